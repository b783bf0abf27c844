"""Training-data operators: filters, deduplication, decontamination, language ID, packing, chat formatting.

Nothing else in the library imports this subpackage; ``registry`` lists its queries and SQL.
"""
