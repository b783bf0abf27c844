"""Rivulet: a PySpark-native engine for record reconciliation, chain analysis and corpus preparation."""
