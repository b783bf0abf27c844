"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from . import audio, chat_format, decontaminate, language, mixing, ngram_join, packing, quality, spelling, substring_dedup, toxicity, url_filter, yinyang

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_media_fingerprints": audio.op5_media_fingerprints,
    "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
    "op7_language_id": language.op7_language_id,
    "op8_packing": packing.op8_packing,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_centroid_clustering": yinyang.op11_centroid_clustering,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_source_mixing": mixing.op13_source_mixing,
}

SQL = {
    "op1_url_filter": url_filter.SQL,
    "op6_ngram_jaccard_join": ngram_join.SQL,
    "op9_chat_format": chat_format.SQL,
    "op11_centroid_clustering": yinyang.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_source_mixing": mixing.SQL,
}
