"""Corpus preparation in five stages; each stage's result is stored as Parquet and read again as the next one's documents.

Documents that the quality classifier rejects go, one document of each near-duplicate group stays, repeated sentence spans are cut (documents of
which nothing is left go), documents that carry benchmark items go, and the rest is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import decontaminate, ngram_join, packing, quality, substring_dedup
from rivulet.llm.common import begin_stage, drop, table, written

#: Five-word shingles and Jaccard of 0.8 or more make near duplicates.
SHINGLE, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin_stage()
    return quality.select(docs, table(spark, "labels", sf_dir))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin_stage()
    return ngram_join.keep_first(docs, k=SHINGLE, percent=PERCENT)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin_stage()
    out = substring_dedup.dedup(docs).where("removed = 0 or length(trim(text)) > 0")
    return out.withColumn("n_chars", F.when(F.col("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin_stage()
    return decontaminate.decontaminate(docs, table(spark, "benchmark", sf_dir))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    begin_stage()
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: Trained models and a tokenizer decide here, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    docs = table(spark, "documents", sf_dir)
    for _, stage in STAGES[:-1]:
        stored = written(stage(spark, docs, sf_dir), of_stage=False)
        drop(docs)
        docs = stored
    return STAGES[-1][1](spark, docs, sf_dir)
