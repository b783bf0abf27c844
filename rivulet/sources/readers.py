"""Sources and sinks (S1-S22). Paths may lie in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The main table (D2); keys that a file lacks are null.
ENTRY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("name_ar", "father", "grandfather", "kunyah", "laqab", "nisba", "status", "status_detail", "sect", "canonical_entry", "identity_confidence", "_num_najaf", "_num_beirut", "_num_tehran", "_raw", "tabaqah_source")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("aliases", "alias_entry_nums", "same_as_entry_nums", "narrates_from_imams", "narrates_from_narrators", "narrated_from_by", "companions_of", "books", "status_sources")]
    + [T.StructField(c, T.IntegerType()) for c in ("hadith_count", "birth_year_hijri", "death_year_hijri", "_entry_idx")]
    + [T.StructField("tabaqah", T.DoubleType()), T.StructField("has_book", T.BooleanType())]
    + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("birth_year_window", "death_year_window")]
)
RAW = "idx int, n1 string, n2 string, n3 string, text string"


def json_objects(spark: SparkSession, path: str, schema: T.StructType = ENTRY) -> DataFrame:
    """One JSON object of objects as rows (S1): entry_key, the fields of ``schema``, and src_ord, the place in the file.

    A file is one JSON value, so one task reads it; keep large tables as Parquet and read this form once.
    """
    text = spark.read.text(path, wholetext=True)
    pairs = F.map_entries(F.from_json("value", T.MapType(T.StringType(), schema)))
    rows = text.select(F.posexplode(pairs).alias("src_ord", "e"))
    return rows.select(F.col("e.key").alias("entry_key"), "src_ord", "e.value.*")


def json_array(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Raw entries of a JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def optional(read: Callable[[], DataFrame], spark: SparkSession, schema) -> DataFrame:
    """What ``read`` gives, or no rows where its path is missing."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files (S9), numbered from 0, ready for ``scan.assemble``.

    Large files are read by many tasks: lines are counted by split, and a line's number is its place in the split behind the lines of the splits before.
    Only one row a split is moved. A last line end starts no further line.
    """
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = spark.read.text(path).select(split.alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    counts = rows.groupBy("at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("at.file").orderBy("at.start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col("at").alias("of"), (before - F.col("first")).alias("shift"))
    numbered = rows.join(base, F.col("at") == F.col("of"))
    return numbered.select(F.col("at.file").alias("file"), (F.col("id") + F.col("shift")).alias("line_no"), "line")


def binary(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """(file, text) of scans or PDF files by a given extractor (S10, S11); no OCR engine comes with the library."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            yield b.assign(text=[extract(x) for x in b["content"]])[["file", "text"]]

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.mapInPandas(run, "file string, text string")


def fetched(spark: SparkSession, books: list[str], fetch: Callable[[str], list[dict]], schema: str, text: str, least: int = 15) -> DataFrame:
    """Records of a paged service by a given client (S12, S14): one task a book; texts under ``least`` characters go. Tests pass an offline client."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [f.split()[0] for f in schema.split(",")]
        for b in batches:
            rows = [r for book in b["book"] for r in fetch(book)]
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    asked = spark.createDataFrame([(x,) for x in books], "book string").repartition(max(1, len(books)))
    return asked.mapInPandas(run, schema).where(F.length(text) >= least)


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """Point lookup (S2); on bucketed or sorted files the filter reaches the scan."""
    return df.where(F.col(key) == value)


def equal_name(df: DataFrame, column: str, name: str, normal: Callable[[Column], Column]) -> DataFrame:
    """Equality of normalised names."""
    return df.where(normal(F.col(column)) == normal(F.lit(name)))


def pick_random(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows that a seed picks (O7): the order is the md5 of seed and key, so it holds on any cluster."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), key).limit(n)


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet done (S21); several runs over shared output resume here."""
    return df.join(done.select(key), key, "left_anti")


def quarantine(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows."""
    flag = F.coalesce(bad, F.lit(True))
    return df.where(~flag), df.where(flag)


def store(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Full rewrite by Spark's commit protocol."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def store_version(df: DataFrame, path: str, version: int) -> str:
    """A new version beside the old ones."""
    to = f"{path}/version={version:06d}"
    df.write.mode("errorifexists").parquet(to)
    return to


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that ``store_version`` wrote whole, oldest first; one that a failed write left behind is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("version=")]
    whole = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in whole)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as it was in a version, else in the newest."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {version} below {path}: {known}")
    return spark.read.parquet(f"{path}/version={known[-1] if version is None else version:06d}")


def restore(spark: SparkSession, path: str, version: int) -> str:
    """An old version written again as the newest; nothing is lost."""
    return store_version(read_version(spark, path, version), path, versions(spark, path)[-1] + 1)


def store_split(df: DataFrame, path: str, part: str, most_chars: int = 200) -> None:
    """JSON by part, and CSV with cut texts."""
    df.write.mode("overwrite").partitionBy(part).json(f"{path}/json")
    cut = [F.substring(c, 1, most_chars).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes if not k.startswith(("array", "map", "struct"))]
    df.select(*cut).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/csv")


def store_report(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A report as one text file of lines, in order (S19); reports are small by their kind."""
    df.orderBy(*order).select(F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns])).coalesce(1).write.mode("overwrite").text(path)


def next_key(df: DataFrame, key: str) -> DataFrame:
    """The next free number of a text key."""
    return df.agg((F.coalesce(F.max(F.col(key).try_cast("long")), F.lit(0)) + 1).cast("string").alias(key))
