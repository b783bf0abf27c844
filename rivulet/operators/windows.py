"""Positional operators over ordered rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds the previous and next value."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"prev_{value}": F.lag(value).over(w), f"next_{value}": F.lead(value).over(w)})


def gap_severity(gap: Column) -> Column:
    """Of a layer minus the next one's (W2): major from 3 or -2, minor from 2 or -1, else none."""
    return F.when((gap >= 3) | (gap <= -2), "major").when((gap >= 2) | (gap <= -1), "minor")


def gap_note(gap: Column) -> Column:
    """A gap of layers in words (N38), null where there is none to speak of."""
    # The notes.
    inverted = F.concat(F.lit("طبقة مقلوبة: الشيخ أحدث من الراوي بـ "), F.abs(gap).cast("string"), F.lit(" طبقة"))
    wide = F.concat(F.lit("فجوة "), gap.cast("string"), F.lit(" طبقات — إرسال أو سقط رواة"))
    near = F.when(gap == -1, "فجوة طبقة واحدة عكسية — الراوي من طبقة سابقة (محتمل عند الرواة المعمّرين)").when(gap == 2, "فجوة طبقة واحدة — إرسال محتمل")
    return F.when(gap <= -2, inverted).when(gap > 2, wide).otherwise(near)


def last_before(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last non-null value strictly before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, by: list[str], order: list[str], member: Column, least: int = 1) -> DataFrame:
    """(by, first, last, n) of runs of consecutive rows for which ``member`` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = df.withColumn("__m", F.coalesce(member, F.lit(False))).withColumn("__run", F.sum(F.when(F.col("__m"), 0).otherwise(1)).over(w))
    at = F.struct(*order)
    runs = flagged.where("__m").groupBy(*by, "__run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("__run")


def number_ranges(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Consecutive ranges of numbers."""
    w = Window.partitionBy(*by).orderBy(number)
    runs = df.select(*by, number).distinct().withColumn("__g", F.col(number) - F.row_number().over(w))
    return runs.groupBy(*by, "__g").agg(F.min(number).alias("low"), F.max(number).alias("high")).drop("__g")


def gap_ranges(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Ranges of missing numbers between those that occur (W6, X22), without listing each."""
    w = Window.partitionBy(*by).orderBy(number)
    nxt = df.select(*by, number).distinct().withColumn("__next", F.lead(number).over(w))
    return nxt.where(F.col("__next") > F.col(number) + 1).select(*by, (F.col(number) + 1).alias("low"), (F.col("__next") - 1).alias("high"))


def next_valid(df: DataFrame, by: list[str], order: list[str], valid: Column, name: str, reach: int = 9) -> DataFrame:
    """Adds the first valid value among the next ``reach`` rows."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, reach)
    return df.withColumn(name, F.first(valid, ignorenulls=True).over(w))


def assemble(lines: DataFrame, file: str, line_no: str, text: str, header: Column, stop: Column | None = None) -> DataFrame:
    """Entries of line streams (X4, X5, X9), for many short files; ``scan.assemble`` takes files of any length. A header starts one, following lines belong to it, a stop line ends it. (file, entry, n_lines, text)."""
    w = Window.partitionBy(file).orderBy(line_no)
    marked = lines.withColumn("__h", F.coalesce(header, F.lit(False)).cast("int")).withColumn("__s", F.coalesce(stop, F.lit(False)).cast("int") if stop is not None else F.lit(0))
    marked = marked.withColumn("entry", F.sum("__h").over(w)).withColumn("__dead", F.max("__s").over(Window.partitionBy(file, "entry").orderBy(line_no)))
    kept = marked.where((F.col("entry") > 0) & (F.col("__dead") == 0))
    parts = F.array_sort(F.collect_list(F.struct(line_no, text)))
    return kept.groupBy(file, "entry").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(parts, lambda x: x[text]), "\n").alias("text"))


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group in a total order (O1); Spark prunes each partition to k rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def near_best(df: DataFrame, by: list[str], score: str, within: float, order: list[str], most: int) -> DataFrame:
    """Rows behind the best by at most ``within``, the first ``most`` of them (O3)."""
    ranked = top_k(df, by, [F.desc(score), *order], most + 1)
    top = F.max(score).over(Window.partitionBy(*by))
    return ranked.withColumn("top", top).where((F.col("rank") > 1) & (F.col(score) >= F.col("top") - within))
