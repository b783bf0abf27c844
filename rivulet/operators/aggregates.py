"""Aggregations beyond the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, by: str) -> DataFrame:
    """Count and percentage of each value."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.select(by, "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4).alias("pct"))


def non_empty(df: DataFrame, column: str) -> Column:
    """Whether a value counts as filled (P8): no null, no blank text, no empty list or map."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "string":
        return c.isNotNull() & (F.trim(c) != "")
    if kind in ("array", "map"):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def field_richness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled): one pass over the data, then turned to rows (A2)."""
    one = df.agg(*[F.count_if(non_empty(df, c)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def upper_median(col: str) -> Column:
    """sorted(values)[count // 2] (A9): the upper middle of an even count, always one of the values. Nulls are left out."""
    values = F.array_sort(F.collect_list(col))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def grouped_upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The same for groups of any size: values are counted first, so a task holds distinct values, not rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    ranked = counts.select(*by, value, F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy(*by)).alias("n"))
    return ranked.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.min(value).alias("median"))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value, in order, at which the weights so far reach half of all."""
    sums = df.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    upto = F.sum("w").over(Window.partitionBy(*by).orderBy(value))
    total = F.sum("w").over(Window.partitionBy(*by))
    return sums.select(*by, value, upto.alias("upto"), total.alias("total")).where(F.col("upto") * 2 >= F.col("total")).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def best_by_rank(df: DataFrame, by: list[str], rank: Column, order: list[str], keep: list[str]) -> DataFrame:
    """The row of lowest rank of each group, ties by ``order`` (A14, W8, W9): one partial aggregate, no sort of groups."""
    return df.groupBy(*by).agg(F.min(F.struct(rank.alias("rank"), *order, *[c for c in keep if c not in order])).alias("b")).select(*by, *[f"b.{c}" for c in keep], "b.rank")


def spread_conflicts(df: DataFrame, by: list[str], value: str, limit: float) -> DataFrame:
    """Groups whose values lie more than ``limit`` apart."""
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).where(F.col("high") - F.col("low") > limit)


def incompatible(df: DataFrame, by: list[str], value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Groups that hold both values of a forbidden pair."""
    has = {v: F.bool_or(F.col(value) == v) for pair in pairs for v in pair}
    both = F.lit(False)
    for a, b in pairs:
        both = both | (F.coalesce(has[a], F.lit(False)) & F.coalesce(has[b], F.lit(False)))
    return df.groupBy(*by).agg(both.alias("conflict"), F.count("*").alias("n")).where("conflict").drop("conflict")


def union_lists(df: DataFrame, by: str, lists: list[str]) -> DataFrame:
    """Sorted set union of list columns over groups."""
    return df.groupBy(by).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists])


def homonyms(df: DataFrame, name: str, key: str) -> DataFrame:
    """Names of several keys, with the sorted keys."""
    return df.groupBy(F.trim(name).alias(name)).agg(F.count_distinct(key).alias("n"), F.array_sort(F.collect_set(key)).alias("keys")).where("n > 1")


def richness(df: DataFrame, scalars: list[str], lists: list[str]) -> Column:
    """Filled scalars plus lengths of lists (A22), the score that picks a group's canonical row."""
    out = F.lit(0)
    for c in scalars:
        out = out + non_empty(df, c).cast("int")
    for c in lists:
        out = out + F.coalesce(F.size(c), F.lit(0))
    return out


def density(df: DataFrame, columns: list[str]) -> DataFrame:
    """Filled share of all fields."""
    filled = sum((F.count_if(non_empty(df, c)) for c in columns[1:]), F.count_if(non_empty(df, columns[0])))
    return df.agg(filled.alias("filled"), (F.count("*") * len(columns)).alias("total")).withColumn("density", F.round(F.col("filled") / F.col("total"), 4))


def numbering_audit(df: DataFrame, number: str) -> DataFrame:
    """Range, distinct, duplicate and missing numbers (A18). Missing ones follow from the counts; ``gap_ranges`` lists them."""
    counts = df.where(F.col(number).isNotNull()).groupBy(number).agg(F.count("*").alias("c"))
    return counts.agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("distinct_numbers"), F.sum(F.when(F.col("c") > 1, F.col("c") - 1).otherwise(0)).alias("duplicates")).withColumn("missing", F.col("high") - F.col("low") + 1 - F.col("distinct_numbers"))
