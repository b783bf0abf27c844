"""Additive evidence scores, runner-up gates, weakest-link grades and cascades as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def additive(parts: list[tuple[str, Column, Column]]) -> tuple[Column, Column]:
    """(score, reasons) of parts (name, condition, points); a null condition counts for nothing."""
    score, reasons = F.lit(0.0), []
    for name, condition, points in parts:
        hit = F.coalesce(condition, F.lit(False))
        score = score + F.when(hit, points.cast("double")).otherwise(0.0)
        reasons.append(F.when(hit, F.lit(name)))
    return score, F.array_compact(F.array(*reasons))


def decide(scored: DataFrame, by: list[str], score: str, order: list[str], high: float, medium: float, gap: float) -> DataFrame:
    """The best row of each group with its confidence: ambiguous if the runner-up is closer than ``gap`` (C11)."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *order)
    best = scored.withColumns({"runner_up": F.lead(score).over(w), "__n": F.row_number().over(w)}).where("__n = 1").drop("__n")
    close = F.col("runner_up").isNotNull() & (F.col(score) - F.col("runner_up") < gap)
    return best.withColumn("confidence", F.when(close, "ambiguous").when(F.col(score) >= high, "high").when(F.col(score) >= medium, "medium").otherwise("low"))


def weakest_link(links: DataFrame, chain: str, flags: dict[str, Column], grades: list[tuple[str, str]], best: str) -> DataFrame:
    """Each chain's grade: of ``grades`` (flag, grade) the first whose flag any link raises, else ``best``."""
    folded = links.groupBy(chain).agg(F.count("*").alias("n_links"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(f) for f, c in flags.items()])
    grade = F.lit(best)
    for flag, name in reversed(grades):
        grade = F.when(F.col(flag), name).otherwise(grade)
    return folded.select(chain, "n_links", grade.alias("grade"))


def evidence(rows: list[DataFrame], key: str) -> DataFrame:
    """(key, kinds, total) of evidence frames (key, kind, weight), summed (M3, M6)."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy(key).agg(F.count_distinct("kind").alias("kinds"), F.sum("weight").alias("total"))


def assessment(score: Column) -> Column:
    """Labels of summed evidence."""
    return F.when(score >= 10, "very strong").when(score >= 6, "strong").when(score >= 3, "moderate").when(score >= 1, "weak").otherwise("insufficient")


def cascade(rules: list[tuple[Column, str]], default: str | None) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(default)
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return out
