"""Who may stand in a gap of a chain, and chains beside a chain (M5, J24), on edges (teacher, student).

A person fits between a narrator and a teacher who is too far away if the narrator heard from that person and the person from the teacher. Of the two lists of neighbours that must
intersect only the shorter one is walked; each of its members is then looked up as an edge. A hub therefore costs as much as the person at the other end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def fillers(gaps: DataFrame, edges: DataFrame, layers: DataFrame, key: str = "gap_id") -> DataFrame:
    """(gap_id, between): persons of the wanted layer whom ``before`` heard and who heard ``after``. gaps: (gap_id, before, after, layer), a null layer allows any; layers: (person, layer)."""
    e = edges.select("teacher", "student").where("teacher is not null and student is not null")
    # Only students of somebody behind a gap can fill it, and only where somebody before a gap heard them: other edges are neither sorted nor stored. Small tables are stored first, so that Spark knows them to be small.
    ends, starts = written(gaps.select(F.col("after").alias("teacher")).distinct()), written(gaps.select(F.col("before").alias("student")).distinct())
    taught = written(e.join(ends, "teacher", "left_semi").select("teacher", "student").distinct()).toDF("after", "between")
    people = written(taught.select(F.col("between").alias("teacher")).distinct())
    pairs = written(e.join(people, "teacher", "left_semi").join(starts, "student", "left_semi").select("teacher", "student").distinct()).toDF("between", "before")
    heard, teaches = pairs.groupBy("before").agg(F.count("*").alias("n_heard")), taught.groupBy("after").agg(F.count("*").alias("n_taught"))
    known = gaps.select(key, "before", "after", F.col("layer").alias("wanted")).join(teaches, "after").join(heard, "before")
    short = written(known.withColumn("up", F.col("n_heard") <= F.col("n_taught")).drop("n_heard", "n_taught"))
    by_before = short.where("up").join(pairs, "before").join(taught, ["after", "between"], "left_semi")
    by_after = short.where("not up").join(taught, "after").join(pairs, ["between", "before"], "left_semi")
    columns = [key, "between", "wanted", "before", "after"]
    met = by_before.select(*columns).union(by_after.select(*columns)).where("between <> before and between <> after").distinct()
    of = layers.join(people.toDF("person"), "person", "left_semi").select(F.col("person").alias("between"), F.col("layer").alias("own"))
    return met.join(of, "between", "left").where("wanted is null or own = wanted").select(key, "between")


def gaps_of(links: DataFrame, least: int = 2) -> DataFrame:
    """(chain_id, pos, before, after, layer): neighbours in a chain at least ``least`` layers apart, and the layer between them, one above the narrator's. links: chain_id, pos, person, layer, in order from the narrator up."""
    from pyspark.sql import Window

    w = Window.partitionBy("chain_id").orderBy("pos")
    x = links.withColumns({"after": F.lead("person").over(w), "__l": F.lead("layer").over(w)})
    return x.where(F.col("layer") - F.col("__l") >= least).select("chain_id", "pos", F.col("person").alias("before"), "after", (F.col("layer") - 1).alias("layer"))


def parallel(narrators: DataFrame, edges: DataFrame) -> DataFrame:
    """(narrator, teacher, others): teachers of each narrator whom others heard too, and how many; ``companions`` lists them. Counts are degrees, so no pair of students is formed."""
    e = written(edges.select("teacher", "student").where("teacher is not null and student is not null").distinct())
    n = e.groupBy("teacher").agg((F.count("*") - 1).alias("others"))
    own = e.join(narrators.select(F.col("narrator").alias("student")).distinct(), "student")
    return own.join(n, "teacher").where("others > 0").select(F.col("student").alias("narrator"), "teacher", "others")


def companions(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(narrator, teacher, other): the others on chosen paths of ``parallel``."""
    e = edges.select("teacher", F.col("student").alias("other")).where("teacher is not null and other is not null").distinct()
    return paths.select("narrator", "teacher").join(e, "teacher").where("other <> narrator").select("narrator", "teacher", "other")
