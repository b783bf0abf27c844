"""Generation layers over a teacher/student graph: pointers, votes, propagation and relaxation.

Rounds are synchronous: all votes of a round see the layers of the round before, so row order decides nothing. Each round is one
join and one aggregate; its result is a table in the shared folder, so plans stay short and lost executors lose nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, written
from .aggregates import grouped_upper_median
from .dictionary import longest_title

LOWEST, HIGHEST = 1, 12
SPREAD = 3


def chase(pointers: DataFrame, key: str = "key", to: str = "to", rounds: int = 32) -> DataFrame:
    """(key, root, cycle): where pointers lead (G6). Pointers double each round; on a cycle the root is null."""
    p = pointers.where(F.col(to).isNotNull() & (F.col(to) != F.col(key))).select(F.col(key).alias("k"), F.col(to).alias("p")).distinct()
    p, done = written(p), False
    for _ in range(rounds):
        up = p.select(F.col("k").alias("p"), F.col("p").alias("pp"))
        step = written(p.join(up, "p", "left").select("k", F.coalesce("pp", "p").alias("q"), F.col("pp").isNotNull().alias("moved")))
        drop(p)
        p = step.select("k", F.col("q").alias("p"), "moved")
        p._rivulet_path = step._rivulet_path
        if not step.where("moved").limit(1).count():
            done = True
            break
    moved = F.coalesce(F.col("moved"), F.lit(False)) if not done else F.lit(False)
    roots = p.select(F.col("k").alias(key), F.when(~moved, F.col("p")).alias("root"), moved.alias("cycle"))
    return pointers.select(key).distinct().join(roots, key, "left").select(key, F.when(F.coalesce("cycle", F.lit(False)), None).otherwise(F.coalesce("root", F.col(key))).alias("root"), F.coalesce("cycle", F.lit(False)).alias("cycle"))


def votes(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(key, vote): a student stands one layer below its teacher, a teacher one above its student. Edges (teacher, student), layers (key, layer)."""
    known = layers.where("layer is not null")
    down = edges.join(known, edges["teacher"] == known["key"]).select(F.col("student").alias("key"), (F.col("layer") + 1).alias("vote"))
    up = edges.join(known, edges["student"] == known["key"]).select(F.col("teacher").alias("key"), (F.col("layer") - 1).alias("vote"))
    return down.unionAll(up)


def propagate(edges: DataFrame, layers: DataFrame, rounds: int = 10, spread: int = SPREAD) -> DataFrame:
    """(key, layer, source, conflict): nodes without layer take the upper median of their votes; votes further apart than ``spread`` are a conflict."""
    state = written(layers.select("key", "layer", F.when(F.col("layer").isNotNull(), "seed").alias("source"), F.lit(False).alias("conflict")))
    for number in range(1, rounds + 1):
        open_keys = state.where("layer is null").select("key")
        cast = votes(edges, state.select("key", "layer")).join(open_keys, "key", "left_semi")
        fit = cast.groupBy("key").agg((F.max("vote") - F.min("vote") > spread).alias("wide"))
        median = grouped_upper_median(cast, ["key"], "vote")
        new = fit.join(median, "key").select("key", "wide", F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), "median")).alias("found"))
        step = state.join(new, "key", "left")
        take = F.col("layer").isNull() & F.col("found").isNotNull() & ~F.coalesce("wide", F.lit(False))
        step = written(step.select("key", F.when(take, F.col("found")).otherwise(F.col("layer")).alias("layer"), F.when(take, F.lit(f"round {number}")).otherwise(F.col("source")).alias("source"), (F.col("conflict") | F.coalesce("wide", F.lit(False))).alias("conflict"), take.alias("took")))
        drop(state)
        state = step.drop("took")
        state._rivulet_path = step._rivulet_path
        if not step.where("took").limit(1).count():
            break
    return state


def relax(edges: DataFrame, seeds: DataFrame, rounds: int = 50, tolerance: float = 1.0) -> DataFrame:
    """(key, value): seeds are pinned, every other node takes the mean of its votes until the summed change is below ``tolerance`` and no node is new."""
    pinned = seeds.where("layer is not null").select("key", F.col("layer").cast("double").alias("pin"))
    state = written(pinned.select("key", F.col("pin").alias("layer")))
    edges = written(edges.select("teacher", "student"))  # each round reads them twice
    pinned = written(pinned)
    for _ in range(rounds):
        mean = votes(edges, state).groupBy("key").agg(F.avg("vote").alias("mean"))
        new = mean.join(pinned, "key", "full_outer").select("key", F.coalesce("pin", "mean").alias("layer"))
        step = written(new.join(state.toDF("key", "old"), "key", "left").select("key", "layer", F.coalesce(F.abs(F.col("layer") - F.col("old")), F.lit(0.0)).alias("moved"), F.col("old").isNull().alias("fresh")))
        change, fresh = step.agg(F.sum("moved"), F.max("fresh")).first()
        drop(state)
        state = step.select("key", "layer")
        state._rivulet_path = step._rivulet_path
        if (change or 0.0) < tolerance and not fresh:
            break
    drop(edges, pinned)
    return state.withColumnRenamed("layer", "value")


def to_aliases(aliases: DataFrame, layers: DataFrame) -> DataFrame:
    """(key, layer, source): aliases without layer take that of their canonical entry (G10). aliases: (key, canonical)."""
    own = layers.select("key", "layer")
    canon = layers.select(F.col("key").alias("canonical"), F.col("layer").alias("canonical_layer"))
    both = aliases.join(own, "key", "left").join(canon, "canonical", "left")
    return both.select("key", F.coalesce("layer", "canonical_layer").alias("layer"), F.when(F.col("layer").isNotNull(), "own").when(F.col("canonical_layer").isNotNull(), "alias").alias("source"))


def seeds_from_references(refs: DataFrame, titles: DataFrame, key: str = "key", name: str = "name") -> DataFrame:
    """(key, layer, confidence) from named authorities (G7): each distinct title votes its layer, high with two or more. Of the titles in a name the longest counts."""
    names = refs.select(F.col(name).alias("__name")).where("__name is not null").distinct()
    hits = refs.join(longest_title(names.withColumn("__text", F.col("__name")), "__name", "__text", titles), F.col(name) == F.col("__name"))
    each = hits.select(key, F.col("layer").alias("vote"), "title").distinct()
    median = grouped_upper_median(each, [key], "vote")
    n = each.groupBy(key).agg(F.count_distinct("title").alias("n"))
    return median.join(n, key).select(key, F.col("median").alias("layer"), F.when(F.col("n") >= 2, "high").otherwise("medium").alias("confidence"))


def split_large(clusters: DataFrame, most: int = 6) -> DataFrame:
    """(node, root): clusters of more than ``most`` nodes fall apart."""
    size = clusters.groupBy("root").agg(F.count("*").alias("n"))
    return clusters.join(size, "root").select("node", F.when(F.col("n") > most, F.col("node")).otherwise(F.col("root")).alias("root"))


def clamp(layer: Column) -> Column:
    return F.when(layer.between(LOWEST, HIGHEST), layer)
