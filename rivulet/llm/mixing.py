"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source gets a target number of words and each of its documents the same expected copies, target / size of the source. Expected copies are prefix-summed
over the source's documents, one random offset of the source is added, and a document is emitted once for each integer boundary that its
sum crosses. Copies are taken in the order of the documents' sizes (systematic sampling of an ordered list spreads the copies over all sizes), so the
words of a source miss its target by about one document at most. So that one long document can't miss it by much, what a document has beyond
1/SLICES of its source is dealt in slices of that size, each with its own expected copies; its slices stand together, and their
boundaries are counted at once.

Sums are numbers of units, exact integers; a prefix is a product, so no rounding adds up. They are made in two steps: rows of a source are counted by
bins of size and id, no more than BIN rows each (rows that repeat an id and size are one row with a number), and windows run over the bins of a source,
then over the rows of a bin. A source may therefore hold most of the rows.

Defined results: a word is a run without ASCII white space; null and empty texts have none, take none and are returned. Sources are numbered by code point, null last, as a
source of its own, and weigh 1, 2, 3, repeating. Rows that repeat stay rows of their own, each with its share; null ids are as one id. An empty table gives an empty result. The offset
depends on seed and source alone and the order on ids and sizes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scan
from .common import table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Shares of a source that a slice of a document holds at most.
SLICES = 4096
#: Classes of sizes by which copies are ordered, and rows of a bin.
CLASSES, BIN = 1024, 10_000
#: Rows of one repeated id that are made in one piece.
PIECE = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size): all words shared by weight, no source above ``most`` times its own, the excess reshared until none is above.

    A source is above when most * size / weight is at most what the others leave for a unit of weight. In the order of that ratio those above come first,
    so one pass over running sums finds them. Sums are over sources, dealt into ranges.
    """
    ranked = scan.numbered(sizes, [F.col("source").isNull(), F.col("source")], "i")
    w = F.lit(weights[-1])
    for j, x in enumerate(weights[:-1]):
        w = F.when((F.col("i") - 1) % len(weights) == j, x).otherwise(w)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    known = written(ranked.withColumn("weight", w.cast("long")).select("source", "source_size", "weight", "i"))
    words, weights_all = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    ratio = F.col("source_size") * F.lit(_product(weights)) / F.col("weight")  # exact: each weight divides the product
    p = scan.parts(known.withColumn("ratio", ratio), [], ["ratio", "i"])
    r = scan.running(p, [], {"before": F.col("source_size"), "weights_before": F.col("weight")})
    # most * size * (weights left) <= (words left) * weight
    above = (big("source_size") * most * (F.lit(weights_all) - big("weights_before"))) <= (F.lit(words) - big("before") * most) * big("weight")
    r = written(r.select("source", "source_size", "weight", (above & F.lit(words > 0)).alias("above")))
    capped, left = r.agg(F.coalesce(F.sum(F.when(F.col("above"), F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("above"), F.col("weight"))), F.lit(0))).first()
    share = F.lit((words - capped) / left if left else 0.0)
    return r.select("source", "source_size", "weight", F.when(F.col("above"), (F.col("source_size") * most).cast("double")).otherwise(share * F.col("weight")).alias("target"))


def _hash(*columns: Column) -> Column:
    """32 bits of the md5 of the values as text; of nulls, those of empty texts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).cast("binary")), 1, 8), 16, 10).cast("long")


def _product(weights: tuple[int, ...]) -> int:
    out = 1
    for w in set(weights):
        out *= w
    return out


def _cut(name: str, by: list[str], rows: DataFrame) -> DataFrame:
    """Adds ``name``: the units of ``k`` in all earlier rows of the same ``by``, by bins and then by rows of a bin."""
    bins = rows.groupBy(*by, "class").agg(F.count("*").alias("c"))
    rows = rows.join(bins, [*by, "class"]).withColumn("bin", _hash(F.col("id"), F.col("size")) % F.expr(f"1 + c div {BIN}"))
    sums = rows.groupBy(*by, "class", "bin").agg(F.sum("k").alias("units"))
    earlier = sums.withColumn("base", F.coalesce(F.sum("units").over(Window.partitionBy(*by).orderBy("class", "bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(*by, "class", "bin").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("__in", F.coalesce(F.sum("k").over(inside), F.lit(0))).join(earlier.drop("units"), [*by, "class", "bin"])
    return both.withColumn(name, F.col("base") + F.col("__in")).drop("c", "bin", "base", "__in", "class", "k")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 1) -> DataFrame:
    """(id, size, source, source_size, target, taken) of every document; ``taken`` are the words that the mix takes of it, repeats counted."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.size(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0)).alias("size"))
    sized = sized.withColumn("size", F.greatest("size", F.lit(0)))
    rows = written(sized.groupBy("id", "source", "size").agg(F.count("*").alias("m")))
    goal = written(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, most))
    # Sources by number, for joins and windows: null is one of them.
    goal = written(scan.numbered(goal, [F.col("source").isNull(), F.col("source")], "s"))
    slice_ = F.greatest(F.lit(1), F.expr(f"(source_size + {SLICES} - 1) div {SLICES}"))
    offset = _hash(F.lit(seed), F.col("source")) % (1 << 20) / (1 << 20)
    rate = F.coalesce(F.col("target") / F.expr("nullif(source_size, 0)"), F.lit(0.0))
    facts = goal.select(F.col("source").alias("__of"), "s", "source_size", "target", slice_.alias("slice"), rate.alias("rate"), offset.alias("u"))
    known = rows.join(facts, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    known = written(known.withColumns({"full": F.expr("size div slice"), "rest": F.expr("size % slice")}))
    # Units of a source: first rests from small to large, then full slices, each counted over all earlier ones.
    rests = F.when(F.col("rest") > 0, F.col("m")).otherwise(0)
    units = _cut("rests_before", ["s"], known.withColumn("class", F.expr(f"(rest * {CLASSES}) div slice")).withColumn("k", rests))
    all_rests = known.groupBy("s").agg(F.sum(rests).alias("rests"))
    units = written(_cut("full_before", ["s"], units.withColumn("class", _hash(F.col("id"), F.col("size")) % 64).withColumn("k", F.col("full") * F.col("m"))).join(all_rests, "s"))
    crossed = lambda at, n: F.floor((at + n) * F.col("rate") + F.col("u")) - F.floor(at * F.col("rate") + F.col("u"))
    words = crossed(F.col("rests") + F.col("full_before") + F.col("j") * F.col("full"), F.col("full")) * F.col("slice") + F.when(F.col("rest") > 0, crossed(F.col("rests_before") + F.col("j"), F.lit(1)) * F.col("rest")).otherwise(0)
    # Rows that repeat are made again, those of a hot id in pieces that are dealt anew.
    several = units.where("m > 1").withColumn("piece", F.explode(F.expr(f"sequence(0L, (m - 1) div {PIECE})"))).repartition("s", "id", "size", "piece")
    several = several.withColumn("j", F.explode(F.expr(f"sequence(piece * {PIECE}, least(m, (piece + 1) * {PIECE}) - 1)"))).drop("piece")
    each = units.where("m = 1").withColumn("j", F.lit(0).cast("long")).unionByName(several)
    return each.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", F.least(words, F.col("size") * most).cast("long").alias("taken"))


def op13_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, "documents", sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id AS id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS w FROM g),
o AS (SELECT *, coalesce(sum(ss) OVER b, 0) AS before, coalesce(sum(w) OVER b, 0) AS wb, sum(ss) OVER () AS t, sum(w) OVER () AS tw FROM w WINDOW b AS (ORDER BY ss * 6 // w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, t > 0 AND ss * 3 * (tw - wb) <= (t - before * 3) * w AS above FROM o),
x AS (SELECT coalesce(sum(ss * 3) FILTER (above), 0) AS capped, sum(w) FILTER (NOT above) AS rest FROM a),
s AS (
  SELECT source, ss, CASE WHEN above THEN CAST(ss * 3 AS DOUBLE) ELSE coalesce(CAST(t - capped AS DOUBLE) / CAST(rest AS DOUBLE) * w, 0) END AS target, greatest(1, (ss + {SLICES - 1}) // {SLICES}) AS slice,
         (CAST('0x' || substr(md5('1:' || coalesce(source, '')), 1, 8) AS BIGINT) % 1048576) / 1048576 AS u FROM a, x),
k AS (
  SELECT r, id, size, ss, target, slice, u, CASE WHEN ss > 0 THEN target / ss ELSE 0 END AS rate, size // slice AS f, size % slice AS q, s.source AS src, CAST('0x' || substr(md5(coalesce(CAST(id AS VARCHAR), '') || ':' || size), 1, 8) AS BIGINT) AS h
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT *, q * {CLASSES} // slice AS c1, h % 64 AS c2, count(*) FILTER (q > 0) OVER (PARTITION BY src) AS qs FROM k),
n AS (SELECT src, c1, count(*) AS n1 FROM (SELECT DISTINCT src, c1, id, size FROM c) GROUP BY 1, 2),
m AS (SELECT src, c2, count(*) AS n2 FROM (SELECT DISTINCT src, c2, id, size FROM c) GROUP BY 1, 2),
b AS (SELECT c.*, h % (1 + n1 // {BIN}) AS b1, h % (1 + n2 // {BIN}) AS b2 FROM c JOIN n ON c.src IS NOT DISTINCT FROM n.src AND c.c1 = n.c1 JOIN m ON c.src IS NOT DISTINCT FROM m.src AND c.c2 = m.c2),
p AS (
  SELECT *, coalesce(sum(CASE WHEN q > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY c1, b1, id NULLS FIRST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p1,
         qs + coalesce(sum(f) OVER (PARTITION BY src ORDER BY c2, b2, id NULLS FIRST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p2 FROM b)
SELECT id AS doc_id, size, ss AS source_size, target, CAST(least((floor((p2 + f) * rate + u) - floor(p2 * rate + u)) * slice + CASE WHEN q > 0 THEN (floor((p1 + 1) * rate + u) - floor(p1 * rate + u)) * q ELSE 0 END, size * 3) AS BIGINT) AS taken FROM p"""
