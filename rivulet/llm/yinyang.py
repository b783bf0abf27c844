"""Centroid clustering of integer vectors by Yinyang grouping.

Centroids are put into groups once. Each vector keeps an upper bound of the distance to its own centroid and one lower bound for each
group. When centroids move, the bounds are widened by how far they moved; a vector whose upper bound lies below all lower bounds stays
where it is without any distance (global filter). For the others the upper bound is made exact, then only the groups whose lower bound it does not
undercut are left (group filter), and the centroids of these are scanned exactly. Bounds are widened by more than rounding can lose,
and decide only where they differ, so assignments are those of a full scan, ties included.

State lies beside the vectors in a table of the shared folder that each round reads once and writes once, by any number of tasks. Sums
of the clusters change by the vectors that moved; these are aggregated by Spark, and the driver sees k rows a round.

Defined results: a vector counts if it has exactly ``dims`` components and none is null or non-finite; others give no row. A null id is as an empty text
for the start; of equal ids the smaller vector starts first. Rows that repeat stay rows of their own. With fewer vectors than k there are as many
centroids as vectors, and with none no rows. Components count as at most 2^27 in size after scaling, so that squared distances fit in a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, released, table, written

#: Largest size of a component: 64 * (2 * 2^27)^2 is below 2^63.
LARGEST = 1 << 27
#: Bounds are moved apart by this share and by this much, far more than sums of doubles lose.
SHARE, MORE = 1e-12, 1e-9


def above(squared: np.ndarray) -> np.ndarray:
    """An upper bound of the root."""
    return np.sqrt(squared) * (1 + SHARE) + MORE


def below(squared: np.ndarray) -> np.ndarray:
    """A lower bound of the root."""
    return np.sqrt(squared) * (1 - SHARE) - MORE


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of v to all rows of c."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < 1 << 21:  # sums of 64 products stay below 2^53 in doubles
        v, c = v.astype(np.float64), c.astype(np.float64)
    return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def own_squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    return ((v - c) ** 2).sum(axis=1)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: farthest-first starts, then a few rounds of means. Groups decide what is skipped, never what results."""
    c = centroids.astype(np.float64)
    starts = [0]
    near = ((c - c[0]) ** 2).sum(axis=1)
    while len(starts) < min(groups, len(c)):
        starts.append(int(near.argmax()))
        near = np.minimum(near, ((c - c[starts[-1]]) ** 2).sum(axis=1))
    middle = c[starts]
    for _ in range(5):
        of = ((c[:, None, :] - middle) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.array([c[of == g].mean(axis=0) if (of == g).any() else middle[g] for g in range(len(middle))])
    return np.unique(of, return_inverse=True)[1]


def first_scan(v: np.ndarray, centroids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) of vectors without state."""
    d = squares(v, centroids)
    a = d.argmin(axis=1)  # the first of equals
    upper = above(d[np.arange(len(v)), a])
    d = d.astype(np.float64)
    d[np.arange(len(v)), a] = np.inf
    lower = np.stack([below(d[:, of == g].min(axis=1)) for g in range(of.max() + 1)], axis=1)
    return a, upper, lower


def next_scan(v: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, number of exact distances) after the centroids moved by at most ``drift``."""
    groups = of.max() + 1
    far = np.array([drift[of == g].max() for g in range(groups)])
    a, upper, lower = a.copy(), upper + drift[a], lower - far
    open_ = np.flatnonzero(upper >= lower.min(axis=1))  # global filter
    scanned = len(open_)
    best = own_squares(v[open_], centroids[a[open_]])
    upper[open_] = above(best)
    still = upper[open_] >= lower[open_].min(axis=1)
    open_, best = open_[still], best[still]
    for g in range(groups):
        member = np.flatnonzero(of == g)
        hit = np.flatnonzero(upper[open_] >= lower[open_, g])  # group filter
        if not len(hit):
            continue
        rows = open_[hit]
        d = squares(v[rows], centroids[member])
        scanned += d.size
        other = np.where(member == a[rows][:, None], np.iinfo(np.int64).max, d)
        at = other.argmin(axis=1)
        found = other[np.arange(len(rows)), at]
        better = (found < best[hit]) | ((found == best[hit]) & (member[at] < a[rows]))
        # The bound of a group is that of its nearest centroid but the own one, whichever is that in the end.
        other[np.flatnonzero(better), at[better]] = np.iinfo(np.int64).max
        rest = other.min(axis=1)
        lower[rows, g] = np.where(rest == np.iinfo(np.int64).max, np.inf, below(rest.astype(np.float64)))
        moved = rows[better]
        left = of[a[moved]]
        lower[moved, left] = np.minimum(lower[moved, left], below(best[hit[better]].astype(np.float64)))
        a[moved], best[hit[better]] = member[at[better]], found[better]
        upper[moved] = above(found[better])
    return a, upper, lower, scanned


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, groups: int = 4, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((id, v, cluster, distance) of every vector that counts, final centroids).

    v is floor(scale * x); the start are the k vectors with the smallest sha256 of ``seed:id``; each of ``rounds`` rounds assigns all vectors and replaces
    each centroid that has vectors by the exact floor of their mean; then all are assigned once more. k and dims bound what the driver holds.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col)
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(vec, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    kept = vectors.where(F.coalesce((F.size(vec) == dims) & good, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("v"))
    start = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    kind = vectors.schema[id_col].dataType
    if not start:
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, kind), T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])), np.empty((0, dims), np.int64)
    centroids = np.array([r["v"] for r in start], np.int64)
    of = grouped(centroids, groups)
    fields = f"id {kind.simpleString()}, v array<int>, prev int, cluster int, distance long, upper double, lower array<double>"
    drift = np.zeros(len(centroids))
    sums, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), object)
    state: DataFrame | None = None
    for i in range(rounds + 1):

        def run(batches: Iterator[pa.RecordBatch], c=centroids, moved=drift, first=state is None) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column(1), dims).astype(np.int64)
                if first:
                    prev = pa.nulls(len(v), pa.int32())
                    a, upper, lower = first_scan(v, c, of)
                else:
                    prev = batch.column(2)
                    a, upper, lower, _ = next_scan(v, prev.to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(4), of.max() + 1), c, moved, of)
                columns = [batch.column(0), batch.column(1), prev, pa.array(a, pa.int32()), pa.array(own_squares(v, c[a]), pa.int64()), pa.array(upper), _lists(lower)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "prev", "cluster", "distance", "upper", "lower"])

        came = kept if state is None else state.select("id", "v", "cluster", "upper", "lower")
        after = written(came.mapInArrow(released(run), fields))
        if state is not None:
            drop(state)
        state = after
        if i == rounds:
            break
        # Only vectors that moved change the sums.
        went = state.where("prev is null or prev <> cluster").select("v", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("prev").alias("c"), F.lit(-1).alias("s")))).alias("e")).where("e.c is not null")
        for r in went.groupBy("e.c").agg(F.sum("e.s").alias("n"), F.array(*[F.sum(F.col("v")[j].cast("long") * F.col("e.s")) for j in range(dims)]).alias("t")).collect():
            counts[r["c"]] += r["n"]
            sums[r["c"]] += np.array(r["t"], object)
        new = np.array([sums[j] // counts[j] if counts[j] else centroids[j] for j in range(len(centroids))]).astype(np.int64)
        drift, centroids = above(own_squares(new, centroids).astype(np.float64)), new
    return state.select(F.col("id").alias(id_col), "v", "cluster", "distance"), centroids


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, "embeddings", sf_dir))
    sums = {r[0]: r[1] for r in rows.groupBy("cluster").agg(F.sum("distance")).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    out = [(j, sums.get(j, 0), sum(sums.values()), d) for j, d in enumerate(digest)]
    facts = spark.createDataFrame(out, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _sql(k: int = 16, rounds: int = 3) -> str:
    parts = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT {k}))",
    ]
    near = "a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, v.vec_id, v.v, c.c, list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.v) + list_inner_product(c.v, c.v) AS d FROM v CROSS JOIN c{i} c) GROUP BY r)"
    mean = """m{j} AS (SELECT c, list(floor(s / n) ORDER BY i) AS v FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c),
c{j} AS (SELECT c{i}.c, coalesce(m{j}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{j} USING (c))"""
    for i in range(rounds):
        parts += [near.format(i=i), mean.format(i=i, j=i + 1)]
    parts.append(near.format(i=rounds))
    last = f"a{rounds}"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST({last}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(list_transform(c{rounds}.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} ON c{rounds}.c = {last}.c"
    )


SQL = _sql()
