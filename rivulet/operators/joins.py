"""Join operators that Spark has no single node for: each one becomes equi-joins that shuffle on their keys.

Nothing here broadcasts by hint: Spark's own size threshold and adaptive execution choose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def band_join(left: DataFrame, right: DataFrame, left_num: str, right_num: str, width: int) -> DataFrame:
    """Inner join on abs(left_num - right_num) <= width (J9): the left side is dealt to the two bins that its band can touch, so any width is two rows."""
    size = 2 * width + 1
    bins = F.array_distinct(F.array(F.floor((F.col(left_num) - width) / size), F.floor((F.col(left_num) + width) / size)))
    a = left.withColumn("__bin", F.explode(bins))
    b = right.withColumn("__bin", F.floor(F.col(right_num) / size))
    return a.join(b, "__bin").where(F.abs(F.col(left_num) - F.col(right_num)) <= width).drop("__bin")


def unique_key_cascade(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], value: str, stop_on_ambiguous: bool = False) -> DataFrame:
    """``left`` with ``value`` of the right row that the first key matches uniquely, and the number of that key in ``via``.

    With ``stop_on_ambiguous`` a key that matches several rows ends the search instead of handing on to the next key.
    """
    out, pick, via, stopped = left, F.lit(None).cast(right.schema[value].dataType), F.lit(None).cast("int"), F.lit(False)
    for i, (a, b) in enumerate(zip(left_keys, right_keys, strict=True)):
        index = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias(f"__k{i}")).agg(F.count("*").alias(f"__n{i}"), F.min(value).alias(f"__v{i}"))
        out = out.join(index, F.col(a) == F.col(f"__k{i}"), "left")
        hit = (F.col(f"__n{i}") == 1) & pick.isNull() & ~stopped
        if stop_on_ambiguous:
            stopped = stopped | (F.coalesce(F.col(f"__n{i}"), F.lit(0)) > 1)
        pick, via = F.when(hit, F.col(f"__v{i}")).otherwise(pick), F.when(hit, i + 1).otherwise(via)
    return out.select(*left.columns, pick.alias(value), via.alias("via"))


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], left_num: str, right_num: str, order: list[str]) -> DataFrame:
    """Each left row with the right row of the same key at the smallest distance, ties by ``order`` (J8). Left rows are told apart by all their columns."""
    both = left.join(right, on)
    best = F.min(F.struct(F.abs(F.col(left_num) - F.col(right_num)).alias("distance"), *[F.col(c) for c in order], F.struct(*[F.col(c) for c in right.columns if c not in on]).alias("row"))).alias("best")
    picked = both.groupBy(*left.columns).agg(best)
    return picked.select(*left.columns, "best.row.*", "best.distance")


def containment_join(queries: DataFrame, forms: DataFrame, query_id: str, query_tokens: str, form_id: str, form_tokens: str) -> DataFrame:
    """(query, form) pairs with all tokens of the query among the form's (J3, X26), through the query's rarest token and a check.

    Only a query's rarest token is joined, so frequent tokens fan out no pairs.
    """
    f = forms.select(F.col(form_id).alias("__f"), F.array_distinct(form_tokens).alias("__ft"))
    posting = f.select("__f", F.explode("__ft").alias("__t"))
    q = queries.select(F.col(query_id).alias("__q"), F.array_distinct(query_tokens).alias("__qt")).where(F.size("__qt") > 0)
    asked = q.select("__q", "__qt", F.explode("__qt").alias("__t"))
    count = posting.join(asked.select("__t").distinct(), "__t", "left_semi").groupBy("__t").agg(F.count("*").alias("__n"))
    rare = asked.join(count, "__t").groupBy("__q", "__qt").agg(F.min(F.struct("__n", "__t")).alias("r"), F.count("*").alias("known"))
    rare = rare.where(F.col("known") == F.size("__qt")).select("__q", "__qt", F.col("r.__t").alias("__t"))
    met = rare.join(posting, "__t").select("__q", "__qt", "__f").join(f, "__f").where(F.size(F.array_except("__qt", "__ft")) == 0)
    return met.select(F.col("__q").alias(query_id), F.col("__f").alias(form_id))


#: Tokens and number of the queries that one scan of the candidates holds; larger query sets take several scans.
HELD_TOKENS, HELD_QUERIES = 20_000, 500
#: Numbers of the dense block of candidates and tokens that a task multiplies at a time.
BLOCK_CELLS = 4_000_000


def shared_tokens(queries: DataFrame, candidates: DataFrame, query_id: str, query_tokens: str, cand_tokens: str, least: int = 1) -> DataFrame:
    """The candidates' other columns with ``query_id`` and ``overlap`` for each row pair that shares at least ``least`` distinct tokens.

    A frequent token would pair all its queries and candidates in a join. So blocks of queries go to the tasks, which count by a product of two 0/1 matrices; only pairs leave a task.
    """
    hashed = lambda c: F.transform(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))), lambda x: F.xxhash64(x))
    asked = queries.select(F.col(query_id).alias("q"), hashed(F.col(query_tokens)).alias("h")).where("size(h) > 0")
    tokens, number = asked.agg(F.sum(F.size("h")), F.count("*")).first()
    blocks = max(1, -(-(tokens or 0) // HELD_TOKENS), -(-number // HELD_QUERIES))
    block = F.pmod(F.xxhash64("q", "h"), F.lit(blocks))
    others = [c for c in candidates.columns if c != cand_tokens]
    body = candidates.select(*others, hashed(F.col(cand_tokens)).alias("__h"))
    q_type, spark = queries.schema[query_id].dataType, queries.sparkSession
    schema = T.StructType([candidates.schema[c] for c in others] + [T.StructField(query_id, q_type), T.StructField("overlap", T.LongType())])

    def scan(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, sets, vocabulary = sent.value
            matrix = np.zeros((len(vocabulary), len(keys)), np.float32)
            for j, own in enumerate(sets):
                matrix[np.searchsorted(vocabulary, own), j] = 1
            step = max(1, BLOCK_CELLS // max(1, len(vocabulary)))
            for whole in batches:
                for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    lists = batch.column(len(others))
                    flat = lists.flatten().to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                    at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
                    hit = vocabulary[at] == flat
                    block = np.zeros((batch.num_rows, len(vocabulary)), np.float32)
                    block[row[hit], at[hit]] = 1
                    both = np.rint(block @ matrix).astype(np.int64)
                    rows, cols = np.nonzero(both >= least)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(len(others))), pa.array([keys[j] for j in cols.tolist()], to_arrow_type(q_type)), pa.array(both[rows, cols])], names=[f.name for f in schema])

        return run

    out = None
    for i in range(blocks):
        rows = asked.where(block == i).collect()
        if not rows:
            continue
        sets = [np.array(r[1], np.int64) for r in rows]
        found = body.mapInArrow(scan(spark.sparkContext.broadcast(([r[0] for r in rows], sets, np.unique(np.concatenate(sets))))), schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def overlap_topk(queries: DataFrame, candidates: DataFrame, query_id: str, query_tokens: str, cand_id: str, cand_tokens: str, k: int, least: int = 1, keep: Column | None = None) -> DataFrame:
    """The k candidates of each query that share most distinct tokens (J10, J11), ties by id; ``keep`` filters on columns of both sides. Ids are unique on each side."""
    met = shared_tokens(queries, candidates, query_id, query_tokens, cand_tokens, max(1, least))
    if keep is not None:
        met = met.join(queries.drop(query_tokens), query_id).where(keep)
    w = Window.partitionBy(query_id).orderBy(F.desc("overlap"), cand_id)
    return met.select(query_id, cand_id, "overlap").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def only_in_left(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Anti join."""
    return left.join(right, on, "left_anti")


def known_only(left: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Batch lookup: rows whose key is asked for (S3)."""
    return left.join(keys, on, "left_semi")


def keyed_compare(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer comparison of two versions (J15, J16, U1): key, state (only_old, only_new, same, changed) and the changed columns."""
    a, b = old.select(key, *[F.col(c).alias(f"__o_{c}") for c in columns], F.lit(1).alias("__o")), new.select(key, *[F.col(c).alias(f"__n_{c}") for c in columns], F.lit(1).alias("__n"))
    diff = F.array_compact(F.array(*[F.when(~F.col(f"__o_{c}").eqNullSafe(F.col(f"__n_{c}")), c) for c in columns]))
    state = F.when(F.col("__n").isNull(), "only_old").when(F.col("__o").isNull(), "only_new").when(F.size(diff) > 0, "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"), F.when(state == "changed", F.array_join(diff, ",")).otherwise("").alias("changed"))


def backfill(df: DataFrame, source: DataFrame, key: str, scalars: list[str], lists: list[str] = ()) -> DataFrame:
    """Fills null scalars and appends unseen list items from a source with unique keys."""
    src = source.select(key, *[F.col(c).alias(f"__s_{c}") for c in [*scalars, *lists]])
    out = df.join(src, key, "left")
    empty = lambda c: F.coalesce(c, F.array().cast(df.schema[c_name].dataType))
    made = {c: F.coalesce(F.when(F.col(c).cast("string") == "", None).otherwise(F.col(c)), F.col(f"__s_{c}")) for c in scalars}
    for c_name in lists:
        made[c_name] = F.array_union(empty(F.col(c_name)), empty(F.col(f"__s_{c_name}")))
    return out.withColumns(made).select(*df.columns)


def common_neighbours(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(a, b, common): pairs of destinations with a shared source, counted."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    return e.toDF("s", "a").join(e.toDF("s", "b"), "s").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))


def two_hops(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(a, c, ways): ends of paths over one intermediary."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    return e.toDF("a", "m").join(e.toDF("m", "c"), "m").where("a <> c").groupBy("a", "c").agg(F.count("*").alias("ways"))
