"""Exact Jaccard join of word-shingle sets with count-vector R-trees.

Tokens (shingle hashes) are hashed into groups. The counts of 256 groups are a set's point; the sum over groups of the smaller
count bounds the overlap of two sets, and of a set with all that lies below a tree node by the node's largest counts.
Global trees over such points do not separate unrelated texts of one size (their boxes overlap in every coordinate), so
points are first dealt into cells by the same kind of hashing. Sets whose sizes allow a link differ in at most D tokens, so of
G token groups at least G - D hold the same tokens in both. By prefix filtering, any order of all possible group contents has then one
that both sets have among their first D + 1; with the fullest groups first, the key of a cell is a group with the hash of its
several tokens, which unrelated sets hardly share, however many there are. A set with fewer than D + 1 groups in use adds the keys of
its first tokens (of which linked sets of that kind share one), so that an empty group is never a key. Links between different sets are
found in two steps:

1. Each cell's members are compared with one of them, the one that shares most cells (one row a member, never all pairs of a cell).
2. Cells whose other members are not yet all connected are joined by R-trees, in blocks of bounded size; of small cells the few pairs
   are listed, each once however many cells show it. Pairs that the links of step 1 connect are skipped, for they cannot change a component.

Pairs that survive the bound are verified on the whole sets. Copies with equal sets are one node throughout.

Defined results: null text is as an empty one; texts without words have no shingles and link with nothing; texts with fewer words
than a shingle has are one shingle of all words; rows with equal ids stay rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import drop, key_filter, mix64, passes, released, rows_of, table, written

GROUPS = 256
FIRST, RATIO = 10, 1.5
#: Cell groups of a set for each one whose content is a key.
SPARE = 2
#: Last bits of a key that are left out when keys of several sets are looked for.
KEY_REST = 24
#: Members of a block that a task joins with itself or another one: a few MB of counts.
BLOCK = 2048
LEAF = 16
#: Members of a cell, but for its hub, whose pairs are listed (28 at most); larger cells take the trees.
SMALL = 8
#: Rows of a task that joins blocks by trees.
TREE_ROWS = 5000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(255 << 56)


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of the values at each of n places (exact: both halves stay below 2^53)."""
    low = np.bincount(at, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    return low + (np.bincount(at, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64) << np.uint64(32))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of all texts, and where each text's end; only A-Z are lower-cased, only ASCII white space separates."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words = lists.flatten()
    some = np.asarray(pc.not_equal(words, "").to_numpy(zero_copy_only=False), bool)  # the edges of a text may split off empty words
    ends = np.cumsum(np.r_[0, some])[np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)])]
    coded = words.filter(pa.array(some)).dictionary_encode()
    codes = np.array([xxhash.xxh3_64_intdigest(w.as_buffer()) for w in coded.dictionary], np.uint64)
    h = codes[coded.indices.to_numpy(zero_copy_only=False)] if len(codes) else np.empty(0, np.uint64)
    n = np.diff(ends)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    stop = np.cumsum(count)
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out = mix64(out * _STEP + h[i : i + len(out)] + np.uint64(i))
    flat = np.empty(int(stop[-1]) if len(stop) else 0, np.uint64)
    for a, m, c, s in zip(ends[:-1].tolist(), n.tolist(), count.tolist(), stop.tolist(), strict=True):
        if m >= k:
            flat[s - c : s] = out[a : a + c]
            flat[s - c : s].sort()
        elif m:
            flat[s - 1] = xxhash.xxh3_64_intdigest(h[a : a + m].tobytes(), seed=m)
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    first[(stop - count)[count > 0]] = True
    return flat[first], np.cumsum(np.r_[0, first])[stop]


def signatures(h: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    return mix64(_sums(mix64(h), owner, len(n)) + n.astype(np.uint64) * _STEP).view(np.int64)


def bands(percent: int, most: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size, last size, and the most tokens D in which two linked sets differ whose smaller one has a size of the band."""
    edges = [1, FIRST]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
    low, top = np.array(edges[:-1]), np.array(edges[1:]) - 1
    return low, top, (100 - percent) * (top + top * 100 // percent) // (100 + percent)


def cell_keys(h: np.ndarray, ends: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owners) of the cells of all sets: in the band of a set's size, and in those where a smaller partner may lie."""
    low, top, differ = bands(percent)
    start = np.r_[0, ends[:-1]]
    n = ends - start
    own = np.searchsorted(low, n, side="right") - 1
    keys, owners = [], []
    for back in range(len(low)):
        at = np.flatnonzero((n > 0) & (own - back >= 0))
        at = at[top[own[at] - back] * 100 >= n[at] * percent]
        if not len(at):
            break
        band = own[at] - back
        at, band = at[differ[band] > 0], band[differ[band] > 0]  # else only equal sets link
        if not len(at):
            continue
        groups = SPARE * (differ[band] + 1)
        base = np.cumsum(np.r_[0, groups])
        tokens = np.concatenate([h[a:b] for a, b in zip(start[at].tolist(), ends[at].tolist(), strict=True)])
        of = np.repeat(np.arange(len(at)), n[at])
        place = base[of] + ((tokens >> np.uint64(17)) % groups[of].astype(np.uint64)).astype(np.int64)
        number = np.arange(base[-1]) - np.repeat(base[:-1], groups)
        content = mix64(_sums(mix64(tokens), place, base[-1]) + (np.repeat(band, groups).astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)) * _STEP)
        held = np.bincount(place, minlength=base[-1])
        order = (255 - np.minimum(held, 255)).astype(np.uint64) << np.uint64(56) | content >> np.uint64(8)  # fullest groups first
        for i, (a, b, need) in enumerate(zip(base[:-1].tolist(), base[1:].tolist(), (differ[band] + 1).tolist(), strict=True)):
            order[a:b].sort()
            used = order[a : a + need]
            if used[-1] >= _EMPTY:
                used = used[used < _EMPTY]
                size, tokens_at = int(n[at[i]]), start[at[i]]
                first = h[tokens_at : tokens_at + size - -(-percent * size // 100) + 1]
                used = np.r_[used, mix64(first + np.uint64((int(band[i]) + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1))]
            keys.append(used)
            owners.append(np.full(len(used), at[i]))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def points(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, th, n, sig, vec, keys) of every row; th is the hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 2_000_000):
            h, ends = shingle_sets(batch.column(2), k)
            n, rows = np.diff(np.r_[0, ends]), batch.num_rows
            owner = np.repeat(np.arange(rows), n)
            none = n == 0
            vec = np.bincount(owner * GROUPS + (h & np.uint64(GROUPS - 1)).astype(np.int64), minlength=rows * GROUPS)
            vec = np.minimum(vec, 65535).astype("<u2").reshape(rows, GROUPS)
            keys, of = cell_keys(h, ends, percent)
            order = np.argsort(of, kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, np.bincount(of, minlength=rows)]), pa.int32()), pa.array(keys[order], pa.int64()))
            columns = [pa.array(n, pa.int64()), pa.array(signatures(h, owner, n), pa.int64(), mask=none), pa.array([None if x else v for x, v in zip(none.tolist(), _packed(vec), strict=True)], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "th", "n", "sig", "vec", "keys"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), f"id {kind}, th long, n long, sig long, vec binary, keys array<long>")


class CountTree:
    """A bulk-loaded R-tree over count vectors: leaves of LEAF points in order of size and of the two coordinates that vary most, with the largest counts of each node."""

    def __init__(self, vec: np.ndarray, n: np.ndarray):
        wide = np.argsort(-vec.var(axis=0), kind="stable")[:2] if len(n) else (0, 1)
        self.order = np.lexsort((vec[:, wide[1]], vec[:, wide[0]], n)) if len(n) else np.empty(0, np.int64)
        self.vec, self.n = vec[self.order], n[self.order]
        self.levels = []  # from leaves to the root: largest counts, smallest and largest size
        top, low, high = self.vec, self.n, self.n
        while len(top) > 1 or not self.levels:
            cut = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))
            if len(top) == 1:
                break

    def search(self, q: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Indices of all points whose bound allows Jaccard >= percent with a set of the given point and size."""
        at = np.array([0])
        for depth in range(len(self.levels) - 1, -2, -1):
            top, low, high = self.levels[depth] if depth >= 0 else (self.vec, self.n, self.n)
            near = at[(low[at] * percent <= size * 100) & (size * percent <= high[at] * 100)]
            bound = np.minimum(top[near], q).sum(axis=1)
            # J >= t needs an overlap of t / (1 + t) of both sizes; below a node, of its smallest size.
            at = near[bound * (100 + percent) >= percent * (size + np.maximum(low[near], -(-size * percent // 100)))]
            if depth >= 0:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < (len(self.levels[depth - 1][0]) if depth else len(self.vec))]
        return self.order[at]


def _packed(vec: np.ndarray) -> list[bytes]:
    """Count vectors in 4, 8 or 16 bits a count, as their largest one needs."""
    top = vec.max(axis=1, initial=0).tolist()
    half, byte = (vec[:, 0::2] | vec[:, 1::2] << 4).astype(np.uint8), vec.astype(np.uint8)
    return [half[i].tobytes() if t < 16 else byte[i].tobytes() if t < 256 else vec[i].tobytes() for i, t in enumerate(top)]


def _vectors(col: pa.Array) -> np.ndarray:
    data = col.to_pylist()
    size, out = np.array([len(x) for x in data], np.int64), np.empty((len(data), GROUPS), np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        raw = np.frombuffer(b"".join(data[i] for i in at.tolist()), "<u2" if n == 2 * GROUPS else np.uint8).reshape(len(at), -1)
        if n == GROUPS // 2:
            raw = np.stack([raw & 15, raw >> 4], axis=2).reshape(len(at), GROUPS)
        out[at] = raw
    return out


def tree_pairs(rows: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs (a, b) between both sides of each task g that the trees' bound allows, but for rows of one root. Rows of side 2 are both sides of their task."""
    rows = rows.select("g", "side", "sig", "root", "n", "vec").repartition(tasks, "g").sortWithinPartitions("g", "side")

    def join(part: pa.RecordBatch) -> list[tuple[int, int]]:
        side = part.column(1).to_numpy()
        cut, own = int(np.count_nonzero(side == 0)), bool(side[-1] == 2)
        sig, root, n = (part.column(c).to_numpy() for c in (2, 3, 4))
        if own:
            cut = len(sig)
        elif not 0 < cut < len(sig):
            return []
        vec = _vectors(part.column(5))
        tree, found = CountTree(vec[:cut], n[:cut]), set()
        for i in range(0 if own else cut, len(sig)):
            hit = tree.search(vec[i], int(n[i]), percent)
            found.update((min(int(sig[i]), x), max(int(sig[i]), x)) for x in sig[hit[root[hit] != root[i]]].tolist())
        return sorted(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that may go on in the next batch
        pairs = lambda found: pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
        whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            start = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)].tolist()
            for a, b in zip(start, start[1:], strict=False):
                if a or (held and held[0].column(0)[0].as_py() != int(g[0])):
                    if held:
                        yield pairs(join(whole()))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield pairs(join(whole()))

    return rows.mapInArrow(released(run), "a long, b long")


def cells_of(pts: DataFrame) -> DataFrame:
    """(key, pivot, others, sig): the members of cells of several sets, but for the one that shares most cells, the pivot; ``others`` is their number.

    Keys of one set are left behind by a filter before anything is joined.
    """
    spark, some = pts.sparkSession, pts.where("sig is not null")
    row = F.xxhash64("sig", "id", "th")
    first = written(some.groupBy("sig").agg(F.min(F.struct("id", "th")).alias("r")).select(F.xxhash64("sig", "r.id", "r.th").alias("row")))
    once = spark.sparkContext.broadcast(key_filter(first, "row", 64))

    @F.pandas_udf("boolean")
    def new_set(row: pd.Series) -> pd.Series:
        return pd.Series(passes(once.value, row.to_numpy(np.int64)))

    # Every set is counted once, and a copy that the filter lets pass again: so a key of several sets has a count of 2 at least. Keys of which the
    # first bits agree count as one. Both may let more keys pass, never fewer, and what is moved is half as long as whole keys with their sets.
    counted = some.where(new_set(row)).select(F.explode("keys").alias("key")).groupBy(F.shiftrightunsigned("key", KEY_REST).alias("key")).count()
    several = written(counted.where("count > 1").select("key"))
    drop(first)
    sent = spark.sparkContext.broadcast(key_filter(several, "key", 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, seen = sent.value, set()
        for batch in batches:
            new = [i for i, s in enumerate(batch.column(0).to_pylist()) if not (s in seen or seen.add(s))]  # copies once a task
            batch = batch.take(pa.array(new, pa.int64()))
            lists = batch.column(1)
            keys, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            hit = passes(mask, (keys.view(np.uint64) >> np.uint64(KEY_REST)).view(np.int64))
            shared = np.bincount(owner[hit], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit], pa.int64()), batch.column(0).take(pa.array(owner[hit])), pa.array(shared[owner[hit]], pa.int32())], names=["key", "sig", "shared"])

    likely = written(pts.where("sig is not null").select("sig", "keys").mapInArrow(released(run), "key long, sig long, shared int"))
    drop(several)
    # The number of rows is that of members but for copies in several tasks: it may be too high, never too low.
    hub = written(likely.groupBy("key").agg(F.max(F.struct("shared", "sig")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", F.col("hub.sig").alias("pivot"), (F.col("n") - 1).alias("others")))
    cells = written(likely.join(hub, "key").where("sig <> pivot").select("key", "pivot", "others", "sig"))
    drop(likely, hub)
    return cells


def bounded(pairs: DataFrame, vec: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose count vectors allow a link: the summed minima bound the overlap."""
    both = pairs.join(vec.toDF("a", "na", "va"), "a").join(vec.toDF("b", "nb", "vb"), "b").where(f"least(na, nb) * 100 >= greatest(na, nb) * {percent}").select("a", "b", "na", "nb", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                least = np.minimum(_vectors(batch.column(4)), _vectors(batch.column(5))).sum(axis=1)
                sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                yield batch.select([0, 1]).filter(pa.array(least * (100 + percent) >= percent * sizes))

    return both.mapInArrow(released(run), "a long, b long")


def verified(docs: DataFrame, text_col: str, pts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set signatures whose sets link; the sets of no other texts are made or moved."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    texts = written(pts.select("sig", "th").join(ids, "sig").groupBy("sig").agg(F.min("th").alias("th")).select("th"))
    sent = spark.sparkContext.broadcast(key_filter(texts, "th", 256))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, seen = sent.value, set()
        for whole in batches:
            th = whole.column(0).to_numpy()
            hit = [i for i in np.flatnonzero(passes(mask, th)).tolist() if not (int(th[i]) in seen or seen.add(int(th[i])))]  # copies once a task
            for batch in rows_of([whole.take(pa.array(hit, pa.int64()))], 2_000_000):
                h, ends = shingle_sets(batch.column(1), k)
                n = np.diff(np.r_[0, ends])
                sig = signatures(h, np.repeat(np.arange(len(n)), n), n)
                data = [h[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(data, pa.binary())], names=["sig", "h"]).filter(pa.array(n > 0))

    made = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(released(sets), "sig long, h binary")
    held = written(made.dropDuplicates(["sig"]))
    both = pairs.join(held.select(F.col("sig").alias("b"), F.col("h").alias("hb")), "b").join(held.select(F.col("sig").alias("a"), F.col("h").alias("ha")), "a").select("a", "b", "ha", "hb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (x.size + y.size - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = written(both.mapInArrow(released(check), "a long, b long"))
    drop(texts, held)
    sent.unpersist()
    return links


def _rooted(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, th, n, root) of every row, stored: rows of one root are reached by links of Jaccard >= percent/100; those without shingles have none."""
    spark = docs.sparkSession
    if not 50 <= percent <= 99:
        raise ValueError("percent must lie between 50 and 99")
    pts = written(points(docs, id_col, text_col, k, percent))
    cells = cells_of(pts)
    keyed, pts = pts, written(pts.drop("keys"))  # the keys are most of the table
    drop(keyed)
    pairs = written(cells.select(F.col("pivot").alias("a"), F.col("sig").alias("b")).distinct())
    used = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    vec = written(pts.select("sig", "n", "vec").join(used, "sig").groupBy("sig").agg(F.first("n").alias("n"), F.first("vec").alias("vec")))

    # Step 1: members against the hub of their cell.
    star = written(bounded(pairs, vec, percent))
    drop(pairs)
    links = verified(docs, text_col, pts, star, k, percent)
    root = components(links)

    # Step 2: cells with members of several components.
    rooted = written(cells.where("others > 1").select("key", "others", "sig").join(root.toDF("sig", "to"), "sig", "left").select("key", "others", "sig", F.coalesce("to", "sig").alias("root")))
    few = rooted.where(F.col("others") <= SMALL)
    listed = few.select("key", F.col("sig").alias("a"), F.col("root").alias("ra")).join(few.select("key", F.col("sig").alias("b"), F.col("root").alias("rb")), "key").where("a < b and ra <> rb").select("a", "b").distinct()
    early = written(bounded(listed, vec, percent))
    member = rooted.where(F.col("others") > SMALL).select("key", "sig", "root").distinct()
    mixed = member.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("sig")).alias("all")).where("r0 < r1")
    mixed = mixed.groupBy("m", "all").agg(F.min("key").alias("key")).select("key", "m")  # cells with the same members are one
    member = written(member.join(mixed, "key"))
    part = member.groupBy("key", "root").agg(F.count("*").alias("c"))
    block = F.when(F.col("c") >= BLOCK, F.struct(F.col("root").alias("r"), F.expr(f"pmod(xxhash64(sig), ceil(c / {BLOCK}))").alias("i"))).otherwise(F.struct(F.lit(None).cast("long").alias("r"), F.expr(f"pmod(xxhash64(root), ceil(m / {BLOCK}))").alias("i")))
    member = written(member.join(part, ["key", "root"]).select("key", "sig", "root", block.alias("blk")))
    blocks = member.groupBy("key", "blk").agg(F.count("*").alias("c")).select("key", "blk")
    tasks = blocks.join(blocks.withColumnRenamed("blk", "blk2"), "key").where("blk <= blk2 and not (blk.r is not null and blk2.r is not null and blk.r = blk2.r)")
    sides = tasks.select("key", "blk", "blk2", F.explode(F.when(F.col("blk").eqNullSafe(F.col("blk2")), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side")).withColumn("own", F.when(F.col("side") == 1, F.col("blk2")).otherwise(F.col("blk")))
    sides = sides.select("key", "own", "side", F.xxhash64("key", "blk", "blk2").alias("g"))
    rows = sides.join(member.withColumnRenamed("blk", "own"), ["key", "own"]).select("g", "side", "sig", "root").join(vec, "sig")
    late = written(tree_pairs(rows, percent, max(spark.sparkContext.defaultParallelism, math.ceil(member.count() * 2 / TREE_ROWS))).where("a <> b").union(early).distinct())
    drop(cells, member, rooted, early)
    if late.limit(1).count():
        more = verified(docs, text_col, pts, late, k, percent)
        final = components(links.union(more))
        drop(root, more)
        root = final
    drop(star, late, vec)

    # Rows are joined to roots on tables, so that Spark can split the rows of a large group.
    linked = written(pts.select("id", "th", "n", "sig").join(root.toDF("sig", "to"), "sig", "left").select("id", "th", "n", F.coalesce("to", "sig").alias("root")))
    drop(pts, root, links)
    return linked


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the smallest id that links of Jaccard >= percent/100 reach."""
    linked = _rooted(docs, id_col, text_col, k, percent)
    least = written(linked.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id")))
    own = linked.where("root is null").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    found = linked.where("root is not null").join(least, "root").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return found.union(own)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, nulls last, and of rows with one id that of the smallest text hash.

    Ids need not be unique: rows are told apart by id and text, so an unrelated row with the id of a copy stays. Rows that agree in both are copies, of which one stays, whatever
    their other columns hold. Rows without words are no copies of anything and all stay.
    """
    linked = _rooted(docs, id_col, text_col, k, percent).where("root is not null")
    who = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    best = written(linked.groupBy("root").agg(F.min(who).alias("first")))
    # Of each group the first row is looked for; of that row's id and text one row may stay, of the others none.
    fate = linked.join(best, "root").groupBy("id", "th").agg(F.bool_and((F.col("th") == F.col("first.th")) & F.col("id").eqNullSafe(F.col("first.id"))).alias("stays"), F.count("*").alias("n"))
    fate = written(fate.where("not stays or n > 1").select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("stays").alias("__stays")))
    # Only rows whose text may be one of these are joined, so the other texts are not moved.
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(fate, "__th", 64))

    @F.pandas_udf("boolean")
    def likely(th: pd.Series) -> pd.Series:
        return pd.Series(passes(sent.value, th.to_numpy(np.int64)))

    marked = docs.withColumn("__like", likely(F.xxhash64(text_col)) & F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    others, some = marked.where("not __like").select(*docs.columns), marked.where("__like").select(*docs.columns)
    of = some[id_col].eqNullSafe(fate["__id"]) & (F.xxhash64(some[text_col]) == fate["__th"])
    left = others.unionByName(some.join(fate, of, "left_anti"))
    if not fate.where("__stays").limit(1).count():
        return left
    several = some.join(fate.where("__stays"), of).drop("__id", "__stays").dropDuplicates([id_col, "__th"])
    return left.unionByName(several.select(*docs.columns))


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, "documents", sf_dir), k=3, percent=90)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM w),
h AS (SELECT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (
  SELECT a AS doc_id, a AS o FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.o)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.o, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(o) AS o FROM r GROUP BY 1) m USING (doc_id)"""
