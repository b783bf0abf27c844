"""Spelling variants: a self-join of the vocabulary at one edit by tries with active-node sets.

Two words one edit apart agree before or behind the middle of the shorter one. The trie of all words is therefore partitioned by prefixes of
half a word, that of all words read from the end likewise; each partition is a subtrie whose root stands behind the part that is kept, and the
rest of a word is its window. A word stands in the partitions of its own length and in those of partners that are one shorter. A partition with more
than MOST words is split again at the middle of its window, until one letter is left, so no partition grows with the
vocabulary. Of several windows that could hold an inserted letter the last one counts, so each pair is found once.

Within partitions nodes are propagated level by level. The active nodes of a node are those within one edit: at distance nought the node
itself, at distance one its siblings, its parent, its children, and the equal-letter children of active nodes of its parent. Distance is symmetric, so of each
two nodes only one holds the other: pairs of one level, and pairs of a node and a deeper one. Pairs of terminals are the result. All partitions of
a batch are propagated together.

Defined results: null texts hold no words, a null id is as an empty text; rows that repeat count twice; a table without words of
enough length and number gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.layers import chase
from .common import drop, released, rows_of, table, written

LETTERS = "a-zÀ-ÿ"
#: Words of a partition that is not split any more.
MOST = 4096
#: Words of the partitions that are propagated together, and letters of their windows.
TOGETHER, CELLS = 16_384, 8_000_000
#: Words that a task counts before it hands its counts on.
HELD = 200_000
#: Every so many-th word of a document loses a letter.
LOSES = 31


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, fewest: int = 2, loses: int = LOSES) -> DataFrame:
    """(word, n) of all words of at least ``shortest`` letters with at least ``fewest`` occurrences.

    Words are maximal runs of letters, A-Z lower-cased. A word whose crc32 of ``id:word`` is a multiple of ``loses`` loses the letter at that number modulo its length.
    """
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")  # a shorter run has no such part, so matches are whole runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in rows_of(batches):
            for key, text in zip(batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1)).to_pylist(), strict=True):
                start = zlib.crc32(f"{key or ''}:".encode())
                for w, n in Counter(runs.findall(text or "")).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % loses == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < shortest:
                            continue
                    held[w] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    counted = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def _placed(rows: DataFrame, places: Column) -> DataFrame:
    """Rows at the partitions ``places``, structs of m (length of the shorter word), a (first letter of the window) and w (its length)."""
    rows = rows.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.m", "p.a", "p.w")
    behind = F.expr("substring(word, a + w + 1 + length(word) - m)")
    return rows.withColumn("key", F.xxhash64("m", "a", "w", F.expr("substring(word, 1, a)"), behind))


def _halves(m: str, a: str, w: str) -> list[str]:
    return [f"named_struct('m', {m}, 'a', {a} + {w} div 2, 'w', {w} - {w} div 2)", f"named_struct('m', {m}, 'a', {a}, 'w', cast({w} div 2 as int))"]


def partitions(words: DataFrame, shortest: int = 7, most: int = MOST) -> list[DataFrame]:
    """Frames (word, n, m, a, w, key) of partitions of the tries, by how often they were split."""
    length = "length(word)"
    own, less = _halves(length, "0", length), _halves(f"{length} - 1", "0", f"({length} - 1)")
    kind = "array<struct<m:int,a:int,w:int>>"
    level = _placed(words, F.expr(f"cast(if({length} > {shortest}, array({', '.join(own + less)}), array({', '.join(own)})) as {kind})"))
    out = []
    while True:
        full = written(level.groupBy("key").agg(F.count("*").alias("c"), F.first("w").alias("w")).where(f"c > {most} and w > 1").select("key"))
        if not full.limit(1).count():
            drop(full)
            return [*out, level]
        out.append(level.join(full, "key", "left_anti"))
        level = _placed(level.join(full, "key", "left_semi").select("word", "n", "m", "a", "w").withColumnsRenamed({"m": "m0", "a": "a0", "w": "w0"}).withColumn("__p", F.expr(f"cast(array({', '.join(_halves('m0', 'a0', 'w0'))}) as {kind})")), F.col("__p"))


class Forest:
    """Tries of the windows of all partitions of a batch, level by level: a node is a place in the sorted array of parent * 256 + letter."""

    def __init__(self, group: np.ndarray, letters: np.ndarray, width: int, long: np.ndarray):
        """``letters`` has a row of width + 1 letters for each word; words that are not ``long`` have width."""
        self.width, self.at = width, []
        self.keys, self.short, self.long = [], [], []
        node, rows = group, np.arange(len(group))
        for depth in range(width + 2):
            if depth:
                rows = rows if depth <= width else np.flatnonzero(long)
                node = node[rows] if depth > width else node
                keys, node = np.unique(node * 256 + letters[rows, depth - 1], return_inverse=True)
            else:
                keys, node = np.unique(group, return_inverse=True)
            self.keys.append(keys)
            has = np.zeros((2, len(keys)), bool)
            has[long[rows].astype(int), node] = True
            self.short.append(has[0])
            self.long.append(has[1])
            if depth == width:
                self.ends_short = self._ends(node[~long], np.flatnonzero(~long), len(keys))
        self.ends_long = self._ends(node, rows, len(keys))

    @staticmethod
    def _ends(node: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, -1)
        out[node] = row
        return out

    def children(self, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``node``, child) of all children."""
        keys = self.keys[depth + 1]
        low = np.searchsorted(keys, node * 256)
        n = np.searchsorted(keys, node * 256 + 256) - low
        return np.repeat(np.arange(len(node)), n), np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)

    def matched(self, pairs: tuple[np.ndarray, np.ndarray], depth: int, other: int) -> tuple[np.ndarray, np.ndarray]:
        """The equal-letter children of pairs of nodes at two depths."""
        of, child = self.children(pairs[0], depth)
        keys = self.keys[other + 1]
        wanted = pairs[1][of] * 256 + (self.keys[depth + 1][child] & 255)
        found = np.searchsorted(keys, wanted)
        hit = found < len(keys)
        hit[hit] = keys[found[hit]] == wanted[hit]
        return child[hit], found[hit]

    def siblings(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes of one parent below which short words end."""
        node = np.flatnonzero(self.short[depth])
        parent = self.keys[depth][node] >> 8
        first = np.searchsorted(parent, parent)
        before = np.arange(len(node)) - first
        later = np.repeat(np.arange(len(node)), before)
        earlier = np.arange(before.sum()) - np.repeat(np.cumsum(before) - before, before) + np.repeat(first, before)
        return node[earlier], node[later]

    def _deeper(self, depth: int, pairs: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Active pairs of nodes at ``depth`` and one deeper: children, and those that go on."""
        top = np.flatnonzero(self.short[depth])
        of, child = self.children(top, depth)
        a, b = top[of], child
        if pairs is not None:
            a, b = np.r_[a, pairs[0]], np.r_[b, pairs[1]]
        keep = self.short[depth][a] & self.long[depth + 1][b]
        both = np.unique(a[keep] << 32 | b[keep])
        return both >> 32, both & 0xFFFFFFFF

    def pairs(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of words one edit apart. An insertion right behind the window belongs to another partition unless the window is ``whole``, that is, ends the shorter word."""
        none = np.empty(0, np.int64)
        level, deeper = (none, none), self._deeper(0, None)
        for depth in range(self.width):
            a, b = self.matched(level, depth, depth)
            go = self.short[depth + 1][a] & self.short[depth + 1][b]
            sa, sb = self.siblings(depth + 1)
            level = np.r_[a[go], sa], np.r_[b[go], sb]
            deeper = self._deeper(depth + 1, self.matched(deeper, depth, depth + 1))
        a, b = self.ends_short[level[0]], self.ends_short[level[1]]
        ok = (a >= 0) & (b >= 0)
        x, y = self.ends_short[deeper[0]], self.ends_long[deeper[1]]
        fine = (x >= 0) & (y >= 0)
        fine &= whole[x] | (self.keys[self.width + 1][deeper[1]] >> 8 != deeper[0])
        return np.r_[a[ok], x[fine]], np.r_[b[ok], y[fine]]


def _found(part: pa.Table) -> pa.RecordBatch | None:
    """Both directions of all near pairs of some whole partitions of one window length."""
    words = part.column("word").to_pylist()
    size = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("latin-1") + b"\0", np.uint8)
    m, a = part.column("m").to_numpy(), part.column("a").to_numpy()
    width, long = part.column("w")[0].as_py(), size > m
    start = np.cumsum(size) - size + a
    letters = flat[np.minimum(start[:, None] + np.arange(width + 1), len(flat) - 1)].astype(np.int64)
    group = np.unique(part.column("key").to_numpy(), return_inverse=True)[1]
    x, y = Forest(group, letters, width, long).pairs(a + width == m)
    # Keys are hashes: the kept parts of a pair must agree.
    same = np.array([words[i][: a[i]] == words[j][: a[j]] and words[i][a[i] + width :] == words[j][a[j] + width + len(words[j]) - len(words[i]) :] for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
    x, y = x[same], y[same]
    if not len(x):
        return None
    word, n = part.column("word").combine_chunks(), part.column("n").combine_chunks()
    one, two = pa.array(np.r_[x, y]), pa.array(np.r_[y, x])
    return pa.RecordBatch.from_arrays([word.take(one), word.take(two), n.take(two)], names=["word", "near", "near_n"])


def near_words(parts: DataFrame, tasks: int) -> DataFrame:
    """(word, near, near_n): both directions of each pair one edit apart, from whole partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, w = batch.column("key").to_numpy(), batch.column("w").to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (w[1:] != w[:-1])) + 1
            for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(key)].tolist(), strict=True):
                if held:
                    last = held[-1]
                    wide = last.column("w")[0].as_py()
                    begins = last.column("key")[0].as_py() != int(key[a]) or wide != int(w[a])
                    n = sum(x.num_rows for x in held)
                    if begins and (wide != int(w[a]) or n + b - a > TOGETHER or (n + b - a) * (wide + 1) > CELLS):
                        if (out := _found(pa.Table.from_batches(held))) is not None:
                            yield out
                        held = []
                held.append(batch.slice(a, b - a))
        if held and (out := _found(pa.Table.from_batches(held))) is not None:
            yield out

    rows = parts.select("word", "n", "m", "a", "w", "key").repartition(tasks, "key").sortWithinPartitions("w", "key")
    return rows.mapInArrow(released(run), "word string, near string, near_n long")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, fewest: int = 2, ratio: int = 10, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word. The form is the near word of most occurrences, ties to the smallest, if it has ``ratio`` times those of the word; root is where forms lead."""
    spark = docs.sparkSession
    words = written(vocabulary(docs, id_col, text_col, shortest, fewest))
    tasks = max(spark.sparkContext.defaultParallelism, words.count() // 20_000)
    found: DataFrame | None = None
    for part in partitions(words, shortest, most):
        near = near_words(part, tasks)
        found = near if found is None else found.union(near)
    best = found.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("b"))
    rows = words.join(best, "word", "left").withColumn("ok", F.coalesce(-F.col("b.n") >= ratio * F.col("n"), F.lit(False)))
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("ok"), F.col("b.near")).alias("form"), F.when(F.col("ok"), -F.col("b.n")).alias("form_n")))
    roots = chase(rows.where("form is not null").select("word", "form"), "word", "form").select("word", "root")  # forms have more occurrences, so there is no cycle
    drop(words)
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, "documents", sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


# crc32 by its definition: the table of the remainders of all bytes, then one look-up a byte of the UTF-8 text (code points below 256).
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) x(i))),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
one AS (SELECT id, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY 1, 2),
bytes AS (
  SELECT id, w, n, flatten(list_transform(list_transform(string_split(id || ':' || w, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END)) AS b FROM one),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda h, x: xor(h >> 8, crc.t[xor(h & 255, x) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
less AS (SELECT DISTINCT w, n, i, left(w, i) || substr(w, i + 2) AS d FROM (SELECT w, n, unnest(range(length(w))) AS i FROM v)),
pairs AS (
  SELECT a.w, b.w AS near, b.n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.w <> b.w
  UNION SELECT v.w, l.w, l.n FROM v JOIN less l ON l.d = v.w
  UNION SELECT l.w, v.w, v.n FROM v JOIN less l ON l.d = v.w),
best AS (SELECT w, count(*) AS n_near, max(n) AS n, arg_min(near, (-n, near)) AS near FROM pairs GROUP BY w),
f AS (
  SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * v.n THEN near END AS form, CASE WHEN b.n >= 10 * v.n THEN b.n END AS form_n FROM v LEFT JOIN best b USING (w)),
r AS (SELECT w, w AS root, 0 AS depth FROM f UNION ALL SELECT r.w, f.form, depth + 1 FROM r JOIN f ON f.w = r.root WHERE f.form IS NOT NULL)
SELECT f.w AS word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN (SELECT w, arg_max(root, depth) AS root FROM r GROUP BY w) USING (w)"""
