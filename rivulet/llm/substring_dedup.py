"""Substring deduplication by sliding sentence spans.

A text is cut into sentences; a sentence of more than LONG words is cut further after the words whose hash is the least of some GAP
words in a row (winnowing). So no part is longer than GAP words, and equal passages are cut alike but for their first and last GAP - 1
words, wherever they stand: each shared run of over 50 words inside such sentences holds a span. From every sentence a span runs over
at least ``span`` sentences and ``min_words`` words; the hash of its words is joined over all documents. The occurrence in the document
with the smallest id (in it, the first one) stays; sentences that any other occurrence covers are removed.

Defined results: null text stays null and has no spans; rows that share an id count as one document (none is behind the other, repeats inside
each row are removed); rows with a null id are never behind others; a text shorter than one span is kept; white space belongs to the
sentence before it, and at the start of a text to the first one; an empty table gives an empty result; all columns of the input stay, and a column
``removed`` of the input is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, key_filter, passes, released, rows_of, table, written
from .lexical import LETTER, WORD, code_points, lowered, run_hashes

SPAN = 3
MIN_WORDS = 25
LONG = 20
GAP = 8  # 1 + 1 + 2 + 4 words, as ``cut`` doubles

SPACE, LINE, STOP, CLOSE, WIDE = range(1, 6)


@cache
def _kinds() -> np.ndarray:
    """Of each code point of the basic plane: white space, line end, stop, sign that may close a sentence behind its stop, stop without white space, or 0."""
    out = np.fromiter((chr(i).isspace() for i in range(1 << 16)), np.uint8, 1 << 16)
    for kind, signs in ((LINE, "\n"), (STOP, ".!?"), (CLOSE, "\"'”’)]"), (WIDE, "。！？")):
        out[list(map(ord, signs))] = kind
    return out


def cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the hash of each word, the first word of each sentence and the number of words, the place in the text where each sentence begins and its length)."""
    codes = code_points(lowered(text))
    kind = _kinds()[np.minimum(codes, 0xFFFF)]
    gap = np.ones(len(codes) + 2, bool)
    gap[1:-1] = (kind == SPACE) | (kind == LINE)
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    wide = np.flatnonzero(kind == WIDE) + 1
    if len(wide):  # a word ends there as well
        wide = wide[(wide < len(codes)) & ~gap[np.minimum(wide + 1, len(codes) + 1)]]
        wide = wide[kind[wide] != WIDE]
        start, end = np.sort(np.concatenate([start, wide])), np.sort(np.concatenate([end, wide]))
    n = len(start)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    words = run_hashes(codes.astype(np.uint64), start, end, LETTER)
    last = end - 1
    while len(back := np.flatnonzero((kind[last] == CLOSE) & (last > start))):
        last[back] -= 1
    ends = np.flatnonzero((kind[last] == STOP) | (kind[end - 1] == WIDE)) + 1
    first = np.unique(np.concatenate([[0, n], ends, np.searchsorted(start, np.flatnonzero(kind == LINE))]))
    long = np.flatnonzero(np.diff(first) > LONG)
    if len(long):
        # The least of GAP words in a row, the last of equal ones: a hash with the place from behind in its low half.
        key = words & np.uint64(0xFFFFFFFF << 32) | np.arange(n, 0, -1).astype(np.uint64)
        least = key
        for step in (1, 2, 4):  # of 2, 4 and 8 words in a row
            least = np.minimum(least[:-step], least[step:])
        inside = np.zeros(n + 1, np.int8)
        inside[first[long]] = 1
        inside[first[long + 1] - GAP + 1] = -1
        picked = n - (least[np.cumsum(inside[: len(least)]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.unique(np.concatenate([first, picked + 1]))
    return words, first, np.concatenate([[0], start[first[1:-1]], [len(text)]])


def spans(text: str, span: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each span its hash, its number of sentences, and whether an equal one stands before it in the text; it begins at the sentence of its place."""
    words, first, _ = cut(text)
    n = len(first) - 1
    last = np.maximum(np.arange(n) + span, np.searchsorted(first, first[:-1] + min_words))
    last = last[last <= n]
    at = np.arange(len(last))
    h = run_hashes(words, first[at], first[last], WORD)
    again = np.ones(len(h), bool)
    again[np.unique(h, return_index=True)[1]] = False
    return h.view(np.int64), last - at, again


def without(text: str, cuts: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the sentences of the spans (first sentence, number of sentences), and how many went."""
    place = cut(text)[2].tolist()
    gone = set()
    for first, n in cuts:
        gone.update(range(first, min(first + n, len(place) - 1)))
    return "".join(text[place[i] : place[i + 1]] for i in range(len(place) - 1) if i not in gone), len(gone)


def found_spans(docs: DataFrame, id_col: str, text_col: str, span: int, min_words: int) -> DataFrame:
    """(id, th, hashes, lengths, again) of each row with spans; th tells rows of one id apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 2_000_000):
            rows = [spans(t.as_py() or "", span, min_words) for t in batch.column(2)]
            ends = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
            columns = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c), k)) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.bool_()), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "th", "hashes", "lengths", "again"])
            yield out.filter(pa.array([len(r[0]) > 0 for r in rows]))

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), f"id {kind}, th long, hashes array<long>, lengths array<int>, again array<boolean>")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, cuts): the spans of each row that are not the first of their kind, as (first sentence, number of sentences)."""
    found = written(found_spans(docs, id_col, text_col, span, min_words))
    owner = written(found.select("id", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last").select("hash", "owner"))
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(owner, "hash", 64))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = sent.value
        for batch in batches:
            size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), size)
            first = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            h, n, again = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3, 4))
            keep = np.flatnonzero(again | passes(mask, h))
            of = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(x[keep], k) for x, k in ((first, pa.int32()), (h, pa.int64()), (n, pa.int32()), (again, pa.bool_())))], names=["id", "th", "first", "hash", "n", "again"])

    each = found.mapInArrow(released(likely), f"id {found.schema['id'].dataType.simpleString()}, th long, first int, hash long, n int, again boolean")
    each = written(each)
    drop(found)
    behind = each.where("not again").join(owner, "hash").where("id > owner").select("id", "th", "first", "n")
    inside = each.where("again").select("id", "th", "first", "n")
    # A span that an earlier one of its row repeats goes with or without other documents.
    return behind.union(inside).groupBy("id", "th").agg(F.collect_set(F.struct("first", "n")).alias("cuts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated spans removed from the text, and the number of removed sentences in ``removed``."""
    cuts = written(repeated_spans(docs, id_col, text_col, span, min_words))

    @F.pandas_udf("text string, removed int")
    def shortened(text: pd.Series, which: pd.Series) -> pd.DataFrame:
        rows = [(t, 0) if t is None or c is None else without(t, [(x["first"], x["n"]) for x in c]) for t, c in zip(text, which, strict=True)]
        return pd.DataFrame(rows, columns=["text", "removed"])

    # Only rows whose text may be one with cuts are joined, so the other texts are not moved.
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(cuts, "th", 64))

    @F.pandas_udf("boolean")
    def likely(th: pd.Series) -> pd.Series:
        return pd.Series(passes(sent.value, th.to_numpy(np.int64)))

    kept = [c for c in docs.columns if c != "removed"]
    marked = docs.select(*kept).withColumn("__th", F.xxhash64(text_col)).withColumn("__like", likely("__th"))
    others = marked.where("not __like").select(*kept, F.lit(0).alias("removed"))
    key = cuts.select(F.col("id").alias("__id"), F.col("th").alias("__cth"), "cuts").withColumnRenamed("cuts", "__cuts")
    joined = marked.where("__like").join(key, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__cth")), "left")
    out = joined.withColumn("__new", F.when(F.col("__cuts").isNotNull(), shortened(F.col(text_col), F.col("__cuts"))))
    out = out.select(*[F.coalesce("__new.text", text_col).alias(c) if c == text_col else F.col(c) for c in kept], F.coalesce("__new.removed", F.lit(0)).alias("removed"))
    return others.unionByName(out)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, "documents", sf_dir).select("doc_id", "text")
    return dedup(docs)
