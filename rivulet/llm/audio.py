"""Media columns: chroma fingerprints of audio, packed integers that offset histograms and bit errors align.

Audio is raw unsigned 8-bit mono PCM. Frames give twelve pitch-class energies; sixteen filters over the integral image of these
(differences of rectangle sums, in logarithms) give two bits each, in Gray code, so a frame's fingerprint is a 32-bit integer.
Recordings with equal fingerprints are one class. A query's integers are hash-joined with those of all classes; pairs that share enough
of them for some offset get the votes of every offset, over all places, and the bit errors of each offset with enough votes decide.
Of the offsets that fit, the one with most votes is the match. Recordings shorter than OVERLAP or VOTES need as much as they are long.

Defined results: null and empty audio have no fingerprint and no class; audio shorter than a filter is padded with silence; equal votes
go to the smaller offset; rows of one id are recordings of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, released, rows_of, table, written

RATE = 8000
FRAME = 512
HOP = 128
WIDTH = 8
LOWEST, HIGHEST = 80.0, 3500.0
#: Steps between the four levels of a filter.
STEPS = (-0.12, 0.0, 0.12)
#: Votes of an offset, frames of an overlap and share of differing bits that a match needs.
VOTES, OVERLAP, ERRORS = 2, 4, 0.2


def _chroma_matrix() -> np.ndarray:
    """From spectrum bins to pitch classes; 440 Hz is in class 9."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12))
    for i, x in enumerate(f):
        if LOWEST <= x <= HIGHEST:
            out[i, int(round(12 * np.log2(x / 440.0) + 9)) % 12] = 1.0
    return out


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width) of sixteen filters, spread by rule over kinds, heights and widths."""
    return [(i % 4, (5 * i) % 9, 2 + i % 3 + (i % 4 == 2), WIDTH - 2 * (i // 8)) for i in range(16)]


_MATRIX, _FILTERS, _HANN = _chroma_matrix(), _filters(), np.hanning(FRAME)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma(pcm: bytes) -> np.ndarray:
    x = np.frombuffer(pcm, np.uint8).astype(np.float64) - 128
    frames = max(WIDTH, 1 + max(0, len(x) - FRAME + HOP - 1) // HOP)
    x = np.r_[x, np.zeros(max(0, FRAME + (frames - 1) * HOP - len(x)))]
    out = []
    for a in range(0, frames, 512):  # bounded memory for long recordings
        n = min(512, frames - a)
        part = np.lib.stride_tricks.as_strided(x[a * HOP :], (n, FRAME), (x.strides[0] * HOP, x.strides[0]))
        out.append(np.abs(np.fft.rfft(part * _HANN)) ** 2 @ _MATRIX)
    c = np.concatenate(out)
    return c / np.maximum(np.sqrt((c**2).sum(axis=1, keepdims=True)), 1e-9)


def fingerprint(pcm: bytes | None) -> np.ndarray:
    """Packed 32-bit integers, one for each place of the widest filter."""
    if not pcm:
        return np.empty(0, np.uint32)
    c = chroma(pcm)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    n = len(c) - WIDTH + 1
    t = np.arange(n)

    def area(t0: np.ndarray, width: int, y: int, height: int) -> np.ndarray:
        return image[t0 + width, y + height] - image[t0, y + height] - image[t0 + width, y] + image[t0, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in _FILTERS:
        half, mid = w // 2, h // 2
        if kind == 0:  # lower against upper pitch classes
            a, b = area(t, w, y, mid), area(t, w, y + mid, h - mid)
        elif kind == 1:  # earlier against later
            a, b = area(t, half, y, h), area(t + half, w - half, y, h)
        elif kind == 2:  # diagonal quarters
            a = area(t, half, y, mid) + area(t + half, w - half, y + mid, h - mid)
            b = area(t, half, y + mid, h - mid) + area(t + half, w - half, y, mid)
        else:  # the middle in time against both ends
            q = w // 4
            b = area(t + q, w - 2 * q, y, h)
            a = area(t, w, y, h) - b
        level = np.searchsorted(STEPS, np.log((1 + a) / (1 + b)))
        out = out << np.uint32(2) | _GRAY[level]
    return out


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """(id, cls, fp) of every row; cls is the hash of the whole fingerprint, null without one."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            fps = [fingerprint(x.as_py()).view(np.int32) for x in batch.column(1)]
            classes = [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) if len(x) else None for x in fps]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.int64()), pa.array(fps, pa.list_(pa.int32()))], names=["id", "cls", "fp"])

    return media.select(F.col(id_col).alias("id"), F.col(audio_col).cast("binary").alias("audio")).mapInArrow(released(run), f"id {kind}, cls long, fp array<int>")


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and values of the runs of equal integers."""
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return start, np.diff(np.r_[start, len(x)]), x[start]


def histogram(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Votes of the offsets 1 - len(q) .. len(d) - 1: equal integers at all pairs of places. Two runs add a trapezoid, kept as its second differences."""
    (a, m, x), (b, n, y) = runs(q), runs(d)
    order = np.argsort(y, kind="stable")
    b, n, y = b[order], n[order], y[order]
    low, high = np.searchsorted(y, x), np.searchsorted(y, x, "right")
    steps = np.zeros(len(q) + len(d) + 1, np.int64)
    ends = np.cumsum(high - low)
    for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(ends >> 20)) + 1):  # bounded memory where few integers alternate
        count = (high - low)[part]
        i = np.repeat(part, count)
        j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[i]
        at = b[j] - a[i] - m[i] + len(q)
        for move, sign in ((0, 1), (m[i], -1), (n[j], -1), (m[i] + n[j], 1)):
            steps += sign * np.bincount(at + move, minlength=len(steps))
    return steps.cumsum().cumsum()[: len(q) + len(d) - 1]


def bit_errors(q: np.ndarray, d: np.ndarray, offsets: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Differing bits at each offset: one by one, or where that is more work by exact correlation of all offsets."""
    if overlap.sum() <= 64 * (len(q) + len(d)):
        return np.array([int(np.bitwise_count(q[max(0, -o) : max(0, -o) + n] ^ d[max(0, o) : max(0, o) + n]).sum()) for o, n in zip(offsets.tolist(), overlap.tolist(), strict=True)], np.int64)
    size = 1 << (len(q) + len(d)).bit_length()
    both = np.zeros(size // 2 + 1, complex)
    for k in range(32):
        sign = lambda x: (x >> np.uint32(k) & np.uint32(1)) * 2.0 - 1  # noqa: E731, B023
        both += np.fft.rfft(sign(d), size) * np.conj(np.fft.rfft(sign(q), size))
    same = np.rint(np.fft.irfft(both, size)).astype(np.int64)[offsets % size]
    return (32 * overlap - same) // 2


def aligned(q: np.ndarray, d: np.ndarray) -> tuple[int, int, int, float] | None:
    """(offset, votes, overlap, bit error) of the offset with most votes among those that fit."""
    votes = histogram(q, d)
    offsets = np.flatnonzero(votes >= min(VOTES, len(q), len(d))) + 1 - len(q)
    start = np.maximum(offsets, 0)
    overlap = np.minimum(len(q) + offsets, len(d)) - start
    fits = overlap >= min(OVERLAP, len(q), len(d))
    offsets, overlap = offsets[fits], overlap[fits]
    errors = bit_errors(q, d, offsets, overlap) / (overlap * 32)
    good = np.flatnonzero(errors <= ERRORS)
    if not len(good):
        return None
    best = good[votes[offsets[good] + len(q) - 1].argmax()]
    return int(offsets[best]), int(votes[offsets[best] + len(q) - 1]), int(overlap[best]), float(errors[best])


def align(queries: DataFrame, classes: DataFrame) -> DataFrame:
    """Both (cls, fp) with distinct cls: (query, match, offset, votes, overlap, bit_error); offset is the match's frame at the query's frame 0."""
    counts = lambda df: df.select("cls", F.size("fp").alias("n"), F.explode("fp").alias("x")).groupBy("cls", "n", "x").agg(F.count("*").alias("c"))
    q, d = counts(queries).toDF("query", "qn", "x", "qc"), counts(classes).toDF("match", "dn", "x", "dc")
    # No offset has more votes than the smaller counts of the shared integers sum up to.
    pairs = q.join(d, "x").where("query <> match").groupBy("query", "match").agg(F.sum(F.least("qc", "dc")).alias("most"), F.min(F.least("qn", "dn")).alias("n")).where(F.col("most") >= F.least(F.lit(VOTES), "n"))
    both = pairs.select("query", "match").join(queries.toDF("query", "qf"), "query").join(classes.toDF("match", "df"), "match").select("query", "match", "qf", "df")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda x: np.asarray(x.values).view(np.uint32)
        for batch in batches:
            found = [aligned(of(q), of(d)) for q, d in zip(batch.column(2), batch.column(3), strict=True)]
            hit = pa.array([x is not None for x in found])
            columns = list(zip(*[x for x in found if x], strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["query", "match", "offset", "votes", "overlap", "bit_error"])

    return both.mapInArrow(released(run), "query long, match long, offset int, votes long, overlap int, bit_error double")


def search(media: DataFrame, wanted, id_col: str = "id", audio_col: str = "audio") -> tuple[DataFrame, DataFrame]:
    """Members (id, class_id), class_id being the smallest id of equal fingerprints, and matches between class ids for the rows that fulfil ``wanted``."""
    prints = written(fingerprints(media, id_col, audio_col))
    release(media.sparkSession)
    classes = prints.where("cls is not null").groupBy("cls").agg(F.min("id").alias("class_id"), F.first("fp").alias("fp"), F.max(F.coalesce(wanted(F.col("id")), F.lit(False))).alias("asked"))
    classes = written(classes)
    members = prints.select("id", "cls").join(classes.select("cls", "class_id"), "cls").select("id", "class_id")
    found = align(classes.where("asked").select("cls", "fp"), classes.select("cls", "fp"))
    name = classes.select("cls", "class_id")
    found = found.join(name.toDF("query", "query_class"), "query").join(name.toDF("match", "match_class"), "match")
    return members, found.select("query_class", "match_class", "offset", "votes", "overlap", "bit_error")


def op5_media_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The tables have no audio, so the UTF-8 bytes of each document stand for its samples. One row a document, and one a match of classes."""
    media = table(spark, "documents", sf_dir).select("doc_id", F.col("text").cast("binary").alias("audio"))
    members, found = search(media, lambda i: i % 100 == 0, "doc_id", "audio")
    null = lambda kind: F.lit(None).cast(kind)
    rows = members.select(F.lit("member").alias("kind"), F.col("id").alias("doc_id"), "class_id", null("long").alias("match_class"), null("int").alias("offset"), null("long").alias("votes"), null("double").alias("bit_error"))
    return rows.union(found.select(F.lit("match"), F.col("query_class"), F.col("query_class"), F.col("match_class"), "offset", "votes", "bit_error"))
