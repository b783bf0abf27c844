"""Helpers that the training-data operators share: scratch tables, hashing, bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import begin_stage, drop, release, shared_folder, written  # noqa: F401

#: Bits of the filters over 64-bit keys: 8 MB at most, whatever the input.
FILTER_BITS = 1 << 26


def table(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(col: Column, n: int) -> Column:
    """A stable bucket of 0 .. n-1 for any value, null included."""
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; of a null, that of an empty text."""
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Memo(dict):
    """A dict that computes missing values and starts anew when it holds ``most`` entries, so memory stays bounded."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


def key_filter(values: DataFrame, column: str, spare: int = 16) -> np.ndarray:
    """A filter of fixed size over a 64-bit column, made by Spark: at most 2^20 words of 64 bits come to the driver. It lets all wanted values pass, and more the fuller it is."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << int(values.count() * spare).bit_length()))
    at = F.pmod(F.col(column), F.lit(bits))
    words = values.select(F.shiftright(at, 6).alias("w"), (at % 64).cast("int").alias("i")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def passes(mask: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64).view(np.uint64) & np.uint64(len(mask) * 64 - 1)
    return (mask[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def tidy() -> None:
    """Gives what a task left behind in a reused worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a reused worker keeps from one task to the next under ``key``, made where it is not there. Tasks that do not use it give it back with ``leave``."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def leave(key: Hashable | None = None) -> None:
    """Gives back what tasks of other operators left in this worker; Spark hands each worker on from stage to stage, and keeps several for each core."""
    others = [k for k in _kept if k != key]
    for k in others:
        del _kept[k]
    if others:
        tidy()


def released(run, key: Hashable | None = None):
    """``run`` for mapInArrow, with ``tidy`` at the end of each task. What other operators left in the worker goes before the first batch is read, but for what is kept under ``key``."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave(key)
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def rows_of(batches: Iterator[pa.RecordBatch], most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the strings of one slice stay near ``most_chars`` bytes (very long documents come alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.zeros(n)
        for col in batch.columns:
            if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
                size += np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.float64)
        part = (np.cumsum(size) // most_chars).astype(np.int64)
        starts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, n]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b > a:
                yield batch.slice(int(a), int(b - a))


#: Characters of all texts that a training sample may hold together, shared equally by its classes.
SAMPLE_CHARS = 100_000_000
#: Ids of a sample up to which it is broadcast.
SENT = 200_000


def bounded_sample(rows: DataFrame, id_col: str, text_col: str, class_col: str, most_chars: int = SAMPLE_CHARS) -> list:
    """The rows of a sample, for the driver: of equal ids the one whose text sorts first, and of each class no more texts than its share of ``most_chars`` holds, shorter ones first.

    So one very long text leaves only itself out. A class of which no text fits is an error.
    """
    others = [c for c in rows.columns if c not in (id_col, text_col)]
    once = written(rows.groupBy(id_col).agg(F.min(F.struct(F.coalesce(text_col, F.lit("")).alias(text_col), *others)).alias("r")).select(id_col, F.length(f"r.{text_col}").alias("__n"), "r.*"))
    upto = F.sum("__n").over(Window.partitionBy(class_col).orderBy("__n", F.xxhash64(id_col), id_col))  # over the sample's rows, which per-class bounds keep few
    fits = once.select(id_col, class_col, upto.alias("__upto"))
    classes = {r[0] for r in once.select(class_col).distinct().collect()}
    kept = fits.where(F.col("__upto") <= most_chars // max(1, len(classes)))
    out = once.join(kept.select(id_col), id_col, "left_semi").select(*rows.columns).collect()
    drop(once)
    if lacking := classes - {r[class_col] for r in out}:
        raise ValueError(f"no text of these classes fits into {most_chars} characters: {sorted(lacking, key=str)}")
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str | Column, per_class: int) -> tuple[list[tuple[str, int]], dict[int, float]]:
    """[(text, label)] of about ``per_class`` labelled documents of each class, chosen by hash of the id, and how many labelled documents one stands for.

    ``label`` is an integer column or expression of ``labels``; of several labels of a document the highest counts.
    Classes are few; the driver receives at most about ``per_class`` texts of each, and SAMPLE_CHARS characters together.
    """
    label = F.col(label) if isinstance(label, str) else label
    graded = labels.select(F.col(id_col).alias("__id"), label.cast("int").alias("__label")).dropna().groupBy("__id").agg(F.max("__label").alias("__label"))
    counts = {r[0]: r[1] for r in graded.groupBy("__label").count().collect()}
    if not counts:
        return [], {}
    share = F.lit(0)
    for k, n in counts.items():
        share = F.when(F.col("__label") == k, int(min(1.0, per_class / n) * (1 << 20))).otherwise(share)
    chosen = graded.where(bucket(F.col("__id"), 1 << 20) < share)
    expected = sum(min(per_class, n) for n in counts.values())
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen) if expected <= SENT else chosen, "__id").select("__id", "__text", "__label")
    rows = sorted((tuple(r) for r in bounded_sample(rows, "__id", "__text", "__label")), key=lambda r: (r[0], r[1]))
    got: dict[int, int] = {}
    for r in rows:
        got[r[2]] = got.get(r[2], 0) + 1
    return [(r[1], r[2]) for r in rows], {k: counts[k] / n for k, n in got.items()}
