"""Sequence packing by non-negative least squares over shallow length combinations.

Documents are tokenised, ended by ``eos`` and cut into whole windows plus a remainder shorter than a window. Whole windows are sequences.
For remainders, combinations of few lengths that fill a window exactly are enumerated, their repeat counts solve a non-negative least
squares problem against the histogram of lengths (at most ``window`` numbers, whatever the input), are rounded down and mended
to fit. What is left is packed greedily, longest first, and cut where a window is full; the end of that stream is cut into
powers of two, which need no padding. All lengths of a bin are equal, so a document's place follows from its rank in its bin.

Defined results: null text is as an empty one (its only token is ``eos``); rows with equal ids are packed one by one; an empty table
gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, released, rows_of, table, written

#: Rows of one length and salt, which are ranked in one task.
RANKED = 20_000
#: Rows whose tokens a worker holds at a time when it places them.
PLACED = 500
#: Lengths that triples are made of; all pairs are taken.
TRIPLE_LENGTHS = 48
#: Copies of one length in a combination.
DEPTH = 8
SWEEPS = 60

_odd_space = re.compile(r"[\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: Runs of signs, which the tokenizer takes as one piece.
_signs = re.compile(r"(?:[^\w\s]|_)+")
#: Text on which words put together must give what the whole gives; else a tokenizer is one of another kind, and texts are encoded whole.
PROBE = "The Quick brown-fox's 42nd Jump: \u00c9t\u00e9 na\u00efve don't we'll (a,b) 3.14 \u0631\u062c\u0644 x_y \u4e2d\u6587 e\u0301 !? it's\tend\n"
#: Runs and words of one generation of the memory. When there are more, a new one begins, which takes over from the last one what it meets again.
REMEMBERED = 250_000


SPACE, SIGN, LETTER, OTHER = range(4)


@cache
def _kinds() -> np.ndarray:
    """Of each byte of UTF-8: white space, a sign, part of a word, or one whose word is left whole (apostrophes, and characters whose first byte does not tell letters from signs)."""
    out = np.full(256, OTHER, np.uint8)
    out[:128] = [SPACE if chr(i).isspace() else LETTER if chr(i).isalnum() else SIGN for i in range(128)]
    out[0x80:0xC0] = LETTER  # what follows a first byte
    out[0xC3:0xCA] = out[0xD0:0xD2] = LETTER  # Latin letters, but for two signs, and Cyrillic ones
    out[ord("'")] = OTHER
    return out


def pieces(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(runs of white space, signs or letters and digits, and whole words that hold another character; the first run of each text and the one after its last). The texts are in lower case."""
    size = np.array([len(t) for t in texts], np.int64)
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, np.uint8)
    kind = _kinds()[data]
    if b"\xc3\x97" in joined or b"\xc3\xb7" in joined:
        kind[1:][(data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))] = OTHER
    start = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]][: len(data)])
    own = kind[start]
    if (own == OTHER).any():
        space = own == SPACE
        word = np.cumsum(space | np.r_[True, space[:-1]])
        whole = np.zeros(len(start) + 1, bool)
        whole[word[own == OTHER]] = True
        start = start[~(whole[word] & (np.r_[0, word[:-1]] == word))]
    runs = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.r_[start, len(data)].astype(np.int32)), pa.py_buffer(joined))
    begin = np.cumsum(size + 1) - size - 1
    return runs, np.searchsorted(start, begin), np.searchsorted(start, begin + size)


class Encoder:
    """Texts to ids as little-endian uint32. A tokenizer of word ends never joins what white space parts, nor letters, digits and signs, so each of these is encoded once and remembered;
    a batch of texts looks up each distinct one once.

    Words of letters alone, in canonical form and lower case, need neither its normaliser nor its pattern of splits, only white space to part them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.whole = False
        self.whole = self.encode([PROBE]) != [self.one(PROBE)]

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def normal(self, text: str) -> bytes | None:
        """The text in canonical form and lower case, or None if only the whole text is sure."""
        if self.whole or _odd_space.search(text) or "\u03a3" in text or "\u0130" in text or "<|" in text:
            return None  # white space, lower case or special tokens might differ
        return unicodedata.normalize("NFC", text).lower().encode()

    def recalled(self, words: set[str]) -> set[str]:
        """The words that must be learned; what the generation before knows of the others is taken over."""
        again = words & self.before.keys()
        self.known.update(zip(again, map(self.before.__getitem__, again), strict=True))
        return words - again

    def learn(self, new: set[str]) -> None:
        plain = set(filter(str.isalpha, new))
        # With apostrophes the tokenizer's rule is another, so such words are encoded whole.
        cut = {w: [w] if "'" in w else _signs.sub(r" \g<0> ", w).split() for w in new - plain}
        parts = self.recalled(set().union(*cut.values()) - self.known.keys() - plain)
        letters = [*plain, *filter(str.isalpha, parts)]
        if letters:  # in one call: the ends tell them apart
            ids = np.array(self.letters.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(letters) and ends[-1] == len(ids):
                data, stop = ids.tobytes(), (ends * 4).tolist()
                self.known.update(zip(letters, [data[a:b] for a, b in zip([0, *stop], stop, strict=False)], strict=True))
        for p in (*plain, *parts):
            if p not in self.known:
                self.known[p] = self.one(p)
        for w, own in cut.items():
            if w not in self.known:
                self.known[w] = b"".join(map(self.known.__getitem__, own))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        each = [self.normal(t) if t else b"" for t in texts]
        runs, begin, stop = pieces([t or b"" for t in each])
        coded = runs.dictionary_encode()
        there = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = set(there) - self.known.keys()
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.before, self.known = self.known, {}
                new = set(there)
            self.learn(self.recalled(new))
        ids = [self.known[w] for w in there]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        of = coded.indices.to_numpy()
        upto = np.cumsum(np.r_[0, size[of]])
        place = np.repeat((np.cumsum(size) - size)[of] - upto[:-1], size[of]) + np.arange(upto[-1])
        data = np.frombuffer(b"".join(ids), "<u4")[place].tobytes()
        return [self.one(t) if e is None else data[a:b] for t, e, a, b in zip(texts, each, (upto[begin] * 4).tolist(), (upto[stop] * 4).tolist(), strict=True)]


def combinations(hist: np.ndarray, window: int) -> list[dict[int, int]]:
    """Shallow combinations {length: copies} that fill the window exactly, of lengths that occur."""
    there = set(np.flatnonzero(hist).tolist()) - {0}
    out = {}
    add = lambda *parts: out.setdefault(tuple(sorted(parts)), None)
    for a in there:
        if window - a in there:
            add(a, window - a)
        for k in range(2, DEPTH):
            if (b := window - k * a) in there:
                add(*[a] * k, b)
            if window == k * a:
                add(*[a] * k)
    often = sorted(there, key=lambda a: (-hist[a], a))[:TRIPLE_LENGTHS]
    for i, a in enumerate(often):
        for b in often[i:]:
            if (c := window - a - b) in there:
                add(a, b, c)
            for d in often[:8]:
                if (c := window - a - b - d) in there:
                    add(a, b, c, d)
    return [{x: parts.count(x) for x in parts} for parts in sorted(out)]


def solve(parts: list[dict[int, int]], hist: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|^2, by cyclic coordinate descent on the sparse columns."""
    left, x = hist.astype(float).copy(), [0.0] * len(parts)
    columns = [(list(p.items()), sum(c * c for c in p.values())) for p in parts]
    for _ in range(SWEEPS):
        moved = 0.0
        for j, (column, norm) in enumerate(columns):
            step = max(-x[j], sum(c * left[a] for a, c in column) / norm)
            if step:
                x[j] += step
                for a, c in column:
                    left[a] -= c * step
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return np.array(x)


def plan(hist: np.ndarray, window: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """[(combination, repeats)] with whole repeats that the histogram holds, and the counts that are left."""
    parts, left = combinations(hist, window), hist.astype(np.int64).copy()
    x = solve(parts, hist)
    times = [0] * len(parts)
    for most in (np.floor(x + 1e-9), np.full(len(parts), np.inf)):  # rounded, then what still fits
        for j in sorted(range(len(parts)), key=lambda j: (-x[j], j)):
            n = int(min(most[j], *(left[a] // c for a, c in parts[j].items())))
            if n > 0:
                times[j] += n
                for a, c in parts[j].items():
                    left[a] -= c * n
    return [(p, n) for p, n in zip(parts, times, strict=True) if n], left


def _slots(chosen: list[tuple[dict[int, int], int]], left: np.ndarray, window: int):
    """Sorted arrays (length << 40 | first rank, sequence, offset) of the runs of ranks that combinations take; the residual stream; its ends."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, times in chosen:
        offset = 0
        for a, copies in sorted(parts.items(), reverse=True):
            for _ in range(copies):
                rows.append((a << 40 | taken.get(a, 0), sequence, offset))
                taken[a] = taken.get(a, 0) + times
                offset += a
        sequence += times
    stream, at = np.zeros(window + 1, np.int64), 0
    for a in range(window, 0, -1):  # longest first
        stream[a] = at
        if a < len(left):
            at += int(left[a]) * a
    ends = [at - at % window + sum(1 << j for j in range(i, window.bit_length()) if (at % window) >> j & 1) for i in range(window.bit_length() - 1, -1, -1) if (at % window) >> i & 1]
    first = np.array([taken.get(a, 0) for a in range(window + 1)], np.int64)
    rows.sort()
    return [np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ([], [], []))], first, stream, sequence, at - at % window, ends


def tokenised(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, window: int, eos: int) -> DataFrame:
    """(id, n, base, whole, rest): tokens of each row as ids; ``base`` numbers its whole windows uniquely by task and place."""
    kind, key = docs.schema[id_col].dataType.simpleString(), ("encoder", tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end, seen = kept(key, lambda: Encoder(tokenizer)), np.array([eos], "<u4").tobytes(), TaskContext.get().partitionId() << 32
        for batch in rows_of(batches, 2_000_000):
            n, base, whole, rest = [], [], [], []
            for ids in encoder.encode(batch.column(1).to_pylist()):
                ids += end
                cut = len(ids) // 4 // window
                n.append(len(ids) // 4)
                base.append(seen)
                whole.append(ids[: cut * window * 4] or None)
                rest.append(ids[cut * window * 4 :] or None)
                seen += cut
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, pa.int64()), pa.array(whole, pa.binary()), pa.array(rest, pa.binary())], names=["id", "n", "base", "whole", "rest"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run, key), f"id {kind}, n long, base long, whole binary, rest binary")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, eos: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset); ``ids`` is binary, little-endian uint32."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    tokens = written(tokenised(docs, id_col, text_col, tokenizer, window, eos))
    rows = tokens.count()
    salts = max(1, math.ceil(rows / RANKED))
    rest = tokens.select("id", "n", "rest", (F.col("n") % window).alias("len"), F.pmod(F.xxhash64("id", "rest"), F.lit(salts)).alias("salt")).where("len > 0")
    count = rest.groupBy("len", "salt").agg(F.count("*").alias("c"))
    hist = np.zeros(window, np.int64)
    for length, c in count.groupBy("len").agg(F.sum("c")).collect():  # at most window - 1 rows
        hist[length] = c
    chosen, left = plan(hist, window)
    (at, sequence, offset), first, stream, base, full, ends = _slots(chosen, left, window)
    before = count.withColumn("before", F.sum("c").over(Window.partitionBy("len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("len", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    in_salt = Window.partitionBy("len", "salt").orderBy("id", "n", F.xxhash64("rest"))
    ranked = rest.join(before, ["len", "salt"]).withColumn("rank", F.row_number().over(in_salt) - 1 + F.col("before")).select("id", "n", "rest", "len", "rank")
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, PLACED) for b in batches for i in range(0, b.num_rows, PLACED)):
            ids, out = batch.column(0).to_pylist(), []
            for i, n, data, size, rank in zip(ids, *(batch.column(c).to_pylist() for c in ("n", "rest", "len", "rank")), strict=True):
                if rank < first[size]:
                    j = int(np.searchsorted(at, size << 40 | rank, side="right")) - 1
                    out.append((i, n - size, size, data, n, int(sequence[j]) + rank - (int(at[j]) & (1 << 40) - 1), int(offset[j])))
                    continue
                s, done = int(stream[size]) + (rank - int(first[size])) * size, 0
                while done < size:
                    if s < full:
                        number, begin = s // window, s - s % window
                        end = begin + window
                    else:
                        k = next(k for k, e in enumerate(ends) if s < e)
                        number, begin, end = full // window + k, ends[k - 1] if k else full, ends[k]
                    length = min(size - done, end - s)
                    out.append((i, n - size + done, length, data[done * 4 : (done + length) * 4], n, base + number, s - begin))
                    s, done = s + length, done + length
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    cuts = F.expr(f"transform(sequence(0, cast(n div {window} as int) - 1), k -> substring(whole, k * {window * 4} + 1, {window * 4}))")
    whole = tokens.where("whole is not null").select("id", "n", "base", F.posexplode(cuts).alias("k", "ids"))
    whole = whole.select("id", (F.col("k") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), "ids", F.col("n").alias("doc_tokens"), (F.col("base") + F.col("k") + F.lit(1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = whole.union(ranked.mapInArrow(released(place), schema))
    return out.withColumnRenamed("id", id_col)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, "documents", sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
