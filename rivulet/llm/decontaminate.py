"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of texts become typed placeholders. Windows of the templates are hash-joined with those of the benchmark; the
values in the slots of matching windows must map each value of an item to one value of the document, along one alignment. Windows that
match with equal values are verbatim copies, with other values re-parameterised questions. A window with more than SLOTS placeholders
(half of its tokens, if it is shorter) is joined on its raw tokens, and its template on a longer window that has as many fixed tokens as others.
An alignment whose slots disagree is split where they do; of its parts, those with equal values and those of at least ``run`` tokens count.

A document is contaminated by an item if its consistent windows are at least ``coverage`` of the item's, or one part of an alignment covers
``run`` tokens. Items of at least SHORTEST tokens but fewer than a window has are one window.

Defined results: null text has no tokens; items with fewer than SHORTEST tokens match nothing; items of equal text are reported
under the smallest item id; repeated rows give one result for each (id, text); empty tables give an empty result; other columns
of the inputs are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_filter, passes, released, rows_of, table, written
from .lexical import LETTER, WORD, code_points, lowered, run_hashes

WINDOW = 8
SHORTEST = 4
COVERAGE = 0.5
RUN = 20
#: Placeholders that a window joined on its template alone may have at most.
SLOTS = 4
#: Bits of the filter for each window of the benchmark.
SPARSE = 1024

# Number words and units of measure.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half third quarter".split())
UNITS = frozenset("% $ € £ ¥ ° mm cm km kg mg ml kb mb gb tb hz khz mhz ghz kw kwh mph kph meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit volt volts watt watts joule joules newton newtons".split())

#: Kinds of tokens; what is from CAPITAL on is a placeholder.
END, OTHER, CAPITAL, NUMBER, UNIT = range(5)
_MARK = {NUMBER: 0x6E756D62, CAPITAL: 0x6E616D65, UNIT: 0x756E6974}
#: Tells windows over raw tokens apart.
RAW = 0x7261772D77696E64
_NONE, _ALPHA, _DIGIT, _SIGN, _STOP = range(5)


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point, and 1 for upper case, 2 for lower case."""
    kind, case = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    whole = "".join(chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000))
    for found in re.finditer(r"[^\W\d_]+", whole):
        kind[found.start() : found.end()] = _ALPHA
    for found in re.finditer(r"\d+", whole):
        kind[found.start() : found.end()] = _DIGIT
    kind[list(map(ord, "%$€£¥°"))] = _SIGN
    kind[list(map(ord, ".!?\n"))] = _STOP
    for i in np.flatnonzero(kind == _ALPHA).tolist():
        case[i] = 1 if whole[i].isupper() else 2 if whole[i].islower() or whole[i].istitle() else 0
    return kind, case


@cache
def _known(words: frozenset[str]) -> np.ndarray:
    """Sorted hashes of the words."""
    return np.sort(np.concatenate([run_hashes(code_points(w).astype(np.uint64), np.array([0]), np.array([len(w)]), LETTER) for w in words]))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


@dataclass
class Tokens:
    """The tokens of several texts one behind the other, without sentence ends."""

    text: str
    code: np.ndarray  # hashes, with placeholders
    slot: np.ndarray  # kind of the placeholder, or 0
    raw: np.ndarray  # hashes of the lower-cased tokens
    start: np.ndarray  # places in the joined text
    end: np.ndarray
    stop: np.ndarray  # of each token, where the tokens of its text end
    first: np.ndarray  # of each text, its first token

    def values(self, at: int, length: int) -> list[str]:
        """Kind and lower-cased token of the placeholders of a window."""
        return [f"{self.slot[i]}{self.text[self.start[i] : self.end[i]].lower()}" for i in range(at, at + length) if self.slot[i]]


def parsed(texts: list[str | None]) -> Tokens:
    """Letters, numbers (digits with single signs between them) and single signs are tokens. A capital at a sentence's start is a plain word."""
    joined = "\n".join(t or "" for t in texts)
    points = code_points(joined)
    low = points if joined.islower() else code_points(lowered(joined))
    classes, cases = _classes()
    kind, case = classes[points], cases[points]
    inner = np.zeros(len(kind), bool)  # signs between digits belong to the number
    if len(kind) > 2:
        digit = kind == _DIGIT
        inner[1:-1] = digit[:-2] & digit[2:] & np.isin(points[1:-1], list(map(ord, ".,:/")))
    kind = np.where(inner, _DIGIT, kind)
    opens = (kind != _NONE) & (np.concatenate([[0], kind[:-1]]) != kind) | (kind == _SIGN) | (kind == _STOP)
    start = np.flatnonzero(opens)
    closes = (kind != _NONE) & (np.concatenate([kind[1:], [0]]) != kind) | (kind == _SIGN) | (kind == _STOP)
    end = np.flatnonzero(closes) + 1
    raw = run_hashes(low.astype(np.uint64), start, end, LETTER)
    what = kind[start]
    lower = np.concatenate([[0], np.cumsum(case == 2)])
    capital = (what == _ALPHA) & (case[start] == 1) & ((lower[end] > lower[start]) | (end - start == 1))
    token = np.full(len(start), OTHER, np.uint8)
    behind = np.ones(len(start), bool)
    behind[1:] = what[:-1] == _STOP
    token[capital & ~behind] = CAPITAL
    token[_among(raw, _known(UNITS))] = UNIT
    token[(what == _DIGIT) | _among(raw, _known(NUMBER_WORDS))] = NUMBER
    keep = np.flatnonzero(what != _STOP)
    token, raw, start, end = token[keep], raw[keep], start[keep], end[keep]
    code = raw.copy()
    for k, mark in _MARK.items():
        code[token == k] = mark
    border = np.cumsum([len(t or "") + 1 for t in texts])
    first = np.searchsorted(start, border)  # of the next text
    stop = np.repeat(first, np.diff(first, prepend=0))
    return Tokens(joined, code, np.where(token >= CAPITAL, token, 0), raw, start, end, stop, np.concatenate([[0], first[:-1]]))


def windows(t: Tokens, size: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and lengths of the windows at every place, and whether they are over raw tokens: those with few placeholders over their template; each other one over its raw
    tokens and, of the usual size, prolonged until it has as many fixed tokens as others (``longest`` is the greatest length that can match)."""
    at = np.flatnonzero(t.stop - np.arange(len(t.code)) >= size)
    most = min(SLOTS, size // 2)
    count = np.concatenate([[0], np.cumsum(t.slot > 0)])
    dense = count[at + size] - count[at] > most
    plain, at = at[~dense], at[dense]
    places, hashes, lengths = [plain, at], [run_hashes(t.code, plain, plain + size, WORD), run_hashes(t.raw, at, at + size, WORD) ^ np.uint64(RAW)], [np.full(len(plain) + len(at), size)]
    if size == WINDOW and len(at):
        fixed = np.arange(len(count)) - count
        end = np.searchsorted(fixed, fixed[at] + size - most)
        fits = (end <= t.stop[at]) & (end - at <= longest)
        places.append(at[fits])
        hashes.append(run_hashes(t.code, at[fits], end[fits], WORD))
        lengths.append((end - at)[fits])
    raw = np.arange(sum(map(len, places))) - len(plain)
    return *map(np.concatenate, (places, hashes, lengths)), (raw >= 0) & (raw < len(at))


def _sizes(n: int) -> int:
    return WINDOW if n >= WINDOW else n if n >= SHORTEST else 0


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, hash, size, length, at, windows, values) of every item; items of equal text are one. ``length`` is that of the window, ``size`` the item's usual one."""
    kind = items.schema[id_col].dataType.simpleString()
    once = items.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(F.min(id_col).alias("item")).select("item", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = parsed([text])
                if size := _sizes(len(t.code)):
                    places, hashes, lengths, _ = windows(t, size, len(t.code))
                    out += [(item, h, size, n, p, len(t.code) - size + 1, t.values(p, n)) for p, h, n in zip(places.tolist(), hashes.view(np.int64).tolist(), lengths.tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["item", "hash", "size", "length", "at", "windows", "values"])

    return once.mapInArrow(released(run), f"item {kind}, hash long, size int, length int, at int, windows int, values array<string>")


def parts(line: list[dict], run: int) -> list[tuple[list[dict], bool]]:
    """The consistent parts of one alignment that count, each with whether all its values are equal. ``line`` has (at, length, values, own) of each window."""
    out, part, known = [], [], {}
    for window in sorted(line, key=lambda w: (w["at"], w["length"])):
        pairs = dict(zip(window["values"], window["own"], strict=True))
        if any(pairs[a] != b for a, b in zip(window["values"], window["own"], strict=True)):
            pairs = None  # the window contradicts itself
        if part and (pairs is None or any(known.get(a, b) != b for a, b in pairs.items())):
            out.append((part, known))
            part, known = [], {}
        if pairs is not None:
            part, known = [*part, window], known | pairs
    if part:
        out.append((part, known))
    whole = len(out) == 1 and len(out[0][0]) == len(line)
    judged = [(p, all(a == b for a, b in k.items()), max(w["at"] + w["length"] for w in p) - p[0]["at"]) for p, k in out]
    return [(p, same) for p, same, tokens in judged if whole or same or tokens >= run]


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """(id, th, item, kind, coverage, longest, first_token) of every contaminated document and item."""
    kind = docs.schema[id_col].dataType.simpleString()
    bench = written(benchmark_windows(items, item_id, item_text))
    item_kind = bench.schema["item"].dataType.simpleString()
    sizes = sorted((r[0], r[1]) for r in bench.groupBy("size").agg(F.max("length")).collect())  # at most WINDOW of them
    mask = docs.sparkSession.sparkContext.broadcast(key_filter(bench.select("hash").distinct(), "hash", SPARSE))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = mask.value
        for batch in rows_of(batches, 1_000_000):
            t, out = parsed(batch.column(2).to_pylist()), []
            ids, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for size, longest in sizes:
                places, h, lengths, raw = windows(t, size, longest)
                hit = np.flatnonzero(passes(bits, h.view(np.int64)))
                rows = np.searchsorted(t.first, places[hit], side="right") - 1
                for d, p, x, n, same in zip(rows.tolist(), *(c[hit].tolist() for c in (places, h.view(np.int64), lengths, raw)), strict=True):
                    out.append((ids[d], th[d], x, size, p - int(t.first[d]), None if same else t.values(p, n)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["id", "th", "hash", "size", "p", "own"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for part, same in parts(row["line"], run):
                    most = max(w["at"] + w["length"] for w in part) - part[0]["at"]
                    out += [(row["id"], row["th"], row["item"], row["windows"], row["size"], part[0]["p"], same, most, at) for at in {w["at"] for w in part}]
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = (batch.schema.field(0).type, pa.int64(), batch.schema.field(2).type, pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["id", "th", "item", "windows", "size", "p", "same", "most", "at"])

    hits = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(released(scan), f"id {kind}, th long, hash long, size int, p int, own array<string>").distinct()
    met = hits.join(bench, ["hash", "size"]).where("own is null or size(own) = size(values)").withColumn("own", F.coalesce("own", "values"))
    line = met.groupBy("id", "th", "item", "windows", "size", (F.col("p") - F.col("at")).alias("off")).agg(F.collect_list(F.struct("at", "p", "length", "values", "own")).alias("line"))
    each = line.select("id", "th", "item", "windows", "size", "line").mapInArrow(released(split), f"id {kind}, th long, item {item_kind}, windows int, size int, p int, same boolean, most int, at int")
    # A window of the item counts once, however many alignments show it.
    item = each.groupBy("id", "th", "item", "windows", "size").agg(F.count_distinct("at").alias("n"), F.max("most").alias("most"), F.min("p").alias("first_token"), F.min("same").alias("same"))
    share = F.col("n") / F.col("windows")
    bad = item.where((share >= coverage) | (F.col("most") >= run))
    return bad.select("id", "th", "item", F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind"), share.alias("coverage"), F.col("most").alias("longest"), "first_token")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` without contaminated documents."""
    bad = written(matches(docs, items, id_col, text_col, **limits).select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct())
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text_col]) == bad["__th"]), "left_anti")


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, "documents", sf_dir).select("doc_id", "text"), table(spark, "benchmark", sf_dir)
    return matches(docs, items).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "kind", "coverage", "longest", "first_token")
