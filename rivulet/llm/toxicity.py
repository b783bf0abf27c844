"""Toxicity by multiple-instance learning: sentences are instances, noisy-or combines them, only documents have labels.

A sentence's score is the logistic of a bias and the summed weights of its distinct words; a word's weight is that of its features:
itself and its beginnings, which endings share. A document's score is 1 - prod(1 - score of a sentence).
Weights are fitted on the likelihood of document labels, with each class weighted back to its share of the labelled rows,
so sentences that explain a label are found without sentence labels.

Defined results: null text and texts without words have no sentence and the score of an empty noisy-or, 0; of several labels of one document
the highest counts; labels that are null count for nothing; without labels of both classes every score is 0; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, crc_mod, labelled_sample, released, rows_of, table

_token = re.compile(r"[.!?\n]|\w+")
#: Labelled documents of each class that training takes at most (all, where there are fewer).
PER_CLASS = 3000
STEPS = 220
RATE = 0.1
SPARSE = 1e-4
RIDGE = 1e-5


BEGINNINGS = (3, 4, 5, 6)


def features(word: str) -> list[str]:
    """A word and its beginnings, which end in a hyphen."""
    return [word, *[f"{word[:n]}-" for n in BEGINNINGS if len(word) > n]]


def instances(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary, the distinct words of all sentences as its indices, the place where each sentence begins, and the place among sentences where each text begins."""
    index: dict[str, int] = {}
    words, starts, docs, at, sentences = [], [], [], 0, 0
    for text in texts:
        docs.append(sentences)
        found = _token.findall((text or "").lower())
        ids = np.fromiter((-1 if w in ".!?\n" else index.setdefault(w, len(index)) for w in found), np.int64, len(found))
        ends = ids < 0
        number, ids = np.divmod(np.unique(np.cumsum(ends)[~ends] << 32 | ids[~ends]), 1 << 32)
        if len(ids):
            begin = np.r_[0, np.flatnonzero(np.diff(number)) + 1]
            starts.append(begin + at)
            words.append(ids)
            at += len(ids)
            sentences += len(begin)
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return list(index), cat(words), cat(starts), np.array(docs, np.int64)


@dataclass
class Model:
    bias: float = -50.0
    weights: dict[str, float] = field(default_factory=dict)


def fit(texts: list[str], labels: np.ndarray, shares: tuple[float, float], steps: int = STEPS) -> Model:
    """Proximal Adam on the noisy-or likelihood. shares: how many labelled documents each fitted one of class 0 and 1 stands for."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model()
    vocabulary, col, starts, docs = instances(texts)
    each = [features(w) for w in vocabulary]
    used: dict[str, int] = {}
    feature = np.fromiter((used.setdefault(f, len(used)) for x in each for f in x), np.int64)
    word = np.repeat(np.arange(len(each)), [len(x) for x in each])
    sent = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(col)]))
    owner = np.repeat(np.arange(len(texts)), np.diff(np.r_[docs, len(starts)]))
    weight = np.where(y > 0, shares[1], shares[0])
    weight /= weight.sum()
    w, b = np.zeros(len(used)), math.log(max(1e-3, (weight * y).sum()) / max(1, len(starts) / len(y)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(sent, np.bincount(word, w[feature], len(each))[col], len(starts))
        soft = np.logaddexp(0, z)
        none = np.bincount(owner, soft, len(y))  # -log of the chance that no sentence is toxic
        p = -np.expm1(-none)
        up = np.where(y > 0, -weight * np.exp(-none) / np.maximum(p, 1e-9), weight)
        g = up[owner] * np.exp(z - soft)
        grad = np.r_[np.bincount(feature, np.bincount(col, g[sent], len(each))[word], len(used)) + RIDGE * w, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        scale = RATE / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        step = scale * m / (1 - 0.9**t)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(scale[:-1] * SPARSE, 0.5))
    return Model(float(b), {f: x for f, x in zip(used, w.tolist(), strict=True) if x})


def scorer(model: Model):
    known = model.weights
    starts = [(n, {f[:-1]: x for f, x in known.items() if f[-1] == "-" and len(f) == n + 1}) for n in BEGINNINGS]

    def weight(word: str) -> float:
        if word in ".!?\n":
            return math.nan
        return known.get(word, 0.0) + sum(x.get(word[:n], 0.0) for n, x in starts if len(word) > n)

    memo = Memo(weight)

    def score(text: str | None) -> tuple[float, int, np.ndarray]:
        """(document score, number of the worst sentence or -1, score of each sentence)."""
        found = _token.findall((text or "").lower())
        x = np.fromiter(map(memo.__getitem__, found), float, len(found))
        ends = np.isnan(x)
        number, x = np.cumsum(ends)[~ends], x[~ends]
        if not len(x):
            return 0.0, -1, x
        if (some := np.flatnonzero(x)).size > 1:  # a word counts once in its sentence
            names, seen = [w for w in found if w not in ".!?\n"], set()
            for i, at in zip(some.tolist(), number[some].tolist(), strict=True):
                if (key := (at, names[i])) in seen:
                    x[i] = 0.0
                seen.add(key)
        z = model.bias + np.add.reduceat(x, np.r_[0, np.flatnonzero(np.diff(number)) + 1])
        return float(-math.expm1(-np.logaddexp(0, z).sum())), int(z.argmax()), 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    return score


def located(text: str, numbers: set[int]) -> dict[int, tuple[int, int]]:
    """Start and end of the numbered sentences in the text."""
    out, n, start, end, inside = {}, -1, 0, 0, False
    for found in _token.finditer(text):
        if found[0] in ".!?\n":
            if inside and n in numbers:
                out[n] = start, found.end()
            inside = False
        else:
            if not inside:
                n, start, inside = n + 1, found.start(), True
            end = found.end()
    if inside and n in numbers:
        out[n] = start, end
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A model of a bounded, deterministic sample of the labelled documents."""
    rows, shares = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    return fit([r[0] for r in rows], np.array([r[1] > 0 for r in rows], float), (shares.get(0, 1.0), shares.get(1, 1.0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", locate: float = 0.5) -> DataFrame:
    """(id, score, sentences, worst_start, worst_end, worst_score, offending).

    ``offending`` has (start, end, score) of every sentence whose own score reaches ``locate``, in text order; the worst sentence's span is
    located where the document's score does, for which several sentences below it may be enough.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer(sent.value)
        for batch in rows_of(batches):
            out = []
            for text in batch.column(1):
                text = text.as_py()
                p, worst, each = one(text)
                bad = np.flatnonzero(each >= locate).tolist()
                places = located(text, {worst, *bad}) if len(each) and (bad or p >= locate) else {}
                listed = [{"start": places[i][0], "end": places[i][1], "score": float(each[i])} for i in bad]
                out.append((p, len(each), *(places[worst] if places and p >= locate else (None, None)), float(each[worst]) if len(each) else 0.0, listed))
            columns = list(zip(*out, strict=True))
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "score", "sentences", "worst_start", "worst_end", "worst_score", "offending"])

    schema = f"{id_col} {kind}, score double, sentences int, worst_start int, worst_end int, worst_score double, offending array<struct<start: int, end: int, score: double>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, "documents", sf_dir).select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = train(docs, table(spark, "labels", sf_dir).where(~held))
    out = score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "sentences", "worst_start", "worst_end", "worst_score", "offending")
