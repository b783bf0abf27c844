"""Quality as ordinal regression: one hashed-text score, ordered thresholds between grades (cumulative logits).

The score is the (smoothed) mean weight of a text's tokens (hashed words and runs of other signs) plus weights of its bucketed shape (repetition,
upper case, signs); P(grade > g) is the logistic of score minus threshold g. Thresholds are kept in order by fitting the first
and the logarithms of the gaps. Graded ratings come from the labels: 0 is low quality, 1 good but toxic, 2 good.

Defined results: null text is as an empty one and has the score of its shape alone; of several ratings of one document the highest
counts; null ratings count for nothing; without two different grades every document has the middle grade and passes; an empty table
gives an empty result; columns other than id and text pass through ``select`` unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, labelled_sample, leave, table, tidy

_token = re.compile(r"\w+|[^\w\s]+")
DIMENSIONS = 1 << 16
SHAPES = 24
#: Tokens of weight 0 that every text is thought to have besides its own: a few words alone decide little.
PRIOR = 20
#: Rated documents of each grade that training takes at most (all, where there are fewer).
PER_GRADE = 2500
STEPS = 150
RATE = 0.05
RIDGE = 1e-4
#: Chance of grade 1 or better from which a document is selected.
SELECT = 0.5


def _hashed(token: str) -> int:
    kind = token if token[0].isalnum() or token[0] == "_" else f"{token[-3:]}|"
    return xxhash.xxh3_64_intdigest(kind.lower().encode("utf-8", "surrogatepass")) % DIMENSIONS


@cache
def _capitals() -> np.ndarray:
    """Whether each code point is an upper-case letter."""
    return np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000)


def capitals(text: str) -> int:
    """How many characters of the whole text are upper-case letters."""
    if text.isascii():
        codes = np.frombuffer(text.encode(), np.uint8)
        return int(np.count_nonzero((codes - np.uint8(65)) < 26))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(np.count_nonzero(_capitals()[codes]))


def shape(text: str, tokens: np.ndarray) -> list[int]:
    """Indices of the shape buckets of a text, above the hashed tokens."""
    n = len(tokens)
    signs = sum(map(text.count, "!#$%&*|"))
    letters = max(1, len(text) - text.count(" "))
    upper = capitals(text)
    same = float((tokens[1:] == tokens[:-1]).mean()) if n > 1 else 0.0
    step = lambda x, k: min(k - 1, int(x * k))
    return [DIMENSIONS + x for x in (step(same, 8), 8 + step(upper / letters, 8), 16 + step(signs / letters * 4, 8))]


def parsed(text: str | None, memo: Memo) -> tuple[np.ndarray, list[int]]:
    text = text or ""
    found = _token.findall(text)
    ids = np.fromiter(map(memo.__getitem__, found), np.int64, len(found))
    return ids, shape(text, ids)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > g) for each threshold g."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -30, 30)))

    def score(self, text: str | None, memo: Memo) -> float:
        ids, parts = parsed(text, memo)
        return float(self.weights[ids].sum() / (len(ids) + PRIOR) + self.weights[parts].sum())


def fit(texts: list[str], grades: np.ndarray, shares: dict[int, float], grade_count: int = 3) -> Model:
    y = np.asarray(grades, int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(DIMENSIONS + SHAPES), np.linspace(-4, -2, grade_count - 1))
    memo = Memo(_hashed)
    rows, cols, values = [], [], []
    for i, text in enumerate(texts):
        ids, parts = parsed(text, memo)
        used, counts = np.unique(ids, return_counts=True)
        rows.append(np.full(len(used) + len(parts), i))
        cols.append(np.r_[used, parts])
        values.append(np.r_[counts / (len(ids) + PRIOR) * 10, np.ones(len(parts))])  # scaled so that both kinds learn alike
    row, col, value = (np.concatenate(x) for x in (rows, cols, values))
    weight = np.array([shares.get(int(g), 1.0) for g in y]) ** 0.5  # halfway between the sample and the corpus
    weight /= weight.sum()
    n = DIMENSIONS + SHAPES
    w, t0, gaps = np.zeros(n), -1.0, np.zeros(grade_count - 2)
    m, v = np.zeros(n + 1 + len(gaps)), np.zeros(n + 1 + len(gaps))
    for step in range(1, STEPS + 1):
        cuts = np.r_[t0, t0 + np.cumsum(np.exp(gaps))]
        z = np.bincount(row, value * w[col], len(y))
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -30, 30)))
        full = np.c_[np.ones(len(y)), above, np.zeros(len(y))]
        slope = np.c_[np.zeros(len(y)), above * (1 - above), np.zeros(len(y))]
        at = np.arange(len(y))
        p = np.maximum(full[at, y] - full[at, y + 1], 1e-9)
        dz = -(slope[at, y] - slope[at, y + 1]) / p * weight
        dcut = np.zeros(len(cuts))
        for g in range(len(cuts)):
            dcut[g] = (np.where(y == g + 1, slope[:, g + 1] / p, 0) - np.where(y == g, slope[:, g + 1] / p, 0)) @ weight
        dgaps = np.array([dcut[i + 1 :].sum() * np.exp(gaps[i]) for i in range(len(gaps))])
        grad = np.r_[np.bincount(col, dz[row] * value, n) + RIDGE * w, dcut.sum(), dgaps]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, t0, gaps = w - move[:n], t0 - move[n], gaps - move[n + 1 :]
    w[:DIMENSIONS] *= 10
    return Model(w, np.r_[t0, t0 + np.cumsum(np.exp(gaps))])


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The graded rating: 0 low quality, 1 good but toxic, 2 good. A null toxicity counts as none."""
    return F.when(F.col(quality) <= 0, 0).when(F.col(quality) > 0, F.when(F.col(toxic) > 0, 1).otherwise(2))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade: Column | None = None, per_grade: int = PER_GRADE) -> Model:
    """A model of a bounded, deterministic sample of the rated documents. Grades count from 0; there are as many as the highest asks for, three at least."""
    rows, shares = labelled_sample(docs, labels, id_col, text_col, grade_of() if grade is None else grade, per_grade)
    grades = np.array([r[1] for r in rows], int)
    if grades.min(initial=0) < 0:
        raise ValueError("grades count from 0")
    return fit([r[0] for r in rows], grades, shares, max(3, int(grades.max(initial=0)) + 1))


def score(docs: DataFrame, model: Model, text_col: str = "text", grade_col: str = "expected_grade", tail_col: str = "tail_probability") -> DataFrame:
    """``docs`` with the expected grade and P(grade >= 1); columns of these names in ``docs`` are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("grade double, tail double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        leave()
        memo, model = Memo(_hashed), sent.value
        try:
            for texts in batches:
                tails = model.tails(np.array([model.score(t, memo) for t in texts], float))
                yield pd.DataFrame({"grade": tails.sum(axis=1), "tail": tails[:, 0]})
        finally:
            tidy()

    return docs.withColumn("__graded", run(text_col)).withColumns({grade_col: F.col("__graded.grade"), tail_col: F.col("__graded.tail")}).drop("__graded")


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = SELECT) -> DataFrame:
    """``docs`` without the rejected ones, its columns unchanged."""
    scored = score(docs, train(docs, labels, id_col, text_col), text_col, "__grade", "__tail")
    return scored.where(F.col("__tail") >= at_least).select(*docs.columns)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, "documents", sf_dir).select("doc_id", "text")
    out = score(docs, train(docs, table(spark, "labels", sf_dir)))
    return out.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= SELECT).alias("keep"))
