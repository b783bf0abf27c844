"""Language ID by interpolated Kneser-Ney character models, one a language, in sorted arrays of hashed n-grams.

Texts are lower-cased, letters are their code points, runs of other signs are one space. Each order keeps the sorted 64-bit hashes of the
n-grams that any language saw, with the finished log probability in every language, and the sorted contexts with their
back-off weights, so scoring is a binary search an order. The language of lowest cross-entropy a letter wins; a softmax over total
log-likelihoods, tempered on validation texts, is its score, and a text is rejected whose cross-entropy lies above what nearly all
validation texts of that language have.

Defined results: null text and texts without a letter are ``und`` with score 0 and rejected; letters that training did not see are
equally unlikely in all languages; without training rows everything is ``und``; equal cross-entropies go to the language that sorts first; an empty table gives
an empty result; other columns than id and text are not read for predictions.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, bucket, crc_mod, mix64, released, rows_of, table

ORDER = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Training documents of each language that the models read at most (about; all, where there are fewer).
PER_LANGUAGE = 600
#: One in so many training documents only calibrates.
VALIDATION = 5
REJECT = 0.995
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each code point: 2 letter, 1 mark (part of a word), 0 other."""
    return np.array([2 if chr(c).isalpha() else 1 if unicodedata.category(chr(c))[0] == "M" else 0 for c in range(0x110000)], np.uint8)


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)


def coded(text: str | None) -> tuple[np.ndarray, bool]:
    """Code points of letters, 0 for runs of other signs and at both ends; whether there is a letter."""
    x = points(text)
    kind = _letters()[x]
    c = np.zeros(len(x) + 2, np.uint64)
    c[1:-1] = np.where(kind > 0, x, 0)
    return c[np.r_[True, (c[1:] > 0) | (c[:-1] > 0)]], bool((kind == 2).any())


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams; the one that ends at place p stands at p - k + 1."""
    n = len(codes) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(k):
        out = out * _STEP + codes[i : i + n] + np.uint64(1)
    return mix64(out)


def placed(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts, each behind ORDER - 1 spaces; the places of their signs but the first; their numbers."""
    pad = np.zeros(ORDER - 1, np.uint64)
    sizes = np.array([len(c) - 1 for c in texts])
    first = np.cumsum(sizes + ORDER - 1) - sizes
    return np.concatenate([np.r_[pad, c[1:]] for c in texts]), np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), sizes


@dataclass
class Models:
    languages: list[str]
    size: int  # different signs of training, and one for all others
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    limit: np.ndarray
    temperature: float = 1.0

    def loglik(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probability of each text in each language, and its number of signs."""
        codes, place, sizes = placed(texts)
        out = np.zeros((len(place), len(self.languages)), np.float32)
        left = np.arange(len(place))
        for k in range(ORDER, 0, -1):
            table, want = self.keys[k - 1], grams(codes, k)[place[left] - k + 1]
            at = np.minimum(np.searchsorted(table, want), len(table) - 1)
            hit = table[at] == want
            out[left[hit]] += self.logp[k - 1][at[hit]]
            left = left[~hit]
            if not len(left):
                break
            context = grams(codes, k - 1)[place[left] - k + 1]
            at = np.minimum(np.searchsorted(self.contexts[k - 1], context), len(self.contexts[k - 1]) - 1)
            known = self.contexts[k - 1][at] == context
            out[left[known]] += self.backoff[k - 1][at[known]]
        out[left] -= np.log(self.size)
        return np.add.reduceat(out, np.cumsum(np.r_[0, sizes[:-1]]), axis=0, dtype=np.float64), sizes

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, accepted) of each text."""
        signs = [coded(t) for t in texts]
        asked = [i for i, (_, letter) in enumerate(signs) if letter and self.languages]
        out: list[tuple[str, float, float | None, bool]] = [(UNKNOWN, 0.0, None, False)] * len(texts)
        if asked:
            total, n = self.loglik([signs[i][0] for i in asked])
            entropy = -total / n[:, None]
            best = entropy.argmin(axis=1)
            score = posterior(total, n, self.temperature)[np.arange(len(best)), best]
            for i, b, s, h in zip(asked, best.tolist(), score.tolist(), entropy[np.arange(len(best)), best].tolist(), strict=True):
                out[i] = (self.languages[b], min(1.0, s), h, h <= self.limit[b])
        return out


def posterior(total: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    x = total / np.sqrt(n)[:, None] * temperature  # letters of one text are not independent
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _counts(texts: list[np.ndarray]) -> list[tuple[np.ndarray, ...]]:
    """(keys, counts, contexts, keys without the first sign) of each order: raw counts of the longest, of shorter ones the number of distinct signs before them."""
    if not texts:
        return [(np.empty(0, np.uint64),) * 4] * ORDER
    codes, place, _ = placed(texts)
    out = []
    for k in range(ORDER, 0, -1):
        keys, first, n = np.unique(grams(codes, k)[place - k + 1], return_index=True, return_counts=True)
        place = place[first]
        out.append((keys, n, grams(codes, k - 1)[place - k + 1], grams(codes, k - 1)[place - k + 2]))
    return out[::-1]


def fit(rows: list[tuple[str, str]]) -> Models:
    """rows: (text, language). Texts of every VALIDATION-th place calibrate temperature and rejection."""
    languages = sorted({lang for _, lang in rows})
    place: Counter = Counter()
    held, train = [], {lang: [] for lang in languages}
    for text, lang in rows:
        place[lang] += 1
        c, letter = coded(text)
        if letter:
            if place[lang] % VALIDATION == 0:
                held.append((c, languages.index(lang)))
            else:
                train[lang].append(c)
    counted = [_counts(train[lang]) for lang in languages]
    out = Models(languages, 1, [], [], [], [], np.full(len(languages), np.inf))
    lower = None
    for k in range(1, ORDER + 1):
        per = [c[k - 1] for c in counted]
        every = [np.concatenate(x) for x in zip(*per, strict=True)] if per else [np.empty(0, np.uint64)] * 4
        keys, first = np.unique(every[0], return_index=True)
        of_key, shorter = every[2][first], every[3][first]
        contexts, group = np.unique(of_key, return_inverse=True)
        if lower is None:
            out.size = len(keys) + 1
            below = np.full((len(keys), len(per)), 1 / out.size)
        else:
            below = lower[1][np.searchsorted(lower[0], shorter)]
        p, lam = np.zeros((len(keys), len(per))), np.ones((len(contexts), len(per)))
        for j, (own, n, *_) in enumerate(per):
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            c = np.zeros(len(keys))
            c[np.searchsorted(keys, own)] = n
            total = np.bincount(group, c, len(contexts))
            kinds = np.bincount(group, c > 0, len(contexts))
            lam[:, j] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            p[:, j] = np.maximum(c - discount, 0) / np.maximum(total, 1)[group] + lam[group, j] * below[:, j]
        out.keys.append(keys)
        out.logp.append(np.log(np.maximum(p, 1e-30)).astype(np.float32))
        out.contexts.append(contexts)
        out.backoff.append(np.log(np.maximum(lam, 1e-30)).astype(np.float32))
        lower = (keys, p)
    if held:
        total, n = out.loglik([c for c, _ in held])
        truth = np.array([j for _, j in held])
        own = -total[np.arange(len(held)), truth] / n
        for j in range(len(languages)):
            if (truth == j).sum() >= 20:
                out.limit[j] = np.quantile(own[truth == j], REJECT) * 1.05
        grid = [2.0**e for e in range(-6, 5)]
        loss = [-np.log(np.maximum(posterior(total, n, t)[np.arange(len(held)), truth], 1e-12)).mean() for t in grid]
        out.temperature = grid[int(np.argmin(loss))]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Models:
    """Models of a bounded, deterministic sample of the documents with a language, chosen by hash of the id. Languages are few: each has a model, and the driver holds all of them."""
    known = docs.where(F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col(lang_col) == lang, int(min(1.0, per_language / n) * (1 << 20))).otherwise(share)
    rows = bounded_sample(known.where(bucket(F.col(id_col), 1 << 20) < share).select(id_col, text_col, lang_col), id_col, text_col, lang_col)
    return fit([(r[1], r[2]) for r in sorted(rows, key=lambda r: (str(r[0]), r[1]))])


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, accepted) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in rows_of(batches, 400_000):
            columns = list(zip(*own.predict(batch.column(1).to_pylist()), strict=True))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x if k != pa.bool_() else bool(x) for x in c], k) for c, k in zip(columns, kinds, strict=True))], names=["id", "lang_pred", "score", "cross_entropy", "accepted"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), f"{id_col} {kind}, lang_pred string, score double, cross_entropy double, accepted boolean")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, "documents", sf_dir).select("doc_id", "text", "lang")
    held = crc_mod(F.col("doc_id"), 4) == 2
    out = predict(docs, train(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
