import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rivulet.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"

TOKENIZER = Tokenizer.from_file(PATH)


def whole_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", ["", " ", "Hello,  World's end!", "É́tude\tÀ b\n\nc", "x\x1cy z", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ ΟΔΟΣ", "日本語 テキスト１２３", "á ́b", "it's we'll 123 4.5%", "Don't. a.'s x_ _y_. É! İA, ΑΣ. ok!!! A% b### (c) <|endoftext|>. d<|x", "½. x²! 3,5; e\u0301."])
def test_words_are_encoded_as_in_the_whole_text(text):
    assert np.frombuffer(packing.Encoder(PATH).encode([text])[0], "<u4").tolist() == whole_ids(text)[:-1]


def test_plan_uses_no_more_than_the_histogram_holds():
    rng = np.random.default_rng(0)
    hist = np.zeros(64, np.int64)
    np.add.at(hist, rng.integers(1, 64, 500), 1)
    chosen, left = packing.plan(hist, 64)
    used = hist - left
    again = np.zeros(64, np.int64)
    for parts, n in chosen:
        assert sum(a * c for a, c in parts.items()) == 64 and n > 0
        for a, c in parts.items():
            again[a] += c * n
    assert (left >= 0).all() and (used == again).all() and used.sum() > 0.7 * hist.sum()


def check(docs, pieces, window):
    """Every id of every document once and in place; sequences gapless, full or a power of two."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids, at = whole_ids(text), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == zlib.crc32(r.ids)
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)


@pytest.mark.parametrize("window", [64, 2048])
def test_round_trip(spark, window):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (-1, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    check(rows, packing.pack(frame, PATH, window).collect(), window)


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b c")] * 5, "doc_id long, text string")
    out = packing.pack(frame, PATH, 8).collect()
    assert sum(r.length for r in out) == 20
    assert packing.pack(frame.limit(0), PATH).count() == 0


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, plain = packing.Encoder(path), Tokenizer.from_file(path)
    texts = ["Two words", " Leading space, Ünïcode.", "", None, "a\n\nb"]
    assert other.whole and not packing.Encoder(PATH).whole
    assert [np.frombuffer(x, "<u4").tolist() for x in other.encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_repeat_counts_are_a_least_squares_solution(seed):
    """Where x > 0 the gradient is nought, elsewhere it points out of bounds: so it is for no other x, as the problem is convex."""
    rng = np.random.default_rng(seed)
    hist = np.bincount(rng.integers(1, 32, 400), minlength=32)
    parts = packing.combinations(hist, 32)
    a = np.zeros((len(hist), len(parts)))
    for j, p in enumerate(parts):
        for length, copies in p.items():
            a[length, j] = copies
    x = packing.solve(parts, hist)
    slope = a.T @ (a @ x - hist)
    assert (x >= 0).all() and (slope > -0.5).all() and np.abs(slope[x > 0.05]).max() < 0.5
    best = np.zeros(len(parts))  # another way: projected gradient steps
    step = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20_000):
        best = np.maximum(0, best - step * (a.T @ (a @ best - hist)))
    error = lambda y: ((a @ y - hist) ** 2).sum()
    assert error(x) <= error(best) * 1.01 + 1


def test_signs_are_parted_before_words_are_learned(monkeypatch):
    """A word is learned once, whatever signs follow it; words with an apostrophe or a sign outside the common scripts stay whole until then."""
    encoder, learned = packing.Encoder(PATH), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda new: (learned.extend(w for w in new if not w.isspace()), learn(new)))
    # The probe of a new encoder has taught it some signs.
    texts = ["Alpha béta. (alpha), ALPHA! béta_", None, "don't. a—b 3×4 же.", "", "alpha x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [whole_ids(t)[:-1] for t in texts]
    assert sorted(learned) == sorted(["alpha", "béta", "),", "!", "don't.", "a—b", "3×4", "же", "alpha x"])
    assert encoder.encode([]) == [] and encoder.encode(["", None]) == [b"", b""]


def test_workers_give_the_tokenizer_back_to_other_operators(spark):
    """Reused workers keep it from task to task of packing; tasks of other operators find none, and quality leaves none behind."""
    import gc

    import pyarrow as pa

    from rivulet.llm import quality
    from rivulet.llm.common import released

    docs = spark.createDataFrame([(i, f"Some words {i}, of a text. " * 5) for i in range(400)], "doc_id long, text string").repartition(32)

    def alive(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Encoder" for x in gc.get_objects())], pa.int64())], names=["n"])

    def seen(run):
        return sum(r.n for r in docs.mapInArrow(run, "n long").collect())

    def tokenise():
        assert packing.tokenised(docs, "doc_id", "text", PATH, 2048, 1).count() == 400

    tokenise()
    assert seen(alive) > 0
    assert seen(released(alive)) == 0 and seen(alive) == 0
    tokenise()
    model = quality.fit(["good words", "bad ones"], np.array([2, 0]), {})
    assert quality.score(docs, model).where("expected_grade >= 0").count() == 400
    assert seen(alive) == 0
