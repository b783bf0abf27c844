"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing columns, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import audio, chat_format, decontaminate, language, ngram_join, quality, substring_dedup, toxicity, url_filter
from rivulet.llm.common import written

from . import brute

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(f"{WORDS[i % 20]}{i % 977}" for i in range(40_000)) + "."
TEXT = "The river ran past the old mill. Nobody had seen the miller for years. Children still told stories about him at night. He was never found again."
ROWS = [(1, TEXT), (1, TEXT), (2, None), (3, ""), (4, " \n\t "), (None, TEXT), (None, None), (5, LONG), (6, "?!"), (7, "one two"), (8, "One TWO")]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in ("id", "n", "sig", "th", "score", "removed", "hash", "key", "lang_pred", "expected_grade", "__t"):
        frame = frame.withColumn(c, F.lit("clash"))
    return frame


def test_url_filter(spark):
    rows = [(1, None), (2, ""), (3, "no-scheme/en/"), (4, "http://A.Example.COM/en/x"), (5, "http://www.example.com/en/x"), (6, "https://x.net/fr/"), (7, "http://x.org/casino-bonus?free"), (8, "http://x.org/free-win"), (9, "http://x.org/freewin"), (10, "http://x.org?xxx"), (10, "http://x.org?xxx"), (11, "http://netcom/"), (12, "http://x.com")]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("weight", F.lit("clash"))
    out = {r.page_id: r for r in url_filter.judge(frame).collect()}
    got = {i: (r.host, r.path, r.rule, r.verdict) for i, r in out.items()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[5][2:] == ("www.example.com/en/", "allow")
    assert got[6][2:] == ("net/fr/", "block") and got[7][3] == "block" and got[8][3] == "block" and got[9][3] == "allow" and got[10][3] == "block"
    assert got[11][2] is None and got[12] == ("x.com", "", None, "allow")
    assert url_filter.judge(frame).count() == len(rows) and url_filter.judge(frame.limit(0)).count() == 0


def test_url_weights_decide(spark):
    frame = spark.createDataFrame([(1, "http://x.org/free-click"), (2, "http://x.org/poker-casino"), (3, "http://x.org/free-click-cheap-win"), (4, "http://x.org/poker-poker")], "page_id long, url string")
    got = {r.page_id: (r.soft_distinct, r.verdict) for r in url_filter.judge(frame).collect()}
    assert got == {1: (2, "allow"), 2: (2, "block"), 3: (4, "block"), 4: (1, "allow")}
    terms = spark.createDataFrame([("Free", 0.6), ("free", 0.2), ("click", 0.5), ("", 1.0), (None, 1.0), ("river", None)], "term string, weight double")
    own = url_filter.vocabulary_of(terms)
    assert own == {"free": 0.6, "click": 0.5} and [r.verdict for r in url_filter.judge(frame, vocabulary=own).orderBy("page_id").collect()] == ["block", "allow", "block", "allow"]


def test_substring_dedup(docs):
    out = [(r.doc_id, r.text, r.removed) for r in substring_dedup.dedup(docs).collect()]
    assert len(out) == len(ROWS) and (2, None, 0) in out and (3, "", 0) in out and (4, " \n\t ", 0) in out
    assert out.count((1, TEXT, 0)) == 2 and (None, TEXT, 0) in out
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_substring_dedup_against_brute_force(spark):
    a = "Water boils at sea level when heated enough. Steam then leaves the open kettle quickly. A lid keeps most of the heat inside it."
    rows = [(3, f"Intro of three. {a} Something else ends this one."), (1, f"{a} First has more."), (2, "Nothing is shared here. It is a text of its own. Truly so, as one can see."), (4, f"Own start. {a.upper()}"), (5, f"{a} {a}")]
    got = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=20).collect()}
    assert [got[i] for i, _ in rows] == brute.deduplicated(rows, 3, 20)
    assert got[1] == rows[1][1] and got[2] == rows[2][1] and got[3].strip() == "Intro of three. Something else ends this one." and "KETTLE" not in got[4] and got[5] == ""


def test_long_passages_without_sentence_ends_are_cut(spark):
    passage = " ".join(f"{WORDS[(i * 7) % 20]}{WORDS[i % 20]}{i}" for i in range(90))
    rows = [(1, f"aa bb cc {passage} dd ee"), (2, f"quite another opening {passage} and an end"), (3, "clean " * 3)]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].removed == 0 and got[3].removed == 0 and len(got[2].text.split()) < 45


def test_every_passage_of_51_words_in_long_sentences_holds_a_span():
    rng = np.random.default_rng(5)
    word = lambda: WORDS[rng.integers(20)] + str(rng.integers(50))
    for space in (" ", "\t", "\u00a0"):
        for k in range(100):
            passage = [word() for _ in range(51)]
            a, b = (space.join([word() for _ in range(rng.integers(1, 30))] + passage + [word() for _ in range(rng.integers(1, 30))]) for _ in range(2))
            spans = lambda t: set(substring_dedup.spans(t, substring_dedup.SPAN, substring_dedup.MIN_WORDS)[0].tolist())
            assert spans(a) & spans(b) and spans(a) & spans(f"It ends. {space.join(passage)}. More")
    text = "one" + " " * 40 + "\n" + " " * 30
    assert substring_dedup.cut(text)[2].tolist() == [0, len(text)]


def test_substring_dedup_on_random_texts(spark):
    import random

    rng = random.Random(11)
    word = lambda: rng.choice(WORDS) + str(rng.randrange(9))
    shared = [" ".join(" ".join(word() for _ in range(rng.choice([3, 9, 30]))) + rng.choice([". ", "! ", "\n", '." ', "。 "]) for _ in range(5)) for _ in range(6)]
    rows = [(rng.choice([None, i, i // 2]), None if i == 5 else "".join(rng.choice([rng.choice(shared), f"{word()} {word()}. "]) for _ in range(rng.randrange(6)))) for i in range(60)]
    out = substring_dedup.dedup(spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(rows)], "doc_id long, n int, text string"))
    assert [r.text for r in out.orderBy("n").collect()] == brute.deduplicated(rows, substring_dedup.SPAN, substring_dedup.MIN_WORDS)


def test_stops_inside_words_and_length_changing_letters():
    assert substring_dedup.cut("f g。h İ")[1].tolist() == [0, 2, 4] and brute.sentences("f g。h İ")[0][1] == 4
    assert len(substring_dedup.cut("A.b c.\"\nd")[1]) == 3


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "Tom Baker bought 12 kg of apples for 30 dollars and then sold half of them to Ann Smith."), (2, None), (3, "two words"), (4, "a short item here now"), (5, TEXT), (6, TEXT)], "item_id long, text string").withColumn("size", F.lit("clash"))
    more = spark.createDataFrame([(100, "Intro. Tom Baker bought 12 kg of apples for 30 dollars and then sold half of them to Ann Smith. End."), (101, "Then Bob Miller bought 7 kg of apples for 99 dollars and then sold half of them to Eve Stone."), (102, "He bought apples for dollars."), (103, "well a short item here now ok")], "doc_id long, text string")
    out = {(r.id, r.item): r.kind for r in decontaminate.matches(docs.unionByName(more, allowMissingColumns=True), bench).collect()}
    assert out == {(100, 1): "verbatim", (101, 1): "reparameterised", (103, 4): "verbatim", (1, 5): "verbatim", (None, 5): "verbatim"}
    left = decontaminate.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [2, 3, 4, 5, 6, 7, 8] and left.columns == docs.columns
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, "take 5 boxes and add 5 boxes then remove 7 boxes and count all boxes")], "item_id long, text string")
    rows = [(1, "take 8 boxes and add 8 boxes then remove 9 boxes and count all boxes"), (2, "take 8 boxes and add 3 boxes then remove 9 boxes and count all boxes")]
    out = {r.id: r.kind for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert out == {1: "reparameterised"}


def test_an_alignment_is_split_where_its_slots_disagree(spark):
    item = "On day 12 the crew of the old ship saw 12 whales near the quiet bay and then the whole crew sang all through the night until the sun rose"
    rows = [(1, item.replace("saw 12", "saw 13")), (2, item.replace("day 12", "day 5"))]
    items = [(1, item), (2, " ".join(["What is"] + [f"{i} plus" for i in range(3, 14)] + ["14 equal to now"])), (3, "Compute " + " ".join(str(3 * i) for i in range(4, 15)))]
    rows += [(3, f"So: {items[1][1]}? Well."), (4, items[2][1])]
    out = {(r.id, r.item): (r.kind, r.coverage) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert out == brute.contaminated(rows, items) and set(out) == {(1, 1), (2, 1), (3, 2), (4, 3)}


def test_decontamination_against_brute_force(spark):
    import random

    rng = random.Random(2)
    fill = lambda: rng.choice([rng.choice(WORDS), str(rng.randrange(30)), rng.choice(["Ann", "Bob"]), "kg", rng.choice("seven two".split())])
    items = [(i, " ".join(fill() for _ in range(rng.choice([3, 5, 9, 14, 30])))) for i in range(25)]
    rows = []
    for i in range(70):
        own = rng.choice(items)[1].split()
        if rng.random() < 0.6:
            own = [fill() if rng.random() < 0.04 else str(rng.randrange(30)) if w.isdigit() and rng.random() < 0.3 else w for w in own]
        rows.append((i, " ".join([fill() for _ in range(rng.randrange(9))] + own + [fill() for _ in range(rng.randrange(9))])))
    out = {(r.id, r.item): (r.kind, r.coverage) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert out == brute.contaminated(rows, items) and len(out) > 30


def test_repeated_lines_cover_an_item_window_once(spark):
    bench = spark.createDataFrame([(1, "the quick river ran past the old mill while nobody had seen any miller near those stones")], "item_id long, text string")
    line = "the quick river ran past the old mill.\n"
    rows = [(1, line * 30), (2, line + "nobody had seen any"), (3, "the quick river ran past the old mill while nobody had seen any")]
    out = {r.id: r.coverage for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert out == {3: 0.6}


def test_items_dense_in_placeholders(spark):
    items = [(1, "1 2 3 4 5 6 7 8 9 10 11 12"), (2, "10 20 30 40"), (3, "then add 12 14 16 18 20 22 24 to get their whole sum")]
    rows = [(1, f"see {items[0][1]} here"), (2, "so 10 20 30 40 it is"), (3, f"well {items[2][1]} now"), (4, "well then add 31 33 35 37 39 41 43 to get their whole sum now")]
    rows += [(5, "see 2 3 4 5 6 7 8 9 1 1 1 1 here"), (6, "so 10 20 30 41 it is"), (7, "so 20 10 30 40 it is")]
    out = {(r.id, r.item): (r.kind, r.coverage) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert out == {(1, 1): ("verbatim", 1.0), (2, 2): ("verbatim", 1.0), (3, 3): ("verbatim", 1.0), (4, 3): ("reparameterised", 1.0)}


def brute_force_groups(rows, k, percent):
    sets = []
    for i, t in rows:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        ws = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
        sets.append((i, {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} - {()}))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for (i, s), g in zip(sets, group, strict=True):
        members = [m for (m, _), h in zip(sets, group, strict=True) if h == g and m is not None]
        out.append((i, len(s), min(members) if members else i))
    return sorted(out, key=repr)


def test_jaccard_edges(docs):
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs, k=3, percent=90).collect()), key=repr)
    assert out == brute_force_groups(ROWS, 3, 90)
    assert ngram_join.jaccard_groups(docs.limit(0)).count() == 0
    kept = ngram_join.keep_first(docs, k=3, percent=90)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 7] and kept.columns == docs.columns


@pytest.mark.parametrize("seed", range(3))
def test_one_row_of_each_group_stays_with_any_ids(spark, seed):
    rng = np.random.default_rng(seed)
    base = [" ".join(rng.choice(WORDS, 40)) for _ in range(6)]
    texts = [None, "", " "] + [f"{b} {x}" for b in base for x in ("one", "two", "one")] + [" ".join(rng.choice(WORDS, 30)) for _ in range(5)]
    rows = [(None if x == 0 else int(x), texts[int(t)]) for x, t in zip(rng.integers(0, 6, 60), rng.integers(0, len(texts), 60), strict=True)]
    got = [tuple(r) for r in ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=80).collect()]
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]  # with ids of their own the groups are known
    group = {i: c for i, _, c in brute_force_groups(numbered, 3, 80)}
    wordless = [r for r in rows if not (r[1] or "").split()]
    assert sorted((r for r in got if not (r[1] or "").split()), key=repr) == sorted(wordless, key=repr)
    stays = {}
    for i, r in enumerate(rows):
        if (r[1] or "").split():
            stays.setdefault(group[i], []).append(r)
    found = [r for r in got if (r[1] or "").split()]
    assert len(found) == len(stays)
    for members in stays.values():
        own = [r for r in found if r in members]
        assert len(own) == 1 and (own[0][0] is None, own[0][0] or 0) == min((i is None, i or 0) for i, _ in members)


def test_packed_counts_come_back():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    vec = np.concatenate([rng.integers(0, top, (7, ngram_join.GROUPS)) for top in (2, 16, 17, 256, 300, 65536)]).astype("<u2")
    packed = ngram_join._packed(vec)
    assert (ngram_join._vectors(pa.array(packed, pa.binary())) == vec).all() and {len(x) for x in packed} == {128, 256, 512}
    assert ngram_join._vectors(pa.array([], pa.binary())).shape == (0, ngram_join.GROUPS)


def test_unrelated_rows_with_the_id_of_a_copy_stay(spark):
    a, b = " ".join(WORDS), " ".join(reversed(WORDS))
    rows = [(1, a), (2, a + " more"), (2, b)]
    assert sorted(tuple(r) for r in ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(1, a), (2, b)]


def test_samples_leave_out_only_what_does_not_fit(spark):
    from rivulet.llm.common import bounded_sample

    rows = [(i, "x" * 20, i % 2) for i in range(20)] + [(99, "y" * 2000, 0)]
    frame = spark.createDataFrame(rows, "i long, t string, c int")
    assert sorted(r.i for r in bounded_sample(frame, "i", "t", "c", 1500)) == list(range(20))
    with pytest.raises(ValueError, match="no text"):
        bounded_sample(frame.where("i >= 99 or c = 1"), "i", "t", "c", 1500)


def test_grades_beyond_three(spark):
    rows = [(i, f"{WORDS[i % 5]} " * 30) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 as int) as g")
    model = quality.train(docs, labels, grade=F.col("g"))
    assert len(model.thresholds) == 4 and (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r.expected_grade for r in quality.score(docs, model).collect()}
    assert out[4] > out[2] > out[0]
    with pytest.raises(ValueError, match="count from 0"):
        quality.train(docs, labels, grade=F.col("g") - 1)


@pytest.mark.parametrize(("k", "percent"), [(1, 80), (3, 90)])
def test_jaccard_against_brute_force(spark, k, percent):
    import random

    rng = random.Random(k)
    rows = []
    for g in range(12):
        base = [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(rng.choice([3, 9, 10, 14, 22, 40, 75]))]
        for _ in range(rng.choice([1, 4, 15])):
            copy = [w if rng.random() > 0.03 else "x" + str(rng.randrange(99)) for w in base]
            rows.append((len(rows), " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(frame, k=k, percent=percent).collect()), key=repr)
    assert out == brute_force_groups(rows, k, percent)


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (3, 90)])
def test_cells_of_unrelated_texts_do_not_grow(k, percent):
    import pyarrow as pa

    rng = np.random.default_rng(7)
    shared = []
    for n in (400, 1600):
        texts = pa.array([" ".join(map(str, rng.integers(0, 1 << 40, rng.integers(10, 400)))) for _ in range(n)])
        h, ends = ngram_join.shingle_sets(texts, k)
        keys, owners = ngram_join.cell_keys(h, ends, percent)
        members = np.unique(np.stack([keys, owners], 1), axis=0)[:, 0]
        shared.append(len(members) - len(np.unique(members)))
        size = np.diff(np.r_[0, ends])
        assert np.bincount(owners, minlength=n).max() <= size.max() * 0.75 + 8
    assert shared == [0, 0]


@pytest.mark.parametrize("percent", [50, 66, 80, 90, 99])
def test_linked_sets_share_a_cell(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(600):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.r_[a[int(rng.integers(0, n // 3 + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 2))).astype(np.uint64)]
        sets += [np.unique(a), np.unique(b)]
    keys, owners = ngram_join.cell_keys(np.concatenate(sets), np.cumsum([len(s) for s in sets]), percent)
    held = {i: set(keys[owners == i].tolist()) for i in range(len(sets))}
    linked = 0
    for i in range(0, len(sets), 2):
        a, b = set(sets[i].tolist()), set(sets[i + 1].tolist())
        if a != b and 100 * len(a & b) >= percent * len(a | b):
            linked += 1
            assert held[i] & held[i + 1]
    assert linked > 5 or percent == 99


def test_trees_find_all_that_the_bound_allows():
    import numpy as np

    rng = np.random.default_rng(1)
    vec = rng.poisson(0.4, (300, ngram_join.GROUPS))
    vec[100:200] = vec[:100] + (rng.random((100, ngram_join.GROUPS)) < 0.01)
    n = vec.sum(axis=1)
    tree = ngram_join.CountTree(vec, n)
    for i in range(0, 300, 17):
        low = np.minimum(vec, vec[i]).sum(axis=1)
        union = n + n[i] - low
        must = set(np.flatnonzero(100 * low >= 90 * union).tolist())
        assert must <= set(tree.search(vec[i], int(n[i]), 90).tolist())


LABELS = [(1, 1, 0), (3, 0, 1), (5, 1, None), (None, 1, 1), (2, None, None)]


def test_toxicity(spark, docs):
    bad = [(100 + i, f"Fine words come first number {i}. You are a stupid clown today. More text follows {WORDS[i % 20]}.") for i in range(40)]
    good = [(200 + i, f"Fine words come first number {i}. You are a kind friend today. More text follows {WORDS[i % 20]}.") for i in range(40)]
    frame = docs.unionByName(spark.createDataFrame(bad + good, "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(i, 1) for i, _ in bad[:30]] + [(i, 0) for i, _ in good[:30]] + [(1, None), (bad[0][0], 0)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(frame, toxicity.train(frame, labels)).collect()}
    assert all(out[i].score > 0.7 for i, _ in bad) and all(out[i].score < 0.3 for i, _ in good)
    assert bad[35][1][out[135].worst_start : out[135].worst_end] == "You are a stupid clown today."
    assert out[2].score == out[3].score == out[4].score == 0.0 and out[5].sentences == 1
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert len(none) == len(ROWS) and max(r.score for r in none) < 1e-9
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def test_toxicity_scores_against_plain_loops(spark):
    import math
    import random
    import re

    rng = random.Random(5)
    words = ["clown", "clowns", "stupid", "stupidly", "fine", "day", "übel", "a", "stu"]
    weights = {"clown": 2.5, "clo-": 0.5, "stup-": 1.25, "stupid": 1.0, "übel": 3.0, "fine": -1.0, "stu-": 0.25}
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "! ", "\n", "?? "]) for _ in range(rng.randrange(14)))) for i in range(60)] + [(60, None), (61, "... !"), (62, "Clown CLOWN clown")]

    def plain(text):
        keep, each = 1.0, []
        for sentence in re.split(r"[.!?\n]", (text or "").lower()):
            found = set(re.findall(r"\w+", sentence))
            if found:
                z = -3.0
                for w in found:
                    z += weights.get(w, 0.0) + sum(weights.get(w[:n] + "-", 0.0) for n in (3, 4, 5, 6) if len(w) > n)
                each.append(1 / (1 + math.exp(-z)))
                keep *= 1 - each[-1]
        return (1 - keep if each else 0.0), each

    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), toxicity.Model(-3.0, weights)).collect()}
    for i, t in rows:
        score, each = plain(t)
        assert abs(out[i].score - score) < 1e-9 and out[i].sentences == len(each) and len(out[i].offending) == sum(x >= 0.5 for x in each)
        assert abs(out[i].worst_score - max(each, default=0.0)) < 1e-9


def test_every_offending_sentence_is_listed(spark):
    text = "You are a clown! Fine words here.\nWhat a stupid clown. All is well. So stupid"
    rows = [(1, text), (2, "Fine words here."), (3, None), (4, "İ. A CLOWN")]
    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), toxicity.Model(-4.0, {"clown": 6.0, "stupid": 5.0})).collect()}
    assert [text[x.start : x.end] for x in out[1].offending] == ["You are a clown!", "What a stupid clown.", "So stupid"]
    assert [round(x.score, 3) for x in out[1].offending] == [0.881, 0.999, 0.731] and text[out[1].worst_start : out[1].worst_end] == "What a stupid clown."
    assert out[2].offending == out[3].offending == [] and [(x.start, x.end) for x in out[4].offending] == [(3, 10)]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    from rivulet.llm.common import crc_mod

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = crc_mod(F.col("doc_id"), 3) == 1
    out = toxicity.score(docs, toxicity.train(docs, labels.where(~held))).join(labels, "doc_id").where(held).select("score", "toxic").collect()
    right = sum((r.score >= 0.7) == (r.toxic == 1) for r in out)
    assert right / len(out) > 0.97


def test_quality(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == len(ROWS) and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in out)
    plain = quality.select(docs, labels.limit(0))
    assert plain.count() == len(ROWS) and plain.columns == docs.columns
    assert quality.select(docs.limit(0), labels).count() == 0


def test_quality_tails_against_plain_loops(spark):
    import math
    import re

    rng = np.random.default_rng(8)
    model = quality.Model(rng.normal(0, 1, quality.DIMENSIONS + quality.SHAPES), np.array([-0.4, 0.9]))
    rows = [(0, None), (1, ""), (2, "Good good text, with SIGNS!! and 12 words."), (3, "same same same same"), (4, "%%% ### $$$"), (5, "ÄÖ ß x" * 300)]

    def plain(text):
        text = text or ""
        tokens = re.findall(r"\w+|[^\w\s]+", text)
        codes = [quality._hashed(t) for t in tokens]
        score = sum(model.weights[c] for c in codes) / (len(codes) + 20)
        letters = max(1, len(text.replace(" ", "")))
        shares = (sum(a == b for a, b in zip(codes, codes[1:], strict=False)) / (len(codes) - 1) if len(codes) > 1 else 0.0, sum(c.isupper() for c in text) / letters, sum(c in "!#$%&*|" for c in text) / letters * 4)
        score += sum(model.weights[quality.DIMENSIONS + 8 * i + min(7, int(x * 8))] for i, x in enumerate(shares))
        return [1 / (1 + math.exp(t - score)) for t in (-0.4, 0.9)]

    out = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        tails = plain(t)
        assert abs(out[i].expected_grade - sum(tails)) < 1e-6 and abs(out[i].tail_probability - tails[0]) < 1e-6


def test_equal_texts_get_equal_results_and_ties_are_settled(spark):
    rows = [(i, "the same plain words here. and more of them.") for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.Model(np.zeros(quality.DIMENSIONS + quality.SHAPES), np.array([-0.5, 0.5]))
    assert len({(r.expected_grade, r.tail_probability) for r in quality.score(frame, model).collect()}) == 1
    assert len({r.score for r in toxicity.score(frame, toxicity.Model(-1.0, {})).collect()}) == 1
    tie = language.fit([("aa aa", "x"), ("aa aa", "w")] * 3)
    assert tie.predict(["aa"])[0][0] == "w"


def test_upper_case_is_counted_over_the_whole_text():
    for line in ("A line of just thirty letters.", "Ä line öf jüst thirty Ǆ ǅ 𝐀 Ω."):
        text = line * 1000
        assert quality.capitals(text) == sum(map(str.isupper, text))
        assert quality.shape(text, np.arange(9))[1] == quality.shape(line, np.arange(9))[1]
    assert quality.capitals("") == 0


def test_quality_on_rated_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = F.col("doc_id") % 3 > 0
    model = quality.train(docs.where(train), labels.where(train))
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    out = quality.score(docs.where(~train), model).join(labels, "doc_id").select("quality", "tail_probability", "expected_grade").collect()
    good, poor = [r for r in out if r.quality == 1], [r for r in out if r.quality == 0]
    assert sum(r.tail_probability >= 0.5 for r in good) / len(good) > 0.98 and sum(r.tail_probability < 0.5 for r in poor) / len(poor) > 0.85


def test_language(spark, docs):
    train = [(i, t, lang) for i in range(60) for t, lang in ((f"{' '.join(WORDS[i % 7 : i % 7 + 9])} the and of with", "en"), (f"der die das und nicht aber schon {WORDS[i % 20][::-1]} über für", "de"))]
    frame = spark.createDataFrame([*train, (900, None, "en"), (901, "12 34", "de"), (902, "text", None)], "doc_id long, text string, lang string")
    models = language.train(frame)
    out = {r.doc_id: r for r in language.predict(docs, models).collect()}
    assert models.languages == ["de", "en"] and all(out[i].lang_pred == "und" and out[i].score == 0 for i in (2, 3, 4, 6))
    assert out[1].lang_pred == "en" and 0 <= out[1].score <= 1 and out[5].lang_pred in ("en", "de")
    assert models.predict(["und das ist nicht schön"])[0][0] == "de" and models.predict(["𐐷𐐷"])[0][0] in ("de", "en")
    none = language.predict(docs, language.train(frame.limit(0))).collect()
    assert len(none) == len(ROWS) and {r.lang_pred for r in none} == {"und"}
    assert language.predict(docs.limit(0), models).count() == 0


def plain_kneser_ney(texts: list[str]):
    """Log probability of a text by an interpolated model of order 4 over dictionaries; the alphabet is given with it."""
    from collections import Counter

    clean = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    padded = lambda t: "   " + clean(t)[1:]
    counts = {4: Counter(p[i - 3 : i + 1] for p in map(padded, texts) for i in range(3, len(p)))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = once / (once + 2 * twice) if once else 0.5

    def p(gram: str, size: int) -> float:
        if not gram:
            return 1 / size
        k, c = len(gram), counts[len(gram)]
        of = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        if not of:
            return p(gram[1:], size)
        total = sum(of.values())
        return max(c.get(gram, 0) - discount[k], 0) / total + discount[k] * len(of) / total * p(gram[1:], size)

    return lambda t, size: sum(np.log(p(q[i - 3 : i + 1], size)) for q in [padded(t)] for i in range(3, len(q))), set("".join(map(padded, texts)))


def test_language_against_dictionaries():
    rows = [("abab abba, baab!", "a"), ("cdcd dccd äöü", "b"), ("Ba ab aba 12 b", "a"), ("ddc cd üä", "b"), ("漢字 かな", "b")]
    models = language.fit(rows)
    models_of = [plain_kneser_ney([t for t, lang in rows if lang == name]) for name in ("a", "b")]
    size = len(models_of[0][1] | models_of[1][1]) + 1
    assert models.size == size
    for text in ("abba cd", "x", "漢 dä zz ab", "b"):
        got, n = models.loglik([language.coded(text)[0]])
        assert n[0] == len(text) + 1 and np.allclose(got[0], [m(text, size) for m, _ in models_of], atol=1e-3)


def test_language_probabilities_sum_to_one():
    models = language.fit([("abab abba baab", "a"), ("cdcd dccd", "b")] * 3)
    base, _ = models.loglik([np.array([0, 97, 98], np.uint64)])
    total = sum(np.exp(models.loglik([np.array([0, 97, 98, code], np.uint64)])[0][0] - base[0]) for code in [0, *map(ord, "abcdz")])
    assert models.size == 6 and np.allclose(total, 1, atol=1e-3)


def test_letters_of_many_scripts_stay_apart():
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 9000)]
    models = language.fit([("".join(letters[i::3]), "xyz"[i]) for i in range(3) for _ in range(2)])
    assert [models.predict(["".join(letters[7998 + i :: 3])])[0][0] for i in range(3)] == list("xyz") and models.size == 9002


def test_language_held_out(spark):
    from rivulet.llm.common import crc_mod

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = crc_mod(F.col("doc_id"), 4) == 2
    out = language.predict(docs, language.train(docs.where(~held))).where(held).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_audio(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    t = np.arange(8000 * 6) / 8000
    notes = 220 * 2 ** (np.repeat(rng.integers(0, 24, 48), 1000) / 12)
    song = 60 * np.sin(2 * np.pi * np.cumsum(notes) / 8000) + 20 * np.sin(4 * np.pi * np.cumsum(notes) / 8000)
    pcm = lambda x: bytes(np.clip(x + 128, 0, 255).astype(np.uint8))
    other = 60 * np.sin(2 * np.pi * np.cumsum(220 * 2 ** (np.repeat(rng.integers(0, 24, 48), 1000) / 12)) / 8000)
    rows = [(100, pcm(song)), (1, pcm(song)), (2, pcm(song[128 * 40 :] + rng.normal(0, 1.5, len(song) - 128 * 40))), (3, pcm(other)), (4, b""), (5, None), (6, b"\x80"), (7, b"\x80\x80")]
    frame = spark.createDataFrame(rows, "id long, audio binary").withColumn("fp", F.lit("clash"))
    members, found = audio.search(frame, lambda i: i % 100 == 0)
    assert {r.id: r.class_id for r in members.collect()} == {100: 1, 1: 1, 2: 2, 3: 3, 6: 6, 7: 6}
    got = found.collect()
    assert [(r.query_class, r.match_class, r.offset) for r in got] == [(1, 2, -40)] and got[0].bit_error < 0.2 and got[0].votes >= 2
    assert [x.count() for x in audio.search(frame.limit(0), lambda i: i % 100 == 0)] == [0, 0]


def test_alignment_tries_every_offset_and_place(spark):
    rng = np.random.default_rng(9)
    noise = lambda n: rng.integers(0, 1 << 32, n, np.uint32)
    a, b, c = noise(12), noise(10), noise(10)
    short, one = noise(3), noise(1)
    prints = {1: np.r_[a, c], 2: np.r_[a, b, a, c], 3: short, 4: np.r_[short[:2], short[2:] ^ np.uint32(5)], 5: one, 6: np.r_[noise(6), one, noise(6)]}
    frame = spark.createDataFrame([(k, v.view(np.int32).tolist()) for k, v in prints.items()], "cls long, fp array<int>")
    out = {(r.query, r.match): (r.offset, r.votes, r.overlap) for r in audio.align(frame.where("cls % 2 = 1"), frame).collect()}
    assert out == {(1, 2): (22, 22, 22), (3, 4): (0, 2, 3), (5, 6): (6, 1, 1)}


def test_votes_and_bit_errors_against_brute_force():
    rng = np.random.default_rng(4)
    for k in range(60):
        q, d = (np.repeat(rng.integers(0, 4, n).astype(np.uint32) * np.uint32(0x91234567), rng.integers(1, 4, n)) for n in rng.integers(1, 200 if k % 9 == 0 else 20, 2))
        offsets = np.arange(1 - len(q), len(d))
        pairs = [(q[max(0, -o) :][:n], d[max(0, o) :][:n]) for o in offsets for n in [min(len(q) - max(0, -o), len(d) - max(0, o))]]
        assert audio.histogram(q, d).tolist() == [int((x == y).sum()) for x, y in pairs]
        assert audio.bit_errors(q, d, offsets, np.array([len(x) for x, _ in pairs])).tolist() == [int(np.bitwise_count(x ^ y).sum()) for x, y in pairs]


def test_chat_format(spark):
    call = lambda i, name, args: f'<tool_call>{{"id": "{i}", "name": "{name}", "arguments": {args}}}</tool_call>'
    rows = [
        (1, 0, "user", 'Say "hi"\n'),
        (1, 1, "assistant", "Sure." + call("a", "add", '{"y": 2, "x": 1}') + call("b", "add", '{"x": "$result:a"}')),
        (1, 2, "tool", '{"tool_call_id": "b", "content": "late"}'),
        (1, 3, "tool", '{"tool_call_id": "a", "content": "3"}'),
        (1, 4, "tool", '{"tool_call_id": "zz", "content": "?"}'),
        (1, 5, "assistant", call("a", "add", '{"x": 1, "y": 2}') + call("c", "nope", "{}") + call("d", "add", "[1]") + call("e", "add", '{"x": 1, "y": 2, "z": 0}')),
        (2, 0, None, None),
        (2, 1, "assistant", call("p", "add", '{"x": "$result:q", "y": 1}') + call("q", "add", '{"x": "$result:p", "y": 1}')),
        (3, 0, "user", "same"),
        (3, 0, "user", "same"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("call_id", F.lit("clash"))
    out = chat_format.link(chat_format.events(frame), {"add": {"x": "integer", "y": "integer?"}}).collect()
    status = {(r.conv, r.turn, r.kind, r.call_id): r.status for r in out}
    assert status[1, 1, "call", "a"] == "ok" and status[1, 1, "call", "b"] == "invalid" and status[1, 4, "result", "zz"] == "orphan"
    assert status[1, 5, "call", "a"] == "duplicate" and [status[1, 5, "call", c] for c in "cde"] == ["invalid"] * 3
    assert status[2, 1, "call", "p"] == status[2, 1, "call", "q"] == "cycle"
    errors = {r.call_id: r.errors for r in out if r.kind == "call" and r.turn == 5}
    assert errors["c"] == ["unknown tool"] and errors["d"] == ["not an object"] and errors["e"] == ["unknown z"]
    place = {(r.kind, r.call_id): (r.order_turn, r.order_depth) for r in out if r.conv == 1 and r.turn < 5 and r.call_id}
    assert place["call", "a"] < place["result", "a"] < place["call", "b"] < place["result", "b"]
    json = {(r.kind, r.call_id, r.turn): r.json for r in out if r.conv == 1}
    assert json["call", "a", 1] == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","type":"call"}'
    assert json["message", None, 0] == '{"content":"Say \\"hi\\"\\n","role":"user","type":"message"}'
    assert sum(r.conv == 3 for r in out) == 2 and next(r.json for r in out if r.conv == 2 and r.turn == 0) == '{"content":null,"role":null,"type":"message"}'
    assert chat_format.link(chat_format.events(frame.limit(0)), {}).count() == 0


def test_long_chains_are_no_cycles(spark):
    evs = [(1, 0, i, "call", "assistant", f"k{i}", "f", "{}" if i == 0 else f'{{"x": "$result:k{i - 1}"}}') for i in range(19)]
    evs += [(2, 1, 0, "call", "assistant", "p", "f", '{"x": "$result:q"}'), (2, 5, 0, "call", "assistant", "q", "f", '{"x": "$result:p"}'), (2, 6, 0, "call", "assistant", "r", "f", '{"x": "$result:zz"}')]
    evs += [(None, 1, 0, "call", "assistant", "s", "f", '{"x": "$result:s"}')]
    frame = spark.createDataFrame(evs, "conv long, turn long, seq int, kind string, role string, call_id string, name string, payload string")
    out = {r.call_id: (r.status, r.order_turn, r.order_depth) for r in chat_format.link(frame, {"f": {"x": "string?"}}).collect()}
    assert [out[f"k{i}"] for i in range(19)] == [("unanswered", 0, 2 * i) for i in range(19)]
    assert out["p"][0] == out["q"][0] == out["s"][0] == "cycle" and out["r"] == ("unanswered", 6, 0)


def shuffled(spark, run) -> int:
    """Bytes that shuffles wrote while ``run`` ran."""
    sc, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executorList(False)))
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def unrelated(spark, n, words=200):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" + "." * (j % 10 == 9) for j, x in enumerate(rng.integers(0, 1 << 30, words).tolist()))) for i in range(n)]
    return spark.createDataFrame(rows + [(n + i, rows[i][1]) for i in range(3)], "doc_id long, text string").repartition(4)


def test_cells_move_less_than_keys_and_sets(spark):
    pts = written(ngram_join.points(unrelated(spark, 1000), "doc_id", "text", 5, 80))
    keys = pts.selectExpr("sum(size(keys))").first()[0]
    assert shuffled(spark, lambda: ngram_join.cells_of(pts)) < 11 * keys
    assert ngram_join.cells_of(pts).count() == 0  # copies alone make no cell


def test_texts_without_cuts_are_not_moved(spark):
    docs, conf = written(unrelated(spark, 300)), "spark.sql.autoBroadcastJoinThreshold"
    cuts = written(substring_dedup.repeated_spans(docs))
    spark.conf.set(conf, "-1")
    try:
        found = shuffled(spark, lambda: substring_dedup.repeated_spans(docs).count())
        moved = shuffled(spark, lambda: substring_dedup.dedup(docs).write.format("noop").mode("overwrite").save())
        assert cuts.count() == 3 and moved - found < 0.3 * docs.selectExpr("sum(length(text))").first()[0]
        assert sorted((r.doc_id, r.removed > 0) for r in substring_dedup.dedup(docs).collect()) == [(i, i >= 300) for i in range(303)]
    finally:
        spark.conf.unset(conf)
