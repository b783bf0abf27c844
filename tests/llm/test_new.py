"""Centroid clustering, spelling variants and source mixing against plain versions, with their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import mixing, spelling, yinyang

# --- Centroid clustering


def plain_clusters(rows, k, rounds, dims, scale=64, seed=1):
    kept = [(i, [int(np.floor(np.float64(scale) * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=repr), centres


@pytest.mark.parametrize(("seed", "dims", "k", "groups"), [(0, 3, 7, 3), (1, 8, 16, 4), (2, 2, 5, 1), (3, 2, 40, 40)])
def test_clusters_against_plain_loops(spark, seed, dims, k, groups):
    rng = np.random.default_rng(seed)
    hubs = rng.normal(0, 1, (6, dims))
    made = np.round(hubs[rng.integers(0, 6, 300)] + rng.normal(0, 0.3, (300, dims)), 1)  # rounded, so that ties and equal vectors occur
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(5, [float(x) for x in made[5]]), (None, [0.5] * dims), (900, None), (901, [1.0] * (dims + 1)), (902, [float("nan")] * dims), (903, [float("inf")] * dims), (904, [None] * dims), (905, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("id", "v", "cluster", "prev", "distance", "upper")})
    want, centres = plain_clusters(rows, k, 3, dims)
    got, found = yinyang.cluster(frame.repartition(7), k=k, dims=dims, groups=groups)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == want and found.tolist() == centres


def test_few_and_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert yinyang.cluster(none)[0].count() == 0
    two = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got, centres = yinyang.cluster(two, dims=2)
    assert len(centres) == 2 and sorted(r.cluster for r in got.collect()) == [0, 1] and {r.distance for r in got.collect()} == {0}
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    assert {r.distance for r in yinyang.cluster(huge, dims=2, k=1)[0].collect()} == {1 << 54}  # components end at 2^27


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(4)
    hubs = rng.integers(-400, 400, (24, 16))
    v = (hubs[rng.integers(0, 24, 4000)] + rng.integers(-9, 10, (4000, 16))).astype(np.int64)
    centres = hubs + rng.integers(-6, 7, hubs.shape)
    of = yinyang.grouped(centres, 5)
    assert set(of.tolist()) == set(range(of.max() + 1)) and of.max() >= 2
    a, upper, lower = yinyang.first_scan(v, centres, of)
    for _ in range(4):
        moved = centres + rng.integers(-2, 3, centres.shape)
        drift = yinyang.above(yinyang.own_squares(moved, centres).astype(float))
        a, upper, lower, scanned = yinyang.next_scan(v, a, upper, lower, moved, drift, of)
        d = ((v[:, None, :] - moved) ** 2).sum(axis=2)
        assert (a == d.argmin(axis=1)).all() and scanned < d.size / 4
        assert (upper**2 >= d[np.arange(len(v)), a]).all()
        d = d.astype(float)
        d[np.arange(len(v)), a] = np.inf
        assert all((np.maximum(lower[:, g], 0) ** 2 <= d[:, of == g].min(axis=1)).all() for g in range(of.max() + 1))
        centres = moved


# --- Spelling variants


def plain_words(rows, shortest=7, fewest=2):
    out = Counter()
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                p = h % len(w)
                w = w[:p] + w[p + 1 :]
            if len(w) >= shortest:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= fewest}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(words):
    form, count = {}, {}
    for w, n in words.items():
        own = [(-words[x], x) for x in words if near(w, x)]
        count[w] = len(own)
        form[w] = min(own)[1] if own and -min(own)[0] >= 10 * n else None
    root = {}
    for w in words:
        x = w
        while form[x] is not None:
            x = form[x]
        root[w] = x
    return {w: (n, count[w], form[w], words[form[w]] if form[w] else None, root[w]) for w, n in words.items()}


@pytest.mark.parametrize(("most", "letters"), [(5000, "abé"), (6, "ab"), (3, "abcd"), (1, "ab")])
def test_variants_against_all_pairs(spark, most, letters):
    rnd = random.Random(most)
    make = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(6, 11)))
    words = [make() for _ in range(140)]
    words += ["a" * n for n in (7, 8, 9, 10)] + ["abababab", "bababab", "babababa"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(60)]
    rows += [(100 + i, " ".join([words[0]] * 40 + [words[1]] * 15)) for i in range(4)] + [(1, rows[1][1]), (1, rows[1][1]), (None, "aaaaaaa aaaaaaa"), (2, None), (3, ""), (4, "ABABABAB-ABABABABx×÷ 12"), (5, "Ünïcödéß " * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "id", "w", "key", "near")})
    want = plain_variants(plain_words(rows))
    got = spelling.variants(frame.repartition(5), most=most).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want and len(got) == len(want)


def test_chains_of_forms_lead_to_a_root(spark):
    rows = [(i, "governmentt") for i in range(2)] + [(10 + i, "government") for i in range(30)] + [(100 + i, "governmant") for i in range(400)]
    frame = spark.createDataFrame([(i, f"{t} {t}") for i, t in rows], "doc_id long, text string")
    words = plain_words([(i, f"{t} {t}") for i, t in rows])
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(frame).collect()}
    assert got == plain_variants(words) and got["governmentt"][4] == "governmant"


def test_very_long_words_and_no_words(spark):
    long = "".join(random.Random(7).choice("abc") for _ in range(20_000))
    rows = [(i, x) for i in range(3) for x in (long, long[:9000] + long[9001:])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n_near for r in spelling.variants(frame).collect()}
    words = plain_words(rows)
    assert set(got) == set(words) and got[long[:9000] + long[9001:]] >= 1
    assert spelling.variants(frame.limit(0)).count() == 0 and spelling.variants(spark.createDataFrame([(1, "one two")], "doc_id long, text string")).count() == 0


def test_partitions_are_bounded_and_hold_all_pairs(spark):
    words = ["prefixprefix" + f"{i:012b}".translate(str.maketrans("01", "xy")) for i in range(600)]  # one half for all
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    parts = spelling.partitions(frame, most=50)
    assert len(parts) > 2
    for part in parts:
        assert max(r["count"] for r in part.groupBy("key").count().collect()) <= 50
    found = Counter()
    for part in parts:
        found.update((r.word, r.near) for r in spelling.near_words(part, 3).collect())
    assert found == Counter((a, b) for a in words for b in words if near(a, b))


# --- Source mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, sum(sizes.values()), set(order)
    while free:
        each = left / sum(weight[s] for s in free)
        above = {s for s in free if each * weight[s] > most * sizes[s]}
        if not above:
            break
        out |= {s: float(most * sizes[s]) for s in above}
        left, free = left - sum(most * sizes[s] for s in above), free - above
    return out | {s: left / sum(weight[s] for s in free) * weight[s] for s in free}


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_resharing(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice([0, 1, rnd.randint(1, 100), rnd.randint(1, 100_000)]) for i in range(rnd.randint(1, 23))} | ({None: 7} if seed % 2 else {})
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mix(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, text(rnd.choice([1, 3, 40, rnd.randint(1, 900)])), f"src{min(rnd.randint(0, 9), rnd.randint(0, 9))}") for i in range(900)]
    rows += [(2000, text(30_000), "src9"), (2001, "", "src1"), (2002, None, "src2"), (2003, " \t\n\x0b ", "src3"), (2004, "a b c", "src4"), (None, text(5), "src5"), (None, None, None), (7, text(9), None)]
    rows += [(3000, text(11), "src6")] * 120 + [(1, rows[1][1], rows[1][2])] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("size", "id", "m", "k", "s", "taken", "class", "bin")})
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = as_rows(mixing.mixed(frame))
    assert got == as_rows(mixing.mixed(frame.repartition(9, "text"))) and len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((i, n, s) for i, n, s, *_ in got), key=repr) == sorted(((i, size(t), s) for i, t, s in rows), key=repr)
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    want = plain_targets(dict(total))
    for s in total:
        own = [r for r in got if r[2] == s]
        taken = sum(r[5] for r in own)
        assert all(r[3] == total[s] and abs(r[4] - want[s]) < 1e-6 * want[s] for r in own)
        assert abs(taken - want[s]) <= max(40, want[s] / 500), (s, taken, want[s])
    assert all(0 <= r[5] <= 3 * r[1] for r in got)


def test_large_sources_take_whole_documents_of_all_sizes(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 30)), "a" if i % 10 else "b") for i in range(30_000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 'a'").collect()
    whole = sum(r.taken % r.size == 0 for r in got)
    assert whole == len(got) and abs(sum(r.taken for r in got) - got[0].target) <= 60
    rate = got[0].target / got[0].source_size
    for low in range(1, 30, 5):  # copies are spread over all sizes
        own = [r for r in got if low <= r.size < low + 5]
        assert abs(sum(r.taken for r in own) / sum(r.size for r in own) - rate) < 0.05


def test_nothing_to_mix(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(none).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mixed(empty).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
