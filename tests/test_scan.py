"""Ordered computations over giant groups against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators import scan
from rivulet.sources import readers


def plain_repair(values, highest=15617, next_highest=16500, reach=9):
    out, prev = [], None
    for i, v in enumerate(values):
        v = v or 0
        if v <= 0 or v > highest:
            nxt = next((x for x in values[i + 1 : i + 1 + reach] if x is not None and 0 < x <= next_highest), None)
            if prev is not None:
                v = prev if nxt == prev + 1 else prev + 1
            elif nxt is not None:
                v = max(1, nxt - 1)
        out.append(v)
        prev = v
    return out


@pytest.mark.parametrize("seed", range(4))
def test_repair_over_ranges(spark, seed):
    rnd = random.Random(seed)
    pick = lambda i: rnd.choice([None, 0, -3, 99999, 16000, 16400, i + 1, i + 2]) if rnd.random() < (0.5, 0.9, 0.97, 1.0)[seed] else i + 1
    groups = {"a": [pick(i) for i in range(700)], None: [pick(i) for i in range(13)], "c": [pick(i) for i in range(5)], "d": [rnd.choice([0, 16000, 15990 + i % 30]) for i in range(300)]}
    rows = [(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, n int")
    want = {(g, i): v for g, vs in groups.items() for i, v in enumerate(plain_repair(vs))}
    for size in (40, 10_000):
        got = scan.repair_numbers(df, ["g"], ["i"], "n", rows=size).collect()
        assert len(got) == len(rows) and {(r.g, r.i): r.repaired for r in got} == want


def plain_match(wanted, places):
    out, last = {}, None
    for o, k in wanted:
        found = sorted(places.get(k, []))
        if found:
            last = next((p for p in found if last is None or p > last), found[0])
            out[o] = last
    return out


@pytest.mark.parametrize("seed", range(3))
def test_forward_matching_over_ranges(spark, seed):
    rnd = random.Random(seed)
    keys = [f"k{i}" for i in range((4, 60, 400)[seed])]
    wanted, heads, want = [], [], {}
    for g, n in (("a", 500), ("b", 3), ("c", 60)):
        w = [(o, rnd.choice(keys)) for o in range(n)]
        at = {k: rnd.sample(range(10_000), rnd.randint(2, 6)) for k in keys if rnd.random() < 0.8}
        wanted += [(g, *x) for x in w]
        heads += [(g, k, p) for k, ps in at.items() for p in ps]
        want |= {(g, o): p for o, p in plain_match(w, at).items()}
    rnd.shuffle(wanted)
    wanted, heads = spark.createDataFrame(wanted, "g string, o int, k string"), spark.createDataFrame(heads, "g string, k string, p int")
    for size in (37, 10_000):
        assert {(r.g, r.o): r.p for r in scan.monotone_match(wanted, heads, "g", "o", "k", "p", rows=size).collect()} == want


def test_running_values_and_numbers(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None, "c"]) if i % 3 else "a", i, rnd.choice([None, i])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    p = scan.parts(df, ["g"], ["i"], 50)
    got = {r.i: (r.s, r.l) for r in scan.running(p, ["g"], {"s": F.coalesce("v", F.lit(0))}, {"l": F.col("v")}).collect()}
    sums, last = {}, {}
    for g, i, v in rows:
        assert got[i] == (sums.get(g, 0), last.get(g))
        sums[g] = sums.get(g, 0) + (v or 0)
        last[g] = last.get(g) if v is None else v
    assert sorted((r.i, r.row) for r in scan.numbered(df, ["i"], rows=70).collect()) == [(i, i + 1) for i in range(900)]
    sizes = sorted(r["count"] for r in p.groupBy("__part").count().collect())
    assert len(sizes) >= 12 and sizes[-1] < 150  # one group of 600 rows is no single task


def test_ranges_of_nothing(spark):
    none = spark.createDataFrame([], "g string, i int, n int")
    assert scan.repair_numbers(none, ["g"], ["i"], "n").count() == 0
    assert scan.numbered(none, ["i"]).count() == 0
    assert scan.monotone_match(none.toDF("g", "o", "k"), none.toDF("g", "k", "p"), "g", "o", "k", "p").count() == 0
    assert scan.assemble(none.selectExpr("g", "i", "g as t"), "g", "i", "t", F.lit(True)).count() == 0


@pytest.mark.parametrize("rows", [30, 10_000])
def test_assembly_over_ranges(spark, rows):
    rnd = random.Random(9)
    files = {f: ["# " + str(i) if rnd.random() < 0.04 else "STOP" if rnd.random() < 0.02 else f"line {i}" for i in range(n)] for f, n in (("x", 800), ("y", 40), ("z", 1))}
    df = spark.createDataFrame([(f, i, t) for f, ts in files.items() for i, t in enumerate(ts)], "f string, i int, t string")
    want = {}
    for f, ts in files.items():
        entry, live = 0, False
        for t in ts:
            entry, live = (entry + 1, True) if t.startswith("#") else (entry, live and t != "STOP")
            if live:
                want.setdefault((f, entry), []).append(t)
    got = scan.assemble(df, "f", "i", "t", F.col("t").startswith("#"), F.col("t") == "STOP", rows=rows).collect()
    assert {(r.f, r.entry): (r.n_lines, r.text) for r in got} == {k: (len(v), "\n".join(v)) for k, v in want.items()}


def test_numbered_lines_of_split_files(spark, tmp_path):
    rnd = random.Random(2)
    texts = {f"f{j}.txt": ["é" * rnd.randint(0, 80) + str(i) for i in range(n)] for j, n in enumerate((4000, 0, 1, 700))}
    for name, ls in texts.items():
        (tmp_path / name).write_bytes(("\r\n" if name == "f3.txt" else "\n").join(ls).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 10
        found = {}
        for r in got.collect():
            found.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.line
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k: [v[i] for i in sorted(v)] for k, v in found.items()} == {k: v for k, v in texts.items() if v}
    assert all(sorted(v) == list(range(len(v))) for v in found.values())
