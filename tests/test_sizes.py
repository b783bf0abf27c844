"""Work that must grow with the rows, not with their pairs: each case has few rows whose pairs are many, and limits on what the plan moves."""

import pytest
from pyspark.sql import functions as F

from rivulet.operators import analysis, chain, dictionary, evidence_rules, ladder, layers, probe, resolver, scribal
from rivulet.plans import library


def _moved(spark, df) -> int:
    """Most rows that any node of the executed plan gave out."""
    plan = df._jdf.queryExecution()
    plan.executedPlan().executeCollect()
    most, todo = 0, [plan.executedPlan()]
    seq = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        rows = p.metrics().get("numOutputRows")
        if rows.isDefined():
            most = max(most, rows.get().value())
        todo += list(seq(p.children()))
    return most


def test_long_keys_in_reports(spark):
    customers = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 400, 401, 402, 403, 123456, 1234568)], "c_custkey long")
    got = library.unresolved_names(type("T", (), {"customer": customers})())
    assert {r.number for r in got.collect()} == {0, 1, 2, 3, 400, 402, 123456, 1234568}


def test_ladder_counts_hot_prefixes(spark):
    """300 names ask for a prefix of 300 entries, of which all met the authority."""
    e = spark.range(300).select(F.concat(F.lit("e"), "id").alias("entry_key"), F.lit("ا بن ب بن ج").alias("name_ar"))
    q = spark.range(300).select(F.col("id").alias("query_id"), F.lit("ا بن د").alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(1).alias("layer"))
    met = e.select("entry_key", F.when(F.col("entry_key") == "e7", "A").otherwise("B").alias("authority"))
    expected = spark.createDataFrame([(1, "A")], "layer int, authority string")
    none = lambda c: F.array().cast("array<string>")
    got = ladder.match(q, ladder.prefix_index(e), met, expected, none)
    assert {(r.entry_key, r.candidates) for r in got.collect()} == {("e7", 300)}
    assert _moved(spark, got) < 5000


def test_queries_that_ask_the_same_are_scored_once(spark):
    """200 queries of one name, of two layers, and 200 people of that name."""
    text = lambda x: F.lit(x).alias
    none = F.array().cast("array<string>")
    e = spark.range(200).select(F.concat(F.lit("e"), "id").alias("entry_key"), F.col("id").alias("src_ord"), text("علي بن محمد")("name_ar"), *[text("")(c) for c in ("kunyah", "laqab", "nisba")], text("محمد")("father"), *[none.alias(c) for c in ("aliases", "books", "narrates_from_narrators", "narrated_from_by", "narrates_from_imams")], text("hasan")("status"), (F.col("id") % 90).cast("int").alias("hadith_count"), (F.col("id") % 12).cast("double").alias("tabaqah"), text("unique")("identity_confidence"))
    q = spark.range(200).select(F.col("id").alias("query_id"), text("علي بن محمد")("name"), none.alias("teachers"), none.alias("students"), F.lit(None).cast("string").alias("book"), F.when(F.col("id") % 2 == 0, 3).alias("low"), F.when(F.col("id") % 2 == 0, 5).alias("high"))
    got = resolver.resolve(q, resolver.build_index(e), e, 2)
    rows = got.collect()
    assert len(rows) == 400 and {r.total_candidates for r in rows} == {200}
    # 89 and 179 have the most reports; 89 and 88 are of layers 5 and 4.
    assert {(r.query_id % 2, r["rank"], r.entry_key, r.score) for r in rows} == {(1, 1, "e89", 4.891), (1, 2, "e179", 4.891), (0, 1, "e89", 6.391), (0, 2, "e88", 6.39)}
    assert _moved(spark, got) < 5000


def test_boosted_overlap_compares_equal_names_once(spark):
    """A word that all share; 300 queries and 300 entries of two names each."""
    names = lambda *x: F.array(*map(F.lit, x))
    q = spark.range(300).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, names("علي بن محمد")).otherwise(names("بن", "علي")).alias("names"))
    e = spark.range(300).select(F.concat(F.lit("e"), "id").alias("entry_key"), F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, names("علي بن محمد", "زيد")).otherwise(names("بن سهل")).alias("names"))
    got = analysis.boosted_overlap(q, e, 3)
    want = {(0, f"e{i}", 8, n) for n, i in enumerate((0, 3, 6), 1)} | {(1, f"e{i}", 12, n) for n, i in enumerate((0, 3, 6), 1)}
    assert {(r.query_id % 2, r.entry_key, r.score, r["rank"]) for r in got.collect()} == want and got.count() == 900
    assert _moved(spark, got) < 5000


def test_by_names_pair_without_a_shuffle_of_pairs(spark):
    """All entries have the asked by-name; some have it as an alias too, or ask twice."""
    e = spark.range(200).select(F.concat(F.lit("e"), "id").alias("entry_key"), F.lit("ابو علي").alias("kunyah"), F.when(F.col("id") % 2 == 0, F.array(F.lit("ابو علي القمي"))).alias("aliases"))
    q = spark.range(200).select("id", F.explode(F.when(F.col("id") == 7, F.array(F.lit("ابو علي"), F.lit("ابو"))).otherwise(F.array(F.lit("ابو علي")))).alias("kunya")).withColumnRenamed("id", "query_id")
    got = evidence_rules.kunya_candidates(q, e)
    assert got.count() == got.distinct().count() == 40000
    assert "HashAggregate(keys=[query_id" not in got._jdf.queryExecution().executedPlan().toString().split("Join")[0]


def test_nearest_number_of_equal_names(spark):
    """500 rows and 500 entries of one name: no pairs, and the nearest by number, then by order."""
    import random

    rnd = random.Random(3)
    main = [(str(k) if k % 9 else f"x{k}", k, None if k % 4 == 0 else rnd.randint(0, 3000), "علي بن محمد") for k in range(500)]
    summary = [(rnd.randint(0, 3000), "علي بن محمد" if i % 50 else "زيد") for i in range(500)] + [(None, "علي بن محمد")]
    got = analysis.map_summary(spark.createDataFrame(summary, "number int, name string"), spark.createDataFrame(main, "key string, ord int, number int, name string"))
    at = [((n if n is not None else int(key) + 1 if key.isdigit() else None), o, key) for key, o, n, _ in main]
    want = {n: min((abs(a - n) if a is not None else 999999, o, key) for a, o, key in at)[2] for n, name in summary if n is not None and name != "زيد"}
    assert {r.number: r.key for r in got.collect()} == want
    assert _moved(spark, got) < 20000


@pytest.mark.parametrize("keep, most", [("last", 1), ("term", 2)])
def test_tasks_keep_few_matches_of_a_text(spark, keep, most):
    """A text with 20000 matches of two terms gives one row, or one a term."""
    texts = spark.createDataFrame([(1, "ab" * 10_000), (2, "none")], "id int, text string")
    terms = spark.createDataFrame([("ab", "a"), ("ba", "b")], "term string, label string")
    assert dictionary.mentions(texts, "id", "text", terms, longest=False, keep=keep).count() == most
    assert [tuple(r) for r in dictionary.last_mention(texts, "id", "text", terms, edges=False).collect()] == [(1, 19998, 20000, "ab")]
    assert [tuple(r) for r in dictionary.labels(texts, "id", "text", terms, edges=False).collect()] == [(1, ["a", "b"])]


def test_near_names_are_not_sent_to_the_driver(spark):
    names = spark.createDataFrame([("abcd",), ("wxyz",)], "name string")
    got = scribal.near(names, spark.createDataFrame([("abce", 2), ("abxy", 1), ("badc", 1)], "name string, n int"))
    assert sorted(tuple(r) for r in got.collect()) == [("abcd", "abce", 1, 2), ("abcd", "abxy", 2, 1)]
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_anonymous_links_need_no_exchange(spark):
    chains = spark.createDataFrame([(1, ["زرارة", "عن رجل", "عمن ذكره", "ابان"]), (2, []), (3, None), (4, ["زرارة"])], "chain_id int, segments array<string>")
    got = chain.irsal(chains)
    rows = {r.chain_id: (r.has_irsal, [(f["index"], f["type"]) for f in r.findings]) for r in got.collect()}
    assert rows[1][0] and [i for i, _ in rows[1][1]] == [1, 2] and rows[2] == rows[3] == rows[4] == (False, [])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_fillers_store_only_edges_that_can_fill(spark):
    """1000 edges, of which two lead from behind a gap to before it."""
    far = spark.range(998).select((F.col("id") + 100).alias("teacher"), (F.col("id") + 5000).alias("student"))
    edges = far.union(spark.createDataFrame([(1, 2), (2, 3)], "teacher long, student long"))
    stored = []
    keep = probe.written

    def spy(df, *a):
        out = keep(df, *a)
        stored.append(out.count())
        return out

    probe.written = spy
    try:
        got = probe.fillers(spark.createDataFrame([(9, 3, 1, None)], "gap_id int, before long, after long, layer int"), edges, spark.createDataFrame([], "person long, layer int"))
        assert [tuple(r) for r in got.collect()] == [(9, 2)]
    finally:
        probe.written = keep
    assert max(stored) <= 2


def test_relaxation_reads_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "teacher string, student string").mapInArrow(counted, "teacher string, student string")
    got = layers.relax(edges, spark.createDataFrame([("a", 3), ("d", 6)], "key string, layer int"), rounds=4)
    assert {r.key: r.value for r in got.collect()} == {"a": 3.0, "b": 4.0, "c": 5.0, "d": 6.0} and seen.value == 3
