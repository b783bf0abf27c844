import pytest
from pyspark.sql import functions as F

from rivulet.operators import aggregates as ag
from rivulet.operators import chain, evidence_rules, extract, extractor, graph, joins, layers, resolver, scan, scoring, similarity, windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_medians(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 7, 1), ("a", 2, 1), ("a", 9, 4), ("b", None, 1), ("b", 3, 2)], "k string, v int, w int")
    assert rows(df.groupBy("k").agg(ag.upper_median("v").alias("m"))) == [("a", 7), ("b", 3)] == rows(ag.grouped_upper_median(df, ["k"], "v"))
    assert rows(ag.weighted_median(df.where("v is not null"), ["k"], "v", "w")) == [("a", 9), ("b", 3)]


def test_band_join_is_a_plain_theta_join(spark):
    a, b = spark.range(0, 60).selectExpr("id a", "cast(id * 7 % 41 - 20 as int) x"), spark.range(0, 60).selectExpr("id b", "cast(id * 11 % 37 - 15 as int) y")
    for w in (0, 1, 2, 7):
        assert rows(joins.band_join(a, b, "x", "y", w).select("a", "b")) == rows(a.crossJoin(b).where(F.abs(F.col("x") - F.col("y")) <= w).select("a", "b"))


def test_containment_and_cascade(spark):
    q = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, []), (4, ["x", "x"])], "q int, t array<string>")
    f = spark.createDataFrame([("f", ["x", "y", "w"]), ("g", ["x"]), ("h", ["y", "y"])], "f string, u array<string>")
    assert rows(joins.containment_join(q, f, "q", "t", "f", "u")) == [(1, "f"), (4, "f"), (4, "g")]
    left = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, "c", "r")], "id int, l0 string, l1 string")
    right = spark.createDataFrame([("a", "z", 10), ("b", "q", 20), ("b", "s", 30)], "r0 string, r1 string, v int")
    assert rows(joins.unique_key_cascade(left, right, ["l0", "l1"], ["r0", "r1"], "v").select("id", "v", "via")) == [(1, 10, 1), (2, 20, 2), (3, None, None)]
    assert rows(joins.unique_key_cascade(left, right, ["l0", "l1"], ["r0", "r1"], "v", True).select("id", "v"))[1] == (2, None)


def test_islands_repair_and_assembly(spark):
    df = spark.createDataFrame([("f", i, n) for i, n in enumerate([5, 0, 7, 0, 0, 10, 99999, 0])], "f string, i int, n int")
    assert [r.repaired for r in scan.repair_numbers(df, ["f"], ["i"], "n").orderBy("i").collect()] == [5, 6, 7, 8, 9, 10, 11, 12]
    tied = spark.createDataFrame([("f", i, n) for i, n in enumerate([0, 4, 0, 5])], "f string, i int, n int")
    assert [r.repaired for r in scan.repair_numbers(tied, ["f"], ["i"], "n").orderBy("i").collect()] == [3, 4, 4, 5]
    text = spark.createDataFrame([("f", i, x) for i, x in enumerate(["junk", "1 - A", "more", "END", "lost", "2 - B"])], "f string, i int, x string")
    got = windows.assemble(text, "f", "i", "x", F.col("x").rlike("^[0-9]+ - "), F.col("x") == "END")
    assert rows(got) == [("f", 1, 2, "1 - A\nmore"), ("f", 2, 1, "2 - B")]
    assert rows(windows.gap_ranges(spark.createDataFrame([(1,), (2,), (5,), (9,)], "n int"), [], "n")) == [(3, 4), (6, 8)]


def test_components_and_pointers(spark):
    chain_edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (None, 3)]
    got = graph.components(spark.createDataFrame(chain_edges, "a int, b int"))
    by_root = {}
    for n, r in got.collect():
        by_root.setdefault(r, set()).add(n)
    assert sorted(map(sorted, by_root.values())) == [list(range(41)), [100, 101, 102]]
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("s", "s")], "key string, to string")
    assert rows(layers.chase(p)) == [("a", "c", False), ("b", "c", False), ("c", "c", False), ("s", "s", False), ("x", None, True), ("y", None, True)]


def test_propagation(spark):
    edges = spark.createDataFrame([("t", "m"), ("m", "s"), ("t2", "c"), ("c", "s2")], "teacher string, student string")
    state = spark.createDataFrame([("t", 4), ("m", None), ("s", None), ("t2", 1), ("c", None), ("s2", 12)], "key string, layer int")
    got = {r.key: (r.layer, r.conflict) for r in layers.propagate(edges, state).collect()}
    assert got["m"] == (5, False) and got["s"] == (6, False) and got["c"] == (None, True)
    relaxed = {r.key: r.value for r in layers.relax(edges, state.where("key in ('t', 'm', 's')"), rounds=5).collect()}
    assert relaxed["t"] == 4.0 and relaxed["m"] == 5.0


LIVES = [("a", 31, 96), ("b", 40, 101), ("c", 120, 190), ("d", None, 96), ("e", 82, None), ("f", 81, None), ("g", 76, None), ("h", None, None)]


@pytest.mark.parametrize(("teacher", "student", "want"), [("a", "b", ("certain", 46)), ("a", "c", ("impossible", -34)), ("d", "e", ("impossible", 4)), ("d", "f", ("possible", 5)), ("d", "g", ("certain", 10)), ("h", "a", ("unknown", None))])
def test_transmission(spark, teacher, student, want):
    life = {k: (b, d) for k, b, d in LIVES}
    df = spark.createDataFrame([(*life[teacher], *life[student])], "tb int, td int, sb int, sd int")
    none = F.lit(None).cast("array<int>")
    made = lambda p: chain.lifetime(F.col(f"{p}b"), F.col(f"{p}d"), none, none)
    df = df.select(made("t").alias("t"), made("s").alias("s")).select(chain.transmission(F.col("t"), F.col("s")).alias("x"))
    assert tuple(df.select("x.*").first()) == want


@pytest.mark.parametrize(
    ("segments", "want"),
    [
        (["بكر بن صالح", "رجل من قم", "عن سليم"], ("MURSAL", [1])),
        (["سعد", "عن بعض شيوخه", "عن امرأة", "عن داود"], ("MUDAL", [1, 2])),
        (["ثعلبة", "عن حبيب", "عن صفوان"], (None, [])),
        (["ثعلبة", "عن غير واحد من أهلها"], ("MUBHAM", [1])),
        (["عمن ذكره", "سليم"], ("MURSAL", [0])),
        ([], (None, [])),
    ],
)
def test_irsal(spark, segments, want):
    r = chain.irsal(spark.createDataFrame([(1, segments)], "chain_id int, segments array<string>")).first()
    assert (r.irsal_type, [f["index"] for f in r.findings]) == want and r.has_irsal == bool(want[1])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("بكر بن صالح، عن ثعلبة بن ميمون", ["بكر بن صالح", "ثعلبة بن ميمون"]),
        ("سليم عن أبيه عن جده", ["سليم", "ابيه", "جده"]),
        ("", []),
        ("صفوان", ["صفوان"]),
        ("7 - حدثنا سعد بن طريف قال حدثني سليم (ع) قال: ان الصوم جنة", ["سعد بن طريف", "سليم"]),
        ("وعنه عن بكربن صالح ومحمد بن سالم جميعا عن صفوان", ["بكر بن صالح", "محمد بن سالم", "صفوان"]),
        ("وبهذا الإسناد عن داود، عمن رواه، عن لزرارة رفعه الى سليم", ["داود", "عمن رواه", "زرارة"]),
        ("حبيب عمن ذكره عن داود وهو ابو اليقظان", ["حبيب", "عمن رواه", "داود"]),
        ("ابيه و حبيب عن سليم، عن حبيب", ["ابيه", "حبيب", "سليم"]),
        ("زكريا ابن آدم عن للرضا عليه السلام في رجل مات", ["زكريا بن ادم", "الرضا"]),
        ("سعد عن الحلال والحرام، عن [داود] يقول نعم", ["سعد", "داود"]),
        (None, []),
    ],
)
def test_chain_parsing(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert df.select(chain.parse(F.col("text"))).first()[0] == want


def test_tokens_of_a_chain(spark):
    df = spark.createDataFrame([(1, "أحمد بن محمد، عن أبيه، عن أبي عبد الله (ع)"), (2, None)], "id int, text string")
    assert [tuple(r) for r in chain.names_of_tokens(chain.tokenize(df, "id", "text"), "id").collect()] == [(1, ["احمد بن محمد", "ابيه", "ابي عبد الله"])]


def test_grades(spark):
    cases = {
        1: ([("احمد", "thiqah", 5, None), ("فقال الرجل", None, None, None)], "Sahih"),
        2: ([("احمد", "thiqah", 5, None), ("زيد", None, None, None)], "Undetermined"),
        3: ([("احمد", "daif", 5, None), ("زيد", "majhul", None, None)], "Da'if"),
        4: ([("احمد", "unspecified", 99, None)], "Majhul"),
        5: ([("احمد", "unspecified", 100, None)], "Sahih"),
        6: ([("احمد", "muwaththaq", 1, None), ("زيد", "hasan", 1, None)], "Muwaththaq"),
        7: ([("احمد", "mamduh", 1, None)], "Hasan"),
        8: ([("احمد", "thiqah", 1, "واقفي")], "Sahih"),
        9: ([("احمد", "hasan", 1, "فطحي")], "Muwaththaq"),
    }
    df = spark.createDataFrame([(i, *link) for i, (links, _) in cases.items() for link in links], "chain_id int, name string, status string, hadith_count int, sect string")
    assert {r.chain_id: r.grade for r in chain.grade(df).collect()} == {i: g for i, (_, g) in cases.items()}


ENTRIES = "entry_key string, name_ar string, kunyah string, laqab string, nisba string, father string, aliases array<string>, status string, src_ord int, narrates_from_narrators array<string>, narrates_from_imams array<string>, narrated_from_by array<string>, books array<string>, identity_confidence string, hadith_count int, tabaqah double"


def test_resolve(spark):
    blank = [[], [], [], [], "unique"]
    entries = spark.createDataFrame(
        [
            ("1", "زرارة بن أعين", "ابو الحسن", "", "الشيباني", "اعين", [], "thiqah", 0, [], ["ابي جعفر"], ["عمر بن اذينة"], ["الكافي"], "unique", 100, 4.0),
            ("2", "رومي بن زرارة بن أعين", "", "", "", "زرارة", [], "unspecified", 1, *blank, None, 6.0),
            ("3", "الحسن بن محبوب", "", "السراد", "", "محبوب", ["ابن محبوب"], "thiqah", 2, *blank, 10, 7.0),
        ],
        ENTRIES,
    )
    queries = spark.createDataFrame([(1, "زرارة", ["أبي جعفر"], ["عمر بن أذينة"], "الكافي", 4.0, 5.0), (2, "ابن محبوب", [], [], None, None, None), (3, "حسن بن محبوب", [], [], None, None, None), (4, "غير معروف", [], [], None, None, None)], "query_id int, name string, teachers array<string>, students array<string>, book string, low double, high double")
    got = resolver.resolve(queries, resolver.build_index(entries), entries).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.entry_key) for r in got] == [(1, 1, "1"), (1, 2, "2"), (2, 1, "3"), (3, 1, "3")]
    # shared word 2.0, prefix 1.5, teacher 2, student 2, book 1, fame 0.2 * log10(101), reliable 2, layer 1.5
    assert got[0].score == pytest.approx(12.401, abs=1e-3) and got[0].total_candidates == 2


def test_kunya(spark):
    entries = spark.createDataFrame([("1", "ابو بصير", []), ("2", None, ["أبو بصير المرادي"]), ("3", "ابو حمزة", [])], "entry_key string, kunyah string, aliases array<string>")
    found = evidence_rules.kunya_candidates(spark.createDataFrame([(1, "أبو بصير")], "query_id int, kunya string"), entries)
    assert rows(found) == [(1, "1"), (1, "2")]
    same = [(1, k, True, False, True, 5.0, 5, 5, ["unknown"], False) for k in "ab"]
    one = [(2, "a", True, False, True, 5.0, 5, 5, ["certain"], False), (2, "b", True, False, True, 9.0, 5, 5, [], False), (3, "a", False, False, False, 5.0, 5, 5, ["impossible"], False)]
    scored = spark.createDataFrame(same + one, "query_id int, entry_key string, knows_student boolean, knows_teacher boolean, imam boolean, tabaqah double, low int, high int, verdicts array<string>, book_custom boolean")
    got = {r.query_id: (r.entry_key, r.score, r.confidence) for r in evidence_rules.kunya_score(scored).collect()}
    assert got == {1: ("a", 12, "ambiguous"), 2: ("a", 12, "high"), 3: (None, None, "none")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("فلان : ثقة عين - روى", "thiqah"),
        ("فلان - ثقة -", "thiqah"),
        ("لم تثبت وثاقته وهو ثقة", "unspecified"),
        ("طريق الصدوق اليه ضعيف .", "unspecified"),
        ("فلان - ضعيف .", "daif"),
        ("هو ضعيف جدا", "daif"),
        ("موثق", "muwaththaq"),
        ("من الحسان", "hasan"),
        ("مجهول", "majhul"),
        ("روى عن ابيه", "unspecified"),
        (None, None),
    ],
)
def test_verdicts(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(extract.verdict(F.col("t"))).first()[0] == want


def test_extraction(spark):
    df = spark.createDataFrame([("12 - 13 - ١٤ - آدم أبو الحسين :روى",)], "t string")
    assert tuple(df.select(extract.edition_numbers(F.col("t")).alias("x")).select("x.*").first()) == ("12", "13", "١٤")
    assert df.select(extract.name_of(F.col("t"))).first()[0] == "آدم أبو الحسين"
    life = spark.createDataFrame([("توفي سنة ١٤٨ وله 65 سنة",), ("لا شيء",)], "t string").select(extract.lifetime(F.col("t")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in life] == [(83, 148, 65), (None, None, None)]
    merged = spark.createDataFrame([(["أحمد"], ["احمد", "زيد"])], "a array<string>, b array<string>").select(extract.merge_lists(F.col("a"), F.col("b"))).first()[0]
    assert merged == ["أحمد", "زيد"]
    part = spark.createDataFrame([("أحمد بن محمد، عن زرارة، عن أبي عبد الله (ع) قال: الحلال بين",)], "t string").select(extract.chain_part(F.col("t"), ("ابي عبد الله", "ابي جعفر"))).first()[0]
    assert "ابي عبد الله" in part and "الحلال" not in part


def test_letter_swaps_and_versions(spark):
    df = spark.createDataFrame([("بريد", "تريد"), ("a", "abcd")], "a string, b string").select(evidence_rules.letter_swaps(F.col("a"), F.col("b")).alias("s")).collect()
    assert [[tuple(x) for x in r.s] for r in df] == [[(0, "ب", "ت")], []]
    diff = spark.createDataFrame([(["أحمد", "زيد"], ["احمد", "عمرو", "بكر"])], "a array<string>, b array<string>").select(evidence_rules.version_diff(F.col("a"), F.col("b"))).first()[0]
    assert [tuple(x) for x in diff] == [(1, "زيد", "عمرو"), (2, None, "بكر")]


def test_model_batches(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "idx int, text string")
    calls = []

    def client(prompt):
        n = [line for line in prompt.splitlines() if line.startswith("#")]
        return "[" + ",".join('[{"name": "x"}, {"name": "y"}]' if "t3" in x else '{"name": "z"}' for x in n) + "]"

    got = extractor.entry_keys(extractor.extract(df, "idx", "text", ["name"], client, size=4), "idx").collect()
    assert len(got) == 11 and {r.entry_key: r.name for r in got}["3_overflow_1"] == "y" and not any(r.error for r in got) and not calls
    broken = extractor.extract(df, "idx", "text", ["name"], lambda p: "[]", size=4, tries=2).collect()
    assert len(broken) == 10 and all(r.error for r in broken)
    assert extractor.extract(df, "idx", "text", ["name"]).where("error is null").count() == 10


def test_similarity_edges(spark):
    q = similarity.index(spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "ab")], "q int, t string"), "q", F.col("t"))
    assert rows(q.select("q", "size", "gram")) == [(1, 1, "abc")]
    assert scoring.assessment(F.lit(7)) is not None


def test_both_searches_agree_on_nulls_repeats_and_wide_letters(spark):
    queries = [(1, "a stone bridge 😀😀 over water"), (1, "quite another text of stones"), (2, None), (None, "stone bridge"), (3, "ab"), (4, "b😀c d"), (1, "quite another text of stones")]
    docs = [(10, "A stone bridge over the water!"), (10, "stones and more stones"), (11, "b😀c"), (12, None), (None, "stone bridge"), (13, "a stone bridge 😀😀 over water"), (13, "a stone bridge 😀😀 over water"), (14, "")]
    q, d = spark.createDataFrame(queries, "q long, t string"), spark.createDataFrame(docs, "d long, t string")
    text = F.col("t")
    joined = similarity.search(similarity.index(q, "q", text, None), similarity.index(d, "d", text, None), "q", "d", 3)
    shown = lambda df: sorted((r.q, r.d, round(r.similarity, 9), r["rank"]) for r in df.collect())
    want = shown(joined)
    assert want == shown(similarity.search_texts(q, d, "q", "d", text, text, 3)) == shown(similarity.search_texts(q, d, "q", "d", text, text, 3, held=10))

    def grams(t):
        t = " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
        return {t[i : i + 3] for i in range(len(t) - 2)}

    best = {}
    for a, x in queries:
        for b, y in docs:
            if None not in (a, b, x, y) and (g := grams(x)) and (h := grams(y)) and len(g & h) / len(g | h) > 0.03:
                best[a, b] = max(best.get((a, b), 0), len(g & h) / len(g | h))
    assert {(a, b): s for a, b, s, _ in want} == {k: round(v, 9) for k, v in best.items() if sum(v2 > v or (v2 == v and k2[1] < k[1]) for k2, v2 in best.items() if k2[0] == k[0]) < 3}


def test_analysed_chains(spark):
    from rivulet.operators import analysis

    blank = [[], [], [], [], "unique"]
    entries = spark.createDataFrame(
        [
            ("1", "بكر بن صالح", "", "", "", "صالح", [], "thiqah", 0, ["داود بن سرحان"], [], [], [], "unique", 10, 6.0),
            ("2", "داود بن سرحان", "", "", "", "سرحان", [], "thiqah", 1, *blank, 5, 5.0),
            ("3", "سرحان", "", "", "", "عمرو", [], "thiqah", 2, *blank, 1, 5.0),
        ],
        ENTRIES,
    ).withColumn("grandfather", F.when(F.col("entry_key") == "2", "عمرو"))
    chains = spark.createDataFrame([(1, ["بكر بن صالح", "داود بن سرحان", "ابيه", "الباقر"]), (2, ["لا احد", "عمن رواه", "جده"]), (3, [])], "chain_id int, names array<string>")
    fixed = spark.createDataFrame([("الباقر", "IMAM_BAQIR", 4.0)], "name string, virtual_key string, layer double")
    index = resolver.build_index(entries)
    out = {(r.chain_id, r.pos): r for r in analysis.analyse_chains(chains, index, entries, fixed, {"الباقر": 4}).collect()}
    got = {k: (r.asked, r.virtual_key, r.entry_key, r.layer, r.irsal_type) for k, r in out.items()}
    assert got[1, 0] == ("بكر بن صالح", None, "1", 6.0, None) and got[1, 1] == ("داود بن سرحان", None, "2", 5.0, None)
    assert got[1, 2] == ("سرحان", None, "3", 5.0, None) and got[1, 3] == ("الباقر", "IMAM_BAQIR", None, 4.0, None)
    assert got[2, 0][2] is None and got[2, 1][4] == "mursal" and got[2, 2][0] is None and len(out) == 7
    # Behind layer 6 and before nobody of known layer: 4 to 6; behind layer 5 and before the authority of layer 4: 4 to 5.
    assert (out[1, 1].low, out[1, 1].high) == (4.0, 6.0) and (out[1, 2].low, out[1, 2].high) == (4.0, 5.0)
    lone = {r.chain_id: r.entry_key for r in analysis.analyse_chains(chains.select("chain_id", F.slice("names", 1, 1).alias("names")), index, entries, fixed, {"الباقر": 4}).collect()}
    assert lone[1] == "1"  # a chain of one link is resolved as any other
    guess = {r.name: r.layer for r in analysis.estimate_layers(chains.select(F.explode("names").alias("name")), index, entries, {"الباقر": 4}).collect()}
    assert guess == {"بكر بن صالح": 6.0}
