"""The chain grammar, dictionary matching, scribal errors, prefix ladders, gap recovery and gap probes against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators import dictionary, grammar, ladder, probe, recovery, scribal


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("أحمد بن محمد، عن الحسين بن سعيد، عن زرارة", [("name", "احمد بن محمد"), ("name", "الحسين بن سعيد"), ("name", "زرارة")]),
        ("علي بن الحسين، عن أبيه، عن جده، عن النبي", [("name", "علي بن الحسين"), ("father", "ابيه"), ("name", "جده"), ("name", "النبي")]),
        ("محمد بن مسلم، عن أبي جعفر، عن جده، عن علي بن أبي طالب", [("name", "محمد بن مسلم"), ("name", "ابي جعفر"), ("name", "جده"), ("name", "علي بن ابي طالب")]),
        ("زرارة عن أبي جعفر", [("name", "زرارة"), ("name", "ابي جعفر")]),
        ("عدة من أصحابنا، عن سهل بن زياد قال حدثني غير واحد عن بعض أصحابه", [("group", "عدة من اصحابنا"), ("name", "سهل بن زياد"), ("group", "غير واحد"), ("group", "بعض اصحابه")]),
        ("12 - حدثنا سعد بإسناده عن أبي عبد الله (عليه السلام) وعنه عن ابيه", [("name", "سعد"), ("name", "ابي عبد الله (عليه السلام)"), ("relay", "وعنه"), ("father", "ابيه")]),
        ("سليم عمن رواه عن داود و زيد", [("name", "سليم"), ("relay", "عمن رواه"), ("name", "داود"), ("name", "زيد")]),
        ("(ع) عن عن ،", []),
        ("", []),
        (None, []),
    ],
)
def test_grammar(spark, text, want):
    rows = grammar.segments(spark.createDataFrame([(1, text)], "id int, text string"), "id", F.col("text")).orderBy("pos").collect()
    assert [(r.kind, r.segment) for r in rows] == want and [r.pos for r in rows] == list(range(len(want)))


def test_grammar_in_sql(spark):
    grammar.register(spark)
    spark.createDataFrame([(1, "زيد عن عمرو"), (2, None)], "id int, t string").createOrReplaceTempView("told")
    assert [tuple(r) for r in spark.sql("SELECT id, s.kind, s.segment FROM told, LATERAL chain_segments(t) s ORDER BY id, s.pos").collect()] == [(1, "name", "زيد"), (1, "name", "عمرو")]


@pytest.mark.parametrize("edges", [False, True])
def test_dictionary_against_plain_search(spark, edges):
    rnd = random.Random(3)
    terms = sorted({"".join(rnd.choice("ab cé") for _ in range(rnd.randint(1, 5))).strip() for _ in range(60)} - {""})
    texts = ["".join(rnd.choice("aab  cé😀") for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [None, ""]
    inside = lambda c: c.isalnum() or c == "_"
    every, longest = [], []
    for i, s in enumerate(texts):
        hits = [(a, a + len(t), t) for a in range(len(s or "")) for t in terms if s.startswith(t, a)]
        if edges:
            hits = [(a, b, t) for a, b, t in hits if not (a and inside(s[a - 1])) and not (b < len(s) and inside(s[b]))]
        every += [(i, *h) for h in hits]
        upto = 0
        for a, b, t in sorted(hits, key=lambda h: (h[0], -h[1])):
            if a >= upto:
                longest.append((i, a, b, t))
                upto = b
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    known = spark.createDataFrame([(t,) for t in terms] + [(None,), ("",), (terms[0],)], "term string")
    assert sorted(tuple(r) for r in dictionary.mentions(frame, "id", "text", known, longest=False, edges=edges).collect()) == sorted(every)
    assert sorted(tuple(r) for r in dictionary.mentions(frame, "id", "text", known, edges=edges).collect()) == sorted(longest)
    last = {}
    for i, a, b, t in every:
        if i not in last or (b, -a) > (last[i][1], -last[i][0]):
            last[i] = (a, b, t)
    assert {r.id: (r.start, r.end, r.term) for r in dictionary.last_mention(frame, "id", "text", known, edges=edges).collect()} == last


def test_titles_and_labels(spark):
    titles = spark.createDataFrame([("الباقر", 4), ("ابو جعفر", 4), ("ابو جعفر الثاني", 7)], "title string, layer int")
    texts = spark.createDataFrame([(1, "عن ابو جعفر الثاني"), (2, "ابو جعفر"), (3, "زيد")], "id int, t string")
    assert sorted(tuple(r) for r in dictionary.longest_title(texts, "id", "t", titles).collect()) == [(1, "ابو جعفر الثاني", 7), (2, "ابو جعفر", 4)]
    terms = spark.createDataFrame([("x", "L"), ("y", "M"), ("z", "L")], "term string, label string")
    frame = spark.createDataFrame([(1, "x z y"), (2, "xy"), (3, "z")], "id int, t string")
    assert sorted((r.id, r.labels) for r in dictionary.labels(frame, "id", "t", terms).collect()) == [(1, ["L", "M"]), (3, ["L"])]
    with pytest.raises(ValueError, match="more than a task"):
        old, dictionary.MOST = dictionary.MOST, 2
        try:
            dictionary.mentions(frame, "id", "t", terms)
        finally:
            dictionary.MOST = old


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_scribal_predicates(spark):
    col = lambda c, *v: spark.createDataFrame([v], ", ".join(f"v{i} string" for i in range(len(v)))).select(c(*[F.col(f"v{i}") for i in range(len(v))]).alias("x")).first().x
    assert col(scribal.alike, "زيد بن خلف", "زيد بن خالد") == "خلف/خالد" and col(scribal.alike, "زيد بن عمرو", "علي بن عمر") == "عمر/عمرو" and col(scribal.alike, "زيد", "علي") is None
    assert col(scribal.misdotted, "إسماعيل بن يسار") == "بشار" and col(scribal.misdotted, "زيد") is None
    assert col(scribal.taken_for, "محمد بن زيد") == "محمد/أحمد" and col(scribal.taken_for, "محمد بن أحمد") is None
    assert col(scribal.added, "زيد بن علي بن عمر") is True and col(scribal.added, "زيد بن علي") is False and col(scribal.added, None) is False
    assert col(scribal.is_long, "ا ب ج د ه") is True and col(scribal.is_long, "ا ب ج د") is False
    assert col(scribal.reversed_name, "زيد بن علي") == "علي بن زيد" and col(scribal.reversed_name, "زيد") is None
    assert col(scribal.skeleton, "يسار") == col(scribal.skeleton, "بشار") and col(scribal.shortened, "زيد بن علي بن عمر") == "زيد بن عمر" and col(scribal.shortened, "زيد بن علي") is None


def test_scribal_indexes_against_all_pairs(spark):
    rnd = random.Random(11)
    make = lambda n: "".join(rnd.choice("ابتجحد") for _ in range(n))
    known = sorted({make(rnd.randint(1, 6)) for _ in range(150)})
    asked = sorted({make(rnd.randint(1, 6)) for _ in range(60)} | set(known[:10]))
    k = spark.createDataFrame([(x, i) for i, x in enumerate(known)], "name string, n long")
    q = spark.createDataFrame([(x,) for x in asked] + [(None,)], "name string")
    got = {(r.name, r.other, r.edits) for r in scribal.near(q, k).collect()}
    assert got == {(a, b, d) for a in asked for b in known if 1 <= (d := plain_distance(a, b)) <= 2}
    bare = lambda s: s.translate(str.maketrans(scribal.DOTTED, scribal.PLAIN))
    assert {(r.name, r.other) for r in scribal.meant_by_dots(q, k).collect()} == {(a, b) for a in asked for b in known if a != b and bare(a) == bare(b)}
    names = spark.createDataFrame([("زيد بن علي", 1), ("علي بن زيد", 5), ("زيد بن عمر", 2)], "name string, n long")
    assert [tuple(r) for r in scribal.meant_by_order(names, names).collect()] == [("زيد بن علي", "علي بن زيد", 1, 5)]
    long = spark.createDataFrame([("زيد بن علي بن عمر",)], "name string")
    assert [tuple(r) for r in scribal.meant_without(long, names).collect()] == [("زيد بن علي بن عمر", "زيد بن عمر", 2)]
    assert [tuple(r) for r in scribal.rare(long.union(names.select("name")), names, 2).orderBy("name").collect()] == [("زيد بن علي", 1), ("زيد بن علي بن عمر", 0)]


def test_prefix_ladder_against_a_loop(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice("ا ب ج د ه و".split())
    name = lambda: " ".join(word() for _ in range(rnd.randint(1, 7)))
    entries = [(f"e{i}", name(), rnd.sample(["A", "B", "C"], rnd.randint(0, 2))) for i in range(60)]
    asked = [(i, name(), [name() for _ in range(rnd.randint(0, 2))] or None, rnd.choice([None, 1, 2, 9])) for i in range(120)]
    expected = {1: {"A"}, 2: {"B", "C"}}
    fix = lambda s: [s.replace("ه", "د")] if "ه" in s else []
    keys = lambda s: [" ".join(s.split()[:d] if d else s.split()) for d in ladder.DEPTHS]
    index = {}
    for e, n, _ in entries:
        for key in set(keys(n)):
            index.setdefault(key, set()).add(e)
    want = {}
    for i, n, alias, layer in asked:
        tried = [n, *(alias or [])]
        tried = tried + fix(n) + [v for a in alias or [] for v in fix(a)]
        hit, pool = None, set()
        for x in tried:
            for key in keys(x):
                found = index.get(key, set())
                if len(found) == 1 and hit is None:
                    hit = next(iter(found))
                pool |= found
        if hit is None:
            good = {e for e, _, a in entries if e in pool and set(a) & expected.get(layer, set())}
            hit = next(iter(pool)) if len(pool) == 1 else next(iter(good)) if len(good) == 1 else None
            want[i] = (hit, len(pool))
        else:
            want[i] = (hit, 0)
    e = spark.createDataFrame(entries, "entry_key string, name_ar string, a array<string>")
    q = spark.createDataFrame(asked, "query_id int, name string, aliases array<string>, layer int")
    ex = spark.createDataFrame([(k, a) for k, v in expected.items() for a in v], "layer int, authority string")
    corrected = lambda c: F.when(F.contains(c, F.lit("ه")), F.array(F.replace(c, F.lit("ه"), F.lit("د")))).otherwise(F.array().cast("array<string>"))
    got = ladder.match(q, ladder.prefix_index(e), e.select("entry_key", F.explode("a").alias("authority")), ex, corrected).collect()
    assert {r.query_id: (r.entry_key, r.candidates) for r in got} == want and len(got) == len(asked)
    numbers = spark.createDataFrame([("e1", 1, ["5", None]), ("e0", 0, ["5", "7"])], "entry_key string, src_ord int, numbers array<string>")
    assert sorted(tuple(r) for r in ladder.by_any_number(numbers.select(F.explode("numbers").alias("number")), numbers).collect()) == [("5", "e0"), ("7", "e0")]


@pytest.mark.parametrize("rows", [25, 10_000])
def test_asof_and_missing_runs(spark, rows):
    rnd = random.Random(6)
    right = [(g, p, rnd.choice([None, p * 2])) for g, n in (("a", 300), ("b", 4)) for p in sorted(rnd.sample(range(1000), n))]
    left = [(rnd.choice(["a", "b", "z"]), rnd.randint(-5, 1005), i) for i in range(200)]
    want = {}
    for g, p, i in left:
        own = [(q, v) for h, q, v in right if h == g]
        before, after = [x for x in own if x[0] <= p], [x for x in own if x[0] > p]
        want[i] = (*(before[-1] if before else (None, None)), *(after[0] if after else (None, None)))
    got = recovery.asof(spark.createDataFrame(left, "g string, p int, i int"), spark.createDataFrame(right, "g string, p int, v int"), ["g"], "p", ["v"], rows=rows).collect()
    assert {r.i: (r.before_p, r.before_v, r.after_p, r.after_v) for r in got} == want and len(got) == len(left)
    numbers = [(g, n, n * 10, n * 10 + 4) for g, n, _ in right] + [("a", right[0][1], 0, 1)]
    runs = {(r.g, r.low, r.high): (r.before, r.after, r.text_start, r.text_end) for r in recovery.missing_runs(spark.createDataFrame(numbers, "g string, n int, s int, e int"), ["g"], "n", "s", "e", rows=rows).collect()}
    plain = {}
    for g in "ab":
        own = [q for h, q, _ in right if h == g]
        plain |= {(g, a + 1, b - 1): (a, b, a * 10 + 4, b * 10) for a, b in zip(own, own[1:], strict=False) if b > a + 1}
    assert runs == plain


def test_recovered_entries(spark):
    text = "ذيل ما قبله\n٩٩ - زيد بن علي الكوفي\nكلام <b>من السادسة</b>\nيرد بعنوان: زيد، ابن علي\n\nآخر\n12. عمرو بن خالد\nفهو من صغار الخامسة\n9999 - ليس هنا\n3 - بكر بن صالح\n4 - زائد بن نافع"
    gaps = spark.createDataFrame([("k", 5, 7, text), ("k", 20, 20, "لا شيء"), ("k", 30, 31, None)], "book string, low int, high int, text string")
    rows = recovery.recovered(gaps, ["book"]).orderBy("number").collect()
    assert [(r.number, r.read_number, r.name, r.layer) for r in rows] == [(5, 99, "زيد بن علي الكوفي", 6), (6, 12, "عمرو بن خالد", 5), (7, 3, "بكر بن صالح", None)]
    assert rows[0].alt_names == ["زيد", "ابن علي"]


def test_probes_against_all_pairs(spark):
    rnd = random.Random(8)
    people = [f"p{i}" for i in range(30)]
    edges = {(rnd.choice(people[:6] if rnd.random() < 0.4 else people), rnd.choice(people)) for _ in range(260)}
    layers = {p: rnd.choice([None, 3, 4, 5]) for p in people}
    gaps = [(i, rnd.choice(people), rnd.choice(people), rnd.choice([None, 3, 4, 5])) for i in range(150)]
    want = {(i, x) for i, b, a, layer in gaps for x in people if (x, b) in edges and (a, x) in edges and x not in (a, b) and (layer is None or layers[x] == layer)}
    e = spark.createDataFrame([*edges, ("p1", None)], "teacher string, student string")
    got = probe.fillers(spark.createDataFrame(gaps, "gap_id int, before string, after string, layer int"), e, spark.createDataFrame(list(layers.items()), "person string, layer int"))
    assert {tuple(r) for r in got.collect()} == want
    few = spark.createDataFrame([(p,) for p in people[:5]], "narrator string")
    paths = probe.parallel(few, e)
    degree = {t: len({s for u, s in edges if u == t}) for t in people}
    assert {tuple(r) for r in paths.collect()} == {(s, t, degree[t] - 1) for t, s in edges if s in people[:5] and degree[t] > 1}
    assert {tuple(r) for r in probe.companions(paths, e).collect()} == {(s, t, o) for t, s in edges if s in people[:5] for u, o in edges if u == t and o != s}
    links = spark.createDataFrame([(1, 0, "a", 6), (1, 1, "b", 4), (1, 2, "c", 3), (1, 3, "d", None)], "chain_id int, pos int, person string, layer int")
    assert [tuple(r) for r in probe.gaps_of(links).collect()] == [(1, 0, "a", "b", 5)]
