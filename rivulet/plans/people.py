"""Queries of the name, chain and record operators. The driver's tables hold no such names, so keys stand for people, and names follow from keys by arithmetic in both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analysis as an
from ..operators import chain as ch
from ..operators import evidence_rules as ev
from ..operators import extract as ex
from ..operators import layers as ly
from ..operators import merge as mg
from ..operators import resolver as rs
from ..operators import scan
from ..operators import windows as wn
from .catalogue import _round_sql, query

GIVEN = ["علي", "محمد", "احمد", "الحسين", "جعفر", "زرارة", "يونس", "حماد", "سهل", "ابان", "داود"]
PLACES = ["الكوفي", "القمي", "البصري", "الرازي", "المدني"]
STATUS = ["thiqah", "daif", "majhul", "unspecified", "mamduh", "hasan", "muwaththaq"]


def one(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def one_sql(values: list[str], key: str) -> str:
    return f"(ARRAY[{', '.join(repr(v) for v in values)}])[CAST(({key}) % {len(values)} + 1 AS BIGINT)]"


def div(c: Column, n: int) -> Column:
    return F.floor(c / n)


def given(key: Column) -> Column:
    return one(GIVEN, key)


def given_sql(key: str) -> str:
    return one_sql(GIVEN, key)


def people(t) -> DataFrame:
    """Entries, one a customer."""
    k, space = F.col("c_custkey"), F.lit(" ")
    name = lambda a, b: F.concat(given(a), F.lit(" بن "), given(b))
    empty = F.lit(None).cast("array<string>")
    return t.customer.select(
        F.concat(F.lit("k"), k.cast("string")).alias("entry_key"),
        k.alias("src_ord"),
        F.concat(name(k, div(k, 11)), space, one(PLACES, k)).alias("name_ar"),
        F.concat(F.lit("ابو "), given(div(k, 7))).alias("kunyah"),
        F.when(k % 4 == 0, "الصيرفي").alias("laqab"),
        one(PLACES, k).alias("nisba"),
        given(div(k, 11)).alias("father"),
        F.when(k % 3 == 0, F.array(F.concat(given(k), space, one(PLACES, k)))).otherwise(empty).alias("aliases"),
        one(STATUS, k).alias("status"),
        F.when(k % 9 != 0, (k % 150).cast("int")).alias("hadith_count"),
        (k % 12 + 1).cast("double").alias("tabaqah"),
        F.when(k % 5 == 0, "certain").when(k % 5 == 1, "uncertain").alias("identity_confidence"),
        F.when(k % 6 == 0, F.array(F.concat(F.lit("كتاب "), given(k)))).otherwise(empty).alias("books"),
        F.array(name(k + 1, k + 2)).alias("narrates_from_narrators"),
        F.array(name(k + 3, k + 4)).alias("narrated_from_by"),
        F.when(k % 8 == 0, F.array(F.lit("الباقر"))).otherwise(empty).alias("narrates_from_imams"),
    )


def _name_sql(a: str, b: str) -> str:
    return f"{given_sql(a)} || ' بن ' || {given_sql(b)}"


PEOPLE = f"""SELECT 'k' || c_custkey AS entry_key, c_custkey AS k, {_name_sql("c_custkey", "c_custkey // 11")} || ' ' || {one_sql(PLACES, "c_custkey")} AS name_ar,
'ابو ' || {given_sql("c_custkey // 7")} AS kunyah, CASE WHEN c_custkey % 4 = 0 THEN 'الصيرفي' ELSE '' END AS laqab, {one_sql(PLACES, "c_custkey")} AS nisba, {given_sql("c_custkey // 11")} AS father,
CASE WHEN c_custkey % 3 = 0 THEN [{given_sql("c_custkey")} || ' ' || {one_sql(PLACES, "c_custkey")}] ELSE [] END AS aliases, {one_sql(STATUS, "c_custkey")} AS status, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 150 END AS hadith_count,
c_custkey % 12 + 1 AS tabaqah, CASE c_custkey % 5 WHEN 0 THEN 0.1 WHEN 1 THEN -0.2 ELSE 0 END AS sure, CASE WHEN c_custkey % 6 = 0 THEN ['كتاب ' || {given_sql("c_custkey")}] ELSE [] END AS books,
[{_name_sql("c_custkey + 1", "c_custkey + 2")}] AS teachers_of, [{_name_sql("c_custkey + 3", "c_custkey + 4")}] AS students_of, CASE WHEN c_custkey % 8 = 0 THEN ['الباقر'] ELSE [] END AS imams FROM customer"""
PARTICLES_SQL = f"({', '.join(repr(p) for p in tx.PARTICLES)})"


def _content_sql(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda w: w <> '' AND w NOT IN {PARTICLES_SQL})"


def _rank_sql(order: tuple[str, ...], col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(order)) + f" ELSE {len(order)} END"


# --- Resolver


FORMS_SQL = """list_distinct(list_filter([name_ar, trim(replace(name_ar, nisba, '')), string_split(name_ar, ' ')[1] || ' بن ' || father, kunyah, kunyah || ' ' || nisba, CASE WHEN laqab <> '' THEN kunyah || ' ' || laqab ELSE '' END,
'ابن ' || father, replace(kunyah, 'ابو ', 'ابي '), replace(kunyah, 'ابو ', 'ابي ') || ' ' || nisba, CASE WHEN laqab <> '' THEN replace(kunyah, 'ابو ', 'ابي ') || ' ' || laqab ELSE '' END]
|| aliases || list_transform(aliases, lambda a: trim(replace(a, nisba, ''))), lambda f: length(f) >= 3))"""
TOGGLE = "CASE WHEN starts_with({0}, 'ال') THEN substr({0}, 3) ELSE 'ال' || {0} END"
ASKED = f"""SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN {_name_sql("s_suppkey", "s_suppkey // 11")} || ' ' || {one_sql(PLACES, "s_suppkey")} WHEN 1 THEN {_name_sql("s_suppkey", "s_suppkey // 3")}
WHEN 2 THEN 'ابي ' || {given_sql("s_suppkey // 5")} || ' ' || {one_sql(PLACES, "s_suppkey")} ELSE 'حسين بن ' || {given_sql("s_suppkey // 4")} END AS name,
{_name_sql("s_suppkey + 1", "s_suppkey + 2")} AS teacher, {given_sql("s_suppkey")} AS student, 'كتاب ' || {given_sql("s_suppkey")} AS book, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 10 + 1 END AS low FROM supplier"""


def asked(t) -> DataFrame:
    """Names to resolve, one a supplier."""
    s, space = F.col("s_suppkey"), F.lit(" ")
    name = lambda a, b: F.concat(given(a), F.lit(" بن "), given(b))
    kinds = F.when(s % 4 == 0, F.concat(name(s, div(s, 11)), space, one(PLACES, s))).when(s % 4 == 1, name(s, div(s, 3))).when(s % 4 == 2, F.concat(F.lit("ابي "), given(div(s, 5)), space, one(PLACES, s))).otherwise(F.concat(F.lit("حسين بن "), given(div(s, 4))))
    low = F.when(s % 3 > 0, (s % 10 + 1).cast("int"))
    return t.supplier.select(s.alias("query_id"), kinds.alias("name"), F.array(name(s + 1, s + 2)).alias("teachers"), F.array(given(s)).alias("students"), F.concat(F.lit("كتاب "), given(s)).alias("book"), low.alias("low"), (low + 2).alias("high"))


INDEX_SQL = f"""e AS MATERIALIZED (SELECT *, 'k' || (k - k % 3) AS canonical_key, {_rank_sql(rs.STATUS_ORDER, "status")} AS r FROM ({PEOPLE})),
f AS (SELECT canonical_key, entry_key, r, k, unnest({FORMS_SQL}) AS form FROM e),
i AS MATERIALIZED (SELECT form, canonical_key, entry_key, k FROM (SELECT *, row_number() OVER (PARTITION BY form, canonical_key ORDER BY r, k) AS n FROM f) WHERE n = 1)"""


def _index(t) -> DataFrame:
    e = people(t)
    canonical = e.select("entry_key", F.concat(F.lit("k"), (F.col("src_ord") - F.col("src_ord") % 3).cast("string")).alias("canonical_key"))
    return rs.build_index(e, canonical)


@query(f"WITH {INDEX_SQL} SELECT form, canonical_key, entry_key FROM i")
def resolver_index(t):  # C1 N18 W8
    return _index(t)


@query(f"WITH {INDEX_SQL} SELECT count(DISTINCT form) AS forms, count(*) AS refs, round(count(*) / count(DISTINCT form), 4) AS per_form FROM i")
def resolver_index_stats(t):  # A7
    return _index(t).agg(F.count_distinct("form").alias("forms"), F.count("*").alias("refs")).withColumn("per_form", F.round(F.col("refs") / F.col("forms"), 4))


RESOLVE_SQL = f"""WITH {INDEX_SQL},
q AS MATERIALIZED (SELECT *, string_split(name, ' ') AS ws, {_content_sql("name")} AS qc FROM ({ASKED})),
v AS (SELECT query_id, 1 AS source, name AS form FROM q
UNION ALL SELECT query_id, 2, {TOGGLE.format("ws[1]")} || substr(name, length(ws[1]) + 1) FROM q
UNION ALL SELECT query_id, 3, array_to_string(list_transform(ws, lambda w, j: CASE WHEN j = p + 1 THEN {TOGGLE.format("w")} ELSE w END), ' ') FROM (SELECT *, unnest(range(1, len(ws))) AS p FROM q) WHERE ws[p] IN ('بن', 'ابن')
UNION ALL SELECT query_id, 4, array_to_string(ws[3:], ' ') FROM q WHERE len(ws) >= 3 AND ws[1] IN ('ابي', 'ابو', 'ابا')
UNION ALL SELECT query_id, 6, array_to_string(ws[:len(ws) - 1], ' ') FROM q WHERE len(ws) >= 3),
met AS (SELECT query_id, source, canonical_key, entry_key FROM v JOIN i USING (form)),
small AS (SELECT query_id, qc FROM q LEFT JOIN (SELECT query_id, count(DISTINCT canonical_key) AS n FROM met WHERE source < 6 GROUP BY 1) USING (query_id) WHERE coalesce(n, 0) < {rs.SMALL_POOL}),
wide AS (SELECT query_id, 5 AS source, canonical_key, entry_key FROM small JOIN i ON len(qc) > 0 AND list_has_all({_content_sql("form")}, qc)),
pool AS (SELECT m.*, e.r, e.k FROM (SELECT * FROM met UNION ALL SELECT * FROM wide) m JOIN e USING (entry_key)),
best AS (SELECT query_id, canonical_key, min((source, k)) AS seen, arg_min(entry_key, (r, source, k, entry_key)) AS entry_key FROM pool GROUP BY 1, 2),
x AS (SELECT b.query_id, b.canonical_key, b.seen, e.entry_key, q.name AS q_name, q.qc, q.teacher, q.student, q.book, q.low, e.name_ar, {_content_sql("e.name_ar")} AS nc, e.teachers_of || e.imams AS known, e.students_of, e.books, e.sure, e.hadith_count, e.status, e.tabaqah
FROM best b JOIN e ON e.entry_key = b.entry_key JOIN q ON q.query_id = b.query_id),
y AS (SELECT *, len(list_intersect(qc, nc)) AS shared, greatest(low - tabaqah, tabaqah - low - 2, 0) AS away FROM x),
z AS (SELECT *, CASE WHEN q_name = name_ar THEN 3.0 WHEN shared > 0 THEN shared / greatest(len(list_distinct(qc)), 1) * 2.0 ELSE 0 END + CASE WHEN len(qc) > 0 AND nc[:len(qc)] = qc THEN 1.5 ELSE 0 END
+ CASE WHEN list_contains(known, teacher) THEN 2.0 WHEN len(list_filter(known, lambda o: list_has_all({_content_sql("o")}, {_content_sql("teacher")}))) > 0 THEN 1.0 ELSE 0 END
+ CASE WHEN list_contains(students_of, student) THEN 2.0 WHEN len(list_filter(students_of, lambda o: list_has_all({_content_sql("o")}, {_content_sql("student")}))) > 0 THEN 1.0 ELSE 0 END
+ CASE WHEN list_contains(books, book) THEN 1.0 ELSE 0 END + sure + CASE WHEN hadith_count > 0 THEN log10(hadith_count + 1) * 0.2 ELSE 0 END + CASE status WHEN 'thiqah' THEN 2.0 WHEN 'daif' THEN -2.0 ELSE 0 END
+ CASE WHEN low IS NULL THEN 0 WHEN away = 0 THEN 1.5 WHEN away = 1 THEN 0 WHEN away = 2 THEN -1.0 ELSE -2.0 END AS score,
concat_ws(',', CASE WHEN q_name = name_ar THEN 'exact name' END, CASE WHEN q_name <> name_ar AND shared > 0 THEN 'shared words' END, CASE WHEN len(qc) > 0 AND nc[:len(qc)] = qc THEN 'name begins so' END) AS reasons FROM y),
w AS (SELECT *, round_even(CAST(score AS DOUBLE), 3) AS s, count(*) OVER (PARTITION BY query_id) AS total_candidates FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, seen, entry_key) AS rank FROM w)
SELECT query_id, canonical_key, entry_key, s AS score, reasons, total_candidates, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 5"""


@query(RESOLVE_SQL)
def resolve_names(t):  # C2 C3 C4 J1 J2 J3 J4 O1
    return rs.resolve(asked(t), _index(t), people(t)).withColumn("reasons", F.array_join("reasons", ","))


# --- Text functions


RAW = ["عَلِيّ بن أبي طالب (ع)", "أَحمد بن محمّد  بن  عيسى", "إسحاق بن عمّار، الكوفي", "الل ه ولي التوفيق", "ٱلحسين بن سعيد القلاء", "یونس بن عبدالرحمان نيسابور", "عبد الله بن سنـــان", "فاطمة ; سيدة النسا"]
MARKS_SQL = "[" + chr(0x64B) + "-" + chr(0x65F) + chr(0x670) + "]"


def bare_sql(x: str) -> str:
    return f"regexp_replace(replace({x}, 'ـ', ''), '{MARKS_SQL}', '', 'g')"


def normal_sql(x: str) -> str:
    folded = f"translate({bare_sql(x)}, 'أإآٱ', 'اااا')"
    spelled = rf"replace(replace(regexp_replace({folded}, 'الل\s+ه([^\p{{L}}\p{{N}}_]|$)', 'الله\1', 'g'), 'نيسابور', 'نيشابور'), 'رحمان', 'رحمن')"
    return rf"trim(regexp_replace(regexp_replace({spelled}, 'اء(\s|$)', 'ا\1', 'g'), '\s+', ' ', 'g'))"


def squeezed_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


@query(rf"""WITH x AS (SELECT p_partkey, {one_sql(RAW, "p_partkey")} AS raw FROM part), n AS (SELECT *, {normal_sql("raw")} AS canonical FROM x)
SELECT p_partkey, canonical, {squeezed_sql("regexp_replace(regexp_replace(translate(replace(raw, 'ـ', ''), 'أإآٱیکىة', 'اااايكيه'), '" + MARKS_SQL + r"', '', 'g'), '[^؀-ۿ\s]', '', 'g')")} AS strict,
array_to_string(list_transform(list_filter(string_split(canonical, ' '), lambda w: w <> ''), lambda w: CASE WHEN starts_with(w, 'ال') AND length(w) > 4 THEN substr(w, 3) ELSE w END), ' ') AS without_article,
{bare_sql("raw")} AS bare, {squeezed_sql("regexp_replace(canonical, '[^ا-ي ]', '', 'g')")} AS letters,
{squeezed_sql("regexp_replace(translate(" + bare_sql("raw") + r", 'أإآ', 'ااا'), '\p{P}', ' ', 'g')")} AS for_merge, len(list_filter(string_split(canonical, ' '), lambda w: w <> '')) AS tokens FROM n""")
def normal_forms(t):  # N1 N2 N3 N4 N6 N7 N8 N9
    raw = F.col("raw")
    return t.part.select("p_partkey", one(RAW, F.col("p_partkey")).alias("raw")).select(
        "p_partkey",
        tx.normalize(raw).alias("canonical"),
        tx.normalize_strict(raw).alias("strict"),
        tx.without_article(raw).alias("without_article"),
        tx.bare(raw).alias("bare"),
        tx.letters_only(raw).alias("letters"),
        tx.for_merge(raw).alias("for_merge"),
        F.size(tx.tokens(raw)).cast("long").alias("tokens"),
    )


HONOURED = ["الباقر (ع)", "الصادق عليه السلام", "الرضا", "الحسن بن علي العسكري (ع)", "الحسن بن علي", "رجل"]
TITLES = {"الباقر": 4, "الصادق": 5, "الرضا": 8, "الحسن بن علي": 3, "الحسن بن علي العسكري": 11}
REPLIES = ['<think>so</think>{"a": 1}', '```json\n[1, 2]\n```', "no json", '{"a": 1', "", 'x {"b": [1]} y']


@query(rf"""WITH x AS (SELECT p_partkey AS k, {one_sql(HONOURED, "p_partkey")} AS name, {one_sql(REPLIES, "p_partkey").replace(chr(10), "' || chr(10) || '")} AS reply FROM part)
SELECT k, trim(regexp_replace(name, '\s*(\(ع\)|\sعليه السلام)\s*$', '')) AS plain,
CAST(CASE WHEN contains(name, 'الحسن بن علي العسكري') THEN 11 WHEN contains(name, 'الحسن بن علي') THEN 3 WHEN contains(name, 'الباقر') THEN 4 WHEN contains(name, 'الصادق') THEN 5 WHEN contains(name, 'الرضا') THEN 8 END AS INTEGER) AS layer,
CASE WHEN k % 400 BETWEEN 1 AND 500 AND k % 700 <= 500 AND k % 700 >= 1 THEN CAST(k % 700 AS INTEGER) END AS year, CASE WHEN k % 5 = 0 THEN 0 ELSE round(log10(k + 1) * 0.2, 9) END AS fame,
CAST(k AS INTEGER) AS digits, coalesce(CASE WHEN k % 3 > 0 THEN 'n' || k END, CASE WHEN k % 2 > 0 THEN 'm' || k END, 'k' || k) AS shown,
CASE WHEN contains(reply, 'think') THEN '{{"a": 1}}' WHEN contains(reply, '[1, 2]') THEN '[1, 2]' WHEN contains(reply, '"b"') THEN '{{"b": [1]}}' END AS json FROM x""".replace("k % 400 BETWEEN 1 AND 500 AND ", ""))
def scalar_functions(t):  # N11 N14 N15 N16 N19 N32 N37 N40 N41
    k = F.col("k")
    x = t.part.select(F.col("p_partkey").alias("k"), one(HONOURED, F.col("p_partkey")).alias("name"), one(REPLIES, F.col("p_partkey")).alias("reply"))
    plain = tx.strip_honorific(F.col("name"))
    return x.select(
        "k",
        plain.alias("plain"),
        tx.longest_title(plain, TITLES).alias("layer"),
        tx.plausible_year((k % 700).cast("int")).alias("year"),
        F.round(tx.fame(F.when(k % 5 != 0, k)), 9).alias("fame"),
        tx.loose_int(F.concat(F.lit("رقم "), tx.to_arabic_digits(k), F.lit(" ص"))).alias("digits"),
        tx.first_filled(F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("n"), k.cast("string"))), F.when(k % 2 != 0, F.concat(F.lit("m"), k.cast("string"))), F.concat(F.lit("k"), k.cast("string"))).alias("shown"),
        tx.json_of_reply(F.col("reply")).alias("json"),
    )


def _words_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: length(w) >= 3 AND w NOT IN {PARTICLES_SQL}))"


MATCH = "(a = b OR (length(a) >= 3 AND length(b) >= 3 AND (starts_with(a, b) OR starts_with(b, a))))"


@query(f"""WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN 'عبد الله بن ' || {given_sql("c_custkey")} ELSE {_name_sql("c_custkey", "c_custkey // 11")} || ' ' || {one_sql(PLACES, "c_custkey")} END AS one, {_name_sql("c_custkey + c_custkey // 50", "c_custkey // 11")} || ' ' || substr({one_sql(PLACES, "c_custkey")}, 1, 5) AS two FROM customer),
y AS (SELECT *, {_words_sql("one")} AS aw, {_words_sql("two")} AS bw, {_content_sql("one")} AS oc, {_content_sql("two")} AS tc FROM x),
z AS (SELECT *, CASE WHEN oc[1] = 'عبد' THEN oc[1] || ' ' || oc[2] ELSE oc[1] END AS g1, tc[1] AS g2, len(list_filter(aw, lambda a: len(list_filter(bw, lambda b: {MATCH})) > 0)) AS met FROM y)
SELECT k, len(aw) AS significant, len(list_intersect(aw, bw)) AS shared, g1 AS given, CASE WHEN g1 = g2 AND len(aw) > 0 THEN round(met / len(aw), 6) ELSE 0 END AS score,
one = two OR len(list_filter(list_filter(string_split(two, ' '), lambda w: length(w) >= 3), lambda w: NOT contains(one, w))) = 0 AS listed, len(list_intersect(aw, bw)) > 0 OR met > 0 AS any_word FROM z""")
def name_measures(t):  # N22 N23 N24 N25 N26 N27
    k, space = F.col("c_custkey"), F.lit(" ")
    name = lambda a, b: F.concat(given(a), F.lit(" بن "), given(b))
    first = F.when(k % 13 == 0, F.concat(F.lit("عبد الله بن "), given(k))).otherwise(F.concat(name(k, div(k, 11)), space, one(PLACES, k)))
    x = t.customer.select(k.alias("k"), first.alias("one"), F.concat(name(k + div(k, 50), div(k, 11)), space, F.substring(one(PLACES, k), 1, 5)).alias("two"))
    a, b = tx.significant(F.col("one")), tx.significant(F.col("two"))
    return x.select(
        "k",
        F.size(a).cast("long").alias("significant"),
        tx.overlap(a, b).cast("long").alias("shared"),
        tx.given_name(F.col("one")).alias("given"),
        F.round(tx.name_score(F.col("one"), F.col("two")), 6).alias("score"),
        tx.in_names(F.col("two"), F.array("one")).alias("listed"),
        F.exists(a, lambda x: F.exists(b, lambda y: tx.word_match(x, y))).alias("any_word"),
    )


@query("""WITH x AS (SELECT p_partkey AS k, p_name, string_split(p_name, ' ') AS ws FROM part),
v AS (SELECT k, unnest(list_distinct([p_name] || list_transform(ws, lambda w, j: array_to_string(list_transform(ws, lambda u, i: CASE WHEN i = j THEN regexp_replace(u, 'e([^e]*)$', 'E\\1') ELSE u END), ' ')))) AS variant FROM x)
SELECT k, variant FROM v""".replace("\\\\", "\\"))
def letter_variants(t):  # N20
    return t.part.select(F.col("p_partkey").alias("k"), F.explode(tx.one_edit_variants(F.col("p_name"), "e", "E")).alias("variant"))


@query(r"""SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(url, '/en/') THEN 'english' END, CASE WHEN regexp_matches(url, '/es/') THEN 'spanish' END, CASE WHEN regexp_matches(url, 'https') THEN 'secure' END], lambda x: x IS NOT NULL), ',') AS labels,
CASE WHEN length(split_part(url, '/', 4)) > 20 THEN split_part(url, '/', 4) WHEN contains(substr(url, 1, CAST(ceil(length(url) * 0.6) AS BIGINT)), '//') THEN trim(substr(url, strpos(url, '//') + 2)) ELSE url END AS main FROM pages""")
def page_labels(t):  # N31 N33
    labels = tx.labels(F.col("url"), {"english": "/en/", "spanish": "/es/", "secure": "https"})
    return t.pages.select("page_id", F.array_join(labels, ",").alias("labels"), tx.main_text(F.split_part("url", F.lit("/"), F.lit(4)), F.col("url"), ("//",)).alias("main"))


GRADES = ["Sahih", "Hasan -> weak link", "Muwaththaq", "Da'if", "Majhul but sahih", "Undetermined"]


@query(f"""WITH x AS (SELECT o_orderkey, lower({one_sql(GRADES, "o_orderkey").replace("Da'if", "Da''if").replace('"', "'")}) AS g FROM orders),
c AS (SELECT o_orderkey, CASE WHEN contains(g, 'da''if') OR contains(g, 'weak') THEN 'daif' WHEN contains(g, 'majhul') THEN 'majhul' WHEN contains(g, 'sahih') THEN 'sahih' WHEN contains(g, 'hasan') THEN 'hasan' WHEN contains(g, 'muwaththaq') THEN 'muwaththaq' ELSE 'other' END AS ours, CASE o_orderkey % 3 WHEN 0 THEN 'sahih' WHEN 1 THEN 'daif' ELSE 'hasan' END AS theirs FROM x)
SELECT ours, theirs, count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY 1, 2""")
def grade_confusion(t):  # N35 A15 V4
    k = F.col("o_orderkey")
    pairs = t.orders.select(ev.category(one(GRADES, k)).alias("ours"), F.when(k % 3 == 0, "sahih").when(k % 3 == 1, "daif").otherwise("hasan").alias("theirs"))
    return ev.confusion(pairs, "ours", "theirs").withColumn("share", F.round("share", 6))


# --- Extraction


@query("""WITH x AS (SELECT s_suppkey AS k, s_suppkey % 40 AS n3 FROM supplier) SELECT n3, array_to_string(list_sort(list(k)), ',') AS idxs FROM x GROUP BY 1""")
def number_index(t):  # X2
    return ex.name_index(t.supplier.select((F.col("s_suppkey") % 40).alias("n3"), F.col("s_suppkey").alias("idx"))).withColumn("idxs", F.array_join("idxs", ","))


@query("""WITH b AS (SELECT l_partkey AS idx FROM lineitem WHERE l_quantity = 50) SELECT p_partkey AS idx FROM part WHERE (p_partkey + 1 IN (SELECT idx FROM b) OR p_partkey - 1 IN (SELECT idx FROM b)) AND p_partkey NOT IN (SELECT idx FROM b)""")
def batch_neighbours(t):  # X11
    return ex.neighbours_of_batch(t.part.select(F.col("p_partkey").alias("idx")), t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").cast("long").alias("idx")).distinct())


@query(f"""WITH x AS (SELECT p_partkey AS k, [p_name, {normal_sql("'أ' || p_brand")}] AS old, p_type, 'ا' || p_brand AS same FROM part)
SELECT k, array_to_string([p_name_] || [second] || CASE WHEN p_type IN (p_name_, second) THEN [] ELSE [p_type] END, ',') AS names, CASE WHEN k % 2 = 0 THEN p_type ELSE 'kept' END AS filled, 'safe' AS locked FROM (SELECT *, old[1] AS p_name_, old[2] AS second FROM x)""")
def merged_fields(t):  # X15 X16 P10
    brand = F.concat(F.lit("ا"), F.col("p_brand"))
    x = t.part.select(F.col("p_partkey").alias("k"), F.array("p_name", brand).alias("old"), F.array(F.concat(F.lit("أ"), F.col("p_brand")), F.col("p_type")).alias("new"), F.when(F.col("p_partkey") % 2 == 0, " ").otherwise("kept").alias("filled"), F.lit("safe").alias("locked"), "p_type")
    x = ex.fill(x, {"filled": F.col("p_type"), "locked": F.col("p_type")}, protected=("locked",))
    return x.select("k", F.array_join(ex.merge_lists(F.col("old"), F.col("new")), ",").alias("names"), "filled", "locked")


# --- Chains: an order's lines are the links of one chain, its suppliers the people


LINK = f"""SELECT l_orderkey AS chain_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_suppkey AS s, {_name_sql("l_suppkey", "l_suppkey // 11")} AS name FROM lineitem"""
STATED = {"thiqah": 0, "daif": 1, "majhul": 2, "unspecified": 3, "mamduh": 4, "hasan": 5, "muwaththaq": 6}


def _lines(t) -> DataFrame:
    s = F.col("l_suppkey")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return t.lineitem.select(F.col("l_orderkey").alias("chain_id"), pos.alias("pos"), s.alias("s"), F.concat(given(s), F.lit(" بن "), given(div(s, 11))).alias("name"))


def _chains(t) -> DataFrame:
    """(chain_id, names) in the order of the lines."""
    return _lines(t).groupBy("chain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))


@query(f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY chain_id, name ORDER BY pos) AS n FROM ({LINK}))
SELECT chain_id, row_number() OVER (PARTITION BY chain_id ORDER BY pos) - 1 AS pos, name FROM x WHERE n = 1""")
def parsed_chains(t):  # C5: texts made of the names with the words of chains around them; a name counts once
    k = F.col("chain_id") % 4
    text = F.when(k == 0, F.concat(F.lit("12 - حدثنا "), F.array_join("names", " عن "), F.lit(" قال: كل شيء حلال")))
    text = text.when(k == 1, F.concat(F.lit("وبهذا الإسناد عن "), F.array_join("names", "، عن "), F.lit(" (عليه السلام)"))).when(k == 2, F.concat(F.lit("أخبرنا "), F.array_join("names", " قال حدثني "), F.lit(" جميعا")))
    text = text.otherwise(F.concat(F.lit("وعنه عن "), F.array_join("names", " عن "), F.lit(" رفعه")))
    return _chains(t).select("chain_id", F.posexplode(ch.parse(text)).alias("pos", "name"))


@query(f"SELECT chain_id, pos * 2 + 1 AS pos, 'name' AS kind, name AS token FROM ({LINK}) UNION ALL SELECT chain_id, pos * 2, 'connector', 'عن' FROM ({LINK})")
def chain_tokens(t):  # C6
    text = _chains(t).select("chain_id", F.concat(F.lit("عن "), F.array_join("names", " عن ")).alias("text"))
    return ch.tokenize(text, "chain_id", "text")


@query(f"SELECT chain_id, array_to_string(list(name ORDER BY pos), '|') AS names FROM ({LINK}) GROUP BY 1")
def chain_names(t):  # C6
    text = _chains(t).select("chain_id", F.concat(F.lit("عن "), F.array_join("names", " عن ")).alias("text"))
    return ch.names_of_tokens(ch.tokenize(text, "chain_id", "text"), "chain_id").select("chain_id", F.array_join("names", "|").alias("names"))


@query(f"""SELECT chain_id, pos, name, lag(name) OVER w AS prev_name, lead(name) OVER w AS next_name FROM ({LINK}) WINDOW w AS (PARTITION BY chain_id ORDER BY pos)""")
def chain_links(t):  # D8 W1
    return ch.links(_chains(t), "chain_id", "names")


LIFE_SQL = """CASE WHEN s % 4 = 0 THEN 40 + s % 300 END AS birth, CASE WHEN s % 3 = 0 THEN 100 + s % 290 END AS death, CASE WHEN s % 5 > 0 THEN s % 200 + 1 END AS w"""
BOUNDS_SQL = """coalesce(birth, w) AS birth_low, coalesce(death, w + 90) AS death_high, CASE WHEN birth IS NOT NULL AND death IS NOT NULL THEN 'explicit' WHEN birth IS NOT NULL OR death IS NOT NULL THEN 'explicit+window' WHEN w IS NOT NULL THEN 'tabaqah_window' ELSE 'unknown' END AS source"""
LINKED_SQL = f"""b AS (SELECT *, s % 12 + 1 AS layer, {BOUNDS_SQL} FROM (SELECT *, {LIFE_SQL} FROM ({LINK}))),
n AS (SELECT *, layer - lead(layer) OVER v AS gap, lead(death_high) OVER v AS last, lead(source) OVER v AS next_source FROM b WINDOW v AS (PARTITION BY chain_id ORDER BY pos)),
a AS MATERIALIZED (SELECT *, CASE WHEN gap >= 3 OR gap <= -2 THEN 'major' WHEN gap >= 2 OR gap <= -1 THEN 'minor' END AS severity, CASE WHEN next_source IS NULL THEN NULL WHEN source = 'unknown' OR next_source = 'unknown' OR last IS NULL OR birth_low IS NULL THEN 'unknown'
WHEN birth_low > last OR last - birth_low - 10 < 5 THEN 'impossible' WHEN last - birth_low - 10 < 10 THEN 'possible' ELSE 'certain' END AS verdict FROM n)"""


def _annotated(t) -> DataFrame:
    s = F.col("s")
    w = F.when(s % 5 > 0, (s % 200 + 1).cast("int"))
    null = F.lit(None).cast("array<int>")
    life = ch.lifetime(F.when(s % 4 == 0, (40 + s % 300).cast("int")), F.when(s % 3 == 0, (100 + s % 290).cast("int")), F.when(w.isNotNull(), F.array(w, w + 30)).otherwise(null), F.when(w.isNotNull(), F.array(w + 20, w + 90)).otherwise(null))
    return ch.annotate(_lines(t).withColumns({"tabaqah": s % 12 + 1, "life": life}))


@query(f"WITH {LINKED_SQL} SELECT chain_id, pos, source, gap, severity, verdict, CASE WHEN verdict <> 'unknown' THEN last - birth_low - 10 END AS overlap FROM a")
def annotated_links(t):  # C8 C9 W2 J20
    return _annotated(t).select("chain_id", "pos", "life.source", "gap", "severity", "verdict", F.col("overlap").cast("long").alias("overlap"))


@query(f"""WITH {LINKED_SQL} SELECT chain_id, pos, 'lifetime_gap' AS flag, 'high' AS level FROM a WHERE verdict = 'impossible' UNION ALL SELECT chain_id, pos, 'skipped_intermediary', 'medium' FROM a WHERE verdict = 'possible' AND gap >= 2""")
def hidden_gaps(t):  # C9
    return ch.tadlis_flags(_annotated(t)).select("chain_id", "pos", "flag", "level")


@query(f"WITH {LINKED_SQL} SELECT chain_id, avg(CASE WHEN s % 6 > 0 THEN 1.0 ELSE 0.0 END) AS ratio, count(severity) AS gaps FROM a GROUP BY 1")
def chain_integrity(t):  # M5 M7
    return ev.integrity(_annotated(t).withColumn("resolved", F.col("s") % 6 > 0))


#: Segments: names, and the openings of anonymous links with and without their leading word and with words behind them. The SQL reads them by its own patterns.
SEGMENTS = ["زرارة", "محمد بن مسلم", "ابان", "يونس بن حماد", "رجلة"] + [f"{head}{body.rstrip('$').removeprefix('عن ')}{tail}" for body, _, _ in ch.ANONYMOUS for head in ("عن ", "") for tail in ("", " من قم")]


def _irsal_case(field: int) -> str:
    """The type or severity of the first pattern in order that a segment begins with; a closing $ wants the segment to end there."""
    when = []
    for pattern in ch.ANONYMOUS:
        body = pattern[0].removeprefix("عن ")
        closed = body.endswith("$")
        body = body.rstrip("$")
        rest = f"regexp_replace(seg, '^عن ', '')" if pattern[0].startswith("عن ") else "seg"
        when.append(f"WHEN {rest} = '{body}'" + ("" if closed else f" OR starts_with({rest}, '{body} ')") + f" THEN '{pattern[field]}'")
    return f"CASE {' '.join(when)} END"


IRSAL_SQL = f"""x AS (SELECT chain_id, pos, {_irsal_case(1)} AS kind, {_irsal_case(2)} AS severity FROM (SELECT *, {one_sql(SEGMENTS, "s + pos * 7")} AS seg FROM ({LINK}))),
y AS (SELECT *, kind = 'MURSAL' AND (lag(kind) OVER v IS NOT NULL OR lead(kind) OVER v IS NOT NULL) AS up FROM x WINDOW v AS (PARTITION BY chain_id ORDER BY pos)),
z AS (SELECT chain_id, pos, CASE WHEN up THEN 'MUDAL' ELSE kind END AS kind, CASE WHEN up THEN 'critical' ELSE severity END AS severity FROM y),
irsal AS (SELECT chain_id, count(kind) > 0 AS has_irsal, arg_min(kind, (CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, pos)) FILTER (kind IS NOT NULL) AS irsal_type, coalesce(string_agg(pos || ':' || kind || ':' || severity, ',' ORDER BY pos) FILTER (kind IS NOT NULL), '') AS findings FROM z GROUP BY 1)"""


def _irsal(t) -> DataFrame:
    seg = _lines(t).groupBy("chain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", one(SEGMENTS, F.col("s") + F.col("pos") * 7).alias("x")))), lambda y: y["x"]).alias("segments"))
    return ch.irsal(seg)


@query(f"WITH {IRSAL_SQL} SELECT chain_id, has_irsal, irsal_type, findings FROM irsal")
def anonymous_links(t):  # C10 W4
    shown = F.transform("findings", lambda f: F.concat_ws(":", f["index"].cast("string"), f["type"], f["severity"]))
    return _irsal(t).select("chain_id", "has_irsal", "irsal_type", F.array_join(shown, ",").alias("findings"))


GRADE_SQL = f"""g0 AS (SELECT l_orderkey AS chain_id, CASE WHEN l_suppkey % 10 > 0 THEN {one_sql(STATUS, "l_suppkey")} END AS status, l_suppkey % 150 AS n, l_suppkey % 20 = 7 AS sect, l_suppkey % 17 <> 3 AS link FROM lineitem),
graded AS (SELECT chain_id, count(*) AS n_links, CASE WHEN bool_or(status IS NULL) THEN 'Undetermined' WHEN bool_or(status = 'daif') THEN 'Da''if' WHEN bool_or(status = 'majhul' OR status = 'unspecified' AND n < 100) THEN 'Majhul'
WHEN bool_or(status = 'muwaththaq' OR status <> 'thiqah' AND sect) THEN 'Muwaththaq' WHEN bool_or(status IN ('mamduh', 'hasan')) THEN 'Hasan' ELSE 'Sahih' END AS grade FROM g0 WHERE link GROUP BY 1)"""


def _graded(t) -> DataFrame:
    s = F.col("l_suppkey")
    name = F.when(s % 17 == 3, "قال ان الله يحب").otherwise(given(s))
    return ch.grade(t.lineitem.select(F.col("l_orderkey").alias("chain_id"), name.alias("name"), F.when(s % 10 > 0, one(STATUS, s)).alias("status"), (s % 150).alias("hadith_count"), F.when(s % 20 == 7, "فطحي المذهب").alias("sect")))


@query(f"WITH {GRADE_SQL} SELECT * FROM graded")
def chain_grades(t):  # A24 P9
    return _graded(t)


@query(f"""WITH {LINKED_SQL}, {IRSAL_SQL}, {GRADE_SQL}, f AS (SELECT g.*, coalesce(has_irsal, FALSE) AND grade = 'Sahih' AS marked, irsal_type, coalesce(bad, FALSE) AS bad FROM graded g LEFT JOIN irsal USING (chain_id) LEFT JOIN (SELECT chain_id, bool_or(verdict = 'impossible') AS bad FROM a GROUP BY 1) USING (chain_id))
SELECT chain_id, n_links, grade, grade || CASE WHEN marked THEN ' -> ' || irsal_type ELSE '' END || CASE WHEN bad THEN ' -> impossible link' ELSE '' END AS final FROM f""")
def final_grades(t):  # C7f C10
    return ch.downgrade(_graded(t), _annotated(t), _irsal(t)).select("chain_id", "n_links", "grade", "final")


@query(f"""WITH x AS (SELECT chain_id, pos, CASE WHEN s % 4 > 0 THEN s % 12 + 1 END AS layer FROM ({LINK})), y AS (SELECT *, lag(layer) OVER v AS p, lead(layer) OVER v AS n FROM x WINDOW v AS (PARTITION BY chain_id ORDER BY pos))
SELECT chain_id, pos, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN least(p, n) WHEN p IS NOT NULL THEN greatest(1, p - 2) ELSE n END AS low, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN greatest(p, n) WHEN p IS NOT NULL THEN p WHEN n IS NOT NULL THEN least(12, n + 2) END AS high FROM y""")
def expected_layers(t):  # C7c
    w = Window.partitionBy("chain_id").orderBy("pos")
    x = _lines(t).withColumn("layer", F.when(F.col("s") % 4 > 0, F.col("s") % 12 + 1))
    x = x.select("chain_id", "pos", ch.expected_range(F.lag("layer").over(w), F.lead("layer").over(w)).alias("r"))
    return x.select("chain_id", "pos", "r.low", "r.high")


@query(f"""WITH x AS (SELECT chain_id, pos, s, CASE s % 5 WHEN 0 THEN 'ابيه' WHEN 1 THEN 'جده' ELSE name END AS name, CASE WHEN s % 5 > 2 THEN {given_sql("s // 3")} END AS father, CASE WHEN s % 5 > 2 THEN {given_sql("s // 7")} END AS grandfather FROM ({LINK})),
y AS (SELECT *, last_value(father IGNORE NULLS) OVER v AS f, last_value(grandfather IGNORE NULLS) OVER v AS g FROM x WINDOW v AS (PARTITION BY chain_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT chain_id, pos, CASE s % 5 WHEN 0 THEN f WHEN 1 THEN g ELSE name END AS asked FROM y""")
def relatives(t):  # C7b W3
    s = F.col("s")
    x = _lines(t).withColumns({"name": F.when(s % 5 == 0, "ابيه").when(s % 5 == 1, "جده").otherwise(F.col("name")), "entry_key": F.when(s % 5 > 1, s), "virtual": s % 5 == 2, "father": given(div(s, 3)), "grandfather": given(div(s, 7))})
    return ch.fathers(x).select("chain_id", "pos", "asked")


@query(f"""WITH {LINKED_SQL} SELECT chain_id, pos, k AS entry_key FROM a, (SELECT unnest([1, 2, 3]) AS k) WHERE severity IS NOT NULL AND abs((s + 5 * k) % 12 + 1 - (layer - gap)) <= 1""")
def gap_alternatives(t):  # C12
    links = _annotated(t)
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    others = _lines(t).select("chain_id", "pos", "s", k.alias("entry_key")).select("chain_id", "pos", "entry_key", ((F.col("s") + 5 * F.col("entry_key")) % 12 + 1).alias("alt_tabaqah"))
    return ch.gap_alternatives(links, others).select("chain_id", "pos", "entry_key")


@query(f"SELECT chain_id, pos, CASE {given_sql('s')} WHEN 'علي' THEN 'IMAM_ALI' WHEN 'الحسين' THEN 'IMAM_HUSAYN' END AS virtual_key, {given_sql('s')} IN ('علي', 'الحسين') AS virtual FROM ({LINK})")
def virtual_links(t):  # C7a
    fixed = t.lineitem.sparkSession.createDataFrame([("علي", "IMAM_ALI", 2), ("الحسين", "IMAM_HUSAYN", 2)], "name string, virtual_key string, layer int")
    return mg.with_virtual(_lines(t).withColumn("name", given(F.col("s"))), fixed).select("chain_id", "pos", "virtual_key", "virtual")


@query(f"""WITH x AS (SELECT chain_id, pos, name, lead(name) OVER (PARTITION BY chain_id ORDER BY pos) AS nx FROM ({LINK})), y AS (SELECT *, {_words_sql("name")} AS a, {_words_sql("nx")} AS b FROM x)
SELECT chain_id, pos, coalesce(array_to_string(list_sort(list_intersect(a, b)), ','), '') AS repeated FROM y""")
def skipped_eyes(t):  # W10 M9
    return ev.repeated_words(_lines(t)).select("chain_id", "pos", F.array_join(F.array_sort("repeated"), ",").alias("repeated"))


# --- Records: overrides, identities, merges, layers


ENTRY_SQL = f"SELECT *, 'k' || k AS key FROM (SELECT *, CAST(k AS INTEGER) AS idx FROM ({PEOPLE}))"


def _entries(t) -> DataFrame:
    """The people with the columns that the merge operators read; identity claims link each second key with the one before it."""
    e, k = people(t), F.col("src_ord")
    empty = F.array().cast("array<string>")
    return e.withColumns(
        {
            "_entry_idx": k.cast("int"),
            "tabaqah": F.when(k % 12 + 1 <= 6, (k % 12 + 1).cast("double")),
            "tabaqah_source": F.lit(None).cast("string"),
            "same_as_entry_nums": F.when(k % 2 == 1, F.array(F.concat(F.lit("k"), (k - 1).cast("string")))).otherwise(empty),
            "grandfather": F.when(k % 10 == 0, given(k)),
            "status_detail": F.when(k % 7 == 0, "x"),
            "has_book": k % 6 == 0,
            "canonical_entry": F.lit(None).cast("string"),
        }
    )


@query(f"""WITH e AS ({ENTRY_SQL}), o AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'k' || s_suppkey WHEN s_suppkey % 3 = 0 THEN '_' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END AS ok, CAST(s_suppkey % 14 AS INTEGER) AS layer FROM supplier)
SELECT key AS entry_key, coalesce(CAST(coalesce(a.layer, b.layer) AS DOUBLE), CASE WHEN k % 12 + 1 <= 6 THEN CAST(k % 12 + 1 AS DOUBLE) END) AS tabaqah, CASE WHEN coalesce(a.layer, b.layer) IS NOT NULL THEN 'manual_override' END AS tabaqah_source
FROM e LEFT JOIN (SELECT * FROM o WHERE layer BETWEEN 1 AND 12) a ON a.ok = e.key LEFT JOIN (SELECT * FROM o WHERE layer BETWEEN 1 AND 12) b ON b.ok = CAST(e.k AS VARCHAR)""")
def overridden_layers(t):  # J6
    s = F.col("s_suppkey")
    text = s.cast("string")
    by_hand = t.supplier.select(F.when(s % 2 == 0, F.concat(F.lit("k"), text)).when(s % 3 == 0, F.concat(F.lit("_"), text)).otherwise(text).alias("key"), (s % 14).cast("int").alias("tabaqah"))
    return mg.override(_entries(t), by_hand).select("entry_key", "tabaqah", "tabaqah_source")


LINK_SQL = f"""e AS MATERIALIZED (SELECT *, {_words_sql("name_ar || ' ' || array_to_string(aliases, ' ')")} AS w, {_content_sql("name_ar")}[1] AS g FROM ({ENTRY_SQL})),
links AS (SELECT a.key AS a, b.key AS b FROM e a JOIN e b ON a.k % 2 = 1 AND b.k = a.k - 1 WHERE len(list_intersect(a.w, b.w)) >= 2 OR (len(list_intersect(a.w, b.w)) >= 1 AND a.g = b.g)
UNION SELECT 'k' || s_suppkey, 'k' || (s_suppkey + 2) FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey + 2 IN (SELECT k FROM e) AND s_suppkey IN (SELECT k FROM e)),
u AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
c AS (WITH RECURSIVE r AS (SELECT a AS node, a AS o FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.o) SELECT node, min(o) AS root, count(*) AS n FROM r GROUP BY 1),
member AS MATERIALIZED (SELECT e.key, CASE WHEN c.n IS NULL OR c.n > 6 THEN e.key ELSE c.root END AS root FROM e LEFT JOIN c ON c.node = e.key)"""


def _links(t) -> DataFrame:
    s = F.col("s_suppkey")
    trusted = t.supplier.where(s % 4 == 0).select(F.concat(F.lit("k"), s.cast("string")).alias("a"), F.concat(F.lit("k"), (s + 2).cast("string")).alias("b"))
    return mg.identity_links(_entries(t), trusted)


def _members(t) -> DataFrame:
    c = mg.clusters(_entries(t), _links(t))
    return c.join(c.groupBy("root").agg(F.min("entry_key").alias("least")), "root").select("entry_key", F.col("least").alias("root"))


@query(f"WITH {LINK_SQL} SELECT a, b FROM links")
def identity_links(t):  # G2
    return _links(t)


@query(f"WITH {LINK_SQL} SELECT key AS entry_key, root FROM member")
def identity_clusters(t):  # G1 G3
    return _members(t)


RICH_SQL = """(CASE WHEN name_ar <> '' THEN 1 ELSE 0 END) + 1 + (CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) + 1 + (CASE WHEN laqab <> '' THEN 1 ELSE 0 END) + 1 + (CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN hadith_count IS NOT NULL THEN 1 ELSE 0 END)
+ len(imams) + len(books) + len(aliases) + len(teachers_of) + len(students_of) + (CASE WHEN k % 6 = 0 THEN 2 ELSE 0 END) + (CASE WHEN status <> 'unspecified' THEN 3 ELSE 0 END)"""


@query(f"""WITH {LINK_SQL}, x AS (SELECT member.root, e.*, {RICH_SQL} AS rich FROM e JOIN member USING (key))
SELECT root, arg_max(key, (rich, key)) AS canonical, count(*) AS n, CASE WHEN arg_max(status, (rich, key)) <> 'unspecified' THEN arg_max(status, (rich, key)) ELSE coalesce(arg_min(status, k) FILTER (status <> 'unspecified'), 'unspecified') END AS status,
(bool_or(status = 'thiqah') AND (bool_or(status = 'daif') OR bool_or(status = 'majhul'))) OR (bool_or(status = 'muwaththaq') AND bool_or(status = 'daif')) AS status_conflict, FALSE AS era_conflict FROM x GROUP BY 1""")
def identities(t):  # G5 A8 A13 A21 A22 W9
    return mg.identities(_entries(t), _members(t), {"الباقر": 2})


MERGE_RANK = _rank_sql(mg.MERGE_ORDER, "st")
LISTS_SQL = {"narrates_from_imams": "imams", "narrates_from_narrators": "teachers_of", "narrated_from_by": "students_of", "books": "books"}


@query(f"""WITH {LINK_SQL}, x AS (SELECT e.*, member.root, CASE WHEN s_suppkey % 4 = 1 THEN 'hasan' WHEN s_suppkey % 4 = 2 THEN 'unspecified' WHEN s_suppkey IS NOT NULL THEN 'daif' END AS said FROM e JOIN member USING (key) LEFT JOIN supplier ON s_suppkey = k),
y AS (SELECT *, CASE WHEN said <> 'unspecified' THEN said ELSE status END AS st FROM x), z AS (SELECT *, {MERGE_RANK} AS r FROM y),
b AS (SELECT root, min(r) AS r, arg_min(st, (r, k)) AS st, arg_min(key, (r, k)) AS owner, list_sort(list_distinct(list(name_ar))) AS names, {", ".join(f"list_sort(list_distinct(flatten(list({c})))) AS {n}" for n, c in LISTS_SQL.items())} FROM z GROUP BY 1)
SELECT z.key AS entry_key, CASE WHEN b.r < z.r THEN b.st ELSE z.st END AS status, CASE WHEN b.r < z.r THEN b.owner END AS status_inherited_from, z.root AS canonical_entry,
array_to_string(list_sort(list_distinct(z.aliases || list_filter(b.names, lambda n: n <> z.name_ar))), '|') AS aliases, {", ".join(f"array_to_string(b.{n}, '|') AS {n}" for n in LISTS_SQL)} FROM z JOIN b USING (root)""")
def merged_entries(t):  # G4 U2
    s = F.col("s_suppkey")
    said = t.supplier.select(F.concat(F.lit("k"), s.cast("string")).alias("entry_key"), F.when(s % 4 == 1, "hasan").when(s % 4 == 2, "unspecified").otherwise("daif").alias("summary_status"))
    out = mg.merge(_entries(t), said, _members(t))
    return out.select("entry_key", "status", "status_inherited_from", "canonical_entry", F.array_join(F.array_sort("aliases"), "|").alias("aliases"), *[F.array_join(n, "|").alias(n) for n in LISTS_SQL])


@query(f"""WITH s AS (SELECT key, imams FROM ({ENTRY_SQL})), r AS (SELECT key, unnest(CASE WHEN substr(key, length(key)) IN ('1', '2') THEN ['الصادق (ع)', 'الرضا'] WHEN substr(key, length(key)) = '3' THEN ['الحسن بن علي العسكري'] ELSE imams END) AS name FROM s),
v AS (SELECT DISTINCT key, CASE WHEN contains(name, 'العسكري') THEN 11 WHEN contains(name, 'الباقر') THEN 4 WHEN contains(name, 'الصادق') THEN 5 ELSE 8 END AS v FROM r)
SELECT key, CAST(list_sort(list(v))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS INTEGER) AS layer, CASE WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM v GROUP BY 1""")
def authority_layers(t):  # G7 A9
    key = F.col("entry_key")
    last = F.right(key, F.lit(1))
    names = F.when(last.isin("1", "2"), F.array(F.lit("الصادق (ع)"), F.lit("الرضا"))).when(last == "3", F.array(F.lit("الحسن بن علي العسكري"))).otherwise(F.col("narrates_from_imams"))
    refs = people(t).select(key.alias("key"), F.explode(names).alias("name")).withColumn("name", tx.strip_honorific(F.col("name")))
    titles = t.customer.sparkSession.createDataFrame(list(TITLES.items()), "title string, layer int")
    return ly.seeds_from_references(refs, titles)


_KEYS = {"eastern": "translate(CAST(s_suppkey AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩')", "mixed": "CASE WHEN s_suppkey % 3 = 0 THEN translate(CAST(s_suppkey AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') ELSE CAST(s_suppkey AS VARCHAR) END", "named": "'k' || s_suppkey"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS keys, bool_or(regexp_matches(k, '[٠-٩]')) AND NOT bool_or(regexp_matches(k, '^[0-9]+$')) AS old_format FROM (SELECT {x} AS k FROM supplier)" for n, x in _KEYS.items()))
def key_format(t):  # V3
    s = F.col("s_suppkey")
    plain, eastern = s.cast("string"), F.translate(s.cast("string"), tx.WESTERN, tx.EASTERN)
    keys = {"eastern": eastern, "mixed": F.when(s % 3 == 0, eastern).otherwise(plain), "named": F.concat(F.lit("k"), plain)}
    out = [mg.old_keys(t.supplier.select(c.alias("entry_key"))).select(F.lit(n).alias("keys"), "old_format") for n, c in keys.items()]
    return out[0].union(out[1]).union(out[2])


# --- Rules and validation


@query(f"""WITH e AS ({ENTRY_SQL}), q AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 2 = 0 THEN 'ابو ' || {given_sql("s_suppkey")} ELSE {given_sql("s_suppkey")} END AS kunya FROM supplier)
SELECT DISTINCT query_id, key AS entry_key FROM q JOIN e ON e.kunyah = q.kunya OR (len(e.aliases) > 0 AND string_split(e.aliases[1], ' ')[1] = q.kunya)""")
def kunya_candidates(t):  # J19
    s = F.col("s_suppkey")
    asked_for = t.supplier.select(s.alias("query_id"), F.when(s % 2 == 0, F.concat(F.lit("ابو "), given(s))).otherwise(given(s)).alias("kunya"))
    return ev.kunya_candidates(asked_for, people(t))


@query("""WITH x AS (SELECT o_custkey AS query_id, l_suppkey AS s, any_value(l_suppkey % 12 + 1) AS layer, any_value(o_custkey % 10 + 1) AS low FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
y AS (SELECT *, layer BETWEEN low - 1 AND low + 3 AS fits, s % 11 = 0 AS broken FROM x),
z AS (SELECT query_id, s, CASE WHEN s % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN s % 5 = 0 THEN 5 ELSE 0 END + CASE WHEN s % 7 = 0 THEN 3 ELSE 0 END + CASE WHEN fits THEN 2 ELSE 0 END + CASE WHEN s % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN s % 4 = 0 THEN 1 ELSE 0 END AS score FROM y WHERE fits AND NOT broken),
r AS (SELECT *, lead(score) OVER w AS runner_up, row_number() OVER w AS n FROM z WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, s))
SELECT q.query_id, s AS entry_key, score, runner_up, CASE WHEN s IS NULL THEN 'none' WHEN runner_up IS NOT NULL AND score - runner_up < 2 THEN 'ambiguous' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT DISTINCT query_id FROM x) q LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (query_id)""")
def kunya_scores(t):  # C11
    met = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query_id"), F.col("l_suppkey").alias("entry_key")).distinct()
    s, low = F.col("entry_key"), F.col("query_id") % 10 + 1
    verdicts = F.when(s % 11 == 0, F.array(F.lit("impossible"))).when(s % 2 == 0, F.array(F.lit("certain"), F.lit("tight"), F.lit("unknown"))).otherwise(F.array(F.lit("tight")))
    return ev.kunya_score(met.withColumns({"knows_student": s % 3 == 0, "knows_teacher": s % 5 == 0, "imam": s % 7 == 0, "tabaqah": s % 12 + 1, "low": low, "high": low + 2, "verdicts": verdicts, "book_custom": s % 4 == 0}))


@query(f"""WITH e AS ({ENTRY_SQL}) SELECT 'layer' AS evidence, key FROM e WHERE abs(tabaqah - 5) <= 1 UNION ALL SELECT 'teacher', key FROM e WHERE list_contains(teachers_of, 'علي بن محمد') UNION ALL SELECT 'part', key FROM e WHERE contains(name_ar, 'جعفر') OR contains(nisba, 'جعفر')
UNION ALL SELECT 'period', key FROM e WHERE NOT (k % 300 + 60 < 100 OR coalesce(k % 300 > 200, FALSE)) UNION ALL SELECT 'count', key FROM e WHERE coalesce(hadith_count, 0) >= 100""")
def identified_by(t):  # M1 M2 J21
    e = people(t).withColumns({"birth": F.col("src_ord") % 300, "death": F.col("src_ord") % 300 + 60})
    found = [("layer", ev.by_layer(e, F.lit(5))), ("teacher", ev.by_listed(e, "narrates_from_narrators", F.lit("علي بن محمد"))), ("part", ev.by_part(e, ["name_ar", "nisba"], "جعفر")), ("period", ev.by_period(e, 100, 200)), ("count", ev.by_count(e, 100))]
    out = [df.select(F.lit(kind).alias("evidence"), F.col("entry_key").alias("key")) for kind, df in found]
    return out[0].union(out[1]).union(out[2]).union(out[3]).union(out[4])


@query(f"""WITH e AS ({ENTRY_SQL}), good AS (SELECT DISTINCT {_name_sql("s_suppkey", "s_suppkey + 1")} AS n FROM supplier WHERE s_suppkey % 3 > 0),
v AS (SELECT key, 'imam' AS kind, 3.0 AS w FROM e WHERE k % 8 = 0 UNION ALL SELECT key, 'consensus', 2.5 FROM e WHERE k % 20 = 0 UNION ALL SELECT key, 'principle', 2.0 FROM e WHERE len(list_intersect(students_of, ['محمد بن احمد'])) > 0 UNION ALL SELECT key, 'count', 1.5 FROM e WHERE hadith_count >= 100
UNION ALL SELECT key, 'teachers', 2.0 FROM e WHERE teachers_of[1] IN (SELECT n FROM good) UNION ALL SELECT key, 'students', 1.5 FROM e WHERE students_of[1] IN (SELECT n FROM good)), s AS (SELECT key, count(DISTINCT kind) AS kinds, CAST(sum(w) AS DOUBLE) AS total FROM v GROUP BY 1)
SELECT key AS entry_key, kinds, total, CASE WHEN total >= 10 THEN 'very strong' WHEN total >= 6 THEN 'strong' WHEN total >= 3 THEN 'moderate' WHEN total >= 1 THEN 'weak' ELSE 'insufficient' END AS label FROM s""")
def reliability(t):  # M6 A23 N39
    e = people(t)
    entries = e.select("entry_key", F.col("narrates_from_narrators").alias("teachers"), F.col("narrated_from_by").alias("students"), "hadith_count")
    s = F.col("s_suppkey")
    statuses = t.supplier.select(F.concat(given(s), F.lit(" بن "), given(s + 1)).alias("name"), F.when(s % 3 > 0, "thiqah").otherwise("daif").alias("status"))
    witnesses = e.where("src_ord % 8 = 0").select("entry_key", F.lit("imam").alias("kind")).union(e.where("src_ord % 20 = 0").select("entry_key", F.lit("consensus")))
    return ev.reliability(entries, statuses, witnesses, ["محمد بن احمد"])


@query("""SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN (CASE WHEN d.n_chars >= 200 THEN 1 ELSE 0 END) IS NOT DISTINCT FROM l.quality THEN 'match' ELSE 'wrong' END AS verdict,
CASE WHEN d.doc_id IS NOT NULL AND (CASE WHEN d.n_chars >= 200 THEN 1 ELSE 0 END) IS DISTINCT FROM l.quality THEN l.quality END AS correction FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def validated_statuses(t):  # V1 V2 A16
    kind = t.labels.schema["quality"].dataType
    ours = t.documents.select("doc_id", F.when(F.col("n_chars") >= 200, 1).otherwise(0).cast(kind).alias("ours"))
    return ev.validate(ours, t.labels, "doc_id", "ours", "quality")


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def last_events(t):  # W8
    return wn.keep_last(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT doc_id, i, coalesce(array_to_string(list_filter([lead(line, 1) OVER w, lead(line, 2) OVER w], lambda x: x IS NOT NULL), '|'), '') AS ahead FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS i FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY i)")
def lines_ahead(t):  # X6 W7
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return mg.look_ahead(lines, "doc_id", "i", "line", 2).select("doc_id", "i", F.array_join("ahead", "|").alias("ahead"))


@query("""WITH x AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS text FROM x WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''""")
def unfolded_trees(t):  # S13
    nodes = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("text"))).alias("n"))
    return mg.unfold(nodes.select("conv_id", F.to_json("n").alias("tree")), "conv_id", "tree")


@query("""WITH w AS (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o, o_orderpriority AS k FROM orders) SELECT g, o, o * 10 AS place FROM w""")
def monotone_matches(t):  # X25
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = t.orders.select(F.col("o_custkey").alias("g"), F.row_number().over(w).cast("long").alias("o"), F.col("o_orderpriority").alias("k"))
    return scan.monotone_match(rows, rows.select("g", (F.col("o") * 10).alias("place"), "k"), "g", "o", "k", "place")


@query("""WITH x AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, i, 100 + i AS repaired FROM x""")
def repaired_numbers(t):  # W5: each fourth number is lost, the ends of a customer's rows are whole
    w = Window.partitionBy("o_custkey")
    x = t.orders.select("o_custkey", F.row_number().over(w.orderBy("o_orderkey")).alias("i"), F.count("*").over(w).alias("n"))
    broken = (F.col("i") % 4 == 0) & (F.col("i") < F.col("n"))
    x = x.withColumn("number", F.when(broken, 0).otherwise(100 + F.col("i")).cast("int"))
    return scan.repair_numbers(x, ["o_custkey"], ["i"], "number").select("o_custkey", "i", "repaired")


# --- Whole chains and two books


ESTIMATE_SQL = f"""{INDEX_SQL},
first_of AS (SELECT form, arg_min(e.tabaqah, e.k) AS layer FROM i JOIN e USING (entry_key) GROUP BY 1),
votes AS (SELECT entry_key, 5 AS v, 2.0 AS w FROM e WHERE len(imams) > 0 UNION ALL SELECT entry_key, layer + 1, 1.0 FROM (SELECT entry_key, unnest(teachers_of) AS form FROM e) JOIN first_of USING (form)),
sums AS (SELECT entry_key, v, sum(w) AS w FROM votes GROUP BY 1, 2), upto AS (SELECT *, sum(w) OVER (PARTITION BY entry_key ORDER BY v) AS u, sum(w) OVER (PARTITION BY entry_key) AS total FROM sums),
own AS MATERIALIZED (SELECT entry_key, min(v) AS layer FROM upto WHERE u * 2 >= total GROUP BY 1)"""


@query(f"""WITH {ESTIMATE_SQL}, q AS (SELECT DISTINCT {_name_sql("s_suppkey", "s_suppkey // 3")} AS name FROM supplier), g AS (SELECT name, name AS form FROM q UNION ALL SELECT name, CASE WHEN starts_with(name, 'ال') THEN substr(name, 3) ELSE 'ال' || name END FROM q),
c AS (SELECT DISTINCT name, i.entry_key FROM g JOIN i USING (form)), x AS (SELECT name, layer, sum(CASE WHEN coalesce(hadith_count, 0) = 0 THEN 1 ELSE hadith_count END) AS w FROM c JOIN own USING (entry_key) JOIN e USING (entry_key) GROUP BY 1, 2),
y AS (SELECT *, sum(w) OVER (PARTITION BY name ORDER BY layer) AS u, sum(w) OVER (PARTITION BY name) AS total FROM x) SELECT name, CAST(min(layer) AS DOUBLE) AS layer FROM y WHERE u * 2 >= total GROUP BY 1""")
def estimated_layers(t):  # C7d A11
    s = F.col("s_suppkey")
    names = t.supplier.select(F.concat(given(s), F.lit(" بن "), given(div(s, 3))).alias("name"))
    return an.estimate_layers(names, _index(t), people(t), {"الباقر": 4})


@query(f"""WITH x AS (SELECT chain_id, pos, CASE WHEN s % 9 = 0 THEN 'عمن رواه' ELSE name END AS name, s % 12 + 1 AS layer, lead(s % 12 + 1) OVER (PARTITION BY chain_id ORDER BY pos) AS nl FROM ({LINK}))
SELECT chain_id, pos, CASE WHEN name = 'عمن رواه' THEN 'mursal' WHEN layer - nl >= 3 THEN 'mursal' WHEN layer - nl = 2 THEN 'munqati' WHEN layer - nl <= -2 THEN 'mudal' END AS irsal_type FROM x""")
def gap_types(t):  # C7e
    layer = F.col("s") % 12 + 1
    w = Window.partitionBy("chain_id").orderBy("pos")
    name = F.when(F.col("s") % 9 == 0, "عمن رواه").otherwise(F.col("name"))
    return _lines(t).select("chain_id", "pos", an.gap_type(name, layer, F.lead(layer).over(w)).alias("irsal_type"))


_GUESS = f"""guess AS MATERIALIZED (WITH q AS (SELECT DISTINCT n AS name FROM (SELECT unnest([n0, n1, n2]) AS n FROM ch) WHERE n <> 'الباقر'), g AS (SELECT name, name AS form FROM q UNION ALL SELECT name, CASE WHEN starts_with(name, 'ال') THEN substr(name, 3) ELSE 'ال' || name END FROM q),
c AS (SELECT DISTINCT name, i.entry_key FROM g JOIN i USING (form)), x AS (SELECT name, layer, sum(CASE WHEN coalesce(hadith_count, 0) = 0 THEN 1 ELSE hadith_count END) AS w FROM c JOIN own USING (entry_key) JOIN e USING (entry_key) GROUP BY 1, 2),
y AS (SELECT *, sum(w) OVER (PARTITION BY name ORDER BY layer) AS u, sum(w) OVER (PARTITION BY name) AS total FROM x) SELECT name, CAST(min(layer) AS DOUBLE) AS layer FROM y WHERE u * 2 >= total GROUP BY 1)"""


def _place_sql(p: int) -> str:
    """CTEs of a chain's place: a{p}, what is asked there and within which layers, and d{p}, the chain with what was found, from the place before."""
    before = f"d{p - 1}" if p else "start"
    body = RESOLVE_SQL.split(f"{INDEX_SQL},\n", 1)[1].replace(f"({ASKED})", f"(SELECT chain_id AS query_id, asked AS name, teacher, student, '' AS book, low, high FROM a{p} WHERE v IS NULL AND asked IS NOT NULL)")
    body = body.replace("q.low, e.name_ar", "q.low, q.high, e.name_ar").replace("tabaqah - low - 2", "tabaqah - high")
    body = body[: body.rindex("SELECT query_id, canonical_key")] + "SELECT query_id, entry_key FROM o WHERE rank = 1"
    span = "CASE WHEN prev IS NOT NULL AND nxt IS NOT NULL THEN {both} WHEN prev IS NOT NULL THEN {before} WHEN nxt IS NOT NULL THEN {behind} END"
    low, high = span.format(both="least(prev, nxt)", before="greatest(1, prev - 2)", behind="nxt"), span.format(both="greatest(prev, nxt)", before="prev", behind="least(12, nxt + 2)")
    return f"""l{p} AS (SELECT chain_id, n{p} AS name, CASE WHEN n{p} = 'ابيه' THEN dad ELSE n{p} END AS asked, v{p} AS v, {f"n{p + 1}" if p < 2 else "NULL"} AS teacher, {f"n{p - 1}" if p else "NULL"} AS student, prev, {f"coalesce(v{p + 1}, g{p + 1})" if p < 2 else "CAST(NULL AS DOUBLE)"} AS nxt, dad FROM ch JOIN {before} USING (chain_id)),
a{p} AS MATERIALIZED (SELECT *, {low} AS low, {high} AS high FROM l{p}), r{p} AS MATERIALIZED ({"WITH " + body}),
f{p} AS MATERIALIZED (SELECT a{p}.*, r{p}.entry_key, coalesce(v, e.tabaqah) AS layer, CASE WHEN r{p}.entry_key IS NOT NULL THEN e.father ELSE dad END AS next_dad FROM a{p} LEFT JOIN r{p} ON query_id = chain_id LEFT JOIN e ON e.entry_key = r{p}.entry_key),
d{p} AS (SELECT chain_id, CAST(layer AS DOUBLE) AS prev, next_dad AS dad FROM f{p})"""


ANALYSED_SQL = f"""WITH {ESTIMATE_SQL}, names AS (SELECT s_suppkey AS chain_id, {_name_sql("s_suppkey", "s_suppkey // 3")} AS n0, CASE WHEN s_suppkey % 3 = 0 THEN 'ابيه' ELSE {_name_sql("s_suppkey + 1", "s_suppkey + 2")} END AS n1, CASE WHEN s_suppkey % 2 = 0 THEN 'الباقر' ELSE {_name_sql("s_suppkey + 2", "s_suppkey")} END AS n2 FROM supplier),
ch0 AS (SELECT chain_id, n0, n1, n2 FROM names), {_GUESS.replace("FROM ch)", "FROM ch0)")},
ch AS MATERIALIZED (SELECT ch0.*, CAST(NULL AS DOUBLE) AS v0, CAST(NULL AS DOUBLE) AS v1, CASE WHEN n2 = 'الباقر' THEN 4.0 END AS v2, x.layer AS g0, y.layer AS g1, z.layer AS g2 FROM ch0 LEFT JOIN guess x ON x.name = n0 LEFT JOIN guess y ON y.name = n1 LEFT JOIN guess z ON z.name = n2),
start AS (SELECT chain_id, CAST(NULL AS DOUBLE) AS prev, CAST(NULL AS VARCHAR) AS dad FROM ch0), {_place_sql(0)}, {_place_sql(1)}, {_place_sql(2)}
""" + " UNION ALL ".join(
    f"SELECT chain_id, {p} AS pos, name, asked, CASE WHEN v IS NOT NULL THEN 'IMAM_BAQIR' END AS virtual_key, entry_key, CAST(layer AS DOUBLE) AS layer, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CASE WHEN layer - nxt >= 3 THEN 'mursal' WHEN layer - nxt = 2 THEN 'munqati' WHEN layer - nxt <= -2 THEN 'mudal' END AS irsal_type FROM f{p}" for p in range(3)
)


@query(ANALYSED_SQL)
def analysed_chains(t):  # C7 C7a C7b C7c C7e M5: place by place, for each link's layers depend on how the one before was resolved
    s = F.col("s_suppkey")
    name = lambda a, b: F.concat(given(a), F.lit(" بن "), given(b))
    chains = t.supplier.select(s.alias("chain_id"), F.array(name(s, div(s, 3)), F.when(s % 3 == 0, "ابيه").otherwise(name(s + 1, s + 2)), F.when(s % 2 == 0, "الباقر").otherwise(name(s + 2, s))).alias("names"))
    fixed = t.supplier.sparkSession.createDataFrame([("الباقر", "IMAM_BAQIR", 4.0)], "name string, virtual_key string, layer double")
    entries = people(t).withColumn("grandfather", given(F.col("src_ord")))
    return an.analyse_chains(chains, _index(t), entries, fixed, {"الباقر": 4})


@query(f"""WITH s AS (SELECT s_suppkey AS number, {_name_sql("s_suppkey", "s_suppkey // 11")} AS n FROM supplier), m AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey AS ord, CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 3 END AS number, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 3 END, c_custkey + 1) AS spot, {_name_sql("c_custkey", "c_custkey // 7")} AS m FROM customer),
a AS (SELECT s.number, arg_min(key, (abs(spot - s.number), ord)) AS key FROM s JOIN m ON n = m GROUP BY 1),
b AS (SELECT s.number, arg_min(key, ord) AS key FROM s JOIN m ON m.number = s.number WHERE len(list_intersect(list_filter(string_split(n, ' '), lambda w: w <> 'بن'), list_filter(string_split(m, ' '), lambda w: w <> 'بن'))) > 0 GROUP BY 1)
SELECT s.number, coalesce(a.key, b.key) AS key FROM s LEFT JOIN a USING (number) LEFT JOIN b USING (number) WHERE coalesce(a.key, b.key) IS NOT NULL""")
def summary_map(t):  # J8
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    name = lambda a, b: F.concat(given(a), F.lit(" بن "), given(b))
    main = t.customer.select(c.cast("string").alias("key"), c.alias("ord"), F.when(c % 2 == 0, div(c, 3)).alias("number"), name(c, div(c, 7)).alias("name"))
    return an.map_summary(t.supplier.select(s.alias("number"), name(s, div(s, 11)).alias("name")), main)


@query(f"""WITH q AS (SELECT s_suppkey AS query_id, {_name_sql("s_suppkey", "s_suppkey + 1")} AS name, unnest([s_suppkey * 9, s_suppkey * 9 + 3]) AS number FROM supplier), e AS (SELECT 'k' || c_custkey AS entry_key, c_custkey AS n, {_name_sql("c_custkey + c_custkey // 9 * 3", "c_custkey")} AS en FROM customer),
x AS (SELECT query_id, number, entry_key, {_content_sql("name")} AS qc, {_words_sql("name")} AS aw, {_content_sql("en")} AS ec, {_words_sql("en")} AS bw FROM q JOIN e ON abs(n - number) <= 2),
y AS (SELECT query_id, number, entry_key, CASE WHEN qc[1] = ec[1] THEN len(list_filter(aw, lambda a: len(list_filter(bw, lambda b: {MATCH})) > 0)) / len(aw) ELSE 0 END AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id, number ORDER BY score DESC, entry_key DESC) AS r FROM y WHERE score > 0), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, entry_key ORDER BY number) AS f FROM z WHERE r = 1 AND score >= 0.75)
SELECT query_id, number, entry_key, round(score, 6) AS score FROM b WHERE f = 1""")
def matched_numbers(t):  # J9
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    name = lambda a, b: F.concat(given(a), F.lit(" بن "), given(b))
    q = t.supplier.select(s.alias("query_id"), name(s, s + 1).alias("name"), F.explode(F.array(s * 9, s * 9 + 3)).alias("number"))
    e = t.customer.select(F.concat(F.lit("k"), c.cast("string")).alias("entry_key"), c.alias("e_number"), name(c + div(c, 9) * 3, c).alias("e_name"))
    return an.match_numbers(q, e).withColumn("score", F.round("score", 6))


@query(f"""WITH q AS (SELECT s_suppkey AS query_id, [{_name_sql("s_suppkey", "s_suppkey // 3")}, {given_sql("s_suppkey + 5")}] AS qn FROM supplier), e AS (SELECT entry_key, k, [name_ar] || aliases AS en FROM ({PEOPLE})),
w AS (SELECT query_id, entry_key, k, qn, en, len(list_intersect(flatten(list_transform(qn, lambda x: string_split(x, ' '))), flatten(list_transform(en, lambda x: string_split(x, ' '))))) AS shared FROM q, e),
s AS (SELECT query_id, entry_key, k, shared + 5 * len(list_filter(qn, lambda x: len(list_filter(en, lambda y: contains(y, x))) > 0)) AS score FROM w WHERE shared > 0)
SELECT query_id, entry_key, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k, entry_key) AS r FROM s) WHERE r <= 25""")
def boosted_candidates(t):  # J11
    s = F.col("s_suppkey")
    q = t.supplier.select(s.alias("query_id"), F.array(F.concat(given(s), F.lit(" بن "), given(div(s, 3))), given(s + 5)).alias("names"))
    e = people(t).select("entry_key", F.col("src_ord").alias("ord"), F.concat(F.array("name_ar"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"))
    return an.boosted_overlap(q, e)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS i FROM documents),
p AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '[0-9]') THEN regexp_extract(line, '[0-9]+') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS page FROM l),
f AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '')
SELECT p.doc_id, p.i, p.page, coalesce((SELECT string_agg(f.line, '|' ORDER BY f.i) FROM f WHERE f.doc_id = p.doc_id AND f.n BETWEEN (SELECT max(n) FROM f g WHERE g.doc_id = p.doc_id AND g.i < p.i) - 2 AND (SELECT max(n) FROM f g WHERE g.doc_id = p.doc_id AND g.i < p.i)), '') AS before
FROM p WHERE regexp_matches(p.line, 'icense')""")
def stated_opinions(t):  # W7 X24
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    page = F.when(F.col("line").rlike("[0-9]"), F.regexp_extract("line", "[0-9]+", 0))
    return an.opinions(lines, "doc_id", "i", "line", page, F.col("line").rlike("icense")).select("doc_id", "i", "page", F.array_join("before", "|").alias("before"))


@query("""WITH k AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), x AS (SELECT *, lead(p) OVER (PARTITION BY s ORDER BY p) AS nx FROM k)
SELECT s, p + i AS number, 'text ' || i AS text FROM (SELECT s, p, nx, unnest([1, 2, 3]) AS i FROM x WHERE nx > p + 1) WHERE p + i < nx""")
def filled_gaps(t):  # X23
    gaps = wn.gap_ranges(t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")), ["s"], "p")
    found = gaps.select("s", "low", F.posexplode(F.array(*[F.lit(f"text {i}") for i in (1, 2, 3)])).alias("ord", "text"))
    return an.fill_gaps(gaps, found, "s")


@query(f"SELECT count(*) FILTER (k % 3 = 0) AS cleared, (SELECT count(*) FROM customer WHERE c_custkey % 3 > 0) AS kept FROM ({PEOPLE})")
def cleared_layers(t):  # A26 P1
    e = people(t).withColumn("tabaqah_source", F.when(F.col("src_ord") % 3 == 0, "inferred_network").otherwise("alf_rajul"))
    cleared, counted = an.clear_inferred(e)
    return counted.withColumn("j", F.lit(1)).join(cleared.agg(F.count("tabaqah").alias("kept")).withColumn("j", F.lit(1)), "j").drop("j")


def _three_sql(k: str) -> str:
    return f"{given_sql(k)} || ' بن ' || {given_sql(f'({k}) // 11')} || ' بن ' || {given_sql(f'({k}) // 121')}"


@query(f"""WITH p AS MATERIALIZED (SELECT s_suppkey AS k, {_three_sql("s_suppkey")} AS name, {_three_sql("s_suppkey + 1")} AS teacher_name FROM supplier), u AS (SELECT name, min(k) AS k FROM p GROUP BY 1 HAVING count(*) = 1),
e AS MATERIALIZED (SELECT DISTINCT 's' || u.k AS teacher, 's' || p.k AS student FROM p JOIN u ON u.name = p.teacher_name),
a AS MATERIALIZED (SELECT 's' || k AS key, CASE WHEN k % 13 = 0 THEN 's' || (k - 1) ELSE 's' || k END AS canonical, CASE WHEN k % 10 = 0 THEN k % 12 + 1 WHEN k % 17 = 0 THEN 5 END AS layer FROM p),
s0 AS MATERIALIZED (SELECT key, layer FROM a WHERE key = canonical), {', '.join(map(_round_sql, range(1, 11)))}
SELECT a.key, CAST(coalesce(o.layer, c.layer) AS INTEGER) AS layer, CASE WHEN o.layer IS NOT NULL THEN 'own' WHEN c.layer IS NOT NULL THEN 'alias' END AS source FROM a LEFT JOIN s10 o ON o.key = a.key LEFT JOIN s10 c ON c.key = a.canonical""")
def inferred_layers(t):  # G11 G12
    k = F.col("s_suppkey")
    name = lambda x: F.concat(given(x), F.lit(" بن "), given(div(x, 11)), F.lit(" بن "), given(div(x, 121)))
    empty = F.array().cast("array<string>")
    key = F.concat(F.lit("s"), k.cast("string"))
    e = t.supplier.select(
        key.alias("entry_key"),
        name(k).alias("name_ar"),
        F.when(k % 13 == 0, F.concat(F.lit("s"), (k - 1).cast("string"))).alias("canonical_entry"),
        F.when(k % 17 == 0, F.array(F.lit("الصادق (ع)"))).otherwise(empty).alias("narrates_from_imams"),
        F.array(name(k + 1)).alias("narrates_from_narrators"),
        empty.alias("narrated_from_by"),
    )
    seeds = t.supplier.where(k % 10 == 0).select(key.alias("key"), (k % 12 + 1).cast("int").alias("layer"))
    titles = t.supplier.sparkSession.createDataFrame(list(TITLES.items()), "title string, layer int")
    return mg.infer_layers(e, seeds, titles)
