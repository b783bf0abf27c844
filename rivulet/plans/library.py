"""Queries of books by lines, verdicts in full, versions, samples and the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import books as bk
from ..sources import readers as rd
from ..sources.scratch import scratch_path
from .catalogue import query
from .people import ANALYSED_SQL, _index, _name_sql, div, given, given_sql, one, people
from .texts import CORES, _has, eastern, eastern_sql, name, pick_sql

TOLD = {"reliable": "ثقة عين", "alone": "ثقة", "very weak": "ضعيف جداً", "weak": "ضعيف", "muwaththaq": "موثق", "mamduh": "ممدوح", "hasan": "من الحسان", "good": "حسن", "majhul": "مجهول"}
_RULES = [("reliable", "thiqah", "NOT negated"), ("alone", "thiqah", "NOT negated"), ("very weak", "daif", "TRUE"), ("weak", "daif", "NOT path"), ("muwaththaq", "muwaththaq", "TRUE"), ("mamduh", "mamduh", "TRUE"), ("hasan", "hasan", "TRUE"), ("good", "hasan", "TRUE"), ("majhul", "majhul", "TRUE")]


def _rule_sql(value) -> str:
    return "CASE " + " ".join(f"WHEN {_has(kind)} AND {free} THEN '{value(kind, status)}'" for kind, status, free in _RULES) + " END"


@query(f"""WITH x AS (SELECT c_custkey AS k, {pick_sql([c for _, c in CORES], "c_custkey")} AS c1, {pick_sql([c for _, c in CORES], "c_custkey // 10")} AS c2, c_custkey // 100 % 2 = 1 AS negated, c_custkey // 200 % 2 = 1 AS path FROM customer)
SELECT k AS c_custkey, coalesce({_rule_sql(lambda kind, status: status)}, 'unspecified') AS status, {_rule_sql(lambda kind, status: TOLD[kind])} AS detail,
array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN 'النجاشي' END, CASE WHEN k % 7 = 0 THEN 'الشيخ الطوسي' END, CASE WHEN k % 5 = 0 THEN 'الوحيد' END], lambda y: y IS NOT NULL), ',') AS sources FROM x""")
def verdict_details(t):  # X7: the words of the rule that decides, and who is cited
    k = F.col("c_custkey")
    core = lambda c: one([x for x, _ in CORES], c)
    told = F.concat(F.when(k % 5 == 0, " قاله الوحيد").otherwise(""), F.when(k % 7 == 0, " وثقه الشيخ").otherwise(""), F.when(k % 3 == 0, " قال النجاشي").otherwise(""))
    text = F.concat(given(k), F.lit(" - "), F.when(div(k, 200) % 2 == 1, "في طريق الصدوق اليه ").otherwise(""), core(k), F.lit(" - "), F.when(div(k, 100) % 2 == 1, "لم تثبت وثاقته - ").otherwise(""), core(div(k, 10)), F.lit(" ."), told)
    return t.customer.select("c_custkey", bk.verdict_fields(text).alias("v")).select("c_custkey", "v.status", "v.detail", F.array_join("v.sources", ",").alias("sources"))


@query("SELECT 1 AS version, count(*) AS n, sum(p_size) AS size FROM part WHERE p_size <= 25 UNION ALL SELECT 2, count(*), sum(p_size) FROM part UNION ALL SELECT 3, count(*), sum(p_size) FROM part WHERE p_size <= 25")
def restored_versions(t):  # S17: two versions, the first restored as a third, each read as it was
    spark = t.part.sparkSession
    path = scratch_path(spark)
    rd.store_version(t.part.where("p_size <= 25"), path, 1)
    rd.store_version(t.part, path, 2)
    rd.restore(spark, path, 1)
    out = [rd.read_version(spark, path, v).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.sum("p_size").alias("size")) for v in (1, 2, None)[:2]]
    newest = rd.read_version(spark, path).agg(F.lit(rd.versions(spark, path)[-1]).alias("version"), F.count("*").alias("n"), F.sum("p_size").alias("size"))
    return out[0].union(out[1]).union(newest)


@query("SELECT p_partkey, p_name FROM part ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 40")
def picked_sample(t):  # O7
    return rd.pick_random(t.part.select("p_partkey", "p_name"), 40, 7, "p_partkey")


def _book(t):
    k = F.col("c_custkey")
    return t.customer.select(F.concat(F.lit("f"), (k % 3).cast("string")).alias("file"), k.alias("line_no"), F.concat((k % 700).cast("string"), F.lit(" - "), given(k), F.lit(" بن "), given(div(k, 11)), F.when(k % 2 == 0, " الكوفي").otherwise(""), F.lit(" :")).alias("line"))


_BOOK_SQL = f"h AS (SELECT 'f' || c_custkey % 3 AS f, c_custkey AS k, c_custkey % 700 AS number, {_name_sql('c_custkey', 'c_custkey // 11')} || CASE WHEN c_custkey % 2 = 0 THEN ' الكوفي' ELSE '' END AS name FROM customer WHERE c_custkey % 700 >= 10)"


@query(f"WITH {_BOOK_SQL}, n AS (SELECT number, arg_min(name, (f, k)) AS name FROM h GROUP BY 1) SELECT DISTINCT h.number, n.name, h.name AS form FROM h JOIN n USING (number)")
def book_headers(t):  # X26
    return bk.header_index(_book(t))


@query(f"""WITH {_BOOK_SQL}, q AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 2 = 0 THEN {_name_sql("s_suppkey", "s_suppkey // 3")} ELSE {given_sql("s_suppkey")} || ' ' || {given_sql("s_suppkey // 3")} END AS name FROM supplier),
x AS (SELECT DISTINCT query_id, number, TRUE AS exact FROM q JOIN h USING (name))
SELECT * FROM x UNION ALL SELECT DISTINCT query_id, number, FALSE FROM q JOIN h ON list_has_all(string_split(h.name, ' '), string_split(q.name, ' ')) WHERE query_id NOT IN (SELECT query_id FROM x)""")
def found_in_books(t):  # X26: the header's name, else a header with all words
    s = F.col("s_suppkey")
    names = t.supplier.select(s.alias("query_id"), F.when(s % 2 == 0, name(s, div(s, 3))).otherwise(F.concat(given(s), F.lit(" "), given(div(s, 3)))).alias("name"))
    return bk.find_in_books(names, bk.header_index(_book(t)))


def _pages(t, blocks):
    """(file, line_no, line) of four texts; ``blocks`` are the lines of a customer."""
    k = F.col("c_custkey")
    return t.customer.select(F.concat(F.lit("f"), (k % 4).cast("string")).alias("file"), k.alias("k"), F.posexplode(F.array(*blocks)).alias("i", "line")).select("file", (F.col("k") * 10 + F.col("i")).alias("line_no"), "line").where("line is not null")


@query(f"""SELECT 'f' || c_custkey % 4 AS file, CAST(c_custkey + 1 AS INTEGER) AS number, {_name_sql("c_custkey", "c_custkey // 11")} || CASE WHEN c_custkey % 3 = 0 THEN ' من ' || {given_sql("c_custkey + 2")} ELSE '' END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'ثقة' ELSE '' END AS grade_text,
{eastern_sql("c_custkey + 1")} || CASE WHEN c_custkey % 5 = 0 THEN ' – ' ELSE ' - ' END || {_name_sql("c_custkey", "c_custkey // 11")} || CASE WHEN c_custkey % 2 = 0 THEN ' : ثقة' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN ' من ' || {given_sql("c_custkey + 2")} ELSE '' END AS raw FROM customer""")
def ocr_pages(t):  # X9: numbered entries of recognised pages, with continuations and blank lines
    k = F.col("c_custkey")
    head = F.concat(eastern(k + 1), F.when(k % 5 == 0, " – ").otherwise(" - "), name(k, div(k, 11)), F.when(k % 2 == 0, " : ثقة").otherwise(""))
    return bk.ocr_entries(_pages(t, [head, F.lit("  "), F.when(k % 3 == 0, F.concat(F.lit("  من "), given(k + 2)))]))


@query(f"""WITH x AS (SELECT c_custkey AS k, 'f' || c_custkey % 4 AS file FROM customer WHERE c_custkey >= 40)
SELECT file, CAST(k AS VARCHAR) AS najaf, CAST(k + 1 AS VARCHAR) AS beirut, {eastern_sql("k + 2")} AS tehran, {_name_sql("k", "k // 11")} AS name,
k || ' - ' || (k + 1) || ' - ' || {eastern_sql("k + 2")} || ' - ' || {_name_sql("k", "k // 11")} || ' : روى' || CASE WHEN k % 3 = 0 THEN ' عن ' || {given_sql("k + 2")} ELSE '' END AS text FROM x""")
def summary_book(t):  # X5: behind the line at which the book begins; pages and notes are no text
    k = F.col("c_custkey")
    head = F.concat(k.cast("string"), F.lit(" - "), (k + 1).cast("string"), F.lit(" - "), eastern(k + 2), F.lit(" - "), name(k, div(k, 11)), F.lit(" : روى"))
    lines = _pages(t, [head, F.concat(F.lit("## Page "), k.cast("string")), F.when(k % 3 == 0, F.concat(F.lit(" عن "), given(k + 2))), F.lit("> note")])
    return bk.summary_entries(lines, F.col("line").rlike("^4[0-3] - "))


@query(f"""SELECT CASE WHEN c_custkey // 4 * 4 + c_custkey % 4 < 400 THEN 'no_match' ELSE 'ambiguous' END AS section, CAST(c_custkey AS INTEGER) AS number, CAST(CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 12 + 1 END AS INTEGER) AS layer, {_name_sql("c_custkey", "c_custkey // 11")} AS name FROM customer WHERE c_custkey < 400 OR c_custkey % 2 = 0""")
def unresolved_names(t):  # X27: two sections in each of four reports
    k = F.col("c_custkey")
    row = F.concat(F.lit("["), F.format_string("%5d", k), F.lit("] T"), F.when(k % 6 > 0, (k % 12 + 1).cast("string")).otherwise("None"), F.lit(" "), name(k, div(k, 11)), F.when((k >= 400) & (k % 2 == 0), " (best match: x)").otherwise(""))
    marks = F.when(k < 4, "=== NO CANDIDATES (9) ===").when((k >= 400) & (k < 404), "=== AMBIGUOUS (9) ===")
    return bk.unresolved_report(_pages(t, [marks, row, F.lit("")]))


@query(f"""WITH e AS (SELECT c_custkey AS k, [{_name_sql("c_custkey + 3", "c_custkey + 4")}] AS students, {pick_sql(["thiqah", "daif", "majhul", "unspecified", "mamduh", "hasan", "muwaththaq"], "c_custkey")} AS status FROM customer)
SELECT count(*) AS vouched, count(*) FILTER (status <> 'thiqah') AS uplifted FROM e WHERE list_has_any(students, ['علي بن محمد', 'جعفر بن زرارة', 'حماد بن سهل'])""")
def vouched_uplift(t):  # A23
    return bk.uplift(people(t).withColumnRenamed("narrated_from_by", "students"), ["علي بن محمد", "جعفر بن زرارة", "حماد بن سهل"])


GRADES = ["صحيح", "حسن كالصحيح", "ضعيف", "موثق كالصحيح"]
STRANGER = "رفاعة بن عقيل"
_FIRST = f"{_name_sql('s_suppkey', 's_suppkey // 3')} AS n0"
_PARTS = ANALYSED_SQL[: ANALYSED_SQL.rindex("SELECT chain_id, 0 AS pos")].replace(_FIRST, f"CASE WHEN s_suppkey % 10 = 1 THEN '{STRANGER}' ELSE {_FIRST.removesuffix(' AS n0')} END AS n0", 1)
_BENCH = f"""{_PARTS.rstrip()}, s AS (SELECT chain_id, name, CASE WHEN v IS NOT NULL THEN 'thiqah' ELSE e.status END AS status, hadith_count FROM (SELECT chain_id, name, v, entry_key FROM f0 UNION ALL SELECT chain_id, name, v, entry_key FROM f1 UNION ALL SELECT chain_id, name, v, entry_key FROM f2) l LEFT JOIN e USING (entry_key)),
o AS (SELECT chain_id, CASE WHEN bool_or(status IS NULL) THEN 'Undetermined' WHEN bool_or(status = 'daif') THEN 'Daif' WHEN bool_or(status = 'majhul' OR status = 'unspecified' AND coalesce(hadith_count, 0) < 100) THEN 'Majhul' WHEN bool_or(status = 'muwaththaq') THEN 'Muwaththaq' WHEN bool_or(status IN ('mamduh', 'hasan')) THEN 'Hasan' ELSE 'Sahih' END AS ours FROM s GROUP BY 1)"""


def _bench(t):
    s = F.col("s_suppkey")
    names = [F.when(s % 10 == 1, STRANGER).otherwise(name(s, div(s, 3))), F.when(s % 3 == 0, "ابيه").otherwise(name(s + 1, s + 2)), F.when(s % 2 == 0, "الباقر").otherwise(name(s + 2, s))]
    text = F.concat(s.cast("string"), F.lit(" - "), names[0], F.lit(" عن "), names[1], F.lit("، عن "), names[2], F.when(s % 2 == 0, " (ع) قال: الحلال بين").otherwise(" قال سمعته يقول كذا"))
    reports = t.supplier.select(s.alias("report_id"), text.alias("text"), one(GRADES, s).alias("grade"))
    fixed = t.supplier.sparkSession.createDataFrame([("الباقر", "IMAM_BAQIR", 4.0)], "name string, virtual_key string, layer double")
    return bk.benchmark(reports, _index(t), people(t).withColumn("grandfather", given(F.col("src_ord"))), fixed, {"الباقر": 4}, ("الباقر",))


@query(f"{_BENCH} SELECT chain_id AS report_id, ours, ours = 'Sahih' AS matches, CASE ours WHEN 'Sahih' THEN NULL WHEN 'Undetermined' THEN 'unresolved_link' WHEN 'Daif' THEN 'has_daif_link' WHEN 'Majhul' THEN 'has_majhul_link' ELSE ours END AS reason FROM o WHERE chain_id % 4 <> 2")
def benchmark_grades(t):  # V4 A15: from texts to grades, compared with another grader's
    return _bench(t)[0]


@query(f"{_BENCH} SELECT name, count(*) AS n FROM s WHERE status IS NULL AND chain_id % 4 <> 2 GROUP BY 1")
def benchmark_unresolved(t):  # V4 A15: the names that found no entry
    return _bench(t)[1]
