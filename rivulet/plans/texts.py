"""Queries of operators on free texts. Texts are put together from parts that follow from keys, and the SQL computes from the same keys, or by its own patterns, what must be found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chain as ch
from ..operators import evidence_rules as ev
from ..operators import extract as ex
from ..operators import windows as wn
from .catalogue import query
from .people import GIVEN, _name_sql, div, given, given_sql, one, one_sql


def eastern(c: Column) -> Column:
    return F.translate(c.cast("string"), tx.WESTERN, tx.EASTERN)


def eastern_sql(x: str) -> str:
    return f"translate(CAST({x} AS VARCHAR), '{tx.WESTERN}', '{tx.EASTERN}')"


def name(a: Column, b: Column) -> Column:
    return F.concat(given(a), F.lit(" بن "), given(b))


def _list_sql(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) for v in values) + "]"


def pick_sql(values: list, key: str) -> str:
    return f"({_list_sql(values)})[CAST(({key}) % {len(values)} + 1 AS BIGINT)]"


# --- X7 X8: two phrases, of which each has a class; a negation between them, and a path before the first

CORES = [("ثقة عين", "reliable"), ("ثقة", "alone"), ("ضعيف جدا", "very weak"), ("ضعيف", "weak"), ("موثق", "muwaththaq"), ("ممدوح", "mamduh"), ("من الحسان", "hasan"), ("مجهول", "majhul"), ("حسن", "good"), ("كوفي", "")]


def _has(*kinds: str) -> str:
    return "(" + " OR ".join(f"c{i} = '{k}'" for i in (1, 2) for k in kinds) + ")"


@query(f"""WITH x AS (SELECT c_custkey, {pick_sql([k for _, k in CORES], "c_custkey")} AS c1, {pick_sql([k for _, k in CORES], "c_custkey // 10")} AS c2, c_custkey // 100 % 2 = 1 AS negated, c_custkey // 200 % 2 = 1 AS path FROM customer)
SELECT c_custkey, CASE WHEN {_has("reliable", "alone")} AND NOT negated THEN 'thiqah' WHEN {_has("very weak")} THEN 'daif' WHEN {_has("weak")} AND NOT path THEN 'daif' WHEN {_has("muwaththaq")} THEN 'muwaththaq' WHEN {_has("mamduh")} THEN 'mamduh'
WHEN {_has("hasan", "good")} THEN 'hasan' WHEN {_has("majhul")} THEN 'majhul' ELSE 'unspecified' END AS verdict FROM x""")
def entry_verdicts(t):  # X7 X8
    k = F.col("c_custkey")
    core = lambda c: one([x for x, _ in CORES], c)
    text = F.concat(given(k), F.lit(" - "), F.when(div(k, 200) % 2 == 1, "في طريق الصدوق اليه ").otherwise(""), core(k), F.lit(" - "), F.when(div(k, 100) % 2 == 1, "لم تثبت وثاقته - ").otherwise(""), core(div(k, 10)), F.lit(" ."))
    return t.customer.select("c_custkey", ex.verdict(text).alias("verdict"))


# --- X12 X13 X14


@query(f"""WITH x AS (SELECT p_partkey AS k, {given_sql("p_partkey")} AS a, {given_sql("p_partkey // 3")} AS b, {given_sql("p_partkey // 7")} AS c, {given_sql("p_partkey // 5")} AS d, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN {given_sql("p_partkey // 3 + 1")} ELSE {given_sql("p_partkey // 3")} END AS known FROM part),
s AS (SELECT k, CASE WHEN k % 3 = 0 THEN [a || ' بن ' || b, 'محمد بن ' || c] WHEN k % 3 = 1 THEN [{pick_sql(["الباقر", "الصادق", "الرضا"], "k // 3")}] ELSE [] END AS sources FROM x)
SELECT x.k AS p_partkey, x.k % 3 < 2 AS has_book, CAST(nullif(x.k % 60, 0) AS INTEGER) AS hadith_count, {pick_sql(["sahih", "daif", None, None], "x.k")} AS tariq_status,
array_to_string(list_filter([CASE WHEN x.k & 1 > 0 THEN 'الكافي' END, CASE WHEN x.k & 2 > 0 THEN 'الاستبصار' END, CASE WHEN x.k & 4 > 0 THEN 'الفقيه' END, CASE WHEN x.k & 8 > 0 THEN 'تفسير القمي' END], lambda y: y IS NOT NULL), ',') AS books,
CASE WHEN known IS NULL OR contains(b, known) OR contains(known, b) THEN c END AS grandfather,
array_to_string(list_filter(sources, lambda y: NOT (contains(y, 'الحسين') OR y IN ('الباقر', 'الصادق', 'الرضا'))), ',') AS teachers, array_to_string(list_filter(sources, lambda y: contains(y, 'الحسين') OR y IN ('الباقر', 'الصادق', 'الرضا')), ',') AS authorities,
CASE WHEN x.k % 2 = 0 AND d <> 'الحسين' THEN d ELSE '' END AS students FROM x JOIN s ON s.k = x.k""")
def entry_facts(t):  # X12 X13 X14
    k = F.col("p_partkey")
    n = F.when(k % 2 == 0, (k % 60).cast("string")).otherwise(eastern(k % 60))
    bit = lambda b, word: F.when(k.bitwiseAND(F.lit(b)) > 0, f" {word} ").otherwise("")
    text = F.concat(one(["له كتاب", "لها أصل", "لا شيء"], k), F.lit("، روى "), n, F.lit(" رواية، "), one(["طريق الشيخ اليه صحيح", "طريقه اليه ضعيف", "طريقه. ضعيف", "بلا سند"], k), F.lit("، "), bit(1, "الكافي"), bit(2, "الاستبصار"), bit(4, "من لا يحضره الفقيه"), bit(8, "تفسير القمي"))
    told = F.when(k % 3 == 0, F.concat(F.lit("روى عن "), name(k, div(k, 3)), F.lit(" ومحمد بن "), given(div(k, 7)), F.lit("."))).when(k % 3 == 1, F.concat(F.lit("روى عن "), one(["الباقر", "الصادق", "الرضا"], div(k, 3)), F.lit(" في الكافي."))).otherwise("روى عن الكشي.")
    told = F.concat(told, F.when(k % 2 == 0, F.concat(F.lit(" وروى عنه "), given(div(k, 5)))).otherwise(""))
    line = F.concat(k.cast("string"), F.lit(" - "), name(k, div(k, 3)), F.lit(" بن "), given(div(k, 7)), F.when(k % 2 == 0, ": كوفي").otherwise("."))
    known = F.when(k % 4 == 0, None).when(k % 4 == 1, given(div(k, 3) + 1)).otherwise(given(div(k, 3)))
    joined = lambda c: F.array_join(c, ",")
    x = t.part.select("p_partkey", ex.facts(text).alias("f"), ex.connections(told).alias("c"), ex.grandfather(line, known).alias("grandfather"))
    return x.select("p_partkey", "f.has_book", "f.hadith_count", "f.tariq_status", joined(F.col("f.books")).alias("books"), "grandfather", *[joined(F.col(f"c.{n}")).alias(n) for n in ("teachers", "authorities", "students")])


# --- X10

OPENERS = [("متحد مع", "identical"), ("تقدم في", "cross_ref"), ("يأتي في", "cross_ref")]
STANDING = list(ex.STANDING.items())


@query(f"""WITH x AS (SELECT s_suppkey AS k, s_suppkey % 5 AS a, {pick_sql([v for _, v in STANDING], "s_suppkey // 5")} AS hint, {_name_sql("s_suppkey", "s_suppkey // 3")} AS n FROM supplier)
SELECT k, CAST(k % 500 + 10 AS BIGINT) AS target, {pick_sql([v for _, v in OPENERS], "a")} AS kind, n AS target_name, hint FROM x WHERE a < 3
UNION ALL SELECT k, k + 1, 'identical', NULL, hint FROM x WHERE a = 3 UNION ALL SELECT k, k - 1, 'identical', NULL, NULL FROM x WHERE a = 4 AND k > 0
UNION ALL SELECT k, k % 300 + 600, 'reference', NULL, NULL FROM x WHERE a < 3 AND k % 2 = 0""")
def cross_references(t):  # X10
    k = F.col("s_suppkey")
    number = F.when(k % 3 == 0, eastern(k % 500 + 10)).otherwise((k % 500 + 10).cast("string"))
    standing = one([v for v, _ in STANDING], div(k, 5))
    text = F.when(k % 5 < 3, F.concat(one([v for v, _ in OPENERS], k % 5), F.lit(" "), name(k, div(k, 3)), F.lit(" "), standing, F.lit(" الذي مر برقم "), number, F.when(k % 2 == 0, F.concat(F.lit(" والمتقدم "), eastern(k % 300 + 600))).otherwise("")))
    text = text.when(k % 5 == 3, F.concat(F.lit("متحد مع لاحقه "), standing)).otherwise("متحد مع سابقه")
    return ex.cross_references(t.supplier.select(k.alias("k"), text.alias("text")), "k", "text")


# --- X17 X18 X19 X20

DIED = ["توفي سنة {}", "مات في سنة ({}هـ)", "وفاته سنة {}", "المتوفى ({})", "قتل سنة {}", "استشهد في سنة {}"]
AGED = ["", " وله {} سنة", " وعمره {} سنة", " بلغ من العمر {} سنة"]
_low, _high = (f"({_list_sql([y[i] for y in ex.LAYER_YEARS])})[c_custkey % 12 + 1]" for i in (0, 1))


@query(f"""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 12 + 1 END AS layer, CASE WHEN c_custkey % 7 > 0 AND c_custkey * 7 % 620 BETWEEN 1 AND 500 THEN c_custkey * 7 % 620 END AS death,
CASE WHEN c_custkey // 6 % 4 > 0 AND c_custkey % 140 BETWEEN 30 AND 120 THEN c_custkey % 140 END AS age, {_low} AS low, {_high} AS high FROM customer), y AS (SELECT *, CASE WHEN death - age BETWEEN 1 AND 500 THEN death - age END AS birth FROM x)
SELECT c_custkey, CAST(birth AS INTEGER) AS birth, CAST(death AS INTEGER) AS death, CASE WHEN layer IS NOT NULL AND birth IS NULL THEN greatest(low - 60, 1) || '-' || least(greatest(high - 10, 1), 500) END AS born, CASE WHEN layer IS NOT NULL AND death IS NULL THEN low || '-' || least(high + 30, 500) END AS died,
CASE WHEN death IS NOT NULL AND age IS NOT NULL THEN 'certain' WHEN death IS NOT NULL THEN 'likely' WHEN layer IS NOT NULL THEN 'windowed' ELSE 'unknown' END AS confidence FROM y""")
def lifetimes(t):  # X17 X18 X19 X20
    k = F.col("c_custkey")
    shape = lambda c: F.when(k % 3 == 0, eastern(c)).otherwise(c.cast("string"))
    died = F.replace(one(DIED, k), F.lit("{}"), shape(k * 7 % 620))
    text = F.concat(given(k), F.lit(" كوفي. "), F.when(k % 7 > 0, died).otherwise("لا تاريخ له"), F.replace(one(AGED, div(k, 6)), F.lit("{}"), shape(k % 140)), F.lit("."))
    life = ex.lifetime_fields(text, F.when(k % 5 > 0, k % 12 + 1))
    shown = lambda w: F.when(F.col(w).isNotNull(), F.concat_ws("-", F.col(f"{w}.low").cast("string"), F.col(f"{w}.high").cast("string")))
    x = t.customer.select("c_custkey", life.alias("l")).select("c_custkey", "l.*")
    return x.select("c_custkey", "birth", "death", shown("birth_window").alias("born"), shown("death_window").alias("died"), "confidence")


# --- X1 X3


@query(f"""WITH x AS (SELECT s_suppkey AS k, {_name_sql("s_suppkey", "s_suppkey // 3")} AS name FROM supplier)
SELECT k AS s_suppkey, CASE WHEN k % 4 = 2 THEN (k + 1) || ',' || {eastern_sql("k + 2")} WHEN k % 4 = 3 THEN (k + 1) || ',' || {eastern_sql("k + 2")} || ',' || (k + 3) ELSE '' END AS numbers, name FROM x""")
def entry_heads(t):  # X1 X3: up to three numbers of editions; one alone is none of the three forms
    k = F.col("s_suppkey")
    numbers = F.when(k % 4 == 1, F.concat((k + 1).cast("string"), F.lit(" - "))).when(k % 4 == 2, F.concat((k + 1).cast("string"), F.lit(" - "), eastern(k + 2), F.lit(" - ")))
    numbers = numbers.when(k % 4 == 3, F.concat((k + 1).cast("string"), F.lit(" - "), eastern(k + 2), F.lit(" - "), (k + 3).cast("string"), F.lit(" - "))).otherwise("")
    text = F.concat(numbers, name(k, div(k, 3)), one([" :روى عن", " - كوفي", ""], k))
    n = ex.edition_numbers(text)
    return t.supplier.select("s_suppkey", F.array_join(F.array_compact(F.array(n["n1"], n["n2"], n["n3"])), ",").alias("numbers"), ex.name_of(text).alias("name"))


# --- X28

HEAD_TITLES = ("ابي عبد الله", "ابي جعفر")


@query(f"""WITH x AS (SELECT s_suppkey AS k, {_name_sql("s_suppkey", "s_suppkey // 11")} || '، عن ' || {_name_sql("s_suppkey + 1", "s_suppkey // 5")} AS names FROM supplier)
SELECT k AS s_suppkey, names || CASE WHEN k % 4 < 2 THEN ' عن ' || {pick_sql(list(HEAD_TITLES), "k")} || CASE WHEN k // 4 % 2 = 0 THEN ' (ع)' ELSE '' END WHEN k % 4 = 3 THEN ' كلام بلا نهاية' ELSE '' END AS chain FROM x""")
def chain_parts(t):  # X28: up to the last title and its honorific, else up to a word of speech, else all
    k = F.col("s_suppkey")
    names = F.concat(name(k, div(k, 11)), F.lit("، عن "), name(k + 1, div(k, 5)))
    ending = F.when(k % 4 < 2, F.concat(F.lit(" عن "), one(list(HEAD_TITLES), k), F.when(div(k, 4) % 2 == 0, " (ع)").otherwise(""), F.lit(" قال: الحلال بين"))).when(k % 4 == 2, " قال سمعته يقول كذا").otherwise(" كلام بلا نهاية")
    text = F.concat(F.when(k % 3 == 0, F.concat((k % 90).cast("string"), F.lit(" - "))).otherwise(""), names, ending)
    return t.supplier.select("s_suppkey", ex.chain_part(text, HEAD_TITLES).alias("chain"))


# --- M4

_CONFUSED = "MAP {" + ", ".join(f"'{a}': {list(b)!r}" for a, b in ev.CONFUSED.items()) + "}"
OTHER = "translate(a, 'حدسطعق', 'خذشظغك')"


@query(f"""WITH x AS (SELECT c_custkey, {given_sql("c_custkey")} || {given_sql("c_custkey // 11")} AS a0, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS how FROM customer),
y AS (SELECT c_custkey, a0 AS a, CASE how WHEN 1 THEN {OTHER.replace("(a,", "(a0,")} WHEN 2 THEN a0 || ' بن زيد' ELSE reverse(a0) END AS b FROM x),
z AS (SELECT c_custkey, a, b, unnest(range(1, least(length(a), length(b)) + 1)) AS i FROM y WHERE abs(length(a) - length(b)) <= 2),
h AS (SELECT c_custkey, string_agg((i - 1) || ':' || a[i] || ':' || b[i], ',' ORDER BY i) AS swaps FROM z WHERE a[i] <> b[i] AND list_contains(coalesce({_CONFUSED}[a[i]], []), b[i]) GROUP BY 1)
SELECT c_custkey, coalesce(swaps, '') AS swaps FROM x LEFT JOIN h USING (c_custkey)""")
def letter_swaps(t):  # M4
    k = F.col("c_custkey")
    a = F.concat(given(k), given(div(k, 11)))
    b = F.when(k % 3 == 0, F.translate(a, "حدسطعق", "خذشظغك")).when(k % 3 == 1, F.concat(a, F.lit(" بن زيد"))).otherwise(F.reverse(a))
    return t.customer.select("c_custkey", F.array_join(F.transform(ev.letter_swaps(a, b), lambda x: F.concat_ws(":", x["place"].cast("string"), x["from"], x["to"])), ",").alias("swaps"))


# --- N17 N21, N5 N38

HANDED = ["عن", "حدثني", "قال", ""]
BY_NAMES = ["أبو", "ابن أبي", "اُمّ"]


@query(f"""WITH x AS (SELECT s_suppkey AS k, {pick_sql(BY_NAMES, "s_suppkey // 4")} || ' ' || {given_sql("s_suppkey")} AS n FROM supplier)
SELECT k AS s_suppkey, replace(replace(translate(n, 'أةى', 'اهي'), chr(1615), ''), chr(1617), '') AS by_name, k % 5 IN (0, 1) AS heading FROM x""")
def by_names(t):  # N17 N21
    k = F.col("s_suppkey")
    n = F.concat(one(BY_NAMES, div(k, 4)), F.lit(" "), given(k))
    told = F.when(k % 4 == 3, n).otherwise(F.concat(one(HANDED, k), F.lit(" "), n))
    line = F.when(k % 5 == 0, F.concat(F.lit("أصحاب "), given(k))).when(k % 5 == 1, F.concat(given(k), F.lit(": كلام"))).otherwise(name(k, div(k, 3)))
    return t.supplier.select("s_suppkey", tx.by_name(told).alias("by_name"), tx.is_heading(line).alias("heading"))


@query(f"""WITH x AS (SELECT s_suppkey AS k, {pick_sql(["أبو", "ابن", "فاطمة بنت", "ابا"], "s_suppkey")} || ' ' || {given_sql("s_suppkey")} || CASE WHEN s_suppkey % 2 = 0 THEN ' بن موسى' ELSE '' END AS raw, s_suppkey % 9 - 4 AS gap FROM supplier),
y AS (SELECT *, array_to_string(list_filter(string_split(raw, ' '), lambda w: w NOT IN ('بن', 'ابن', 'أبو', 'ابا', 'ابي', 'ال', 'ابو') OR w = 'أبو'), ' ') AS bare FROM x)
SELECT k AS s_suppkey, translate(bare, 'أإآةى', 'اااهي') AS form, CASE WHEN gap <= -2 THEN 'طبقة مقلوبة: الشيخ أحدث من الراوي بـ ' || abs(gap) || ' طبقة' WHEN gap = -1 THEN 'فجوة طبقة واحدة عكسية — الراوي من طبقة سابقة (محتمل عند الرواة المعمّرين)'
WHEN gap = 2 THEN 'فجوة طبقة واحدة — إرسال محتمل' WHEN gap > 2 THEN 'فجوة ' || gap || ' طبقات — إرسال أو سقط رواة' END AS note FROM y""")
def search_forms(t):  # N5 N38: letters are folded before particles go, so a particle with a hamza stays
    k = F.col("s_suppkey")
    raw = F.concat(one(["أبو", "ابن", "فاطمة بنت", "ابا"], k), F.lit(" "), given(k), F.when(k % 2 == 0, " بن موسى").otherwise(""))
    return t.supplier.select("s_suppkey", tx.for_search(raw).alias("form"), wn.gap_note(k % 9 - 4).alias("note"))


# --- X21 N16 O6

ORDINALS = [(n, v) for n, v in ex.ORDINALS.items() if n != "الاولى"]
AGES = ["", "صغار ", "كبار "]


@query(f"""WITH x AS (SELECT c_custkey AS k, {pick_sql([n for n, _ in ORDINALS], "c_custkey")} AS o, {pick_sql([v for _, v in ORDINALS], "c_custkey")} AS v, {pick_sql(AGES, "c_custkey // 11")} AS age, c_custkey // 33 % 4 AS how FROM customer)
SELECT k AS c_custkey, CAST(CASE WHEN how < 3 THEN v END AS INTEGER) AS layer, CASE WHEN how < 2 THEN 'من ' || age || o WHEN how = 2 THEN o END AS detail, CASE WHEN how < 2 THEN {pick_sql([None, "junior", "senior"], "k // 11")} END AS sub,
CASE WHEN k % 2 = 0 THEN {_name_sql("k", "k // 3")} || ',' || {given_sql("k")} ELSE '' END AS alt_names FROM x""")
def authority_entries(t):  # X21 N16 O6: bold phrases, of which the last with an ordinal counts; a plain conclusion; neither; and other names
    k = F.col("c_custkey")
    how, phrase = div(k, 33) % 4, F.concat(F.lit("من "), one(AGES, div(k, 11)), one([n for n, _ in ORDINALS], k))
    bold = F.concat(F.lit("كلام <b>من الثانية</b> ثم <b>"), phrase, F.lit("</b> و<b>فصل</b>"))
    body = F.when(how == 0, bold).when(how == 1, F.concat(bold, F.lit(" فهو من الثالثة"))).when(how == 2, F.concat(F.lit("<b>فصل</b> وهو "), phrase)).otherwise("لا شيء <b>فصل</b>")
    others = F.when(k % 2 == 0, F.concat(F.lit("\nيرد بعنوان: "), name(k, div(k, 3)), F.lit("، <i>"), given(k), F.lit("</i>.\n\nثم"))).otherwise("")
    return t.customer.select("c_custkey", ex.authority(F.concat(body, others)).alias("a")).select("c_custkey", "a.layer", "a.detail", "a.sub", F.array_join("a.alt_names", ",").alias("alt_names"))


# --- N41 N14 N15


@query(rf"""WITH x AS (SELECT p_partkey AS k FROM part)
SELECT k, CASE WHEN k % 6 < 4 THEN '{{"n": ' || k || ', "l": [' || k % 7 || ', "x"]}}' WHEN k % 6 = 4 THEN '[' || k || ', {{"a": null}}]' END AS json, CAST(CASE k % 5 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 5 END AS INTEGER) AS layer,
CASE k % 5 WHEN 0 THEN 'ابو جعفر' WHEN 1 THEN 'ابو جعفر الثاني' WHEN 2 THEN {given_sql("k")} || ' الصادق' ELSE {given_sql("k")} END AS plain FROM x""")
def replies_and_titles(t):  # N41 N14 N15: thoughts, fences and garbage around JSON; honorifics behind names; the longest of nested titles
    k = F.col("p_partkey")
    n = k.cast("string")
    body = F.when(k % 6 < 4, F.concat(F.lit('{"n": '), n, F.lit(', "l": ['), (k % 7).cast("string"), F.lit(', "x"]}'))).when(k % 6 == 4, F.concat(F.lit("["), n, F.lit(', {"a": null}]'))).otherwise("no braces here")
    reply = F.concat(one(["", "<think>[1] or {}?</think>", "```json\n", "Here it is: "], k), body, one(["", "\n```", " and } more ]", "]}}"], div(k, 4)))
    titled = F.when(k % 5 == 0, "أبو جعفر").when(k % 5 == 1, "أبو جعفر الثاني").when(k % 5 == 2, F.concat(given(k), F.lit(" الصادق"))).otherwise(given(k))
    plain = tx.strip_honorific(F.concat(titled, one(["", " (ع)", " عليه السلام", " (عليه السلام)"], k)))
    titles = {"ابو جعفر": 4, "ابو جعفر الثاني": 7, "الصادق": 5}
    return t.part.select(k.alias("k"), tx.json_of_reply(reply).alias("json"), tx.longest_title(plain, titles).alias("layer"), plain.alias("plain"))
