"""Queries of the chain grammar, dictionary matching, scribal errors, prefix ladders, gap recovery and gap probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as dc
from ..operators import grammar as gm
from ..operators import ladder as ld
from ..operators import probe as pb
from ..operators import recovery as rc
from ..operators import scribal as sb
from .catalogue import query
from .people import LINK, _lines, _name_sql, div, given, given_sql

JOINTS = [" عن ", "، حدثنا ", " قال حدثني ", " بإسناده عن "]
#: Told, kind and segment by the supplier's number; a null stands for the link's name.
PIECES = {3: ("عدة من أصحابنا", "group", "عدة من اصحابنا"), 4: ("أبيه", "father", "ابيه"), 6: ("عمن رواه", "relay", "عمن رواه")}


@query(f"""SELECT chain_id, pos, CASE s % 7 {' '.join(f"WHEN {k} THEN '{p[1]}'" for k, p in PIECES.items())} ELSE 'name' END AS kind,
CASE s % 7 {' '.join(f"WHEN {k} THEN '{p[2]}'" for k, p in PIECES.items())} WHEN 5 THEN name || ' (ع)' ELSE name END AS segment FROM ({LINK})""")
def chain_segments(t):  # C6 L1: a chain of an order's lines, with groups, relatives, relays and honorifics, read by a table function in a lateral join
    s = F.col("s") % 7
    told = F.col("name")
    for k, (text, _, _) in PIECES.items():
        told = F.when(s == k, text).otherwise(told)
    told = F.when(s == 5, F.concat("name", F.lit(" (ع)"))).otherwise(told)
    joint = F.when(F.col("pos") == 0, F.concat((F.col("chain_id") % 90).cast("string"), F.lit(" - حدثنا "))).otherwise(F.element_at(F.array(*map(F.lit, JOINTS)), (F.col("pos") % 4 + 1).cast("int")))
    chains = _lines(t).select("chain_id", F.struct("pos", F.concat(joint, told).alias("x")).alias("p")).groupBy("chain_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return gm.segments(chains.select("chain_id", F.array_join(F.transform("p", lambda x: x["x"]), "").alias("text")), "chain_id", F.col("text"))


TERMS = "SELECT DISTINCT substr(text, i, 4) AS term FROM benchmark, (SELECT unnest([3, 9, 17, 30]) AS i) WHERE length(text) >= i + 3"


def _terms(t):
    return t.benchmark.select(F.explode(F.array(*[F.when(F.length("text") >= i + 3, F.substring("text", i, 4)) for i in (3, 9, 17, 30)])).alias("term")).where("term is not null").distinct()


@query(f"""WITH t AS ({TERMS}), x AS (SELECT doc_id, term, length(text) - strpos(reverse(text), reverse(term)) + 1 AS e FROM documents JOIN t ON contains(text, term))
SELECT doc_id, CAST(e - 4 AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", term FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e DESC) = 1""")
def last_mentions(t):  # X28: the rightmost of many terms in whole texts; terms are of one length, so no two end together
    return dc.last_mention(t.documents, "doc_id", "text", _terms(t), edges=False)


@query(f"""WITH t AS ({TERMS}), x AS (SELECT doc_id, count(DISTINCT substr(term, 1, 1)) AS n, list_sort(list_distinct(list(lower(substr(term, 1, 1))))) AS labels FROM documents JOIN t ON contains(text, term) GROUP BY 1)
SELECT doc_id, array_to_string(labels, '|') AS labels FROM x""")
def term_labels(t):  # N33: labels of all terms that occur in a text; a label is a term's first letter
    terms = _terms(t).withColumn("label", F.lower(F.substring("term", 1, 1)))
    return dc.labels(t.documents, "doc_id", "text", terms, edges=False).select("doc_id", F.array_join("labels", "|").alias("labels"))


@query(f"""WITH t AS (SELECT {given_sql("n_nationkey")} || CASE WHEN n_nationkey % 2 = 0 THEN ' بن ' || {given_sql("n_nationkey // 3")} ELSE '' END AS title, min(n_nationkey % 12 + 1) AS layer FROM nation GROUP BY 1),
x AS (SELECT c_custkey, {_name_sql("c_custkey", "c_custkey // 11")} AS name FROM customer)
SELECT c_custkey, title, CAST(layer AS INTEGER) AS layer FROM x JOIN t ON contains(name, title) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(title) DESC, title) = 1""")
def title_layers(t):  # N15: the longest title in a name decides
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    titles = t.nation.select(F.concat(given(n), F.when(n % 2 == 0, F.concat(F.lit(" بن "), given(div(n, 3)))).otherwise("")).alias("title"), (n % 12 + 1).cast("int").alias("layer"))
    return dc.longest_title(t.customer.select(k, F.concat(given(k), F.lit(" بن "), given(div(k, 11))).alias("name")), "c_custkey", "name", titles)


# --- Scribal errors: a customer's number in letters is a name, so many names differ by dots, by a letter or by order

LETTERS = "ابتثجحخدذر"
KNOWN_SQL = f"SELECT translate(CAST(c_custkey AS VARCHAR), '0123456789', '{LETTERS}') AS name, c_custkey % 5 + 1 AS n FROM customer"
ASKED_SQL = f"SELECT translate(CAST(s_suppkey * 7 AS VARCHAR), '0123456789', '{LETTERS}') AS name FROM supplier"


def _spelled(c):
    return F.translate(c.cast("string"), "0123456789", LETTERS)


def _known(t):
    return t.customer.select(_spelled(F.col("c_custkey")).alias("name"), (F.col("c_custkey") % 5 + 1).cast("long").alias("n"))


@query(f"WITH k AS ({KNOWN_SQL}), a AS (SELECT DISTINCT name FROM ({ASKED_SQL})) SELECT a.name, k.name AS other, k.n FROM a JOIN k ON translate(a.name, '{sb.DOTTED}', '{sb.PLAIN}') = translate(k.name, '{sb.DOTTED}', '{sb.PLAIN}') AND a.name <> k.name")
def dotless_twins(t):  # M9: dots
    return sb.meant_by_dots(t.supplier.select(_spelled(F.col("s_suppkey") * 7).alias("name")), _known(t))


@query(f"""WITH k AS (SELECT CAST(c_custkey AS VARCHAR) AS d, c_custkey % 5 + 1 AS n FROM customer), a AS (SELECT DISTINCT CAST(s_suppkey * 7 AS VARCHAR) AS d FROM supplier)
SELECT translate(a.d, '0123456789', '{LETTERS}') AS name, translate(k.d, '0123456789', '{LETTERS}') AS other, CAST(levenshtein(a.d, k.d) AS INTEGER) AS edits, k.n FROM a JOIN k ON levenshtein(a.d, k.d) BETWEEN 1 AND 2""")
def near_names(t):  # M9 M4: one or two edits, by letters left out
    return sb.near(t.supplier.select(_spelled(F.col("s_suppkey") * 7).alias("name")), _known(t))


@query(f"""WITH k AS (SELECT name, sum(n) AS n FROM (SELECT {_name_sql("c_custkey", "c_custkey // 11")} AS name, c_custkey % 5 + 1 AS n FROM customer) GROUP BY 1),
a AS (SELECT DISTINCT {_name_sql("s_suppkey", "s_suppkey // 3")} AS name FROM supplier), r AS (SELECT name, split_part(name, ' بن ', 2) || ' بن ' || split_part(name, ' بن ', 1) AS other FROM a)
SELECT r.name, other, CAST(coalesce(x.n, 0) AS BIGINT) AS here, CAST(y.n AS BIGINT) AS there FROM r LEFT JOIN k x ON x.name = r.name JOIN k y ON y.name = other WHERE other <> r.name AND y.n > coalesce(x.n, 0)""")
def reversed_names(t):  # M9: reversal
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    known = t.customer.select(F.concat(given(k), F.lit(" بن "), given(div(k, 11))).alias("name"), (k % 5 + 1).cast("long").alias("n"))
    return sb.meant_by_order(t.supplier.select(F.concat(given(s), F.lit(" بن "), given(div(s, 3))).alias("name")), known)


THREE_SQL = f"{given_sql('s_suppkey')} || ' بن ' || {given_sql('s_suppkey // 3')} || ' بن ' || {given_sql('s_suppkey // 5')}"


@query(f"""WITH k AS (SELECT {_name_sql("c_custkey", "c_custkey // 11")} AS name, count(*) AS n FROM customer GROUP BY 1), a AS (SELECT DISTINCT {THREE_SQL} AS name, {_name_sql("s_suppkey", "s_suppkey // 5")} AS other FROM supplier)
SELECT a.name, other, n FROM a JOIN k ON k.name = other""")
def shortened_names(t):  # M9: addition
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    known = t.customer.select(F.concat(given(k), F.lit(" بن "), given(div(k, 11))).alias("name"), F.lit(1).cast("long").alias("n"))
    return sb.meant_without(t.supplier.select(F.concat(given(s), F.lit(" بن "), given(div(s, 3)), F.lit(" بن "), given(div(s, 5))).alias("name")), known)


FLAG_NAMES = ["خلف", "خالد", "عمر", "عمرو", "محمد", "أحمد", "يسار", "سالم", "هلال"]


def _flag(k):
    return F.element_at(F.array(*map(F.lit, FLAG_NAMES)), (k % len(FLAG_NAMES) + 1).cast("int"))


def _flag_sql(k: str) -> str:
    return f"(ARRAY{FLAG_NAMES!r})[CAST(({k}) % {len(FLAG_NAMES)} + 1 AS BIGINT)]"


_ALIKE = " ".join(f"WHEN (ends_with(a, '{x}') AND ends_with(b, '{y}')) OR (ends_with(a, '{y}') AND ends_with(b, '{x}')) THEN '{x}/{y}'" for x, y in sb.ALIKE)
_TAKEN = " ".join(f"WHEN contains(a, '{x}') AND NOT contains(a, '{y}') THEN '{x}/{y}'" for x, y in sb.TAKEN)


@query(f"""WITH x AS (SELECT c_custkey, {given_sql("c_custkey")} || ' بن ' || CASE WHEN c_custkey % 4 = 0 THEN {given_sql("c_custkey // 2")} || ' بن ' ELSE '' END || {_flag_sql("c_custkey")} AS a, {_flag_sql("c_custkey // 9")} AS b FROM customer)
SELECT c_custkey, CASE {_ALIKE} END AS alike, CASE WHEN contains(a, 'يسار') THEN 'بشار' END AS misdotted, CASE {_TAKEN} END AS taken_for, c_custkey % 4 = 0 AS added, len(string_split(a, ' ')) >= {sb.LONG} AS long FROM x""")
def scribal_flags(t):  # M9: similar writing, dots, confusion, addition, rare names
    k = F.col("c_custkey")
    x = t.customer.select(k, F.concat(given(k), F.lit(" بن "), F.when(k % 4 == 0, F.concat(given(div(k, 2)), F.lit(" بن "))).otherwise(""), _flag(k)).alias("a"), _flag(div(k, 9)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select("c_custkey", sb.alike(a, b).alias("alike"), sb.misdotted(a).alias("misdotted"), sb.taken_for(a).alias("taken_for"), sb.added(a).alias("added"), sb.is_long(a).alias("long"))


# --- Prefix ladder


def _prefix_sql(name: str) -> str:
    return f"[{', '.join([name] + [f'''array_to_string(list_slice(string_split({name}, ' '), 1, {d}), ' ')''' for d in ld.DEPTHS[1:]])}]"


LADDER = f"""e AS (SELECT 'k' || c_custkey AS entry_key, {_name_sql("c_custkey", "c_custkey // 11")} || ' بن ' || {given_sql("c_custkey // 121")} || CASE WHEN c_custkey % 3 = 0 THEN ' الكوفي' ELSE '' END AS name, 'A' || (c_custkey % 7) AS authority FROM customer),
i AS (SELECT DISTINCT unnest({_prefix_sql("name")}) AS prefix, entry_key FROM e), known AS (SELECT prefix, count(*) AS n, min(entry_key) AS entry_key FROM i GROUP BY 1),
q AS (SELECT s_suppkey AS query_id, {_name_sql("s_suppkey", "s_suppkey // 11")} AS name, {_name_sql("s_suppkey", "s_suppkey // 2")} || ' بن ' || {given_sql("s_suppkey // 5")} AS alias, s_suppkey % 9 AS layer FROM supplier),
r AS (SELECT query_id, layer, unnest([0, 1, 2, 3]) AS reading, unnest([name || ' الكوفي', alias, replace(name || ' الكوفي', 'ه', 'م'), replace(alias, 'ه', 'م')]) AS x FROM q),
t AS (SELECT query_id, reading, unnest({_prefix_sql("x")}) AS prefix, unnest([0, 1, 2, 3, 4]) AS depth FROM r)"""


@query(f"""WITH {LADDER}, h AS (SELECT * FROM t JOIN known USING (prefix)), f AS (SELECT query_id, arg_min(entry_key, (reading, depth)) AS entry_key, min(reading * 10 + depth) AS spot FROM h WHERE n = 1 GROUP BY 1),
l AS (SELECT DISTINCT query_id, i.entry_key FROM h JOIN i USING (prefix) WHERE query_id NOT IN (SELECT query_id FROM f)),
c AS (SELECT l.query_id, count(*) AS candidates, count(*) FILTER (authority = 'A' || layer) AS good, min(l.entry_key) AS anyone, min(l.entry_key) FILTER (authority = 'A' || layer) AS one FROM l JOIN e USING (entry_key) JOIN q USING (query_id) GROUP BY 1)
SELECT q.query_id, coalesce(f.entry_key, CASE WHEN candidates = 1 THEN anyone WHEN good = 1 THEN one END) AS entry_key, CAST(spot // 10 AS INTEGER) AS reading, CAST(spot % 10 AS INTEGER) AS depth, coalesce(candidates, 0) AS candidates FROM q LEFT JOIN f USING (query_id) LEFT JOIN c USING (query_id)""")
def prefix_ladder(t):  # J12 N10 N20: names, aliases and corrected readings, five words down to two, then the layer
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    name = lambda *parts: F.concat_ws(" بن ", *[given(p) for p in parts])
    entries = t.customer.select(F.concat(F.lit("k"), k.cast("string")).alias("entry_key"), F.concat(name(k, div(k, 11), div(k, 121)), F.when(k % 3 == 0, " الكوفي").otherwise("")).alias("name_ar"), F.concat(F.lit("A"), (k % 7).cast("string")).alias("authority"))
    asked = t.supplier.select(s.alias("query_id"), F.concat(name(s, div(s, 11)), F.lit(" الكوفي")).alias("name"), F.array(name(s, div(s, 2), div(s, 5))).alias("aliases"), (s % 9).cast("int").alias("layer"))
    expected = asked.select("layer", F.concat(F.lit("A"), F.col("layer").cast("string")).alias("authority")).distinct()
    return ld.match(asked, ld.prefix_index(entries), entries.select("entry_key", "authority"), expected, lambda c: F.array(F.replace(c, F.lit("ه"), F.lit("م"))))


@query("SELECT n AS number, arg_min(l_orderkey, l_orderkey) AS entry_key FROM (SELECT l_orderkey, unnest([l_partkey, l_suppkey + 100]) AS n FROM lineitem) WHERE n IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1")
def any_number(t):  # J13: the first order that carries a number in either edition
    editions = t.lineitem.select(F.col("l_orderkey").alias("entry_key"), F.col("l_orderkey").alias("src_ord"), F.array("l_partkey", F.col("l_suppkey") + 100).alias("numbers"))
    return ld.by_any_number(t.part.where("p_size > 10").select(F.col("p_partkey").alias("number")), editions)


# --- Gaps in books: a supplier's parts are the numbers of its book


@query("""WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), x AS (SELECT *, lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS b FROM e)
SELECT l_suppkey, b + 1 AS low, l_partkey - 1 AS high, b AS before, l_partkey AS after, b * 100 + 7 AS text_start, l_partkey * 100 AS text_end FROM x WHERE l_partkey > b + 1""")
def missing_runs(t):  # X22: runs of missing numbers with their neighbours and the text between
    entries = t.lineitem.select("l_suppkey", "l_partkey", (F.col("l_partkey") * 100).alias("start"), (F.col("l_partkey") * 100 + 7).alias("end"))
    return rc.missing_runs(entries, ["l_suppkey"], "l_partkey", "start", "end")


@query("""WITH r AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2), l AS (SELECT user_id, ts, event_id FROM events WHERE event_id % 3 = 1),
b AS (SELECT l.event_id, r.ts AS bt, r.v AS bv FROM l ASOF JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts), a AS (SELECT l.event_id, r.ts AS nt, r.v AS nv FROM l ASOF JOIN r ON l.user_id = r.user_id AND l.ts < r.ts)
SELECT l.event_id, bt AS before_ts, bv AS before_v, nt AS after_ts, nv AS after_v FROM l LEFT JOIN b USING (event_id) LEFT JOIN a USING (event_id)""")
def asof_both(t):  # X22: the nearest rows before and behind
    e = t.events
    right = e.where("event_id % 3 = 0").groupBy("user_id", "ts").agg(F.max("value").alias("v"))
    left = e.where("event_id % 3 = 1").select("user_id", "ts", "event_id")
    return rc.asof(left, right, ["user_id"], "ts", ["v"]).drop("user_id", "ts")


@query(f"""WITH x AS (SELECT s_suppkey AS s, unnest([0, 1, 2]) AS i FROM supplier) SELECT s AS book, 10 + i AS number, CAST((s + i * 5) % 90 + 1 AS INTEGER) AS read_number, {_name_sql("s", "i + 1")} AS name,
CASE WHEN i = 0 THEN 5 WHEN s % 2 = 0 THEN 6 END AS layer, CASE WHEN i = 0 THEN 'من كبار الخامسة' WHEN s % 2 = 0 THEN 'السادسة' END AS detail FROM x WHERE i <= s % 3""")
def recovered_entries(t):  # X23 X21: headers in the text of a gap take its numbers in order; a layer is read from bold text or a conclusion
    s = F.col("s_suppkey")
    header = lambda i: F.concat((((s + i * 5) % 90) + 1).cast("string"), F.lit(" - " if i % 2 else ". "), given(s), F.lit(" بن "), given(F.lit(i + 1)), F.lit("\n"))
    body = [F.lit("كلام <b>من كبار الخامسة</b>\n")] + [F.concat(F.lit("كلام آخر\n"), F.when(s % 2 == 0, "فهو من السادسة\n").otherwise("لا شيء\n"))] * 2
    text = F.concat(F.lit("ذيل ما قبله\n"), *[F.concat(header(i), body[i]) for i in range(3)])
    gaps = t.supplier.select(s.alias("book"), F.lit(10).cast("long").alias("low"), (10 + s % 3).alias("high"), text.alias("text"))
    return rc.recovered(gaps, ["book"]).drop("alt_names")


# --- Gap probes on edges from suppliers to parts


EDGES = "SELECT DISTINCT l_suppkey AS teacher, 100000 + l_partkey AS student FROM lineitem UNION SELECT DISTINCT 100000 + l_partkey, 1000000 + o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"""WITH e AS ({EDGES}), g AS (SELECT o_orderkey AS gap_id, 1000000 + o_custkey AS before, o_orderkey % 97 AS after, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 END AS layer FROM orders)
SELECT gap_id, x.teacher AS between FROM g JOIN e x ON x.student = before JOIN e y ON y.teacher = after AND y.student = x.teacher WHERE layer IS NULL OR x.teacher % 4 = layer""")
def gap_fillers(t):  # M5: who was heard by a customer's order and heard a supplier
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    part = F.col("l_partkey") + 100000
    edges = t.lineitem.select(F.col("l_suppkey").alias("teacher"), part.alias("student")).union(lines.select(part, F.col("o_custkey") + 1000000))
    k = F.col("o_orderkey")
    gaps = t.orders.select(k.alias("gap_id"), (F.col("o_custkey") + 1000000).alias("before"), (k % 97).alias("after"), F.when(k % 5 > 0, k % 4).alias("layer"))
    layers = t.lineitem.select(part.alias("person"), (part % 4).alias("layer")).distinct()
    return pb.fillers(gaps, edges, layers)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS teacher, l_partkey AS student FROM lineitem), n AS (SELECT teacher, count(*) - 1 AS others FROM e GROUP BY 1)
SELECT student AS narrator, teacher, others FROM e JOIN n USING (teacher) WHERE others > 0""")
def parallel_paths(t):  # M5 J24: suppliers through whom a part's chain has companions
    edges = t.lineitem.select(F.col("l_suppkey").alias("teacher"), F.col("l_partkey").alias("student"))
    return pb.parallel(t.lineitem.select(F.col("l_partkey").alias("narrator")), edges)
