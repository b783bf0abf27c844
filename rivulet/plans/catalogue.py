"""Every query on the driver's tables with the SQL that it must match. The letters after a name are the operators of the survey that it exercises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import extract as ex
from ..operators import graph as gr
from ..operators import joins as jn
from ..operators import layers as ly
from ..operators import scoring as sc
from ..operators import similarity as sim
from ..operators import windows as wn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Parquet tables below a folder, read when named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RANK = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


def rank_of(col: str):
    return sc.cascade([(F.col(col) == k, str(v)) for k, v in RANK.items()], "9").cast("int")


RANK_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANK.items()) + " ELSE 9 END"


# --- Aggregations


@query("SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 4) AS pct FROM orders GROUP BY 1")
def status_distribution(t):  # A1
    return ag.distribution(t.orders, "o_orderstatus")


@query("""WITH x AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'doc_id' AS field, count(doc_id) AS filled FROM x UNION ALL SELECT 'text', count(CASE WHEN trim(text) <> '' THEN 1 END) FROM x
UNION ALL SELECT 'lang', count(CASE WHEN trim(lang) <> '' THEN 1 END) FROM x UNION ALL SELECT 'quality', count(quality) FROM x UNION ALL SELECT 'toxic', count(toxic) FROM x""")
def field_richness(t):  # A2 P8
    return ag.field_richness(t.documents.join(t.labels, "doc_id", "left"), ["doc_id", "text", "lang", "quality", "toxic"])


@query("SELECT count(DISTINCT conv_id) AS conversations, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, max(n) AS longest FROM conversations JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id)")
def list_length_totals(t):  # A3 A4
    per = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    return per.agg(F.count("*").alias("conversations"), F.sum("n").alias("turns"), F.sum("c").alias("chars"), F.max("n").alias("longest"))


@query("SELECT 'event_type' AS facet, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'has_k', CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN 'yes' ELSE 'no' END, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'positive', CASE WHEN value > 0 THEN 'yes' ELSE 'no' END, count(*) FROM events GROUP BY 2")
def multi_facet_counts(t):  # A5 A25, one pass over the table
    yes = lambda c: F.when(c, "yes").otherwise("no")
    facets = F.array(*[F.struct(F.lit(n).alias("facet"), v.alias("value")) for n, v in (("event_type", F.col("event_type")), ("has_k", yes(F.get_json_object("props", "$.k").isNotNull())), ("positive", yes(F.col("value") > 0)))])
    return t.events.select(F.explode(facets).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, list_sort(list(CAST(l_quantity AS INTEGER)))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM lineitem GROUP BY 1")
def upper_median(t):  # A9
    return ag.grouped_upper_median(t.lineitem.withColumn("q", F.col("l_quantity").cast("int")), ["l_orderkey"], "q")


@query("""WITH v AS (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS q, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY q) AS upto, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM v)
SELECT l_suppkey, min(q) AS weighted_median FROM c WHERE upto * 2 >= total GROUP BY 1""")
def weighted_median(t):  # A11
    return ag.weighted_median(t.lineitem.withColumn("q", F.col("l_quantity").cast("int")), ["l_suppkey"], "q", "l_linenumber")


@query(f"SELECT o_custkey, o_orderkey, o_orderpriority, r AS rank FROM (SELECT *, {RANK_SQL} AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY {RANK_SQL}, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_by_rank(t):  # A14
    return ag.best_by_rank(t.orders, ["o_custkey"], rank_of("o_orderpriority"), ["o_orderkey"], ["o_orderkey", "o_orderpriority"])


@query("SELECT user_id, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY 1 HAVING max(value) - min(value) > 3")
def conflict_spread(t):  # A10 A21
    return ag.spread_conflicts(t.events, ["user_id"], "value", 3)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING bool_or(event_type = 'purchase') AND bool_or(event_type = 'error')")
def conflict_pairs(t):  # A21
    return ag.incompatible(t.events, ["user_id"], "event_type", [("purchase", "error")])


@query("SELECT trim(p_name) AS p_name, count(DISTINCT p_partkey) AS n, array_to_string(list_sort(list(DISTINCT p_partkey)), ',') AS keys FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def homonyms(t):  # A20
    return ag.homonyms(t.part, "p_name", "p_partkey").withColumn("keys", F.array_join("keys", ","))


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1")
def union_lists(t):  # A13 U2
    lists = t.orders.select("o_custkey", F.array("o_orderstatus").alias("statuses"), F.array("o_orderpriority").alias("priorities"))
    return ag.union_lists(lists, "o_custkey", ["statuses", "priorities"]).select("o_custkey", F.array_join("statuses", ",").alias("statuses"), F.array_join("priorities", ",").alias("priorities"))


@query("SELECT count(DISTINCT o_orderkey) AS distinct_numbers, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) - count(DISTINCT o_orderkey) AS duplicates, max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS missing FROM orders")
def numbering_audit(t):  # A18
    return ag.numbering_audit(t.orders, "o_orderkey")


@query("SELECT d.source, count(*) AS docs, count(l.doc_id) AS labelled, count(CASE WHEN l.toxic = 1 THEN 1 END) AS toxic, round(avg(d.n_chars), 4) AS avg_chars FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def layer_coverage(t):  # A6 A19
    x = t.documents.join(t.labels, "doc_id", "left")
    return x.groupBy("source").agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))


@query("""WITH x AS (SELECT d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT sum(CASE WHEN lang IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN source IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS filled, count(*) * 3 AS total,
round(sum(CASE WHEN lang IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN source IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END) / (count(*) * 3), 4) AS density FROM x""")
def extraction_density(t):  # A17
    return ag.density(t.documents.join(t.labels, "doc_id", "left"), ["lang", "source", "quality"])


@query("""SELECT a.l_orderkey, count(*) AS n, count(CASE WHEN a.l_returnflag <> a.l_linestatus THEN 1 END) AS differ FROM lineitem a GROUP BY 1""")
def match_counts(t):  # A16
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != F.col("l_linestatus")).alias("differ"))


@query("SELECT k, count(*) AS refs, count(DISTINCT p_partkey) AS parts FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS k FROM part) GROUP BY 1 ORDER BY refs DESC, k LIMIT 15")
def most_ambiguous(t):  # O5
    forms = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("k"))
    return forms.groupBy("k").agg(F.count("*").alias("refs"), F.count_distinct("p_partkey").alias("parts")).orderBy(F.desc("refs"), "k").limit(15)


# --- Joins


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT o_orderkey, CASE WHEN b.o_totalprice IS NULL THEN 'only_old' WHEN a.o_totalprice IS NULL THEN 'only_new' WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'changed' ELSE 'same' END AS state,
CASE WHEN a.o_totalprice IS NOT NULL AND b.o_totalprice IS NOT NULL AND a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' ELSE '' END AS changed FROM a FULL JOIN b USING (o_orderkey)""")
def keyed_compare(t):  # J15 J16 U1
    old = t.orders.where("o_orderstatus <> 'P'")
    new = t.orders.where("o_orderpriority <> '5-LOW'").withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")))
    return jn.keyed_compare(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def only_in_left(t):  # J14
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return jn.only_in_left(t.customer, urgent, "c_custkey").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def semi_lookup(t):  # S3
    return jn.known_only(t.part, t.lineitem.where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey").select("p_partkey", "p_name")


@query("""WITH k AS (SELECT p_partkey, p_name || ' ' || p_brand AS k1, p_name AS k2, p_brand || p_size AS k3 FROM part),
n AS (SELECT k.*, count(*) OVER (PARTITION BY k1) AS n1, count(*) OVER (PARTITION BY k2) AS n2, count(*) OVER (PARTITION BY k3) AS n3 FROM k)
SELECT p_partkey AS q, CASE WHEN n1 = 1 OR n2 = 1 OR n3 = 1 THEN p_partkey END AS p_partkey, CAST(CASE WHEN n1 = 1 THEN 1 WHEN n2 = 1 THEN 2 WHEN n3 = 1 THEN 3 END AS INTEGER) AS via FROM n""")
def unique_key_cascade(t):  # J5 J7 J12
    keys = [F.concat_ws(" ", "p_name", "p_brand"), F.col("p_name"), F.concat("p_brand", "p_size")]
    right = t.part.select("p_partkey", *[k.alias(f"r{i}") for i, k in enumerate(keys)])
    left = t.part.select(F.col("p_partkey").alias("q"), *[k.alias(f"l{i}") for i, k in enumerate(keys)])
    return jn.unique_key_cascade(left, right, ["l0", "l1", "l2"], ["r0", "r1", "r2"], "p_partkey").select("q", "p_partkey", "via")


@query("""SELECT o_orderkey, l_linenumber, distance FROM (SELECT o_orderkey, l_linenumber, abs(o_orderkey % 50 - CAST(l_quantity AS BIGINT)) AS distance,
row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(o_orderkey % 50 - CAST(l_quantity AS BIGINT)), l_linenumber) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE n = 1""")
def nearest_number(t):  # J8
    left = t.orders.select("o_orderkey", (F.col("o_orderkey") % 50).alias("a"))
    right = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").cast("long").alias("b"))
    return jn.nearest_join(left, right, ["o_orderkey"], "a", "b", ["l_linenumber"]).select("o_orderkey", "l_linenumber", "distance")


@query("SELECT p_partkey, s_suppkey, p_partkey - s_suppkey * 17 AS delta FROM part JOIN supplier ON abs(p_partkey - s_suppkey * 17) <= 2")
def band_join(t):  # J9
    right = t.supplier.withColumn("n", F.col("s_suppkey") * 17)
    return jn.band_join(t.part, right, "p_partkey", "n", 2).select("p_partkey", "s_suppkey", (F.col("p_partkey") - F.col("n")).alias("delta"))


WORDS_SQL = r"list_distinct(regexp_extract_all(lower(text), '\p{L}+'))"


@query(f"""WITH q AS (SELECT item_id, length(text) AS n, unnest({WORDS_SQL}) AS w FROM benchmark), d AS (SELECT doc_id, n_chars, unnest({WORDS_SQL}) AS w FROM documents),
p AS (SELECT item_id, doc_id, count(*) AS overlap FROM q JOIN d USING (w) WHERE abs(n - n_chars) <= 2000 GROUP BY 1, 2)
SELECT item_id, doc_id, overlap, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS r FROM p) WHERE r <= 20""")
def window_layer_join(t):  # J10 J11
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    q = t.benchmark.select("item_id", F.length("text").alias("n"), words.alias("qw"))
    d = t.documents.select("doc_id", "n_chars", words.alias("dw"))
    return jn.overlap_topk(q, d, "item_id", "qw", "doc_id", "dw", 20, keep=F.abs(F.col("n") - F.col("n_chars")) <= 2000)


@query(f"""WITH q AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark), d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents)
SELECT item_id, doc_id FROM q JOIN d ON len(q.w) > 0 AND list_has_all(d.w, q.w)""")
def token_containment(t):  # J3 X26
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    q = t.benchmark.select("item_id", words.alias("qw"))
    return jn.containment_join(q, t.documents.select("doc_id", words.alias("dw")), "item_id", "qw", "doc_id", "dw")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderdate + INTERVAL 60 DAY AS o_end FROM orders),
x AS (SELECT *, lead(o_orderkey) OVER w AS next_key, lead(o_orderdate) OVER w AS next_start FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, next_key, CASE WHEN next_start > o_end THEN 'impossible' WHEN date_diff('day', next_start, o_end) < 5 THEN 'tight' WHEN date_diff('day', next_start, o_end) < 10 THEN 'possible' ELSE 'certain' END AS verdict FROM x WHERE next_key IS NOT NULL""")
def interval_overlap(t):  # the same kind of verdict on dates
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = t.orders.select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 60 days")).alias("o_end"), F.lead("o_orderkey").over(w).alias("next_key"), F.lead("o_orderdate").over(w).alias("next_start")).where("next_key is not null")
    days = F.datediff("o_end", "next_start")
    return x.select("o_orderkey", "next_key", sc.cascade([(F.col("next_start") > F.col("o_end"), "impossible"), (days < 5, "tight"), (days < 10, "possible")], "certain").alias("verdict"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS d FROM lineitem) SELECT a.d AS a, b.d AS b, count(*) AS common FROM e a JOIN e b ON a.s = b.s AND a.d < b.d GROUP BY 1, 2""")
def common_neighbours(t):  # J22 J24
    return jn.common_neighbours(t.lineitem, "l_orderkey", "l_suppkey")


@query("""SELECT 'c' || o_custkey AS a, 'p' || l_partkey AS c, count(DISTINCT o_orderkey) AS ways FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def two_hop_paths(t):  # J23: customers reach parts over their orders
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    first = t.orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
    return jn.two_hops(first.union(t.lineitem.select(name("o", "l_orderkey"), name("p", "l_partkey"))))


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def lookup_names(t):  # J25 J13
    return t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END, p_type) AS p_brand, array_to_string(list_sort(list_distinct([p_name, p_type])), ',') AS names FROM part""")
def backfill(t):  # J17 J18 P10
    base = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("p_brand"), F.array("p_name").alias("names"))
    src = t.part.select("p_partkey", F.col("p_type").alias("p_brand"), F.array("p_type").alias("names"))
    return jn.backfill(base, src, "p_partkey", ["p_brand"], ["names"]).withColumn("names", F.array_join(F.array_sort("names"), ","))


# --- Windows


@query("""WITH x AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, lead(year(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ny FROM orders)
SELECT o_orderkey, CAST(y - ny AS INTEGER) AS gap, CASE WHEN y - ny >= 3 OR y - ny <= -2 THEN 'major' WHEN y - ny >= 2 OR y - ny <= -1 THEN 'minor' END AS severity FROM x WHERE ny IS NOT NULL""")
def adjacent_gap(t):  # W1 W2
    x = wn.neighbours(t.orders.withColumn("y", F.year("o_orderdate")), ["o_custkey"], ["o_orderdate", "o_orderkey"], "y").where("next_y is not null")
    gap = F.col("y") - F.col("next_y")
    return x.select("o_orderkey", gap.alias("gap"), wn.gap_severity(gap).alias("severity"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events")
def last_non_null_before(t):  # W3 X24
    return wn.last_before(t.events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase").select("event_id", "last_purchase")


@query("""WITH x AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS n FROM x WHERE event_type = 'error' GROUP BY user_id, g HAVING count(*) >= 2""")
def islands(t):  # W4
    runs = wn.islands(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 2)
    return runs.select("user_id", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"), "n")


@query("""WITH k AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), x AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS nx FROM k)
SELECT l_suppkey, l_partkey + 1 AS low, nx - 1 AS high FROM x WHERE nx > l_partkey + 1""")
def gap_ranges(t):  # W6 X22
    return wn.gap_ranges(t.lineitem, ["l_suppkey"], "l_partkey")


@query("""WITH k AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), x AS (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM k)
SELECT l_suppkey, min(l_partkey) AS low, max(l_partkey) AS high FROM x GROUP BY l_suppkey, g""")
def number_ranges(t):  # W6
    return wn.number_ranges(t.lineitem, ["l_suppkey"], "l_partkey")


@query("""SELECT o_orderkey, (SELECT arg_min(b.o_totalprice, b.rn) FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) b WHERE b.o_custkey = a.o_custkey AND b.rn BETWEEN a.rn + 1 AND a.rn + 9 AND b.o_totalprice > 200000) AS next_large
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) a""")
def next_valid_within_9(t):  # W5
    return wn.next_valid(t.orders, ["o_custkey"], ["o_orderkey"], F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")), "next_large").select("o_orderkey", "next_large")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '[0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS entry FROM l)
SELECT doc_id, CAST(entry AS BIGINT) AS entry, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS text FROM h WHERE entry > 0 GROUP BY 1, 2""")
def line_assembly(t):  # X4 X5 X9 X27
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return wn.assemble(lines, "doc_id", "i", "line", F.col("line").rlike("[0-9]"))


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 10")
def topk_stable(t):  # O1
    return wn.top_k(t.lineitem, ["l_returnflag"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 10).select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("""WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER w AS r, max(p_retailprice) OVER (PARTITION BY p_brand) AS top FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey))
SELECT p_brand, p_partkey, CAST(r AS INTEGER) AS rank FROM r WHERE r BETWEEN 2 AND 4 AND p_retailprice >= top - 100""")
def near_alternatives(t):  # O3
    return wn.near_best(t.part, ["p_brand"], "p_retailprice", 100.0, ["p_partkey"], 3).select("p_brand", "p_partkey", "rank")


@query("SELECT c_custkey, coalesce(TRY_CAST(regexp_extract(c_name, '([0-9]+)', 1) AS INTEGER), 99999) AS n FROM customer ORDER BY 2, 1 LIMIT 25 OFFSET 20")
def numeric_order_page(t):  # O4 P6
    n = F.coalesce(F.expr("try_cast(regexp_extract(c_name, '([0-9]+)', 1) as int)"), F.lit(99999))
    return t.customer.select("c_custkey", n.alias("n")).orderBy("n", "c_custkey").offset(20).limit(25)


# --- Text and extraction


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(html), 'casino|viagra') THEN 'spam' WHEN regexp_matches(lower(html), 'license') THEN 'license' WHEN regexp_matches(url, '/en/') THEN 'english' ELSE 'other' END AS category FROM pages""")
def regex_cascade(t):  # N34
    low = F.lower("html")
    return t.pages.select("page_id", sc.cascade([(low.rlike("casino|viagra"), "spam"), (low.rlike("license"), "license"), (F.col("url").rlike("/en/"), "english")], "other").alias("category"))


@query("""SELECT page_id, CAST(i - 1 AS INTEGER) AS i, h AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS i FROM pages)""")
def regex_extract_all(t):  # all matches of one pattern, the base of mentions
    return ex.mentions(t.pages, "page_id", "html", 'href="([^"]*)"').withColumnRenamed("value", "target")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages""")
def html_text(t):  # S13
    return t.pages.select("page_id", ex.html_text(F.col("html")).alias("text"))


@query("SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS arabic, CAST(o_orderkey AS INTEGER) AS back FROM orders")
def digits_translate(t):  # N11 N12 N13
    x = t.orders.select("o_orderkey", tx.to_arabic_digits(F.col("o_orderkey")).alias("arabic"))
    return x.withColumn("back", tx.strict_int(F.col("arabic")))


@query("""WITH f AS (SELECT p_partkey, unnest(list_distinct([p_name || ' ' || p_brand || ' ' || p_type, p_name || ' ' || p_brand, p_name || ' ' || p_type, p_name, split_part(p_name, ' ', 1) || ' ' || p_brand])) AS form FROM part)
SELECT p_partkey, form FROM f WHERE length(form) >= 3""")
def name_forms(t):  # distinct forms of other names
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    forms = tx.distinct_forms([F.concat_ws(" ", "p_name", "p_brand", "p_type"), F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_name", "p_type"), F.col("p_name"), F.concat_ws(" ", first, "p_brand")])
    return t.part.select("p_partkey", F.explode(forms).alias("form"))


@query("""SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS i, s AS sentence FROM (SELECT conv_id, turn, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?]\\s*'), lambda x: trim(x)), lambda x: length(x) > 15) AS p FROM conversations))""".replace("\\\\", "\\"))
def sentence_split(t):  # N30
    return t.conversations.select("conv_id", "turn", F.posexplode(sim.sentences(F.col("text"))).alias("i", "sentence"))


@query("SELECT p_partkey, substr(p_name, 1, 3) AS key3, split_part(p_name, ' ', 1) AS word1, length(p_name) - length(replace(p_name, ' ', '')) + 1 AS words FROM part")
def prefix_keys(t):  # N9 N10
    words = tx.words(F.col("p_name"))
    return t.part.select("p_partkey", F.substring("p_name", 1, 3).alias("key3"), tx.first_words(F.col("p_name"), 1).alias("word1"), F.size(words).cast("long").alias("words"))


GRAMS_SQL = "list_distinct(list_transform(range(1, greatest(2, length(b) - 1)), lambda i: substr(b, i, 3)))"


@query(f"""WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS b FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS b FROM documents),
qg AS (SELECT item_id, len(g) AS n, unnest(g) AS g FROM (SELECT item_id, {GRAMS_SQL} AS g FROM q WHERE length(b) >= 3)), dg AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM (SELECT doc_id, {GRAMS_SQL} AS g FROM d WHERE length(b) >= 3)),
p AS (SELECT item_id, doc_id, count(*) / (any_value(qg.n) + any_value(dg.n) - count(*)) AS s FROM qg JOIN dg USING (g) GROUP BY 1, 2)
SELECT item_id, doc_id, round(s, 6) AS similarity, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS r FROM p WHERE s > 0.03) WHERE r <= 5""")
def trigram_topk(t):  # T1 T2 N28 N29
    found = sim.search_texts(t.benchmark, t.documents, "item_id", "doc_id", F.col("text"), F.col("text"), 5)
    return found.select("item_id", "doc_id", F.round("similarity", 6).alias("similarity"), "rank")


# --- Graph


@query("""WITH x AS (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS component, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders)
SELECT o_orderkey AS node, component FROM x WHERE n > 1""")
def connected_components(t):  # G1: each order is linked with the next one of its customer and priority, so paths are long
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    c = gr.components(t.orders.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")))
    return c.join(c.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey ELSE o_orderkey - o_orderkey % 10 // 2 - 1 END AS t FROM orders),
r AS (SELECT k, t, 0 AS d FROM p UNION ALL SELECT r.k, p.t, d + 1 FROM r JOIN p ON p.k = r.t WHERE p.t <> p.k AND d < 40)
SELECT k AS key, arg_max(t, d) AS root FROM r GROUP BY 1""")
def pointer_chase(t):  # G6
    k = F.col("o_orderkey")
    p = t.orders.select(k.alias("key"), F.when(k % 10 == 0, k).otherwise(k - F.floor((k % 10) / 2) - 1).alias("to"))
    return ly.chase(p).select("key", "root")


EDGES = "SELECT DISTINCT l_suppkey AS teacher, 1000000000 + l_partkey AS student FROM lineitem"
NODES = "SELECT DISTINCT unnest([teacher, student]) AS key FROM e"
SEED_SQL = "CASE WHEN key % 7 = 0 THEN CAST(key % 3 + 5 AS INTEGER) END"
#: Rounds that the SQL unrolls; more than the operators take until nothing moves.
ROUNDS, RELAXED = 9, 50


def _layer_graph(t):
    e = t.lineitem.select(F.col("l_suppkey").alias("teacher"), (F.col("l_partkey") + 1_000_000_000).alias("student")).distinct()
    nodes = e.select(F.explode(F.array("teacher", "student")).alias("key")).distinct()
    return e, nodes.withColumn("layer", F.when(F.col("key") % 7 == 0, (F.col("key") % 3 + 5).cast("int")))


def _round_sql(i: int) -> str:
    return f"""v{i} AS MATERIALIZED (SELECT student AS key, layer + 1 AS v FROM e JOIN s{i - 1} ON key = teacher WHERE layer IS NOT NULL UNION ALL SELECT teacher, layer - 1 FROM e JOIN s{i - 1} ON key = student WHERE layer IS NOT NULL),
m{i} AS MATERIALIZED (SELECT key, list_sort(list(v))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS med, max(v) - min(v) > 3 AS wide FROM v{i} GROUP BY key),
s{i} AS MATERIALIZED (SELECT s.key, CASE WHEN s.layer IS NULL AND med IS NOT NULL AND NOT wide THEN greatest(1, least(12, med)) ELSE s.layer END AS layer FROM s{i - 1} s LEFT JOIN m{i} m ON m.key = s.key)"""


@query(f"WITH e AS MATERIALIZED ({EDGES}), s0 AS MATERIALIZED (SELECT key, {SEED_SQL} AS layer FROM ({NODES})), {', '.join(map(_round_sql, range(1, ROUNDS + 1)))} SELECT key, CAST(layer AS INTEGER) AS layer FROM s{ROUNDS}")
def propagate_layers(t):  # G7 G8
    e, layers = _layer_graph(t)
    return ly.propagate(e, layers).select("key", F.col("layer").cast("int").alias("layer"))


def _relax_sql(i: int) -> str:
    """Round i, and whether it was the last one: the summed change is below 1 and no node is new."""
    return f"""n{i} AS MATERIALIZED (SELECT x.key, CASE WHEN x.key % 7 = 0 THEN x.key % 3 + 5.0 ELSE avg(v) END AS layer FROM (SELECT student AS key, layer + 1.0 AS v FROM e JOIN r{i - 1} ON key = teacher UNION ALL SELECT teacher, layer - 1.0 FROM e JOIN r{i - 1} ON key = student UNION ALL SELECT key, NULL FROM r0) x GROUP BY x.key),
d{i} AS MATERIALIZED (SELECT stop OR last AS stop FROM (SELECT sum(coalesce(abs(n.layer - r.layer), 0)) < 1 AND NOT bool_or(r.key IS NULL) AS last FROM n{i} n LEFT JOIN r{i - 1} r ON r.key = n.key), d{i - 1}),
r{i} AS MATERIALIZED (SELECT key, layer FROM n{i}, d{i - 1} WHERE NOT stop UNION ALL SELECT key, layer FROM r{i - 1}, d{i - 1} WHERE stop)"""


@query(f"WITH e AS MATERIALIZED ({EDGES}), d0 AS (SELECT FALSE AS stop), r0 AS MATERIALIZED (SELECT key, CAST(key % 3 + 5 AS DOUBLE) AS layer FROM ({NODES}) WHERE key % 7 = 0), {', '.join(map(_relax_sql, range(1, RELAXED + 1)))} SELECT key, round(layer, 6) AS value FROM r{RELAXED}")
def relaxation(t):  # G9 A12
    e, layers = _layer_graph(t)
    return ly.relax(e, layers).select("key", F.round("value", 6).alias("value"))


@query(f"""WITH e AS ({EDGES}), s AS (SELECT key, {SEED_SQL} AS layer FROM ({NODES}))
SELECT a.key, CAST(coalesce(a.layer, b.layer) AS INTEGER) AS layer, CASE WHEN a.layer IS NOT NULL THEN 'own' WHEN b.layer IS NOT NULL THEN 'alias' END AS source FROM s a LEFT JOIN s b ON b.key = a.key - a.key % 7""")
def alias_layers(t):  # G10
    _, layers = _layer_graph(t)
    return ly.to_aliases(layers.select("key", (F.col("key") - F.col("key") % 7).alias("canonical")), layers)


# --- Grading, scores, validation


@query("""SELECT l_orderkey, count(*) AS n_links, CASE WHEN bool_or(l_returnflag = 'R') THEN 'weak' WHEN bool_or(l_linestatus = 'O') THEN 'unknown' WHEN bool_or(l_discount > 0.08) THEN 'fair' ELSE 'sound' END AS grade FROM lineitem GROUP BY 1""")
def weakest_link(t):  # A24
    return sc.weakest_link(t.lineitem, "l_orderkey", {"broken": F.col("l_returnflag") == "R", "unknown": F.col("l_linestatus") == "O", "fair": F.col("l_discount") > 0.08}, [("broken", "weak"), ("unknown", "unknown"), ("fair", "fair")], "sound")


SCORE_SQL = "CASE WHEN s_nationkey = c_nationkey THEN 3 ELSE 0 END + CASE WHEN s_acctbal > 5000 THEN 2 ELSE 0 END + CASE WHEN s_suppkey % 10 = c_custkey % 10 THEN 1 ELSE 0 END"


@query(f"""WITH x AS (SELECT c_custkey, s_suppkey, CAST({SCORE_SQL} AS DOUBLE) AS score FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
r AS (SELECT *, lead(score) OVER w AS runner_up, row_number() OVER w AS n FROM x WINDOW w AS (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey))
SELECT c_custkey, s_suppkey, score, CASE WHEN runner_up IS NOT NULL AND score - runner_up < 1 THEN 'ambiguous' WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE n = 1""")
def additive_score(t):  # C11 O1: a customer's candidates are its suppliers
    met = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    both = met.join(t.customer, "c_custkey").join(t.supplier, "s_suppkey")
    score, _ = sc.additive([("nation", F.col("s_nationkey") == F.col("c_nationkey"), F.lit(3)), ("balance", F.col("s_acctbal") > 5000, F.lit(2)), ("digit", F.col("s_suppkey") % 10 == F.col("c_custkey") % 10, F.lit(1))])
    return sc.decide(both.select("c_custkey", "s_suppkey", score.alias("score")), ["c_custkey"], "score", ["s_suppkey"], 5, 3, 1).drop("runner_up")


@query("""WITH e AS (SELECT o_custkey AS k, 'urgent' AS kind, 2.0 AS w FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, 'large', 1.5 FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT c_custkey, 'rich', 3.0 FROM customer WHERE c_acctbal > 8000),
s AS (SELECT k, count(DISTINCT kind) AS kinds, CAST(sum(w) AS DOUBLE) AS total FROM e GROUP BY 1)
SELECT k AS c_custkey, kinds, total, CASE WHEN total >= 10 THEN 'very strong' WHEN total >= 6 THEN 'strong' WHEN total >= 3 THEN 'moderate' WHEN total >= 1 THEN 'weak' ELSE 'insufficient' END AS label FROM s""")
def evidence_sum(t):  # M3 M6 N39
    row = lambda df, key, kind, w: df.select(F.col(key).alias("c_custkey"), F.lit(kind).alias("kind"), F.lit(w).alias("weight"))
    total = sc.evidence([row(t.orders.where("o_orderpriority = '1-URGENT'"), "o_custkey", "urgent", 2.0), row(t.orders.where("o_totalprice > 300000"), "o_custkey", "large", 1.5), row(t.customer.where("c_acctbal > 8000"), "c_custkey", "rich", 3.0)], "c_custkey")
    return total.withColumn("label", sc.assessment(F.col("total")))


@query("""SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN (d.n_chars >= 200) = (l.quality = 1) THEN 'match' ELSE 'wrong' END AS verdict FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def validation_verdicts(t):  # the same verdicts by a cascade
    d = t.documents.select("doc_id", (F.col("n_chars") >= 200).alias("ours"))
    x = t.labels.join(d, "doc_id", "left")
    return x.select("doc_id", sc.cascade([(F.col("ours").isNull(), "missing"), (F.col("ours") == (F.col("quality") == 1), "match")], "wrong").alias("verdict"))


@query("""SELECT doc_id, CASE WHEN r <= 500 THEN 'train' WHEN r <= 530 THEN 'validation' WHEN r <= 555 THEN 'test' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE n_chars >= 20) WHERE r <= 555""")
def fixed_split(t):  # P5 O7: a positional split keeps 555 rows, so the sort is a top-k
    first = t.documents.where("n_chars >= 20").orderBy("doc_id").limit(555)
    r = F.row_number().over(Window.orderBy("doc_id"))
    return first.select("doc_id", sc.cascade([(r <= 500, "train"), (r <= 530, "validation")], "test").alias("part"))


@query("""WITH c AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) SELECT d.doc_id, CASE WHEN d.n_chars < 100 THEN 'skip' ELSE 'ask' END AS action FROM documents d ANTI JOIN c USING (doc_id)""")
def resume_pending(t):  # S21 L5 P2
    return jn.only_in_left(t.documents, t.labels.select("doc_id"), "doc_id").select("doc_id", F.when(F.col("n_chars") < 100, "skip").otherwise("ask").alias("action"))


@query("""WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name || '*' ELSE p_name END AS p_name FROM part) SELECT * FROM b UNION ALL SELECT max(p_partkey) + 1, 'new' FROM part""")
def upsert_entries(t):  # S22 U3
    changed = t.part.where("p_partkey % 4 = 0").select("p_partkey", F.concat("p_name", F.lit("*")).alias("new_name"))
    base = t.part.select("p_partkey", "p_name").join(changed, "p_partkey", "left").select("p_partkey", F.coalesce("new_name", "p_name").alias("p_name"))
    return base.unionByName(t.part.agg((F.max("p_partkey") + 1).alias("p_partkey"), F.lit("new").alias("p_name")))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_totalprice > 200000 THEN 2 ELSE 3 END AS tier FROM orders WHERE o_orderstatus <> 'F' ORDER BY tier, o_orderkey LIMIT 100")
def priority_queue(t):  # P3 P4
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_totalprice") > 200000, 2).otherwise(3)
    return t.orders.where("o_orderstatus <> 'F'").select("o_orderkey", tier.alias("tier")).orderBy("tier", "o_orderkey").limit(100)


@query("SELECT c_custkey, c_name FROM customer WHERE (contains(lower(c_name), '7') OR contains(lower(c_mktsegment), 'auto')) AND c_acctbal > 0")
def facet_search(t):  # P6 P7
    return tx.any_contains(t.customer, ["c_name", "c_mktsegment"], ["7", "auto"]).where("c_acctbal > 0").select("c_custkey", "c_name")


@query("(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def set_operations(t):  # U1 U4
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    return a.subtract(b).unionByName(a.intersect(b))


# --- Beyond the reference: grouping sets and event-time windows


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(t):
    return t.lineitem.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("""WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM x)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_window(t):
    return t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


from . import library, names, people, storage, streams, texts  # noqa: E402, F401  their queries join the same tables
