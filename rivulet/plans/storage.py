"""Queries of sources, sinks, search with weights, and the model interface. What they read they wrote before, below the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extractor as xt
from ..operators import similarity as sim
from ..sources import readers as rd
from ..sources.scratch import scratch_path
from .catalogue import query


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def stored_table(t):  # S15 S16
    path = scratch_path(t.nation.sparkSession)
    rd.store(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path, ["n_regionkey"])
    rd.store(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path, ["n_regionkey"])  # a rewrite replaces all
    return t.nation.sparkSession.read.parquet(path).select("n_nationkey", "n_name", F.col("n_regionkey").cast(t.nation.schema["n_regionkey"].dataType).alias("n_regionkey"))


@query("SELECT 1 AS version, count(*) AS n FROM region UNION ALL SELECT 2, count(*) FROM nation")
def stored_versions(t):  # S17
    spark = t.region.sparkSession
    path = scratch_path(spark)
    rd.store_version(t.region.select(F.col("r_name").alias("name")), path, 1)
    rd.store_version(t.nation.select(F.col("n_name").alias("name")), path, 2)
    return spark.read.parquet(path).groupBy("version").agg(F.count("*").alias("n"))


@query("SELECT 'json' AS form, p_partkey, p_name AS text FROM part UNION ALL SELECT 'csv', p_partkey, substr(p_name, 1, 5) FROM part")
def split_table(t):  # S18
    spark = t.part.sparkSession
    path = scratch_path(spark)
    rd.store_split(t.part.select("p_partkey", "p_name", "p_brand"), path, "p_brand", most_chars=5)
    whole = spark.read.schema("p_partkey long, p_name string").json(f"{path}/json").select(F.lit("json").alias("form"), "p_partkey", F.col("p_name").alias("text"))
    return whole.union(spark.read.schema("p_partkey long, p_name string, p_brand string").option("header", True).csv(f"{path}/csv").select(F.lit("csv"), "p_partkey", "p_name"))


def _as_one_file(rows, spark) -> str:
    """Writes the rows' texts as one file of lines."""
    path = scratch_path(spark)
    rows.coalesce(1).write.text(path)
    return path


@query("""SELECT 's' || s_suppkey AS entry_key, s_name AS name_ar, CASE WHEN s_suppkey % 2 = 0 THEN 'thiqah' END AS status, CAST(s_suppkey AS INTEGER) AS hadith_count, row_number() OVER (ORDER BY s_suppkey) - 1 AS src_ord FROM supplier""")
def json_entries(t):  # S1
    spark, s = t.supplier.sparkSession, F.col("s_suppkey")
    record = F.to_json(F.struct(F.col("s_name").alias("name_ar"), F.when(s % 2 == 0, "thiqah").alias("status"), s.cast("int").alias("hadith_count")))
    whole = t.supplier.agg(F.array_sort(F.collect_list(F.struct(s.alias("s"), F.concat(F.lit('"s'), s.cast("string"), F.lit('": '), record).alias("x")))).alias("l"))
    text = whole.select(F.concat(F.lit("{"), F.array_join(F.transform("l", lambda y: y["x"]), ","), F.lit("}")))
    return rd.json_objects(spark, _as_one_file(text, spark)).select("entry_key", "src_ord", "name_ar", "status", "hadith_count")


@query("SELECT CAST(n_nationkey AS INTEGER) AS idx, '1' AS n1, CAST(n_regionkey AS VARCHAR) AS n3, n_name AS text FROM nation")
def json_raw_entries(t):  # S7
    spark = t.nation.sparkSession
    record = F.to_json(F.struct(F.col("n_nationkey").cast("int").alias("idx"), F.lit("1").alias("n1"), F.col("n_regionkey").cast("string").alias("n3"), F.col("n_name").alias("text")))
    text = t.nation.agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]")))
    return rd.json_array(spark, _as_one_file(text, spark)).select("idx", "n1", "n3", "text")


@query("SELECT count(*) AS there, 0 AS missing FROM region")
def optional_tables(t):  # S8
    spark = t.region.sparkSession
    path = scratch_path(spark)
    rd.store(t.region.select("r_name"), path)
    n = lambda p: rd.optional(lambda: spark.read.parquet(p), spark, "r_name string").agg(F.count("*").alias("n"))
    return n(path).select(F.col("n").alias("there"), F.lit(1).alias("j")).join(n(path + "-none").select(F.col("n").alias("missing"), F.lit(1).alias("j")), "j").select("there", F.col("missing").cast("int").alias("missing"))


@query("SELECT r_regionkey, i AS line_no, CASE i WHEN 0 THEN r_name ELSE 'second ' || r_regionkey END AS line FROM region, (SELECT unnest([0, 1]) AS i)")
def text_lines(t):  # S9
    spark = t.region.sparkSession
    path = scratch_path(spark)
    t.region.select(F.concat("r_name", F.lit("\nsecond "), F.col("r_regionkey").cast("string")).alias("value"), "r_regionkey").write.partitionBy("r_regionkey").text(path)
    key = F.regexp_extract("file", "r_regionkey=([0-9]+)", 1).cast(t.region.schema["r_regionkey"].dataType)
    return rd.lines(spark, path).where("line <> ''").select(key.alias("r_regionkey"), "line_no", "line")


@query("SELECT r_regionkey, upper(r_name) || chr(10) AS text FROM region")
def scanned_files(t):  # S10 S11: the extractor stands for an engine that reads scans
    spark = t.region.sparkSession
    path = scratch_path(spark)
    t.region.select(F.lower("r_name").alias("value"), "r_regionkey").write.partitionBy("r_regionkey").text(path)
    read = rd.binary(spark, f"{path}/*/*.txt", lambda content: content.decode().upper())
    return read.select(F.regexp_extract("file", "r_regionkey(?:=|%3D)([0-9]+)", 1).cast(t.region.schema["r_regionkey"].dataType).alias("r_regionkey"), "text")


@query("SELECT n_name AS book, i AS id, n_name || ' record number ' || i AS text FROM nation, (SELECT unnest([0, 1, 2]) AS i) WHERE length(n_name || ' record number ' || i) >= 22")
def fetched_records(t):  # S12 S14: the client stands for a service
    books = [r[0] for r in t.nation.select("n_name").collect()]
    fetch = lambda book: [{"book": book, "id": i, "text": f"{book} record number {i}"} for i in range(3)]
    return rd.fetched(t.nation.sparkSession, books, fetch, "book string, id int, text string", "text", least=22)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 7 OR lower(s_name) = 'supplier#000000009'")
def looked_up(t):  # S2 S4 S5
    by_key = rd.lookup(t.supplier, "s_suppkey", 7)
    return by_key.select("s_suppkey", "s_name").union(rd.equal_name(t.supplier, "s_name", "SUPPLIER#000000009", F.lower).select("s_suppkey", "s_name"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'bad' ELSE 'good' END AS part FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def pending_orders(t):  # S20 S21
    rest = rd.pending(t.orders, t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    good, bad = rd.quarantine(rest, F.col("o_totalprice") > 400000)
    return good.select("o_orderkey", F.lit("good").alias("part")).union(bad.select("o_orderkey", F.lit("bad")))


@query("SELECT CAST(max(c_custkey) + 1 AS VARCHAR) AS c_custkey FROM customer")
def next_free_key(t):  # S22
    return rd.next_key(t.customer.select(F.col("c_custkey").cast("string").alias("c_custkey")), "c_custkey")


GRAMS = "list_distinct(list_transform(range(1, greatest(2, length(b) - 1)), lambda i: substr(b, i, 3)))"
CLEAN = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query(f"""WITH q AS (SELECT item_id, {GRAMS} AS g FROM (SELECT item_id, substr({CLEAN}, 1, 300) AS b FROM benchmark) WHERE length(b) >= 3), d AS (SELECT doc_id, source, {GRAMS} AS g FROM (SELECT doc_id, source, substr({CLEAN}, 1, 300) AS b FROM documents) WHERE length(b) >= 3),
p AS (SELECT item_id, doc_id, count(*) AS c, any_value(qn) AS qn, any_value(dn) AS dn FROM (SELECT item_id, len(g) AS qn, unnest(g) AS x FROM q) JOIN (SELECT doc_id, len(g) AS dn, unnest(g) AS x FROM d) USING (x) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, c / (qn + dn - c) AS similarity, source FROM p JOIN documents USING (doc_id) WHERE c / (qn + dn - c) > 0.03), w AS (SELECT *, similarity * CASE WHEN contains(source, '1') THEN 3.0 WHEN contains(source, '2') THEN 1.5 ELSE 1.0 END AS score FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS r FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE r = 1)
SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def weighted_search(t):  # T1 T2 T3 T4 O2: parents are the sources, and what was shown are the labelled documents
    docs = t.documents
    weights = docs.select("doc_id", F.col("source").alias("parent"), sim.name_weight(F.col("source"), {"1": 3.0, "2": 1.5}).alias("weight"))
    found = sim.search(sim.index(t.benchmark, "item_id", F.col("text")), sim.index(docs, "doc_id", F.col("text")), "item_id", "doc_id", 3, weight=weights, parent="parent")
    return sim.not_shown(found, t.labels, "doc_id").select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH x AS (SELECT p_partkey, {GRAMS.replace("b,", "p_name,").replace("length(b)", "length(p_name)")} AS a, list_distinct(list_transform(range(1, greatest(2, length(p_type) - 1)), lambda i: substr(lower(p_type), i, 3))) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS similarity FROM x""")
def sql_similarity(t):  # L1 N29
    spark = t.part.sparkSession
    xt.register(spark)
    return t.part.select("p_partkey", F.round(F.expr("trigram_similarity(p_name, p_type)"), 6).alias("similarity"))


def _answer(prompt: str) -> str:
    """A client that stands for a model: the first word of each numbered entry, and two records where an entry has a colon."""
    rows = [line.split(": ", 1)[1] for line in prompt.splitlines() if line.startswith("# ")]
    return json.dumps([[{"first": r.split(" ")[0]}, {"first": "second"}] if ":" in r else {"first": r.split(" ")[0]} for r in rows])


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS entry_key, split_part(n_name, ' ', 1) AS first FROM nation UNION ALL SELECT n_nationkey || '_overflow_1', 'second' FROM nation WHERE n_nationkey % 5 = 0""")
def extracted_records(t):  # L2 L3
    text = F.when(F.col("n_nationkey") % 5 == 0, F.concat("n_name", F.lit(" : more"))).otherwise(F.col("n_name"))
    rows = xt.extract(t.nation.select(F.col("n_nationkey").cast("int").alias("idx"), text.alias("text")), "idx", "text", ["first"], _answer, size=4)
    return xt.entry_keys(rows, "idx").select("entry_key", "first")


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c.c_custkey, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'auto' ELSE 'ask' END AS route, c_name || chr(10) || c_mktsegment AS prompt FROM c JOIN customer USING (c_custkey)""")
def routed_questions(t):  # L4 L5
    n = t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_name", "c_mktsegment").agg(F.count("o_orderkey").alias("n"))
    return n.select("c_custkey", xt.route(F.col("n")).alias("route"), xt.prompt([F.col("c_name"), F.lit(None).cast("string"), F.col("c_mktsegment")]).alias("prompt"))


@query("""WITH r AS (SELECT p_brand, p_name, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
SELECT p_brand, string_agg(p_name || chr(10) || '=> ' || p_type, chr(10) || chr(10) ORDER BY n DESC) AS prompt FROM r WHERE n <= 3 GROUP BY 1""")
def example_prompts(t):  # T5
    return xt.shots(t.part, "p_brand", "p_name", "p_type", "p_partkey", 3)


@query("""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, trim(part, ' ' || chr(10) || chr(9) || chr(13)) AS part FROM x WHERE length(trim(part, ' ' || chr(10) || chr(9) || chr(13))) > 10""")
def paragraphs(t):  # T5
    each = t.documents.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("i", "part"))
    return each.withColumn("part", F.regexp_replace("part", r"^[ \t\n\r]+|[ \t\n\r]+$", "")).where(F.length("part") > 10)


@query("SELECT o_orderkey, NOT (length(n) > 55 OR starts_with(n, 'فقال ')) AS is_link FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'زرارة' WHEN 1 THEN 'فقال الرجل' ELSE repeat('كلمة ', 12) END AS n FROM orders)")
def link_segments(t):  # P9
    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, "زرارة").when(k == 1, "فقال الرجل").otherwise("كلمة " * 12)
    return t.orders.select("o_orderkey", tx.is_link(name).alias("is_link"))


@query("SELECT o_orderpriority || ' | ' || count(*) AS line FROM orders GROUP BY o_orderpriority")
def stored_report(t):  # S19
    spark = t.orders.sparkSession
    path = scratch_path(spark)
    rd.store_report(t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), path, ["o_orderpriority", "n"], ["o_orderpriority"])
    return spark.read.text(path).withColumnRenamed("value", "line")


def _layer_of(prompt: str) -> str:
    """A client that stands for a model: the number of letters of each entry's last word."""
    return json.dumps([{"tabaqah": len(line.split()[-1])} for line in prompt.splitlines() if line.startswith("# ")])


@query("""SELECT 'n' || n_nationkey AS entry_key, CAST(length(n_name) - length(rtrim(n_name)) + length(list_last(string_split(n_name, ' '))) AS INTEGER) AS tabaqah, 'inferred_llm' AS tabaqah_source FROM nation WHERE n_nationkey % 4 > 0 AND length(list_last(string_split(n_name, ' '))) BETWEEN 1 AND 12""")
def model_layers(t):  # L6
    k = F.col("n_nationkey")
    e = t.nation.select(F.concat(F.lit("n"), k.cast("string")).alias("entry_key"), k.cast("int").alias("idx"), F.lit("x").alias("name_ar"), F.concat(F.lit("a text on "), F.col("n_name")).alias("text"), F.when(k % 4 == 0, 3).alias("tabaqah"))
    return xt.infer_layers(e, _layer_of, size=4)
