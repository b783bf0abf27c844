import json

from pyspark.sql import functions as F

from rivulet.sources import readers
from rivulet.streaming import chains


def test_json_objects_and_arrays(spark, tmp_path):
    (tmp_path / "db.json").write_text(json.dumps({"3": {"name_ar": "آدم", "aliases": ["x"], "tabaqah": 5}, "10_overflow_1": {"name_ar": "زيد"}}, ensure_ascii=False))
    got = readers.json_objects(spark, str(tmp_path / "db.json")).orderBy("src_ord").collect()
    assert [(r.entry_key, r.name_ar, r.aliases, r.tabaqah) for r in got] == [("3", "آدم", ["x"], 5.0), ("10_overflow_1", "زيد", None, None)]
    assert readers.next_key(readers.json_objects(spark, str(tmp_path / "db.json")), "entry_key").first()[0] == "4"
    (tmp_path / "raw.json").write_text(json.dumps([{"idx": 0, "n1": "١", "text": "a"}, {"idx": 1}]))
    assert readers.json_array(spark, str(tmp_path / "raw.json")).count() == 2
    assert readers.optional(lambda: spark.read.parquet(str(tmp_path / "none")), spark, "a int").count() == 0


def test_lines_sinks_and_resume(spark, tmp_path):
    (tmp_path / "v1.md").write_text("one\ntwo\r\n\nthree")
    assert [r.line for r in readers.lines(spark, str(tmp_path / "*.md")).orderBy("line_no").collect()] == ["one", "two", "", "three"]
    df = spark.createDataFrame([(1, "a" * 300, "p"), (2, None, "q")], "k int, t string, part string")
    readers.store_split(df, str(tmp_path / "out"), "part")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).agg(F.max(F.length("t"))).first()[0] == 200
    assert spark.read.json(str(tmp_path / "out/json")).count() == 2
    assert readers.store_version(df, str(tmp_path / "v"), 1).endswith("version=000001")
    assert [r.k for r in readers.pending(df, df.where("k = 1"), "k").collect()] == [2]
    good, bad = readers.quarantine(df, F.col("t").isNull())
    assert good.count() == bad.count() == 1
    got = readers.fetched(spark, ["b1", "b2"], lambda b: [{"id": b, "text": b * 10}, {"id": b, "text": "short"}], "id string, text string", "text")
    assert got.count() == 2
    assert readers.pick_random(df, 1, 7, "k").count() == 1


def test_chains_are_graded_as_they_arrive_and_resume(spark, tmp_path):
    index = spark.createDataFrame([("زرارة", "thiqah", 10, None), ("احمد بن محمد", "daif", 1, None)], "form string, status string, hadith_count int, sect string")
    folder, seen = str(tmp_path / "in"), []
    make = lambda rows: spark.createDataFrame(rows, "chain_id long, text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(folder)
    make([(1, "زرارة"), (2, "أحمد بن محمد، عن زرارة")])
    for extra in ([(3, "غيره عن زرارة")], []):
        chains.grade_into(chains.source(spark, folder), index, str(tmp_path / "out"), str(tmp_path / "cp"), lambda df, n: seen.append(n)).awaitTermination()
        if extra:
            make(extra)
    got = {r.chain_id: r.grade for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "Sahih", 2: "Da'if", 3: "Undetermined"} and seen == [0, 1]


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    for name, df, mode in (("tumbling", chains.counts(stream, "1 hour"), "complete"), ("per_session", chains.sessions(stream), "complete"), ("state", chains.running_totals(stream), "update"), ("once", chains.deduplicated(stream, "event_id"), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    n = events.count()
    assert spark.sql("select sum(n) from tumbling").first()[0] == n == spark.sql("select sum(n) from per_session").first()[0] == spark.sql("select sum(n) from state").first()[0] == spark.sql("select count(*) from once").first()[0]
