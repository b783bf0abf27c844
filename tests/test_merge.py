import pytest
from pyspark.sql import functions as F

from rivulet.operators import merge, scan
from rivulet.sources.readers import ENTRY


def entries(spark, *rows):
    names = ["entry_key", "src_ord", *ENTRY.fieldNames()]
    schema = "entry_key string, src_ord int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTRY.fields)
    return spark.createDataFrame([tuple({"src_ord": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], schema)


@pytest.fixture(scope="module")
def people(spark):
    return entries(
        spark,
        {"entry_key": "1", "_entry_idx": 1, "name_ar": "محمد بن مسلم الثقفي", "status": "unspecified", "same_as_entry_nums": ["2", "3"], "books": ["a"]},
        {"entry_key": "2", "_entry_idx": 2, "name_ar": "محمد بن مسلم", "status": "thiqah", "books": ["b"], "narrates_from_imams": ["الباقر (ع)"]},
        {"entry_key": "3", "_entry_idx": 3, "name_ar": "زرارة بن اعين", "status": "daif", "narrates_from_narrators": ["محمد بن مسلم"]},
    )


def test_links_clusters_and_merge(spark, people):
    trusted = spark.createDataFrame([], "a string, b string")
    links = merge.identity_links(people, trusted)
    assert [tuple(r) for r in links.collect()] == [("1", "2")]
    member = merge.clusters(people, links)
    assert {r.root for r in member.where("entry_key in ('1', '2')").collect()} != {r.root for r in member.where("entry_key = '3'").collect()}
    ids = {r.n: r for r in merge.identities(people, member, {"الباقر (ع)": 2}).collect()}
    assert ids[2].canonical == "2" and ids[2].status == "thiqah" and not ids[2].status_conflict
    out = {r.entry_key: r for r in merge.merge(people, spark.createDataFrame([("3", "majhul")], "entry_key string, summary_status string"), member).collect()}
    assert out["1"].status == "thiqah" and out["1"].status_inherited_from == "2" and out["1"].books == ["a", "b"] and out["1"].aliases == ["محمد بن مسلم"]
    assert out["3"].status == "majhul" and out["3"].status_inherited_from is None


def test_overrides_and_layers(spark, people):
    over = spark.createDataFrame([("1", 7), ("_comment", 3), ("2", 99)], "key string, tabaqah int")
    assert {r.entry_key: r.tabaqah for r in merge.override(people, over).collect()} == {"1": 7.0, "2": None, "3": None}
    titles = spark.createDataFrame([("الباقر", 4)], "title string, layer int")
    seeds = spark.createDataFrame([], "key string, layer int")
    got = {r.key: r.layer for r in merge.infer_layers(people, seeds, titles, 3).collect()}
    assert got == {"1": None, "2": 4, "3": 5}


def test_monotone_matching_and_trees(spark):
    wanted = spark.createDataFrame([("g", i, k) for i, k in enumerate(["a", "b", "a", "c", "a"])], "g string, o int, k string")
    headers = spark.createDataFrame([("g", p, k) for p, k in [(10, "a"), (20, "b"), (30, "a")]], "g string, p int, k string")
    assert [tuple(r) for r in scan.monotone_match(wanted, headers, "g", "o", "k", "p").orderBy("o").collect()] == [("g", 0, 10), ("g", 1, 20), ("g", 2, 30), ("g", 4, 10)]
    tree = spark.createDataFrame([(1, '[{"text": "x", "children": [{"text": "y"}]}, {"text": " "}]'), (2, None)], "k int, t string")
    assert [tuple(r) for r in merge.unfold(tree, "k", "t").orderBy("pos").collect()] == [(1, 0, "x"), (1, 1, "y")]
    keys = spark.createDataFrame([("١",), ("x",)], "entry_key string")
    assert merge.old_keys(keys).first()[0] and not merge.old_keys(keys.union(spark.createDataFrame([("2",)], "entry_key string"))).first()[0]
    assert merge.look_ahead(tree.withColumn("b", F.lit(1)), "b", "k", "t", 2).count() == 2
