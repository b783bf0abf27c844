"""Merging two sources of entries: overrides, validated identity links, clusters, merged statuses and layer pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import graph, layers

# Ranks of statuses when sources are merged, best first, and rulings that contradict each other.
MERGE_ORDER = ("thiqah", "muwaththaq", "hasan", "mamduh", "majhul", "daif", "unspecified")
CONTRADICTIONS = (("thiqah", "daif"), ("thiqah", "majhul"), ("muwaththaq", "daif"))

SCALARS = ("name_ar", "father", "grandfather", "kunyah", "laqab", "nisba", "status_detail", "hadith_count")
LISTS = ("narrates_from_imams", "books", "aliases", "narrates_from_narrators", "narrated_from_by")
UNIONED = ("narrates_from_imams", "narrates_from_narrators", "narrated_from_by", "books")


def merge_rank(c: Column) -> Column:
    out = F.lit(len(MERGE_ORDER))
    for i, s in enumerate(MERGE_ORDER):
        out = F.when(c == s, i).otherwise(out)
    return out


def override(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Layers set by hand (J6): by key, else by the entry's number; keys that begin with an underscore and layers outside 1-12 count for nothing. overrides: (key, tabaqah)."""
    good = overrides.where(~F.startswith("key", F.lit("_")) & F.col("tabaqah").between(1, 12)).groupBy("key").agg(F.min("tabaqah").alias("t"))
    by_key = good.select(F.col("key").alias("entry_key"), F.col("t").alias("__a"))
    rest = good.join(entries.select(F.col("entry_key").alias("key")), "key", "left_anti")
    by_number = rest.select(F.col("key").try_cast("int").alias("_entry_idx"), F.col("t").alias("__b")).dropna()
    out = entries.join(by_key, "entry_key", "left").join(by_number, "_entry_idx", "left")
    hand = F.coalesce("__a", "__b")
    return out.withColumns({"tabaqah": F.coalesce(hand.cast("double"), "tabaqah"), "tabaqah_source": F.when(hand.isNotNull(), "manual_override").otherwise(F.col("tabaqah_source"))}).select(*entries.columns)


def identity_links(entries: DataFrame, trusted: DataFrame) -> DataFrame:
    """(a, b): trusted links between known entries, and claimed ones whose names share two words, or one and the first name."""
    names = entries.select("entry_key", tx.significant(F.concat_ws(" ", F.col("name_ar"), F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))).alias("w"), tx.given_name(F.col("name_ar")).alias("g"))
    side = lambda k: names.select(F.col("entry_key").alias(k), F.col("w").alias(f"w{k}"), F.col("g").alias(f"g{k}"))
    claimed = entries.select(F.col("entry_key").alias("a"), F.explode("same_as_entry_nums").alias("b"))
    both = claimed.join(side("a"), "a").join(side("b"), "b")
    shared = tx.overlap(F.col("wa"), F.col("wb"))
    good = both.where((shared >= 2) | ((shared >= 1) & (F.col("ga") == F.col("gb")))).select("a", "b")
    known = trusted.join(names.select(F.col("entry_key").alias("a")), "a", "left_semi").join(names.select(F.col("entry_key").alias("b")), "b", "left_semi").select("a", "b")
    return good.union(known).distinct()


def clusters(entries: DataFrame, links: DataFrame, most: int = 6) -> DataFrame:
    """(entry_key, root): components of links; those of more than ``most`` entries fall apart; an entry without link is its own."""
    c = layers.split_large(graph.components(links), most).select(F.col("node").alias("entry_key"), "root")
    return entries.select("entry_key").join(c, "entry_key", "left").select("entry_key", F.coalesce("root", "entry_key").alias("root"))


def richness(c: Callable[[str], Column] = F.col) -> Column:
    """Filled fields, list lengths, 2 for a book, 3 for a definite status."""
    out = F.lit(0)
    for f in SCALARS:
        out = out + F.when(F.coalesce(c(f).cast("string"), F.lit("")) != "", 1).otherwise(0)
    for f in LISTS:
        out = out + F.coalesce(F.size(c(f)), F.lit(0))
    return out + F.when(F.coalesce(c("has_book"), F.lit(False)), 2).otherwise(0) + F.when(F.coalesce(c("status"), F.lit("unspecified")) != "unspecified", 3).otherwise(0)


def identities(entries: DataFrame, member: DataFrame, eras: dict[str, int]) -> DataFrame:
    """(root, canonical, n, status, status_conflict, era_conflict): the richest entry is canonical, ties to the greater key."""
    e = entries.join(member, "entry_key").withColumn("rich", richness())
    era = F.create_map(*[F.lit(x) for k, v in eras.items() for x in (k, v)]) if eras else F.create_map()
    spans = e.select("root", F.explode_outer("narrates_from_imams").alias("i")).select("root", F.try_element_at(era, "i").alias("era")).groupBy("root").agg((F.max("era") - F.min("era")).alias("span"))
    definite = F.when(F.col("status") != "unspecified", F.col("status"))
    has = {s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False)) for pair in CONTRADICTIONS for s in pair}
    conflict = F.lit(False)
    for a, b in CONTRADICTIONS:
        conflict = conflict | (has[a] & has[b])
    best = e.groupBy("root").agg(F.max(F.struct("rich", "entry_key", "status")).alias("c"), F.count("*").alias("n"), F.min_by(definite, F.when(definite.isNotNull(), F.col("src_ord"))).alias("first_definite"), conflict.alias("status_conflict"))
    own = F.when(F.col("c.status") != "unspecified", F.col("c.status"))
    return best.join(spans, "root", "left").select("root", F.col("c.entry_key").alias("canonical"), "n", F.coalesce(own, "first_definite", F.lit("unspecified")).alias("status"), "status_conflict", F.coalesce(F.col("span") > 1, F.lit(False)).alias("era_conflict"))


def merge(entries: DataFrame, summary: DataFrame, member: DataFrame) -> DataFrame:
    """Merged entries (G4). summary: (entry_key, summary_status), mapped to this table's keys.

    The summary's status wins unless unspecified; then a strictly better status of the cluster is taken over and its owner recorded;
    four list fields become the cluster's sorted union; aliases gain the other names of the cluster; layers are cleared.
    """
    e = entries.join(summary, "entry_key", "left").join(member, "entry_key")
    status = F.coalesce(F.when(F.col("summary_status") != "unspecified", F.col("summary_status")), "status", F.lit("unspecified"))
    e = e.withColumn("status", status)
    empty = F.array().cast("array<string>")
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, empty))))).alias(f"__{c}") for c in UNIONED]
    per = e.groupBy("root").agg(F.min(F.struct(merge_rank(F.col("status")).alias("r"), "src_ord", "status", "entry_key")).alias("__b"), F.array_sort(F.collect_set("name_ar")).alias("__names"), *union)
    out = e.join(per, "root")
    better = F.col("__b.r") < merge_rank(F.col("status"))
    made = {f: F.col(f"__{f}") for f in UNIONED}
    made["aliases"] = F.array_union(F.coalesce("aliases", empty), F.array_except("__names", F.array("name_ar")))
    made["status_inherited_from"] = F.when(better, F.col("__b.entry_key"))
    made["canonical_entry"] = F.col("root")
    made["tabaqah"], made["tabaqah_source"] = F.lit(None).cast("double"), F.lit(None).cast("string")
    return out.withColumns(made).withColumn("status", F.when(better, F.col("__b.status")).otherwise(F.col("status"))).select(*entries.columns, "status_inherited_from")


def infer_layers(entries: DataFrame, seeds: DataFrame, titles: DataFrame, rounds: int = 10) -> DataFrame:
    """(key, layer, source) in the order seeds, named authorities, network, aliases (G11, G12). Names of edges count where they name one entry."""
    key = entries.select(F.col("entry_key").alias("key"), F.coalesce("canonical_entry", "entry_key").alias("canonical"))
    refs = entries.select(F.col("entry_key").alias("key"), F.explode("narrates_from_imams").alias("name")).withColumn("name", tx.strip_honorific(F.col("name")))
    first = layers.seeds_from_references(refs, titles).select("key", F.col("layer").alias("by_title"))
    start = key.join(seeds.select("key", F.col("layer").alias("seed")), "key", "left").join(first, "key", "left").select("key", "canonical", F.coalesce("seed", "by_title").cast("int").alias("layer"))
    names = entries.select(tx.normalize(F.col("name_ar")).alias("n"), "entry_key").groupBy("n").agg(F.min("entry_key").alias("k"), F.count_distinct("entry_key").alias("c")).where("c = 1")
    named = lambda lists: entries.select("entry_key", F.explode(lists).alias("x")).select("entry_key", tx.normalize(F.col("x")).alias("n")).join(names, "n").select("entry_key", "k")
    edges = named("narrates_from_narrators").toDF("student", "teacher").select("teacher", "student").union(named("narrated_from_by").toDF("teacher", "student")).distinct()
    found = layers.propagate(edges, start.where("key = canonical").select("key", "layer"), rounds)
    own = start.select("key", "canonical").join(found.select("key", "layer"), "key", "left")
    return layers.to_aliases(own.select("key", "canonical"), own.select("key", "layer"))


def old_keys(entries: DataFrame) -> DataFrame:
    """One row: whether all keys that are numbers are written in Eastern digits, the older format (V3)."""
    eastern, plain = F.col("entry_key").rlike(f"[{tx.EASTERN}]"), F.col("entry_key").rlike("^[0-9]+$")
    return entries.agg((F.coalesce(F.bool_or(eastern), F.lit(False)) & ~F.coalesce(F.bool_or(plain), F.lit(False))).alias("old_format"))


def with_virtual(links: DataFrame, virtual: DataFrame) -> DataFrame:
    """Adds the fixed entry of names that stand for authorities or groups (C7a). virtual: (name, virtual_key, layer), normalised."""
    return links.join(virtual.withColumnRenamed("name", "__v"), tx.normalize(F.col("name")) == F.col("__v"), "left").drop("__v").withColumn("virtual", F.col("virtual_key").isNotNull())


def look_ahead(lines: DataFrame, by: str, order: str, text: str, n: int = 4) -> DataFrame:
    """Adds the next n lines as an array."""
    w = Window.partitionBy(by).orderBy(order)
    return lines.withColumn("ahead", F.array_compact(F.array(*[F.lead(text, i).over(w) for i in range(1, n + 1)])))


def unfold(pages: DataFrame, key: str, tree: str, children: str = "children", text: str = "text") -> DataFrame:
    """(key, pos, text) of a JSON tree in reading order."""
    import json

    kind = pages.schema[key].dataType.simpleString()

    def walk(node) -> Iterator[str]:
        if isinstance(node, list):
            for x in node:
                yield from walk(x)
        elif isinstance(node, dict):
            if isinstance(node.get(text), str) and node[text].strip():
                yield node[text].strip()
            yield from walk(node.get(children) or [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, p, t) for k, x in zip(b[key], b[tree], strict=True) for p, t in enumerate(walk(json.loads(x or "[]")))], columns=[key, "pos", "text"])

    return pages.select(key, tree).mapInPandas(run, f"{key} {kind}, pos int, text string")
