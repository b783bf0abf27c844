"""Chains as a whole, and matching of two books' entries (C7, C7d, C7e, J8, J9, J11, A26, X23, X24, W7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import drop, written
from .aggregates import weighted_median
from .chain import expected_range
from .joins import band_join, shared_tokens
from .merge import with_virtual
from .recovery import asof
from .resolver import resolve
from .scoring import cascade
from .windows import top_k

#: Weights of a layer that an authority and one that a teacher gives.
BY_AUTHORITY, BY_TEACHER = 2.0, 1.0


def estimate_layers(names: DataFrame, index: DataFrame, entries: DataFrame, titles: dict[str, int]) -> DataFrame:
    """(name, layer) of names by what their candidates' authorities and teachers say (C7d): students stand one layer below.

    The weighted median of a candidate's votes is its layer; the median of the candidates', weighted by their reports, is the name's.
    """
    n = names.select("name", tx.normalize(F.col("name")).alias("form")).distinct()
    other = F.when(F.startswith("form", F.lit("ال")) & (F.length(F.split_part("form", F.lit(" "), F.lit(1))) > 2), F.substr("form", F.lit(3))).otherwise(F.concat(F.lit("ال"), "form"))
    asked = n.where("form <> ''").select("name", F.explode(F.array("form", other)).alias("form"))
    met = asked.join(index.select("form", "entry_key"), "form").select("name", "entry_key").distinct()
    known = entries.select("entry_key", "src_ord", "tabaqah", "hadith_count", "narrates_from_imams", "narrates_from_narrators")
    of = met.select("entry_key").distinct().join(known, "entry_key")
    table = F.array(*[F.struct(F.lit(tx_title).alias("title"), F.lit(float(layer)).alias("layer")) for tx_title, layer in titles.items()])
    said = of.select("entry_key", F.explode("narrates_from_imams").alias("i")).select("entry_key", F.explode(F.filter(table, lambda x: F.contains(tx.normalize(F.col("i")), x["title"]) | F.contains(x["title"], tx.normalize(F.col("i"))))).alias("t"))
    by_authority = said.select("entry_key", (F.col("t.layer") + 1).alias("vote"), F.lit(BY_AUTHORITY).alias("weight"))
    first = index.join(known.select("entry_key", "src_ord", "tabaqah"), "entry_key").groupBy("form").agg(F.min(F.struct("src_ord", "tabaqah")).alias("f")).select("form", F.col("f.tabaqah").alias("layer"))
    taught = of.select("entry_key", F.explode("narrates_from_narrators").alias("t")).select("entry_key", tx.normalize(F.col("t")).alias("form")).join(first, "form").where("layer is not null")
    votes = by_authority.union(taught.select("entry_key", (F.col("layer") + 1).alias("vote"), F.lit(BY_TEACHER).alias("weight")))
    each = weighted_median(votes, ["entry_key"], "vote", "weight").withColumnRenamed("weighted_median", "layer")
    both = met.join(each, "entry_key").join(known.select("entry_key", F.coalesce(F.nullif("hadith_count", F.lit(0)), F.lit(1)).alias("reports")), "entry_key")
    return weighted_median(both, ["name"], "layer", "reports").withColumnRenamed("weighted_median", "layer")


def gap_type(name: Column, layer: Column, next_layer: Column) -> Column:
    """How a link breaks the chain (C7e): by its words, or by the layers between it and the next one."""
    gap = layer - next_layer
    return cascade([(tx.normalize(name).isin("عمن رواه", "عمن ذكره"), "mursal"), (gap >= 3, "mursal"), (gap == 2, "munqati"), (gap <= -2, "mudal")], None)


def analyse_chains(chains: DataFrame, index: DataFrame, entries: DataFrame, virtual: DataFrame, titles: dict[str, int]) -> DataFrame:
    """(chain_id, pos, name, asked, virtual_key, entry_key, layer, low, high, irsal_type) of every link.

    A link's expected layers follow from the resolved layer of the link before and the layer that the next name has or is estimated to
    have; "his father" asks for the father of the last resolved link. So links are resolved place by place, all chains at once: there are as many
    rounds as links in the longest chain. chains: (chain_id, names); virtual: (name, virtual_key, layer) of names that stand for authorities.
    """
    w = Window.partitionBy("chain_id").orderBy("pos")
    index = index if hasattr(index, "_rivulet_path") else written(index)  # every place reads it
    links = with_virtual(chains.select("chain_id", F.posexplode("names").alias("pos", "name")), virtual).withColumnRenamed("layer", "v_layer")
    guess = written(estimate_layers(links.where("not virtual").select("name"), index, entries, titles))
    links = links.join(guess.withColumnRenamed("layer", "guess"), "name", "left")
    links = written(links.withColumns({"next_layer": F.lead(F.coalesce("v_layer", "guess")).over(w), "prev_name": F.lag("name").over(w), "next_name": F.lead("name").over(w)}))
    people = entries.select("entry_key", F.col("tabaqah").alias("found"), "father", "grandfather")
    last, out = None, []
    longest = links.agg(F.max("pos")).first()[0]
    for p in range(0 if longest is None else longest + 1):
        now = links.where(F.col("pos") == p)
        if last is None:
            now = now.withColumns({"prev_layer": F.lit(None).cast("double"), "dad": F.lit(None).cast("string"), "granddad": F.lit(None).cast("string")})
        else:
            now = now.join(last.select("chain_id", F.col("after").alias("prev_layer"), "dad", "granddad"), "chain_id", "left")
        n = tx.normalize(F.col("name"))
        now = now.withColumn("asked", F.when(n.isin("ابيه", "ابوه"), F.col("dad")).when(n == "جده", F.col("granddad")).otherwise(F.col("name")))
        r = expected_range(F.col("prev_layer"), F.col("next_layer"))
        now = written(now.withColumns({"low": r["low"], "high": r["high"]}))
        one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
        queries = now.where("not virtual and asked is not null").select(F.col("chain_id").alias("query_id"), F.col("asked").alias("name"), one("next_name").alias("teachers"), one("prev_name").alias("students"), F.lit("").alias("book"), "low", "high")
        best = resolve(queries, index, entries, 1).select(F.col("query_id").alias("chain_id"), "entry_key").join(people, "entry_key")
        done = now.join(best, "chain_id", "left").withColumn("layer", F.coalesce("v_layer", "found"))
        # Who is resolved and no authority is the anchor of relatives behind them.
        own = F.col("entry_key").isNotNull()
        done = written(done.select("chain_id", "pos", "name", "asked", "virtual_key", "entry_key", "layer", "low", "high", gap_type(F.col("name"), F.col("layer"), F.col("next_layer")).alias("irsal_type"), F.col("layer").alias("after"), F.when(own, F.col("father")).otherwise(F.col("dad")).alias("dad"), F.when(own, F.col("grandfather")).otherwise(F.col("granddad")).alias("granddad")))
        drop(now)
        out.append(done.drop("after", "dad", "granddad"))
        last = done
    drop(guess)
    every = out[0] if out else links.select("chain_id", "pos", "name", F.col("name").alias("asked"), "virtual_key", F.lit(None).cast("string").alias("entry_key"), F.lit(None).cast("double").alias("layer"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("string").alias("irsal_type"))
    for more in out[1:]:
        every = every.union(more)
    return every


# --- Entries of one book in another


# Words that two names share too easily.
COMMON = ("بن", "ابن", "ابو", "ابي", "الكوفي")


def map_summary(summary: DataFrame, main: DataFrame) -> DataFrame:
    """(number, key): the entry of ``main`` that each summary row stands for (J8): of equal names the nearest number, else an equal number that shares a word.

    summary: (number, name); main: (key, number, name, ord). A row without number is at the place behind its own key.
    """
    s = summary.select("number", tx.for_merge(F.col("name")).alias("n"))
    m = main.select("key", "ord", F.coalesce("number", F.col("key").try_cast("int") + 1).alias("at"), F.col("number").alias("m_number"), tx.for_merge(F.col("name")).alias("m"))
    # The nearest number stands next to the row in the order of its name's numbers, so equal names form no pairs.
    asked = s.where("n <> '' and number is not null").distinct().withColumn("at", F.col("number").cast("long"))
    placed = m.withColumn("at", F.col("at").cast("long")).groupBy(F.col("m").alias("n"), "at").agg(F.min(F.struct("ord", "key")).alias("o"))
    beside = asof(asked, placed.where("at is not null"), ["n"], "at", ["o"])
    # Entries without any place count as far away.
    lost = placed.where("at is null").select("n", F.struct(F.lit(999999).cast("long").alias("d"), "o.ord", "o.key").alias("lost"))
    side = lambda x: F.when(F.col(f"{x}_at").isNotNull(), F.struct(F.abs(F.col(f"{x}_at") - F.col("at")).alias("d"), F.col(f"{x}_o.ord").alias("ord"), F.col(f"{x}_o.key").alias("key")))
    named = beside.join(lost, "n", "left").select("number", F.least(side("before"), side("after"), "lost").alias("b")).groupBy("number").agg(F.min("b").alias("b")).select("number", F.col("b.key").alias("by_name"))
    content = lambda c: F.array_except(tx.words(F.col(c)), F.array(*map(F.lit, COMMON)))
    same = s.join(m, F.col("number") == F.col("m_number")).where(F.arrays_overlap(content("n"), content("m"))).groupBy("number").agg(F.min(F.struct("ord", "key")).alias("b")).select("number", F.col("b.key").alias("by_number"))
    both = s.select("number").distinct().join(named, "number", "left").join(same, "number", "left")
    return both.select("number", F.coalesce("by_name", "by_number").alias("key")).where("key is not null")


def match_numbers(asked: DataFrame, entries: DataFrame, width: int = 2, least: float = 0.75) -> DataFrame:
    """(query_id, number, entry_key, score): at each number of a query the entry within ``width`` whose name fits best, if well enough (J9); an entry counts once, at its first number.

    asked: (query_id, name, number); entries: (entry_key, e_number, e_name).
    """
    near = band_join(asked, entries, "number", "e_number", width)
    scored = near.withColumn("score", tx.name_score(F.col("name"), F.col("e_name"))).where(F.col("score") > 0)
    best = top_k(scored, ["query_id", "number"], [F.desc("score"), F.desc("entry_key")], 1).where(F.col("score") >= least)
    return top_k(best.drop("rank"), ["query_id", "entry_key"], ["number"], 1).select("query_id", "number", "entry_key", "score")


def boosted_overlap(asked: DataFrame, entries: DataFrame, k: int = 25, boost: int = 5) -> DataFrame:
    """(query_id, entry_key, score, rank): entries by shared words of any name, ``boost`` more for each name of the query that stands inside one of theirs.

    asked: (query_id, names); entries: (entry_key, names, ord); keys are unique. A name inside another one shares its words, so all candidates come from the words. The score follows from
    the names alone: equal lists of names are compared once, and of entries with equal names only the first k can be among the k best. Shared words are counted without joining rows by frequent words.
    """
    normal = lambda c: F.transform(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: tx.normalize(x))
    words = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda x: tx.words(x))))
    named = asked.select("query_id", normal(F.col("names")).alias("qn")).where("qn is not null")
    # Sorted, for the score doesn't depend on the order of names.
    q = written(named.withColumn("qn", F.array_sort("qn")))
    first = top_k(entries.select("entry_key", "ord", F.array_sort(normal(F.col("names"))).alias("en")).where("en is not null"), ["en"], ["ord", "entry_key"], k)
    e = written(first.groupBy("en").agg(F.array_sort(F.collect_list(F.struct("ord", "entry_key"))).alias("first")))
    pairs = shared_tokens(q.select("qn").distinct().withColumn("qw", words(F.col("qn"))), e.withColumn("ew", words(F.col("en"))), "qn", "qw", "ew")
    inside = F.size(F.filter("qn", lambda x: F.exists("en", lambda y: F.contains(y, x))))
    scored = pairs.select("qn", "first", (F.col("overlap") + boost * inside).alias("score"))
    # A list of names with a smaller score can't push in between: of the lists only k can hold one of the k best entries, for each has a first one.
    lists = top_k(scored, ["qn"], [F.desc("score"), "first"], k).drop("rank")
    each = lists.select("qn", "score", F.explode("first").alias("e")).select("qn", "score", "e.ord", "e.entry_key")
    best = top_k(each, ["qn"], [F.desc("score"), "ord", "entry_key"], k)
    return q.join(best, "qn").select("query_id", "entry_key", "score", "rank")


# --- Lines, gaps and counters


def preceding(lines: DataFrame, by: str, order: str, text: str, n: int = 3) -> DataFrame:
    """Adds ``before``, the last n lines before each that are not blank."""
    w = Window.partitionBy(by).orderBy(order)
    # A filled line knows the n - 1 filled ones before it; each line takes over what the last filled line before it knows.
    full = lines.where(tx.strip(F.col(text)) != "").select(by, order, F.array_compact(F.array(*[F.lag(text, i).over(w) for i in range(n - 1, -1, -1)])).alias("known"))
    joined = lines.join(full, [by, order], "left")
    up_to = w.rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("before", F.coalesce(F.last("known", ignorenulls=True).over(up_to), F.array().cast("array<string>"))).drop("known")


def opinions(lines: DataFrame, by: str, order: str, text: str, page: Column, opinion: Column, n: int = 3) -> DataFrame:
    """(by, order, text, page, before): lines that state an opinion, with the page that stands last before or on them and the n filled lines before."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    paged = lines.withColumn("page", F.last(page, ignorenulls=True).over(w))
    return preceding(paged, by, order, text, n).where(F.coalesce(opinion, F.lit(False))).select(by, order, text, "page", "before")


def fill_gaps(gaps: DataFrame, candidates: DataFrame, by: str) -> DataFrame:
    """(by, number, text): recovered texts take the missing numbers of their gap in order (X23). gaps: (by, low, high); candidates: (by, low, ord, text)."""
    w = Window.partitionBy(by, "low").orderBy("ord")
    n = candidates.withColumn("number", F.col("low") + F.row_number().over(w) - 1)
    return n.join(gaps, [by, "low"]).where("number <= high").select(by, "number", "text")


def clear_inferred(entries: DataFrame, inferred: tuple[str, ...] = ("inferred_imam", "inferred_network", "inferred_llm", "inferred_alias")) -> tuple[DataFrame, DataFrame]:
    """The entries without layers that were inferred, and one row with how many there were."""
    mine = F.coalesce(F.col("tabaqah_source").isin(*inferred), F.lit(False))
    cleared = entries.withColumns({"tabaqah": F.when(~mine, F.col("tabaqah")), "tabaqah_source": F.when(~mine, F.col("tabaqah_source"))})
    return cleared, entries.agg(F.count_if(mine).alias("cleared"))
