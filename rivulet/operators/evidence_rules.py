"""Rule modules over candidates and chains: by-name disambiguation, identification, scribal errors, reliability, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .scoring import assessment, cascade, decide, evidence

# Weights of the evidence for a by-name, and its thresholds.
TEACHER_STUDENT, IMAM, LAYER, LIFETIME, BOOK = 5, 3, 2, 2, 1
HIGH, MEDIUM, AMBIGUOUS = 7, 4, 2


def kunya_candidates(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, entry_key): entries whose by-name is the asked one or one of whose aliases begins with it (J19), by equality of word prefixes."""
    q = asked.select("query_id", tx.normalize(F.col("kunya")).alias("k"))
    own = entries.select("entry_key", tx.normalize(F.col("kunyah")).alias("k"))
    alias = entries.select("entry_key", F.explode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("a")).select("entry_key", tx.tokens(F.col("a")).alias("w"))
    heads = alias.select("entry_key", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda n: F.array_join(F.slice("w", F.lit(1), n), " "))).alias("k"))
    # Both sides have each key once, with all keys of their query or entry: a pair is told at its first common key only, so pairs need no shuffle that makes them distinct.
    once = lambda df, id_col, name: df.where("k <> ''").groupBy(id_col).agg(F.collect_set("k").alias(name)).select(id_col, name, F.explode(name).alias("k"))
    met = once(q, "query_id", "qs").join(once(own.union(heads), "entry_key", "es"), "k")
    single = (F.size("qs") == 1) | (F.size("es") == 1)
    return met.where(single | (F.col("k") == F.array_min(F.array_intersect("qs", "es")))).select("query_id", "entry_key")


def kunya_score(scored: DataFrame) -> DataFrame:
    """The best entry of each query (C11). Columns: query_id, entry_key, knows_student, knows_teacher, imam, tabaqah, low, high, verdicts (array), book_custom.

    Entries outside the layers, or with an impossible link, are out; verdicts other than impossible and tight count, unknown ones too.
    """
    fits = F.col("tabaqah").between(F.col("low") - 1, F.col("high") + 1)
    lost = F.coalesce(~fits, F.lit(False)) | F.array_contains(F.coalesce("verdicts", F.array().cast("array<string>")), "impossible")
    lives = F.size(F.filter(F.coalesce("verdicts", F.array().cast("array<string>")), lambda v: ~v.isin("impossible", "tight"))) * LIFETIME
    on = lambda c, w: F.when(F.coalesce(F.col(c), F.lit(False)), w).otherwise(0)
    score = on("knows_student", TEACHER_STUDENT) + on("knows_teacher", TEACHER_STUDENT) + on("imam", IMAM) + F.when(F.coalesce(fits, F.lit(False)), LAYER).otherwise(0) + lives + on("book_custom", BOOK)
    alive = scored.withColumn("score", score).where(~lost)
    best = decide(alive.select("query_id", "entry_key", "score"), ["query_id"], "score", ["entry_key"], HIGH, MEDIUM, AMBIGUOUS)
    return scored.select("query_id").distinct().join(best, "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit("none")))


# --- Identification by one kind of evidence (M1, M2)


def by_layer(candidates: DataFrame, expected: Column) -> DataFrame:
    return candidates.where(F.abs(F.col("tabaqah") - expected) <= 1)


def by_listed(candidates: DataFrame, lists: str, name: Column) -> DataFrame:
    """Candidates that list a name among teachers or students."""
    return candidates.where(F.exists(F.coalesce(F.col(lists), F.array().cast("array<string>")), lambda x: tx.normalize(x) == tx.normalize(name)))


def by_part(candidates: DataFrame, columns: list[str], part: str) -> DataFrame:
    """Candidates one of whose texts (places, names) contains a part."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(tx.normalize(F.col(c)), tx.normalize(F.lit(part))), F.lit(False))
    return candidates.where(hit)


def by_period(candidates: DataFrame, start: int, end: int) -> DataFrame:
    """Lives that do not lie outside a period (J21); an open end is inside."""
    return candidates.where(~(F.coalesce(F.col("death") < start, F.lit(False)) | F.coalesce(F.col("birth") > end, F.lit(False))))


def by_count(candidates: DataFrame, least: int) -> DataFrame:
    return candidates.where(F.coalesce("hadith_count", F.lit(0)) >= least)


# Letters that copyists confuse.
CONFUSED = {
    "ب": ["ت", "ث", "ن"],
    "ت": ["ب", "ث", "ن"],
    "ث": ["ب", "ت", "س"],
    "ج": ["ح", "خ"],
    "ح": ["ج", "خ"],
    "خ": ["ح", "ج"],
    "د": ["ذ", "ر", "ز"],
    "ذ": ["د", "ز"],
    "ر": ["د", "ز"],
    "ز": ["ذ", "ر"],
    "س": ["ش", "ص"],
    "ش": ["س", "ص"],
    "ص": ["س", "ش", "ض"],
    "ض": ["ص", "ط"],
    "ط": ["ض", "ظ"],
    "ظ": ["ط", "ع"],
    "ع": ["ظ", "غ"],
    "غ": ["ع", "ق"],
    "ق": ["غ", "ك"],
    "ك": ["ق", "ل"],
    "ل": ["ك", "م"],
    "م": ["ل", "ن"],
    "ن": ["م", "ب"],
    "ه": ["ة", "ي"],
    "ة": ["ه", "ي"],
    "ي": ["ه", "ة"],
}


def letter_swaps(a: Column, b: Column) -> Column:
    """(place, from, to) of letters that differ by a usual confusion, of names at most two letters apart in length (M4)."""
    chars = lambda c: F.split(tx.normalize(c), "")
    pairs = F.arrays_zip(F.filter(chars(a), lambda x: x != "").alias("x"), F.filter(chars(b), lambda x: x != "").alias("y"))
    known = F.create_map(*[F.lit(x) for k, v in CONFUSED.items() for x in (k, "".join(v))])
    rows = F.transform(pairs, lambda p, i: F.struct(i.alias("place"), p["x"].alias("from"), p["y"].alias("to")))
    close = F.abs(F.length(tx.normalize(a)) - F.length(tx.normalize(b))) <= 2
    hits = F.filter(rows, lambda r: (r["from"] != r["to"]) & F.coalesce(F.contains(F.try_element_at(known, r["from"]), r["to"]), F.lit(False)))
    return F.when(close, hits).otherwise(F.filter(rows, lambda r: F.lit(False)))


def repeated_words(links: DataFrame, chain_id: str = "chain_id") -> DataFrame:
    """Adds words that a link shares with the next one (W10), the trace of a skipping eye."""
    w = Window.partitionBy(chain_id).orderBy("pos")
    return links.withColumn("repeated", F.array_intersect(tx.significant(F.col("name")), tx.significant(F.lead("name").over(w))))


def version_diff(a: Column, b: Column) -> Column:
    """(place, first, second) where two versions of a chain differ."""
    rows = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p, i: F.struct(i.alias("place"), p["x"].alias("first"), p["y"].alias("second")))
    return F.filter(rows, lambda r: ~tx.normalize(r["first"]).eqNullSafe(tx.normalize(r["second"])))


def integrity(links: DataFrame, chain_id: str = "chain_id") -> DataFrame:
    """Share of resolved links and number of gaps of each chain (M5, M7). links: chain_id, resolved, severity."""
    return links.groupBy(chain_id).agg(F.avg(F.col("resolved").cast("double")).alias("ratio"), F.count_if(F.col("severity").isNotNull()).alias("gaps"))


def reliability(entries: DataFrame, statuses: DataFrame, witnesses: DataFrame, anchors: list[str]) -> DataFrame:
    """(entry_key, kinds, total, label) of summed evidence.

    entries: entry_key, teachers, students, hadith_count; statuses: (name, status); witnesses: (entry_key, kind) with kind imam or consensus; a student among ``anchors`` vouches.
    """
    row = lambda df, kind, weight: df.select("entry_key", F.lit(kind).alias("kind"), weight.cast("double").alias("weight"))
    good = statuses.where("status = 'thiqah'").select(tx.normalize(F.col("name")).alias("n")).distinct()
    empty = F.array().cast("array<string>")
    listed = lambda c: entries.select("entry_key", F.explode(F.coalesce(F.col(c), empty)).alias("x")).select("entry_key", tx.normalize(F.col("x")).alias("n")).distinct().join(good, "n")
    vouched = entries.where(F.exists(F.coalesce("students", empty), lambda s: tx.normalize(s).isin(*anchors)))
    rows = [
        row(witnesses.where("kind = 'imam'"), "imam", F.lit(3.0)),
        row(witnesses.where("kind = 'consensus'"), "consensus", F.lit(2.5)),
        row(vouched, "principle", F.lit(2.0)),
        row(entries.where(F.coalesce("hadith_count", F.lit(0)) >= 100), "count", F.lit(1.5)),
        row(listed("teachers"), "teachers", F.lit(2.0)),
        row(listed("students"), "students", F.lit(1.5)),
    ]
    return evidence(rows, "entry_key").withColumn("label", assessment(F.col("total")))


# --- Validation


def validate(ours: DataFrame, theirs: DataFrame, key: str, ours_status: str, theirs_status: str) -> DataFrame:
    """(key, verdict, correction): each of their rows is matched, wrong (with their status as correction) or missing."""
    both = theirs.select(key, F.col(theirs_status).alias("__t")).join(ours.select(key, F.col(ours_status).alias("__o"), F.lit(True).alias("__in")), key, "left")
    verdict = cascade([(F.col("__in").isNull(), "missing"), (F.col("__o").eqNullSafe(F.col("__t")), "match")], "wrong")
    return both.select(key, verdict.alias("verdict"), F.when(verdict == "wrong", F.col("__t")).alias("correction"))


def category(grade: Column) -> Column:
    """The short category of a grade's text, worst words first."""
    low = F.lower(grade)
    return cascade([(F.contains(low, F.lit("da'if")) | F.contains(low, F.lit("weak")), "daif"), (F.contains(low, F.lit("majhul")), "majhul"), (F.contains(low, F.lit("sahih")), "sahih"), (F.contains(low, F.lit("hasan")), "hasan"), (F.contains(low, F.lit("muwaththaq")), "muwaththaq")], "other")


def confusion(pairs: DataFrame, ours: str, theirs: str) -> DataFrame:
    """Counts and shares of pairs of categories."""
    n = pairs.groupBy(ours, theirs).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
