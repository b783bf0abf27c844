"""Scribal errors in names (M9): predicates of one or two names, and indexes that find the name that was meant among many known ones.

Known names are (name, n), n how often a name occurs. Indexes are joins on hashes: of letters without their dots, of names with one or two letters left out, and of
a name's parts in the other order. No pair of names is formed but of those that share a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Ends of names that look alike in old script, names misread by their dots, words that are taken for each other, marks of words that were added.
ALIKE = (("خلف", "خالد"), ("خلف", "خلد"), ("هارون", "مروان"), ("محمد", "أحمد"), ("عمر", "عمرو"), ("سالم", "سلم"), ("هلال", "مليك"))
MISDOTTED = (("يسار", "بشار"),)
TAKEN = (("عن", "بن"), ("محمد", "أحمد"), ("عمر", "عمرو"))
ADDED = (r"بن\s+\S+\s+بن\s+", r"ابي\s+\S+\s+بن\s+")
#: Words from which on a name is rare.
LONG = 5

# Letters that differ by dots only, and the one that stands for each.
DOTTED, PLAIN = "بتثنيئجخذزشضظغقة", "ٮٮٮٮٮٮححدرسصطعفه"


def alike(a: Column, b: Column) -> Column:
    """The pair of endings by which two names look alike, as "x/y", or null."""
    out = F.lit(None).cast("string")
    for x, y in reversed(ALIKE):
        met = (F.endswith(a, F.lit(x)) & F.endswith(b, F.lit(y))) | (F.endswith(a, F.lit(y)) & F.endswith(b, F.lit(x)))
        out = F.when(met, f"{x}/{y}").otherwise(out)
    return out


def misdotted(name: Column) -> Column:
    """The right reading of a known misreading in a name, or null."""
    out = F.lit(None).cast("string")
    for wrong, right in reversed(MISDOTTED):
        out = F.when(F.contains(name, F.lit(wrong)), right).otherwise(out)
    return out


def taken_for(name: Column) -> Column:
    """"wrong/right" where a name holds a word that is easily taken for another and does not hold that one, or null."""
    out = F.lit(None).cast("string")
    for wrong, right in reversed(TAKEN):
        out = F.when(F.contains(name, F.lit(wrong)) & ~F.contains(name, F.lit(right)), f"{wrong}/{right}").otherwise(out)
    return out


def added(name: Column) -> Column:
    """Whether a name has the shape of one with words added."""
    return F.lit(False) if not ADDED else F.coalesce(name.rlike("|".join(ADDED)), F.lit(False))


def is_long(name: Column) -> Column:
    """Whether a name has more words than names usually have."""
    return F.coalesce(F.size(tx.words(name)), F.lit(0)) >= LONG


def reversed_name(name: Column) -> Column:
    """"B son of A" of "A son of B"; null of any other shape."""
    parts = F.split(name, " بن ")
    return F.when(F.size(parts) == 2, F.concat(F.get(parts, 1), F.lit(" بن "), F.get(parts, 0)))


def skeleton(name: Column) -> Column:
    """A name's letters without their dots."""
    return F.translate(tx.normalize(name), DOTTED, PLAIN)


def shortened(name: Column) -> Column:
    """A name without the part between its first and second "son of", the part that may have been added; null if there is none."""
    return F.nullif(F.regexp_replace(name, r"^(.*?) بن \S+ بن ", "$1 بن "), name)


def _names(known: DataFrame) -> DataFrame:
    return known.where("name <> ''").groupBy("name").agg(F.sum("n").alias("n"))


def meant_by_dots(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, other, n): known names that differ from a name by dots only."""
    k = _names(known).select(F.col("name").alias("other"), "n", skeleton(F.col("name")).alias("s"))
    return names.select("name").distinct().withColumn("s", skeleton(F.col("name"))).join(k, "s").where(tx.normalize(F.col("name")) != tx.normalize(F.col("other"))).select("name", "other", "n")


def meant_by_order(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, other, here, there): names whose parts stand the other way round in a known name that occurs more often."""
    k = _names(known)
    own = names.select("name").distinct().join(k.withColumnRenamed("n", "here"), "name", "left").withColumn("other", reversed_name(F.col("name")))
    met = own.where("other <> name").join(k.select(F.col("name").alias("other"), F.col("n").alias("there")), "other")
    return met.select("name", "other", F.coalesce("here", F.lit(0).cast("long")).alias("here"), "there").where("there > here")


def meant_without(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, other, n): known names that are a name without the part that may have been added."""
    own = names.select("name").distinct().withColumn("other", shortened(F.col("name"))).where("other is not null")
    return own.join(_names(known).withColumnRenamed("name", "other"), "other").select("name", "other", "n")


def rare(names: DataFrame, known: DataFrame, least: int = 1) -> DataFrame:
    """(name, n): names that are long or that occur fewer than ``least`` times among the known ones."""
    own = names.select("name").distinct().join(_names(known), "name", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return own.where(is_long(F.col("name")) | (F.col("n") < least))


def _left_out(c: Column, most: int) -> Column:
    """Distinct texts that result from leaving out up to ``most`` letters."""
    one = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))).otherwise(F.array().cast("array<string>"))
    every = last = F.array(c)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, one)))
        every = F.concat(every, last)
    return F.array_distinct(every)


def near(names: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """(name, other, edits, n): known names within one or ``most`` edits of a name. Two names that near have a text in common that either gives with so many letters left out."""
    keys = lambda df: df.withColumn("h", F.explode(F.transform(_left_out(F.col("c"), most), lambda x: F.xxhash64(x))))
    own = names.select("name").distinct().withColumn("c", tx.normalize(F.col("name"))).where("c <> ''")
    k = _names(known).select(F.col("name").alias("other"), "n").withColumn("c", tx.normalize(F.col("other")))
    # Never broadcast: Spark estimates the tables without the texts that each name gives, and so would collect them on the driver. Pairs too far apart go before pairs are made distinct.
    met = keys(own).select("name", "c", "h").hint("merge").join(keys(k).select("other", "n", F.col("c").alias("d"), "h"), "h")
    met = met.withColumn("edits", F.levenshtein("c", "d", most)).where(F.col("edits").between(1, most))
    return met.select("name", "other", "edits", "n").distinct()
