"""Missing numbers, the texts in which they may stand, and what can be read from these (X22, X23); and the as-of join from both sides that this needs.

Everything is ordered by ranges, so one book may hold any number of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import scan
from .extract import authority


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], rows: int = scan.ROWS) -> DataFrame:
    """``left`` with before_X and after_X for each X of ``take`` and for ``on``: those of the nearest right row at or before a row, and behind it, in the same group.

    Right rows have one row a place; nulls of X are taken as they are. Both sides are ordered together, in ranges, once forwards and once backwards.
    """
    held = F.struct(F.col(on), *take)
    both = left.withColumn("__r", F.lit(None).cast("int")).withColumn("__x", F.lit(None).cast(right.select(held.alias("s")).schema["s"].dataType))
    add = right.select(*by, on, F.lit(0).alias("__r"), held.alias("__x"))
    for c in left.columns:
        if c not in (*by, on):
            add = add.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    both = both.unionByName(add.select(*both.columns))
    # Right rows first at one place, so that they count as before.
    first = scan.running(scan.parts(both, by, [on, F.col("__r").isNull()], rows), by, lasts={"__before": F.col("__x")}).drop("__part", "__pos")
    second = scan.running(scan.parts(first, by, [F.desc(on), F.col("__r").isNotNull()], rows), by, lasts={"__after": F.col("__x")}).drop("__part", "__pos")
    found = second.where("__r is null")
    return found.select(*left.columns, *[F.col(f"__{side}.{c}").alias(f"{side}_{c}") for side in ("before", "after") for c in (on, *take)])


def missing_runs(entries: DataFrame, by: list[str], number: str, start: str, end: str, rows: int = scan.ROWS) -> DataFrame:
    """(by, low, high, before, after, text_start, text_end): runs of missing numbers between two that are there, with the piece of text from behind the entry before to the entry behind.

    ``start`` and ``end`` are the places of an entry's header; of entries with one number the last in the text counts. One row a run, however long it is.
    """
    once = entries.where(F.col(number).isNotNull()).groupBy(*by, number).agg(F.max(F.struct(start, end)).alias("at"))
    p = scan.parts(once, by, [number], rows)
    x = scan.running(p, by, lasts={"b": F.struct(F.col(number).alias("number"), F.col(f"at.{end}").alias("end"))})
    return x.where(F.col(number) > F.col("b.number") + 1).select(*by, (F.col("b.number") + 1).alias("low"), (F.col(number) - 1).alias("high"), F.col("b.number").alias("before"), F.col(number).alias("after"), F.col("b.end").alias("text_start"), F.col(f"at.{start}").alias("text_end"))


# A line that may be the header of an entry, and the greatest number that counts.
HEADER = "^([0-9٠-٩۰-۹]{1,4})\\s*[.\\-]\\s*([؀-ۿ].{3,80})$"
GREATEST = 1100


def recovered(gaps: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, number, read_number, name, layer, detail, alt_names): entries read from the texts of runs of missing numbers (X23). gaps: by, low, high, text.

    Every line with the shape of a header begins a candidate, which reaches to the next; candidates take the missing numbers in order, whatever number stands in the text.
    """
    lines = F.split(F.col(text), "\n")
    digits = lambda x: F.translate(F.regexp_extract(x, HEADER, 1), tx.EASTERN + tx.PERSIAN, tx.WESTERN * 2).try_cast("int")
    found = gaps.withColumn("__l", lines).withColumn("__n", F.transform("__l", digits))
    places = F.filter(F.sequence(F.lit(0), F.size("__l") - 1), lambda i: F.coalesce(F.get("__n", i).between(1, GREATEST), F.lit(False)))
    found = found.withColumn("__at", places).where(F.size("__at") > 0).select(*by, "low", "high", "__l", "__n", "__at", F.posexplode("__at").alias("__i", "__p"))
    stop = F.coalesce(F.get("__at", F.col("__i") + 1), F.size("__l"))
    body = F.array_join(F.slice("__l", F.col("__p") + 2, stop - F.col("__p") - 1), "\n")
    rows = found.where(F.col("low") + F.col("__i") <= F.col("high"))
    name = tx.strip(F.regexp_extract(F.get("__l", F.col("__p")), HEADER, 2))
    rows = rows.select(*by, (F.col("low") + F.col("__i")).alias("number"), F.get("__n", F.col("__p")).alias("read_number"), name.alias("name"), authority(body).alias("a"))
    return rows.select(*by, "number", "read_number", "name", "a.layer", "a.detail", "a.alt_names")


def cut(text: Column, start: Column, end: Column) -> Column:
    """The piece of a text between two places, from 0."""
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))
