"""The interface to language models (L2-L6, T5): prompts, batches, checks and retries around a client that callers pass in.

Nothing here opens a network; without a client the offline stub answers with empty records, and everything else behaves the same.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[str], str]


def offline(prompt: str) -> str:
    """As many empty records as the prompt has numbered entries."""
    return json.dumps([{} for line in prompt.splitlines() if line.startswith("#")])


def batches(df: DataFrame, idx: str, size: int) -> DataFrame:
    """Adds the number of the batch (L3)."""
    return df.withColumn("batch", F.floor(F.col(idx) / size))


def extract(df: DataFrame, idx: str, text: str, fields: list[str], client: Client = offline, size: int = 8, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """(idx, position, fields…, error): records of each entry, in batches that are asked again while their number is wrong (L2, L3).

    A record list for one entry gives several positions (fused rows). A batch that stays wrong gives one row an entry with its error.
    """
    schema = f"{idx} {df.schema[idx].dataType.simpleString()}, position int, {', '.join(f'{f} string' for f in fields)}, error string"

    def ask(rows: list[tuple]) -> tuple[list, str | None]:
        hint = ""
        for attempt in range(tries):
            prompt = "\n".join([hint, *(f"# {i}: {t}" for i, t in rows)])
            try:
                found = json.loads(client(prompt))
                if isinstance(found, list) and len(found) == len(rows):
                    return found, None
                hint = f"Give exactly {len(rows)} records."
            except Exception as e:  # noqa: BLE001  whatever a client raises is its error
                hint = str(e)
                time.sleep(wait * 2**attempt)
        return [{}] * len(rows), hint

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(idx)
        rows = list(zip(group[idx], group[text].fillna(""), strict=True))
        found, error = ask(rows)
        out = []
        for (i, _), record in zip(rows, found, strict=True):
            for p, one in enumerate(record if isinstance(record, list) else [record]):
                out.append((i, p, *[None if one.get(f) is None else str(one[f]) for f in fields], error))
        return pd.DataFrame(out, columns=[idx, "position", *fields, "error"])

    return batches(df.select(idx, text), idx, size).groupBy("batch").applyInPandas(run, schema)


def infer_layers(entries: DataFrame, client: Client = offline, size: int = 1) -> DataFrame:
    """(entry_key, tabaqah, tabaqah_source): layers that a model reads from the texts of entries that have none (L6). Replies that are no layer from 1 to 12 are left out.

    entries: entry_key, idx, name_ar, text, tabaqah; aliases and entries done before are the caller's to leave out.
    """
    asked = entries.where(F.col("tabaqah").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("entry_key", "idx", prompt([F.col("name_ar"), F.regexp_replace(F.substring("text", 1, 3000), "\\s+", " ")]).alias("q"))
    found = extract(asked.withColumn("q", F.regexp_replace("q", "\n", ": ")), "idx", "q", ["tabaqah"], client, size)
    layer = F.col("layer").between(1, 12)
    return asked.join(found.where("position = 0").select("idx", F.col("tabaqah").try_cast("int").alias("layer")), "idx").where(layer).select("entry_key", F.col("layer").alias("tabaqah"), F.lit("inferred_llm").alias("tabaqah_source"))


def entry_keys(df: DataFrame, idx: str) -> DataFrame:
    """Keys of records: the entry's number, and of fused rows a suffix by position (L3)."""
    key = F.when(F.col("position") == 0, F.col(idx).cast("string")).otherwise(F.concat(F.col(idx).cast("string"), F.lit("_overflow_"), F.col("position").cast("string")))
    return df.withColumn("entry_key", key)


def route(n_candidates: Column) -> Column:
    """none: no candidate; auto: the only one is taken; ask: a model decides."""
    return F.when(n_candidates == 0, "none").when(n_candidates == 1, "auto").otherwise("ask")


def prompt(parts: list[Column]) -> Column:
    """The filled parts, a line each (L4)."""
    return F.concat_ws("\n", *parts)


def shots(examples: DataFrame, query: str, source: str, target: str, order: str, k: int) -> DataFrame:
    """(query, prompt): the k best pairs as examples, best last (T5)."""
    from .windows import top_k

    best = top_k(examples, [query], [order], k)
    pairs = F.reverse(F.array_sort(F.collect_list(F.struct("rank", source, target))))
    return best.groupBy(query).agg(F.array_join(F.transform(pairs, lambda p: F.concat(p[source], F.lit("\n=> "), p[target])), "\n\n").alias("prompt"))


def register(spark) -> None:
    """SQL functions of the library (L1), so that queries need no Python."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def trigram_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
        out = []
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            p, q = grams(x.lower()), grams(y.lower())
            out.append(len(p & q) / len(p | q) if p | q else 0.0)
        return pd.Series(out)

    spark.udf.register("trigram_similarity", trigram_similarity)
