"""Model calls over a table in waves (L2, L3): few requests at a time, results stored after each wave, so that what was answered is never asked again.

A wave takes the next batches that have no stored result, deals them to tasks, and writes one row for each entry; the next wave, a restart or another run begins behind what is
stored. A lost executor repeats no more than its part of one wave. Within a task at most ``in_flight`` requests run at once. A client may raise ``Later`` with the seconds
that a service wants to be left alone: all requests of the task wait for it, and it counts as no try.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Client = Callable[[str], str]


class Later(Exception):  # noqa: N818  no error: the service is busy
    """Raised by a client: ask again after so many seconds."""

    def __init__(self, seconds: float):
        super().__init__(f"again in {seconds} s")
        self.seconds = seconds


class Desk:
    """Asks for a task: retries, waits that all its threads share, and what a reply must look like."""

    def __init__(self, client: Client, tries: int, wait: float):
        self.client, self.tries, self.wait = client, tries, wait
        self.lock, self.until = threading.Lock(), 0.0

    def ask(self, prompt: str, good: Callable[[object], bool], told: str) -> tuple[object, str | None]:
        """(reply, None), or (None, the last error) after all tries. ``told`` is added to a prompt whose reply was not good."""
        hint, tries = "", 0
        while tries < self.tries:
            with self.lock:
                pause = self.until - time.monotonic()
            if pause > 0:
                time.sleep(pause)
            try:
                reply = json.loads(self.client(f"{prompt}\n{hint}" if hint else prompt))
                if good(reply):
                    return reply, None
                hint = told
            except Later as e:
                with self.lock:
                    self.until = max(self.until, time.monotonic() + e.seconds)
                continue
            except Exception as e:  # noqa: BLE001  whatever a client raises is its error
                hint = f"{type(e).__name__}: {e}"
                time.sleep(self.wait * 2**tries)
            tries += 1
        return None, hint


def answer(desk: Desk, rows: list[tuple], fields: list[str], lists: list[str], giant: int) -> list[tuple]:
    """(idx, position, values, error) of the entries of one batch; an entry longer than ``giant`` is a batch of its own and asked twice, for all but the lists, then for these."""
    numbered = lambda rs: "\n".join(f"# {i}: {t}" for i, t in rs)
    is_list = lambda n: lambda x: isinstance(x, list) and len(x) >= n  # noqa: E731  more records than entries: fused ones
    if len(rows) == 1 and len(rows[0][1]) > giant and lists:
        short, error = desk.ask(f"{numbered(rows)}\nLeave out {', '.join(lists)}.", is_list(1), "Give exactly 1 record.")
        long, second = desk.ask(f"{numbered(rows)}\nGive only {', '.join(lists)}, as one object.", lambda x: isinstance(x, dict), "Give one object.")
        first = dict((short or [{}])[0] or {}) | {k: (long or {}).get(k) for k in lists}
        found, error = [first, *(short or [])[1:]], error or second
    else:
        found, error = desk.ask(numbered(rows), is_list(len(rows)), f"Give exactly {len(rows)} records.")
        found = found or [{}] * len(rows)
    out = []
    for p, record in enumerate(found):
        idx, position = (rows[p][0], 0) if p < len(rows) else (rows[-1][0], p - len(rows) + 1)
        values = record if isinstance(record, dict) else {}
        out.append((idx, position, [None if values.get(f) is None else values[f] if isinstance(values[f], str) else json.dumps(values[f], ensure_ascii=False) for f in [*fields, *lists]], error))
    return out


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier waves wrote; no rows before the first."""
    from ..sources.readers import optional

    return optional(lambda: spark.read.schema(schema).parquet(path).select(*[c.split()[0] for c in schema.split(", ")]), spark, schema)


def run(df: DataFrame, idx: str, text: str, fields: list[str], client: Client, path: str, lists: list[str] = (), size: int = 8, giant: int = 20_000, in_flight: int = 4, wave: int = 256, tries: int = 3, wait: float = 0.5, again: bool = False) -> DataFrame:
    """(idx, position, fields…, error) of all entries, stored below ``path``, one folder a wave.

    idx is an integer, unique and stable from run to run. Batches are ``size`` entries by idx; entries longer than ``giant`` characters are alone. ``wave`` batches make a wave. With ``again`` entries
    that were stored with an error are asked once more, and the newest answer counts. A record beyond the last entry's belongs to it as a further position.
    """
    spark = df.sparkSession
    names = [*fields, *lists]
    schema = f"{idx} {df.schema[idx].dataType.simpleString()}, position int, {', '.join(f'{f} string' for f in names)}, error string, wave int"
    entries = df.select(idx, F.coalesce(text, F.lit("")).alias("text")).where(F.col(idx).isNotNull())
    big = F.length("text") > giant
    entries = entries.withColumns({"batch": F.when(big, F.col(idx)).otherwise(F.floor(F.col(idx) / size)).cast("long"), "big": big})
    last = stored(spark, path, schema).agg(F.max("wave")).first()[0]
    number, begun = 0 if last is None else last + 1, 0 if last is None else last + 1

    def task(batches):
        desk = Desk(client, tries, wait)
        for b in batches:
            groups = [list(zip(g[idx], g["text"], strict=True)) for _, g in b.sort_values(idx).groupby(["big", "batch"], sort=True)]
            with ThreadPoolExecutor(max(1, in_flight)) as pool:
                done = [r for rows in pool.map(lambda rows: answer(desk, rows, fields, list(lists), giant), groups) for r in rows]
            yield pd.DataFrame([(i, p, *v, e, number) for i, p, v, e in done], columns=[c.split()[0] for c in schema.split(", ")])

    while True:
        done = stored(spark, path, schema)
        # An entry is done when a row of it is stored; with ``again`` a failed one only counts if this run made it.
        ok = done.where(F.col("error").isNull() | (F.col("wave") >= begun)) if again else done
        left = entries.join(ok.select(idx).distinct(), idx, "left_anti")
        keys = [(r["big"], r["batch"]) for r in left.select("big", "batch").distinct().orderBy("big", "batch").limit(wave).collect()]  # at most ``wave`` rows
        if not keys:
            break
        now = left.join(F.broadcast(spark.createDataFrame(keys, "big boolean, batch long")), ["big", "batch"])  # at most ``wave`` rows
        # All entries of a batch go to one task, and to one Arrow batch of it.
        grouped = now.groupBy("big", "batch").agg(F.collect_list(F.struct(idx, "text")).alias("l")).repartition(max(1, min(len(keys), spark.sparkContext.defaultParallelism)), "big", "batch")

        def unfolded(frames):
            for f in frames:
                rows = [(r["big"], r["batch"], e[idx], e["text"]) for _, r in f.iterrows() for e in r["l"]]
                yield from task([pd.DataFrame(rows, columns=["big", "batch", idx, "text"])])

        grouped.mapInPandas(unfolded, schema).write.mode("errorifexists").parquet(f"{path}/part={number:06d}")
        number += 1
    newest = stored(spark, path, schema)
    of = newest.groupBy(idx).agg(F.max("wave").alias("__w"))
    return newest.join(of, idx).where("wave = __w").drop("wave", "__w")
