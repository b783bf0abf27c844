"""Structured Streaming: micro-batches of chains against a static index, event-time windows, deduplication and keyed state.

The checkpoint takes the place of a progress file: a restarted query goes on behind its last committed batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import chain


def source(spark: SparkSession, folder: str, schema: str = "chain_id long, text string, ts timestamp", files: int = 16) -> DataFrame:
    """Chains as they arrive as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def graded(chains: DataFrame, index: DataFrame) -> DataFrame:
    """(chain_id, ts, pos, name, status) of each link: a stream-static join to (form, status, hadith_count, sect)."""
    links = chains.select("chain_id", "ts", F.posexplode(chain.parse(F.col("text"))).alias("pos", "name"))
    return links.join(index, links["name"] == index["form"], "left").drop("form")


def grade_into(chains: DataFrame, index: DataFrame, out: str, checkpoint: str, done: Callable[[DataFrame, int], None] | None = None):
    """Grades each micro-batch and writes it under its number, so a repeated batch replaces itself. Returns the query."""

    def batch(df: DataFrame, number: int) -> None:
        result = chain.grade(df)
        result.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if done:
            done(result, number)

    return graded(chains, index).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(stream: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    """With a watermark; times without a zone are taken in the session's."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def counts(events: DataFrame, window: str, slide: str | None = None, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Tumbling or sliding counts with a watermark."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return timed(events, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    return timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(stream: DataFrame, key: str = "chain_id", late: str = "1 hour") -> DataFrame:
    """Each key once; state goes when the watermark passes."""
    return timed(stream, late).dropDuplicatesWithinWatermark([key])


def running_totals(events: DataFrame, key: str = "user_id", value: str = "value", late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """(key, n, total) as it stands after each micro-batch; a key's state goes when the watermark is an idle time past its last batch."""
    kind = events.schema[key].dataType.simpleString()

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        state.setTimeoutTimestamp(max(0, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return timed(events, late).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.EventTimeTimeout)
