"""Spark session for local work; on a cluster, settings of the submitter win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, memory: str = "8g", **more: str) -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | more
    out = SparkSession.builder.config(map=conf).getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out
