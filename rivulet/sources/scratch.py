"""Tables written to the shared checkpoint folder: lineage ends there, and a lost executor loses nothing."""

from __future__ import annotations

import atexit
import gc
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder used when a local session (tests) names no spark.checkpoint.dir.
LOCAL_CHECKPOINTS = "/tmp/rivulet-checkpoints"
#: Shuffle files of a finished write go at once, not with the next collection of the driver's heap.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_tables: dict[str, SparkSession] = {}
_own = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Only a local session may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return LOCAL_CHECKPOINTS


def _delete(path: str) -> None:
    spark = _tables.pop(path, None)
    if spark is None:
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
        return


def written(df: DataFrame, partitions: int | None = None, of_stage: bool = True) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, and lost executors lose nothing. ``begin_stage`` deletes it if it is ``of_stage``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rivulet-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
        _tables[path] = spark
        if of_stage:
            getattr(_own, "stage", []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rivulet_path = path  # type: ignore[attr-defined]
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes tables of ``written`` that no later plan reads."""
    for df in frames:
        _delete(getattr(df, "_rivulet_path", ""))


def begin_stage() -> None:
    """Called by each pipeline stage as it starts: the result of the stage before is stored by then, so the scratch tables that this thread wrote for that one go."""
    for path in getattr(_own, "stage", []):
        _delete(path)
    _own.stage = []


@atexit.register
def _sweep() -> None:
    from pyspark import SparkContext

    if SparkContext._active_spark_context is None:
        return
    for path in list(_tables):
        _delete(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files and broadcasts of finished phases, whose frames are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def scratch_path(spark: SparkSession) -> str:
    """A new path below the shared folder for files that a caller writes; it goes at exit."""
    path = f"{shared_folder(spark)}/rivulet-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path
