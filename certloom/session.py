"""Session settings, the shared scratch folder, and the size check behind every broadcast hint."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.files import delete_path

# A side is broadcast only when it was counted and stays below both bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # State of long windows belongs on disk, with increments as checkpoints.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators rely on; `extra` uses `_` for `.` in keys."""
    builder = SparkSession.builder.appName("certloom")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Times are UTC seconds everywhere, so formatting must not use a local zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where it is unset, one in the warehouse, if executors reach that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = spark.sparkContext.master.startswith("local")
    if not local and (warehouse.startswith("file:") or "://" not in warehouse and spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")):
        raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of one machine")
    return f"{warehouse}/_scratch"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder that every executor can reach: below `spark.checkpoint.dir`, or in the warehouse where that is unset."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the scratch folder and read back, for a costly input that is used several times."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """`keep(df, label)` as `stored`, for tables that are deleted when the job that needs them ends."""
    base = scratch_dir(spark, "job")

    def keep(df: DataFrame, label: str) -> DataFrame:
        df.write.parquet(f"{base}/{label}")
        return spark.read.schema(df.schema).parquet(f"{base}/{label}")

    try:
        yield keep
    finally:
        delete_path(spark, base)


def small_enough(df: DataFrame, width: Column, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Count `df` and add up `width` (bytes per row) to decide whether it may be broadcast."""
    size = df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")
    ).first()
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def broadcast_if_small(df: DataFrame, width: Column, **bounds: int) -> DataFrame:
    """`broadcast(df)` when the check passes, else `df`, which then joins by shuffle."""
    return F.broadcast(df) if small_enough(df, width, **bounds) else df
