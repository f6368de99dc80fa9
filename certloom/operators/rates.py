"""Ingest counters and the trailing-minute insert rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certloom.session import broadcast_if_small, stored

WINDOW_MS = 60_000


def _rate(total: Column, window_ms: Column) -> Column:
    """Per second to one decimal, 0 below one second."""
    per_second = total / (window_ms / F.lit(1000.0))
    return F.when(window_ms < 1000, F.lit(0.0)).otherwise(F.floor(per_second * 10 + 0.5) / F.lit(10.0))


def rate_at(batches: DataFrame, now_ms: int, started_ms: int) -> DataFrame:
    """The rate at one moment from `(at_ms, n)` rows."""
    recent = batches.filter((F.col("at_ms") > now_ms - WINDOW_MS) & (F.col("at_ms") <= now_ms))
    window = F.lit(min(WINDOW_MS, now_ms - started_ms))
    return recent.agg(_rate(F.coalesce(F.sum("n"), F.lit(0)), window).alias("rate"))


def rolling_rate(batches: DataFrame, started_ms: int) -> DataFrame:
    """`(at_ms, n, total, rate)` at every moment with a batch.

    Moments are put into minutes and every minute also gets the one before it, so a window holds
    at most two minutes of distinct milliseconds instead of the whole history.
    """
    moments = batches.groupBy("at_ms").agg(F.sum("n").alias("n"))
    minute = F.call_function("div", F.col("at_ms") - F.pmod("at_ms", F.lit(WINDOW_MS)), F.lit(WINDOW_MS))
    spread = moments.withColumn("own", minute).withColumn("minute", F.explode(F.array("own", F.col("own") + 1)))
    trailing = Window.partitionBy("minute").orderBy("at_ms").rangeBetween(-(WINDOW_MS - 1), 0)
    window = F.least(F.lit(WINDOW_MS), F.col("at_ms") - F.lit(started_ms))
    return (
        spread.withColumn("total", F.sum("n").over(trailing))
        .filter(F.col("minute") == F.col("own"))
        .select("at_ms", "n", "total", _rate(F.col("total"), window).alias("rate"))
    )


def ingest_counts(parsed: DataFrame, keep: Column, target: DataFrame) -> DataFrame:
    """One row of counters for a batch: received, filtered out, inserted, duplicate, batches.

    The batch is read once into one row per fingerprint, which all counters come from.
    """
    per = stored(
        parsed.groupBy("fingerprint").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(keep, F.lit(False))).alias("kept")
        ),
        "batch",
    )
    kept = per.filter(F.col("kept") > 0).select("fingerprint")
    known = target.select("fingerprint").join(
        broadcast_if_small(kept, F.length("fingerprint")), "fingerprint", "left_semi"
    )
    inserted = kept.join(known, "fingerprint", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    received, passed = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kept"), F.lit(0))
    return (
        per.agg(received.alias("received"), passed.alias("kept"))
        .select("*", inserted.alias("inserted"))
        .select(
            "received",
            (F.col("received") - F.col("kept")).alias("filtered"),
            "inserted",
            (F.col("kept") - F.col("inserted")).alias("duplicate"),
            F.when(F.col("kept") > 0, 1).otherwise(0).alias("batches"),
        )
    )
