"""Summaries of statistics rows: range totals, merged top lists, volume bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.operators.periods import DAY, TOP, top_k

# Seconds of a range and whether it reads hourly rows.
RANGES = {"24h": (DAY, True), "7d": (7 * DAY, False), "30d": (30 * DAY, False)}


def in_range(hourly: DataFrame, daily: DataFrame, name: str, now: int) -> DataFrame:
    seconds, use_hourly = RANGES[name]
    rows = hourly if use_hourly else daily
    return rows.filter((F.col("period_start") >= now - seconds) & (F.col("period_start") < now))


def merged_counts(stats: DataFrame, list_col: str) -> DataFrame:
    """Sum of the counts per listed value."""
    return (
        stats.select(F.inline(list_col)).groupBy("value").agg(F.sum("count").alias("n"))
    )


def merge_top_lists(stats: DataFrame, list_col: str, k: int = TOP) -> DataFrame:
    """Lists of all periods as one, ranked again: `(rank, value, count)`."""
    counts = merged_counts(stats, list_col).withColumn("list", F.lit(list_col))
    return top_k(counts, ["list"], "value", k).drop("list")


def rank_entries(stats: DataFrame, list_col: str) -> DataFrame:
    """Entries of each period's list with their place from 1."""
    return stats.select("period_start", F.posexplode(list_col).alias("pos", "entry")).select(
        "period_start", (F.col("pos") + 1).alias("rank"), "entry.value", "entry.count"
    )


def range_summary(stats: DataFrame) -> DataFrame:
    """One row of totals; `listed_*` counts the distinct entries of the merged lists."""
    totals = stats.agg(
        F.coalesce(F.sum("total_certificates"), F.lit(0)).alias("total_certificates"),
        F.coalesce(F.sum("wildcard_count"), F.lit(0)).alias("wildcard_count"),
    )
    listed = [
        merged_counts(stats, c).agg(F.count(F.lit(1)).alias("n")).scalar().alias(name)
        for c, name in (("top_domains", "listed_domains"), ("top_issuers", "listed_issuers"))
    ]
    return totals.select("*", *listed)


def mean_of_period_averages(stats: DataFrame) -> DataFrame:
    """Unweighted mean to one decimal, next to the mean weighted with certificates."""
    weighted = F.sum(F.col("avg_san_count") * F.col("total_certificates")) / F.sum("total_certificates")
    return stats.agg(
        F.round(F.coalesce(F.avg("avg_san_count"), F.lit(0.0)), 1).alias("mean_avg_san_count"),
        F.round(weighted, 6).alias("weighted_avg_san_count"),
    )


def volume_series(stats: DataFrame) -> DataFrame:
    """Bar width in percent of the largest period, at least 4."""
    peak = stats.agg(F.max("total_certificates")).scalar()
    width = F.col("total_certificates") * (F.lit(100.0) / peak)
    return stats.select(
        "period_start",
        "total_certificates",
        F.greatest(F.lit(4.0), F.when(peak > 0, width).otherwise(F.lit(0.0))).alias("width"),
    ).orderBy("period_start")
