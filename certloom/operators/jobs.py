"""Statistics jobs over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from certloom import schemas
from certloom.operators import periods, tables
from certloom.sources.suffixes import SuffixRules


def _schema(step: int):
    return schemas.HOURLY_STATS if step == periods.HOUR else schemas.DAILY_STATS


def _existing(spark: SparkSession, path: str, step: int) -> DataFrame:
    if tables.path_exists(spark, path):
        return tables.read_periods(spark, path, _schema(step))
    return spark.createDataFrame([], _schema(step))


def update_stats(
    spark: SparkSession,
    certs: DataFrame,
    path: str,
    step: int,
    rules: SuffixRules,
    now: int,
    start: int | None = None,
    end: int | None = None,
    force: bool = False,
) -> None:
    """Fill the missing periods of the statistics table at `path`, or recompute all with `force`.

    The default range is from the oldest certificate's day to today.
    """
    if start is None or end is None:
        whole = periods.default_range(certs, now)
        if whole is None:
            return
        start, end = whole[0] if start is None else start, whole[1] if end is None else end
    rows = periods.backfill(certs, _existing(spark, path, step), start, end, step, rules, now, force)
    tables.save_periods(spark, path, rows, _schema(step))


def update_latest(spark: SparkSession, certs: DataFrame, path: str, step: int, rules: SuffixRules, now: int) -> None:
    """Add the last completed period to the statistics table at `path` when it is absent."""
    rows = periods.latest_completed(certs, _existing(spark, path, step), now, step, rules, now)
    tables.save_periods(spark, path, rows, _schema(step))
