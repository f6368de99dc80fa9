"""Frequent values of any range from stored sketches, each count with its bounds.

Lists that were cut at 100 entries cannot be added up: a value that is 101st in every hour may be the first of the month.
A sketch keeps, per period and facet, the counts of its `width` most frequent values, and of the others only their number
and the largest of their counts, its `slack`. Sketches add up to those of longer ranges: the counts are summed, and a
value that one of the sketches does not list may have had up to that sketch's slack there. So the true count of a
value lies between the listed sum and that sum plus the slack of the sketches that do not list it, and no value
outside the merged sketch has more than its slack. Sums are cut to `width` again, with the slack raised to the highest upper bound that
was cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certloom.functions import times
from certloom.operators import periods
from certloom.sources.suffixes import SuffixRules

WIDTH = 1000  # values of a sketch
ENTRY = "array<struct<value:string,low:bigint,high:bigint>>"


def _sketches(entries: DataFrame, rest: DataFrame, keys: list[str], width: int) -> DataFrame:
    """`(keys, total, slack, entries)`: the `width` entries with the largest low counts, highest first.

    `rest` has one row `(keys, total, floor)` per key. The rank test is a limit in front of the shuffle, so a task
    sees at most `width` entries of a key, and the slack comes from one aggregate over the entries that were cut.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("low").desc(), F.col("value").asc()))
    ranked = entries.withColumn("place", place)
    order = F.array_sort(F.collect_list(F.struct("place", "value", "low", "high")))
    kept = ranked.filter(F.col("place") <= width).groupBy(*keys).agg(
        F.transform(order, lambda e: F.struct(e["value"].alias("value"), e["low"].alias("low"), e["high"].alias("high"))).cast(ENTRY).alias("entries"),
        F.collect_set("value").alias("listed"),
    )
    cut = (
        entries.join(kept.select(*keys, "listed"), keys)
        .filter(~F.array_contains("listed", F.col("value")))
        .groupBy(*keys)
        .agg(F.max("high").alias("highest"))
    )
    slack = F.greatest(F.col("floor"), F.coalesce("highest", F.lit(0))).cast("bigint")
    return rest.join(kept.drop("listed"), keys, "left").join(cut, keys, "left").select(
        *keys, "total", slack.alias("slack"), F.coalesce("entries", F.array().cast(ENTRY)).alias("entries")
    )


def sketch(counts: DataFrame, width: int = WIDTH) -> DataFrame:
    """`(period_start, facet, total, slack, entries)` of exact counts `(period_start, facet, value, n)`.

    Values must not repeat within a period and facet; null values and counts below one are left out.
    """
    keys = ["period_start", "facet"]
    valid = counts.filter(F.col("value").isNotNull() & (F.col("n") > 0))
    # The place after the last one kept has the largest count that is not listed.
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("value").asc())
    ranked = valid.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= width + 1)
    packed = F.array_sort(F.collect_list(F.when(F.col("place") <= width, F.struct("place", "value", "n"))))
    tops = ranked.groupBy(*keys).agg(
        F.transform(packed, lambda e: F.struct(e["value"].alias("value"), e["n"].alias("low"), e["n"].alias("high"))).cast(ENTRY).alias("entries"),
        F.coalesce(F.max(F.when(F.col("place") > width, F.col("n"))), F.lit(0)).cast("bigint").alias("slack"),
    )
    totals = valid.groupBy(*keys).agg(F.sum("n").alias("total"))
    return totals.join(tops, keys).select(*keys, "total", "slack", "entries")


def hourly(certificates: DataFrame, rules: SuffixRules, width: int = WIDTH) -> DataFrame:
    """The sketches of issuers and registrable domains of every hour, to be stored and merged to any range."""
    counts = periods.facet_counts(certificates, rules, periods.HOUR)
    return sketch(counts.filter(F.col("facet").isin(periods.ISSUER, periods.DOMAIN)), width)


def merged_entries(sketches: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """All values that any sketch of a key lists, with bounds for the sum, and `(keys, total, floor)`."""
    rest = sketches.groupBy(*keys).agg(F.sum("total").cast("bigint").alias("total"), F.sum("slack").cast("bigint").alias("floor"))
    listed = (
        sketches.select(*keys, "slack", F.explode("entries").alias("e"))
        .groupBy(*keys, F.col("e.value").alias("value"))
        .agg(F.sum("e.low").alias("low"), F.sum(F.col("e.high") - F.col("slack")).alias("above"))
    )
    # A sketch that does not list the value adds its slack to the upper bound.
    bounded = listed.join(rest, keys).select(*keys, "value", "low", F.least(F.col("floor") + F.col("above"), F.col("total")).cast("bigint").alias("high"))
    return bounded, rest


def merge(sketches: DataFrame, step: int | None = None, width: int = WIDTH) -> DataFrame:
    """Sketches of longer periods of `step` seconds, or one per facet for all of them (period_start is then the first of all)."""
    start = times.bucket(F.col("period_start"), step) if step else sketches.agg(F.min("period_start")).scalar()
    moved = sketches.withColumn("period_start", start)
    keys = ["period_start", "facet"]
    return _sketches(*merged_entries(moved, keys), keys, width)


def top(sketches: DataFrame, k: int = periods.TOP) -> DataFrame:
    """`(period_start, facet, rank, value, low, high, sure)`: the first entries of each sketch.

    `sure` tells that the value belongs to the true first `k` whatever the counts within the bounds are: no value
    that is not among these `k` can have more.
    """
    each = sketches.select("period_start", "facet", "slack", F.posexplode("entries").alias("at", "e"))
    beyond = each.filter(F.col("at") >= k).groupBy("period_start", "facet").agg(F.max("e.high").alias("next"))
    shown = each.filter(F.col("at") < k).join(beyond, ["period_start", "facet"], "left")
    rival = F.greatest(F.col("slack"), F.coalesce("next", F.lit(0)))
    return shown.select(
        "period_start", "facet", (F.col("at") + 1).alias("rank"), "e.value", "e.low", "e.high", (F.col("e.low") >= rival).alias("sure")
    )


def in_range(sketches: DataFrame, start: int, end: int) -> DataFrame:
    """The sketches of the periods that start in `[start, end)`."""
    at: Column = F.col("period_start")
    return sketches.filter((at >= start) & (at < end))
