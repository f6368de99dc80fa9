"""Hourly and daily statistics: one pass over the certificates for all periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from certloom.functions import hosts, times
from certloom.functions.predicates import seen_between
from certloom.operators.domains import registrable_domain
from certloom.schemas import TOP_LIST
from certloom.session import BROADCAST_ROWS
from certloom.sources.suffixes import SuffixRules

HOUR, DAY = times.HOUR, times.DAY
TOP = 100

# Facets of the counting pass; the first three are slots in front of the names of a certificate.
ISSUER, WILDCARD, HOUR_SLOT, DOMAIN, NO_DOMAIN = range(5)
YES, NO = "y", "n"


def _period(step: int) -> Column:
    return times.bucket(F.col("seen_at"), step).alias("period_start")


def table_stats(df: DataFrame) -> DataFrame:
    """One row: rows, distinct issuers without null, newest and oldest sighting."""
    return df.agg(
        F.count(F.lit(1)).alias("total_certificates"),
        F.countDistinct("issuer_org").alias("unique_issuers"),
        F.max("seen_at").alias("latest_seen_at"),
        F.min("seen_at").alias("oldest_seen_at"),
    )


def period_basics(df: DataFrame, step: int) -> DataFrame:
    """Counts per period; empty periods give no row."""
    return (
        df.select(_period(step), "domain_count", "issuer_org", hosts.has_wildcard(F.col("domains")).alias("wild"))
        .groupBy("period_start")
        .agg(
            F.count(F.lit(1)).alias("total_certificates"),
            F.sum("domain_count").alias("total_domain_count"),
            F.countDistinct("issuer_org").alias("unique_issuers"),
            F.count_if("wild").alias("wildcard_count"),
        )
    )


def top_k(counts: DataFrame, keys: list[str], value: str, k: int = TOP, n: str = "n") -> DataFrame:
    """The `k` largest counts per key group as `(keys, rank, value, count)`; ties go to the smaller value.

    The rank filter becomes a limit before the shuffle, so no task sees a whole large group.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(n).desc(), F.col(value).asc())
    return (
        counts.select(*keys, F.row_number().over(order).alias("rank"), F.col(value).alias("value"), F.col(n).alias("count"))
        .filter(F.col("rank") <= k)
    )


def pack_top_list(flat: DataFrame, key: str, out: str) -> DataFrame:
    """Flat ranked rows to one `array<struct<value,count>>` per key; at most `k` entries each."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "value", "count")))
    return flat.groupBy(key).agg(_entries(entries).alias(out))


def _entries(ranked: Column) -> Column:
    return F.transform(ranked, lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count")))


def top_issuers(df: DataFrame, step: int, k: int = TOP) -> DataFrame:
    counts = (
        df.filter(F.col("issuer_org").isNotNull())
        .groupBy(_period(step), "issuer_org")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_k(counts, ["period_start"], "issuer_org", k)


def registrable_counts(df: DataFrame, step: int, rules: SuffixRules) -> DataFrame:
    """Name occurrences per period and registrable domain."""
    names = (
        df.select(_period(step), F.explode("domains").alias("domain"))
        .groupBy("period_start", hosts.bare_name(F.col("domain")).alias("host"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        registrable_domain(names, "host", rules, bare=True)
        .filter(F.col("registrable").isNotNull())
        .groupBy("period_start", "registrable")
        .agg(F.sum("n").alias("n"))
    )


def top_domains(df: DataFrame, step: int, rules: SuffixRules, k: int = TOP) -> DataFrame:
    return top_k(registrable_counts(df, step, rules), ["period_start"], "registrable", k)


def unique_domains(df: DataFrame, step: int, rules: SuffixRules) -> DataFrame:
    return (
        registrable_counts(df, step, rules)
        .groupBy("period_start")
        .agg(F.count(F.lit(1)).alias("unique_domains"))
    )


def wildcard_certs(df: DataFrame, step: int) -> DataFrame:
    return df.groupBy(_period(step)).agg(F.count_if(hosts.has_wildcard(F.col("domains"))).alias("wildcard_count"))


def wildcard_sans(df: DataFrame, step: int) -> DataFrame:
    return df.groupBy(_period(step)).agg(F.sum(hosts.wildcard_sans(F.col("domains"))).alias("wildcard_sans"))


def avg_san_count(df: DataFrame, step: int) -> DataFrame:
    return df.groupBy(_period(step)).agg(
        (F.sum("domain_count").cast("double") / F.count(F.lit(1))).alias("avg_san_count")
    )


def peak_hourly(df: DataFrame) -> DataFrame:
    """Largest hourly count of each day; a second, tiny aggregate over the hourly counts."""
    hourly = df.groupBy(times.hour_bucket(F.col("seen_at")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hourly.groupBy(times.day_bucket(F.col("hour")).alias("period_start")).agg(
        F.max("n").alias("peak_hourly_rate")
    )


def facet_counts(df: DataFrame, rules: SuffixRules, step: int, hours: bool = False) -> DataFrame:
    """`(period_start, facet, value, n)`: every count the statistics need, from one scan.

    A certificate gives its issuer, its wildcard flag, its hour when `hours` is set, and its names;
    equal items are added up before they are shuffled. Names become registrable domains after that
    first count, so the lookup runs once per distinct host and period.
    """
    flag = F.when(hosts.has_wildcard(F.col("domains")), YES).otherwise(NO)
    slots = [F.col("issuer_org"), flag]
    if hours:
        slots.append(times.bucket_index(F.col("seen_at"), HOUR).cast("string"))
    pos = F.col("pos")
    facet = F.when(pos < len(slots), pos).otherwise(F.lit(DOMAIN))
    value = F.when(pos < len(slots), F.col("col")).otherwise(hosts.bare_name(F.col("col")))
    raw = (
        df.select(_period(step), F.posexplode(F.concat(F.array(*slots), F.coalesce("domains", F.array().cast("array<string>")))))
        .filter((pos != ISSUER) | F.col("col").isNotNull())
        .groupBy("period_start", facet.alias("facet"), value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    is_name = F.col("facet") == DOMAIN
    named = registrable_domain(raw.withColumn("host", F.when(is_name, F.col("value"))), "host", rules, bare=True)
    return (
        named.groupBy(
            "period_start",
            F.when(is_name & F.col("registrable").isNull(), NO_DOMAIN).otherwise(F.col("facet")).alias("facet"),
            F.when(is_name, F.col("registrable")).otherwise(F.col("value")).alias("value"),
        )
        .agg(F.sum("n").alias("n"))
    )


def _stats(df: DataFrame, step: int, rules: SuffixRules, computed_at: int | Column, k: int) -> DataFrame:
    return stats_of_counts(facet_counts(df, rules, step, hours=step == DAY), step, computed_at, k)


def stats_of_counts(counts: DataFrame, step: int, computed_at: int | Column, k: int = TOP) -> DataFrame:
    """Statistics rows from `(period_start, facet, value, n)` with one row per item; days also need their hours as items."""
    daily = step == DAY
    facet, n = F.col("facet"), F.col("n")

    def total(*facets: int) -> Column:
        return F.coalesce(F.sum(F.when(facet.isin(*facets), n)), F.lit(0))

    certificates = total(WILDCARD)
    # Both branches read the same columns of the same shuffled counts, which are then computed once.
    totals = counts.groupBy("period_start").agg(
        certificates.alias("total_certificates"),
        F.count_if(facet == DOMAIN).alias("unique_domains"),
        F.count_if(facet == ISSUER).alias("unique_issuers"),
        F.coalesce(F.sum(F.when((facet == WILDCARD) & (F.col("value") == YES), n)), F.lit(0)).alias("wildcard_count"),
        (total(DOMAIN, NO_DOMAIN).cast("double") / certificates).alias("avg_san_count"),
        *([F.max(F.when(facet == HOUR_SLOT, n)).alias("peak_hourly_rate")] if daily else []),
    )

    def packed(name: int) -> Column:
        ranked = F.collect_list(F.when(facet == name, F.struct("rank", "value", "count")))
        return F.coalesce(_entries(F.array_sort(ranked)), F.array().cast(TOP_LIST))

    tops = (
        top_k(counts, ["period_start", "facet"], "value", k)
        .groupBy("period_start")
        .agg(packed(DOMAIN).alias("top_domains"), packed(ISSUER).alias("top_issuers"))
    )
    computed = computed_at if isinstance(computed_at, Column) else F.lit(computed_at)
    return totals.join(tops, "period_start").select(
        "period_start",
        (F.col("period_start") + step).alias("period_end"),
        "total_certificates",
        "unique_domains",
        "unique_issuers",
        "wildcard_count",
        "avg_san_count",
        "top_domains",
        "top_issuers",
        computed.cast("bigint").alias("computed_at"),
        *(["peak_hourly_rate"] if daily else []),
    )


def hourly_stats(df: DataFrame, rules: SuffixRules, computed_at: int | Column, k: int = TOP) -> DataFrame:
    return _stats(df, HOUR, rules, computed_at, k)


def daily_stats(df: DataFrame, rules: SuffixRules, computed_at: int | Column, k: int = TOP) -> DataFrame:
    return _stats(df, DAY, rules, computed_at, k)


def stats_for(df: DataFrame, step: int, rules: SuffixRules, computed_at: int | Column, k: int = TOP) -> DataFrame:
    if step not in (HOUR, DAY):
        raise ValueError("periods are hours or days")
    return _stats(df, step, rules, computed_at, k)


def calendar(spark: SparkSession, start: int, end: int, step: int) -> DataFrame:
    """Starts of the periods in `[start, end)`, both rounded down."""
    return spark.range(start - start % step, end - end % step, step).select(F.col("id").alias("period_start"))


def missing_periods(stats: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """Periods of the range without a statistics row."""
    return calendar(stats.sparkSession, start, end, step).join(
        stats.select("period_start").distinct(), "period_start", "left_anti"
    )


def in_periods(df: DataFrame, periods: DataFrame, step: int, start: int, end: int) -> DataFrame:
    """Certificates that fall in one of the periods, with the range bounds for partition pruning.

    The periods are at most one row per step of a bounded range, so their number is known here.
    """
    wanted = periods.select(F.col("period_start").alias("_period"))
    if (end - start) // step + 1 <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return df.filter(seen_between(start, end)).join(
        wanted, times.bucket(F.col("seen_at"), step) == F.col("_period"), "left_semi"
    )


def default_range(df: DataFrame, now: int) -> tuple[int, int] | None:
    """Oldest day to today; one aggregated row is read."""
    oldest = df.agg(F.min("seen_at").alias("t")).first()["t"]
    return None if oldest is None else (oldest - oldest % DAY, now - now % DAY)


def backfill(
    df: DataFrame,
    existing: DataFrame,
    start: int,
    end: int,
    step: int,
    rules: SuffixRules,
    computed_at: int | Column,
    force: bool = False,
) -> DataFrame:
    """Statistics of the missing periods, or of all with `force`, in one job."""
    start, end = start - start % step, end - end % step
    if force:

        chosen = df.filter(seen_between(start, end))
    else:
        chosen = in_periods(df, missing_periods(existing, start, end, step), step, start, end)
    return stats_for(chosen, step, rules, computed_at)


def latest_completed(
    df: DataFrame, existing: DataFrame, now: int, step: int, rules: SuffixRules, computed_at: int | Column
) -> DataFrame:
    """Statistics of the last full period, no row when they exist."""
    start = now - now % step - step
    return backfill(df, existing, start, start + step, step, rules, computed_at)


def facet_table(df: DataFrame) -> DataFrame:
    """Several aggregates of one filtered input in one pass: `(facet, value, n)` by issuer and raw name."""
    issuer = F.col("issuer_org")
    items = F.concat(
        F.array(F.struct(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("value"))),
        F.when(
            issuer.isNotNull(), F.array(F.struct(F.lit("issuer").alias("facet"), issuer.alias("value")))
        ).otherwise(F.array().cast("array<struct<facet:string,value:string>>")),
        F.transform(F.coalesce("domains", F.array().cast("array<string>")), lambda d: F.struct(F.lit("domain").alias("facet"), d.alias("value"))),
    )
    return df.select(F.inline(items)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def conditional_totals(df: DataFrame) -> DataFrame:
    """Distinct and plain counts under a condition, in one aggregate."""
    wild = hosts.has_wildcard(F.col("domains"))
    return df.agg(
        F.countDistinct(F.when(wild, F.col("issuer_org"))).alias("wildcard_issuers"),
        F.count_if(wild).alias("wildcard_certs"),
        F.count_if(F.col("issuer_org").isNull()).alias("no_issuer_certs"),
    )


def issuer_set(df: DataFrame, step: int) -> DataFrame:
    """Distinct issuers of each period as rows, nulls removed."""
    return df.filter(F.col("issuer_org").isNotNull()).select(_period(step), "issuer_org").distinct()


def approx_stats(df: DataFrame, step: int, rules: SuffixRules) -> DataFrame:
    """Mergeable sketches per period: issuers and registrable domains.

    Every task makes one sketch per period of what it reads, so only sketches are shuffled, whatever the number of
    names. A certificate without names still counts its issuer.
    """
    names = df.select(_period(step), "issuer_org", F.explode_outer("domains").alias("domain"))
    return (
        registrable_domain(names, "domain", rules)
        .groupBy("period_start")
        .agg(F.hll_sketch_agg("issuer_org").alias("issuer_sketch"), F.hll_sketch_agg("registrable").alias("domain_sketch"))
    )


def merge_approx(sketches: DataFrame, step: int) -> DataFrame:
    """Union of finer sketches to a coarser period."""
    return sketches.groupBy(times.bucket(F.col("period_start"), step).alias("period_start")).agg(
        F.hll_union_agg("issuer_sketch").alias("issuer_sketch"),
        F.hll_union_agg("domain_sketch").alias("domain_sketch"),
    )


def approx_counts(sketches: DataFrame) -> DataFrame:
    return sketches.select(
        "period_start",
        F.hll_sketch_estimate("issuer_sketch").alias("approx_issuers"),
        F.hll_sketch_estimate("domain_sketch").alias("approx_domains"),
    )
