"""Checked queries: statistics, summaries, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from certloom.operators import frequent, periods, rates, stored_counts, summaries, tables
from certloom.operators.domains import domain_counts
from certloom.operators.search import search
from certloom.plans import derived
from certloom.plans.ingest_queries import BASICS, GITHUB, GITHUB_SQL, JAN_10, JAN_15, JAN_20
from certloom.plans.registry import CERTS, NULLED, WILD, query, registrable_sql
from certloom.plans.search_queries import HOLES, NAMES, stats_with_holes
from certloom.sources.messages import ingest_predicate, parse_messages
from certloom.session import scratch_dir, stored
from certloom.sources.suffixes import seed_rules

HOUR, DAY = periods.HOUR, periods.DAY

REG = CERTS + NAMES + ", " + registrable_sql("names", "d")


def period(step: int) -> str:
    return f"seen_at - seen_at % {step} AS period_start"


def top_sql(step: int, source: str, value: str, where: str, k: int = 100) -> str:
    """Ranked rows per period of a counted value."""
    return f"""SELECT period_start, rank, value, count FROM (SELECT *, row_number() OVER (PARTITION BY period_start
    ORDER BY count DESC, value) AS rank FROM (SELECT {period(step)}, {value} AS value, count(*) AS count
    FROM {source} WHERE {where} GROUP BY ALL)) WHERE rank <= {k}"""


NAMED = "names JOIN reg USING (d)"


@query("d1_table_stats", f"""{CERTS} SELECT count(*) AS total_certificates, count(DISTINCT issuer_org) AS unique_issuers,
  max(seen_at) AS latest_seen_at, min(seen_at) AS oldest_seen_at FROM certs""")
def _(spark, sf):
    return periods.table_stats(derived.certs(spark, sf))


for step, label in ((HOUR, "hourly"), (DAY, "daily")):

    @query(f"d2_{label}_basics", f"{CERTS} SELECT {period(step)}, {BASICS} FROM certs GROUP BY 1")
    def _(spark, sf, step=step):
        return periods.period_basics(derived.certs(spark, sf), step)

    @query(f"d3_{label}_top_issuers", f"{CERTS} {top_sql(step, 'certs', 'issuer_org', 'issuer_org IS NOT NULL')}")
    def _(spark, sf, step=step):
        return periods.top_issuers(derived.certs(spark, sf), step)

    @query(f"d4_{label}_top_domains", f"{REG} {top_sql(step, NAMED, 'registrable', 'registrable IS NOT NULL')}")
    def _(spark, sf, step=step):
        return periods.top_domains(derived.certs(spark, sf), step, seed_rules(spark))


@query("d5_unique_domains", f"{REG} SELECT {period(DAY)}, count(DISTINCT registrable) AS unique_domains FROM {NAMED} WHERE registrable IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return periods.unique_domains(derived.certs(spark, sf), DAY, seed_rules(spark))


@query("d6_wildcard_certs", f"{CERTS} SELECT {period(DAY)}, count(*) FILTER ({WILD}) AS wildcard_count FROM certs GROUP BY 1")
def _(spark, sf):
    return periods.wildcard_certs(derived.certs(spark, sf), DAY)


@query("d7_wildcard_sans", f"{CERTS}{NAMES} SELECT {period(DAY)}, count(*) FILTER (d LIKE '*.%') AS wildcard_sans FROM names GROUP BY 1")
def _(spark, sf):
    return periods.wildcard_sans(derived.certs(spark, sf), DAY)


@query("d8_avg_san_count", f"{CERTS} SELECT {period(DAY)}, round(cast(sum(domain_count) AS double) / count(*), 6) AS avg_san_count FROM certs GROUP BY 1")
def _(spark, sf):
    return periods.avg_san_count(derived.certs(spark, sf), DAY).withColumn("avg_san_count", F.round("avg_san_count", 6))


PEAK = f"""peak AS (SELECT h - h % 86400 AS period_start, max(n) AS peak_hourly_rate FROM
  (SELECT seen_at - seen_at % 3600 AS h, count(*) AS n FROM certs GROUP BY 1) GROUP BY 1)"""


@query("d9_peak_hourly", f"{CERTS}, {PEAK} SELECT * FROM peak")
def _(spark, sf):
    return periods.peak_hourly(derived.certs(spark, sf))


def scalars(stats):
    """A statistics row without its lists."""
    return stats.drop("top_domains", "top_issuers").withColumn("avg_san_count", F.round("avg_san_count", 6))


def stats_sql(step: int, where: str = "true", computed_at: int = 9) -> str:
    """CTE-free body; needs REG in front."""
    return f"""SELECT b.period_start, b.period_start + {step} AS period_end, total_certificates,
  coalesce(unique_domains, 0) AS unique_domains, unique_issuers, wildcard_count,
  round(cast(total_domain_count AS double) / total_certificates, 6) AS avg_san_count, {computed_at} AS computed_at
  FROM (SELECT {period(step)}, {BASICS} FROM certs WHERE {where} GROUP BY 1) b
  LEFT JOIN (SELECT {period(step)}, count(DISTINCT registrable) AS unique_domains FROM {NAMED} GROUP BY 1) u USING (period_start)"""


@query("d10_hourly_stats", f"{REG} {stats_sql(HOUR)}")
def _(spark, sf):
    return scalars(periods.hourly_stats(derived.certs(spark, sf), seed_rules(spark), 9))


@query("d10_daily_stats", f"{REG}, {PEAK} SELECT s.*, peak_hourly_rate FROM ({stats_sql(DAY)}) s JOIN peak USING (period_start)")
def _(spark, sf):
    return scalars(periods.daily_stats(derived.certs(spark, sf), seed_rules(spark), 9))


def both_tops(step: int, k: int = 100) -> str:
    return f"""SELECT 'domains' AS list, * FROM ({top_sql(step, NAMED, 'registrable', 'registrable IS NOT NULL', k)})
  UNION ALL SELECT 'issuers', * FROM ({top_sql(step, 'certs', 'issuer_org', 'issuer_org IS NOT NULL', k)})"""


def both_lists(stats):
    """Both top lists of statistics rows as flat rows."""
    return (
        stats.select(
            "period_start",
            F.stack(F.lit(2), F.lit("domains"), F.col("top_domains"), F.lit("issuers"), F.col("top_issuers")).alias("list", "top"),
        )
        .select("period_start", "list", F.posexplode("top").alias("pos", "e"))
        .select("list", "period_start", (F.col("pos") + 1).cast("bigint").alias("rank"), "e.value", "e.count")
    )


@query("d10_hourly_lists", f"{REG} {both_tops(HOUR)}")
def _(spark, sf):
    return both_lists(periods.hourly_stats(derived.certs(spark, sf), seed_rules(spark), 9))


@query("d10_daily_lists", f"{REG} {both_tops(DAY)}")
def _(spark, sf):
    return both_lists(periods.daily_stats(derived.certs(spark, sf), seed_rules(spark), 9))


IN_RANGE = f"seen_at >= {JAN_10} AND seen_at < {JAN_20}"


@query("d11_backfill_missing", f"""{REG}, {HOLES} SELECT * FROM ({stats_sql(HOUR, IN_RANGE)})
  WHERE period_start NOT IN (SELECT period_start FROM holes)""")
def _(spark, sf):
    c = derived.certs(spark, sf)
    return scalars(periods.backfill(c, stats_with_holes(spark, sf), JAN_10, JAN_20, HOUR, seed_rules(spark), 9))


@query("d11_backfill_force", f"{REG}, {PEAK} SELECT s.*, peak_hourly_rate FROM ({stats_sql(DAY, IN_RANGE)}) s JOIN peak USING (period_start)")
def _(spark, sf):
    c = derived.certs(spark, sf)
    existing = periods.period_basics(c, DAY)
    return scalars(periods.backfill(c, existing, JAN_10, JAN_20, DAY, seed_rules(spark), 9, force=True))


@query("d11_incremental", f"{REG}, {PEAK} SELECT s.*, peak_hourly_rate FROM ({stats_sql(DAY, f'seen_at >= {JAN_10}')}) s JOIN peak USING (period_start)")
def _(spark, sf):
    """Days as sums of stored counts, after an insert, a late batch and retention."""
    return scalars(stored_counts.period_stats(spark, counted_table(spark, sf), DAY, 9))


@query("d11_incremental_lists", f"{REG} SELECT * FROM ({both_tops(HOUR)}) WHERE period_start >= {JAN_10}")
def _(spark, sf):
    return both_lists(stored_counts.period_stats(spark, counted_table(spark, sf), HOUR, 9))


def counted_table(spark, sf):
    """A stored table with counts: rows of one log are there first, later ones are inserted, then those of the other
    logs, which are late; at last retention deletes what is older than January 10th."""
    path, c = scratch_dir(spark, "counted"), derived.certs(spark, sf)
    known = F.col("log_name") == "log0"
    tables.append_new(spark, path, c.filter(known & (F.col("seen_at") < JAN_20)))
    stored_counts.build(spark, path, seed_rules(spark))
    for part in (c.filter(known & (F.col("seen_at") >= JAN_20)), c.filter(~known)):
        tables.append_new(spark, path, part)
    tables.enforce_retention(spark, path, 20, JAN_10 + 20 * DAY)
    return path


@query("d12_latest_completed", f"{REG} {stats_sql(HOUR, f'seen_at >= {JAN_15 + 7200} AND seen_at < {JAN_15 + 10800}')}")
def _(spark, sf):
    """The last full hour at a moment of January 15th, of a table that has no row for it."""
    c = derived.certs(spark, sf)
    existing = periods.period_basics(c.filter(F.col("seen_at") < JAN_15), HOUR)
    return scalars(periods.latest_completed(c, existing, JAN_15 + 12345, HOUR, seed_rules(spark), 9))


SUMMARY_NOW = JAN_20 + 43200


def week(spark, sf):
    """The last seven days of stored daily rows."""
    daily = stored(periods.daily_stats(derived.certs(spark, sf), seed_rules(spark), 9), "daily")
    return summaries.in_range(daily, daily, "7d", SUMMARY_NOW)


WEEK = f"period_start >= {SUMMARY_NOW - 7 * 86400} AND period_start < {SUMMARY_NOW}"


@query("d13_range_summary", f"""{REG}, tops AS ({both_tops(DAY)})
  SELECT (SELECT sum(total_certificates) FROM ({stats_sql(DAY)}) WHERE {WEEK}) AS total_certificates,
    (SELECT sum(wildcard_count) FROM ({stats_sql(DAY)}) WHERE {WEEK}) AS wildcard_count,
    (SELECT count(DISTINCT value) FROM tops WHERE list = 'domains' AND {WEEK}) AS listed_domains,
    (SELECT count(DISTINCT value) FROM tops WHERE list = 'issuers' AND {WEEK}) AS listed_issuers""")
def _(spark, sf):
    return summaries.range_summary(week(spark, sf))


@query("d10_null_names", f"""{CERTS} SELECT {period(DAY)}, count(*) AS total_certificates, count(DISTINCT issuer_org) AS unique_issuers,
  count(*) FILTER ({WILD} AND cert_index % 2 = 1) AS wildcard_count FROM certs GROUP BY 1""")
def _(spark, sf):
    """Half of the certificates without a list of names."""
    c = derived.certs(spark, sf).withColumn("domains", F.when(F.col("cert_index") % 2 == 1, F.col("domains")))
    stats = periods.daily_stats(c, seed_rules(spark), 9)
    return stats.select("period_start", "total_certificates", "unique_issuers", "wildcard_count")


for name, step, label in (("24h", HOUR, "last_day"), ("30d", DAY, "last_month")):
    since = SUMMARY_NOW - summaries.RANGES[name][0]

    @query(f"d13_{label}_totals", f"""{CERTS} SELECT count(*) AS total_certificates, count(*) FILTER ({WILD}) AS wildcard_count
      FROM certs WHERE seen_at - seen_at % {step} >= {since} AND seen_at - seen_at % {step} < {SUMMARY_NOW}""")
    def _(spark, sf, name=name):
        c, rules = derived.certs(spark, sf), seed_rules(spark)
        rows = summaries.in_range(periods.hourly_stats(c, rules, 9), periods.daily_stats(c, rules, 9), name, SUMMARY_NOW)
        return summaries.range_summary(rows).select("total_certificates", "wildcard_count")


@query("d13_last_day_issuers", f"""{CERTS}, tops AS ({top_sql(HOUR, 'certs', 'issuer_org', 'issuer_org IS NOT NULL')}),
  m AS (SELECT value, sum(count) AS count FROM tops WHERE period_start >= {SUMMARY_NOW - 86400} AND period_start < {SUMMARY_NOW} GROUP BY 1)
  SELECT row_number() OVER (ORDER BY count DESC, value) AS rank, value, cast(count AS bigint) AS count FROM m ORDER BY 1 LIMIT 100""")
def _(spark, sf):
    c, rules = derived.certs(spark, sf), seed_rules(spark)
    hourly, daily = periods.hourly_stats(c, rules, 9), periods.daily_stats(c, rules, 9)
    return summaries.merge_top_lists(summaries.in_range(hourly, daily, "24h", SUMMARY_NOW), "top_issuers")


ITEMS = f"""{REG}, items AS (SELECT seen_at, {periods.ISSUER} AS facet, issuer_org AS value FROM certs WHERE issuer_org IS NOT NULL
  UNION ALL SELECT seen_at, {periods.DOMAIN}, registrable FROM {NAMED} WHERE registrable IS NOT NULL)"""


def counted_since(seconds: int) -> str:
    """SQL: exact counts of issuers and domains in the hours of a range."""
    hour = f"seen_at - seen_at % {HOUR}"
    return f"SELECT facet, value, count(*) AS n FROM items WHERE {hour} >= {SUMMARY_NOW - seconds} AND {hour} < {SUMMARY_NOW} GROUP BY ALL"


for name, (seconds, _) in summaries.RANGES.items():

    @query(f"d3_merged_tops_{name}", f"""{ITEMS} SELECT facet, rank, value, n AS low, n AS high FROM (SELECT *, cast(row_number() OVER (PARTITION BY facet
      ORDER BY n DESC, value) AS integer) AS rank FROM ({counted_since(seconds)})) WHERE rank <= 100""")
    def _(spark, sf, seconds=seconds):
        """The first values of a range, from stored hourly sketches; hours of at most WIDTH values give exact counts."""
        sketches = stored(frequent.hourly(derived.certs(spark, sf), seed_rules(spark)), "sketches")
        merged = frequent.merge(frequent.in_range(sketches, SUMMARY_NOW - seconds, SUMMARY_NOW))
        return frequent.top(merged).select("facet", "rank", "value", "low", "high")

    @query(f"d3_bounds_hold_{name}", f"""{ITEMS}, c AS ({counted_since(seconds)}) SELECT facet, cast(sum(n) AS bigint) AS total, count(*) AS distinct_values,
      cast(0 AS bigint) AS outside FROM c GROUP BY facet""")
    def _(spark, sf, seconds=seconds):
        """Narrow sketches, merged by day and then for the range: number of true counts outside their bounds."""
        c, start = derived.certs(spark, sf), SUMMARY_NOW - seconds
        counts = periods.facet_counts(c, seed_rules(spark), HOUR).filter(F.col("facet").isin(periods.ISSUER, periods.DOMAIN))
        counts = stored(counts.filter((F.col("period_start") >= start) & (F.col("period_start") < SUMMARY_NOW)), "counts")
        merged = stored(frequent.merge(frequent.merge(frequent.sketch(counts, 3), DAY, 4), width=5), "merged")
        true = counts.groupBy("facet", "value").agg(F.sum("n").alias("n"))
        listed = merged.select("facet", F.inline("entries"))
        bounds = true.join(listed, ["facet", "value"], "left").join(merged.select("facet", "total", "slack"), "facet")
        held = F.col("n").between(F.coalesce("low", F.lit(0)), F.coalesce("high", "slack"))
        return bounds.groupBy("facet", "total").agg(F.count(F.lit(1)).alias("distinct_values"), F.count_if(~held).alias("outside"))


@query("d14_mean_of_averages", f"""{REG}, s AS ({stats_sql(DAY)}) SELECT round(avg(avg_san_count), 1) AS mean_avg_san_count,
  round(sum(avg_san_count * total_certificates) / sum(total_certificates), 4) AS weighted_avg_san_count FROM s""")
def _(spark, sf):
    stats = periods.daily_stats(derived.certs(spark, sf), seed_rules(spark), 9)
    return summaries.mean_of_period_averages(stats).withColumn(
        "weighted_avg_san_count", F.round("weighted_avg_san_count", 4)
    )


@query("d15_volume_series", f"""{CERTS}, s AS (SELECT {period(HOUR)}, count(*) AS total_certificates FROM certs GROUP BY 1)
  SELECT *, round(greatest(4.0, total_certificates * (100.0::double / max(total_certificates) OVER ())), 6) AS width FROM s""")
def _(spark, sf):
    stats = periods.period_basics(derived.certs(spark, sf), HOUR)
    return summaries.volume_series(stats).withColumn("width", F.round("width", 6))


@query("d16_domain_counts", f"{CERTS}{NAMES} SELECT d AS domain, count(*) AS n FROM names GROUP BY 1")
def _(spark, sf):
    return domain_counts(derived.certs(spark, sf))


@query("d18_facets", f"""{CERTS}, hit AS (SELECT * FROM certs WHERE {GITHUB_SQL})
  SELECT 'total' AS facet, NULL AS value, count(*) AS n FROM hit
  UNION ALL SELECT 'issuer', issuer_org, count(*) FROM hit WHERE issuer_org IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'domain', d, count(*) FROM (SELECT unnest(domains) AS d FROM hit) GROUP BY 2""")
def _(spark, sf):
    return periods.facet_table(search(derived.certs(spark, sf), GITHUB))


@query("d18_null_names", f"""{NULLED} SELECT 'total' AS facet, NULL AS value, count(*) AS n FROM certs
  UNION ALL SELECT 'issuer', issuer_org, count(*) FROM certs WHERE issuer_org IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'domain', d, count(*) FROM (SELECT unnest(domains) AS d FROM certs) GROUP BY 2""")
def _(spark, sf):
    return periods.facet_table(derived.nulled_certs(spark, sf))


@query("d19_conditional_totals", f"""{CERTS} SELECT count(DISTINCT issuer_org) FILTER ({WILD}) AS wildcard_issuers,
  count(*) FILTER ({WILD}) AS wildcard_certs, count(*) FILTER (issuer_org IS NULL) AS no_issuer_certs FROM certs""")
def _(spark, sf):
    return periods.conditional_totals(derived.certs(spark, sf))


@query("d20_issuer_set", f"{CERTS} SELECT DISTINCT {period(DAY)}, issuer_org FROM certs WHERE issuer_org IS NOT NULL")
def _(spark, sf):
    return periods.issuer_set(derived.certs(spark, sf), DAY)


@query("d21_approx_stats", f"""{REG}, i AS (SELECT {period(DAY)}, count(DISTINCT issuer_org) AS issuers FROM certs GROUP BY 1),
  n AS (SELECT {period(DAY)}, count(DISTINCT registrable) AS domains FROM {NAMED} GROUP BY 1)
  SELECT *, true AS issuers_close, true AS domains_close FROM i JOIN n USING (period_start)""")
def _(spark, sf):
    """Daily sketches as unions of hourly ones, held against the exact counts (five percent)."""
    c, rules = derived.certs(spark, sf), seed_rules(spark)
    approx = periods.approx_counts(periods.merge_approx(periods.approx_stats(c, HOUR, rules), DAY))
    issuers = periods.issuer_set(c, DAY).groupBy("period_start").agg(F.count(F.lit(1)).alias("issuers"))
    domains = periods.unique_domains(c, DAY, rules).withColumnRenamed("unique_domains", "domains")
    exact = issuers.join(domains, "period_start")

    def close(a, b):
        return F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), F.col(b) * 0.05)

    return exact.join(approx, "period_start").select(
        "period_start",
        "issuers",
        "domains",
        close("approx_issuers", "issuers").alias("issuers_close"),
        close("approx_domains", "domains").alias("domains_close"),
    )


RECEIVED = "received AS (SELECT * FROM certs WHERE cert_index % 50 <> 0 AND cert_index % 97 <> 0)"
KEPT = "len(list_filter(domains, lambda d: d LIKE '%.github.io' OR d LIKE '%.co.uk')) > 0 OR issuer_org ILIKE '%ca view%'"
GLOBS, ISSUERS = ["*.github.io", "*.co.uk"], ["ca view"]


@query("d22_ingest_counts", f"""{CERTS}, {RECEIVED}, kept AS (SELECT * FROM received WHERE {KEPT})
  SELECT (SELECT count(*) FROM received) AS received, (SELECT count(*) FROM received) - (SELECT count(*) FROM kept) AS filtered,
    (SELECT count(*) FROM kept WHERE seen_at >= {JAN_15}) AS inserted,
    (SELECT count(*) FROM kept WHERE seen_at < {JAN_15}) AS duplicate, 1 AS batches""")
def _(spark, sf):
    """All messages as one batch against a table that ends on January 15th."""
    parsed = parse_messages(derived.messages(spark, sf), now=0)
    target = derived.certs(spark, sf).filter(F.col("seen_at") < JAN_15)
    return rates.ingest_counts(parsed, ingest_predicate(GLOBS, ISSUERS), target)


# --- Windows and list merges -----------------------------------------------------------------


@query("e1_rank_entries", f"{CERTS} {top_sql(DAY, 'certs', 'issuer_org', 'issuer_org IS NOT NULL')}")
def _(spark, sf):
    packed = periods.pack_top_list(periods.top_issuers(derived.certs(spark, sf), DAY), "period_start", "top_issuers")
    return summaries.rank_entries(packed, "top_issuers").withColumn("rank", F.col("rank").cast("bigint"))


@query("e2_rolling_rate", f"""WITH b AS (SELECT epoch_us(ts) // 1000 AS at_ms, count(*) AS n FROM events GROUP BY 1),
  r AS (SELECT at_ms, n, cast(sum(n) OVER (ORDER BY at_ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS bigint) AS total FROM b)
  SELECT at_ms, n, total, CASE WHEN at_ms - 1704067200000 < 1000 THEN 0.0::double ELSE
    floor(total / (least(60000, at_ms - 1704067200000) / 1000.0::double) * 10 + 0.5) / 10.0::double END AS rate FROM r""")
def _(spark, sf):
    """Every event as a one-row batch, from the start of the year."""
    ev = derived.events(spark, sf)
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return rates.rolling_rate(ev.select(at.alias("at_ms"), F.lit(1).cast("bigint").alias("n")), 1704067200000)


@query("e2_rate_at", f"""SELECT floor(count(*) / 60.0::double * 10 + 0.5) / 10.0::double AS rate FROM events
  WHERE epoch_us(ts) // 1000 > {JAN_15}000 - 60000 AND epoch_us(ts) // 1000 <= {JAN_15}000""")
def _(spark, sf):
    ev = derived.events(spark, sf)
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    batches = ev.select(at.alias("at_ms"), F.lit(1).cast("bigint").alias("n"))
    return rates.rate_at(batches, JAN_15 * 1000, 1704067200000)


@query("g3_merge_top_lists", f"""{REG}, tops AS ({top_sql(DAY, NAMED, 'registrable', 'registrable IS NOT NULL')}),
  m AS (SELECT value, sum(count) AS count FROM tops WHERE {WEEK} GROUP BY 1)
  SELECT row_number() OVER (ORDER BY count DESC, value) AS rank, value, cast(count AS bigint) AS count FROM m ORDER BY 1 LIMIT 100""")
def _(spark, sf):
    return summaries.merge_top_lists(week(spark, sf), "top_domains")
