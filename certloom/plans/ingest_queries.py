"""Checked queries: messages, table jobs, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from certloom import schemas
from certloom.functions import text, times
from certloom.functions.predicates import SearchSpec, Term, seen_between
from certloom.operators import key_runs, periods, present, search, tables
from certloom.operators.filters import filter_by_patterns
from certloom.plans import derived
from certloom.plans.registry import CERTS, COPIED, FLAT, flat, query
from certloom.session import scratch_dir
from certloom.sources.messages import ingest_filter, parse_messages
from certloom.sources.suffixes import seed_rules

NOW = 1706659200  # 2024-01-31
JAN_10, JAN_15, JAN_20 = 1704844800, 1705276800, 1705708800


@query(
    "a1_parse_messages",
    CERTS
    + """ SELECT fingerprint, array_to_string(domains, '|') AS domains, issuer_org, issuer_cn, subject_cn, not_before,
    not_after, serial_number, log_name, log_url, cert_index, cert_link, seen_at
  FROM certs WHERE cert_index % 50 <> 0 AND cert_index % 97 <> 0""",
)
def _(spark, sf):
    parsed = parse_messages(derived.messages(spark, sf), now=NOW)
    return parsed.withColumn("domains", F.array_join("domains", "|"))


@query("a2_read_certificates", CERTS + f" SELECT {FLAT} FROM certs WHERE seen_at >= {JAN_10} AND seen_at < {JAN_20}")
def _(spark, sf):
    path = scratch_dir(spark, "certificates")
    tables.rewrite_daily(derived.certs(spark, sf), path)
    rows = tables.read_certificates(spark, path)
    return flat(rows.filter(seen_between(JAN_10, JAN_20)))


@query("a2_read_table", CERTS + f" SELECT {FLAT} FROM certs")
def _(spark, sf):
    path = scratch_dir(spark, "certificates")
    tables.rewrite_daily(derived.certs(spark, sf), path)
    return flat(tables.read_certificates(spark, path))


FIRST_COPY = """first_copy AS (SELECT * FROM certs QUALIFY
  row_number() OVER (PARTITION BY fingerprint ORDER BY seen_at, log_url, cert_index) = 1)"""


@query(
    "a3_insert_new",
    COPIED
    + f""", target AS (SELECT * FROM certs WHERE seen_at < {JAN_15}),
  batch AS (SELECT * FROM certs WHERE seen_at >= {JAN_10} QUALIFY
    row_number() OVER (PARTITION BY fingerprint ORDER BY seen_at, log_url, cert_index) = 1)
  SELECT {FLAT} FROM batch WHERE fingerprint NOT IN (SELECT fingerprint FROM target)""",
)
def _(spark, sf):
    c = derived.copied_certs(spark, sf)
    return flat(tables.insert_new(c.filter(F.col("seen_at") < JAN_15), c.filter(F.col("seen_at") >= JAN_10)))


@query("a3_append_table", COPIED + ", " + FIRST_COPY + " SELECT fingerprint, count(*) AS n FROM first_copy GROUP BY fingerprint")
def _(spark, sf):
    """Two overlapping batches, the second sent twice."""
    path = scratch_dir(spark, "append")
    c = derived.copied_certs(spark, sf)
    tables.append_new(spark, path, c.filter(F.col("seen_at") < JAN_15))
    for _ in range(2):
        tables.append_new(spark, path, c.filter(F.col("seen_at") >= JAN_10))
    return tables.read_certificates(spark, path).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


@query("a3_many_batches", CERTS + """ SELECT fingerprint, count(*) AS n, true AS few_runs FROM certs GROUP BY fingerprint""")
def _(spark, sf):
    """Ten batches, of which the last comes twice; the runs of fingerprints stay few."""
    path, c = scratch_dir(spark, "batches"), derived.certs(spark, sf)
    for k in [*range(10), 9]:
        tables.append_new(spark, path, c.filter(F.col("cert_index") % 10 == k))
    few = len(key_runs.list_runs(spark, f"{path}/_keys")) <= 3
    return tables.read_certificates(spark, path).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.lit(few).alias("few_runs"))


def period_rows(df, step, computed_at):
    """Statistics-like rows without lists, one per period."""
    return periods.period_basics(df, step).withColumn("computed_at", F.lit(computed_at))


BASICS = """count(*) AS total_certificates, sum(domain_count) AS total_domain_count,
  count(DISTINCT issuer_org) AS unique_issuers, count(*) FILTER (len(list_filter(domains, lambda d: d LIKE '*.%')) > 0) AS wildcard_count"""


@query(
    "a4_upsert_periods",
    CERTS
    + f""", h AS (SELECT seen_at - seen_at % 3600 AS period_start, {BASICS} FROM certs GROUP BY 1)
  SELECT *, CASE WHEN period_start >= {JAN_15} THEN 2 ELSE 1 END AS computed_at FROM h""",
)
def _(spark, sf):
    c = derived.certs(spark, sf)
    old = period_rows(c, periods.HOUR, 1)
    return tables.upsert_periods(old, period_rows(c.filter(F.col("seen_at") >= JAN_15), periods.HOUR, 2))


@query(
    "a4_save_periods",
    CERTS
    + f""", d AS (SELECT seen_at - seen_at % 86400 AS period_start, count(*) AS total_certificates FROM certs GROUP BY 1)
  SELECT period_start, total_certificates, CASE WHEN period_start >= {JAN_15} THEN 2 ELSE 1 END AS computed_at FROM d""",
)
def _(spark, sf):
    path, rules, c = scratch_dir(spark, "daily"), seed_rules(spark), derived.certs(spark, sf)
    for version, rows in ((1, c), (2, c.filter(F.col("seen_at") >= JAN_15))):
        tables.save_periods(spark, path, periods.daily_stats(rows, rules, version), schemas.DAILY_STATS)
    return tables.read_periods(spark, path, schemas.DAILY_STATS).select("period_start", "total_certificates", "computed_at")


ISO = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"
CSV = f"""SELECT fingerprint AS "Fingerprint", array_to_string(domains, '; ') AS "Domains",
  cast(domain_count AS varchar) AS "Domain Count", coalesce(issuer_org, '') AS "Issuer Org",
  coalesce(issuer_cn, '') AS "Issuer CN", coalesce(subject_cn, '') AS "Subject CN",
  {ISO.format('not_before')} AS "Not Before", {ISO.format('not_after')} AS "Not After",
  serial_number AS "Serial Number", coalesce(log_name, '') AS "Log Name", {ISO.format('seen_at')} AS "Seen At" FROM certs"""


@query("a5_csv_rows", f"{CERTS} {CSV}")
def _(spark, sf):
    return present.csv_rows(derived.certs(spark, sf))


@query("a5_export_csv", f"{CERTS} {CSV}")
def _(spark, sf):
    """Written as CSV and read back."""
    path = scratch_dir(spark, "csv")
    rows = derived.certs(spark, sf)
    present.export_csv(rows, path)
    back = spark.read.schema(present.csv_rows(rows).schema).csv(path, header=True, escape='"', multiLine=False)
    return back.na.fill("")


@query(
    "a6_export_range",
    COPIED
    + f""" SELECT {FLAT} FROM certs WHERE seen_at > {JAN_15} OR (seen_at = {JAN_15} AND fingerprint > 'a')
  ORDER BY seen_at, fingerprint, cert_index LIMIT 1000""",
)
def _(spark, sf):
    return flat(search.export_range(derived.copied_certs(spark, sf), f"{JAN_15}:a", 1000))


@query("a7_copy_table", COPIED + ", kept AS (SELECT * FROM certs QUALIFY row_number() OVER "
       "(PARTITION BY fingerprint ORDER BY seen_at, log_url, cert_index) = 1) "
       f"SELECT {FLAT.replace('created_at', '7 AS created_at')} FROM kept")
def _(spark, sf):
    """A copy in two ranges over a target that holds a part of it already."""
    path = scratch_dir(spark, "copy")
    source = derived.copied_certs(spark, sf)
    tables.copy_table(spark, source.filter(F.col("seen_at") < JAN_10), path, 7)
    tables.copy_table(spark, source, path, 7, chunks=[(0, JAN_15), (JAN_15, NOW)])
    return flat(tables.read_certificates(spark, path))


@query("a8_rewrite_daily", CERTS + """ SELECT cast(seen_date AS varchar) AS seen_date, count(*) AS n, min(seen_at) AS first,
  max(seen_at) AS last, count(DISTINCT fingerprint) AS fingerprints FROM certs GROUP BY 1""")
def _(spark, sf):
    path = scratch_dir(spark, "daily-table")
    tables.rewrite_daily(derived.certs(spark, sf), path, partitions=8)
    return (
        tables.read_certificates(spark, path)
        .groupBy(F.col("seen_date").cast("string").alias("seen_date"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("seen_at").alias("first"),
            F.max("seen_at").alias("last"),
            F.countDistinct("fingerprint").alias("fingerprints"),
        )
    )


RETENTION_NOW = JAN_20 + 40000


@query("a9_retention", CERTS + f" SELECT {FLAT} FROM certs WHERE seen_at >= {RETENTION_NOW - 7 * 86400}")
def _(spark, sf):
    """Days dropped and the boundary day rewritten in a stored table."""
    path = scratch_dir(spark, "retention-table")
    tables.rewrite_daily(derived.certs(spark, sf), path)
    tables.enforce_retention(spark, path, 7, RETENTION_NOW)
    return flat(tables.read_certificates(spark, path))


@query("a9_retention_count", CERTS + f" SELECT count(*) AS deleted FROM certs WHERE seen_at < {RETENTION_NOW - 7 * 86400}")
def _(spark, sf):
    return tables.retention_count(derived.certs(spark, sf), 7, RETENTION_NOW)


@query("a10_compact", COPIED + f""", kept AS (SELECT * FROM certs QUALIFY row_number() OVER
  (PARTITION BY fingerprint ORDER BY created_at DESC, seen_at, log_url, cert_index) = 1) SELECT {FLAT} FROM kept""")
def _(spark, sf):
    return flat(tables.compact(derived.copied_certs(spark, sf), keys=("fingerprint",)))


@query("a10_compact_days", CERTS + f" SELECT {FLAT} FROM certs")
def _(spark, sf):
    """A table with every row of some days twice, compacted in place."""
    from datetime import date

    path = scratch_dir(spark, "compact-table")
    c = derived.certs(spark, sf)
    tables.rewrite_daily(c.unionByName(c.filter(seen_between(JAN_10, JAN_20))), path)
    tables.compact_days(spark, path, date(2024, 1, 10), date(2024, 1, 20))
    return flat(tables.read_certificates(spark, path))


@query("a11_metadata_table", """SELECT 'user' || user_id AS key, arg_max(event_type || '-' || event_id, v) AS value, max(v) AS updated_at
  FROM (SELECT *, epoch_us(ts) // 1000000 * 1000000 + event_id AS v FROM events) GROUP BY user_id""")
def _(spark, sf):
    """Written in two appends and read back."""
    path, rows = scratch_dir(spark, "metadata"), derived.metadata_versions(spark, sf)
    for part in (F.col("updated_at") % 2 == 0, F.col("updated_at") % 2 == 1):
        tables.save_metadata(spark, path, rows.filter(part))
    return tables.read_metadata(spark, path)


@query("a11_latest_by_key", """SELECT 'user' || user_id AS key, arg_max(event_type || '-' || event_id, v) AS value, max(v) AS updated_at
  FROM (SELECT *, (epoch_us(ts) // 1000000) * 1000000 + event_id AS v FROM events) GROUP BY 1""")
def _(spark, sf):
    return tables.latest_by_key(derived.metadata_versions(spark, sf), ["key"], "updated_at")


@query("a12_top_list_json", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 0 ELSE 0 END AS entries,
  CASE WHEN event_id % 3 = 0 THEN event_type || ':' || user_id || ',x:1' ELSE '' END AS listed FROM events""")
def _(spark, sf):
    entry = F.struct(F.col("event_type").alias("value"), F.col("user_id").alias("count"))
    other = F.struct(F.lit("x").alias("value"), F.lit(1).cast("bigint").alias("count"))
    stored = (
        F.when(F.col("event_id") % 3 == 0, text.encode_top_list(F.array(entry, other)))
        .when(F.col("event_id") % 3 == 1, F.lit("{broken"))
        .otherwise(F.lit('"text"'))
    )
    decoded = derived.events(spark, sf).select("event_id", text.decode_top_list(stored).alias("top"))
    line = F.transform("top", lambda e: F.concat_ws(":", e["value"], e["count"].cast("string")))
    return decoded.select("event_id", F.size("top").alias("entries"), F.array_join(line, ",").alias("listed"))


@query("a12_domains_json", CERTS + " SELECT fingerprint, array_to_string(domains, '|') AS domains FROM certs")
def _(spark, sf):
    c = derived.certs(spark, sf).select("fingerprint", text.encode_domains(F.col("domains")).alias("stored"))
    return c.select("fingerprint", F.array_join(text.decode_domains(F.col("stored")), "|").alias("domains"))


@query("a13_lookup", COPIED + f""" SELECT {FLAT} FROM certs WHERE fingerprint = md5('3')
  ORDER BY created_at DESC, cert_index LIMIT 1""")
def _(spark, sf):
    return flat(search.lookup(derived.copied_certs(spark, sf), "eccbc87e4b5ce2fe28308fd9f2a7baf3"))


@query("a13_lookup_many", COPIED + f""", wanted AS (SELECT DISTINCT md5(cast(user_id AS varchar)) AS fingerprint FROM events)
  SELECT {FLAT} FROM certs SEMI JOIN wanted USING (fingerprint)
  QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY created_at DESC, seen_at DESC, cert_index) = 1""")
def _(spark, sf):
    wanted = derived.events(spark, sf).select(F.md5(F.col("user_id").cast("string")).alias("fingerprint")).distinct()
    return flat(search.lookup_many(derived.copied_certs(spark, sf), wanted))


@query("a14_read_stats", CERTS + f""" SELECT seen_at - seen_at % 3600 AS period_start, {BASICS}, 1 AS computed_at FROM certs
  WHERE seen_at >= {JAN_10} AND seen_at < {JAN_15} GROUP BY 1 ORDER BY 1""")
def _(spark, sf):
    return tables.read_stats(period_rows(derived.certs(spark, sf), periods.HOUR, 1), JAN_10, JAN_15)


# --- Field functions -------------------------------------------------------------------------


@query("b1_normalize_fingerprint", "SELECT event_id, md5(cast(event_id AS varchar)) AS fingerprint FROM events")
def _(spark, sf):
    raw = F.upper(F.regexp_replace("fingerprint", "(..)(?=.)", "$1:"))
    return derived.certs(spark, sf).select(
        F.col("cert_index").alias("event_id"), text.normalize_fingerprint(raw).alias("fingerprint")
    )


@query("b2_clean_domains", CERTS + " SELECT fingerprint, array_to_string(domains, '|') AS domains, domain_count AS n FROM certs")
def _(spark, sf):
    dirty = F.concat(F.array(F.lit(""), F.lit(None).cast("string")), "domains", F.array(F.lit("")))
    c = derived.certs(spark, sf).select("fingerprint", text.clean_domains(dirty).alias("clean"))
    return c.select("fingerprint", F.array_join("clean", "|").alias("domains"), F.size("clean").alias("n"))


@query("b3_empty_to_null", CERTS + " SELECT fingerprint, issuer_org, subject_cn FROM certs")
def _(spark, sf):
    return derived.certs(spark, sf).select(
        "fingerprint",
        *[text.empty_to_null(F.coalesce(c, F.lit(""))).alias(c) for c in ("issuer_org", "subject_cn")],
    )


@query("b4_seen_at", f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN {NOW} ELSE epoch_us(ts) // 1000000 END AS seen_at
  FROM events""")
def _(spark, sf):
    c = derived.certs(spark, sf)
    raw = F.when(F.col("cert_index") % 11 != 0, F.col("seen_at") + F.lit(0.75))
    return c.select(F.col("cert_index").alias("event_id"), times.seen_at(raw, NOW).alias("seen_at"))


@query("b5_domain_count", CERTS + " SELECT fingerprint, domain_count FROM certs")
def _(spark, sf):
    return derived.certs(spark, sf).select("fingerprint", text.domain_count(F.col("domains")).alias("domain_count"))


@query("b6_glob_match", CERTS + """, names AS (SELECT cert_index, unnest(domains) AS domain FROM certs)
  SELECT cert_index, domain, domain ILIKE '%.u1_.NET' AS one, domain ILIKE '%.co.uk' OR domain ILIKE 'click%' AS two FROM names""")
def _(spark, sf):
    names = derived.certs(spark, sf).select("cert_index", F.explode("domains").alias("domain"))
    d = F.col("domain")
    return names.select(
        "cert_index",
        "domain",
        text.glob_match(d, "*.u1?.NET").alias("one"),
        text.glob_match(d, "*.co.uk", "click*").alias("two"),
    )


@query("b7_issuer_contains_any", CERTS + """ SELECT cert_index,
  coalesce(issuer_org ILIKE '%click%' OR issuer_org ILIKE '%ca err%', false) AS hit FROM certs""")
def _(spark, sf):
    hit = text.issuer_contains_any(F.col("issuer_org"), ["CLICK", "ca Err"])
    return derived.certs(spark, sf).select("cert_index", hit.alias("hit"))


@query("b8_ingest_filter", CERTS + f""" SELECT {FLAT} FROM certs WHERE
  len(list_filter(domains, lambda d: d ILIKE '%.github.io' OR d ILIKE '%.u1_.co.uk')) > 0 OR issuer_org ILIKE '%view%'""")
def _(spark, sf):
    return flat(ingest_filter(derived.certs(spark, sf), ["*.GITHUB.io", "*.u1?.co.uk"], ["View"]))


HIT = """hit AS (SELECT fingerprint FROM (SELECT fingerprint, unnest(domains) AS d FROM certs)
    JOIN (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0) ON d = 'a.b.u' || user_id || '.net')"""
HIT_SQL = """(fingerprint IN (SELECT fingerprint FROM hit) OR issuer_org ILIKE '%view%'
    OR len(list_filter(domains, lambda d: d ILIKE '%.github.io' OR d ILIKE '%.u1_.co.uk')) > 0)"""


@query("b8_filter_table", f"{CERTS}, {HIT} SELECT {FLAT} FROM certs WHERE {HIT_SQL}")
def _(spark, sf):
    return flat(filter_by_patterns(derived.certs(spark, sf), pattern_table(spark, sf)))


def pattern_table(spark, sf):
    """The patterns of `b8_ingest_filter` and one for every third user, as a table."""
    users = derived.events(spark, sf).filter(F.col("user_id") % 3 == 0).select("user_id").distinct()
    own = users.select(F.lit("domain").alias("kind"), F.concat(F.lit("*.U"), F.col("user_id").cast("string"), F.lit(".net")).alias("pattern"))
    fixed = spark.createDataFrame([("domain", "*.GITHUB.io"), ("domain", "*.u1?.co.uk"), ("issuer", "View")], own.schema)
    return own.unionByName(fixed)


# --- Views of a row --------------------------------------------------------------------------

MIN = "strftime(make_timestamp({} * 1000000), '%Y-%m-%d %H:%M')"
CUT = "CASE WHEN len({0}) > {1} THEN left({0}, {1}) || '...' ELSE {0} END"


@query("b23_display_row", CERTS + f""" SELECT fingerprint, {CUT.format("coalesce(domains[1], '')", 50)} AS domain,
  CASE WHEN domain_count > 1 THEN '+' || (domain_count - 1) ELSE '' END AS more,
  {CUT.format("coalesce(issuer_org, issuer_cn, '-')", 30)} AS issuer, {MIN.format('not_before')} AS not_before,
  {MIN.format('not_after')} AS not_after, {MIN.format('seen_at')} AS seen_at FROM certs""")
def _(spark, sf):
    return present.display_row(derived.certs(spark, sf))


@query("b23_long_names", f"""WITH p AS (SELECT page_id, url AS d FROM pages) SELECT cast(page_id AS varchar) AS fingerprint,
  {CUT.format('d', 60)} AS domain, '' AS more, {CUT.format('d', 30)} AS issuer,
  {MIN.format('page_id')} AS seen_at FROM p""")
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = pages.select(
        F.col("page_id").cast("string").alias("fingerprint"),
        F.array("url").alias("domains"),
        F.lit(1).alias("domain_count"),
        F.lit(None).cast("string").alias("subject_cn"),
        F.lit(None).cast("string").alias("issuer_org"),
        F.col("url").alias("issuer_cn"),
        F.col("page_id").alias("seen_at"),
    )
    return present.feed_row(rows)


SEC = "strftime(make_timestamp({} * 1000000), '%Y-%m-%d %H:%M:%S UTC')"


@query("b24_detail_row", CERTS + f""" SELECT coalesce(subject_cn, domains[1], 'Unknown') AS title, fingerprint, subject_cn, issuer_org,
  issuer_cn, serial_number, {SEC.format('not_before')} AS not_before, {SEC.format('not_after')} AS not_after,
  {SEC.format('seen_at')} AS seen_at, log_name, log_url, cert_index, cert_link, domain_count,
  array_to_string(domains, '|') AS domains FROM certs""")
def _(spark, sf):
    return present.detail_row(derived.certs(spark, sf)).withColumn("domains", F.array_join("domains", "|"))


@query("b25_buckets", CERTS + f""" SELECT cert_index, seen_at - seen_at % 3600 AS hour, seen_at - seen_at % 86400 AS day,
  (seen_at - {JAN_15}) // 3600 - CASE WHEN seen_at < {JAN_15} AND (seen_at - {JAN_15}) % 3600 <> 0 AND
   (seen_at - {JAN_15}) // 3600 * 3600 > seen_at - {JAN_15} THEN 1 ELSE 0 END AS hours_from_origin FROM certs""")
def _(spark, sf):
    s = F.col("seen_at")
    return derived.certs(spark, sf).select(
        "cert_index",
        times.hour_bucket(s).alias("hour"),
        times.day_bucket(s).alias("day"),
        times.bucket_index(s, 3600, JAN_15).alias("hours_from_origin"),
    )


# --- Pages and orders ------------------------------------------------------------------------

GITHUB = SearchSpec([[Term("github"), Term("error", "issuer", negate=True)]])
GITHUB_SQL = """(len(list_filter(domains, lambda d: contains(d, 'github'))) > 0 OR contains(coalesce(issuer_org, ''), 'github')
  OR contains(coalesce(subject_cn, ''), 'github')) AND NOT contains(coalesce(issuer_org, ''), 'error')"""
NEWEST = "ORDER BY seen_at DESC, fingerprint DESC"


@query("f1_recent", f"{CERTS} SELECT {FLAT} FROM certs {NEWEST} LIMIT 100")
def _(spark, sf):
    return flat(search.recent(derived.certs(spark, sf), 100))


@query("f2_page", f"{CERTS} SELECT {FLAT} FROM certs WHERE {GITHUB_SQL} {NEWEST} LIMIT 50 OFFSET 100")
def _(spark, sf):
    return flat(search.page(derived.certs(spark, sf), GITHUB, 3, 50))


@query("f3_page_after", f"""{CERTS} SELECT {FLAT} FROM certs WHERE {GITHUB_SQL}
  AND (seen_at < {JAN_15} OR (seen_at = {JAN_15} AND fingerprint < 'b')) {NEWEST} LIMIT 50""")
def _(spark, sf):
    return flat(search.page_after(derived.certs(spark, sf), GITHUB, f"{JAN_15}:b", 50))


@query("f4_first_page", f"{CERTS} SELECT {FLAT} FROM certs WHERE {GITHUB_SQL} {NEWEST} LIMIT 51")
def _(spark, sf):
    return flat(search.first_page(derived.certs(spark, sf), GITHUB, 50))


@query("f4_page_with_total", f"""{CERTS}, m AS (SELECT count(*) AS n FROM certs WHERE {GITHUB_SQL})
  SELECT n AS total, cast(ceil(n / 50) AS bigint) AS total_pages, least(n, 50) AS shown FROM m""")
def _(spark, sf):
    """Page one with its total, which is counted only where there is more than a page."""
    page = search.fetch_page(derived.certs(spark, sf), GITHUB, 1, 50)
    values = {"total": page.total, "total_pages": page.total_pages, "shown": len(page.rows)}
    return spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in values.items()])


@query("f6_export_order", f"{CERTS} SELECT {FLAT} FROM certs ORDER BY seen_at, fingerprint")
def _(spark, sf):
    return flat(search.export_order(derived.certs(spark, sf)))


@query("f7_top_100", CERTS + """, n AS (SELECT unnest(domains) AS d FROM certs), c AS (SELECT d, count(*) AS n FROM n GROUP BY 1)
  SELECT row_number() OVER (ORDER BY n DESC, d) AS rank, d AS value, n AS count FROM c ORDER BY n DESC, d LIMIT 100""")
def _(spark, sf):
    from certloom.operators.domains import domain_counts

    counts = domain_counts(derived.certs(spark, sf)).withColumn("list", F.lit("all"))
    return periods.top_k(counts, ["list"], "domain").drop("list")


@query("f8_stats_order", CERTS + f" SELECT seen_at - seen_at % 86400 AS period_start, {BASICS}, 1 AS computed_at FROM certs GROUP BY 1 ORDER BY 1")
def _(spark, sf):
    return tables.read_stats(period_rows(derived.certs(spark, sf), periods.DAY, 1), 0, NOW)


@query("g4_dedupe_union", COPIED + f""", both_ AS (SELECT *, 0 AS s FROM certs WHERE seen_at < {JAN_15}
  UNION ALL SELECT *, 1 FROM certs WHERE seen_at >= {JAN_10})
  SELECT {FLAT} FROM both_ QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY s, seen_at, log_url, cert_index) = 1""")
def _(spark, sf):
    c = derived.copied_certs(spark, sf)
    return flat(tables.dedupe_union(c.filter(F.col("seen_at") < JAN_15), c.filter(F.col("seen_at") >= JAN_10)))
