"""Checked queries: streams over the same files, each compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from certloom.operators import periods, tables
from certloom.plans import derived
from certloom.plans.ingest_queries import HIT, HIT_SQL, NEWEST, NOW, pattern_table
from certloom.plans.registry import CERTS, COPIED, FLAT, flat, query
from certloom.plans.search_queries import MATCHES, SPEC, SPEC_SQL
from certloom.plans.stats_queries import GLOBS, HOUR, ISSUERS, KEPT, NAMED, RECEIVED, REG, period
from certloom.operators.searches import parse_searches
from certloom.session import scratch_dir
from certloom.sources.suffixes import seed_rules
from certloom.streaming import ingest


def finish(stream_query) -> None:
    """Wait for a bounded run and raise its error, if any."""
    stream_query.awaitTermination()


def run_ingest(spark, sf, shares=4, batch=None, copies=1, runs=1, globs=(), substrings=(), patterns=None):
    """Ingest all messages from files, `batch` of their shares at a time; `runs` > 1 sends all of them again, as after a
    lost checkpoint."""
    messages = scratch_dir(spark, "messages")
    files = derived.message_files(spark, sf, messages, shares, copies)
    table, counters = scratch_dir(spark, "table"), []
    for _ in range(runs):
        counters.append(scratch_dir(spark, "counters"))
        finish(
            ingest.ingest_stream(
                ingest.read_message_files(spark, messages, batch and batch * files),
                table,
                counters[-1],
                scratch_dir(spark, "checkpoint"),
                NOW,
                globs,
                substrings,
                once=True,
                patterns=patterns,
            )
        )
    return table, counters


@query("h1_ingest_stream", f"""{CERTS}, {RECEIVED}
  SELECT {FLAT.replace('created_at', f'{NOW} AS created_at')} FROM received WHERE {KEPT}""")
def _(spark, sf):
    table, _ = run_ingest(spark, sf, globs=GLOBS, substrings=ISSUERS)
    return flat(tables.read_certificates(spark, table))


@query("h1_pattern_table", f"""{CERTS}, {RECEIVED}, {HIT}
  SELECT {FLAT.replace('created_at', f'{NOW} AS created_at')} FROM received WHERE {HIT_SQL}""")
def _(spark, sf):
    """Ingest filtered by a table of patterns, prepared once."""
    table, _ = run_ingest(spark, sf, batch=2, patterns=pattern_table(spark, sf))
    return flat(tables.read_certificates(spark, table))


@query("h2_micro_batches", f"{CERTS}, {RECEIVED} SELECT count(*) AS received, 4 AS batches FROM received")
def _(spark, sf):
    """One share of the files per micro-batch."""
    _, counters = run_ingest(spark, sf, shares=4, batch=1)
    return ingest.read_counters(spark, counters[0]).select("received", "batches")


@query("h3_stream_dedupe", f"{COPIED} SELECT DISTINCT fingerprint FROM certs")
def _(spark, sf):
    out = scratch_dir(spark, "deduped")
    once = ingest.dedupe_stream(derived.cert_stream(spark, sf, copies=2), "40 days").select("fingerprint")
    finish(ingest.to_table(once, out, scratch_dir(spark, "checkpoint"), once=True))
    return spark.read.schema("fingerprint string").parquet(out)


@query("h4_rolling_insert_rate", f"""{CERTS}, w AS (SELECT seen_at - seen_at % 5 - 5 * unnest(range(0, 12)) + 60 AS window_end FROM certs),
  n AS (SELECT window_end, count(*) AS total FROM w GROUP BY 1)
  SELECT window_end, total, floor(total / 60.0::double * 10 + 0.5) / 10.0::double AS rate FROM n
  WHERE window_end <= (SELECT max(seen_at) FROM certs) - 60""")
def _(spark, sf):
    out = scratch_dir(spark, "rate")
    rates = ingest.rolling_insert_rate(derived.cert_stream(spark, sf), "60 seconds")
    finish(ingest.to_table(rates, out, scratch_dir(spark, "checkpoint"), once=True))
    return spark.read.schema(rates.schema).parquet(out)


@query("h5_replay", f"""{COPIED}, {RECEIVED} SELECT (SELECT count(DISTINCT fingerprint) FROM received) AS table_rows,
  (SELECT count(DISTINCT fingerprint) FROM received) AS first_inserted, 0 AS second_inserted""")
def _(spark, sf):
    """All messages delivered a second time add nothing."""
    table, counters = run_ingest(spark, sf, copies=2, runs=2)
    first, second = (ingest.read_counters(spark, c).select("inserted").scalar() for c in counters)
    rows = tables.read_certificates(spark, table).agg(F.count(F.lit(1)).alias("table_rows"))
    return rows.select("table_rows", first.alias("first_inserted"), second.alias("second_inserted"))


@query("h6_rate_limit", f"{CERTS}, {RECEIVED} SELECT count(*) AS received, 5 AS batches, true AS bounded FROM received")
def _(spark, sf):
    """With two of ten shares per micro-batch all messages arrive, in five batches of about equal size."""
    messages, counters = scratch_dir(spark, "messages"), scratch_dir(spark, "counters")
    files = derived.message_files(spark, sf, messages, 10)
    finish(
        ingest.ingest_stream(
            ingest.read_message_files(spark, messages, 2 * files),
            scratch_dir(spark, "table"),
            counters,
            scratch_dir(spark, "checkpoint"),
            NOW,
            once=True,
        )
    )
    rows = spark.read.schema(ingest.COUNTERS).parquet(counters)
    total = F.sum("received")
    return rows.agg(
        total.alias("received"), F.sum("batches").alias("batches"), (F.max("received") <= total / 4 + 20).alias("bounded")
    )


@query("h7_live_feed", f"{CERTS} SELECT {FLAT} FROM certs {NEWEST} LIMIT 25")
def _(spark, sf):
    feed = scratch_dir(spark, "feed")
    finish(ingest.live_feed(derived.cert_stream(spark, sf), feed, scratch_dir(spark, "checkpoint"), once=True))
    return flat(ingest.read_feed(spark, feed))


@query("h8_running_counters", f"""{COPIED}, {RECEIVED}, kept AS (SELECT * FROM received WHERE {KEPT})
  SELECT (SELECT count(*) FROM received) AS received, (SELECT count(*) FROM received) - (SELECT count(*) FROM kept) AS filtered,
   (SELECT count(DISTINCT fingerprint) FROM kept) AS inserted,
   (SELECT count(*) - count(DISTINCT fingerprint) FROM kept) AS duplicate""")
def _(spark, sf):
    _, counters = run_ingest(spark, sf, shares=3, batch=1, copies=2, globs=GLOBS, substrings=ISSUERS)
    return ingest.read_counters(spark, counters[0]).drop("batches")


@query("h8_restart", f"""{COPIED}, {RECEIVED}, kept AS (SELECT * FROM received WHERE {KEPT})
  SELECT 2 * (SELECT count(*) FROM received) AS received, 2 * ((SELECT count(*) FROM received) - (SELECT count(*) FROM kept)) AS filtered,
   (SELECT count(DISTINCT fingerprint) FROM kept) AS inserted,
   (SELECT 2 * count(*) - count(DISTINCT fingerprint) FROM kept) AS duplicate""")
def _(spark, sf):
    """A second run with a new checkpoint adds to the counters of the first one in the same folder."""
    messages = scratch_dir(spark, "messages")
    derived.message_files(spark, sf, messages, 3, copies=2)
    table, counters = scratch_dir(spark, "table"), scratch_dir(spark, "counters")
    for _ in range(2):
        source = ingest.read_message_files(spark, messages)
        checkpoint = scratch_dir(spark, "checkpoint")
        finish(ingest.ingest_stream(source, table, counters, checkpoint, NOW, GLOBS, ISSUERS, once=True))
    return ingest.read_counters(spark, counters).drop("batches")


@query("h9_tumbling_stats", f"""{CERTS} SELECT seen_at - seen_at % 3600 AS period_start, count(*) AS total_certificates,
  sum(domain_count) AS total_domain_count, count(*) FILTER (len(list_filter(domains, lambda d: d LIKE '*.%')) > 0) AS wildcard_count,
  count(DISTINCT issuer_org) AS approx_issuers FROM certs GROUP BY 1
  HAVING period_start + 3600 <= (SELECT max(seen_at) FROM certs) - 600""")
def _(spark, sf):
    out = scratch_dir(spark, "hours")
    hours = ingest.tumbling_stats(derived.cert_stream(spark, sf), "1 hour", "10 minutes")
    finish(ingest.to_table(hours, out, scratch_dir(spark, "checkpoint"), once=True))
    return spark.read.schema(hours.schema).parquet(out)


@query("h9_unique_domains", f"""{REG}, n AS (SELECT {period(HOUR)}, count(DISTINCT registrable) AS domains FROM {NAMED} GROUP BY 1),
  t AS (SELECT {period(HOUR)}, count(*) AS total_certificates, sum(domain_count) AS total_domain_count FROM certs GROUP BY 1)
  SELECT *, true AS domains_close FROM t JOIN n USING (period_start) WHERE period_start + 3600 <= (SELECT max(seen_at) FROM certs) - 600""")
def _(spark, sf):
    """Distinct registrable domains of the stream's closed hours, held against the exact counts (three percent)."""
    out, rules = scratch_dir(spark, "hours"), seed_rules(spark)
    hours = ingest.tumbling_stats(derived.cert_stream(spark, sf), "1 hour", "10 minutes", rules)
    finish(ingest.to_table(hours, out, scratch_dir(spark, "checkpoint"), once=True))
    exact = periods.unique_domains(derived.certs(spark, sf), HOUR, rules).withColumnRenamed("unique_domains", "domains")
    found = spark.read.schema(hours.schema).parquet(out).join(exact, "period_start")
    close = F.abs(F.col("approx_domains") - F.col("domains")) <= F.greatest(F.lit(1.0), F.col("domains") * 0.03)
    return found.select("period_start", "total_certificates", "total_domain_count", "domains", close.alias("domains_close"))


@query("h10_changed_searches", f"{CERTS}, {MATCHES} SELECT * FROM matches")
def _(spark, sf):
    """Searches kept as versions: the stream takes the newest one, of which every second search was there before."""
    out, path = scratch_dir(spark, "alerts"), scratch_dir(spark, "searches")
    every = derived.saved_searches(spark, sf)
    ingest.save_searches(spark, path, every.filter(F.col("search_id") % 2 == 0))
    kept = ingest.StoredSearches(path)
    kept.newest(spark)
    ingest.save_searches(spark, path, every)
    finish(ingest.search_alerts(derived.cert_stream(spark, sf), kept, out, scratch_dir(spark, "checkpoint"), once=True))
    return ingest.read_alerts(spark, out)


@query("h10_search_alerts", f"{CERTS}, {MATCHES} SELECT * FROM matches")
def _(spark, sf):
    out = scratch_dir(spark, "alerts")
    parsed = parse_searches(derived.saved_searches(spark, sf))
    finish(ingest.search_alerts(derived.cert_stream(spark, sf), parsed, out, scratch_dir(spark, "checkpoint"), once=True))
    return ingest.read_alerts(spark, out)


@query("h10_spec_alerts", f"{CERTS} SELECT cert_index FROM certs WHERE {SPEC_SQL}")
def _(spark, sf):
    out = scratch_dir(spark, "alerts")
    hits = ingest.spec_alerts(derived.cert_stream(spark, sf), SPEC).select("cert_index")
    finish(ingest.to_table(hits, out, scratch_dir(spark, "checkpoint"), once=True))
    return spark.read.schema("cert_index bigint").parquet(out)
