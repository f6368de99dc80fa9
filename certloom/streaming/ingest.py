"""Streaming ingest: messages to the certificate table, counters, live feed and alerts.

The checkpoint replaces a write queue: a failed micro-batch is run again before newer data, and
inserting it twice adds nothing. Batch size and back-pressure are options of the source
(`maxFilesPerTrigger`, `maxOffsetsPerTrigger`) and of the trigger.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from certloom import schemas
from certloom.files import delete_path, folder_names, move
from certloom.functions.hosts import has_wildcard
from certloom.functions.predicates import SearchSpec, match_spec
from certloom.operators import search, tables
from certloom.operators.domains import registrable_domain
from certloom.operators.filters import index_patterns, matching_fingerprints
from certloom.operators.searches import SearchIndex, index_searches, match_index, parse_searches, update_index
from certloom.sources.messages import ingest_predicate, parse_messages, to_certificates
from certloom.sources.suffixes import SuffixRules

# Batch interval, and lines of the live feed.
BATCH_INTERVAL = "3 seconds"
FEED_ROWS = 25

COUNTERS = T.StructType(
    [T.StructField("batch_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("received", "filtered", "inserted", "duplicate", "batches")]
)


def read_message_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of JSON text lines; Kafka and other sources deliver the same `value` column."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def certificate_stream(messages: DataFrame, now: Column | int, globs=(), substrings=()) -> DataFrame:
    """Parsed and filtered certificates of a message stream, in table form."""
    return to_certificates(parse_messages(messages, now=now).filter(ingest_predicate(globs, substrings)), now)


def dedupe_stream(certs: DataFrame, delay: str) -> DataFrame:
    """Drop a fingerprint seen again within `delay` of event time."""
    timed = certs.withColumn("seen_time", F.timestamp_seconds("seen_at"))
    return timed.withWatermark("seen_time", delay).dropDuplicatesWithinWatermark(["fingerprint"]).drop("seen_time")


def _start(
    stream: DataFrame,
    checkpoint: str,
    each: Callable[[DataFrame, int, str], None],
    once: bool,
    interval: str = BATCH_INTERVAL,
) -> StreamingQuery:
    """Start `each(batch, batch_id, run)`; `run` is the id that the checkpoint gives to all its restarts.

    Batch ids start again with a new checkpoint, so whatever a batch writes is named by both.
    """
    known = threading.Event()
    run: list[str] = []

    def call(batch: DataFrame, batch_id: int) -> None:
        known.wait()
        each(batch, batch_id, run[0])

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(call)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
    run.append(str(query.id))
    known.set()
    return query


def ingest_stream(
    messages: DataFrame,
    table_path: str,
    counters_path: str,
    checkpoint: str,
    now: int | Column,
    globs=(),
    substrings=(),
    once: bool = False,
    interval: str = BATCH_INTERVAL,
    patterns: DataFrame | None = None,
) -> StreamingQuery:
    """Parse, filter and insert a message stream; every micro-batch also leaves one row of counters.

    The filter is two lists, or a table of patterns (`filters`) of any length, prepared once. A micro-batch opens only
    the parts of the fingerprint runs that may hold one of its own (`tables.append_new`). Rows that a failed batch
    had inserted still count as inserted when it is repeated.
    """
    if patterns is not None and (globs or substrings):
        raise ValueError("either lists or a table of patterns")
    keep = ingest_predicate(globs, substrings)
    index = None if patterns is None else index_patterns(patterns)

    def each(batch: DataFrame, batch_id: int, run: str) -> None:
        spark = batch.sparkSession
        parsed = parse_messages(batch, now=now)
        if index is not None:
            # A row is kept or dropped with all of its fingerprint.
            parsed = parsed.persist()
            hits = matching_fingerprints(parsed, index).withColumn("_hit", F.lit(True))
            marked = parsed.join(hits, "fingerprint", "left").withColumn("_keep", F.col("_hit").isNotNull()).drop("_hit").persist()
        else:
            marked = parsed.withColumn("_keep", keep).persist()
        try:
            seen = marked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.count_if("_keep"), F.lit(0)).alias("kept")).first()
            kept = to_certificates(marked.filter("_keep").drop("_keep"), now)
            inserted = tables.append_new(spark, table_path, kept, tag=f"{run}-{batch_id}") if seen["kept"] else 0
            row = (
                batch_id,
                seen["n"],
                seen["n"] - seen["kept"],
                inserted,
                seen["kept"] - inserted,
                1 if seen["kept"] else 0,
            )
            # One folder per run and batch, so that a repeated batch replaces its row.
            target = f"{counters_path}/run={run}/batch={batch_id}"
            spark.createDataFrame([row], COUNTERS).write.mode("overwrite").parquet(target)
        finally:
            marked.unpersist()
            parsed.unpersist()

    return _start(messages, checkpoint, each, once, interval)


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Running totals of the ingest counters, over all runs."""
    rows = spark.read.schema(COUNTERS).parquet(path)
    return rows.agg(*[F.sum(c).alias(c) for c in COUNTERS.fieldNames()[1:]])


def _feed_versions(spark: SparkSession, feed_path: str) -> list[tuple[int, str, int]]:
    """(version, run, batch) of the feed's folders, oldest first."""
    names = [n for n in tables.folder_names(spark, feed_path) if n.startswith("version=")]
    parts = [n.removeprefix("version=").split("_") for n in names]
    return sorted((int(version), run, int(batch)) for version, run, batch in parts)


def _feed_folder(feed_path: str, version: tuple[int, str, int]) -> str:
    return f"{feed_path}/version=" + "_".join(map(str, version))


def live_feed(certs: DataFrame, feed_path: str, checkpoint: str, n: int = FEED_ROWS, once: bool = False) -> StreamingQuery:
    """Keep the `n` newest log entries; each micro-batch writes the next version of a tiny table.

    A run with a new checkpoint goes on from the last version of the run before. An entry that
    is delivered again is shown once.
    """
    entry = ["fingerprint", "seen_at", "log_url", "cert_index"]

    def each(batch: DataFrame, batch_id: int, run: str) -> None:
        spark = batch.sparkSession
        there = _feed_versions(spark, feed_path)
        # Versions rise by one per batch of a run, and a repeated batch has the version it had before.
        start = next((v - b for v, r, b in there if r == run), there[-1][0] + 1 - batch_id if there else 0)
        version = start + batch_id
        newest = batch.select(*schemas.CERTIFICATE_COLUMNS)
        for before in [v for v in there if v[0] < version][-1:]:
            newest = newest.unionByName(spark.read.schema(schemas.CERTIFICATE).parquet(_feed_folder(feed_path, before)))
        written = search.recent(newest.dropDuplicates(entry), n)
        written.write.mode("overwrite").parquet(_feed_folder(feed_path, (version, run, batch_id)))
        # The version before stays until the next batch, as the start of a repeated one.
        for old in [v for v in there if v[0] < version - 1]:
            delete_path(spark, _feed_folder(feed_path, old))

    return _start(certs, checkpoint, each, once)


def read_feed(spark: SparkSession, feed_path: str) -> DataFrame:
    """The newest version of the feed."""
    newest = _feed_versions(spark, feed_path)[-1]
    return spark.read.schema(schemas.CERTIFICATE).parquet(_feed_folder(feed_path, newest))


def spec_alerts(certs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Certificates of a stream that match one search."""
    return certs.filter(match_spec(spec))


def save_searches(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Store `(search_id, text)` as the next version of the saved searches at `path`, and return its number.

    A version appears as a whole; the ones before stay for streams that still compare with them.
    """
    version = max(_search_versions(spark, path), default=0) + 1
    staged = f"{path}/_staged-{version}"
    delete_path(spark, staged)
    rows.select(F.col("search_id").cast("long").alias("search_id"), F.col("text").cast("string").alias("text")).write.parquet(staged)
    move(spark, staged, f"{path}/version={version}")
    return version


def _search_versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removeprefix("version=")) for n in folder_names(spark, path) if n.startswith("version=")]


class StoredSearches:
    """The newest version of a table of saved searches as an index; only new and removed searches are worked on."""

    def __init__(self, path: str):
        self.path = path
        self.version = 0
        self.index: SearchIndex | None = None

    def _read(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.schema("search_id bigint, text string").parquet(f"{self.path}/version={version}")

    def newest(self, spark: SparkSession) -> SearchIndex:
        """Lists the versions; the index stays as it is while there is no newer one."""
        version = max(_search_versions(spark, self.path), default=0)
        if self.index is None or version != self.version:
            now = self._read(spark, version)
            if self.index is None:
                self.index = index_searches(parse_searches(now))
            else:
                before, same = self._read(spark, self.version), ["search_id", "text"]
                added, removed = now.join(before, same, "left_anti"), before.join(now, same, "left_anti")
                self.index = update_index(self.index, parse_searches(added), removed.select("search_id"))
            self.version = version
        return self.index


def search_alerts(certs: DataFrame, searches: DataFrame | StoredSearches, out_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """`(search_id, fingerprint)` of saved searches, written once per micro-batch.

    `searches` are parsed searches, which stay as they are, or those of a table kept by `save_searches`: every
    micro-batch then takes its newest version.
    """
    fixed = None if isinstance(searches, StoredSearches) else index_searches(searches)

    def each(batch: DataFrame, batch_id: int, run: str) -> None:
        index = fixed or searches.newest(batch.sparkSession)
        match_index(batch, index).write.mode("overwrite").parquet(f"{out_path}/run={run}/batch={batch_id}")

    return _start(certs, checkpoint, each, once)


def read_alerts(spark: SparkSession, out_path: str) -> DataFrame:
    """The alerts of all runs; what was delivered again is alerted once."""
    return spark.read.schema("search_id bigint, fingerprint string").parquet(out_path).select("search_id", "fingerprint").distinct()


def tumbling_stats(certs: DataFrame, length: str, delay: str, rules: SuffixRules | None = None) -> DataFrame:
    """Statistics of closed periods; distinct issuers come from a sketch, which a stream can keep, and so do distinct
    registrable domains where the suffix rules are given."""
    timed = certs.withColumn("seen_time", F.timestamp_seconds("seen_at")).withWatermark("seen_time", delay)
    wild = has_wildcard(F.col("domains")).alias("wild")
    columns = ["seen_time", "domain_count", "issuer_org", wild]
    if rules is None:
        rows, first, domains = timed.select(*columns), F.lit(True), []
    else:
        named = timed.select(*columns, F.posexplode_outer("domains").alias("pos", "domain"))
        # A certificate counts once, with its first name.
        rows, first = registrable_domain(named, "domain", rules), F.coalesce(F.col("pos"), F.lit(0)) == 0
        domains = [F.hll_sketch_estimate(F.hll_sketch_agg("registrable")).alias("approx_domains")]
    names = ["total_certificates", "total_domain_count", "wildcard_count", "approx_issuers", *(["approx_domains"] if domains else [])]
    return (
        rows.groupBy(F.window("seen_time", length))
        .agg(
            F.count_if(first).alias("total_certificates"),
            F.sum(F.when(first, F.col("domain_count"))).alias("total_domain_count"),
            F.count_if(first & F.col("wild")).alias("wildcard_count"),
            F.hll_sketch_estimate(F.hll_sketch_agg("issuer_org")).alias("approx_issuers"),
            *domains,
        )
        .select(F.unix_seconds("window.start").alias("period_start"), *names)
    )


def rolling_insert_rate(certs: DataFrame, delay: str, slide: str = "5 seconds") -> DataFrame:
    """Rows per second of the trailing minute, every `slide`, which must divide a minute.

    Rows are counted per slide first; only those counts are spread over the windows that hold them.
    """
    timed = certs.withColumn("seen_time", F.timestamp_seconds("seen_at")).withWatermark("seen_time", delay)
    counts = timed.groupBy(F.window("seen_time", slide)).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.groupBy(F.window(F.window_time("window"), "60 seconds", slide))
        .agg(F.sum("n").alias("total"))
        .select(
            F.unix_seconds("window.end").alias("window_end"),
            "total",
            (F.floor(F.col("total") / F.lit(60.0) * 10 + 0.5) / F.lit(10.0)).alias("rate"),
        )
    )


def to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream's finished rows to a Parquet folder."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=BATCH_INTERVAL)).start(path)
