"""Certificate inputs derived from the `events` table, for checks and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom import schemas
from certloom.functions import times
from certloom.session import ensure_utc


def _seconds(ts: Column) -> Column:
    """Whole UTC seconds of a zoneless timestamp."""
    day = F.unix_date(F.to_date(ts)).cast("long") * times.DAY
    return day + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensure_utc(spark).read.parquet(f"{sf_dir}/events.parquet")


def certs_of(ev: DataFrame, copies: int = 1) -> DataFrame:
    """One certificate per event; `copies` neighbours share a fingerprint."""
    k = F.col("k")
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    names = (
        F.when(
            k % 4 == 0,
            F.array(F.concat(F.lit("www.u"), user, F.lit(".co.uk")), F.concat(F.lit("*.u"), user, F.lit(".co.uk"))),
        )
        .when(k % 4 == 1, F.array(F.concat(kind, F.lit(".u"), user, F.lit(".example.com"))))
        .when(
            k % 4 == 2,
            F.array(
                F.concat(F.lit("u"), user, F.lit(".github.io")),
                F.concat(F.lit("a.b.u"), user, F.lit(".net")),
                F.lit("github.io"),
            ),
        )
        .otherwise(F.array(F.concat(F.lit("*."), kind, k.cast("string"), F.lit(".org"))))
    )
    key = F.col("event_id") if copies == 1 else F.call_function("div", F.col("event_id"), F.lit(copies))
    base = ev.select(
        "*",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        _seconds(F.col("ts")).alias("seen_at"),
    ).select("*", names.alias("domains"))
    log_url = F.concat(F.lit("https://log"), (F.col("user_id") % 5).cast("string"), F.lit(".example/"))
    return base.select(
        F.md5(key.cast("string")).alias("fingerprint"),
        "domains",
        F.size("domains").alias("domain_count"),
        F.when(k % 10 != 0, F.concat(F.lit("CA "), kind)).alias("issuer_org"),
        F.when(k % 10 != 0, F.concat(F.lit("CA "), kind, F.lit(" R"), (k % 3).cast("string"))).alias("issuer_cn"),
        F.when(k % 7 != 0, F.get("domains", F.lit(0))).alias("subject_cn"),
        (F.col("seen_at") - 3600 * (k % 24)).alias("not_before"),
        (F.col("seen_at") - 3600 * (k % 24) + 7776000).alias("not_after"),
        F.concat(F.lit("SN"), F.col("event_id").cast("string")).alias("serial_number"),
        F.concat(F.lit("log"), (F.col("user_id") % 5).cast("string")).alias("log_name"),
        log_url.alias("log_url"),
        F.col("event_id").alias("cert_index"),
        F.concat(log_url, F.lit("entry/"), F.col("event_id").cast("string")).alias("cert_link"),
        "seen_at",
        (F.col("seen_at") + 60).alias("created_at"),
        times.seen_date(F.col("seen_at")).alias("seen_date"),
    )


def certs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certs_of(events(spark, sf_dir))


def nulled_certs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null names in every third row."""
    return certs(spark, sf_dir).withColumn("domains", F.when(F.col("cert_index") % 3 != 0, F.col("domains")))


def copied_certs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fingerprint twice."""
    return certs_of(events(spark, sf_dir), copies=2)


def messages_of(ev: DataFrame, copies: int = 1) -> DataFrame:
    """Certificates as JSON messages, with heartbeats and broken text in between."""
    c = certs_of(ev, copies)
    raw = F.upper(F.regexp_replace("fingerprint", "(..)(?=.)", "$1:"))
    body = F.to_json(
        F.struct(
            F.when(F.col("cert_index") % 50 == 0, F.lit("heartbeat"))
            .otherwise(F.lit("certificate_update"))
            .alias("message_type"),
            F.struct(
                F.lit("X509LogEntry").alias("update_type"),
                "cert_index",
                "cert_link",
                (F.col("seen_at") + F.lit(0.25)).alias("seen"),
                F.struct(F.col("log_url").alias("url"), F.col("log_name").alias("name")).alias("source"),
                F.struct(
                    F.struct(F.coalesce("subject_cn", F.lit("")).alias("CN")).alias("subject"),
                    F.struct(F.col("issuer_org").alias("O"), F.col("issuer_cn").alias("CN")).alias("issuer"),
                    "not_before",
                    "not_after",
                    "serial_number",
                    raw.alias("fingerprint"),
                    F.concat("domains", F.array(F.lit(""))).alias("all_domains"),
                ).alias("leaf_cert"),
            ).alias("data"),
        )
    )
    broken = F.concat(F.lit("{broken "), F.col("cert_index").cast("string"))
    return c.select(F.when(F.col("cert_index") % 97 == 0, broken).otherwise(body).alias("value"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(events(spark, sf_dir))


def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A narrow saved search per user, in seven forms, and three broad ones per event type."""
    ev = events(spark, sf_dir)
    u = F.col("user_id").cast("string")
    forms = [
        F.concat(F.lit("u"), u, F.lit(".github -click")),
        F.concat(F.lit("domain:u"), u, F.lit(".github.io")),
        F.concat(F.lit("cn:u"), u, F.lit(".example domain_count:=1")),
        F.concat(F.lit("domain:u"), u, F.lit(".net OR domain:u"), u, F.lit(".co.uk after:2024-01-10")),
        F.concat(F.lit("u"), u, F.lit(".github created:2024-01-05..2024-01-07")),
        F.concat(F.lit('"u'), u, F.lit('.github.io" before:2024-01-20 wildcard:false')),
        F.concat(F.lit("u%_"), u, F.lit(" OR domain:b.u"), u, F.lit(".net -error OR u"), u, F.lit(".example -CA")),
    ]
    text = forms[-1]
    for i, form in enumerate(forms[:-1]):
        text = F.when(F.col("user_id") % 7 == i, form).otherwise(text)
    narrow = ev.select("user_id").distinct().select(F.col("user_id").alias("search_id"), text.alias("text"))
    kind, first = F.col("event_type"), F.ascii("event_type").cast("bigint")
    broad = (
        ev.select("event_type")
        .distinct()
        .select(
            F.stack(
                F.lit(3),
                -first,
                F.left(kind, F.lit(2)),
                -1000 - first,
                F.concat(F.lit('issuer:"CA '), kind, F.lit('" wildcard:true domain_count:>=1')),
                -2000 - first,
                F.concat(F.lit("cn:* "), kind),
            ).alias("search_id", "text")
        )
    )
    return narrow.unionByName(broad)


def metadata_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value rows, many versions per key."""
    return events(spark, sf_dir).select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("key"),
        F.concat(F.col("event_type"), F.lit("-"), F.col("event_id").cast("string")).alias("value"),
        (_seconds(F.col("ts")) * 1000000 + F.col("event_id")).alias("updated_at"),
    )


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def cert_stream(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    """The certificates as a stream over the same files."""
    reader = ensure_utc(spark).readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet")
    return certs_of(reader.parquet(sf_dir), copies)


# Messages of one text file, some 40 MB.
FILE_MESSAGES = 100_000


def message_files(spark: SparkSession, sf_dir: str, path: str, shares: int, copies: int = 1, per_file: int = FILE_MESSAGES) -> int:
    """Writes the messages below `path` as text in `shares` equal shares, and returns the number of files of a share.

    Events are dealt out before they are written as messages, so that no task has more than a file's worth of them.
    """
    ev = events(spark, sf_dir)
    files = max(1, -(-ev.count() // (shares * per_file)))
    messages_of(ev.repartition(shares * files), copies).write.text(path)
    return files
