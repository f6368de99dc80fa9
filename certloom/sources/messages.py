"""Certificate messages (JSON text) to certificate rows; the same code serves batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom import schemas
from certloom.functions import text, times


def parse_messages(df: DataFrame, value_col: str = "value", now: Column | int | None = None) -> DataFrame:
    """Rows for valid certificate updates; bad JSON, heartbeats and incomplete leaves are dropped.

    `now` stands in for a missing `seen`. Columns of `df` other than `value_col` are kept in front.
    """
    now = F.unix_seconds(F.current_timestamp()) if now is None else now
    kept = [c for c in df.columns if c != value_col]
    # As a one-element list the parsed message is a row source of its own: the tests below stay
    # above it, and no message is parsed more than once.
    message = F.inline(F.array(F.from_json(F.col(value_col).cast("string"), schemas.MESSAGE)))
    parsed = (
        df.select(*kept, message)
        .filter(F.col("message_type") == "certificate_update")
        .select(*kept, F.col("data").alias("_d"), F.col("data.leaf_cert").alias("_l"))
        .withColumn("_domains", text.clean_domains(F.col("_l.all_domains")))
        .filter((F.size("_domains") > 0) & (F.col("_l.fingerprint") != ""))
    )
    return parsed.select(
        *kept,
        text.normalize_fingerprint(F.col("_l.fingerprint")).alias("fingerprint"),
        F.col("_domains").alias("domains"),
        text.empty_to_null(F.col("_l.issuer.O")).alias("issuer_org"),
        text.empty_to_null(F.col("_l.issuer.CN")).alias("issuer_cn"),
        text.empty_to_null(F.col("_l.subject.CN")).alias("subject_cn"),
        F.col("_l.not_before").alias("not_before"),
        F.col("_l.not_after").alias("not_after"),
        F.coalesce(F.col("_l.serial_number"), F.lit("")).alias("serial_number"),
        text.empty_to_null(F.col("_d.source.name")).alias("log_name"),
        text.empty_to_null(F.col("_d.source.url")).alias("log_url"),
        F.col("_d.cert_index").alias("cert_index"),
        text.empty_to_null(F.col("_d.cert_link")).alias("cert_link"),
        times.seen_at(F.col("_d.seen"), now).alias("seen_at"),
    )


def ingest_filter(df: DataFrame, globs: list[str] = (), substrings: list[str] = ()) -> DataFrame:
    """Keep rows with a domain matching any glob or an issuer holding any substring; no filters keep all."""
    return df.filter(ingest_predicate(globs, substrings))


def ingest_predicate(globs: list[str] = (), substrings: list[str] = ()) -> Column:
    if not globs and not substrings:
        return F.lit(True)
    keep = F.lit(False)
    if globs:
        keep = keep | F.coalesce(
            F.exists(F.col("domains"), lambda d: F.coalesce(text.glob_match(d, *globs), F.lit(False))), F.lit(False)
        )
    if substrings:
        keep = keep | text.issuer_contains_any(F.col("issuer_org"), list(substrings))
    return keep


def to_certificates(df: DataFrame, created_at: Column | int) -> DataFrame:
    """Parsed rows with the columns that are set at insert time, in table order."""
    return df.select(
        *[c for c in df.columns if c not in ("domain_count", "created_at", "seen_date")],
        text.domain_count(F.col("domains")).alias("domain_count"),
        (created_at if isinstance(created_at, Column) else F.lit(created_at)).cast("long").alias("created_at"),
        times.seen_date(F.col("seen_at")).alias("seen_date"),
    ).select(*schemas.CERTIFICATE_COLUMNS, *[c for c in df.columns if c not in schemas.CERTIFICATE_COLUMNS])
