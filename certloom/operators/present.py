"""Rows as a result page, a detail view, a live feed or a CSV file shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.functions.text import empty_to_null, truncate
from certloom.functions.times import iso_millis, utc_text

MINUTES, SECONDS = "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss 'UTC'"


def _first_domain() -> Column:
    return F.get("domains", F.lit(0))


def _more_domains() -> Column:
    n = F.col("domain_count") - 1
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(F.lit(""))


def _issuer() -> Column:
    return truncate(F.coalesce("issuer_org", "issuer_cn", F.lit("-")), 30)


def display_row(df: DataFrame) -> DataFrame:
    """A line of the result page."""
    return df.select(
        "fingerprint",
        truncate(F.coalesce(_first_domain(), F.lit("")), 50).alias("domain"),
        _more_domains().alias("more"),
        _issuer().alias("issuer"),
        *[utc_text(F.col(c), MINUTES).alias(c) for c in ("not_before", "not_after", "seen_at")],
    )


def feed_row(df: DataFrame) -> DataFrame:
    """A line of the live feed."""
    return df.select(
        "fingerprint",
        truncate(F.coalesce(_first_domain(), "subject_cn", F.lit("-")), 60).alias("domain"),
        _more_domains().alias("more"),
        _issuer().alias("issuer"),
        utc_text(F.col("seen_at"), MINUTES).alias("seen_at"),
    )


def detail_row(df: DataFrame) -> DataFrame:
    """The fields of the detail view."""
    title = F.coalesce(empty_to_null(F.col("subject_cn")), empty_to_null(_first_domain()), F.lit("Unknown"))
    return df.select(
        title.alias("title"),
        "fingerprint",
        *[empty_to_null(F.col(c)).alias(c) for c in ("subject_cn", "issuer_org", "issuer_cn", "serial_number")],
        *[utc_text(F.col(c), SECONDS).alias(c) for c in ("not_before", "not_after", "seen_at")],
        *[empty_to_null(F.col(c)).alias(c) for c in ("log_name", "log_url")],
        "cert_index",
        empty_to_null(F.col("cert_link")).alias("cert_link"),
        "domain_count",
        "domains",
    )


def csv_rows(df: DataFrame) -> DataFrame:
    """The exported columns as text; nulls are empty."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return df.select(
        text("fingerprint").alias("Fingerprint"),
        F.coalesce(F.array_join("domains", "; "), F.lit("")).alias("Domains"),
        text("domain_count").alias("Domain Count"),
        text("issuer_org").alias("Issuer Org"),
        text("issuer_cn").alias("Issuer CN"),
        text("subject_cn").alias("Subject CN"),
        iso_millis(F.col("not_before")).alias("Not Before"),
        iso_millis(F.col("not_after")).alias("Not After"),
        text("serial_number").alias("Serial Number"),
        text("log_name").alias("Log Name"),
        iso_millis(F.col("seen_at")).alias("Seen At"),
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Write the whole result; quotes are doubled and fields quoted only where they must be."""
    csv_rows(df).write.options(
        header=True,
        escape='"',
        emptyValue="",
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
