"""Explicit schemas; nothing is inferred at run time."""

from pyspark.sql import types as T

CERTIFICATE = T.StructType(
    [
        T.StructField("fingerprint", T.StringType(), False),
        T.StructField("domains", T.ArrayType(T.StringType())),
        T.StructField("domain_count", T.IntegerType()),
        T.StructField("issuer_org", T.StringType()),
        T.StructField("issuer_cn", T.StringType()),
        T.StructField("subject_cn", T.StringType()),
        T.StructField("not_before", T.LongType()),
        T.StructField("not_after", T.LongType()),
        T.StructField("serial_number", T.StringType()),
        T.StructField("log_name", T.StringType()),
        T.StructField("log_url", T.StringType()),
        T.StructField("cert_index", T.LongType()),
        T.StructField("cert_link", T.StringType()),
        T.StructField("seen_at", T.LongType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("seen_date", T.DateType()),
    ]
)

CERTIFICATE_COLUMNS = CERTIFICATE.fieldNames()

# Columns of a parsed message: the table's without those set at insert time.
INGEST_COLUMNS = [c for c in CERTIFICATE_COLUMNS if c not in ("domain_count", "created_at", "seen_date")]

# JSON keys are case-sensitive; parts of the message that no operator reads are left out.
MESSAGE = T.StructType(
    [
        T.StructField("message_type", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("update_type", T.StringType()),
                    T.StructField("cert_index", T.LongType()),
                    T.StructField("cert_link", T.StringType()),
                    T.StructField("seen", T.DoubleType()),
                    T.StructField(
                        "source",
                        T.StructType([T.StructField("url", T.StringType()), T.StructField("name", T.StringType())]),
                    ),
                    T.StructField(
                        "leaf_cert",
                        T.StructType(
                            [
                                T.StructField("subject", T.StructType([T.StructField("CN", T.StringType())])),
                                T.StructField(
                                    "issuer",
                                    T.StructType(
                                        [T.StructField("O", T.StringType()), T.StructField("CN", T.StringType())]
                                    ),
                                ),
                                T.StructField("not_before", T.LongType()),
                                T.StructField("not_after", T.LongType()),
                                T.StructField("serial_number", T.StringType()),
                                T.StructField("fingerprint", T.StringType()),
                                T.StructField("all_domains", T.ArrayType(T.StringType())),
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)

TOP_LIST = T.ArrayType(
    T.StructType([T.StructField("value", T.StringType()), T.StructField("count", T.LongType())])
)

HOURLY_STATS = T.StructType(
    [
        T.StructField("period_start", T.LongType()),
        T.StructField("period_end", T.LongType()),
        T.StructField("total_certificates", T.LongType()),
        T.StructField("unique_domains", T.LongType()),
        T.StructField("unique_issuers", T.LongType()),
        T.StructField("wildcard_count", T.LongType()),
        T.StructField("avg_san_count", T.DoubleType()),
        T.StructField("top_domains", TOP_LIST),
        T.StructField("top_issuers", TOP_LIST),
        T.StructField("computed_at", T.LongType()),
    ]
)

DAILY_STATS = T.StructType(HOURLY_STATS.fields + [T.StructField("peak_hourly_rate", T.LongType())])

METADATA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("updated_at", T.LongType()),
    ]
)
