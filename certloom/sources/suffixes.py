"""Public-suffix rules as an input table `(suffix, kind)`; kind is normal, wildcard or exception.

A wildcard rule is stored without its `*.` and an exception rule without its `!`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.session import BROADCAST_ROWS

# A seed that covers the documented cases; a full list is given as a table.
SEED_SUFFIXES = [
    "com",
    "net",
    "org",
    "io",
    "app",
    "uk",
    "jp",
    "au",
    "co.uk",
    "co.jp",
    "com.au",
    "github.io",
    "herokuapp.com",
    "netlify.app",
]

NORMAL, WILDCARD, EXCEPTION = 1, 2, 4


@dataclass(frozen=True)
class SuffixRules:
    """One row per suffix `(suffix, depth, flags)` with the measured size of the table."""

    frame: DataFrame
    rows: int
    max_depth: int

    @property
    def broadcastable(self) -> bool:
        return self.rows <= BROADCAST_ROWS


def load_rules(table: DataFrame) -> SuffixRules:
    """Normalise a `(suffix, kind)` table and measure it once."""
    flag = (
        F.when(F.col("kind") == "normal", NORMAL)
        .when(F.col("kind") == "wildcard", WILDCARD)
        .when(F.col("kind") == "exception", EXCEPTION)
    )
    frame = (
        table.select(F.lower(F.btrim("suffix")).alias("suffix"), flag.alias("flag"))
        .filter(F.col("flag").isNotNull() & (F.col("suffix") != ""))
        .groupBy("suffix")
        .agg(F.bit_or("flag").alias("flags"))
        .withColumn("depth", F.size(F.split("suffix", r"\.")))
    )
    size = frame.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()
    return SuffixRules(frame, size["n"], size["d"])


def seed_rules(spark: SparkSession) -> SuffixRules:
    rows = ", ".join(f"('{s}', {s.count('.') + 1}, {NORMAL})" for s in SEED_SUFFIXES)
    frame = spark.sql(f"SELECT * FROM VALUES {rows} AS rules(suffix, depth, flags)")
    return SuffixRules(frame, len(SEED_SUFFIXES), max(s.count(".") + 1 for s in SEED_SUFFIXES))
