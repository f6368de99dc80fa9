"""Registrable domain (public suffix plus one label) by joins with a rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.functions import hosts
from certloom.sources.suffixes import EXCEPTION, NORMAL, WILDCARD, SuffixRules

# Names below these endings are never registrable.
RESERVED_ENDINGS = ["local"]

SALTS = 8


def domain_counts(df: DataFrame, *keys: str, domains_col: str = "domains") -> DataFrame:
    """Occurrences of every raw name, per `keys`."""
    return (
        df.select(*keys, F.explode(domains_col).alias("domain"))
        .groupBy(*keys, "domain")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _tail(host: Column, labels: Column | int) -> Column:
    labels = labels if isinstance(labels, Column) else F.lit(labels)
    return F.call_function("substring_index", host, F.lit("."), -labels)


def _with_host(df: DataFrame, bare: Column) -> DataFrame:
    """Add `_host`, the name to look up (null where no registrable domain can exist), and its `_labels`.

    In steps, so that no part is evaluated twice.
    """
    usable = hosts.is_host_name(F.col("_name")) & ~hosts.is_ipv4_shape(F.col("_bare"))
    return (
        df.withColumn("_bare", bare)
        .withColumn("_name", hosts.drop_root_dot(F.col("_bare")))
        .withColumn("_host", F.when(usable & ~_tail(F.col("_name"), 1).isin(RESERVED_ENDINGS), F.col("_name")))
        .withColumn("_labels", F.size(F.split("_host", r"\.")))
        .drop("_bare", "_name")
    )


def _has(flags: Column, kind: int) -> Column:
    return flags.bitwiseAND(F.lit(kind)) != 0


def registrable_domain(
    df: DataFrame, domain_col: str, rules: SuffixRules, out: str = "registrable", via: str | None = None, bare: bool = False
) -> DataFrame:
    """Add `out`; null for a bare suffix, an address or an invalid name.

    Unlisted endings follow the default rule, the longest match wins, exceptions win over all.
    With a rule table of checked size every label depth is one hash lookup and no row moves;
    beyond that bound (`via="shuffle"`) distinct hosts are joined with the rules by suffix.
    `bare` says that the names went through `bare_name` before.
    """
    via = via or ("lookup" if rules.broadcastable else "shuffle")
    named = _with_host(df, F.col(domain_col) if bare else hosts.bare_name(F.col(domain_col)))
    found = _by_lookup(named, rules) if via == "lookup" else _by_shuffle(named, rules)
    public = F.coalesce(F.col("_exc"), F.greatest(F.col("_norm"), F.col("_wild"), F.lit(1)))
    reg = F.when(F.col("_labels") > public, _tail(F.col("_host"), public + 1))
    return found.withColumn(out, reg).select(*[c for c in df.columns if c != out], out)


def _by_lookup(named: DataFrame, rules: SuffixRules) -> DataFrame:
    depths = range(1, rules.max_depth + 1)
    for d in depths:
        level = rules.frame.filter(F.col("depth") == d).select(
            F.col("suffix").alias(f"_s{d}"), F.col("flags").alias(f"_f{d}")
        )
        named = named.join(F.broadcast(level), _tail(F.col("_host"), d) == F.col(f"_s{d}"), "left").drop(f"_s{d}")
    none = F.lit(None).cast("int")
    per_kind = {
        "_exc": [F.when(_has(F.col(f"_f{d}"), EXCEPTION), d - 1) for d in depths],
        "_norm": [F.when(_has(F.col(f"_f{d}"), NORMAL), d) for d in depths],
        "_wild": [F.when(_has(F.col(f"_f{d}"), WILDCARD) & (F.col("_labels") > d), d + 1) for d in depths],
    }
    return named.withColumns({name: F.greatest(none, none, *cases) for name, cases in per_kind.items()})


def _by_shuffle(named: DataFrame, rules: SuffixRules) -> DataFrame:
    hosts_only = named.select("_host", "_labels").filter(F.col("_host").isNotNull()).distinct()
    # A third of all hosts may end in the same suffix, so both sides carry a salt.
    tails = hosts_only.select(
        "_host",
        "_labels",
        F.pmod(F.hash("_host"), F.lit(SALTS)).alias("_salt"),
        F.explode(F.sequence(F.lit(1), F.col("_labels"))).alias("_d"),
    ).withColumn("_tail", _tail(F.col("_host"), F.col("_d")))
    salted = rules.frame.select(
        F.col("suffix").alias("_tail"), "flags", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    )
    d, flags = F.col("_d"), F.col("flags")
    matched = (
        tails.join(salted, ["_tail", "_salt"])
        .groupBy("_host")
        .agg(
            F.max(F.when(_has(flags, EXCEPTION), d - 1)).alias("_exc"),
            F.max(F.when(_has(flags, NORMAL), d)).alias("_norm"),
            F.max(F.when(_has(flags, WILDCARD) & (F.col("_labels") > d), d + 1)).alias("_wild"),
        )
    )
    # The same host may fill many rows of the input: spread them over the salts as well.
    spread = matched.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return named.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(
        spread, ["_host", "_salt"], "left"
    )
