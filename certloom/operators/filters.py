"""The ingest filter for pattern lists too long for one expression: a table of patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.operators.key_sets import KeySet, key_set
from certloom.operators.searches import FEW_KEYS, KEY_LENGTHS, cut, lines_of
from certloom.session import BROADCAST_BYTES, BROADCAST_ROWS, stored

GLOB, SUBSTRING = "domain", "issuer"


def _glob_pattern(glob: Column) -> Column:
    """Column form of `functions.text.glob_match`: `*` any run, `?` one character, the rest literal."""
    literal = F.regexp_replace(glob, r"([\\^$.|+()\[\]{}])", r"\\$1")
    body = F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit(r"(?iu)\A"), body, F.lit(r"\z"))


def _key(text: Column) -> Column:
    """The start of a literal text in the longest key length that fits; no key for no text."""
    key = F.lit("")
    for n in sorted(KEY_LENGTHS):
        key = F.when(F.length(text) >= n, F.left(text, F.lit(n))).otherwise(key)
    return key


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """`(kind, pattern)` rows with the key to look them up by: of a glob, from its longest literal run."""
    runs = F.transform(F.split(F.lower("pattern"), "[*?]+"), lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))
    literal = F.when(F.col("kind") == GLOB, F.array_max(runs)["run"]).otherwise(F.lower("pattern"))
    return (
        patterns.filter(F.col("pattern").isNotNull() & F.col("kind").isin(GLOB, SUBSTRING))
        .select("kind", "pattern", _key(literal).alias("key"))
        .distinct()
    )


@dataclass(frozen=True)
class PatternIndex:
    """Stored patterns with their keys, the set of the keys, their lengths, and the keys themselves of lengths that
    have few."""

    keyed: DataFrame
    keys: KeySet
    small: bool
    lengths: tuple[int, ...]
    few: tuple[str, ...]


def index_patterns(patterns: DataFrame) -> PatternIndex:
    """Prepare a table of patterns; a stream does this once, not per batch."""
    keyed = stored(pattern_keys(patterns), "patterns")
    width = F.octet_length("pattern") + F.octet_length("key") + 24
    # One row per length of a key, of which there are five.
    n = F.length("key").alias("n")
    sizes = keyed.groupBy(n).agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes"), F.countDistinct("key").alias("distinct")).collect()
    rows, size = (sum(r[c] for r in sizes) for c in ("rows", "bytes"))
    listed = [r["n"] for r in sizes if r["distinct"] <= FEW_KEYS]
    few = [r["key"] for r in keyed.filter(F.length("key").isin(listed)).select("key").distinct().collect()] if listed else []
    return PatternIndex(
        keyed,
        key_set(keyed, "key", rows),
        rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES,
        tuple(sorted(r["n"] for r in sizes if r["n"] not in listed)),
        # Runs do not cross a line end.
        tuple(sorted(k for k in few if "\n" not in k)),
    )


def matching_fingerprints(df: DataFrame, index: PatternIndex) -> DataFrame:
    """The distinct fingerprints of the rows that match a pattern.

    Only runs of lengths that a pattern's key has are cut; a length with few keys is tested key by key.
    """
    side = F.broadcast(index.keyed) if index.small else index.keyed
    columns = ["fingerprint", "domains", "issuer_org"]
    rows = df.select(*columns, F.lower(F.concat_ws("\n", "domains", "issuer_org")).alias("_text"))
    text, piece = F.col("_text"), "array<struct<line: string, n: int>>"
    held = [F.when(F.contains(text, F.lit(k)), F.struct(F.lit(k).alias("line"), F.lit(len(k)).alias("n"))) for k in index.few]
    pieces = F.array(*held).cast(piece)
    if index.lengths:
        pieces = F.concat(pieces, lines_of(text, *index.lengths))
    # Keys that no pattern has do not leave their row, and rows without a key are done.
    offered = cut(rows, pieces, *columns).filter(index.keys.may_hold(F.col("key")))
    glob = F.exists("domains", lambda d: F.rlike(d, _glob_pattern(F.col("pattern"))))
    substring = F.contains(F.lower("issuer_org"), F.lower("pattern"))
    matched = F.when(F.col("kind") == GLOB, glob).otherwise(substring)
    return offered.join(side, "key").filter(matched).select("fingerprint").distinct()


def match_patterns(df: DataFrame, index: PatternIndex) -> DataFrame:
    """`filter_by_patterns` with prepared patterns."""
    return df.join(matching_fingerprints(df, index), "fingerprint", "left_semi").select(*df.columns)


def filter_by_patterns(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows with a name that matches any `domain` glob or an issuer that holds any `issuer` text.

    A row meets only patterns that share a run of characters with it, so the work does not grow with rows times
    patterns. Rows with one fingerprint are one certificate and are kept or dropped together. Null patterns
    and other kinds match nothing; an empty table of patterns keeps nothing.
    """
    return match_patterns(df, index_patterns(patterns))
