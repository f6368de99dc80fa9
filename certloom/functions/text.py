"""Cleaning of message fields and glob or substring matching of text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from certloom.schemas import TOP_LIST


def normalize_fingerprint(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(":"), F.lit("")))


def clean_domains(c: Column) -> Column:
    """Drop null and empty names; order and duplicates stay."""
    return F.filter(c, lambda d: d.isNotNull() & (d != ""))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def domain_count(c: Column) -> Column:
    return F.size(c)


def decode_top_list(c: Column) -> Column:
    """JSON text to `array<struct<value,count>>`; text that is no such array gives an empty array."""
    return F.coalesce(F.from_json(c, TOP_LIST), F.array().cast(TOP_LIST))


def encode_top_list(c: Column) -> Column:
    return F.to_json(c)


def decode_domains(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def encode_domains(c: Column) -> Column:
    return F.to_json(c)


def glob_regex(pattern: str) -> str:
    """`*` is any run and `?` any one character; everything else is literal."""
    wild = {"*": ".*", "?": "."}
    return "".join(wild.get(ch) or re.escape(ch) for ch in pattern)


def glob_match(c: Column, *patterns: str) -> Column:
    """Anchored, case-insensitive match of any of the globs, as one alternation."""
    body = "|".join(glob_regex(p) for p in patterns)
    return c.rlike(rf"(?iu)\A(?:{body})\z")


def issuer_contains_any(c: Column, substrings: list[str]) -> Column:
    """Case-insensitive substring test; null never matches."""
    hit = F.lit(False)
    for s in substrings:
        hit = hit | F.contains(F.lower(c), F.lower(F.lit(s)))
    return F.coalesce(hit, F.lit(False))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)
