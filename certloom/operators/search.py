"""One search over the certificate table: counts, pages, recent rows, point lookups, exports."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.functions import times
from certloom.functions.predicates import SearchSpec, match_spec, seen_between
from certloom.operators.tables import first_per_key
from certloom.session import broadcast_if_small


# Rows before a page beyond which its place is counted, not sorted for.
DEEP = 10_000


def newest_first() -> list[Column]:
    return [F.col("seen_at").desc(), F.col("fingerprint").desc()]


def oldest_first() -> list[Column]:
    return [F.col("seen_at").asc(), F.col("fingerprint").asc()]


def search(df: DataFrame, spec: SearchSpec) -> DataFrame:
    return df.filter(match_spec(spec))


def recent(df: DataFrame, n: int) -> DataFrame:
    """The `n` newest rows; every task keeps `n` rows, nothing is sorted as a whole."""
    return df.orderBy(*newest_first()).limit(n)


def match_count(df: DataFrame, spec: SearchSpec, limit: int) -> DataFrame:
    """One row `(total, total_pages)`."""
    return search(df, spec).agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(limit)).cast("long").alias("total_pages")
    )


def page(df: DataFrame, spec: SearchSpec, number: int, limit: int) -> DataFrame:
    """Page `number` (from 1) by offset; for deep pages use `page_after` or `page_by_rank`."""
    return search(df, spec).orderBy(*newest_first()).offset((number - 1) * limit).limit(limit)


def _descend(counts: list[tuple[int, int]], skip: int) -> tuple[int, int]:
    """Of `(key, n)` in reading order, the key that holds the row behind `skip` others, and how many it still skips."""
    for key, n in counts:
        if skip < n:
            return key, skip
        skip -= n
    raise IndexError("no such row")


def page_by_rank(df: DataFrame, spec: SearchSpec, number: int, limit: int) -> DataFrame:
    """`page` for any page number at the price of a count: a histogram of the matches by day and, within the days where
    the page begins and ends, by second tells between which seconds it lies. Only those are read and sorted.

    One number per day and two times one per second of a day reach the driver. A page behind the last has no rows.
    """
    matches = search(df, spec)
    per_day = matches.groupBy(times.day_bucket(F.col("seen_at")).alias("day")).agg(F.count(F.lit(1)).alias("n")).collect()
    days = sorted(((r["day"], r["n"]) for r in per_day), reverse=True)
    total, skip = sum(n for _, n in days), (number - 1) * limit
    if skip >= total:
        return matches.limit(0)

    def at(rank: int) -> tuple[int, int]:
        day, left = _descend(days, rank)
        in_day = matches.filter(seen_between(day, day + times.DAY)).groupBy("seen_at").agg(F.count(F.lit(1)).alias("n")).collect()
        return _descend(sorted(((r["seen_at"], r["n"]) for r in in_day), reverse=True), left)

    newest, above = at(skip)
    oldest, _ = at(min(skip + limit, total) - 1)
    return matches.filter(seen_between(oldest, newest + 1)).orderBy(*newest_first()).offset(above).limit(limit)


def format_cursor(seen_at: int, fingerprint: str) -> str:
    return f"{seen_at}:{fingerprint}"


def parse_cursor(cursor: str) -> tuple[int, str]:
    seconds, _, fingerprint = cursor.partition(":")
    return int(seconds), fingerprint


def page_after(df: DataFrame, spec: SearchSpec, cursor: str, limit: int) -> DataFrame:
    """The page that follows `cursor`; days above the cursor are not read."""
    seen, fingerprint = parse_cursor(cursor)
    below = (F.col("seen_at") < seen) | ((F.col("seen_at") == seen) & (F.col("fingerprint") < fingerprint))
    return search(df, spec).filter(seen_between(before=seen + 1) & below).orderBy(*newest_first()).limit(limit)


@dataclass(frozen=True)
class Page:
    rows: list
    total: int
    total_pages: int
    number: int
    limit: int
    next_cursor: str | None


def first_page(df: DataFrame, spec: SearchSpec, limit: int) -> DataFrame:
    """`limit + 1` newest matches: one more than a page tells whether a count is needed."""
    return search(df, spec).orderBy(*newest_first()).limit(limit + 1)


def fetch_page(
    df: DataFrame, spec: SearchSpec, number: int, limit: int, cursor: str | None = None, known_total: int | None = None
) -> Page:
    """One result page with totals; the count is skipped when it is known or fits on page one."""
    total = known_total if number > 1 else None
    if number == 1:
        rows = first_page(df, spec, limit).collect()
        if len(rows) <= limit:
            total = len(rows)
        rows = rows[:limit]
    elif cursor:
        rows = page_after(df, spec, cursor, limit).collect()
    elif (number - 1) * limit > DEEP:
        rows = page_by_rank(df, spec, number, limit).collect()
    else:
        rows = page(df, spec, number, limit).collect()
    if total is None:
        total = search(df, spec).count()
    last = format_cursor(rows[-1]["seen_at"], rows[-1]["fingerprint"]) if rows else None
    pages = math.ceil(total / limit)
    return Page(rows, total, pages, number, limit, last if number < pages else None)


def lookup(df: DataFrame, fingerprint: str) -> DataFrame:
    """The row of a fingerprint, the last inserted one if there are several."""
    return df.filter(F.col("fingerprint") == fingerprint).orderBy(F.col("created_at").desc(), *newest_first()).limit(1)


def lookup_many(df: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """`lookup` for a whole table of fingerprints."""
    wanted = broadcast_if_small(fingerprints.select("fingerprint"), F.length("fingerprint"))
    hits = df.join(wanted, "fingerprint", "left_semi")
    return first_per_key(hits, ["fingerprint"], [F.col("created_at").desc(), *newest_first(), F.col("cert_index").asc()])


def export_range(df: DataFrame, after_cursor: str | None, limit: int) -> DataFrame:
    """The next `limit` rows in ascending order; days below the cursor are not read."""
    if after_cursor is not None:
        seen, fingerprint = parse_cursor(after_cursor)
        above = (F.col("seen_at") > seen) | ((F.col("seen_at") == seen) & (F.col("fingerprint") > fingerprint))
        df = df.filter(seen_between(after=seen) & above)
    return df.orderBy(*oldest_first()).limit(limit)


def next_cursor(batch: DataFrame, limit: int) -> str | None:
    """Cursor behind an exported batch, null when the batch is not full."""
    end = batch.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("seen_at", "fingerprint")).alias("last")
    ).first()
    return format_cursor(*end["last"]) if end["n"] >= limit else None


def export_order(df: DataFrame) -> DataFrame:
    """The whole table in export order, as range partitions of sorted rows."""
    return df.orderBy(*oldest_first())
