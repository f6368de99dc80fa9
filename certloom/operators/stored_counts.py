"""Statistics of a stored table as additive counts: `(hour, facet, value, n)` with signs.

Every insert adds the counts of its own rows, and what retention or compaction takes away is added with a minus, so hours
and days are sums of stored counts and certificates are not read again. The counts lie in `_counts` of the table's
folder, one folder per change and below it one per day. A folder's name holds the first and last number of the changes
in it. Joined changes take the place of their parts by one rename: a folder whose numbers lie within those of another
one is not read. A mark `floor-<second>-<number>` hides the hours before that second in all changes up to that number.
Names are counted by registrable domain, by the suffix rules given to `build`, which are stored too; after a change of
the rules the counts are built anew.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom import schemas
from certloom.files import delete_path, folder_names, mark, move, path_exists
from certloom.functions import times
from certloom.functions.predicates import seen_between
from certloom.operators import periods
from certloom.sources.suffixes import SuffixRules

FOLDER = "_counts"
WIDTH = 8  # changes of one tier before they are joined
COUNT = T.StructType([
    T.StructField("hour", T.LongType()),
    T.StructField("facet", T.IntegerType()),
    T.StructField("value", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("day", T.DateType()),
])
RULE = T.StructType([T.StructField("suffix", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("flags", T.IntegerType())])


@dataclass(frozen=True)
class Change:
    """A folder of counts: how often it was joined, the numbers of its first and last change, and the insert's id."""

    tier: int
    first: int
    last: int
    uid: str

    @property
    def folder(self) -> str:
        return f"change-{self.tier}-{self.first}-{self.last}-{self.uid}"


def has_counts(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/{FOLDER}")


def list_changes(spark: SparkSession, path: str) -> list[Change]:
    """The changes that count, oldest first: those that are not part of a joined one."""
    names = [n.split("-") for n in folder_names(spark, f"{path}/{FOLDER}") if n.startswith("change-")]
    found = [Change(*map(int, numbers), uid) for _, *numbers, uid in names]
    inside = {c for c in found for d in found if d != c and d.first <= c.first and c.last <= d.last and d.tier > c.tier}
    return sorted((c for c in found if c not in inside), key=lambda c: c.first)


def _floors(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    names = [n.split("-", 1)[1] for n in folder_names(spark, f"{path}/{FOLDER}") if n.startswith("floor-")]
    return [(int(limit), int(number)) for limit, number in (n.rsplit("-", 1) for n in names)]


def _rules(spark: SparkSession, path: str) -> SuffixRules:
    frame = spark.read.schema(RULE).parquet(f"{path}/{FOLDER}/_rules")
    size = frame.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()
    return SuffixRules(frame, size["n"], size["d"])


def counts_of(rows: DataFrame, rules: SuffixRules) -> DataFrame:
    """COUNT of some certificates; a null name list gives no names, but its certificate is counted."""
    each = periods.facet_counts(rows, rules, periods.HOUR)
    hour = F.col("period_start")
    return each.select(hour.alias("hour"), F.col("facet").cast("int").alias("facet"), "value", "n", times.seen_date(hour).alias("day"))


def _added(counts: DataFrame) -> DataFrame:
    return counts.groupBy("day", "hour", "facet", "value").agg(F.sum("n").alias("n")).filter("n <> 0").select(*COUNT.fieldNames())


def _write(spark: SparkSession, path: str, counts: DataFrame, change: Change) -> None:
    """Put the counts in place by one rename."""
    staged = f"{path}/{FOLDER}/staged-{uuid.uuid4().hex}"
    dealt = counts.select(*COUNT.fieldNames()).hint("rebalance", "day").sortWithinPartitions("day", "hour", "facet")
    dealt.write.partitionBy("day").parquet(staged)
    target = f"{path}/{FOLDER}/{change.folder}"
    delete_path(spark, target)
    move(spark, staged, target)


def _read(spark: SparkSession, path: str, changes: list[Change]) -> DataFrame:
    """The rows of some changes, without the hours that retention has hidden."""
    floors = _floors(spark, path)
    by_limit: dict[int | None, list[str]] = {}
    for c in changes:
        limit = max((limit for limit, number in floors if c.last <= number), default=None)
        by_limit.setdefault(limit, []).append(f"{path}/{FOLDER}/{c.folder}")
    found = spark.createDataFrame([], COUNT)
    for limit, folders in by_limit.items():
        for folder in folders:
            rows = spark.read.schema(COUNT).option("basePath", folder).parquet(folder)
            found = found.union(rows if limit is None else rows.filter(F.col("hour") >= limit))
    return found


def build(spark: SparkSession, path: str, rules: SuffixRules) -> None:
    """Count the whole table at `path`; from then on inserts, compaction and retention keep the counts."""
    table = spark.read.schema(schemas.CERTIFICATE).parquet(path)
    staged = f"{path}/{FOLDER}-{uuid.uuid4().hex}"
    rules.frame.select(*[F.col(f.name).cast(f.dataType) for f in RULE]).write.parquet(f"{staged}/_rules")
    first = f"{staged}/{Change(0, 1, 1, uuid.uuid4().hex).folder}"
    counts_of(table, rules).hint("rebalance", "day").sortWithinPartitions("day", "hour", "facet").write.partitionBy("day").parquet(first)
    delete_path(spark, f"{path}/{FOLDER}")
    move(spark, staged, f"{path}/{FOLDER}")


def _next(spark: SparkSession, path: str) -> int:
    return 1 + max((c.last for c in list_changes(spark, path)), default=0)


def add(spark: SparkSession, path: str, rows: DataFrame, uid: str) -> None:
    """Count the rows of the insert `uid`, which may be repeated: its counts are replaced, not added twice."""
    if not has_counts(spark, path):
        return
    own = [c for c in list_changes(spark, path) if c.uid == uid]
    number = _next(spark, path)
    _write(spark, path, counts_of(rows, _rules(spark, path)), own[0] if own else Change(0, number, number, uid))


def join_changes(spark: SparkSession, path: str) -> None:
    """Join neighbouring changes of a tier once there are WIDTH of them, so that few are read at any time."""
    if not has_counts(spark, path):
        return
    for name in folder_names(spark, f"{path}/{FOLDER}"):
        if name.startswith("staged-"):
            delete_path(spark, f"{path}/{FOLDER}/{name}")
    tier = 0
    while True:
        changes = list_changes(spark, path)
        if tier > max((c.tier for c in changes), default=-1):
            break
        own = [c for c in changes if c.tier == tier]
        if len(own) >= WIDTH:
            whole = Change(tier + 1, own[0].first, own[-1].last, uuid.uuid4().hex)
            # Tiers lie in order of age: what is joined is without gaps.
            parts = [c for c in changes if whole.first <= c.first and c.last <= whole.last]
            _write(spark, path, _added(_read(spark, path, parts)), whole)
        tier += 1
    living = {c.folder for c in changes}
    for name in folder_names(spark, f"{path}/{FOLDER}"):
        if name.startswith("change-") and name not in living:
            delete_path(spark, f"{path}/{FOLDER}/{name}")


def recount(spark: SparkSession, path: str, start: int, end: int) -> None:
    """Add what the hours of `[start, end)` differ by from the certificates in them, reading those only.

    It may be repeated: a second time nothing differs. Both ends are full hours.
    """
    if not has_counts(spark, path):
        return
    chosen = spark.read.schema(schemas.CERTIFICATE).parquet(path).filter(seen_between(start, end))
    stored = hourly_counts(spark, path, start, end)
    change = _added(counts_of(chosen, _rules(spark, path)).unionByName(stored.withColumn("n", -F.col("n"))))
    number = _next(spark, path)
    _write(spark, path, change, Change(0, number, number, uuid.uuid4().hex))


def drop_before(spark: SparkSession, path: str, limit: int) -> None:
    """Certificates seen before `limit` have left the table: whole hours are hidden, the hour of `limit` is counted anew.

    Rows of such hours that come later count again.
    """
    if not has_counts(spark, path):
        return
    hour, number = limit - limit % periods.HOUR, _next(spark, path) - 1
    before = _floors(spark, path)
    mark(spark, f"{path}/{FOLDER}/floor-{hour}-{number}")
    for old, known in before:
        if old <= hour and known <= number and (old, known) != (hour, number):
            delete_path(spark, f"{path}/{FOLDER}/floor-{old}-{known}")
    if limit != hour:
        recount(spark, path, hour, hour + periods.HOUR)


def _on_days(counts: DataFrame, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        counts = counts.filter((F.col("day") >= times.seen_date(F.lit(start))) & (F.col("hour") >= start))
    if end is not None:
        counts = counts.filter((F.col("day") <= times.seen_date(F.lit(end - 1))) & (F.col("hour") < end))
    return counts


def hourly_counts(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """COUNT summed over all changes; only the days of the range are opened."""
    return _added(_on_days(_read(spark, path, list_changes(spark, path)), start, end))


def _daily(hourly: DataFrame) -> DataFrame:
    """Hourly counts as items of days: every hour of a day is an item too, with its certificates."""
    is_total = F.col("facet") == periods.WILDCARD
    hour = times.bucket_index(F.col("hour"), periods.HOUR).cast("string")
    own = F.struct(F.col("facet").alias("facet"), F.col("value").alias("value"))
    slot = F.struct(F.lit(periods.HOUR_SLOT).alias("facet"), hour.alias("value"))
    return hourly.select("hour", "n", F.inline(F.when(is_total, F.array(own, slot)).otherwise(F.array(own))))


def period_stats(
    spark: SparkSession, path: str, step: int, computed_at: int | Column, start: int | None = None, end: int | None = None, k: int = periods.TOP
) -> DataFrame:
    """Statistics rows of the periods in `[start, end)` (full periods) from stored counts alone, as
    `periods.hourly_stats` and `daily_stats` give them from certificates."""
    hourly = _on_days(_read(spark, path, list_changes(spark, path)), start, end)
    items = _daily(hourly) if step == periods.DAY else hourly
    counts = (
        items.groupBy(times.bucket(F.col("hour"), step).alias("period_start"), "facet", "value")
        .agg(F.sum("n").alias("n"))
        .filter("n <> 0")
    )
    return periods.stats_of_counts(counts, step, computed_at, k)


def seconds_of(day: date) -> int:
    return (day - date(1970, 1, 1)).days * periods.DAY
