"""Jobs that build and maintain the certificate and statistics tables."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom import schemas
from certloom.files import delete_path, folder_names, mark, move, path_exists
from certloom.functions import times
from certloom.functions.predicates import seen_between
from certloom.operators import postings, stored_counts
from certloom.operators.key_runs import (
    all_parts,
    join_tiers,
    list_runs,
    may_hold,
    raise_floor,
    read_keys,
    write_run,
)
from certloom.session import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, scratch, small_enough
from certloom.sources.messages import to_certificates

DAY = times.DAY

# A bloom filter per row group lets a lookup of few fingerprints skip nearly all of them; its size
# follows the number of values, so small files stay small.
FILE_OPTIONS = {
    "parquet.bloom.filter.enabled#fingerprint": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.fpp#fingerprint": "0.00001",
    "parquet.bloom.filter.max.bytes": "4194304",
    "parquet.bloom.filter.candidates.number#fingerprint": "12",
}


def arrival() -> list[Column]:
    """Order in which rows came in. An index counts within one log, so it only settles ties of one log."""
    return [F.col(c).asc_nulls_last() for c in ("seen_at", "log_url", "cert_index", "serial_number", "created_at")]


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key.

    The rank test becomes a limit of one row per key and task in front of the shuffle, so a key
    that fills a third of the input reaches its final task as one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def latest_by_key(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins; equal versions are settled by the other columns."""
    rest = [c for c in df.columns if c not in keys and c != version]
    packed = F.max(F.struct(version, *rest)).alias("_last")
    return (
        df.groupBy(*keys).agg(packed).select(*keys, "_last.*").select(*df.columns)
    )


def read_certificates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CERTIFICATE).parquet(path)


def existing_certificates(spark: SparkSession, path: str) -> DataFrame:
    """The table at `path`, empty before its first write."""
    return read_certificates(spark, path) if path_exists(spark, path) else spark.createDataFrame([], schemas.CERTIFICATE)


def insert_new(target: DataFrame, batch: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Rows of `batch` whose fingerprint is not in `target`; the first of equal ones stays.

    Only fingerprints of the target are read. It is not shuffled while the batch was counted to be
    small enough for a broadcast of its fingerprints. For a stored table use `append_new`.
    """
    fresh = first_per_key(batch, ["fingerprint"], order or arrival())
    known = target.select("fingerprint")
    if small_enough(batch, F.length("fingerprint")):
        known = known.join(F.broadcast(batch.select("fingerprint").distinct()), "fingerprint", "left_semi")
    return fresh.join(known, "fingerprint", "left_anti").select(*batch.columns)


def by_day(df: DataFrame) -> DataFrame:
    """Rows grouped by day for writing; a day too large for one task is split, small ones are joined."""
    return df.hint("rebalance", "seen_date").sortWithinPartitions("seen_date", "seen_at", "fingerprint")


def _write_days(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).options(**FILE_OPTIONS).partitionBy("seen_date").parquet(path)


def _keys_of(rows: DataFrame, batch: str) -> DataFrame:
    return rows.select("fingerprint", F.lit(batch).alias("batch"), "seen_at")


def rebuild_keys(spark: SparkSession, path: str) -> None:
    """Write the fingerprints of the table at `path` anew, as one run.

    Only needed where rows came by other means than `append_new` and `copy_table`. The new run is in place
    before the old ones go.
    """
    root = f"{path}/_keys"
    old = list_runs(spark, root)
    keys = _keys_of(existing_certificates(spark, path), "").groupBy("fingerprint", "batch").agg(F.max("seen_at").alias("seen_at"))
    count = keys.count()
    if count:
        write_run(spark, root, keys, count)
    for run in old:
        delete_path(spark, f"{root}/{run.folder}")
    delete_path(spark, f"{path}/_open")


def settle(spark: SparkSession, path: str) -> None:
    """Bring runs and certificates together again after inserts that broke, once for each.

    The keys of such an insert that have no certificate are dropped, and its stored counts are taken anew from the
    certificates that landed. Only days of those keys are read.
    """
    root = f"{path}/_keys"
    for name in folder_names(spark, root):
        if name.startswith("_staged-"):
            delete_path(spark, f"{root}/{name}")
    for uid in folder_names(spark, f"{path}/_open"):
        for run in [r for r in list_runs(spark, root) if r.uid == uid]:
            keys = read_keys(spark, root, all_parts([run]))
            days = [r[0] for r in keys.select(times.seen_date(F.col("seen_at"))).distinct().collect()]
            there = existing_certificates(spark, path).filter(F.col("seen_date").isin(days))
            landed = keys.join(there.select("fingerprint"), "fingerprint", "left_semi")
            count = landed.count()
            stored_counts.add(spark, path, there.join(keys.select("fingerprint"), "fingerprint", "left_semi"), uid)
            if count:
                write_run(spark, root, landed, count)
            delete_path(spark, f"{root}/{run.folder}")
        delete_path(spark, f"{path}/_open/{uid}")


def _known(spark: SparkSession, root: str, fresh: DataFrame, small: bool) -> DataFrame | None:
    """(fingerprint, batch) of the keys of `fresh` that the table has; None if no filter passes any."""
    runs = list_runs(spark, root)
    places = may_hold(spark, root, runs, fresh.select("fingerprint")) if small else all_parts(runs)
    if not places:
        return None
    asked = fresh.select("fingerprint")
    keys = read_keys(spark, root, places)
    found = keys.join(F.broadcast(asked) if small else asked, "fingerprint", "left_semi")
    return found.groupBy("fingerprint").agg(F.max("batch").alias("batch"))


def append_new(
    spark: SparkSession, path: str, batch: DataFrame, order: list[Column] | None = None, tag: str | None = None
) -> int:
    """Insert a batch into the table at `path` and return the number of rows it inserted.

    Running it again with the same batch inserts nothing. `tag` names the batch: when a batch of that name
    is repeated, rows that it had inserted before are counted again.

    A batch asks the filters of the fingerprint runs and opens only the parts that may hold one of its own
    (`key_runs`); certificates are never read. A batch beyond the broadcast bound meets all runs by a shuffle.
    Fingerprints are written before certificates, under a mark that is taken away at the end; where a mark is left,
    the next insert drops the keys that have no certificate, so no row is lost or doubled. Postings (`postings`) and
    counts (`stored_counts`) are kept up to date where the table has them.
    """
    root = f"{path}/_keys"
    settle(spark, path)
    fresh = first_per_key(batch, ["fingerprint"], order or arrival()).persist(StorageLevel.MEMORY_AND_DISK)
    known = None
    try:
        size = fresh.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("fingerprint")).alias("bytes")).first()
        count = size["n"]
        if not count:
            return 0
        if not list_runs(spark, root) and path_exists(spark, path):
            rebuild_keys(spark, path)
        small = count <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
        known = _known(spark, root, fresh, small)
        rows, repeated = fresh, 0
        if known is not None:
            known = known.persist(StorageLevel.MEMORY_AND_DISK)
            own = F.coalesce(F.count_if(F.col("batch") == F.lit(tag or "")), F.lit(0)) if tag else F.lit(0)
            seen = known.agg(F.count(F.lit(1)).alias("n"), own.alias("own")).first()
            count, repeated = count - seen["n"], seen["own"]
            rows = fresh.join(known.select("fingerprint"), "fingerprint", "left_anti")
        if count:
            uid = uuid.uuid4().hex
            mark(spark, f"{path}/_open/{uid}")
            write_run(spark, root, _keys_of(rows, tag or ""), count, uid)
            postings.add(spark, path, rows)
            stored_counts.add(spark, path, rows, uid)
            _write_days(by_day(rows.select(*batch.columns)), path, "append")
            delete_path(spark, f"{path}/_open/{uid}")
            join_tiers(spark, root)
            stored_counts.join_changes(spark, path)
        return count + repeated
    finally:
        fresh.unpersist()
        if known is not None:
            known.unpersist()


def rewrite_daily(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Rebuild a table into a new folder, by day, each day in `(seen_at, fingerprint)` order.

    Ranges over all three keys cut a heavy day into equal pieces that do not overlap in time.
    """
    days = df.withColumn("seen_date", times.seen_date(F.col("seen_at")))
    keys = ["seen_date", "seen_at", "fingerprint"]
    ranged = days.repartitionByRange(partitions, *keys) if partitions else days.repartitionByRange(*keys)
    _write_days(ranged.sortWithinPartitions(*keys), path, "errorifexists")


def cutoff(now: int, days: int) -> int:
    return now - days * DAY


def apply_retention(df: DataFrame, days: int, now: int) -> DataFrame:
    """The rows that stay."""
    return df.filter(seen_between(after=cutoff(now, days)))


def retention_count(df: DataFrame, days: int, now: int) -> DataFrame:
    return df.filter(seen_between(before=cutoff(now, days))).agg(F.count(F.lit(1)).alias("deleted"))


def enforce_retention(spark: SparkSession, path: str, days: int, now: int) -> int:
    """Delete old rows of the table at `path`: whole days are dropped, the boundary day is rewritten."""
    limit = cutoff(now, days)
    table = read_certificates(spark, path)
    deleted = retention_count(table, days, now).first()["deleted"]
    if deleted:
        boundary = date(1970, 1, 1) + timedelta(days=limit // DAY)
        kept = f"{path}/_staged-{uuid.uuid4().hex}"
        one_day = table.filter(F.col("seen_date") == F.lit(boundary))
        rewrite_daily(apply_retention(one_day, days, now), kept)
        publish_days(spark, kept, path, emptied=[boundary])
        for day in day_partitions(spark, path):
            if day < boundary:
                delete_path(spark, f"{path}/seen_date={day.isoformat()}")
        if path_exists(spark, f"{path}/_keys"):
            raise_floor(spark, f"{path}/_keys", limit)
        postings.drop_before(spark, path, boundary)
        postings.rebuild(spark, path, boundary, boundary + timedelta(days=1))
    # Also where nothing is left to delete: a run that broke after the deletion is made good.
    stored_counts.drop_before(spark, path, limit)
    return deleted


def compact(df: DataFrame, keys: tuple[str, ...] = ("seen_at", "fingerprint")) -> DataFrame:
    """One row per key, the last inserted one."""
    return first_per_key(df, list(keys), [F.col("created_at").desc(), *arrival()])


def compact_days(spark: SparkSession, path: str, start: date, end: date) -> None:
    """Compact the days `[start, end)` of the table at `path`: one row per key and sorted files,
    those of a heavy day without overlap in time."""
    chosen = read_certificates(spark, path).filter((F.col("seen_date") >= F.lit(start)) & (F.col("seen_date") < F.lit(end)))
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    rewrite_daily(compact(chosen), staged)
    publish_days(spark, staged, path)
    postings.rebuild(spark, path, start, end)
    stored_counts.recount(spark, path, stored_counts.seconds_of(start), stored_counts.seconds_of(end))


def publish_days(spark: SparkSession, staged: str, path: str, emptied: list[date] = (), column: str = "seen_date") -> None:
    """Put the days staged below `path` in the place of those of the table, by renaming, and remove the staged folder.

    A day of `emptied` that has no staged rows is removed. An old day stays in the staged folder until
    all new ones are in place.
    """
    present = day_partitions(spark, staged, column)
    for day in sorted({*present, *emptied}):
        folder = f"{column}={day.isoformat()}"
        if path_exists(spark, f"{path}/{folder}"):
            move(spark, f"{path}/{folder}", f"{staged}/_old/{folder}")
        if day in present:
            move(spark, f"{staged}/{folder}", f"{path}/{folder}")
    delete_path(spark, staged)


def day_partitions(spark: SparkSession, path: str, column: str = "seen_date") -> list[date]:
    """Days with a folder in the table; the list grows with days, not with rows."""
    return [date.fromisoformat(n.split("=", 1)[1]) for n in folder_names(spark, path) if n.startswith(f"{column}=")]


def dedupe_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both tables without repeated fingerprints; rows of `first` win."""
    both = first.withColumn("_source", F.lit(0)).unionByName(second.withColumn("_source", F.lit(1)))
    return first_per_key(both, ["fingerprint"], [F.col("_source").asc(), *arrival()]).drop("_source")


def copy_rows(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of `source` that `target` lacks; the earliest of equal fingerprints is taken."""
    fresh = first_per_key(source, ["fingerprint"], arrival())
    return fresh.join(target.select("fingerprint"), "fingerprint", "left_anti")


def copy_table(
    spark: SparkSession, source: DataFrame, target_path: str, created_at: int, chunks: list[tuple[int, int]] | None = None
) -> int:
    """Copy a table into the one at `target_path` and return the number of new rows.

    Running it again, also after a broken run, adds only what is missing. `chunks` are
    `[after, before)` second ranges in ascending order, each committed on its own.
    """
    parts = [source] if chunks is None else [source.filter(seen_between(*c)) for c in chunks]
    return sum(
        append_new(spark, target_path, to_certificates(part.select(*schemas.INGEST_COLUMNS), created_at)) for part in parts
    )


def upsert_periods(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Statistics with the rows of `rows` in place of those of the same period."""
    return target.join(rows.select("period_start"), "period_start", "left_anti").unionByName(rows)


def save_periods(spark: SparkSession, path: str, rows: DataFrame, schema=schemas.HOURLY_STATS) -> None:
    """Upsert into the statistics table at `path`, rewriting only the days it touches."""
    day = times.seen_date(F.col("period_start")).alias("period_date")
    rows = rows.select(*schema.fieldNames(), day)
    with scratch(spark) as keep:
        new = keep(rows, "periods")
        merged = new
        if path_exists(spark, path):
            touched = broadcast_if_small(new.select("period_date").distinct(), F.lit(8))
            merged = upsert_periods(read_periods(spark, path, schema).join(touched, "period_date", "left_semi"), new)
        staged = f"{path}/_staged-{uuid.uuid4().hex}"
        merged.hint("rebalance", "period_date").write.partitionBy("period_date").parquet(staged)
        publish_days(spark, staged, path, column="period_date")


def read_periods(spark: SparkSession, path: str, schema=schemas.HOURLY_STATS) -> DataFrame:
    return spark.read.schema(T.StructType(schema.fields + [T.StructField("period_date", T.DateType())])).parquet(path)


def save_metadata(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append `(key, value, updated_at)` rows; `read_metadata` takes the last of each key."""
    rows.select(*schemas.METADATA.fieldNames()).write.mode("append").parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return latest_by_key(spark.read.schema(schemas.METADATA).parquet(path), ["key"], "updated_at")


def read_stats(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with `start <= period_start < end`, oldest first."""
    return df.filter((F.col("period_start") >= start) & (F.col("period_start") < end)).orderBy("period_start")
