"""The fingerprints of a stored table as sorted runs with membership filters.

Every insert adds one run below `_keys` in the table's folder, and runs are joined by tiers of size, so their number
grows with the logarithm of the inserts. A run is dealt by hash into parts of bounded size; each part has its keys
in one sorted file and a filter in rows: blocks of 32,768 bits, of which a key sets a few in the one block it belongs to.
A batch asks the filters first and opens only the parts that may hold one of its keys. Keys below the retention
limit do not count any more and are dropped when their run is next joined.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.files import delete_path, folder_names, move

WIDTH = 8  # runs of one tier before they are joined
FIRST_TIER = 4096  # keys; each further tier has WIDTH times as many
PART_KEYS = 1 << 20  # keys of one part, some 60 MB
BLOCK_BITS = 32_768  # the size of Spark's bitmaps
BITS_PER_KEY, BITS_SET = 16, 5  # some 2 of 1,000 absent keys pass a filter

KEY = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("batch", T.StringType()), T.StructField("seen_at", T.LongType())])
FILTER = T.StructType([T.StructField("place", T.StringType()), T.StructField("block", T.LongType()), T.StructField("bits", T.BinaryType())])


@dataclass(frozen=True)
class Run:
    """A run as its folder's name tells it: tier, number of parts (a power of two), filter blocks of a part, the second
    before which its keys have left the table (0 if none have), and an id."""

    tier: int
    parts: int
    blocks: int
    floor: int
    uid: str

    @property
    def folder(self) -> str:
        return f"run-{self.tier}-{self.parts}-{self.blocks}-{self.floor}-{self.uid}"

    def place(self, part: int) -> str:
        return f"{self.uid}/{part}"


def list_runs(spark: SparkSession, root: str) -> list[Run]:
    names = [n.split("-") for n in folder_names(spark, root) if n.startswith("run-")]
    return [Run(*map(int, numbers), uid) for _, *numbers, uid in names]


def tier_of(keys: int) -> int:
    tier, most = 0, FIRST_TIER
    while keys > most:
        tier, most = tier + 1, most * WIDTH
    return tier


def shape(keys: int) -> tuple[int, int]:
    """(parts, blocks of a part's filter) for so many keys."""
    parts = 1
    while parts * PART_KEYS < keys:
        parts *= 2
    return parts, max(1, -(-keys * BITS_PER_KEY // (parts * BLOCK_BITS)))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("fingerprint"), F.lit(parts).cast("long"))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("fingerprint", F.lit("block")), F.lit(blocks).cast("long"))


def _positions() -> Column:
    """The bits of a key within its block, from 0 on."""
    return F.array(*[F.pmod(F.xxhash64("fingerprint", F.lit(k)), F.lit(BLOCK_BITS).cast("long")) for k in range(BITS_SET)])


def _all_set(bits: Column, positions: Column) -> Column:
    def is_set(p: Column) -> Column:
        byte = F.conv(F.hex(F.substr(bits, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("getbit", byte, (p % 8).cast("int")) == 1

    return F.forall(positions, is_set)


def filter_bits(keys: DataFrame, parts: int, blocks: int) -> DataFrame:
    """(part, block, bits) of the filters of some keys, which are grouped by one number: Spark sorts them for this
    aggregate, and sorts a single number by its digits."""
    number = (_part(parts) * F.lit(blocks).cast("long") + _block(blocks)).alias("number")
    found = keys.select(number, F.explode(_positions()).alias("position")).groupBy("number").agg(F.bitmap_construct_agg("position").alias("bits"))
    return found.select(F.call_function("div", "number", F.lit(blocks)).alias("part"), (F.col("number") % blocks).alias("block"), "bits")


def write_run(spark: SparkSession, root: str, keys: DataFrame, count: int, uid: str | None = None, tier: int | None = None) -> Run:
    """Add `count` keys (KEY) as one run: keys and filter are written in one job and put in place by renaming."""
    parts, blocks = shape(count)
    run = Run(tier_of(count) if tier is None else tier, parts, blocks, 0, uid or uuid.uuid4().hex)
    own = _part(parts).alias("part")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in FILTER]
    rows = keys.select(F.lit("keys").alias("kind"), own, *KEY.fieldNames(), *nothing)
    bits = filter_bits(keys, parts, blocks)
    place = F.concat(F.lit(run.uid + "/"), F.col("part").cast("string")).alias("place")
    filters = bits.select(F.lit("filter").alias("kind"), "part", *[F.lit(None).cast(f.dataType).alias(f.name) for f in KEY], place, "block", "bits")
    staged = f"{root}/_staged-{run.uid}"
    dealt = rows.union(filters).repartition("kind", "part").sortWithinPartitions("kind", "part", "fingerprint", "block")
    dealt.write.partitionBy("kind", "part").parquet(staged)
    move(spark, staged, f"{root}/{run.folder}")
    return run


def may_hold(spark: SparkSession, root: str, runs: list[Run], keys: DataFrame) -> list[tuple[Run, int]]:
    """The (run, part) whose filter passes one of `keys`, a table small enough to be broadcast.

    Filters of other parts than those of the keys are not opened. What reaches the driver is bounded by the files.
    """
    most = max((r.parts for r in runs), default=1)
    own = range(1) if most == 1 else sorted(r[0] for r in keys.select(_part(most)).distinct().collect())
    paths = [f"{root}/{r.folder}/kind=filter/part={p}" for r in runs for p in sorted({p % r.parts for p in own})]
    if not paths:
        return []
    places = [F.struct(F.concat(F.lit(r.uid + "/"), _part(r.parts).cast("string")).alias("place"), _block(r.blocks).alias("block")) for r in runs]
    asked = keys.select(_positions().alias("positions"), F.explode(F.array(*places)).alias("at")).select("positions", "at.place", "at.block")
    filters = spark.read.schema(FILTER).parquet(*paths)
    hits = filters.join(F.broadcast(asked), ["place", "block"]).where(_all_set(F.col("bits"), F.col("positions")))
    by_place = {r.place(p): (r, p) for r in runs for p in range(r.parts)}
    return sorted((by_place[h["place"]] for h in hits.select("place").distinct().collect()), key=lambda x: (x[0].uid, x[1]))


def read_keys(spark: SparkSession, root: str, places: Iterable[tuple[Run, int]]) -> DataFrame:
    """Living keys of some parts; other files are not even listed."""
    paths: dict[int, list[str]] = {}
    for run, part in places:
        paths.setdefault(run.floor, []).append(f"{root}/{run.folder}/kind=keys/part={part}")
    found = spark.createDataFrame([], KEY)
    for k, (limit, own) in enumerate(sorted(paths.items())):
        keys = spark.read.schema(KEY).parquet(*own)
        keys = keys.where(F.col("seen_at") >= limit) if limit else keys
        found = keys if k == 0 else found.union(keys)
    return found


def all_parts(runs: list[Run]) -> list[tuple[Run, int]]:
    return [(r, p) for r in runs for p in range(r.parts)]


def raise_floor(spark: SparkSession, root: str, limit: int) -> None:
    """Keys seen before `limit` have left the table: no run that is there now holds them any more.

    A run is renamed, which cannot break halfway; keys that come later are not concerned.
    """
    for run in list_runs(spark, root):
        if run.floor < limit:
            move(spark, f"{root}/{run.folder}", f"{root}/{replace(run, floor=limit).folder}")


def join_tiers(spark: SparkSession, root: str) -> None:
    """Join the runs of every tier that has WIDTH of them, smallest tier first.

    The new run is in place before the old ones go. What a break leaves is a key in two runs, which does no harm.
    """
    tier = 0
    while True:
        runs = list_runs(spark, root)
        if tier > max((r.tier for r in runs), default=-1):
            return
        own = [r for r in runs if r.tier == tier]
        if len(own) >= WIDTH:
            keys = read_keys(spark, root, all_parts(own))
            joined = keys.groupBy("fingerprint").agg(F.max("batch").alias("batch"), F.max("seen_at").alias("seen_at"))
            count = keys.count()
            if count:
                write_run(spark, root, joined, count, tier=max(tier + 1, tier_of(count)))
            for run in own:
                delete_path(spark, f"{root}/{run.folder}")
        tier += 1
