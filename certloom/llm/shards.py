"""Training-order materialisation: fixed windows of token ids in a keyed random order, in binary shards of a fixed stride.

Every task encodes its documents as they come, lays their ids end to end and cuts them into windows of one length. The
windows are stored, counted, and numbered over all tasks. A Feistel permutation of that number, keyed and walked
until it falls below their count, is a window's global slot. Shard k holds the slots from k x per_shard on, one stride
each, so that a slot's place is its byte offset: readers go through files from front to back and go on at any slot.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.files import file_system
from certloom.llm import byte_ids
from certloom.llm.runtime import shared_dir, slices, stored
from certloom.session import broadcast_if_small

LENGTH, PER_SHARD, KEY, ROUNDS = 2048, 4096, 20_240_607, 6
PAD, END = 1, 1
ROUNDS_OF_SHARDS = 3
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ID = 2  # bytes of an id


def feistel(index: Column, domain: int, key: int = KEY, rounds: int = ROUNDS) -> Column:
    """One pass of the permutation over [0, 4**half), the least such power that holds `domain` values."""
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    mask = F.lit((1 << half) - 1).cast("long")
    left, right = F.shiftright(index, half), index.bitwiseAND(mask)
    for k in range(rounds):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(key), F.lit(k)).bitwiseAND(mask))
    return F.shiftleft(left, half).bitwiseOR(right)


def slot(index: Column, domain: int, key: int = KEY) -> Column:
    """A permutation of 0 .. domain - 1 by cycle-walking.

    A pass lands below `domain` with a chance of a quarter at least, so 256 passes fail for fewer than one index
    in 10**31; such an index raises an error rather than take another's slot.
    """
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(255)),
        feistel(index, domain, key),
        lambda at, _: F.when(at < domain, at).otherwise(feistel(at, domain, key)),
    )
    return F.when(walked < domain, walked).otherwise(F.raise_error(F.lit("the cycle walk did not end; take another key")).cast("long"))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _resolved(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark resolves it to, so that executors do not take it for a disk of their own."""
    jpath, system = file_system(spark, path)
    uri = system.makeQualified(jpath).toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def windows(docs: DataFrame, id_column: str, text_column: str, length: int = LENGTH, tokenizer: str = byte_ids.NAME) -> DataFrame:
    """(task, k, data, pieces): the windows of each task, little-endian unsigned 16-bit ids, and whose ids they are.

    A piece is (id, start, length, doc_tokens, offset, ids_crc32): `length` ids of a document, from its `start`-th on,
    which stand at `offset` of the window. A task's last window is padded.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t"))
    kind = source.schema["id"].dataType
    numbers = ["start", "length", "doc_tokens", "offset", "ids_crc32"]
    piece = T.StructType([T.StructField("id", kind), *[T.StructField(n, T.LongType()) for n in numbers]])
    fields = [("task", T.LongType()), ("k", T.LongType()), ("data", T.BinaryType()), ("pieces", T.ArrayType(piece))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = byte_ids.encoder(tokenizer), TaskContext.get().partitionId()
        held, filled, k, open_pieces = bytearray(), 0, 0, []
        done: list[tuple[bytes, list]] = []
        id_type = pa.null()

        def rows() -> pa.RecordBatch:
            nonlocal k
            pieces = [p for _, own in done for p in own]
            columns = list(zip(*pieces)) if pieces else [[]] * 6
            values = pa.StructArray.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["id", *numbers])
            ends = np.cumsum([0, *[len(own) for _, own in done]]).astype(np.int32)
            n = len(done)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([task] * n, pa.int64()), pa.array(range(k, k + n), pa.int64()), pa.array([d for d, _ in done], pa.binary()), pa.ListArray.from_arrays(ends, values)],
                ["task", "k", "data", "pieces"],
            )
            k += n
            done.clear()
            return batch

        for batch in batches:
            id_type, names = batch.schema.field("id").type, batch.column("id").to_pylist()
            for first, texts in slices(batch, "t"):
                for name, text in zip(names[first:], texts):
                    ids = np.append(np.frombuffer(encode(text), "<u4"), END).astype("<u2").tobytes()
                    total, at = len(ids) // _ID, 0
                    while at < total:
                        taken = min(total - at, length - filled)
                        part = ids[at * _ID : (at + taken) * _ID]
                        open_pieces.append((name, at, taken, total, filled, zlib.crc32(part)))
                        held += part
                        at, filled = at + taken, filled + taken
                        if filled == length:
                            done.append((bytes(held), open_pieces))
                            held, filled, open_pieces = bytearray(), 0, []
                if done:
                    yield rows()
        if open_pieces:
            held += np.full(length - filled, PAD, "<u2").tobytes()
            done.append((bytes(held), open_pieces))
            yield rows()

    return source.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def materialise(
    docs: DataFrame,
    path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = KEY,
    tokenizer: str = byte_ids.NAME,
) -> DataFrame:
    """Writes the shards below `path` (a new shared folder if None), and returns one row per piece of a document:
    id, start, length, doc_tokens, slot, offset, shard, ids_crc32.

    Slot s stands in shard s div per_shard, from byte (s mod per_shard) x 2 x length on, and its ids are little-endian
    unsigned 16-bit. Null texts are empty, so their end id alone. Rows with repeated or null ids are documents of
    their own. An empty table gives no shard. A shard is written to a name of its own per attempt and then renamed,
    so a task that runs again leaves one whole file; a shard that lacks a slot is an error.
    """
    spark = docs.sparkSession
    cut = stored(windows(docs, id_column, text_column, length, tokenizer), "windows")
    # One row per task that encoded.
    counts = cut.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("task", F.coalesce(F.expr("sum(n) OVER (ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0)).alias("base"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    side = broadcast_if_small(bases, F.lit(16))
    # As a row source of its own a slot is found once, however often it is asked for.
    own_slot = F.explode(F.array(slot(F.col("base") + F.col("k"), max(total, 1), key)))
    placed = cut.join(side, "task").select("data", "pieces", own_slot.alias("slot"))
    target = _resolved(spark, path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(target)
        system.create_dir(folder, recursive=True)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        shard, sink, next_slot, found = None, None, 0, []

        def close():
            if sink is not None:
                if next_slot != min((shard + 1) * per_shard, total):
                    raise ValueError(f"shard {shard} ends at slot {next_slot}")
                sink.close()
                system.move(f"{folder}/_{shard_name(shard)}-{attempt}", f"{folder}/{shard_name(shard)}")
                found.append((shard, next_slot - shard * per_shard))

        for batch in batches:
            for at, data in zip(batch.column("slot").to_pylist(), batch.column("data")):
                if at // per_shard != shard:
                    close()
                    shard, next_slot = at // per_shard, at // per_shard * per_shard
                    sink = system.open_output_stream(f"{folder}/_{shard_name(shard)}-{attempt}")
                if at != next_slot:
                    raise ValueError(f"slot {next_slot} is missing")
                sink.write(data.as_buffer())
                next_slot += 1
        close()
        columns = list(zip(*found)) if found else [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "windows"])

    # A shard is a range of slots, whose bounds are known without a look at the rows. The shards are written in rounds, and
    # the shuffle files of a round go before the next one, so that windows never lie whole in table, shuffle and shards.
    shards = -(-total // per_shard)
    ends = [shards * k // ROUNDS_OF_SHARDS for k in range(ROUNDS_OF_SHARDS + 1)]
    with _shuffles_dropped(spark):
        for first, end in zip(ends, ends[1:]):
            if first < end:
                own = placed.filter(f"slot >= {first * per_shard} AND slot < {end * per_shard}").select("slot", "data")
                ordered = own.repartitionById(end - first, F.expr(f"cast(slot div {per_shard} - {first} AS int)")).sortWithinPartitions("slot")
                stored(ordered.select("slot", "data").mapInArrow(write, "shard long, windows long"), "shards")
    name = F.concat(F.lit(f"{target}/shard-"), F.lpad(F.expr(f"slot div {per_shard}").cast("string"), 8, "0"), F.lit(".bin"))
    listed = placed.select("slot", F.explode("pieces").alias("p"))
    return listed.select(F.col("p.id").alias(id_column), "p.start", "p.length", "p.doc_tokens", "slot", "p.offset", name.alias("shard"), "p.ids_crc32")


def read_slots(path: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The ids of `count` slots from `first` on, as a training job reads them: by offset, then straight on."""
    system, folder = _open(path)
    at, end = first, first + count
    while at < end:
        shard, skipped = divmod(at, per_shard)
        n = min(end - at, per_shard - skipped)
        with system.open_input_file(f"{folder}/{shard_name(shard)}") as file:
            file.seek(skipped * _ID * length)
            for _ in range(n):
                yield np.frombuffer(file.read(_ID * length), "<u2")
        at += n
