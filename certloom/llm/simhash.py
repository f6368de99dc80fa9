"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius.

Fingerprints that differ in at most r bits agree on at least 8 - r of their 8 bytes. Each distinct
fingerprint is dealt out once per choice of 8 - r bytes; those that agree on such a choice meet in one
sorted run, where they are compared bit-sliced. A run holds distinct values that differ in r bytes only,
so it has at most 2**(8 r) members (65,536 for r = 2), however large a group of copies is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.components import components
from certloom.llm.runtime import gathered, slices, stored
from certloom.session import broadcast_if_small

WORDS, SEED, RADIUS = 3, 42, 2
_CHUNK = 50_000  # shingles, or pairs of a query and a block, that are held as arrays at a time
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shingles(text: str | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, as little-endian words, some at a time; none if there are no words."""
    parts = (text or "").encode().lower().split()  # of bytes: both know ASCII letters and white space only
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), _CHUNK):
        spans = zip(starts[k : k + _CHUNK].tolist(), ends[k : k + _CHUNK].tolist())
        yield np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of one whole text; 0 if it has no words."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in _shingles(text, words, seed):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def shingle_set(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct shingles of one whole text by hash, ascending."""
    found = list(_shingles(text, words, seed))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for _, texts in slices(batch, "t") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def near_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of one run whose values differ in at most `radius` bits.

    `values` are uint64 (or rows of several), run after run. 64 neighbouring values make a block, held as bit
    planes of one word. A query meets the blocks of its run: each plane is compared with the query's bit in all
    64 lanes at once, and carry-save counters add the differing bits. They start so that they overflow at
    radius + 1; a pair of query and block is given up as soon as all its lanes have.
    """
    n = len(values)
    values = values if values.ndim == 2 else values[:, None]
    width = values.shape[1]
    blocks = -(-n // 64)
    padded = np.zeros((blocks * 64, width), "<u8")
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8 * width), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]
    digits = max(1, radius.bit_length())
    unused = (1 << digits) - 1 - radius
    end_of = np.repeat(ends, ends - starts)
    query = np.arange(n)
    query = query[query + 1 < end_of]
    first = (query + 1) // 64
    spans = (end_of[query] - 1) // 64 - first + 1
    cuts = np.concatenate(([0], np.cumsum(spans)))
    left, right = [], []
    at = 0
    while at < len(query):
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + _CHUNK, side="right")) - 1)
        q = np.repeat(query[at:to], spans[at:to])
        block = np.repeat(first[at:to] - (cuts[at:to] - cuts[at]), spans[at:to]) + np.arange(cuts[to] - cuts[at])
        at = to
        low = np.clip(q + 1 - block * 64, 0, 63).astype(np.uint64)
        high = np.clip(block * 64 + 64 - end_of[q], 0, 63).astype(np.uint64)
        lanes = (_ALL << low) & (_ALL >> high)
        counters = [np.full(len(q), _ALL if unused >> k & 1 else 0, np.uint64) for k in range(digits)]
        over = np.zeros(len(q), np.uint64)
        for bit in range(64 * width):
            carry = planes[bit][block] ^ (np.uint64(0) - ((values[q, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)))
            for counter in counters:
                passed = counter & carry
                counter ^= carry
                carry = passed
            over |= carry
            if bit % 8 == 7:
                alive = (lanes & ~over) != 0
                if not alive.all():
                    q, block, lanes, over, *counters = (x[alive] for x in (q, block, lanes, over, *counters))
        near = np.ascontiguousarray(lanes & ~over)
        pair, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        left.append(q[pair])
        right.append(block[pair] * 64 + lane)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n indexes the least one it is tied to by the pairs."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        both = np.minimum(label[i], label[j])
        np.minimum.at(label, i, both)
        np.minimum.at(label, j, both)
        label = label[label]
        if (label == before).all():
            break
    return label


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links that tie all fingerprints within the radius, from distinct values in column `fp`.

    Within a run only one link per value and class is given, not all pairs.
    """
    masks = [sum(255 << 8 * k for k in kept) for kept in combinations(range(8), 8 - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = prints.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(k).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part")) for k, m in enumerate(signed)])).alias("key")
    ).select("key.choice", "key.part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def ties(choice, part, fp):
            new = np.flatnonzero(np.concatenate(([True], (choice[1:] != choice[:-1]) | (part[1:] != part[:-1]))))
            sizes = np.diff(np.concatenate((new, [len(fp)])))
            values = fp[np.repeat(sizes > 1, sizes)]
            ends = np.cumsum(sizes[sizes > 1])
            i, j = near_pairs(values.view(np.uint64), ends - sizes[sizes > 1], ends, radius)
            label = _least(len(values), i, j)
            tied = label != np.arange(len(values))
            return pa.RecordBatch.from_arrays([pa.array(values[tied]), pa.array(values[label[tied]])], ["a", "b"])

        for batch in batches:
            held = tuple(np.concatenate((h, batch.column(k).to_numpy())) for k, h in enumerate(held))
            choice, part, fp = held
            if len(fp) and (choice[0], part[0]) != (choice[-1], part[-1]):
                # The last run may go on in the next batch.
                last = int(np.flatnonzero((choice != choice[-1]) | (part != part[-1]))[-1]) + 1
                yield ties(choice[:last], part[:last], fp[:last])
                held = choice[last:], part[last:], fp[last:]
        if len(held[2]):
            yield ties(*held)

    return dealt.repartition("choice", "part").sortWithinPartitions("choice", "part", "fp").mapInArrow(run, "a long, b long")


def _classes(rows: DataFrame, distinct: DataFrame, tied: DataFrame, most: int) -> DataFrame:
    """`rows` with component_id, the least `first` of the component that the links give their `node`."""
    roots = components(tied, most=most).withColumnRenamed("node", "of")
    named = distinct.join(roots, F.col("node") == F.col("of"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("node", "component_id"), "node")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (16 hex digits), component_id (least id reachable by links).

    Null and empty texts have fingerprint zero and are linked like any other. A repeated id gives a row each
    time. Null ids get the least id of their component, null if it has none. Other columns are not looked at.
    """
    prints = stored(fingerprints(docs, id_column, text_column), "prints")
    nodes = prints.withColumnRenamed("fp", "node")
    distinct = nodes.groupBy("node").agg(F.min(id_column).alias("first"))
    # A value has at most one link in each of its runs.
    most = prints.count() * comb(8, radius)
    classes = _classes(nodes, distinct, links(distinct.select(F.col("node").alias("fp")), radius), most)
    return classes.select(id_column, F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` without near-duplicates (`near_duplicates`): of each component one row stays.

    That is the row with the least id, rows without an id last, and of rows with one id the one with the least text
    hash. So rows with one id and texts that are not linked all stay, and of equal rows one.
    """
    row = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("h"), F.col(text_column).alias("t"))
    own = F.struct(F.col("id").isNull().alias("last"), "id", "h")
    prints = stored(fingerprints(row.select(own.alias("own"), "t"), "own", "t").withColumnRenamed("fp", "node"), "prints")
    rows = prints.count()
    distinct = stored(gathered(prints.groupBy("node").agg(F.min("own").alias("first")), rows), "distinct")
    classes = _classes(prints, distinct, links(distinct.select(F.col("node").alias("fp")), radius), rows * comb(8, radius))
    # A row is known by its id and its text's hash; those that go are mostly fewer than those that stay.
    same = classes.groupBy("own").agg(F.min("component_id").alias("kept"), F.count(F.lit(1)).alias("m")).where("own <> kept OR m > 1")
    same = stored(gathered(same.select("own.id", "own.h", (F.col("own") == F.col("kept")).alias("stays")), rows), "same")
    lost, again = same.where("NOT stays"), same.where("stays")

    def among(rows: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
        side = broadcast_if_small(chosen.select("id", "h"), F.lit(32)).alias("r")
        return rows.alias("d").join(side, F.col(f"d.{id_column}").eqNullSafe(F.col("r.id")) & (F.xxhash64(f"d.{text_column}") == F.col("r.h")), how)

    kept = among(docs, lost, "left_anti")
    if again.isEmpty():
        return kept
    # Rows of one id and one text: one of them stays, the first by their other columns.
    rank, rest = "_".join(["rank", *docs.columns]), [F.col(c) for c in docs.columns]
    first = F.row_number().over(Window.partitionBy(F.col(id_column), F.xxhash64(text_column)).orderBy(*rest))
    once = among(kept, again, "left_semi").withColumn(rank, first).where(F.col(rank) == 1).select(*docs.columns)
    return among(kept, again, "left_anti").unionByName(once)
