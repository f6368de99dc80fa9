"""Similarity join of documents by the Jaccard similarity of their word-shingle sets, exact and size-aware.

Small sets are joined by enumeration: two sets of a and b shingles are similar if and only if they have a subset of
`least_common(a, b)` shingles in common, so each small set lists its subsets of the few sizes that its partners can
ask for, and a shared subset proves the link. Large sets have too many subsets. They are joined by inverted lists,
which are scanned for pairs: the lists are of slices of a set, not of single shingles, so a passage that many
documents share makes no long list. Similar sets differ in at most D shingles, so of D + 1 slices of the shingle space
one holds the same shingles in both. The size at which enumeration ends is where it stops being cheaper than the lists
would be, by the cost of both measured over all small sets.

Pairs on a list are told apart by parity sketches (a bit is the parity of the shingles that fall on it): differing bits
are never more than differing shingles, so this loses no pair. What passes is checked with the whole sets. A list first gives
the edges of a spanning forest, then, when those are checked and tied, all pairs that are still in different classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.components import components
from certloom.llm.runtime import slices, stored
from certloom.llm.simhash import shingle_set
from certloom.session import broadcast_if_small

WORDS, PERCENT = 3, 90
SMALL = 39  # sizes up to this may be enumerated, if that is cheaper; a set of 39 has some 9,000 subsets to list
SKETCH = 2048  # bits
BLOCK = 512  # members of a list that are compared with as many others in one place
MET = 4_000_000  # rows of 16 bytes that may be broadcast, after counting
_SEED = 42
_CELLS = 1 << 21  # words held as an array at a time


def least_common(a, b, percent: int = PERCENT):
    """The least intersection of similar sets of `a` and `b` members."""
    return -(-percent * (a + b) // (100 + percent))


def most_different(a, b, percent: int = PERCENT):
    """The most members that only one of two similar sets has."""
    return a + b - 2 * least_common(a, b, percent)


@cache
def bands(percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(least size, slices) of each band of sizes: sets of one band have partners in it and the bands next to it only."""
    lows = [1]
    while lows[-1] < 1 << 33:
        lows.append(100 * lows[-1] // percent + 1)
    parts = [1]
    for k in range(1, len(lows) - 1):
        most = 2 * (lows[k + 1] - 1)
        total = np.arange(max(2, most - 400), most + 1)
        parts.append(int(most_different(total, 0, percent).max()) + 1)
    return np.array(lows[:-1]), np.array(parts)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slices(hashes: np.ndarray, parts: int, way: int) -> tuple[np.ndarray, np.ndarray]:
    """Per slice: sum of the mixed shingles in it, and whether there are any."""
    mixed = _mix(hashes + np.uint64(way))
    part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    total, full = np.zeros(parts, np.uint64), np.zeros(parts, bool)
    total[part[new]] = np.add.reduceat(mixed[order], new)
    full[part[new]] = True
    return total, full


def list_keys(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The lists a set is on: its slices in its own band and in the next, where sets of both meet.

    An empty slice says little, so it is joined with each slice of a second division: sets with the same empty
    slice agree in one of those, too.
    """
    lows, parts = bands(percent)
    if not len(hashes):
        return np.zeros(0, np.int64)
    own, found = int(np.searchsorted(lows, len(hashes), side="right")) - 1, []
    for band in (own, own + 1):
        n = int(parts[band])
        if n == 1:  # only equal sets are similar here
            continue
        total, full = _slices(hashes, n, 1)
        tag = np.uint64(band) << np.uint64(48)
        found.append(_mix(total[full] + (tag | np.flatnonzero(full).astype(np.uint64))))
        for empty in np.flatnonzero(~full).tolist():
            second, _ = _slices(hashes, n, 2)
            mark = tag | np.uint64(empty + 1) << np.uint64(24)
            found.append(_mix(second + (mark | np.arange(n, dtype=np.uint64))))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)).view(np.int64)


def parity_sketch(hashes: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    at = (_mix(hashes + np.uint64(3)) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little")


def _prints(docs: DataFrame, id_column: str, text_column: str, words: int, percent: int) -> DataFrame:
    """(id, th, node, n, keys, small): hash of the text, hash and size of the set, its lists, and itself if it is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch, "t"):
                sets = [shingle_set(t, words) for t in texts]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), _SEED) for s in sets], np.uint64).view(np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                lists = []
                for made in ([list_keys(s, percent) for s in sets], [s.view(np.int64) if len(s) <= SMALL else s[:0].view(np.int64) for s in sets]):
                    ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(made))))
                own = [batch.column(c).slice(first, len(texts)) for c in ("id", "th")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(nodes), pa.array(sizes), *lists], ["id", "th", "node", "n", "keys", "small"])

    source = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), F.col(text_column).alias("t"))
    many = T.ArrayType(T.LongType())
    kinds = {"id": source.schema["id"].dataType, "th": T.LongType(), "node": T.LongType(), "n": T.LongType(), "keys": many, "small": many}
    return source.mapInArrow(run, T.StructType([T.StructField(c, k) for c, k in kinds.items()]))


# --- Small sets ---


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a set of `n` shares with its similar partners, whatever their size.

    None if only an equal set is similar: equal sets are one.
    """
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    sizes = {c for b in partners if (c := least_common(n, b, percent)) <= min(n, b)}
    return sorted(sizes) if any(most_different(n, b, percent) > 0 for b in partners) else []


def boundary(distinct: DataFrame, percent: int = PERCENT) -> int:
    """The greatest size to enumerate: where subsets of all smaller sets and lists of all others cost least together.

    Enumeration costs a row per subset. Lists cost a row per entry, and for each other set that an entry meets the
    shingles to compare. Both are added up over all sets of up to SMALL shingles; at most SMALL rows reach the driver.
    """
    entries = distinct.where(F.col("n") <= SMALL).select("n", F.explode("keys").alias("key"))
    per_list = entries.groupBy("key", "n").agg(F.count(F.lit(1)).alias("m"))
    whole = per_list.groupBy("key").agg(F.sum("m").alias("whole"))
    scanned = per_list.join(whole, "key").groupBy("n").agg(F.sum("m").alias("entries"), F.sum(F.col("m") * (F.col("whole") - 1)).alias("met"))
    sets = distinct.where(F.col("n") <= SMALL).groupBy("n").agg(F.count(F.lit(1)).alias("sets"))
    rows = {r["n"]: r for r in sets.join(scanned, "n", "left").collect()}

    def enumerated(n: int) -> int:
        return rows[n]["sets"] * sum(comb(n, c) for c in subset_sizes(n, percent))

    def listed(n: int) -> int:
        return (rows[n]["entries"] or 0) + n * (rows[n]["met"] or 0)

    def cost(x: int) -> int:
        return sum(enumerated(n) for n in rows if n <= x) + sum(listed(n) for n in rows if n >= _listed_from(x, percent))

    return min(reversed(range(SMALL + 1)), key=cost)  # of equal costs the greatest


def _listed_from(x: int, percent: int) -> int:
    """The least size that can have a partner beyond `x`, so is on the lists."""
    return -(-percent * (x + 1) // 100)


def subset_links(distinct: DataFrame, x: int, percent: int = PERCENT) -> DataFrame:
    """(a, b) links that tie all similar sets of up to `x` shingles.

    Members of one list have `c` shingles in common. If two of them are similar, so is each of them to the
    smallest member, which therefore ties them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = {}
        for batch in batches:
            found: list[tuple] = []
            for node, n, members in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "small"))):
                own = np.array(members, np.int64)
                for c in subset_sizes(n, percent):
                    if (n, c) not in chosen:
                        chosen[n, c] = np.array(list(combinations(range(n), c)), np.int64)
                    for row in own[chosen[n, c]]:
                        found.append((xxhash.xxh64_intdigest(row.tobytes(), _SEED) - (1 << 63), c, node, n))
            columns = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "c", "node", "n"])

    small = distinct.where(F.col("n") <= x).select("node", "n", "small")
    subsets = stored(small.mapInArrow(run, "key long, c long, node long, n long"), "subsets")
    least = subsets.groupBy("key", "c").agg(F.min(F.struct("n", "node")).alias("least"))
    common = F.col("c") * 100 >= percent * (F.col("n") + F.col("least.n") - F.col("c"))
    return subsets.join(least, ["key", "c"]).where(common & (F.col("node") != F.col("least.node"))).select(F.col("node").alias("a"), F.col("least.node").alias("b"))


# --- Large sets ---


def shared_lists(distinct: DataFrame, least: int) -> DataFrame:
    """(key, node, m) of the lists with more than one member, `m`, of sets of `least` shingles or more."""
    entries = distinct.where(F.col("n") >= least).select("node", F.explode("keys").alias("key"))
    counts = stored(entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "lists")
    return entries.join(broadcast_if_small(counts, F.lit(16), max_rows=MET), "key").select("key", "node", "m")


def _sets(docs: DataFrame, met: DataFrame, text_column: str, words: int) -> DataFrame:
    """(node, n, grams, sketch) of the sets in `met` (node, th): their texts are read once more and cut again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "t"):
                sets = [shingle_set(t, words) for t in texts]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), _SEED) for s in sets], np.uint64).view(np.int64)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                grams = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                sketches = pa.array([parity_sketch(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), grams, sketches], ["node", "n", "grams", "sketch"])

    texts = docs.select(F.xxhash64(text_column).alias("th"), F.col(text_column).alias("t"))
    chosen = texts.join(broadcast_if_small(met.select("th"), F.lit(16), max_rows=MET), "th", "left_semi").dropDuplicates(["th", "t"])
    return chosen.mapInArrow(run, "node long, n long, grams array<long>, sketch binary")


def near_in_list(values: np.ndarray, n: np.ndarray, root: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of members of different roots that may be similar: no similar pair is left out."""
    counts = np.unique(root, return_inverse=True, return_counts=True)
    asks = counts[1] != counts[2].argmax()  # members of the greatest class need not meet each other
    queries, every = np.flatnonzero(asks), np.arange(len(n))
    left, right = [], []
    step = max(1, _CELLS // (4 * len(n)))
    for k in range(0, len(queries), step):
        q = queries[k : k + step]
        a, b = n[q][:, None], n[None]
        most = most_different(a, b, percent)
        near = (root[q][:, None] != root[None]) & (~asks[None] | (every[None] > q[:, None])) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        near &= np.bitwise_count(values[q][:, None, :4] ^ values[None, :, :4]).sum(2, dtype=np.int64) <= most
        i, j = np.nonzero(near)
        for s in range(0, len(i), _CELLS // values.shape[1]):
            x, y = q[i[s : s + _CELLS // values.shape[1]]], j[s : s + _CELLS // values.shape[1]]
            kept = np.bitwise_count(values[x] ^ values[y]).sum(1, dtype=np.int64) <= most_different(n[x], n[y], percent)
            left.append(x[kept])
            right.append(y[kept])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def spanning_forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Indexes of edges that tie what all edges tie, each chosen as the first to leave its tree; `label` are the trees."""
    label, chosen, edge = label.copy(), [], np.arange(len(i))
    while len(edge):
        a, b = label[i[edge]], label[j[edge]]
        open_edges = a != b
        edge, a, b = edge[open_edges], a[open_edges], b[open_edges]
        first = np.full(len(label), len(i))
        np.minimum.at(first, a, edge)
        np.minimum.at(first, b, edge)
        picked = np.unique(first[first < len(i)])
        chosen.append(picked)
        tie_a, tie_b = label[i[picked]], label[j[picked]]
        to = np.arange(len(label))
        while len(picked):
            before = to.copy()
            both = np.minimum(to[tie_a], to[tie_b])
            np.minimum.at(to, tie_a, both)
            np.minimum.at(to, tie_b, both)
            to = to[to]
            if (to == before).all():
                break
        label = to[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def list_pairs(shared: DataFrame, sets: DataFrame, roots: DataFrame | None, forest: bool, percent: int = PERCENT) -> DataFrame:
    """(a, b) pairs to check. A long list is cut into blocks by hash, and every pair of blocks is compared on its own."""
    members = shared.join(sets.select("node", "n", "sketch"), "node")
    if roots is None:
        members = members.withColumn("root", F.col("node"))
    else:
        members = members.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node")).drop("of")
        # Lists within one class are done.
        mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        members = members.join(mixed, "key")
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("node"), blocks)
    dealt = members.select("key", "node", "n", "sketch", "root", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "n", "sketch", "root")

    def pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, low, high, node, n, root = (rows.column(c).to_numpy() for c in ("key", "low", "high", "node", "n", "root"))
        values = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "<u8").reshape(len(node), -1)
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        for s, e in zip(new.tolist(), [*new[1:].tolist(), len(node)]):
            if e - s > 1:
                trees = np.unique(root[s:e], return_inverse=True)[1]
                if trees.max():
                    i, j = near_in_list(values[s:e], n[s:e], trees, percent)
                    if forest:
                        kept = spanning_forest(trees, i, j)
                        i, j = i[kept], j[kept]
                    yield node[s + i], node[s + j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = ["key", "low", "high", "node", "n", "sketch", "root"]

        def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for a, b in pairs(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(names)
            held = pa.concat_tables([held, rows]) if held is not None else rows
            key, low, high = (held.column(c).to_numpy() for c in names[:3])
            other = np.flatnonzero((key != key[-1]) | (low != low[-1]) | (high != high[-1]))
            if len(other):  # the last group may go on in the next rows
                yield from told(held.slice(0, int(other[-1]) + 1).combine_chunks())
                held = held.slice(int(other[-1]) + 1).combine_chunks()
        if held is not None and len(held):
            yield from told(held.combine_chunks())

    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node").mapInArrow(run, "a long, b long").distinct()


def checked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The `pairs` whose whole sets are similar."""
    a, b = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    together = F.size("grams_a") + F.size("grams_b") - F.col("common")
    found = pairs.join(a, "a").join(b, "b").withColumn("common", both)
    return found.where(F.col("common") * 100 >= together * percent).select("a", "b")


def similar_sets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the least id reachable by links, itself included).

    Documents are linked when the Jaccard similarity of their sets of `words`-word shingles is `percent` in a hundred
    or more; with fewer words the whole sequence is the one shingle. Texts that are null or have no words have an empty
    set, are linked with nothing, and are their own component. Equal sets are one node, so copies meet nobody a second
    time. Repeated ids give a row each time; rows without id take the least id of their component, null if it has none.
    Other columns are not looked at. Sets and shingles are told apart by 64-bit hashes.
    """
    prints = stored(_prints(docs, id_column, text_column, words, percent), "prints")
    same = [F.first(c).alias(c) for c in ("n", "keys", "small")]
    distinct = stored(prints.where("n > 0").groupBy("node").agg(F.min("id").alias("first"), F.min("th").alias("th"), *same), "distinct")
    x = boundary(distinct, percent)
    shared = stored(shared_lists(distinct, _listed_from(x, percent)), "shared")
    met = stored(distinct.join(shared.select("node").distinct(), "node", "left_semi").select("node", "th"), "met")
    sets = stored(_sets(docs, met, text_column, words), "sets")
    # Most lists have two members, which need no comparing on the list; a pair is mostly on several.
    longer = shared.where("m > 2")
    twos = shared.where("m = 2").groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b")
    pairs = twos.union(list_pairs(longer, sets, None, True, percent)).distinct()
    links = stored(checked(pairs, sets, percent).union(subset_links(distinct, x, percent)), "links")
    more = stored(checked(list_pairs(longer, sets, components(links, most=links.count()), False, percent), sets, percent), "links")
    both = links.union(more)
    roots = components(both, most=both.count()).withColumnRenamed("node", "of")
    named = distinct.select("node", "first").join(roots, F.col("node") == F.col("of"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    classes = named.join(least, "root").select(F.col("node").alias("of"), "component")
    rows = prints.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(classes, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"))
