"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often corpus-wide.

All documents of a batch are merged at once: a state vector holds for every document the next token of either
tokenizer. A step compares the byte ends under all pointers, moves the one that lies behind (both, where they are
equal), and emits a cut with the tokens since the cut before it, all of which are linked. Finished documents leave
the vector. Counts of linked id pairs are added up over all documents; a document then meets the frequent pairs
in a table of bounded size, and the others by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm import byte_ids
from certloom.llm.runtime import slices, stored

PIECES = "piece_bpe_32k.model"
SLICE = 2_000_000  # characters that are merged together
CACHE = 300_000  # words kept per Python worker, some 60 MB
FREQUENT = 1 << 20  # pairs at most that every task gets whole, at 17 bytes each
_WIDE = 4096  # links of one group beyond which equal ids are counted before they are paired


class Pair:
    """Both tokenizers, with the byte lengths and printed forms of their ids.

    No token of either reaches over a single space between other characters, so a text without leading, closing and
    repeated spaces is its words, each with the space before it. Words repeat: their ids are kept in a bounded
    table, and the words that a slice does not know yet are encoded in one call, laid end to end.
    """

    def __init__(self, a: str = byte_ids.NAME, b: str = PIECES):
        self.plain = byte_ids.Encoder(a).plain
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        ranks = {i: spelt for spelt, i in self.plain._mergeable_ranks.items()}
        ids = range(self.model.get_piece_size())
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ids, map(self.model.id_to_piece, ids))]
        self.a_sizes = np.array([len(ranks.get(k, b"")) for k in range(max(ranks) + 1)], np.int64)
        self.b_sizes = np.array([len(p) for p in self.b_bytes], np.int64)
        na, nb = len(self.a_sizes), len(self.b_sizes)
        shown = [str(k) for k in range(max(na, nb))]
        # An id within its side, at the end of A's side, within the other side, at the end of a group.
        self.shown = [s + "," for s in shown[:na]] + [s + "|" for s in shown[:na]] + [s + "," for s in shown[:nb]] + [s + ";" for s in shown[:nb]]
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64)] * 2
        self.cuts = [np.zeros(1, np.int64)] * 2  # where each word's ids begin, and the end

    def _spelt(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for a whole text, None if either does not spell it with a space before it."""
        b = self.model.encode(text)
        want = b" " + text.encode()
        if b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        a = np.array(self.plain.encode_ordinary(" " + text), np.int64)
        return (a, np.array(b, np.int64)) if self.a_sizes[a].sum() == len(want) else None

    def _counted(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids end to end, ids of each word) of A and of B; words that are not spelt for themselves have none."""
        together = self._spelt(" ".join(words))
        if together is not None:
            ends = np.cumsum([len(w.encode()) + 1 for w in words])
            pieces = zip(together, (self.a_sizes, self.b_sizes))
            return [(ids, np.diff(np.searchsorted(np.cumsum(sizes[ids]), ends) + 1, prepend=0)) for ids, sizes in pieces]
        if len(words) == 1:
            return [(np.zeros(0, np.int64), np.zeros(1, np.int64))] * 2
        half = len(words) // 2
        return [tuple(map(np.concatenate, zip(x, y))) for x, y in zip(self._counted(words[:half]), self._counted(words[half:]))]

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of unknown words."""
        if len(self.index) > CACHE:
            self._forget()
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        for k, (ids, counts) in enumerate(self._counted(words)):
            self.cuts[k] = np.concatenate((self.cuts[k], len(self.ids[k]) + np.cumsum(counts)))
            self.ids[k] = np.concatenate((self.ids[k], ids))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts end to end, ids of each text) of A and of B; a text that either does not spell has none."""
        words, counts, whole = [], np.zeros(len(texts), np.int64), {}
        for k, text in enumerate(texts):
            own = text.split(" ")
            if "" in own:
                whole[k] = self._spelt(text) if text else None
            else:
                words += own
                counts[k] = len(own)
        unknown = set(words).difference(self.index)
        if unknown:
            if len(self.index) > CACHE:
                unknown = set(words)
            self._learn(list(unknown))
        code = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        text_of = np.repeat(np.arange(len(texts)), counts)
        lengths = [self.cuts[k][code + 1] - self.cuts[k][code] for k in (0, 1)]
        # A word that is not spelt for itself may be so within its text.
        for k in np.unique(text_of[lengths[0] == 0]).tolist():
            whole[k] = self._spelt(texts[k])
        found = []
        for k in (0, 1):
            n = lengths[k]
            at = np.repeat(self.cuts[k][code] - np.cumsum(n) + n, n) + np.arange(n.sum())
            ids, size = self.ids[k][at], np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64)
            if whole:
                parts = np.split(ids, np.cumsum(size)[:-1])
                for j, spelt in whole.items():
                    parts[j] = spelt[k] if spelt else ids[:0]
                ids, size = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            found.append((ids, size))
        return found


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(a: str, b: str) -> Pair:
    """One pair per Python worker and files."""
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first A token, last A token, first B token, last B token) of every group, in order.

    `ends` are the byte ends of all documents' tokens, laid end to end, so that a document's last ends are equal
    in both; `counts` are the tokens of each document.
    """
    stop = np.cumsum(counts_a)
    a, b = stop - counts_a, np.cumsum(counts_b) - counts_b
    live = counts_a > 0
    a, b, stop = a[live], b[live], stop[live]
    from_a, from_b = a.copy(), b.copy()
    emitted: list[tuple[np.ndarray, ...]] = []
    while len(a):
        at_a, at_b = ends_a[a], ends_b[b]
        cut = np.flatnonzero(at_a == at_b)
        if len(cut):
            emitted.append((from_a[cut], a[cut], from_b[cut], b[cut]))
            from_a[cut], from_b[cut] = a[cut] + 1, b[cut] + 1
        a += at_a <= at_b
        b += at_b <= at_a
        if len(cut) and (a[cut] == stop[cut]).any():
            live = a < stop
            a, b, stop, from_a, from_b = a[live], b[live], stop[live], from_a[live], from_b[live]
    if not emitted:
        return (np.zeros(0, np.int64),) * 4
    columns = [np.concatenate(c) for c in zip(*emitted)]
    order = np.argsort(columns[0])
    return tuple(c[order] for c in columns)


def _linked(groups: tuple[np.ndarray, ...], ids_a: np.ndarray, ids_b: np.ndarray, owner: np.ndarray, width: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner x span + pair, links), ascending and each once, of all groups; `owner` is a group's document."""
    first_a, last_a, first_b, last_b = groups
    size_b = last_b - first_b + 1
    links = (last_a - first_a + 1) * size_b
    small = links <= _WIDE
    n = np.where(small, links, 0)
    group = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    of_b = size_b[group]
    keys = [owner[group] * span + ids_a[first_a[group] + k // of_b] * width + ids_b[first_b[group] + k % of_b]]
    weights = [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(~small):
        a, many_a = np.unique(ids_a[first_a[g] : last_a[g] + 1], return_counts=True)
        b, many_b = np.unique(ids_b[first_b[g] : last_b[g] + 1], return_counts=True)
        keys.append((owner[g] * span + a[:, None] * width + b).ravel())
        weights.append((many_a[:, None] * many_b).ravel())
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    if not len(keys):
        return keys, weights
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(weights, new)


def aligned(texts: list[str], pair: Pair) -> list[np.ndarray | list]:
    """Per text: n_a, n_b, n_groups, n_links, the groups as text; and the id pairs of all texts with where each begins."""
    (ids_a, counts_a), (ids_b, counts_b) = pair.encode(texts)
    ends = (np.cumsum(sizes[ids]).astype(np.int32) for sizes, ids in ((pair.a_sizes, ids_a), (pair.b_sizes, ids_b)))
    groups = lockstep(*ends, counts_a, counts_b)
    first_a, last_a, first_b, last_b = groups
    owner = np.searchsorted(np.cumsum(counts_a), first_a, side="right")
    n_groups = np.bincount(owner, minlength=len(texts))
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, owner, (last_a - first_a + 1) * (last_b - first_b + 1))
    # A group's tokens stand after all tokens of the groups before it, those of A first.
    na, nb = len(pair.a_sizes), len(pair.b_sizes)
    group_a = np.repeat(np.arange(len(first_a)), last_a - first_a + 1)
    group_b = np.repeat(np.arange(len(first_a)), last_b - first_b + 1)
    form = np.zeros(len(ids_a) + len(ids_b), np.int64)
    form[np.arange(len(ids_a)) + first_b[group_a]] = ids_a
    form[np.arange(len(ids_b)) + last_a[group_b] + 1] = ids_b + 2 * na
    form[last_a + first_b] += na
    form[last_b + last_a + 1] += nb
    ends = np.cumsum(counts_a + counts_b)
    spelt = []
    for s, e in zip((ends - counts_a - counts_b).tolist(), ends.tolist()):
        spelt.append("".join(map(pair.shown.__getitem__, form[s:e].tolist()))[:-1])
    span = na * nb
    keys, weights = _linked(groups, ids_a, ids_b, owner, nb, span)
    starts = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
    return [counts_a, counts_b, n_groups, n_links, spelt, keys % span, weights, starts]


def alignments(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", a: str = byte_ids.NAME, b: str = PIECES, with_groups: bool = False) -> DataFrame:
    """One row per row of `docs`: row, id, n_a, n_b, n_groups, n_links, groups_sha256, its linked id pairs (`a` id x size
    of `b` + `b` id, as little-endian unsigned 64-bit) with the links of each, and the groups as text if asked for."""
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links", *(["groups"] if with_groups else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        for batch in batches:
            # Texts of like length go together, so that a slice does not wait for its longest.
            batch = batch.take(pa.compute.sort_indices(pa.compute.binary_length(batch.column("t"))))
            for first, texts in slices(batch, "t", SLICE):
                *counts, spelt, keys, links, starts = aligned(texts, pair)
                cut = [(int(s), int(e)) for s, e in zip(starts[:-1], starts[1:])]
                digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelt]
                packed = [pa.array([x[s:e].astype(kind).tobytes() for s, e in cut], pa.binary()) for x, kind in ((keys, "<u8"), (links, "<u4"))]
                own = [batch.column(c).slice(first, len(texts)) for c in ("row", "id")]
                shown = [pa.array(spelt, pa.string())] if with_groups else []
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, counts), pa.array(digests, pa.string()), *packed, *shown], names)

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("t"))
    kinds = [T.LongType(), source.schema["id"].dataType, *[T.LongType()] * 4, T.StringType(), T.BinaryType(), T.BinaryType(), T.StringType()]
    return source.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): how many documents hold the pair linked, and whether no pair of the same `a` id is held by more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(np.frombuffer(b"".join(batch.column("pairs").to_pylist()), "<u8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "m"])

    counts = stored(found.select("pairs").mapInArrow(run, "pair long, m long").groupBy("pair").agg(F.sum("m").alias("n")), "pairs")
    counts = counts.withColumn("a", F.expr(f"pair div {width}"))
    # One row per id of a vocabulary.
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent_from(counts: DataFrame, bound: int) -> int:
    """The least power of two that at most `bound` pairs reach."""
    held, least = 0, 1 << 62
    for r in sorted(counts.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count(F.lit(1)).alias("m")).collect(), reverse=True):
        held += r["m"]
        if held > bound:
            break
        least = 1 << r["e"]
    return least


def align(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", a: str = byte_ids.NAME, b: str = PIECES, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of `docs`: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair no other pair of the same A id exceeds in documents, ties included;
    count_sum adds up the documents of each link's pair. Texts that are null or empty, or that either tokenizer does
    not spell, have no tokens: zeros and an empty digest. Repeated rows are documents each, also in the counts,
    and null or repeated ids do not matter. Other columns are not looked at.

    Pairs in many documents, at most `frequent` of them, are looked up in each task; a document's other pairs are
    shuffled to their counts, and each of those has fewer documents than any frequent pair.
    """
    width = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b)).get_piece_size()
    found = stored(alignments(docs, id_column, text_column, a, b), "aligned")
    counts = stored(pair_counts(found, width), "counts")
    least = _frequent_from(counts, frequent)
    often = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    table = docs.sparkSession.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("pair", "n", "best")))
    kept = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    extra = {"n_best": "long", "count_sum": "long", "pair": "long", "links": "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_n, known_best = table.value
        for batch in batches:
            parts = batch.column("pairs").to_pylist()
            row = np.repeat(np.arange(len(parts)), [len(p) // 8 for p in parts])
            pairs = np.frombuffer(b"".join(parts), "<u8").astype(np.int64)
            links = np.frombuffer(b"".join(batch.column("links").to_pylist()), "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            at = at[hit]
            sums = []
            for value in (known_best[at] * links[hit], known_n[at] * links[hit]):
                total = np.zeros(len(parts), np.int64)
                np.add.at(total, row[hit], value)
                sums.append(pa.array(total))
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *sums, none, none], [*kept, *extra])
            rest = np.flatnonzero(~hit)
            if len(rest):
                blank = [pa.nulls(len(rest), batch.schema.field(c).type) for c in kept[1:]]
                rows = batch.column("row").take(pa.array(row[rest]))
                nothing = pa.nulls(len(rest), pa.int64())
                yield pa.RecordBatch.from_arrays([rows, *blank, nothing, nothing, pa.array(pairs[rest]), pa.array(links[rest])], [*kept, *extra])

    schema = T.StructType([f for f in found.schema.fields if f.name in kept] + [T.StructField(n, T.LongType()) for n in extra])
    scored = stored(found.select(*kept, "pairs", "links").mapInArrow(run, schema), "scored")
    rare = (
        scored.where("pair IS NOT NULL")
        .select("row", "pair", "links")
        .join(counts.where(F.col("n") < least), "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more"))
    )
    sums = [(F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more"))]
    rows = scored.where("pair IS NULL").join(rare, "row", "left")
    return rows.select(F.col("id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")
