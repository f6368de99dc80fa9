"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its evidence is its own shape and that of the lines next to it, and neighbouring
labels depend on each other. The score of a document is the mean of its lines' forward-backward marginals of
"good", weighted by their lengths. The field is trained on documents whose label all of their lines take.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.runtime import slices

PER_LABEL = 1500  # documents per label that the field is trained on, by hash of the id
THRESHOLD = 0.3
STEPS, RATE, RIDGE = 150, 0.1, 1e-3

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _BAR, _SIGN, _OTHER = range(8)


def _classes() -> np.ndarray:
    """Character class of each code point of the basic plane."""
    table = np.full(1 << 16, _OTHER, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isspace():
            table[code] = _SPACE
        elif c.isupper():
            table[code] = _UPPER
        elif c.isalpha():
            table[code] = _LOWER
        elif c.isdigit():
            table[code] = _DIGIT
    for group, kind in ((".,;:?'\"()-", _STOP), ("|\t", _BAR), ("!#$%&*+/<=>@[\\]^_`{}~", _SIGN)):
        for c in group:
            table[ord(c)] = kind
    return table


_TABLE = _classes()
# Steps at which a share counts as high, per class of characters; shares of distinct words and lengths likewise.
_CUTS = {_UPPER: (0.08, 0.3, 0.6), _DIGIT: (0.05, 0.2), _STOP: (0.01, 0.05, 0.12), _BAR: (0.01, 0.05), _SIGN: (0.02, 0.08, 0.2), _OTHER: (0.1,), _SPACE: (0.05, 0.3)}
_DISTINCT, _WORD, _CHARS = (0.3, 0.5, 0.7, 0.9), (2.0, 4.0, 7.0, 12.0), (1, 20, 60, 200, 800)
OWN = sum(map(len, _CUTS.values())) + len(_DISTINCT) + len(_WORD) + len(_CHARS) + 1
FEATURES = 3 * OWN + 3  # own, previous, next; first line, last line, constant


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, characters per line, first line of each text). An empty text is one empty line."""
    lines = [line for t in texts for line in t.split("\n")]
    counts = np.array([t.count("\n") + 1 for t in texts])
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _TABLE[np.minimum(chars, 0xFFFF)]
    starts = np.cumsum(sizes + 1) - sizes - 1
    whole = np.maximum(sizes, 1)
    own, at = np.zeros((len(lines), OWN), np.float32), 0
    for kind, cuts in _CUTS.items():
        n = np.add.reduceat((kinds == kind).astype(np.int32), starts)
        share = (n - (kind == _SPACE)) / whole  # the line's end was counted as a space
        for cut in cuts:
            own[:, at] = share > cut
            at += 1
    words = [line.split() for line in lines]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(words)) / np.maximum(n_words, 1)
    for value, cuts in ((np.where(n_words > 3, distinct, 1.0), _DISTINCT), (sizes / np.maximum(n_words, 1), _WORD), (sizes, _CHARS)):
        for cut in cuts:
            own[:, at] = value > cut
            at += 1
    same = np.zeros(len(lines), bool)
    same[1:] = [a == b for a, b in zip(lines, lines[1:])]
    same[firsts] = False
    own[:, at] = same
    found = np.zeros((len(lines), FEATURES), np.float32)
    found[:, :OWN] = own
    found[1:, OWN : 2 * OWN] = own[:-1]
    found[:-1, 2 * OWN : 3 * OWN] = own[1:]
    lasts = firsts + counts - 1
    found[firsts, OWN : 2 * OWN] = 0
    found[lasts, 2 * OWN : 3 * OWN] = 0
    found[firsts, -3] = 1
    found[lasts, -2] = 1
    found[:, -1] = 1
    return found, sizes, firsts


@dataclass(frozen=True)
class Field:
    """Weights of the evidence for "good", and log potentials [previous label, label] of neighbouring lines."""

    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, evidence: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) per line, and the expected label pairs [previous, next] of each document.

        All documents advance together, longest first, so a step works on those that still have lines.
        """
        unary = np.zeros((len(evidence), 2))
        unary[:, 1] = evidence @ self.weights
        lengths = np.diff(np.append(firsts, len(evidence)))
        order = np.argsort(-lengths, kind="stable")
        first, length = firsts[order], lengths[order]
        steps = int(length[0]) if len(length) else 0
        going = np.searchsorted(-length, -np.arange(steps), side="left")  # documents with more than t lines
        ahead, behind = np.zeros_like(unary), np.zeros_like(unary)
        for t in range(steps):
            rows = first[: going[t]] + t
            if t:
                before = ahead[rows - 1]
                ahead[rows] = unary[rows] + np.logaddexp(before[:, :1] + self.moves[0], before[:, 1:] + self.moves[1])
            else:
                ahead[rows] = unary[rows]
        pairs = np.zeros((len(firsts), 2, 2))
        for t in reversed(range(steps - 1)):
            rows = first[: going[t + 1]] + t
            later = unary[rows + 1] + behind[rows + 1]
            behind[rows] = np.logaddexp(later[:, :1] + self.moves[:, 0], later[:, 1:] + self.moves[:, 1])
            joint = ahead[rows][:, :, None] + self.moves + later[:, None, :]
            joint -= np.logaddexp.reduce(joint.reshape(len(rows), 4), axis=1)[:, None, None]
            pairs[order[: len(rows)]] += np.exp(joint)
        both = ahead + behind
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pairs

    def scores(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the marginals of each text."""
        evidence, sizes, firsts = features(texts)
        good, _ = self.marginals(evidence, firsts)
        weights = sizes + 1.0
        return np.clip(np.add.reduceat(good * weights, firsts) / np.add.reduceat(weights, firsts), 0.0, 1.0)


def learn(evidence: np.ndarray, firsts: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum likelihood by Adam, each document and each label with equal weight; `labels` per document."""
    lengths = np.diff(np.append(firsts, len(evidence)))
    n = np.array([max((labels == 0).sum(), 1), max((labels == 1).sum(), 1)])
    weight = 1 / (2 * n[labels] * lengths)
    line = np.repeat(np.arange(len(firsts)), lengths)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels, labels), weight * (lengths - 1))
    value = np.zeros(FEATURES + 4)
    mean, square = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, STEPS + 1):
        good, pairs = Field(value[:FEATURES], value[FEATURES:].reshape(2, 2)).marginals(evidence, firsts)
        gap = (labels[line] - good) * weight[line]
        slope = np.concatenate((gap @ evidence, (seen - (pairs * weight[:, None, None]).sum(0)).ravel())) - RIDGE * value
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        value = value + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Field(value[:FEATURES], value[FEATURES:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", per_label: int = PER_LABEL) -> Field:
    """A field from at most `per_label` labelled documents of each label, the first by hash of the id.

    The sample is the only thing bounded here; it is cut before the texts are joined to it, and features, not
    texts, reach the driver. Labels other than 0 and 1 are left out, of conflicting ones the smaller counts.
    Without labelled documents of both labels every line gets the share of good ones, or one half.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where("id IS NOT NULL")
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_label) for k in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]).groupBy("id").agg(F.min("label").alias("label")))
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t")).join(sample, "id").select("id", "t", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch, "t"):
                evidence, _, firsts = features(texts)
                packed = [np.packbits(part.astype(bool), axis=1).tobytes() for part in np.split(evidence, firsts[1:])]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("label"), pa.array(packed, pa.binary())], ["id", "label", "lines"])

    rows = sorted(source.mapInArrow(run, "id string, label int, lines binary").collect(), key=lambda r: (r["id"], r["label"], r["lines"]))
    found = np.array([r["label"] for r in rows], np.int64)
    if len(set(found.tolist())) < 2:
        weights = np.zeros(FEATURES)
        weights[-1] = 0.0 if not len(found) else (4.0 if found[0] else -4.0)
        return Field(weights, np.zeros((2, 2)))
    width = -(-FEATURES // 8)
    parts = [np.frombuffer(r["lines"], np.uint8).reshape(-1, width) for r in rows]
    firsts = np.cumsum([0] + [len(p) for p in parts])[:-1]
    evidence = np.unpackbits(np.concatenate(parts), axis=1)[:, :FEATURES].astype(np.float32)
    return learn(evidence, firsts, found)


def score(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: id, score (0 to 1, higher is better), predicted. Null texts are empty texts,
    which are one empty line. Whole texts are read; other columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scores(texts) for _, texts in slices(batch, "t")]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)
