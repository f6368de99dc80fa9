"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.runtime import slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15  # of all orders together; bucket 0 takes what crosses the end of a text and counts nothing
SLICE = 1 << 17  # characters that are turned into n-grams at a time: arrays of some 20 MB per worker, texts of this length apart
MAX_LANGUAGES = 256  # with BUCKETS, the bound of the broadcast matrix: 32 MiB
_WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and signs such as fractions and Roman numerals, which are none


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram buckets, first character of each text); the buckets have one row per order."""
    lowered = [t.lower() for t in texts]
    starts = np.cumsum([0] + [len(t) + 1 for t in lowered])
    chars = np.frombuffer("\n".join(lowered + [""]).encode("utf-32-le", "surrogatepass"), "<u4")
    found = np.empty((len(ORDERS), len(chars)), np.int32)
    ends = starts[1:] - 1
    for row, order in enumerate(ORDERS):
        mixed = chars + np.uint32(order * 7919)
        for k in range(1, order):
            mixed = mixed * np.uint32(0x9E3779B1)
            mixed[:-k] += chars[k:]
        mixed = (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(8)
        found[row] = 1 + (mixed ^ (mixed >> np.uint32(11))) % np.uint32(BUCKETS - 1)
        for k in range(order):
            found[row][np.maximum(ends - k, 0)] = 0
    return found, starts[:-1]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language: log probabilities, zeros in row 0
    prior: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Posterior of each language for each text."""
        found, starts = codes(texts)
        total = sum(np.add.reduceat(self.weights[row], starts, axis=0, dtype=np.float64) for row in found) + self.prior
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Model:
    """Counts over all rows with a text and a language; one dense count array per task and language is added up
    before the shuffle. At most languages x BUCKETS numbers reach the driver, and the languages are counted first.

    No rows give a model without languages. Empty texts add to the prior only.
    """
    source = docs.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    names = [r["lang"] for r in source.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names.sort()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {name: k for k, name in enumerate(names)}
        counts, texts_of = np.zeros((len(names), BUCKETS), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            langs = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            texts_of += np.bincount(langs, minlength=len(names))
            for first, texts in slices(batch, "t", SLICE):
                found, starts = codes(texts)
                owner = np.repeat(langs[first : first + len(texts)], np.diff(np.append(starts, found.shape[1])))
                for k in np.unique(owner):
                    counts[k] += np.bincount(found[:, owner == k].ravel(), minlength=BUCKETS)
        counts[:, 0] = texts_of  # the prior travels in the bucket that counts nothing
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])], ["lang", "bucket", "n"])

    rows = source.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(names)))
    counts[rows["bucket"], rows["lang"]] = rows["n"]
    prior = np.log(np.maximum(counts[0], 1)) - np.log(max(counts[0].sum(), 1))
    counts[0] = 0
    counts += 0.5
    weights = np.log(counts / counts.sum(axis=0, keepdims=True))
    weights[0] = 0
    return Model(names, weights.astype(np.float32), prior)


def _has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def _predicted(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    named = [bool(model.languages) and _has_letter(t) for t in texts]
    if not any(named):
        return ["und"] * len(texts), [0.0] * len(texts)
    scores = model.scores(texts)
    best = scores.argmax(axis=1)
    langs = [model.languages[b] if ok else "und" for b, ok in zip(best, named)]
    return langs, [float(s[b]) if ok else 0.0 for s, b, ok in zip(scores, best, named)]


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row, from the text alone; `und` with score 0 for null texts and texts without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_predicted(shared.value, texts) for _, texts in slices(batch, "t", SLICE)]
            langs, scores = [x for p in parts for x in p[0]], [x for p in parts for x in p[1]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def keep_known(docs: DataFrame, model: Model, text_column: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows whose language is told with at least `min_score`; all columns as they are, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [lang != "und" and score >= min_score for _, texts in slices(batch, text_column, SLICE) for lang, score in zip(*_predicted(shared.value, texts))]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
