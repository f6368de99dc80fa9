"""What the operators share: the shared scratch folder, checkpoints, text batches, and fold numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.session import shared_dir, stored

__all__ = ["FILE_ROWS", "SLICE_CHARS", "checkpointed", "fold", "gathered", "shared_dir", "slices", "stored"]

# A task turns at most about this many characters into arrays at a time.
SLICE_CHARS = 1_000_000
# Rows of ids and hashes that are worth a file of their own, some 3 MB.
FILE_ROWS = 100_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of at most `rows` narrow rows, in no more parts than these fill or the cores can work on, before it is written.

    A written part costs its executor processes: Hadoop's local files set their rights by a command, two of a part,
    and a process that Java starts has the executor's memory a second time until the command runs.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; Spark removes its files when nothing refers to them any more (if so configured)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for pieces of a batch of about `limit` characters; null texts are empty.

    A text is never cut, so one that is longer than the limit is a piece of its own.
    """
    texts, first, total = [], 0, 0
    for row, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        if texts and total + len(text) > limit:
            yield first, texts
            texts, first, total = [], row, 0
        texts.append(text)
        total += len(text)
    if texts:
        yield first, texts
