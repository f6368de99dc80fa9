"""Packing of documents into sequences of a fixed length, by bounded-space best fit.

Each task keeps a fixed number of open windows. A piece goes to the open window whose gap it fits best; when
none fits and no more may be opened, the fullest window takes as much of the piece as it has room for and is
emitted without padding. What is left open at the end of a task is merged to at most one window, and those
windows, one per task, are merged in groups of tasks by a second, small stage. The last window of a group is
cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm import byte_ids
from certloom.llm.runtime import slices, stored

LENGTH, OPEN, END = 2048, 32, 1
MERGED = 256  # tasks whose last windows are merged together: at most MERGED x LENGTH ids
_ID = 4  # bytes per id

Piece = tuple  # (document, start, ids as bytes, tokens of the document)


class Packer:
    """Bounded-space packing of pieces; `full` collects (pieces of a window) that are done."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.open: list[list] = []  # [filled, pieces]
        self.full: list[list[Piece]] = []

    def add(self, document, ids: bytes) -> None:
        total = len(ids) // _ID
        whole = total // self.length * self.length
        for start in range(0, whole, self.length):
            self.full.append([(document, start, ids[start * _ID : (start + self.length) * _ID], total)])
        if whole < total:
            self.place((document, whole, ids[whole * _ID :], total))

    def place(self, piece: Piece) -> None:
        document, start, ids, total = piece
        need = len(ids) // _ID
        fits = [w for w in self.open if self.length - w[0] >= need]
        if fits:
            window = max(fits, key=lambda w: w[0])
        elif len(self.open) < self.most:
            window = [0, []]
            self.open.append(window)
        else:
            window = max(self.open, key=lambda w: w[0])
        room = min(need, self.length - window[0])
        window[0] += room
        window[1].append((document, start, ids[: room * _ID], total))
        if window[0] == self.length:
            self.open = [w for w in self.open if w is not window]
            self.full.append(window[1])
        if room < need:
            self.place((document, start + room, ids[room * _ID :], total))

    def merge(self) -> list[Piece]:
        """Closes all windows: their pieces are laid end to end, fullest window first. Returns the last, unfilled one."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open, last = [], Packer(self.length, 1)
        for piece in pieces:
            last.place(piece)
        self.full += last.full
        return last.open[0][1] if last.open else []


def powers(pieces: list[Piece], length: int) -> list[list[Piece]]:
    """The pieces of one window, cut into windows whose lengths are powers of two, greatest first."""
    total, rest, found = sum(len(p[2]) for p in pieces) // _ID, list(pieces), []
    for size in [1 << k for k in reversed(range(length.bit_length())) if total >> k & 1]:
        window, room = [], size
        while room:
            document, start, ids, tokens = rest.pop(0)
            taken = min(room, len(ids) // _ID)
            window.append((document, start, ids[: taken * _ID], tokens))
            if taken < len(ids) // _ID:
                rest.insert(0, (document, start + taken, ids[taken * _ID :], tokens))
            room -= taken
        found.append(window)
    return found


_NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "task"]


def _rows(windows: list[list[Piece]], first_sequence: int, with_ids: bool, task: int | None = None) -> list[list]:
    """Columns, in the order of _NAMES; `task` marks windows that are still to be merged."""
    columns: list[list] = [[] for _ in _NAMES]
    for k, window in enumerate(windows):
        offset = 0
        for document, start, ids, tokens in window:
            n = len(ids) // _ID
            row = (document, start, n, zlib.crc32(ids), tokens, first_sequence + k, offset, ids if with_ids else None, task)
            for column, value in zip(columns, row):
                column.append(value)
            offset += n
    return columns


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    open_windows: int = OPEN,
    end_id: int = END,
    tokenizer: str = byte_ids.NAME,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and `ids` (little-endian
    unsigned 32-bit) if asked for.

    A null text is empty; an empty document is its end id alone. Rows with a repeated or null id are packed
    each for itself. Other columns are not looked at. The pieces are written once, so that a task that runs
    again cannot disagree with what was merged.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t"))
    kinds = [source.schema["id"].dataType, *[T.LongType()] * 6, T.BinaryType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(_NAMES, kinds)])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = byte_ids.encoder(tokenizer), Packer(length, open_windows)
        task = TaskContext.get().partitionId()
        first = task << 32

        def done(kind: pa.DataType, rest: list[Piece] | None = None) -> pa.RecordBatch:
            nonlocal first
            columns = _rows(packer.full, first, with_ids)
            first += len(packer.full)
            packer.full = []
            if rest:
                columns = [a + b for a, b in zip(columns, _rows([rest], first, True, task))]
            types = [kind, *[pa.int64()] * 6, pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _NAMES)

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            names = batch.column("id").to_pylist()
            for at, texts in slices(batch, "t"):
                for name, text in zip(names[at:], texts):
                    packer.add(name, encode(text) + end)
                yield done(kind)
        if kind is not None:
            yield done(kind, packer.merge())

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(length, 1)
        for _, r in group.sort_values(["task", "offset"]).iterrows():
            packer.place((r["id"], r["start"], r["ids"], r["doc_tokens"]))
        windows = packer.full + powers(packer.merge(), length)
        first = 1 << 62 | int(group["task"].iloc[0]) // MERGED << 32
        return pd.DataFrame(dict(zip(_NAMES, _rows(windows, first, with_ids)))).astype({"id": object})

    packed = stored(source.mapInArrow(run, schema), "packed")
    merged = packed.where("task IS NOT NULL").groupBy(F.floor(F.col("task") / MERGED)).applyInPandas(merge, schema)
    shown = _NAMES[: 8 if with_ids else 7]
    return packed.where("task IS NULL").select(*shown).union(merged.select(*shown)).withColumnRenamed("id", id_column)
