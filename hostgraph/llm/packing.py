"""Best-fit-decreasing packing of token sequences into fixed windows.

A document's ids are cut into full windows first; the remainder (shorter than a window) goes
to the open window with the least room that still takes it.  Open windows hang at the leaf of
their remaining capacity in a segment tree, so the tightest one is found in log2(window) steps.

Packing runs where the documents lie: no row moves.  A task holds the remainders of one bundle
of documents (a parameter), sorts them by falling length, places them and hands them on; of the
windows it keeps only their room and fill.  A hot source or a very long text therefore changes
nothing but the number of rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import shared_encoder

END_ID = 0            # appended to every document
SEQUENCE_BITS = 33    # sequence ids: task number, then a counter of so many bits


class CapacityTree:
    """Segment tree over remaining capacities ``0..size``; a leaf holds the open windows with
    that much room, an inner node the number of windows below it."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, window: int, capacity: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (window, capacity) with the least capacity >= ``need``."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):   # up to a full right sibling
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:                              # down to its leftmost leaf
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


class Packer:
    """Windows of ``size`` ids; ``place`` gives (window, offset) of a piece."""

    def __init__(self, size: int):
        self.size, self.tree, self.windows = size, CapacityTree(size), 0

    def new_window(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, length: int) -> tuple[int, int]:
        got = self.tree.take(length)
        window, room = got if got else (self.new_window(), self.size)
        if room > length:
            self.tree.put(window, room - length)
        return window, self.size - room

    def place_all(self, lengths: list[int]) -> list[tuple[int, int]]:
        """Best fit in falling length; ties in the order given."""
        out: list = [None] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            out[i] = self.place(lengths[i])
        return out


def cut(ids: bytes, size: int) -> list[tuple[int, bytes]]:
    """(start, ids) of the full windows and then the remainder, if there is one."""
    step = 4 * size
    return [(i // 4, ids[i:i + step]) for i in range(0, len(ids), step)]


PIECES = ("doc_id {id}, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, bundle: int = 8192,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian uint32), ``doc_tokens,
    sequence_id, offset``.

    A null or empty text is the single id 0.  Repeated rows are packed as often as they occur;
    a null id stays null; an empty table gives no rows.  Only the two named columns are read,
    so other columns may have any name.  Pieces of equal length keep the order of the input."""
    kind = docs.schema[id_col].dataType
    encoder = shared_encoder(docs.sparkSession, tokenizer)

    def run(batches):
        each = encoder().each
        packer = Packer(size)
        base = TaskContext.get().partitionId() << SEQUENCE_BITS
        end = np.array([END_ID], "<u4").tobytes()
        rest: list[tuple] = []

        def rows(pieces: list[tuple]):
            cols = list(zip(*pieces))
            types = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=["doc_id", "start", "length", "ids", "doc_tokens",
                                                     "sequence_id", "offset"])

        def settle():
            at = packer.place_all([len(p) // 4 for _, _, p, _ in rest])
            return [(d, s, len(p) // 4, p, n, base + w, o)
                    for (d, s, p, n), (w, o) in zip(rest, at)]

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), each(batch.column(1))
            for i in range(0, batch.num_rows, 64):
                full = []
                for doc, coded in zip(ids[i:i + 64], texts):
                    coded += end
                    n = len(coded) // 4
                    for start, part in cut(coded, size):
                        if len(part) == 4 * size:
                            full.append((doc, start, size, part, n, base + packer.new_window(), 0))
                        else:
                            rest.append((doc, start, part, n))
                if full:
                    yield rows(full)
                if len(rest) >= bundle:
                    yield rows(settle())
                    rest.clear()
        if rest:
            yield rows(settle())

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, PIECES.format(id=kind.simpleString())))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
