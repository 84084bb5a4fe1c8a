"""Packed token-id output: binary id matrices with cumulative segment lengths and position resets.

Documents are split losslessly: full windows of ``size`` ids, then a remainder that best-fit
decreasing places by the same segment-tree search as ``packing``.  One row of the written table
is one matrix of at most ``matrix_rows`` sequences.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import END_ID, SEQUENCE_BITS, Packer, cut
from .tokens import shared_encoder

MATRIX = ("matrix_id long, n_rows int, width int, item_bytes int, ids binary, "
          "cu_seqlens array<array<int>>, position_resets array<array<int>>, "
          "doc_id array<array<{id}>>, start array<array<long>>")
AT_ONCE = 16           # matrices whose sequences are handed on together
SEQUENCES = ("matrix_id long, row int, n_tokens int, ids binary, cu_seqlens array<int>, "
             "position_resets array<int>, doc_id array<{id}>, start array<long>")


def _nested(each: np.ndarray, values: pa.Array) -> pa.Array:
    """One list of lists: of ``values``, as many to a list as ``each`` says."""
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), values)
    return pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), inner)


def packed_matrices(docs: DataFrame, tokenizer: str, size: int = 1024, matrix_rows: int = 64,
                    bundle: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matrices of packed ids, row-major and little-endian (2 bytes an id when the vocabulary
    fits, else 4); a row is filled up with ``END_ID`` behind its last segment.

    ``cu_seqlens`` of a row is 0, then the running total of its segment lengths;
    ``position_resets`` are the columns at which positions start again from 0 (each segment's
    first column, and the first filling column if there is one); ``doc_id`` and ``start`` say
    which ids of which document a segment holds.  A null or empty text is the single END_ID;
    repeated rows are packed as often as they occur; an empty table gives no matrix."""
    kind = docs.schema[id_col].dataType
    encoder = shared_encoder(docs.sparkSession, tokenizer)

    def run(batches):
        enc = encoder()
        item = "<u2" if enc.vocabulary <= 1 << 16 else "<u4"
        base = TaskContext.get().partitionId() << SEQUENCE_BITS
        end = np.array([END_ID], "<u4").tobytes()
        made, id_type = 0, pa.int64()
        ready: list[list[tuple]] = []       # sequences: lists of (doc, start, ids)
        rest: list[tuple] = []

        def settle():
            packer = Packer(size)
            windows: dict[int, list[tuple]] = {}
            for piece, (w, o) in zip(rest, packer.place_all([len(p) // 4 for _, _, p in rest])):
                windows.setdefault(w, []).append((o, piece))
            for w in windows.values():
                ready.append([p for _, p in sorted(w, key=lambda x: x[0])])
            rest.clear()

        def matrices(last: bool):
            nonlocal made
            while len(ready) >= matrix_rows or (last and ready):
                rows, ready[:] = ready[:matrix_rows], ready[matrix_rows:]
                pieces = [x for row in rows for x in row]
                each = np.array([len(row) for row in rows])
                lengths = np.array([len(x[2]) // 4 for x in pieces])
                first = np.concatenate([[0], np.cumsum(each)])      # each row's first segment
                ends = np.concatenate([[0], np.cumsum(lengths)])
                base_of = np.repeat(ends[first[:-1]], each)         # ids in the rows before
                used = np.diff(ends[first])
                matrix = np.full((len(rows), size), END_ID, item)
                matrix[np.arange(size) < used[:, None]] = np.frombuffer(b"".join(x[2] for x in pieces), "<u4")
                short = np.flatnonzero(used < size)
                cu = np.insert(ends[1:] - base_of, first[:-1], 0)
                resets = np.insert(ends[:-1] - base_of, first[short + 1], used[short])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + made], pa.int64()), pa.array([len(rows)], pa.int32()),
                     pa.array([size], pa.int32()), pa.array([np.dtype(item).itemsize], pa.int32()),
                     pa.array([matrix.tobytes()], pa.binary()), _nested(each + 1, pa.array(cu, pa.int32())),
                     _nested(each + (used < size), pa.array(resets, pa.int32())),
                     _nested(each, pa.array([x[0] for x in pieces], id_type)),
                     _nested(each, pa.array([x[1] for x in pieces], pa.int64()))],
                    names=["matrix_id", "n_rows", "width", "item_bytes", "ids", "cu_seqlens",
                           "position_resets", "doc_id", "start"])
                made += 1

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), enc.each(batch.column(1))
            for i in range(0, batch.num_rows, 64):
                for doc, coded in zip(ids[i:i + 64], texts):
                    for start, part in cut(coded + end, size):
                        if len(part) == 4 * size:
                            ready.append([(doc, start, part)])
                        else:
                            rest.append((doc, start, part))
                if len(rest) >= bundle:
                    settle()
                yield from matrices(False)
        settle()
        yield from matrices(True)

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, MATRIX.format(id=kind.simpleString())))


def write_matrices(matrices: DataFrame, path: str) -> None:
    """One Parquet file per task; a lost task writes its file again."""
    matrices.write.parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """The sequences of written matrices: ids as little-endian uint32, without the filling."""
    table = spark.read.parquet(path)
    kind = table.schema["doc_id"].dataType.elementType.elementType.simpleString()

    def sequences(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column
        cu = col("cu_seqlens").flatten()
        rows = np.asarray(col("n_rows"))
        n = np.asarray(cu.values)[np.asarray(cu.offsets)[1:] - 1]
        used, at = n.tolist(), 0
        ids = []
        for raw, width, item in zip(col("ids"), np.asarray(col("width")).tolist(), np.asarray(col("item_bytes")).tolist()):
            coded = np.frombuffer(raw.as_buffer(), f"<u{item}").astype("<u4").tobytes()
            here = range(0, len(coded), 4 * width)
            ids += [coded[i:i + 4 * k] for i, k in zip(here, used[at:at + len(here)])]
            at += len(here)
        within = np.arange(len(n)) - np.repeat(np.cumsum(rows) - rows, rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.asarray(col("matrix_id")), rows)), pa.array(within, pa.int32()),
             pa.array(n, pa.int32()), pa.array(ids, pa.binary()), cu, col("position_resets").flatten(),
             col("doc_id").flatten(), col("start").flatten()],
            names=["matrix_id", "row", "n_tokens", "ids", "cu_seqlens", "position_resets",
                   "doc_id", "start"])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                yield sequences(batch.slice(i, AT_ONCE))

    return table.mapInArrow(run, SEQUENCES.format(id=kind))


def segments(sequences: DataFrame) -> DataFrame:
    """One row per segment: its document, its place there, its ids and its place in the row."""
    at = F.posexplode(F.arrays_zip("doc_id", "start", F.slice("cu_seqlens", 1, F.size("doc_id")).alias("a"),
                                   F.slice("cu_seqlens", 2, F.size("doc_id")).alias("b")))
    one = sequences.select("matrix_id", "row", "ids", at.alias("segment", "x"))
    return one.select("matrix_id", "row", "segment", F.col("x.doc_id").alias("doc_id"),
                      F.col("x.start").alias("start"), (F.col("x.b") - F.col("x.a")).cast("long").alias("length"),
                      F.expr("substring(ids, 4 * x.a + 1, 4 * (x.b - x.a))").alias("ids"),
                      F.col("x.a").cast("long").alias("offset"))
