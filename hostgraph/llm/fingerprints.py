"""Document fingerprints by one-permutation MinHash with optimal densification.

Each shingle is hashed once: the leading bits choose its bin, the rest compete for the minimum of
that bin.  An empty bin takes the value of the full bin that its own sequence of hashed draws hits
first (the same draws for every document, so equal texts stay equal).  Only the low-order bits of
each bin are kept; two unrelated bins then agree with probability 2^-bits, which the likeness
corrects for.

Neighbours in id order come from a range partitioning: a task walks its sorted rows with one
document held back, and what crosses the ends of the ranges is settled from one row per range.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import WORDS, mix, shingle_hashes, word_hashes
from .store import write_table

BINS, BITS = 512, 4


@lru_cache(4)
def _draws(bins: int, tries: int) -> np.ndarray:
    """Bin that empty bin ``i`` looks at in its ``t``-th try (tries x bins)."""
    t, i = np.meshgrid(np.arange(1, tries + 1, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    return (mix(t * np.uint64(0x9E3779B97F4A7C15) + i) % np.uint64(bins)).astype(np.int32)


@lru_cache(4)
def _bit_rows(bits: int) -> np.ndarray:
    """The ``bits`` bits of each value, lowest first."""
    return (np.arange(1 << bits)[:, None] >> np.arange(bits) & 1).astype(np.uint8)


def densify(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Values with every empty bin filled from the first full bin among its draws (after 4096
    draws, from the next full bin)."""
    bins = len(values)
    empty = np.flatnonzero(~full)
    out = values.copy()
    draws, tried = _draws(bins, 4096), 0
    # one draw at a time while most bins still hit, then ever more of them: few are left by then
    for tries in (*range(1, 17), 32, 64, 128, 256, 512, 1024, 2048, 4096):
        if not len(empty):
            return out
        look = draws[tried:tries].take(empty, 1)
        seen = full[look]
        hit = seen.any(0)
        out[empty[hit]] = values[look[seen.argmax(0)[hit], hit]]
        empty, tried = empty[~hit], tries
    if len(empty):
        at = np.flatnonzero(full)
        out[empty] = values[at[np.searchsorted(at, empty) % len(at)]]
    return out


def fingerprint(shingles: np.ndarray, bins: int = BINS, bits: int = BITS) -> bytes:
    """Packed low-order ``bits`` of ``bins`` one-permutation minima; empty without shingles."""
    if not len(shingles):
        return b""
    width = np.uint64(64 - int(np.log2(bins)))
    values = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    at = (shingles >> width).astype(np.int64)
    np.minimum.at(values, at, shingles & ((np.uint64(1) << width) - np.uint64(1)))
    full = np.zeros(bins, bool)
    full[at] = True
    low = (densify(values, full) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(_bit_rows(bits)[low]).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Jaccard estimate of two fingerprints: the share of equal bins, corrected for bins that
    agree by chance, held to 0..1.  Two empty ones are alike, an empty and a full one are not."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(f, np.uint8)).reshape(-1, bits) for f in (a, b))
    chance = 2.0 ** -bits
    share = float((x == y).all(1).mean())
    return min(1.0, max(0.0, (share - chance) / (1 - chance)))


def text_fingerprint(text: str, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> bytes:
    return fingerprint(shingle_hashes(word_hashes(text), words), bins, bits)


def fingerprints(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` (binary) of every whole text; a null text is empty."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([text_fingerprint(t, words, bins, bits) for t in texts], pa.binary())],
                names=["doc_id", "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint binary"))


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, "
            "edited_fingerprint binary, near_edited double, near_next double")


def edit(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points replaced by the first as many of
    ``following`` (or all of it)."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def compare_neighbours(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and that of the next document
    in ascending id (the last one's is the first): ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    A null text is empty; a null id sorts first; rows that share an id follow one another by
    text; a single row follows itself; an empty table gives no rows."""

    def settle(one: tuple, two: tuple) -> tuple:
        """one, two: (id, text, fingerprint)"""
        other = edit(one[1], two[1])
        fp = one[2] if other == one[1] else text_fingerprint(other, words, bins, bits)
        return (one[0], len(one[1]), hashlib.sha256(other.encode()).hexdigest(), one[2], fp,
                likeness(one[2], fp, bits), likeness(one[2], two[2], bits))

    def batch_of(rows: list[tuple], ends: list[tuple]):
        cols = [list(c) + [None] * len(ends) for c in zip(*rows)] if rows else [[None] * len(ends)] * len(_NAMES)
        extra = [[None] * len(rows) + [e[k] for e in ends] for k in range(4)]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([False] * len(rows) + [True] * len(ends), pa.bool_())]
            + [pa.array(c, t) for c, t in zip(cols, _TYPES)] + [pa.array(c, t) for c, t in zip(extra, types)],
            names=["end", *_NAMES, "head_id", "head_text", "tail_id", "tail_text"])

    def walk(batches):
        head = held = None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i in range(0, batch.num_rows, 512):
                rows = []
                for d, t in zip(ids[i:i + 512], batch.column(1).slice(i, 512).to_pylist()):
                    now = (d, t, text_fingerprint(t, words, bins, bits))
                    if held is None:
                        head = now
                    else:
                        rows.append(settle(held, now))
                    held = now
                if rows:
                    yield batch_of(rows, [])
        if held is not None:
            yield batch_of([], [(head[0], head[1], held[0], held[1])])

    def close(batches):
        """Ends of all ranges in order: the last of each meets the first of the next."""
        head = held = None
        full = lambda d, t: (d, t, text_fingerprint(t, words, bins, bits))
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                first = full(r["head_id"], r["head_text"])
                if held is None:
                    head = first
                else:
                    rows.append(settle(held, first))
                held = full(r["tail_id"], r["tail_text"])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], t) for c, t in zip(settle(held, head), _TYPES)], names=_NAMES)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    walked, _ = write_table(
        d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(walk, f"end boolean, {COMPARED}, head_id long, head_text string, tail_id long, tail_text string"),
        "fingerprints")
    # one row per range: as many as tasks, whatever the number of documents; they meet behind a
    # shuffle, so that the files are still scanned by many tasks
    ends = walked.where("end").select("head_id", "head_text", "tail_id", "tail_text")
    last = ends.repartition(1).sortWithinPartitions(F.asc_nulls_first("head_id"), "head_text").mapInArrow(close, COMPARED)
    return walked.where("NOT end").select(*_NAMES).unionByName(last)
