"""Runs of repeating words: maximal stretches that repeat a period of q words at least four times.

Internal pattern matching.  A run of period q and at least 4q words holds a block of L words, L the
power of two in [q, 2q), that starts at a multiple of L/2 and whose next occurrence lies inside the
run.  As L >= q and q is the run's smallest period, that occurrence is exactly q words on.  So for
each L all such blocks are asked for their next occurrence in the neighbouring window of L words: a
range successor over the block's interval of the suffix array, answered by a wavelet matrix.  Blocks
of one distance that follow each other are one arithmetic progression of occurrences; it gives a
candidate period and a stretch, which is then extended to both sides by less than L/2 words.

A task sorts the suffixes of many documents at once (prefix doubling over (document, word), only among
suffixes that still tie), and all queries of a level run as one NumPy vector.  A document is never cut;
memory is about 200 bytes a word of the longest document, or of ``STEP_WORDS``.  No row moves.

Defined results.  A null or empty text, or one of white space only, has no words: no runs, nulls, and
the hashes of nothing.  Repeated rows, null ids and ties stay as they are; only the named columns are read.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_REPEATS = 4
LEAST_WORDS = 6
STEP_WORDS = 150_000     # words of the documents looked at together (or one document, if longer)


class WaveletMatrix:
    """Values of ``bits`` bits in a fixed order, for range successor queries of whole vectors."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones_from = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(1 - bit, out=before[1:])
            self.zeros.append(before)
            self.ones_from.append(int(before[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each ``[lo, hi)`` are less than ``x`` (which has ``bits`` bits)."""
        count = np.zeros(len(lo), np.int64)
        for level, zeros, ones in zip(range(self.bits - 1, -1, -1), self.zeros, self.ones_from):
            left, right = zeros[lo], zeros[hi]
            up = ((x >> level) & 1).astype(bool)
            count += np.where(up, right - left, 0)
            lo = np.where(up, ones + lo - left, left)
            hi = np.where(up, ones + hi - right, right)
        return count

    def quantile(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each ``[lo, hi)``."""
        value = np.zeros(len(lo), np.int64)
        for zeros, ones in zip(self.zeros, self.ones_from):
            left, right = zeros[lo], zeros[hi]
            up = k >= right - left
            k = np.where(up, k - (right - left), k)
            lo = np.where(up, ones + lo - left, left)
            hi = np.where(up, ones + hi - right, right)
            value = 2 * value + up
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value >= ``x`` of each ``[lo, hi)``, or -1."""
        k = self.below(lo, hi, x)
        out = np.full(len(lo), -1, np.int64)
        some = np.flatnonzero(k < hi - lo)
        out[some] = self.quantile(lo[some], hi[some], k[some])
        return out


def _block_queries(words: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray):
    """Suffix array of all documents, each on its own, sorted by their first L words for the largest L
    that a run can need; and for every L the blocks that stand more than once in their document, with
    their interval.  Returns (suffix array, [(L, starts, lo, hi)])."""
    n = len(words)
    key = doc * (int(words.max()) + 1) + words
    array = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)          # first place of the suffix's group in the array
    end = np.empty(n, np.int64)           # and the place behind its last

    def regroup(slots: np.ndarray, keys: np.ndarray) -> None:
        new = np.ones(len(slots), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        members = np.diff(np.append(at, len(slots)))
        lo = np.repeat(slots[at], members)
        rank[array[slots]] = lo
        end[array[slots]] = lo + np.repeat(members, members)

    regroup(np.arange(n), key[array])
    rest, queries, length = size[doc] - place, [], 1
    active = np.arange(n)                 # places of the array whose suffix still ties
    while True:
        suffix = array[active]
        tied = end[suffix] - rank[suffix] > 1
        active, suffix = active[tied], suffix[tied]
        if not len(active):
            break
        # a run of a period over L/2 has over 2L words
        starts = np.sort(suffix[(place[suffix] % max(1, length // 2) == 0) & (rest[suffix] > length)
                                & (size[doc[suffix]] > 2 * length)])
        if len(starts):
            queries.append((length, starts, rank[starts], end[starts]))
        longer = size[doc[suffix]] > 4 * length
        active, suffix = active[longer], suffix[longer]
        if not len(active):
            break
        # double: order by (rank, rank of the suffix ``length`` words on)
        inside = rest[suffix] > length
        second = np.where(inside, rank[np.where(inside, suffix + length, 0)] + 1, 0)
        both = rank[suffix] * (n + 1) + second
        order = np.argsort(both, kind="stable")
        array[active] = suffix[order]
        regroup(active, both[order])
        length *= 2
    return array, queries


def _extend(words: np.ndarray, left_end: np.ndarray, right_end: np.ndarray, lo: np.ndarray, hi: np.ndarray,
            period: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch ``[lo, hi)`` made as long as it keeps its period, by at most ``reach`` words a side."""

    def equal_words(first, step, room):
        """How many of ``room`` pairs ``(first + step*i, that + period)`` are equal before one differs."""
        which = np.repeat(np.arange(len(first)), room)
        nth = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        at = first[which] + step * nth
        out = room.copy()
        bad = np.flatnonzero(words[at] != words[at + period[which]])
        if len(bad):
            who, where = np.unique(which[bad], return_index=True)
            out[who] = nth[bad[where]]
        return out

    right = equal_words(hi - period, 1, np.minimum(reach, right_end - hi))
    left = equal_words(lo - 1, -1, np.minimum(reach, lo - left_end))
    return lo - left, hi + right


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, length, period)`` of every run of the documents ``bounds[d]:bounds[d+1]`` of
    ``words`` (numbers from 0), in the order of document, start, period."""
    size = np.diff(bounds)
    none = np.empty(0, np.int64)
    if not len(words):
        return none, none, none, none
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(words)) - bounds[doc]
    array, queries = _block_queries(words, doc, place, size)
    bits = max(1, int(size.max()).bit_length())
    matrix = WaveletMatrix(place[array], bits)
    found = []
    for length, starts, lo, hi in queries:
        # the window behind a block's start; half of L and less belongs to a smaller L
        step = matrix.successor(lo, hi, place[starts] + 1) - place[starts]
        near = (step <= length) & (2 * step > length)
        starts, step = starts[near], step[near]
        if not len(starts):
            continue
        order = np.lexsort((starts, step, doc[starts]))
        starts, step = starts[order], step[order]
        stop, of = starts + length + step, doc[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (of[1:] != of[:-1]) | (step[1:] != step[:-1]) | (starts[1:] > stop[:-1] - step[1:])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(starts)) - 1
        a, b = _extend(words, bounds[of[at]], bounds[of[at] + 1], starts[at], stop[last], step[at], length)
        found.append((of[at], a, b - a, step[at]))
    if not found:
        return none, none, none, none
    of, start, length, period = (np.concatenate(x) for x in zip(*found))
    keep = length >= np.maximum(LEAST_WORDS, LEAST_REPEATS * period)
    rows = np.unique(np.stack([of, start - bounds[of], length, period], 1)[keep], axis=0)
    order = np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))
    return tuple(rows[order].T)


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words of a tenth of all documents (by the CRC-32 of their id) repeat from a place on with a
    period, both fixed by that number; the others stay.  A null id plants nothing."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


RUNS = ("doc_id {id}, n_words long, starts array<long>, lengths array<long>, periods array<long>, "
        "collapsed string")


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False,
              step_words: int = STEP_WORDS) -> DataFrame:
    """One row per document: the runs of its words (between ASCII white space) by start, then period, and
    ``collapsed``: its words joined by one space, without those that a run holds after its first period."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_words", "starts", "lengths", "periods", "collapsed"]

    def look(ids: list, texts: list[list[bytes]], id_type) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        flat = [number.setdefault(w, len(number)) for words in texts for w in words]
        bounds = np.cumsum([0, *(len(w) for w in texts)])
        doc, start, length, period = find_runs(np.array(flat, np.int64), bounds)
        # a word behind a run's first period is dropped: count the runs that do so at every word
        open_at = np.zeros(len(flat) + 1, np.int64)
        np.add.at(open_at, bounds[doc] + start + period, 1)
        np.add.at(open_at, bounds[doc] + start + length, -1)
        kept = np.cumsum(open_at[:-1]) == 0
        some = set(doc.tolist())
        collapsed = []
        for d, words in enumerate(texts):
            if d in some:
                words = [words[i] for i in np.flatnonzero(kept[bounds[d]:bounds[d + 1]]).tolist()]
            collapsed.append(b" ".join(words))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ids)))]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (start, length, period)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array(np.diff(bounds), pa.int64()), *lists,
             pa.array(collapsed, pa.binary()).cast(pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, first, size = batch.column(0).to_pylist(), [], 0, 0
            texts = batch.column(1)
            for i, d in enumerate(ids):
                words = (texts[i].as_py() or "").encode().split()
                held.append(planted(words, d) if plant else words)
                size += len(words)
                if size >= step_words or i + 1 == len(ids):
                    yield look(ids[first:i + 1], held, batch.schema.field(0).type)
                    held, first, size = [], i + 1, 0

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, RUNS.format(id=kind)))


def digest(runs: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and hashes, by built-in functions."""
    every = F.arrays_zip("starts", "lengths", "periods")
    lines = F.transform(every, lambda r: F.concat(
        r["starts"].cast("string"), F.lit(","), r["lengths"].cast("string"), F.lit(","),
        r["periods"].cast("string"), F.lit("\n")))
    # the runs are in order of start, then period: the first of the greatest length is the longest
    best = F.when(F.size("starts") > 0,
                  F.element_at(every, F.array_position("lengths", F.array_max("lengths")).cast("int")))
    return (runs.withColumn("best", best).select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), F.col("best.starts").alias("start"),
        F.col("best.lengths").alias("length"), F.col("best.periods").alias("period"),
        F.expr("(1000 * best.lengths) div best.periods").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
