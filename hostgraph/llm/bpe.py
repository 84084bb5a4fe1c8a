"""Byte-level BPE: ids of whole texts by ranked merges, and texts from ids.

A text is split by the pattern that the ranks were made for; each match starts as its single bytes,
and the adjacent pair of least rank is merged until none has a rank.  Here the merges are folded in
Python over the distinct parts of a task's texts (a table of bounded size); ``bpe_functions`` folds
them by Spark's higher-order functions.  No row moves; decoding concatenates the ids' byte strings.
"""
from __future__ import annotations

import base64
import heapq
import uuid
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import split_parts


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of ``base64 rank`` lines; its size is that of the vocabulary.  It
    is a file beside the library, read once by the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_NONE = 1 << 62      # above every rank


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of one match of the pattern: the leftmost pair of least rank merges first."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    if n > 64:
        return _merge_long(word, ranks)
    get = ranks.get
    at = list(range(n + 1))                # part i is word[at[i]:at[i + 1]]
    pairs = [get(word[i:i + 2], _NONE) for i in range(n - 1)]
    while pairs and (best := min(pairs)) < _NONE:
        i = pairs.index(best)
        del pairs[i], at[i + 1]
        if i:
            pairs[i - 1] = get(word[at[i - 1]:at[i + 1]], _NONE)
        if i < len(pairs):
            pairs[i] = get(word[at[i]:at[i + 2]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(at, at[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same order of merges from a heap of pairs over a linked list."""
    n = len(word)
    end = list(range(1, n + 1))            # part i is word[i:end[i]]
    left, alive = list(range(-1, n - 1)), [True] * n
    heap: list = []

    def push(i):
        if end[i] < n:
            r = ranks.get(word[i:end[end[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[i], end[end[i]]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or end[mid] != stop:
            continue
        alive[mid] = False
        end[i] = stop
        if stop < n:
            left[stop] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


class _Coder:
    MEMO = 300_000      # parts in the newer of two tables (or those of one text, if more); when it is
    #                     full it replaces the older one, and parts that come again move back

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        import regex
        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        ids: list[int] = []
        for word in self.find(text):
            ids += merge(word.encode(), self.ranks)
        return pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str) -> bytes:
        first, rest = split_parts(text)
        distinct = dict.fromkeys(rest)
        if missing := [p for p in distinct if p not in self.memo]:
            if len(self.memo) + len(missing) > self.MEMO:
                self.memo, self.older = {}, self.memo
                missing = list(distinct)
            for p in missing:
                known = self.older.get(p)
                self.memo[p] = self.part(" " + p) if known is None else known
        return self.part(first) + b"".join(map(self.memo.__getitem__, rest))


_CODERS: dict[str, _Coder] = {}      # the worker's coder for the last vocabulary


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) for every row; no special tokens.  A null or empty text has no
    ids; repeated rows and null ids are kept; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)      # the vocabulary: a fixed size
    kind = docs.schema[id_col].dataType.simpleString()
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _CODERS:
            _CODERS.clear()
            _CODERS[key] = _Coder(pattern, shared.value)
        code = _CODERS[key].encode
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = [code(t or "") for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(g) // 4 for g in got)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                               pa.array(np.frombuffer(b"".join(got), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, ids array<int>"))


def decode(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The frame with a column ``decoded``: the concatenated byte strings of ``ids``."""
    shared = coded.sparkSession.sparkContext.broadcast(ranks)
    names = coded.columns

    def run(batches):
        pieces: list = [b""] * (max(shared.value.values(), default=-1) + 1)
        for piece, rank in shared.value.items():
            pieces[rank] = piece
        for batch in batches:
            ids = batch.column(names.index("ids"))
            at, flat = ids.offsets.to_pylist(), ids.values.to_numpy()
            text = [b"".join(map(pieces.__getitem__, flat[a:b].tolist())) if known else None
                    for a, b, known in zip(at, at[1:], ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.binary())], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(run, schema + ", decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
