"""Alignment of two tokenizers' tokens by the bytes they cover, and how usual each linked id pair is.

Tokens of A and B whose byte ranges end together are linked; the places where both end cut a text
into groups, the smallest pieces that both vocabularies spell out whole.

Lockstep merging: one NumPy state vector holds an A pointer and a B pointer for every lane of a batch
of documents (a lane is a document, or a window of ``LANE`` A tokens of a long one).  Each step compares
the byte ends under all pointers at once, emits a link and a cut for each lane where they agree, and
moves the pointer that lies behind; finished lanes are taken out of the vector.

Corpus-wide counts: every document keeps its distinct id pairs with their number, and every block of
documents (``BLOCK`` bytes of text in a task) those of all its documents.  Only the blocks' pairs are
summed over the corpus and joined back, so that a pair found in every text costs one row a block;
then each block's documents meet that block's pairs, never those of another.

Defined results.  A null or empty text, or one whose joined A or B bytes are not those of a space and the
text, has no tokens: zeros and ''.  Repeated rows and null ids are kept as rows of their own and counted
as often as they stand.  An empty table gives no rows.  Only the two named columns are read.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import write_table

LANE = 256              # A tokens of a lane
STEP_BYTES = 2 << 20    # bytes of text merged at once (or one text, if longer)
BLOCK = 24 << 20        # bytes of text in a block
BLOCK_BITS = 33

_SPACE_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 bytes
    stand for themselves, the others are numbered on from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairCoder:
    """Ids of a text under both vocabularies.  Both start a new token wherever a space follows a
    character that is no white space, so the parts between such places are encoded once and kept
    (a table of bounded size)."""

    MEMO = 200_000      # parts in the newer of two tables (or those of one call, if more)

    def __init__(self, vocabulary_a: bytes, model_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_buffer(vocabulary_a)
        self.a.encode_special_tokens = True       # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        own = byte_of_character()
        self.bytes_a = [b""] * self.a.get_vocab_size(True)
        for token, i in self.a.get_vocab(True).items():
            self.bytes_a[i] = (bytes(own[c] for c in token) if all(c in own for c in token) else token.encode())
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i)
                                else b"" if self.b.is_control(i) else piece.replace("▁", " ").encode())
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes_b))):
            raise ValueError("a piece spans a space inside a text: parts cannot be encoded on their own")
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.space_b = self.b.piece_to_id("▁")
        self.memo: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _ids_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_b(self, parts: list[str]) -> list[np.ndarray]:
        """Of a space and each part: the model puts the space in front, except before nothing."""
        return [np.array(ids if p else [self.space_b], "<u4")
                for p, ids in zip(parts, self.b.encode(parts, num_threads=1))]

    def _alone(self, part: str) -> tuple[bytes, bytes] | None:
        want = b" " + part.encode()
        a, b = self._ids_a([" " + part])[0], self._ids_b([part])[0]
        if (b"".join(map(self.bytes_a.__getitem__, a.tolist())) != want
                or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != want):
            return None
        return a.tobytes(), b.tobytes()

    def _together(self, parts: list[str]) -> list:
        """Parts that don't end in white space, encoded as one text that is cut again at their ends."""
        joined = " ".join(parts)
        whole = self._alone(joined)
        if whole is None:
            return [self._alone(p) for p in parts]
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        cuts = []
        for raw, size in zip(whole, (self.len_a, self.len_b)):
            at = np.searchsorted(np.cumsum(size[np.frombuffer(raw, "<u4")]), ends) + 1
            cuts.append([raw[4 * i:4 * j] for i, j in zip([0, *at.tolist()], at.tolist())])
        return list(zip(*cuts))

    def _learn(self, parts: list[str]) -> None:
        self.memo.update((p, self.older[p]) for p in parts if p in self.older)
        new = [p for p in parts if p not in self.older]
        whole = [p for p in new if p and not p[-1].isspace()]
        for i in range(0, len(whole), 256):
            some = whole[i:i + 256]
            self.memo.update(zip(some, self._together(some)))
        self.memo.update((p, self._alone(p)) for p in new if not p or p[-1].isspace())

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(A ids, B ids) of a space and each text, little-endian unsigned 32-bit; empty for a text
        without tokens."""
        split = []
        for t in texts:
            if not t or "▁" in t:          # B cannot tell that character from a space
                split.append([])
            elif t[0] == " " or _SPACE_RUN.search(t):
                split.append([x[1:] for x in _CUT.split(" " + t)])
            else:
                split.append(t.split(" "))
        distinct = dict.fromkeys(chain.from_iterable(split))
        if missing := [p for p in distinct if p not in self.memo]:
            if len(self.memo) + len(missing) > self.MEMO:
                self.memo, self.older = {}, self.memo
                missing = list(distinct)
            self._learn(missing)
        out = []
        for parts in split:
            got = [self.memo[p] for p in parts]
            if None in got:
                out.append((b"", b""))
            else:
                out.append((b"".join([a for a, _ in got]), b"".join([b for _, b in got])))
        return out


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray, lane: int) -> tuple:
    """Pointer ranges ``(a, a_end, b, b_end)`` of the lanes: each document's A tokens
    (``bounds[d]:bounds[d+1]``) in windows of ``lane``, and the B tokens that end in the same bytes."""
    sizes = np.diff(bounds)
    per = -(-sizes // lane)
    first = np.repeat(bounds[:-1], per)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    a = first + nth * lane
    a_end = np.minimum(a + lane, np.repeat(bounds[1:], per))
    b_end = np.searchsorted(ends_b, ends_a[a_end - 1], "right")
    b = np.searchsorted(ends_b, np.where(a > 0, ends_a[a - 1], 0), "right")
    return a, a_end, b, b_end


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, state: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the A and the B tokens that are linked (at the same time: last of their group).
    The i-th marked A token is linked with the i-th marked B token."""
    a, a_end, b, b_end = state
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    alive = (a < a_end) & (b < b_end)
    while True:
        if not alive.all():
            a, a_end, b, b_end = a[alive], a_end[alive], b[alive], b_end[alive]
        if not len(a):
            return cut_a, cut_b
        x, y = ends_a[a], ends_b[b]
        meet = x == y
        cut_a[a[meet]] = True
        cut_b[b[meet]] = True
        a = a + (x <= y)
        b = b + (y <= x)
        alive = (a < a_end) & (b < b_end)


class _Writer:
    """Texts of the groups: ids in their order within and across groups, each with the sign behind it."""

    def __init__(self, ids: int):
        self.text = [b"%d%s" % (i, sign) for i in range(ids) for sign in (b",", b"|", b";")]

    def codes(self, ids_a, ids_b, cut_a, cut_b) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all groups in writing order, and where each A token went."""
        end_a, end_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        at_a = np.arange(len(ids_a)) + np.concatenate([[0], end_b + 1])[np.cumsum(cut_a) - cut_a]
        at_b = np.arange(len(ids_b)) + (end_a + 1)[np.cumsum(cut_b) - cut_b]
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[at_a] = 3 * ids_a + cut_a
        out[at_b] = 3 * ids_b + 2 * cut_b
        return out

    def join(self, codes: np.ndarray) -> bytes:
        return b"".join(map(self.text.__getitem__, codes.tolist()))[:-1]


_WORKER: dict[str, tuple] = {}     # the worker's coder and writer for the last pair of vocabularies

_ALIGNED = ("doc_id {id}, block long, whole_block boolean, n_a long, n_b long, n_groups long, n_links long, "
            "groups_sha256 string, groups string, pairs array<long>, counts array<long>")


def align(docs: DataFrame, vocabulary_a: bytes, model_b: bytes, id_col: str = "doc_id", text_col: str = "text",
          keep_groups: bool = False) -> tuple[DataFrame, int]:
    """One row per document: token, group and link counts, the SHA-256 of the groups' text
    (``a1,a2|b1;a3|b2``; the text itself in ``groups`` if kept), its distinct linked id pairs
    (``a * base + b``) and how often each stands; and one row per block (``whole_block``) with the pairs
    of all its documents.  Returns the frame and ``base``, the size of B's vocabulary."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((vocabulary_a, model_b))      # two vocabularies: a fixed size
    key = hashlib.sha256(vocabulary_a + model_b).hexdigest()
    import sentencepiece
    base = sentencepiece.SentencePieceProcessor(model_proto=model_b).get_piece_size()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            _WORKER.clear()
            coder = PairCoder(*files.value)
            _WORKER[key] = coder, _Writer(max(len(coder.bytes_a), len(coder.bytes_b)))
        coder, writer = _WORKER[key]
        block, held, seen = TaskContext.get().partitionId() << BLOCK_BITS, 0, []
        id_type = pa.int64()

        def merge(ids: list, texts: list[str]) -> pa.RecordBatch:
            coded = coder.encode(texts)
            n_a = np.array([len(a) // 4 for a, _ in coded], np.int64)
            n_b = np.array([len(b) // 4 for _, b in coded], np.int64)
            ids_a = np.frombuffer(b"".join([a for a, _ in coded]), "<u4").astype(np.int64)
            ids_b = np.frombuffer(b"".join([b for _, b in coded]), "<u4").astype(np.int64)
            ends_a, ends_b = np.cumsum(coder.len_a[ids_a]), np.cumsum(coder.len_b[ids_b])
            bounds = np.concatenate([[0], np.cumsum(n_a)])
            cut_a, cut_b = lockstep(ends_a, ends_b, lanes(ends_a, ends_b, bounds, LANE))
            link_a, link_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
            doc = np.searchsorted(bounds, link_a, "right") - 1
            n_links = np.bincount(doc, minlength=len(ids))
            # distinct pairs of each document
            pair = ids_a[link_a] * base + ids_b[link_b]
            order = np.lexsort((pair, doc))
            pair, doc = pair[order], doc[order]
            new = np.ones(len(pair), bool)
            new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            counts, pairs = np.diff(np.append(at, len(pair))), pair[at]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(ids)))]).astype(np.int32)
            seen.append(_sum(pairs, counts))
            codes = writer.codes(ids_a, ids_b, cut_a, cut_b)
            to = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
            written = [writer.join(codes[i:j]) if j > i else b"" for i, j in zip(to, to[1:])]
            return batch(ids, False, n_a, n_b, n_links,
                         [hashlib.sha256(w).hexdigest() if w else "" for w in written],
                         [w.decode() for w in written] if keep_groups else [None] * len(ids), offsets, pairs, counts)

        def batch(ids, whole, n_a, n_b, n_links, hashes, groups, offsets, pairs, counts):
            listed = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int64()))
                      for x in (pairs, counts)]
            n, links = len(ids), pa.array(n_links, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array([block] * n, pa.int64()), pa.array([whole] * n),
                 pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), links, links, pa.array(hashes, pa.string()),
                 pa.array(groups, pa.string()), *listed], names=names)

        def close():
            pairs, counts = _sum(np.concatenate([p for p, _ in seen]), np.concatenate([c for _, c in seen]))
            return batch([None], True, [0], [0], [0], [""], [None], [0, len(pairs)], pairs, counts)

        for got in batches:
            id_type = got.schema.field(0).type
            ids, texts = got.column(0).to_pylist(), [t or "" for t in got.column(1).to_pylist()]
            start = size = 0
            for i, t in enumerate(texts):
                size += 3 * len(t) // 2 + 16
                if size >= STEP_BYTES or i + 1 == len(texts):
                    yield merge(ids[start:i + 1], texts[start:i + 1])
                    start, held, size = i + 1, held + size, 0
                    if held >= BLOCK:
                        yield close()
                        block, held = block + 1, 0
                        seen.clear()
        if seen:
            yield close()

    names = ["doc_id", "block", "whole_block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups",
             "pairs", "counts"]
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, _ALIGNED.format(id=kind))), base


def _sum(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sum of their counts."""
    found, where = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, where, counts)
    return found, total


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """``pair, n_linked, best``: how many links of the corpus hold the pair, and whether none with the
    same B id has more.  Rows of blocks are read, none of documents."""
    one = (aligned.where("whole_block").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
           .select("p.pairs", "p.counts").groupBy(F.col("pairs").alias("pair"))
           .agg(F.sum("counts").alias("n_linked")).withColumn("b", F.col("pair") % base))
    top = one.groupBy("b").agg(F.max("n_linked").alias("top"))
    return one.join(top, "b").select("pair", "n_linked", (F.col("n_linked") == F.col("top")).alias("best"))


def score_links(aligned: DataFrame, base: int) -> DataFrame:
    """The rows of the documents with ``n_best`` (links whose pair is the most frequent of its B id) and
    ``count_sum`` (the corpus-wide counts of all its links summed up).  ``aligned`` is read twice: written
    already, it is not worked out again."""
    found, _ = write_table(pair_counts(aligned, base), "alignment-pairs")
    known = (aligned.where("whole_block").select("block", F.explode("pairs").alias("pair")).join(found, "pair")
             .select(F.col("block").alias("of_block"), "pair", "n_linked", "best"))
    rows = aligned.where("NOT whole_block").drop("whole_block")
    keep = [c for c in rows.columns if c not in ("block", "pairs", "counts")]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        order = np.argsort(right["pair"].to_numpy())
        pair, n, best = (right[c].to_numpy()[order] for c in ("pair", "n_linked", "best"))
        lists = left["pairs"].combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(left["pairs"].combine_chunks().value_lengths().to_numpy())])
        counts = left["counts"].combine_chunks().flatten().to_numpy()
        at = np.searchsorted(pair, lists.flatten().to_numpy())
        sums = []
        for x in (np.where(best[at], counts, 0) if len(pair) else counts, counts * n[at] if len(pair) else counts):
            run = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
            sums.append(pa.array(run[offsets[1:]] - run[offsets[:-1]], pa.int64()))
        return pa.Table.from_arrays([*(left[c] for c in keep), *sums], names=[*keep, "n_best", "count_sum"])

    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", n_best long, count_sum long"
    return rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(look_up, schema)


def cross_align(docs: DataFrame, vocabulary_a: bytes, model_b: bytes, id_col: str = "doc_id", text_col: str = "text",
                keep_groups: bool = False) -> DataFrame:
    """Alignment with corpus-wide counts: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256`` (and ``groups``, if kept)."""
    made, base = align(docs, vocabulary_a, model_b, id_col, text_col, keep_groups)
    aligned, _ = write_table(made, "alignment")
    return score_links(aligned, base).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
        *(["groups"] if keep_groups else []))
