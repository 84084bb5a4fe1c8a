"""Token ids of whole texts, inside the Arrow batches of a Spark task.

Both byte-level vocabularies split a text by one pattern before merging.  Every place where a
space follows a character that is no white space is a boundary of that pattern, and none of
its alternatives looks across such a place, so the parts between those places are encoded on
their own and each distinct part once per worker (a table of bounded size).  The parts of a run of
texts are told apart in Arrow, so that Python sees each distinct part of the run once.
"""
from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

# str.isspace() covers more characters than the pattern's \s: that merges neighbouring parts
# and never cuts inside a token.
_SPACE_RUN = re.compile(r"\s ")
_ASCII_RUNS = [x + " " for x in map(chr, range(128)) if x.isspace()]
_OTHER_RUN = re.compile(r"[^\S\x00-\x7F] ")
_CUT = re.compile(r"(?<=\S)(?= )")
# A part of up to four lines that are letters and then a few ASCII marks.  The pattern takes such letters with
# the space before them, the marks and the line break each on their own, so they are encoded once each.
_WORD, _MARKS = "[A-Za-zÀ-ÖØ-öø-ſ]+", r"[!-/:-@\[-`{-~]"
_LINES = re.compile(rf"{_WORD}{_MARKS}{{0,3}}(?:\n{_WORD}{_MARKS}{{0,3}}){{0,3}}")
_LINE = re.compile(rf"({_WORD})({_MARKS}{{1,3}})")
_PIECES = re.compile(rf"\n?{_WORD}|{_MARKS}+")
RUN = 6_000_000       # characters of the texts encoded together (or one text, if longer)


def split_parts(text: str) -> tuple[str, list[str]]:
    """The first part, and the others without the one space that each starts with."""
    if _SPACE_RUN.search(text):
        first, *rest = _CUT.split(text)
        return first, [x[1:] for x in rest]
    first, *rest = text.split(" ")
    return first, rest


class Encoder:
    """ids of texts by a ``tokenizers`` file, as ``encode(text, add_special_tokens=False)``
    gives them (the string of an added token is that token; such a text is encoded whole)."""

    MEMO = 900_000   # parts in the newer of two tables (or those of one call, if more); when it is
    #                  full it replaces the older one, and parts that come again move back

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(file)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_added = lambda text: any(a in text for a in added)
        self.vocabulary = self.tokenizer.get_vocab_size(True)
        # bytes of each id: a byte-level vocabulary writes a byte as one character
        self.bytes = np.zeros(self.vocabulary, np.int64)
        for piece, i in self.tokenizer.get_vocab(True).items():
            self.bytes[i] = len(piece)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}     # marks behind words, line breaks with words; counted with the newer table

    def _plain(self, texts: list[str]) -> list[bytes]:
        got = []
        for i in range(0, len(texts), 4096):
            got += self.tokenizer.encode_batch_fast(texts[i:i + 4096], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _joined(self, parts: list[str], lead: str = " ") -> list[bytes]:
        """``lead`` and a part, for parts that don't end in white space: many to a text, whose ids are cut
        again where the bytes of the parts end."""
        size = 1 + pc.binary_length(pa.array(parts, pa.string())).to_numpy(zero_copy_only=False)
        starts = range(0, len(parts), 256)
        out = []
        for i in range(0, len(starts), 16):
            some = starts[i:i + 16]
            got = self.tokenizer.encode_batch_fast([lead + lead.join(parts[k:k + 256]) for k in some], add_special_tokens=False)
            for k, e in zip(some, got):
                ids = np.array(e.ids, "<u4")
                cuts = [0, *(4 * np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(size[k:k + 256])) + 4).tolist()]
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _learn(self, parts: list[str]) -> None:
        memo, pieces, older = self.memo, self.pieces, self.older
        new = parts
        if older:
            back = [*map(older.get, parts)]
            memo.update((p, ids) for p, ids in zip(parts, back) if ids is not None)
            new = [p for p, ids in zip(parts, back) if ids is None]
        words, cut = [], {}
        for p in new:
            if p.isalpha():
                words.append(p)
            elif one := _LINE.fullmatch(p):
                cut[p] = one.groups()
            elif "\n" in p and _LINES.fullmatch(p):
                cut[p] = _PIECES.findall(p)
            else:
                words.append(p)
        words += {c[0] for c in cut.values()}.difference(memo, words)
        whole = [p for p in words if p and not p[-1].isspace()]
        memo.update(zip(whole, self._joined(whole)))
        rest = [p for p in words if not p or p[-1].isspace()]
        memo.update(zip(rest, self._plain([" " + p for p in rest])))
        others = {x for c in cut.values() for x in c[1:]}.difference(pieces)
        lines, marks = [x for x in others if x[0] == "\n"], [x for x in others if x[0] != "\n"]
        pieces.update(zip(lines, self._joined([x[1:] for x in lines], "\n")))
        pieces.update(zip(marks, self._plain(marks)))
        for p, c in cut.items():
            memo[p] = memo[c[0]] + (pieces[c[1]] if len(c) == 2 else b"".join(map(pieces.__getitem__, c[1:])))

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts behind a space each."""
        got = [*map(self.memo.get, parts)]
        if missing := [p for p, ids in zip(parts, got) if ids is None]:
            if len(self.memo) + len(self.pieces) + len(missing) > self.MEMO:
                self.memo, self.older, self.pieces = {}, self.memo, {}
                missing = parts
            self._learn(missing)
            got = [self.memo[p] if ids is None else ids for p, ids in zip(parts, got)]
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        heads, odd = list(texts), {}
        for i, t in enumerate(texts):
            if self.has_added(t):
                odd[i] = []
            elif any(x in t for x in _ASCII_RUNS) or not t.isascii() and _OTHER_RUN.search(t):
                heads[i], odd[i] = split_parts(t)
        even = [i for i in range(len(texts)) if i not in odd]
        # a text's other parts lie at start .. start + count of all parts
        start, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        lists = pc.split_pattern(pa.array([texts[i] for i in even], pa.string()), " ")
        ends, parts = lists.offsets.to_numpy().astype(np.int64), lists.values
        for i, h in zip(even, parts.take(pa.array(ends[:-1])).to_pylist()):
            heads[i] = h
        start[even], count[even] = ends[:-1] - np.arange(len(even)), np.diff(ends) - 1
        behind = np.ones(len(parts), bool)
        behind[ends[:-1]] = False
        n = len(parts) - len(even)
        for i, others in odd.items():
            start[i], count[i] = n, len(others)
            n += len(others)
        parts = pa.concat_arrays([parts.filter(pa.array(behind)), pa.array([p for x in odd.values() for p in x], pa.string())])
        coded = parts.dictionary_encode()
        known, at = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ends = np.concatenate([[0], np.cumsum(size[at])])
        where = np.repeat((np.cumsum(size) - size)[at] - ends[:-1], size[at]) + np.arange(ends[-1])
        raw = np.frombuffer(b"".join(known), "<u4")[where].tobytes()
        return [h + raw[a:b] for h, a, b in zip(self._plain(heads), (4 * ends[start]).tolist(), (4 * ends[start + count]).tolist())]

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """The same of every row of a column (null: empty), in runs of bounded size."""
        run, size = [], 0
        for i in range(0, len(texts), 64):
            for t in texts.slice(i, 64).to_pylist():
                t = t or ""
                if run and size + len(t) > RUN:
                    yield from self.encode(run)
                    run, size = [], 0
                run.append(t)
                size += len(t)
        if run:
            yield from self.encode(run)


_ENCODERS: dict[str, Encoder] = {}


def shared_encoder(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """What gives a task its worker's encoder.  The driver reads the tokenizer file (a vocabulary: a fixed
    size) and sends it along, so that no task needs its path."""
    with open(path, "rb") as f:
        file = f.read()
    sent, key = spark.sparkContext.broadcast(file), hashlib.sha256(file).hexdigest()

    def get() -> Encoder:
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(sent.value)
        return _ENCODERS[key]
    return get
