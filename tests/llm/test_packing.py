import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hostgraph.llm import packing, token_output, tokens
from hostgraph.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
FILE = open(PATH, "rb").read()
ODD = ["", " ", "  two  spaces \n\n end ", "a\n b", "tab\t x", "don't 12 345!!", "x" * 5000, "é ü 漢字   nb",
       "\x1c sep \x1c", " lead", "trail ", "<|endoftext|> text", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|", "word " * 3000, "\r\n \r\n", "a   b"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_encoder_equals_the_library(plain):
    got = Encoder(FILE).encode(ODD)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(x) for x in ODD]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(" \n\t  \x1c\x85ab'1!é"), max_size=30))
def test_encoder_on_any_white_space(text):
    enc = _shared()
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def _shared(keep=[]):
    if not keep:
        keep.append(Encoder(FILE))
    return keep[0]


def test_encoder_with_a_full_table(plain, monkeypatch):
    monkeypatch.setattr(Encoder, "MEMO", 3)
    texts = ["one two three four five", "six two one seven", "one two"]
    assert [np.frombuffer(g, "<u4").tolist() for g in Encoder(FILE).encode(texts)] == [plain(x) for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\n.,'#aZéßž×ŉ1\t漢"), max_size=40), max_size=5))
def test_encoder_on_marks_and_lines(texts):
    enc = _shared()
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in enc.encode(texts)] == want


def test_encoder_in_runs(plain, monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 20)
    got = list(Encoder(FILE).each(pa.array([None, *ODD, None])))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(x) for x in ["", *ODD, ""]]


def test_a_word_is_encoded_once_whatever_marks_follow():
    """F op4, op8: each pair of word and marks went through the tokenizer (CPU seconds a GB)."""
    class Counting:
        def __init__(self, inner):
            self.inner, self.sent = inner, 0

        def encode_batch_fast(self, texts, **kw):
            self.sent += sum(map(len, texts))
            return self.inner.encode_batch_fast(texts, **kw)

    enc = Encoder(FILE)
    enc.tokenizer = Counting(enc.tokenizer)
    words = [f"stra{chr(97 + i // 26)}ß{chr(97 + i % 26)}e" for i in range(200)]
    texts = [f"{w} {w} {w}. {w}, {w}!! {w}.\n{w} {w}\n{w}; {w}..." for w in words]
    enc.encode(texts)
    assert enc.tokenizer.sent < 4 * sum(len(w) + 1 for w in words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_against_a_plain_search(lengths):
    room, want = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fit = [r for r in room if r >= lengths[i]]
        want[i] = 16 - min(fit) if fit else 0
        if fit:
            room.remove(min(fit))
        left = (min(fit) if fit else 16) - lengths[i]
        if left:
            room.append(left)
    got = packing.Packer(16).place_all(lengths)
    assert [o for _, o in got] == want
    seen = defaultdict(list)
    for (w, o), n in zip(got, lengths):
        seen[w].append((o, n))
    for parts in seen.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 16


def frame(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(3, ODD[3], 9), (None, "null id", 1), (50, None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")


def test_pack_documents(spark, plain):
    docs = frame(spark).repartition(3)
    rows = packing.pack_documents(docs, PATH, size=64, bundle=4).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(plain(r.text or "") + [0])
    assert set(by_doc) == set(texts)
    for d, lists in texts.items():
        assert sum(r.length for r in by_doc[d]) == sum(map(len, lists))
        ids = lists[0]
        for r in by_doc[d]:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start:r.start + r.length]
            assert r.doc_tokens == len(ids)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    one = packing.digest(packing.pack_documents(docs.where("doc_id = 6"), PATH, size=64)).collect()
    ids = np.array(plain(ODD[6]) + [0], "<u4")
    assert {(r.start, r.ids_crc32) for r in one} == {(r.start, zlib.crc32(ids[r.start:r.start + r.length].tobytes())) for r in one}


def test_empty_table(spark):
    none = frame(spark).where("false")
    assert packing.pack_documents(none, PATH).count() == 0
    assert token_output.packed_matrices(none, PATH).count() == 0


def test_matrices_round_trip(spark, plain, tmp_path):
    docs = frame(spark).repartition(2)
    path = str(tmp_path / "m")
    token_output.write_matrices(token_output.packed_matrices(docs, PATH, size=64, matrix_rows=5, bundle=6), path)
    seq = token_output.read_sequences(spark, path)
    for r in seq.collect():
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens == len(r.ids) // 4 <= 64
        assert r.position_resets == r.cu_seqlens[:-1] + ([r.n_tokens] if r.n_tokens < 64 else [])
        assert len(r.doc_id) == len(r.start) == len(r.cu_seqlens) - 1
    got = defaultdict(list)
    for r in token_output.segments(seq).collect():
        assert len(r.ids) == 4 * r.length
        got[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for r in docs.collect():
        n = 2 if r.doc_id == 3 else 1
        parts = sorted(got[r.doc_id])
        assert sum((p for _, p in parts[::n]), []) == plain(r.text or "") + [0]
        assert len(parts) % n == 0
