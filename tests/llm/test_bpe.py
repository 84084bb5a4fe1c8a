import public_tokenizers as P
import pytest
import tiktoken

from hostgraph.llm import bpe, bpe_functions

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
TEXTS = ["", None, " ", "Hello world, it's 12345!!", "  two  spaces \n\n end ", "antidisestablishmentarianism", "é漢字😀 ß",
         "a\n b", "tab\t x", "\x1c \x85 x", "<|endoftext|>", "aaaaaaaaaaaaaaaaaaaa", "xyzzy " * 50, "don't WE'RE they'll",
         "\r\n \r\n", "nb  y"]
LONG = ["ab" * 6000 + "c" * 3000, "word " * 5000]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={}).encode_ordinary


def frame(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "y"), (3, TEXTS[3], "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.mark.parametrize("style,texts", [(bpe, TEXTS + LONG), (bpe_functions, TEXTS)])
def test_equals_the_library(spark, library, style, texts):
    docs = frame(spark, texts)
    coded = style.encode(docs, RANKS, P.PATTERN)
    out = style.decode(coded, RANKS).collect()
    want = sorted([(r.doc_id, library(r.text or ""), (r.text or "").encode()) for r in docs.collect()], key=repr)
    assert sorted([(r.doc_id, list(r.ids), bytes(r.decoded)) for r in out], key=repr) == want


def test_long_words_merge_in_the_same_order(library):
    import random
    rng = random.Random(5)
    for n in (65, 200, 900):
        w = "".join(rng.choice("abcdefgh") for _ in range(n))
        assert bpe._merge_long(w.encode(), RANKS) == library(w)


def test_full_table_and_digest(spark, library, monkeypatch):
    import hashlib
    monkeypatch.setattr(bpe._Coder, "MEMO", 3)
    code = bpe._Coder(P.PATTERN, RANKS)
    import numpy as np
    for t in ["one two three four five", "six seven one", "one two"]:
        assert np.frombuffer(code.encode(t), "<i4").tolist() == library(t)
    docs = frame(spark, TEXTS)
    for r in bpe.digest(bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS)).where("doc_id is not null").collect():
        ids = library(TEXTS[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


def test_empty_table(spark):
    none = frame(spark, TEXTS).where("false")
    assert bpe.decode(bpe.encode(none, RANKS, P.PATTERN), RANKS).count() == 0


def test_parts_of_the_older_table_are_not_merged_again(monkeypatch):
    monkeypatch.setattr(bpe._Coder, "MEMO", 4)
    coder = bpe._Coder(P.PATTERN, bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    made, part = [], coder.part
    coder.part = lambda text: made.append(text) or part(text)
    first = coder.encode("x b c")
    coder.encode("x d e f")           # the table is full
    assert coder.encode("x b") == first[:len(coder.encode("x b"))]
    assert [made.count(p) for p in (" b", " c", " d")] == [1, 1, 1]


def test_merge_takes_the_leftmost_pair_of_least_rank():
    ranks = {bytes([c]): c for c in range(256)}
    ranks |= {w: 256 + i for i, w in enumerate([b"aa", b"ab", b"aab", b"ba", b"aaaa", b"baab"])}
    for word, ids in ((b"", []), (b"a", [97]), (b"aaa", [256, 97]), (b"aaab", [256, 257]), (b"abaab", [257, 258]),
                      (b"caabaab", [99, 258, 258]), (b"xyz", [120, 121, 122])):
        assert bpe.merge(word, ranks) == bpe._merge_long(word, ranks) == ids
