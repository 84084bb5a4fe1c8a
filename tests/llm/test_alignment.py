import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from hostgraph.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FILES = [open(p, "rb").read() for p in (A, B)]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_table():
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


def plain(libraries, text):
    """Tokens of one text by the libraries alone: (a ids, b ids, links as index pairs, groups)."""
    a, b = libraries
    if not text:
        return [], [], [], ""
    table = byte_table()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    raw_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    raw_b = []
    for i in ids_b:
        p = b.id_to_piece(i)
        raw_b.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
    want = b" " + text.encode()
    if b"".join(raw_a) != want or b"".join(raw_b) != want:
        return [], [], [], ""
    ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
    links = [(i, j) for i, x in enumerate(ends_a) for j, y in enumerate(ends_b) if x == y]
    groups, i0, j0 = [], 0, 0
    for i, j in links:
        groups.append(",".join(map(str, ids_a[i0:i + 1])) + "|" + ",".join(map(str, ids_b[j0:j + 1])))
        i0, j0 = i + 1, j + 1
    return ids_a, ids_b, links, ";".join(groups)


def brute(libraries, rows):
    got = [(d, *plain(libraries, t)) for d, t in rows]
    count = Counter((a[i], b[j]) for _, a, b, links, _ in got for i, j in links)
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for d, a, b, links, groups in got:
        pairs = [(a[i], b[j]) for i, j in links]
        out.append((d, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links),
                    sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs),
                    hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


STRANGE = ["", None, " ", "  ", "a", " a", "a ", "a  b", "\ta \n b\r\n", "x <|endoftext|> y", "<s> </s> <unk> <0x41>",
           "▁", "a ▁b", "naïve café über", "日本語のテキスト、漢字", "👩‍👩‍👧 family 👍🏽", "\x00 nul \x01", "a b 　c   d",
           "can't we'll I'd", "1234567890 3.14159", "é combined", "x" * 700, "﻿bom", "tab\t\t tab", "\u0085 nel ",
           "if (a[i] == b)  {\n    return;\n}\n"]


def test_against_the_libraries(spark, libraries):
    rng = random.Random(5)
    words = "the of and naïve über ghjk 12 3.5 Licence (c) ... émile 漢字 tokenizer's \n \t x<0x0A>".split(" ")
    rows = [(i, t) for i, t in enumerate(STRANGE)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    rows += [(7, "a repeated id"), (7, "a repeated id"), (None, "no id here"), (None, None)]
    docs = spark.createDataFrame([(d, t, d, "x") for d, t in rows], "doc_id long, text string, n_a long, pairs string")
    got = sorted([tuple(r) for r in al.cross_align(docs.repartition(5), *FILES).collect()], key=repr)
    assert got == brute(libraries, rows)


def test_long_texts_are_cut_into_lanes_and_blocks(spark, libraries, monkeypatch):
    rng = random.Random(6)
    rows = [(0, " ".join(rng.choice("alpha beta gamma délta 漢字漢字 unbreakable xq".split()) for _ in range(4000))),
            (1, "z" * 3000), (2, "漢" * 1200), (3, "one short text")]
    made = {}
    for t in rows:
        made[t[0]] = plain(libraries, t[1])
    groups = al.cross_align(spark.createDataFrame(rows, "doc_id long, text string"), *FILES, keep_groups=True).collect()
    assert {r["doc_id"]: r["groups"] for r in groups} == {d: m[3] for d, m in made.items()}
    assert [tuple(r)[:-1] for r in sorted(groups)] == brute(libraries, rows)


def test_small_blocks_sum_up_alike(libraries):
    """Lanes of any width mark the same tokens."""
    coder = al.PairCoder(*FILES)
    texts = ["some words with naïve endings and 漢字 " * 30, "short", "q" * 500]
    coded = coder.encode(texts)
    ids = [np.frombuffer(b"".join(c[k] for c in coded), "<u4").astype(int) for k in (0, 1)]
    ends = [np.cumsum(size[i]) for size, i in zip((coder.len_a, coder.len_b), ids)]
    bounds = np.concatenate([[0], np.cumsum([len(a) // 4 for a, _ in coded])])
    want = [np.isin(x, y) for x, y in (ends, ends[::-1])]
    for lane in (1, 2, 7, 256, 10 ** 6):
        got = al.lockstep(*ends, al.lanes(*ends, bounds, lane))
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_the_kept_parts_change_nothing(libraries, monkeypatch):
    monkeypatch.setattr(al.PairCoder, "MEMO", 5)
    coder = al.PairCoder(*FILES)
    for t in STRANGE * 2:
        a, b = coder.encode([t or ""])[0]
        want = plain(libraries, t)
        assert np.frombuffer(a, "<u4").tolist() == want[0] and np.frombuffer(b, "<u4").tolist() == want[1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert al.cross_align(docs, *FILES).collect() == []


def test_only_empty_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "▁")], "doc_id long, text string")
    assert sorted(tuple(r) for r in al.cross_align(docs, *FILES).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
