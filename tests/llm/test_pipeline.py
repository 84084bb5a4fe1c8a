import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as cp
from hostgraph.llm import toxicity
from test_pii import base
from test_prob_minhash import brute

SF = "/root/testdata/sf0.001"
NAMES = ["EMAIL", "IP", "CARD", "PHONE"]


def masked(text):
    spans = []
    for s, k, e in sorted(base(text), key=lambda x: (x[0], x[2])):
        if spans and spans[-1][1] > s:
            a, b, n = spans[-1]
            spans[-1] = (a, max(b, e), k if e - s > b - a else n)
        else:
            spans.append((s, e, k))
    out, at = "", 0
    for s, e, k in spans:
        out += text[at:s] + f"[{NAMES[k]}]"
        at = e
    return out + text[at:]


def test_stages_against_brute_force(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_copies", "pii", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = []
    for k, (_, f) in enumerate(cp.STAGES):
        out = f(spark, docs if not stages else stages[-1], SF)
        out.write.parquet(str(tmp_path / str(k)))
        stages.append(spark.read.parquet(str(tmp_path / str(k))))
    for s in stages[:-1]:
        assert s.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in model.score(docs).where("predicted = 1").collect()}
    one = {r.doc_id: r.text for r in stages[0].collect()}
    assert set(one) == set(rows) - bad and bad
    two = {r.doc_id for r in stages[1].collect()}
    classes = brute(list(one.items()))
    assert two == {d for d, c in classes.items() if d == c} and len(two) < len(one)
    three = {r.doc_id: r for r in stages[2].collect()}
    assert {d: r.text for d, r in three.items()} == {d: masked(one[d]) for d in two}
    assert any(r.text != one[d] and r.n_chars == len(r.text) for d, r in three.items())
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in stages[3].collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == two
    for d, parts in pieces.items():
        ids = np.array(t.encode(three[d].text, add_special_tokens=False).ids + [0], "<u4")
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        assert sum(r.length for r in parts) == len(ids) == parts[0].doc_tokens


def test_an_empty_corpus(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf/labels.parquet"))
    assert cp.run(spark, str(tmp_path / "sf")).count() == 0
