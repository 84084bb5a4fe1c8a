import hashlib
import re

import pytest

from hostgraph.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = ["", None, "mail a.b+c@x-y.example.com, and _d@e.f@g.h.i_j@k.l", "a@b.c_d@e.f a@b @c.d x@y..z %@a.b-", "@" * 50,
         "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 000001.2.3.4 1..2.3.4 00255.0.0.0256", "4111 1111 1111 1111 and 4111-1111-1111-1112",
         "x4111111111111111y 411111111111111100000000 4111  1111 1111 1111", "+1 (771) 555-1655 +49.30.1234567 +1 +12 3 + 1 2345678901",
         "+1 234 567 890 123 456 7 +1()()()2 ++1 234567890", "é漢😀 é@x.yz 😀 10.1.2.3 漢 +1 (771) 555-1655",
         "1" * 30000, "a" * 30000 + "@", "1 " * 20000, "a." * 9000 + "@b", "1.1.1." * 5000 + "x", "4111111111111111@a.b 1.2.3.4@c.d",
         "5500-0000-0000-0004 6011 0009 9013 9424", "tel:+1-202-555-0143x10.0.0.256"]


def test_base_spans_against_python(spark):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "c"), (6, TEXTS[6], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    got = pii.digest(pii.find(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[2 if r.doc_id is None else r.doc_id] or ""
        want = base(text)
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.spans == joined and r.n_added == 0, text[:60]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"Please call me at +1 (202) 555-0{100 + i} for details about item {i}.") for i in range(30)]
    rows += [(100, "Please call me at 555-0199 for details."), (101, "we sold 555-0198 pieces in 1999 for cash"),
             (102, "call me at 555-0199 for a chat"), (103, None), (104, "")]
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, text_key string, n_chars int")
    found = pii.find(docs)
    got = {r.doc_id: r for r in pii.digest(found).collect()}
    text = dict(rows)
    assert got[100].spans == "phone:18:26" and got[100].n_phone == 0 and text[100][18:26] == "555-0199"
    assert got[102].spans == "phone:11:19"
    assert got[101].spans == "" and all(got[i].n_added == 0 for i in range(30))
    clean = pii.redact(docs, found)
    assert clean.columns == docs.columns
    out = {r.doc_id: r for r in clean.collect()}
    assert out[100].text == "Please call me at [PHONE] for details." and out[100].n_chars == len(out[100].text)
    assert out[5].text == "Please call me at [PHONE] for details about item 5."
    assert out[101].text == text[101] and out[101].n_chars == 7 and out[103].text is None


def test_unseen_identifiers_of_several_tokens(spark):
    """Digit groups in the form of the seeds are one instance, in the context around the whole run."""
    want = {100: "(202) 555-0199", 101: "202 555 0199", 102: "4111 1111 1111 1112", 103: "202.555 0198", 104: "202 555 0197",
            105: "(0202) 555 0196", 106: None, 107: None}
    rows = [(i, f"Please call me at +1 (202) 555-0{100 + i} for details about item {i}.") for i in range(30)]
    rows += [(100, "Please call me at (202) 555-0199 for details."), (101, "Please call me at 202 555 0199 for details."),
             (102, "Please call me at 4111 1111 1111 1112, for details"), (103, "é😀 call me at 202.555 0198) or so"),
             (104, "call me at 202 555 0197 10.0.0.1"), (105, "call me at (0202) 555 0196x12 or so"),
             (106, "we sold 202 555 0195 pieces in 1999 2000 for cash"), (107, "1 2 3 " * 900 + "(1 " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(docs)
    got, text = {r.doc_id: r for r in found.collect()}, dict(rows)
    for i, value in want.items():
        assert [text[i][s.start:s.end] for s in got[i].added] == ([value] if value else []), text[i][:60]
        assert all(pii.KINDS[s.kind] == "phone" for s in got[i].added)
    out = {r.doc_id: r.text for r in pii.redact(docs, found).collect()}
    assert out[100] == out[101] == "Please call me at [PHONE] for details."
    assert out[104] == "call me at [PHONE] [IP]" and out[106] == text[106]


def test_redaction_of_overlaps_and_repeated_rows(spark):
    rows = [(1, "a 4111111111111111@a.b c"), (1, "a 4111111111111111@a.b c"), (None, "x@y.zz"), (2, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(r.text for r in pii.redact(docs, pii.find(docs)).collect())
    assert out == ["[EMAIL]", "a [EMAIL] c", "a [EMAIL] c", "nothing"]


def test_long_text(spark):
    """Every place of a text of 10,000 instances (far over a block and a page) with overlapping spans."""
    words, at, want, plain = [], 0, [], []
    for i in range(10000):
        w = ["x%06d@y.zz" % i, "10.0.0.%d" % (i % 256), "n%06dz" % i, "4111111111111111@a.b", "é😀"][i % 5]
        words.append(w)
        want += [(at + s, k, at + e) for s, k, e in base(w)]
        if w[0] == "n":
            plain.append((at, at + 8, w, "1000%d" % ((i - 1) % 256), "4111111111111111ab"))
        at += len(w) + 1
    text = " ".join(words)
    assert sorted(want) == base(text)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.extract(docs, "doc_id", "text").collect()[0]
    assert sorted((s.start, s.kind, s.end) for s in row.base) == base(text)
    assert sorted((s.start, s.end, s.value, s.near, s.next) for s in row.seen if s.kind is None) == plain
    out = pii.redact(docs, pii.find(docs)).collect()[0].text.split(" ")
    assert out == [{"x": "[EMAIL]", "1": "[IP]", "4": "[EMAIL]"}.get(w[0], w) for w in words]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.find(docs)).count() == 0


def test_native(spark):
    import ast
    import inspect
    for module in (pii,):
        names = {n.attr for n in ast.walk(ast.parse(inspect.getsource(module))) if isinstance(n, ast.Attribute)}
        assert not names & {"udf", "pandas_udf", "mapInPandas", "mapInArrow", "applyInPandas", "rdd"}
