import hashlib
import random
import zlib

import numpy as np
import pytest

from hostgraph.llm import periodic_runs as pr


def brute_runs(words):
    """Every maximal stretch of each period, straight from the definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(6, 4 * q) and not any(
                    all(words[x] == words[x + p] for x in range(start, start + length - p)) for p in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(texts):
    number = {}
    flat = [number.setdefault(w, len(number)) for t in texts for w in t]
    bounds = np.cumsum([0, *map(len, texts)])
    doc, start, length, period = pr.find_runs(np.array(flat, np.int64), bounds)
    out = [[] for _ in texts]
    for row in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[row[0]].append(row[1:])
    return out


def brute_row(d, text):
    words = []
    if text:
        word = b""
        for c in text.encode():
            if c == 0x20 or 9 <= c <= 13:
                if word:
                    words.append(word)
                word = b""
            else:
                word += bytes([c])
        if word:
            words.append(word)
    n, h = len(words), None if d is None else zlib.crc32(str(d).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (d, len(runs), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


@pytest.mark.parametrize("seed", range(30))
def test_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(30):
        t = []
        while rng.random() < 0.85:
            unit = [rng.choice("abc"[:rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 14))]
            t += (unit * rng.randrange(1, 9))[:rng.randrange(1, 90)]
        texts.append(t)
    assert runs_of(texts) == [brute_runs(t) for t in texts]
    assert any(runs_of(texts))


def test_every_period_at_every_offset():
    """A run of exactly four periods, wherever its blocks fall, and one word less."""
    rng = random.Random(3)
    texts = []
    for q in [*range(1, 40), 63, 64, 65]:
        for before in range(0, 2 * q, max(1, q // 5)):
            unit = ["u%d" % i for i in range(q)]
            for length in (4 * q - 1, 4 * q, 4 * q + rng.randrange(q + 1)):
                texts.append(["x%d" % i for i in range(before)] + (unit * 6)[:length] + ["y", "z"])
    want = []
    for t in texts:
        at = next((i for i, w in enumerate(t) if w[0] == "u"))
        q, m = len({w for w in t if w[0] == "u"}), sum(w[0] == "u" for w in t)
        want.append([(at, m, q)] if m >= max(6, 4 * q) else [])
    assert runs_of(texts) == want


def test_nested_and_touching_runs():
    a = ["a"] * 6 + ["b"]
    texts = [a * 5, ["a"] * 50, ["a", "b"] * 4 + ["b", "a"] * 4, (["a"] * 7 + ["b"] * 7) * 4, ["c"], []]
    assert runs_of(texts) == [brute_runs(t) for t in texts]
    assert len(runs_of(texts)[0]) == 6


def test_long_text():
    rng = random.Random(8)
    t = ["w%d" % rng.randrange(300) for _ in range(3000)]
    t += t[1000:1900] * 5 + ["k"] * 4000 + ["w%d" % rng.randrange(5) for _ in range(3000)]
    got = runs_of([t])[0]
    assert (6900 in {m - m % 900 for _, m, _ in got} or any(q == 900 for _, _, q in got)) and any(q == 1 and m == 4000 for _, m, q in got)
    short = [r for r in got if r[2] < 60]
    assert short == [r for r in brute_small(t, 60)]


def brute_small(words, limit):
    out = []
    for q in range(1, limit):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(
                    all(words[x] == words[x + p] for x in range(i, j - i + q + i - p)) for p in range(1, q)):
                out.append((i, j - i + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 100, 500)
    m = pr.WaveletMatrix(v, 7)
    lo = rng.integers(0, 500, 400)
    hi = np.minimum(500, lo + rng.integers(0, 60, 400))
    x = rng.integers(0, 110, 400)
    want = [min((y for y in v[a:b].tolist() if y >= c), default=-1) for a, b, c in zip(lo, hi, x.tolist())]
    assert m.successor(lo, hi, x).tolist() == want


def test_rows_against_the_definition(spark):
    rng = random.Random(4)
    rows = []
    for d in range(300):
        n = rng.choice([0, 1, 3, 7, 40, 130])
        rows.append((d, rng.choice([" ", "\n", "  ", "\t\x0b"]).join(rng.choice("la lü li lo".split()) for _ in range(n))))
    rows += [(None, None), (None, "b " * 9), (5, ""), (6, None), (7, " \t"), (8, "a b c " * 20), (8, "a b c " * 20),
             (30, "nbsp stays joined here " * 4), (-4, "x y " * 12)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, starts int, period int")
    for step in (40, 10 ** 6):
        got = pr.digest(pr.word_runs(docs.repartition(4), plant=True, step_words=step)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted((brute_row(*r) for r in rows), key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pr.digest(pr.word_runs(docs)).collect() == []


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "so very very very very very very good")], "doc_id long, text string")
    r = pr.word_runs(docs).first()
    assert (r["starts"], r["lengths"], r["periods"], r["collapsed"]) == ([1], [6], [1], "so very good")
