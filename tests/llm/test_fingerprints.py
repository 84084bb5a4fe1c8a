import hashlib
import random

import numpy as np

from hostgraph.llm import fingerprints as fp
from hostgraph.llm.shingles import shingle_hashes, word_hashes


def text(rng, n):
    return " ".join("w%d" % rng.randrange(5000) for _ in range(n))


def jaccard(a, b):
    def bag(t):
        w = t.split()
        k = min(5, len(w))
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    x, y = bag(a), bag(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_likeness_estimates_jaccard():
    rng = random.Random(1)
    off = []
    for n in (3, 8, 60, 400, 3000):
        for share in (0.0, 0.05, 0.3, 0.8):
            a = text(rng, n).split()
            b = list(a)
            for i in range(int(n * share)):
                b[i] = "x%d" % rng.randrange(5000)
            a, b = " ".join(a), " ".join(b)
            got = fp.likeness(fp.text_fingerprint(a), fp.text_fingerprint(b))
            off.append(got - jaccard(a, b))
            assert abs(off[-1]) < (0.12 if n >= 60 else 0.35)
    assert abs(np.mean(off)) < 0.03
    assert abs(np.mean([fp.likeness(fp.text_fingerprint(text(rng, 300)), fp.text_fingerprint(text(rng, 300)))
                        for _ in range(50)])) < 0.03       # unrelated ones agree by chance, corrected


def test_densification_uses_only_full_bins():
    for n in (1, 2, 5, 100):
        h = shingle_hashes(word_hashes(text(random.Random(n), n)))
        values = np.full(512, 7, np.uint64)
        full = np.zeros(512, bool)
        full[(h >> np.uint64(55)).astype(int)] = True
        values[full] = np.arange(full.sum()) + 100
        out = fp.densify(values, full)
        assert set(out.tolist()) <= set(values[full].tolist())
        assert (out[full] == values[full]).all()
    assert fp.fingerprint(np.empty(0, np.uint64)) == b""
    assert len(fp.text_fingerprint("one word")) == fp.BINS * fp.BITS // 8


def want(rows):
    out = []
    rows = sorted(rows, key=lambda r: ((-1, "") if r[0] is None else (r[0], ""), r[1] or ""))
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edited = t[:len(t) - n] + nxt[:n]
        f, e, x = map(fp.text_fingerprint, (t, edited, nxt))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, fp.likeness(f, e), fp.likeness(f, x)))
    return sorted(out, key=repr)


def test_neighbours_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i * 7, text(rng, rng.choice([0, 1, 4, 30, 300]))) for i in range(60)]
    rows += [(500, "é漢😀" * 9), (501, None), (502, ""), (503, "ab"), (14, rows[2][1]), (None, "null id here"), (600, text(rng, 20000))]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, end int, head_text string")
    got = [(r.doc_id, r.n_chars, r.edited_sha256, bytes(r.fingerprint), bytes(r.edited_fingerprint), r.near_edited, r.near_next)
           for r in fp.compare_neighbours(df.repartition(6)).collect()]
    assert sorted(got, key=repr) == want(rows)
    plain = {(r.doc_id, r.n_chars): bytes(r.fingerprint) for r in fp.fingerprints(df).collect()}
    assert all(plain[d, n] == f for d, n, _, f, _, _, _ in got)


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    r = fp.compare_neighbours(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert fp.compare_neighbours(one.where("false")).count() == 0


def test_range_ends_meet_behind_a_shuffle(spark):
    """The written table is scanned by many tasks, not by the one that settles the ends."""
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    plan = fp.compare_neighbours(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "Exchange SinglePartition" in plan


def test_densification_follows_the_draws_and_looks_at_no_more_than_it_needs():
    import tracemalloc
    rng = np.random.default_rng(5)
    draws = fp._draws(512, 4096)
    for n in (1, 3, 5, 40, 300, 512):
        full = np.zeros(512, bool)
        full[rng.choice(512, n, replace=False)] = True
        values = rng.integers(0, 1 << 50, 512).astype(np.uint64)
        tracemalloc.start()
        out = fp.densify(values, full)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 1 or peak < 1_500_000       # 4096 draws of every bin that missed 64 times are several MB
        at = np.flatnonzero(full)
        for i in range(512):
            hits = np.flatnonzero(full[draws[:, i]])
            source = i if full[i] else draws[hits[0], i] if len(hits) else at[np.searchsorted(at, i) % n]
            assert out[i] == values[source]


def test_bits_are_packed_lowest_first():
    h = shingle_hashes(word_hashes(text(random.Random(3), 900)))
    for bits in (1, 2, 4, 8):
        low = np.unpackbits(np.frombuffer(fp.fingerprint(h, 64, bits), np.uint8)).reshape(64, bits)
        minima = [min(int(x) & (1 << 58) - 1 for x in h if int(x) >> 58 == b) for b in range(64)]
        assert [sum(int(v) << k for k, v in enumerate(row)) for row in low] == [m & (1 << bits) - 1 for m in minima]
