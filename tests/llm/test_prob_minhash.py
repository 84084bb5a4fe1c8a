import random
from collections import Counter
from fractions import Fraction

import numpy as np

from hostgraph.llm import prob_minhash as pm
from hostgraph.llm.components import components
from hostgraph.llm.shingles import counted, probability_jaccard


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def exact(a, b):
    def bag(t):
        w = t.split()
        k = min(5, len(w))
        return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter()
    x, y = bag(a), bag(b)
    total = Fraction(0)
    for i in x.keys() & y.keys():
        total += 1 / sum(max(Fraction(x[j], x[i]), Fraction(y[j], y[i])) for j in x.keys() | y.keys())
    return total


def alike(a, b):
    """``exact(a, b) >= 8/10`` by the function that ``test_probability_jaccard_is_exact`` checks."""
    return probability_jaccard(counted(a), counted(b)) >= 0.8 - 1e-12


def corpus(seed=3):
    rng = random.Random(seed)
    out = []
    for g in range(12):
        base = words(rng, rng.choice([6, 40, 120, 300]))
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                own[rng.randrange(len(own))] = "changed%d" % rng.randrange(99)
            if rng.random() < 0.3:
                own += own[:20] * 3
            out.append(" ".join(own))
    return out


def test_probability_jaccard_is_exact():
    texts = corpus()[:14] + ["", "one two", "one two", "a b c d e " * 30]
    for a in texts:
        for b in texts:
            assert abs(probability_jaccard(counted(a), counted(b)) - float(exact(a, b))) < 1e-9


def test_registers_estimate_it():
    texts = [t for t in corpus() if t][:20]
    sets = [counted(t) for t in texts]
    sig = pm.signatures(sets, 2048)
    assert np.array_equal(sig[3], pm.signatures([sets[3]], 2048)[0])     # whatever else is in the batch
    for i in range(len(sets)):
        for j in range(i):
            assert abs((sig[i] == sig[j]).mean() - probability_jaccard(sets[i], sets[j])) < 0.06


def brute(rows):
    """class by doc_id"""
    ids = {}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    live = [(d, t) for d, t in rows if d is not None and t and t.split()]
    for i, (d, t) in enumerate(live):
        find(d)
        for e, s in live[:i]:
            if t == s or d == e or alike(t, s):
                join(d, e)
    for d, t in rows:
        ids[d] = find(d) if d is not None and t and t.split() else d
    return ids


def test_classes_against_brute_force(spark):
    texts = corpus(5)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[4]) for i in range(40)]                   # a large group of copies
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, ""), (None, texts[0]), (6, texts[2]), (3000, "two words"),
             (3001, "two words"), (3002, "two other")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, band int, node string")
    got = pm.near_duplicates(docs.repartition(5)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    classes = pm.near_duplicates(docs)
    kept = pm.keep_one(docs, classes)
    assert kept.columns == docs.columns
    # of each group of alike texts the row of its smallest id, and every row that links with nothing
    groups = {}
    same = text_groups(rows)
    for d, t in rows:
        if d is not None and t and t.split():
            groups[same[t]] = min(d, groups.get(same[t], d))
    alone = [r for r in rows if r[0] is None or not (r[1] or "").split()]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(
        [*groups.values(), *(d for d, _ in alone)], key=repr)


def text_groups(rows):
    """The first of the texts that each text is connected with."""
    texts = sorted({t for d, t in rows if d is not None and t and t.split()})
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if alike(a, b):
                root[find(a)] = find(b)
    return {t: find(t) for t in texts}


def test_different_texts_under_one_id(spark):
    """Each id has two texts; a third document is a near copy of the second."""
    rng = random.Random(11)
    rows = []
    for i in range(8):
        first, second = words(rng, 60), words(rng, 60)
        rows += [(i, " ".join(first)), (i, " ".join(second)), (100 + i, " ".join([*second[:-1], "changed"]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = pm.near_duplicates(docs.repartition(6))
    assert {r.doc_id: r.class_id for r in classes.collect()} == brute(rows)
    kept = sorted(tuple(r) for r in pm.keep_one(docs, classes).collect())
    assert kept == sorted(r for r in rows if r[0] < 100)      # both texts of each id, no near copy


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.82: at least 99 of 100 are found."""
    rng = random.Random(12)
    rows, pairs = [], 0
    while pairs < 300:
        a = words(rng, 200)
        b = list(a)
        for _ in range(5):
            b[rng.randrange(len(b))] = "x%d" % rng.randrange(10 ** 6)
        if 0.80 <= probability_jaccard(counted(" ".join(a)), counted(" ".join(b))) < 0.82:
            rows += [(2 * pairs, " ".join(a)), (2 * pairs + 1, " ".join(b))]
            pairs += 1
    got = pm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.doc_id % 2 and r.class_id == r.doc_id - 1 for r in got) >= 297


def test_a_shared_passage_gives_no_rows(spark):
    """Short texts around one passage, not alike: they fill buckets, and what leaves a bucket is a forest."""
    rng = random.Random(13)
    passage = words(rng, 40)
    rows = [(i, " ".join([*words(rng, 4), *passage, *words(rng, 4)])) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in pm.near_duplicates(docs).collect()}
    want = brute(rows)
    assert sum(got[d] == want[d] for d in want) >= 0.99 * len(want)


def test_links_across_the_components_of_a_bucket(spark):
    """One row a band and one band: all meet in few buckets, and only verified pairs count."""
    texts = corpus(8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in pm.near_duplicates(docs, bands=60, rows=1).collect()}
    assert got == brute(list(enumerate(texts)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pm.near_duplicates(docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 200 + i) for i in range(1, 80)] + [(5, 5), (400, 390)]
    edges += [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(40)]
    got, _ = components(spark.createDataFrame(edges, "u long, v long"))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "u long, v long"))[0].count() == 0


def test_kept_rows_move_once(spark):
    """pipeline, near_copies: repeated rows were dealt out a second time, whole texts with them (disk)."""
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None)], "doc_id long, text string")
    classes = spark.createDataFrame([(1, bytes(16), True, True)], "doc_id long, text_key binary, kept boolean, linkable boolean")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = pm.keep_one(docs, classes)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x]
    # the texts once; the kept ones in two steps, for linkable rows and for the others; not the result again
    assert 0 < len(moved) <= 5, plan
