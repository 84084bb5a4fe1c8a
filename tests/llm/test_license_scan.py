import itertools
import random
import re

import duckdb
import pytest

from hostgraph.llm import license_scan as ls
from hostgraph.llm.license_templates import PHRASES, TEMPLATES
from hostgraph.llm.queries import license_sql


def spellings(items):
    """All word lists that a template accepts; a replaceable region's words are None."""
    out = [[]]
    for item in items:
        if isinstance(item, bytes):
            more = [[item]]
        elif isinstance(item, tuple):
            more = [[None] * n for n in range(item[0], item[1] + 1)]
        else:
            more = [[], *spellings(item)]
        out = [a + b for a in out for b in more]
    return out


def brute(words, templates):
    out = []
    for i in range(len(words)):
        for t, text in enumerate(templates):
            fit = [len(s) for s in spellings(ls.parse(text)) if s and i + len(s) <= len(words)
                   and all(x is None or x == y for x, y in zip(s, words[i:]))]
            if fit:
                out.append((i, i + max(fit), t))
    return out


SMALL = ["a b", "a <<var;words=1..3>> b", "b <<beginOptional>>c <<beginOptional>>a<<endOptional>> c<<endOptional>> a",
         "<<beginOptional>>c<<endOptional>> b <<var;words=0..2>> <<beginOptional>>a<<endOptional>> c",
         "a <<beginOptional>><<var;words=2..2>><<endOptional>> a"]


@pytest.mark.parametrize("seed", range(20))
def test_automaton_against_all_spellings(seed):
    rng = random.Random(seed)
    one = ls.TokenAutomaton(SMALL)
    for _ in range(40):
        words = [rng.choice([b"a", b"b", b"c", b"other"]) for _ in range(rng.randrange(25))]
        assert sorted(one.places(words)) == sorted(brute(words, SMALL))


def test_markup_that_is_wrong():
    for bad in ("a <<beginOptional>> b", "a <<var;words=3..1>>", "a <<other>>"):
        with pytest.raises(ValueError):
            ls.parse(bad)
    for bad in ("<<var;words=1..2>> a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            ls.TokenAutomaton([bad])


def fill(template, rng, regions=True):
    """A text that holds the template, its regions filled or left out by chance."""
    t = re.sub(r"<<var;words=(\d+)\.\.(\d+)>>", lambda m: " ".join(["Hölder"] * rng.randint(int(m[1]), int(m[2]))), template)
    while "<<beginOptional>>" in t:
        t = re.sub(r"<<beginOptional>>((?:(?!<<).)*)<<endOptional>>",
                   lambda m: m[1] if regions and rng.random() < 0.5 else "", t, flags=re.S)
    return t


def rows():
    rng = random.Random(2)
    out = [(0, None), (1, ""), (2, "..."), (3, "MIT License"), (4, "mit-licenseé"), (5, "cc by cc by CC, by"), (6, "gnu general"),
           (7, "The GNU General\nPublic   License and the Apache (license)"), (8, "K MIT LİCENSE"), (9, "apache license " * 500),
           (None, "mit license"), (3, "MIT License"), (10, "permission " * 3000), (11, "is licensed under the MIT License now"),
           (12, "漢字 cc by 漢字"), (13, "cc by-nc 4.0 under CC BY-NC 4.0."), (14, "under the the MIT License")]
    n = 100
    for label, t in TEMPLATES:
        for _ in range(4):
            words = fill(t, rng).split()
            out.append((n, "Before it: " + rng.choice([" ", "\n"]).join(words) + " — and after."))
            gone = words[:]
            del gone[rng.randrange(len(gone))]
            out.append((n + 1, " ".join(gone)))
            n += 2
    return out


def test_rows_against_sql(spark):
    import pandas as pd
    given = rows()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in given], "doc_id long, text string, n_words int, labels string")
    df = ls.digest(ls.scan(docs.repartition(3), PHRASES, TEMPLATES))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in given])
    rel = con.execute(license_sql())
    assert [c[0] for c in rel.description] == df.columns
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted(rel.fetchall(), key=repr)
    by = dict((r[0], r) for r in got)
    assert by[5][2:4] == (3, 0) and by[5][4] == 4 and by[9][2] == 500 and by[8][2] == 0 and by[4][2] == 0


def test_templates_accept_their_own_text():
    one = ls.TokenAutomaton([t for _, t in TEMPLATES])
    rng = random.Random(1)
    for n, (label, t) in enumerate(TEMPLATES):
        for _ in range(5):
            words = ls.words_of(fill(t, rng))
            assert any(x == n and stop == len(words) for _, stop, x in one.places(words))


def test_places_of_a_template_do_not_overlap(spark):
    docs = spark.createDataFrame([(1, "x y z y x y")], "doc_id long, text string")
    r = ls.scan(docs, [("p", "y")], [("t", "<<beginOptional>>x<<endOptional>> y <<var;words=0..1>>")]).first()
    assert [tuple(p)[:3] for p in r["places"] if not p["phrase"]] == [(0, 3, "t"), (3, 5, "t"), (5, 6, "t")]
    assert [tuple(p)[:2] for p in r["places"] if p["phrase"]] == [(1, 2), (3, 4), (5, 6)]


def test_states_begin_anew(monkeypatch):
    monkeypatch.setattr(ls, "MAX_STATES", 3)
    one = ls.TokenAutomaton(SMALL)
    words = [b"a", b"other", b"b", b"c", b"a", b"c", b"a"]
    assert one.places(words) == one.places(words) and sorted(one.places(words)) == sorted(brute(words, SMALL))


def test_empty_table(spark):
    assert ls.digest(ls.scan(spark.createDataFrame([], "doc_id long, text string"), PHRASES, TEMPLATES)).collect() == []
