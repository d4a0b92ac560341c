"""Phrase collocations against counting every phrase."""

import random

import numpy as np
import pytest

from studyloom.llm import collocations as C
from tests.llm import brute

SCHEMA = "lang string, text string, n long, h long, words string"


def corpus(seed):
    """Few words, planted phrases, repeats of one word, every kind of stop; three languages, one of them null."""
    r, out = random.Random(seed), []
    for lang, few in (("xx", 30), ("yy", 6), (None, 12)):
        names = [f"w{i}é"[: 2 + i % 3] + str(i) for i in range(few)]
        planted = [[r.choice(names) for _ in range(r.randint(2, 6))] for _ in range(8)]
        for _ in range(60):
            words = []
            for _ in range(r.randint(0, 40)):
                words += r.choice(planted) if r.random() < 0.4 else [r.choice(names)] * (r.randint(2, 9) if r.random() < 0.1 else 1)
            text = "".join(w.upper() if r.random() < 0.1 else w for w in [w + r.choice([" "] * 12 + [", ", ".", "\n", "\t", "  ", "\x85 ", "? ", "\r\n"]) for w in words])
            out.append((lang, text))
    return out + [("xx", None), ("yy", ""), ("zz", "one two three"), ("xx", " ,. \n")]


@pytest.mark.parametrize(("least", "most", "first", "growth"), [(8, 15, 6, 3), (5, 2000, 1000, 2), (20, 3, 2, 4)])
def test_collocations_equal_brute_force(spark, least, most, first, growth, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 40)
    rows = corpus(least)
    docs = spark.createDataFrame([(la, t, 1, 2, "x") for la, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in C.collocations(docs, least=least, most=most, first=first, growth=growth).collect())
    want = sorted(brute.collocations(rows, least, most))
    assert want and got == want


def test_bounds_end_languages_early(spark):
    """With room at the top, words whose bound lies below the last wanted score are never grown."""
    r = random.Random(4)
    rows = [("xx", " ".join(f"a{i % 40}" if r.random() < 0.2 else "the" for i in range(400)) + f" rare{i % 9} pair{i % 9}") for i in range(200)]
    docs = spark.createDataFrame([(la, t, 1, 2, "x") for la, t in rows], SCHEMA)
    seen = []
    whole = C.Corpus.grown
    try:
        C.Corpus.grown = lambda self, k, f, p: (seen.append((k, len(p))), whole(self, k, f, p))[1]
        got = [tuple(x) for x in C.collocations(docs, least=20, most=9, first=20, growth=2).collect()]
    finally:
        C.Corpus.grown = whole
    assert sorted(got) == sorted(brute.collocations(rows, 20, 9))
    assert sum(n for k, n in seen if k == 2) <= 40


def test_empty_and_rare(spark, nothing, docs):
    assert C.collocations(nothing).count() == 0
    assert C.collocations(docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_set_of_hashes():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    assert C.Among(h[:2000])(h).tolist() == [True] * 2000 + [False] * 3000
    assert not C.Among(h[:0])(h).any()


def test_large_counts_are_exact(spark):
    n, a = 10**15 + 7, 3 * 10**11 + 1
    d = spark.createDataFrame([(a, n, a + 5, a + 9)], "a long, n long, l long, r long")
    assert d.selectExpr(C.quotient("a", "cast(l as decimal(19,0)) * cast(r as decimal(19,0))")).first()[0] == 1000 * a * n // ((a + 5) * (a + 9))
