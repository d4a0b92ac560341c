"""Periodic runs against trying every period."""

import hashlib
import random
import tempfile
import time
from collections import Counter

import numpy as np
import pytest

from studyloom.llm import runs
from studyloom.llm.queries import op11, with_loops
from tests.llm import brute


def test_scales_cover_every_distance_once():
    for least in (2, 7, 12, 100):
        got = sorted((d, b) for b, lo, hi in runs.scales(least, 900) for d in range(lo, hi + 1))
        assert [d for d, _ in got] == list(range(1, 451)) and all(2 * b - 1 <= max(d, least - d) for d, b in got)
        assert all(hi - lo < 2 * b for b, lo, hi in runs.scales(least, 900))


@pytest.mark.parametrize("b", [1, 2, 8, 64])
def test_squared_differences_are_exact(b):
    rng = np.random.default_rng(b)
    x = rng.integers(0, 5000, 40 * b + 200).astype(np.uint64)
    at, first, last = np.array([0, b, 3 * b]), 2 * b - 1, 4 * b - 2
    want = [[int(sum((int(x[s + i]) - int(x[s + i + d])) ** 2 for i in range(b))) for d in range(first, last + 1)] for s in at]
    for prime in runs.PRIMES:
        got = runs.squared_differences(x, at, b, first, last, prime)
        assert got.tolist() == [[v % prime[0] for v in row] for row in want]


def words(r):
    n, few = r.choice([0, 1, 11, 12, 13, 40, 150]), r.choice([1, 2, 3, 60])
    w = [str(r.randrange(few)) for _ in range(n)]
    if n and r.random() < 0.6:
        s = r.randrange(n)
        p = r.randint(1, max(1, (n - s) // 2))
        w = [w[i] if i < s else w[s + (i - s) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least", [4, 12, 30])
def test_runs_equal_brute_force(least):
    r = random.Random(least)
    for _ in range(60):
        texts = [words(r) for _ in range(r.randint(1, 6))]
        for w, (own, left) in zip(texts, runs.looped([" ".join(w) for w in texts], least), strict=True):
            assert own == brute.word_runs(w, least)
            drop = {i for s, n, q in own for i in range(s + q, s + n)}
            assert left == " ".join(v for i, v in enumerate(w) if i not in drop)


@pytest.mark.parametrize("unit", [["a"], ["a", "b"], [str(i) for i in range(3000)]])
def test_long_repeating_texts_take_little_time(unit):
    t = time.monotonic()
    (own, left), = runs.looped([" ".join(unit * (60_000 // len(unit)))], 12)
    assert own == [(0, 60_000, len(unit))] and left.split() == unit
    assert time.monotonic() - t < 20


def test_query(spark, docs, nothing, records):
    got = Counter(tuple(r) for r in runs_digest(spark, docs))
    want = Counter()
    for i, t, *_ in records:
        w = brute.looped_words(i, t)
        own = brute.word_runs(w) if len(w) < 3000 else None
        if own is None:
            continue
        drop = {k for s, n, q in own for k in range(s + q, s + n)}
        top = min(((-n, s, q) for s, n, q in own), default=None)
        most = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(i, len(own), *most, sha("".join(f"{s},{n},{q}\n" for s, n, q in own)), sha(" ".join(v for k, v in enumerate(w) if k not in drop)))] += 1
    assert not want - got and sum(got.values()) == len(records)
    assert runs.periodic_runs(nothing).count() == 0
    assert any(r[0] == 209 and r[1] for r in got)


def runs_digest(spark, docs):
    folder = tempfile.mkdtemp(prefix="spark-")
    docs.write.parquet(f"{folder}/documents.parquet")
    return op11(spark, folder).collect()


def test_loops_follow_the_rule(spark, docs, records):
    got = Counter((r["doc_id"], tuple(brute.WORD.findall(r["text"] or ""))) for r in with_loops(docs).collect())
    assert got == Counter((i, tuple(brute.looped_words(i, t))) for i, t, *_ in records)
    assert sum(i is not None and not brute.crc(i) % 10 for i, *_ in records) > 2
