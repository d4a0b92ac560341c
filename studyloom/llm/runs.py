"""Periodic runs of words, by block convolution at dyadic scales.

A run of period q and length L >= max(least, 2q) matches itself q words on over L - q >= max(q, least - q) words, a stretch
that holds a whole aligned block of B words where 2B - 1 is no more. So each scale B, a power of two, is asked for the
distances d whose largest such B it is: for every aligned block and every d, the sum of squared differences between the
block's word numbers and those d words on is worked out at once from prefix sums and one cross-correlation, by exact number
theoretic transforms of size 4B over the integers modulo primes whose product is above any such sum. A sum of 0 is an
occurrence; its distance seeds a run, which is extended word by word to both sides. Only blocks whose words all come again
within the scale's reach are transformed, and blocks well inside a run of a small period are passed over, as all their
occurrences are multiples of it.

Several documents are taken at once, as one sequence with a number of its own between two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from studyloom.llm.common import ODD_SPACE, SPACES, slices

#: primes with a primitive root and the power of two that divides p - 1: sizes up to 2^23, 2^26 and 2^27
PRIMES = ((998244353, 3, 23), (469762049, 3, 26), (2013265921, 31, 27))
#: elements of one batch of transforms
BATCH = 1 << 18


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return [w for w in SPACES.split(text) if w] if ODD_SPACE.search(text) else text.split()


def scales(least: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(B, first distance, last distance), by distance, for all distances up to half of `longest`."""
    q = 1
    while 2 * q <= longest:
        b = 1 << ((max(q, least - q) + 1) // 2).bit_length() - 1
        end = q
        while 2 * (end + 1) <= longest and end + 1 - q < 2 * b and 1 << ((max(end + 1, least - end - 1) + 1) // 2).bit_length() - 1 == b:
            end += 1
        yield b, q, end
        q = end + 1


@cache
def roots(p: int, g: int, size: int, inverse: bool) -> tuple[np.ndarray, ...]:
    """The powers of the roots of unity of each step, largest first."""
    out = []
    while size > 1:
        r = pow(g, (p - 1) // size, p)
        r, powers = pow(r, -1, p) if inverse else r, np.ones(1, np.uint64)
        while len(powers) < size // 2:
            powers = np.concatenate([powers, powers * np.uint64(pow(r, len(powers), p)) % np.uint64(p)])
        out.append(powers)
        size //= 2
    return tuple(out)


def less(x: np.ndarray, p: np.uint64) -> np.ndarray:
    """Numbers below 2p, modulo p: what goes below zero wraps to something large."""
    return np.minimum(x, x - p)


def transformed(a: np.ndarray, prime: tuple[int, int, int]) -> np.ndarray:
    """Rows of `a`, a power of two wide, transformed modulo the prime, in bit-reversed order."""
    p, (m, size) = np.uint64(prime[0]), a.shape
    for w in roots(prime[0], prime[1], size, False):
        half = len(w)
        pairs = a.reshape(m, -1, 2, half)
        u, v = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        out[:, :, 0] = less(u + v, p)
        np.remainder((u + (p - v)) * w, p, out=out[:, :, 1])
        a = out.reshape(m, size)
    return a


def restored(a: np.ndarray, prime: tuple[int, int, int]) -> np.ndarray:
    """The inverse of `transformed`, from bit-reversed order."""
    p, (m, size) = np.uint64(prime[0]), a.shape
    for w in reversed(roots(prime[0], prime[1], size, True)):
        half = len(w)
        pairs = a.reshape(m, -1, 2, half)
        u, v = pairs[:, :, 0], pairs[:, :, 1] * w % p
        out = np.empty_like(pairs)
        out[:, :, 0] = less(u + v, p)
        out[:, :, 1] = less(u + (p - v), p)
        a = out.reshape(m, size)
    return a * np.uint64(pow(size, -1, prime[0])) % p


def squared_differences(x: np.ndarray, at: np.ndarray, b: int, first: int, last: int, prime: tuple[int, int, int]) -> np.ndarray:
    """[block, d]: the sum of (x[i] - x[i + d])^2 over the b words from `at`, modulo the prime, for d = first … last.

    `x` goes on for at least b + last words after each block.
    """
    p, wide, size = np.uint64(prime[0]), b + last - first, 4 * b
    block, window = np.zeros((len(at), size), np.uint64), np.zeros((len(at), size), np.uint64)
    block[:, :b] = x[at[:, None] + np.arange(b - 1, -1, -1)]
    window[:, :wide] = x[at[:, None] + np.arange(first, first + wide)]
    block, window = block % p, window % p
    both = restored(transformed(block, prime) * transformed(window, prime) % p, prime)[:, b - 1 : wide]
    sums = np.zeros((len(at), wide + 1), np.uint64)
    np.cumsum(window[:, :wide] ** 2 % p, axis=1, out=sums[:, 1:])
    own = (block[:, :b] ** 2 % p).sum(axis=1, dtype=np.uint64)[:, None]
    # all terms stay below 2^64: b and wide are at most 2^27
    return (own + (sums[:, b:] - sums[:, : wide - b + 1]) + np.uint64(2) * (p - both)) % p


def occurrences(x: np.ndarray, at: np.ndarray, b: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of every occurrence of the blocks at `at`, by distance, then position."""
    most, product, primes = b * int(x.max()) ** 2, 1, []
    for prime in (q for q in PRIMES if 4 * b <= 1 << q[2]):
        primes.append(prime)
        product *= prime[0]
        if product > most:
            break
    found = []
    for lo in range(0, len(at), step := max(1, BATCH // (4 * b))):
        some = at[lo : lo + step]
        row, col = np.nonzero(squared_differences(x, some, b, first, last, primes[0]) == 0)
        for prime in primes[1:]:
            if not len(row):
                break
            still = np.unique(row)
            zero = squared_differences(x, some[still], b, first, last, prime) == 0
            same = zero[np.searchsorted(still, row), col]
            row, col = row[same], col[same]
        found.append((some[row], col + first))
    s, d = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((s, d))
    return s[order], d[order]


def stretch(x: np.ndarray, s: int, e: int, d: int) -> tuple[int, int]:
    """The longest (l, r) around (s, e) with x[i] = x[i + d] for l <= i < r. The ends of `x` match nothing."""
    for step in (64 << k for k in range(40)):
        n = min(step, len(x) - d - e)
        off = np.flatnonzero(x[e : e + n] != x[e + d : e + d + n])
        e += int(off[0]) if len(off) else n
        if len(off) or not n:
            break
    for step in (64 << k for k in range(40)):
        n = min(step, s)
        off = np.flatnonzero(x[s - n : s] != x[s - n + d : s + d])
        s -= n - 1 - int(off[-1]) if len(off) else n
        if len(off) or not n:
            break
    return s, e


def next_distances(x: np.ndarray) -> np.ndarray:
    """How many words on each word comes again; a very large number where it doesn't."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), np.iinfo(np.int64).max)
    same = x[order[1:]] == x[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def runs_of(x: np.ndarray, least: int, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of `x`, in order; no run is longer than `longest`.

    `x` holds word numbers from 0; a number that is there only once ends every run.
    """
    n, again = len(x), next_distances(x)
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # the run found so far that goes furthest from a word
    found: dict[tuple[int, int], int] = {}
    lone = np.uint64(x.max() + 1 if n else 0)
    for b, first, last in scales(least, longest):
        blocks = n // b
        at = np.flatnonzero(again[: blocks * b].reshape(blocks, b).max(axis=1) <= last) * b
        at = at[(reach[at] < at + b + last) | (period[at] > b)]
        if not len(at):
            continue
        padded = np.concatenate([x.astype(np.uint64), np.full(b + last, lone, np.uint64)])
        places, distances = occurrences(padded, at, b, first, last)
        new = (reach[places] < places + distances + b) | (distances % period[places] != 0)
        places, distances = places[new], distances[new]
        ends = np.flatnonzero(np.diff(distances, append=-1)) + 1
        for lo, hi in zip([0, *ends], ends, strict=False):
            s, d = places[lo:hi], int(distances[lo])
            s = s[(reach[s] < s + d + b) | (d % period[s] != 0)]
            k = 0
            while k < len(s):
                l, r = stretch(x, int(s[k]), int(s[k]) + b, d)
                if r + d - l >= max(least, 2 * d):
                    found[l, r + d] = min(d, found.get((l, r + d), d))
                    further = (reach[l : r + d] < r + d) | ((reach[l : r + d] == r + d) & (period[l : r + d] > d))
                    reach[l : r + d][further], period[l : r + d][further] = r + d, d
                k = int(np.searchsorted(s, r - b, side="right"))
    return sorted((l, r, q) for (l, r), q in found.items())


def looped(texts: list[str | None], least: int) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """For each text its runs (start, length, period), by start, then period, and what is left of its words."""
    split = [words_of(t) for t in texts]
    ids: dict[str, int] = {}
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in split])])
    x = np.empty(starts[-1], np.int64)
    for begin, w in zip(starts, split, strict=False):
        x[begin : begin + len(w)] = [ids.setdefault(v, len(ids)) for v in w]
    x[starts[1:] - 1] = len(ids) + np.arange(len(split))
    runs = runs_of(x, least, max(map(len, split), default=0))
    edge = np.zeros(len(x) + 1, np.int64)
    for l, r, q in runs:
        edge[l + q] += 1
        edge[r] -= 1
    kept, at = np.cumsum(edge[:-1]) == 0, 0
    for begin, end, w in zip(starts, starts[1:], split, strict=False):
        first = at
        while at < len(runs) and runs[at][0] < end:
            at += 1
        own = sorted((int(l - begin), int(r - l), q) for l, r, q in runs[first:at])
        own.sort(key=lambda v: (v[0], v[2]))
        yield own, " ".join(w if not own else [v for v, k in zip(w, kept[begin : end - 1].tolist(), strict=True) if k])


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for part in slices(batch, "text"):
            runs, left = zip(*looped(part.column("text").to_pylist(), least), strict=True)
            dicts = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs]
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "runs": pa.array(dicts, kind), "collapsed": pa.array(left, pa.string())})


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """(key, runs, collapsed) of every row.

    runs: start (word number), length and smallest period, in words, of every longest stretch of period q and at least
    max(`least`, 2q) words, by start, then period; runs may overlap. collapsed: the words that no run holds after its first
    q, joined by one space. A null or empty text has no runs and collapses to ''. Repeated rows count each for itself; other
    columns are not looked at. Texts are taken whole, nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    schema = f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return d.mapInArrow(lambda b: _runs(b, least), schema).withColumnRenamed("id", key)
