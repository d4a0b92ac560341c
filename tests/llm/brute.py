"""Plain versions of the operators, on lists."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near_components(docs, width, percent=80):
    """id -> smallest id reachable; docs: list of (id, text)."""
    sets = [(i, shingles(t, width)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for i in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def base_scores(docs, held):
    """id -> (tokens, known, base score); docs: list of (row, id, text)."""
    tokens = {r: [*WORD.findall((t or "").translate(LOWER)), " "] for r, _, t in docs}
    c = Counter(w for r, i, _ in docs if not held(i) for w in tokens[r])
    n, v = sum(c.values()), len(c)
    return n, {r: (len(w), sum(c[x] > 0 for x in w), math.fsum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for r, w in tokens.items()}


def pair_scores(train, docs, mu):
    """id -> log10 probability with exact counts of words and pairs."""
    split = lambda t: [*WORD.findall((t or "").translate(LOWER)), " "]
    c, two = Counter(), Counter()
    for t in train:
        w = split(t)
        c.update(w)
        two.update(zip([" ", *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    p = lambda x: (c[x] + 0.5) / (n + 0.5 * (v + 1))
    return {i: math.fsum(math.log10((two[a, b] + mu * p(b)) / (c[a] + mu)) for a, b in zip([" ", *split(t)], split(t), strict=False)) for i, t in docs}


def crc(key):
    return zlib.crc32(str(key).encode())


def mix_targets(sizes):
    """source -> target; sizes: source -> words, None last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free, left, out = set(names), 1.5 * sum(sizes.values()), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > 2 * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def greedy_bpe(symbols, ranks):
    """The textbook form: merge the best pair, leftmost first, until none is left."""
    s = list(symbols)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            return s
        i = best[1]
        s[i : i + 2] = [s[i] + s[i + 1]]


def top_k(vectors, queries, k):
    """[(query, rank, id, score)]; vectors: id -> list of ints."""
    out = []
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def groups_by(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


def word_runs(w, least=12):
    """[(start, length, period)] by trying every period."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def looped_words(key, text):
    """The words of a document of the contract: every tenth one, by its id's hash, goes round from some word on."""
    w = WORD.findall(text or "")
    if key is None or crc(key) % 10 or not w:
        return w
    n, g = len(w), crc(key) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collocations(docs, least, most):
    """[(lang, rank, phrase, a, l, r, n, score)] from counts of all phrases; docs: list of (lang, text)."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 7):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if 2 <= len(p) <= 5 and a >= least}
        drop = {q for p, a in good.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if (q := p[i : i + k]) in good and 100 * a >= 100 * good[q]}
        rows = []
        for p, a in good.items():
            if p not in drop:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:most])]
    return out
