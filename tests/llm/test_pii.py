"""Personal data: the patterns against plain ones, the field against every path, and words it was not trained on."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from studyloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(n // 10 + n % 10 for n in twice) % 10 == 0


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None,
                    "card": 12 <= len(d) <= 19 and plain_luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [(k, b, e) for b, _, k, e in sorted(out)]


PARTS = ["4539578763621486", "4539 5787 6362 1486", "+1 (626) 555-5759", "a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "007.08.9.255.1.2.3", "é", " ", "-", ".", "+", "12", "%@a-.b.c", "x@@y.z", "\n", "a@b.c@d.e"]


def test_patterns_equal_plain_ones():
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice(PARTS) if r.random() < 0.7 else r.choice("0123456789.+-@ ab()") for _ in range(r.randint(0, 9)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("unit", ["a", "1", "1.", "+1", "@", "a@", "1 ", "+1-", "a.b@c", "1.2.3.4.", "4539578763621486 "])
def test_long_hostile_texts_take_little_time(unit):
    model, text, t = pii.trained(), unit * (400_000 // len(unit)), time.monotonic()
    pii.field_spans([text], model)
    pii.base_spans(text)
    assert time.monotonic() - t < 12


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    e, moves, n = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3)), np.array([5, 1, 3])
    tags = rng.integers(0, 3, (3, 5))
    value, by_e, by_moves = pii.likelihood(e, moves, tags, n)

    def score(r, path):
        path = [0, *path, 0]
        return sum(moves[a, b] for a, b in itertools.pairwise(path)) + sum(e[r, t, y] for t, y in enumerate(path[1:-1]))

    want = sum(score(r, tags[r, : n[r]]) - np.log(sum(np.exp(score(r, p)) for p in itertools.product(range(3), repeat=n[r]))) for r in range(3))
    assert abs(value - want) < 1e-9
    for grad, array in ((by_e, e), (by_moves, moves)):
        for at in np.ndindex(array.shape):
            array[at] += 1e-5
            up = pii.likelihood(e, moves, tags, n)[0]
            array[at] -= 2e-5
            down = pii.likelihood(e, moves, tags, n)[0]
            array[at] += 1e-5
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-5


def test_islands_hold_the_best_path():
    model, rng = pii.trained(), np.random.default_rng(1)
    vocabulary = sorted({w for line in pii.LABELLED for w in pii.parsed(line)[0]})
    for _ in range(200):
        words = [vocabulary[i] for i in rng.integers(0, len(vocabulary), rng.integers(1, 30))]
        ids = np.array([0, *model.class_ids(words), 0])
        e, best, ways = model.scores(ids), None, []
        best = model.moves[0] + e[1]
        for t in range(2, len(ids) - 1):
            way = best[:, None] + model.moves
            ways.append(way.argmax(axis=0))
            best = way.max(axis=0) + e[t]
        path = [int((best + model.moves[:, 0]).argmax())]
        for way in reversed(ways):
            path.append(int(way[path[-1]]))
        assert model.tags(ids)[1:-1].tolist() == path[::-1]


NEW = [
    ("You can ask Mr. [name|Walter Quinn] about it, or ring [local_phone|646-555-0199].", 2),
    ("Please write to [spoken_email|greta at example dot org] today", 1),
    ("Her SSN is [id_number|321-54-9876] and she was born on [birth_date|03/04/1971].", 2),
    ("He lives at [address|48 Willow Road] near us", 1),
    ("Frau [name|Helga Stein] ist da", 1),
    ("IBAN: [id_number|AT61 1904 3002 3457 3201] for payment", 1),
    ("of +1 (269) 555-3296 4524132264652876 and", 2),
    ("The MIT License and the GNU General Public License. The The Of Of", 0),
    ("thorend 12.5 of ing 42 Anblewh. Sttible was 3 thonre in 2021", 0),
]


def test_words_not_in_the_table():
    model, right = pii.trained(), 0
    for line, n in NEW:
        want, text, at = set(), "", 0
        for m in pii.MARK.finditer(line):
            text += line[at : m.start()]
            want.add((m.group(1), len(text), len(text) + len(m.group(2))))
            text, at = text + m.group(2), m.end()
        text += line[at:]
        got = pii.field_spans([text], model)[0]
        assert len(got) == n or n, (text, got)
        right += len(want & set(got)) if want else len(got) == n
    assert right >= 0.85 * (sum(len(pii.MARK.findall(s)) or 1 for s, _ in NEW))


def test_spans_of_the_field_leave_base_ones():
    base = [("ip", 5, 10), ("email", 20, 30)]
    got = pii.merged(base, [("name", 0, 5), ("name", 9, 12), ("name", 10, 20), ("address", 25, 40), ("name", 30, 31)])
    assert got == [("name", 0, 5), base[0], ("name", 10, 20), base[1], ("name", 30, 31)]


def test_personal_data(spark, docs, nothing, records):
    extra = [(901, "my name is Ann Gray, mail a.b@c.de or +1 (626) 555-5759"), (902, "é 1.2.3.4 😀 4539578763621486")]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    got = Counter(tuple(r) for r in pii.personal_data(docs.select("doc_id", "text").union(more)).collect())
    assert sum(got.values()) == len(records) + 2
    spans = {r[0]: r[6] for r in got}
    for i, t in [(r[0], r[1]) for r in records] + extra:
        base = plain_spans(t or "")
        counts = [sum(s[0] == k for s in base) for k in PLAIN]
        digest = hashlib.sha256(",".join(f"{k}:{b}:{e}" for k, b, e in base).encode()).hexdigest()
        assert got[(i, *counts, digest, spans[i])]
    assert spans[901] == "name:11:19,email:26:34,phone:38:55" and spans[902] == "ip:2:9,card:12:28" and spans[200] == spans[201] == ""
    assert not any(s for i, s in spans.items() if i in range(1, 61))
    assert pii.personal_data(nothing).count() == 0
