"""Personal data: patterns for what has a fixed form, a linear-chain conditional random field for what has none.

The field tags every word O or a kind. Its features are a word's shape, outline and (for words of the labelled table) the
word itself, of the word, its neighbours and the one before those. It is trained once, on the labelled table of a few
hundred short lines, by the gradient of its log-likelihood from forward and backward sums.

Texts are decoded whole, by Viterbi in numpy batches. A word is surely O when O leads by more than any transitions to and
from it can make up; no best path tags it otherwise, so it splits the chain. What is left are short islands, decoded side
by side, sorted by length.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from studyloom.llm.common import slices
from studyloom.llm.pii_labels import LABELLED

BASE_KINDS = ("email", "ip", "card", "phone")
FIELD_KINDS = ("name", "address", "local_phone", "spoken_email", "id_number", "birth_date", "card_number")
ORDER = {k: i for i, k in enumerate(BASE_KINDS + FIELD_KINDS)}
Span = tuple[str, int, int]

# the patterns of the contract, with no way to try one stretch twice
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield "email", begin, m.end()
        # what the match took, or at least this sign, can't begin another one
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that fail their check left out."""
    out = list(emails(text)) if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGITS.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


# words and features --------------------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
AFTER, BEFORE = ".,;:!?\"'", "\"'"
MARK = re.compile(r"\[(" + "|".join(FIELD_KINDS) + r")\|(.*?)\](?=[^\]\w]*(?:\s|$))")
#: words of the labelled table that are features themselves are there so often at least
LEAST_SEEN = 2
LONGEST = 40


def shape(word: str) -> str:
    """Letters by case, digits one by one up to five in a row, other signs as they are; what comes three times or more is shortened."""
    out = []
    for c in word[:LONGEST]:
        s = "d" if c in "0123456789" else "X" if c.isupper() else "x" if c.isalpha() else c if c.isascii() else "u"
        if s == "d" and out[-5:] == ["d"] * 5 or s != "d" and out[-1:] == [s]:
            continue
        out.append(s)
    return "".join(out)


def features(word: str) -> list[str]:
    core = word.rstrip(AFTER).lstrip(BEFORE)
    s = shape(core)
    digits = sum(c == "d" for c in s)
    kind = "low" if s == "x" else "cap" if s == "Xx" else "up" if s == "X" else "num" if s and set(s) <= set("d") else "part" if digits else "other"
    end = word[len(word.rstrip(AFTER)) :][:1]
    return [f"s={s}", f"k={kind}", f"n={min(digits, 9)}", f"e={end}", f"w={core.lower()[:LONGEST]}", f"b={s[:1]}", "long" if len(core) > 30 else "short"]


#: where a feature is seen from: the word itself, the next one, the one before, the one two before
PLACES = ((0, "own"), (-1, "before"), (1, "after"), (-2, "second"))
EDGE = "\n"


def parsed(line: str) -> tuple[list[str], list[int]]:
    """Words and tags of a labelled line; tag 0 is O."""
    words, tags, at = [], [], 0
    for m in MARK.finditer(line):
        before = WORDS.findall(line[at : m.start()])
        own = WORDS.findall(m.group(2))
        words, tags = words + before + own, tags + [0] * len(before) + [1 + FIELD_KINDS.index(m.group(1))] * len(own)
        at = m.end()
        # signs right after a span belong to its last word
        tail = re.match(r"\S*", line[at:]).group()
        words[-1] += tail
        at += len(tail)
    rest = WORDS.findall(line[at:])
    return words + rest, tags + [0] * len(rest)


# the field -----------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights: `tables[p][f]` of feature f seen from place p, for each tag; `moves[a, b]` from tag a to tag b."""

    known: dict[str, int]
    tables: np.ndarray
    moves: np.ndarray
    classes: dict[tuple[int, ...], int] = field(default_factory=dict)
    kept: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)
    stacked: np.ndarray | None = None

    def __post_init__(self) -> None:
        # the largest gain that any tag but O can have from its two moves
        gain = self.moves[:, :, None] + self.moves[None] - self.moves[:, :1, None] - self.moves[None, :1]
        self.gain = float(gain[:, 1:].max())
        self.number("edge", (), EDGE)
        self.plain = self.of("qqzzqq")
        self.capital = self.of("Qqzzqq")
        self.familiar = {f[2:] for f in self.known if f.startswith("w=")}

    def __reduce__(self):
        return Field, (self.known, self.tables, self.moves)

    def number(self, kind: str, active: tuple[int, ...], word: str) -> int:
        k = self.classes.get((kind, *active))
        if k is None:
            k = self.classes[kind, *active] = len(self.rows)
            row = self.tables[:, list(active)].sum(axis=1)
            if kind == "edge":
                row[0, 1:] = -1e6  # the edge of a text is never tagged
            self.rows.append(row)
            self.stacked = None
        return k

    def of(self, word: str) -> int:
        """The class of a word: words whose known features are the same share one."""
        return self.number("word", tuple(sorted({self.known[f] for f in features(word) if f in self.known})), word)

    def class_ids(self, words: Sequence[str]) -> list[int]:
        kept, out, familiar = self.kept, [], self.familiar
        if len(kept) > 200_000:
            kept.clear()
        for w in words:
            k = kept.get(w)
            if k is None:
                if w.isalpha() and len(w) <= 30 and w.lower() not in familiar and (w.islower() or (w[1:].islower() and w[0].isupper())):
                    # an ordinary word has no other features than this
                    k = self.plain if w.islower() else self.capital
                else:
                    k = EDGE_CLASS if w == EDGE else self.of(w)
                if len(w) <= LONGEST:
                    kept[w] = k
            out.append(k)
        return out

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """[word, tag]; `ids` begin and end with the edge's class."""
        if self.stacked is None:
            self.stacked = np.stack(self.rows, axis=1)
        out = self.stacked[0][ids]
        for p, (shift, _) in enumerate(PLACES[1:], 1):
            k = abs(shift)
            if shift < 0:
                out[k:] += self.stacked[p][ids[:-k]]
            else:
                out[:-k] += self.stacked[p][ids[k:]]
        return out

    def tags(self, ids: np.ndarray) -> np.ndarray:
        """The tags of the best path through each text of the concatenation."""
        e = self.scores(ids)
        unsure = e[:, 0] - e[:, 1:].max(axis=1) <= self.gain
        unsure[[0, -1]] = False
        out = np.zeros(len(ids), np.int8)
        edge = np.diff(unsure.astype(np.int8))
        begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        if len(begin):
            self.islands(e, begin, end, out)
        return out

    def islands(self, e: np.ndarray, begin: np.ndarray, end: np.ndarray, out: np.ndarray) -> None:
        """Viterbi over e[begin:end], O before and after, all islands at once; longer ones come first, so that those still
        going on are always the first rows."""
        order = np.argsort(begin - end, kind="stable")
        begin, n = begin[order], (end - begin)[order]
        best = self.moves[0] + e[begin]
        final, back = best + self.moves[:, 0], []
        for t in range(1, int(n[0])):
            live = int(np.searchsorted(-n, -t, side="left"))
            way = best[:live, :, None] + self.moves
            back.append(way.argmax(axis=1).astype(np.int8))
            best = way.max(axis=1) + e[begin[:live] + t]
            final[:live] = best + self.moves[:, 0]
        tag = final.argmax(axis=1)
        for t in range(int(n[0]) - 1, -1, -1):
            live = int(np.searchsorted(-n, -t, side="left"))
            out[begin[:live] + t] = tag[:live]
            if t:
                tag[:live] = back[t - 1][np.arange(live), tag[:live]]


EDGE_CLASS = 0


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)


def likelihood(e: np.ndarray, moves: np.ndarray, tags: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the tags [line, word] of lines of n words, and its gradients by scores and moves."""
    lines, longest, k = e.shape
    rows = np.arange(lines)
    on = np.arange(longest) < n[:, None]
    fore = np.empty_like(e)
    fore[:, 0] = moves[0] + e[:, 0]
    for t in range(1, longest):
        fore[:, t] = log_sum(fore[:, t - 1, :, None] + moves, 1) + e[:, t]
    aft = np.empty_like(e)
    aft[:, -1] = moves[:, 0]
    for t in range(longest - 2, -1, -1):
        on_step = log_sum(moves + (e[:, t + 1] + aft[:, t + 1])[:, None, :], 2)
        aft[:, t] = np.where((t + 1 < n)[:, None], on_step, moves[:, 0])
    total = log_sum(fore[rows, n - 1] + moves[:, 0], 1)
    of_tags = np.zeros_like(e)
    of_tags[rows[:, None], np.arange(longest), tags] = 1
    seen = np.where(on[:, :, None], np.exp(fore + aft - total[:, None, None]), 0.0)
    by_e = np.where(on[:, :, None], of_tags, 0.0) - seen
    by_moves, gold = np.zeros((k, k)), 0.0
    both = np.concatenate([np.zeros((lines, 1), int), np.where(on, tags, 0), np.zeros((lines, 1), int)], axis=1)
    for t in range(longest + 1):
        live = t <= n
        np.add.at(by_moves, (both[live, t], both[live, t + 1]), 1.0)
        gold += moves[both[live, t], both[live, t + 1]].sum()
    by_moves[0] -= seen[:, 0].sum(axis=0)
    by_moves[:, 0] -= seen[rows, n - 1].sum(axis=0)
    for t in range(1, longest):
        pair = np.exp(fore[:, t - 1, :, None] + moves + (e[:, t] + aft[:, t] - total[:, None])[:, None, :])
        by_moves -= pair[t < n].sum(axis=0)
    gold += (e * of_tags)[on].sum()
    return float(gold - total.sum()), by_e, by_moves


def jumbled(table: list[tuple[list[str], list[int]]], times: int = 2) -> list[tuple[list[str], list[int]]]:
    """Untagged lines of the table's untagged words among invented ones, in any order and with any capitals and stops: no
    word alone, and no capital after a stop, is personal data."""
    r = random.Random(5)
    plain = [w.strip(AFTER).lower() for words, tags in table for w, t in zip(words, tags, strict=True) if not t and w.strip(AFTER)]
    out = []
    for _ in range(times * len(table)):
        words = []
        for _ in range(r.randint(6, 14)):
            w = r.choice(plain) if r.random() < 0.5 else "".join(r.choice(("an", "er", "tio", "le", "qu", "o", "sch")) for _ in range(r.randint(1, 4)))
            w = w.capitalize() if r.random() < 0.3 or words and words[-1].endswith(".") else w
            words.append(w + (r.choice(".,.:") if r.random() < 0.2 else ""))
        out.append((words, [0] * len(words)))
    return out


@lru_cache(maxsize=4)
def trained(lines: tuple[str, ...] = tuple(LABELLED), rounds: int = 120, prior: float = 0.05) -> Field:
    """The field of greatest penalised likelihood on the labelled lines, by steps of adapted size on the whole gradient."""
    table = [parsed(line) for line in lines]
    table = [(w, t) for w, t in table + jumbled(table) if w]
    seen = Counter(x for w, _ in table for x in {f for v in w for f in features(v)})
    known = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= LEAST_SEEN or not f.startswith("w=")))}
    k, n = 1 + len(FIELD_KINDS), np.array([len(w) for w, _ in table])
    longest, places = int(n.max()), len(PLACES)
    # words by number, 0 for none: scores are looked up by word, gradients summed up by word
    names = {w: 1 + i for i, w in enumerate(sorted({w for words, _ in table for w in words}))}
    x = np.zeros((1 + len(names), len(known)))
    for w, i in names.items():
        x[i, [known[f] for f in features(w) if f in known]] = 1
    word, tags = np.zeros((places, len(table), longest), int), np.zeros((len(table), longest), int)
    for r, (words, own) in enumerate(table):
        tags[r, : len(own)] = own
        for p, (shift, _) in enumerate(PLACES):
            for t in range(len(words)):
                if 0 <= t + shift < len(words):
                    word[p, r, t] = names[words[t + shift]]
    weights, moves = np.zeros((places, len(known), k)), np.zeros((k, k))
    mean, square = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    by_word = np.zeros((places, len(x), k))
    for step in range(1, rounds + 1):
        e = sum((x @ weights[p])[word[p]] for p in range(places))
        _, by_e, by_moves = likelihood(e, moves, tags, n)
        by_word[:] = 0
        for p in range(places):
            np.add.at(by_word[p], word[p], by_e)
        grown = np.stack([x.T @ by_word[p] for p in range(places)])
        for i, (v, g) in enumerate(((weights, grown - prior * weights), (moves, by_moves - prior * moves))):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            v += 0.1 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return Field(known, weights, moves)


# spans ---------------------------------------------------------------------------------------------------------------

#: one to four words with a space between; fewest digits that a span of the field must hold
NAME = re.compile(r"[^\W\d_][\w'’-]*(?: [^\W\d_][\w'’-]*){0,3}")
DIGITS = {"local_phone": 7, "id_number": 6, "birth_date": 5, "address": 1}


def believed(kind: str, text: str) -> bool:
    """What a span of its kind must have whatever the field says."""
    if kind == "name":
        return bool(NAME.fullmatch(text)) and all(w[0].isupper() for w in text.split(" "))
    if kind == "spoken_email":
        return bool(re.match(r"\S+\s+\W?at\b.*\bdot\b", text))
    if kind == "card_number":
        return 12 <= len(d := NOT_DIGITS.sub("", text)) <= 19 and luhn(d)
    return len(DIGIT.findall(text)) >= DIGITS[kind]


def field_spans(texts: Sequence[str], model: Field) -> list[list[Span]]:
    """The field's spans of each text."""
    words: list[str] = [EDGE]
    starts = []
    for t in texts:
        starts.append(len(words))
        words += WORDS.findall(t)
        words.append(EDGE)
    tags = model.tags(np.array(model.class_ids(words), np.int64))
    out: list[list[Span]] = [[] for _ in texts]
    named = np.flatnonzero(tags)
    for r in np.unique(np.searchsorted(starts, named, side="right") - 1) if len(named) else []:
        at = [m.span() for m in WORDS.finditer(texts[r])]
        own, text, i = tags[starts[r] : starts[r] + len(at)], texts[r], 0
        while i < len(at):
            if not own[i]:
                i += 1
                continue
            j = i
            while j < len(at) and own[j] == own[i]:
                j += 1
            raw = text[at[i][0] : at[j - 1][1]]
            begin = at[i][0] + len(raw) - len(raw.lstrip(BEFORE))
            end = at[j - 1][1] - (len(raw) - len(raw.rstrip(AFTER)))
            kind = FIELD_KINDS[own[i] - 1]
            if begin < end and believed(kind, text[begin:end]):
                out[r].append((kind, begin, end))
            i = j
    return out


def merged(base: list[Span], more: list[Span]) -> list[Span]:
    """The base spans and those of the field that touch none of them, by start, then kind."""
    if not more:
        return base
    taken = sorted((b, e) for _, b, e in base)
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, np.int64)
    begins = np.array([b for b, _ in taken], np.int64)

    def free(b: int, e: int) -> bool:
        k = int(np.searchsorted(begins, e))
        return not k or int(reach[k - 1]) <= b

    return sorted(base + [s for s in more if free(*s[1:])], key=lambda s: (s[1], ORDER[s[0]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def _scan(batches: Iterator[pa.RecordBatch], model: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            rows = {"id": part.column("id")}
            for k in BASE_KINDS:
                rows[f"n_{k}"] = pa.array([sum(s[0] == k for s in b) for b in base], pa.int64())
            rows["base_sha256"] = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
            rows["spans"] = pa.array([joined(merged(b, m)) for b, m in zip(base, field_spans(texts, model), strict=True)])
            yield pa.RecordBatch.from_pydict(rows)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", labelled: Sequence[str] = LABELLED) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    The counts and the digest are of the patterns' spans alone; spans lists these and those the field adds, `kind:start:end`
    in code points, by start, then kind. A span of the field that touches one of a pattern is left out. `labelled` is the
    training table, lines with [kind|words]; it is held by the driver whole and should stay below some thousands of lines.
    A null or empty text has no spans. Repeated rows count each for itself; other columns are not looked at. Texts are taken
    whole, nothing is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(tuple(labelled)))
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    schema = f"id {kind}, {''.join(f'n_{k} long, ' for k in BASE_KINDS)}base_sha256 string, spans string"
    return d.mapInArrow(lambda b: _scan(b, model.value), schema).withColumnRenamed("id", key)
