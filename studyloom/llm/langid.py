"""Language identification by interpolated Kneser-Ney character models, one per language.

The models are fitted on a bounded sample of labelled documents (`Bounds`): whole texts in hash order, until a language
has enough characters. n-grams are counted by Spark; the counts of the sample, bounded with it, are made into sorted
arrays of n-gram hashes with one probability per language, which are broadcast. Every document is scored on its whole
text. Words repeat, so a worker keeps the scores of those it has met; a word is scored between spaces, and a text's score
is the sum over its words divided by its characters.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.llm.common import slices, stored, tidily

DIGIT = re.compile(r"\d")
LETTERS = re.compile(r"[^\W\d_]+")
#: a document is rejected at twice the spreads above the usual cross-entropy that one in a hundred of the held-out documents
#: has, and at no fewer than these
REJECT = 10.0
#: the least share of a text's letters that words without digits must hold to be judged alone
PLAIN = 0.1


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text; signs such as ² and ½, which a word pattern takes, are none."""
    runs = LETTERS.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [x for r in runs for x in "".join(c if c.isalpha() else " " for c in r).split()]

BASE = np.uint64(0x9E3779B97F4A7C15)
KEPT_WORDS = 300_000
KEPT_LENGTH = 48
UNDECIDED = "und"


@dataclass(frozen=True)
class Bounds:
    """What the classifier is fitted on: at most so many documents and characters of each language."""

    docs: int = 800
    chars: int = 1_500_000
    #: characters of all languages together; many languages share it evenly
    all_chars: int = 12_000_000
    #: documents of each language that calibrate score and rejection, apart from those counted
    calibration: int = 200


def padded(word: str, order: int) -> str:
    return " " * (order - 1) + word + " "


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For o = 0..order, the hash of the o characters that end at each place; places before the o-th are not to be used."""
    out = [np.zeros(len(codes), np.uint64)]
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for o in range(1, order + 1):
            h = out[-1].copy()
            h[o - 1 :] += (codes[: len(codes) - o + 1].astype(np.uint64) + np.uint64(1)) * power if len(codes) >= o else 0
            out.append(h)
            power = power * BASE
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted hash in the sorted `keys`, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Model:
    """grams[o]: sorted hashes of o-grams and the probability of their last character in each language; contexts[o]:
    hashes of o-character contexts and the share left to shorter ones."""

    langs: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    #: from calibration: temperature of the posterior; mean and spread of cross-entropy by language
    temperature: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    per_char: np.ndarray | None = None
    #: spreads above the mean at which a document is rejected
    reject: float = REJECT
    name: str = ""

    def bits(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each run of letters, the bits it costs in each language, and the characters that count."""
        n, order = len(self.langs), self.order
        if not runs:
            return np.zeros((0, n)), np.zeros(0, np.int64)
        lengths = np.array([len(r) + 1 for r in runs])
        codes = codes_of("".join(padded(r, order) for r in runs))
        begin = np.concatenate([[0], np.cumsum(lengths + order - 1)[:-1]])
        counted = np.ones(len(codes), bool)
        for k in range(order - 1):
            counted[begin + k] = False
        at = np.flatnonzero(counted)
        hashes = gram_hashes(codes, order)
        p, weight = np.empty((len(at), n), np.float32), np.ones((len(at), n), np.float32)
        left = np.arange(len(at))
        for o in range(order, 0, -1):
            keys, probs = self.grams[o]
            i = find(keys, hashes[o][at[left]])
            hit = i >= 0
            p[left[hit]] = weight[left[hit]] * probs[i[hit]]
            left = left[~hit]
            if not len(left):
                break
            ckeys, shares = self.contexts[o - 1]
            j = find(ckeys, hashes[o - 1][at[left] - 1])
            known = j >= 0
            weight[left[known]] *= shares[j[known]]
        p[left] = weight[left] * self.floor
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.add.reduceat(-np.log2(np.maximum(p, 1e-30)), first, axis=0), lengths


def fitted(counts: list[tuple[str, str, int]], order: int) -> Model:
    """The model from (language, n-gram of `order` characters, count).

    Interpolated Kneser-Ney with one discount per order, n1 / (n1 + 2 n2): the highest order uses counts, each lower one
    the number of different characters that were seen before the n-gram; below the unigrams lies an even share.
    """
    langs = sorted({c[0] for c in counts})
    alphabet = 1 + len({g[-1] for _, g, _ in counts})
    by_lang: list[list[dict[str, float]]] = []  # language -> order -> probability
    left: list[list[dict[str, float]]] = []  # language -> context length -> share left
    for lang in langs:
        top = {g: n for name, g, n in counts if name == lang}
        tables = {order: top}
        for o in range(order - 1, 0, -1):
            lower: dict[str, int] = defaultdict(int)
            for g in tables[o + 1]:
                lower[g[1:]] += 1
            tables[o] = lower
        probs: list[dict[str, float]] = [{} for _ in range(order + 1)]
        shares: list[dict[str, float]] = [{} for _ in range(order)]
        for o in range(1, order + 1):
            n1, n2 = (sum(1 for n in tables[o].values() if n == k) for k in (1, 2))
            d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
            total: dict[str, int] = defaultdict(int)
            kinds: dict[str, int] = defaultdict(int)
            for g, n in tables[o].items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            shares[o - 1] = {h: d * kinds[h] / t for h, t in total.items()}
            for g, n in tables[o].items():
                lower_p = probs[o - 1][g[1:]] if o > 1 else 1 / alphabet
                probs[o][g] = (n - d) / total[g[:-1]] + shares[o - 1][g[:-1]] * lower_p
        by_lang.append(probs)
        left.append(shares)

    def prob(k: int, g: str) -> float:
        p = by_lang[k][len(g)].get(g)
        if p is not None:
            return p
        share = left[k][len(g) - 1].get(g[:-1], 1.0)
        return share * (prob(k, g[1:]) if len(g) > 1 else 1 / alphabet)

    def table(names: set[str], width: int, value) -> tuple[np.ndarray, np.ndarray]:
        ordered = list(names)
        keys = np.zeros(len(ordered), np.uint64)
        if width and ordered:
            keys = gram_hashes(codes_of("".join(ordered)), width)[width][width - 1 :: width]
        rows = np.array([[value(k, g) for k in range(len(langs))] for g in ordered], np.float32).reshape(len(ordered), len(langs))
        by = np.argsort(keys, kind="stable")
        return keys[by], rows[by]

    none = (np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32))
    grams = [none] + [table({g for p in by_lang for g in p[o]}, o, prob) for o in range(1, order + 1)]
    contexts = [table({h for s in left for h in s[o]}, o, lambda k, h, o=o: left[k][o].get(h, 1.0)) for o in range(order)]
    return Model(langs, order, grams, contexts, np.full(len(langs), 1 / alphabet, np.float32))


class Scorer:
    """A model and the words a worker has met: token -> row of `table`, whose last column counts characters."""

    def __init__(self, model: Model) -> None:
        self.model, self.at = model, {}
        self.table = np.zeros((0, 2 * len(model.langs) + 2))

    def rows_of(self, tokens: list[str]) -> np.ndarray:
        """Bits in each language and characters of each token; those of tokens with a digit stand in the second half."""
        runs, owner = [], []
        for i, t in enumerate(tokens):
            for r in letter_runs(t.lower()):
                runs.append(r)
                owner.append(i)
        bits, n = self.model.bits(runs)
        wide = len(self.model.langs) + 1
        out = np.zeros((len(tokens), 2 * wide))
        if runs:
            np.add.at(out[:, :wide], np.array(owner), np.column_stack([bits, n]))
        mixed = np.array([DIGIT.search(t) is not None for t in tokens], bool)
        out[mixed, wide:] = out[mixed, :wide]
        out[mixed, :wide] = 0
        return out

    def texts(self, texts: list[str]) -> np.ndarray:
        """Of each text the bits in each language, and its counted characters.

        Tokens with a digit (ids, keys, addresses) don't count beside words, but do where words hold less than PLAIN of the
        letters: in lists of such tokens, and in scripts without spaces, where a token is a whole line.
        """
        out = self.sums(texts)
        wide = len(self.model.langs) + 1
        words, others = out[:, :wide], out[:, wide:]
        return words + np.where((words[:, -1] < PLAIN * (words[:, -1] + others[:, -1]))[:, None], others, 0.0)

    def sums(self, texts: list[str]) -> np.ndarray:
        if len(self.at) > KEPT_WORDS:
            self.at, self.table = {}, self.table[:0]
        split = [t.split() for t in texts]
        new = list({w for ws in split for w in ws if w not in self.at})
        short, long_ = [w for w in new if len(w) <= KEPT_LENGTH], [w for w in new if len(w) > KEPT_LENGTH]
        base = len(self.table)
        self.table = np.concatenate([self.table, *[self.rows_of(short[i : i + 20_000]) for i in range(0, len(short), 20_000)]])
        self.at |= {w: base + i for i, w in enumerate(short)}
        at, table = self.at, self.table
        out = np.zeros((len(texts), table.shape[1]))
        rest = dict(zip(long_, self.rows_of(long_), strict=True)) if long_ else {}
        for i, ws in enumerate(split):
            if rest:
                for w in ws:
                    if w in rest:
                        out[i] += rest[w]
                ws = [w for w in ws if w not in rest]
            out[i] += table[np.fromiter(map(at.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
        return out


_scorers: dict[str, Scorer] = {}


def scorer(shared) -> Scorer:
    """A worker's scorer for a broadcast model; workers outlive models, so they are told apart by name."""
    model = shared.value
    if model.name not in _scorers:
        _scorers.clear()
        _scorers[model.name] = Scorer(model)
    return _scorers[model.name]


def sample(train: DataFrame, bounds: Bounds, n_langs: int) -> DataFrame:
    """(lang, text, place): of each language the first documents in hash order, within `bounds`; equal texts count once.

    Only `docs + calibration` hashes of a language leave a task (Spark prunes a row_number limit of up to 1,000 before the
    shuffle), and the copies of a sampled text are combined where they lie, however many there are.
    """
    d = train.select("lang", "text", F.xxhash64("text").alias("h"))
    by = Window.partitionBy("lang").orderBy("h")
    first = d.select("lang", "h").distinct().withColumn("place", F.row_number().over(by)).filter(F.col("place") <= bounds.docs + bounds.calibration)
    if n_langs <= 1000:  # at most a million short rows; else Spark shuffles the texts
        first = F.broadcast(first)
    d = d.join(first, ["lang", "h"]).groupBy("lang", "h", "place").agg(F.min("text").alias("text"))
    share = min(bounds.chars, bounds.all_chars // max(1, n_langs))
    upto = F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return d.select("lang", "text", "place", (F.coalesce(upto, F.lit(0)) < share).alias("within"))


def _grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            seen: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                for r in letter_runs(text.lower()):
                    p = padded(r, order)
                    for i in range(len(r) + 1):
                        seen[lang, p[i : i + order]] += 1
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in seen], pa.string()), "gram": pa.array([k[1] for k in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def _costs(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    s = scorer(shared)
    for batch in batches:
        for part in slices(batch, "text"):
            got = s.texts(part.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "bits": pa.array(list(got[:, :-1]), pa.list_(pa.float64())), "chars": pa.array(got[:, -1])})


def trained(train: DataFrame, order: int = 5, bounds: Bounds = Bounds()) -> Model | None:
    """The calibrated model from (lang, text) rows, or None where no row has both a language and a letter."""
    spark = train.sparkSession
    train = train.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n_langs = train.select("lang").distinct().count()
    s = stored(sample(train, bounds, n_langs), "language-sample")
    fit = (F.col("place") % 7 != 3) & F.col("within")
    grams = s.filter(fit).select("lang", "text").mapInArrow(lambda b: _grams(b, order), "lang string, gram string, n long")
    counts = [tuple(r) for r in grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False)]
    if not counts:
        return None
    model = fitted(counts, order)
    shared = spark.sparkContext.broadcast(model)
    # apart from what was counted; a language with too few documents calibrates on all of its own
    few = s.groupBy("lang").agg(F.max("place").alias("most"))
    cal = s.join(few, "lang").filter((F.col("place") % 7 == 3) | (F.col("most") < 20)).select("lang", "text")
    got = cal.mapInArrow(lambda b: _costs(b, shared), "lang string, bits array<double>, chars double").filter("chars > 0").toPandas()
    shared.unpersist()
    return calibrated(model, got["lang"].tolist(), np.array(got["bits"].tolist()).reshape(len(got), len(model.langs)), got["chars"].to_numpy())


def calibrated(model: Model, langs: list[str], bits: np.ndarray, chars: np.ndarray) -> Model:
    """Temperature of the least log loss on documents of known language; cross-entropy's mean and spread by language."""
    k = len(model.langs)
    index = {name: i for i, name in enumerate(model.langs)}
    usable = np.array([x in index for x in langs], bool)
    truth, bits, chars = np.array([index[x] for x in langs if x in index], int), bits[usable], chars[usable]
    model.name = uuid.uuid4().hex
    model.mean, model.spread, model.per_char = np.zeros(k), np.full(k, 0.25), np.full(k, 4.0)
    if not len(truth):
        model.mean += math.log2(64)
        return model
    best = None
    for t in (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01):
        z = -bits * math.log(2) * t
        loss = float(np.mean(np.logaddexp.reduce(z, axis=1) - z[np.arange(len(truth)), truth]))
        if best is None or loss < best[0] - 1e-9:
            best = (loss, t)
    model.temperature = best[1]
    ce = bits[np.arange(len(truth)), truth] / chars
    for i in range(k):
        own = ce[truth == i]
        if len(own):
            # medians: mislabelled and odd documents must not widen what is usual
            model.mean[i] = np.median(own)
            model.spread[i] = max(0.15, 1.4826 * np.median(np.abs(own - model.mean[i])))
    if len(truth):
        usual = np.sqrt(model.spread[truth] ** 2 + model.per_char[truth] / np.maximum(chars, 1))
        model.reject = max(REJECT, 2 * float(np.quantile((ce - model.mean[truth]) / usual, 0.99)))
    return model




def _identify(batches: Iterator[pa.RecordBatch], shared, text: str, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    s = scorer(shared)
    m = s.model
    for batch in batches:
        for part in slices(batch, text):
            texts = part.column(text).to_pylist()
            got = s.texts([t or "" for t in texts])
            chars = got[:, -1]
            some = np.where(chars > 0, chars, 1)[:, None]
            ce = got[:, :-1] / some
            best = ce.argmin(axis=1)  # the first of equals in the order of names
            z = -got[:, :-1] * math.log(2) * m.temperature
            posterior = np.exp(z[np.arange(len(texts)), best] - np.logaddexp.reduce(z, axis=1))
            usual = np.sqrt(m.spread[best] ** 2 + m.per_char[best] / some[:, 0])
            far = (ce[np.arange(len(texts)), best] - m.mean[best]) / usual
            score = posterior / (1 + np.exp(np.clip(far - m.reject, -50, 50)))
            none = chars == 0
            lang = [UNDECIDED if n else m.langs[b] for n, b in zip(none, best, strict=True)]
            yield pa.RecordBatch.from_pydict({
                **{c: part.column(c) for c in keep}, "lang_pred": pa.array(lang, pa.string()), "score": pa.array(np.where(none, 0.0, score)),
                "cross_entropy": pa.array(np.where(none, np.nan, ce[np.arange(len(texts)), best]), from_pandas=True), "rejected": pa.array(none | (far > m.reject)),
            })
    _scorers.clear()  # workers go on to other work; the words met here would stay with them


def identified(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """(key, lang_pred, score, cross_entropy, rejected) of every row by its whole text alone; `keep` names other columns
    to carry in place of the key.

    `und`, score 0 and rejected for a null text, one without a letter, and all if there is no model. score: the posterior
    of the language named, lowered as the cross-entropy leaves what is usual for it; rejected beyond `Model.reject` spreads, where
    the row still names its nearest language. Ties go to the first language in order. Repeated rows are alike; other
    columns are not looked at. Nothing is shuffled.
    """
    keep = keep or (key,)
    read = docs.select(*dict.fromkeys((*keep, text)))
    if model is None:
        return read.select(*keep, F.lit(UNDECIDED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double, cross_entropy double, rejected boolean"
    return read.mapInArrow(tidily(lambda b: _identify(b, shared, text, keep)), schema)


def fold(key: Column, folds: int = 5) -> Column:
    """The fold of a document: CRC-32 of its id as text."""
    return F.crc32(key.cast("string").cast("binary")) % folds
