"""Phrases that stand together: best-first branch and bound over prefixes.

The score of a phrase is its worst cut's 1000 a n / (l r), floored. Cut after its first word w: r, the count of the rest, is
at least a, so no phrase that begins with w scores more than 1000 n / f(w): the bound of w and of all that grows from it.
The frontier is every language's words in falling order of that bound. Each round takes a language's next words, a few
times as many as the round before, and grows all their prefixes word by word as long as their counts reach `least`, which no
longer phrase can pass. What has grown is bounded again by its last cut, and only phrases whose bound reaches the wanted
scores, the highest first, are looked at for all their cuts and for what stands around them. A language ends when its wanted number of surviving scores lies above the next word's bound; what
ties with that bound is still grown.

The corpus is read as numbers: once, texts become hashes of words with a zero between pieces, stored in the shared folder.
A pass over it takes a bounded set of prefixes to the workers and counts what follows them; sums are combined in the worker
before they are shuffled by phrase, so that no phrase or language is a hot key. Counts of rests that begin with other words
are asked for in a pass of their own. A phrase is dropped when all its occurrences have the same word before or the same
word after them: just then does a phrase one word longer occur as often, and any longer one implies one of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from studyloom.llm.common import numbered, slices, stored, tidily

LONGEST = 5
#: words of the first round of each language, and how many times as many the next one has
FIRST, GROWTH = 16_384, 2
#: prefixes that one pass takes to the workers: 8 MB
CHUNK = 1_000_000
#: positions that a worker counts at once
HELD = 600_000
#: words that a worker knows the hashes of, bytes of text in a stored row, rows handed over at once
KEPT, ROW_BYTES, ROWS = 200_000, 1 << 20, 50_000
W = [f"w{i}" for i in range(1, LONGEST + 1)]

#: A-Z to a-z, a tab to a space, every stop and line end to one stop
TABLE = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words:
    """Hashes of words, never 0; tells which of them this worker meets for the first time."""

    def __init__(self) -> None:
        self.kept: dict[bytes, int] = {b".": 0}

    def __call__(self, words: list[bytes]) -> tuple[list[int], list[bytes]]:
        kept, out, new = self.kept, [], []
        if len(kept) > KEPT:
            kept.clear()
            kept[b"."] = 0
        for w in words:
            h = kept.get(w)
            if h is None:
                h = kept[w] = xxh64_intdigest(w) or 1
                new.append(w)
            out.append(h)
        return out, new


def pieces(text: str) -> list[bytes]:
    """The words of a text, `.` between two pieces."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).replace(b".", b" . ").split()


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for part in slices(batch, "text", ROW_BYTES):
            by: dict[str, list[str]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if text:
                    by.setdefault("und" if lang is None else lang, []).append(text)
            for lang, texts in by.items():
                codes, new = words([w for t in texts for w in (b".", *pieces(t))])
                table, ids = np.unique(np.array([0, *codes, 0], np.uint64), return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "lang": [lang], "n": pa.array([int((ids > 0).sum())], pa.int64()), "ids": [ids.astype(np.int32).tobytes()], "table": [table.tobytes()],
                    "hashes": pa.array([[xxh64_intdigest(w) - (xxh64_intdigest(w) >> 63 << 64) or 1 for w in new]], pa.list_(pa.int64())),
                    "words": pa.array([[w.decode("utf-8", "replace") for w in new]], pa.list_(pa.string())),
                })


def coded(docs: DataFrame, text: str, lang: str) -> DataFrame:
    d = docs.select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"))
    return d.mapInArrow(tidily(_coded), "lang string, n long, ids binary, table binary, hashes array<long>, words array<string>")


# phrases as hashes ---------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def of_lang(langs: list[str]) -> np.ndarray:
    return np.array([xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in langs], np.uint64)


def longer(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word; a phrase of none has its language's hash."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + w)


class Among:
    """Whether hashes are in a set."""

    def __init__(self, wanted: np.ndarray) -> None:
        self.wanted = np.sort(wanted)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.wanted >> np.uint64(44)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = self.maybe[h >> np.uint64(44)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.wanted, h[at]), len(self.wanted) - 1)
            out[at] = self.wanted[place] == h[at]
        return out


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, ids, table) of each stored row; id 0 stands for hash 0, between pieces."""
    for batch in batches:
        langs, ids, tables = (batch.column(c) for c in ("lang", "ids", "table"))
        for i in range(batch.num_rows):
            yield langs[i].as_py(), np.frombuffer(ids[i].as_buffer(), np.int32), np.frombuffer(tables[i].as_buffer(), np.uint64)


def walk(lang: str, ids: np.ndarray, table: np.ndarray, first: Among | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, positions, hashes) of all phrases of k = 1, 2, … words, those that begin with a word of `first` where it is given."""
    h = longer(of_lang([lang]), table)
    begins = first(h) if first else np.ones(len(table), bool)
    begins[0] = False
    at = np.flatnonzero(begins[ids])
    h = h[ids[at]]
    yield 1, at, h
    for k in range(1, longest):
        on = ids[at + k] > 0
        at, h = at[on], h[on]
        h = longer(h, table[ids[at + k]])
        yield k + 1, at, h


COUNTS = "lang string, h long, c long"


GROWN = "lang string, p long, w long, c long"


def handed(lang: str, *columns: np.ndarray, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), ROWS):
        some = [np.ascontiguousarray(c[i : i + ROWS]).view(np.int64) for c in columns]
        yield pa.RecordBatch.from_pydict({"lang": pa.repeat(lang, len(some[0])), **dict(zip(names, some, strict=True))})


def counts(held: dict[str, list[tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
    """Counts of the (phrase, prefix, word) that are held, by phrase; nothing is held afterwards."""
    while held:
        lang, parts = held.popitem()
        h, p, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        _, at, c = np.unique(h, return_index=True, return_counts=True)
        yield from handed(lang, p[at], w[at], c, names=("p", "w", "c"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, ids, table in rows(batches):
        c = np.bincount(ids, minlength=len(table))[1:]
        yield from handed(lang, table[1:], c, names=("h", "c"))


def _grown(batches: Iterator[pa.RecordBatch], k: int, first: np.ndarray, prefixes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of k words whose first k - 1, beginning with a word of `first`, are among the prefixes."""
    begins, among, held, n = Among(first), Among(prefixes), {}, 0
    for lang, ids, table in rows(batches):
        *_, (_, at, h) = walk(lang, ids, table, begins, k - 1)
        on = among(h) & (ids[at + k - 1] > 0)
        p, w = h[on], table[ids[at[on] + k - 1]]
        held.setdefault(lang, []).append((longer(p, w), p, w))
        n += len(p)
        if n > HELD:
            yield from counts(held)
            n = 0
    yield from counts(held)


FOUND = f"lang string, h long, m int, {', '.join(f'{w} long' for w in W)}, c long, left_least long, left_most long, right_least long, right_most long"


def _found(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, first: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The wanted phrases with their words, counts, and the least and greatest hash before and after them, 0 for none."""
    among, begins = Among(wanted), None if first is None else Among(first)
    for lang, ids, table in rows(batches):
        for k, at, h in walk(lang, ids, table, begins, LONGEST):
            on = among(h) if k > 1 else np.zeros(len(h), bool)
            at, h = at[on], h[on]
            if not len(at):
                continue
            order = np.argsort(h, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
            first = at[order[begin]]
            signed = table.view(np.int64)
            left, right = signed[ids[at - 1]][order], signed[ids[at + k]][order]
            out = {"lang": pa.repeat(lang, len(begin)), "h": h[order[begin]].view(np.int64), "m": pa.array([k] * len(begin), pa.int32())}
            for j, w in enumerate(W):
                out[w] = signed[ids[first + j]] if j < k else pa.nulls(len(begin), pa.int64())
            out["c"] = np.diff(begin, append=len(order))
            for name, side in (("left", left), ("right", right)):
                out[f"{name}_least"], out[f"{name}_most"] = np.minimum.reduceat(side, begin), np.maximum.reduceat(side, begin)
            yield pa.RecordBatch.from_pydict(out)


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of both parts of every cut of the phrases."""
    for batch in batches:
        langs, m = batch.column("lang").to_pylist(), batch.column("m").to_numpy()
        seed = of_lang(langs)
        words = [batch.column(w).fill_null(0).to_numpy().view(np.uint64) for w in W]
        for k in range(1, LONGEST):
            head, tail = seed, seed
            for j in range(k):
                head = longer(head, words[j])
            on = m > k
            for j in range(k, LONGEST):
                tail = np.where(m > j, longer(tail, words[j]), tail)
            rest = {"h": batch.column("h").to_numpy()[on], "k": pa.array([k] * int(on.sum()), pa.int32()), "head": head[on].view(np.int64), "tail": tail[on].view(np.int64)}
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, y in zip(langs, on.tolist(), strict=True) if y], pa.string()), **rest, "tail_words": pa.array((m[on] - k).astype(np.int32))})


# passes --------------------------------------------------------------------------------------------------------------


class Corpus:
    """The stored corpus and its passes."""

    def __init__(self, docs: DataFrame, text: str, lang: str, least: int) -> None:
        self.all = stored(coded(docs, text, lang), "words")
        self.numbers = self.all.select("lang", "ids", "table")
        self.least = least
        self.broadcast = docs.sparkSession.sparkContext.broadcast

    def words(self) -> DataFrame:
        """(lang, w, c) of the words that occur often enough."""
        sums = self.numbers.mapInArrow(tidily(_word_counts), COUNTS).groupBy("lang", "h").agg(F.sum("c").alias("c"))
        return sums.filter(F.col("c") >= self.least).withColumnRenamed("h", "w")

    def grown(self, k: int, first: np.ndarray, prefixes: np.ndarray) -> DataFrame:
        """(lang, h, p, w, c) of the frequent phrases of k words whose prefix p, k - 1 words long, is one of `prefixes`."""
        b = self.broadcast((first, prefixes))
        sums = self.numbers.mapInArrow(tidily(lambda x: _grown(x, k, *b.value)), GROWN).groupBy("lang", "p", "w").agg(F.sum("c").alias("c"))
        return sums.filter(F.col("c") >= self.least).mapInArrow(_named, f"{GROWN}, h long")

    def found(self, wanted: np.ndarray, first: np.ndarray | None = None) -> DataFrame:
        """The wanted phrases as in FOUND; all of them begin with a word of `first` where it is given."""
        b = self.broadcast((wanted, first))
        least, most = [F.min(f"{s}_least").alias(f"{s}_least") for s in ("left", "right")], [F.max(f"{s}_most").alias(f"{s}_most") for s in ("left", "right")]
        return self.numbers.mapInArrow(tidily(lambda x: _found(x, *b.value)), FOUND).groupBy("lang", "h", "m", *W).agg(F.sum("c").alias("c"), *least, *most)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p, w = (b.column(c).to_numpy().view(np.uint64) for c in ("p", "w"))
        yield b.append_column("h", pa.array(longer(p, w).view(np.int64)))


def chunks(df: DataFrame, most: int = CHUNK) -> Iterator[np.ndarray]:
    """The distinct hashes of `df`, a stored table with column h, in parts of about `most`."""
    n = df.count()
    parts = -(-n // most)
    for i in range(parts):
        part = df.filter(F.pmod(F.xxhash64("h"), F.lit(parts)) == i) if parts > 1 else df
        yield np.unique(part.select("h").toArrow().column("h").to_numpy()).view(np.uint64)


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def scored(corpus: Corpus, found: DataFrame, known: DataFrame, n: DataFrame) -> DataFrame:
    """`found` with l, r, n and score: those of the cut that scores least, the first of such. `known`: counts (lang, h, c) of
    all their prefixes and words; rests that are not there are counted."""
    cuts = stored(found.select("lang", "h", "m", *W).mapInArrow(_cuts, "lang string, h long, k int, head long, tail long, tail_words int"), "cuts")
    asked = cuts.filter("tail_words > 1").select("lang", F.col("tail").alias("h")).distinct().join(known.select("lang", "h"), ["lang", "h"], "left_anti")
    more = [stored(corpus.found(part).select("lang", "h", "c"), "rests") for part in chunks(stored(asked, "asked"))]
    known = union([known, *more]).distinct()
    head, tail = (known.select("lang", F.col("h").alias(p), F.col("c").alias(c)) for p, c in (("head", "l"), ("tail", "r")))
    parts = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).join(found.select("lang", "h", F.col("c").alias("a")), ["lang", "h"]).join(n, "lang")
    # decimals of 38 digits; the quotient is at most 1000 n / f
    parts = parts.withColumn("score", F.expr(quotient("a", "cast(l as decimal(19,0)) * cast(r as decimal(19,0))")))
    worst = parts.groupBy("lang", "h").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("_cut"))
    d = found.join(worst, ["lang", "h"])
    return d.select("lang", "h", "m", *W, F.col("c").alias("a"), "left_least", "left_most", "right_least", "right_most", *[F.col(f"_cut.{c}").alias(c) for c in ("l", "r", "n", "score")])


def same(side: str):
    return (F.col(f"{side}_least") == F.col(f"{side}_most")) & (F.col(f"{side}_most") != 0)


def quotient(a: str, b: str) -> str:
    """1000 a n div b, exactly."""
    return f"(cast({a} as decimal(20,0)) * cast(1000 as decimal(4,0)) * cast(n as decimal(20,0))) div ({b})"


def survivors(corpus: Corpus, pool: DataFrame, known: DataFrame, n: DataFrame, first: np.ndarray) -> list[DataFrame]:
    """The phrases of `pool` that no longer one replaces, with their scores."""
    found = [stored(corpus.found(part, first), "found") for part in chunks(pool)]
    if not found:
        return []
    return [stored(scored(corpus, union(found), known, n).filter(~((F.col("m") < LONGEST) & (same("left") | same("right")))), "scored")]


def grown_from(corpus: Corpus, batch: DataFrame, words: DataFrame, n: DataFrame, done: list[DataFrame], most: int) -> list[DataFrame]:
    """The surviving phrases that begin with a word of `batch` and can be among the first `most` of their language.

    A phrase's last cut is known from its growth and bounds its score. The phrases of highest bounds are looked at first;
    of the others, those whose bound reaches the last wanted score that is then known.
    """
    spark, out = batch.sparkSession, []
    alone = words.select("lang", "w", F.col("c").alias("wc"))
    for first in chunks(batch):
        levels, prefixes, parents = [], [first], words.select("lang", F.col("h").alias("p"), F.col("c").alias("pc"))
        for k in range(2, LONGEST + 1):
            parts = [stored(corpus.grown(k, first, p), f"grown{k}") for p in prefixes]
            if not parts:
                break
            bounded = union(parts).join(parents, ["lang", "p"]).join(alone, ["lang", "w"]).join(n, "lang")
            bound = F.expr(quotient("c", "cast(pc as decimal(19,0)) * cast(wc as decimal(19,0))"))
            levels.append(stored(bounded.select("lang", "h", "c", bound.alias("bound")), f"level{k}"))
            prefixes = chunks(levels[-1])
            parents = levels[-1].select("lang", F.col("h").alias("p"), F.col("c").alias("pc"))
        if not levels:
            continue
        pool = union(levels)
        known = union([words.select("lang", "h", "c"), pool.select("lang", "h", "c")])
        best = Window.partitionBy("lang").orderBy(F.col("bound").desc(), "h")
        early = stored(pool.withColumn("_i", F.row_number().over(best)).filter(F.col("_i") <= 2 * most).select("lang", "h"), "early")
        out += survivors(corpus, early, known, n, first)
        reached = stored(settled(spark, done + out, most), "reached")
        late = pool.join(early, ["lang", "h"], "left_anti").join(reached, "lang", "left").filter("bound >= coalesce(reached, 0)").select("lang", "h")
        out += survivors(corpus, stored(late, "late"), known, n, first)
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, most: int = 2000, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases of 2 to 5 words.

    By score, then count a, both falling, then the phrase in byte order. Counts are those of the whole table; a null language
    is `und`, a null or empty text has no words; repeated rows count each. A table without frequent phrases gives no rows.
    Words are compared as 64-bit hashes. `first` and `growth` set how many words the rounds take; results don't depend on them.
    """
    corpus = Corpus(docs, text, lang, least)
    n = stored(corpus.all.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    frequent = stored(corpus.words(), "frequent").join(n, "lang").withColumn("bound", F.expr("(cast(n as decimal(20,0)) * 1000) div c"))
    # rare words first, numbered in buckets of one count each, or one bit length where counts are large
    size = F.length(F.bin("c")).cast("long")
    top = F.when(F.col("c") < 1 << 20, F.col("c")).otherwise((F.lit(1 << 20) + size))
    words = stored(hashed(numbered(frequent, ["lang"], [F.col("c"), F.col("w")], "place", top.cast("long"))), "frontier")
    states = stored(words.select("lang", F.lit(0).cast("long").alias("reached")).distinct(), "states")
    spark, done = docs.sparkSession, []
    begin, end = 0, first
    while True:
        batch = words.join(states.select("lang", "reached"), "lang").filter((F.col("place") >= begin) & (F.col("place") < end) & (F.col("bound") >= F.col("reached")))
        done += grown_from(corpus, stored(batch.select("lang", "h"), "batch"), words, n, done, most)
        # a language goes on while a word is left whose bound its last wanted score doesn't pass
        ahead = words.filter(F.col("place") >= end).groupBy("lang").agg(F.max("bound").alias("bound"))
        states = states.select("lang").join(ahead, "lang").join(settled(spark, done, most), "lang", "left")
        states = stored(states.select("lang", F.coalesce("reached", F.lit(0)).cast("long").alias("reached"), "bound").filter("bound >= reached"), "states")
        if states.isEmpty():
            break
        begin, end = end, end * growth
    return named(corpus, done, most)


def settled(spark: SparkSession, done: list[DataFrame], most: int) -> DataFrame:
    """(lang, reached): the last wanted score of languages that have so many."""
    if not done:
        return spark.createDataFrame([], "lang string, reached long")
    by = Window.partitionBy("lang").orderBy(F.col("score").desc())
    top = union(done).select("lang", "score", F.row_number().over(by).alias("_i")).filter(F.col("_i") <= most)
    return top.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("reached")).filter(F.col("_n") == most).drop("_n")


def hashed(words: DataFrame) -> DataFrame:
    """`words` with h: the hash of a phrase of this one word."""

    def run(batches):
        for b in batches:
            seed = of_lang(b.column("lang").to_pylist())
            yield b.append_column("h", pa.array(longer(seed, b.column("w").to_numpy().view(np.uint64)).view(np.int64)))

    return words.select("lang", "w", "c", "n", "bound", "place").mapInArrow(run, "lang string, w long, c long, n long, bound long, place long, h long")


def named(corpus: Corpus, done: list[DataFrame], most: int) -> DataFrame:
    """The first phrases with their words. Those that tie with the last one by score and count are all looked up."""
    spark = corpus.all.sparkSession
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if not done:
        return spark.createDataFrame([], schema)
    by = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    best = stored(union(done).withColumn("_i", F.rank().over(by)).filter(F.col("_i") <= most).drop("_i"), "best")
    each = best.select("lang", "h", F.posexplode(F.array_compact(F.array(*W))).alias("_at", "w"))
    spelled = corpus.all.select(F.explode(F.arrays_zip("hashes", "words")).alias("_x")).select(F.col("_x.hashes").alias("w"), F.col("_x.words").alias("word"))
    spelled = spelled.join(each.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.min("word").alias("word"))
    texts = each.join(spelled, "w").groupBy("lang", "h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    final = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    d = best.join(texts, ["lang", "h"]).withColumn("rank", F.row_number().over(final).cast("long")).filter(F.col("rank") <= most)
    return d.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
