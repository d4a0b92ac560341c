"""Language-model scoring by counts of words and pairs of words over the whole training corpus.

Pairs are counted by Spark in segments by hash, and words in one table; both are exact and none is left out, however large
the corpus. A segment's counts are made by one task from its own pairs and stored; the number of segments follows the
corpus, so that one of them has a bounded size. To score, a document's pairs are sent to their segments, looked up there
and summed up by slice of documents, whose sums from a bounded number of tasks are then added. So neither counts nor pairs meet on the driver, and nothing that grows is broadcast.

The most frequent words, of a bounded number, go to every worker with their counts. A pair that ends in another word lies
in the segment of that word, beside the word's own count; all other words of a document are joined with the table.

`Filter` and `made_segment` are a small approximate form of counts (log-frequency Bloom filter); scores don't use them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh64_intdigest

from studyloom.llm.common import slices, stored

PROBES = 5
MU = 20.0


@dataclass(frozen=True)
class Size:
    """Bounds of what one task holds: the bytes and tokens of a segment of counts, and the words whose counts are broadcast."""

    max_bytes: int = 32 << 20
    tokens_per_segment: int = 1 << 20
    top_words: int = 1 << 18


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the words and ends of texts one after the other, where each text begins, and the words' 64-bit hashes
    by number. Number 0 is the end; numbers hold for these texts. The end is hashed as a space, which no word can hold. What Arrow splits and lowers by is U+0020, U+0009 to
    U+000D and A-Z, no more. A null text is an empty one."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten().dictionary_encode()
    kinds = words.dictionary.cast(pa.large_binary())
    _, at, data = kinds.buffers()
    at, data = np.frombuffer(at, np.int64)[kinds.offset : kinds.offset + len(kinds) + 1], (data or pa.py_buffer(b"")).to_pybytes()
    ends = at.tolist()
    hashes = np.fromiter(map(xxh64_intdigest, itertools.chain([b" "], (data[x:y] for x, y in itertools.pairwise(ends)))), np.uint64, len(kinds) + 1)
    number = words.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    # white space at an end of a text leaves an empty word there
    some = (np.diff(at) > 0)[number]
    number, owner = number[some], owner[some]
    lengths = np.bincount(owner, minlength=len(texts)) + 1
    numbers = np.zeros(len(number) + len(texts), np.int64)
    numbers[np.arange(len(number)) + owner] = number + 1
    return numbers, np.cumsum(lengths) - lengths, hashes


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def gram_of(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A hash of each two words."""
    with np.errstate(over="ignore"):
        return mixed(before * np.uint64(0x9FB21C651E98DF25) + tokens, 3)


def pairs_of(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each word's number above that of the one before it; texts begin at `first`, each after an end."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[first] = 0
    return numbers << 32 | before


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)


def count_of(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of 2^(q-1) .. 2^q - 1; 0 for level 0."""
    return np.where(q > 0, (np.exp2(q - 1.0) + np.exp2(q * 1.0) - 1) / 2, 0.0)


class Filter:
    """Segments of equal size, one after the other; the top bits of an n-gram's hash name its segment."""

    def __init__(self, bits: np.ndarray, segments: int, segment_bits: int) -> None:
        self.bytes, self.segments, self.segment_bits = bits, segments, segment_bits

    def places(self, x: np.ndarray, q: int, probe: int) -> np.ndarray:
        return mixed(x, 101 * q + probe) % np.uint64(self.segment_bits)

    def levels(self, x: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probing 1, 2, … until one is missing."""
        out, alive, q = np.zeros(len(x), np.int64), np.arange(len(x)), 0
        base = segment_of(x, self.segments).astype(np.int64) * (self.segment_bits // 8)
        while len(alive) and q < 64:
            q += 1
            for probe in range(PROBES):
                at = self.places(x[alive], q, probe)
                byte = self.bytes[base[alive] + (at >> np.uint64(3)).astype(np.int64)]
                alive = alive[(byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                if not len(alive):
                    break
            out[alive] = q
        return out


def segment_of(x: np.ndarray, segments: int) -> np.ndarray:
    """`segments` is a power of two."""
    bits = segments.bit_length() - 1
    return (x >> np.uint64(64 - bits)) if bits else np.zeros(len(x), np.uint64)


def made_segment(x: np.ndarray, counts: np.ndarray, segment_bits: int, bits_per_entry: float) -> bytes:
    """One segment's bits. Levels below the first that lets all entries fit stay out."""
    q = level(counts)
    for least in range(1, 65):
        if q[q >= least].sum() * bits_per_entry <= segment_bits:
            break
    x, q = x[q >= least], q[q >= least]
    plain = Filter(np.zeros(0, np.uint8), 1, segment_bits)
    bits = np.zeros(segment_bits, bool)
    for k in range(1, int(q.max()) + 1 if len(q) else 1):
        for probe in range(PROBES):
            bits[plain.places(x[q >= k], k, probe).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def planes(a: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, …: zeros of small numbers lie together and shrink in a shuffle."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def pieces(segment: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each segment and the places where it is named, in order."""
    order = np.argsort(segment, kind="stable")
    begin = np.flatnonzero(np.diff(segment[order], prepend=-1))
    for at in np.split(order, begin[1:]) if len(order) else []:
        yield int(segment[at[0]]), at


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, which are small where keys are."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unstepped(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data, np.uint64), dtype=np.uint64)


#: set in keys that are hashes
HASHED = np.uint64(1 << 63)


def word_key(words: np.ndarray) -> np.ndarray:
    """What stands for a word itself among the pairs of its segment."""
    return mixed(words, 1) | HASHED


def word_segment(words: np.ndarray, segments: int) -> np.ndarray:
    return segment_of(mixed(words, 7), segments).astype(np.int64)


def pair_segment(grams: np.ndarray, words: np.ndarray, known: np.ndarray, segments: int) -> np.ndarray:
    """Pairs that end in a frequent word are dealt by themselves, so that no word is a hot key, others by their last word."""
    return np.where(known, segment_of(grams, segments).astype(np.int64), word_segment(words, segments))


COUNTED = "segment long, gram binary, n binary"


def _counted(segment: np.ndarray, grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(grams)
    segment, grams, n = segment[order], grams[order], n[order]
    got = [(s, steps(grams[at]), planes(n[at])) for s, at in pieces(segment)]
    return pa.RecordBatch.from_pydict({"segment": pa.array([g[0] for g in got], pa.int64()), "gram": pa.array([g[1] for g in got], pa.binary()), "n": pa.array([g[2] for g in got], pa.binary())})


def _grams(batches: Iterator[pa.RecordBatch], shared, segments: int) -> Iterator[pa.RecordBatch]:
    """COUNTED rows: pairs of words, counted within each slice of texts."""
    for batch in batches:
        for part in slices(batch, "text"):
            numbers, first, h = words_of(part.column("text"))
            facts = Facts(shared.value, h)
            pairs, n = np.unique(pairs_of(numbers, first), return_counts=True)
            last = pairs >> 32
            grams = gram_of(h[pairs & 0xFFFFFFFF], h[last])
            yield _counted(pair_segment(grams, h[last], facts.at[last] >= 0, segments), facts.keys(grams, pairs & 0xFFFFFFFF, last), n)


def _single(batches: Iterator[pa.RecordBatch], shared, segments: int) -> Iterator[pa.RecordBatch]:
    """COUNTED rows of the words that aren't broadcast."""
    for b in batches:
        w = b.column("word").to_numpy()
        rest = find(shared.value.top, w) < 0
        words = w[rest].view(np.uint64)
        yield _counted(word_segment(words, segments), word_key(words), b.column("c").to_numpy()[rest])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One COUNTED row of each segment, sorted by gram. Rows come by segment; one segment's counts are held at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None

    def done() -> pa.RecordBatch:
        x, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(x)
        x, n = x[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        return pa.RecordBatch.from_pydict({"segment": pa.array([last], pa.int64()), "gram": pa.array([steps(x[first])], pa.binary()), "n": pa.array([planes(np.add.reduceat(n, first))], pa.binary())})

    for batch in batches:
        for segment, gram, n in zip(batch.column("segment").to_pylist(), batch.column("gram"), batch.column("n"), strict=True):
            if last is not None and segment != last:
                yield done()
                held.clear()
            last = segment
            held.append((unstepped(gram.as_py()), unplaned(n.as_py(), np.int64)))
    if held:
        yield done()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            numbers, _, h = words_of(part.column("text"))
            n = np.bincount(numbers, minlength=len(h))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"word": pa.array(h[some].view(np.int64)), "c": pa.array(n[some])})


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key in the sorted `keys`, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Known:
    """What is broadcast: the exact counts of the most frequent words, and the corpus' totals."""

    top: np.ndarray
    top_counts: np.ndarray
    tokens: int
    kinds: int

    @property
    def bits(self) -> int:
        return max(1, len(self.top).bit_length())

    def share(self, counts: np.ndarray) -> np.ndarray:
        """p(w) of the base score."""
        return (counts + 0.5) / (self.tokens + 0.5 * (self.kinds + 1))


@dataclass
class Model:
    """Two-word histories are smoothed by a Dirichlet prior of MU words: p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU), with
    p(w) as in the base score. A text's histories are its own tokens, its end first, so the log of its probability is a sum
    over its words, of log MU p(w) - log(c(w) + MU), and one over its pairs, of log(1 + c(v w) / (MU p(w))).

    pairs: COUNTED rows, one of each segment."""

    known: Known
    segments: int
    pairs: DataFrame


class Facts:
    """What the broadcast words tell of each word by its number: its place among them or -1, and its terms of base score and
    score."""

    def __init__(self, known: Known, hashes: np.ndarray) -> None:
        self.model = known
        self.at = find(known.top, hashes.view(np.int64))
        c = self.counts(self.at)
        self.logs = np.where(self.at >= 0, np.log10(known.share(c)), 0.0)
        self.back = np.where(self.at >= 0, self.logs + math.log10(MU) - np.log10(c + MU), 0.0)

    def counts(self, at: np.ndarray) -> np.ndarray:
        """The counts of words by their places; 0 for -1."""
        return np.where(at >= 0, self.model.top_counts[at], 0) if len(self.model.top) else np.zeros(len(at), np.int64)

    def keys(self, grams: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A short key of pairs of two broadcast words, the last word's place in front; else the pair's hash."""
        v, w = self.at[before], self.at[last]
        return np.where((v >= 0) & (w >= 0), (w << self.model.bits | v).astype(np.uint64), grams | HASHED)


def trained(train: DataFrame, size: Size = Size()) -> tuple[Model, DataFrame]:
    """The model, and the stored (word, c) table of exact counts, from a column `text`; a null text is an empty one."""
    train = train.select("text")
    words = stored(train.mapInArrow(_words, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    tokens, kinds = (int(x or 0) for x in words.agg(F.sum("c"), F.count(F.lit(1))).first())
    by = words.orderBy(F.col("c").desc(), "word").limit(size.top_words).toPandas().sort_values("word")
    known = Known(by["word"].to_numpy(np.int64), by["c"].to_numpy(np.int64), tokens, kinds)
    # 16 bytes a pair
    segments = 1 << max(6, math.ceil(math.log2(max(1, 2 * tokens / size.tokens_per_segment, 16 * tokens / size.max_bytes))))
    shared = train.sparkSession.sparkContext.broadcast(known)
    counted = train.mapInArrow(lambda b: _grams(b, shared, segments), COUNTED).union(words.mapInArrow(lambda b: _single(b, shared, segments), COUNTED))
    # dealt by segment, so that the counts of a segment are put together where they are stored
    pairs = stored(counted.repartition("segment").sortWithinPartitions("segment").mapInArrow(_segments, COUNTED), "pair-counts")
    return Model(known, segments, pairs), words


#: documents of a block: one task keeps a sum of each, 8 bytes
BLOCK = 1 << 23
#: tasks that look up pairs: a document gets one sum from each at most, however many segments there are
TASKS = 48
#: kinds of rows that are dealt to segments, in this order within one
COUNTS, PAIRS, DOCUMENT = 0, 1, 2


def _deal(batches: Iterator[pa.RecordBatch], shared, segments: int, schema: pa.Schema, blocks: int = 1) -> Iterator[pa.RecordBatch]:
    """One row of each document, and for each slice of texts one of each segment: its pairs by document."""

    def batch_of(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    for batch in batches:
        for part in slices(batch, "text"):
            numbers, first, h = words_of(part.column("text"))
            facts = Facts(shared.value, h)
            row = part.column("row").to_numpy()
            # rows of a partition are numbered one after the other from a multiple of 2^33
            block = (int(row[0]) >> 33) % blocks
            lengths = np.diff(np.append(first, len(numbers)))
            owner = np.repeat(row - row[0], lengths)
            rare = np.flatnonzero(facts.at[numbers] < 0)
            words, n_rare = np.unique(owner[rare] << 32 | numbers[rare], return_counts=True)
            offsets = pa.array(np.searchsorted(words >> 32, np.arange(len(row) + 1)), pa.int32())
            yield batch_of(len(row), {
                "block": pa.array([block] * len(row), pa.int32()), "segment": pa.array(row % segments), "kind": pa.array(np.full(len(row), DOCUMENT, np.int32)),
                "n_tokens": pa.array(lengths), "n_known": pa.array(lengths - np.bincount(owner[rare], minlength=len(row))),
                "base": pa.array(np.add.reduceat(facts.logs[numbers], first)), "score": pa.array(np.add.reduceat(facts.back[numbers], first)),
                "rare": pa.array(pa.ListArray.from_arrays(offsets, pa.array(h[words & 0xFFFFFFFF].view(np.int64)))), "n_rare": pa.array(pa.ListArray.from_arrays(offsets, pa.array(n_rare, pa.int32()))),
            } | {c: part.column(c) for c in ("row", "id", "held_out")})
            pairs = pairs_of(numbers, first)
            before = pairs & 0xFFFFFFFF
            grams = gram_of(h[before], h[numbers])
            keys = facts.keys(grams, before, numbers)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]))
            n = np.diff(np.append(begin, len(keys)))
            keys, owner, grams, last = keys[begin], owner[begin], grams[order[begin]], numbers[order[begin]]
            got = []
            for segment, at in pieces(pair_segment(grams, h[last], facts.at[last] >= 0, segments)):
                hashed = last[at[keys[at] >= HASHED]]
                c = facts.counts(facts.at[hashed])
                got.append((segment, steps(keys[at]), planes(n[at]), planes(c), word_key(h[hashed[c == 0]]).tobytes(), planes(owner[at])))
            columns = {"block": pa.array([block] * len(got), pa.int32()), "segment": pa.array([g[0] for g in got], pa.int64()), "kind": pa.array([PAIRS] * len(got), pa.int32()), "row": pa.array([row[0]] * len(got), pa.int64())}
            yield batch_of(len(got), columns | {name: pa.array([g[i] for g in got], pa.binary()) for i, name in enumerate(("gram", "n", "c", "words", "owner"), 1)})


def plus(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays; places beyond the end of the shorter one are 0 there."""
    if a is None:
        return b
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    long[: len(short)] += short
    return long


def _look_up(batches: Iterator[pa.RecordBatch], shared, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of documents as they are, and rows of slices: (row of the first document, sums over pairs of it and those after it).

    Rows come by block and segment, a segment's counts first; only these and the sums of a block are held."""
    m: Known = shared.value
    here, keys, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums: dict[int, np.ndarray] = {}
    schema = None

    def count(wanted: np.ndarray) -> np.ndarray:
        at = find(keys, wanted)
        return np.where(at >= 0, counts[at], 0)

    def given_out() -> pa.RecordBatch:
        columns = {"kind": pa.array([PAIRS] * len(sums), pa.int32()), "row": pa.array(list(sums), pa.int64()), "sums": pa.array([x.tobytes() for x in sums.values()], pa.binary())}
        out = pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(len(sums), f.type) for f in schema], schema=schema)
        sums.clear()
        return out

    for batch in batches:
        documents = batch.filter(pc.equal(batch.column("kind"), DOCUMENT)).select(names)
        schema = documents.schema
        if documents.num_rows:
            yield documents
        for i, kind in enumerate(batch.column("kind").to_pylist()):
            value = lambda name: batch.column(name)[i].as_py()  # noqa: B023, E731
            if kind == COUNTS:
                if sums and here is not None and here[0] != value("block"):
                    yield given_out()
                here, keys, counts = (value("block"), value("segment")), unstepped(value("gram")), unplaned(value("n"), np.int64)
            elif kind == PAIRS and (value("block"), value("segment")) == here:
                pairs, rest = unstepped(value("gram")), unplaned(value("c"), np.int64)
                rest[rest == 0] = count(np.frombuffer(value("words"), np.uint64))
                two, short = count(pairs), int(np.searchsorted(pairs, HASHED))
                c = np.concatenate([m.top_counts[(pairs[:short] >> np.uint64(m.bits)).astype(np.int64)], rest])
                some = np.flatnonzero(two)
                logs = unplaned(value("n"), np.int64)[some] * np.log10(1 + two[some] / (MU * m.share(c[some])))
                row = value("row")
                sums[row] = plus(sums.get(row), np.bincount(unplaned(value("owner"), np.int64)[some], logs))
    if sums:
        yield given_out()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, pairs) of each document from the sums of slices, which come by slice; one slice is held."""
    here: int | None = None
    held: np.ndarray | None = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"row": pa.array(here + np.arange(len(held))), "pairs": pa.array(held)})

    for batch in batches:
        for row, sums in zip(batch.column("row").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            if row != here:
                if held is not None:
                    yield done()
                here, held = row, None
            held = plus(held, np.frombuffer(sums).copy())
    if held is not None:
        yield done()


def scored(docs: DataFrame, model: Model, words: DataFrame, held_out: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A null text counts as empty: one token, its end. base_score sums exact word counts' logs; score is the model's log10
    probability of the text. Repeated rows are scored each for itself. With an empty training corpus every word is unknown.
    Other columns are not looked at. A document's pairs are shuffled once, as hashes by segment, and its words beyond the
    most frequent ones.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model.known)
    d = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), docs[text].alias("text"))
    given = f"kind int, row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, n_rare array<int>, sums binary"
    sent = given + ", block int, segment long, gram binary, n binary, c binary, words binary, owner binary"
    like = docs.sparkSession.createDataFrame([], sent).schema
    arrow, names, segments = to_arrow_schema(like), [x.split()[0] for x in given.split(", ")], model.segments
    # counts go to each block of documents
    blocks = max(1, math.ceil(docs.count() / BLOCK))
    counts = model.pairs.withColumns({"kind": F.lit(COUNTS), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    dealt = d.mapInArrow(lambda b: _deal(b, shared, segments, arrow, blocks), sent).unionByName(counts, allowMissingColumns=True)
    s = dealt.repartition(TASKS, "block", "segment").sortWithinPartitions("block", "segment", "kind").mapInArrow(lambda b: _look_up(b, shared, names), given)
    s = stored(s, "scores")
    all_tokens, floor = model.known.tokens, model.known.tokens + 0.5 * (model.known.kinds + 1)
    sums = s.filter(F.col("kind") == PAIRS).select("row", "sums").repartition("row").sortWithinPartitions("row").mapInArrow(_added, "row long, pairs double")
    s = s.filter(F.col("kind") == DOCUMENT).drop("kind", "sums")
    rare = s.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("n_rare").alias("n"))))
    # words of count 0 too: an inner join would lose their share of the score
    c = F.coalesce("c", F.lit(0))
    log = F.log10((c + 0.5) / F.lit(floor))
    # short whole numbers are shuffled rather than sums of logs
    rest = rare.join(words, "word", "left").select("row", "n", "c").repartition("row").groupBy("row").agg(
        F.sum(F.col("n") * log).alias("rest"), F.sum(F.col("n") * (log + F.lit(math.log10(MU)) - F.log10(c + F.lit(MU)))).alias("back"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more")
    )
    out = s.drop("rare", "n_rare").join(rest, "row", "left").join(sums, "row", "left")
    return out.select(
        F.col("id").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("back", F.lit(0.0)) + F.coalesce("pairs", F.lit(0.0))).alias("score"),
    )
