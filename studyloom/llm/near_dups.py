"""Near duplicates by MinHash, with sequential Bayesian verification of banded candidates.

1. One pass turns a text into its set of word shingles: the set's size and digest, band keys, and a signature of one byte
   per hash. Equal sets are one class from there on, stood for by its smallest id.
2. Classes that share a band key are candidates. Their signatures are compared in batches; after each the posterior of the
   similarity, given the matches so far, is bounded, and a pair whose chance to reach the threshold is under the chosen miss
   probability is dropped. Survivors join into clouds. Rounds of stars compare each class with one centre of its band, so
   most copies join with one comparison each; then all pairs of a band that lie in different clouds are compared, so no
   candidate is left out.
3. Linked texts lie in one cloud. Clouds are cut into blocks of bounded bytes, and links are verified there on full sets:
   a class is compared with all those not yet reached, so a group of copies costs about as many comparisons as it has
   texts. Where a cloud has several blocks, what its centre doesn't reach is compared with every block.
4. Groups are the components of the verified links, found by star contraction over edges. Only links that join something
   new leave a task.

With 32 bands of 4 hashes a pair of similarity 0.8 shares no band with a chance below 5e-8. Sets are compared as 64-bit
hashes of their shingles, all of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import WordHashes, lower_words, slices, stored, tidily

BANDS, BAND_ROWS = 32, 4
HASHES = 128
BATCH = 16
MISS = 1e-6
STAR_ROUNDS = 2
BLOCK_BYTES = 8 << 20
BLOOM_BITS = 1 << 24
_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1)
ADDED = _rng.integers(0, 2**32, HASHES, np.uint32)


class Hasher:
    """The set of 64-bit hashes of a text's shingles."""

    def __init__(self, width: int) -> None:
        self.width, self.hashes = width, WordHashes()
        self.factors = np.random.default_rng(7).integers(1, 2**63, width + 1, np.int64).astype(np.uint64) | np.uint64(1)

    def __call__(self, words: list[str]) -> np.ndarray:
        h = np.array(self.hashes(words), np.uint64)
        n, k = len(h), self.width if len(h) >= self.width else len(h)
        with np.errstate(over="ignore"):
            x = np.full(max(0, n - k + 1) if n else 0, np.uint64(k))
            for i in range(k):
                x = x * self.factors[i] + h[i : n - k + 1 + i]
                x ^= x >> np.uint64(29)
            x = x * self.factors[self.width]
            x ^= x >> np.uint64(32)
        return np.unique(x)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The HASHES minima of each non-empty set of 64-bit hashes."""
    lengths = np.array([len(s) for s in sets])
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(HASHES):
            out[:, i] = np.minimum.reduceat(flat * MULTIPLIERS[i] + ADDED[i], begin)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: a hash of the band's number and its minima."""
    m = minima[:, : BANDS * BAND_ROWS].reshape(len(minima), BANDS, BAND_ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(minima), BANDS))
        for r in range(BAND_ROWS):
            key = (key ^ m[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
            key = key ^ (key >> np.uint64(32))
    return key.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> tuple[int, ...]:
    """For each batch compared, the fewest matches with which a pair stays.

    With a uniform prior on the chance c that one hash matches, the posterior after m of n is Beta(m+1, n-m+1), and
    P(c >= t | m, n) = P(Binomial(n+1, t) <= m). One byte of a hash matches by accident with 1/256, so t is the threshold
    moved up by that.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(batch, hashes + 1, batch):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def likely(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of signatures (rows of bytes) survive the batches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def low_bytes(minima: np.ndarray) -> np.ndarray:
    """What is compared of each minimum: its lowest byte, which is even where the highest is 0 for every long text."""
    return (minima & np.uint32(255)).astype(np.uint8)


def digest_of(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(width)
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            sets = [hasher(lower_words(t)) if t else np.zeros(0, np.uint64) for t in part.column("text").to_pylist()]
            some = [s for s in sets if len(s)]
            minima = signatures(some) if some else np.zeros((0, HASHES), np.uint32)
            keys, sig = band_keys(minima), low_bytes(minima)
            row = iter(range(len(some)))
            at = [next(row) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary()),
                "sig": pa.array([None if i is None else sig[i].tobytes() for i in at], pa.binary()),
                "bands": pa.array([None if i is None else keys[i] for i in at], pa.list_(pa.int64())),
            })


def _survivors(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        yield batch.select(["a", "b"]).filter(pa.array(likely(a, b, threshold)))


def _pairs_within(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks of one band that lie in different groups and survive the batches."""
    for batch in batches:
        low, high = [], []
        for r in batch.to_pylist():
            ids_a, ids_b = np.array(r["ids_a"]), np.array(r["ids_b"])
            groups_a, groups_b = np.array(r["groups_a"]), np.array(r["groups_b"])
            sig_a, sig_b = (np.frombuffer(b"".join(r[c]), np.uint8).reshape(-1, HASHES) for c in ("sigs_a", "sigs_b"))
            for i in range(len(ids_a)):
                j = np.flatnonzero((groups_b != groups_a[i]) & (ids_b > ids_a[i] if r["same"] else ids_b != ids_a[i]))
                j = j[likely(np.broadcast_to(sig_a[i], (len(j), HASHES)), sig_b[j], threshold)]
                low.append(np.minimum(ids_a[i], ids_b[j]))
                high.append(np.maximum(ids_a[i], ids_b[j]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (low, high))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def components(edges: DataFrame) -> DataFrame:
    """(id, component): of every id in `edges` (a, b) the smallest id it is connected with.

    Large and small stars in turn (each neighbour of a node moves to the node's least neighbour) until nothing changes;
    the depth halves, and no round emits more edges than there are.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())

    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    before = mark(e)
    while before[0]:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # now towards smaller neighbours: a < b in every row
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("m"), F.explode(F.array("a", "b")).alias("v")).filter("m < v")
        e = stored(small.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "edges")
        after = mark(e)
        if after == before:
            break
        before = after
    of = e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    roots = e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return of.union(roots).groupBy("id").agg(F.min("component").alias("component"))


def held(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids, BLOOM_BITS long whatever their number: full, it lets all pass and only saves nothing."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(BLOOM_BITS, bool)
        for b in batches:
            on[bloom_places(b.column("id").to_numpy())] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in ids.repartition(4).mapInArrow(bits, "bits binary").collect():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def bloom_places(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BLOOM_BITS.bit_length() + 1)).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], width: int, shared) -> Iterator[pa.RecordBatch]:
    """(id, n, words): the full sets of texts whose id may be wanted."""
    hasher, on = Hasher(width), np.unpackbits(shared.value).astype(bool)
    for batch in batches:
        wanted = on[bloom_places(batch.column("id").to_numpy())]
        batch = batch.filter(pa.array(wanted))
        for part in slices(batch, "text", 2 << 20):
            sets = [hasher(lower_words(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "digest": pa.array([digest_of(x) for x in sets], pa.binary()), "n": pa.array([len(x) for x in sets], pa.int64()), "words": pa.array([x.tobytes() for x in sets], pa.binary())})


class Sets:
    """Sets of 64-bit hashes side by side, to intersect one with many."""

    def __init__(self, words: list[bytes]) -> None:
        self.lengths = np.array([len(w) // 8 for w in words])
        flat = np.frombuffer(b"".join(words), np.uint64)
        # numbers in place of hashes, to mark those of one set in a table
        kinds, self.flat = np.unique(flat, return_inverse=True)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)])
        self.mark = np.zeros(len(kinds), bool)

    def linked(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of `others` (in order) have enough in common with set i."""
        if not len(others):
            return others
        own = self.flat[self.begin[i] : self.begin[i + 1]]
        self.mark[own] = True
        n = self.lengths[others]
        starts = np.cumsum(n) - n
        at = np.repeat(self.begin[others] - starts, n) + np.arange(n.sum())
        both = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), starts)
        self.mark[own] = False
        return others[100 * both >= percent * (len(own) + n - both)]


def runs_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows come in order of `keys`: one table for each of their values."""
    kept: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero((np.diff(k, axis=0) != 0).any(axis=1)) + 1
        for x, y in zip([0, *cuts], [*cuts, len(k)], strict=True):
            if last is not None and tuple(k[x]) != last:
                yield pa.Table.from_batches(kept)
                kept = []
            last = tuple(k[x])
            kept.append(b.slice(x, y - x))
    if kept:
        yield pa.Table.from_batches(kept)


def _within(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links that span the components of one block: from each class reached to those not reached before."""
    a, b = [], []
    for t in runs_of(batches, ("cloud", "block")):
        ids, sets = t.column("id").to_numpy(), Sets(t.column("words").to_pylist())
        left = np.argsort(ids, kind="stable")
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo:
                i = todo.pop()
                new = sets.linked(i, left, percent)
                if len(new):
                    a += [ids[i]] * len(new)
                    b += ids[new].tolist()
                    todo += new.tolist()
                    left = left[~np.isin(left, new)]
        if len(a) > 20_000:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between what a centre didn't reach and the classes of one block: one for each two components."""
    for t in runs_of(batches, ("cloud", "out_block", "block")):
        ids, groups, far, sets = t.column("id").to_numpy(), t.column("component").to_numpy(), t.column("far").to_numpy(), Sets(t.column("words").to_pylist())
        found: dict[tuple[int, int], tuple[int, int]] = {}
        near = np.flatnonzero(~far)
        for i in np.flatnonzero(far):
            for j in sets.linked(i, near[groups[near] != groups[i]], percent):
                found.setdefault((groups[i], groups[j]), (int(ids[i]), int(ids[j])))
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found.values()], pa.int64()), "b": pa.array([y for _, y in found.values()], pa.int64())})


def clouds_of(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, component): classes that survive with another one, by cloud."""
    banded = classes.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last")
    members = stored(banded.join(shared.drop("last"), "band"), "bands")
    sigs = classes.select("id", "sig")
    found, clouds = [], None
    for _ in range(STAR_ROUNDS):
        if clouds is None:
            star = members.select(F.col("first").alias("a"), F.col("id").alias("b"))
        else:  # the centre: the first of those not in the cloud of the band's first; two alone have been compared
            open_ = grouped(members.filter("n > 2"), clouds)
            centre = open_.filter("group <> first_group").groupBy("band").agg(F.min(F.struct("id", "group")).alias("c"))
            star = open_.join(centre, "band").filter("group <> c.group").select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b"))
        pairs = star.filter("a <> b").distinct()
        both = pairs.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
        found.append(stored(both.select("a", "b", "sig_a", "sig_b").mapInArrow(tidily(lambda x: _survivors(x, threshold)), "a long, b long"), "survivors"))
        clouds = stored(components(union(found)), "clouds")

    open_ = stored(grouped(members.filter("n > 2"), clouds), "open")
    several = open_.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks")).filter("low < high")
    part = open_.select("band", "id", "group").join(several.select("band", "blocks"), "band").join(sigs, "id")
    part = part.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = part.groupBy("band", "block").agg(F.collect_list(F.struct("id", "group", "sig")).alias("rows"))
    blocks = stored(rows.select("band", "block", F.col("rows.id").alias("ids"), F.col("rows.group").alias("groups"), F.col("rows.sig").alias("sigs")), "blocks")
    x, y = (blocks.select("band", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "ids", "groups", "sigs")]) for s in "ab")
    meet = x.join(y, "band").filter("block_a <= block_b").withColumn("same", F.col("block_a") == F.col("block_b"))
    rest = meet.select("same", *[f"{c}_{s}" for s in "ab" for c in ("ids", "groups", "sigs")])
    found.append(stored(rest.mapInArrow(tidily(lambda b: _pairs_within(b, threshold)), "a long, b long").distinct(), "rest"))
    return components(union(found))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def links_within(clouds: DataFrame, classes: DataFrame, texts: DataFrame, width: int, threshold: float, block_bytes: int) -> DataFrame:
    """Links (a, b) between classes of one cloud that span its components, verified on full sets."""
    percent = round(threshold * 100)
    wanted = clouds.withColumnRenamed("component", "cloud").join(classes.select("id", "digest"), "id")
    shared = texts.sparkSession.sparkContext.broadcast(held(clouds.select("id")))
    sets = texts.mapInArrow(tidily(lambda b: _sets(b, width, shared)), "id long, digest binary, n long, words binary")
    sets = sets.join(wanted, ["id", "digest"]).dropDuplicates(["id", "digest"]).select("id", "n", "words", "cloud")
    sets = stored(sets, "sets")
    size = sets.groupBy("cloud").agg(F.ceil(F.sum(8 * F.col("n") + 64) / F.lit(block_bytes)).cast("int").alias("blocks"))
    d = sets.join(size, "cloud")
    # the centre, the cloud's first class, is in every block
    place = F.when(F.col("id") == F.col("cloud"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    d = d.withColumn("block", F.explode(place))
    dealt = d.select("cloud", "block", "id", "words").repartition("cloud", "block").sortWithinPartitions("cloud", "block", "id")
    inside = stored(dealt.mapInArrow(tidily(lambda b: _within(b, percent)), "a long, b long"), "links")

    # clouds of several blocks
    groups = components(inside)
    large = d.filter("blocks > 1").select("cloud", "blocks", "block", "id", "n", "words").filter("id <> cloud or block = 0")
    large = large.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    large = stored(large, "large")
    far = large.join(large.filter("id = cloud").select("cloud", F.col("component").alias("reached")), "cloud").filter("component <> reached").drop("reached")
    out_size = far.groupBy("cloud").agg(F.ceil(F.sum(8 * F.col("n") + 64) / F.lit(block_bytes)).cast("int").alias("out_blocks"))
    columns = ["cloud", "out_block", "block", "far", "id", "component", "words"]
    asks = far.join(out_size, "cloud").withColumn("out_block", F.pmod(F.xxhash64("id"), F.col("out_blocks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("far", F.lit(True))
    rows = large.join(out_size, "cloud").withColumn("out_block", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1))).withColumn("far", F.lit(False))
    dealt = asks.select(*columns).union(rows.select(*columns)).repartition("cloud", "out_block", "block").sortWithinPartitions("cloud", "out_block", "block", "id")
    return inside.union(stored(dealt.mapInArrow(tidily(lambda b: _across(b, percent)), "a long, b long"), "links"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, block: int = 256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of `docs`, whose key is a long.

    Rows are linked if their sets of `width`-word shingles have a Jaccard similarity of `threshold` or more; component_id
    is the smallest key reachable over links, kept is true for that row. Null and empty texts have no shingles and are
    linked with nothing. A row whose key is null stands alone, with a null component_id, and is kept. Rows that repeat a
    key are one node of the graph; each keeps its own n_shingles. Other columns are not looked at; an empty table gives none.
    """
    d = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    sets = stored(d.mapInArrow(tidily(lambda b: _sketch(b, width)), "id long, n_shingles long, digest binary, sig binary, bands array<long>"), "shingles")
    usable = sets.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    classes = stored(usable.groupBy("digest").agg(F.min(F.struct("id", "sig", "bands")).alias("c")).select("digest", "c.*"), "classes")
    clouds = stored(clouds_of(classes, threshold, block), "clouds")
    links = links_within(clouds, classes, d.filter("id is not null and text is not null"), width, threshold, block_bytes)
    # rows that repeat a key: the classes of their texts are one node
    node = classes.select("digest", "id").join(usable.select("digest", F.col("id").alias("other")).distinct(), "digest")
    repeated = usable.groupBy("id").agg(F.count_distinct("digest").alias("n")).filter("n > 1").select(F.col("id").alias("other"))
    same = node.join(repeated, "other").select(F.col("id").alias("a"), F.col("other").alias("b")).filter("a <> b")
    groups = stored(components(links.union(same)), "groups")

    reps = classes.select("digest", F.col("id").alias("rep"))
    out = sets.select("id", "n_shingles", "digest").join(reps, "digest", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    out = out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def grouped(members: DataFrame, groups: DataFrame) -> DataFrame:
    """`members` with the group of each id and that of its band's first."""
    of = members.join(groups.withColumnRenamed("component", "group"), "id", "left").withColumn("group", F.coalesce("group", "id"))
    first = groups.select(F.col("id").alias("first"), F.col("component").alias("first_group"))
    return of.join(first, "first", "left").withColumn("first_group", F.coalesce("first_group", "first"))
