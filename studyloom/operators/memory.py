"""Review logs to memory states."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions import fsrs
from studyloom.functions.fsrs_arrays import NEVER, STAGES, Memories, reviewed
from studyloom.streaming import steps

#: items whose next answers are applied in one array step; fewer ones take the step for one item each
FEW = 8


def seed_hash(item: Column) -> Column:
    """FNV state of `<item id>/`, the part of the seed that is the same for every review of an item."""
    return fsrs.fnv1a(F.concat(item, F.lit("/")))


def _begins(batch: pa.RecordBatch, keys: Sequence[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row begins another item than the row before it; a null key is a key."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    out[0] = True
    for k in keys:
        c = batch.column(k)
        last, this = c.slice(0, n - 1), c.slice(1)
        out[1:] |= pc.fill_null(pc.not_equal(last, this), False).to_numpy(zero_copy_only=False) | pc.xor(last.is_null(), this.is_null()).to_numpy(zero_copy_only=False)
    if before is not None:
        out[0] = any(before.column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys)
    return out


def _apply(m: Memories, begin: np.ndarray, n: np.ndarray, ts: np.ndarray, rating: np.ndarray, seed: np.ndarray, retention: float) -> None:
    """Each item's answers, rows begin … begin + n, in order. Longer logs come first, so that those going on are first."""
    live = int((n > 0).sum())
    for t in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n[:live], -t, side="left"))
        if live <= FEW:
            break
        at = begin[:live] + t
        m.put(slice(live), reviewed(m.at(slice(live)), ts[at], rating[at], seed[at], retention))
    else:
        return
    for i in range(live):
        row = m.row(i)
        for k in range(begin[i] + t, begin[i] + n[i]):
            row = steps.review(row, int(ts[k]), int(rating[k]), "", retention, int(seed[k]))
        m.put_row(i, row)


def _rows(keys: pa.RecordBatch, m: Memories) -> pa.RecordBatch:
    last = pa.array(m.last_review, pa.int64(), mask=m.last_review == NEVER)
    stage = pa.array(np.array(STAGES, object)[m.stage], pa.string())
    numbers = [pa.array(m.due), pa.array(m.stability), pa.array(m.difficulty), pa.array(m.reps.astype(np.int32)), pa.array(m.lapses.astype(np.int32))]
    memory = pa.StructArray.from_arrays([stage, *numbers, last], ["stage", "due", "stability", "difficulty", "reps", "lapses", "last_review"])
    return pa.RecordBatch.from_arrays([*keys.columns, memory], [*keys.schema.names, "memory"])


def _fold(batches: Iterator[pa.RecordBatch], keys: Sequence[str], retention: float) -> Iterator[pa.RecordBatch]:
    """Sorted answers to one row per item. Of an item that goes on in the next batch, its memory alone is carried over."""
    carried: tuple[pa.RecordBatch, Memories] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = _begins(batch, keys, carried[0] if carried else None)
        number = lambda c, fill=0: pc.fill_null(batch.column(c), fill).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        ts, rating, seed = number("_ts"), number("_rating"), number("_seed")
        if carried and begins[0]:
            yield _rows(*carried)
            carried = None
        begins[0] = True
        begin = np.flatnonzero(begins)
        n = np.diff(begin, append=batch.num_rows)
        m = Memories.fresh(ts[begin])
        prior = np.flatnonzero(pc.is_valid(batch.column("_prior")).to_numpy(zero_copy_only=False)[begin])
        if len(prior):
            given = batch.column("_prior").take(pa.array(begin[prior]))
            part = lambda f, fill=0: pc.fill_null(given.field(f), fill).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            stage = pc.index_in(given.field("stage"), pa.array(STAGES)).to_numpy(zero_copy_only=False)
            m.put(prior, Memories(stage, *[part(f) for f in ("due", "stability", "difficulty", "reps", "lapses")], part("last_review", NEVER)))
        if carried:
            m.put(slice(1), carried[1])
        first = begin.copy()
        first[prior] += 1
        left = n - (first - begin)
        order = np.argsort(-left, kind="stable")
        ordered = m.at(order)
        _apply(ordered, first[order], left[order], ts, rating, seed, retention)
        m.put(order, ordered)
        ids = batch.select(list(keys)).take(pa.array(begin))
        if len(begin) > 1:
            yield _rows(ids.slice(0, len(begin) - 1), m.at(slice(len(begin) - 1)))
        carried = ids.slice(len(begin) - 1), m.at(slice(len(begin) - 1, None))
    if carried:
        yield _rows(*carried)


def replay(
    reviews: DataFrame,
    keys: Sequence[str] = ("learner_id", "item_id"),
    item: Column | None = None,
    prior: DataFrame | None = None,
    retention: float = 0.9,
) -> DataFrame:
    """(keys…, memory): every item's log folded in (ts, seq) order, from `prior` memories where given.

    One shuffle by item and one sort within its partitions; the fold reads the sorted rows as a stream and holds one batch
    and one memory, so a log may have any length: nothing of an item is gathered. An update is not associative, so one item's
    answers are applied by one task. Answers without a time or with a rating other than 1 to 4 are passed over; items that
    have only such ones and no prior memory give no row. A prior memory without answers stays as it is.
    """
    keys = list(keys)
    item = item if item is not None else F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    told = reviews.filter(F.col("ts").isNotNull() & F.col("rating").between(1, 4))
    columns = [F.unix_micros("ts").alias("_ts"), F.col("seq").alias("_seq"), F.col("rating").cast("long").alias("_rating"), seed_hash(item).alias("_seed")]
    rows = told.select(*keys, *columns, F.lit(None).cast(fsrs.MEMORY_TYPE).alias("_prior"))
    if prior is not None:
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("_ts", "_seq", "_rating", "_seed")]
        rows = rows.union(prior.filter("memory is not null").select(*keys, *none, F.col("memory").cast(fsrs.MEMORY_TYPE)))
    # the fold costs far more per row than its size suggests, so its partition count is the configured one, not the
    # one a size-based coalesce would choose
    width = int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, *keys).sortWithinPartitions(*keys, F.col("_prior").isNull(), "_ts", "_seq")
    kinds = ", ".join(f"`{k}` {reviews.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(lambda b: _fold(b, keys, retention), f"{kinds}, memory {fsrs.MEMORY_TYPE}")


def apply_review(df: DataFrame, ts: str, rating: str, item: Column, memory: str = "memory", retention: float = 0.9) -> DataFrame:
    """one answer per row: `memory` becomes the memory after `rating` at `ts`."""
    d = df.withColumn("_seed", seed_hash(item)).withColumn("_at", F.unix_micros(ts))
    return d.withColumn(memory, F.expr(fsrs.step_sql(memory, "_at", rating, "_seed", retention))).drop("_seed", "_at")


def preview(df: DataFrame, now: str, item: Column, memory: str = "memory", retention: float = 0.9) -> DataFrame:
    """four rows per item, the wait in seconds each answer would give."""
    d = df.withColumn("_seed", seed_hash(item)).withColumn("_at", F.unix_micros(F.lit(now).cast("timestamp")))
    d = d.withColumn("rating", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3, 4)])))
    nxt = F.expr(fsrs.step_sql(memory, "_at", "rating", "_seed", retention))
    return (
        d.withColumn("_next", nxt)
        .withColumn("wait_seconds", ((F.col("_next.due") - F.col("_at")) / 1_000_000).cast("long"))
        .drop("_seed", "_at", "_next")
    )


def unpack(df: DataFrame, memory: str = "memory") -> DataFrame:
    """Memory fields as columns, times as timestamps."""
    m = F.col(memory)
    return df.select(
        *[c for c in df.columns if c != memory],
        m["stage"].alias("stage"),
        F.timestamp_micros(m["due"]).alias("due"),
        m["stability"].alias("stability"),
        m["difficulty"].alias("difficulty"),
        m["reps"].alias("reps"),
        m["lapses"].alias("lapses"),
        F.timestamp_micros(m["last_review"]).alias("last_review"),
    )
