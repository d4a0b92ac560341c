"""Structured Streaming forms of the incremental operators.

Late or out-of-order reviews: the batch replay (F4) sorts by (ts, seq) and is the truth. The stream applies each
micro-batch in that order and keeps going; an answer older than the state it meets is counted in its output row, and
`with_late_replayed` replays the items that met one from the log.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from studyloom.functions import replies as Y
from studyloom.operators.memory import replay
from studyloom.streaming import steps

MEMORY_STATE = "stage string, due long, stability double, difficulty double, reps int, lapses int, last_review long"
MEMORY_OUT = f"learner_id long, item_id int, {MEMORY_STATE}, late long"
MEMORY_NAMES = [c.split()[0] for c in MEMORY_OUT.split(", ")]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint directory (a temporary one only where none is configured)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and return its output as a table with a `batch` column."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)

    def write(df: DataFrame, batch: int) -> None:
        # a batch that runs again after a failure replaces its own folder
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch=*")


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The last output row of each key of an update-mode table."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_m")).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def _apply_reviews(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    learner, item = key
    # one item's answers in one micro-batch; most items have few, so frames of their own would cost more than the step
    ts_us, seq, ratings = (np.concatenate(c) for c in zip(*((c["ts_us"].to_numpy(), c["seq"].to_numpy(), c["rating"].to_numpy()) for c in chunks)))
    order = np.lexsort((seq, ts_us))
    memory, late = tuple(state.get) if state.exists else None, 0
    seed = steps.fnv1a(f"{learner}-{item}/")
    for ts, rating in zip(ts_us[order].tolist(), ratings[order].tolist()):
        if memory is None:
            memory = ("New", int(ts), 0.0, 0.0, 0, 0, None)
        if memory[6] is None or ts >= memory[6]:
            memory = steps.review(memory, int(ts), int(rating), "", seed=seed)
        else:
            late += 1
    state.update(memory)
    yield pd.DataFrame({name: [v] for name, v in zip(MEMORY_NAMES, (learner, item, *memory, late), strict=True)})


def stream_reviews(reviews: DataFrame) -> DataFrame:
    """A stream of reviews(learner_id, item_id, ts, seq, rating) to each item's new memory (update mode).

    Only one memory per item is kept; the state store spreads items over partitions. `late`: answers of the micro-batch
    that were older than the memory they met and so not applied.
    """
    r = reviews.select("learner_id", "item_id", F.unix_micros("ts").alias("ts_us"), "seq", "rating")
    return r.groupBy("learner_id", "item_id").applyInPandasWithState(_apply_reviews, MEMORY_OUT, MEMORY_STATE, "update", GroupStateTimeout.NoTimeout)


def with_late_replayed(table: DataFrame, log: DataFrame) -> DataFrame:
    """The memories that `stream_reviews` stored, those of items that met a late answer replayed from the whole log.

    Only the log of such items is read into the replay.
    """
    keys = ["learner_id", "item_id"]
    now = latest(table, keys).drop("late")
    met = table.groupBy(*keys).agg(F.sum("late").alias("late")).filter("late > 0").drop("late")
    again = replay(log.join(met, keys, "left_semi"), keys).select(*keys, "memory.*")
    return now.join(met, keys, "left_anti").unionByName(again.select(*now.columns))


def last_batch(table: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """The rows of each key's last batch: `touched` (key, batch) names all keys of each, those left without rows too."""
    last = touched.groupBy(key).agg(F.max("batch").alias("batch"))
    return table.join(last, [key, "batch"]).drop("batch")


def stream_import(files: DataFrame, arrived: str, delay: str) -> DataFrame:
    """Documents imported once by content id (append mode).

    Ids leave the state `delay` after their time in `arrived`; what comes again later is the library's to know (S4).
    """
    return files.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["paper_id"])


def _join_pieces(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text, upto, waiting = state.get if state.exists else ("", 0, "{}")
    early = {int(k): v for k, v in json.loads(waiting).items()}
    for c in chunks:
        early.update({int(s): t or "" for s, t in zip(c["seq"], c["text"]) if s >= upto})
    new = []
    while upto in early:
        new.append(early.pop(upto))
        upto += 1
    text += "".join(new)
    state.update((text, upto, json.dumps(early)))
    yield pd.DataFrame([[key[0], text, upto]], columns=["reply_id", "text", "pieces"])


def stream_replies(pieces: DataFrame) -> DataFrame:
    """A stream of pieces(reply_id long, seq from 0, text) to each reply so far, read again at every update.

    Pieces that come early wait in the state; one without text counts. A reply is a few kilobytes; its state stays, since no piece says it is the last.
    """
    so_far = pieces.groupBy("reply_id").applyInPandasWithState(
        _join_pieces, "reply_id long, text string, pieces long", "text string, upto long, waiting string", "update", GroupStateTimeout.NoTimeout
    )
    t = F.col("text")
    return so_far.select(
        "reply_id", "pieces", Y.visible_answer(t).alias("answer"), Y.plan_so_far(t).alias("ideas"), Y.cards_so_far(t).alias("cards"), Y.feedback(t).alias("feedback"), "text",
    )


def stream_due(changes: DataFrame, items: Callable[[], DataFrame], now: Callable[[], Column], sink: Callable[[DataFrame, DataFrame, int], None]):
    """A writer that recomputes the review queue of the learners a micro-batch touches, at the batch's time.

    changes(learner_id, …) is the stream; `items` reads the current cards and ideas; `sink` stores (queue, touched
    learners, batch id). A learner's queue is that of the last batch that touched them (`last_batch`).
    """
    from studyloom.operators.review import review_queue

    def recompute(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("learner_id").distinct()
        sink(review_queue(items().join(touched, "learner_id", "left_semi"), now()), touched, batch_id)

    return changes.writeStream.foreachBatch(recompute)


def stream_positions(heard: DataFrame) -> DataFrame:
    """The latest listening position per paper of a stream heard(paper_id, ts, segment) (update mode)."""
    return heard.groupBy("paper_id").agg(F.max(F.struct("ts", "segment")).alias("_m")).select("paper_id", F.col("_m.segment").alias("segment"), F.col("_m.ts").alias("ts"))
