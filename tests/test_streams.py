"""Streams over several micro-batches, with late answers and queues that empty."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from studyloom.operators import memory
from studyloom.queries import streaming as Q
from studyloom.streaming import streams as X

REVIEWS = "learner_id long, item_id int, ts timestamp, seq long, rating int"


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def batches(spark, folder, parts, schema):
    """One file per part, read one at a time in the order of their names."""
    import os
    import time

    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
        for f in os.listdir(f"{folder}/{k}"):
            os.utime(f"{folder}/{k}/{f}", (time.time() - 100 + k, time.time() - 100 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_late_answers_are_replayed(spark, tmp_path):
    parts = [
        [(1, 1, at(0), 1, 3), (1, 2, at(0), 2, 3), (2, 1, at(0), 3, 1)],
        [(1, 1, at(9), 5, 4), (2, 1, at(2), 6, 3)],
        [(1, 1, at(4), 4, 1), (1, 2, at(8), 7, 2)],  # item 1's answer of day 4 comes after that of day 9
    ]
    stream = batches(spark, str(tmp_path), parts, REVIEWS)
    table = X.run_to_table(X.stream_reviews(stream), "late", "update")
    assert table.select("batch").distinct().count() == 3
    assert table.filter("late > 0").count() == 1
    log = spark.createDataFrame([r for p in parts for r in p], REVIEWS)
    rounded = [F.round(c, 9).alias(c) for c in ("stability", "difficulty")]
    columns = ["learner_id", "item_id", "stage", "due", *rounded, "reps", "lapses", "last_review"]
    want = memory.replay(log).select("learner_id", "item_id", "memory.*").select(*columns)
    got = X.with_late_replayed(table, log).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_queue_is_that_of_the_last_batch(spark):
    queue = spark.createDataFrame([(1, "a", 1, 0), (1, "b", 2, 0), (2, "c", 1, 0), (1, "b", 1, 1)], "learner_id long, item_key string, position int, batch int")
    touched = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (1, 1), (2, 2)], "learner_id long, batch int")
    got = sorted(tuple(r) for r in X.last_batch(queue, touched, "learner_id").select("learner_id", "item_key", "position").collect())
    assert got == [(1, "b", 1)]  # learner 2 has nothing left to review


def test_imports_and_replies_over_batches(spark, tmp_path):
    files = batches(spark, str(tmp_path / "f"), [[("x",), ("y",)], [("x",)], [("z",)]], "paper_id string").withColumn("arrived", F.current_timestamp())
    got = X.run_to_table(X.stream_import(files, "arrived", "1 day"), "import")
    assert sorted(r["paper_id"] for r in got.collect()) == ["x", "y", "z"]
    pieces = batches(spark, str(tmp_path / "r"), [[(1, 1, "world")], [(1, 0, "hello ")], [(1, 2, "!"), (2, 0, "x")]], "reply_id long, seq long, text string")
    table = X.run_to_table(X.stream_replies(pieces), "replies", "update")
    got = {r["reply_id"]: (r["text"], r["pieces"]) for r in X.latest(table, ["reply_id"]).collect()}
    assert got == {1: ("hello world!", 3), 2: ("x", 1)}


def test_tables_in_several_files_are_streamed(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k % 3}") for k in range(9)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = {hashlib.sha256(f"text {k}".encode()).hexdigest()[:16] for k in range(3)}
    assert sorted(r["paper_id"] for r in Q.stream_import(spark, str(tmp_path)).collect()) == sorted(want)


def test_replies_of_several_files_with_a_piece_without_text(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "a "), (1, 1, None), (1, 2, "b"), (2, 0, "c")], "conv_id long, turn int, text string")
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["reply_id"]: (r["pieces"], r["answer"]) for r in Q.stream_replies(spark, str(tmp_path)).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {1: (3, md5("a b")), 2: (1, md5("c"))}
