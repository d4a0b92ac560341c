"""Streams (X1–X5) read from the test tables' files and run to the end; the result is what the stream has stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.plans import views
from studyloom.queries import review as review_queries
from studyloom.queries import sqlviews as Q
from studyloom.queries.memory import now
from studyloom.queries.registry import Registry
from studyloom.sources import files as S
from studyloom.streaming import streams as X

R = Registry()


def stream_of(spark, sf, name):
    """The files of a table as a stream, whether the table is one file or a folder of them."""
    # a pattern, so that a single file is listed like a folder; it matches the table's own name only
    return spark.readStream.schema(views.table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def event_stream(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return stream_of(spark, sf, "events").withColumn("k", k).withColumn("ts", views.utc("ts"))


def review_stream(spark, sf):
    rating = F.create_map(*[F.lit(x) for kv in views.RATING.items() for x in kv])[F.col("event_type")]
    return event_stream(spark, sf).filter("event_type <> 'signup'").select(
        F.col("user_id").alias("learner_id"), (F.col("k") % 4).cast("int").alias("item_id"), "ts", F.col("event_id").alias("seq"), rating.cast("int").alias("rating")
    )


@R.add("stream_reviews", Q.rec(Q.MEMORY, "SELECT learner_id, item_id, stage, due AS due_us, round(s, 6) AS stability, round(d, 6) AS difficulty, reps, lapses FROM memory"))
def stream_reviews(spark, sf):
    """Memories after the stream of answers; equal to the batch replay."""
    m = X.with_late_replayed(X.run_to_table(X.stream_reviews(review_stream(spark, sf)), "reviews", "update"), views.reviews(spark, sf))
    return m.select("learner_id", "item_id", "stage", F.col("due").alias("due_us"), F.round("stability", 6).alias("stability"), F.round("difficulty", 6).alias("difficulty"), "reps", "lapses")


@R.add("stream_import", "SELECT DISTINCT left(sha256(text), 16) AS paper_id FROM documents")
def stream_import(spark, sf):
    """Each distinct document once."""
    d = stream_of(spark, sf, "documents").select(S.content_id(F.encode("text", "UTF-8")).alias("paper_id"), F.current_timestamp().alias("arrived"))
    return X.run_to_table(X.stream_import(d, "arrived", "1 day"), "import").select("paper_id")


@R.add("stream_replies", """SELECT conv_id AS reply_id, count(*) AS pieces, md5(regexp_replace(string_agg(text, '' ORDER BY turn), '^\\s+|\\s+$', '', 'g')) AS answer FROM conversations GROUP BY conv_id""")
def stream_replies(spark, sf):
    """Conversations as replies arriving in pieces (one turn each)."""
    c = stream_of(spark, sf, "conversations").select(F.col("conv_id").alias("reply_id"), F.col("turn").alias("seq"), "text")
    r = X.latest(X.run_to_table(X.stream_replies(c), "replies", "update"), ["reply_id"])
    return r.select("reply_id", "pieces", F.md5("answer").alias("answer"))


@R.add("stream_due", review_queries.R.sql["review_queue"])
def stream_due(spark, sf):
    """Queues of the learners touched by the stream of answers (all of them)."""
    folder = X.shared_folder(spark, "due")

    def sink(queue, touched, batch):
        queue.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
        touched.write.mode("overwrite").parquet(f"{folder}/touched/batch={batch}")

    w = X.stream_due(review_stream(spark, sf), lambda: review_queries.items(spark, sf), now, sink)
    w.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    read = lambda part: spark.read.option("basePath", f"{folder}/{part}").parquet(f"{folder}/{part}/batch=*")
    q = X.last_batch(read("out"), read("touched"), "learner_id")
    return q.select("learner_id", "item_key", "item_kind", "stage", "question", "position")


@R.add("stream_positions", f"WITH {Q.EV} SELECT user_id AS paper_id, arg_max(k, ts) AS segment, epoch_us(max(ts)) AS at_us FROM ev WHERE event_type = 'view' GROUP BY user_id")
def stream_positions(spark, sf):
    """Where each paper was last heard."""
    h = event_stream(spark, sf).filter("event_type = 'view'").select(F.col("user_id").alias("paper_id"), "ts", F.col("k").alias("segment"))
    p = X.latest(X.run_to_table(X.stream_positions(h), "positions", "update"), ["paper_id"])
    return p.select("paper_id", "segment", F.unix_micros("ts").alias("at_us"))
