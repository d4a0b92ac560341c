"""Spaced repetition (F1–F10) over the review log in `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import fsrs
from studyloom.operators import memory
from studyloom.plans import views
from studyloom.queries import sqlviews as Q
from studyloom.queries.registry import Registry

R = Registry()


def now():
    return F.lit(Q.NOW).cast("timestamp")


def item():
    return F.concat_ws("-", F.col("learner_id").cast("string"), F.col("item_id").cast("string"))


def memories(spark, sf):
    return memory.replay(views.reviews(spark, sf))


@R.add(
    "recall_curve",
    f"""WITH {Q.EV} SELECT event_id,
  round(pow(1.0::DOUBLE + (pow(0.9::DOUBLE, -2.0::DOUBLE) - 1.0::DOUBLE) * greatest(0, k - 5) / (value + 1.0::DOUBLE), -0.5::DOUBLE), 6) AS recall,
  round((value + 1.0::DOUBLE) / (pow(0.9::DOUBLE, -2.0::DOUBLE) - 1.0::DOUBLE) * (pow(0.7::DOUBLE + k / 400.0::DOUBLE, -2.0::DOUBLE) - 1.0::DOUBLE), 6) AS interval_days
FROM ev""",
)
def recall_curve(spark, sf):
    """stability from `value`, elapsed days and wanted retention from `k`."""
    e = views.events(spark, sf)
    s = F.col("value") + 1.0
    return e.select(
        "event_id",
        F.round(fsrs.recall(s, (F.col("k") - 5).cast("double")), 6).alias("recall"),
        F.round(fsrs.interval_days(F.lit(0.7) + F.col("k") / F.lit(400.0), s), 6).alias("interval_days"),
    )


@R.add("memory_replay", Q.rec(Q.MEMORY, """SELECT learner_id, item_id, stage, due AS due_us, round(s, 6) AS stability,
  round(d, 6) AS difficulty, reps, lapses, last_us AS last_review_us FROM memory"""))
def memory_replay(spark, sf):
    """every item's memory after its whole log."""
    m = memories(spark, sf)
    return m.select(
        "learner_id",
        "item_id",
        "memory.stage",
        F.col("memory.due").alias("due_us"),
        F.round("memory.stability", 6).alias("stability"),
        F.round("memory.difficulty", 6).alias("difficulty"),
        "memory.reps",
        "memory.lapses",
        F.col("memory.last_review").alias("last_review_us"),
    )


@R.add("memory_replay_incremental", Q.rec(Q.MEMORY, """SELECT learner_id, item_id, stage, due AS due_us,
  round(s, 6) AS stability, round(d, 6) AS difficulty, reps, lapses FROM memory"""))
def memory_replay_incremental(spark, sf):
    """F4 continued: the first half of the month replayed, then the rest on top of those memories."""
    r = views.reviews(spark, sf)
    mid = F.lit("2024-01-15 00:00:00").cast("timestamp")
    m = memory.replay(r.filter(F.col("ts") >= mid), prior=memory.replay(r.filter(F.col("ts") < mid)))
    return m.select(
        "learner_id", "item_id", "memory.stage", F.col("memory.due").alias("due_us"),
        F.round("memory.stability", 6).alias("stability"), F.round("memory.difficulty", 6).alias("difficulty"),
        "memory.reps", "memory.lapses",
    )


# four copies of each log, one per answer, with that answer appended at NOW
_APPENDED = (
    Q.REVIEWS
    + f""",
rated AS (SELECT learner_id, item_id, r.rating FROM (SELECT DISTINCT learner_id, item_id FROM reviews), (VALUES (1), (2), (3), (4)) AS r(rating)),
extended AS (
  SELECT v.learner_id * 10 + a.rating AS learner_id, v.item_id, v.ts, v.seq, v.rating FROM reviews v
    JOIN rated a ON a.learner_id = v.learner_id AND a.item_id = v.item_id
  UNION ALL SELECT learner_id * 10 + rating, item_id, TIMESTAMP '{Q.NOW}', 1000000000, rating FROM rated),
"""
    # the seed is the item's own id, not the widened one
    + Q.memory_cte("extended").replace("concat(st.learner_id, '-'", "concat(st.learner_id // 10, '-'")
)


@R.add("review_step", Q.rec(_APPENDED, """SELECT learner_id // 10 AS learner_id, item_id, stage, due AS due_us, round(s, 6) AS stability,
  round(d, 6) AS difficulty, reps, lapses FROM memory WHERE learner_id % 10 = 1 + (learner_id // 10 + item_id) % 4"""))
def review_step(spark, sf):
    """one answer applied to each memory; the rating cycles over learner and item."""
    m = memories(spark, sf).withColumn("rating", (F.lit(1) + (F.col("learner_id") + F.col("item_id")) % 4).cast("int"))
    m = memory.apply_review(m.withColumn("at", now()), "at", "rating", item())
    return m.select(
        "learner_id", "item_id", "memory.stage", F.col("memory.due").alias("due_us"),
        F.round("memory.stability", 6).alias("stability"), F.round("memory.difficulty", 6).alias("difficulty"),
        "memory.reps", "memory.lapses",
    )


@R.add("preview_answers", Q.rec(_APPENDED, f"""SELECT learner_id // 10 AS learner_id, item_id, CAST(learner_id % 10 AS INTEGER) AS rating,
  (due - epoch_us(TIMESTAMP '{Q.NOW}')) // 1000000 AS wait_seconds FROM memory"""))
def preview_answers(spark, sf):
    """the wait each of the four answers would give."""
    return memory.preview(memories(spark, sf), Q.NOW, item()).select("learner_id", "item_id", "rating", "wait_seconds")


@R.add("due_state", Q.rec(Q.MEMORY, f"""SELECT learner_id, item_id,
  CASE WHEN stage = 'Review' THEN due // 86400000000 <= epoch_us(TIMESTAMP '{Q.NOW}') // 86400000000
       ELSE due <= epoch_us(TIMESTAMP '{Q.NOW}') END AS is_due,
  {Q.due_for_review()} AS is_due_for_review FROM memory"""))
def due_state(spark, sf):
    """due now, and due in a review session."""
    m = memory.unpack(memories(spark, sf))
    return m.select(
        "learner_id",
        "item_id",
        fsrs.is_due(F.col("stage"), F.col("due"), now()).alias("is_due"),
        fsrs.is_due_for_review(F.col("stage"), F.col("due"), now()).alias("is_due_for_review"),
    )


@R.add("interval_spread", f"""WITH {Q.EV}, u AS (
  SELECT event_id, value / 4.0::DOUBLE AS days, ({Q.fnv("concat(user_id, '-', k, '/', event_id % 10)")} % 10000) / 9999.0::DOUBLE AS unit FROM ev)
SELECT event_id, round(CASE WHEN days < 3 THEN days ELSE days * (0.95::DOUBLE + 0.1::DOUBLE * unit) END, 6) AS fuzzed,
  CAST(least(36500, greatest(1, round_even(CASE WHEN days < 3 THEN days ELSE days * (0.95::DOUBLE + 0.1::DOUBLE * unit) END, 0))) AS BIGINT) AS whole_days
FROM u""")
def interval_spread(spark, sf):
    """F8: hash spread of an interval and its whole days."""
    e = views.events(spark, sf)
    seed = F.concat_ws("/", F.concat_ws("-", F.col("user_id").cast("string"), F.col("k").cast("string")),
                       (F.col("event_id") % 10).cast("string"))
    e = e.select("event_id", (F.col("value") / 4.0).alias("days"), fsrs.fnv1a(seed).alias("h"))
    return e.select(
        "event_id",
        F.round(fsrs.fuzz(F.col("days"), F.col("h")), 6).alias("fuzzed"),
        fsrs.whole_days(F.col("days"), F.col("h")).cast("long").alias("whole_days"),
    )


@R.add("interval_labels", f"""WITH {Q.EV}, t AS (SELECT event_id, (value * value * 60 * (1 + k * k) / 7)::DOUBLE AS s FROM ev),
x AS (SELECT *, round(s / 86400 / CASE WHEN s / 86400 < 365 THEN 30.4 ELSE 365.25 END * 10) AS tenths FROM t)
SELECT event_id, CASE
  WHEN s / 60 < 59.5 THEN concat(greatest(1, CAST(round_even(s / 60, 0) AS BIGINT)), ' min')
  WHEN s / 3600 < 23.5 THEN concat(CAST(round_even(s / 3600, 0) AS BIGINT), ' h')
  WHEN s / 86400 < 30 THEN concat(CAST(round_even(s / 86400, 0) AS BIGINT), ' d')
  ELSE concat(CAST(tenths AS BIGINT) // 10, CASE WHEN CAST(tenths AS BIGINT) % 10 = 0 THEN '' ELSE concat('.', CAST(tenths AS BIGINT) % 10) END,
              CASE WHEN s / 86400 < 365 THEN ' mo' ELSE ' y' END) END AS label FROM x""")
def interval_labels(spark, sf):
    """waits in words."""
    e = views.events(spark, sf)
    seconds = F.col("value") * F.col("value") * 60 * (1 + F.col("k") * F.col("k")) / 7
    return e.select("event_id", fsrs.format_interval(seconds).alias("label"))


@R.add("fresh_memories", f"""WITH {Q.EV}, {Q.NEW_CARDS}
SELECT card_id, 'New' AS stage, epoch_us(created_utc) AS due_us, 0.0::DOUBLE AS stability, 0.0::DOUBLE AS difficulty, 0 AS reps, 0 AS lapses FROM new_cards""")
def fresh_memories(spark, sf):
    """cards never reviewed are due when made."""
    c = views.new_cards(spark, sf).withColumn("memory", F.expr(fsrs.fresh_sql("unix_micros(created_utc)")))
    return c.select("card_id", "memory.stage", F.col("memory.due").alias("due_us"), "memory.stability", "memory.difficulty",
                    "memory.reps", "memory.lapses")
