"""Cards, ideas and the review queue (K1–K20) over the review log in `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import fsrs
from studyloom.operators import memory, review
from studyloom.plans import views
from studyloom.queries import sqlviews as Q
from studyloom.queries.memory import memories, now
from studyloom.queries.registry import Registry

R = Registry()
IDEA = ["learner_id", "item_id"]


def ideas(spark, sf):
    """Items 2 and 3 are ideas, 0 and 1 cards."""
    r = views.reviews(spark, sf).filter("item_id >= 2")
    return memory.unpack(memory.replay(r))


def items(spark, sf):
    """Cards (reviewed and new) and ideas that have a question, in the shape `review_queue` takes."""
    r = views.reviews(spark, sf)
    m = memory.unpack(memory.replay(r))
    made = r.groupBy(*IDEA).agg((F.min("ts") - F.expr("INTERVAL 1 DAY")).alias("created_utc"))
    m = m.join(made, IDEA).withColumn("segment", F.lit(0))
    picks = review.pick_question(views.questions(spark, sf), IDEA, "q").select(*IDEA, "q")
    m = m.join(picks, IDEA, "left").filter("item_id < 2 OR q IS NOT NULL")
    reviewed = m.select(
        "learner_id",
        F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("item_key"),
        F.when(F.col("item_id") < 2, "card").otherwise("idea").alias("item_kind"),
        "stage", "due", "stability", "last_review", "created_utc", "segment",
        F.when(F.col("item_id") >= 2, F.col("q")).alias("question"),
    )
    fresh = views.new_cards(spark, sf).select(
        "learner_id", F.col("card_id").alias("item_key"), F.lit("card").alias("item_kind"), F.lit("New").alias("stage"),
        F.col("created_utc").alias("due"), F.lit(0.0).alias("stability"), F.lit(None).cast("timestamp").alias("last_review"),
        "created_utc", "segment", F.lit(None).cast("int").alias("question"),
    )
    return reviewed.unionByName(fresh)


PICK = """picks AS (
  SELECT learner_id, item_id, q FROM (
    SELECT qs.*, row_number() OVER (PARTITION BY qs.learner_id, qs.item_id
      ORDER BY (CASE WHEN lk.is_choice IS NULL THEN 0 WHEN lk.is_choice = qs.is_choice THEN 1 ELSE 0 END), last_asked NULLS FIRST, q) AS rn
    FROM questions qs LEFT JOIN (
      SELECT learner_id, item_id, is_choice FROM questions WHERE last_asked IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY learner_id, item_id ORDER BY last_asked DESC, q) = 1) lk
    ON lk.learner_id = qs.learner_id AND lk.item_id = qs.item_id) WHERE rn = 1)"""

_RECALL = f"""pow(1.0::DOUBLE + (pow(0.9::DOUBLE, -2.0::DOUBLE) - 1.0::DOUBLE) * greatest(0, (epoch_us(TIMESTAMP '{Q.NOW}') - last_us) / 86400000000.0::DOUBLE) / s, -0.5::DOUBLE)"""

ITEMS = (
    Q.MEMORY + ",\n" + Q.QUESTIONS + ",\n" + Q.NEW_CARDS + ",\n" + PICK + f""",
items AS (
  SELECT m.learner_id, 'i' || m.item_id AS item_key, CASE WHEN m.item_id < 2 THEN 'card' ELSE 'idea' END AS item_kind, stage, due,
         s, last_us, c.created_us, 0 AS segment, CASE WHEN m.item_id >= 2 THEN p.q END AS question
  FROM memory m
  JOIN (SELECT learner_id, item_id, epoch_us(min(ts)) - 86400000000 AS created_us FROM reviews GROUP BY ALL) c
    ON c.learner_id = m.learner_id AND c.item_id = m.item_id
  LEFT JOIN picks p ON p.learner_id = m.learner_id AND p.item_id = m.item_id
  WHERE m.item_id < 2 OR p.q IS NOT NULL
  UNION ALL
  SELECT learner_id, card_id, 'card', 'New', epoch_us(created_utc), 0.0, NULL, epoch_us(created_utc), segment, NULL FROM new_cards),
due_items AS (
  SELECT *, CASE WHEN stage IN ('Learning', 'Relearning') THEN 0 WHEN stage = 'Review' THEN 1 ELSE 2 END AS cls,
    CASE WHEN stage IN ('Learning', 'Relearning') THEN due WHEN stage = 'Review' THEN {_RECALL} ELSE created_us END::DOUBLE AS key
  FROM items WHERE {Q.due_for_review()}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY learner_id, cls ORDER BY key, CASE WHEN cls = 2 THEN segment ELSE 0 END, item_kind, item_key) AS r FROM due_items)"""
)


@R.add("review_queue", Q.rec(ITEMS, """SELECT learner_id, item_key, item_kind, stage, question,
  row_number() OVER (PARTITION BY learner_id ORDER BY cls, r) AS position
FROM ranked WHERE cls < 2 OR r <= 20"""))
def review_queue(spark, sf):
    """K9: cards and ideas due now, in the order to review them."""
    q = review.review_queue(items(spark, sf), now())
    return q.select("learner_id", "item_key", "item_kind", "stage", "question", "position")


@R.add("due_cards", Q.rec(ITEMS, """SELECT learner_id, item_key, row_number() OVER (PARTITION BY learner_id ORDER BY cls, r) AS position
FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY learner_id, cls ORDER BY r) AS r) FROM ranked WHERE item_kind = 'card')
WHERE cls < 2 OR r <= 20"""))
def due_cards(spark, sf):
    """The queue of cards only."""
    cards = items(spark, sf).filter("item_kind = 'card'")
    return review.review_queue(cards, now()).select("learner_id", "item_key", "position")


@R.add("due_card_counts", Q.rec(ITEMS, """SELECT learner_id, CAST(count(*) FILTER (stage <> 'New') + least(20, count(*) FILTER (stage = 'New')) AS BIGINT) AS due_count
FROM due_items WHERE item_kind = 'card' GROUP BY learner_id"""))
def due_card_counts(spark, sf):
    """Number of cards due, at most 20 of them new."""
    return review.due_count(items(spark, sf).filter("item_kind = 'card'"), now())


@R.add("idea_strength", Q.rec(Q.MEMORY, f"""SELECT learner_id, item_id, round(CASE WHEN stage = 'New' THEN 0 ELSE {_RECALL} END, 6) AS strength,
  stage <> 'New' AND NOT (CASE WHEN stage = 'Review' THEN due // 86400000000 <= epoch_us(TIMESTAMP '{Q.NOW}') // 86400000000
       ELSE due <= epoch_us(TIMESTAMP '{Q.NOW}') END) AS skippable
FROM memory WHERE item_id >= 2"""))
def idea_strength(spark, sf):
    """K1, K2: recall of every idea now, and whether a new paper can skip it."""
    c = ideas(spark, sf)
    return c.select(
        *IDEA,
        F.round(review.strength(F.col("stage"), F.col("stability"), F.col("last_review"), now()), 6).alias("strength"),
        review.skippable(F.col("stage"), F.col("due"), now()).alias("skippable"),
    )


@R.add("answer_ratings", f"""WITH {Q.EV} SELECT event_id, CASE WHEN event_type <> 'error' AND k % 4 = event_id % 4 THEN 3 ELSE 1 END AS rating
FROM ev WHERE event_type <> 'signup'""")
def answer_ratings(spark, sf):
    """K3: choices rated against the right option; an error event is "I don't know"."""
    a = views.events(spark, sf).filter("event_type <> 'signup'")
    choice = F.when(F.col("event_type") != "error", F.col("k") % 4)
    return a.select("event_id", review.rating_of(choice, F.col("event_id") % 4).alias("rating"))


@R.add("answer_ideas", Q.rec(Q.REVIEWS + """,
answered AS (SELECT user_id AS learner_id, k % 4 AS item_id, k % 3 AS q, ts, event_id AS seq,
    CASE WHEN k % 5 = event_id % 5 THEN 3 ELSE 1 END AS rating, event_type = 'view' AS asked_only
  FROM ev WHERE event_type IN ('click', 'view') AND k % 4 >= 2),
log2 AS (SELECT learner_id, item_id, ts, seq, rating FROM answered WHERE NOT asked_only),
""" + Q.memory_cte("log2") + """,
asked AS (SELECT learner_id, item_id, q, max(epoch_us(ts)) AS last_asked_us FROM answered GROUP BY ALL)""", """SELECT a.learner_id, a.item_id, a.q, a.last_asked_us, m.stage, m.due AS due_us, m.reps FROM asked a
LEFT JOIN memory m ON m.learner_id = a.learner_id AND m.item_id = a.item_id"""))
def answer_ideas(spark, sf):
    """K4: a question asked is marked; only an answer moves the memory."""
    a = (
        views.events(spark, sf)
        .filter("event_type in ('click', 'view') and k % 4 >= 2")
        .select(
            F.col("user_id").alias("learner_id"), (F.col("k") % 4).alias("item_id"), (F.col("k") % 3).alias("q"), "ts",
            F.col("event_id").alias("seq"), review.rating_of(F.col("k") % 5, F.col("event_id") % 5).alias("rating"),
            (F.col("event_type") == "view").alias("asked_only"),
        )
    )
    pool = a.select(*IDEA, "q").distinct().withColumn("last_asked", F.lit(None).cast("timestamp"))
    marked = review.mark_asked(pool, a, [*IDEA, "q"])
    m = memory.replay(a.filter(~F.col("asked_only")))
    return marked.join(m, IDEA, "left").select(
        *IDEA, "q", F.unix_micros("last_asked").alias("last_asked_us"), "memory.stage", F.col("memory.due").alias("due_us"),
        "memory.reps",
    )


@R.add("question_picks", Q.rec(Q.EV + ",\n" + Q.QUESTIONS + ",\n" + PICK, """SELECT p.learner_id, p.item_id, p.q, c.q AS choice_only
FROM picks p LEFT JOIN (
  SELECT learner_id, item_id, q FROM questions WHERE is_choice
  QUALIFY row_number() OVER (PARTITION BY learner_id, item_id ORDER BY last_asked NULLS FIRST, q) = 1) c
ON c.learner_id = p.learner_id AND c.item_id = p.item_id"""))
def question_picks(spark, sf):
    """K5: the question to ask next, of any kind and multiple choice only."""
    q = views.questions(spark, sf)
    any_kind = review.pick_question(q, IDEA, "q")
    choice = review.pick_question(q, IDEA, "q", choice_only=True).withColumnRenamed("q", "choice_only")
    return any_kind.join(choice, IDEA, "left")


@R.add("question_pool", f"""WITH {Q.EV}, allq AS (
  SELECT user_id AS learner_id, k % 4 AS item_id, k AS qid, min(CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 0 ELSE 1 END) AS late, min(event_id) AS ord
  FROM ev WHERE event_type <> 'signup' GROUP BY ALL)
SELECT learner_id, item_id, qid FROM allq
QUALIFY row_number() OVER (PARTITION BY learner_id, item_id ORDER BY late DESC, ord DESC) <= 12""")
def question_pool(spark, sf):
    """K6: questions of later lessons join the pool; the newest 12 stay."""
    e = views.events(spark, sf).filter("event_type <> 'signup'").select(
        F.col("user_id").alias("learner_id"), (F.col("k") % 4).alias("item_id"), F.col("k").alias("qid"), "event_id", "ts",
    )
    early = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    pool = e.filter(early).groupBy(*IDEA, "qid").agg(F.min("event_id").alias("ord"))
    new = e.filter(~early).groupBy(*IDEA, "qid").agg(F.min("event_id").alias("ord"))
    return review.add_questions(pool, new, IDEA, "qid", ["ord"]).select(*IDEA, "qid")


@R.add("idea_sources", f"""WITH {Q.EV} SELECT user_id AS learner_id, k % 4 AS item_id, k // 10 AS paper_id, epoch_us(max(ts)) AS met_us,
  arg_max(event_id, ts) AS segment FROM ev GROUP BY ALL""")
def idea_sources(spark, sf):
    """K7: the papers an idea was met in, each with its latest meeting."""
    e = views.events(spark, sf).select(
        F.col("user_id").alias("learner_id"), (F.col("k") % 4).alias("item_id"), F.floor(F.col("k") / 10).cast("int").alias("paper_id"),
        "ts", F.col("event_id").alias("segment"),
    )
    s = review.latest_sources(e, IDEA, "paper_id", "ts")
    return s.select(*IDEA, "paper_id", F.unix_micros("ts").alias("met_us"), "segment")


@R.add("new_ideas", f"""WITH {Q.EV}, checks AS (SELECT user_id AS learner_id, k AS item_id, ts FROM ev WHERE event_type = 'purchase'),
known AS (SELECT DISTINCT user_id AS learner_id, k AS item_id FROM ev WHERE event_type = 'click')
SELECT learner_id, item_id, epoch_us(min(ts)) AS created_us, 'New' AS stage, 0 AS reps FROM checks c
WHERE NOT EXISTS (SELECT 1 FROM known n WHERE n.learner_id = c.learner_id AND n.item_id = c.item_id) GROUP BY ALL""")
def new_ideas(spark, sf):
    """K8: ideas made at their first check (purchase) unless known already (click)."""
    e = views.events(spark, sf).select(F.col("user_id").alias("learner_id"), F.col("k").alias("item_id"), "ts", "event_type")
    made = review.create_ideas(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), IDEA)
    return made.select(*IDEA, F.unix_micros("created_utc").alias("created_us"), "memory.stage", "memory.reps")


def _sources(spark, sf):
    e = views.events(spark, sf).select(
        F.col("user_id").alias("learner_id"), (F.col("k") % 4).alias("item_id"), F.floor(F.col("k") / 10).cast("int").alias("paper_id"),
        "ts", F.col("event_id").alias("segment"),
    )
    s = review.latest_sources(e, IDEA, "paper_id", "ts")
    newest = F.sort_array(F.collect_list(F.struct("ts", "paper_id", "segment")), asc=False)
    return s.groupBy(*IDEA).agg(newest.alias("sources"))


_SOURCES = Q.EV + """,
src AS (SELECT user_id AS learner_id, k % 4 AS item_id, k // 10 AS paper_id, max(ts) AS ts, arg_max(event_id, ts) AS segment FROM ev GROUP BY ALL)"""


@R.add("ideas_of_paper", f"WITH {_SOURCES} SELECT DISTINCT learner_id, item_id FROM src WHERE paper_id = 3")
def ideas_of_paper(spark, sf):
    """Ideas met in paper 3."""
    return review.of_paper(_sources(spark, sf), F.lit(3)).select(*IDEA)


@R.add("where_to_listen", f"""WITH {_SOURCES} SELECT learner_id, item_id, paper_id, segment FROM src WHERE paper_id % 3 = 1
QUALIFY row_number() OVER (PARTITION BY learner_id, item_id ORDER BY ts DESC) = 1""")
def where_to_listen(spark, sf):
    """The latest paper of each idea that is still in the library (papers 1, 4, 7)."""
    library = views.events(spark, sf).select(F.floor(F.col("k") / 10).cast("int").alias("paper_id")).distinct().filter("paper_id % 3 = 1")
    return review.where_to_listen(_sources(spark, sf), library, IDEA)


@R.add("deck_sizes", "SELECT p_partkey, CAST(least(30, greatest(12, p_size)) AS INTEGER) AS cards FROM part")
def deck_sizes(spark, sf):
    """Cards for a paper of `p_size` pages."""
    return views.table(spark, sf, "part").select("p_partkey", review.deck_size(F.col("p_size")).cast("int").alias("cards"))


@R.add("learn_summary", Q.rec(ITEMS, f"""SELECT learner_id,
  CAST(count(*) FILTER (({Q.due_for_review()}) AND stage <> 'New') + least(20, count(*) FILTER (({Q.due_for_review()}) AND item_kind = 'card' AND stage = 'New')) AS BIGINT) AS due_now,
  count(*) FILTER (item_kind = 'card') AS cards, count(*) FILTER (item_kind = 'idea' AND stage <> 'New') AS ideas,
  count(*) FILTER (stage = 'Review' AND item_kind = 'card') + count(*) FILTER (item_kind = 'idea' AND stage <> 'New') AS learned,
  min(due) FILTER (due > epoch_us(TIMESTAMP '{Q.NOW}')) AS next_due_us
FROM items GROUP BY learner_id"""))
def learn_summary(spark, sf):
    """One line per learner."""
    s = review.learn_summary(items(spark, sf), now())
    return s.withColumn("next_due_us", F.unix_micros("next_due")).drop("next_due")


@R.add("session_scores", f"""WITH {Q.REVIEWS} SELECT learner_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, count(*) AS answered,
  count(*) FILTER (rating > 1) AS remembered FROM reviews GROUP BY ALL""")
def session_scores(spark, sf):
    """Answered and remembered per learner and day."""
    r = views.reviews(spark, sf).withColumn("day", F.floor(F.unix_micros("ts") / fsrs.DAY).cast("long"))
    return review.session_score(r, ["learner_id", "day"])


@R.add("retracted_replay", Q.rec(Q.REVIEWS + """,
kept AS (SELECT * FROM reviews WHERE seq NOT IN (SELECT event_id + 1 FROM ev WHERE event_type = 'signup' AND k % 2 = 0)),
""" + Q.memory_cte("kept"), "SELECT learner_id, item_id, stage, due AS due_us, reps, lapses, round(s, 6) AS stability FROM memory"))
def retracted_replay(spark, sf):
    """Answers followed back by a retraction never happened; memories are replayed without them."""
    gone = views.events(spark, sf).filter("event_type = 'signup' and k % 2 = 0").select((F.col("event_id") + 1).alias("seq"))
    m = memory.replay(review.retract(views.reviews(spark, sf), gone, ["seq"]))
    return m.select(*IDEA, "memory.stage", F.col("memory.due").alias("due_us"), "memory.reps", "memory.lapses",
                    F.round("memory.stability", 6).alias("stability"))


@R.add("listened_percent", f"""WITH {Q.SEGMENTS} SELECT paper_id, CAST(floor(100 * arg_max(idx, ts) FILTER (event_type_view) // count(*)) AS BIGINT) AS percent
FROM (SELECT *, kind = 'sentence' AND k % 2 = 0 AS event_type_view FROM segments) GROUP BY paper_id""")
def listened_percent(spark, sf):
    """How far each paper was listened to; the last even-numbered sentence is the position."""
    s = views.segments(spark, sf)
    at = F.max_by("idx", F.when((F.col("kind") == "sentence") & (F.col("k") % 2 == 0), F.col("ts")))
    g = s.groupBy("paper_id").agg(at.alias("last"), F.count("*").alias("n"))
    return g.select("paper_id", review.listened_percent(F.col("last"), F.col("n")).alias("percent"))
