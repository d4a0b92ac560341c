"""Cards, ideas and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions import fsrs
from studyloom.plans.ordered import Running, scan
from studyloom.session import cut_lineage

NEW_PER_SESSION = 20  # fixed value: new cards taken into one review
MAX_QUESTIONS = 12  # fixed value: questions kept per idea


def days_since(then: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(float(fsrs.DAY))


def strength(stage: Column, stability: Column, last_review: Column, now: Column) -> Column:
    """K1: chance of recalling the idea now; 0 before it was ever checked."""
    known = (stage != "New") & last_review.isNotNull()
    return F.when(known, fsrs.recall(stability, days_since(last_review, now))).otherwise(F.lit(0.0))


def skippable(stage: Column, due: Column, now: Column, tz: str = "UTC") -> Column:
    """K2: known and not due, so a new paper need not teach it."""
    return (stage != "New") & ~fsrs.is_due(stage, due, now, tz)


def rating_of(choice: Column, correct: Column) -> Column:
    """K3: right is Good (3); wrong or no choice is Again (1)."""
    return F.when(choice == correct, F.lit(3)).otherwise(F.lit(1))


def pick_question(
    questions: DataFrame, keys: list[str], ordinal: str, choice_only: bool = False, exclude: DataFrame | None = None
) -> DataFrame:
    """K5: (keys…, question): of the other kind than the one asked last, then longest not asked (never first).

    One map-side combined aggregate: the pick is precomputed for each possible "last kind", so no key is sorted.
    `exclude` (keys…, ordinal) takes questions out of the choice but not out of what was asked last.
    """
    q = questions
    allowed = F.lit(True)
    if exclude is not None:
        q = q.join(exclude.select(*keys, ordinal, F.lit(True).alias("_out")), [*keys, ordinal], "left")
        allowed = F.col("_out").isNull()
    if choice_only:
        allowed = allowed & F.col("is_choice")

    def best(kind: bool | None) -> Column:
        same = F.lit(False) if kind is None else F.col("is_choice") == F.lit(kind)
        rank = F.struct(same.alias("s"), F.col("last_asked").alias("a"), F.col(ordinal).alias("o"))
        return F.min(F.when(allowed, rank))["o"]

    last_kind = F.max(
        F.when(F.col("last_asked").isNotNull(), F.struct("last_asked", (-F.col(ordinal)).alias("o"), "is_choice"))
    )["is_choice"]
    agg = q.groupBy(*keys).agg(
        last_kind.alias("_kind"), best(None).alias("_any"), best(True).alias("_after_choice"), best(False).alias("_after_recall")
    )
    pick = F.when(F.col("_kind").isNull(), F.col("_any")).otherwise(
        F.when(F.col("_kind"), F.col("_after_choice")).otherwise(F.col("_after_recall"))
    )
    return agg.select(*keys, pick.alias(ordinal)).filter(F.col(ordinal).isNotNull())


def mark_asked(questions: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """K4 (question side): `last_asked` moved to the latest answer or showing at `ts`."""
    latest = answers.groupBy(*keys).agg(F.max("ts").alias("_ts"))
    return (
        questions.join(latest, keys, "left")
        .withColumn("last_asked", F.greatest(F.col("last_asked"), F.col("_ts")))
        .drop("_ts")
    )


def add_questions(pool: DataFrame, new: DataFrame, keys: list[str], qid: str, order: list[str]) -> DataFrame:
    """K6: the pool and the new questions by id, the newest 12 kept (pool before new, each in `order`)."""
    fresh = new.join(pool.select(*keys, qid), [*keys, qid], "left_anti")
    both = pool.withColumn("_late", F.lit(0)).unionByName(fresh.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_late").desc(), *[F.col(c).desc() for c in order])
    return both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= MAX_QUESTIONS).drop("_r", "_late")


def latest_sources(sources: DataFrame, keys: list[str], paper: str, ts: str) -> DataFrame:
    """K7: one source per paper, the most recent meeting; ordered by `ts` descending for the reader."""
    rest = [c for c in sources.columns if c not in (*keys, paper, ts)]
    return (
        sources.groupBy(*keys, paper)
        .agg(F.max(F.struct(ts, *rest)).alias("_m"))
        .select(*keys, paper, *[F.col(f"_m.{c}").alias(c) for c in (ts, *rest)])
    )


def create_ideas(checks: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """K8: ideas met for the first time: the first check of each idea not known yet, fresh and due at that moment."""
    unknown = checks.join(known.select(*keys), keys, "left_anti")
    first = unknown.groupBy(*keys).agg(F.min("ts").alias("created_utc"))
    memory = F.expr(fsrs.fresh_sql("unix_micros(created_utc)"))
    return first.withColumn("memory", memory)


def review_queue(items: DataFrame, now: Column, learner: str = "learner_id", tz: str = "UTC") -> DataFrame:
    """What to review now, in order, per learner.

    items(learner, item_key, item_kind, stage, due, stability, last_review, created_utc, segment); ideas without a
    question are to be left out before. Steps by due, then reviews by recall, then at most 20 new items by
    (created, segment): those are cut to 20 by a row_number limit (pruned before the shuffle), and positions come from a
    bucketed scan. The items are stored first, as they are read four times.
    """
    items = items.filter("item_kind = 'card' OR stage <> 'New'")
    due = items.filter(fsrs.is_due_for_review(F.col("stage"), F.col("due"), now, tz))
    cls = F.when(F.col("stage").isin("Learning", "Relearning"), 0).when(F.col("stage") == "Review", 1).otherwise(2)
    recall = F.when(
        F.col("last_review").isNotNull(), fsrs.recall(F.col("stability"), days_since(F.col("last_review"), now))
    ).otherwise(F.lit(0.0))
    d = due.withColumn("_class", cls).withColumn(
        "_key",
        F.when(cls == 0, F.unix_micros("due").cast("double"))
        .when(cls == 1, recall)
        .otherwise(F.unix_micros("created_utc").cast("double")),
    )
    d = d.withColumn("_seg", F.when(cls == 2, F.col("segment")).otherwise(F.lit(0)))
    order = ["_class", "_key", "_seg", "item_kind", "item_key"]
    extra = ["_class", "_key", "_seg"]
    d = cut_lineage(d)
    w = Window.partitionBy(learner).orderBy(*order[1:])
    new = d.filter(F.col("_class") == 2).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= NEW_PER_SESSION)
    d = d.filter(F.col("_class") < 2).unionByName(new.drop("_r"))
    # class, then the leading part of its sort key: due day, recall in thousandths, creation day
    part = F.when(F.col("_class") == 1, F.floor(F.col("_key") * 1000)).otherwise(F.floor(F.col("_key") / fsrs.DAY))
    bucket = F.col("_class").cast("long") * F.lit(1_000_000_000) + part.cast("long")
    d = scan(d, [learner], order, bucket, [Running("position", "sum", F.lit(1).cast("long"))])
    return d.drop(*extra)


def due_count(items: DataFrame, now: Column, learner: str = "learner_id", tz: str = "UTC") -> DataFrame:
    """Items due per learner, counting at most 20 new ones."""
    due = items.filter(fsrs.is_due_for_review(F.col("stage"), F.col("due"), now, tz))
    n_new = F.count_if(F.col("stage") == "New")
    return due.groupBy(learner).agg(
        (F.count_if(F.col("stage") != "New") + F.least(n_new, F.lit(NEW_PER_SESSION))).cast("long").alias("due_count")
    )


def of_paper(concepts: DataFrame, paper: Column) -> DataFrame:
    """Ideas met in a paper (`sources` is an array of structs)."""
    return concepts.filter(F.exists("sources", lambda s: s["paper_id"] == paper))


def where_to_listen(concepts: DataFrame, library: DataFrame, keys: list[str]) -> DataFrame:
    """For each idea the first source whose paper is still in the library."""
    s = concepts.select(*keys, F.posexplode("sources").alias("_pos", "_s")).select(
        *keys, "_pos", F.col("_s.paper_id").alias("paper_id"), F.col("_s.segment").alias("segment")
    )
    kept = s.join(library.select("paper_id"), "paper_id", "left_semi")
    return kept.groupBy(*keys).agg(F.min(F.struct("_pos", "paper_id", "segment")).alias("_m")).select(
        *keys, F.col("_m.paper_id").alias("paper_id"), F.col("_m.segment").alias("segment")
    )


def deck_size(pages: Column) -> Column:
    """About one card per page, 12 to 30."""
    return F.least(F.lit(30), F.greatest(F.lit(12), pages))


def learn_summary(items: DataFrame, now: Column, learner: str = "learner_id", tz: str = "UTC") -> DataFrame:
    """Per learner: due now, cards, ideas, learned, next due after now."""
    due = fsrs.is_due_for_review(F.col("stage"), F.col("due"), now, tz)
    is_card = F.col("item_kind") == "card"
    studied = ~is_card & (F.col("stage") != "New")
    return items.groupBy(learner).agg(
        (
            F.count_if(due & (F.col("stage") != "New"))
            + F.least(F.count_if(due & is_card & (F.col("stage") == "New")), F.lit(NEW_PER_SESSION))
        ).cast("long").alias("due_now"),
        F.count_if(is_card).alias("cards"),
        F.count_if(studied).alias("ideas"),
        (F.count_if(is_card & (F.col("stage") == "Review")) + F.count_if(studied)).alias("learned"),
        F.min(F.when((is_card | studied) & (F.col("due") > now), F.col("due"))).alias("next_due"),
    )


def session_score(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Answered, and remembered (not Again)."""
    return reviews.groupBy(*keys).agg(F.count("*").alias("answered"), F.count_if(F.col("rating") > 1).alias("remembered"))


def retract(reviews: DataFrame, retractions: DataFrame, keys: list[str]) -> DataFrame:
    """The log without answers that never happened (misheard, or the question was wrong)."""
    return reviews.join(retractions.select(*keys), keys, "left_anti")


def listened_percent(last_segment: Column, segment_count: Column) -> Column:
    """K19."""
    pct = F.floor(last_segment * F.lit(100) / F.greatest(segment_count, F.lit(1)))
    return F.when(segment_count > 0, pct).otherwise(F.lit(0)).cast("long")



def parse_cards(replies: DataFrame, existing: DataFrame, visuals: DataFrame, sections: DataFrame, shown: DataFrame, ends: DataFrame, now: Column) -> DataFrame:
    """New cards of replies(paper_id, reply_id, origin, position, text).

    Cards missing a side, and fronts (normalised) that exist already or came earlier, are left out; a visual must exist;
    the segment is the named section's first, for a whole paper's deck else where the visual is first shown, else the
    position, within the paper. sections(paper, section, first_segment), shown(paper, visual_id, first_segment), ends(paper, last).
    """
    from studyloom.functions import replies as Y

    key = ["paper_id"]
    c = replies.select(*key, "reply_id", "origin", "position", F.posexplode(Y.reply_cards(F.col("text"))).alias("ord", "c"))
    c = c.select(
        *key, "reply_id", "origin", "position", "ord", F.trim("c.front").alias("front"), F.trim("c.back").alias("back"), F.col("c.showOn").alias("_on"),
        F.when(~F.coalesce("c.show", F.lit("")).isin("", "null", "none"), Y.strip_chars(F.col("c.show"), r"\[\] ")).alias("_show"), F.col("c.section").try_cast("int").alias("section"),
    ).filter("front <> '' AND back <> ''")
    c = c.withColumn("_norm", Y.normal_front(F.col("front")))
    c = c.join(existing.select(*key, Y.normal_front(F.col("front")).alias("_norm")).distinct(), [*key, "_norm"], "left_anti")
    cols = c.columns
    c = c.groupBy(*key, "_norm").agg(F.min_by(F.struct(*cols), F.struct("reply_id", "ord")).alias("_c")).select("_c.*")
    c = c.join(visuals.select(*key, F.col("visual_id").alias("_show"), F.col("visual_id").alias("visual")).distinct(), [*key, "_show"], "left")
    c = c.join(sections.filter("section > 0").select(*key, "section", F.col("first_segment").alias("_sec")), [*key, "section"], "left")
    c = c.join(shown.select(*key, F.col("visual_id").alias("visual"), F.col("first_segment").alias("_first")), [*key, "visual"], "left").join(ends, key)
    seg = F.coalesce("_sec", F.when(F.col("origin") == "paper", F.col("_first")), "position")
    return c.select(
        *key, "reply_id", "ord", F.sha2(F.concat_ws("|", F.col("paper_id").cast("string"), "_norm"), 256).alias("card_id"), "front", "back", "visual",
        (F.col("visual").isNotNull() & (F.coalesce("_on", F.lit("")) == "front")).alias("visual_on_front"), F.greatest(F.lit(0), F.least(seg, "last")).alias("segment"), "origin", now.alias("created_utc"),
    )


def known_list(concepts: DataFrame, now: Column, learner: str = "learner_id", tz: str = "UTC") -> DataFrame:
    """Studied ideas as listed: percent remembered, when the review is, where it is from; in order of their names.

    Sorted within each learner's own list (`sort_name`), not globally.
    """
    c = concepts.filter("stage <> 'New'")
    pct = F.rint(strength(F.col("stage"), F.col("stability"), F.col("last_review"), now) * 100).cast("int")
    wait = (F.unix_micros("due") - F.unix_micros(now)) / 1_000_000
    nxt = F.when(fsrs.is_due(F.col("stage"), F.col("due"), now, tz), "review due").otherwise(F.concat(F.lit("review in "), fsrs.format_interval(wait)))
    n = F.size("sources")
    more = F.when(n > 1, F.concat(F.lit(" and "), (n - 1).cast("string"), F.lit(" more"))).otherwise("")
    origin = F.when(n > 0, F.concat(F.lit("from "), F.col("sources")[0]["title"], more)).otherwise("")
    return c.select(learner, "concept_id", F.lower("name").alias("sort_name"), pct.alias("percent"), nxt.alias("next"), origin.alias("origin"))
