"""Tables of the engine's data model derived from the test data (`events`, `documents`, `pages`, …).

Every derivation is declarative, so the scale of a view follows its source table. The SQL of the same views is in
`studyloom.queries.sqlviews`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.plans.ordered import Running, by_day, scan
from studyloom.plans.parallel import spread


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of texts, spread over the cores."""
    return spread(table(spark, sf, name))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def utc(ts: str) -> F.Column:
    """A zone-free timestamp column read as UTC, whatever the session's zone."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts}))")


def _k() -> F.Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """`events` with its JSON number read once as `k`."""
    return table(spark, sf, "events").withColumn("k", _k()).withColumn("ts", utc("ts"))


RATING = {"error": 1, "view": 2, "click": 3, "purchase": 4}


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """reviews(learner_id, item_id, ts, seq, rating): the review log."""
    e = events(spark, sf).filter("event_type <> 'signup'")
    rating = F.create_map(*[F.lit(x) for kv in RATING.items() for x in kv])[F.col("event_type")]
    return e.select(
        F.col("user_id").alias("learner_id"),
        (F.col("k") % 4).cast("int").alias("item_id"),
        "ts",
        F.col("event_id").alias("seq"),
        rating.cast("int").alias("rating"),
    )


def new_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards made but never reviewed: one per signup or purchase event."""
    return (
        events(spark, sf)
        .filter("event_type in ('signup', 'purchase')")
        .select(
            F.col("user_id").alias("learner_id"),
            F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("card_id"),
            F.col("ts").alias("created_utc"),
            F.col("k").alias("segment"),
        )
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """questions(learner_id, item_id, q, is_choice, last_asked): up to three per idea; q 2 is answered from memory."""
    return (
        events(spark, sf)
        .filter("event_type in ('click', 'view')")
        .groupBy(
            F.col("user_id").alias("learner_id"),
            (F.col("k") % 4).cast("int").alias("item_id"),
            (F.col("k") % 3).cast("int").alias("q"),
        )
        .agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("last_asked"))
        .withColumn("is_choice", F.col("q") < 2)
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """segments(paper_id, idx, kind, section, page, unit_visual, given, say, k, ts): one narrated clip per event.

    signup = heading, others = sentences; a purchase has its own visual, an error is given one by reference.
    """
    e = events(spark, sf).select(
        F.col("user_id").alias("paper_id"), "ts", "event_id", "event_type", "k", "value",
    )
    d = e.withColumn("kind", F.when(F.col("event_type") == "signup", "heading").otherwise("sentence"))
    d = scan(d, ["paper_id"], ["ts", "event_id"], by_day("ts"), [
        Running("idx", "sum_before", F.lit(1).cast("long")), Running("section", "sum", (F.col("kind") == "heading").cast("long")),
    ])
    v = F.concat(F.lit("E"), (F.col("k") % 5).cast("string"))
    return d.select(
        "paper_id",
        "idx",
        "kind",
        "section",
        F.floor(F.col("idx") / 10).cast("long").alias("page"),
        F.when(F.col("event_type") == "purchase", v).alias("own_visual"),
        F.when(F.col("event_type") == "error", v).alias("ref_visual"),
        F.concat_ws(" ", F.lit("Equation"), (F.col("k") % 7).cast("string"), F.col("event_type"), F.col("value").cast("int").cast("string")).alias("say"),
        "k",
        "ts",
        "event_id",
    )


def is_inline(visual: F.Column) -> F.Column:
    """In the derived segments the visual E0 is an inline formula."""
    return visual == F.lit("E0")


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """clips(paper_id, idx, duration_ms); no row where idx % 17 = 3 (not synthesized yet)."""
    return (
        segments(spark, sf)
        .filter("idx % 17 <> 3")
        .select("paper_id", "idx", F.floor(F.lit(400) + F.lit(1000) * (F.col("k") + 1) / 15).cast("long").alias("duration_ms"))
    )
