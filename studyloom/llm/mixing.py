"""Mixing sources to target weights by entropy balancing.

Of all document rates r that give every source its target of words, entropy balancing takes those closest to 1 in relative
entropy, at most `most`. The problem's dual has one number per source: r = min(most, exp(lambda * size / mean size)).
Newton's iterations on the dual run over all sources at once, on the table of (source, size) counts, each a join and a sum
per source; a bracket around each root keeps them safe. Rates are rounded into copies systematically: documents of a source
in order of size, each taking the whole numbers that its share of the running sum passes; so the words taken stay within
one document of the target, and single documents then close what is left of the gap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.llm.common import WORD, numbered, stored

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL, MOST = 1.5, 2.0
ROUNDS, NEAR = 30, 1e-9
CORRECTIONS = 4


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source, source_size), one row per source.

    Weights repeat over the sources by code point, null last. Shares above `most` times the size stop there and the excess
    is shared among the others by weight: with sources in order of most * size / weight, the ones that stop are the first
    of that order, so a running sum gives the one level all others stand at.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*map(F.lit, weights))[F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))]
    d = sources.withColumn("w", w).withColumn("stop", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("stop") / F.col("w"))
    by, all_ = Window.orderBy("ratio", "source_key"), Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    full = F.least(F.lit(total), F.lit(most)) * F.sum("source_size").over(all_)
    level = (full - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    d = d.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(all_)["level"])
    target = F.when(F.col("level").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("w") * F.col("level")))
    return d.select("source_key", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def rate_of(tilt: Column, x: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.least(tilt * x, F.lit(50.0))))


def balanced(counts: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """(source_key, mean, tilt): the dual's solution for counts (source_key, size, n) and targets, one row per source."""
    worded = counts.filter("size > 0")
    means = worded.groupBy("source_key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(F.col("size") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("heavy"))
    start = F.log(F.greatest(F.col("target") / F.col("source_size"), F.lit(1e-12))) * F.col("mean") / F.col("heavy")
    state = goals.filter("source_size > 0").join(means, "source_key").select("source_key", "target", "source_size", "mean", start.alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"))
    state = stored(state, "tilts")
    for _ in range(ROUNDS):
        x = F.col("size") / F.col("mean")
        r = rate_of(F.col("tilt"), x, most)
        words = F.col("n") * F.col("size") * r
        j = worded.join(state.select("source_key", "mean", "tilt"), "source_key")
        sums = j.groupBy("source_key").agg(F.sum(words).alias("f"), F.sum(F.when(r < most, words * x).otherwise(0.0)).alias("slope"))
        s = state.join(sums, "source_key")
        over = F.col("f") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - (F.col("f") - F.col("target")) / F.col("slope")
        # outside the bracket or without a slope: halve it, or double the tilt while one side is still open
        halved = F.when((low > -1e6) & (high < 1e6), (low + high) / 2).otherwise(F.when(over, F.least(F.col("tilt") * 2, F.col("tilt") - 1)).otherwise(F.greatest(F.col("tilt") * 2, F.col("tilt") + 1)))
        near = F.abs(F.col("f") - F.col("target")) <= NEAR * F.col("source_size")
        tilt = F.when(near, F.col("tilt")).when((F.col("slope") > 0) & (step > low) & (step < high), step).otherwise(halved)
        s = s.select("source_key", "target", "source_size", "mean", tilt.alias("tilt"), low.alias("low"), high.alias("high"), near.alias("near"))
        s = stored(s, "tilts")
        state = s.drop("near")
        if s.filter("not near").isEmpty():
            break
    return state.select("source_key", "mean", "tilt")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: int = 2) -> DataFrame:
    """(key, source, size, source_size, target, rate, copies, taken) for each row of `docs`.

    size: words of the text, 0 for null or empty ones, which are taken 0 times. target: the words its source should give.
    taken = copies * size, copies 0 to `most`. Repeated rows are documents of their own and may differ in copies; which of
    them gets more is decided by their order only, so reruns give the same rows. A null source is a source of its own, the
    last. Other columns are not looked at; an empty table gives none. A source may hold any share of the rows: sums are
    combined before the shuffle, and places within (source, size) are counted in buckets.
    """
    d = docs.select(
        docs[key].alias("id"), docs[source].cast("string").alias("source"),
        F.when(docs[source].isNull(), "n").otherwise(F.concat(F.lit("s"), docs[source].cast("string"))).alias("source_key"),
        F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(docs[key].cast("string"), docs[text]).alias("order"),
    )
    d = stored(d, "sizes")
    counts = stored(d.groupBy("source_key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    sources = counts.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = stored(targets(sources, weights, total, float(most)), "targets")
    tilts = balanced(counts, goals, float(most))

    full = F.col("target") >= F.lit(float(most)) * F.col("source_size") * (1 - 1e-12)
    rate = F.when(F.col("size") == 0, 0.0).when(full, float(most)).otherwise(rate_of(F.col("tilt"), F.col("size") / F.col("mean"), float(most)))
    rates = counts.join(goals, "source_key").join(tilts, "source_key", "left").withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    before = Window.partitionBy("source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rates = rates.withColumn("passed", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0)))
    rates = rates.select("source_key", "size", "source_size", "target", "rate", "passed")

    placed = numbered(d, ["source_key", "size"], ["order", "id"], "place", F.pmod("order", F.lit(1024)))
    at = lambda j: F.floor(F.col("passed") + j * F.col("rate") + F.lit(0.5) + F.lit(1e-9))
    c = placed.join(rates, ["source_key", "size"]).withColumn("copies", F.least(at(F.col("place") + 1) - at(F.col("place")), F.lit(most)).cast("int"))
    c = stored(c.select("id", "source", "source_key", "size", "place", "source_size", "target", "rate", "copies"), "copies")
    return closed(c, most).select(
        F.col("id").alias(key), "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def closed(copies: DataFrame, most: int) -> DataFrame:
    """`copies` with one copy more or less of a few documents per source: each the longest that fits what is left of the gap.

    (source_key, size, place) names a row.
    """
    row = ["source_key", "size", "place"]
    gap = stored(copies.groupBy("source_key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")), "gaps")
    changes = None
    for _ in range(CORRECTIONS):
        now = copies if changes is None else changed(copies, changes)
        # a hair of slack: gaps are doubles
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap") + 1e-6) & F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        pick = now.select(*row, "copies").join(gap, "source_key").filter(fits).groupBy("source_key").agg(F.max(F.struct("size", "place")).alias("p"), F.first("gap").alias("gap"))
        pick = stored(pick.select("source_key", "p.size", "p.place", F.signum("gap").cast("int").alias("change")), "changes")
        changes = pick if changes is None else changes.union(pick)
        moved = pick.select("source_key", (F.col("change") * F.col("size")).alias("moved"))
        gap = stored(gap.join(moved, "source_key", "left").select("source_key", (F.col("gap") - F.coalesce("moved", F.lit(0))).alias("gap")), "gaps")
    return changed(copies, changes)


def changed(copies: DataFrame, changes: DataFrame) -> DataFrame:
    row = ["source_key", "size", "place"]
    sums = changes.groupBy(*row).agg(F.sum("change").alias("change"))
    return copies.join(sums, row, "left").withColumn("copies", (F.col("copies") + F.coalesce("change", F.lit(0))).cast("int")).drop("change")
