"""D8 on a stored index: a search reads the postings of its own words only, and of these only what can reach the page.

The index is two tables. `postings` holds one row for each (word, slot): the keys of the works of that slot which hold the
word, how often they do, and the greatest of these numbers. A work's slot is a hash of its key, the same for all its words,
so the rows of one slot can be intersected by themselves, and a slot's best possible score is known from the greatest
numbers alone. The table is partitioned by a hash of the word and sorted by word within its files. `size` holds the number
of works and the two widths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SIZE = 20  # fixed value: results per page
#: slots looked at first, for a score that the others must reach
FIRST_SLOTS = 16


def _part(word: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(parts)).cast("int")


def postings_of(d: DataFrame, parts: int, slots: int) -> DataFrame:
    """The rows of postings of d(key, _w): words are shuffled once, by (word, slot), and counted and gathered there."""
    slot = F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int")
    each = d.select("key", slot.alias("slot"), F.explode("_w").alias("word")).filter("word <> ''")
    once = each.repartition("word", "slot").groupBy("word", "slot", "key").agg(F.count(F.lit(1)).alias("tf"))
    rows = once.groupBy("word", "slot").agg(F.array_sort(F.collect_list(F.struct("key", "tf"))).alias("_p"), F.max("tf").alias("most"))
    return rows.select("word", "slot", "most", F.size("_p").cast("long").alias("n"), F.col("_p.key").alias("keys"), F.col("_p.tf").alias("tfs"), _part(F.col("word"), parts).alias("part"))


def write_index(works: DataFrame, path: str, text: str = "text", key: str = "key", parts: int = 32, slots: int = 256) -> None:
    """The index of works(key, text) at `path`, replacing one that is there.

    A row of postings holds about works / `slots` keys at most, whatever the word, so `slots` grows with the catalogue; with
    `parts` it sets how much of the table a search opens. Rows are dealt to their files after the one shuffle by (word, slot).
    Null texts have no words; works with a null key are left out.
    """
    d = works.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+").alias("_w"))
    rows = postings_of(d, parts, slots)
    rows.repartition("part").sortWithinPartitions("part", "word", "slot").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    counted = d.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(parts).alias("parts"), F.lit(slots).alias("slots"))
    counted.coalesce(1).write.mode("overwrite").parquet(f"{path}/size")


class Index:
    """A stored index, opened."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        size = spark.read.parquet(f"{path}/size").first()
        self.n, self.parts = size["n"], size["parts"]
        self.postings = spark.read.parquet(f"{path}/postings")

    def of(self, words: Sequence[str]) -> DataFrame:
        """The rows of these words; other partitions aren't opened."""
        parts = [_part(F.lit(w), self.parts) for w in words]
        return self.postings.filter(F.col("part").isin(*parts) & F.col("word").isin(*words)).drop("part")

    def search(self, words: str, page: int = 1) -> DataFrame:
        """(key, score, total): the works that hold all words, by the sum of tf ln(n / df), then key; 20 a page.

        `total` is the number of all such works. Words are those of `words` between spaces, in lower case; one that the index
        doesn't have makes the result empty, and so does a search for nothing.
        """
        wanted = sorted({w for w in words.lower().split() if w})
        end = page * PAGE_SIZE
        rows = self.of(wanted) if wanted else self.postings.filter(F.lit(False)).drop("part")
        df = rows.groupBy("word").agg(F.sum("n").alias("df"))
        weighed = rows.join(F.broadcast(df.select("word", F.log(F.lit(float(self.n)) / F.greatest(F.lit(1), "df")).alias("idf"))), "word")  # as many rows as words are asked for
        slots = weighed.groupBy("slot").agg(F.count(F.lit(1)).alias("_words"), F.sum(F.col("most") * F.col("idf")).alias("best")).filter(F.col("_words") == len(wanted)).select("slot", "best")

        def hits(of: DataFrame) -> DataFrame:
            each = weighed.join(of, "slot", "left_semi").select("word", "idf", F.explode(F.arrays_zip("keys", "tfs")).alias("_p"))
            # summed in the order of the words, so that the same work has the same score however it is found
            scored = each.select(F.col("_p.keys").alias("key"), F.struct("word", (F.col("_p.tfs") * F.col("idf")).alias("s")).alias("_s")).groupBy("key").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
            score = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x["s"])
            return scored.filter(F.size("_s") == len(wanted)).select("key", F.round(score, 6).alias("score"))

        first = hits(slots.orderBy(F.col("best").desc(), "slot").limit(FIRST_SLOTS)).orderBy(F.col("score").desc(), "key").limit(end)
        # the last place of the page as far as it is known; 0 where the first slots don't fill it
        reached = first.agg(F.when(F.count(F.lit(1)) == end, F.min("score")).otherwise(F.lit(0.0)).alias("reached"))
        # scores are rounded and bounds are not
        found = hits(slots.filter(F.col("best") >= reached.select("reached").scalar() - 1e-6))
        both = rows.groupBy("slot").agg(F.collect_list("keys").alias("_k")).filter(F.size("_k") == len(wanted))
        total = both.agg(F.coalesce(F.sum(F.size(F.aggregate(F.slice("_k", 2, max(len(wanted), 1)), F.col("_k")[0], F.array_intersect))), F.lit(0)).cast("long").alias("total"))
        paged = found.orderBy(F.col("score").desc(), "key").offset(end - PAGE_SIZE).limit(PAGE_SIZE)
        return paged.select("key", "score", total.select("total").scalar().alias("total"))
