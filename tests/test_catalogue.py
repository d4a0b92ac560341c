"""The stored search index against the scan of the whole catalogue."""

import random

import pytest
from pyspark.sql import functions as F

from studyloom.operators import catalog, postings


@pytest.fixture(scope="module")
def works(spark):
    r = random.Random(6)
    rows = [(f"k{i:04d}", " ".join(r.choice(["alpha", "beta", "Gamma", "delta,", "rare" if i % 97 == 0 else "the", "the"]) for _ in range(r.randint(0, 30)))) for i in range(800)]
    return spark.createDataFrame(rows + [("null", None), ("empty", ""), ("tie1", "beta beta gamma"), ("tie2", "gamma Beta beta")], "key string, text string")


@pytest.fixture(scope="module")
def index(spark, works, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    postings.write_index(works, path, parts=8, slots=32)
    return postings.Index(spark, path)


@pytest.mark.parametrize("words", ["beta gamma", "the", "rare alpha", "the alpha beta gamma delta", "THE rare", "none", "beta none"])
@pytest.mark.parametrize("page", [1, 2, 7])
def test_pages_equal_the_scan(works, index, words, page):
    got = [tuple(r) for r in index.search(words, page).collect()]
    assert got == [tuple(r) for r in catalog.search(works, words, page).collect()]


def test_a_search_opens_its_words_partitions_only(spark, index):
    assert index.search("").count() == 0
    rows = index.of(["beta"])
    assert {f.split("part=")[1].split("/")[0] for f in rows.inputFiles()} and rows.select("word").distinct().count() == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(word" in plan or "EqualTo(word" in plan
    sizes = index.postings.selectExpr("max(size(keys)) most", "max(n) n").first()
    assert sizes["most"] == sizes["n"] < 60


def test_slots_that_cannot_reach_the_page_are_left_out(spark, tmp_path):
    rows = [(f"k{i:05d}", "common " * (60 if i % 500 == 0 else 1) + ("other" if i % 2 else "")) for i in range(10_000)]
    works = spark.createDataFrame(rows, "key string, text string")
    postings.write_index(works.repartition(4), str(tmp_path), parts=4, slots=128)
    index = postings.Index(spark, str(tmp_path))
    assert [tuple(r) for r in index.search("other common").collect()] == [tuple(r) for r in catalog.search(works, "other common").collect()]


def test_words_are_shuffled_once(spark, works):
    """counting and gathering share one shuffle."""
    d = works.select("key", F.split(F.lower("text"), " ").alias("_w"))
    plan = postings.postings_of(d, 8, 32)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
