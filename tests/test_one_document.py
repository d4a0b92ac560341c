"""A document that holds all rows is not one task's; a text's words are indexed in its own row."""

import pytest
from pyspark.sql import functions as F

from studyloom.functions import titles as N
from studyloom.operators import layout as L


@pytest.fixture
def shuffled(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def test_words_meet_their_body_by_page(shuffled):
    words = shuffled.range(400).selectExpr("1L AS doc_id", "id div 4 AS page", "id AS word_id", "10.0 AS size")
    body = shuffled.createDataFrame([(1, 9.0), (2, 8.0)], "doc_id long, body double")
    d = L._with_body(words, body).cache()
    assert d.count() == 400 and d.select("body").distinct().collect() == [(9.0,)]
    assert d.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200
    d.unpersist()


def test_words_of_a_text(spark):
    texts = ["a b a", "", "b", None, "a a a", "Abstract: x y x y z"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.filter(F.split("t", " "), lambda x: x != "").alias("w"))
    d = d.select("t", N.word_index(F.col("w")).alias("i"))
    for r in d.collect():
        ws = None if r.t is None else r.t.split()
        assert r.i == (None if ws is None else {w: [p for p, x in enumerate(ws) if x == w] for w in ws})
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_groups_are_read_once(spark):
    from studyloom.operators import ocr as O

    groups = spark.createDataFrame([(1, 1, "Fig1", 9, 2), (1, 1, "Fig1", 9, 3)], "doc_id long, page long, visual_id string, caption_ord long, ord long")
    blocks = spark.createDataFrame([(1, 1, i, 10.0 * i, 20.0, 10.0 * i + 5, 30.0) for i in (2, 3, 9)], "doc_id long, page long, ord long, x0 double, y0 double, x1 double, y1 double")
    sizes = spark.createDataFrame([(1, 1, 612.0, 792.0, 612.0, 792.0)], "doc_id long, page long, px_w double, px_h double, pt_w double, pt_h double")
    r = O.regions(groups, blocks, sizes)
    assert [tuple(x) for x in r.select("visual_id", "x", "y", "w", "h").collect()] == [("Fig1", 16.0, 16.0, 83.0, 18.0)]
    # groups, blocks and sizes
    assert r._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
