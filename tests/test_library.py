"""Ideas written, read back and compared, fields that are not there included."""

import datetime as dt

from pyspark.sql import functions as F

from studyloom.sources import library as B


def test_ideas_written_and_read_back(spark):
    at = dt.datetime(2026, 3, 1, 12, 30, 5, 250_000)
    memory = ("Review", at, 12.5, 4.25, 7, 1, None)
    whole = (1, "c1", "näme \"x\"", "a\nb", True, [("p1", "T", 3), ("p2", "", 0)], [("q1", "Why?", ["a", "b"], 1, ["no", "yes"], "", "p1", "E1", at), ("q2", "How?", [], -1, [], "So.", "", None, None)], memory, at)
    bare = (1, "c2", "", "", False, [], [], ("New", at, 0.0, 0.0, 0, 0, None), at)
    d = spark.createDataFrame([whole, bare], "learner_id long, concept_id string, name string, definition string, background boolean, sources array<struct<paper_id:string,title:string,segment:int>>, questions array<struct<id:string,prompt:string,options:array<string>,correct:int,why:array<string>,answer:string,paper_id:string,visual:string,last_asked:timestamp>>, memory struct<stage:string,due:timestamp,stability:double,difficulty:double,reps:int,lapses:int,last_review:timestamp>, created_utc timestamp")
    files = B.write_concepts(d)
    got = B.read_concepts(files, F.lit("2000-01-01").cast("timestamp"))
    assert sorted(map(str, got.select(*d.columns).collect())) == sorted(map(str, d.collect()))
    text = files.filter(F.col("json").contains("c2")).first()["json"]
    assert '"options"' not in text and '"last"' not in text
