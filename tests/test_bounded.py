"""Documents that were one row each: their scans share one shuffle, store nothing, and give what buckets give."""

import pytest
from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.operators import markdown as D
from studyloom.operators import structure as S

BOOKS = [
    (1, "A TITLE OF IT\n\nWe saw it, e.g. in Fig. 2. It was ﬁne .. and [1] good.\n\n(?)\n\n2.1 Method\n\nwww.x.org is low- rank."),
    (2, "one line\ntwo lines. Three.\fnext page\nSee No. 5."),
    (3, ""),
]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("ExistingRDD")


def numbered(spark, bounded):
    b = S.text_blocks(spark.createDataFrame(BOOKS, "doc_id long, text string"))
    b = S.sectionize(S.paginate(b, bounded=bounded), F.lit("A title of it"), bounded=bounded)
    null = F.lit(None).cast("string")
    return b.withColumns({"number": null, "alt": null, "caption": null, "rows": F.lit(None).cast("array<array<string>>")})


def test_speech_folds_its_text_once(spark):
    said = T.for_speech(F.col("x"))._jc.toString()
    assert said.count(T.fold_tables()[0]) == 1


def test_units_of_rows(spark):
    titles = spark.createDataFrame([(i, "A title of it") for i, _ in BOOKS], "doc_id long, title string")
    plain, whole = ([df.orderBy("doc_id", "ord").collect() for df in D.units_and_visuals(numbered(spark, b), titles, bounded=b)] for b in (False, True))
    assert plain == whole and len(whole[0]) > 8
    # the blocks and the titles, once each, and the title units
    shuffled, stored = exchanges(D.units_and_visuals(numbered(spark, True), titles, bounded=True)[0])
    assert shuffled <= 2 and stored <= 3


def test_lines_of_rows_are_shuffled_once(spark):
    text = "# Head\n\none *it* &amp; two\n- item\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nUnder\n=====\n```\ncode\n```\n"
    d = spark.createDataFrame([(1, text), (2, "> quoted\nplain\n")], "doc_id long, text string")
    b = D.markdown_blocks(d)
    assert exchanges(b) == (1, 1)
    got = [(r.doc_id, r.kind, r.text) for r in b.orderBy("doc_id", "ord").collect()]
    assert got == [(1, "heading", "Head"), (1, "paragraph", "one it & two"), (1, "item", "item"), (1, "table", ""), (1, "heading", "Under"), (1, "code", "code"), (2, "paragraph", "quoted plain")]


def test_captions_of_rows(spark):
    rows = [(1, i, k, t, "") for i, (k, t) in enumerate([("image", ""), ("paragraph", "Figure 1: a"), ("table", ""), ("paragraph", "Table 2: b"), ("table", ""), ("image", "")])]
    b = spark.createDataFrame(rows, "doc_id long, ord int, kind string, text string, caption string")
    plain, whole = (S.attach_captions(b, bounded=x) for x in (False, True))
    assert plain.orderBy("ord").collect() == whole.orderBy("ord").collect()
    assert exchanges(whole) == (1, 1)
