"""Lines are dealt to their pages once, without their texts; what follows reads them there."""

import pytest
from pyspark.sql import functions as F

from studyloom.operators import layout as L
from studyloom.queries import layout as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["lines_classified", "display_rescued"])
def test_lines_are_dealt_once(spark, name):
    d = Q.R.queries[name](spark, SF)._jdf.queryExecution()
    plan = d.executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ExistingRDD" not in plan
    # the columns as they are, before the facts that are worked out of texts
    dealt = d.optimizedPlan().toString().split("RepartitionByExpression")[1].split("\n")[1].split("CASE WHEN")[0]
    assert "line_id#" in dealt and "text#" not in dealt


def test_facts_of_documents(spark):
    """A font of less than 1.5 % is rare, a margin text on a third of the pages repeats; a document without glyphs has body 10."""
    rows = [(1, p, 10 * p + i, 700.0 if i else 780.0, "Head 1" if i == 0 else f"word {p}", "A" if p or i else "B", 9.1) for p in range(9) for i in range(10)]
    rows += [(2, 0, 999, 400.0, "", "C", 12.0)]
    d = spark.createDataFrame(rows, "doc_id int, page int, line_id int, top double, text string, font_family string, size double")
    d = d.withColumns({"bottom": F.col("top") - 9, "n_glyphs": F.length(F.replace("text", F.lit(" "), F.lit(""))), "n_math": F.lit(0)})
    got = {r["doc_id"]: (r["body"], sorted(r["common"]), sorted(r["repeated"])) for r in L.document_facts(d).collect()}
    assert got == {1: (9.0, ["A"], ["head"]), 2: (10.0, [], [])}


def test_paragraphs_read_lines_where_they_are(spark):
    """the edges of a column come from windows of its page: one exchange, no join but that of document facts."""
    plan = Q.R.queries["line_paragraphs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Join") == plan.count("BroadcastHashJoin") == 1


def test_front_matter_over_pages(spark):
    """references go on over pages without headings until an appendix; only lines that their page does not decide are dealt again."""
    heads = {(1, 1, 1): "Abstract", (1, 2, 2): "References", (1, 4, 1): "Appendix A", (1, 6, 0): "References", (1, 6, 2): "B Proofs", (2, 0, 2): "abstract", (2, 1, 0): "Abstract"}
    rows = [(d, p, s, 1000 * d + 10 * p + s, 700.0 - 100 * s, heads.get((d, p, s), "Some words.")) for d in (1, 2, 3) for p in range(8) for s in range(4)]
    d = spark.createDataFrame(rows, "doc_id int, page int, seq int, line_id int, baseline double, text string").withColumn("body", F.lit(10.0))
    bit = lambda name, on: F.when(on, 1 << L.FACTS.index(name)).otherwise(0)
    facts = bit("abstract", F.lower("text") == "abstract") + bit("references", F.col("text") == "References") + bit("appended", F.col("text").isin("Appendix A", "B Proofs"))
    d = d.withColumn("_facts", facts).withColumn("kind", F.when(F.col("text") == "Some words.", "text").otherwise("heading"))
    want, skip = [], {}
    for doc, page, seq, line, _, text in rows:
        if text == "References":
            skip[doc] = True
        elif text in ("Appendix A", "B Proofs"):
            skip[doc] = False
        before = {1: (1, 1), 2: (0, 2)}.get(doc)
        if not skip.get(doc) and not (before and page == before[0] and seq < before[1]):
            want.append(line)
    got = L.front_matter(d.drop("text"))
    assert sorted(r["line_id"] for r in got.collect()) == want
    assert "_facts" in got.columns and "_event" not in got.columns


def test_front_matter_does_not_deal_lines_by_document(spark):
    plan = Q.R.queries["front_matter_skipped"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("Join LeftAnti") == 1 and "LogicalRDD" not in plan


def test_groups_have_their_texts(spark):
    """an equation's lines are returned in reading order, those of other columns and far away are not."""
    rows = [(0, "left", 700.0, "fragment", "a"), (1, "left", 690.0, "fragment", "b (1)"), (2, "left", 680.0, "display", "x = 1 (2)"), (3, "left", 670.0, "display", "y = 2 (3)"), (4, "left", 500.0, "display", "z = 3"), (5, "right", 490.0, "display", "u = 4 (9)"), (6, "right", 480.0, "text", "words")]
    d = spark.createDataFrame(rows[::-1], "seq long, region string, baseline double, kind string, text string").selectExpr("1 AS doc_id", "1 AS page", "*", "10.0D AS body")
    got = {r["first_seq"]: (r["eq_number"], r["text"]) for r in L.display_groups(d).collect()}
    assert got == {1: ("1–3", "b (1)\nx = 1 (2)\ny = 2 (3)"), 4: (None, "z = 3"), 5: ("9", "u = 4 (9)")}
