"""Lines read part by part: numbers, names, options, reasons, citations and Markdown signs."""

import pytest
from pyspark.sql import functions as F

from studyloom.functions import headings as H
from studyloom.functions import replies as Y
from studyloom.functions import text as T
from studyloom.operators import markdown as M
from studyloom.operators import study as P


def read(spark, texts, fn):
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r["v"] for r in d.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_numbers_and_names(spark):
    yes = ["1 A", "1. A", "12.3 B", "1.2.3.4 x", "A Title", "B.1 x", "IV. Words", "XII. y"]
    no = ["1", "1 ", "123 A", "1.2.3.4.5 A", "a b", "IV Words", " 1 A", "1,2 A", "AB x", ""]
    assert read(spark, yes + no, lambda t: H.is_numbered(t, "IVX", 4, letter=True)) == [True] * len(yes) + [False] * len(no)
    assert read(spark, ["A Title", "B.1 x", "1 A"], lambda t: H.is_numbered(t, "IVXLC", 6, letter=False)) == [False, False, True]
    assert read(spark, ["References", "7. REFERENCES", "IV references", "A references", "my references", "77 references", "777 references"], lambda t: H.is_named(t, ["references"])) == [True, True, True, False, False, True, False]
    assert read(spark, ["A. references", "b references"], lambda t: H.is_named(t, ["references"], letter=True)) == [True, True]
    words = ["(3)", "(3a)", "(A.1)", "(B2).", "(2.4b),", "(a)", "3", "(1.2.3)", "()", "(A1.2)", "(3a", None]
    assert read(spark, words, H.equation_number) == ["3", "3a", "A.1", "B2", "2.4b", None, None, None, None, None, None, None]


def test_options_and_reasons(spark):
    options = ["A) one", " > **B.** two words ", "C: x", "F.  y", "G) no", "A)x", "AB) x", "a) x", ""]
    assert [v and tuple(v) for v in read(spark, options, P.option_line)] == [("A", "one"), ("B", "two words"), ("C", "x"), ("F", "y"), None, None, None, None, None]
    reasons = ["WHY A: no.", "why (b) - Because", "- **WHY C**: so", "WHY D) it is", "WHY: x", "WHY G: x", "WHYA. y", "WHY A no"]
    assert [v and tuple(v) for v in read(spark, reasons, P.reason_line)] == [("A", "no."), ("B", "Because"), ("C", "so"), ("D", "it is"), None, None, ("A", "y"), None]
    said = ["I don't know", "Dunno know", "no idea at all", "Pass.", "the passage", "en tiedä!", "skipping", "I have no clue", ""]
    assert read(spark, said, P.gives_up) == [True, True, True, True, False, True, False, True, False]


CITED = {
    "as shown [1, 2–4] here": "as shown here", "see [ 12a ]": "see", "a [x] b": "a [x] b", "in (2019) and (2019a; 2020)": "in and", "by (Smith et al., 2019)": "by",
    "(see Smith 2019b) so": " so", "f (x = 2019) g": "f (x = 2019) g", "(in 2019 we) y": "(in 2019 we) y", "((Li 2020))": "()", "[(2019)]": "[]", "(12019)": "(12019)", "a(b": "a(b", "": "",
    "(" + "w" * 158 + " 2019)": "", "(" + "w" * 165 + " 2019)": "(" + "w" * 165 + " 2019)", "x [1][2]": "x", "[1-]": "[1-]", "(1899)": "(1899)", "(e.g., A 2001)": "",
}


def test_citations(spark):
    assert dict(zip(CITED, read(spark, list(CITED), T.strip_citations), strict=True)) == CITED


@pytest.mark.parametrize(
    ("reader", "lines"),
    [
        (M.heading_line, {"# A": (1, "A"), "   ### B ## ": (3, "B"), "    # no": None, "####### no": None, "#no": None, "# #": (1, "")}),
        (M.item_text, {"- a": "a", "  12) b c": "b c", "• x": "x", "1234. no": None, "-no": None, "-": None, "a. no": None}),
        (M.is_rule, {"---": True, " * * *": True, "_ _": False, "--*": False, "    ---": False, "": False}),
        (M.is_table_rule, {"|--|:--:|": True, "-- | ---": True, "|-|": False, "| a |": False, "---": True, "": False, ":--": True, "::--": False}),
        (M.image_line, {"![a b](x.png)": ("a b", "x.png", ""), ' ![](<y>  "T t") ': ("", "y", "T t"), "![a](x) b": None, "![a](x y)": None, "[a](x)": None, "![a]()": None}),
    ],
)
def test_markdown_lines(spark, reader, lines):
    got = read(spark, list(lines), reader)
    assert {k: tuple(v) if isinstance(v, tuple) else v for k, v in zip(lines, got, strict=True)} == lines


def test_fields_and_ideas(spark):
    fields = {"GOAL: x": ("GOAL", "x"), "> **Same as known:** k1": ("SAME AS KNOWN", "k1"), "## Question 2: Why?": ("QUESTION", "Why?"), "*SHOW*: E1": ("SHOW", "E1"), "no field": ("", ""), "a b c d e f g h i: x": ("", ""), "x1y: z": ("", ""), ": z": ("", "")}
    d = spark.createDataFrame([(k,) for k in fields], "t string")
    got = {r["t"]: (r["k"], r["v"]) for r in d.select("t", Y.field_key(F.col("t")).alias("k"), Y.field_value(F.col("t")).alias("v")).collect()}
    assert got == fields
    ideas = {"IDEA c1: A name": ("c1", "A name"), "**idea 2** - **B**": ("2", "**B**"), "# IDEA x_1 . y": ("x_1", "y"), "IDEAS c1: n": None, "IDEA : n": None, "IDEA c3": ("c3", "")}
    assert {k: v and tuple(v) for k, v in zip(ideas, read(spark, list(ideas), Y.idea_line), strict=True)} == ideas


def test_repeated_ids_of_a_plan(spark):
    rows = [(1, i, b) for i, b in enumerate(["c1", "c1b", "c1", "x", "c1", "c1b"])] + [(2, 0, "c1")]
    d = spark.createDataFrame(rows, "paper_id long, _idea long, _base string")
    got = {(r["paper_id"], r["_idea"]): r["idea_id"] for r in P._given_ids(d).collect()}
    assert [got[1, i] for i in range(6)] == ["c1", "c1b", "c1bb", "x", "c1bbb", "c1bb" + "bb"] and got[2, 0] == "c1"
