"""Markdown (B3–B5) and units (B17, B19) over documents written as Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import markdown as M
from studyloom.operators import markdown as D
from studyloom.operators import structure as S
from studyloom.plans import views
from studyloom.queries.registry import Registry
from studyloom.queries.text import BOOK_BLOCKS, books, sentences_cte, sql_speech, sql_tidy
from studyloom.session import stored

R = Registry()

_PLAIN = r"regexp_replace(text, '[^a-zA-Zà-ÿ .,]', ' ')"
_PLAIN_DUCK = _PLAIN.replace("' ')", "' ', 'g')")
_INLINE = rf"""concat('A **bold', doc_id, '** and [link](http://x.y/(z)) `code` ~~old~~ <b>t</b> x<sup>2</sup> &amp; \\* $a_*b*$ *it* [^1] snake_case_word ', {_PLAIN})"""


@R.add("markdown_inline", f"""SELECT doc_id, {sql_tidy("concat('A bold', doc_id, ' and link code old t x^{2} & * $a_*b*$ it snake_case_word ', " + _PLAIN_DUCK + ")")} AS inline FROM documents""")
def markdown_inline(spark, sf):
    """Inline marks removed, formulas kept."""
    return views.texts(spark, sf, "documents").select("doc_id", M.inline_text(F.expr(_INLINE)).alias("inline"))


@R.add("markdown_cells", r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a|b ' || page_id || '|c / d' ELSE 'x|' || page_id END AS cells FROM pages""")
def markdown_cells(spark, sf):
    """Cells of pipe rows."""
    line = F.expr(r"CASE WHEN page_id % 2 = 0 THEN concat('| a | **b ', page_id, '** | c / d |') ELSE concat('x | ', page_id, ' | ') END")
    return views.table(spark, sf, "pages").select("page_id", F.array_join(M.table_cells(line), "|").alias("cells"))


_P1, _P2 = (f"trim(substring({_PLAIN}, {a}, 40))" for a in (1, 41))
_MD = rf"""concat('# Title ', doc_id, '\n\n', {_P1}, ' x\nmore *text*\n> quoted\n\n- one\n  wrapped\n- two ', doc_id, '\n1. three\n> said\n\nUnder\n=====\n\n', '```python\n# not a heading\n\n| a |\n```\n\n```math\na^2\n```\n$$\nb_', doc_id,
  '\n$$\n$$c$$\n\n| H1 | H2 |\n|---|:--|\n| 1 | x\\|y |\n| 2 | z |\nafter ', {_P2}, '\n\n---\n\n![Figure 2: cat](c.png)\n![img-0.jpeg](i.png "T")\n## Sub ##\nlast')"""
_X1, _X2 = (f"trim(substring({_PLAIN_DUCK}, {a}, 40))" for a in (1, 41))
_MD_ROWS = (
    ("heading", "1", "'Title ' || doc_id", "''", "''"), ("paragraph", "NULL", sql_tidy(f"concat({_X1}, ' x more text quoted')"), "''", "''"), ("item", "NULL", "'one wrapped'", "''", "''"), ("item", "NULL", "'two ' || doc_id", "''", "''"),
    ("item", "NULL", "'three'", "''", "''"), ("paragraph", "NULL", "'said'", "''", "''"), ("heading", "1", "'Under'", "''", "''"), ("code", "NULL", "concat('# not a heading', chr(10), chr(10), '| a |')", "''", "''"), ("math", "NULL", "'a^2'", "''", "''"),
    ("math", "NULL", "'b_' || doc_id", "''", "''"), ("math", "NULL", "'c'", "''", "''"), ("table", "NULL", "''", "''", "'H1,H2;1,x|y;2,z'"), ("paragraph", "NULL", sql_tidy(f"concat('after ', {_X2})"), "''", "''"),
    ("image", "NULL", "'Figure 2: cat'", "'Figure 2: cat'", "''"), ("image", "NULL", "''", "'T'", "''"), ("heading", "2", "'Sub'", "''", "''"), ("paragraph", "NULL", "'last'", "''", "''"),
)


def written(spark, sf):
    return views.texts(spark, sf, "documents").select("doc_id", F.expr(_MD).alias("text"))


@R.add("markdown_blocks", "\nUNION ALL ".join(f"SELECT doc_id, {i} AS place, '{k}' AS kind, {l} AS level, {t} AS text, {c} AS caption, {r} AS rows FROM documents" for i, (k, l, t, c, r) in enumerate(_MD_ROWS)).replace("AS rows", 'AS "rows"'))
def markdown_blocks(spark, sf):
    """Blocks of Markdown documents."""
    b = D.markdown_blocks(written(spark, sf))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1  # the handful of blocks of one document
    rows = F.coalesce(F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";"), F.lit(""))
    return b.select("doc_id", place.alias("place"), "kind", "level", "text", F.coalesce("caption", F.lit("")).alias("caption"), rows.alias("rows"))


def _unit_blocks(spark, sf):
    d = books(spark, sf).select("doc_id", F.replace("text", F.lit("$"), F.lit("")).alias("text"))  # no formulas here
    # the blocks of a document come from its one row; they are read again for the titles
    b = S.sectionize(S.paginate(stored(S.text_blocks(d)), bounded=True), F.lit("A title"), bounded=True)
    null = F.lit(None).cast("string")
    return b.withColumns({"number": null, "alt": null, "caption": null, "rows": F.lit(None).cast("array<array<string>>")})


@R.add("document_units", f"""WITH RECURSIVE {BOOK_BLOCKS.replace("FROM documents)", "FROM (SELECT doc_id, replace(text, '$', '') AS text FROM documents))")},
paged AS (SELECT b.*, CAST(CASE WHEN p.doc_id IS NULL THEN coalesce(sum(length(text)) OVER (PARTITION BY b.doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 3000
  ELSE coalesce(sum(CASE WHEN kind = 'break' AND ord > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY b.doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS BIGINT) AS page,
  CAST(sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY b.doc_id ORDER BY ord) AS BIGINT) AS section FROM blocks b LEFT JOIN (SELECT DISTINCT doc_id FROM blocks WHERE kind = 'break') p ON p.doc_id = b.doc_id),
paras2 AS (SELECT doc_id, ord, text FROM paged WHERE kind = 'paragraph'),
{sentences_cte("paras2", "doc_id, ord")},
u0 AS (SELECT doc_id, ord, 0 AS s_ord, 'heading' AS kind, text, TRUE AS paragraph_end FROM paged WHERE kind = 'heading'
  UNION ALL SELECT doc_id, ord, s_ord, 'sentence', sentence, s_ord = max(s_ord) OVER (PARTITION BY doc_id, ord) FROM sentences),
u1 AS (SELECT * FROM u0 WHERE kind = 'heading' OR regexp_matches(text, '[\\p{{L}}\\p{{Nd}}]')),
u2 AS (SELECT u.*, p.page, p.section, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.ord, s_ord) AS n FROM u1 u JOIN paged p ON p.doc_id = u.doc_id AND p.ord = u.ord)
SELECT doc_id, n, CASE kind WHEN 'heading' THEN 'H' ELSE 'S' END || n AS unit_id, kind, page, section, paragraph_end, CASE WHEN kind = 'sentence' THEN {sql_speech("text")} END AS spoken FROM u2
UNION ALL SELECT doc_id, 0, 'T0', 'title', 0, 0, TRUE, NULL FROM (SELECT DISTINCT doc_id FROM blocks)""")
def document_units(spark, sf):
    """B17 on running text: the units of every document, as they are said."""
    b = _unit_blocks(spark, sf)
    units, _ = D.units_and_visuals(b, b.select("doc_id").distinct().withColumn("title", F.lit("A title")), bounded=True)
    return units.select("doc_id", F.col("ord").alias("n"), "unit_id", "kind", "page", "section", "paragraph_end", F.when(F.col("kind") == "sentence", F.col("spoken")).alias("spoken"))


def _mixed(spark, sf):
    """Seven blocks per document of every kind that carries a visual."""
    d = views.texts(spark, sf, "documents").select("doc_id", F.expr(f"trim(substring({_PLAIN}, 1, 30))").alias("w"))
    i = F.col("doc_id").cast("string")
    rows = F.array(F.array(F.lit("Name"), F.lit(""), F.lit("N")), F.array(F.lit("a|b"), F.lit("1"), i))
    blk = lambda k, text="", number=None, alt="", caption="", rows_=None: F.struct(
        F.lit(k).alias("kind"), (text if not isinstance(text, str) else F.lit(text)).alias("text"), F.lit(number).cast("string").alias("number"), F.lit(alt).alias("alt"),
        (caption if not isinstance(caption, str) else F.lit(caption)).alias("caption"), (rows_ if rows_ is not None else F.lit(None).cast("array<array<string>>")).alias("rows"),
    )
    blocks = F.array(
        blk("heading", "2.1 Method"), blk("paragraph", F.concat(F.lit("We set $x_i = 1$ at "), i)), blk("math", "E = mc^2 \\tag{4}"), blk("image", caption=F.concat(F.lit("Figure 3: A cat "), i, F.lit(". It sits."))), blk("image", alt="dog"),
        blk("table", rows_=rows), blk("table", caption="Figure 3: not", rows_=rows), blk("code", "run()", caption="Algorithm 1: Go."), blk("image", caption="Figure 3: again"),
    )
    b = d.select("doc_id", F.posexplode(blocks).alias("ord", "b")).select("doc_id", "ord", "b.*").withColumn("page", F.lit(0).cast("long")).withColumn("section", F.lit(1).cast("long"))
    return b, d.select("doc_id", F.lit("Other").alias("title"))


@R.add("document_visuals", "\nUNION ALL ".join(
    f"SELECT doc_id, {n} AS ord, '{v}' AS visual_id, '{k}' AS kind, {e} AS eq_number, {r} AS raw_text, {t} AS latex FROM documents" for n, v, k, e, r, t in (
        (2, "S2", "inline", "NULL", "'We set $x_i = 1$ at ' || doc_id", "'x_i = 1'"), (3, "E3", "equation", "'4'", "'E = mc^2'", "'E = mc^2'"), (4, "Fig3", "figure", "'3'", "'Figure 3: A cat ' || doc_id || '. It sits.'", "NULL"),
        (6, "Pic1", "figure", "NULL", "'Picture: dog'", "NULL"), (7, "Grid2", "table", "NULL", "concat('| Name |  | N |', chr(10), '|---|---|---|', chr(10), '| a/b | 1 | ', doc_id, ' |')", "NULL"),
        (8, "Grid3", "table", "'3'", "concat('Figure 3: not', chr(10), '| Name |  | N |', chr(10), '|---|---|---|', chr(10), '| a/b | 1 | ', doc_id, ' |')", "NULL"), (9, "E9", "algorithm", "'1'", "'run()'", "NULL"), (10, "Pic4", "figure", "'3'", "'Figure 3: again'", "NULL"),
    )))
def document_visuals(spark, sf):
    """Visuals with their ids, numbers and texts."""
    b, t = _mixed(spark, sf)
    return D.units_and_visuals(b, t, bounded=True)[1].select("doc_id", "ord", "visual_id", "kind", "eq_number", "raw_text", "latex")


@R.add("documents_as_markdown", """SELECT doc_id, concat('# Other', chr(10), chr(10), '### 2.1 Method', chr(10), chr(10), 'We set $x_i = 1$ at ', doc_id, chr(10), chr(10), '$$E = mc^2 \\tag{4}$$', chr(10), chr(10), '[picture: Figure 3: A cat ', doc_id, '. It sits.]', chr(10), chr(10),
  '[picture: Picture]', chr(10), chr(10), '| Name |  | N |', chr(10), '|---|---|---|', chr(10), '| a/b | 1 | ', doc_id, ' |', chr(10), chr(10), 'Figure 3: not', chr(10), chr(10), '| Name |  | N |', chr(10), '|---|---|---|', chr(10), '| a/b | 1 | ', doc_id, ' |', chr(10), chr(10),
  'Algorithm 1: Go.', chr(10), chr(10), '```', chr(10), 'run()', chr(10), '```', chr(10), chr(10), '[picture: Figure 3: again]', chr(10), chr(10)) AS markdown FROM documents""")
def documents_as_markdown(spark, sf):
    """Documents put together as one text."""
    b, t = _mixed(spark, sf)
    return D.to_markdown(b.withColumn("level", F.lit(2)).withColumn("visual_id", F.lit(None).cast("string")), t)
