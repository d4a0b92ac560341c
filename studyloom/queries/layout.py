"""OCR blocks (O1–O8) and page lines (L1–L14) derived from `lineitem`: an order is a page, a line item a block or line."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import layout as L
from studyloom.operators import ocr as O
from studyloom.plans import views
from studyloom.queries.registry import Registry

R = Registry()

_BLOCK = r"""l_orderkey div 50 AS doc_id, l_orderkey % 50 AS page, CAST(l_linenumber * 10000000000 + l_partkey * 100 + l_quantity AS BIGINT) AS ord,
  CASE l_partkey % 8 WHEN 0 THEN 'header' WHEN 1 THEN 'title' WHEN 2 THEN 'text' WHEN 3 THEN 'equation' WHEN 4 THEN 'image' WHEN 6 THEN 'table' ELSE 'caption' END AS kind,
  CASE l_partkey % 8 WHEN 1 THEN concat('Title ', l_suppkey) WHEN 2 THEN CASE l_suppkey % 4 WHEN 0 THEN 'Abstract of it' WHEN 1 THEN 'we compute ' WHEN 2 THEN 'We end.' ELSE 'and so on' END
    WHEN 3 THEN concat('$$a_{', l_suppkey % 9, '} = b \\tag{3}$$') WHEN 5 THEN concat('Figure ', l_suppkey % 5, ': x') WHEN 7 THEN CASE WHEN l_suppkey % 2 = 0 THEN concat('Table ', l_suppkey % 5, ': y') ELSE '(a) panel' END
    ELSE '' END AS content,
  l_quantity * 10 AS x0, l_linenumber * 60.0 + l_partkey % 13 AS y0, l_quantity * 10 + 100 + round(l_discount * 1000) AS x1, l_linenumber * 60.0 + l_partkey % 13 + 20 + round(l_tax * 500) AS y1"""
_BLOCK_DUCK = _BLOCK.replace("l_orderkey div 50", "l_orderkey // 50").replace("\\\\tag", "\\tag").replace("* 60.0", "* 60.0::DOUBLE")

BLOCKS = f"blocks AS (SELECT {_BLOCK_DUCK} FROM lineitem)"


def blocks(spark, sf):
    return views.table(spark, sf, "lineitem").selectExpr(*_split(_BLOCK)).withColumn("slack", F.lit(4.0))


def _split(cols: str) -> list[str]:
    """Top-level commas only."""
    out, depth, cur, quoted = [], 0, "", False
    for ch in cols:
        quoted = quoted != (ch == "'")
        depth += (ch == "(") - (ch == ")") if not quoted else 0
        if ch == "," and depth == 0 and not quoted:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def sizes(spark, sf):
    b = views.table(spark, sf, "lineitem").selectExpr("l_orderkey div 50 AS doc_id", "l_orderkey % 50 AS page").distinct()
    return b.withColumns({"px_w": F.lit(1224.0), "px_h": F.lit(1584.0), "pt_w": F.lit(612.0), "pt_h": F.lit(792.0)})


@R.add("ocr_running_text", f"""WITH {BLOCKS}, f AS (SELECT doc_id, min(page) AS p FROM blocks GROUP BY ALL),
k AS (SELECT b.*, b.page = f.p AS first FROM blocks b JOIN f ON f.doc_id = b.doc_id WHERE kind <> 'header'),
m AS (SELECT doc_id, min(ord) FILTER (first AND kind IN ('title', 'text') AND content LIKE 'Abstract%') AS a, min(ord) FILTER (first AND kind = 'title') AS t FROM k GROUP BY ALL)
SELECT k.doc_id, k.page, k.ord, k.kind FROM k JOIN m ON m.doc_id = k.doc_id WHERE NOT (first AND a IS NOT NULL AND ord < a AND (t IS NULL OR ord <> t))""")
def ocr_running_text(spark, sf):
    """O1."""
    return O.running_text(blocks(spark, sf)).select("doc_id", "page", "ord", "kind")


@R.add("page_turns_joined", f"""WITH RECURSIVE {BLOCKS}, b AS (SELECT * FROM blocks WHERE kind <> 'header'),
per AS (SELECT doc_id, page, arg_max(ord, ord) AS lo, arg_max(kind, ord) AS lk, arg_max(content, ord) AS lc, arg_min(ord, ord) FILTER (kind IN ('text', 'title', 'equation')) AS fo,
  arg_min(kind, ord) FILTER (kind IN ('text', 'title', 'equation')) AS fk, arg_min(content, ord) FILTER (kind IN ('text', 'title', 'equation')) AS fc, count(*) AS n FROM b GROUP BY ALL),
walk AS (
  SELECT doc_id, page, lo, lk, lc, fo, n, FALSE AS joined, CAST(NULL AS BIGINT) AS to_ord FROM per p WHERE NOT EXISTS (SELECT 1 FROM per q WHERE q.doc_id = p.doc_id AND q.page = p.page - 1)
  UNION ALL
  SELECT p.doc_id, p.page, p.lo, p.lk, p.lc, p.fo, p.n, coalesce(w.lk = 'text' AND NOT regexp_matches(rtrim(w.lc), '[.!?:;]$') AND p.fk = 'text' AND regexp_matches(ltrim(p.fc), '^\\p{{Ll}}')
    AND NOT (w.joined AND w.n = 1), FALSE), w.lo FROM walk w JOIN per p ON p.doc_id = w.doc_id AND p.page = w.page + 1),
moved AS (SELECT doc_id, page, fo AS ord, to_ord FROM walk WHERE joined)
SELECT b.doc_id, b.page, b.ord, CASE WHEN t.ord IS NULL THEN b.content ELSE rtrim(b.content) || ' ' || ltrim(tb.content) END AS content FROM b
LEFT JOIN moved t ON t.doc_id = b.doc_id AND t.page = b.page + 1 AND t.to_ord = b.ord LEFT JOIN b tb ON tb.doc_id = t.doc_id AND tb.page = t.page AND tb.ord = t.ord
WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.doc_id = b.doc_id AND m.page = b.page AND m.ord = b.ord)""")
def page_turns_joined(spark, sf):
    """O2."""
    return O.join_page_turns(blocks(spark, sf).filter("kind <> 'header'")).select("doc_id", "page", "ord", "content")


_VIS = """SELECT doc_id, page, 'E' || ord AS visual_id, x0 / 2 + 5 AS x, y0 / 2 - 3 AS y, (x1 - x0) / 2 AS w, (y1 - y0) / 2 + 20 AS h FROM blocks WHERE kind = 'text'"""


@R.add("equations_refined", f"""WITH {BLOCKS}, v AS ({_VIS}), e AS (SELECT doc_id, page, ord, content, x0 / 2 AS x0, y0 / 2 AS y0, x1 / 2 AS x1, y1 / 2 AS y1 FROM blocks WHERE kind = 'equation'),
h AS (SELECT v.doc_id, v.page, v.visual_id, e.ord, e.content, e.x0, e.y0, e.x1, e.y1, greatest(0, least(x + w, e.x1) - greatest(x, e.x0)) * greatest(0, least(y + h, e.y1) - greatest(y, e.y0)) AS i,
  least(w * h, (e.x1 - e.x0) * (e.y1 - e.y0)) AS a FROM v JOIN e ON e.doc_id = v.doc_id AND e.page = v.page),
g AS (SELECT doc_id, page, visual_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM h WHERE i > 0 AND i >= 0.3 * a GROUP BY ALL),
t AS (SELECT doc_id, page, visual_id, string_agg(trim(replace(replace(content, '$$', ''), '\\tag{{3}}', '')), chr(10) ORDER BY ord) AS latex FROM (
  SELECT doc_id, page, visual_id, content, min(ord) AS ord FROM h WHERE i > 0 AND i >= 0.3 * a GROUP BY ALL) GROUP BY ALL),
r AS (SELECT v.*, g.x0, greatest(0, greatest(x - 40, least(x, g.x0))) AS nx0, greatest(0, greatest(y - 40, least(y, g.y0))) AS ny0, least(612, least(x + w + 40, greatest(x + w, g.x1))) AS nx1,
  least(792, least(y + h + 40, greatest(y + h, g.y1))) AS ny1, t.latex FROM v LEFT JOIN g ON g.doc_id = v.doc_id AND g.page = v.page AND g.visual_id = v.visual_id LEFT JOIN t ON t.doc_id = v.doc_id AND t.page = v.page AND t.visual_id = v.visual_id)
SELECT doc_id, page, visual_id, round(CASE WHEN x0 IS NULL THEN x ELSE nx0 END, 4) AS x, round(CASE WHEN x0 IS NULL THEN y ELSE ny0 END, 4) AS y, round(CASE WHEN x0 IS NULL THEN w ELSE nx1 - nx0 END, 4) AS w,
  round(CASE WHEN x0 IS NULL THEN h ELSE ny1 - ny0 END, 4) AS h, latex FROM r""")
def equations_refined(spark, sf):
    """O3: text blocks play the equations found in the page, equation blocks what OCR saw."""
    b = blocks(spark, sf)
    v = b.filter("kind = 'text'").selectExpr("doc_id", "page", "concat('E', ord) AS visual_id", "x0 / 2 + 5 AS x", "y0 / 2 - 3 AS y", "(x1 - x0) / 2 AS w", "(y1 - y0) / 2 + 20 AS h")
    r = O.refine_equations(v, b, sizes(spark, sf))
    return r.select("doc_id", "page", "visual_id", *[F.round(c, 4).alias(c) for c in "xywh"], "latex")


GROUPS = f"""{BLOCKS},
caps AS (SELECT *, CASE WHEN content LIKE 'Figure%' THEN 'Fig' ELSE 'Tab' END || regexp_extract(content, '\\d') AS id, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, ord) AS n FROM blocks WHERE kind = 'caption' AND content LIKE '%:%'),
above AS (SELECT *, coalesce(max(y1) OVER (PARTITION BY doc_id, page ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM caps),
img AS (SELECT c.doc_id, c.page, c.id, c.ord AS caption_ord, c.y0 AS cy, b.ord, b.y0 FROM above c JOIN blocks b ON b.doc_id = c.doc_id AND b.page = c.page AND b.kind = 'image' AND (b.y0 + b.y1) / 2 >= c.above AND (b.y0 + b.y1) / 2 <= c.y0 + 4
  WHERE c.id LIKE 'Fig%' QUALIFY row_number() OVER (PARTITION BY b.doc_id, b.page, b.ord ORDER BY c.n) = 1),
tops AS (SELECT doc_id, page, id, caption_ord, cy, min(y0) AS top FROM img GROUP BY ALL),
subs AS (SELECT t.doc_id, t.page, t.id, t.caption_ord, b.ord FROM tops t JOIN blocks b ON b.doc_id = t.doc_id AND b.page = t.page AND b.kind = 'caption' AND b.content LIKE '(a)%' AND b.y0 >= t.top - 40 AND b.y1 <= t.cy + 4),
tcap AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, y1, ord) AS tn FROM caps WHERE id LIKE 'Tab%'),
claims AS (
  SELECT doc_id, page, id, ord AS caption_ord, tn, (SELECT b.ord FROM blocks b WHERE b.doc_id = c.doc_id AND b.page = c.page AND b.kind = 'table' ORDER BY least(abs(b.y0 - c.y1), abs(c.y0 - b.y1)), b.ord LIMIT 1) AS ord,
    [(SELECT b.ord FROM blocks b WHERE b.doc_id = c.doc_id AND b.page = c.page AND b.kind = 'table' ORDER BY least(abs(b.y0 - c.y1), abs(c.y0 - b.y1)), b.ord LIMIT 1)] AS used FROM tcap c WHERE tn = 1
  UNION ALL
  SELECT doc_id, page, id, caption_ord, tn, o, list_append(used, o) FROM (
    SELECT c.doc_id, c.page, c.id, c.ord AS caption_ord, c.tn, w.used, (SELECT b.ord FROM blocks b WHERE b.doc_id = c.doc_id AND b.page = c.page AND b.kind = 'table' AND NOT list_contains(w.used, b.ord)
      ORDER BY least(abs(b.y0 - c.y1), abs(c.y0 - b.y1)), b.ord LIMIT 1) AS o FROM claims w JOIN tcap c ON c.doc_id = w.doc_id AND c.page = w.page AND c.tn = w.tn + 1)),
groups AS (SELECT doc_id, page, id AS visual_id, caption_ord, ord FROM img UNION ALL SELECT * FROM subs UNION ALL SELECT doc_id, page, id, caption_ord, ord FROM claims WHERE ord IS NOT NULL)"""


@R.add("figure_groups", f"WITH RECURSIVE {GROUPS} SELECT * FROM groups")
def figure_groups(spark, sf):
    """Blocks of each numbered figure and table."""
    return O.figure_groups(blocks(spark, sf))


REGIONS = GROUPS + """,
mem AS (SELECT DISTINCT doc_id, page, visual_id, caption_ord, ord FROM (SELECT * FROM groups UNION ALL SELECT doc_id, page, visual_id, caption_ord, caption_ord FROM groups)),
ext AS (SELECT m.doc_id, m.page, m.visual_id, m.caption_ord, min(x0) / 2 - 4 AS x0, min(y0) / 2 - 4 AS y0, max(x1) / 2 + 4 AS x1, max(y1) / 2 + 4 AS y1 FROM mem m JOIN blocks b ON b.doc_id = m.doc_id AND b.page = m.page AND b.ord = m.ord GROUP BY ALL),
regions AS (SELECT doc_id, page, visual_id, caption_ord, greatest(0, x0) AS x, greatest(0, y0) AS y, least(612, x1) - greatest(0, x0) AS w, least(792, y1) - greatest(0, y0) AS h FROM ext)"""


@R.add("figure_regions", f"WITH RECURSIVE {REGIONS} SELECT doc_id, page, visual_id, caption_ord, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w, round(h, 4) AS h FROM regions")
def figure_regions(spark, sf):
    """Areas of the groups on their pages."""
    b = blocks(spark, sf)
    r = O.regions(O.figure_groups(b), b, sizes(spark, sf))
    return r.select("doc_id", "page", "visual_id", "caption_ord", *[F.round(c, 4).alias(c) for c in "xywh"])


@R.add("document_figures", f"""WITH RECURSIVE {REGIONS} SELECT r.doc_id, r.visual_id, r.page, round(x, 4) AS x, round(y, 4) AS y FROM regions r JOIN blocks b ON b.doc_id = r.doc_id AND b.page = r.page AND b.ord = r.caption_ord
QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.visual_id ORDER BY r.page, b.y0, r.caption_ord) = 1""")
def document_figures(spark, sf):
    """One region per figure of a document."""
    b = blocks(spark, sf)
    f = O.figures(O.regions(O.figure_groups(b), b, sizes(spark, sf)), b)
    return f.select("doc_id", "visual_id", "page", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_PIECES = r"""concat('$$a_{', doc_id, '} = b \\tag{3}$$ and \\[c^', doc_id % 7, '\\] or \\(d\\) with $x', doc_id % 10, '$ ', replace(text, '$', ''))"""


@R.add("ocr_formulas", """SELECT doc_id, concat('a_{', doc_id, '} = b|c^', doc_id % 7, '|d|x', doc_id % 10) AS pieces FROM documents""")
def ocr_formulas(spark, sf):
    """Formulas of OCR markdown."""
    return views.texts(spark, sf, "documents").select("doc_id", F.array_join(O.math_pieces(F.expr(_PIECES)), "|").alias("pieces"))


@R.add("character_similarity", r"""WITH t AS (SELECT doc_id, regexp_replace(lower(substring(text, 1, 40)), '[^\p{L}\p{Nd}]', '', 'g') AS a, regexp_replace(lower(substring(text, 21, 60)), '[^\p{L}\p{Nd}]', '', 'g') AS b FROM documents),
ca AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(a, '')) AS c FROM t) WHERE c <> '' GROUP BY ALL), cb AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(b, '')) AS c FROM t) WHERE c <> '' GROUP BY ALL),
m AS (SELECT ca.doc_id, sum(least(ca.n, cb.n)) AS s FROM ca JOIN cb ON cb.doc_id = ca.doc_id AND cb.c = ca.c GROUP BY ALL)
SELECT t.doc_id, round(CASE WHEN a = '' OR b = '' THEN 0 ELSE coalesce(s, 0)::DOUBLE / greatest(length(a), length(b)) END, 6) AS similarity FROM t LEFT JOIN m ON m.doc_id = t.doc_id""")
def character_similarity(spark, sf):
    """Characters two stretches of each document have in common."""
    d = views.texts(spark, sf, "documents")
    return d.select("doc_id", F.round(O.char_similarity(F.substring("text", 1, 40), F.substring("text", 21, 60)), 6).alias("similarity"))


@R.add("best_formulas", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'abc123' WHEN 1 THEN 'xyz|xyzw' ELSE 'q' END AS best FROM documents""")
def best_formulas(spark, sf):
    """The formulas that match a visual's text best; each document is one visual."""
    d = views.texts(spark, sf, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, "a b c = 1 2 3").when(F.col("doc_id") % 3 == 1, "xyz w").otherwise("nothing")
    some = F.array(F.lit("abc123"), F.lit("xyz"), F.lit(r"\alpha"), F.lit("xyzw"))
    pieces = F.when(F.col("doc_id") % 3 == 2, F.array(F.lit("q"))).otherwise(some)
    return d.select("doc_id", F.array_join(O.best_pieces(raw, pieces), "|").alias("best"))


# ---- page lines

_TEXTS = (
    "Running head 12", "2.1 Method of Parts", "x = y + 1 (3)", "Abstract", "References", "a + b = c", "12 0.5 77 ab", "The model was trained on data.", "and then we conti-", "nued with more words here",
    "Appendix A", "(a)", "y = z (A.4)",
)
_MATH = (0, 0, 4, 0, 0, 5, 0, 0, 0, 0, 0, 0, 3)
_LINE = f"""l_suppkey % 20 AS doc_id, l_orderkey {{div}} 50 AS page, l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS line_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'left' ELSE 'right' END AS region,
  CAST(60 + (l_partkey % 5) * 12 + CASE WHEN l_linenumber % 3 = 2 THEN 260 ELSE 0 END AS DOUBLE) AS left,
  CAST(210 + (l_partkey % 5) * 12 + CASE WHEN l_linenumber % 3 = 2 THEN 260 ELSE 0 END + (l_quantity % 7) * 10 AS DOUBLE) AS right,
  CAST(740 - (l_partkey * 7 + l_linenumber * 13) % 720 AS DOUBLE) AS baseline,
  CASE WHEN l_quantity = 50 THEN 14.0 ELSE 9 + (l_quantity % 4) * 0.5 END AS size"""


def lines(spark, sf):
    """lines(…) of L1–L14, one per line item."""
    d = views.table(spark, sf, "lineitem").selectExpr(*_split(_LINE.replace("{div}", "div")), "l_partkey", "l_quantity").withColumn("size", F.col("size").cast("double"))
    running = F.col("baseline") > 690  # most pages have a running head
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("l_partkey") % len(xs) + 1).cast("int"))
    d = d.withColumn("text", F.when(running, _TEXTS[0]).otherwise(pick(_TEXTS))).withColumn("n_math", F.when(running, 0).otherwise(pick(_MATH))).withColumn("n_glyphs", F.length(F.replace("text", F.lit(" "), F.lit(""))))
    return d.select(
        "doc_id", "page", "line_id", "region", "left", "right", (F.col("baseline") - F.col("size") * 0.25).alias("bottom"), (F.col("baseline") + F.col("size") * 0.75).alias("top"), "baseline", "size", "text",
        "n_glyphs", "n_math", F.when(F.col("l_quantity") % 3 == 0, F.col("n_glyphs")).otherwise(0).alias("n_bold"), F.concat(F.lit("F"), (F.col("l_quantity").cast("int") % 30).cast("string")).alias("font_family"),
    )


_Q = ", ".join(f"'{t}'" for t in _TEXTS)
PAGE_LINES = f"""l0 AS (SELECT {_LINE.replace("{div}", "//").replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"').replace("14.0 ELSE 9 + (l_quantity % 4) * 0.5", "14.0::DOUBLE ELSE 9 + (l_quantity % 4) * 0.5::DOUBLE")},
  740 - (l_partkey * 7 + l_linenumber * 13) % 720 > 690 AS hd, CASE WHEN hd THEN '{_TEXTS[0]}' ELSE [{_Q}][l_partkey % {len(_TEXTS)} + 1] END AS text, CASE WHEN hd THEN 0 ELSE [{", ".join(map(str, _MATH))}][l_partkey % {len(_TEXTS)} + 1] END AS n_math, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
lines AS (SELECT *, baseline - size * 0.25::DOUBLE AS bottom, baseline + size * 0.75::DOUBLE AS top, length(replace(text, ' ', '')) AS n_glyphs, CASE WHEN q % 3 = 0 THEN length(replace(text, ' ', '')) ELSE 0 END AS n_bold, 'F' || (q % 30) AS font_family FROM l0)"""

BODY = """bodies AS (SELECT doc_id, -arg_max(-h, (n, -h)) AS body FROM (SELECT doc_id, round_even(size * 2, 0) / 2 AS h, sum(n_glyphs - n_math) AS n FROM lines GROUP BY ALL) WHERE n > 0 GROUP BY doc_id)"""


@R.add("body_sizes", f"WITH {PAGE_LINES}, {BODY} SELECT doc_id, body FROM bodies")
def body_sizes(spark, sf):
    """L1."""
    return L.body_size(lines(spark, sf))


SHARES = """fam AS (SELECT doc_id, font_family, sum(n_glyphs) AS n FROM lines GROUP BY ALL),
shares AS (SELECT doc_id, font_family, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) AS share FROM fam)"""


@R.add("font_shares", f"WITH {PAGE_LINES}, {SHARES} SELECT doc_id, font_family, round(share, 6) AS share FROM shares")
def font_shares(spark, sf):
    """L2."""
    return L.font_share(lines(spark, sf)).withColumn("share", F.round("share", 6))


_MKEY = "CASE WHEN top > 792 - 0.09::DOUBLE * 792 OR bottom < 0.08::DOUBLE * 792 THEN regexp_replace(lower(text), '[\\d\\s]+', '', 'g') END"
MARGINS = f"""np AS (SELECT doc_id, count(DISTINCT page) AS pages FROM lines GROUP BY ALL),
mk AS (SELECT doc_id, {_MKEY} AS mkey, count(DISTINCT page) AS c FROM lines GROUP BY ALL),
margins AS (SELECT mk.doc_id, mkey FROM mk JOIN np ON np.doc_id = mk.doc_id WHERE mkey IS NOT NULL AND c >= greatest(2, pages // 3))"""


@R.add("running_margins", f"WITH {PAGE_LINES}, {MARGINS} SELECT doc_id, mkey AS key FROM margins")
def running_margins(spark, sf):
    """L3."""
    return L.running_margins(lines(spark, sf))


@R.add("column_gutters", """WITH w AS (SELECT l_suppkey AS page, CASE WHEN l_partkey % 2 = 0 THEN 50 + l_quantity * 3 ELSE 340 + l_quantity * 3 END AS lo, CASE WHEN l_partkey % 2 = 0 THEN 50 + l_quantity * 3 ELSE 340 + l_quantity * 3 END + 20 + l_linenumber * 3
  + CASE WHEN l_partkey % 301 = 0 THEN 150 ELSE 0 END AS hi FROM lineitem WHERE l_quantity % 2 = 1),
n AS (SELECT page, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 60),
x AS (SELECT i, 612 * 0.3::DOUBLE + i AS x FROM (SELECT unnest(range(245)) AS i)),
c AS (SELECT n.page, n.n, x.i, x.x, count(w.lo) AS c FROM n CROSS JOIN x LEFT JOIN w ON w.page = n.page AND w.lo < x.x AND w.hi > x.x GROUP BY ALL),
b AS (SELECT *, min(c) OVER (PARTITION BY page) AS best FROM c),
r AS (SELECT page, n, min(i) AS a, max(i) AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY page ORDER BY i) AS g FROM b WHERE c = best AND best <= greatest(2, n // 50)) GROUP BY page, n, g),
g AS (SELECT page, n, (612 * 0.3::DOUBLE + a + CASE WHEN z = 244 THEN 612 * 0.7::DOUBLE ELSE 612 * 0.3::DOUBLE + z END) / 2 AS gutter FROM r
  QUALIFY row_number() OVER (PARTITION BY page ORDER BY round(CASE WHEN z = 244 THEN 612 * 0.7::DOUBLE ELSE 612 * 0.3::DOUBLE + z END - 612 * 0.3::DOUBLE - a, 6) DESC, a) = 1)
SELECT g.page, round(gutter, 4) AS gutter FROM g JOIN w ON w.page = g.page GROUP BY g.page, gutter, n HAVING count(*) FILTER (hi <= gutter) > 0.2 * n AND count(*) FILTER (lo >= gutter) > 0.2 * n""")
def column_gutters(spark, sf):
    """L4: gutters; a supplier's odd-quantity line items are the words of one page."""
    lo = F.when(F.col("l_partkey") % 2 == 0, 50 + F.col("l_quantity") * 3).otherwise(340 + F.col("l_quantity") * 3)
    wide = F.when(F.col("l_partkey") % 301 == 0, 150).otherwise(0)
    w = views.table(spark, sf, "lineitem").filter("l_quantity % 2 = 1").select(
        (F.col("l_suppkey") % 3).alias("doc_id"), F.col("l_suppkey").alias("page"), lo.alias("left"), (lo + 20 + F.col("l_linenumber") * 3 + wide).alias("right"), F.lit(10.0).alias("size")
    )
    body = w.select("doc_id").distinct().withColumn("body", F.lit(10.0))
    return L.column_gutter(w, body, ["doc_id", "page"]).select("page", F.round("gutter", 4).alias("gutter"))


SEQ = """bands AS (SELECT *, sum(CASE WHEN region = 'full' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY -baseline, CASE WHEN region = 'full' THEN 1 ELSE 0 END, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - CASE WHEN region = 'full' THEN 1 ELSE 0 END AS band FROM lines),
seqs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, CASE WHEN region = 'full' THEN 1 ELSE 0 END, CASE region WHEN 'left' THEN 0 WHEN 'right' THEN 1 ELSE 2 END, -baseline, line_id) - 1 AS seq FROM bands)"""


@R.add("reading_order", f"WITH {PAGE_LINES}, {SEQ} SELECT line_id, doc_id, seq FROM seqs")
def reading_order(spark, sf):
    """L5."""
    return L.reading_order(lines(spark, sf)).select("line_id", "doc_id", "seq")


@R.add("rows_grouped", """WITH w AS (SELECT l_orderkey // 20 AS page, l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS word_id, 40 + l_quantity * 10 AS lo, 60 + l_quantity * 10 AS hi, 700 - (l_partkey % 60) * 11.0::DOUBLE + (l_suppkey % 4) AS baseline,
  CASE WHEN l_linenumber = 7 THEN 6.0 ELSE 10.0 END::DOUBLE AS size FROM lineitem),
m AS (SELECT *, CASE WHEN lag(-baseline) OVER p IS NULL OR -baseline - lag(-baseline) OVER p > 0.3 * 10 THEN 1 ELSE 0 END AS new FROM w WHERE size = 10 WINDOW p AS (PARTITION BY page ORDER BY -baseline, word_id)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY page ORDER BY -baseline, word_id) AS BIGINT) AS "row", CASE WHEN (lo + hi) / 2 < 306 THEN 'left' ELSE 'right' END AS region FROM m),
g AS (SELECT page, "row", region, max(baseline) AS base, min(lo) AS lo, max(hi) AS hi FROM r GROUP BY ALL),
s AS (SELECT w.word_id, w.page, g."row", g.region FROM w JOIN g ON g.page = w.page AND w.baseline - g.base > -5 AND w.baseline - g.base < 7.5 AND w.lo >= g.lo - 15 AND w.hi <= g.hi + 15 WHERE size = 6
  QUALIFY row_number() OVER (PARTITION BY w.word_id ORDER BY abs(w.baseline - g.base - 1), g."row", g.region) = 1)
SELECT word_id, page, "row", region FROM r UNION ALL SELECT word_id, page, "row", region FROM s""")
def rows_grouped(spark, sf):
    """Words to rows; seventh line items are scripts."""
    w = views.table(spark, sf, "lineitem").select(
        (F.floor(F.col("l_orderkey") / 20) % 3).alias("doc_id"), F.floor(F.col("l_orderkey") / 20).alias("page"), F.expr("l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT)").alias("word_id"), (40 + F.col("l_quantity") * 10).alias("left"), (60 + F.col("l_quantity") * 10).alias("right"),
        (700 - (F.col("l_partkey") % 60) * 11.0 + F.col("l_suppkey") % 4).alias("baseline"), F.when(F.col("l_linenumber") == 7, 6.0).otherwise(10.0).alias("size"),
    )
    body = w.select("doc_id").distinct().withColumn("body", F.lit(10.0))
    return L.row_grouping(w, body).select("word_id", "page", "row", "region")


GAPS = """gaps AS (SELECT *, coalesce(lag(bottom) OVER p - top, 99) AS above, coalesce(bottom - lead(top) OVER p, 99) AS below FROM seqs WINDOW p AS (PARTITION BY doc_id, page, region ORDER BY -baseline, line_id)),
edges AS (SELECT doc_id, page, region, list_sort(list("left"))[count(*) // 10 + 1] AS column_left FROM lines GROUP BY ALL)"""


@R.add("line_gaps", f"WITH {PAGE_LINES}, {SEQ}, {GAPS} SELECT g.line_id, g.doc_id, round(above, 4) AS above, round(below, 4) AS below, column_left FROM gaps g JOIN edges e ON e.doc_id = g.doc_id AND e.page = g.page AND e.region = g.region")
def line_gaps(spark, sf):
    """L7."""
    return L.line_gaps(lines(spark, sf)).select("line_id", "doc_id", F.round("above", 4).alias("above"), F.round("below", 4).alias("below"), "column_left")


# facts of the thirteen texts: prose words, words, numeric words, display number, relation, upper share, heading number, level
_FACTS = """[{p: 2, w: 3, num: 1, eqn: FALSE, rel: FALSE, up: 1.0 / 11, nh: FALSE, lv: 1, kh: FALSE, sent: FALSE, cap: TRUE, dec: FALSE, let: 11}, {p: 2, w: 4, num: 1, eqn: FALSE, rel: FALSE, up: 2.0 / 13, nh: TRUE, lv: 2, kh: FALSE, sent: FALSE, cap: TRUE, dec: FALSE, let: 13},
  {p: 0, w: 6, num: 4, eqn: TRUE, rel: TRUE, up: 0.0, nh: FALSE, lv: 1, kh: FALSE, sent: FALSE, cap: FALSE, dec: FALSE, let: 2}, {p: 1, w: 1, num: 0, eqn: FALSE, rel: FALSE, up: 1.0 / 8, nh: FALSE, lv: 1, kh: TRUE, sent: FALSE, cap: TRUE, dec: FALSE, let: 8},
  {p: 1, w: 1, num: 0, eqn: FALSE, rel: FALSE, up: 1.0 / 10, nh: FALSE, lv: 1, kh: TRUE, sent: FALSE, cap: TRUE, dec: FALSE, let: 10}, {p: 0, w: 5, num: 2, eqn: FALSE, rel: TRUE, up: 0.0, nh: FALSE, lv: 1, kh: FALSE, sent: FALSE, cap: FALSE, dec: FALSE, let: 3},
  {p: 0, w: 4, num: 3, eqn: FALSE, rel: FALSE, up: 0.0, nh: FALSE, lv: 1, kh: FALSE, sent: FALSE, cap: TRUE, dec: TRUE, let: 2}, {p: 5, w: 6, num: 0, eqn: FALSE, rel: FALSE, up: 1.0 / 24, nh: FALSE, lv: 1, kh: FALSE, sent: TRUE, cap: TRUE, dec: FALSE, let: 24},
  {p: 2, w: 4, num: 0, eqn: FALSE, rel: FALSE, up: 0.0, nh: FALSE, lv: 1, kh: FALSE, sent: FALSE, cap: FALSE, dec: FALSE, let: 14}, {p: 5, w: 5, num: 0, eqn: FALSE, rel: FALSE, up: 0.0, nh: FALSE, lv: 1, kh: FALSE, sent: FALSE, cap: FALSE, dec: FALSE, let: 21},
  {p: 1, w: 2, num: 0, eqn: FALSE, rel: FALSE, up: 2.0 / 9, nh: FALSE, lv: 1, kh: FALSE, sent: FALSE, cap: TRUE, dec: FALSE, let: 9}, {p: 0, w: 1, num: 0, eqn: FALSE, rel: FALSE, up: 0.0, nh: FALSE, lv: 1, kh: FALSE, sent: FALSE, cap: FALSE, dec: FALSE, let: 1},
  {p: 0, w: 4, num: 1, eqn: TRUE, rel: TRUE, up: 1.0 / 3, nh: FALSE, lv: 1, kh: FALSE, sent: FALSE, cap: FALSE, dec: FALSE, let: 3}]"""
KINDS = f"""{SEQ}, {GAPS}, {BODY}, {SHARES}, {MARGINS},
fx AS (SELECT g.*, b.body, e.column_left, s.share, {_MKEY} AS mkey, m.mkey IS NOT NULL AS rep, {_FACTS}[list_position([{_Q}], text)] AS f FROM gaps g JOIN bodies b ON b.doc_id = g.doc_id
  JOIN edges e ON e.doc_id = g.doc_id AND e.page = g.page AND e.region = g.region JOIN shares s ON s.doc_id = g.doc_id AND s.font_family = g.font_family
  LEFT JOIN margins m ON m.doc_id = g.doc_id AND m.mkey = {_MKEY}),
fy AS (SELECT *, (f.eqn AND n_math >= 2 AND f.p <= 3) OR ("left" > column_left + body * 1.5 AND n_math::DOUBLE / n_glyphs >= 0.4 AND f.p <= 2) OR ("left" > column_left + body * 1.5 AND f.rel AND n_math >= 2 AND f.p = 0 AND n_glyphs <= 60) AS disp,
  n_bold >= 0.85 * n_glyphs AS bold, size >= body * 1.12::DOUBLE AS big, above >= body * 0.9::DOUBLE AND below >= body * 0.45::DOUBLE AS alone FROM fx),
fz AS (SELECT *, (f.kh AND ((bold OR big OR (f.up >= 0.75 AND f.let >= 4)) OR alone)) OR ((bold OR big OR (f.up >= 0.75 AND f.let >= 4)) AND NOT f.sent AND NOT f.dec AND f.cap AND (f.nh OR ((bold OR big) AND alone AND "left" <= column_left + body AND f.w >= 2)) AND f.p >= 1) AS head FROM fy),
kinds AS (SELECT *, CASE WHEN mkey IS NOT NULL AND (length(mkey) <= 3 OR rep) THEN 'header/footer' WHEN bottom < 0.22::DOUBLE * 792 AND size < body * 0.93::DOUBLE AND NOT disp THEN 'footnote' WHEN disp THEN CASE WHEN size < body * 0.85::DOUBLE THEN 'figure text' END
  WHEN n_glyphs <= 4 AND f.p = 0 THEN NULL WHEN head THEN NULL WHEN size < body * 0.85::DOUBLE THEN 'small text' WHEN f.w >= 3 AND f.num >= 0.5 * f.w AND f.p <= 2 THEN 'table/figure' WHEN share < 0.015 AND NOT bold AND f.w <= 6 THEN 'figure text' END AS reason FROM fz),
classed AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'drop' WHEN disp THEN 'display' WHEN n_glyphs <= 4 AND f.p = 0 THEN 'fragment' WHEN head THEN 'heading' ELSE 'text' END AS kind FROM kinds)"""


def classified(spark, sf):
    """Classified lines in reading order."""
    return L.classify_lines(lines(spark, sf), ordered=True)


@R.add("lines_classified", f"WITH {PAGE_LINES}, {KINDS} SELECT line_id, doc_id, kind, reason, CAST(CASE WHEN kind = 'heading' THEN f.lv END AS INTEGER) AS level FROM classed")
def lines_classified(spark, sf):
    """L8."""
    return L.classify_lines(lines(spark, sf)).select("line_id", "doc_id", "kind", "reason", "level")


RESCUED = KINDS + """,
mem AS (SELECT *, kind = 'text' AND f.p <= 1 AND n_math >= 0.35 * n_glyphs AS able FROM classed),
lk AS (SELECT *, coalesce((able OR kind = 'display') AND lag(able OR kind = 'display') OVER p AND lag(region) OVER p = region AND abs(lag(baseline) OVER p - baseline) <= body * 1.6::DOUBLE, FALSE) AS linked FROM mem WINDOW p AS (PARTITION BY doc_id, page ORDER BY seq)),
ch AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY seq) AS chain FROM lk),
rescued AS (SELECT * REPLACE (CASE WHEN able AND seq >= min(CASE WHEN kind = 'display' THEN seq END) OVER (PARTITION BY doc_id, page, chain) - 2 THEN 'display' ELSE kind END AS kind) FROM ch)"""


@R.add("display_rescued", f"WITH {PAGE_LINES}, {RESCUED} SELECT line_id, doc_id, kind FROM rescued")
def display_rescued(spark, sf):
    """L9."""
    return L.rescue_display(classified(spark, sf)).select("line_id", "doc_id", "kind")


@R.add("display_groups", f"""WITH {PAGE_LINES}, {RESCUED},
k2 AS (SELECT *, coalesce(kind IN ('display', 'fragment') AND lag(kind IN ('display', 'fragment')) OVER p AND lag(region) OVER p = region AND abs(lag(baseline) OVER p - baseline) < body * 4.2::DOUBLE, FALSE) AS l2 FROM rescued WINDOW p AS (PARTITION BY doc_id, page ORDER BY seq)),
r2 AS (SELECT *, sum(CASE WHEN l2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY seq) AS run FROM k2),
g2 AS (SELECT *, min(CASE WHEN kind = 'display' THEN seq END) OVER (PARTITION BY doc_id, page, run) AS fd, CASE WHEN f.eqn THEN regexp_extract(text, '\\(([^)]*)\\)', 1) END AS num FROM r2 WHERE kind IN ('display', 'fragment'))
SELECT doc_id, page, min(seq) AS first_seq, max(seq) AS last_seq, CASE WHEN count(num) = 1 THEN arg_min(num, seq) WHEN count(num) > 1 THEN arg_min(num, seq) || '–' || arg_max(num, seq) END AS eq_number, string_agg(text, chr(10) ORDER BY seq) AS text FROM g2 WHERE fd IS NOT NULL AND seq >= fd - 1 GROUP BY doc_id, page, run""")
def display_groups(spark, sf):
    """L10."""
    return L.display_groups(L.rescue_display(classified(spark, sf)))


@R.add("line_paragraphs", f"""WITH {PAGE_LINES}, {KINDS},
te AS (SELECT doc_id, page, region, list_sort(list("left"))[count(*) // 10 + 1] AS tl, list_sort(list("right"))[count(*) * 9 // 10 + 1] AS tr FROM classed WHERE kind = 'text' GROUP BY ALL),
d AS (SELECT c.*, tl, tr FROM classed c LEFT JOIN te ON te.doc_id = c.doc_id AND te.page = c.page AND te.region = c.region WHERE kind <> 'drop'),
p AS (SELECT *, lag(kind) OVER w AS pk, lag(region) OVER w AS pr, lag(baseline) OVER w AS pb, lag("right") OVER w AS pright, lag(text) OVER w AS pt, lag(tr) OVER w AS ptr FROM d WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq)),
s AS (SELECT *, kind = 'text' AND (pk IS NULL OR pk <> 'text' OR (pr = region AND pb - baseline > body * 1.9::DOUBLE) OR (regexp_matches(rtrim(pt), '[.:?!]$') AND (pright < coalesce(ptr, pright) - body * 1.5 OR "left" > coalesce(tl, "left") + body * 0.8::DOUBLE))) AS st FROM p),
n AS (SELECT line_id, doc_id, kind, CAST(sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY seq) AS BIGINT) AS paragraph FROM s)
SELECT line_id, doc_id, paragraph FROM n WHERE kind = 'text'""")
def line_paragraphs(spark, sf):
    """L11."""
    return L.paragraphs(classified(spark, sf)).select("line_id", "doc_id", "paragraph")


_WORD = "CASE length(w) % 5 WHEN 1 THEN w || '-' WHEN 2 THEN lower(w) ELSE w END"


@R.add("hyphens_mended", f"""WITH l AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS ord FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)),
t AS (SELECT doc_id, ord, ord // 3 AS line, {_WORD} AS text FROM l),
n AS (SELECT *, lag(text) OVER w AS pt, lag(line) OVER w AS pl FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
j AS (SELECT *, CASE WHEN pl <> line AND length(pt) > 2 THEN CASE WHEN regexp_matches(pt, '\\p{{L}}[-‐]$') AND regexp_matches(text, '^\\p{{Ll}}') AND NOT regexp_matches(pt, '^\\p{{Lu}}') AND NOT contains(text, '-') THEN 'mend'
  WHEN pt LIKE '%-' AND regexp_matches(text, '^\\p{{L}}') THEN 'glue' END END AS how FROM n),
x AS (SELECT *, lead(how) OVER (PARTITION BY doc_id ORDER BY ord) AS nxt, CAST(sum(CASE WHEN how IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS token_ord FROM j)
SELECT doc_id, token_ord, string_agg(CASE WHEN nxt = 'mend' THEN left(text, length(text) - 1) ELSE text END, '' ORDER BY ord) AS token FROM x GROUP BY ALL""")
def hyphens_mended(spark, sf):
    """Words broken at line ends; a line is three words, hyphens come from word lengths."""
    d = views.texts(spark, sf, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("ord", "w"))
    d = d.select("doc_id", "ord", F.floor(F.col("ord") / 3).alias("line"), F.expr(_WORD).alias("text"))
    return L.mend_hyphens(d, ["doc_id"])


@R.add("pdf_titles", f"""WITH {PAGE_LINES}, {KINDS}, c AS (SELECT * FROM classed WHERE page = 0 AND kind <> 'drop' AND top > 396),
m AS (SELECT doc_id, max(size) AS mx FROM c GROUP BY ALL), t AS (SELECT c.doc_id, c.text, c.seq FROM c JOIN m ON m.doc_id = c.doc_id WHERE mx >= body * 1.2::DOUBLE AND size >= mx * 0.92::DOUBLE QUALIFY row_number() OVER (PARTITION BY c.doc_id ORDER BY seq) <= 4),
s AS (SELECT doc_id, string_agg(text, ' ' ORDER BY seq) AS t FROM t GROUP BY ALL)
SELECT d.doc_id, coalesce(s.t, CASE WHEN d.doc_id % 3 = 0 THEN 'Meta ' || d.doc_id END, 'file' || d.doc_id) AS title FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN s ON s.doc_id = d.doc_id""")
def pdf_titles(spark, sf):
    """L13."""
    c, body = classified(spark, sf), L.body_size(lines(spark, sf))
    i = F.col("doc_id").cast("string")
    meta = body.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Meta "), i)).when(F.col("doc_id") % 3 == 1, "Microsoft Word - x").alias("meta_title"), F.concat(F.lit("file"), i).alias("file_name"))
    return L.pdf_title(c, body, meta)


@R.add("front_matter_skipped", f"""WITH {PAGE_LINES}, {KINDS}, a AS (SELECT doc_id, arg_min(page, (page, seq)) AS ap, arg_min(baseline, (page, seq)) AS ab FROM classed WHERE page <= 1 AND lower(text) LIKE 'abstract%' GROUP BY ALL),
d AS (SELECT c.* FROM classed c LEFT JOIN a ON a.doc_id = c.doc_id WHERE NOT coalesce(c.page = ap AND c.baseline > ab + body * 1.5, FALSE)),
e AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN CASE WHEN text = 'References' THEN 1 WHEN text = 'Appendix A' THEN 0 END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS skip FROM d)
SELECT line_id, doc_id, kind FROM e WHERE coalesce(skip, 0) = 0""")
def front_matter_skipped(spark, sf):
    """L14."""
    c = classified(spark, sf).select("doc_id", "page", "seq", "line_id", "kind", "baseline", "body", "_facts")
    return L.front_matter(c).select("line_id", "doc_id", "kind")
