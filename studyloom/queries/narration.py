"""Narration segments (N2–N21) over the segments derived from `events`, and units of `documents`."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from studyloom.operators import narration as A
from studyloom.operators import structure as S
from studyloom.plans import views
from studyloom.queries import sqlviews as Q
from studyloom.queries.registry import Registry
from studyloom.queries.text import LINES, lines
from studyloom.session import cut_lineage

R = Registry()


def numbered(spark, sf):
    """Visuals of each paper: E1 is numbered 1–3, the others by their own number, E0 is inline."""
    e = views.events(spark, sf)
    n = (F.col("k") % 5).cast("string")
    return e.select(F.col("user_id").alias("paper_id"), (F.col("k") % 5).alias("ord"), F.concat(F.lit("E"), n).alias("visual_id"),
                    F.when(F.col("k") % 5 == 1, "1–3").when(F.col("k") % 5 != 0, n).alias("eq_number")).distinct()


NUMBERED = """numbers AS (SELECT DISTINCT paper_id, CASE WHEN number = 2 OR number = 3 THEN 'E1' ELSE 'E' || number END AS visual_id, number FROM (
  SELECT user_id AS paper_id, unnest(CASE k % 5 WHEN 1 THEN [1, 2, 3] WHEN 0 THEN [] ELSE [k % 5] END) AS number, user_id, k FROM ev)
  WHERE number NOT IN (2, 3) OR EXISTS (SELECT 1 FROM ev e2 WHERE e2.user_id = paper_id AND e2.k % 5 = 1))"""

SHOWN = """cnt AS (SELECT *, coalesce(own_visual, ref_visual) AS shown,
  sum(CASE WHEN own_visual IS NULL AND ref_visual IS NULL AND kind = 'sentence' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY idx) AS c FROM segments),
ev2 AS (SELECT *, CASE WHEN (shown IS NOT NULL AND shown <> 'E0') OR kind = 'heading' THEN idx END AS mark FROM cnt),
prev AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM ev2),
shown AS (SELECT p.paper_id, p.idx, p.kind, p.section, p.page, p.say, p.k,
  coalesce(p.shown, CASE WHEN p.kind = 'sentence' AND a.shown <> 'E0' AND a.section = p.section AND p.c - a.c <= 3 THEN a.shown END) AS show,
  CASE WHEN p.own_visual IS NOT NULL THEN 'own' WHEN p.ref_visual IS NOT NULL THEN 'reference'
    WHEN p.kind = 'sentence' AND a.shown <> 'E0' AND a.section = p.section AND p.c - a.c <= 3 THEN 'recent' ELSE 'own' END AS reason
  FROM prev p LEFT JOIN prev a ON a.paper_id = p.paper_id AND a.idx = p.at)"""


def shown(spark, sf):
    s = views.segments(spark, sf)
    return A.assign_visuals(s, views.is_inline(F.coalesce("own_visual", "ref_visual")))


@R.add("segment_pauses", f"""WITH {Q.SEGMENTS}, u AS (SELECT *, idx // 2 AS unit, lead(idx // 2) OVER (PARTITION BY paper_id ORDER BY idx) AS nxt,
  CASE WHEN kind = 'heading' AND k % 9 = 0 THEN 'title' WHEN kind = 'sentence' AND k % 4 = 1 THEN 'equation' ELSE kind END AS kd FROM segments)
SELECT paper_id, idx, CASE WHEN kd = 'title' THEN 900 WHEN kd = 'heading' THEN 700 WHEN kd = 'equation' AND (nxt IS NULL OR nxt <> unit) THEN 900
  WHEN (nxt IS NULL OR nxt <> unit) AND k % 3 = 0 THEN 450 ELSE 120 END AS pause_ms FROM u""")
def segment_pauses(spark, sf):
    """Silence after each clip; two clips per unit."""
    s = views.segments(spark, sf)
    kind = F.when((F.col("kind") == "heading") & (F.col("k") % 9 == 0), "title").when((F.col("kind") == "sentence") & (F.col("k") % 4 == 1), "equation").otherwise(F.col("kind"))
    s = s.withColumn("kind", kind).withColumn("unit_id", F.floor(F.col("idx") / 2)).withColumn("paragraph_end", F.col("k") % 3 == 0)
    return A.with_pauses(s).select("paper_id", "idx", "pause_ms")


@R.add("number_expansion", """WITH v AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, 'E' || l_partkey AS visual_id, CAST(l_quantity AS INTEGER) AS q FROM lineitem WHERE l_returnflag <> 'N'),
x AS (SELECT doc_id, l_linenumber, visual_id, unnest(CASE q % 4 WHEN 0 THEN list_transform(range(q, q + 3), lambda n: CAST(n AS VARCHAR)) WHEN 1 THEN [CAST(q AS VARCHAR), CAST(q + 20 AS VARCHAR)]
  WHEN 2 THEN ['A.' || q, 'A.' || (q + 1)] ELSE [CAST(q AS VARCHAR)] END) AS number FROM v)
SELECT doc_id, number, arg_min(visual_id, (l_linenumber, visual_id)) AS visual_id FROM x GROUP BY ALL""")
def number_expansion(spark, sf):
    """Equation numbers, with ranges, to visuals; one line item is one visual."""
    q = F.col("l_quantity").cast("int")
    s = lambda c: c.cast("string")
    n = (
        F.when(q % 4 == 0, F.concat(s(q), F.lit("–"), s(q + 2))).when(q % 4 == 1, F.concat(s(q), F.lit("–"), s(q + 20)))
        .when(q % 4 == 2, F.concat(F.lit("A."), s(q), F.lit("–A."), s(q + 1))).otherwise(s(q))
    )
    v = views.table(spark, sf, "lineitem").filter("l_returnflag <> 'N'").select(
        F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.concat(F.lit("E"), s(F.col("l_partkey"))).alias("visual_id"), n.alias("eq_number")
    )
    return A.expand_numbers(v, "doc_id", ["l_linenumber"])


@R.add("segment_references", f"""WITH {Q.SEGMENTS}, {NUMBERED}
SELECT s.paper_id, s.idx, coalesce(n.visual_id, CASE WHEN s.k % 3 = 1 THEN 'Fig' || (s.k % 4) END) AS referenced FROM segments s
LEFT JOIN numbers n ON n.paper_id = s.paper_id AND n.number = s.k % 7""")
def segment_references(spark, sf):
    """N4: "Equation n" and "Figure n" mentions to visuals; every paper has figures Fig0–Fig3 and no tables."""
    s = views.segments(spark, sf)
    s = s.withColumn("say", F.concat("say", F.lit(" Table 1 and "), F.when(F.col("k") % 3 == 1, F.concat(F.lit("figs. "), (F.col("k") % 4).cast("string"))).otherwise("none")))
    eq = A.expand_numbers(numbered(spark, sf), "paper_id", ["ord"])
    figs = views.table(spark, sf, "events").select(F.col("user_id").alias("paper_id")).distinct().select(
        "paper_id", F.explode(F.array(*[F.lit(f"Fig{i}") for i in range(4)])).alias("visual_id")
    )
    return A.resolve_references(s, eq, figs).select("paper_id", "idx", "referenced")


@R.add("segment_visuals", f"WITH {Q.SEGMENTS}, {SHOWN} SELECT paper_id, idx, show, reason FROM shown")
def segment_visuals(spark, sf):
    """What is on screen for each segment, and why."""
    return shown(spark, sf).select("paper_id", "idx", "show", "reason")


@R.add("section_starts", f"""WITH {Q.SEGMENTS}, wanted AS (SELECT DISTINCT paper_id, section + 1 AS section FROM segments)
SELECT w.paper_id, w.section, coalesce(min(s.idx) FILTER (s.section >= w.section), max(s.idx)) AS first_segment
FROM wanted w JOIN segments s ON s.paper_id = w.paper_id GROUP BY ALL""")
def section_starts(spark, sf):
    """First segment of every section; each paper lists one section more than it has."""
    s = views.segments(spark, sf)
    return A.section_starts(s, s.select("paper_id", (F.col("section") + 1).alias("section")).distinct())


@R.add("visual_order", f"WITH {Q.SEGMENTS}, {SHOWN} SELECT paper_id, show AS visual_id, min(idx) AS first_segment FROM shown WHERE show <> 'E0' AND reason <> 'recent' GROUP BY ALL")
def visual_order(spark, sf):
    """First appearance of each visual."""
    return A.visual_order(shown(spark, sf), views.is_inline(F.col("show")))


@R.add("visual_stops", f"""WITH {Q.SEGMENTS}, {SHOWN},
l AS (SELECT *, CASE WHEN show IS NOT DISTINCT FROM lag(show) OVER (PARTITION BY paper_id ORDER BY idx) AND idx > 0 THEN 0 ELSE 1 END AS st FROM shown),
r AS (SELECT *, sum(st) OVER (PARTITION BY paper_id ORDER BY idx) AS run FROM l),
g AS (SELECT paper_id, show, run, min(idx) FILTER (reason <> 'recent') AS first, max(idx) FILTER (reason <> 'recent') AS stop FROM r WHERE show <> 'E0' GROUP BY ALL)
SELECT paper_id, show AS visual_id, arg_min(stop, first) AS stop FROM g WHERE first IS NOT NULL GROUP BY ALL""")
def visual_stops(spark, sf):
    """Where "stop at equations" pauses."""
    return A.visual_stops(shown(spark, sf), views.is_inline(F.col("show")))


_FIG_SAY = "CASE k % 8 WHEN 0 THEN concat('Figure ', k % 3, ': a cat') WHEN 1 THEN concat('as Table ', k % 3, ' and Fig. ', k % 3, ' show') ELSE 'text' END"


@R.add("figures_attached", f"""WITH {Q.SEGMENTS}, {SHOWN},
b AS (SELECT paper_id, idx, kind, section, show, reason, k, show IS NULL OR reason = 'recent' AS free,
  CASE WHEN k % 8 = 0 AND k % 3 < 2 THEN 'Fig' || (k % 3) END AS cap, CASE WHEN k % 8 IN (0, 1) AND k % 3 < 2 THEN 'Fig' || (k % 3) END AS men FROM shown),
n AS (SELECT *, CASE WHEN free THEN coalesce(cap, men) END AS new,
  sum(CASE WHEN show IS NULL AND coalesce(cap, men) IS NULL AND kind = 'sentence' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY idx) AS c FROM b),
m AS (SELECT *, last_value(CASE WHEN new IS NOT NULL OR kind = 'heading' OR (show IS NOT NULL AND reason <> 'recent') THEN idx END IGNORE NULLS)
  OVER (PARTITION BY paper_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM n)
SELECT m.paper_id, m.idx, coalesce(m.new, CASE WHEN m.show IS NULL AND m.kind = 'sentence' AND a.section = m.section AND m.c - a.c <= 2 THEN a.new END, m.show) AS show,
  CASE WHEN m.new IS NOT NULL THEN CASE WHEN m.cap IS NOT NULL THEN 'own' ELSE 'reference' END
    WHEN m.show IS NULL AND m.kind = 'sentence' AND a.new IS NOT NULL AND a.section = m.section AND m.c - a.c <= 2 THEN 'recent' ELSE m.reason END AS reason
FROM m LEFT JOIN m a ON a.paper_id = m.paper_id AND a.idx = m.at""")
def figures_attached(spark, sf):
    """Figures Fig0 and Fig1 of every paper added to a narrated script."""
    s = shown(spark, sf).withColumn("say", F.expr(_FIG_SAY))
    figs = views.table(spark, sf, "events").select(F.col("user_id").alias("paper_id")).distinct().select(
        "paper_id", F.explode(F.array(F.lit("Fig0"), F.lit("Fig1"))).alias("visual_id")
    )
    return A.attach_figures(s, figs).select("paper_id", "idx", "show", "reason")


@R.add("captions_linked", f"""WITH {LINES}, u AS (SELECT doc_id, ord, ord // 4 AS page, CASE WHEN ord % 3 = 0 THEN 'Fig' || (length(text) % 4) END AS cap, CASE WHEN ord % 5 = 0 THEN 'S' || ord END AS vis FROM lines),
f AS (SELECT doc_id, 'Fig' || (page % 4) AS visual_id, min(page) AS page FROM u GROUP BY ALL),
h AS (SELECT u.doc_id, u.cap, min(u.ord) AS ord FROM u JOIN f ON f.doc_id = u.doc_id AND f.visual_id = u.cap AND abs(f.page - u.page) <= 1 GROUP BY ALL)
SELECT u.doc_id, u.ord, coalesce(h.cap, u.vis) AS visual_id FROM u LEFT JOIN h ON h.doc_id = u.doc_id AND h.ord = u.ord""")
def captions_linked(spark, sf):
    """Caption sentences point at their figure."""
    u = lines(spark, sf).select(
        "doc_id", "ord", F.floor(F.col("ord") / 4).cast("int").alias("page"), F.lit("sentence").alias("kind"),
        F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Figure "), (F.length("text") % 4).cast("string"), F.lit(": "), "text")).otherwise(F.lit("x")).alias("text"),
        F.when(F.col("ord") % 5 == 0, F.concat(F.lit("S"), F.col("ord").cast("string"))).alias("visual_id"),
    )
    f = u.groupBy("doc_id", F.concat(F.lit("Fig"), (F.col("page") % 4).cast("string")).alias("visual_id")).agg(F.min("page").alias("page"))
    return A.link_captions(u, f).select("doc_id", "ord", "visual_id")


@R.add("visuals_dropped", """WITH u AS (SELECT l_orderkey AS doc_id, l_partkey AS ord, l_linenumber, 'V' || l_suppkey AS visual_id FROM lineitem),
m AS (SELECT DISTINCT o_orderkey AS doc_id, 'V' || (o_orderkey % 7) AS visual_id FROM orders)
SELECT u.doc_id, u.ord, u.l_linenumber, CASE WHEN m.doc_id IS NULL THEN u.visual_id END AS visual_id FROM u LEFT JOIN m ON m.doc_id = u.doc_id AND m.visual_id = u.visual_id""")
def visuals_dropped(spark, sf):
    """Links to visuals that could not be drawn are cleared."""
    li = views.table(spark, sf, "lineitem")
    u = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("ord"), "l_linenumber", F.concat(F.lit("V"), F.col("l_suppkey").cast("string")).alias("visual_id"))
    m = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("V"), (F.col("o_orderkey") % 7).cast("string")).alias("visual_id"))
    return A.drop_visuals(u, u.select("doc_id", "visual_id").distinct(), m)[0].select("doc_id", "ord", "l_linenumber", "visual_id")


def _units(spark, sf):
    """units(doc_id, ord, unit_id, kind, chars, spoken, chunk): each line a unit, chunked in its document's own row."""
    d = views.texts(spark, sf, "documents")
    ls = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    kind = lambda s, i: F.when(i % 9 == 4, "heading").when(F.length(s) % 5 == 0, "equation").otherwise("sentence")
    u = F.transform(ls, lambda s, i: F.struct(kind(s, i).alias("kind"), F.length(s).alias("chars")))
    d = d.select("doc_id", u.alias("u"))
    d = d.select("doc_id", F.posexplode(F.arrays_zip("u", A.chunk_of_units(F.col("u")).alias("chunk"))).alias("ord", "x"))
    return d.select(
        "doc_id", "ord", F.concat(F.lit("U"), F.col("ord").cast("string")).alias("unit_id"), "x.u.kind", "x.u.chars",
        F.concat(F.lit("spoken "), F.col("ord").cast("string")).alias("spoken"), "x.chunk",
        F.when(F.col("x.u.kind") == "equation", F.concat(F.lit("E"), F.col("ord").cast("string"))).alias("visual_id"),
        F.floor(F.col("ord") / 5).cast("int").alias("page"),
    )


UNITS = LINES + """,
u0 AS (SELECT doc_id, ord, CASE WHEN ord % 9 = 4 THEN 'heading' WHEN length(text) % 5 = 0 THEN 'equation' ELSE 'sentence' END AS kind, length(text) AS chars FROM lines),
walk AS (
  SELECT doc_id, ord, kind, 0 AS chunk, CAST(chars + 8 AS BIGINT) AS c, CASE WHEN kind = 'equation' THEN 1 ELSE 0 END AS e FROM u0 WHERE ord = 0
  UNION ALL
  SELECT doc_id, ord, kind, chunk + f, CASE WHEN f = 1 THEN 0 ELSE c END + chars + 8, CASE WHEN f = 1 THEN 0 ELSE e END + CASE WHEN kind = 'equation' THEN 1 ELSE 0 END FROM (
    SELECT u.doc_id, u.ord, u.kind, u.chars, w.chunk, w.c, w.e,
      CASE WHEN w.c > 6000 OR (u.kind = 'equation' AND w.e >= 6) OR (u.kind = 'heading' AND w.c > 2500) THEN 1 ELSE 0 END AS f
    FROM walk w JOIN u0 u ON u.doc_id = w.doc_id AND u.ord = w.ord + 1)),
units AS (SELECT doc_id, ord, kind, chunk, 'U' || ord AS unit_id, CASE WHEN kind = 'equation' THEN 'E' || ord END AS visual_id, ord // 5 AS page FROM walk)"""


@R.add("unit_chunks", f"WITH RECURSIVE {UNITS} SELECT doc_id, ord, chunk FROM units")
def unit_chunks(spark, sf):
    """Units packed into narration requests."""
    return _units(spark, sf).select("doc_id", "ord", "chunk")


@R.add("visuals_known_before", f"""WITH RECURSIVE {UNITS}, c AS (SELECT doc_id, chunk, arg_min(page, ord) AS first_page FROM units GROUP BY ALL)
SELECT c.doc_id, c.chunk, v.visual_id FROM c JOIN units v ON v.doc_id = c.doc_id AND v.visual_id IS NOT NULL AND v.page <= c.first_page AND v.chunk <> c.chunk""")
def visuals_known_before(spark, sf):
    """Equations a later request may refer to."""
    u = _units(spark, sf)
    c = u.groupBy("doc_id", "chunk").agg(F.min_by("page", "ord").alias("first_page"))
    v = u.filter("visual_id IS NOT NULL").select("doc_id", "visual_id", "page", "kind", F.col("ord").cast("string").alias("eq_number"))
    return A.known_before(c, v, u)


def _drafts(spark, sf):
    """A model's drafts: one per unit except some equations, some pointing back or nowhere; every fifth document is summarised."""
    u = cut_lineage(_units(spark, sf))
    d = u.filter("NOT (kind = 'equation' AND ord % 2 = 0) AND NOT (doc_id % 5 = 0 AND ord % 2 = 1)")
    src = F.when(F.col("ord") % 7 == 3, F.concat(F.lit("U"), (F.col("ord") - 2).cast("string"))).when(F.col("ord") % 11 == 5, "X").otherwise(F.col("unit_id"))
    return d.select("doc_id", "chunk", F.col("ord").alias("d_ord"), src.alias("src"), F.when(F.col("ord") % 13 == 6, "").otherwise(F.concat(F.lit("draft "), F.col("ord").cast("string"))).alias("say")), u


DRAFTS = UNITS + """,
drafts AS (SELECT doc_id, chunk, ord AS d_ord, CASE WHEN ord % 7 = 3 THEN ord - 2 WHEN ord % 11 = 5 THEN NULL ELSE ord END AS src,
  CASE WHEN ord % 13 = 6 THEN '' ELSE 'draft ' || ord END AS say FROM units WHERE NOT (kind = 'equation' AND ord % 2 = 0) AND NOT (doc_id % 5 = 0 AND ord % 2 = 1)),
heads AS (SELECT doc_id, chunk, min(ord) AS head FROM units GROUP BY ALL),
aligned AS (SELECT d.doc_id, d.chunk, d.d_ord, d.say, greatest(coalesce(max(u.ord) OVER (PARTITION BY d.doc_id, d.chunk ORDER BY d.d_ord), h.head), h.head) AS unit_ord
  FROM drafts d JOIN heads h ON h.doc_id = d.doc_id AND h.chunk = d.chunk LEFT JOIN units u ON u.doc_id = d.doc_id AND u.chunk = d.chunk AND u.ord = d.src),
cov AS (SELECT u.doc_id, u.chunk, count(*) FILTER (kind = 'sentence') AS need, count(*) FILTER (kind = 'sentence' AND a.unit_ord IS NOT NULL) AS have
  FROM units u LEFT JOIN (SELECT DISTINCT doc_id, chunk, unit_ord FROM aligned) a ON a.doc_id = u.doc_id AND a.chunk = u.chunk AND a.unit_ord = u.ord GROUP BY ALL),
okc AS (SELECT doc_id, chunk FROM cov c WHERE (need = 0 OR have >= 0.7 * need) AND EXISTS (SELECT 1 FROM aligned a WHERE a.doc_id = c.doc_id AND a.chunk = c.chunk AND say <> '')),
accepted AS (
  SELECT a.doc_id, a.chunk, a.d_ord, a.unit_ord, a.say FROM aligned a JOIN okc o ON o.doc_id = a.doc_id AND o.chunk = a.chunk WHERE say <> ''
  UNION ALL
  SELECT u.doc_id, u.chunk, NULL, u.ord, 'spoken ' || u.ord FROM units u JOIN okc o ON o.doc_id = u.doc_id AND o.chunk = u.chunk
  WHERE kind = 'equation' AND NOT EXISTS (SELECT 1 FROM aligned a WHERE a.doc_id = u.doc_id AND a.chunk = u.chunk AND a.unit_ord = u.ord))"""


@R.add("drafts_aligned", f"WITH RECURSIVE {DRAFTS} SELECT doc_id, chunk, d_ord, unit_ord FROM aligned")
def drafts_aligned(spark, sf):
    """Drafts to the units they narrate."""
    d, u = _drafts(spark, sf)
    return A.align_drafts(d, u, ["doc_id", "chunk"]).select("doc_id", "chunk", "d_ord", "unit_ord")


@R.add("drafts_accepted", f"WITH RECURSIVE {DRAFTS} SELECT doc_id, chunk, d_ord, unit_ord, say FROM accepted")
def drafts_accepted(spark, sf):
    """Drafts of chunks that are covered well enough, with skipped equations put back."""
    d, u = _drafts(spark, sf)
    return A.coverage_guard(cut_lineage(A.align_drafts(d, u, ["doc_id", "chunk"])), u, ["doc_id", "chunk"])


@R.add("narration_merged", f"""WITH RECURSIVE {DRAFTS} SELECT doc_id, chunk, unit_ord, say, FALSE AS offline FROM accepted
UNION ALL SELECT doc_id, chunk, ord, 'spoken ' || ord, TRUE FROM units u WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.doc_id = u.doc_id AND a.chunk = u.chunk)""")
def narration_merged(spark, sf):
    """Accepted drafts, offline text for the other chunks."""
    d, u = _drafts(spark, sf)
    key = ["doc_id", "chunk"]
    m = A.merge_narration(cut_lineage(A.coverage_guard(cut_lineage(A.align_drafts(d, u, key)), u, key)), u, key)
    return m.select("doc_id", "chunk", "unit_ord", "say", "offline")


_POS = """pos AS (SELECT s.event_id AS pos_id, s.paper_id, s.idx, CASE WHEN c.duration_ms IS NULL THEN 0 ELSE (s.k * 37) % c.duration_ms END AS offset_ms FROM segments s
  LEFT JOIN clips c ON c.paper_id = s.paper_id AND c.idx = s.idx),
line AS (SELECT s.paper_id, s.idx, c.duration_ms, coalesce(sum(coalesce(c.duration_ms, 0)) OVER (PARTITION BY s.paper_id ORDER BY s.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
  FROM segments s LEFT JOIN clips c ON c.paper_id = s.paper_id AND c.idx = s.idx)"""


def _positions(spark, sf):
    s, c = cut_lineage(views.segments(spark, sf)), views.clips(spark, sf)
    d = s.join(c, ["paper_id", "idx"], "left")
    off = F.when(F.col("duration_ms").isNull(), 0).otherwise((F.col("k") * 37) % F.col("duration_ms"))
    return d.select(F.col("event_id").alias("pos_id"), "paper_id", "idx", off.alias("offset_ms")), cut_lineage(A.timeline(s, c))


@R.add("seek_back", f"""WITH {Q.SEGMENTS}, {_POS}, p AS (SELECT pos.*, l.st - (15000 - offset_ms) AS at, 15000 - offset_ms AS rest FROM pos JOIN line l ON l.paper_id = pos.paper_id AND l.idx = pos.idx),
g AS (SELECT p.*, (SELECT max(l.idx) FROM line l WHERE l.paper_id = p.paper_id AND l.idx < p.idx AND l.duration_ms IS NULL) AS gap FROM p),
h AS (SELECT g.*, l.st AS gap_at FROM g LEFT JOIN line l ON l.paper_id = g.paper_id AND l.idx = g.gap)
SELECT h.pos_id, h.paper_id, CAST(CASE WHEN rest <= 0 THEN h.idx WHEN gap IS NOT NULL AND at < gap_at THEN gap WHEN at < 0 THEN 0 ELSE c.idx END AS BIGINT) AS segment,
  CAST(CASE WHEN rest <= 0 THEN -rest WHEN (gap IS NOT NULL AND at < gap_at) OR at < 0 THEN 0 ELSE at - c.st END AS BIGINT) AS offset_ms
FROM h LEFT JOIN line c ON c.paper_id = h.paper_id AND c.duration_ms > 0 AND h.at >= c.st AND h.at < c.st + c.duration_ms""")
def seek_back(spark, sf):
    """Every position moved 15 seconds back."""
    p, line = _positions(spark, sf)
    return A.seek_back(p, line, 15000)


@R.add("seek_forward", f"""WITH {Q.SEGMENTS}, {_POS}, p AS (SELECT pos.*, l.st + offset_ms + 15000 AS at FROM pos JOIN line l ON l.paper_id = pos.paper_id AND l.idx = pos.idx),
g AS (SELECT p.*, (SELECT min(l.idx) FROM line l WHERE l.paper_id = p.paper_id AND l.idx >= p.idx AND l.duration_ms IS NULL) AS gap FROM p),
h AS (SELECT g.*, l.st AS gap_at, e.idx AS last_idx, e.duration_ms AS last_d, e.st + coalesce(e.duration_ms, 0) AS fin FROM g LEFT JOIN line l ON l.paper_id = g.paper_id AND l.idx = g.gap
  JOIN (SELECT * FROM line QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY idx DESC) = 1) e ON e.paper_id = g.paper_id)
SELECT h.pos_id, h.paper_id, CAST(CASE WHEN gap IS NOT NULL AND (gap = h.idx OR at >= gap_at) THEN gap WHEN at >= fin THEN last_idx ELSE c.idx END AS BIGINT) AS segment,
  CAST(CASE WHEN gap IS NOT NULL AND (gap = h.idx OR at >= gap_at) THEN 0 WHEN at >= fin THEN greatest(0, coalesce(last_d, 0) - 250) ELSE at - c.st END AS BIGINT) AS offset_ms
FROM h LEFT JOIN line c ON c.paper_id = h.paper_id AND c.duration_ms > 0 AND h.at >= c.st AND h.at < c.st + c.duration_ms""")
def seek_forward(spark, sf):
    """Every position moved 15 seconds forward."""
    p, line = _positions(spark, sf)
    return A.seek_forward(p, line, 15000)


@R.add("clips_to_make", f"""WITH {Q.SEGMENTS}, cur AS (SELECT paper_id, max(idx) // 2 AS cursor FROM segments GROUP BY paper_id)
SELECT s.paper_id, s.idx FROM segments s JOIN cur ON cur.paper_id = s.paper_id AND s.idx BETWEEN cursor AND cursor + 40
WHERE NOT EXISTS (SELECT 1 FROM clips c WHERE c.paper_id = s.paper_id AND c.idx = s.idx AND c.idx % 2 = 0) AND NOT (s.k % 10 = 3) AND NOT (s.k % 10 = 4 AND s.k % 20 < 10)""")
def clips_to_make(spark, sf):
    """Clips still to synthesize ahead of each cursor; even segments with a clip are done."""
    s = views.segments(spark, sf)
    now = F.lit(Q.NOW).cast("timestamp")
    cursors = s.groupBy("paper_id").agg(F.floor(F.max("idx") / 2).cast("long").alias("cursor"))
    done = views.clips(spark, sf).filter("idx % 2 = 0")
    late = F.when(F.col("k") % 20 < 10, now - F.expr("INTERVAL 5 SECONDS")).otherwise(now - F.expr("INTERVAL 20 SECONDS"))
    failed = s.filter("k % 10 = 4").withColumn("failed_at", late)
    return A.clips_to_make(s, done, s.filter("k % 10 = 3"), failed, cursors, 40, now)


@R.add("contents_index", f"""WITH {Q.SEGMENTS}, {SHOWN}, o AS (SELECT paper_id, show AS visual_id, min(idx) AS idx FROM shown WHERE show <> 'E0' AND reason <> 'recent' GROUP BY ALL),
v AS (SELECT o.paper_id, s.section, string_agg(o.visual_id, ',' ORDER BY o.idx) AS visuals FROM o JOIN segments s ON s.paper_id = o.paper_id AND s.idx = o.idx GROUP BY ALL)
SELECT s.paper_id, 'section' AS entry, s.section AS number, min(s.idx) AS first_segment, coalesce(any_value(v.visuals), '') AS visuals FROM segments s LEFT JOIN v ON v.paper_id = s.paper_id AND v.section = s.section GROUP BY ALL
UNION ALL SELECT paper_id, 'page', page, min(idx), '' FROM segments GROUP BY ALL""")
def contents_index(spark, sf):
    """Table of contents by page and section."""
    s = shown(spark, sf)
    return A.contents_index(s, A.visual_order(s, views.is_inline(F.col("show"))))


def _quote(sql: str) -> str:
    """`show` and `at` are keywords of DuckDB."""
    return re.sub(r"\b(show|at)\b", r'"\1"', sql)


R.sql.update({k: _quote(v) for k, v in R.sql.items()})
