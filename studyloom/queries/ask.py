"""Questions about a document (H1–H10, P2, P4, P5, K13, K14) over `events`, `conversations` and `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import replies as Y
from studyloom.operators import ask as H
from studyloom.plans import views
from studyloom.queries import sqlviews as Q
from studyloom.queries.narration import SHOWN, _quote, shown
from studyloom.queries.registry import Registry

R = Registry()


@R.add("listening_context", _quote(f"""WITH {Q.SEGMENTS}, {SHOWN}, q AS (SELECT event_id AS question_id, s.paper_id, least(s.idx + s.k % 3 * 30, e.m) AS position FROM segments s
  JOIN (SELECT paper_id, max(idx) AS m FROM segments GROUP BY ALL) e ON e.paper_id = s.paper_id WHERE s.k % 4 = 0)
SELECT q.question_id, string_agg(s.say, '|' ORDER BY s.idx) FILTER (s.idx < position) AS heard, any_value(s.say) FILTER (s.idx = position) AS playing,
  string_agg(s.say, '|' ORDER BY s.idx) FILTER (s.idx > position) AS ahead, any_value(s.section) FILTER (s.idx = position) AS section, any_value(s.show) FILTER (s.idx = position) AS on_screen
FROM q JOIN shown s ON s.paper_id = q.paper_id AND s.idx BETWEEN position - 8 AND position + 2 GROUP BY ALL"""))
def listening_context(spark, sf):
    """H1: what was heard, is playing and comes next for a quarter of all segments."""
    s = shown(spark, sf)
    q = s.filter("k % 4 = 0").select(F.col("event_id").alias("question_id"), "paper_id", (F.col("idx") + F.col("k") % 3 * 30).alias("position"))
    c = H.listening_context(q, s)
    text = lambda a: F.nullif(F.array_join(a, "|"), F.lit(""))
    return c.select("question_id", text("heard").alias("heard"), "playing", text("ahead").alias("ahead"), "section", "on_screen")


_SAID = """said AS (SELECT paper_id, show AS visual_id, CASE WHEN length(s) > 700 THEN left(s, 700) || '…' ELSE s END AS said FROM (
  SELECT paper_id, show, string_agg(say, ' ' ORDER BY idx) AS s FROM shown WHERE show IS NOT NULL AND reason = 'own' GROUP BY ALL))"""


@R.add("visual_narration", _quote(f"WITH {Q.SEGMENTS}, {SHOWN}, {_SAID} SELECT paper_id, visual_id, said FROM said"))
def visual_narration(spark, sf):
    """H2: what is said about each visual."""
    return H.visual_narration(shown(spark, sf))


@R.add("visual_cards", _quote(f"""WITH {Q.SEGMENTS}, {SHOWN}, {_SAID}, v AS (SELECT DISTINCT paper_id, k % 5 AS n FROM segments)
SELECT v.paper_id, 'E' || n AS visual_id, concat('[E', n, '] ', CASE n WHEN 1 THEN 'Equations (1–3)' WHEN 2 THEN 'Figure 2' WHEN 3 THEN 'Table' ELSE 'Algorithm 4' END, ', page ', n + 1, '.',
  CASE n WHEN 1 THEN ' LaTeX: a = b' WHEN 2 THEN ' Caption: A cat' WHEN 4 THEN ' Text: for i' ELSE '' END, CASE WHEN n IN (2, 3) AND v.paper_id % 2 = 0 THEN ' What the image shows: note ' || n ELSE '' END,
  coalesce(' The narration said: ' || s.said, '')) AS card
FROM v LEFT JOIN said s ON s.paper_id = v.paper_id AND s.visual_id = 'E' || n WHERE n > 0"""))
def visual_cards(spark, sf):
    """H3: a line about every visual of every paper."""
    s = shown(spark, sf)
    n = F.col("n")
    v = s.select("paper_id", (F.col("k") % 5).alias("n")).distinct().select(
        "paper_id", "n", F.concat(F.lit("E"), n.cast("string")).alias("visual_id"), n.alias("page"),
        F.element_at(F.array(*[F.lit(x) for x in ("inline", "equation", "figure", "table", "algorithm")]), n + 1).alias("kind"),
        F.when(n == 1, "1–3").when(n == 2, "2").when(n == 4, "4").alias("eq_number"),
        F.when(n == 2, "A\n cat").when(n == 4, "for  i").otherwise("").alias("raw_text"), F.when(n == 1, "a =\n b").alias("latex"),
    )
    notes = v.filter("paper_id % 2 = 0").select("paper_id", "visual_id", F.concat(F.lit("note  "), n.cast("string")).alias("note"))
    return H.visual_cards(v, notes, H.visual_narration(s))


TURNS = """turns AS (SELECT u.conv_id % 20 AS user_id, u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


@R.add("question_history", f"""WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conv_id DESC, turn DESC) AS r FROM turns)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY conv_id, turn) AS INTEGER) AS place, question, answer FROM r WHERE r <= 6""")
def question_history(spark, sf):
    """H4: the last six questions of each user."""
    t = H.help_turns(views.table(spark, sf, "conversations")).withColumn("user_id", F.col("conv_id") % 20)
    return H.history(t, ["user_id"], ["conv_id", "turn"]).select("user_id", "place", "question", "answer")


_REPLY = """CASE conv_id % 4 WHEN 0 THEN concat(trim(text), '\\n---\\n**SHOW**: [E', turn % 4, '].\\nNEXT: "Why so?" | - How? | ', repeat('x', 90), ' | *And then* | five') WHEN 1 THEN concat(trim(text), '\\n--')
  WHEN 2 THEN concat(trim(text), ' see [E1, E') ELSE trim(text) END"""


@R.add("replies_parsed", """SELECT conv_id, turn, regexp_replace(trim(text), '^\\s+|\\s+$', '', 'g') || CASE conv_id % 4 WHEN 2 THEN ' see' ELSE '' END AS answer,
  CASE WHEN conv_id % 4 = 0 AND turn % 4 IN (1, 3) THEN 'E' || (turn % 4) END AS show, CASE WHEN conv_id % 4 = 0 THEN 'Why so?|How?|And then' ELSE '' END AS followups
FROM conversations WHERE role = 'assistant'""".replace("AS show", 'AS "show"'))
def replies_parsed(spark, sf):
    """H5: answers with the visual they show and their follow-ups; partial replies hide what is still arriving."""
    c = views.texts(spark, sf, "conversations")
    r = c.filter("role = 'assistant'").select("conv_id", "turn", F.expr(_REPLY).alias("text"))
    v = c.select("conv_id", F.explode(F.array(F.lit("E1"), F.lit("E3"))).alias("visual_id")).distinct()
    return H.parse_replies(r, v, "conv_id").select("conv_id", "turn", "answer", "show", F.array_join("followups", "|").alias("followups"))


_ANSWER = """concat(CASE conv_id % 3 WHEN 0 THEN 'As equation (1.9) [E1] and Figure 2 show, $x = Eq. 3$ Eq. 4, ' WHEN 1 THEN 'By Algorithm 7 and [Fig2, E9] or Figure 2, [12]. ' ELSE 'See Table 9. [S0] ' END, text, ' Eqs. (3)')"""


@R.add("answer_visuals", """SELECT conv_id, turn, unnest(l) AS visual_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS rank FROM (
  SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN ['E1', 'Fig2', 'E2'] WHEN 1 THEN ['A7', 'Fig2', 'E2'] ELSE ['E2'] END AS l FROM conversations WHERE role = 'assistant')""")
def answer_visuals(spark, sf):
    """H6: visuals that answers name, in order."""
    c = views.texts(spark, sf, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), F.expr(_ANSWER).alias("text"))
    rows = [("E1", "equation", "1.9"), ("E2", "equation", "3–5"), ("Fig2", "figure", "2"), ("A7", "algorithm", "7"), ("S0", "inline", None)]
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(v).alias("visual_id"), F.lit(k).alias("kind"), F.lit(n).alias("eq_number")) for i, (v, k, n) in enumerate(rows)])
    v = c.select("conv_id").distinct().select("conv_id", F.inline(each))
    got = H.referenced(a, v, "conv_id")
    return got.select("conv_id", F.split("answer_id", "/")[1].cast("long").alias("turn"), "visual_id", F.col("rank").cast("int").alias("rank"))


@R.add("paper_texts", """WITH p AS (SELECT doc_id // 20 AS paper, doc_id % 20 AS page, concat(chr(10), chr(10), '<!-- page ', doc_id % 20 + 1, ' -->', chr(10), chr(10), replace(text, '![x](y.png)', '')) AS t FROM documents),
j AS (SELECT paper, regexp_replace(string_agg(t, '' ORDER BY page), '^\\s+|\\s+$', '', 'g') AS t FROM p GROUP BY paper)
SELECT paper, md5(t) AS text, length(t) AS chars FROM j""")
def paper_texts(spark, sf):
    """Papers of twenty documents as their pages, as one text each."""
    d = views.texts(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 20).cast("long").alias("paper"), (F.col("doc_id") % 20).alias("page"), F.concat(F.lit("![a](b.png)"), "text").alias("markdown")
    )
    return H.paper_text(d, "paper").select("paper", F.md5("text").alias("text"), F.length("text").cast("long").alias("chars"))


@R.add("paper_texts_growing", """WITH p AS (SELECT doc_id % 20 AS paper, doc_id // 20 AS page, concat(chr(10), chr(10), '<!-- page ', doc_id // 20 + 1, ' -->', chr(10), chr(10), text) AS t FROM documents),
b AS (SELECT paper, page, t, sum(length(t)) OVER (PARTITION BY paper ORDER BY page) - length(t) AS n FROM p)
SELECT paper, page, CASE WHEN n = 0 THEN 0 ELSE CAST(n - 2 AS BIGINT) END AS "begin", md5(CASE WHEN n = 0 THEN substring(t, 3) ELSE t END) AS text FROM b""")
def paper_texts_growing(spark, sf):
    """Twenty papers that grow with the table, as pieces with their places."""
    d = views.texts(spark, sf, "documents").select(
        (F.col("doc_id") % 20).alias("paper"), F.floor(F.col("doc_id") / 20).cast("long").alias("page"), F.concat(F.lit("![a](b.png)"), "text").alias("markdown")
    )
    return H.paper_pieces(d, "paper").withColumn("text", F.md5("text"))


_PLAN = """concat('OVERVIEW: x\\n## IDEA ', doc_id % 7, ': **', substring(text, 1, 12), '**\\n idea c2 - Second ', doc_id, '\\nIDEA c3:\\nnoise')"""


@R.add("plan_progress", "SELECT doc_id, trim(regexp_replace(trim(substring(text, 1, 12)), '[*]+$', '')) || '|Second ' || doc_id AS ideas FROM documents WHERE NOT contains(substring(text, 1, 12), chr(10))")
def plan_progress(spark, sf):
    """Idea names in plans still being written."""
    d = views.texts(spark, sf, "documents").filter("NOT contains(substring(text, 1, 12), '\\n')")
    return d.select("doc_id", F.array_join(Y.plan_so_far(F.expr(_PLAN)), "|").alias("ideas"))


_FEEDBACK = """CASE conv_id % 6 WHEN 0 THEN concat('VERDICT: got it\\n', text) WHEN 1 THEN concat('**Verdict:** Partly right\\n\\n', text) WHEN 2 THEN concat('\\n VERDICT: not yet\\r\\n', text)
  WHEN 3 THEN 'VERDICT: got' WHEN 4 THEN '**VERD' ELSE text END"""


@R.add("feedback_verdicts", """SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'got it' WHEN 1 THEN 'partly' WHEN 2 THEN 'not yet' END AS verdict,
  CASE WHEN conv_id % 6 IN (3, 4) THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS feedback FROM conversations""")
def feedback_verdicts(spark, sf):
    """Verdict and text of feedback, whole or arriving."""
    c = views.texts(spark, sf, "conversations").select("conv_id", "turn", Y.feedback(F.expr(_FEEDBACK)).alias("f"))
    return c.select("conv_id", "turn", "f.verdict", F.col("f.text").alias("feedback"))


_LINES = "concat('C', doc_id % 9, ': **yes**\\nc', doc_id % 5, 'x - no\\nc3 = k1 \\nc', doc_id, ' -> K', doc_id % 4)"


@R.add("verdict_lines", """SELECT doc_id, concat('c', doc_id % 9, '=true,c', doc_id % 5, 'x=false') AS verdicts, concat('c3=k1,c', doc_id, '=k', doc_id % 4) AS matches FROM documents""")
def verdict_lines(spark, sf):
    """P5: verdict and match lines of replies."""
    d = views.texts(spark, sf, "documents").select("doc_id", Y.verdicts(F.expr(_LINES)).alias("v"), Y.idea_matches(F.expr(_LINES)).alias("m"))
    pair = lambda a, k, v: F.array_join(F.transform(a, lambda x: F.concat_ws("=", x[k], x[v].cast("string"))), ",")
    return d.select("doc_id", pair("v", "idea", "yes").alias("verdicts"), pair("m", "idea", "alias").alias("matches"))


