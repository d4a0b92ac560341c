"""Files, library tables and provider records (S1–S18), cards in replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import replies as Y
from studyloom.operators import catalog as C
from studyloom.operators import memory, review
from studyloom.plans import views
from studyloom.queries import sqlviews as Q
from studyloom.queries.memory import now
from studyloom.queries.registry import Registry
from studyloom.sources import files as S
from studyloom.sources import library as B
from studyloom.sources import providers as V

R = Registry()

# (extension, bytes put before the text as hex, format)
_FILES = (
    (".bin", "255044462D312E37", "pdf"), (".zip", "504B0304" + "application/epub+zip".encode().hex(), "epub"), ("", "504B0304" + "word/document.xml".encode().hex(), "docx"),
    (".x", "504B0304" + "ppt/presentation.xml".encode().hex(), "pptx"), (".png", "89504E470D0A1A0A", "png"), (".txt", "FFD8FFE0", "jpeg"), ("", "524946460000000057454250", "webp"), (".txt", "4100", None),
    ("", "<!DOCTYPE html><html>".encode().hex(), "html"), ("", "# Title\n".encode().hex(), "markdown"), (".txt", "", "text"), (".exe", "4D5A", None), (".md", "", "markdown"), (".odt", "504B0304" + "content.xml".encode().hex(), "odt"),
)


def files(spark, sf):
    """Every document as a file of one of the kinds above."""
    d = views.texts(spark, sf, "documents")
    n = (F.col("doc_id") % len(_FILES) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in _FILES]), n)
    plain = F.regexp_replace("text", r"[^\p{L}\p{N} .,]", " ")
    return d.select("doc_id", F.concat(F.lit("dir.d/f"), F.col("doc_id").cast("string"), pick(0)).alias("path"), F.concat(F.unhex(pick(1)), F.encode(plain, "UTF-8")).alias("content"))


_KINDS = ", ".join("NULL" if f[2] is None else f"'{f[2]}'" for f in _FILES)


@R.add("file_formats", f"SELECT doc_id, [{_KINDS}][doc_id % {len(_FILES)} + 1] AS format, doc_id % {len(_FILES)} = 0 AS is_pdf FROM documents")
def file_formats(spark, sf):
    """What each file is, from its content first."""
    return files(spark, sf).select("doc_id", S.detect_format(F.col("path"), F.col("content")).alias("format"), S.is_pdf(F.col("content")).alias("is_pdf"))


@R.add("decoded_texts", "SELECT doc_id, md5(CASE WHEN doc_id % 5 = 3 THEN 'é' || doc_id || 'ü' ELSE text END) AS text FROM documents")
def decoded_texts(spark, sf):
    """Bytes in five encodings back to text."""
    d = views.texts(spark, sf, "documents")
    m, t = F.col("doc_id") % 5, F.col("text")
    latin = F.concat(F.lit("é"), F.col("doc_id").cast("string"), F.lit("ü"))
    raw = (
        F.when(m == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8"))).when(m == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE")))
        .when(m == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE"))).when(m == 3, F.encode(latin, "ISO-8859-1")).otherwise(F.encode(t, "UTF-8"))
    )
    return d.select("doc_id", raw.alias("content")).select("doc_id", F.md5(S.decode_text(F.col("content"))).alias("text"))


@R.add("content_ids", "SELECT doc_id, left(sha256(text), 16) AS paper_id FROM documents")
def content_ids(spark, sf):
    """S3."""
    return views.texts(spark, sf, "documents").select("doc_id", S.content_id(F.encode("text", "UTF-8")).alias("paper_id"))


@R.add("new_imports", "SELECT DISTINCT left(sha256(text), 16) AS paper_id FROM documents WHERE left(sha256(text), 16) NOT IN (SELECT left(sha256(text), 16) FROM documents WHERE doc_id % 4 = 0)")
def new_imports(spark, sf):
    """Documents not imported before, exact copies once; every fourth document is in the library."""
    d = views.texts(spark, sf, "documents").select("doc_id", S.content_id(F.encode("text", "UTF-8")).alias("paper_id"))
    return C.new_documents(d, d.filter("doc_id % 4 = 0")).select("paper_id")


@R.add("library_list", "SELECT o_orderkey AS paper_id, epoch_us(o_orderdate) AS added_us FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def library_list(spark, sf):
    """Papers that have a script."""
    p = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), views.utc("o_orderdate").alias("added_utc"))
    s = views.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("paper_id"))
    return C.library(p, s).select("paper_id", F.unix_micros("added_utc").alias("added_us"))


@R.add("paper_deleted", "SELECT left(sha256(CAST(o_orderkey AS VARCHAR)), 16) AS paper_id FROM orders WHERE left(sha256(CAST(o_orderkey AS VARCHAR)), 16) <> left(sha256('7'), 16)")
def paper_deleted(spark, sf):
    """The library without one paper; an id of another shape deletes nothing."""
    import hashlib

    p = views.table(spark, sf, "orders").select(F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 16).alias("paper_id"))
    return C.delete_paper(C.delete_paper(p, "../x"), hashlib.sha256(b"7").hexdigest()[:16])


@R.add("scripts_stored", f"WITH {Q.SEGMENTS} SELECT paper_id, idx, kind, section, say FROM segments WHERE paper_id % 5 <> 0")
def scripts_stored(spark, sf):
    """Scripts written and read back; papers stored by another version are absent."""
    from studyloom.streaming.streams import shared_folder

    s = views.segments(spark, sf).select("paper_id", "idx", "kind", "section", "say")
    folder = shared_folder(spark, "scripts")
    B.write_script(s.withColumn("version", F.when(F.col("paper_id") % 5 == 0, 2).otherwise(B.SCRIPT_VERSION)), folder)
    return B.read_script(spark, folder)


def _memory_json(spark, sf):
    m = memory.unpack(memory.replay(views.reviews(spark, sf)))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return m.select(
        "learner_id", "item_id", F.lower("stage").alias("stage"), F.when(F.col("item_id") != 1, iso("due")).alias("due"), "stability", "difficulty", "reps",
        F.when(F.col("item_id") != 2, F.col("lapses").cast("string")).alias("lapses"), iso("last_review").alias("last"), F.lit("2024-01-01T00:00:00Z").alias("created"),
    )


@R.add("cards_read", Q.rec(Q.MEMORY, """SELECT learner_id AS paper_id, 'c' || item_id AS card_id, stage, CASE WHEN item_id = 1 THEN epoch_us(TIMESTAMP '2024-01-01') ELSE due END AS due_us, round(s, 6) AS stability, reps,
  last_us AS last_review_us, 0 AS segment, '' AS origin FROM memory"""))
def cards_read(spark, sf):
    """Decks as JSON read back; a missing due time is the creation time, missing fields take defaults."""
    m = _memory_json(spark, sf)
    card = F.struct(F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("id"), F.lit("f").alias("front"), F.lit("b").alias("back"), "created", "stage", "due", "stability", "difficulty", "reps", "last")
    f = m.groupBy(F.col("learner_id").alias("paper_id")).agg(F.to_json(F.collect_list(card)).alias("json"))
    c = B.read_cards(B.write_cards(B.read_cards(f, now())), now())
    return c.select("paper_id", "card_id", "memory.stage", F.unix_micros("memory.due").alias("due_us"), F.round("memory.stability", 6).alias("stability"), "memory.reps",
                    F.unix_micros("memory.last_review").alias("last_review_us"), "segment", "origin")


@R.add("concepts_read", Q.rec(Q.MEMORY, """SELECT learner_id, 'x' || item_id AS concept_id, stage, reps, FALSE AS background, 'P' || item_id || '@' || learner_id AS source, 'Why?:1:-1' AS questions FROM memory"""))
def concepts_read(spark, sf):
    """Ideas as JSON read back, with sources and questions."""
    return _shown(_concepts(spark, sf))


def _concepts(spark, sf):
    m = _memory_json(spark, sf)
    i = F.col("item_id").cast("string")
    c = F.struct(
        F.concat(F.lit("x"), i).alias("id"), F.lit("n").alias("name"), "created", "stage", "due", "stability", "difficulty", "reps", "last",
        F.array(F.struct(F.concat(F.lit("P"), i).alias("paper"), F.col("learner_id").cast("string").alias("title"))).alias("sources"),
        F.array(F.struct(F.lit("Why?").alias("prompt"), F.array(F.lit("a")).alias("options"))).alias("questions"),
    )
    f = m.groupBy("learner_id").agg(F.to_json(F.collect_list(c)).alias("json"))
    return B.read_concepts(f, now())


def _shown(r):
    q = F.transform("questions", lambda q: F.concat_ws(":", q["prompt"], F.size(q["options"]).cast("string"), q["correct"].cast("string")))
    return r.select("learner_id", "concept_id", "memory.stage", "memory.reps", "background", F.concat(F.col("sources")[0]["paper_id"], F.lit("@"), F.col("sources")[0]["title"]).alias("source"), F.array_join(q, ",").alias("questions"))


@R.add("concepts_written", R.sql["concepts_read"])
def concepts_written(spark, sf):
    """Ideas written as JSON and read back."""
    return _shown(B.read_concepts(B.write_concepts(_concepts(spark, sf)), now()))


@R.add("help_log_read", """SELECT conv_id, turn, text AS question, '' AS answer, CAST(turn AS INTEGER) AS segment, CASE WHEN turn % 2 = 0 THEN 'E1' END AS about, len(text) % 3 AS n_next FROM conversations""")
def help_log_read(spark, sf):
    """Questions and answers as JSON read back."""
    c = views.texts(spark, sf, "conversations")
    n = F.length("text") % 3
    t = F.struct(F.col("text").alias("q"), F.col("turn").alias("segment"), F.when(F.col("turn") % 2 == 0, "E1").alias("about"), F.when(n > 0, F.array_repeat(F.lit("x"), n)).alias("next"), F.lit("2024-01-01").alias("utc"))
    f = c.select(F.col("conv_id").alias("paper_id"), "turn", F.to_json(F.array(t)).alias("json"))
    r = B.read_help_log(f.withColumn("paper_id", F.struct("paper_id", "turn")), now())
    return r.select("paper_id.paper_id", "paper_id.turn", "question", "answer", "segment", "about", F.size("followups").alias("n_next")).withColumnRenamed("paper_id", "conv_id")


@R.add("figure_notes_read", "SELECT page_id, 'Fig' || page_id AS visual_id, url AS note FROM pages UNION ALL SELECT page_id, 'Tab1', 'n' FROM pages WHERE page_id % 3 > 0")
def figure_notes_read(spark, sf):
    """Figure descriptions as JSON maps; a broken file gives nothing."""
    p = views.table(spark, sf, "pages")
    m = F.when(F.col("page_id") % 3 > 0, F.create_map(F.concat(F.lit("Fig"), F.col("page_id").cast("string")), F.col("url"), F.lit("Tab1"), F.lit("n"))).otherwise(F.create_map(F.concat(F.lit("Fig"), F.col("page_id").cast("string")), F.col("url")))
    return B.read_figure_notes(p.select(F.col("page_id").alias("paper_id"), F.to_json(m).alias("json"))).select(F.col("paper_id").alias("page_id"), "visual_id", "note")


@R.add("progress_read", f"""WITH {Q.EV} SELECT event_id, 'x' || (k % 4) AS link, CASE k % 5 WHEN 0 THEN 'learned' WHEN 1 THEN 'tested out' WHEN 2 THEN 'known' WHEN 3 THEN 'refreshed' ELSE 'learned' END AS outcome, k % 3 AS recap,
  CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS heard, 0 AS n_teach FROM ev""")
def progress_read(spark, sf):
    """Progress files; unknown outcomes are learned, missing fields empty."""
    e = views.events(spark, sf)
    name = F.element_at(F.array(*[F.lit(x) for x in ("learned", "testedOut", "known", "refreshed", "other")]), F.col("k") % 5 + 1)
    j = F.struct(F.create_map(F.lit("c1"), F.concat(F.lit("x"), (F.col("k") % 4).cast("string"))).alias("links"), F.create_map(F.lit("c1"), name).alias("done"), F.array(F.col("k") % 3, F.col("k") % 3).alias("recaps"),
                 F.when(F.col("k") % 2 == 0, F.col("k")).alias("heard"))
    p = B.read_progress(e.select(F.col("event_id").alias("learner_id"), F.lit(1).alias("paper_id"), F.to_json(j).alias("json")), now())
    return p.select(F.col("learner_id").alias("event_id"), F.col("links")["c1"].alias("link"), F.col("done")["c1"].alias("outcome"), F.col("recaps")[0].alias("recap"), "heard", F.size("teach").alias("n_teach"))


@R.add("ocr_read", f"""SELECT l_orderkey AS doc_id, count(*) AS blocks, round(sum(l_quantity), 4) AS x0, round(sum(l_discount), 4) AS y0, max('t' || l_partkey) AS last_content FROM lineitem GROUP BY l_orderkey""")
def ocr_read(spark, sf):
    """OCR responses (an order each) to blocks; the pages and images tables come from the same read."""
    li = views.table(spark, sf, "lineitem")
    b = F.struct(F.lit("text").alias("type"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("content"), F.col("l_quantity").alias("top_left_x"), F.col("l_discount").alias("top_left_y"))
    page = F.struct(F.lit(0).alias("index"), F.lit("m").alias("markdown"), F.collect_list(b).alias("blocks"))
    r = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.to_json(F.struct(F.array(page).alias("pages"))).alias("json"))
    blocks = V.read_ocr(r)[1]
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.round(F.sum("x0"), 4).alias("x0"), F.round(F.sum("y0"), 4).alias("y0"), F.max("content").alias("last_content"))


def _work_json(spark, sf):
    d = views.texts(spark, sf, "documents")
    i = F.col("doc_id").cast("string")
    m = F.col("doc_id") % 4
    place = lambda pdf, page, name: F.struct(pdf.alias("pdf_url"), page.alias("landing_page_url"), F.struct(name.alias("display_name")).alias("source"))
    none = F.lit(None).cast("string")
    words = F.filter(F.split(F.substring("text", 1, 60), r"\s+"), lambda x: x != "")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, j: F.when(x == w, j)), lambda j: j.isNotNull()))))
    w = F.struct(
        F.concat(F.lit("https://openalex.org/W"), i).alias("id"), F.when(m != 3, F.concat(F.lit("https://doi.org/10.1234/x"), i)).alias("doi"), F.concat(F.lit("A <i>Title</i>\n "), i).alias("title"),
        F.col("n_chars").alias("cited_by_count"), F.array(F.struct(F.struct(F.col("source").alias("display_name")).alias("author"))).alias("authorships"),
        place(none, F.lit("https://pub.org/p"), F.when(m == 1, F.lit("Venue"))).alias("primary_location"), place(F.when(m == 0, F.concat(F.lit("https://pub.org/"), i, F.lit(".pdf"))), F.lit("https://best.org/p"), F.col("source")).alias("best_oa_location"),
        F.array(place(F.when(m == 1, F.lit("https://z.org/a")), F.when(m == 2, F.concat(F.lit("https://arxiv.org/abs/1706."), F.lpad(i, 5, "0"), F.lit("v2"))), none)).alias("locations"), index.alias("abstract_inverted_index"),
    )
    return d.select("doc_id", F.to_json(w).alias("json"))


@R.add("openalex_read", """SELECT doc_id, 'W' || doc_id AS key, 'A Title ' || doc_id AS title, source AS author, CAST(n_chars AS INTEGER) AS citations, CASE doc_id % 4 WHEN 0 THEN 'https://pub.org/' || doc_id || '.pdf' WHEN 1 THEN 'https://z.org/a'
  ELSE 'https://arxiv.org/pdf/1706.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') END AS pdfs, CASE WHEN doc_id % 4 = 1 THEN 'Venue' ELSE source END AS venue, 'https://doi.org/10.1234/x' || doc_id AS page,
  CASE WHEN doc_id % 4 = 2 THEN '1706.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') END AS arxiv, array_to_string(list_filter(regexp_split_to_array(left(text, 60), '\\s+'), lambda x: x <> ''), ' ') AS abstract
FROM documents WHERE doc_id % 4 <> 3""")
def openalex_read(spark, sf):
    """Works with a free PDF from JSON records."""
    w = V.read_openalex(_work_json(spark, sf))
    return w.select("doc_id", "key", "title", F.col("authors")[0].alias("author"), "citations", F.array_join("pdfs", "|").alias("pdfs"), "venue", "page", "arxiv", "abstract")


@R.add("s2_read", """SELECT doc_id, 'S2:' || doc_id AS key, 'T ' || doc_id AS title, CASE doc_id % 4 WHEN 1 THEN 'https://x.org/f.pdf' ELSE 'https://arxiv.org/pdf/1706.' || doc_id END AS pdfs,
  CASE doc_id % 4 WHEN 0 THEN 'https://doi.org/10.5/' || doc_id WHEN 1 THEN 'u' ELSE 'https://arxiv.org/abs/1706.' || doc_id END AS page, CASE doc_id % 4 WHEN 1 THEN source ELSE 'arXiv' END AS venue FROM documents WHERE doc_id % 4 <> 3""")
def s2_read(spark, sf):
    """Works of the second provider; links to doi.org are no files."""
    d = views.texts(spark, sf, "documents")
    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    p = F.struct(
        i.alias("paperId"), F.concat(F.lit("T  "), i).alias("title"), F.when(m == 1, F.col("source")).alias("venue"), F.lit("u").alias("url"),
        F.struct(F.when((m == 0) | (m == 2), F.concat(F.lit("1706."), i)).alias("ArXiv"), F.when(m == 0, F.concat(F.lit("10.5/"), i)).alias("DOI")).alias("externalIds"),
        F.struct(F.when(m == 1, F.lit("https://x.org/f.pdf")).when(m == 3, F.lit("https://doi.org/10.5/z")).alias("url")).alias("openAccessPdf"),
    )
    w = V.read_s2(d.select("doc_id", F.to_json(p).alias("json")))
    return w.select("doc_id", "key", "title", F.array_join("pdfs", "|").alias("pdfs"), "page", "venue")


@R.add("arxiv_read", """SELECT doc_id, 'arXiv:1706.' || doc_id AS key, 'Title ' || doc_id AS title, 'A B|' || source AS authors, 2000 + doc_id % 20 AS year, 'We do it.' AS abstract FROM documents WHERE doc_id % 6 <> 5""")
def arxiv_read(spark, sf):
    """The first Atom entry; a feed without one gives nothing."""
    d = views.texts(spark, sf, "documents")
    i = F.col("doc_id").cast("string")
    entry = F.concat(
        F.lit("<entry><title>Title\n  "), i, F.lit("</title><summary> We  do it. </summary><published>"), (2000 + F.col("doc_id") % 20).cast("string"), F.lit("-01-02T00:00:00Z</published><author><name>A B</name></author><author><name>"),
        F.col("source"), F.lit("</name></author></entry>"),
    )
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.when(F.col("doc_id") % 6 == 5, "<id>x</id>").otherwise(entry), F.lit("</feed>"))
    a = V.read_arxiv(d.select("doc_id", F.concat(F.lit("1706."), i).alias("arxiv"), xml.alias("xml")))
    return a.select("doc_id", "key", "title", F.array_join("authors", "|").alias("authors"), "year", "abstract")


_CARDS = r"""concat('Here:\n```json\n', CASE WHEN conv_id % 2 = 0 THEN '[' ELSE '{"cards": [' END, '{"front": "What is ', turn % 3, '?", "back": "b", "show": "[E', turn % 3, ']", "showOn": "front", "section": ', turn % 4, '}, {"front": "what is ', turn % 3, '", "back": "again"},
  {"front": "Known?", "back": "x"}, {"front": "No back", "back": ""}, {"front": "F ', conv_id, '", "back": "y", "section": "none", "show": "none"}', CASE WHEN conv_id % 2 = 0 THEN ']' ELSE ']}' END, '\n```\n')"""


@R.add("cards_parsed", """WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'paper' ELSE 'moment' END AS origin, turn * 3 AS position FROM conversations),
c AS (SELECT conv_id, turn, 0 AS ord, 'What is ' || (turn % 3) || '?' AS front, CASE WHEN turn % 3 > 0 THEN 'E' || (turn % 3) END AS visual, turn % 4 AS section, origin, position FROM r
  UNION ALL SELECT conv_id, turn, 4, 'F ' || conv_id, NULL, NULL, origin, position FROM r),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, front ORDER BY turn, ord) = 1)
SELECT conv_id, front, visual, visual IS NOT NULL AS visual_on_front, greatest(0, least(CASE WHEN section IN (1, 2) THEN section * 10 WHEN origin = 'paper' AND visual IS NOT NULL THEN 7 ELSE position END, 15)) AS segment FROM f""")
def cards_parsed(spark, sf):
    """Cards of every turn's reply; a conversation is a paper with sections 1 and 2, visuals E1 and E2."""
    c = views.texts(spark, sf, "conversations")
    r = c.select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("reply_id"), F.when(F.col("turn") % 2 == 0, "paper").otherwise("moment").alias("origin"), (F.col("turn") * 3).alias("position"), F.expr(_CARDS).alias("text"))
    p = r.select("paper_id").distinct()
    visuals = p.select("paper_id", F.explode(F.array(F.lit("E1"), F.lit("E2"))).alias("visual_id"))
    sections = p.select("paper_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("section")).withColumn("first_segment", F.col("section") * 10)
    existing = p.withColumn("front", F.lit("KNOWN"))
    k = review.parse_cards(r, existing, visuals, sections, visuals.withColumn("first_segment", F.lit(7)), p.withColumn("last", F.lit(15)), now())
    return k.select(F.col("paper_id").alias("conv_id"), "front", "visual", "visual_on_front", F.col("segment").cast("long").alias("segment"))


@R.add("cards_so_far", "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 3 ELSE 5 END AS cards FROM conversations")
def cards_so_far(spark, sf):
    """Cards in replies still arriving."""
    text = F.expr(_CARDS)
    cut = F.when(F.col("conv_id") % 3 == 0, F.substring_index(text, '"Known?', 1)).otherwise(text)
    return views.texts(spark, sf, "conversations").select("conv_id", "turn", Y.cards_so_far(cut).cast("int").alias("cards"))


@R.add("known_ideas", Q.rec(Q.MEMORY, f"""SELECT learner_id, 'x' || item_id AS concept_id, 'name ' || item_id AS sort_name, CAST(round_even(100 * pow(1.0::DOUBLE + (pow(0.9::DOUBLE, -2.0::DOUBLE) - 1.0::DOUBLE) * greatest(0, (epoch_us(TIMESTAMP '{Q.NOW}') - last_us) / 86400000000.0::DOUBLE) / s, -0.5::DOUBLE), 0) AS INTEGER) AS percent,
  CASE WHEN (CASE WHEN stage = 'Review' THEN due // 86400000000 <= epoch_us(TIMESTAMP '{Q.NOW}') // 86400000000 ELSE due <= epoch_us(TIMESTAMP '{Q.NOW}') END) THEN 'review due' END AS due_now,
  'from P' || (learner_id % 7) || CASE WHEN item_id > 0 THEN ' and ' || item_id || ' more' ELSE '' END AS origin FROM memory WHERE stage <> 'New'"""))
def known_ideas(spark, sf):
    """Ideas a learner has studied, as listed."""
    m = memory.unpack(memory.replay(views.reviews(spark, sf)))
    src = F.transform(F.sequence(F.lit(0), F.col("item_id")), lambda i: F.struct(F.concat(F.lit("P"), ((F.col("learner_id") + i) % 7).cast("string")).alias("title")))
    c = m.select("learner_id", F.concat(F.lit("x"), F.col("item_id").cast("string")).alias("concept_id"), F.concat(F.lit("Name "), F.col("item_id").cast("string")).alias("name"), "stage", "due", "stability", "last_review", src.alias("sources"))
    k = review.known_list(c, now())
    return k.withColumn("due_now", F.when(F.col("next") == "review due", F.col("next"))).drop("next")
