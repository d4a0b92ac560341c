"""Text rules and document structure (B1–B22, N1, N18, H7, P17) over `documents` and `conversations`.

The test documents have no citations, formulas, headings or page breaks, so some queries add them to every document by
`concat`, in the same way in the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.operators import structure as S
from studyloom.plans import views
from studyloom.queries.registry import Registry
from studyloom.session import cut_lineage

R = Registry()


def docs(spark, sf):
    return views.texts(spark, sf, "documents").select("doc_id", "text")


def lines(spark, sf):
    return S.lines_of(docs(spark, sf), "doc_id", "text")


LINES = """lines AS (
  SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS ord FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))"""


def sql_tidy(c: str) -> str:
    t = f"ltrim(regexp_replace({c}, '[\\p{{Z}}\\s]+', ' ', 'g'))"
    for _ in range(2):
        t = f"regexp_replace({t}, '(^|[^.])\\.\\.([^.]|$)', '\\1.\\2', 'g')"
    for a, b in ((" ,", ","), (" .", "."), (" ;", ";"), (" :", ":"), ("( ", "("), (" )", ")")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim({t})"


# of the characters whose plain form is longer, those that the derived texts hold
_MANY = "ﬁﬂ…"


def sql_fold(c: str) -> str:
    src, dst = (x.replace("'", "''") for x in T.fold_tables())
    t = f"translate({c}, '{src}', '{dst}')"
    for a, b in T.fold_many().items():
        if a in _MANY:
            t = f"replace({t}, '{a}', '{b}')"
    return t


def sql_citations(c: str) -> str:
    t = f"regexp_replace({c}, '\\s?\\[\\s*\\d+[a-z]?(\\s*[,–—-]\\s*\\d+[a-z]?)*\\s*\\]', '', 'g')"
    t = f"regexp_replace({t}, '\\s?\\(\\s*(?:19|20)\\d{{2}}[a-z]?(\\s*[,;]\\s*(?:19|20)\\d{{2}}[a-z]?)*\\s*\\)', '', 'g')"
    return f"regexp_replace({t}, '\\s?\\((?:see |e\\.g\\.,? |cf\\. )?[^()=]{{0,160}}?\\b(?:19|20)\\d{{2}}[a-z]?\\)', '', 'g')"


def sql_speech(c: str) -> str:
    t = sql_citations(sql_fold(c))
    t = f"regexp_replace({t}, '(https?://|www\\.)\\S+', 'a link', 'g')"
    for pattern, words in T.ABBREVIATIONS:
        p = pattern.replace("\\b", "(^|[^\\p{L}\\p{M}\\p{N}_])", 1)
        t = f"regexp_replace({t}, '{p}', '\\1{words.replace('$1', chr(92) + '2')}', 'g')"
    t = f"regexp_replace({t}, '([\\p{{L}}\\p{{M}}\\p{{N}}_])- ([\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1-\\2', 'g')"
    return sql_tidy(t)


_MARKED = "concat(' ( see )  ..  ', text, ' ,  end ; ( x ) .')"


@R.add("text_tidy", f"""SELECT doc_id, md5({sql_tidy(_MARKED)}) AS tidied, md5(trim(regexp_replace(replace(text, 'a', chr(173) || 'a'), '[{chr(0xAD)}]', '', 'g'))) AS plain
FROM documents""")
def text_tidy(spark, sf):
    """Spacing mended; soft hyphens dropped."""
    d = docs(spark, sf)
    soft = F.regexp_replace(F.replace("text", F.lit("a"), F.lit("­a")), "­", "")
    return d.select("doc_id", F.md5(T.tidy(F.expr(_MARKED))).alias("tidied"), F.md5(F.trim(soft)).alias("plain"))


_FANCY = "concat('𝑥ᵢ + 𝜃 ﬁnd ﬂow 𝐖₁𝐱 + 𝒃² … 𝟘𝟙 ', text)"


@R.add("text_fold", f"SELECT doc_id, {sql_fold(_FANCY)} AS folded FROM documents")
def text_fold(spark, sf):
    """Presentation forms as plain characters."""
    return docs(spark, sf).select("doc_id", T.fold(F.expr(_FANCY)).alias("folded"))


_CITED = "concat('Deep nets [12, 14] work (He et al., 2016) well (2016; 2017), e.g. ResNets (a = 2016); ', text, ' (see Lee, 2020a) see Fig. 3 and Eq. 2. Low- rank, No. 5, www.x.org/a cf. it.')"


@R.add("citations_stripped", f"SELECT doc_id, {sql_citations(_CITED)} AS stripped FROM documents")
def citations_stripped(spark, sf):
    """Citation marks removed."""
    return docs(spark, sf).select("doc_id", T.strip_citations(F.expr(_CITED)).alias("stripped"))


@R.add("speech_text", f"SELECT doc_id, {sql_speech(_CITED)} AS spoken FROM documents")
def speech_text(spark, sf):
    """Texts as they are said."""
    return docs(spark, sf).select("doc_id", T.for_speech(F.expr(_CITED)).alias("spoken"))


_NO_SPLIT = ", ".join(f"'{w}'" for w in T.NO_SPLIT_AFTER)


def sentences_cte(source: str, key: str) -> str:
    """sentences(key…, s_ord, sentence) of source(key…, text) in DuckDB. A formula is within one word, its spaces are marked."""
    masked = """array_to_string(list_transform(regexp_extract_all(text, '(?s)\\$\\$.+?\\$\\$|\\$[^$]+?\\$|[^$]+|\\$'),
      lambda p: CASE WHEN starts_with(p, '$') AND length(p) > 1 THEN translate(p, concat(' ', chr(10), chr(9), chr(13)), repeat(chr(57345), 4)) ELSE p END), '')"""
    return f"""words AS (
  SELECT {key}, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
    SELECT {key}, list_filter(regexp_split_to_array({masked}, '[ \\n\\t\\r]+'), lambda x: x <> '') AS w FROM {source})),
ends AS (
  SELECT {key}, w, i, CASE WHEN nxt IS NULL OR NOT regexp_matches(wt, '[.?!]$') THEN 0
      WHEN lower(ltrim(wt, '([“"')) IN ({_NO_SPLIT}) THEN 0
      WHEN length(wt) = 2 AND regexp_matches(wt, '^\\p{{Lu}}') THEN 0
      WHEN regexp_matches(ltrim(nxt, '("“‘['), '^(\\p{{Lu}}|[^\\p{{L}}]|$)') THEN 1 ELSE 0 END AS e
  FROM (SELECT *, lead(w) OVER (PARTITION BY {key} ORDER BY i) AS nxt, rtrim(w, ')"”’]') AS wt FROM words)),
base AS (
  SELECT *, row_number() OVER (PARTITION BY {key}, base ORDER BY i) AS p FROM (
    SELECT *, coalesce(sum(e) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM ends)),
cand AS (SELECT {key}, base, p FROM base WHERE regexp_matches(w, '[;,]$') AND p >= 70),
cuts AS (
  SELECT DISTINCT {key}, base, CAST(0 AS BIGINT) AS last FROM cand
  UNION ALL
  SELECT {", ".join("c." + k.strip() for k in key.split(","))}, c.base, min(k.p) FROM cuts c JOIN cand k
    ON {" AND ".join(f"k.{x.strip()} = c.{x.strip()}" for x in key.split(","))} AND k.base = c.base AND k.p >= c.last + 70
  GROUP BY ALL),
parts AS (
  SELECT {", ".join("b." + k.strip() for k in key.split(","))}, b.base, b.w, b.i, count(c.last) AS part FROM base b LEFT JOIN cuts c
    ON {" AND ".join(f"b.{x.strip()} = c.{x.strip()}" for x in key.split(","))} AND b.base = c.base AND c.last > 0 AND c.last < b.p
  GROUP BY ALL),
sentences AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY base, part) - 1 AS s_ord, {sql_tidy("s")} AS sentence FROM (
    SELECT {key}, base, part, replace(string_agg(w, ' ' ORDER BY i), chr(57345), ' ') AS s FROM parts GROUP BY ALL) WHERE {sql_tidy("s")} <> '')"""


@R.add("document_sentences", f"WITH RECURSIVE {LINES},\n{sentences_cte('lines', 'doc_id, ord')}\nSELECT doc_id, ord, s_ord, sentence FROM sentences")
def document_sentences(spark, sf):
    """The sentences of every line of every document."""
    return S.block_sentences(lines(spark, sf))


_BOOK = r"""concat('by nobody\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n', CASE WHEN doc_id % 2 = 0 THEN replace(text, '\n', '\n\n') ELSE text END,
  CASE WHEN doc_id % 2 = 0 THEN '\n\nCHAPTER ONE\n\nIt was a dark and\nstormy night; tor-\nrents fell.\n\nTHE SECOND TITLE\n\n1.2 Method of things\n\n* * *\n\nchapter two\n\n' ELSE '\nchapter two\n' END,
  CASE WHEN doc_id % 3 = 0 THEN concat(chr(12), 'PAGE TWO\n') ELSE '' END, text, '\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nlicence')"""
_BOOK_DUCK = "(" + _BOOK.replace("'by nobody", "E'by nobody").replace("'\\n", "E'\\n").replace("'PAGE", "E'PAGE") + ")"

BOOK_BLOCKS = f"""book AS (SELECT doc_id, {_BOOK_DUCK} AS t0 FROM documents),
body AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t0, '(?is)^.*?\\n\\*\\*\\* START OF THE PROJECT GUTENBERG[^\\n]*', ''), '(?is)\\n\\*\\*\\* END OF THE PROJECT GUTENBERG.*$', chr(10)), chr(12)) AS pages FROM book),
pages AS (SELECT doc_id, unnest(pages) AS page, generate_subscripts(pages, 1) AS pg FROM body),
paras AS (SELECT doc_id, pg, blank, unnest(l) AS para, generate_subscripts(l, 1) AS i FROM (
  SELECT doc_id, pg, regexp_matches(page, '\\n[ \\t]*\\n') AS blank, list_filter(list_transform(
    CASE WHEN regexp_matches(page, '\\n[ \\t]*\\n') THEN regexp_split_to_array(page, '\\n[ \\t]*\\n') ELSE string_split(page, chr(10)) END,
    lambda x: trim(x, E' \\n\\t')), lambda x: x <> '') AS l FROM pages)),
joined AS (SELECT *, trim(replace(regexp_replace(regexp_replace(para, '\\s*\\n\\s*', chr(10), 'g'), '(\\p{{L}})-\\n(\\p{{Ll}})', '\\1\\2', 'g'), chr(10), ' ')) AS t,
  lead(length(para)) OVER (PARTITION BY doc_id, pg ORDER BY i) AS nxt FROM paras),
looks AS (SELECT *, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters,
  length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= 3 AND length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) = length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS caps,
  regexp_matches(t, '^(chapter|part|book|section|prologue|epilogue|preface|introduction|conclusion|appendix|contents|foreword|afterword)([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)') AS chap,
  NOT regexp_matches(t, '[.,;:!?"”’)]$') AS no_end, regexp_matches(t, '^(\\d{{1,2}}(\\.\\d{{1,2}}){{0,3}}\\.?|[IVXLC]{{1,6}}\\.)\\s+\\S') AS numbered FROM joined),
kinds AS (SELECT *, NOT contains(para, chr(10)) AND length(t) <= 80 AND letters > 0 AND ((chap AND length(t) <= 60) OR (no_end AND (caps OR numbered) AND blank)
  OR (no_end AND coalesce(nxt, 0) > 150 AND blank AND regexp_matches(t, '^\\p{{Lu}}') AND length(t) - length(replace(t, ' ', '')) <= 9)) AS heading FROM looks),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pg, i) - 1 AS ord, kind, level, text FROM (
  SELECT doc_id, pg, 0 AS i, 'break' AS kind, NULL AS level, '' AS text FROM pages WHERE pg > 1
  UNION ALL
  SELECT doc_id, pg, i, CASE WHEN heading THEN 'heading' ELSE 'paragraph' END, CASE WHEN heading THEN CASE WHEN chap OR caps THEN 1 ELSE 2 END END,
    CASE WHEN heading AND caps THEN array_to_string(list_transform(regexp_extract_all(lower(t), '[\\p{{L}}''’]+|[^\\p{{L}}''’]+'), lambda r: upper(r[1]) || r[2:]), '') ELSE t END
  FROM kinds WHERE heading OR NOT regexp_matches(t, '^[^\\p{{L}}\\p{{M}}\\p{{N}}]+$')))"""


def books(spark, sf):
    return docs(spark, sf).select("doc_id", F.expr(_BOOK).alias("text"))


def book_blocks(spark, sf):
    return S.text_blocks(books(spark, sf))


@R.add("text_blocks", f"WITH {BOOK_BLOCKS} SELECT doc_id, ord, kind, level, text FROM blocks")
def text_blocks(spark, sf):
    """B1, B2: headings, paragraphs and page breaks of plain texts inside licence markers."""
    return book_blocks(spark, sf)


@R.add("page_numbers", f"""WITH {BOOK_BLOCKS} SELECT b.doc_id, ord, CAST(CASE WHEN p.doc_id IS NULL
  THEN coalesce(sum(length(text)) OVER (PARTITION BY b.doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 3000
  ELSE coalesce(sum(CASE WHEN kind = 'break' AND ord > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY b.doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS BIGINT) AS page
FROM blocks b LEFT JOIN (SELECT DISTINCT doc_id FROM blocks WHERE kind = 'break') p ON p.doc_id = b.doc_id""")
def page_numbers(spark, sf):
    """Pages by breaks, or by 3000 characters."""
    return S.paginate(cut_lineage(book_blocks(spark, sf))).select("doc_id", "ord", "page")


@R.add("section_numbers", f"""WITH {BOOK_BLOCKS} SELECT doc_id, ord,
  CAST(sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS section FROM blocks
WHERE TRUE""")
def section_numbers(spark, sf):
    """Section of every block (no block repeats the title "A title")."""
    return S.sectionize(cut_lineage(book_blocks(spark, sf)), F.lit("A title")).select("doc_id", "ord", "section")


@R.add("document_titles", f"""WITH {BOOK_BLOCKS} SELECT doc_id, CASE WHEN kind = 'heading' OR (kind = 'paragraph' AND length(text) <= 100 AND NOT text LIKE '%.') THEN text END AS title
FROM blocks WHERE ord = 0""")
def document_titles(spark, sf):
    """A first line standing alone is the title."""
    return S.document_title(book_blocks(spark, sf))


@R.add("readable_documents", f"""WITH RECURSIVE {LINES}, {sentences_cte("lines", "doc_id, ord")}
SELECT doc_id, count(*) AS sentences, count(*) AS units FROM sentences GROUP BY doc_id HAVING count(*) >= 3""")
def readable_documents(spark, sf):
    """Documents with at least three sentences."""
    u = S.block_sentences(lines(spark, sf)).withColumn("kind", F.lit("sentence"))
    return S.readable(u, min_sentences=3)


def _headed(d):
    n = F.length("text")
    return d.select(
        "doc_id", "ord",
        F.when(F.col("ord") % 5 == 0, "heading").when(n % 11 == 3, "break").otherwise("paragraph").alias("kind"),
        F.when(F.col("ord") % 5 == 0, 1 + n % 3).alias("level"),
        F.when((F.col("ord") % 5 == 0) & (n % 4 == 1), "2. References:").otherwise(F.col("text")).alias("text"),
    )


_HEADED = LINES + """,
headed AS (SELECT doc_id, ord, CASE WHEN ord % 5 = 0 THEN 'heading' WHEN length(text) % 11 = 3 THEN 'break' ELSE 'paragraph' END AS kind,
  CASE WHEN ord % 5 = 0 THEN 1 + length(text) % 3 END AS level, ord % 5 = 0 AND length(text) % 4 = 1 AS ref FROM lines),
walk AS (
  SELECT doc_id, ord, kind, CASE WHEN ref THEN level END AS skip, NOT ref AS keep FROM headed WHERE ord = 0
  UNION ALL
  SELECT h.doc_id, h.ord, h.kind,
    CASE WHEN h.ref THEN h.level WHEN h.kind = 'heading' AND w.skip IS NOT NULL AND h.level <= w.skip THEN NULL ELSE w.skip END,
    NOT h.ref AND (w.skip IS NULL OR h.kind = 'break' OR (h.kind = 'heading' AND h.level <= w.skip))
  FROM walk w JOIN headed h ON h.doc_id = w.doc_id AND h.ord = w.ord + 1)"""


@R.add("references_dropped", f"WITH RECURSIVE {_HEADED} SELECT doc_id, ord, kind FROM walk WHERE keep")
def references_dropped(spark, sf):
    """Blocks without reference lists; lines get heading levels and reference headings by their length."""
    return S.drop_references(_headed(lines(spark, sf))).select("doc_id", "ord", "kind")


_N = "length(text) % 6"
_CAPTIONED = f"""CASE {_N} WHEN 2 THEN concat('Figure ', ord, ': ', text) WHEN 3 THEN concat('Table ', ord, '. ', text) ELSE text END"""
_KIND = f"CASE {_N} WHEN 0 THEN 'image' WHEN 1 THEN 'table' WHEN 4 THEN 'table' ELSE 'paragraph' END"


@R.add("captions_attached", f"""WITH RECURSIVE {LINES},
b AS (SELECT doc_id, ord, {_KIND} AS kind, {_CAPTIONED} AS text, CASE {_N} WHEN 0 THEN 'f' WHEN 1 THEN 't' WHEN 4 THEN 't' END AS vis,
  CASE {_N} WHEN 2 THEN 'f' WHEN 3 THEN 't' END AS cap FROM lines),
n AS (SELECT *, lag(cap) OVER w AS up, lead(cap) OVER w AS down FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
walk AS (
  SELECT *, FALSE AS gone, CASE WHEN vis IS NOT NULL AND down = vis THEN 'down' END AS took, FALSE AS took_before FROM n WHERE ord = 0
  UNION ALL
  SELECT n.doc_id, n.ord, n.kind, n.text, n.vis, n.cap, n.up, n.down, coalesce(w.took = 'down', FALSE),
    CASE WHEN n.vis = 'f' AND n.down = 'f' THEN 'down' WHEN n.vis = n.up AND NOT w.gone THEN 'up' WHEN n.vis = n.down THEN 'down' END,
    FALSE
  FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.ord = w.ord + 1),
around AS (SELECT *, lead(took) OVER w AS next_took, lag(text) OVER w AS up_text, lead(text) OVER w AS down_text FROM walk WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord, kind, CASE took WHEN 'down' THEN down_text WHEN 'up' THEN up_text ELSE '' END AS caption
FROM around WHERE NOT (cap IS NOT NULL AND (gone OR coalesce(next_took = 'up', FALSE)))""")
def captions_attached(spark, sf):
    """Pictures and tables take neighbouring captions; kinds and captions come from the lines' lengths."""
    b = lines(spark, sf).select(
        "doc_id", "ord", F.expr(_KIND).alias("kind"), F.expr(_CAPTIONED).alias("text"), F.lit("").alias("caption")
    )
    return S.attach_captions(b, bounded=True).select("doc_id", "ord", "kind", "caption")


@R.add("images_resolved", f"""WITH {LINES}, b AS (SELECT doc_id, ord, length(text) % 3 = 0 AS img, 'img' || (length(text) % 25) AS src,
  CASE WHEN length(text) % 2 = 0 THEN 'cap ' || ord ELSE '' END AS caption, text FROM lines),
f AS (SELECT 'img' || n_nationkey AS url FROM nation WHERE n_nationkey % 3 <> 0)
SELECT doc_id, ord, CASE WHEN img AND url IS NOT NULL THEN 'image' ELSE 'paragraph' END AS kind,
  CASE WHEN img AND url IS NULL THEN caption WHEN img THEN '' ELSE text END AS text
FROM b LEFT JOIN f ON f.url = b.src WHERE NOT (img AND url IS NULL AND caption = '')""")
def images_resolved(spark, sf):
    """Links resolved against a table of fetched pictures."""
    n = F.length("text")
    b = lines(spark, sf).select(
        "doc_id", "ord", F.when(n % 3 == 0, "image").otherwise("paragraph").alias("kind"),
        F.concat(F.lit("img"), (n % 25).cast("string")).alias("src"),
        F.when(n % 2 == 0, F.concat(F.lit("cap "), F.col("ord").cast("string"))).otherwise("").alias("caption"),
        F.when(n % 3 == 0, "").otherwise(F.col("text")).alias("text"),
    )
    fetched = views.table(spark, sf, "nation").select(
        F.concat(F.lit("img"), F.col("n_nationkey").cast("string")).alias("url"), (F.col("n_nationkey") % 3 != 0).alias("ok")
    )
    return S.resolve_images(b, fetched).select("doc_id", "ord", "kind", "text")


_CAP = "concat(CASE ord % 5 WHEN 0 THEN 'Figure 3a: ' WHEN 1 THEN '**Fig. A2. ' WHEN 2 THEN 'TABLE 4 | ' WHEN 3 THEN 'Figures 3: ' ELSE '' END, text)"


@R.add("caption_ids", f"""WITH {LINES} SELECT doc_id, ord, CASE WHEN regexp_matches({_CAP}, '(?i)^[^\\p{{L}}\\p{{N}}_]*(Figure|Fig\\.?|Table)\\s*([A-Z]?\\d+[a-z]?)\\s*[:.|]')
  THEN CASE WHEN ord % 5 = 2 THEN 'Tab' ELSE 'Fig' END || regexp_extract({_CAP}, '(?i)^[^\\p{{L}}\\p{{N}}_]*(Figure|Fig\\.?|Table)\\s*([A-Z]?\\d+[a-z]?)', 2) END AS visual_id,
  ord % 5 IN (0, 1, 2) AS is_caption FROM lines""")
def caption_ids(spark, sf):
    """Visual ids of caption lines."""
    c = F.expr(_CAP)
    return lines(spark, sf).select("doc_id", "ord", T.caption_id(c).alias("visual_id"), T.is_caption(c).alias("is_caption"))


_HEAD = "concat(CASE ord % 5 WHEN 0 THEN '2.1 ' WHEN 1 THEN 'B ' WHEN 2 THEN 'A.2. ' WHEN 3 THEN 'Chapter 3 ' ELSE '' END, text)"


@R.add("heading_speech", f"""WITH {LINES} SELECT doc_id, ord, CASE WHEN ord % 5 IN (0, 1, 2)
  THEN concat(CASE WHEN ord % 5 = 1 THEN 'Appendix ' ELSE 'Section ' END, CASE ord % 5 WHEN 0 THEN '2.1' WHEN 1 THEN 'B' ELSE 'A.2' END, '. ', rtrim(text, '.'), '.')
  WHEN regexp_matches(text, '^(\\d{{1,2}}(\\.\\d{{1,2}})*|[A-Z](\\.\\d{{1,2}})*)\\.?\\s+.') AND ord % 5 = 4 AND NOT regexp_matches(text, '(?i)^(chapter|part|book|section|appendix|lesson|unit|slide)([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')
  THEN concat(CASE WHEN regexp_matches(text, '^[A-Z]\\.?\\s') THEN 'Appendix ' ELSE 'Section ' END, regexp_extract(text, '^(\\d{{1,2}}(\\.\\d{{1,2}})*|[A-Z](\\.\\d{{1,2}})*)\\.?\\s+(.*)$', 1), '. ',
    rtrim(regexp_extract(text, '^(\\d{{1,2}}(\\.\\d{{1,2}})*|[A-Z](\\.\\d{{1,2}})*)\\.?\\s+(.*)$', 4), '.'), '.')
  ELSE rtrim(CASE WHEN ord % 5 = 3 THEN 'Chapter 3 ' || text ELSE text END, '.:') || '.' END AS spoken FROM lines""")
def heading_speech(spark, sf):
    """Headings as they are said."""
    return lines(spark, sf).select("doc_id", "ord", T.heading_spoken(F.expr(_HEAD)).alias("spoken"))


_MATH = "concat('We set $x$, $x_i$ and $$E = mc^2$$ with $\\\\alpha$ or $abcdefgh$ and $a^2$. ', text)"
_MATH_DUCK = _MATH.replace("\\\\", "\\")


@R.add("formula_spans", f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all({_MATH_DUCK}, '(?s)\\$\\$.+?\\$\\$|\\$[^$]+?\\$'), lambda m: trim(regexp_replace(regexp_replace(m, '^\\$\\$?', ''), '\\$\\$?$', ''))), '|') AS spans,
  array_to_string(list_filter(list_transform(regexp_extract_all({_MATH_DUCK}, '(?s)\\$\\$.+?\\$\\$|\\$[^$]+?\\$'), lambda m: trim(regexp_replace(regexp_replace(m, '^\\$\\$?', ''), '\\$\\$?$', ''))),
    lambda m: length(m) > 2 AND (regexp_matches(m, '[\\\\^_=]') OR length(m) > 6))[1:3], '|') AS shown FROM documents""")
def formula_spans(spark, sf):
    """Inline formulas, and the three worth showing."""
    c = F.expr(_MATH)
    return docs(spark, sf).select(
        "doc_id", F.array_join(T.math_spans(c), "|").alias("spans"), F.array_join(T.shown_formulas(c), "|").alias("shown")
    )


def pack_cte(parts: str, key: str, first: int, rest: int, trailing: bool) -> str:
    """clips(key…, n, clip) of parts(key…, i, p): greedy packing; `trailing` counts the space after each part."""
    ks = [k.strip() for k in key.split(",")]
    on = " AND ".join(f"p.{k} = w.{k}" for k in ks)
    cols = ", ".join(f"p.{k}" for k in ks)
    gap = "1" if trailing else "0"
    grow = "w.len + length(p.p) + 1"
    return f"""packed AS (
  SELECT {key}, i, p, 0 AS n, CAST(length(p) + {gap} AS BIGINT) AS len FROM {parts} WHERE i = 1
  UNION ALL
  SELECT {cols}, p.i, p.p, CASE WHEN w.len + length(p.p) > CASE WHEN w.n = 0 THEN {first} ELSE {rest} END THEN w.n + 1 ELSE w.n END,
    CASE WHEN w.len + length(p.p) > CASE WHEN w.n = 0 THEN {first} ELSE {rest} END THEN length(p.p) + {gap} ELSE {grow} END
  FROM packed w JOIN {parts} p ON {on} AND p.i = w.i + 1),
clips AS (SELECT {key}, n, trim(string_agg(p, ' ' ORDER BY i)) AS clip FROM packed GROUP BY {key}, n)"""


@R.add("narration_split", f"""WITH RECURSIVE {LINES},
long AS (SELECT doc_id, ord, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (
  SELECT doc_id, ord, string_split(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM lines WHERE length(text) > 450)),
{pack_cte("long", "doc_id, ord", 400, 400, True)}
SELECT doc_id, ord, n, clip FROM clips UNION ALL SELECT doc_id, ord, 0, text FROM lines WHERE length(text) <= 450""")
def narration_split(spark, sf):
    """Lines over 450 characters as clips of at most 400 where sentences allow."""
    return lines(spark, sf).select("doc_id", "ord", F.posexplode(T.split_long(F.col("text"))).alias("n", "clip"))


def _turns(spark, sf):
    return views.texts(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")


@R.add("lesson_clips", f"""WITH RECURSIVE paras AS (SELECT conv_id, turn, unnest(l) AS t, generate_subscripts(l, 1) AS j FROM (
  SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations WHERE role = 'assistant')),
cut AS (SELECT conv_id, turn, j, unnest(l) AS p, generate_subscripts(l, 1) AS q FROM (
  SELECT conv_id, turn, j, string_split(regexp_replace(t, '([.!?])\\s+(["“(*]?[A-Z0-9$])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM paras)),
parts AS (SELECT conv_id, turn, trim(p) AS p, row_number() OVER (PARTITION BY conv_id, turn ORDER BY j, q) AS i FROM cut WHERE trim(p) <> ''),
{pack_cte("parts", "conv_id, turn", 140, 280, False)}
SELECT conv_id, turn, n, clip FROM clips""")
def lesson_clips(spark, sf):
    """A tutor's turns as clips to say."""
    return _turns(spark, sf).select("conv_id", "turn", F.posexplode(T.lesson_clips(F.col("text"))).alias("n", "clip"))


@R.add("answer_clips", f"""WITH RECURSIVE cut AS (SELECT conv_id, turn, unnest(l) AS p, generate_subscripts(l, 1) AS q FROM (
  SELECT conv_id, turn, string_split(regexp_replace(text, '([.!?:])\\s+([A-Z0-9(“"])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM conversations WHERE role = 'assistant')),
parts AS (SELECT conv_id, turn, trim(p) AS p, row_number() OVER (PARTITION BY conv_id, turn ORDER BY q) AS i FROM cut WHERE trim(p) <> ''),
{pack_cte("parts", "conv_id, turn", 120, 320, False)}
SELECT conv_id, turn, n, clip FROM clips""")
def answer_clips(spark, sf):
    """Answers as clips, a short one first."""
    return _turns(spark, sf).select("conv_id", "turn", F.posexplode(T.answer_clips(F.col("text"))).alias("n", "clip"))


_NOT_TERMS = ", ".join(f"'{t}'" for t in T.NOT_TERMS)


@R.add("document_terms", f"""WITH {LINES}, t AS (SELECT doc_id, ord, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (
  SELECT doc_id, ord, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_-]+'), lambda w:
    regexp_matches(w, '^([A-Z][a-z]+[A-Z][A-Za-z]*|[A-Z]{{2,}}[a-z]?)(-\\d+)?$') AND w NOT IN ({_NOT_TERMS}) AND length(w) <= 24) AS l FROM lines)),
s AS (SELECT doc_id, ord, pos, CASE WHEN regexp_matches(term, '^.{{2,}}\\p{{Lu}}s$') THEN term[:-2] ELSE term END AS term FROM t),
d AS (SELECT doc_id, term, arg_min(ord, (-ord, pos)) AS ord, arg_min(pos, (-ord, pos)) AS pos FROM s GROUP BY ALL)
SELECT doc_id, rank, term FROM (SELECT doc_id, term, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY -ord, pos) AS INTEGER) AS rank FROM d) WHERE rank <= 3""")
def document_terms(spark, sf):
    """H7: the three latest terms of each document."""
    return S.text_terms(lines(spark, sf))


@R.add("speaking_time", "SELECT doc_id, 400 + length(text) * 1000 // 15 AS estimate_ms FROM documents")
def speaking_time(spark, sf):
    """N18."""
    return docs(spark, sf).select("doc_id", T.estimate_ms(F.col("text")).alias("estimate_ms"))
