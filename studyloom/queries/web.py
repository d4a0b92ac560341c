"""Web pages (W1–W10) over `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.functions import web as W
from studyloom.operators import web as O
from studyloom.plans import views
from studyloom.queries.registry import Registry
from studyloom.queries.text import sql_tidy

R = Registry()


def pages(spark, sf):
    return views.texts(spark, sf, "pages")


def sql_strip(h: str) -> str:
    t = f"regexp_replace({h}, '(?s)<!--.*?-->', '', 'g')"
    for tag in (*W.ALWAYS_SKIP, *W.NAVIGATION):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    return f"""regexp_replace({t}, '(?is)<div\\b[^>]*class="ad"[^>]*>.*?</div\\s*>', '', 'g')"""


def sql_decode(c: str) -> str:
    t = c
    for name, ch in W.ENTITIES:
        t = f"replace({t}, '{name}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return t


def sql_plain(h: str) -> str:
    return sql_tidy(sql_decode(f"regexp_replace(regexp_replace({h}, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]*>?', '', 'g')"))


STRIPPED = f"stripped AS (SELECT page_id, url, html, {sql_strip('html')} AS body FROM pages)"


def sql_article(h: str) -> str:
    return f"regexp_extract({h}, '(?is)<article\\b[^>]*>(.*?)(?:</article\\s*>|$)', 1)"


def sql_body(h: str) -> str:
    return f"CASE WHEN regexp_matches({h}, '(?i)<body\\b') THEN regexp_extract({h}, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|$)', 1) ELSE {h} END"


def sql_root(h: str, said: str) -> str:
    """The article or the body of `h`, as `said`, the same page with all its words, decides; an element without an end reaches to the page's."""
    n = f"length({sql_plain(sql_article(said))})"
    return f"CASE WHEN {n} >= 400 OR {n} > 0.3 * greatest(1, length({sql_plain(sql_body(said))})) THEN {sql_article(h)} ELSE {sql_body(h)} END"


ROOT = f"""{STRIPPED},
root AS (SELECT page_id, url, html, {sql_root('body', 'body')} AS root FROM stripped)"""


@R.add("furniture_stripped", f"WITH {STRIPPED} SELECT page_id, length(body) AS chars, md5(body) AS body FROM stripped")
def furniture_stripped(spark, sf):
    """Pages without scripts, menus, ads and other chrome."""
    b = W.strip_furniture(F.col("html"))
    return pages(spark, sf).select("page_id", b.alias("b")).select("page_id", F.length("b").cast("long").alias("chars"), F.md5("b").alias("body"))


def _roots(spark, sf):
    p = pages(spark, sf).select("page_id", "url", "html", W.strip_furniture(F.col("html")).alias("body"))
    return p.select("page_id", "url", "html", W.article_root(F.col("body")).alias("root"))


@R.add("article_roots", f"WITH {ROOT} SELECT page_id, md5(root) AS root FROM root")
def article_roots(spark, sf):
    """The part of each page that holds its article."""
    return _roots(spark, sf).select("page_id", F.md5("root").alias("root"))


PIECES = f"""pieces AS (SELECT page_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (
  SELECT page_id, string_split(regexp_replace(root, '(?i)(</?(?:{"|".join(W.BLOCK_TAGS)})\\b[^>]*>)', chr(1) || '\\1', 'g'), chr(1)) AS l FROM root)),
b AS (SELECT page_id, i, piece, lower(regexp_extract(piece, '^<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag,
  {sql_tidy("regexp_replace(regexp_replace(" + sql_plain("piece") + ", '\\(\\s*[,;]?\\s*\\)|\\[\\s*[,;]?\\s*\\]', '', 'g'), '\\s*[,;]\\s*\\)', ')', 'g')")} AS text FROM pieces)"""
_BLOCK_KIND = "CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag IN ('li', 'dt', 'dd') THEN 'item' WHEN tag = 'pre' THEN 'code' ELSE 'paragraph' END"
_BLOCK_SAYS = "regexp_matches(text, '[\\p{L}\\p{Nd}]')"


@R.add("web_blocks", f"""WITH {ROOT},
{PIECES}
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ord, {_BLOCK_KIND} AS kind, text FROM b WHERE {_BLOCK_SAYS}""")
def web_blocks(spark, sf):
    """Blocks of every page's article."""
    return O.web_blocks(pages(spark, sf), ["page_id"]).select("page_id", "ord", "kind", "text")


# what the article of each page begins with: every kind of block, and what must not become one
_TYPED_PART = """concat('<h2>Part ', page_id, '</h2><ul class="langs"><li><a href="/de">Deutsch</a></li><li><a href="/fr">Français</a></li><li><a href="/fi">Suomi</a></li></ul>',
  '<div><p>The value of <span style="display:none"><math alttext="{\\\\displaystyle z_{', page_id, '}}"></math> stray</span><img class="mwe-math-fallback-image-inline" alt="z" src="x.svg"> is H<sub>2</sub>O.<sup class="reference"><a href="#c1">[1]</a></sup> It sums<sup><a href=\\'#n\\'>2</a></sup> to 1 (, ).</p></div>',
  '<p><math display="block" alttext="a < b_', page_id, '"></math></p><div hidden><p>unseen</p></div>',
  '<figure><img src="f', page_id, '.png" alt="plot"><img data-src="/g.png" src="data:image/gif;base64,R0"><figcaption>Figure 2: The <i>function</i>.</figcaption></figure>',
  '<table><caption>Table 1: Values.</caption><tr><th>z</th><th>p<sup>2</sup></th></tr><tr><td>a cell of prose longer than thirty signs ', page_id, '</td><td><math alttext="x_1"></math> &amp; 1</td></tr></table>',
  '<table class="ltx_equation"><tr><td><math alttext="c = d" display="block"></math></td><td class="ltx_eqn_eqno">(', page_id % 9, ')</td></tr></table>',
  '<table><tr><td><p>left side</p></td><td><table><tr><td>u</td><td>v</td></tr><tr><td>3</td><td>4</td></tr></table></td></tr></table>',
  '<ol><li><p>first item</p></li><li>second <b>item</b></ol><pre>if x:
  y = ', page_id, ' &lt; 2</pre><figure><figure><table><tr><td>7</td><td>8</td></tr><tr><td>9</td><td>0</td></tr></table></figure><figcaption>Table 2: Inside.</figcaption></figure>',
  '<p>With <img src=\\'p.png\\' alt=\\'A photo\\'> in the text.</p><p><a href="/a">one</a> <a href="/b">two</a> <a href="/c">three</a></p>')"""
_TYPED = f"replace(html, '<article>', concat('<article>', {_TYPED_PART}))"
# its place in the SQL, and its words without what is hidden
_TYPED_MARK = '<hr class="typed">'
_TYPED_SAID = "regexp_replace(" + _TYPED_PART.replace("\\\\", "\\").replace("\\'", "''") + """, '<span style="display:none">.*?</span>|<div hidden>.*?</div>', '', 'g')"""
_TYPED_SQL = """SELECT page_id, i, x.ord, x.kind, x.level, x.text, x.caption, x.src, x.number, x.rows FROM b, LATERAL (VALUES
  (0, 'heading', 2, concat('Part ', page_id), NULL, NULL, NULL, NULL), (1, 'paragraph', NULL, concat('The value of $z_{', page_id, '}$ is H_{2}O. It sums to 1.'), NULL, NULL, NULL, NULL),
  (2, 'math', NULL, concat('a < b_', page_id), NULL, NULL, NULL, NULL), (3, 'image', NULL, 'plot', 'Figure 2: The function.', concat('f', page_id, '.png'), NULL, NULL),
  (4, 'image', NULL, '', NULL, '/g.png', NULL, NULL), (5, 'table', NULL, '', 'Table 1: Values.', NULL, NULL, concat('z|p^{2}/a cell of prose longer than thirty signs ', page_id, '|$x_1$ & 1')),
  (6, 'math', NULL, 'c = d', NULL, NULL, CAST(page_id % 9 AS VARCHAR), NULL), (7, 'paragraph', NULL, 'left side', NULL, NULL, NULL, NULL), (8, 'table', NULL, '', NULL, NULL, NULL, 'u|v/3|4'),
  (9, 'item', NULL, 'first item', NULL, NULL, NULL, NULL), (10, 'item', NULL, 'second item', NULL, NULL, NULL, NULL), (11, 'code', NULL, concat('if x:', chr(10), '  y = ', page_id, ' < 2'), NULL, NULL, NULL, NULL),
  (12, 'table', NULL, '', 'Table 2: Inside.', NULL, NULL, '7|8/9|0'), (13, 'paragraph', NULL, 'With in the text.', NULL, NULL, NULL, NULL), (14, 'image', NULL, 'A photo', NULL, 'p.png', NULL, NULL)
) AS x(ord, kind, level, text, caption, src, number, rows) WHERE starts_with(piece, '<hr class="typed">')"""


@R.add("web_blocks_typed", f"""WITH {STRIPPED},
said AS (SELECT page_id, replace(body, '<article>', '<article>{_TYPED_MARK}') AS body, replace(body, '<article>', concat('<article>', {_TYPED_SAID})) AS said FROM stripped),
root AS (SELECT page_id, {sql_root("body", "said")} AS root FROM said),
{PIECES},
typed AS ({_TYPED_SQL}
  UNION ALL SELECT page_id, i, 15, {_BLOCK_KIND}, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN CAST(tag[2:] AS INTEGER) END, text, NULL, NULL, NULL, NULL FROM b WHERE {_BLOCK_SAYS})
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, ord) - 1 AS ord, kind, level, text, caption, src, number, rows FROM typed""")
def web_blocks_typed(spark, sf):
    """Pages whose articles begin with every kind of block, each at its place."""
    b = O.web_blocks(pages(spark, sf).select("page_id", F.expr(_TYPED).alias("html")), ["page_id"])
    return b.withColumn("rows", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/"))


_ELEMENT = r"(?is)<(?:ul|p|div)\b[^>]*>.*?</(?:ul|p|div)\s*>"


@R.add("link_shares", f"""WITH e AS (SELECT page_id, unnest(l) AS piece, generate_subscripts(l, 1) - 1 AS ord FROM (
  SELECT page_id, regexp_extract_all(html, '{_ELEMENT}') AS l FROM pages)),
s AS (SELECT page_id, ord, length({sql_plain("piece")}) AS total, list_transform(regexp_extract_all(piece, '(?is)<a\\b[^>]*>(.*?)</a\\s*>', 1), lambda a: length({sql_plain("a")})) AS ls FROM e)
SELECT page_id, ord, total, CAST(coalesce(list_sum(ls), 0) AS BIGINT) AS linked, len(ls) AS links,
  total > 0 AND coalesce(list_sum(ls), 0) >= 0.8 * total AND (len(ls) >= 3 OR total < 30) AS farm FROM s""")
def link_shares(spark, sf):
    """How much of each list, paragraph and box is links."""
    e = pages(spark, sf).select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_ELEMENT), F.lit(0))).alias("ord", "piece"))
    e = e.select("page_id", "ord", W.link_share(F.col("piece")).alias("s"))
    return e.select(
        "page_id", "ord", F.col("s.total").cast("long").alias("total"), F.col("s.linked").cast("long").alias("linked"),
        F.col("s.links").cast("long").alias("links"), W.is_link_farm(F.col("s")).alias("farm"),
    )


_META = """CASE page_id % 3 WHEN 0 THEN replace(html, '</head>', concat('<meta name="citation_title" content="Paper &amp; ', page_id, '"></head>'))
  WHEN 1 THEN replace(replace(html, '<h1>', '<h2>'), '<title>', '<title>Page - ') ELSE html END"""


@R.add("web_titles", f"""WITH m AS (SELECT page_id, {_META} AS html FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Paper & ' || page_id WHEN 1 THEN 'Page'
  ELSE {sql_plain("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} END AS title FROM m""")
def web_titles(spark, sf):
    """Titles from metadata, heading or title element."""
    return pages(spark, sf).select("page_id", F.expr(_META).alias("html")).select("page_id", W.page_title(F.col("html")).alias("title"))


_SRC = """CASE page_id % 6 WHEN 0 THEN 'img/a.png' WHEN 1 THEN '/root.png' WHEN 2 THEN '//cdn.example.org/x.png' WHEN 3 THEN 'https://a.org/b.png'
  WHEN 4 THEN '../up.png' ELSE 'data:image/png;base64,AA' END"""


@R.add("links_resolved", f"""WITH u AS (SELECT page_id, url, {_SRC} AS src, regexp_extract(url, '^(https?)://', 1) AS scheme,
  regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[^/]*$', '') AS folder FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN origin || CASE WHEN folder = '' THEN '/' ELSE folder END || src WHEN 1 THEN origin || src WHEN 2 THEN scheme || ':' || src
  WHEN 3 THEN src WHEN 4 THEN origin || coalesce(nullif(regexp_replace(folder, '[^/]+/$', ''), ''), '/') || 'up.png' END AS link FROM u""")
def links_resolved(spark, sf):
    """Picture addresses against the page's own."""
    return pages(spark, sf).select("page_id", W.resolve_link(F.col("url"), F.expr(_SRC)).alias("link"))


_RICH = """replace(html, '<article>', concat('<article><table><tr><th>Name</th><th>N &amp; M</th></tr><tr><td>', page_id, '</td><td>x<br>y</td></tr></table>',
  '<table><tr><td>layout</td></tr></table><table class="eqn"><tr><td><math alttext="{\\\\displaystyle a_', page_id, ' = b}"></math></td><td>(', page_id % 9, ')</td></tr></table>',
  '<p>Inline <math><annotation encoding="application/x-tex">z_{i}</annotation></math><sup><a href="#n1">[1]</a></sup> done<a class="noteref" href="#x">2</a>.</p>',
  '<figure><img data-src="/f', page_id, '.png" src="data:image/gif;base64,R0" alt="image"><figcaption>Figure ', page_id, ': a cat</figcaption></figure><img src="i.png" width="16" height="16"><img src="g.png" alt="A graph">'))"""
_RICH_DUCK = _RICH.replace("\\\\", "\\")


def rich(spark, sf):
    return pages(spark, sf).select("page_id", F.expr(_RICH).alias("html"))


@R.add("web_tables", """SELECT page_id, 0 AS ord, 'Name|N & M' AS header, page_id || '|x y' AS last_row, 2 AS n_rows FROM pages""")
def web_tables(spark, sf):
    """Data tables; layout tables are left out."""
    t = rich(spark, sf).select("page_id", F.posexplode(W.tables(F.col("html"))).alias("ord", "t")).withColumn("rows", W.table_rows(F.col("t")))
    t = t.filter(~W.is_layout_table(F.col("t"), F.col("rows")))
    return t.select(
        "page_id", "ord", F.array_join(F.col("rows")[0], "|").alias("header"),
        F.array_join(F.element_at("rows", -1), "|").alias("last_row"), F.size("rows").alias("n_rows"),
    )


@R.add("web_formulas", """SELECT page_id, 0 AS ord, concat('a_', page_id, ' = b') AS latex, TRUE AS display, CAST(page_id % 9 AS VARCHAR) AS number FROM pages
UNION ALL SELECT page_id, 1, 'z_{i}', FALSE, NULL FROM pages""")
def web_formulas(spark, sf):
    """Formulas with their display flag and number."""
    m = rich(spark, sf).select("page_id", F.posexplode(W.page_math(F.col("html"))).alias("ord", "m"))
    return m.select("page_id", "ord", "m.latex", "m.display", "m.number")


@R.add("web_figures", """SELECT page_id, 0 AS ord, concat('/f', page_id, '.png') AS src, '' AS alt, concat('Figure ', page_id, ': a cat') AS caption FROM pages
UNION ALL SELECT page_id, 1, 'g.png', 'A graph', '' FROM pages""")
def web_figures(spark, sf):
    """Pictures with captions; icons and placeholders are left out."""
    m = rich(spark, sf).select("page_id", F.posexplode(W.page_figures(F.col("html"))).alias("ord", "f"))
    return m.select("page_id", "ord", "f.src", "f.alt", "f.caption")


@R.add("note_marks_stripped", f"""SELECT page_id, md5(replace(replace({_RICH_DUCK}, '<sup><a href="#n1">[1]</a></sup>', ''), '<a class="noteref" href="#x">2</a>', '')) AS html FROM pages""")
def note_marks_stripped(spark, sf):
    """Footnote marks removed."""
    return rich(spark, sf).select("page_id", F.md5(W.strip_note_marks(F.col("html"))).alias("html"))
