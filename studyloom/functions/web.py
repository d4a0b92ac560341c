"""Web pages as column expressions.

A page is read as a stream of tags and texts. Elements that are left out or kept whole end where the depth of their own
name returns to zero, so elements nested in others of the same name are no trouble; everything stays one projection over
the page's own row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyloom.functions.text import CUT, GAP, bind, collapse, tidy

# Elements never read, navigation elements, block elements.
ALWAYS_SKIP = (
    "script", "style", "noscript", "template", "svg", "iframe", "object", "embed", "canvas", "video", "audio", "button",
    "select", "textarea", "head", "map", "dialog",
)
NAVIGATION = ("nav", "aside", "form")
BLOCK_TAGS = (
    "h[1-6]", "p", "li", "dt", "dd", "ul", "ol", "dl", "pre", "div", "section", "article", "main", "header", "footer",
    "blockquote", "table", "tr", "figure", "figcaption", "hr", "body",
)
# Classes and ids of page furniture, and the ones that count as part of a longer name.
CHROME = (
    "nav", "navbar", "navigation", "menu", "sidebar", "footer", "cookie", "cookies", "consent", "share", "sharing", "social",
    "advert", "advertisement", "ad", "ads", "promo", "breadcrumb", "breadcrumbs", "related", "comments", "comment",
    "subscribe", "newsletter", "signup", "banner", "popup", "modal", "toolbar", "skip", "masthead", "mw-editsection",
    "noprint", "sr-only", "visually-hidden", "ltx_page_footer", "ltx_page_header", "ltx_role_footnote", "hatnote", "navbox",
    "vertical-navbox", "catlinks", "reflist", "mw-references-wrap", "references", "ambox", "sistersitebox", "metadata",
    "mw-jump-link", "shortdescription",
)
CHROME_PARTS = ("nav", "sidebar", "cookie", "breadcrumb", "share", "comments", "advert", "newsletter")
CHROME_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search")
HOLDERS = "div|section|ul|ol|p|span|header|footer|table|dl|menu|main|article|li"

# Named character references.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&times;", "×"), ("&deg;", "°"),
    ("&eacute;", "é"), ("&egrave;", "è"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&szlig;", "ß"),
    ("&amp;", "&"),
)


HIDDEN = r"""\shidden(?=[\s>=])|\saria-hidden\s*=\s*["']true["']|\sstyle\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)"""
VOID = ("input", "track", "source", "br", "hr", "img", "meta", "link", "area", "base", "col", "embed", "wbr")
RANGES = "array<struct<a:int,b:int>>"


def tag_stream(html: Column) -> Column:
    """Tags and the texts between them, in order; put together they are the page."""
    return F.regexp_extract_all(html, F.lit(r"<[^>]*>|[^<]+|<"), F.lit(0))


def element_ranges(ts: Column, starts: Callable[[Column], Column], to_end: bool = False) -> Column:
    """array<struct<a, b>>: first and last place of each outermost element whose start tag `starts` accepts.

    The walk keeps the name it is in, its depth and where it began, and writes down a range when the depth is back at zero.
    An element without an end is none, or reaches to the page's end.
    """
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))
    info = F.transform(ts, lambda t: F.struct(name(t).alias("name"), t.startswith("</").alias("end"), (t.endswith("/>") | name(t).isin(*VOID)).alias("alone"), (t.startswith("<") & starts(t)).alias("starts")))
    whole = lambda x: F.lit(x).cast("int")

    def state(name: Column, depth: Column, at: Column, i: Column, found: Column) -> Column:
        return F.struct(name.alias("name"), depth.alias("depth"), at.alias("at"), i.alias("i"), found.alias("found"))

    def closed(s: Column, a: Column, b: Column) -> Column:
        return F.concat(s["found"], F.array(F.struct(a.alias("a"), b.alias("b"))))

    def step(s: Column, x: Column) -> Column:
        nxt, none = s["i"] + whole(1), F.lit(None).cast("string")
        begins = s["name"].isNull() & x["starts"] & ~x["end"]
        same = s["name"] == x["name"]
        depth = s["depth"] + F.when(same & x["end"], whole(-1)).when(same & ~x["alone"], whole(1)).otherwise(whole(0))
        return (
            F.when(begins & x["alone"], state(none, whole(0), whole(0), nxt, closed(s, s["i"], s["i"])))
            .when(begins, state(x["name"], whole(1), s["i"], nxt, s["found"]))
            .when(s["name"].isNotNull() & (depth == 0), state(none, whole(0), whole(0), nxt, closed(s, s["at"], s["i"])))
            .otherwise(state(s["name"], depth, s["at"], nxt, s["found"]))
        )

    zero = state(F.lit(None).cast("string"), whole(0), whole(0), whole(0), F.array().cast(RANGES))
    last = lambda s: F.when(s["name"].isNotNull(), closed(s, s["at"], s["i"])).otherwise(s["found"]) if to_end else s["found"]
    return F.aggregate(info, zero, step, last)


def replaced(ts: Column, ranges: Column, by: Callable[[Column], Column]) -> Column:
    """The page of these tags and texts, each range put as `by` has it; `by` takes the range's own tags and texts."""
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(ranges, k)["b"] + 1)
    end = lambda k: F.when(k == F.size(ranges), F.size(ts)).otherwise(F.try_element_at(ranges, k + 1)["a"])
    own = lambda r: F.slice(ts, r["a"] + 1, r["b"] - r["a"] + 1)
    before = lambda k: F.slice(ts, begin(k) + 1, end(k) - begin(k))
    put = lambda k: F.when(k < F.size(ranges), F.array(bind(F.try_element_at(ranges, k + 1), lambda r: by(own(r))))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(ranges)), lambda k: F.concat(before(k), put(k)))), "")


def replaced_elements(html: Column, starts: Callable[[Column], Column], by: Callable[[Column], Column]) -> Column:
    """The page with each outermost element whose start tag `starts` accepts put as `by` has it."""
    return bind(tag_stream(html), lambda ts: bind(element_ranges(ts, starts), lambda rs: replaced(ts, rs, by)))


def without_elements(html: Column, starts: Callable[[Column], Column]) -> Column:
    """The page without the elements whose start tag `starts` accepts."""
    return replaced_elements(html, starts, lambda ts: F.lit(""))


def innermost_ranges(ts: Column, names: tuple[str, ...]) -> Column:
    """array<struct<a, b>>: the elements of these names that hold none of them: a start tag whose next tag is its end."""
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))
    tags = F.transform(ts, lambda t, i: F.struct(i.alias("i"), name(t).alias("name"), t.startswith("</").alias("end")))

    def pair(tags: Column) -> Column:
        after = lambda k: F.try_element_at(tags, k + 2)
        both = F.transform(tags, lambda x, k: F.when(~x["end"] & after(k)["end"] & (after(k)["name"] == x["name"]), F.struct(x["i"].alias("a"), after(k)["i"].alias("b"))))
        return F.filter(both, lambda r: r.isNotNull())

    return bind(F.filter(tags, lambda x: x["name"].isin(*names)), pair)


def elements(html: Column, starts: Callable[[Column], Column]) -> Column:
    """array<string>: what the outermost elements hold whose start tag `starts` accepts; without an end, to the page's end."""
    inner = lambda ts, r: F.array_join(F.slice(ts, r["a"] + 2, F.greatest(r["b"] - r["a"] - 1, F.lit(0))), "")
    return bind(tag_stream(html), lambda ts: F.transform(element_ranges(ts, starts, to_end=True), lambda r: inner(ts, r)))


def decode_entities(c: Column) -> Column:
    """Named references of the fixed list, and numeric ones."""
    named = F.str_to_map(F.lit(CUT.join(f"{name}{GAP}{ch}" for name, ch in ENTITIES)), F.lit(CUT), F.lit(GAP))

    def numeric(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^&#[xX]?([0-9A-Fa-f]+);$", 1)
        base = F.when(p.rlike(r"^&#[xX]"), digits).otherwise(F.conv(digits, 10, 16))
        return F.when(p.startswith("&#"), F.decode(F.unhex(F.lpad(base, 8, "0")), "UTF-32"))

    pieces = F.regexp_extract_all(c, F.lit(r"&(?:[A-Za-z]{2,8}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});|[^&]+|&"), F.lit(0))
    read = lambda p: F.when(p.startswith("&") & p.endswith(";"), F.coalesce(F.try_element_at(named, p), numeric(p), p)).otherwise(p)
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, read), "")).otherwise(c)


def plain(html: Column) -> Column:
    """Text of a piece of HTML: `<br>` is a space, other tags go, references are decoded."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", " "), r"<[^>]*>?", "")
    return tidy(collapse(bind(t, decode_entities)))


def strip_furniture(html: Column) -> Column:
    """Without comments, scripts, navigation, page chrome and hidden elements, each to its own end tag."""
    names = rf"""\s(?:class|id)\s*=\s*["'](?:[^"']*?\s)?(?:{'|'.join(CHROME)})[\s"']"""
    parts = rf"""\s(?:class|id)\s*=\s*["'](?:[^"']*?[\s_-])?(?:{'|'.join(CHROME_PARTS)})[\s_"'-]"""
    role = rf"""\srole\s*=\s*["'](?:{'|'.join(CHROME_ROLES)})["']"""
    hidden = HIDDEN
    skipped = rf"(?i)^<(?:{'|'.join((*ALWAYS_SKIP, *NAVIGATION, 'input', 'track', 'source'))})\b"
    furniture = rf"(?i)^<(?:{HOLDERS})\b[^>]*?(?:{names}|{parts}|{role}|{hidden})"
    beside = r"""(?i)^<[a-z][^>]*?\sclass\s*=\s*["'][^"']*(?:mwe-math-fallback|ltx_note)"""
    return without_elements(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), lambda t: t.rlike(skipped) | t.rlike(furniture) | t.rlike(beside))


def article_root(html: Column) -> Column:
    """The largest article, else main, else #content; too small a one gives way to the body."""
    body = F.when(html.rlike(r"(?i)<body\b"), F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)).otherwise(html)

    def largest(start: str) -> Column:
        return F.array_max(F.transform(elements(html, lambda t: t.rlike(start)), lambda h: F.struct(F.length(plain(h)).alias("n"), h.alias("h"))))

    candidate = F.coalesce(
        largest(r"(?i)^<article\b"),
        largest(r"""(?i)^<(?:main\b|\w+\b[^>]*\srole\s*=\s*["']main["'])"""),
        largest(r"""(?i)^<\w+\b[^>]*\sid\s*=\s*["'](?:main-)?content["']"""),
    )
    return bind(
        candidate,
        lambda c: F.when(
            c.isNotNull() & ((c["n"] >= 400) | (c["n"] > 0.3 * F.greatest(F.lit(1), F.length(plain(body))))), c["h"]
        ).otherwise(body),
    )


BLOCK = "struct<kind:string,level:int,text:string,caption:string,src:string,number:string,rows:array<array<string>>>"
#: a typed block on its way through the page: MARK kind FIELD text FIELD caption FIELD src FIELD number FIELD rows; rows are cut
#: by ROW and CELL
MARK, FIELD, ROW, CELL = "\ue002", "\ue003", "\ue004", "\ue005"
FARMS = ("ul", "ol", "p", "div", "table", "section", "dl", "menu")


def _typed(kind: str, text: Column | None = None, caption: Column | None = None, src: Column | None = None, number: Column | None = None, rows: Column | None = None) -> Column:
    """A block as text without tags, cut off from what is around it."""
    parts = [F.lit(kind), *[F.lit("") if c is None else F.coalesce(c, F.lit("")) for c in (text, caption, src, number, rows)]]
    return F.concat(F.lit(CUT + MARK), F.replace(F.concat_ws(FIELD, *parts), F.lit("<"), F.lit("&lt;")), F.lit(CUT))


def _read_typed(piece: Column) -> Column:
    f = F.split(F.replace(F.substring(piece, 2, 1 << 30), F.lit("&lt;"), F.lit("<")), FIELD)
    rows = F.when(f[5] != "", F.transform(F.split(f[5], ROW), lambda r: F.split(r, CELL)))
    return F.struct(
        f[0].alias("kind"), F.lit(None).cast("int").alias("level"), f[1].alias("text"), F.nullif(f[2], F.lit("")).alias("caption"), F.nullif(f[3], F.lit("")).alias("src"),
        F.nullif(f[4], F.lit("")).alias("number"), rows.alias("rows"),
    ).cast(BLOCK)


def _whole(ts: Column) -> Column:
    return F.array_join(ts, "")


def hidden_math_shown(html: Column) -> Column:
    """Hidden elements that hold formulas, as pages with pictures of them have, become these formulas."""
    hidden = lambda t: t.rlike(rf"(?i)^<[a-z][^>]*?(?:{HIDDEN})") & ~t.rlike(r"(?i)^<math\b")
    math = lambda ts: F.array_join(bind(element_ranges(ts, _is_math), lambda rs: F.transform(rs, lambda r: _whole(F.slice(ts, r["a"] + 1, r["b"] - r["a"] + 1)))), "")
    return F.when(html.rlike(r"(?i)<math\b"), replaced_elements(html, hidden, lambda ts: bind(ts, math))).otherwise(html)


def _is_math(t: Column) -> Column:
    return t.rlike(r"(?i)^<math\b")


def without_link_farms(html: Column) -> Column:
    """W4 applied: lists, paragraphs, boxes and tables that are mostly links are left out; those inside others first."""
    several = lambda h: h.rlike(r"(?is)<a\b.*<a\b|<(?:p|li|div)\b[^>]*>\s*<a\b")
    once = lambda h: bind(tag_stream(h), lambda ts: bind(innermost_ranges(ts, FARMS), lambda rs: replaced(ts, rs, lambda own: bind(_whole(own), lambda e: F.when(is_link_farm(link_share(e)), "").otherwise(e)))))
    return F.when(several(html), once(once(html))).otherwise(html)


def _table(element: Column) -> Column:
    """One table that holds no other: numbered formulas, rows of data, or a layout, which is opened."""
    # formulas within cells are part of their text
    spelled = F.when(element.rlike(r"(?i)<math\b"), _put(element, "math", _inline)).otherwise(element)
    rows = table_rows(spelled)
    numbered = formulas(F.regexp_extract_all(element, F.lit(r"(?is)<tr\b[^>]*>.*?(?:</tr\s*>|(?=<tr\b)|$)"), F.lit(0)))
    cells = F.regexp_extract_all(element, F.lit(r"(?is)<td\b[^>]*>(.*?)(?:</td\s*>|(?=<t[dr]\b)|$)"), F.lit(1))
    prose = F.exists(cells, lambda c: ~c.rlike(r"(?i)<math\b") & (F.length(plain(c)) > 30))
    tag = F.regexp_extract(element, r"^<[^>]*>", 0)
    equations = element.rlike(r"(?i)<math\b") & (~prose | tag.rlike(r"""(?i)\sclass\s*=\s*["'][^"']*(?:equation|eqn)"""))
    caption = plain(F.regexp_extract(element, r"(?is)<caption\b[^>]*>(.*?)</caption\s*>", 1))
    data = bind(rows, lambda rs: F.when(~is_layout_table(element, rs), _typed("table", None, caption, rows=F.array_join(F.transform(rs, lambda r: F.array_join(r, CELL)), ROW))))
    opened = F.regexp_replace(element, r"(?i)</?(?:table|thead|tbody|tfoot|tr|td|th|caption)\b[^>]*>", "<div>")
    return F.when(equations, F.array_join(F.transform(numbered, lambda m: _typed("math", m["latex"], number=m["number"])), "")).otherwise(F.coalesce(data, opened))


def _figure(element: Column) -> Column:
    """A figure's table, pictures or code with its caption; the first picture has it."""
    return bind(figure_caption(element), lambda caption: bind(pictures(element, caption), lambda images: _shown(element, caption, images)))


def _shown(element: Column, caption: Column, images: Column) -> Column:
    held = F.regexp_extract(element, f"({MARK}table{FIELD}[^{FIELD}]*{FIELD})([^{FIELD}]*)({FIELD}[^{CUT}]*)", 0)
    own = F.split(held, FIELD)
    table = F.concat(F.lit(CUT), F.concat_ws(FIELD, own[0], own[1], F.when(own[2] != "", own[2]).otherwise(F.replace(caption, F.lit("<"), F.lit("&lt;"))), F.slice(own, 4, 3)), F.lit(CUT))
    shown = F.array_join(F.transform(images, lambda f: _typed("image", f["alt"], f["caption"], f["src"])), "")
    said = F.when(caption != "", F.concat(F.lit("<p>"), F.replace(caption, F.lit("<"), F.lit("&lt;")), F.lit("<p>"))).otherwise("")
    code = F.regexp_extract(element, r"(?is)<pre\b[^>]*>(.*?)</pre\s*>", 1)
    rest = F.regexp_replace(element, r"(?is)<figcaption\b[^>]*>.*?</figcaption\s*>|</?figure\b[^>]*>", "<div>")
    lead = F.when((F.size(images) > 0) & (caption != "") & (images[0]["caption"] == ""), said).otherwise("")
    return (
        F.when(held != "", table).when(F.size(images) > 0, F.concat(lead, shown)).when(element.rlike(r"(?i)<img\b"), said)
        .when(code != "", _typed("code", code_text(code), caption)).otherwise(F.concat(rest, said))
    )


def code_text(html: Column) -> Column:
    """Text of a `pre` element: lines and spaces as they are."""
    return F.rtrim(decode_entities(F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>?", "")), F.lit(" \n\r\t"))


def _is_display(math: Column) -> Column:
    return math.rlike(r"""(?is)^<math\b[^>]*\s(?:display\s*=\s*["']?block|mode\s*=\s*["']?display)""")


def _formula(element: Column) -> Column:
    """A formula of its own, or `$…$` within the text."""
    return F.when(_is_display(element) & math_latex(element).isNotNull(), _typed("math", math_latex(element))).otherwise(_inline(element))


def _inline(element: Column) -> Column:
    latex = F.replace(F.replace(math_latex(element), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.coalesce(F.concat(F.lit(" $"), latex, F.lit("$ ")), plain(element))


def _put(html: Column, name: str, body: Callable[[Column], Column]) -> Column:
    """The page with its outermost elements of a name put as `body` has them; pages without any are not walked."""
    there, start = rf"(?i)<{name}\b", rf"(?i)^<{name}\b"
    return F.when(html.rlike(there), replaced_elements(html, lambda t: t.rlike(start), lambda ts: bind(_whole(ts), body))).otherwise(html)


def typed_tables(html: Column) -> Column:
    """Tables of data and of formulas as typed blocks, layouts opened; only tables that hold no other can be either."""
    inner = lambda ts: bind(innermost_ranges(ts, ("table",)), lambda rs: replaced(ts, rs, lambda own: bind(_whole(own), _table)))
    return F.when(html.rlike(r"(?i)<table\b"), bind(tag_stream(html), inner)).otherwise(html)


def typed_figures(html: Column) -> Column:
    return _put(html, "figure", _figure)


def typed_code(html: Column) -> Column:
    return _put(html, "pre", lambda e: _typed("code", code_text(e)))


def typed_math(html: Column) -> Column:
    return _put(html, "math", _formula)


def scripts_raised(html: Column) -> Column:
    """`<sup>` and `<sub>` as `^{…}` and `_{…}`; empty ones are left out."""
    t = html
    for name, sign in (("sup", "^{"), ("sub", "_{")):
        t = F.regexp_replace(t, rf"(?i)<{name}\b[^>]*>\s*", sign)
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\s*</su[bp]\s*>", "}"), r"[\^_]\{\}", "")
    return F.when(html.rlike(r"(?i)<su[bp]\b"), t).otherwise(html)


def cut_blocks(html: Column) -> Column:
    """array<struct<kind, level, text, caption, src, number, rows>> of an article whose typed blocks are put in their places."""
    # a paragraph that opens an item is the item
    html = F.regexp_replace(html, r"(?i)(<(?:li|dt|dd)\b[^>]*>\s*)<p\b[^>]*>", "$1")
    marked = F.regexp_replace(html, rf"(?i)(</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>)", CUT + "$1")

    def block(piece: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, r"^<([A-Za-z][A-Za-z0-9]*)", 1))
        text = F.regexp_replace(plain(piece), r"\(\s*[,;]?\s*\)|\[\s*[,;]?\s*\]", "")
        text = tidy(F.regexp_replace(text, r"\s*[,;]\s*\)", ")"))
        kind = F.when(tag.rlike("^h[1-6]$"), "heading").when(tag.isin("li", "dt", "dd"), "item").otherwise("paragraph")
        level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
        none = F.lit(None).cast("string")
        return F.struct(kind.alias("kind"), level.alias("level"), text.alias("text"), none.alias("caption"), none.alias("src"), none.alias("number"), F.lit(None).cast("array<array<string>>").alias("rows")).cast(BLOCK)

    def _image(f: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit("image").alias("kind"), F.lit(None).cast("int").alias("level"), f["alt"].alias("text"), none.alias("caption"), f["src"].alias("src"), none.alias("number"), F.lit(None).cast("array<array<string>>").alias("rows")).cast(BLOCK)

    def read(piece: Column) -> Column:
        shown = F.transform(pictures(piece, F.lit("")), _image)
        said = F.filter(F.array(block(piece)), lambda b: b["text"].rlike(r"[\p{L}\p{Nd}]"))
        return F.when(piece.startswith(MARK), F.array(_read_typed(piece))).when(piece.rlike(r"(?i)<img\b"), F.concat(said, shown)).otherwise(said)

    return F.flatten(F.transform(F.split(marked, CUT), read))


def link_share(piece: Column) -> Column:
    """struct<linked, total, links> of a piece of HTML."""
    links = F.regexp_extract_all(piece, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1))
    sizes = F.transform(links, lambda a: F.length(plain(a)))
    return F.struct(
        F.aggregate(sizes, F.lit(0), lambda s, n: s + n).alias("linked"), F.length(plain(piece)).alias("total"), F.size(links).alias("links")
    )


def is_link_farm(share: Column) -> Column:
    return (share["total"] > 0) & (share["linked"] >= 0.8 * share["total"]) & ((share["links"] >= 3) | (share["total"] < 30))


def _attr(tag: Column, name: str) -> Column:
    """An attribute's value, in double or single quotes."""
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in "\"'"], F.lit(""))


def _meta(html: Column, names: str) -> Column:
    tag = F.regexp_extract(html, rf"""(?is)(<meta\b[^>]*\b(?:name|property)\s*=\s*["'](?:{names})["'][^>]*>)""", 1)
    return decode_entities(_attr(tag, "content"))


def page_title(html: Column) -> Column:
    """Citation title, first h1, og:title, title; the last two without the site's name."""
    site = lambda t: F.split(t, r"\s+[|–—·]\s+|\s+-\s+")[0]
    h1 = plain(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1))
    title = plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))
    found = F.array(_meta(html, "citation_title|dc\\.title"), h1, site(_meta(html, "og:title")), site(title))
    return F.filter(F.transform(found, tidy), lambda t: (t != "") & (F.length(t) < 300))[0]


def base_href(html: Column) -> Column:
    return F.nullif(_attr(F.regexp_extract(html, r"(?is)(<base\b[^>]*>)", 1), "href"), F.lit(""))


def resolve_link(base: Column, src: Column) -> Column:
    """An absolute http(s) address of `src` on a page at `base`, else null. Dot segments of relative paths are folded."""
    scheme = F.regexp_extract(base, r"^(https?)://", 1)
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1)
    folder = F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.when(F.contains(path, F.lit("/")), "").otherwise("/"))
    bare = F.regexp_replace(src, r"^(\./)+", "")
    ups = F.regexp_count(F.regexp_extract(bare, r"^((?:\.\./)*)", 1), F.lit(r"\.\./"))
    down = F.regexp_replace(bare, r"^(?:\.\./)+", "")
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    kept = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - ups))
    up = F.concat(F.when(F.size(kept) > 0, F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(""), F.lit("/"), down)
    return (
        F.when(src.rlike(r"(?i)^https?://"), src)
        .when(src.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (origin == "") | base.isNull(), F.lit(None).cast("string"))
        .when(src.startswith("//"), F.concat(scheme, F.lit(":"), src))
        .when(src.startswith("/"), F.concat(origin, src))
        .otherwise(F.concat(origin, up))
    )


def table_rows(table: Column) -> Column:
    """Rows of cells of one table element."""
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?:</tr\s*>|(?=<tr\b)|$)"), F.lit(1))
    cells = lambda r: F.transform(
        F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?:</t[dh]\s*>|(?=<t[dh]\b)|$)"), F.lit(1)), plain
    )
    return F.transform(rows, cells)


def is_layout_table(table: Column, rows: Column) -> Column:
    """One row or column, a table or heading inside, or cells of running text."""
    cells = F.flatten(rows)
    chars = F.aggregate(cells, F.lit(0), lambda s, c: s + F.length(c))
    return (
        (F.size(rows) <= 1)
        | F.forall(rows, lambda r: F.size(r) <= 1)
        | F.substring(table, 2, 1 << 30).rlike(r"(?i)<(?:table|h[1-6])\b")
        | (F.floor(chars / F.greatest(F.lit(1), F.size(cells))) > 250)
    )


def whole_elements(html: Column, starts: Callable[[Column], Column]) -> Column:
    """array<string>: the outermost elements whose start tag `starts` accepts, each to its own end tag."""
    return bind(tag_stream(html), lambda ts: F.transform(element_ranges(ts, starts), lambda r: _whole(F.slice(ts, r["a"] + 1, r["b"] - r["a"] + 1))))


def tables(html: Column) -> Column:
    """The page's tables that are in no other."""
    return whole_elements(html, lambda t: t.rlike(r"(?i)^<table\b"))


def math_latex(math: Column) -> Column:
    """LaTeX of a math element: its alttext, else its TeX annotation."""
    note = decode_entities(F.regexp_extract(math, r"""(?is)<annotation\b[^>]*encoding\s*=\s*["'][^"']*tex[^"']*["'][^>]*>(.*?)</annotation\s*>""", 1))
    alt = decode_entities(_attr(math, "alttext"))
    raw = F.trim(F.regexp_replace(F.when(alt != "", alt).otherwise(note), r"\\displaystyle|\\textstyle", ""))
    return F.nullif(
        F.when(raw.rlike(r"(?s)^\{.*\}$"), F.trim(F.regexp_extract(raw, r"(?s)^\{(.*)\}$", 1))).otherwise(raw), F.lit("")
    )


def page_math(html: Column) -> Column:
    """array<struct<latex, display, number>>; formulas of one table row are one, with the row's number."""
    return formulas(whole_elements(html, lambda t: t.rlike(r"(?i)^<(?:tr|math)\b")))


def formulas(rows: Column) -> Column:
    """The formulas of table rows and of `math` elements."""
    math = r"(?is)<math\b.*?</math\s*>"

    def one(r: Column) -> Column:
        latex = F.filter(F.transform(F.regexp_extract_all(r, F.lit(math), F.lit(0)), math_latex), lambda l: l.isNotNull())
        rest = F.regexp_replace(r, math, "")
        number = F.nullif(F.regexp_extract(rest, r">\s*\(\s*([A-Z]?[\d.]+[a-z]?)\s*\)\s*<", 1), F.lit(""))
        display = _is_display(r) | r.rlike("(?i)^<tr")
        return F.struct(F.nullif(F.array_join(latex, " "), F.lit("")).alias("latex"), display.alias("display"), number.alias("number"))

    return F.filter(F.transform(rows, one), lambda m: m["latex"].isNotNull())


def picture(tag: Column, caption: Column) -> Column:
    """struct<src, alt, caption> of an `img` tag; src is null for icons and placeholders."""
    usable = F.filter(F.array(*[_attr(tag, k) for k in ("data-src", "data-original", "src")]), lambda s: (s != "") & ~s.startswith("data:image/gif"))
    size = lambda k: F.regexp_extract(_attr(tag, k), r"(\d+)", 1).try_cast("int")
    small = F.coalesce((size("width") < 48) & (size("height") < 48), F.lit(False))
    alt = tidy(decode_entities(_attr(tag, "alt")))
    said = lambda a: F.when(a.rlike(r"(?i)^\[.*\]$|^(image|img|picture|photo|figure|graphic)$|\.(png|jpe?g|gif|webp|svg)$"), "").otherwise(a)
    return F.struct(F.when(~small, F.try_element_at(usable, F.lit(1))).alias("src"), bind(alt, said).alias("alt"), caption.alias("caption"))


def pictures(html: Column, caption: Column) -> Column:
    """The usable pictures of a piece of HTML, the first of all its pictures with the caption."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    return F.filter(F.transform(tags, lambda tag, i: picture(tag, F.when(i == 0, caption).otherwise(""))), lambda f: f["src"].isNotNull())


def figure_caption(figure: Column) -> Column:
    return plain(F.regexp_extract(figure, r"(?is)<(figcaption|caption)\b[^>]*>(.*?)</\1\s*>", 2))


def page_figures(html: Column) -> Column:
    """array<struct<src, alt, caption>>: pictures in order; a figure's first picture gets its caption."""
    parts = whole_elements(html, lambda t: t.rlike(r"(?i)^<(?:figure|img)\b"))
    return F.flatten(F.transform(parts, lambda p: pictures(p, F.when(p.rlike("(?i)^<figure"), figure_caption(p)).otherwise(""))))


def strip_note_marks(html: Column) -> Column:
    """Footnote and citation marks left out: marked elements, and short superscripts that are only #links."""
    marked = r"""(?i)^<(?:sup|a|cite|span)\b[^>]*\s(?:epub:type|type|role|class)\s*=\s*["'][^"']*(?:noteref|footnote-ref|reference|ltx_note_mark|ltx_cite|citation)"""
    there = html.rlike(r"(?i)noteref|footnote-ref|reference|ltx_note_mark|ltx_cite|citation")
    t = F.when(there, without_elements(html, lambda t: t.rlike(marked))).otherwise(html)
    return F.regexp_replace(t, r"""(?is)<sup\b[^>]*>(?:\s*<a\b[^>]*\shref\s*=\s*["']#[^"']*["'][^>]*>[^<]{0,8}</a\s*>)+\s*</sup\s*>""", "")
