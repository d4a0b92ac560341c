"""Text rules as column expressions: tidying, folding, speech wording, sentences.

All patterns run in Java's regex engine inside the JVM; whole texts are processed in place, one row at a time.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks used inside a text while it is cut; not characters of any script.
CUT = "\ue000"
GAP = "\ue001"

WS = " \\n\\t\\r"

# Words after which a full stop does not end a sentence.
NO_SPLIT_AFTER = (
    "e.g.", "i.e.", "al.", "etc.", "vs.", "cf.", "fig.", "figs.", "eq.", "eqs.", "sec.", "secs.", "tab.", "resp.",
    "approx.", "no.", "dr.", "prof.", "mr.", "ms.", "thm.", "def.", "ref.", "w.r.t.", "i.i.d.", "st.", "app.", "vol.",
    "pp.", "ch.",
)

# What is said for an abbreviation (pattern, words).
ABBREVIATIONS = (
    (r"\be\.\s?g\.,?", "for example,"),
    (r"\bi\.\s?e\.,?", "that is,"),
    (r"\bet al\.", "and colleagues"),
    (r"\bw\.r\.t\.", "with respect to"),
    (r"\bi\.i\.d\.", "I I D"),
    (r"\bresp\.", "respectively"),
    (r"\bcf\.", "compare"),
    (r"\bvs\.", "versus"),
    (r"\betc\.", "et cetera."),
    (r"\bFigs?\.\s*", "Figure "),
    (r"\bEqs?\.\s*", "Equation "),
    (r"\bSecs?\.\s*", "Section "),
    (r"\bTab\.\s*", "Table "),
    (r"\bThm\.\s*", "Theorem "),
    (r"\bDef\.\s*", "Definition "),
    (r"\bApp\.\s*", "Appendix "),
    (r"\bRef\.\s*", "Reference "),
    (r"\bNo\.\s*(\d)", "number $1"),
    (r"\bapprox\.", "approximately"),
)

def bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once: lambda variables are not re-evaluated, repeated expressions are."""
    return F.transform(F.array(value), body)[0]


def _where(c: Column, cond: Callable[[Column], Column], then: Callable[[Column], Column]) -> Column:
    """`then` of `c` where `cond` holds, else `c`: a sign that costs little spares most texts the patterns behind it."""
    return bind(c, lambda x: F.when(cond(x), then(x)).otherwise(x))


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str]:
    """Characters with a compatibility form of one character, and those forms, by the Unicode data (NFKC)."""
    one = {c: n for c, n in _compatibility() if len(n) == 1}
    return "".join(one), "".join(one.values())


@lru_cache(maxsize=1)
def fold_many() -> dict[str, str]:
    """Characters whose compatibility form has several characters, such as ligatures, fractions and units."""
    return {c: n for c, n in _compatibility() if len(n) != 1}


@lru_cache(maxsize=1)
def _compatibility() -> list[tuple[str, str]]:
    """Every character that NFKC changes. Surrogates are none."""
    chars = (chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)
    return [(c, n) for c in chars if (n := unicodedata.normalize("NFKC", c)) != c]


def _class(chars: Iterable[str]) -> str:
    """A pattern's character class of these, neighbours as ranges."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


def fold(c: Column) -> Column:
    """Compatibility forms (ligatures, super/subscripts, mathematical and full-width letters, fractions) as plain characters."""
    src, dst = fold_tables()
    many, cls = fold_many(), _class(fold_many())
    forms = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    # the class has some hundred ranges, tried one after another: ASCII is told first
    odd, other = f"(?![\\x00-\\x7f])[{cls}]", f"[\\x00-\\x7f[^{cls}]]+"

    def apart(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(f"{odd}|{other}"), F.lit(0))
        return F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) == 1, F.coalesce(F.try_element_at(forms, p), p)).otherwise(p)), "")

    return _where(c, lambda x: x.rlike("[^\\x00-\\x7f]"), lambda x: _where(F.translate(x, src, dst), lambda t: t.rlike(odd), apart))


def tidy(c: Column) -> Column:
    """Whitespace collapsed, spacing around punctuation mended."""
    t = _where(c, lambda x: x.rlike(r"(?U)[^\S ]|  "), lambda x: F.regexp_replace(x, r"(?U)\s+", " "))
    t = _where(t, lambda x: F.contains(x, F.lit("..")), lambda x: F.regexp_replace(x, r"(?<!\.)\.\.(?!\.)", "."))
    for a, b in ((" ,", ","), (" .", "."), (" ;", ";"), (" :", ":"), ("( ", "("), (" )", ")")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(t)


def collapse(c: Column) -> Column:
    """Whitespace collapsed; soft hyphens and invisible joiners left out."""
    return F.regexp_replace(F.regexp_replace(c, "[\u00ad\u200b-\u200d\u2060\ufeff]", ""), r"(?U)\s+", " ")


# What may stand before an author in a bracket, and how long the rest may be.
BEFORE_AUTHOR, LONGEST_AUTHOR = ("see ", "e.g., ", "e.g. ", "e.g.,", "e.g.", "cf. "), 160


def _without_brackets(c: Column, opening: str, closing: str, is_mark: Callable[[Column], Column]) -> Column:
    """Brackets that hold no bracket of their kind are left out, with a space before them, where `is_mark` says so of their inside."""
    pieces = lambda x: F.regexp_extract_all(x, F.lit(rf"\s?\{opening}[^\{opening}\{closing}]*\{closing}|[^\s\{opening}]+|\s|\{opening}"), F.lit(0))
    inside = lambda p: F.substring_index(F.substring_index(p, opening, -1), closing, 1)
    marked = lambda p: p.endswith(closing) & p.rlike(rf"^\s?\{opening}") & is_mark(inside(p))
    return _where(c, lambda x: F.contains(x, F.lit(opening)), lambda x: F.array_join(F.filter(pieces(x), lambda p: ~marked(p)), ""))


def _lettered(word: Column, digits: Column) -> Column:
    """`word` is `digits` or these and one small letter."""
    return (word == digits) | ((F.substring(word, F.lit(1), F.length(word) - 1) == digits) & F.substring(word, -1, 1).between("a", "z"))


def strip_citations(c: Column) -> Column:
    """Citation marks left out; an author-year bracket with `=` in it is no citation.

    Marks are lists of numbers in square brackets and, in round ones, lists of years or a text that ends in a year.
    """
    spaced = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    number = lambda p: bind(spaced(p), lambda w: (w != "") & _lettered(w, F.regexp_extract(w, r"^\d+", 0)) & w.rlike(r"^\d"))
    year = lambda w: bind(F.regexp_extract(w, r"^\d+", 0), lambda d: (F.length(d) == 4) & d.between("1900", "2099") & _lettered(w, d))

    def author(inside: Column) -> Column:
        last = F.regexp_extract(inside, r"\w+$", 0)
        named = F.substring(inside, F.lit(1), F.length(inside) - F.length(last))
        short = F.exists(F.array(F.lit(""), *[F.lit(x) for x in BEFORE_AUTHOR]), lambda x: named.startswith(x) & (F.length(named) - F.length(x) <= LONGEST_AUTHOR))
        return year(last) & ~F.contains(inside, F.lit("=")) & short

    t = _without_brackets(c, "[", "]", lambda i: F.forall(F.split(i, "[,–—-]"), number))
    return _without_brackets(t, "(", ")", lambda i: F.forall(F.split(i, "[,;]"), lambda p: year(spaced(p))) | author(i))


def for_speech(c: Column) -> Column:
    """A sentence as it is said."""

    def said(x: Column) -> Column:
        for pattern, words in ABBREVIATIONS:
            x = F.regexp_replace(x, "(?U)" + pattern, words)
        return x

    t = F.regexp_replace(strip_citations(fold(c)), r"(https?://|www\.)\S+", "a link")
    # every abbreviation has a stop, and most texts have none of them
    some = "(?U)" + "|".join(pattern for pattern, _ in ABBREVIATIONS)
    t = _where(t, lambda x: F.contains(x, F.lit(".")) & x.rlike(some), said)
    t = _where(t, lambda x: F.contains(x, F.lit("- ")), lambda x: F.regexp_replace(x, r"(?U)(\w)- (\w)", "$1-$2"))
    return tidy(t)


def speakable(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{Nd}]")


FORMULA = r"(?s)\$\$.+?\$\$|\$[^$]+?\$"


def math_spans(c: Column) -> Column:
    """Inline formulas in order, without their dollar signs."""
    return F.transform(
        F.regexp_extract_all(c, F.lit(FORMULA), F.lit(0)), lambda m: F.trim(F.regexp_replace(m, r"^\$\$?|\$\$?$", ""))
    )


def substantial(c: Column) -> Column:
    return (F.length(c) > 2) & (c.rlike(r"[\\^_=]") | (F.length(c) > 6))


def shown_formulas(c: Column) -> Column:
    """The first three formulas worth showing."""
    return F.slice(F.filter(math_spans(c), substantial), 1, 3)


def _mask_formulas(c: Column) -> Column:
    pieces = F.regexp_extract_all(c, F.lit(FORMULA + r"|[^$]+|\$"), F.lit(0))
    masked = F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p.startswith("$") & (F.length(p) > 1), F.translate(p, " \n\t\r", GAP * 4)).otherwise(p),
        ),
        "",
    )
    return F.when(F.contains(c, F.lit("$")), masked).otherwise(c)


def sentence_end_pattern() -> str:
    """A word that ends a sentence, with the white space after it."""
    words = "|".join(w.replace(".", r"\.") for w in NO_SPLIT_AFTER)
    close = r"[)\"”’\]]"
    not_short = rf"(?![(\[\"“]*(?iu:{words}){close}*[{WS}])"
    not_initial = rf"(?!\p{{Lu}}[.?!]{close}*[{WS}])"
    nxt = rf"(?=[(\"“‘\[]*+(?:[{WS}]|$|\p{{Lu}}|[^\p{{L}}]))(?=[^{WS}])"
    # most words have no mark: they are told before the words that don't end a sentence are tried
    return rf"(?<![^{WS}])(?=[^{WS}]*[.?!]){not_short}{not_initial}([^{WS}]*[.?!]{close}*)[{WS}]+{nxt}"


LONG_RUN = 70  # fixed value: words after which a run-on is cut at a comma or semicolon


def _cut_long(words: Column) -> Column:
    """One over-long sentence (array of words) as its pieces."""
    stops = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).rlike("[;,]$"))
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("cuts"))
    cuts = F.aggregate(
        stops,
        start,
        lambda s, i: F.when(
            i - s["last"] >= LONG_RUN, F.struct(i.alias("last"), F.concat(s["cuts"], F.array(i)).alias("cuts"))
        ).otherwise(s),
        lambda s: F.array_distinct(F.concat(F.array(F.lit(0)), s["cuts"], F.array(F.size(words)))),
    )
    return bind(
        cuts,
        lambda at: F.transform(
            F.sequence(F.lit(1), F.size(at) - 1),
            lambda k: F.array_join(F.slice(words, F.element_at(at, k) + 1, F.element_at(at, k + 1) - F.element_at(at, k)), " "),
        ),
    )


def sentences(c: Column) -> Column:
    """The sentences of a paragraph; a formula never splits."""
    marked = F.regexp_replace(_mask_formulas(c), sentence_end_pattern(), "$1" + CUT)
    parts = F.split(marked, CUT)

    def pieces(s: Column) -> Column:
        words = F.filter(F.split(s, f"[{WS}]+"), lambda w: w != "")
        return bind(
            words, lambda w: F.when(F.size(w) >= LONG_RUN, _cut_long(w)).otherwise(F.array(F.array_join(w, " ")))
        )

    flat = F.flatten(F.transform(parts, pieces))
    return F.filter(F.transform(flat, lambda s: tidy(F.replace(s, F.lit(GAP), F.lit(" ")))), lambda s: s != "")


# The words and form of captions.
CAPTION = r"(?iU)^\W*(Figure|Fig\.?|Table)\s*([A-Z]?\d+[a-z]?)\s*[:.|]"
CAPTION_WORDS = (
    r"(?iU)^\W*(Figure|Fig\.?|Table|Tab\.|Listing|Algorithm|Chart|Image|Photo|Illustration|Plate|Exhibit)"
    r"\s*[A-Z]?\d+[a-z]?\s*[:.|—–-]"
)


def is_caption(c: Column) -> Column:
    return c.rlike(CAPTION_WORDS)


def is_table_caption(c: Column) -> Column:
    return c.rlike(r"(?iU)^\W*(Table|Tab\.)")


def caption_id(c: Column) -> Column:
    """Fig3 / Tab2 of a caption, else null."""
    kind = F.when(F.upper(F.regexp_extract(c, CAPTION, 1)).startswith("T"), "Tab").otherwise("Fig")
    return F.when(c.rlike(CAPTION), F.concat(kind, F.regexp_extract(c, CAPTION, 2)))


# The forms of a heading's number, and words that begin a heading of their own kind.
HEADING_NUMBER = r"^((\d{1,2}(\.\d{1,2})*|[A-Z](\.\d{1,2})*)\.?)\s+(.*)$"
CHAPTER_START = r"(?iU)^(chapter|part|book|section|appendix|lesson|unit|slide)\b"


def heading_spoken(c: Column) -> Column:
    """How a heading is said; a numbered one by its number."""
    number, title = F.regexp_extract(c, HEADING_NUMBER, 2), F.regexp_extract(c, HEADING_NUMBER, 5)
    word = F.when(number.rlike(r"^\p{L}$"), "Appendix").otherwise("Section")
    numbered = c.rlike(HEADING_NUMBER) & (F.length(title) > 0) & ~c.rlike(CHAPTER_START)
    return F.when(
        numbered, F.concat(word, F.lit(" "), number, F.lit(". "), F.regexp_replace(title, r"\.+$", ""), F.lit("."))
    ).otherwise(F.concat(F.regexp_replace(c, r"[.:]+$", ""), F.lit(".")))


def split_long(c: Column) -> Column:
    """Narration over 450 characters split at sentence marks and packed to at most 400."""
    parts = F.split(c, r"(?U)(?<=[.!?;])\s+")
    packed = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")),
        lambda s, p: F.when(
            (F.length(s["cur"]) > 0) & (F.length(s["cur"]) + F.length(p) > 400),
            F.struct(F.concat(s["done"], F.array(F.trim(s["cur"]))).alias("done"), F.concat(p, F.lit(" ")).alias("cur")),
        ).otherwise(F.struct(s["done"].alias("done"), F.concat(s["cur"], p, F.lit(" ")).alias("cur"))),
        lambda s: F.when(F.length(s["cur"]) > 0, F.concat(s["done"], F.array(F.trim(s["cur"])))).otherwise(s["done"]),
    )
    return F.when(F.length(c) <= 450, F.array(c)).otherwise(packed)


def pack(sentences: Column, first: int, rest: int) -> Column:
    """Greedy clips of whole sentences: the first within `first` characters, the others within `rest`."""
    limit = lambda s: F.when(F.size(s["done"]) == 0, first).otherwise(rest)
    return F.aggregate(
        sentences,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")),
        lambda s, p: F.when(
            (F.length(s["cur"]) > 0) & (F.length(s["cur"]) + F.length(p) > limit(s)),
            F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), p.alias("cur")),
        ).otherwise(
            F.struct(
                s["done"].alias("done"),
                F.when(F.length(s["cur"]) > 0, F.concat(s["cur"], F.lit(" "), p)).otherwise(p).alias("cur"),
            )
        ),
        lambda s: F.when(F.length(s["cur"]) > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]),
    )


def lesson_clips(c: Column) -> Column:
    """A tutor's text as clips (display formulas stay whole): first within 140 characters, others within 280."""
    paras = F.filter(F.transform(F.split(F.replace(c, F.lit("\r"), F.lit("")), "\n"), lambda p: F.trim(p)), lambda p: p != "")
    cut = lambda p: F.when(p.startswith("$$"), F.array(p)).otherwise(
        F.split(p, r"(?<=[.!?])\s+(?=[\"“(*]?[A-Z0-9$])")
    )
    parts = F.filter(F.transform(F.flatten(F.transform(paras, cut)), lambda p: F.trim(p)), lambda p: p != "")
    return pack(parts, 140, 280)


def answer_clips(c: Column) -> Column:
    """An answer as clips: first within 120 characters, others within 320."""
    parts = F.filter(
        F.transform(F.split(c, r"(?<=[.!?:])\s+(?=[A-Z0-9(“\"])"), lambda p: F.trim(p)), lambda p: p != ""
    )
    return pack(parts, 120, 320)


# Words that look like terms but are not, and the form of a term.
NOT_TERMS = ("II", "III", "IV", "VI", "VII", "VIII", "IX", "XI", "OK", "US", "UK", "EU", "AND", "OR", "NOT", "THE")
TERM = r"(?U)(?<![\w-])([A-Z][a-z]+[A-Z][A-Za-z]*|[A-Z]{2,}[a-z]?)(-\d+)?(?![\w-])"


def terms(c: Column) -> Column:
    """H7 for one text: acronyms and CamelCase names in order of appearance, plural s dropped."""
    found = F.filter(
        F.regexp_extract_all(c, F.lit(TERM), F.lit(0)), lambda t: ~t.isin(*NOT_TERMS) & (F.length(t) <= 24)
    )
    return F.transform(found, lambda t: F.when(t.rlike(r"^.{2,}\p{Lu}s$"), F.regexp_replace(t, "s$", "")).otherwise(t))


def estimate_ms(c: Column) -> Column:
    """Speaking time of a text without audio."""
    return (F.lit(400) + F.floor(F.length(c) * 1000 / 15)).cast("long")
