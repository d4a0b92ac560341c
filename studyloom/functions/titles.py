"""Identifiers, titles and addresses of works as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyloom.functions.text import bind

ARXIV = r"(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv[:.]\s*)?(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?(?:\.pdf)?"
DOI = r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)"
BARE_ARXIV = r"(?i)^(arxiv:\s*)?\d{4}\.\d{4,5}(v\d+)?$"


def accent_tables() -> tuple[str, str]:
    """Letters with marks and their base letters, from the Unicode decomposition of the Latin blocks."""
    src, dst = [], []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and base[0].isalpha():
            src.append(chr(cp))
            dst.append(base[0])
    return "".join(src), "".join(dst)


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def arxiv_of(c: Column) -> Column:
    """The arXiv id in an address, DOI or text that mentions arXiv, without its version."""
    t = F.trim(c)
    return F.when(F.contains(F.lower(t), F.lit("arxiv")), _some(F.regexp_extract(t, ARXIV, 1)))


def doi_of(c: Column) -> Column:
    """The DOI in a text, without final punctuation."""
    return _some(F.regexp_replace(F.regexp_extract(c, DOI, 1), r"[.,;)]+$", ""))


def parse_query(c: Column) -> Column:
    """struct<kind, value> of a typed query: arxiv, doi, url or words."""
    t = F.trim(c)
    bare, url = t.rlike(BARE_ARXIV), t.rlike(r"(?i)^https?://")
    spaced = F.contains(t, F.lit(" "))
    arxiv, doi = arxiv_of(t), doi_of(t)
    is_arxiv = arxiv.isNotNull() & (bare | url | F.lower(t).startswith("arxiv"))
    out = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    return (
        F.when(is_arxiv, out("arxiv", arxiv))
        .when(bare, out("arxiv", F.regexp_replace(t, r"(?i)^arxiv:\s*|v\d+$", "")))
        .when(doi.isNotNull() & ~spaced, out("doi", doi))
        .when(url & ~spaced, out("url", t))
        .otherwise(out("words", t))
    )


def normalize_title(c: Column) -> Column:
    """D3: letters and digits only, without accents, lower case; for equality."""
    src, dst = accent_tables()
    return F.lower(F.regexp_replace(F.translate(c, src, dst), r"[^\p{L}\p{Nd}]", ""))


def title_words(c: Column) -> Column:
    """The distinct words of a title that are longer than one character."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared words over all words of two word sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def word_index(words: Column) -> Column:
    """D5, the other way: a text's words as a map word → positions, in its own row: equal words follow each other once sorted."""

    def entries(at: Column) -> Column:
        word = lambda k: F.try_element_at(at, k)["w"]
        starts = F.filter(F.transform(at, lambda x, i: F.when((i == 0) | (word(F.greatest(i, F.lit(1))) != x["w"]), i)), lambda i: i.isNotNull())

        def runs(ss: Column) -> Column:
            end = lambda k: F.coalesce(F.try_element_at(ss, k + 2), F.size(at))
            places = lambda s, k: F.transform(F.slice(at, s + 1, end(k) - s), lambda x: x["p"])
            return F.transform(ss, lambda s, k: F.struct(word(s + 1).alias("w"), places(s, k).alias("ps")))

        return F.map_from_entries(bind(starts, runs))

    return bind(F.array_sort(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p")))), entries)


def abstract_from_index(index: Column) -> Column:
    """A map word → positions turned back into text; a leading heading is dropped."""
    pairs = F.flatten(
        F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))
    )
    text = F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
    return _some(F.regexp_replace(text, r"(?iU)^(abstract|summary)\b[\s.:—-]*", ""))


def order_pdfs(urls: Column) -> Column:
    """Addresses to try, in order: arXiv, preprint servers, files, pages, PubMed Central; abstract pages become PDFs."""

    def rank(u: Column) -> Column:
        t = F.lower(u)
        return (
            F.when(F.contains(t, F.lit("arxiv.org/")), 0)
            .when(t.rlike(r"biorxiv\.org|medrxiv\.org|chemrxiv|ssrn\.com"), 1)
            .when(t.rlike(r"ncbi\.nlm\.nih\.gov|europepmc\.org"), 4)
            .when(t.endswith(".pdf") | t.rlike(r"/pdf|download"), 2)
            .otherwise(3)
        )

    direct = lambda u: F.when(
        F.contains(F.lower(u), F.lit("arxiv.org/abs/")) & arxiv_of(u).isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_of(u))
    ).otherwise(u)
    kept = F.array_distinct(F.transform(F.filter(urls, lambda u: u.isNotNull() & (F.trim(u) != "")), direct))
    ranked = F.transform(kept, lambda u, i: F.struct(rank(u).alias("r"), i.alias("i"), u.alias("u")))
    return F.transform(F.array_sort(ranked), lambda x: x["u"])


def host(url: Column) -> Column:
    """Host without `www.`; the text itself when it is no address."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(h != "", F.replace(F.lower(h), F.lit("www."), F.lit(""))).otherwise(url)


def external_id(arxiv: Column, doi: Column) -> Column:
    """The id another catalogue knows a work by."""
    return F.coalesce(F.concat(F.lit("ARXIV:"), arxiv), F.concat(F.lit("DOI:"), doi))


def clean_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"(?U)\s+", " "))
