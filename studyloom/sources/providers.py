"""Provider records to catalogue rows (S13–S16): JSON and XML read with schemas, no per-record code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions import titles as N

_PLACE = "pdf_url STRING, landing_page_url STRING, source STRUCT<display_name: STRING>"
OPENALEX = (
    f"id STRING, doi STRING, title STRING, publication_year INT, cited_by_count INT, abstract_inverted_index MAP<STRING, ARRAY<INT>>, "
    f"authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, primary_location STRUCT<{_PLACE}>, best_oa_location STRUCT<{_PLACE}>, locations ARRAY<STRUCT<{_PLACE}>>"
)
S2 = (
    "paperId STRING, title STRING, venue STRING, abstract STRING, url STRING, year INT, citationCount INT, authors ARRAY<STRUCT<name: STRING>>, "
    "externalIds STRUCT<ArXiv: STRING, DOI: STRING>, openAccessPdf STRUCT<url: STRING>"
)
ATOM = "entry ARRAY<STRUCT<title: STRING, summary: STRING, published: STRING, author: ARRAY<STRUCT<name: STRING>>>>"
OCR = (
    "pages ARRAY<STRUCT<index: INT, markdown: STRING, dimensions: STRUCT<width: DOUBLE, height: DOUBLE>, "
    "blocks: ARRAY<STRUCT<type: STRING, content: STRING, top_left_x: DOUBLE, top_left_y: DOUBLE, bottom_right_x: DOUBLE, bottom_right_y: DOUBLE>>, "
    "images: ARRAY<STRUCT<id: STRING, image_base64: STRING>>>>"
)


def _some(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def _or_empty(c: Column, t: str = "array<string>") -> Column:
    return F.coalesce(c, F.array().cast(t))


def _arxiv_pdf(arxiv: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)


def _names(c: Column) -> Column:
    return F.filter(_or_empty(c), lambda n: _some(n).isNotNull())


def read_openalex(records: DataFrame) -> DataFrame:
    """Works of records(json), those with a title and a free PDF."""
    d = records.withColumn("w", F.from_json("json", OPENALEX))
    w = F.col("w")
    places = F.coalesce(w["locations"], F.filter(F.array(w["best_oa_location"]), lambda x: F.lit(False)))
    doi = N.doi_of(_some(w["doi"]))
    links = F.flatten(F.transform(places, lambda p: F.array(p["landing_page_url"], p["pdf_url"])))
    arxiv = F.filter(F.transform(F.concat(F.array(doi), links), N.arxiv_of), lambda x: x.isNotNull())
    d = d.withColumns({"doi": doi, "_arxivs": arxiv}).withColumn("arxiv", F.try_element_at("_arxivs", F.lit(1)))
    pdfs = F.concat(F.array(w["best_oa_location"]["pdf_url"]), F.transform(places, lambda p: p["pdf_url"]), F.array(_arxiv_pdf(F.col("arxiv"))))
    best, first = w["best_oa_location"], w["primary_location"]
    openalex = F.substring_index(_some(w["id"]), "/", -1)
    title = N.clean_title(_some(w["title"]))
    out = d.select(
        *records.columns, F.coalesce(openalex, title).alias("key"), title.alias("title"), _names(F.transform(w["authorships"], lambda a: a["author"]["display_name"])).alias("authors"),
        w["publication_year"].alias("year"), F.coalesce(_some(first["source"]["display_name"]), _some(best["source"]["display_name"])).alias("venue"),
        N.abstract_from_index(w["abstract_inverted_index"]).alias("abstract"), F.coalesce(w["cited_by_count"], F.lit(0)).alias("citations"), N.order_pdfs(pdfs).alias("pdfs"),
        F.coalesce(F.concat(F.lit("https://doi.org/"), "doi"), _some(best["landing_page_url"]), _some(first["landing_page_url"])).alias("page"), "doi", "arxiv", openalex.alias("openalex"),
    )
    return out.filter(F.col("title").isNotNull() & (F.size("pdfs") > 0))


def read_s2(records: DataFrame) -> DataFrame:
    """Works of the other provider's records(json); "open access" links to doi.org are pages, not files."""
    d = records.withColumn("p", F.from_json("json", S2))
    p = F.col("p")
    arxiv, doi = _some(p["externalIds"]["ArXiv"]), _some(p["externalIds"]["DOI"])
    file = _some(p["openAccessPdf"]["url"])
    file = F.when(~F.contains(file, F.lit("doi.org/")), file)
    out = d.select(
        *records.columns, F.concat(F.lit("S2:"), _some(p["paperId"])).alias("key"), N.clean_title(_some(p["title"])).alias("title"), _names(F.transform(p["authors"], lambda a: a["name"])).alias("authors"),
        p["year"].alias("year"), F.coalesce(_some(p["venue"]), F.when(arxiv.isNotNull(), "arXiv")).alias("venue"), _some(p["abstract"]).alias("abstract"),
        F.coalesce(p["citationCount"], F.lit(0)).alias("citations"), N.order_pdfs(F.array(file, _arxiv_pdf(arxiv))).alias("pdfs"),
        F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("https://arxiv.org/abs/"), arxiv), _some(p["url"])).alias("page"), doi.alias("doi"), arxiv.alias("arxiv"), F.lit(None).cast("string").alias("openalex"),
    )
    return out.filter(F.col("title").isNotNull() & F.col("key").isNotNull() & (F.size("pdfs") > 0))


def read_arxiv(records: DataFrame) -> DataFrame:
    """The first Atom entry of records(arxiv, xml)."""
    e = F.from_xml(F.col("xml"), ATOM)["entry"]
    line = lambda c: _some(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    d = records.withColumn("e", F.try_element_at(e, F.lit(1)))
    x = F.col("e")
    return d.select(
        *[c for c in records.columns if c != "xml"], F.concat(F.lit("arXiv:"), "arxiv").alias("key"), line(x["title"]).alias("title"), F.filter(F.transform(x["author"], lambda a: a["name"]), lambda n: n.isNotNull()).alias("authors"),
        F.substring(F.trim(x["published"]), 1, 4).try_cast("int").alias("year"), F.lit("arXiv").alias("venue"), line(x["summary"]).alias("abstract"), F.array(_arxiv_pdf(F.col("arxiv"))).alias("pdfs"),
        F.concat(F.lit("https://arxiv.org/abs/"), "arxiv").alias("page"),
    ).filter("title IS NOT NULL")


def read_ocr(responses: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, blocks, images) of responses(doc, json)."""
    p = responses.select(doc, F.explode(F.from_json("json", OCR)["pages"]).alias("p"))
    num = lambda c: F.coalesce(c, F.lit(0.0))
    page = F.coalesce(F.col("p.index"), F.lit(0)).alias("page")
    text = lambda c: F.coalesce(c, F.lit(""))
    pages = p.select(doc, page, num(F.col("p.dimensions.width")).alias("width"), num(F.col("p.dimensions.height")).alias("height"), text(F.col("p.markdown")).alias("markdown"))
    b = p.select(doc, page, F.posexplode("p.blocks").alias("ord", "b"))
    blocks = b.select(
        doc, "page", "ord", text(F.col("b.type")).alias("kind"), num(F.col("b.top_left_x")).alias("x0"), num(F.col("b.top_left_y")).alias("y0"), num(F.col("b.bottom_right_x")).alias("x1"),
        num(F.col("b.bottom_right_y")).alias("y1"), text(F.col("b.content")).alias("content"),
    )
    i = p.select(doc, page, F.explode("p.images").alias("i"))
    data = F.regexp_replace(text(F.col("i.image_base64")), r"(?s)^.*?base64,", "")
    images = i.select(doc, "page", text(F.col("i.id")).alias("image_id"), F.try_to_binary(data, F.lit("base64")).alias("bytes")).filter("bytes IS NOT NULL AND length(bytes) > 0")
    return pages, blocks, images
