"""Raw files: format, text, content id (S1–S4, S18). Input is `spark.read.format("binaryFile")` or any (path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """files(path, content) below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def _head(content: Column, n: int) -> Column:
    """The first bytes as Latin-1 text, one character per byte."""
    return F.decode(F.substring(content, 1, n), "ISO-8859-1")


def is_pdf(content: Column) -> Column:
    """S18."""
    return F.contains(_head(content, 1024), F.lit("%PDF-"))


def decode_text(content: Column) -> Column:
    """By byte order mark, else UTF-8 if it is valid, else Latin-1."""
    lead = F.hex(F.substring(content, 1, 3))
    body = lambda n: F.substring(content, n + 1, 1 << 30)
    return (
        F.when(lead == "EFBBBF", F.decode(body(3), "UTF-8"))
        .when(lead.startswith("FFFE"), F.decode(body(2), "UTF-16LE"))
        .when(lead.startswith("FEFF"), F.decode(body(2), "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def content_id(content: Column) -> Column:
    """S3: the first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def detect_format(path: Column, content: Column) -> Column:
    """Pdf, epub, docx, pptx, odt, png, jpeg, webp, html, markdown, text, or null.

    Zip kinds are recognised by member names, which zip headers store uncompressed; nothing is unpacked.
    """
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    lead = F.hex(F.substring(content, 1, 12))
    raw = F.decode(content, "ISO-8859-1")
    member = lambda name: F.contains(raw, F.lit(name))
    zipped = (
        F.when(member("application/epub+zip") | member("META-INF/container.xml"), "epub")
        .when(member("word/document.xml"), "docx")
        .when(member("ppt/presentation.xml"), "pptx")
        .when(member("application/vnd.oasis.opendocument.text") | (member("content.xml") & (ext == ".odt")), "odt")
    )
    start = F.substring(content, 1, 8192)
    utf16 = lead.startswith("FFFE") | lead.startswith("FEFF")
    binary = F.contains(F.decode(start, "ISO-8859-1"), F.lit("\0")) & ~utf16
    text = F.when(utf16, F.decode(F.substring(content, 3, 8190), "UTF-16LE")).otherwise(F.decode(start, "ISO-8859-1"))
    lower = F.lower(F.regexp_replace(text, r"(?U)^[\s\x{FEFF}ï»¿]+", ""))
    html = (
        ext.isin(".html", ".htm", ".xhtml") | lower.startswith("<!doctype html") | lower.startswith("<html")
        | (lower.startswith("<?xml") & F.contains(lower, F.lit("<html"))) | (~ext.isin(".md", ".txt") & lower.rlike(r"<(body|p|div|article)[\s>]"))
    )
    marked = text.rlike(r"(?m)^#{1,6}\s+\S|^```|\]\([^)]+\)|^\s*[-*]\s+\S")
    return (
        F.when(is_pdf(content), "pdf")
        .when(lead.startswith("504B0304"), zipped)
        .when(lead.startswith("89504E47"), "png")
        .when(lead.startswith("FFD8FF"), "jpeg")
        .when((F.length(content) > 12) & lead.rlike("^52494646.{8}57454250"), "webp")
        .when(binary, None)
        .when(html, "html")
        .when(ext.isin(".md", ".markdown", ".mdown", ".mkd"), "markdown")
        .when(ext.isin(".txt", ".text"), "text")
        .when(marked, "markdown")
        .when(ext.isin("", ".rst", ".org", ".tex", ".log", ".csv"), "text")
    )


def import_files(files: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, path, format, content) of readable files not imported before, one per content."""
    from studyloom.operators.catalog import new_documents

    f = files.select(content_id(F.col("content")).alias("paper_id"), "path", detect_format(F.col("path"), F.col("content")).alias("format"), "content")
    return new_documents(f.filter("format IS NOT NULL"), papers)
