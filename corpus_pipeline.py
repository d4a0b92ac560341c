"""A training corpus from raw documents, in five stages.

Each stage reads what the one before it wrote, works on all of it, and returns the columns of documents; the last returns
the encoded texts. A null text is rejected with the language, a null source is a source of its own, rows without an id and
different texts under one id are documents like others; a table without rows stays one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import bpe, langid, mixing, near_dups, secret_scan
from studyloom.llm.common import stored
from studyloom.llm.queries import documents, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; what no language model accepts goes. `lang` becomes the language found."""
    model = langid.trained(docs.select("lang", "text"))
    found = langid.identified(docs, model, keep=COLUMNS)
    return found.filter("not rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with `_row`, a key made of id and text: different texts under one id, or without one, are different rows."""
    return docs.withColumn("_row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one of the smallest id, nulls last.

    Rows alike in id and text are one document, with the least of their other columns. Texts without words stay.
    """
    rows = keyed(docs.select(*COLUMNS))
    many = rows.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    d = rows.join(many, "_row")
    rest = [c for c in COLUMNS if c != "text"]
    # texts of repeated rows are shuffled combined
    alike = d.filter("_n > 1").groupBy("_row").agg(F.min(F.struct(*rest)).alias("_r"), F.min("text").alias("text")).select("_row", *[F.col(f"_r.{c}").alias(c) for c in rest], "text")
    single = stored(d.filter("_n = 1").select("_row", *COLUMNS).unionByName(alike), "rows")
    groups = stored(near_dups.near_duplicates(single, key="_row").select("_row", "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    first = groups.join(single.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("_first"))
    return single.join(first.select(F.col("_first.row").alias("_row")), "_row", "left_semi").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each stretch that a span covers put as one mark; clean texts stay as they are."""
    return secret_scan.redacted_documents(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; rows alike in id and text share the most copies of any of them."""
    d = keyed(docs.select(*COLUMNS))
    copies = mixing.mixed(d, key="_row").groupBy("_row").agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    return d.join(copies, "_row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with digests of them and of the text that they decode to."""
    return bpe.encoded(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: character models, MinHash and BPE are beyond SQL; the tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split(" ")[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
