"""The registered queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import bpe, collocations, langid, lm, mixing, near_dups, pii, quality, runs, secret_scan, sharding, token_counts, top_k
from studyloom.llm.common import WORD
from studyloom.queries.registry import Registry

R = Registry()


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; STUDYLOOM_TOKENIZERS names another folder for them."""
    if folder := os.environ.get("STUDYLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@R.add("op1_secret_scan")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, sf))


@R.add("op2_bpe")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf), vocabulary(), with_ids=False)


@R.add("op3_quality")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(documents(spark, sf))


@R.add("op4_top_k")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return top_k.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("id") % 20 == 0)


@R.add("op5_mixing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf))


@R.add("op6_language_id")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    model = langid.trained(docs.filter(langid.fold(F.col("doc_id")) != 0).select("lang", "text"))
    return langid.identified(docs.select("doc_id", "text"), model).withColumn("held_out", F.coalesce(langid.fold(F.col("doc_id")) == 0, F.lit(False)))


@R.add("op7_near_duplicates")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf), width=2, threshold=0.8)


@R.add("op8_lm_scores")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    model, words = lm.trained(docs.filter(~held_out))
    return lm.scored(docs, model, words, held_out)


@R.add("op9_token_counts")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf), vocabulary())


@R.add("op10_sharding")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shards(documents(spark, sf), [1.0] * 8)


def with_loops(docs: DataFrame) -> DataFrame:
    """`docs` with every tenth text, by the hash of its id, made periodic from some word on; these texts become their words,
    joined by spaces. A row without an id is left as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p) + 1
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, place(i).cast("int"))), " "))

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, F.transform(F.array(words), loop)[0]).otherwise(F.col("text")))


@R.add("op11_periodic_runs")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.periodic_runs(with_loops(documents(spark, sf).select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    d = found.withColumn("_most", longest)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_most.s")).alias("start"), F.col("_most.n").alias("length"), (-F.col("_most.q")).alias("period"),
        F.expr("1000 * _most.n div -_most.q").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@R.add("op13_personal_data")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf))


COLLOCATIONS = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents WHERE text IS NOT NULL
), size AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang
), gram AS (
  SELECT lang, k, w[i : i + k - 1] AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, range(1, 6) AS t(k))
), f AS (SELECT lang, k, p, count(*) AS c FROM gram GROUP BY lang, k, p HAVING count(*) >= 100
), drops AS (
  SELECT DISTINCT s.lang, s.p FROM (SELECT lang, c, unnest([p[1 : k - 1], p[2 : k]]) AS p FROM f WHERE k > 2) AS s JOIN f USING (lang, p, c)
), cut AS (
  SELECT x.lang, x.p, x.c AS a, l.c AS l, r.c AS r, z.n, j, (1000 * x.c::HUGEINT * z.n) // (l.c::HUGEINT * r.c) AS score
  FROM (SELECT lang, k, p, c, unnest(range(1, k)) AS j FROM f WHERE k > 1) AS x
  JOIN f AS l ON l.lang = x.lang AND l.p = x.p[1 : j] JOIN f AS r ON r.lang = x.lang AND r.p = x.p[j + 1 : x.k] JOIN size AS z ON z.lang = x.lang
  WHERE NOT EXISTS (SELECT 1 FROM drops AS d WHERE d.lang = x.lang AND d.p = x.p)
), worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1
), placed AS (SELECT *, array_to_string(p, ' ') AS phrase FROM worst)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM placed QUALIFY rank <= 2000
"""


@R.add("op12_collocations", COLLOCATIONS)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf))
