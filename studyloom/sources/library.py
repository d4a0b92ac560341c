"""The library's tables and their tolerant JSON forms.

Nested tables are Parquet with a `version` column; the JSON readers give a missing or mistyped field its default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCRIPT_VERSION = 1  # fixed value

MEMORY = "stage STRING, due STRING, stability DOUBLE, difficulty DOUBLE, reps INT, lapses INT, last STRING"
CARD = f"id STRING, front STRING, back STRING, visual STRING, visualOnFront BOOLEAN, segment INT, origin STRING, created STRING, {MEMORY}"
QUESTION = "id STRING, prompt STRING, options ARRAY<STRING>, correct INT, why ARRAY<STRING>, answer STRING, paper STRING, visual STRING, asked STRING"
CONCEPT = (
    f"id STRING, name STRING, definition STRING, background BOOLEAN, created STRING, {MEMORY}, "
    f"sources ARRAY<STRUCT<paper: STRING, title: STRING, segment: INT>>, questions ARRAY<STRUCT<{QUESTION}>>"
)
TURN = "q STRING, a STRING, segment INT, about STRING, `show` STRING, next ARRAY<STRING>, utc STRING"
PROGRESS = "links MAP<STRING, STRING>, done MAP<STRING, STRING>, recaps ARRAY<INT>, teach ARRAY<STRING>, reported ARRAY<STRING>, matched STRING, heard INT, at STRING"
OUTCOMES = {"learned": "learned", "testedOut": "tested out", "known": "known", "refreshed": "refreshed"}


def write_script(scripts: DataFrame, path: str) -> None:
    """Scripts (segments, sections or visuals by paper), one folder per version, replaced as a whole by the sink's commit."""
    versioned = scripts if "version" in scripts.columns else scripts.withColumn("version", F.lit(SCRIPT_VERSION))
    versioned.write.mode("overwrite").partitionBy("version").parquet(path)


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """Scripts of the current version (a partition filter); others are absent."""
    return spark.read.parquet(path).filter(F.col("version") == SCRIPT_VERSION).drop("version")


def _time(c: Column) -> Column:
    return c.try_cast("timestamp")


def _memory(e: Column, created: Column) -> Column:
    stage = F.when(e["stage"].isin("learning", "review", "relearning"), F.initcap(e["stage"])).otherwise("New")
    return F.struct(
        stage.alias("stage"), F.coalesce(_time(e["due"]), created).alias("due"), F.coalesce(e["stability"], F.lit(0.0)).alias("stability"),
        F.coalesce(e["difficulty"], F.lit(0.0)).alias("difficulty"), F.coalesce(e["reps"], F.lit(0)).alias("reps"), F.coalesce(e["lapses"], F.lit(0)).alias("lapses"),
        _time(e["last"]).alias("last_review"),
    )


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def read_cards(files: DataFrame, now: Column) -> DataFrame:
    """One row per card of files(paper_id, json); `due` defaults to `created`, that to `now`."""
    e = files.select("paper_id", F.posexplode(F.from_json("json", f"ARRAY<STRUCT<{CARD}>>")).alias("ord", "e"))
    c = F.col("e")
    made = F.coalesce(_time(c["created"]), now)
    given = F.sha2(F.concat_ws("|", "paper_id", F.col("ord").cast("string")), 256)
    return e.select(
        "paper_id", F.coalesce(c["id"], given).alias("card_id"), _text(c["front"]).alias("front"), _text(c["back"]).alias("back"), c["visual"].alias("visual"),
        F.coalesce(c["visualOnFront"], F.lit(False)).alias("visual_on_front"), F.coalesce(c["segment"], F.lit(0)).alias("segment"), _text(c["origin"]).alias("origin"),
        made.alias("created_utc"), _memory(c, made).alias("memory"),
    )


def iso(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def write_cards(cards: DataFrame) -> DataFrame:
    """files(paper_id, json): one row per card, so a large deck is many rows (read_cards takes decks of any size)."""
    m = F.col("memory")
    card = F.struct(
        F.col("card_id").alias("id"), "front", "back", "visual", F.col("visual_on_front").alias("visualOnFront"), "segment", "origin", iso("created_utc").alias("created"),
        F.lower(m["stage"]).alias("stage"), iso(m["due"]).alias("due"), m["stability"].alias("stability"), m["difficulty"].alias("difficulty"), m["reps"].alias("reps"),
        m["lapses"].alias("lapses"), iso(m["last_review"]).alias("last"),
    )
    return cards.select("paper_id", F.to_json(F.array(card)).alias("json"))


def read_concepts(files: DataFrame, now: Column) -> DataFrame:
    """One row per idea of files(learner_id, json), with its sources and questions."""
    e = files.select("learner_id", F.posexplode(F.from_json("json", f"ARRAY<STRUCT<{CONCEPT}>>")).alias("ord", "e"))
    c = F.col("e")
    made = F.coalesce(_time(c["created"]), now)
    none = lambda t: F.array().cast(t)
    source = lambda s: F.struct(_text(s["paper"]).alias("paper_id"), _text(s["title"]).alias("title"), F.coalesce(s["segment"], F.lit(0)).alias("segment"))
    question = lambda q: F.struct(
        q["id"].alias("id"), _text(q["prompt"]).alias("prompt"), F.coalesce(q["options"], none("array<string>")).alias("options"), F.coalesce(q["correct"], F.lit(-1)).alias("correct"),
        F.coalesce(q["why"], none("array<string>")).alias("why"), _text(q["answer"]).alias("answer"), _text(q["paper"]).alias("paper_id"), q["visual"].alias("visual"), _time(q["asked"]).alias("last_asked"),
    )
    empty = lambda arr, fn: F.coalesce(F.transform(arr, fn), F.transform(F.filter(arr, lambda x: F.lit(False)), fn))
    return e.select(
        "learner_id", F.coalesce(c["id"], F.sha2(F.concat_ws("|", F.col("learner_id").cast("string"), F.col("ord").cast("string")), 256)).alias("concept_id"), _text(c["name"]).alias("name"),
        _text(c["definition"]).alias("definition"), F.coalesce(c["background"], F.lit(False)).alias("background"), empty(c["sources"], source).alias("sources"),
        empty(c["questions"], question).alias("questions"), _memory(c, made).alias("memory"), made.alias("created_utc"),
    )


def write_concepts(concepts: DataFrame) -> DataFrame:
    """(learner_id, json): each idea of `read_concepts`' form as a JSON array of one, sources and questions within it.

    What is empty is left out: options with their right one and reasons, answers, visuals, times not known. A learner's file
    is put together by whoever stores it, so no learner's ideas are gathered here.
    """
    m = F.col("memory")
    full = lambda a: F.when(F.size(a) > 0, a)
    source = lambda s: F.struct(s["paper_id"].alias("paper"), s["title"].alias("title"), s["segment"].alias("segment"))

    def question(q: Column) -> Column:
        choice = F.size(q["options"]) > 0
        return F.struct(
            q["id"].alias("id"), q["prompt"].alias("prompt"), full(q["options"]).alias("options"), F.when(choice, q["correct"]).alias("correct"), F.when(choice, q["why"]).alias("why"),
            F.nullif(q["answer"], F.lit("")).alias("answer"), q["paper_id"].alias("paper"), q["visual"].alias("visual"), iso(q["last_asked"]).alias("asked"),
        )

    idea = F.struct(
        F.col("concept_id").alias("id"), "name", "definition", "background", F.transform("sources", source).alias("sources"), F.transform("questions", question).alias("questions"),
        iso("created_utc").alias("created"), F.lower(m["stage"]).alias("stage"), iso(m["due"]).alias("due"), m["stability"].alias("stability"), m["difficulty"].alias("difficulty"),
        m["reps"].alias("reps"), m["lapses"].alias("lapses"), iso(m["last_review"]).alias("last"),
    )
    return concepts.select("learner_id", F.to_json(F.array(idea)).alias("json"))


def read_help_log(files: DataFrame, now: Column) -> DataFrame:
    """Question and answer turns of files(paper_id, json)."""
    e = files.select("paper_id", F.posexplode(F.from_json("json", f"ARRAY<STRUCT<{TURN}>>")).alias("ord", "e"))
    c = F.col("e")
    return e.select(
        "paper_id", "ord", _text(c["q"]).alias("question"), _text(c["a"]).alias("answer"), F.coalesce(c["segment"], F.lit(0)).alias("segment"), c["about"].alias("about"), c["show"].alias("show"),
        F.coalesce(c["next"], F.array().cast("array<string>")).alias("followups"), F.coalesce(_time(c["utc"]), now).alias("asked_utc"),
    )


def read_figure_notes(files: DataFrame) -> DataFrame:
    """(paper_id, visual_id, note) of files(paper_id, json); an unreadable file gives no rows."""
    return files.select("paper_id", F.explode(F.from_json("json", "MAP<STRING, STRING>")).alias("visual_id", "note"))


def read_progress(files: DataFrame, now: Column) -> DataFrame:
    """Progress of files(learner_id, paper_id, json); an unknown outcome counts as learned."""
    names = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])
    e = files.select("learner_id", "paper_id", F.from_json("json", PROGRESS).alias("e"))
    c = F.col("e")
    empty = F.create_map().cast("map<string,string>")
    texts = lambda a: F.array_distinct(F.coalesce(a, F.array().cast("array<string>")))
    return e.select(
        "learner_id", "paper_id", F.coalesce(c["links"], empty).alias("links"),
        F.coalesce(F.transform_values(c["done"], lambda k, v: F.coalesce(F.try_element_at(names, v), F.lit("learned"))), empty).alias("done"),
        F.array_distinct(F.coalesce(c["recaps"], F.array().cast("array<int>"))).alias("recaps"), texts(c["teach"]).alias("teach"), texts(c["reported"]).alias("reported"),
        F.coalesce(_time(c["matched"]), now).alias("matched"), F.coalesce(c["heard"], F.lit(0)).alias("heard"), _text(c["at"]).alias("at"),
    )
