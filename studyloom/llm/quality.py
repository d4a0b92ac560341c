"""Quality rules with thresholds that adapt to each language and source.

Everything is a SQL expression over the row, a mergeable quantile sketch (KLL) per language and source, or a join. A row's
measures are computed once and stored; the sketches of a (language, source) merge into those of the language and of the
whole table, which stand in where a group is too small to speak for itself. A document goes when a measure lies far
outside the quartiles of its own group and far beyond the group's own tail, so no fixed cut-off decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import SPACE, stored

#: shares that are judged, and the least spread that each is taken to have: what a single sign, word or line makes in a text
MEASURES = {"symbol_share": 0.0025, "odd_share": 0.0025, "upper_share": 0.0025, "dup_line_share": 0.0125, "repeat_share": 0.0125, "word_length": 0.05}
#: measures that are odd when small, too
TWO_SIDED = ("word_length",)
#: how many spreads beyond a quantile are still usual: interquartile ranges beyond the quartile, or tails beyond the quantile
#: of TAIL, a tail being its distance from the quartile
TAIL = 0.05
REACH = 4.0
#: documents below which a group borrows the sketch of its language, and a language that of all
MIN_GROUP = 100
SKETCH_K = 400


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for the row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE))
    return F.array_remove(F.split(spaced, " "), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are sorted as longs that hold a hash in front and the place behind, as few bits as the places need; neighbours
    with the same hash are windows found again if their words agree, too. Places in order then give the words covered.
    """

    def found(w: Column) -> Column:
        n = F.size(w) - 2
        bits = F.ceil(F.log2((n + 1).cast("double"))).cast("int")
        return let(
            F.struct(w.alias("w"), bits.alias("bits"), F.call_function("shiftleft", F.lit(1).cast("long"), bits).alias("room")),
            lambda v: let(
                F.sort_array(
                    F.transform(
                        F.sequence(F.lit(0), n - 1),
                        lambda i: F.xxhash64(v["w"][i], v["w"][i + 1], v["w"][i + 2]).bitwiseAND(-v["room"]).bitwiseOR(i.cast("long")),
                    )
                ),
                lambda s: let(
                    F.sort_array(
                        F.transform(
                            F.filter(F.sequence(F.lit(0), n - 1), lambda k: same(v, s, k, k - 1, k > 0) | same(v, s, k, k + 1, k < n - 1)),
                            lambda k: s[k].bitwiseAND(v["room"] - 1).cast("int"),
                        )
                    ),
                    lambda p: F.aggregate(
                        p,
                        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")),
                        lambda acc, x: F.struct((acc["n"] + F.least(x - acc["at"], F.lit(3))).alias("n"), x.alias("at")),
                    )["n"],
                ),
            ),
        )

    def same(v: Column, s: Column, k: Column, j: Column, inside: Column) -> Column:
        a, b = (s[x].bitwiseAND(v["room"] - 1).cast("int") for x in (k, j))
        return F.when(
            inside,
            (s[k].bitwiseAND(-v["room"]) == s[j].bitwiseAND(-v["room"])) & (v["w"][a] == v["w"][b]) & (v["w"][a + 1] == v["w"][b + 1]) & (v["w"][a + 2] == v["w"][b + 2]),
        ).otherwise(F.lit(False))

    return F.when(F.size(words) >= 4, let(words, found)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row of base numbers and measures for each row of `docs`."""
    t = F.coalesce(docs[text], F.lit(""))
    d = docs.select(docs[key].alias("id"), docs[lang].cast("string").alias("lang"), docs[source].cast("string").alias("source"), t.alias("text"), words_of(t).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    d = d.select(
        "id", "lang", "source", "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        lines.alias("lines"),
    )
    d = d.select(
        "id", "lang", "source", "n_words", "word_chars", "n_repeat_words",
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(r"[^\p{L}\p{M}\s]")).alias("n_odd"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
    )
    per_word, per_char = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars"))
    return d.select(
        "id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / per_word).alias("symbol_share"),
        (F.col("n_odd") / per_char).alias("odd_share"),
        (F.col("n_upper") / per_char).alias("upper_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / per_word).alias("repeat_share"),
        (F.col("word_chars") / per_word).alias("word_length"),
    )


def fences(measures: DataFrame) -> DataFrame:
    """(lang, source, low_…, high_…) for every language and source with a document that passed the base rules."""
    groups = measures.filter("not base_failed").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES]
    )
    groups = stored(groups, "quality-sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES]]
    langs = groups.groupBy("lang").agg(*merged)
    whole = groups.agg(*merged).first()  # one sketch of bounded size for each measure
    pick = lambda m: F.when(F.col("g.n") >= MIN_GROUP, F.col(f"g.{m}")).when(F.col("l.n") >= MIN_GROUP, F.col(f"l.{m}")).otherwise(F.lit(whole[m]).cast("binary"))
    j = groups.alias("g").join(langs.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")))
    out = [F.col("g.lang").alias("lang"), F.col("g.source").alias("source")]
    for m, least in MEASURES.items():
        q0, q1, q3, q4 = (F.kll_sketch_get_quantile_double(pick(m), F.lit(q)) for q in (TAIL, 0.25, 0.75, 1 - TAIL))
        reach = lambda spread, least=least: F.lit(REACH) * F.greatest(spread, F.lit(least))
        out += [F.least(q1 - reach(q3 - q1), q0 - reach(q1 - q0)).alias(f"low_{m}"), F.greatest(q3 + reach(q3 - q1), q4 + reach(q4 - q3)).alias(f"high_{m}")]
    return j.select(*out)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed) for every row.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. kept is false then, and else unless a
    measure lies outside its group's fences; failed lists those measures. A null text has no words; null languages and
    sources are groups of their own. Every row of repeated ones is judged and counts in the sketches. Other columns are
    not looked at; an empty table gives none. Fences need a group's rows only in sketches, combined before the shuffle.
    """
    m = stored(measured(docs, key, text, lang, source), "quality-measures")
    f = fences(m).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[f"{side}_{x}" for x in MEASURES for side in ("low", "high")])
    j = m.join(f, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    tests = []
    for x in MEASURES:
        odd = F.col(x) > F.col(f"high_{x}")
        tests.append(F.when(odd | (F.col(x) < F.col(f"low_{x}")) if x in TWO_SIDED else odd, F.lit(x)))
    failed = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*tests)))
    return j.select(
        F.col("id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"), failed.alias("failed"),
    )
