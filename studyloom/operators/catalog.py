"""Bibliographic catalogue: search, lookup, identity, recommendation, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions import titles as N
from studyloom.session import cut_lineage

PAGE_SIZE = 20  # fixed value: results per page
SAME_TITLE = 0.8  # fixed value: similarity from which two titles are one work's
LOOKED_AT = 8  # fixed value: titles shorter than this are never looked up
LONG_TITLE = 12  # fixed value: normalised titles must be longer than this to count as the same
SEEDS, CITING_SEEDS, CITING_RESULTS = 15, 20, 30  # fixed values


def search(works: DataFrame, words: str, page: int = 1, text: str = "text", key: str = "key") -> DataFrame:
    """D8, re-aimed (the reference asks a web service): works holding all words, by TF-IDF, 20 per page, with the total.

    One scan for the counts and one for the hits; the page is a top-k (`TakeOrderedAndProject`), never a global sort
    or window.
    """
    wanted = sorted({w for w in words.lower().split() if w})
    d = works.withColumn("_w", F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"))
    occurrences = lambda w: F.size(F.filter("_w", lambda x: x == F.lit(w)))
    tf = [occurrences(w) for w in wanted]
    d = d.withColumns({f"_tf{i}": c for i, c in enumerate(tf)}).drop("_w")
    has = [F.col(f"_tf{i}") > 0 for i in range(len(wanted))]
    every = has[0]
    for h in has[1:]:
        every = every & h
    counts = d.agg(
        F.count("*").alias("n"), F.count_if(every).alias("total"), *[F.count_if(h).alias(f"df{i}") for i, h in enumerate(has)]
    )
    stat = lambda c: counts.select(c).scalar()
    score = sum(
        (F.col(f"_tf{i}") * F.log(stat("n").cast("double") / F.greatest(F.lit(1), stat(f"df{i}"))) for i in range(len(wanted))), F.lit(0.0)
    )
    hits = d.filter(every).select(key, F.round(score, 6).alias("score"))
    start = (page - 1) * PAGE_SIZE
    return hits.orderBy(F.col("score").desc(), key).offset(start).limit(PAGE_SIZE).select(key, "score", stat("total").alias("total"))


def lookup(queries: DataFrame, works: DataFrame, preprints: DataFrame) -> DataFrame:
    """One work per query(query_id, text): by arXiv DOI, then preprint record, then a stub; by DOI; a URL is a stub.

    works(doi, key, title, …) and preprints(arxiv, title) are joined on their ids only.
    """
    q = queries.select("query_id", N.parse_query(F.col("text")).alias("_q")).select("query_id", "_q.kind", "_q.value")
    doi = F.when(F.col("kind") == "arxiv", F.concat(F.lit("10.48550/arxiv."), F.lower("value"))).when(F.col("kind") == "doi", F.lower("value"))
    by_doi = works.groupBy(F.lower("doi").alias("_doi")).agg(F.min(F.struct("key", "title")).alias("_work"))
    pre = preprints.groupBy(F.col("arxiv").alias("_arxiv")).agg(F.min("title").alias("_pre"))
    j = (
        q.withColumn("_doi", doi)
        .join(by_doi, "_doi", "left")
        .withColumn("_arxiv", F.when((F.col("kind") == "arxiv") & F.col("_work").isNull(), F.col("value")))
        .join(pre, "_arxiv", "left")
    )
    arxiv_key = F.concat(F.lit("arXiv:"), F.col("value"))
    name = F.nullif(F.regexp_replace(F.regexp_extract("value", r"^\w+://[^/?#]+(?:/[^?#]*)?/([^/?#]*)", 1), r"\.[^.]*$", ""), F.lit(""))
    key = F.when(F.col("kind") == "url", F.col("value")).when(F.col("kind") == "arxiv", F.coalesce("_work.key", arxiv_key)).otherwise(F.col("_work.key"))
    title = (
        F.when(F.col("kind") == "url", F.coalesce(name, F.col("value")))
        .when(F.col("kind") == "arxiv", F.coalesce("_work.title", "_pre", arxiv_key))
        .otherwise(F.col("_work.title"))
    )
    return j.select("query_id", "kind", key.alias("key"), title.alias("title"))


def _title_sets(df: DataFrame, title: str) -> DataFrame:
    return df.withColumn("_set", F.array_sort(N.title_words(F.col(title)))).filter(F.size("_set") > 0)


def similar_titles(left: DataFrame, right: DataFrame, threshold: float = SAME_TITLE) -> DataFrame:
    """Pairs of word sets (left, right) with similarity ≥ threshold: an exact prefix-filtered join.

    `left(_set)` and `right(_set)` hold distinct sets, so copies of one title are one row. Words are ordered by how
    many right-hand sets hold them, rarest first; two sets this similar must share a word among their first
    n − ⌈threshold·n⌉ + 1, so only those prefix words are joined, and common words stay out of the join unless a
    title has nothing else. Nothing is capped.
    """

    def words(df: DataFrame) -> DataFrame:
        return df.select("_set", F.explode("_set").alias("_word"))

    df_right = words(right).groupBy("_word").count().withColumnRenamed("count", "_df")

    def prefixes(df: DataFrame) -> DataFrame:
        ranked = words(df).join(df_right, "_word", "left").select(
            "_set", F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_word").alias("w")).alias("r")
        )
        n = F.size("_set")
        length = n - F.ceil(n * threshold - 1e-9).cast("int") + 1
        # a title's own words: the group is one title, never more
        return ranked.groupBy("_set").agg(F.array_sort(F.collect_list("r")).alias("_r")).select(
            "_set", F.explode(F.slice("_r", F.lit(1), length)).alias("_p")
        ).select("_set", F.col("_p.w").alias("_word"))

    a = prefixes(left).withColumnRenamed("_set", "_a")
    b = prefixes(right).withColumnRenamed("_set", "_b")
    na, nb = F.size("_a"), F.size("_b")
    close = (na >= nb * threshold - 1e-9) & (nb >= na * threshold - 1e-9)
    pairs = a.join(b, "_word").filter(close).select("_a", "_b").distinct()
    return pairs.withColumn("similarity", N.set_similarity(F.col("_a"), F.col("_b"))).filter(F.col("similarity") >= threshold)


def identify(papers: DataFrame, works: DataFrame, paper: str = "paper_id", key: str = "key", title: str = "title") -> DataFrame:
    """(paper, key, similarity): the most similar work with (nearly) the same title, if any."""
    clean = F.trim(F.regexp_replace(title, r"[,:;|!?()\[\]{}\"]", " "))
    p = _title_sets(papers.filter(F.length(clean) >= LOOKED_AT), title).select(paper, "_set")
    # word sets are read four times below and are far smaller than the works, so they are stored once
    w = cut_lineage(_title_sets(works, title).groupBy("_set").agg(F.min(key).alias(key)))
    pairs = similar_titles(p.select("_set").distinct(), w.select("_set"))
    best = pairs.join(w.withColumnRenamed("_set", "_b"), "_b").groupBy("_a").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), F.col(key))).alias("_m")
    )
    return p.join(best.withColumnRenamed("_a", "_set"), "_set").select(
        paper, F.col(f"_m.{key}").alias(key), (-F.col("_m.s")).alias("similarity")
    )


def citing(works: DataFrame, citations: DataFrame, seeds: DataFrame, since_year: int) -> DataFrame:
    """Recent works with a PDF that cite one of ≤ 20 seeds, most cited first, 30 of them.

    seeds(key, rank). The seeds are at most 20 rows, so their join is a broadcast whatever the catalogue's size.
    """
    few = seeds.orderBy("rank").limit(CITING_SEEDS).select(F.col("key").alias("cited"))
    keys = citations.join(few, "cited", "left_semi").select(F.col("citing").alias("key")).distinct()
    recent = works.filter((F.col("year") >= since_year) & (F.size("pdfs") > 0))
    return recent.join(keys, "key", "left_semi").orderBy(F.col("citations").desc(), "key").limit(CITING_RESULTS)


def provenance(papers: DataFrame, sources: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Unknown / looked up and not found / found, per paper."""
    ids = F.coalesce("doi", "arxiv", "openalex")
    s = sources.select(paper, "doi", "arxiv", "openalex", F.lit(True).alias("_seen"))
    state = F.when(F.col("_seen").isNull(), "unknown").when(ids.isNull(), "not found").otherwise("found")
    return papers.join(s, paper, "left").withColumn("state", state).drop("_seen")


def library_sources(
    papers: DataFrame, sources: DataFrame, works: DataFrame, lookups: int, paper: str = "paper_id", order: str = "rank"
) -> DataFrame:
    """(paper, doi, arxiv, openalex) known already, and found for at most `lookups` papers never looked up."""
    state = provenance(papers, sources, paper)
    known = state.filter("state = 'found'").select(paper, "doi", "arxiv", "openalex")
    ask = papers.join(sources.select(paper), paper, "left_anti").orderBy(order).limit(lookups)
    found = identify(ask, works, paper).join(works.select("key", "doi", "arxiv", "openalex"), "key")
    return known.unionByName(found.select(paper, "doi", "arxiv", "openalex"))


def in_library(found: DataFrame, library: DataFrame, key: str = "key") -> DataFrame:
    """Keys of found works that are in the library: same DOI, arXiv id, catalogue id or (long) normalised title.

    The OR of four conditions is four equi semi joins; one condition would be a nested loop.
    """
    hits = []
    for c in ("doi", "arxiv", "openalex"):
        lib = library.select(F.lower(c).alias("_id")).filter("_id IS NOT NULL").distinct()
        hits.append(found.select(key, F.lower(c).alias("_id")).join(lib, "_id", "left_semi").select(key))
    norm = N.normalize_title(F.col("title"))
    lib = library.select(norm.alias("_id")).distinct()
    long = found.select(key, norm.alias("_id")).filter(F.length("_id") > LONG_TITLE)
    hits.append(long.join(lib, "_id", "left_semi").select(key))
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.distinct()


def distinct_titles(works: DataFrame, order: list[Column]) -> DataFrame:
    """First work of each normalised title."""
    cols = works.columns
    ranked = works.withColumn("_t", N.normalize_title(F.col("title")))
    first = ranked.groupBy("_t").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_w"))
    return first.select("_w.*")


def recommend(papers: DataFrame, sources: DataFrame, works: DataFrame, citations: DataFrame, since_year: int) -> DataFrame:
    """Works like the library's 15 newest papers: those citing them, minus the library, one per title."""
    seeds = papers.orderBy(F.col("added").desc(), "paper_id").limit(SEEDS).select("paper_id", F.col("added").alias("_added"))
    ids = seeds.join(sources, "paper_id").filter("openalex IS NOT NULL")
    cited = ids.select(F.col("openalex").alias("key"), (-F.col("_added")).alias("rank"))
    found = citing(works, citations, cited, since_year)
    library = papers.join(sources, "paper_id", "left").select("title", "doi", "arxiv", "openalex")
    fresh = found.join(in_library(found, library), "key", "left_anti")
    return distinct_titles(fresh, [-F.col("citations"), F.col("key")])


def merge_pages(pages: DataFrame, key: str = "key", order: tuple[str, ...] = ("page", "rank"), keep: int | None = None) -> DataFrame:
    """Result pages appended, the first of each key kept; `keep` truncates the list (recommendations: 30)."""
    cols = pages.columns
    first = pages.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_w")).select("_w.*")
    return first if keep is None else first.orderBy(*order).limit(keep)


def new_documents(files: DataFrame, papers: DataFrame) -> DataFrame:
    """files(paper_id, …) not imported before, one per content id."""
    return files.dropDuplicates(["paper_id"]).join(papers.select("paper_id"), "paper_id", "left_anti")


def library(papers: DataFrame, scripts: DataFrame) -> DataFrame:
    """Papers that have a script, newest first."""
    return papers.join(scripts.select("paper_id"), "paper_id", "left_semi").orderBy(F.col("added_utc").desc(), "paper_id")


def delete_paper(papers: DataFrame, paper_id: str) -> DataFrame:
    """The table without a paper; an id that is not 16 hex digits deletes nothing."""
    ok = F.lit(paper_id).rlike("^[0-9a-f]{16}$")
    return papers.filter(~(ok & (F.col("paper_id") == paper_id)))

