"""Narration segments: what is said, what is on screen, where to stop and seek.

Running values (forward fills, counts, islands) use `plans.ordered.scan`; neighbours at a fixed distance are equi joins
on (paper, idx). Both spread a long paper over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.plans.ordered import Running, by_index, scan
from studyloom.session import cut_lineage, stored

PAPER, IDX = "paper_id", "idx"
KEEP_EXPLAINING = 3  # fixed value: sentences that keep a visual up
KEEP_FIGURE = 2  # fixed value: the same for figures attached later

EQUATION_MENTION = r"(?i)\b(?:Equations?|Eqs?\.?|Formula)\s*\(?([A-Z]?\.?\d+(?:\.\d+)?[a-z]?)\)?"
FIGURE_MENTION = r"(?i)\b((?:Figures?|Figs?\.?|Tables?)\s*[A-Z]?\d+[a-z]?)\b"


def pause_ms(kind: Column, last_of_unit: Column, paragraph_end: Column) -> Column:
    """Silence after a clip."""
    return (
        F.when(kind == "title", 900)
        .when(kind == "heading", 700)
        .when((kind == "equation") & last_of_unit, 900)
        .when(last_of_unit & paragraph_end, 450)
        .otherwise(120)
    )


def with_pauses(segments: DataFrame, unit: str = "unit_id") -> DataFrame:
    d = scan(segments, [PAPER], [IDX], by_index(IDX), [Running("_next_unit", "lead", F.col(unit))])
    last = F.col("_next_unit").isNull() | (F.col("_next_unit") != F.col(unit))
    return d.withColumn("pause_ms", pause_ms(F.col("kind"), last, F.col("paragraph_end"))).drop("_next_unit")


def expand_numbers(visuals: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """(doc, number, visual_id): "4–6" names 4, 5 and 6; the first visual of a number wins."""
    parts = F.split("eq_number", "–")
    a, b = parts[0].try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    small = (F.size(parts) == 2) & a.isNotNull() & b.isNotNull() & (b >= a) & (b - a < 10)
    numbers = (
        F.when(small, F.transform(F.sequence(F.least(a, b), F.greatest(a, b)), lambda n: n.cast("string")))
        .when(F.size(parts) == 2, parts)
        .otherwise(F.array("eq_number"))
    )
    v = visuals.filter("eq_number IS NOT NULL").select(doc, "visual_id", *order, F.explode(numbers).alias("number"))
    return v.groupBy(doc, "number").agg(F.min(F.struct(*order, "visual_id")).alias("_f")).select(
        doc, "number", F.col("_f.visual_id").alias("visual_id")
    )


def resolve_references(segments: DataFrame, equations: DataFrame, figures: DataFrame) -> DataFrame:
    """`referenced` visual of each segment: the first equation it mentions that exists, else the first such figure.

    equations(paper, number, visual_id) as N3 gives them, figures(paper, visual_id) with ids like Fig2, Tab1.
    """
    eqs = F.transform(
        F.regexp_extract_all("say", F.lit(EQUATION_MENTION), F.lit(1)),
        lambda n, i: F.struct(F.lit(0).alias("rank"), i.alias("pos"), F.concat(F.lit("#"), n).alias("name")),
    )

    def figure(m: Column, i: Column) -> Column:
        kind = F.when(F.lower(m).startswith("t"), "Tab").otherwise("Fig")
        return F.struct(F.lit(1).alias("rank"), i.alias("pos"), F.concat(kind, F.regexp_extract(m, r"([A-Za-z]?\d+[A-Za-z]?)$", 1)).alias("name"))

    figs = F.transform(F.regexp_extract_all("say", F.lit(FIGURE_MENTION), F.lit(1)), figure)
    m = segments.select(PAPER, IDX, F.explode(F.concat(eqs, figs)).alias("m")).select(PAPER, IDX, "m.*")
    names = equations.select(PAPER, F.concat(F.lit("#"), "number").alias("name"), F.col("visual_id").alias("referenced")).unionByName(
        figures.select(PAPER, F.col("visual_id").alias("name"), F.col("visual_id").alias("referenced"))
    )
    hit = m.join(names, [PAPER, "name"]).groupBy(PAPER, IDX).agg(F.min(F.struct("rank", "pos", "referenced"))["referenced"].alias("referenced"))
    return segments.join(hit, [PAPER, IDX], "left")


def _carry(d: DataFrame, shown: Column, anchors: Column, resets: Column, eligible: Column, keep: int, value: Column) -> DataFrame:
    """`_kept`: the anchor's value for the next `keep` eligible rows of its section, cleared by resets.

    The rank of an eligible row after its anchor is a difference of two running counts, so no island is materialised.
    """
    d = d.withColumns({"_el": eligible.cast("long"), "_an": anchors, "_re": resets, "_val": value})
    d = scan(d, [PAPER], [IDX], by_index(IDX), [Running("_count", "sum", F.col("_el"))])
    event = F.when(F.col("_an"), F.struct(F.col("_val").alias("v"), F.col("section").alias("s"), F.col("_count").alias("c"))).when(
        F.col("_re"), F.struct(F.lit(None).cast("string").alias("v"), F.lit(None).cast("long").alias("s"), F.lit(0).cast("long").alias("c"))
    )
    d = scan(stored(d), [PAPER], [IDX], by_index(IDX), [Running("_last", "last_before", event)])
    ok = (F.col("_el") == 1) & (F.col("_last.s") == F.col("section")) & (F.col("_count") - F.col("_last.c") <= keep)
    return d.withColumn("_kept", F.when(ok, F.col("_last.v"))).drop("_el", "_an", "_re", "_val", "_count", "_last")


def assign_visuals(segments: DataFrame, inline: Column) -> DataFrame:
    """`show` and `reason` of each segment.

    Own visual, else the referenced one, else the last visual that is not inline stays for the next three unshown
    sentences of its section. Headings and titles clear it. `inline` says whether own_visual/ref_visual is inline.
    """
    shown = F.coalesce("own_visual", "ref_visual")
    break_ = F.col("kind").isin("heading", "title")
    anchors = F.coalesce(shown.isNotNull() & ~inline, F.lit(False))
    eligible = shown.isNull() & (F.col("kind") == "sentence")
    d = _carry(segments, shown, anchors, break_ & ~anchors, eligible, KEEP_EXPLAINING, shown)
    reason = (
        F.when(F.col("own_visual").isNotNull(), "own").when(F.col("ref_visual").isNotNull(), "reference")
        .when(F.col("_kept").isNotNull(), "recent").otherwise("own")
    )
    return d.withColumn("show", F.coalesce(shown, "_kept")).withColumn("reason", reason).drop("_kept")


def attach_figures(segments: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures found after narrating: captions and mentions show them, the next two unshown sentences keep them.

    segments(…, show, reason); figures(paper, visual_id). Existing shows stay; another shown segment ends the keeping.
    """
    no_numbers = segments.sparkSession.createDataFrame([], f"{PAPER} bigint, number string, visual_id string")
    cap = T.caption_id(F.col("say"))
    d = segments.withColumn("_cap", cap)
    d = resolve_references(d, no_numbers, figures)
    known = figures.select(PAPER, F.col("visual_id").alias("_cap"), F.lit(True).alias("_has"))
    d = d.join(known, [PAPER, "_cap"], "left")
    free = F.col("show").isNull() | (F.col("reason") == "recent")
    own = F.when(F.col("_has") & free, F.col("_cap"))
    ref = F.when(free, F.col("referenced"))
    new = F.coalesce(own, ref)
    d = d.withColumn("_new", new).withColumn("_why", F.when(own.isNotNull(), "own").when(ref.isNotNull(), "reference"))
    anchors = F.col("_new").isNotNull()
    other = F.col("show").isNotNull() & (F.col("reason") != "recent")
    resets = (F.col("kind").isin("heading", "title") | other) & ~anchors
    eligible = F.col("show").isNull() & ~anchors & (F.col("kind") == "sentence")
    d = _carry(d, F.col("_new"), anchors, resets, eligible, KEEP_FIGURE, F.col("_new"))
    return (
        d.withColumn("reason", F.coalesce("_why", F.when(F.col("_kept").isNotNull(), F.lit("recent")), "reason"))
        .withColumn("show", F.coalesce("_new", "_kept", "show"))
        .drop("_cap", "_has", "referenced", "_new", "_why", "_kept")
    )


def section_starts(segments: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper, section, first_segment): the first segment of that section or a later one, else the last segment."""
    first = segments.groupBy(PAPER, "section").agg(F.min(IDX).alias("_first"))
    last = segments.groupBy(PAPER).agg(F.max(IDX).alias("_last"))
    s = sections.select(PAPER, "section").unionByName(segments.select(PAPER, "section")).distinct().join(first, [PAPER, "section"], "left")
    s = scan(s, [PAPER], ["section"], by_index("section"), [Running("_fill", "next", F.col("_first"))])
    s = s.join(sections.select(PAPER, "section"), [PAPER, "section"], "left_semi").join(last, PAPER)
    return s.select(PAPER, "section", F.coalesce("_fill", "_last").alias("first_segment"))


def visual_order(segments: DataFrame, inline: Column) -> DataFrame:
    """Where each visual that is not inline is first read or referred to."""
    return (
        segments.filter(F.col("show").isNotNull() & ~inline & (F.col("reason") != "recent"))
        .groupBy(PAPER, F.col("show").alias("visual_id"))
        .agg(F.min(IDX).alias("first_segment"))
    )


def visual_stops(segments: DataFrame, inline: Column) -> DataFrame:
    """The segment after which playing stops for a visual: the last one of its first run that is about it."""
    d = scan(segments, [PAPER], [IDX], by_index(IDX), [Running("_prev", "lag", F.col("show"))])
    starts = ~F.col("show").eqNullSafe(F.col("_prev"))
    d = scan(cut_lineage(d.withColumn("_starts", starts)), [PAPER], [IDX], by_index(IDX), [Running("_run", "sum", F.col("_starts").cast("long"))])
    about = F.when(F.col("reason") != "recent", F.col(IDX))
    runs = (
        d.filter(F.col("show").isNotNull() & ~inline)
        .groupBy(PAPER, F.col("show").alias("visual_id"), "_run")
        .agg(F.min(about).alias("first"), F.max(about).alias("stop"))
        .filter("first IS NOT NULL")
    )
    return runs.groupBy(PAPER, "visual_id").agg(F.min(F.struct("first", "stop"))["stop"].alias("stop"))


def link_captions(units: DataFrame, figures: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The first caption sentence within a page of its figure gets the figure as its visual."""
    u = units.withColumn("_cap", F.when(F.col("kind") == "sentence", T.caption_id(F.col("text"))))
    f = figures.select(doc, F.col("visual_id").alias("_cap"), F.col("page").alias("_page"))
    near = u.filter("_cap IS NOT NULL").join(f, [doc, "_cap"]).filter(F.abs(F.col("_page") - F.col("page")) <= 1)
    first = near.groupBy(doc, "_cap").agg(F.min("ord").alias("ord")).select(doc, "ord", F.col("_cap").alias("_linked"))
    return u.drop("_cap").join(first, [doc, "ord"], "left").withColumn("visual_id", F.coalesce("_linked", "visual_id")).drop("_linked")


def drop_visuals(units: DataFrame, visuals: DataFrame, missing: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(units, visuals) without the visuals that could not be drawn."""
    gone = missing.select(doc, "visual_id").distinct()
    u = units.join(gone.withColumn("_gone", F.lit(True)), [doc, "visual_id"], "left")
    u = u.withColumn("visual_id", F.when(F.col("_gone").isNull(), F.col("visual_id"))).drop("_gone")
    return u, visuals.join(gone, [doc, "visual_id"], "left_anti")


# Limits of one narration request.
CHUNK_CHARS, CHUNK_EQUATIONS, CHUNK_HEADING_CHARS, UNIT_COST = 6000, 6, 2500, 8


def chunk_of_units(units: Column) -> Column:
    """Chunk number of each unit of one document (array<struct<kind, chars>> → array<int>).

    The document is one nested row, as it was read; the greedy fold keeps three counters.
    """
    is_eq = lambda u: u["kind"] == "equation"
    zero = F.struct(
        F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(0).alias("eqs"), F.array().cast("array<int>").alias("out")
    )

    def step(s: Column, u: Column) -> Column:
        flush = (s["n"] > 0) & (
            (s["chars"] > CHUNK_CHARS)
            | (is_eq(u) & (s["eqs"] >= CHUNK_EQUATIONS))
            | ((u["kind"] == "heading") & (s["chars"] > CHUNK_HEADING_CHARS))
        )
        base = lambda c: F.when(flush, 0).otherwise(s[c])
        chunk = s["chunk"] + flush.cast("int")
        return F.struct(
            chunk.alias("chunk"),
            (base("n") + 1).alias("n"),
            (base("chars") + u["chars"] + UNIT_COST).alias("chars"),
            (base("eqs") + is_eq(u).cast("int")).alias("eqs"),
            F.concat(s["out"], F.array(chunk)).alias("out"),
        )

    return F.aggregate(units, zero, step, lambda s: s["out"])


def known_before(chunks: DataFrame, visuals: DataFrame, units: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, chunk, visual_id): numbered visuals up to the chunk's first page that are not in the chunk itself.

    chunks(doc, chunk, first_page); units(doc, chunk, unit_id, visual_id).
    """
    v = visuals.filter(F.col("eq_number").isNotNull() & F.col("kind").isin("equation", "figure", "table")).select(doc, "visual_id", "page")
    pairs = chunks.join(v, doc).filter(F.col("page") <= F.col("first_page")).select(doc, "chunk", "visual_id")
    inside = units.select(doc, "chunk", F.explode(F.array("unit_id", "visual_id")).alias("visual_id")).filter("visual_id IS NOT NULL").distinct()
    return pairs.join(inside, [doc, "chunk", "visual_id"], "left_anti")


def align_drafts(drafts: DataFrame, units: DataFrame, chunk: list[str]) -> DataFrame:
    """drafts(chunk…, d_ord, src, …) with `unit_ord`: a source that is unknown or goes back keeps the one before.

    Accepted sources never decrease, so the accepted one is the running maximum. A chunk is at most a few thousand
    characters, so its window is small whatever the document.
    """
    u = units.select(*chunk, F.col("unit_id").alias("src"), F.col("ord").alias("_o"))
    head = units.groupBy(*chunk).agg(F.min("ord").alias("_head"))
    w = Window.partitionBy(*chunk).orderBy("d_ord").rowsBetween(Window.unboundedPreceding, 0)
    d = drafts.join(u, [*chunk, "src"], "left").join(head, chunk)
    return d.withColumn("unit_ord", F.greatest(F.max("_o").over(w), F.col("_head"))).drop("_o", "_head")


def coverage_guard(aligned: DataFrame, units: DataFrame, chunk: list[str]) -> DataFrame:
    """The drafts of chunks that cover ≥ 70 % of their sentences and say something, with the offline cue of every
    equation they skipped put in its place (`d_ord` null)."""
    covered = aligned.select(*chunk, F.col("unit_ord").alias("ord")).distinct().withColumn("_c", F.lit(1))
    u = units.join(covered, [*chunk, "ord"], "left")
    ratio = u.groupBy(*chunk).agg(
        F.count_if(F.col("kind") == "sentence").alias("_need"),
        F.count_if((F.col("kind") == "sentence") & F.col("_c").isNotNull()).alias("_have"),
    )
    says = aligned.filter(F.col("say") != "")
    spoke = says.select(*chunk).distinct()
    ok = ratio.join(spoke, chunk, "left_semi").filter("_need = 0 OR _have >= 0.7 * _need").select(*chunk)
    cues = (
        u.filter((F.col("kind") == "equation") & F.col("_c").isNull())
        .join(ok, chunk, "left_semi")
        .select(*chunk, F.lit(None).cast("int").alias("d_ord"), F.col("ord").alias("unit_ord"), F.col("spoken").alias("say"))
    )
    kept = says.join(ok, chunk, "left_semi").select(*chunk, "d_ord", "unit_ord", "say")
    return kept.unionByName(cues)


def merge_narration(accepted: DataFrame, units: DataFrame, chunk: list[str]) -> DataFrame:
    """Per chunk the accepted drafts, else the units' own spoken text (`offline` true)."""
    offline = units.join(accepted.select(*chunk).distinct(), chunk, "left_anti").select(
        *chunk, F.lit(None).cast("int").alias("d_ord"), F.col("ord").alias("unit_ord"), F.col("spoken").alias("say"), F.lit(True).alias("offline")
    )
    return accepted.withColumn("offline", F.lit(False)).unionByName(offline)


SLOT_MS = 60_000


def timeline(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """(paper, idx, duration, start_ms, end_ms, unknown before/after): positions in the paper's audio.

    Clips without a duration take no time; `_gap_before`/`_gap_after` are the nearest such clip at or before / after.
    """
    d = segments.select(PAPER, IDX).join(clips, [PAPER, IDX], "left")
    gap = F.when(F.col("duration_ms").isNull(), F.col(IDX))
    d = scan(
        d,
        [PAPER],
        [IDX],
        by_index(IDX),
        [
            Running("start_ms", "sum_before", F.coalesce("duration_ms", F.lit(0)).cast("long")),
            Running("_gap_before", "last_before", gap),
            Running("_gap_after", "next", gap),
        ],
    )
    return d.withColumn("end_ms", F.col("start_ms") + F.coalesce("duration_ms", F.lit(0)))


def _clip_at(positions: DataFrame, line: DataFrame, at: str) -> DataFrame:
    """positions with the clip holding time `at`: an equi join on (paper, minute), clips listed in every minute they touch."""
    slots = F.sequence(F.floor(F.col("start_ms") / SLOT_MS), F.floor((F.col("end_ms") - 1) / SLOT_MS))
    c = line.filter("duration_ms > 0").select(
        PAPER, F.col(IDX).alias("_seg"), F.col("start_ms").alias("_start"), F.col("end_ms").alias("_end"), F.explode(slots).alias("_slot")
    )
    p = positions.withColumn("_slot", F.floor(F.col(at) / SLOT_MS))
    hit = p.join(c, [PAPER, "_slot"]).filter((F.col(at) >= F.col("_start")) & (F.col(at) < F.col("_end")))
    return positions.join(hit.select("pos_id", "_seg", "_start"), "pos_id", "left")


def seek_back(positions: DataFrame, line: DataFrame, amount_ms: int) -> DataFrame:
    """positions(pos_id, paper, idx, offset_ms) moved back; unknown clips stop the walk at their start."""
    here = line.select(PAPER, IDX, "start_ms", "_gap_before")
    gaps = line.select(PAPER, F.col(IDX).alias("_gap_before"), F.col("start_ms").alias("_gap_at"))
    p = positions.join(here, [PAPER, IDX]).join(gaps, [PAPER, "_gap_before"], "left")
    rest = F.lit(amount_ms) - F.col("offset_ms")
    p = p.withColumn("_at", F.col("start_ms") - rest)
    p = _clip_at(p, line, "_at")
    inside = rest <= 0
    stopped = F.col("_gap_before").isNotNull() & (F.col("_at") < F.col("_gap_at"))
    seg = F.when(inside, F.col(IDX)).when(stopped, F.col("_gap_before")).when(F.col("_at") < 0, F.lit(0)).otherwise(F.col("_seg"))
    off = F.when(inside, -rest).when(stopped | (F.col("_at") < 0), F.lit(0)).otherwise(F.col("_at") - F.col("_start"))
    return p.select("pos_id", PAPER, seg.cast("long").alias("segment"), off.cast("long").alias("offset_ms"))


def seek_forward(positions: DataFrame, line: DataFrame, amount_ms: int) -> DataFrame:
    """Positions moved forward; unknown clips are entered at their start, past the end is the last clip − 250 ms."""
    here = line.select(PAPER, IDX, "start_ms", "_gap_after")
    gaps = line.select(PAPER, F.col(IDX).alias("_gap_after"), F.col("start_ms").alias("_gap_at"))
    last = line.groupBy(PAPER).agg(F.max(F.struct(IDX, "duration_ms", "end_ms")).alias("_l"))
    p = positions.join(here, [PAPER, IDX]).join(gaps, [PAPER, "_gap_after"], "left").join(last, PAPER)
    p = p.withColumn("_at", F.col("start_ms") + F.col("offset_ms") + F.lit(amount_ms))
    p = _clip_at(p, line, "_at")
    stopped = F.col("_gap_after").isNotNull() & ((F.col("_gap_after") == F.col(IDX)) | (F.col("_at") >= F.col("_gap_at")))
    past = F.col("_at") >= F.col("_l.end_ms")
    seg = F.when(stopped, F.col("_gap_after")).when(past, F.col(f"_l.{IDX}")).otherwise(F.col("_seg"))
    off = F.when(stopped, F.lit(0)).when(past, F.greatest(F.lit(0), F.coalesce("_l.duration_ms", F.lit(0)) - 250)).otherwise(F.col("_at") - F.col("_start"))
    return p.select("pos_id", PAPER, seg.cast("long").alias("segment"), off.cast("long").alias("offset_ms"))


def clips_to_make(
    segments: DataFrame, clips: DataFrame, in_flight: DataFrame, failed: DataFrame, cursors: DataFrame, lookahead: int, now: Column
) -> DataFrame:
    """Segments from the cursor to `lookahead` ahead with no clip, not being made, not failed within 12 seconds."""
    near = segments.join(cursors.select(PAPER, "cursor"), PAPER).filter(
        (F.col(IDX) >= F.col("cursor")) & (F.col(IDX) <= F.col("cursor") + lookahead)
    )
    key = [PAPER, IDX]
    hold = failed.filter(F.col("failed_at") + F.expr("INTERVAL 12 SECONDS") >= now)
    for busy in (clips, in_flight, hold):
        near = near.join(busy.select(*key), key, "left_anti")
    return near.select(*key)


def contents_index(segments: DataFrame, order: DataFrame) -> DataFrame:
    """Table of contents: (paper, entry, number, first_segment, visuals): per page and per section, with the
    visuals first read in the section."""
    page = segments.groupBy(PAPER, F.col("page").alias("number")).agg(F.min(IDX).alias("first_segment")).withColumn("entry", F.lit("page"))
    section = segments.groupBy(PAPER, F.col("section").alias("number")).agg(F.min(IDX).alias("first_segment")).withColumn("entry", F.lit("section"))
    where = segments.select(PAPER, F.col(IDX).alias("first_segment"), "section")
    v = order.join(where, [PAPER, "first_segment"]).groupBy(PAPER, F.col("section").alias("number")).agg(
        F.array_sort(F.collect_list(F.struct("first_segment", "visual_id"))).alias("_v")
    )
    section = section.join(v, [PAPER, "number"], "left")
    visuals = F.coalesce(F.array_join(F.transform("_v", lambda x: x["visual_id"]), ","), F.lit(""))
    return section.select(PAPER, "entry", "number", "first_segment", visuals.alias("visuals")).unionByName(
        page.select(PAPER, "entry", "number", "first_segment", F.lit("").alias("visuals"))
    )
