"""OCR blocks: running text, equations, figures (O1–O8). Joins are equi joins on (doc, page); coordinates are pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.plans.ordered import Running, scan
from studyloom.session import cut_lineage

DOC, PAGE = "doc_id", "page"
NOISE = ("header", "footer", "references", "aside_text")  # fixed values
MAX_GROWTH, PAD = 40.0, 4.0  # fixed values, points
ABSTRACT = r"(?i)^[#\s*_]*abstract\b"


def running_text(blocks: DataFrame) -> DataFrame:
    """O1: blocks without page furniture, and on the first page without what stands between title and abstract."""
    b = blocks.filter(~F.col("kind").isin(*NOISE))
    first = blocks.groupBy(DOC).agg(F.min(PAGE).alias("_p"))
    b = b.join(first, DOC)
    on_first = F.col(PAGE) == F.col("_p")
    marks = b.filter(on_first).groupBy(DOC).agg(
        F.min(F.when(F.col("kind").isin("title", "text") & F.col("content").rlike(ABSTRACT), F.col("ord"))).alias("_abs"),
        F.min(F.when(F.col("kind") == "title", F.col("ord"))).alias("_title"),
    )
    b = b.join(marks, DOC, "left")
    between = on_first & F.col("_abs").isNotNull() & (F.col("ord") < F.col("_abs")) & ~F.col("ord").eqNullSafe(F.col("_title"))
    return b.filter(~between).drop("_p", "_abs", "_title")


def join_page_turns(blocks: DataFrame) -> DataFrame:
    """O2: (doc, page, ord, kind, content): a text that runs over a page turn is one block.

    The first text of a page continues the last block of the page before when that is text without a final mark and
    this starts in lower case before any title, equation or list. A page emptied this way takes nothing from the page
    after it, so in a run of such one-block pages every second one is joined; the run's start is a forward fill.
    """
    per = blocks.groupBy(DOC, PAGE).agg(
        F.max(F.struct("ord", "kind", "content")).alias("_last"),
        F.min(F.when(F.col("kind").isin("text", "title", "equation", "list"), F.struct("ord", "kind", "content"))).alias("_first"),
        (F.count("*") == 1).alias("_single"),
    )
    up = per.select(DOC, (F.col(PAGE) + 1).alias(PAGE), F.col("_last").alias("_up"), F.col("_single").alias("_up_single"))
    j = per.join(up, [DOC, PAGE], "left")
    fits = (
        (F.col("_up.kind") == "text") & ~F.rtrim("_up.content").rlike(r"[.!?:;]$") & (F.col("_first.kind") == "text") & F.ltrim("_first.content").rlike(r"^\p{Ll}")
    )
    j = j.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    bucket = F.floor(F.col(PAGE) / 256).cast("long")
    j = scan(j, [DOC], [PAGE], bucket, [Running("_p", "lag", F.struct(PAGE, "_fits"))])
    linked = F.col("_fits") & F.col("_up_single") & (F.col(f"_p.{PAGE}") == F.col(PAGE) - 1) & F.col("_p._fits")
    starts = F.when(~F.coalesce(linked, F.lit(False)), F.col(PAGE))
    j = scan(cut_lineage(j), [DOC], [PAGE], bucket, [Running("_start", "last", starts)])
    moved = j.filter(F.col("_fits") & ((F.col(PAGE) - F.col("_start")) % 2 == 0)).select(
        DOC, PAGE, F.col("_first.ord").alias("ord"), (F.col(PAGE) - 1).alias("_to_page"), F.col("_up.ord").alias("_to_ord")
    )
    tail = moved.join(blocks.select(DOC, PAGE, "ord", "content"), [DOC, PAGE, "ord"]).select(
        DOC, F.col("_to_page").alias(PAGE), F.col("_to_ord").alias("ord"), F.ltrim("content").alias("_tail")
    )
    b = blocks.join(moved.select(DOC, PAGE, "ord"), [DOC, PAGE, "ord"], "left_anti").join(tail, [DOC, PAGE, "ord"], "left")
    joined = F.concat(F.rtrim("content"), F.lit(" "), "_tail")
    return b.withColumn("content", F.coalesce(joined, "content")).drop("_tail")


def clean_math(c: Column) -> Column:
    t = F.trim(c)
    t = F.regexp_replace(t, r"(?s)^\$\$(.*)\$\$$|^\\\[(.*)\\\]$|^\\\((.*)\\\)$|^\$(.*)\$$", "$1$2$3$4")
    return F.trim(F.regexp_replace(t, r"\\tag\*?\s*\{[^}]*\}", ""))


def math_pieces(c: Column) -> Column:
    """Formulas of OCR markdown, without delimiters and number tags."""
    rx = r"(?s)\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\$.+?\$"
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(rx), F.lit(0)), clean_math), lambda p: p != "")


def signature(c: Column) -> Column:
    """Letters and digits of a formula, LaTeX commands left out, as an array."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(c, r"\\[a-zA-Z]+", " ")), r"[^\p{L}\p{Nd}]", "")
    return F.filter(F.split(plain, ""), lambda x: x != "")


def char_similarity(a: Column, b: Column) -> Column:
    """Share of characters two texts have in common as multisets."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return T.bind(
        F.struct(signature(a).alias("a"), signature(b).alias("b")),
        lambda s: F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0)).otherwise(
            F.aggregate(F.array_distinct(s["a"]), F.lit(0), lambda n, x: n + F.least(count(s["a"], x), count(s["b"], x)))
            / F.greatest(F.size(s["a"]), F.size(s["b"]))
        ),
    )


def best_pieces(raw: Column, pieces: Column) -> Column:
    """The pieces that match a visual's text best, in order; a single piece always."""
    scored = F.transform(pieces, lambda p: F.struct(p.alias("p"), char_similarity(raw, p).alias("s")))
    return F.when(F.size(pieces) <= 1, pieces).otherwise(
        T.bind(
            scored,
            lambda ss: T.bind(
                F.array_max(F.transform(ss, lambda x: x["s"])),
                lambda best: F.transform(F.filter(ss, lambda x: (x["s"] >= best * 0.6) & (x["s"] > 0.15)), lambda x: x["p"]),
            ),
        )
    )


def refine_equations(visuals: DataFrame, blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """O3: equation regions grown over the OCR boxes they meet, each edge by at most 40 points, with the boxes' contents.

    visuals(doc, page, visual_id, x, y, w, h) in points; blocks in pixels; sizes(doc, page, px_w, px_h, pt_w, pt_h).
    The candidates are the boxes of the same page; the extent is a min/max aggregate.
    """
    s = F.col("pt_w") / F.col("px_w"), F.col("pt_h") / F.col("px_h")
    eq = blocks.filter("kind = 'equation'").join(sizes.filter("px_w > 0 AND px_h > 0"), [DOC, PAGE]).select(
        DOC, PAGE, "ord", "content", (F.col("x0") * s[0]).alias("bx0"), (F.col("y0") * s[1]).alias("by0"), (F.col("x1") * s[0]).alias("bx1"), (F.col("y1") * s[1]).alias("by1")
    )
    x1, y1 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    ix = F.greatest(F.lit(0.0), F.least(x1, "bx1") - F.greatest("x", "bx0")) * F.greatest(F.lit(0.0), F.least(y1, "by1") - F.greatest("y", "by0"))
    area_b = F.greatest(F.lit(0.0), F.col("bx1") - F.col("bx0")) * F.greatest(F.lit(0.0), F.col("by1") - F.col("by0"))
    area_v = F.greatest(F.lit(0.0), F.col("w")) * F.greatest(F.lit(0.0), F.col("h"))
    hits = visuals.join(eq, [DOC, PAGE]).filter((ix > 0) & (ix >= 0.3 * F.least(area_v, area_b)))
    key = [DOC, PAGE, "visual_id"]
    g = hits.groupBy(*key, "content").agg(F.min("ord").alias("ord"), *[f(c).alias(c) for f, c in ((F.min, "bx0"), (F.min, "by0"), (F.max, "bx1"), (F.max, "by1"))])
    texts = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "content"))),
            lambda x: T.bind(math_pieces(x["content"]), lambda ps: F.when(F.size(ps) > 0, ps).otherwise(F.array(clean_math(x["content"])))),
        )
    )
    g = g.groupBy(*key).agg(
        F.min("bx0").alias("bx0"), F.min("by0").alias("by0"), F.max("bx1").alias("bx1"), F.max("by1").alias("by1"), F.array_join(F.filter(texts, lambda t: t != ""), "\n").alias("latex")
    )
    j = visuals.join(g, key, "left").join(sizes.select(DOC, PAGE, "pt_w", "pt_h"), [DOC, PAGE], "left")
    lo = lambda p, b: F.greatest(F.lit(0.0), F.greatest(p - MAX_GROWTH, F.least(p, b)))
    hi = lambda q, b, m: F.least(m, F.least(q + MAX_GROWTH, F.greatest(q, b)))
    nx0, ny0 = lo(F.col("x"), F.col("bx0")), lo(F.col("y"), F.col("by0"))
    nx1, ny1 = hi(x1, F.col("bx1"), F.col("pt_w")), hi(y1, F.col("by1"), F.col("pt_h"))
    hit = F.col("bx0").isNotNull()
    pick = lambda new, old: F.when(hit, new).otherwise(old)
    return j.select(
        *key, pick(nx0, F.col("x")).alias("x"), pick(ny0, F.col("y")).alias("y"), pick(nx1 - nx0, F.col("w")).alias("w"), pick(ny1 - ny0, F.col("h")).alias("h"), F.nullif("latex", F.lit("")).alias("latex")
    )


def figure_groups(blocks: DataFrame) -> DataFrame:
    """(doc, page, visual_id, caption_ord, ord): the blocks each numbered caption captions.

    A figure takes the images whose middle lies between the caption above and its own (each image is in one such
    band: the next caption below it, a backward fill down the page), and sub-captions among them. A table caption
    takes the nearest table; tables are claimed in caption order, the nearest still free each time, by passing the
    ranked pairs through a greedy choice per page.
    """
    key = [DOC, PAGE]
    cap = F.when(F.col("kind") == "caption", T.caption_id(F.col("content")))
    b = blocks.withColumn("_id", cap).withColumn("_mid", (F.col("y0") + F.col("y1")) / 2)
    # where a block would be found: images by their middle, captions by their top
    b = b.withColumn("_at", F.when(F.col("_id").isNotNull(), F.col("y0") + F.col("slack")).otherwise(F.col("_mid")))
    nxt = F.when(F.col("_id").isNotNull(), F.struct("_id", "ord", "y0", "slack"))
    b = b.withColumn("_named", F.col("_id").isNotNull().cast("int"))
    b = scan(b, key, ["_at", "_named", "ord"], F.floor("_at").cast("long"), [
        Running("_cap", "next_after", nxt), Running("_above", "max_before", F.when(F.col("_id").isNotNull(), F.col("y1"))),
    ], bounded=True)
    images = b.filter("kind = 'image'").filter(F.col("_cap._id").startswith("Fig") & (F.col("_mid") >= F.coalesce("_above", F.lit(0.0))))
    images = images.select(*key, F.col("_cap._id").alias("visual_id"), F.col("_cap.ord").alias("caption_ord"), "ord", "y0", F.col("_cap.y0").alias("_cy"), "slack")
    tops = images.groupBy(*key, "visual_id", "caption_ord", "_cy", "slack").agg(F.min("y0").alias("_top"))
    subs = b.filter("kind = 'caption' AND _id IS NULL").select(*key, "ord", "y0", "y1").join(tops, key)
    subs = subs.filter((F.col("y0") >= F.col("_top") - 10 * F.col("slack")) & (F.col("y1") <= F.col("_cy") + F.col("slack")))
    out = [images.select(*key, "visual_id", "caption_ord", "ord"), subs.select(*key, "visual_id", "caption_ord", "ord")]

    tabs = b.filter("kind = 'table'").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "y0", "y1"))).alias("_tables"))
    caps = b.filter(F.col("_id").startswith("Tab")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("y0", "y1", "ord", F.col("_id").alias("id")))).alias("_caps"))

    def claim(s: Column, c: Column) -> Column:
        free = F.filter(F.col("_tables"), lambda t: ~F.array_contains(s["used"], t["ord"]))
        dist = lambda t: F.least(F.abs(t["y0"] - c["y1"]), F.abs(c["y0"] - t["y1"]))
        best = F.array_min(F.transform(free, lambda t: F.struct(dist(t).alias("d"), t["ord"].alias("ord"))))
        row = lambda x: F.struct(c["id"].alias("visual_id"), c["ord"].alias("caption_ord"), x["ord"].alias("ord"))
        taken = lambda x: F.struct(F.concat(s["used"], F.array(x["ord"])).alias("used"), F.concat(s["rows"], F.array(row(x))).alias("rows"))
        return T.bind(best, lambda x: F.when(x.isNull(), s).otherwise(taken(x)))

    # the tables and table captions of one page image: a handful
    zero = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<visual_id:string,caption_ord:bigint,ord:bigint>>").alias("rows"))
    claimed = tabs.join(caps, key).select(*key, F.explode(F.aggregate("_caps", zero, claim, lambda s: s["rows"])).alias("r")).select(*key, "r.*")
    out.append(claimed)
    return out[0].unionByName(out[1]).unionByName(out[2])


def regions(groups: DataFrame, blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """The area (points, 4-point margin, inside the page) of each group and its caption."""
    key = [DOC, PAGE, "visual_id", "caption_ord"]
    # the groups are read once for their blocks and captions
    members = groups.select(*key, F.explode(F.array_distinct(F.array("ord", "caption_ord"))).alias("ord")).distinct()
    b = members.join(blocks.select(DOC, PAGE, "ord", "x0", "y0", "x1", "y1"), [DOC, PAGE, "ord"])
    g = b.groupBy(*key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).join(sizes, [DOC, PAGE])
    sx, sy = F.col("pt_w") / F.col("px_w"), F.col("pt_h") / F.col("px_h")
    x0, y0 = F.greatest(F.lit(0.0), F.col("x0") * sx - PAD), F.greatest(F.lit(0.0), F.col("y0") * sy - PAD)
    x1, y1 = F.least("pt_w", F.col("x1") * sx + PAD), F.least("pt_h", F.col("y1") * sy + PAD)
    return g.select(*key, x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def figures(areas: DataFrame, caption_tops: DataFrame) -> DataFrame:
    """One visual per figure id: the first page's, the topmost caption's there."""
    a = areas.join(caption_tops.select(DOC, PAGE, F.col("ord").alias("caption_ord"), F.col("y0").alias("_cy")), [DOC, PAGE, "caption_ord"])
    first = F.min_by(F.struct(PAGE, "x", "y", "w", "h"), F.struct(PAGE, "_cy", "caption_ord"))
    return a.groupBy(DOC, "visual_id").agg(first.alias("_f")).select(DOC, "visual_id", "_f.*")

