"""Web pages to articles and typed blocks (W1–W4, W7–W10), each step a projection over the page's own row."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions import web as W

Step = Callable[[Column], Column]

#: what is left of a page is its article: formulas of hidden elements stay, chrome, note marks and lists of links go
READING: tuple[Step, ...] = (W.hidden_math_shown, W.strip_furniture, W.article_root, W.strip_note_marks, W.without_link_farms)
#: typed blocks take the places of tables first, so that a figure finds them, then of figures, code and formulas
TYPING: tuple[Step, ...] = (W.scripts_raised, W.typed_tables, W.typed_figures, W.typed_code, W.typed_math)


@cache
def _expression(step: Step, column: str) -> Column:
    """A step's expression, put together once: it has some thousands of parts."""
    return step(F.col(column))


def _through(df: DataFrame, column: str, steps: tuple[Step, ...]) -> DataFrame:
    # a projection for each step: the column is worked out once, and the analyser meets no deep expression
    for step in steps:
        df = df.withColumn(column, _expression(step, column))
    return df


def articles(pages: DataFrame, html: str = "html", out: str = "article") -> DataFrame:
    """`pages` with the HTML of each page's article: W1, W2, W4 and W10 applied. A null page has a null article."""
    return _through(pages.withColumn(out, F.col(html)), out, READING)


def article_blocks(articles: DataFrame, keys: list[str], article: str = "article") -> DataFrame:
    """(keys…, ord, kind, level, text, caption, src, number, rows) of every article, in order.

    Kinds: heading (level), paragraph, item, code, math (LaTeX as text, number), table (rows, caption), image (src, alt as
    text, caption). A null or empty article has no blocks.
    """
    d = _through(articles.select(*keys, F.col(article).alias("_html")), "_html", TYPING)
    return d.select(*keys, F.posexplode(_expression(W.cut_blocks, "_html")).alias("ord", "_b")).select(*keys, "ord", "_b.*")


def web_blocks(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """The typed blocks of every page's article."""
    return article_blocks(articles(pages.select(*keys, html), html), keys)
