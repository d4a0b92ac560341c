"""Markdown inline text and table rows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyloom.functions.text import bind, tidy
from studyloom.functions.web import decode_entities

OPEN, CLOSE = "\ue010", "\ue011"
FORMULA = r"\$\$.+?\$\$|\$[^$\n]+?\$|\\\(.+?\\\)"
TOKENS = "|".join((
    FORMULA,
    r"`+[^`]+`+",  # code
    r"!\[[^\]]*\]\([^)]*\)",  # picture
    r"\[\^[^\]]+\]",  # footnote mark
    r"\[(?=[^\]]+\](?:\(|\[))",  # a link's label begins
    r"\]\((?:[^()]++|\([^)]*+\))*+\)",  # … and ends, with its target
    r"\]\[[^\]]*\]",
    r"<https?://[^>]+>",
    r"</?[a-zA-Z][^>]*>",
    r"\\[\\`*_{}\[\]()#+\-.!|]",  # escaped mark
    r"\*\*|__|~~",
    r"(?<![\w*])[*_](?=[^\s*_])|(?<=[^\s*_])[*_](?![\w*])",  # not within words
    r"(?<=\w)[*_]\w|(?<=\s)[*_]\s",  # within a word or alone a mark is text
    r"[^$`!\[\]<\\*_~]+",
    r".",
))
MARKS = ("**", "__", "~~", "*", "_")


def inline_text(c: Column) -> Column:
    """Link texts kept, emphasis, code marks and tags gone, references decoded; formulas stay as they are.

    The text is read once as tokens, each with a rule of its own. Emphasis marks go in pairs: of an odd number the last
    is text.
    """

    def plain(ts: Column, t: Column, i: Column) -> Column:
        tag = F.lower(t)
        n = F.length(t)
        # of an odd number of equal marks the last one has no partner
        alone = (F.size(F.filter(ts, lambda x: x == t)) % 2 == 1) & (F.array_position(F.reverse(ts), t) == F.size(ts) - i)
        return (
            F.when(t.rlike(r"^[^$`!\[\]<\\*_~]"), t)  # most tokens are words between signs
            .when(t.rlike(rf"(?s)^(?:{FORMULA})$"), F.concat(F.lit(OPEN), i.cast("string"), F.lit(CLOSE)))
            .when(t.isin(*MARKS), F.when(alone, t).otherwise(""))
            .when(t.startswith("`") & (n > 1), F.regexp_replace(t, "^`+|`+$", ""))
            .when((t.startswith("![") | t.startswith("[^") | t.startswith("](") | t.startswith("][")) & (n > 2), "")
            .when((t == "[") & (F.try_element_at(ts, i + 2).isNotNull()) & F.exists(F.slice(ts, i + 2, F.size(ts)), lambda x: x.startswith("](") | x.startswith("][")), "")
            .when(tag.rlike("^<https?://"), F.substring(t, F.lit(2), n - 2))
            .when(tag == "<sup>", "^{").when(tag == "<sub>", "_{").when(tag.isin("</sup>", "</sub>"), "}")
            .when(t.startswith("<") & (n > 2), " ")
            .when(t.startswith("\\") & (n == 2), F.substring(t, 2, 1))
            .otherwise(t)
        )

    def read(ts: Column) -> Column:
        text = bind(F.array_join(F.transform(ts, lambda t, i: plain(ts, t, i)), ""), decode_entities)
        parts = F.regexp_extract_all(text, F.lit(rf"{OPEN}\d+{CLOSE}|[^{OPEN}]+"), F.lit(0))
        formula = lambda x: F.regexp_replace(F.try_element_at(ts, F.regexp_extract(x, r"(\d+)", 1).cast("int") + 1), r"(?s)^\\\((.+)\\\)$", r"\$$1\$")
        return tidy(F.array_join(F.transform(parts, lambda x: F.when(x.startswith(OPEN), formula(x)).otherwise(x)), ""))

    return bind(F.regexp_extract_all(c, F.lit(f"(?sU){TOKENS}"), F.lit(0)), read)


def table_cells(line: Column) -> Column:
    """Cells of a pipe row; `\\|` does not separate."""
    t = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(t, r"(?<!\\)\|"), lambda x: inline_text(F.trim(x)))


def table_markdown(rows: Column) -> Column:
    """Rows as a pipe table."""
    line = lambda cells: F.concat(
        F.lit("| "), F.array_join(F.transform(cells, lambda c: F.translate(c, "|\n", "/ ")), " | "), F.lit(" |")
    )
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.try_element_at(rows, F.lit(1)), lambda c: F.lit("---")), "|"), F.lit("|"))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.lit(1), F.size(rows))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.try_element_at(rows, F.lit(1))), rule), body), "\n")).otherwise("")
