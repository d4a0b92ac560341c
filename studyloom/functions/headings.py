"""Numbers and names at the head of a line, read part by part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyloom.functions.text import bind


def head(text: Column) -> Column:
    """The line's first word, '' where the line begins with a space or has none."""
    return F.split(text, r"\s+", 2)[0]


def rest(text: Column) -> Column:
    """What stands after the first word, '' if nothing."""
    return F.coalesce(F.try_element_at(F.split(text, r"\s+", 2), F.lit(2)), F.lit(""))


def _without(word: Column, sign: str) -> Column:
    return F.when(word.endswith(sign), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def only(word: Column, letters: str, most: int) -> Column:
    """One to `most` characters, all of `letters`."""
    return F.length(word).between(1, most) & (F.translate(word, letters, "") == "")


def _counts(word: Column, letter: bool) -> Column:
    """1, 1.2, 1.2.3, 1.2.3.4, each number of one or two digits; A.1 and the like too where `letter`."""

    def parts(p: Column) -> Column:
        first = only(p[0], "0123456789", 2)
        first = first | only(p[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1) if letter else first
        return first & (F.size(p) <= 4) & F.forall(F.slice(p, 2, 9), lambda x: only(x, "0123456789", 2))

    return bind(F.split(_without(word, "."), r"\."), parts)


def is_numbered(text: Column, roman: str, most_roman: int, letter: bool) -> Column:
    """A number and something after it: digits with points, a capital letter with such, or a Roman number with a stop."""
    first = head(text)
    latin = first.endswith(".") & only(_without(first, "."), roman, most_roman)
    # such a line begins with a digit or a capital letter
    return F.substring(text, 1, 1).between("0", "Z") & (rest(text) != "") & (_counts(first, letter) | latin)


def is_named(text: Column, names: Sequence[str], letter: bool = False) -> Column:
    """One of these names in lower case, alone or after a plain number: one or two digits, up to four of IVX, or a letter."""
    low = F.lower(text)
    count = _without(head(low), ".")
    plain = only(count, "0123456789", 2) | only(count, "ivx", 4)
    plain = plain | only(count, "abcdefghijklmnopqrstuvwxyz", 1) if letter else plain
    return low.isin(*names) | (plain & rest(low).isin(*names))


def equation_number(word: Column) -> Column:
    """The number of `(3)`, `(3a)`, `(A.1)` or `(2.4)`, a stop or comma after it or none; null for any other word."""
    closed = F.when(word.endswith(".") | word.endswith(","), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    inner = F.when(closed.startswith("(") & closed.endswith(")"), F.substring(closed, F.lit(2), F.length(closed) - 2))

    def read(n: Column) -> Column:
        last = F.substring(n, -1, 1)
        bare = F.when(only(last, "abcdefghijklmnopqrstuvwxyz", 1), F.substring(n, F.lit(1), F.length(n) - 1)).otherwise(n)
        lead = only(F.substring(bare, 1, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1)
        after = F.substring(bare, 2, 99)
        lettered = F.when(after.startswith("."), F.substring(after, 2, 99)).otherwise(after)
        parts = F.split(F.when(lead, lettered).otherwise(bare), r"\.")
        right = (F.size(parts) <= F.when(lead, 1).otherwise(2)) & F.forall(parts, lambda p: only(p, "0123456789", 99))
        return F.when(right, n)

    return bind(inner, read)
