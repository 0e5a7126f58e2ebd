"""Small column helpers the text rules are built from."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from altloom.functions.fixed import ASCII_SPACE, SPACE, SPACE_CHARS

ColumnLike = Column | str
NOT_SPACE = f"[^{SPACE[1:]}"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: ColumnLike) -> Column:
    return F.trim(col(c), F.lit(SPACE_CHARS))


def squash(c: ColumnLike) -> Column:
    """White space runs become one blank; ends are trimmed.

    Plain ASCII text takes the cheaper class; with (?U) it is SPACE. Single
    blanks are not replaced: nearly all white space is that, and a replacement
    costs more than the scan.
    """
    runs_but_blanks = f"{ASCII_SPACE}(?:{ASCII_SPACE}+|(?<! ))"

    def runs(t: Column) -> Column:
        plain = F.octet_length(t) == F.length(t)
        return F.trim(
            F.when(plain, F.regexp_replace(t, runs_but_blanks, " ")).otherwise(F.regexp_replace(t, "(?U)" + runs_but_blanks, " "))
        )

    return let(col(c), runs)


def words(c: ColumnLike) -> Column:
    """Words of a text; a blank text has none."""
    return let(squash(c), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def word_count(c: ColumnLike) -> Column:
    return F.regexp_count(col(c), F.lit(f"{NOT_SPACE}+"))


def has_more_words(c: ColumnLike, n: int) -> Column:
    """More than ``n`` words; the match ends at the first one too many."""
    return col(c).rlike(f"^{SPACE}*(?:{NOT_SPACE}+{SPACE}+){{{n}}}{NOT_SPACE}")


def leading_words(c: ColumnLike, n: int) -> Column:
    """The first ``n`` words of a text that has at least as many."""
    found = F.regexp_extract(col(c), f"^{SPACE}*((?:{NOT_SPACE}+{SPACE}+){{{n - 1}}}{NOT_SPACE}+)", 1)
    return squash(found)


def is_blank(c: ColumnLike) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def literal(text: str) -> str:
    return re.escape(text).replace(r"\ ", " ")


def any_of(texts: Iterable[str]) -> str:
    """One alternation of literal texts, tried in their order."""
    return "(?:" + "|".join(literal(t) for t in texts) + ")"


def by_first(patterns: Iterable[str]) -> str:
    """An alternation grouped by first character, for tests without order.

    Where a text cannot start, one look at the character is enough.
    """
    groups: dict[str, list[str]] = {}
    for pattern in dict.fromkeys(patterns):
        size = 2 if pattern.startswith("\\") else 1
        groups.setdefault(pattern[:size], []).append(pattern[size:])
    return "(?:" + "|".join(f"{start}(?:{'|'.join(rest)})" for start, rest in groups.items()) + ")"


def has_any(c: ColumnLike, texts: Iterable[str]) -> Column:
    return col(c).rlike(by_first(literal(t) for t in texts))


def count_present(c: ColumnLike, texts: Iterable[str]) -> Column:
    """How many of the texts occur."""
    return sum((col(c).contains(t).cast("int") for t in texts), F.lit(0))


def ends_sentence(c: ColumnLike) -> Column:
    return F.right(col(c), F.lit(1)).isin(".", "!", "?")


def capitalize_first(c: ColumnLike) -> Column:
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def head(c: ColumnLike, n: int) -> Column:
    return F.substring(col(c), 1, n)
