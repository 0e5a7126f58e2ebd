"""Fragments the check SQL is put together from."""

from __future__ import annotations

import re


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def mark(x: str) -> str:
    return f"CASE WHEN {x} = '' OR right({x}, 1) IN ('.','!','?') THEN {x} ELSE {x} || '.' END"


def end_mark(x: str) -> str:
    s = strip(x)
    return f"CASE WHEN {s} = '' OR right({s}, 1) IN ('.','!','?') THEN {s} ELSE {s} || '.' END"


def cap(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


# Letters whose capital is several letters, as ß: the check engine's upper() takes one for one.
LONG_CAPITALS = {c: c.upper() for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}


def full_upper(x: str) -> str:
    """The capital of one letter by the full mapping, which the queries and the reference use."""
    return f"coalesce(map([{quoted(list(LONG_CAPITALS))}], [{quoted(list(LONG_CAPITALS.values()))}])[{x}], upper({x}))"


def full_cap(x: str) -> str:
    return f"{full_upper(f'substr({x}, 1, 1)')} || substr({x}, 2)"


def word_count(x: str) -> str:
    s = squash(x)
    return f"CASE WHEN {s} = '' THEN 0 ELSE len(string_split({s}, ' ')) END"


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def alternation(values: list[str]) -> str:
    return "(" + "|".join(re.sub(r"([\\.\[\](){}*+?^$|\-])", r"\\\1", v) for v in values).replace("'", "''") + ")"


def contains_any(x: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{v}')" for v in values) + ")"


def count_present(x: str, values: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{v}') AS INT)" for v in values) + ")"
