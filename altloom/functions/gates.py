"""Tests on texts: is it real, is it good enough, may it be written?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from altloom.functions import fixed
from altloom.functions.base import (
    ColumnLike, col, ends_sentence, has_any, has_more_words, is_blank, let, squash, strip, words,
)
from altloom.functions.text import normalize_universal


def is_meaningful(c: ColumnLike, tokens: Sequence[str] = fixed.SKIP_TOKENS) -> Column:
    """Text that is neither blank nor a skip token, whatever its case."""
    return F.coalesce(~F.lower(strip(c)).isin([*tokens, ""]), F.lit(False))


def is_skip_value(c: ColumnLike, values: Sequence[str] = fixed.SKIP_VALUES) -> Column:
    """Exact, case-sensitive skip list; blank text is skipped too."""
    return let(col(c), lambda t: F.coalesce((t == "") | strip(t).isin(list(values)), F.lit(True)))


def runs_on(c: ColumnLike) -> Column:
    """More than six words and no closing mark."""
    return has_more_words(c, 6) & ~ends_sentence(strip(c))


def is_placeholder(c: ColumnLike, patterns: Sequence[str] = fixed.PLACEHOLDER_PATTERNS) -> Column:
    one_pattern = "(?iU)" + "|".join(f"(?:{p})" for p in patterns)

    def test(t: Column) -> Column:
        bare = strip(F.regexp_replace(t, "(?i)" + fixed.TRAILING_SIZE, ""))
        return t.rlike(one_pattern) | bare.rlike(one_pattern) | runs_on(t)

    text = F.coalesce(col(c), F.lit(""))
    return F.when(text == "", True).otherwise(let(strip(text), test))


def is_low_value(c: ColumnLike, patterns: Sequence[str] = fixed.LOW_VALUE_PATTERNS) -> Column:
    one_pattern = "(?iU)" + "|".join(f"(?:{p})" for p in patterns)
    return let(
        strip(F.coalesce(col(c), F.lit(""))),
        lambda t: (t == "") | t.rlike(one_pattern) | runs_on(t) | (F.length(t) < 5),
    )


def passes_gate(
    c: ColumnLike, blocked: Sequence[str] = fixed.GATE_BLOCKED, known: Sequence[str] = fixed.GATE_KNOWN
) -> Column:
    """Strict gate: short, nothing blocked, closed, and a known whole word."""

    def test(t: Column) -> Column:
        knows = F.arrays_overlap(words(t), F.array(*[F.lit(w) for w in known]))
        return (
            (t != "")
            & (F.length(t) <= 140)
            & ~has_any(t, blocked)
            & ~runs_on(t)
            & (~has_more_words(t, 2) | knows)
        )

    return let(F.lower(strip(F.coalesce(col(c), F.lit("")))), test)


def passes_lenient(c: ColumnLike, blocked: Sequence[str] = fixed.LENIENT_BLOCKED) -> Column:
    return let(
        strip(F.coalesce(col(c), F.lit(""))),
        lambda t: (t != "") & (F.length(t) <= fixed.LENIENT_LIMIT) & ~has_any(F.lower(t), blocked),
    )


def is_templated(c: ColumnLike) -> Column:
    return has_any(F.coalesce(col(c), F.lit("")), fixed.TEMPLATED)


def write_gate(
    text: ColumnLike,
    kind: ColumnLike,
    is_generated: Column,
    is_fallback: Column,
    policy: str = "none",
    in_group: Column | None = None,
) -> Column:
    """The text to write, or null where the gate blocks it."""
    in_group = F.lit(False) if in_group is None else in_group

    def gate(t: Column) -> Column:
        if policy == "none":
            barred = ~is_generated | ~passes_lenient(t)
        elif policy == "doc-only":
            barred = is_fallback
        elif policy == "ppt-gated":
            barred = is_fallback & ~passes_gate(t)
        else:
            barred = F.lit(False)
        blocked = (
            (t == "")
            | ((F.lower(col(kind)) == "connector") & ~is_generated)
            | (is_fallback & in_group)
            | is_templated(t)
            | barred
        )
        return F.when(~blocked, t)

    return let(strip(text), gate)


def is_error_text(c: ColumnLike, texts: Sequence[str] = fixed.ERROR_TEXTS, shortest: int = 0) -> Column:
    """A model's apology instead of a description."""
    return let(
        F.lower(strip(F.coalesce(col(c), F.lit("")))),
        lambda t: (t == "") | (F.length(t) < shortest) | has_any(t, texts),
    )


def is_empty_placeholder(shape_type: ColumnLike, text: ColumnLike) -> Column:
    """A layout's unfilled text box."""
    t = F.lower(strip(F.coalesce(col(text), F.lit(""))))
    return col(shape_type).isin("TEXT_BOX", "PLACEHOLDER") & (
        (t == "") | has_any(t, fixed.EMPTY_PROMPTS) | t.isin(fixed.EMPTY_LABELS)
    )


def word_jaccard(a: ColumnLike, b: ColumnLike) -> Column:
    """Shared share of lower-cased words; two blanks count as equal."""

    def share(pair: Column) -> Column:
        a, b = F.size(pair["a"]), F.size(pair["b"])
        shared = let(F.size(F.array_intersect(pair["a"], pair["b"])), lambda n: n / (a + b - n))
        return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(shared)

    def taken(low: Column) -> Column:
        pair = F.struct(*[F.array_distinct(words(low[n])).alias(n) for n in ("a", "b")])
        return F.when(low["a"] == low["b"], 1.0).otherwise(let(pair, share))

    return let(F.struct(F.lower(col(a)).alias("a"), F.lower(col(b)).alias("b")), taken)


def mostly_same(a: ColumnLike, b: ColumnLike, threshold: float = 0.8) -> Column:
    return word_jaccard(a, b) >= threshold


def comparable(c: ColumnLike) -> Column:
    return squash(F.lower(normalize_universal(c)))


def equivalent(a: ColumnLike, b: ColumnLike) -> Column:
    """Equal once both are normalised, whatever case or spacing. Texts that differ in spacing only need no normal form."""

    def same(pair: Column) -> Column:
        return F.when(pair["a"] == pair["b"], True).otherwise(comparable(pair["a"]) == comparable(pair["b"]))

    return let(F.struct(*[squash(F.coalesce(col(c), F.lit(""))).alias(n) for n, c in (("a", a), ("b", b))]), same)


def needs_replace(current: ColumnLike, new: ColumnLike, normal: bool = False) -> Column:
    """Is the new text worth writing over the current one? ``normal``: the new text is in its normal form already."""
    compared = col(new) if normal else normalize_universal(new)
    return (
        F.when(is_blank(new), False)
        .when(is_blank(current), True)
        .otherwise(F.lower(normalize_universal(current)) != F.lower(compared))
    )


def punct_diff(expected: ColumnLike, actual: ColumnLike) -> Column:
    """How the closing marks of two texts differ."""
    e, a = F.coalesce(col(expected), F.lit("")), F.coalesce(col(actual), F.lit(""))
    e_end, a_end = F.right(e, F.lit(1)), F.right(a, F.lit(1))
    bare = [F.regexp_replace(t, r"[.!?]+\z", "") for t in (e, a)]
    reason = (
        F.when((e == "") | (a == ""), "empty_text")
        .when(ends_sentence(e) != ends_sentence(a), "terminal_punctuation_mismatch")
        .when(ends_sentence(e) & (e_end != a_end), "different_terminal_punctuation")
        .when((bare[0] == bare[1]) & (e != a), "punctuation_only_difference")
        .otherwise("no_punctuation_issue")
    )
    return F.struct((~reason.isin("empty_text", "no_punctuation_issue")).alias("has_issue"), reason.alias("reason"))


def is_vague(c: ColumnLike, phrases: Sequence[str] = fixed.VAGUE_OUTPUTS) -> Column:
    return has_any(F.lower(col(c)), phrases)


def validate_generated(c: ColumnLike) -> Column:
    """A usable text, or the reason there is none."""

    def check(t: Column) -> Column:
        low = F.lower(t)
        failure = F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in fixed.FAILURE_TEXTS])
        reason = (
            F.when(t == "", "empty")
            .when(F.length(t) < 3, "too_short")
            .when(failure.isNotNull(), F.concat(F.lit("failure_text: "), failure))
        )
        return F.struct(F.when(reason.isNull(), t).alias("text"), reason.alias("failure_reason"))

    given = let(strip(F.coalesce(col(c), F.lit(""))), check)
    missing = F.struct(F.lit(None).cast("string").alias("text"), F.lit("none_returned").alias("failure_reason"))
    return F.when(col(c).isNull(), missing).otherwise(given)
