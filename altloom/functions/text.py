"""Cleaning and cutting of alternative texts, as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from altloom.functions import fixed
from altloom.functions.base import (
    ColumnLike, any_of, capitalize_first, col, count_present, ends_sentence, has_any, has_more_words, head,
    leading_words, let, literal, squash, strip,
)

# A blank before a line feed or a word with one of these initials, about a third of all words.
PIECE_CUT = r" (?=[\naeiou0-9\x80-\uffff])"
# What boilerplate with a name and with a size holds; no letter outside ASCII has one of these as its other case.
NAMED_BOILERPLATE = "[Pp][Oo][Ww][Ee][Rr][Pp]"
SIZED_BOILERPLATE = f"(?U)[EeRr]{fixed.ASCII_SPACE}*[(]"


def end_mark(c: ColumnLike) -> Column:
    """Close a text with a full stop unless it ends in ``.!?``."""
    return let(
        strip(F.coalesce(col(c), F.lit(""))),
        lambda t: F.when((t == "") | ends_sentence(t), t).otherwise(F.concat(t, F.lit("."))),
    )


def first_filled(*options: Column) -> Column:
    return F.coalesce(*[F.when(o != "", o) for o in options])


def truncate_sentence(c: ColumnLike, limit: int = fixed.ALT_LIMIT) -> Column:
    """Cut at the last sentence end, else clause, else blank, else hard."""

    def longest(low: int, high: int, ending: str, text: Column) -> Column:
        return F.regexp_extract(text, f"(?s)^.{{{low},{high}}}{ending}", 0)

    def cut(text: Column) -> Column:
        head_part = first_filled(
            longest(0, limit - 1, "[.!?]", text),
            longest(max(limit - 50, 0), limit - 1, "[;,]", text),
            longest(max(limit - 20, 0), limit - 1, " ", text),
            head(text, limit),
        )
        short = strip(F.regexp_replace(strip(head_part), ",$", ""))
        fits = F.length(text) <= limit
        return F.struct(
            F.when(fits, end_mark(text)).otherwise(end_mark(short)).alias("text"),
            F.when(fits, F.lit(False)).otherwise(F.length(short) < F.length(text)).alias("truncated"),
        )

    return let(squash(F.coalesce(col(c), F.lit(""))), cut)


def occurs(text: Column, part: Column) -> Column:
    """Does a literal part occur? The regex engine skips ahead by it."""
    literal = F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.rlike(text, F.concat(F.lit("\\Q"), literal, F.lit("\\E")))


def unique_sentences(c: ColumnLike) -> Column:
    """Sentences in order, without repeats or sentences held by a longer one.

    Containment is transitive, so what survives is the first copy of every
    sentence found nowhere else. A sentence that another holds is either its
    beginning, and then that of its successor in sorted order, or lies in it
    behind the first character, and then in the tails of all joined once. Few
    are looked for there: a text is cut before the words with certain initials,
    wherever they stand, so a piece between two cuts of a sentence is a piece of
    whatever holds the sentence; one with a piece found once in the text is held
    by none. In plain text the cost is linear.
    """
    parts = F.filter(
        F.transform(F.split(squash(c), " (?<=[.!?] )"), lambda p: F.trim(p, F.lit(" ."))), lambda p: p != ""
    )

    def twice(pieces: Column) -> Column:
        return F.array_distinct(F.filter(pieces, lambda p, n: p == F.get(pieces, n + 1)))

    def single(sentence: Column, repeated: Column) -> Column:
        def whole(pieces: Column) -> Column:
            between = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
            return F.exists(between, lambda p: ~F.array_contains(repeated, p))

        return let(F.split(sentence, PIECE_CUT, 6), whole)

    def held(ordered: Column) -> Column:
        def search(all_of: Column) -> Column:
            return F.filter(
                ordered,
                lambda p, n: F.when(single(p, all_of["repeated"]), False).otherwise(
                    F.startswith(F.get(ordered, n + 1), p) | occurs(all_of["tails"], p)
                ),
            )

        # Sentences are free of line feeds, so none is found across two of them.
        pieces = F.split(F.array_join(ordered, " \n"), PIECE_CUT)
        tails = F.array_join(F.transform(ordered, lambda p: F.substring(p, 2, 2147483647)), "\n")
        return let(F.struct(let(F.sort_array(pieces), twice).alias("repeated"), tails.alias("tails")), search)

    def keep(texts: Column) -> Column:
        def alone(found: Column) -> Column:
            def once(_: Column, n: Column) -> Column:
                return let(
                    F.get(found["low"], n),
                    lambda p: (found["different"] | (F.array_position(found["low"], p) == n + 1)) & ~F.array_contains(found["held"], p),
                )

            return F.filter(texts, once)

        def judged(low: Column) -> Column:
            return let(
                F.sort_array(F.array_distinct(low)),
                lambda ordered: let(
                    F.struct(low.alias("low"), (F.size(ordered) == F.size(low)).alias("different"), held(ordered).alias("held")), alone
                ),
            )

        return let(F.transform(texts, F.lower), judged)

    return let(parts, keep)


def canonical_boilerplate(c: ColumnLike) -> Column:
    """Boilerplate in one form. The rules run only where the letters or the bracket that they need occur."""

    def named(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?i)This is a PowerPoint shape\. It is a (chart .+)", "$1")
        return F.regexp_replace(t, r"(?iU)This is a PowerPoint shape\. It is a (shape|line|connector)\b", "This is a PowerPoint $1")

    def sized(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?i)(A (?:shape|line|connector)\s*\([^)]*\))\s+\1(?=\s|$)", "$1")
        return F.regexp_replace(
            t, r"(?iU)^(A (?:shape|line|connector)\s*\([^)]*\))\s+(This is a PowerPoint (?:shape|line|connector)\b)", "$2"
        )

    once = let(col(c), lambda t: F.when(t.rlike(NAMED_BOILERPLATE), named(t)).otherwise(t))
    return let(once, lambda t: F.when(t.rlike("[(]"), sized(t)).otherwise(t))


def normalize_universal(c: ColumnLike) -> Column:
    """One deterministic form of a text, used before every write and compare."""
    joined = F.array_join(unique_sentences(F.coalesce(col(c), F.lit(""))), ". ")
    return let(end_mark(canonical_boilerplate(joined)), capitalize_first)


def normal_form_exceeds(c: ColumnLike, limit: int) -> Column:
    """True only where ``normalize_universal`` gives more than ``limit`` characters, told from a text's beginning.

    Every sentence lives on, whole and in any case, in one that is kept. A word inside
    a sentence, with a word on both sides, so stands between two blanks of the normal
    form, and different words there share no place: their lengths with a blank each
    add up to no more than the whole. Texts that the boilerplate rules may shorten, and
    those that begin with few different words inside sentences, are not judged.
    """

    def inner_words(t: Column) -> Column:
        # Dots alone are trimmed off a sentence, so they are no word behind another.
        found = F.regexp_extract_all(F.lower(squash(head(t, 3 * limit))), F.lit(r"(?<=[^.!?] )[^ ]*[^ .!?](?= \.*[^ .])"), F.lit(0))
        # One letter has two characters in lower case; the second does not count.
        return F.length(F.translate(F.array_join(F.array_distinct(found), " "), "\u0307", ""))

    def judge(t: Column) -> Column:
        return (F.length(t) > limit) & (inner_words(t) > limit) & ~(t.contains("(") & t.rlike(SIZED_BOILERPLATE)) & ~t.rlike(NAMED_BOILERPLATE)

    return F.coalesce(let(col(c), judge), F.lit(False))


def collapse_repeats(c: ColumnLike) -> Column:
    """Remove repeated size preambles, sentences, sizes and format names."""
    marker = "This is a PowerPoint shape"
    t = squash(F.coalesce(col(c), F.lit("")))
    t = F.regexp_replace(
        t, r"(?i)^(A (?:shape|line|connector) \(\d+x\d+px\))\s+(This is a PowerPoint shape\..*?)\s+\1", "$2"
    )
    t = F.regexp_replace(t, r"(?i)(This is a PowerPoint shape\.[^.]*\.)\s*\1", "$1")
    t = F.regexp_replace(t, r"(\(\d+x\d+px\))\s*\1", "$1")
    for kind in ("diagram", "circuit", "process"):
        t = F.regexp_replace(t, rf"(?i)(Vector [^.]+{kind}[^.]*\.)\s*\1", "$1")

    def keep_longest(text: Column) -> Column:
        pieces = F.split(text, marker)
        tails = F.transform(
            F.slice(pieces, F.lit(2), F.size(pieces)), lambda p, n: F.struct(F.length(p).alias("size"), (-n).alias("back"), p.alias("tail"))
        )
        return F.when(F.size(pieces) > 2, F.concat(F.lit(marker), F.array_max(tails)["tail"])).otherwise(text)

    t = let(t, keep_longest)
    for name in fixed.FORMAT_NAMES:
        t = F.regexp_replace(t, rf"(?i)\b{name}\b(.{{0,50}}?)\b{name}\b", f"{name}$1")
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, r"\.+", ".")
    t = F.regexp_replace(t, r"\s+([.,])", "$1")
    return let(t, end_mark)


def finalize_alt(c: ColumnLike) -> Column:
    """Drop reserved words, raise the first letter, stop after a word."""

    def finish(t: Column) -> Column:
        before = F.regexp_extract(t, r"(?s)^[^\p{L}]*", 0)
        rest = F.substr(t, F.length(before) + 1)
        raised = F.concat(before, capitalize_first(rest))
        closed = F.when(F.right(t, F.lit(1)).rlike(r"[\p{L}\p{N}]"), F.concat(raised, F.lit("."))).otherwise(raised)
        return F.when(F.lower(t).isin(fixed.RESERVED_TOKENS), "").otherwise(closed)

    return let(strip(F.coalesce(col(c), F.lit(""))), finish)


def strip_vague_prefix(c: ColumnLike, prefixes: Sequence[str] = fixed.VAGUE_PREFIXES) -> Column:
    """Remove the first listed opening that fits and repair what is left."""
    t = strip(F.coalesce(col(c), F.lit("")))
    t = F.regexp_replace(t, "(?iu)^" + any_of(prefixes) + r"[ ,.\-]*", "")
    t = F.regexp_replace(t, f"(?iu)^{fixed.AWKWARD_LEAD}[ .]*", fixed.AWKWARD_LEAD_REPAIR)
    return let(t, capitalize_first)


def shrink(c: ColumnLike, limit: int = fixed.SHORT_LIMIT) -> Column:
    """Shorten at a sentence, clause or comma not before position 60."""

    def cut(t: Column) -> Column:
        start = head(t, limit)
        body = first_filled(*[F.regexp_extract(start, rf"(?s)^(.{{60,}}){mark} ", 1) for mark in (r"\.", ";", ",")], start)
        return F.when(F.length(t) <= limit, t).otherwise(end_mark(F.trim(body, F.lit(" .;,"))))

    return let(squash(F.coalesce(col(c), F.lit(""))), cut)


def first_words(c: ColumnLike, limit: int = 30) -> Column:
    """The text up to its first full stop if that fits, else the first words."""

    def cut(text: Column) -> Column:
        opening = F.concat(F.substring_index(text, ".", 1), F.lit("."))
        return (
            F.when(~has_more_words(text, limit), strip(text))
            .when(text.contains(".") & ~has_more_words(opening, limit), strip(opening))
            .otherwise(F.concat(leading_words(text, limit), F.lit("...")))
        )

    return let(F.coalesce(col(c), F.lit("")), cut)


def two_sentences(c: ColumnLike) -> Column:
    """The first two sentences longer than three characters."""

    def pick(t: Column) -> Column:
        parts = F.transform(F.split(t, rf"[.!?]+(?:{fixed.SPACE}|\z)"), strip)
        kept = F.transform(F.filter(parts, lambda p: F.length(p) > 3), capitalize_first)
        return F.when(t == "", "").otherwise(
            end_mark(F.when(F.size(kept) == 0, t).otherwise(F.array_join(F.slice(kept, 1, 2), ". ")))
        )

    return let(strip(F.coalesce(col(c), F.lit(""))), pick)


def short_title(
    c: ColumnLike, limit: int = fixed.TITLE_LIMIT, prefixes: Sequence[str] = fixed.TITLE_PREFIXES
) -> Column:
    """A title cut at a sentence end or a blank late in the limit."""
    t = let(
        strip(F.coalesce(col(c), F.lit(""))),
        lambda t: F.when(
            F.upper(head(t, 9)) == "FALLBACK:", F.trim(F.substring(t, 10, 2147483647), F.lit(" .:-–—"))
        ).otherwise(t),
    )
    t = strip(F.regexp_replace(t, "^" + any_of(prefixes), ""))
    late = int(limit * 0.7) + 1

    def cut(full: Column) -> Column:
        start = head(full, limit)
        at = [strip(F.regexp_extract(start, rf"(?s)^(.{{{late},}}{mark}) ", 1)) for mark in (r"\.", "!", r"\?")]
        at_blank = strip(F.regexp_extract(start, rf"(?s)^(.{{{late},}}) ", 1))
        return F.when(F.length(full) <= limit, full).otherwise(
            first_filled(*at, at_blank, F.concat(strip(start), F.lit("...")))
        )

    return let(finalize_alt(t), cut)


def compare_key(c: ColumnLike) -> Column:
    """Case, blanks and closing marks levelled for comparison."""

    # Pieces of regexes are found faster than literal parts, which Spark compares at every byte.
    nouns = f"[{''.join(sorted({n[0] for n in fixed.PROPER_NOUNS}))}]" + any_of(n[1:] for n in fixed.PROPER_NOUNS)

    def level(low: Column) -> Column:
        raised = low
        for noun in fixed.PROPER_NOUNS:
            raised = F.regexp_replace(raised, f"(?<![^ ]){literal(noun)}(?![^ ])", noun.capitalize())
        return capitalize_first(F.when(low.rlike(nouns), raised).otherwise(low))

    levelled = let(F.lower(squash(c)), level)
    return F.when(F.coalesce(col(c), F.lit("")) == "", "").otherwise(
        F.concat(F.regexp_replace(levelled, r"[.!?]+$", ""), F.lit("."))
    )


def hard_cut(c: ColumnLike, limit: int = fixed.SHORT_LIMIT) -> Column:
    """Clean, cut at the limit and close."""
    cut = F.regexp_replace(head(strip_vague_prefix(c), limit), f"{fixed.SPACE}+$", "")
    return let(cut, lambda t: F.when((t == "") | ends_sentence(t), t).otherwise(F.concat(t, F.lit("."))))


def dedupe_token(c: ColumnLike, token: str) -> Column:
    """Mention a format name once where it is repeated close by."""
    t = col(c)
    several = F.regexp_count(F.upper(t), F.lit(token.upper())) > 1
    once = F.regexp_replace(t, rf"(?i)({token}\s+format)(.+?)\1", "$1$2")
    once = F.regexp_replace(once, rf"(?i)({token})(\s+[^.]{{0,30}}?\s+){token}", "$1$2")
    phrase = rf"Original {token} vector image[^.]*\."
    once = F.regexp_replace(once, rf"(?i)({phrase})(.+?)({phrase})", "$1$2")
    t = squash(F.when(several, once).otherwise(t))
    return strip(F.regexp_replace(t, r"\s+([.,])", "$1"))


def stem(c: ColumnLike) -> Column:
    """A text without sizes, for telling repeats."""
    t = F.regexp_replace(F.lower(strip(c)), r"\(\d+x\d+px\)", "")
    return squash(F.regexp_replace(t, r"\d+×\d+\s*pixels?", ""))


def best_text(texts: ColumnLike) -> Column:
    """The best scored of several texts; the earlier of equals wins."""
    parts = F.filter(F.transform(col(texts), lambda p: strip(F.coalesce(p, F.lit("")))), lambda p: p != "")

    def choose(kept: Column) -> Column:
        stems = F.transform(kept, stem)
        firsts = F.filter(kept, lambda _, n: (F.get(stems, n) != "") & (F.array_position(stems, F.get(stems, n)) == n + 1))
        scored = F.transform(
            firsts, lambda p, n: F.struct(semantic_score(p).alias("score"), (-n).alias("back"), p.alias("text"))
        )
        best = F.when(F.size(kept) == 1, F.get(kept, F.lit(0))).otherwise(F.array_max(scored)["text"])
        return F.coalesce(best, F.lit(""))

    return collapse_repeats(let(parts, choose))


def quality_score(c: ColumnLike) -> Column:
    """How much a text says; errors and blanks always lose."""
    stripped = strip(F.coalesce(col(c), F.lit("")))

    def score(t: Column) -> Column:
        low = F.lower(t)
        beyond = low
        for phrase in fixed.QUALITY_BOILERPLATE:
            beyond = F.replace(beyond, F.lit(phrase), F.lit(""))
        long_words = F.regexp_count(beyond, F.lit(f"[^{fixed.SPACE[1:-1]}]{{3,}}"))
        total = (
            F.when(has_any(low, fixed.QUALITY_ERRORS), -10).otherwise(0)
            + F.when(low.rlike(fixed.SIZE_PREAMBLE + r"\z"), -2).otherwise(0)
            + F.when(long_words >= 3, 3).otherwise(0)
            + F.when(has_any(low, fixed.QUALITY_NOUNS), 2).otherwise(0)
            + F.when(F.length(t).between(40, 200), 1).otherwise(0)
        )
        return F.when(t == "", -10).otherwise(total)

    return let(stripped, score)


def semantic_score(c: ColumnLike) -> Column:
    """Words that say something against boilerplate."""
    low = F.lower(col(c))
    bad = sum((low.rlike(p).cast("int") for p in fixed.SEMANTIC_BOILERPLATE), F.lit(0))
    fair = F.length(strip(c)).between(20, 150).cast("int")
    return count_present(low, fixed.SEMANTIC_WORDS) * 2 - bad * 2 + fair


def post_process(c: ColumnLike, limit: int = fixed.SHORT_LIMIT, max_words: int = 30) -> Column:
    """What a generated text goes through: summary, prefix, length, mark."""

    def summary(t: Column) -> Column:
        return F.when(has_more_words(t, max_words) | t.endswith("..."), first_words(t, max_words)).otherwise(t)

    return end_mark(shrink(strip_vague_prefix(let(strip(F.coalesce(col(c), F.lit(""))), summary)), limit))


def cut_tokens(c: ColumnLike, tokens: int) -> Column:
    """Roughly ``tokens`` tokens, at 1.3 tokens a word."""
    most = int(tokens / 1.3)
    return F.when(has_more_words(c, most), F.concat(leading_words(c, most), F.lit("..."))).otherwise(col(c))
