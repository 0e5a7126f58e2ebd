"""Classification rules as boolean and label columns.

Ordered rule cascades are single ``CASE`` expressions, so a row stops at its
first match and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altloom.functions import rules
from altloom.functions.base import ColumnLike, by_first, col, count_present, has_any, has_more_words, is_blank, let, strip
from altloom.functions.describe import stub
from altloom.functions.gates import is_skip_value, passes_gate
from altloom.functions.geometry import area, aspect_ratio, parse_area
from altloom.functions.review import lookup


def first_rule(*cases: tuple[Column, object]) -> Column:
    """Value of the first condition that holds, else null."""
    chain = None
    for condition, value in cases:
        condition = F.coalesce(condition, F.lit(False))
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def whole_words(banks: Sequence[str]) -> str:
    """A bank is words parted by bars; together they match as whole words."""
    words = [word for bank in banks for word in bank.split("|")]
    return rf"(?<![\p{{L}}\p{{N}}_]){by_first(words)}(?![\p{{L}}\p{{N}}_])"


# --- kinds -----------------------------------------------------------------


def element_type(shape_type: ColumnLike) -> Column:
    return F.coalesce(lookup(rules.ELEMENT_TYPES, col(shape_type)), F.lit("unknown"))


def known_type(shape_type: ColumnLike) -> Column:
    return F.when(col(shape_type).isin(rules.KNOWN_TYPES), col(shape_type)).otherwise(
        F.concat(F.lit("SHAPE_"), col(shape_type))
    )


def format_type(shape_type: ColumnLike, has_image: Column) -> Column:
    return F.when(col(shape_type) != "PICTURE", "shape").when(has_image, "png").otherwise("jpg")


def handling(element: ColumnLike) -> Column:
    """Which path an element takes: by direction, by pixels or by text."""
    return (
        F.when(col(element).isin("connector", "line"), "connector-bypass")
        .when(col(element).isin("picture", "image"), "raster")
        .otherwise("generic")
    )


def is_visual(
    shape_type: ColumnLike, fill_kind: ColumnLike, has_line: Column, w: ColumnLike, h: ColumnLike, rule: str,
    text: ColumnLike | None = None,
) -> Column:
    """Visual significance: ``styled``, ``rendered`` or ``injected``."""
    w, h, fill = col(w), col(h), col(fill_kind)
    filled = fill != "none"
    if rule == "styled":
        return filled | has_line | (w > 200) | (h > 200)
    if rule == "rendered":
        stands_out = filled | has_line | ((w >= 30) & (h >= 30))
        wordy = (col(shape_type) == "TEXT_BOX") & (F.length(strip(text)) > 10) if text is not None else F.lit(False)
        return ~col(shape_type).isin("GROUP", "PICTURE") & (
            (fill == "picture") | (col(shape_type).isin(rules.RENDERED_TYPES) & (stands_out | wordy))
        )
    if rule == "injected":
        placed = (col(shape_type) == "PLACEHOLDER") & (filled | has_line | ((w >= 10) & (h >= 10)))
        return col(shape_type).isin(rules.VISUAL_TYPES) | placed | fill.isin("picture", "pattern")
    raise ValueError(f"unknown rule {rule}")


# --- decorative by name ------------------------------------------------------


def decorative_by_name(name: ColumnLike, name_rules: Mapping[str, Sequence[str]] = rules.NAME_RULES) -> Column:
    """Never-list beats exact beats contained."""
    never = [t.lower() for t in name_rules.get("never", [])]
    exact = [t.lower() for t in name_rules.get("exact", [])]
    partial = [t.lower() for t in dict.fromkeys([*name_rules.get("contains", []), *name_rules.get("force", [])])]

    def test(low: Column) -> Column:
        matched = low.isin(exact) | (has_any(low, partial) if partial else F.lit(False))
        return matched & ~has_any(low, never) if never else matched

    return F.coalesce(let(F.lower(col(name)), test), F.lit(False))


def decorative_by_scope(
    filename: ColumnLike, shape_name: ColumnLike, force: Sequence[str] = rules.NAME_RULES["force"], scope: str = "both"
) -> Column:
    """Force-list terms, taken as they are, in the lower-cased names."""
    in_file, in_name = (F.coalesce(has_any(F.lower(col(c)), force), F.lit(False)) for c in (filename, shape_name))
    return {"filename": in_file, "shape_name": in_name}.get(scope, in_file | in_name)


def decorative_reasons(
    name: ColumnLike, w: ColumnLike, h: ColumnLike, x: ColumnLike, y: ColumnLike, copies: ColumnLike,
    checks: Sequence[str] = (),
) -> Column:
    """Notes on why a picture looks decorative; each check is off by default."""
    w, h, x, y = col(w), col(h), col(x), col(y)
    notes: list[Column] = []
    if "size" in checks:
        ratio = aspect_ratio(w, h)
        notes += [
            F.when((w < 100) | (h < 100), F.lit("Image too small")),
            F.when(ratio > 6, F.concat(F.lit("Extreme aspect ratio ("), F.round(ratio, 1).cast("string"), F.lit(":1)"))),
        ]
    if "keyword" in checks:
        notes.append(F.when(col(name).rlike("(?i)" + rules.DECORATION_WORDS), F.lit("Filename suggests decoration")))
    if "flag" in checks:
        notes.append(F.when(F.lower(col(name)).contains("flag"), F.lit("Contains the word 'flag'")))
    if "corner" in checks:
        left, right, top, bottom = x < 50, x > 600, y < 50, y > 500
        notes.append(
            F.when(left & top, "Top-left corner").when(left & bottom, "Bottom-left corner")
            .when(right & top, "Top-right corner").when(right & bottom, "Bottom-right corner")
        )
    if "duplicate" in checks:
        notes.append(F.when(col(copies) > 1, F.concat(F.lit("Appears on "), col(copies).cast("string"), F.lit(" slides"))))
    return F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>")


def document_decorative(
    name: ColumnLike, descr: ColumnLike, pixels: ColumnLike, name_rules: Mapping[str, Sequence[str]] = rules.NAME_RULES,
    threshold: int | None = 50,
) -> Column:
    """Name rules over name and description, then a small area."""
    low_name, low_descr = F.lower(F.coalesce(col(name), F.lit(""))), F.lower(F.coalesce(col(descr), F.lit("")))
    both = strip(F.concat(low_name, F.lit(" "), low_descr))
    exact = [t.lower() for t in name_rules["exact"]]
    small = F.lit(False) if threshold is None else (col(pixels) > 0) & (col(pixels) < threshold * threshold)
    return F.coalesce(
        first_rule(
            (has_any(both, name_rules["never"]), False),
            (has_any(both, [*name_rules["force"], *(t.lower() for t in name_rules["contains"])]), True),
            (low_name.isin(exact) | low_descr.isin(exact), True),
            (small, True),
        ),
        F.lit(False),
    )


# --- educational content -----------------------------------------------------


def has_context(text: ColumnLike, words: Sequence[str] = rules.CONTEXT_WORDS, at_least: int = 2) -> Column:
    """Enough of the words occur in the text."""
    return let(F.lower(F.coalesce(col(text), F.lit(""))), lambda low: count_present(low, words) >= at_least)


def is_educational(
    filename: ColumnLike, slide_text: ColumnLike, banks: Sequence[str] | None = None,
    file_patterns: Sequence[str] = rules.FILE_PATTERNS, slide_banks: Sequence[str] = rules.SLIDE_WORDS,
) -> Column:
    """Teaching content by name and text, file name, or a wordy slide."""
    banks = banks or [*rules.SCIENCE_WORDS, *rules.TECHNICAL_WORDS, *rules.TEACHING_WORDS, *rules.MATH_WORDS]
    name, text = F.lower(col(filename)), F.lower(F.coalesce(col(slide_text), F.lit("")))
    return (
        F.concat_ws(" ", name, text).rlike(whole_words(banks))
        | name.rlike("|".join(file_patterns))
        | ((F.length(text) > 50) & text.rlike(whole_words(slide_banks)))
    )


def is_educational_shape(
    name: ColumnLike, text: ColumnLike, slide_text: ColumnLike, w: ColumnLike, h: ColumnLike,
    words: Sequence[str] = rules.CONTEXT_WORDS, context_words: int = 2,
) -> Column:
    return (
        has_any(F.lower(col(name)), rules.TEACHING_SHAPES)
        | F.lower(col(text)).rlike("(?U)" + "|".join(rules.TEACHING_TEXTS))
        | (has_context(slide_text, words, context_words) & (F.least(col(w), col(h)) > 20))
    )


def is_text_content(shape_type: ColumnLike, text: ColumnLike, has_frame: Column) -> Column:
    """A text box or framed text that says something."""
    t = strip(F.coalesce(col(text), F.lit("")))
    functional = F.lower(t).rlike("(?U)" + "|".join(rules.FUNCTIONAL_TEXTS)) | (F.length(t) > 1)
    return ((col(shape_type) == "TEXT_BOX") & (t != "")) | (has_frame & (t != "") & functional)


def is_title_area(name: ColumnLike, text: ColumnLike, w: ColumnLike, h: ColumnLike, top: ColumnLike) -> Column:
    """A title by name, or by place and form."""
    t = strip(F.coalesce(col(text), F.lit("")))
    title_like = t.rlike("|".join(rules.TITLE_TEXTS)) | (~has_more_words(t, 8) & (F.length(t) <= 60))
    return has_any(F.lower(col(name)), rules.TITLE_NAMES) | (
        (col(top) <= 180) & (((col(w) > 200) & (col(h) > 30)) | ((F.length(t) > 2) & title_like))
    )


def is_content_size(
    w: ColumnLike, h: ColumnLike, x: ColumnLike, y: ColumnLike, slide_text: ColumnLike,
    words: Sequence[str] = rules.SIZE_CONTEXT_WORDS,
) -> Column:
    """Content by size, proportion, share of the slide and place."""
    w, h, text = col(w), col(h), F.coalesce(col(slide_text), F.lit(""))
    short, ratio = F.least(w, h), aspect_ratio(w, h)
    told = (F.length(text) > 30) & has_any(F.lower(text), words)
    return F.when((w <= 0) | (h <= 0), False).otherwise(
        (short > 300)
        | ((short > 150) & ((ratio < 5) | told))
        | (w * h / (960 * 720) > 0.05)
        | ((short > 100) & (ratio < 3) & (col(x) > 50) & (col(y) > 50))
    )


# --- decorative cascades -----------------------------------------------------


def shape_decorative(
    shape_type: ColumnLike, auto_type: ColumnLike, name: ColumnLike, text: ColumnLike, has_frame: Column,
    slide_text: ColumnLike, w: ColumnLike, h: ColumnLike, top: ColumnLike, threshold: int = 50,
    words: Sequence[str] = rules.CONTEXT_WORDS, context_words: int = 2,
) -> Column:
    """Decorative verdict of a shape and the rule that gave it."""
    kind, w, h = col(shape_type), col(w), col(h)
    t = strip(F.coalesce(col(text), F.lit("")))
    short, long, ratio = F.least(w, h), F.greatest(w, h), aspect_ratio(w, h)
    context = has_context(slide_text, words, context_words)
    bare_auto = (kind == "AUTO_SHAPE") & (t == "")
    rule = F.coalesce(
        first_rule(
            (is_educational_shape(name, text, slide_text, w, h, words, context_words), "keep_educational"),
            (is_text_content(shape_type, text, has_frame), "keep_text"),
            (is_title_area(name, text, w, h, top), "keep_title"),
            (F.length(t) > 2, "keep_worded"),
            ((short < threshold) & (short > 0), F.when(context, "keep_small_in_context").otherwise("small")),
            (kind == "LINE", "line"),
            (kind == "CONNECTOR", "connector"),
            (kind == "FREEFORM", "freeform"),
            (kind == "TEXT_EFFECT", F.when(F.length(t) > 10, "keep_text_effect").otherwise("text_effect")),
            ((kind == "CALLOUT") & (t == ""), "callout"),
            (bare_auto & has_any(F.upper(col(auto_type)), rules.SIMPLE_SHAPES), "geometric"),
            (bare_auto & (long > 500), F.when(context, "keep_background_in_context").otherwise("background")),
            (bare_auto & (long > 200) & (ratio > 4), "divider"),
            (bare_auto & (long <= 200) & (short < 80) & (short > 0), "small_geometric"),
            (ratio > 15, "thin"),
            ((long > 0) & (long < 15), "tiny"),
            (F.lower(t).isin(rules.SYMBOL_TEXTS), "symbol"),
        ),
        F.lit("keep_default"),
    )
    return let(rule, lambda r: F.struct((~r.startswith("keep_")).alias("decorative"), r.alias("rule")))


def shape_decorative_fallback(
    shape_class: ColumnLike, tag: ColumnLike, w: ColumnLike, h: ColumnLike, text: ColumnLike, fill_kind: ColumnLike
) -> Column:
    """Verdict for kinds the main cascade does not know, with its reason."""
    name, w, h = col(shape_class), col(w), col(h)
    ratio = aspect_ratio(w, h)
    reason = first_rule(
        (has_any(name, rules.GEOMETRIC_CLASSES), F.concat(F.lit("Geometric shape class: "), name)),
        (has_any(name, rules.CONNECTOR_CLASSES), F.concat(F.lit("Connector class: "), name)),
        (has_any(name, rules.DRAWING_CLASSES), F.concat(F.lit("Drawing class: "), name)),
        (has_any(F.lower(col(tag)), rules.DECORATIVE_TAGS), F.concat(F.lit("XML tag: "), col(tag))),
        (
            ((w > 0) & (w < 20)) | ((h > 0) & (h < 20)),
            F.concat(F.lit("Very small shape: "), w.cast("string"), F.lit("x"), h.cast("string"), F.lit("px")),
        ),
        (ratio > 10, F.lit("Very thin shape")),
        (col(text).isNotNull() & is_blank(text), F.concat(F.lit("Text-capable shape without content: "), name)),
        (col(fill_kind) == "gradient", F.lit("Shape with gradient fill (likely decorative)")),
        (col(fill_kind) == "textured", F.lit("Shape with texture fill (likely decorative)")),
    )
    missed = F.concat(F.lit("No fallback criteria matched for "), name)
    return F.struct(reason.isNotNull().alias("decorative"), F.coalesce(reason, missed).alias("reason"))


def outline_decorative(shape_type: ColumnLike, fill_kind: ColumnLike, w: ColumnLike, h: ColumnLike) -> Column:
    """Lines, connectors and thin unfilled shapes."""
    return col(shape_type).isin("LINE", "CONNECTOR") | F.coalesce(
        (col(shape_type) == "AUTO_SHAPE") & (col(fill_kind) == "none") & (aspect_ratio(w, h) > 10), F.lit(False)
    )


def stub_decorative(name: ColumnLike, w: ColumnLike, h: ColumnLike) -> Column:
    return has_any(F.lower(col(name)), rules.DECORATIVE_STUBS) | (area(w, h) < 100)


def entry_decorative(
    shape_type: ColumnLike, w: ColumnLike, h: ColumnLike, slide_text: ColumnLike,
    words: Sequence[str] = rules.DECORATIVE_CONTEXT,
) -> Column:
    return (
        col(shape_type).isin("LINE", "CONNECTOR")
        | (area(w, h) < 100)
        | has_any(F.lower(F.coalesce(col(slide_text), F.lit(""))), words)
    )


def review_decorative(w: ColumnLike, h: ColumnLike, current: ColumnLike, suggested: ColumnLike) -> Column:
    """Hint for reviewers: small, or without any text."""
    w, h = col(w), col(h)
    no_text = (F.coalesce(col(current), F.lit("")) == "") & (F.coalesce(col(suggested), F.lit("")) == "")
    return ((w > 0) & (h > 0) & ((w < 50) | (h < 50))) | no_text


def needs_alt(
    filename: ColumnLike, slide_text: ColumnLike, w: ColumnLike, h: ColumnLike, x: ColumnLike, y: ColumnLike,
    copies: ColumnLike, checks: Sequence[str] = (), name_rules: Mapping[str, Sequence[str]] = rules.NAME_RULES,
    banks: Sequence[str] | None = None,
) -> Column:
    """Name rules, then teaching content, then size, then the heuristics."""
    plain = F.size(decorative_reasons(filename, w, h, x, y, copies, checks)) == 0
    return (
        F.when(decorative_by_name(filename, name_rules), False)
        .when(is_educational(filename, slide_text, banks), True)
        .when(is_content_size(w, h, x, y, slide_text), True)
        .otherwise(plain)
    )


def bypass_reason(element: ColumnLike, w: ColumnLike, h: ColumnLike, has_data: Column) -> Column:
    """Why an element is not shown to the model, or null."""
    w, h = col(w), col(h)
    return first_rule(
        (
            col(element).isin("connector", "line"),
            F.concat(F.lit("Using descriptive text for "), col(element), F.lit(" (no AI analysis needed)")),
        ),
        (
            (w < 5) | (h < 5),
            F.concat(F.lit("Element too small ("), w.cast("string"), F.lit("x"), h.cast("string"), F.lit("px)")),
        ),
        (~has_data, F.lit("No shape data available")),
    )


# --- decisions -----------------------------------------------------------------


def include_policy(
    shape_type: ColumnLike, w: ColumnLike, h: ColumnLike, slide_text: ColumnLike, strategy: str = "smart",
    min_area: str = "1%", words: Sequence[str] = rules.DECORATIVE_CONTEXT,
) -> Column:
    """Whether policy lets an element through, and why."""
    kind, size = col(shape_type), area(w, h)
    decorative = entry_decorative(shape_type, w, h, slide_text, words)
    not_decorative = F.concat(F.lit("decorative "), kind, F.lit(" excluded"))
    if strategy == "off":
        include = kind == "PICTURE"
        reason = F.when(include, "picture in off mode (pictures only)").otherwise(
            F.concat(kind, F.lit(" excluded in off mode (pictures only)"))
        )
    elif strategy == "all":
        include = ~decorative
        reason = F.when(include, F.concat(kind, F.lit(" included in all mode"))).otherwise(not_decorative)
    elif strategy == "smart":
        least = parse_area(F.lit(min_area))

        def compared(word: str, sign: str) -> Column:
            return F.concat(
                kind, F.lit(f" {word} threshold ("), size.cast("bigint").cast("string"), F.lit(f" {sign} "),
                least.cast("string"), F.lit(")"),
            )

        include = (kind == "PICTURE") | (~decorative & (size >= least))
        reason = (
            F.when(kind == "PICTURE", "picture in smart mode")
            .when(decorative, not_decorative)
            .when(size >= least, compared("above", ">="))
            .otherwise(compared("below", "<"))
        )
    else:
        include, reason = F.lit(False), F.lit(f"unknown strategy: {strategy}")
    return F.struct(include.alias("include"), reason.alias("reason"))


def decide(df: DataFrame, mode: str = "preserve", strategy: str = "smart", min_area: str = "1%",
           words: Sequence[str] = rules.DECORATIVE_CONTEXT) -> DataFrame:
    """Add action, decision reason, why, text and source to every element.

    Needs ``cached_alt`` (text of another element with the same content, or
    null), ``final_alt`` and ``model_called`` next to the element columns. A
    ``policy`` column worked out before the cache was joined is used as it is.
    """
    policy = (
        F.col("policy") if "policy" in df.columns
        else include_policy("shape_type", "width", "height", "slide_text", strategy, min_area, words)
    )
    cached, own = ~is_blank("cached_alt"), ~is_blank("final_alt") & F.col("model_called")
    keep = ~is_blank("existing_alt") if mode == "preserve" else F.lit(False)
    reason = (
        F.when(keep, "preserve_existing")
        .when(~F.col("__policy.include"), "policy_excluded")
        .when(cached, "cached")
        .when(own, "already_generated")
        .otherwise("needs_generation")
    )
    actions = {
        "preserve_existing": "preserve", "policy_excluded": "exclude", "cached": "use_cache",
        "already_generated": "use_cache", "needs_generation": "generate",
    }
    decided = F.col("decision_reason")
    return (
        df.withColumn("__policy", policy)
        .withColumn("decision_reason", reason)
        .withColumns(
            {
                "action": lookup(actions, decided),
                "include_reason": F.when(decided == "preserve_existing", f"existing ALT preserved in {mode} mode")
                .when(decided == "policy_excluded", "")
                .when(decided == "cached", "reused from cache (content_key match)")
                .when(decided == "already_generated", "already processed in this run")
                .otherwise(F.col("__policy.reason")),
                "exclude_reason": F.when(decided == "policy_excluded", F.col("__policy.reason")).otherwise(""),
                "decided_alt": F.when(decided == "preserve_existing", F.col("existing_alt"))
                .when(decided == "cached", F.col("cached_alt"))
                .when(decided == "already_generated", F.col("final_alt"))
                .otherwise(""),
                "decision_source": F.coalesce(lookup(rules.DECISION_SOURCES, decided), F.lit("unknown")),
            }
        )
        .drop("__policy")
    )


def finalize(df: DataFrame) -> DataFrame:
    """Settle text and reason of every element after generation."""
    suggested = F.coalesce(F.nullif(F.col("final_alt"), F.lit("")), F.col("suggested_alt"), F.lit(""))
    suggested, current = strip(suggested), strip(F.coalesce("existing_alt", F.lit("")))
    given = F.nullif(F.col("decision_reason"), F.lit(""))
    reason = (
        F.when((suggested != "") & given.isin("cached", "generated_new"), given)
        .when((suggested != "") & F.col("model_called"), "generated_new")
        .when((suggested != "") & (F.col("source") == "cached"), "cached")
        .when(suggested != "", F.coalesce(given, F.lit("generated_new")))
        .when(current != "", F.coalesce(given, F.lit("preserve_existing")))
        .otherwise(F.coalesce(given, F.lit("needs_generation")))
    )
    outcome = (
        F.when((suggested != "") & F.coalesce(given.isin("cached", "generated_new"), F.lit(False)), "settled")
        .when((suggested != "") & ~F.col("model_called") & (F.col("source") == "cached"), "cached")
        .when(suggested != "", "generated")
        .when(current != "", "preserved")
        .otherwise("missing")
    )
    return df.withColumns(
        {
            "settled_alt": F.coalesce(F.nullif(suggested, F.lit("")), current),
            "settled_reason": reason,
            "outcome": outcome,
        }
    )


def write_plan(existing: ColumnLike, generated: ColumnLike, final: ColumnLike, mode: str = "preserve") -> Column:
    """Text to stand, the decision, and whether it has to be written.

    ``overwrite`` and any unknown mode behave as ``replace``.
    """
    texts = F.struct(*[F.coalesce(strip(c), F.lit("")).alias(n) for n, c in (("e", existing), ("g", generated), ("f", final))])

    def plan(t: Column) -> Column:
        e, g, f = t["e"], t["g"], t["f"]
        if mode.lower() == "preserve":
            decision = (
                F.when(f != "", "written_final").when(e != "", "preserved_existing").when(g != "", "written_generated")
                .otherwise("skipped_no_content")
            )
            text = F.when(f != "", f).when(e != "", e).otherwise(g)
        else:
            decision = (
                F.when((f != "") & (f != g), "written_final").when((f != "") | (g != ""), "written_generated")
                .when(e != "", "written_existing").otherwise("skipped_no_content")
            )
            text = F.when(f != "", f).when(g != "", g).otherwise(e)
        return let(
            decision,
            lambda d: F.struct(
                F.nullif(text, F.lit("")).alias("final_alt"),
                d.alias("decision"),
                d.isin("written_final", "written_generated").alias("should_write"),
            ),
        )

    return let(texts, plan)


def should_inject(existing: ColumnLike, mode: str = "preserve") -> Column:
    """Whether a new text replaces the one in place, and the rule that says so."""
    t = strip(F.coalesce(col(existing), F.lit("")))
    cases = [(t == "", "no_existing"), (is_skip_value(existing), "skippable")]
    if mode == "overwrite":
        cases.append((F.lit(True), "overwrite"))
    elif mode == "preserve":
        cases += [
            (F.lower(t).isin(rules.DECORATIVE_TEXTS), "decorative_text"),
            (has_any(F.lower(t), rules.INJECT_FAILURES), "failure_text"),
            (F.length(t) > 10, "keep"),
            (F.lit(True), "too_short"),
        ]
    else:
        cases.append((F.lit(True), "unknown_mode"))
    return let(first_rule(*cases), lambda r: F.struct((r != "keep").alias("inject"), r.alias("reason")))


def fallback_policy(
    generated: ColumnLike, failure: ColumnLike, existing: ColumnLike, shape_type: ColumnLike, name: ColumnLike,
    w: ColumnLike, h: ColumnLike, policy: str = "none",
) -> Column:
    """What is written and reviewed where generation failed.

    ``failure`` is null for a success.
    """
    ok, made = col(failure).isNull(), col(generated)
    spare = stub(shape_type, w, h)

    def outcome(write: Column | None, review: Column, status: str, method: str) -> Column:
        return F.struct(
            (F.lit(None).cast("string") if write is None else write).alias("write_text"),
            review.alias("review_text"), F.lit(status).alias("status"), F.lit(method).alias("method"),
        )

    nothing = F.lit("")
    if policy == "none":
        failed = outcome(None, nothing, "NEEDS ALT", "none_policy")
    elif policy == "doc-only":
        failed = outcome(None, F.concat(F.lit("FALLBACK: "), spare), "AUTO-LOWCONF", "doc_only_policy")
    elif policy == "ppt-gated":
        allowed = passes_gate(spare) & is_blank(existing) & ~stub_decorative(name, w, h)
        failed = F.when(allowed, outcome(spare, spare, "FALLBACK_INJECTED", "ppt_gated_policy")).otherwise(
            outcome(None, nothing, "NEEDS ALT", "ppt_gated_rejected")
        )
    else:
        failed = outcome(None, nothing, "NEEDS ALT", "error")
    return F.when(ok, outcome(made, made, "generated", "ai_generation")).otherwise(failed)
