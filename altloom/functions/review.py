"""Columns of the review table and the choice among stored texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from altloom.functions import fixed
from altloom.functions.base import ColumnLike, col, has_any, strip
from altloom.functions.gates import is_meaningful

# Labels shown to reviewers.
STATUS_LABELS = {
    "preserve_existing": "Preserve existing",
    "use_generated": "Use generated",
    "no_alt_available": "No ALT available",
    "flag_for_review": "Needs review",
    "needs_review": "Needs review",
    "custom_alt": "Custom ALT",
    "manual_update": "Manual update",
    "mark_decorative": "Decorative",
    "decorative": "Decorative",
}
TYPE_LABELS = {
    "PICTURE": "Image",
    "AUTO_SHAPE": "PowerPoint shape",
    "TEXT_BOX": "Text box",
    "LINE": "Line",
    "CONNECTOR": "Connector line",
    "TABLE": "Table",
    "GROUP": "Group parent",
}
KEEP_HINT = "(Leave blank to keep current, or type replacement)"
NO_ALT = "[No ALT text]"
NO_SUGGESTION = "[No suggestion]"
GENERIC_PHRASES = ["this is a powerpoint shape", "image of", "picture", "graphic", "unknown"]


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def text_or_blank(c: ColumnLike) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def text_or_null(c: ColumnLike) -> Column:
    return F.nullif(strip(c), F.lit(""))


def source_or(c: ColumnLike, default: str) -> Column:
    return F.coalesce(text_or_null(c), F.lit(default))


def existing_alt(descr: ColumnLike, title: ColumnLike, child_alt: ColumnLike) -> Column:
    """Description, else title, else the first child's text."""
    return F.coalesce(text_or_null(descr), text_or_null(title), text_or_null(child_alt), F.lit(""))


def existing_alt_source(descr: ColumnLike, title: ColumnLike, child_alt: ColumnLike) -> Column:
    return (
        F.when(text_or_null(descr).isNotNull(), "descr")
        .when(text_or_null(title).isNotNull(), "title")
        .when(text_or_null(child_alt).isNotNull(), "group_child")
        .otherwise("none")
    )


def choose_candidate(final: ColumnLike, generated: ColumnLike, existing: ColumnLike) -> Column:
    """The first meaningful text, else whatever the final text holds."""
    return F.coalesce(
        *[F.when(is_meaningful(c), strip(c)) for c in (final, generated, existing)], text_or_null(final)
    )


def suggested_alt(final: ColumnLike, generated: ColumnLike) -> Column:
    return F.coalesce(text_or_null(final), text_or_null(generated), F.lit(""))


def generated_for_review(
    generated: ColumnLike, seen_generated: ColumnLike, final: ColumnLike, current: ColumnLike
) -> Column:
    final_text = text_or_null(final)
    return F.coalesce(
        text_or_null(generated),
        text_or_null(seen_generated),
        F.when(final_text != F.coalesce(col(current), F.lit("")), final_text),
        F.lit(""),
    )


def type_label(shape_type: ColumnLike, in_group: Column) -> Column:
    plain = F.initcap(F.replace(col(shape_type), F.lit("_"), F.lit(" ")))
    return F.concat(
        F.when(in_group, "Group child: ").otherwise(""), F.coalesce(lookup(TYPE_LABELS, col(shape_type)), plain)
    )


def current_cell(existing: ColumnLike, current: ColumnLike, final: ColumnLike, reason: ColumnLike) -> Column:
    """What the review shows as the current text."""
    shown = F.coalesce(
        F.nullif(col(existing), F.lit("")),
        F.nullif(col(current), F.lit("")),
        F.when(col(reason) == "preserved", col(final)),
    )
    return F.coalesce(text_or_null(shown), F.lit(NO_ALT))


def suggested_cell(final: ColumnLike, reason: ColumnLike) -> Column:
    """What the review suggests, by the reason of the decision."""
    text = F.nullif(col(final), F.lit(""))
    return (
        F.when(col(reason) == "preserve_existing", KEEP_HINT)
        .when(col(reason).isin("generated_new", "cached"), F.coalesce(text, F.lit("[Generation failed]")))
        .when(col(reason) == "needs_generation", "[Generate needed]")
        .when(col(reason).isin("policy_excluded", "generation_error"), "[Excluded]")
        .otherwise(F.coalesce(text, F.lit("[No suggested ALT]")))
    )


def status_label(decision: ColumnLike, final: ColumnLike, generated: ColumnLike, current: ColumnLike) -> Column:
    """Label of a decision, or one worked out from the texts."""
    made, kept = text_or_blank(generated), text_or_blank(current)
    given, final_text = text_or_null(decision), text_or_null(final)
    spelled = F.initcap(strip(F.replace(given, F.lit("_"), F.lit(" "))))
    return (
        F.when(given.isNotNull(), F.coalesce(lookup(STATUS_LABELS, F.lower(given)), spelled))
        .when((made != "") & (final_text == made), STATUS_LABELS["use_generated"])
        .when((kept != "") & (final_text == kept), STATUS_LABELS["preserve_existing"])
        .when(final_text.isNotNull(), STATUS_LABELS["custom_alt"])
        .when((made != "") & (kept != ""), "Existing + Generated")
        .when(made != "", "Generated available")
        .when(kept != "", "Existing only")
        .otherwise(STATUS_LABELS["no_alt_available"])
    )


def status_display(status: ColumnLike, reason: ColumnLike) -> Column:
    """Status of a fallback, with its reason in brackets."""
    s, why = col(status), text_or_null(reason)

    def with_reason(label: str, bare: str) -> Column:
        return F.coalesce(F.concat(F.lit(f"{label} ("), why, F.lit(")")), F.lit(bare))

    return (
        F.when(s == "generated", "Generated")
        .when(s == "preserved", "Preserved")
        .when(s.startswith("NEEDS ALT"), with_reason("Needs ALT", "Needs ALT"))
        .when(s.startswith("AUTO-LOWCONF"), with_reason("Auto Low-Conf", "Auto Low-Confidence"))
        .when(s == "FALLBACK_INJECTED", "Fallback Injected")
        .otherwise(s)
    )


def derive_status(current: ColumnLike, suggested: ColumnLike, decorative: Column) -> Column:
    """Status and its label, from what the report shows."""
    cur, sug = col(current), col(suggested)
    has_current = cur != NO_ALT
    has_suggested = ~sug.isin(NO_SUGGESTION, NO_ALT, "")
    status = (
        F.when(decorative, "decorative_skipped")
        .when(has_current & has_any(F.lower(cur), GENERIC_PHRASES), "fallback_injected")
        .when(has_current & has_suggested & (cur == sug), "generated")
        .when(has_current, "preserved")
        .otherwise("needs_alt")
    )
    label = (
        F.when(status == "decorative_skipped", "Decorative")
        .when(status == "fallback_injected", "Fallback (PPT-gated)")
        .when(status == "generated", "Generated")
        .when(status == "preserved", "Preserved")
        .when(has_suggested & sug.startswith("FALLBACK:"), "Fallback (doc-only)")
        .otherwise("Needs ALT")
    )
    return F.struct(status.alias("status"), label.alias("label"))


def review_bucket(current: ColumnLike, suggested: ColumnLike, decorative: Column) -> Column:
    cur, sug = col(current), col(suggested)
    return (
        F.when(decorative, "decorative")
        .when((cur != NO_ALT) & ~sug.isin(NO_SUGGESTION, NO_ALT, "") & (cur == sug), "generated")
        .when(cur != NO_ALT, "preserved")
        .when(sug.startswith("FALLBACK:"), "fallback_injected")
        .otherwise("needs_alt")
    )


def report_decision(current: ColumnLike, suggested: ColumnLike) -> Column:
    """Preserved, Generated, Replaced or Pending, from the shown texts."""
    cur, sug = col(current), col(suggested)
    return (
        F.when((cur != NO_ALT) & (cur == sug), "Preserved")
        .when((cur == NO_ALT) & (sug != NO_SUGGESTION), "Generated")
        .when((cur != NO_ALT) & (sug != NO_SUGGESTION), "Replaced")
        .otherwise("Pending")
    )


def notes_text(
    source_existing: ColumnLike, source_generated: ColumnLike, notes: ColumnLike, provenance: ColumnLike,
    seen_provenance: ColumnLike,
) -> Column:
    """Provenance as one line; ``provenance`` is a map of label to text."""
    labelled = F.transform(
        F.map_entries(col(provenance)),
        lambda e: F.concat(F.coalesce(text_or_null(e["key"]), F.lit("Provenance")), F.lit(": "), text_or_null(e["value"])),
    )
    parts = F.concat(
        F.array(
            F.concat(F.lit("Existing: "), text_or_null(source_existing)),
            F.concat(F.lit("Generated: "), text_or_null(source_generated)),
            text_or_null(notes),
        ),
        F.coalesce(labelled, F.array().cast("array<string>")),
        F.array(text_or_null(seen_provenance)),
    )
    return F.array_join(F.array_compact(parts), " • ")


def failure_class(code: ColumnLike, message: ColumnLike) -> Column:
    """Permanent failures are not worth a retry; all others are."""
    permanent = col(code).isin(fixed.PERMANENT_CODES) | has_any(F.lower(col(message)), fixed.PERMANENT_TEXTS)
    return F.when(F.coalesce(permanent, F.lit(False)), "permanent").otherwise("temporary")


def backoff(failures: ColumnLike, longest: int = 60) -> Column:
    """Seconds to wait after the n-th failure in a row."""
    return F.least(F.pow(F.lit(2.0), F.least(col(failures) - 1, F.lit(30))), F.lit(float(longest))).cast("int")


def retry_delay(attempt: ColumnLike, base: float = 1.0, growth: float = 2.0, longest: float = 60.0) -> Column:
    """Seconds before a retry; jitter is left to the caller."""
    return F.when(col(attempt) <= 0, 0.0).otherwise(
        F.least(F.lit(base) * F.pow(F.lit(growth), col(attempt) - 1), F.lit(longest))
    )
