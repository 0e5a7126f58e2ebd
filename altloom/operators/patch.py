"""Changes as tables: what to write, the written table, flags and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altloom.functions import fixed
from altloom.functions.base import is_blank, strip
from altloom.functions.gates import is_meaningful, needs_replace, write_gate
from altloom.functions.keys import text_hash
from altloom.functions.text import finalize_alt, normal_form_exceeds, normalize_universal
from altloom.operators.joins import KEY


def ready_texts(plan: DataFrame, policy: str = "none") -> DataFrame:
    """The planned texts that pass the gate, in the form they are written in, with their hashes.

    ``plan``: deck, key, text, kind, is_generated, is_fallback, forced (a stored final
    text may replace an existing one even in preserve mode); other columns stay. What is
    compared more than once is best written out: the form is the costly part of a patch.
    """
    form = finalize_alt(normalize_universal("text"))
    if policy == "none":
        # This gate stops long texts, and most of them are known to be long before their form is worked out.
        form = F.when(~normal_form_exceeds("text", fixed.LENIENT_LIMIT), form)
    gate = write_gate(form, "kind", F.col("is_generated"), F.col("is_fallback"), policy)
    kept = [c for c in plan.columns if c not in ("text", "kind", "is_generated", "is_fallback")]
    # Exploding what the gate lets through drops the nulls and, unlike a filter,
    # does not make Spark work the text out twice.
    gated = plan.select(*kept, F.explode(F.array_compact(F.array(gate))).alias("new_alt"))
    return gated.withColumn("text_hash", text_hash("new_alt"))


def changes(ready: DataFrame, current: DataFrame, written: DataFrame, mode: str = "preserve") -> DataFrame:
    """Of the ready texts those that differ from what stands and are not yet written.

    ``current``: deck, key, text. ``written``: deck, key, text_hash of earlier runs. A second run is empty.
    """
    new = ready.select(*KEY, "forced", "new_alt", "text_hash").join(written, [*KEY, "text_hash"], "left_anti")
    compared = new.join(current.select(*KEY, F.col("text").alias("old_alt")), KEY, "left")
    guarded = is_meaningful("old_alt") & ~F.col("forced") if mode == "preserve" else F.lit(False)
    changed = compared.filter(~guarded).filter(needs_replace("old_alt", "new_alt", normal=True))
    return changed.select(
        *KEY, "old_alt", "new_alt", F.when(is_blank("old_alt"), "insert").otherwise("replace").alias("change"), "text_hash"
    )


def patch(plan: DataFrame, current: DataFrame, written: DataFrame, mode: str = "preserve", policy: str = "none") -> DataFrame:
    """Rows to write: gated, different from what stands, and not yet written."""
    return changes(ready_texts(plan, policy), current, written, mode)


def apply_patch(elements: DataFrame, patched: DataFrame) -> DataFrame:
    """Elements with the patched texts, and what happened to each."""
    joined = elements.join(patched.select(*KEY, "new_alt", "change"), KEY, "left")
    return joined.select(
        *[F.coalesce("new_alt", "existing_alt").alias("existing_alt") if c == "existing_alt" else F.col(c) for c in elements.columns],
        F.when(F.col("change").isNotNull(), F.col("change"))
        .when(is_meaningful("existing_alt"), "preserved")
        .otherwise("skipped")
        .alias("outcome"),
    )


def dedupe_titles(df: DataFrame) -> DataFrame:
    """Clear titles that only repeat the description."""
    same = (strip("descr") != "") & (strip("descr") == strip("title"))
    return df.withColumn("title", F.when(same, "").otherwise(F.col("title")))


def mark_decorative(elements: DataFrame, flags: DataFrame, key: list[str]) -> DataFrame:
    """Set the decorative flag of the listed elements and clear their text."""
    listed = flags.select(*key).distinct().withColumn("__listed", F.lit(True))
    on = F.coalesce("__listed", F.lit(False))
    return (
        elements.join(listed, key, "left")
        .withColumns({"decorative": on, "existing_alt": F.when(on, "").otherwise(F.col("existing_alt"))})
        .drop("__listed")
    )
