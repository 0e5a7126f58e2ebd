"""Counts, rates and reports. All are map-side combined aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altloom.functions.base import is_blank, strip
from altloom.functions.review import review_bucket
from altloom.operators.ordered import MONEY, top_per
from altloom.operators.prefix import with_running
from altloom.session import materialize


def n() -> Column:
    return F.count(F.lit(1))


def count_where(condition: Column | str) -> Column:
    return F.count_if(condition)


def percent(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.when(whole > 0, part * 100 / whole).otherwise(0.0), digits)


def exact_sum(name: str) -> Column:
    """Sum of money or seconds that does not depend on row order."""
    return F.coalesce(F.sum(F.col(name).cast(MONEY)).cast("double"), F.lit(0.0))


def manifest_stats(df: DataFrame) -> DataFrame:
    source = F.col("source")
    return df.agg(
        n().alias("total_entries"),
        count_where(~is_blank("existing_alt")).alias("with_current_alt"),
        count_where(~is_blank("suggested_alt")).alias("with_suggested_alt"),
        *[count_where(source == s).alias(f"source_{s}") for s in ("existing", "generated", "cached", "shape_fallback", "excluded")],
        count_where("model_called").alias("calls_made"),
    )


def skip_reason(called: Column, reason: Column) -> Column:
    """Why the model was not called; null where it was."""
    return (
        F.when(called, None)
        .when(reason == "preserve_existing", "preserved_existing_alt")
        .when(reason == "cached", "cache_hit")
        .when(reason.isin("policy_excluded", "generation_error"), reason)
        .otherwise("other")
    )


def telemetry(df: DataFrame) -> DataFrame:
    """Calls made and avoided, hit rates and failures per deck and in total."""
    called, reason = F.col("model_called"), F.col("decision_reason")
    avoided = ~called & reason.isin("preserve_existing", "cached")
    hits = ~called & (reason == "cached")
    return df.rollup("deck").agg(
        n().alias("total_elements"),
        count_where(called).alias("calls_made"),
        count_where(avoided).alias("calls_avoided"),
        count_where(hits).alias("cache_hits"),
        count_where(~called).alias("skipped"),
        percent(count_where(hits), n(), 1).alias("cache_hit_percent"),
        percent(count_where(avoided), n(), 1).alias("avoidance_percent"),
        count_where(F.col("raster_status") == "error").alias("raster_failures"),
    )


def distribution(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Counts of the values of several columns in one pass, as (kind, value)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in columns.items()])
    flat = df.select(F.explode(pairs).alias("p")).select("p.kind", "p.value").filter("value IS NOT NULL")
    return flat.groupBy("kind", "value").agg(n().alias("elements"))


def coverage(df: DataFrame) -> DataFrame:
    """Coverage of every deck from the outcome of its elements."""
    outcome = F.col("outcome")
    preserved, generated = count_where(outcome == "preserved"), count_where(outcome == "generated")
    needs = count_where(outcome.isin("failed", "invalid"))
    decorative = count_where(outcome == "decorative")
    return df.groupBy("deck").agg(
        n().alias("total_elements"),
        preserved.alias("preserved"),
        generated.alias("generated"),
        needs.alias("needs_alt"),
        decorative.alias("decorative_skipped"),
        (preserved + generated).alias("covered_elements"),
        percent(preserved + generated, n()).alias("coverage_percent"),
        percent(generated, n()).alias("descriptive_percent"),
        percent(decorative, n()).alias("decorative_percent"),
    )


def batch_coverage(df: DataFrame) -> DataFrame:
    """Coverage of each deck and, with a null deck, of the batch."""
    outcome = F.col("outcome")
    descriptive, decorative = count_where(outcome == "generated"), count_where(outcome == "decorative")
    return df.rollup("deck").agg(
        n().alias("total_images"),
        descriptive.alias("descriptive_images"),
        decorative.alias("decorative_images"),
        count_where(outcome.isin("failed", "invalid")).alias("failed_images"),
        percent(descriptive, n()).alias("descriptive_percent"),
        percent(decorative, n()).alias("decorative_percent"),
        percent(descriptive + decorative, n()).alias("total_percent"),
    )


STATUSES = ("pending", "processing", "complete", "failed", "skipped")


def ledger_stats(ledger: DataFrame) -> DataFrame:
    counts = {s: count_where(F.col("status") == s) for s in STATUSES}
    return ledger.agg(
        n().alias("total"),
        *[c.alias(s) for s, c in counts.items()],
        (counts["complete"] + counts["failed"] + counts["skipped"]).alias("finished"),
        percent(counts["complete"], n()).alias("success_rate"),
        percent(counts["failed"], n()).alias("failure_rate"),
        (F.unix_timestamp(F.max("added_at")) - F.unix_timestamp(F.min("added_at"))).alias("duration_seconds"),
        (counts["pending"] + counts["processing"] == 0).alias("is_complete"),
    )


def over_threshold(ledger: DataFrame, threshold: float = 0.5) -> DataFrame:
    rate = F.when(n() > 0, count_where(F.col("status") == "failed") / n()).otherwise(0.0)
    return ledger.agg(F.round(rate, 6).alias("failure_rate"), (rate > threshold).alias("stop"))


def write_stats(plan: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Writes by decision and the older counters derived from them."""
    decision = F.col("decision")
    names = ("preserved_existing", "written_generated", "written_existing", "written_final")
    done = {name: count_where(decision == name) for name in names}
    invalid = count_where(decision == "skipped_no_content")
    total = sum((c for c in done.values()), F.lit(0))
    return plan.groupBy(*keys).agg(
        *[c.alias(name) for name, c in done.items()],
        total.alias("injected_successfully"),
        invalid.alias("validation_failures"),
    )


def injectable(df: DataFrame) -> DataFrame:
    """Injectable and missing, by type, by reason and in total."""
    has_alt = ~is_blank("final_alt") | ~is_blank("suggested_alt") | ~is_blank("existing_alt")
    marked = df.withColumn("__has", has_alt)
    return marked.groupingSets(
        [[F.col("shape_type")], [F.col("decision_reason")], []], "shape_type", "decision_reason"
    ).agg(
        F.grouping_id().cast("bigint").alias("level"),
        n().alias("entries"),
        count_where("__has").alias("injectable"),
        count_where(~F.col("__has")).alias("missing"),
    )


def shape_counts(df: DataFrame) -> DataFrame:
    """Shapes and shapes with content, per deck and type."""
    worded = F.length(F.coalesce(strip("text"), F.lit(""))) > 2
    return df.groupBy("deck").agg(
        n().alias("shapes"),
        count_where(worded).alias("with_content"),
        *[count_where(F.col("shape_type") == t).alias(t.lower()) for t in ("PICTURE", "GROUP", "TEXT_BOX", "LINE")],
    )


def document_stats(df: DataFrame) -> DataFrame:
    """Per document: with text, decorative, coverage, calls, distinct images."""
    covered = ~is_blank("existing_alt") | F.col("decorative")
    images = df.groupBy("deck", "image_hash").agg(
        n().alias("__n"), count_where(~is_blank("existing_alt")).alias("__alt"),
        count_where("decorative").alias("__deco"), count_where(covered).alias("__covered"),
        count_where("model_called").alias("__calls"),
    )
    total = F.sum("__n")
    return images.groupBy("deck").agg(
        total.alias("total"),
        F.sum("__alt").alias("with_alt"),
        F.sum("__deco").alias("decorative"),
        F.round(F.when(total > 0, F.sum("__covered") / total).otherwise(1.0), 6).alias("coverage"),
        F.sum("__calls").alias("calls"),
        F.count("image_hash").alias("unique_images"),
    )


def usage(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("provider").agg(
        n().alias("requests"),
        count_where("success").alias("successes"),
        F.round(exact_sum("cost"), 6).alias("total_cost"),
        F.sum("tokens").alias("tokens"),
        F.round(exact_sum("seconds") / n(), 6).alias("avg_response_time"),
    )


def performance(attempts: DataFrame) -> DataFrame:
    used = usage(attempts)
    return used.select(
        "provider",
        F.round(F.col("successes") / F.col("requests"), 6).alias("success_rate"),
        F.round(F.when(F.col("total_cost") > 0, F.col("total_cost") / F.col("requests")).otherwise(0.0), 6).alias("avg_cost"),
        "requests", "total_cost", "avg_response_time",
    )


def budget(attempts: DataFrame, daily: float, total: float) -> DataFrame:
    """Cost by day and so far, with alerts. The window runs over days only."""
    by_day = attempts.groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.col("cost").cast(MONEY)).alias("cost"))
    so_far = F.sum("cost").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return by_day.select("day", F.col("cost").cast("double").alias("daily_cost"), so_far.cast("double").alias("total_cost")).select(
        "day", F.round("daily_cost", 6).alias("daily_cost"), F.round("total_cost", 6).alias("total_cost"),
        (F.col("daily_cost") > daily).alias("daily_alert"), (F.col("total_cost") > total).alias("total_alert"),
    )


def error_summary(errors: DataFrame) -> DataFrame:
    """Errors by category; needs category, recoverable, hint."""
    return errors.groupBy("category").agg(
        n().alias("errors"), count_where("recoverable").alias("recoverable"), F.bool_or(F.col("hint").isNotNull()).alias("has_hints")
    )


def recovery_stats(recoveries: DataFrame) -> DataFrame:
    """Use and share of every strategy by category; all three totals come from one grouping."""
    sums = materialize(
        recoveries.groupingSets([["strategy", "category"], ["strategy"], []], "strategy", "category")
        .agg(n().alias("uses"), F.grouping_id().alias("level"))
    )
    whole = sums.filter("level = 3").select(F.col("uses").alias("__whole"))
    of_strategy = sums.filter("level = 1").select("strategy", F.col("uses").alias("__strategy"))
    parts = sums.filter("level = 0").join(of_strategy, "strategy").join(F.broadcast(whole))  # the whole is one row
    return parts.select(
        "strategy", "category", "uses", F.round(F.col("uses") / F.col("__whole"), 6).alias("share"),
        F.round(F.col("__strategy") / F.col("__whole"), 6).alias("strategy_share"),
    )


def artifact_usage(files: DataFrame, now: Column) -> DataFrame:
    """Files and bytes by age."""
    days = (F.unix_timestamp(now) - F.unix_timestamp("added_at")) / 86400
    bucket = F.when(days < 1, "less_than_1_day").when(days < 7, "1_to_7_days").otherwise("more_than_7_days")
    return files.groupBy(bucket.alias("age")).agg(n().alias("files"), F.round(exact_sum("bytes"), 2).alias("bytes"))


def usage_warning(files: DataFrame, limit_bytes: float) -> DataFrame:
    return files.agg(F.round(exact_sum("bytes"), 2).alias("bytes"), (exact_sum("bytes") > limit_bytes).alias("warn"))


def expired(files: DataFrame, now: Column, days: int) -> DataFrame:
    """What a clean-up would remove, with age, size and the totals beside it; nothing is deleted."""
    age = F.unix_timestamp(now) - F.unix_timestamp("added_at")
    old = files.filter(age > days * 86400).select("path", F.floor(age / 86400).alias("age_days"), "bytes")
    totals = old.agg(n().alias("expired_files"), F.round(exact_sum("bytes"), 2).alias("expired_bytes"))
    return old.join(F.broadcast(totals))  # the totals are one row


def batch_report(results: DataFrame) -> DataFrame:
    """Per status: files, bytes and mean; time counts processed files only."""
    done = F.col("status") == "complete"
    seconds = F.when(done, F.col("bytes").cast(MONEY))
    return results.rollup("status").agg(
        n().alias("files"), count_where(done).alias("processed"), F.round(exact_sum("bytes"), 2).alias("bytes"),
        F.round(F.sum(seconds).cast("double") / F.count(seconds), 6).alias("avg_processed"),
    )


def selector_metrics(records: DataFrame) -> DataFrame:
    share = {
        "unknown_rate": F.col("reason_code").startswith("ambiguous_"),
        "overlay_rate": F.col("has_overlay"),
        "override_rate": F.col("overridden"),
    }
    return records.rollup("selector_decision", "escalation_strategy").agg(
        n().alias("records"), *[F.round(F.avg(c.cast("double")), 6).alias(k) for k, c in share.items()]
    )


def slide_text(df: DataFrame, keys: Sequence[str], order: str, limit: int = 500) -> DataFrame:
    """Texts of a group in order, cut at ``limit``; its title is the first text.

    Only texts that start within the limit or right behind it are collected,
    which is at most ``limit`` of them, whatever the size of the group. The
    blank before one that starts right behind still belongs to the cut.
    """
    worded = df.filter(~is_blank("text")).select(*keys, order, strip("text").alias("text"))
    size = (F.length("text") + 1).cast("bigint")
    placed = with_running(worded, keys, [order], {"__end": ("sum", size)})
    starting = placed.filter(F.col("__end") - F.length("text") - 1 <= limit)
    pieces = F.array_sort(F.collect_list(F.struct(order, F.left("text", F.lit(limit)).alias("text"))))
    joined = F.array_join(F.transform(pieces, lambda p: p["text"]), " ")
    return starting.groupBy(*keys).agg(
        F.left(joined, F.lit(limit)).alias("slide_text"), F.min_by("text", order).alias("title")
    )


def audit_summary(df: DataFrame) -> DataFrame:
    missing = is_blank("existing_alt") & ~F.col("decorative")
    return df.rollup("deck").agg(
        n().alias("total"), count_where("decorative").alias("decorative"), count_where(missing).alias("missing")
    )


def review_summary(df: DataFrame) -> DataFrame:
    reason = F.col("decision_reason")
    return df.groupBy("deck").agg(
        n().alias("entries"),
        count_where(reason == "preserve_existing").alias("preserved"),
        count_where(reason.isin("generated_new", "cached", "needs_generation")).alias("generated"),
        count_where(reason.isin("policy_excluded", "generation_error")).alias("excluded"),
    )


def by_slide(df: DataFrame) -> DataFrame:
    """The entries of every slide, by position; a slide bounds the list."""
    fields = ["shape_idx", *[c for c in df.columns if c not in ("deck", "slide_idx", "shape_idx")]]
    return df.groupBy("deck", "slide_idx").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))


def failures(df: DataFrame, keep: int, context_chars: int = 100) -> DataFrame:
    """First failed generations of every deck with a start of their context."""
    failed = top_per(df.filter("failed"), ["deck"], ["slide_idx", "shape_idx"], keep)
    rows = F.array_sort(F.collect_list(F.struct("n", "instance_key", F.left("slide_text", F.lit(context_chars)).alias("context"))))
    return failed.groupBy("deck").agg(
        F.array_join(F.transform(rows, lambda r: F.concat_ws(": ", r["instance_key"], r["context"])), " | ").alias("failures")
    )


def review_buckets(rows: DataFrame, current: str, suggested: str, decorative: Column) -> DataFrame:
    bucket = review_bucket(current, suggested, decorative)
    no_text = "[No ALT text]"
    return rows.groupBy(bucket.alias("bucket")).agg(
        n().alias("elements"),
        count_where((F.col(current) != no_text) & (F.col(suggested) != no_text) & (F.col(current) == F.col(suggested))).alias("identical"),
        count_where(F.col(current) == no_text).alias("missing_current"),
    )


def plan_summary(decided: DataFrame) -> DataFrame:
    """What a run would do, without calling the model."""
    return decided.groupBy("action", "decision_reason").agg(
        n().alias("elements"), F.count_distinct("content_key").alias("contents")
    )
