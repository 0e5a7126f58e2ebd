"""Counts, rates and reports over elements, work items and provider calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from altloom import views
from altloom.functions import fixed
from altloom.functions.review import failure_class
from altloom.operators import aggregates as agg
from altloom.operators import classify, reuse
from altloom.plans import sql as q
from altloom.plans.decisions import DECIDED_SQL, ENTRY_DECORATIVE, decided_narrow
from altloom.plans.describe_queries import SHOWN, shown
from altloom.plans.ordered_queries import SELECTED_SQL, selected
from altloom.plans.registry import query

ELEMENTS = views.ELEMENTS_SQL
# The test clock of the age reports; the newest work items are from 2000.
NOW = "1998-06-15 12:00:00"


def manifest(spark, sf_dir):
    d = decided_narrow(spark, sf_dir)
    return d.select(
        "*", F.col("generated_alt").alias("suggested_alt"), F.col("decision_source").alias("source"),
        F.when(F.col("height") % 9 == 0, "error").otherwise("success").alias("raster_status"),
    )


MANIFEST_SQL = f"""{DECIDED_SQL}, manifest AS (SELECT *, CASE decision_reason WHEN 'preserve_existing' THEN 'existing' WHEN 'policy_excluded' THEN 'excluded' WHEN 'needs_generation' THEN 'generated' ELSE 'cached' END AS source,
   CASE WHEN height % 9 = 0 THEN 'error' ELSE 'success' END AS raster_status FROM decided)"""


@query(
    "manifest_stats_e01",
    f"""WITH {MANIFEST_SQL} SELECT count(*) AS total_entries, count_if(trim(existing_alt) <> '') AS with_current_alt, count_if(trim(generated_alt) <> '') AS with_suggested_alt,
  count_if(source = 'existing') AS source_existing, count_if(source = 'generated') AS source_generated, count_if(source = 'cached') AS source_cached, 0 AS source_shape_fallback,
  count_if(source = 'excluded') AS source_excluded, count_if(model_called) AS calls_made FROM manifest""",
)
def manifest_stats(spark, sf_dir):
    return agg.manifest_stats(manifest(spark, sf_dir))


@query(
    "telemetry_e02",
    f"""WITH {MANIFEST_SQL}, m AS (SELECT *, NOT model_called AND decision_reason IN ('preserve_existing', 'cached') AS avoided, NOT model_called AND decision_reason = 'cached' AS hit FROM manifest)
SELECT deck, count(*) AS total_elements, count_if(model_called) AS calls_made, count_if(avoided) AS calls_avoided, count_if(hit) AS cache_hits, count_if(NOT model_called) AS skipped,
  round(count_if(hit) * 100 / count(*), 1) AS cache_hit_percent, round(count_if(avoided) * 100 / count(*), 1) AS avoidance_percent, count_if(raster_status = 'error') AS raster_failures FROM m GROUP BY ROLLUP (deck)""",
)
def telemetry(spark, sf_dir):
    return agg.telemetry(manifest(spark, sf_dir))


@query(
    "telemetry_distribution_e02",
    f"""WITH {MANIFEST_SQL}, p AS (SELECT 'decision' AS kind, decision_reason AS value FROM manifest UNION ALL SELECT 'shape_type', shape_type FROM manifest UNION ALL SELECT 'skip_reason',
   CASE WHEN model_called THEN NULL WHEN decision_reason = 'preserve_existing' THEN 'preserved_existing_alt' WHEN decision_reason = 'cached' THEN 'cache_hit' WHEN decision_reason = 'policy_excluded' THEN decision_reason ELSE 'other' END FROM manifest)
SELECT kind, value, count(*) AS elements FROM p WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def telemetry_distribution(spark, sf_dir):
    m = manifest(spark, sf_dir)
    reason = agg.skip_reason(F.col("model_called"), F.col("decision_reason"))
    return agg.distribution(m, {"decision": F.col("decision_reason"), "shape_type": F.col("shape_type"), "skip_reason": reason})


def outcomes(spark, sf_dir):
    e = views.elements(spark, sf_dir)
    outcome = (
        F.when(F.col("shape_type").isin("LINE", "CONNECTOR"), "decorative").when(F.col("existing_alt") != "", "preserved")
        .when(F.col("generated_alt").startswith("Error"), "invalid").when(F.col("generated_alt") != "", "generated").otherwise("failed")
    )
    return e.select("deck", outcome.alias("outcome"))


OUTCOMES_SQL = f"""{ELEMENTS}, o AS (SELECT deck, CASE WHEN shape_type IN ('LINE', 'CONNECTOR') THEN 'decorative' WHEN existing_alt <> '' THEN 'preserved' WHEN starts_with(generated_alt, 'Error') THEN 'invalid'
   WHEN generated_alt <> '' THEN 'generated' ELSE 'failed' END AS outcome FROM elements)"""


@query(
    "coverage_e03",
    f"""WITH {OUTCOMES_SQL} SELECT deck, count(*) AS total_elements, count_if(outcome = 'preserved') AS preserved, count_if(outcome = 'generated') AS generated, count_if(outcome IN ('failed', 'invalid')) AS needs_alt,
  count_if(outcome = 'decorative') AS decorative_skipped, count_if(outcome IN ('preserved', 'generated')) AS covered_elements, round(count_if(outcome IN ('preserved', 'generated')) * 100 / count(*), 6) AS coverage_percent,
  round(count_if(outcome = 'generated') * 100 / count(*), 6) AS descriptive_percent, round(count_if(outcome = 'decorative') * 100 / count(*), 6) AS decorative_percent FROM o GROUP BY deck""",
)
def coverage(spark, sf_dir):
    return agg.coverage(outcomes(spark, sf_dir))


@query(
    "batch_coverage_e04",
    f"""WITH {OUTCOMES_SQL} SELECT deck, count(*) AS total_images, count_if(outcome = 'generated') AS descriptive_images, count_if(outcome = 'decorative') AS decorative_images, count_if(outcome IN ('failed', 'invalid')) AS failed_images,
  round(count_if(outcome = 'generated') * 100 / count(*), 6) AS descriptive_percent, round(count_if(outcome = 'decorative') * 100 / count(*), 6) AS decorative_percent,
  round(count_if(outcome IN ('generated', 'decorative')) * 100 / count(*), 6) AS total_percent FROM o GROUP BY ROLLUP (deck)""",
)
def batch_coverage(spark, sf_dir):
    return agg.batch_coverage(outcomes(spark, sf_dir))


@query(
    "ledger_stats_e05",
    f"""WITH {views.LEDGER_SQL} SELECT count(*) AS total, count_if(status = 'pending') AS pending, count_if(status = 'processing') AS processing, count_if(status = 'complete') AS complete, count_if(status = 'failed') AS failed,
  count_if(status = 'skipped') AS skipped, count_if(status IN ('complete', 'failed', 'skipped')) AS finished, round(count_if(status = 'complete') * 100 / count(*), 6) AS success_rate,
  round(count_if(status = 'failed') * 100 / count(*), 6) AS failure_rate, CAST(epoch(max(added_at)) - epoch(min(added_at)) AS BIGINT) AS duration_seconds, count_if(status IN ('pending', 'processing')) = 0 AS is_complete FROM ledger""",
)
def ledger_stats(spark, sf_dir):
    return agg.ledger_stats(views.ledger(spark, sf_dir))


@query(
    "over_threshold_e06",
    f"WITH {views.LEDGER_SQL} SELECT round(count_if(status = 'failed') / count(*), 6) AS failure_rate, count_if(status = 'failed') / count(*) > 0.005 AS stop FROM ledger",
)
def over_threshold(spark, sf_dir):
    return agg.over_threshold(views.ledger(spark, sf_dir), 0.005)


@query(
    "write_stats_e07",
    f"""WITH {ELEMENTS}, d AS (SELECT deck, CASE WHEN trim(final_alt) <> '' THEN 'written_final' WHEN trim(existing_alt) <> '' THEN 'preserved_existing' WHEN trim(generated_alt) <> '' THEN 'written_generated' ELSE 'skipped_no_content' END AS decision FROM elements)
SELECT deck, count_if(decision = 'preserved_existing') AS preserved_existing, count_if(decision = 'written_generated') AS written_generated, 0 AS written_existing, count_if(decision = 'written_final') AS written_final,
  count_if(decision <> 'skipped_no_content') AS injected_successfully, count_if(decision = 'skipped_no_content') AS validation_failures FROM d GROUP BY deck""",
)
def write_stats(spark, sf_dir):
    plan = classify.write_plan("existing_alt", "generated_alt", "final_alt")["decision"]
    return agg.write_stats(views.elements(spark, sf_dir).select("deck", plan.alias("decision")), ["deck"])


@query(
    "injectable_e08",
    f"""WITH {MANIFEST_SQL}, m AS (SELECT shape_type, decision_reason, coalesce(trim(final_alt) <> '', false) OR trim(generated_alt) <> '' OR trim(existing_alt) <> '' AS has FROM manifest)
SELECT shape_type, decision_reason, CAST(GROUPING(shape_type, decision_reason) AS BIGINT) AS level, count(*) AS entries, count_if(has) AS injectable, count_if(NOT has) AS missing FROM m
GROUP BY GROUPING SETS ((shape_type), (decision_reason), ())""",
)
def injectable(spark, sf_dir):
    return agg.injectable(manifest(spark, sf_dir))


@query(
    "shape_counts_e09",
    f"""WITH {ELEMENTS} SELECT deck, count(*) AS shapes, count_if(length(trim(text)) > 2) AS with_content, count_if(shape_type = 'PICTURE') AS picture, count_if(shape_type = 'GROUP') AS "group",
  count_if(shape_type = 'TEXT_BOX') AS text_box, count_if(shape_type = 'LINE') AS line FROM elements GROUP BY deck""",
)
def shape_counts(spark, sf_dir):
    return agg.shape_counts(views.elements(spark, sf_dir))


@query(
    "repeats_e10",
    f"WITH {ELEMENTS} SELECT content_key, CAST(count(*) AS BIGINT) AS occurrences, count(DISTINCT (deck, slide_idx)) AS slides FROM elements GROUP BY 1 HAVING count(*) > 1",
)
def repeats(spark, sf_dir):
    e = views.elements(spark, sf_dir).select("content_key", "deck", "slide_idx")
    return reuse.repeats(e, "content_key", ["deck", "slide_idx"]).filter("occurrences > 1")


@query(
    "document_stats_e11",
    f"""WITH {ELEMENTS}, d AS (SELECT *, {ENTRY_DECORATIVE} AS deco FROM elements)
SELECT deck, CAST(count(*) AS BIGINT) AS total, CAST(count_if(trim(existing_alt) <> '') AS BIGINT) AS with_alt, CAST(count_if(deco) AS BIGINT) AS decorative, round(count_if(deco OR trim(existing_alt) <> '') / count(*), 6) AS coverage,
  CAST(count_if(uid % 2 = 0) AS BIGINT) AS calls, count(DISTINCT image_hash) AS unique_images FROM d GROUP BY deck""",
)
def document_stats(spark, sf_dir):
    e = views.elements(spark, sf_dir).withColumns(
        {"decorative": classify.entry_decorative("shape_type", "width", "height", "slide_text"), "model_called": F.col("uid") % 2 == 0}
    )
    return agg.document_stats(e)


USAGE_SQL = f"""{views.ATTEMPTS_SQL}, usage AS (SELECT provider, count(*) AS requests, count_if(success) AS successes, round(CAST(sum(CAST(cost AS DECIMAL(20,6))) AS DOUBLE), 6) AS total_cost,
   CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(CAST(seconds AS DECIMAL(20,6))) AS DOUBLE) / count(*), 6) AS avg_response_time FROM attempts GROUP BY 1)"""


@query("usage_e12", f"WITH {USAGE_SQL} SELECT * FROM usage")
def usage(spark, sf_dir):
    return agg.usage(views.attempts(spark, sf_dir))


@query(
    "performance_e13",
    f"""WITH {USAGE_SQL} SELECT provider, round(successes / requests, 6) AS success_rate, round(CASE WHEN total_cost > 0 THEN total_cost / requests ELSE 0 END, 6) AS avg_cost, requests, total_cost, avg_response_time FROM usage""",
)
def performance(spark, sf_dir):
    return agg.performance(views.attempts(spark, sf_dir))


@query(
    "budget_e14",
    f"""WITH {views.ATTEMPTS_SQL}, d AS (SELECT CAST(ts AS DATE) AS day, sum(CAST(cost AS DECIMAL(20,6))) AS c FROM attempts GROUP BY 1), t AS (SELECT day, CAST(c AS DOUBLE) AS daily_cost, CAST(sum(c) OVER (ORDER BY day) AS DOUBLE) AS total_cost FROM d)
SELECT day, round(daily_cost, 6) AS daily_cost, round(total_cost, 6) AS total_cost, daily_cost > 4 AS daily_alert, total_cost > 100 AS total_alert FROM t""",
)
def budget(spark, sf_dir):
    return agg.budget(views.attempts(spark, sf_dir), 4.0, 100.0)


def error_rows(spark, sf_dir):
    a = views.attempts(spark, sf_dir).filter("NOT success")
    return a.select(
        F.col("error").alias("category"), (failure_class("status_code", "error") == "temporary").alias("recoverable"),
        F.when(F.col("status_code") == 503, "try again").alias("hint"),
        F.when(F.col("status_code") == 404, "fallback").otherwise("retry").alias("strategy"),
    )


ERRORS_SQL = f"""{views.ATTEMPTS_SQL}, errors AS (SELECT error AS category, NOT (status_code IN (404, 401, 403) OR {q.contains_any('lower(error)', fixed.PERMANENT_TEXTS)}) AS recoverable,
   CASE WHEN status_code = 503 THEN 'try again' END AS hint, CASE WHEN status_code = 404 THEN 'fallback' ELSE 'retry' END AS strategy FROM attempts WHERE NOT success)"""


@query("error_summary_e15", f"WITH {ERRORS_SQL} SELECT category, count(*) AS errors, count_if(recoverable) AS recoverable, bool_or(hint IS NOT NULL) AS has_hints FROM errors GROUP BY 1")
def error_summary(spark, sf_dir):
    return agg.error_summary(error_rows(spark, sf_dir))


@query(
    "recovery_stats_e16",
    f"""WITH {ERRORS_SQL}, c AS (SELECT strategy, category, count(*) AS uses FROM errors GROUP BY 1, 2)
SELECT strategy, category, uses, round(uses / sum(uses) OVER (), 6) AS share, round(sum(uses) OVER (PARTITION BY strategy) / sum(uses) OVER (), 6) AS strategy_share FROM c""",
)
def recovery_stats(spark, sf_dir):
    return agg.recovery_stats(error_rows(spark, sf_dir))


@query(
    "artifact_usage_e17",
    f"""WITH {views.LEDGER_SQL} SELECT CASE WHEN (epoch(TIMESTAMP '{NOW}') - epoch(added_at)) / 86400 < 1 THEN 'less_than_1_day' WHEN (epoch(TIMESTAMP '{NOW}') - epoch(added_at)) / 86400 < 7 THEN '1_to_7_days'
  ELSE 'more_than_7_days' END AS age, count(*) AS files, round(CAST(sum(CAST(bytes AS DECIMAL(20,6))) AS DOUBLE), 2) AS bytes FROM ledger GROUP BY 1""",
)
def artifact_usage(spark, sf_dir):
    return agg.artifact_usage(views.ledger(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(
    "usage_warning_e17",
    f"WITH {views.LEDGER_SQL} SELECT round(CAST(sum(CAST(bytes AS DECIMAL(20,6))) AS DOUBLE), 2) AS bytes, CAST(sum(CAST(bytes AS DECIMAL(20,6))) AS DOUBLE) > 5e9 AS warn FROM ledger",
)
def usage_warning(spark, sf_dir):
    return agg.usage_warning(views.ledger(spark, sf_dir), 5e9)


@query(
    "expired_e18",
    f"""WITH {views.LEDGER_SQL} SELECT path, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(added_at)) / 86400) AS BIGINT) AS age_days, bytes, count(*) OVER () AS expired_files, round(CAST(sum(CAST(bytes AS DECIMAL(20,6))) OVER () AS DOUBLE), 2) AS expired_bytes FROM ledger WHERE epoch(TIMESTAMP '{NOW}') - epoch(added_at) > 7 * 86400""",
)
def expired(spark, sf_dir):
    return agg.expired(views.ledger(spark, sf_dir), F.lit(NOW).cast("timestamp"), 7)


@query(
    "batch_report_e19",
    f"""WITH {views.LEDGER_SQL} SELECT status, count(*) AS files, count_if(status = 'complete') AS processed, round(CAST(sum(CAST(bytes AS DECIMAL(20,6))) AS DOUBLE), 2) AS bytes,
  round(CAST(sum(CASE WHEN status = 'complete' THEN CAST(bytes AS DECIMAL(20,6)) END) AS DOUBLE) / nullif(count_if(status = 'complete'), 0), 6) AS avg_processed FROM ledger GROUP BY ROLLUP (status)""",
)
def batch_report(spark, sf_dir):
    return agg.batch_report(views.ledger(spark, sf_dir))


@query(
    "selector_metrics_e20",
    f"""WITH {SELECTED_SQL} SELECT selector_decision, escalation_strategy, count(*) AS records, round(avg(CAST(starts_with(reason_code, 'ambiguous_') AS INT)), 6) AS unknown_rate,
  round(avg(CAST(has_overlay AS INT)), 6) AS overlay_rate, round(avg(CAST(width % 6 = 0 AS INT)), 6) AS override_rate FROM selected GROUP BY ROLLUP (selector_decision, escalation_strategy)""",
)
def selector_metrics(spark, sf_dir):
    return agg.selector_metrics(selected(spark, sf_dir).withColumn("overridden", F.col("width") % 6 == 0))


@query(
    "slide_text_e21",
    f"""SELECT conv_id, left(string_agg({q.strip('text')}, ' ' ORDER BY turn), 500) AS slide_text, arg_min({q.strip('text')}, turn) AS title FROM conversations WHERE {q.strip('text')} <> '' GROUP BY 1""",
)
def slide_text(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return agg.slide_text(turns, ["conv_id"], "turn", 500)


@query(
    "audit_summary_e22",
    f"""WITH {ELEMENTS}, d AS (SELECT *, {ENTRY_DECORATIVE} AS deco FROM elements) SELECT deck, count(*) AS total, count_if(deco) AS decorative, count_if(trim(existing_alt) = '' AND NOT deco) AS missing FROM d GROUP BY ROLLUP (deck)""",
)
def audit_summary(spark, sf_dir):
    e = views.elements(spark, sf_dir).withColumn("decorative", classify.entry_decorative("shape_type", "width", "height", "slide_text"))
    return agg.audit_summary(e)


@query(
    "review_summary_e23",
    f"""WITH {DECIDED_SQL} SELECT deck, count(*) AS entries, count_if(decision_reason = 'preserve_existing') AS preserved, count_if(decision_reason IN ('generated_new', 'cached', 'needs_generation')) AS generated,
  count_if(decision_reason IN ('policy_excluded', 'generation_error')) AS excluded FROM decided GROUP BY deck""",
)
def review_summary(spark, sf_dir):
    return agg.review_summary(decided_narrow(spark, sf_dir))


@query(
    "by_slide_e24",
    f"""WITH {ELEMENTS} SELECT deck, slide_idx, count(*) AS entries, string_agg(shape_idx || ':' || instance_key || ':' || existing_alt, chr(10) ORDER BY shape_idx) AS listed FROM elements GROUP BY 1, 2""",
)
def by_slide(spark, sf_dir):
    e = views.elements(spark, sf_dir).select("deck", "slide_idx", "shape_idx", "instance_key", "existing_alt")
    line = lambda x: F.concat_ws(":", x["shape_idx"].cast("string"), x["instance_key"], x["existing_alt"])
    return agg.by_slide(e).select("deck", "slide_idx", F.size("rows").cast("bigint").alias("entries"), F.array_join(F.transform("rows", line), "\n").alias("listed"))


@query(
    "failures_e25",
    f"""WITH {ELEMENTS}, f AS (SELECT deck, instance_key || ': ' || left(slide_text, 100) AS t, row_number() OVER (PARTITION BY deck ORDER BY slide_idx, shape_idx) AS n FROM elements WHERE generated_alt = '' OR starts_with(generated_alt, 'Error'))
SELECT deck, string_agg(t, ' | ' ORDER BY n) AS failures FROM f WHERE n <= 10 GROUP BY deck""",
)
def failures(spark, sf_dir):
    failed = (F.col("generated_alt") == "") | F.col("generated_alt").startswith("Error")
    return agg.failures(views.elements(spark, sf_dir).withColumn("failed", failed), 10)


@query(
    "review_buckets_e26",
    f"""WITH {ELEMENTS}, e AS (SELECT {SHOWN} FROM elements), b AS (SELECT *, CASE WHEN deco THEN 'decorative' WHEN cur <> '[No ALT text]' AND cur = sug AND sug NOT IN ('[No suggestion]', '') THEN 'generated' WHEN cur <> '[No ALT text]' THEN 'preserved'
   WHEN starts_with(sug, 'FALLBACK:') THEN 'fallback_injected' ELSE 'needs_alt' END AS bucket FROM e)
SELECT bucket, count(*) AS elements, count_if(cur <> '[No ALT text]' AND sug <> '[No ALT text]' AND cur = sug) AS identical, count_if(cur = '[No ALT text]') AS missing_current FROM b GROUP BY 1""",
)
def review_buckets(spark, sf_dir):
    return agg.review_buckets(shown(views.elements(spark, sf_dir)), "cur", "sug", F.col("deco"))


@query(
    "plan_summary_e27",
    f"""WITH {DECIDED_SQL} SELECT CASE decision_reason WHEN 'preserve_existing' THEN 'preserve' WHEN 'policy_excluded' THEN 'exclude' WHEN 'needs_generation' THEN 'generate' ELSE 'use_cache' END AS action, decision_reason,
  count(*) AS elements, count(DISTINCT content_key) AS contents FROM decided GROUP BY 1, 2""",
)
def plan_summary(spark, sf_dir):
    return agg.plan_summary(decided_narrow(spark, sf_dir))
