"""Order-dependent operators, group trees and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from altloom import views
from altloom.functions import describe, fixed, rules, text
from altloom.operators import breaker, classify, groups, joins, ordered, patch, reuse
from altloom.plans import sql as q
from altloom.plans.join_queries import KEYS_SQL, OVERLAYS_SQL, STREAK_SQL, stored_keys
from altloom.plans.registry import query
from altloom.plans.text_queries import FINALIZED, QUALITY, UNIVERSAL
from altloom.session import materialize

ELEMENTS = views.ELEMENTS_SQL


@query(
    "cap_per_slide_f01",
    f"""WITH {ELEMENTS} SELECT shape_id, CAST(row_number() OVER (PARTITION BY deck, slide_idx ORDER BY shape_idx) AS INT) AS slot FROM elements
WHERE shape_type NOT IN ('LINE', 'CONNECTOR') QUALIFY row_number() OVER (PARTITION BY deck, slide_idx ORDER BY shape_idx) <= 5""",
)
def cap_per_slide(spark, sf_dir):
    eligible = ~F.col("shape_type").isin("LINE", "CONNECTOR")
    return ordered.cap_per_slide(views.elements(spark, sf_dir), eligible, 5).select("shape_id", "slot")


@query(
    "image_number_f02",
    f"WITH {ELEMENTS} SELECT shape_id, row_number() OVER (PARTITION BY deck ORDER BY slide_idx, shape_idx) AS image_number FROM elements",
)
def image_number(spark, sf_dir):
    e = views.elements(spark, sf_dir).select("shape_id", "deck", "slide_idx", "shape_idx")
    return ordered.image_number(e).select("shape_id", "image_number")


@query(
    "elect_generators_f03",
    f"WITH {ELEMENTS} SELECT deck, shape_id, row_number() OVER (PARTITION BY content_key ORDER BY deck, slide_idx, shape_idx) = 1 AS generates FROM elements",
)
def elect_generators(spark, sf_dir):
    e = views.elements(spark, sf_dir).select("shape_id", "content_key", "deck", "slide_idx", "shape_idx")
    return reuse.elect_generators(e, "content_key", ["deck", "slide_idx", "shape_idx"]).select("deck", "shape_id", "generates")


@query("latest_f04", "SELECT conv_id AS key, max(turn) AS seq, arg_max(role, turn) AS source, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def latest(spark, sf_dir):
    return reuse.latest(views.candidates(spark, sf_dir), ["key"], ["seq"])


@query(
    "best_candidate_f05",
    f"""WITH s AS (SELECT conv_id AS key, turn AS seq, text, {QUALITY.replace('{{', '{').replace('}}', '}').format(t=q.strip('text'))} AS score FROM conversations)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, seq) = 1""",
)
def best_candidate(spark, sf_dir):
    scored = views.candidates(spark, sf_dir).select("key", "seq", "text", text.quality_score("text").alias("score"))
    return reuse.best_candidate(scored, ["key"], "score", "seq")


@query("failure_streak_f06", f"WITH {STREAK_SQL} SELECT attempt_id, streak FROM streaks")
def failure_streak(spark, sf_dir):
    return ordered.streaks(views.attempts(spark, sf_dir).select("attempt_id", "provider", "ts", "success")).select("attempt_id", "streak")


@query(
    "next_retry_f07",
    f"WITH {STREAK_SQL} SELECT attempt_id, streak, ts + to_seconds(CAST(least(power(2, streak - 1), 60) AS INT)) AS retry_at FROM streaks WHERE NOT success",
)
def next_retry(spark, sf_dir):
    return ordered.next_retry(views.attempts(spark, sf_dir).select("attempt_id", "provider", "ts", "success")).select("attempt_id", "streak", "retry_at")


@query(
    "running_usage_f08",
    f"""WITH {views.ATTEMPTS_SQL} SELECT attempt_id, count(*) OVER w AS requests, round(CAST(sum(CAST(seconds AS DECIMAL(20,6))) OVER w AS DOUBLE) / count(*) OVER w, 6) AS mean_seconds,
  round(CAST(sum(CAST(cost AS DECIMAL(20,6))) OVER w AS DOUBLE), 6) AS total_cost FROM attempts WINDOW w AS (PARTITION BY provider ORDER BY ts, attempt_id)""",
)
def running_usage(spark, sf_dir):
    a = views.attempts(spark, sf_dir).select("attempt_id", "provider", "ts", "seconds", "cost")
    return ordered.running_usage(a).select("attempt_id", "requests", "mean_seconds", "total_cost")


@query(
    "breaker_openings_f09",
    f"WITH {STREAK_SQL} SELECT provider, attempt_id, ts AS opened_at, ts + INTERVAL 600 SECOND AS closed_until FROM streaks WHERE streak = 3",
)
def breaker_openings(spark, sf_dir):
    return ordered.breaker_openings(views.attempts(spark, sf_dir).select("attempt_id", "provider", "ts", "success"), threshold=3)


BREAKER_SQL = f"""WITH RECURSIVE {views.ATTEMPTS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts, attempt_id) AS n FROM attempts),
r AS (SELECT provider, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS attempt_id, 'closed' AS name, 'closed' AS before, 0 AS f, 0 AS s, CAST(NULL AS TIMESTAMP) AS failed_at FROM attempts GROUP BY provider
  UNION ALL SELECT provider, n, ts, attempt_id,
    CASE WHEN cur = 'open' THEN cur WHEN success AND cur = 'half_open' AND s + 1 >= 2 THEN 'closed' WHEN success THEN cur WHEN cur = 'half_open' OR f + 1 >= 3 THEN 'open' ELSE cur END, before,
    CASE WHEN cur = 'open' THEN f WHEN NOT success THEN f + 1 WHEN cur = 'closed' OR s + 1 >= 2 THEN 0 ELSE f END,
    CASE WHEN cur = 'half_open' AND success THEN s + 1 ELSE s END, CASE WHEN cur <> 'open' AND NOT success THEN ts ELSE failed_at END
  FROM (SELECT a.provider, a.n, a.ts, a.attempt_id, a.success, r.name AS before, r.f, r.failed_at,
      CASE WHEN r.name = 'open' AND a.ts - r.failed_at >= INTERVAL 60 SECOND THEN 'half_open' ELSE r.name END AS cur,
      CASE WHEN r.name = 'open' THEN 0 ELSE r.s END AS s FROM r JOIN a ON a.provider = r.provider AND a.n = r.n + 1))
SELECT provider, ts, attempt_id, name AS state, before || ' to ' || name AS reason FROM r WHERE n > 0 AND name <> before"""


@query("breaker_changes_f09", BREAKER_SQL)
def breaker_changes(spark, sf_dir):
    """Closed, open and half open over all calls of every provider, in set form."""
    calls = views.attempts(spark, sf_dir).select("attempt_id", "provider", "ts", "success")
    return breaker.breaker_changes(calls, threshold=3, recovery=60.0, good=2)


@query(
    "first_child_alt_f10",
    f"""WITH {ELEMENTS} SELECT deck, slide_idx, parent_id, arg_min(existing_alt, shape_idx) AS child_alt FROM elements WHERE parent_id IS NOT NULL AND trim(existing_alt) <> ''
GROUP BY 1, 2, 3""",
)
def first_child_alt(spark, sf_dir):
    return ordered.first_child_alt(views.elements(spark, sf_dir).filter("parent_id IS NOT NULL"))


@query(
    "repeat_share_f11",
    "SELECT source, count(*) AS elements, count(DISTINCT text) AS contents, round(1 - count(DISTINCT text) / count(*), 6) AS repeat_share FROM documents GROUP BY 1",
)
def repeat_share(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("content_key"))
    return ordered.repeat_share(d, ["source"], "content_key")


# --- order -----------------------------------------------------------------------


@query(
    "review_order_g01",
    f"WITH {ELEMENTS} SELECT shape_id, row_number() OVER (ORDER BY deck, slide_idx, shape_idx) AS position FROM elements",
)
def review_order(spark, sf_dir):
    e = views.elements(spark, sf_dir).select("shape_id", "deck", "slide_idx", "shape_idx")
    return ordered.review_order(e).select("shape_id", "position")


@query(
    "sample_errors_g02",
    f"WITH {views.ATTEMPTS_SQL} SELECT attempt_id, provider, ts, error FROM attempts WHERE NOT success ORDER BY ts, attempt_id LIMIT 10",
)
def sample_errors(spark, sf_dir):
    failed = views.attempts(spark, sf_dir).filter("NOT success").select("attempt_id", "provider", "ts", "error")
    return ordered.sample_errors(failed, ["ts", "attempt_id"], 10)


@query(
    "oldest_first_g03",
    f"WITH {views.LEDGER_SQL} SELECT path, added_at, row_number() OVER (ORDER BY added_at, path) AS position FROM ledger",
)
def oldest_first(spark, sf_dir):
    return ordered.oldest_first(views.ledger(spark, sf_dir).select("path", "added_at"), "added_at", "path")


def selected(spark, sf_dir):
    """Contract decisions over the element table."""
    e = views.elements(spark, sf_dir)
    place = ["deck", "slide_idx"]
    first = reuse.elect_generators(e.select(*reuse.OWNER, "content_key"), "content_key", reuse.OWNER, name="first_copy").drop("content_key")
    children = joins.group_children(e).groupBy(*place, F.col("parent_id").alias("shape_id")).agg(F.count(F.lit(1)).alias("children"))
    covered = joins.overlays(e).select(*place, F.col("target_id").alias("shape_id")).distinct().withColumn("has_overlay", F.lit(True))
    hint = views.pick(["arrow", "unknown", "callout", "error_dialog", "highlight", "circle", "text_box"], F.col("width"))
    full = (
        e.join(first, reuse.OWNER).join(children, reuse.OWNER, "left").join(covered, reuse.OWNER, "left")
        .withColumns(
            {
                "children": F.coalesce("children", F.lit(0)),
                "has_overlay": F.coalesce("has_overlay", F.lit(False)),
                "annotation_hint": hint,
                "decorative": classify.entry_decorative("shape_type", "width", "height", "slide_text"),
            }
        )
    )
    return groups.selector_decide(full)


SELECTED_SQL = f"""{OVERLAYS_SQL}, s AS (SELECT e.*, EXISTS (SELECT 1 FROM overlays o WHERE o.deck = e.deck AND o.slide_idx = e.slide_idx AND o.target_id = e.shape_id) AS has_overlay,
   (SELECT count(*) FROM elements c WHERE c.parent_uid = e.uid AND e.shape_type = 'GROUP') AS children,
   row_number() OVER (PARTITION BY content_key ORDER BY deck, slide_idx, shape_id) = 1 AS first_copy,
   ['arrow','unknown','callout','error_dialog','highlight','circle','text_box'][width % 7 + 1] AS hint,
   shape_type IN ('LINE', 'CONNECTOR') OR width * height < 100 OR {q.contains_any('lower(slide_text)', rules.DECORATIVE_CONTEXT)} AS decorative FROM elements e),
reasoned AS (SELECT *, CASE WHEN hint = 'error_dialog' THEN 'escalate_system_ui_like'
   WHEN trim(existing_alt) <> '' AND NOT regexp_matches(existing_alt, '(?i)click to add|image|placeholder|^figure\\s*\\d+') AND length(existing_alt) >= 15 THEN 'preserve_existing_alt'
   WHEN decorative AND NOT has_overlay THEN 'decorative_rule' WHEN shape_type = 'GROUP' AND children >= 2 THEN 'group_semantics' WHEN shape_type = 'GROUP' THEN 'ambiguous_grouping'
   WHEN shape_type IN ('PICTURE', 'CHART', 'TABLE') AND first_copy THEN 'atomic_visual' WHEN NOT first_copy THEN 'repeated_content' ELSE 'ambiguous_structure' END AS reason_code FROM s),
selected AS (SELECT *, CASE WHEN reason_code = 'escalate_system_ui_like' THEN 'escalate_manual_review' WHEN reason_code = 'decorative_rule' THEN 'exclude_decorative'
   WHEN reason_code IN ('group_semantics', 'ambiguous_grouping') THEN 'include_group' WHEN reason_code = 'repeated_content' THEN 'exclude_redundant' ELSE 'include_atomic' END AS selector_decision,
   CASE WHEN reason_code = 'escalate_system_ui_like' THEN 'defer_to_manual_review' WHEN starts_with(reason_code, 'ambiguous_') THEN 'include_with_ambiguous_reason' ELSE 'none' END AS escalation_strategy FROM reasoned)"""


@query(
    "by_priority_g04",
    f"""WITH {SELECTED_SQL}, p AS (SELECT deck, slide_idx, shape_id, CASE WHEN selector_decision = 'escalate_manual_review' OR (shape_type = 'CHART' AND has_overlay) THEN 1
   WHEN escalation_strategy = 'include_with_ambiguous_reason' THEN 2 ELSE 3 END AS priority FROM selected)
SELECT deck, shape_id, priority, row_number() OVER (ORDER BY priority, deck, slide_idx, shape_id) AS position FROM p""",
)
def by_priority(spark, sf_dir):
    s = selected(spark, sf_dir)
    level = ordered.priority(
        F.col("selector_decision"), F.col("escalation_strategy"), (F.col("shape_type") == "CHART") & F.col("has_overlay")
    )
    return ordered.by_priority(s.select(*reuse.OWNER, level.alias("level")), F.col("level"), reuse.OWNER).select(
        "deck", "shape_id", "priority", "position"
    )


@query(
    "stable_order_g05",
    f"WITH {ELEMENTS} SELECT deck, instance_key, row_number() OVER (ORDER BY deck, instance_key) AS position FROM elements",
)
def stable_order(spark, sf_dir):
    return ordered.stable_order(views.elements(spark, sf_dir).select("deck", "instance_key"), ["deck", "instance_key"])


@query(
    "topk_per_slide_g06",
    f"WITH {ELEMENTS} SELECT deck, slide_idx, instance_key, CAST(row_number() OVER w AS INT) AS n FROM elements WINDOW w AS (PARTITION BY deck, slide_idx ORDER BY instance_key) QUALIFY row_number() OVER w <= 3",
)
def topk_per_slide(spark, sf_dir):
    e = views.elements(spark, sf_dir).select("deck", "slide_idx", "instance_key")
    return ordered.top_per(e, ["deck", "slide_idx"], ["instance_key"], 3)


@query(
    "next_items_g07",
    f"WITH {views.LEDGER_SQL} (SELECT path, status, added_at FROM ledger WHERE status = 'pending' ORDER BY added_at, path LIMIT 20) UNION ALL (SELECT path, status, added_at FROM ledger WHERE status = 'failed' ORDER BY added_at, path LIMIT 5)",
)
def next_items(spark, sf_dir):
    work = views.ledger(spark, sf_dir).select("path", "status", "added_at")
    return ordered.next_items(work, 20).unionByName(ordered.next_items(work, 5, "failed"))


# --- sets -----------------------------------------------------------------------


@query("common_keys_h01", f"WITH {KEYS_SQL} SELECT deck, key FROM k INTERSECT SELECT deck, element_key FROM el")
def common_keys(spark, sf_dir):
    asked, elements = stored_keys(spark, sf_dir)
    return ordered.common_keys(asked, elements.select("deck", F.col("element_key").alias("key")))


@query(
    "backfill_h02",
    f"""WITH {ELEMENTS}, s AS (SELECT deck, instance_key AS key, generated_alt AS text, 'llava' AS source FROM elements WHERE generated_alt <> '')
SELECT * FROM s UNION ALL SELECT deck, instance_key, CASE WHEN shape_type = 'PICTURE' THEN 'Image: ' || shape_name WHEN shape_type = 'CONNECTOR' THEN
   CASE WHEN height < 10 AND width > height * 3 THEN 'horizontal' WHEN width < 10 AND height > width * 3 THEN 'vertical' ELSE 'diagonal' END || ' line'
   WHEN contains(shape_name, 'Arrow') THEN 'Arrow' ELSE 'Shape: ' || shape_name END, 'geometric_backfill' FROM elements
   WHERE generated_alt = '' AND shape_type NOT IN ('PLACEHOLDER', 'TEXT_BOX')""",
)
def backfill(spark, sf_dir):
    e = views.elements(spark, sf_dir).withColumnRenamed("instance_key", "key")
    texts = e.filter("generated_alt <> ''").select("deck", "key", F.col("generated_alt").alias("text"), F.lit("llava").alias("source"))
    none = F.lit(None).cast("int")
    made = F.when(
        F.col("shape_name").contains("Arrow") & ~F.col("shape_type").isin("PICTURE", "CONNECTOR"), "Arrow"
    ).otherwise(describe.describe_geometry("shape_name", "shape_type", none, none, none, "width", "height"))
    return ordered.backfill(texts, e, made)


@query(
    "enqueue_h03",
    f"""WITH {views.LEDGER_SQL}, f AS (SELECT DISTINCT 'in/' || (o_orderkey + 5000) || '.pptx' AS path FROM orders)
SELECT path, status FROM ledger UNION ALL SELECT path, 'pending' FROM f WHERE path NOT IN (SELECT path FROM ledger)""",
)
def enqueue(spark, sf_dir):
    files = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("in/"), (F.col("o_orderkey") + 5000).cast("string"), F.lit(".pptx")).alias("path")
    )
    return ordered.enqueue(views.ledger(spark, sf_dir), files)


@query(
    "rules_union_h04",
    "SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT lower(p_type) FROM part)",
)
def rules_union(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    return ordered.rules_union(
        part.select(F.explode(F.split("p_name", " ")).alias("word")), part.select(F.lower("p_type").alias("word"))
    )


# --- group trees -------------------------------------------------------------------

FLAT_SQL = f"""{views.TANGLED_SQL}, found AS (SELECT uid, 0 AS depth, [shape_id] AS path, [uid] AS upath FROM parented WHERE parent_id IS NULL
  UNION ALL SELECT e.uid, f.depth + 1, list_append(f.path, e.shape_id), list_append(f.upath, e.uid) FROM parented e JOIN found f ON e.up = f.uid),
flat AS (SELECT p.uid, deck, slide_idx, shape_idx, shape_id, depth, coalesce(path, [shape_id]) AS path, coalesce(upath, [p.uid]) AS upath FROM parented p LEFT JOIN found ON found.uid = p.uid)"""


@query("flatten_i01", f"WITH RECURSIVE {FLAT_SQL} SELECT deck, slide_idx, shape_idx, shape_id, depth, array_to_string(path, '/') AS path FROM flat")
def flatten(spark, sf_dir):
    flat = groups.flatten(views.tangled(spark, sf_dir))
    return flat.select("deck", "slide_idx", "shape_idx", "shape_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query(
    "is_image_like_c02",
    f"""WITH RECURSIVE {FLAT_SQL}, own AS (SELECT deck, slide_idx, shape_idx, uid, shape_id, NOT (shape_type IN ('TEXT_BOX', 'PLACEHOLDER') AND (trim(text) = '' OR {q.contains_any('lower(text)', fixed.EMPTY_PROMPTS)}))
   AND (shape_type = 'PICTURE' OR fill_kind = 'picture') AS own FROM tangled)
SELECT o.deck, o.slide_idx, o.shape_idx, o.shape_id, own OR EXISTS (SELECT 1 FROM flat f JOIN own c ON c.uid = f.uid WHERE c.own AND f.uid <> o.uid AND list_contains(f.upath, o.uid)) AS image_like FROM own o""",
)
def is_image_like(spark, sf_dir):
    e = views.tangled(spark, sf_dir)
    return groups.is_image_like(e, groups.flatten(e)).select("deck", "slide_idx", "shape_idx", "shape_id", "image_like")


COUNTS_SQL = f"""{ELEMENTS}, ch AS (SELECT c.parent_uid, c.shape_id, CASE c.shape_type WHEN 'PICTURE' THEN 'image' WHEN 'AUTO_SHAPE' THEN 'shape' WHEN 'CHART' THEN 'chart' END AS kind, trim(c.text) AS t, c.shape_type, c.width
   FROM elements c JOIN elements g ON g.uid = c.parent_uid AND g.shape_type = 'GROUP'),
counts AS (SELECT parent_uid, count(*) AS n, count(kind) AS m, count_if(kind IS NULL AND t <> '') AS w, count_if(kind IS NULL AND t = '') AS d, min(kind) AS k1, max(kind) AS k2,
   min(CASE WHEN kind IS NOT NULL THEN shape_id END) AS only_child FROM ch GROUP BY 1),
sem AS (SELECT counts.*, e.deck, e.slide_idx, e.shape_id AS parent_id, CASE WHEN e.height > 0 THEN e.width / e.height ELSE 1 END AS r FROM counts JOIN elements e ON e.uid = counts.parent_uid),
named AS (SELECT *, CASE WHEN r BETWEEN 0.8 AND 1.4 AND n >= 3 AND d >= 2 THEN 'lightbulb' WHEN r BETWEEN 0.9 AND 1.6 AND n >= 5 THEN 'brain' WHEN r BETWEEN 1.2 AND 2.0 AND n >= 2 THEN 'lungs'
   WHEN r BETWEEN 0.7 AND 1.5 AND n >= 2 THEN 'graduation cap' WHEN n >= 5 THEN 'complex icon' WHEN n >= 3 THEN 'composite icon' END AS semantic FROM sem)"""


def plural(x, word):
    return f"'Group containing ' || {x} || ' {word}' || CASE WHEN {x} <> 1 THEN 's' ELSE '' END"


@query(
    "rollup_groups_i02",
    f"""WITH {COUNTS_SQL} SELECT deck, slide_idx, parent_id AS group_id,
  CASE WHEN m = 0 AND w > 0 THEN {plural('w', 'text element')} WHEN m = 0 AND d > 0 THEN {plural('n', 'decorative element')} WHEN m = 1 THEN 'Group containing ' || k1
    WHEN k1 = k2 THEN 'Group of ' || m || ' ' || k1 || 's' ELSE 'Group containing ' || m || ' visual elements' END AS group_alt,
  CASE WHEN m = 0 AND w > 0 THEN 'text_only_group' WHEN m = 0 THEN 'decorative_group' WHEN m = 1 THEN 'child_promoted_both_keep' ELSE 'composite_structural' END AS policy,
  CAST(NULL AS BIGINT) AS mark_decorative FROM named""",
)
def rollup_groups(spark, sf_dir):
    return groups.rollup_groups(views.elements(spark, sf_dir))


@query(
    "group_semantic_i03",
    f"""WITH {COUNTS_SQL} SELECT deck, slide_idx, parent_id AS group_id, semantic, CASE WHEN semantic IS NOT NULL AND m = 1 THEN only_child END AS mark_decorative,
  CASE WHEN semantic IS NULL THEN NULL WHEN m = 0 THEN 'semantic_parent_generic' WHEN m = 1 THEN 'parent_kept_child_decorative' ELSE 'composite_semantic_container' END AS policy FROM named""",
)
def group_semantic(spark, sf_dir):
    e = views.elements(spark, sf_dir)
    place = ["deck", "slide_idx"]
    kinds = groups.group_semantic(e).select(*place, F.col("parent_id").alias("group_id"), "semantic")
    rolled = groups.rollup_groups(e, semantics=True).select(*place, "group_id", "mark_decorative", "policy")
    return kinds.join(rolled, [*place, "group_id"]).withColumn("policy", F.when(F.col("semantic").isNotNull(), F.col("policy")))


@query(
    "group_decorative_i04",
    f"""WITH {COUNTS_SQL}, f AS (SELECT parent_uid, count(*) AS n, count_if(width % 3 > 0) AS d, count_if(width % 3 = 0 AND (length(t) > 10 OR shape_type IN ('PICTURE', 'CHART'))) AS c FROM ch GROUP BY 1)
SELECT e.deck, e.slide_idx, e.shape_id AS group_id, n AS children, d AS decorative_children, d = n OR (n <= 3 AND d / n >= 0.67) OR (n <= 5 AND d / n >= 0.8) OR (c = 0 AND d / n >= 0.5) AS decorative FROM f JOIN elements e ON e.uid = f.parent_uid""",
)
def group_decorative(spark, sf_dir):
    found = groups.group_decorative(views.elements(spark, sf_dir), F.col("width") % 3 > 0)
    return found.select("deck", "slide_idx", "group_id", "children", "decorative_children", "decorative")


@query(
    "suppress_children_i05",
    f"""WITH RECURSIVE {SELECTED_SQL}, {FLAT_SQL.removeprefix(ELEMENTS + ", ")},
oo AS (SELECT s.deck, s.slide_idx, s.shape_idx, s.shape_id, s.selector_decision, s.reason_code, s.existing_alt, list_filter(f.upath, lambda p: p <> s.uid AND list_contains(g.ids, p))[1] AS top
   FROM selected s JOIN flat f USING (uid) CROSS JOIN (SELECT list(uid) AS ids FROM selected WHERE selector_decision = 'include_group') g),
o AS (SELECT oo.*, e.shape_id AS owner FROM oo LEFT JOIN tangled e ON e.uid = oo.top)
SELECT deck, slide_idx, shape_idx, shape_id, owner AS parent_group_id, CASE WHEN owner IS NOT NULL THEN 'exclude_redundant' ELSE selector_decision END AS selector_decision,
  CASE WHEN owner IS NOT NULL THEN 'group_suppression' ELSE reason_code END AS reason_code FROM o
UNION ALL SELECT deck, slide_idx, shape_idx, shape_id, owner, 'preserve_conflict', 'preserve_conflict' FROM o WHERE owner IS NOT NULL AND length(existing_alt) > 20""",
)
def suppress_children(spark, sf_dir):
    """Suppression over trees with repeated ids and circles; decisions keep the element's own id."""
    decisions = selected(spark, sf_dir).withColumn("human_alt", F.length("existing_alt") > 20)
    flat = groups.flatten(views.tangled(spark, sf_dir))
    return groups.suppress_children(decisions, flat).select(
        "deck", "slide_idx", "shape_idx", "shape_id", "parent_group_id", "selector_decision", "reason_code"
    )


# --- selector ------------------------------------------------------------------------


@query(
    "selector_c23",
    f"""WITH {ELEMENTS} SELECT deck, 'slide_' || slide_idx || '_shape_' || shape_idx AS element_id, 'v1.0-rc' AS selector_version, CAST(NULL AS VARCHAR) AS parent_group_id, 'include_atomic' AS selector_decision,
  'image' AS content_scope, 'stub_v1' AS reason_code, 'Stub v1: included for processing' AS human_reason, 'none' AS escalation_strategy, shape_type AS original_shape_type FROM elements
WHERE NOT (shape_type = 'PLACEHOLDER' AND trim(text) = '')""",
)
def selector(spark, sf_dir):
    records = groups.selector(views.elements(spark, sf_dir), "v1.0-rc")
    return records.select(
        *[c for c in records.columns if c != "metadata"], F.element_at("metadata", "original_shape_type").alias("original_shape_type")
    )


@query("selector_decide_c24", f"WITH {SELECTED_SQL} SELECT deck, shape_id, selector_decision, reason_code, escalation_strategy FROM selected")
def selector_decide(spark, sf_dir):
    return selected(spark, sf_dir).select("deck", "shape_id", "selector_decision", "reason_code", "escalation_strategy")


def corrupted(spark, sf_dir):
    """Selector records with faults put in at known places."""
    records = groups.selector(views.elements(spark, sf_dir), "v1.0-rc")
    shape = F.element_at("metadata", "original_shape_type")
    return records.withColumns(
        {
            "selector_version": F.when(shape == "TABLE", "").otherwise(F.col("selector_version")),
            "selector_decision": F.when(shape == "CHART", "maybe").when(shape == "GROUP", "exclude_redundant").otherwise(F.col("selector_decision")),
            "content_scope": F.when(shape == "LINE", None).otherwise(F.col("content_scope")),
            "escalation_strategy": F.when(shape == "LINE", "later").otherwise(F.col("escalation_strategy")),
            "metadata": F.when(shape != "PLACEHOLDER", F.col("metadata")),
            "extra_fields": F.when(shape == "TEXT_BOX", F.array(F.lit("score"))),
            "has_parent_field": shape != "GROUP",
        }
    )


FAULTS_SQL = f"""{ELEMENTS}, v AS (SELECT deck, 'slide_' || slide_idx || '_shape_' || shape_idx AS element_id, unnest(CASE shape_type WHEN 'TABLE' THEN ['selector_version'] WHEN 'CHART' THEN ['selector_decision']
   WHEN 'GROUP' THEN ['redundant_without_parent'] WHEN 'LINE' THEN ['content_scope', 'escalation_strategy'] WHEN 'PLACEHOLDER' THEN ['metadata'] WHEN 'TEXT_BOX' THEN ['extra_fields'] ELSE [] END) AS violation
   FROM elements WHERE NOT (shape_type = 'PLACEHOLDER' AND trim(text) = ''))"""


@query("violations_c25", f"WITH {FAULTS_SQL} SELECT deck, element_id, violation FROM v")
def violations(spark, sf_dir):
    return groups.violations(corrupted(spark, sf_dir))


@query(
    "batch_verdict_c25",
    f"""WITH {FAULTS_SQL} SELECT deck, (SELECT count(*) FROM elements e WHERE e.deck = d.deck) AS records, (SELECT count(*) FROM v WHERE v.deck = d.deck) AS violations,
  (SELECT count(*) FROM v WHERE v.deck = d.deck) = 0 AS valid FROM (SELECT DISTINCT deck FROM elements) d""",
)
def batch_verdict(spark, sf_dir):
    return groups.batch_verdict(corrupted(spark, sf_dir))


@query("manual_review_c26", f"WITH {SELECTED_SQL} SELECT deck, count(*) AS waiting FROM selected WHERE selector_decision = 'escalate_manual_review' GROUP BY 1")
def manual_review(spark, sf_dir):
    return groups.manual_review(selected(spark, sf_dir)).groupBy("deck").agg(F.count(F.lit(1)).alias("waiting"))


# --- patches ---------------------------------------------------------------------------


def planned(spark, sf_dir):
    """Texts ready to write, current texts and the ledger of an earlier run, which wrote a part of them."""
    e = views.elements(spark, sf_dir).withColumn(
        "plan", classify.write_plan("existing_alt", "generated_alt", "final_alt", "preserve")
    )
    plan = e.filter("plan.should_write").select(
        "deck", F.col("instance_key").alias("key"), F.col("plan.final_alt").alias("text"), F.col("shape_type").alias("kind"), "width",
        F.lit(True).alias("is_generated"), F.lit(False).alias("is_fallback"), (F.col("plan.decision") == "written_final").alias("forced"),
    )
    ready = materialize(patch.ready_texts(plan))
    current = e.select("deck", F.col("instance_key").alias("key"), F.col("existing_alt").alias("text"))
    # Only what stands where a text is ready is compared; the other texts are not moved for it.
    current = current.join(ready.select(*joins.KEY), joins.KEY, "left_semi")
    return ready, current, ready.filter("width % 4 = 0").select("deck", "key", "text_hash")


PLAN_SQL = f"""{ELEMENTS}, w AS (SELECT uid AS doc_id, deck, instance_key AS key, shape_type, width, existing_alt, {q.strip('existing_alt')} AS e, CASE WHEN trim(final_alt) <> '' THEN {q.strip('final_alt')} WHEN trim(existing_alt) <> '' THEN NULL
   WHEN trim(generated_alt) <> '' THEN {q.strip('generated_alt')} END AS text, coalesce(trim(final_alt) <> '', false) AS forced FROM elements),
src AS (SELECT doc_id, text FROM w WHERE text IS NOT NULL)"""
CURRENT_SQL = UNIVERSAL.format(source="cur").replace("parts AS", "cparts AS", 1).replace("FROM parts", "FROM cparts").replace("kept AS (", "ckept AS (", 1)
CURRENT_SQL = CURRENT_SQL.replace("FROM kept)", "FROM ckept)").replace("joined AS (", "cjoined AS (", 1).replace("FROM joined)", "FROM cjoined)").replace("universal AS (", "cuniversal AS (", 1)
PATCH_SQL = f"""{PLAN_SQL}, {UNIVERSAL.format(source='src')}, cur AS (SELECT doc_id, existing_alt AS text FROM w WHERE existing_alt <> ''), {CURRENT_SQL},
new AS (SELECT doc_id, {FINALIZED.format(x='u')} AS n FROM universal),
renorm AS (SELECT w.*, n, c.u AS cu FROM w JOIN new USING (doc_id) LEFT JOIN cuniversal c USING (doc_id)),
gated AS (SELECT * FROM renorm WHERE n <> '' AND length(n) <= 200 AND NOT {q.contains_any('lower(n)', fixed.LENIENT_BLOCKED)} AND NOT {q.contains_any('n', fixed.TEMPLATED)}),
patch AS (SELECT deck, key, existing_alt AS old_alt, n AS new_alt, CASE WHEN e = '' THEN 'insert' ELSE 'replace' END AS change, left(sha1(n), 8) AS text_hash FROM gated
   WHERE (forced OR lower(e) IN ({q.quoted(fixed.SKIP_TOKENS)})) AND (e = '' OR lower(n) <> lower(cu)) AND width % 4 <> 0)"""


@query("patch_l01", f"WITH {PATCH_SQL} SELECT * FROM patch")
def patch_rows(spark, sf_dir):
    return patch.changes(*planned(spark, sf_dir))


@query(
    "apply_patch_l02",
    f"""WITH {PATCH_SQL} SELECT elements.deck, instance_key AS key, coalesce(new_alt, existing_alt) AS existing_alt, CASE WHEN change IS NOT NULL THEN change
   WHEN lower({q.strip('existing_alt')}) NOT IN ({q.quoted(fixed.SKIP_TOKENS)}) THEN 'preserved' ELSE 'skipped' END AS outcome FROM elements LEFT JOIN patch ON patch.deck = elements.deck AND patch.key = instance_key""",
)
def apply_patch(spark, sf_dir):
    e = views.elements(spark, sf_dir).select("deck", F.col("instance_key").alias("key"), "existing_alt")
    return patch.apply_patch(e, patch.changes(*planned(spark, sf_dir)))


@query(
    "dedupe_titles_l03",
    f"""WITH {ELEMENTS}, t AS (SELECT shape_id, existing_alt AS descr, CASE WHEN shape_id % 2 = 0 THEN ' ' || existing_alt ELSE shape_name END AS title FROM elements)
SELECT shape_id, CASE WHEN {q.strip('descr')} <> '' AND {q.strip('descr')} = {q.strip('title')} THEN '' ELSE title END AS title FROM t""",
)
def dedupe_titles(spark, sf_dir):
    t = views.elements(spark, sf_dir).select(
        "shape_id", F.col("existing_alt").alias("descr"),
        F.when(F.col("shape_id") % 2 == 0, F.concat(F.lit(" "), "existing_alt")).otherwise(F.col("shape_name")).alias("title"),
    )
    return patch.dedupe_titles(t).select("shape_id", "title")


@query(
    "mark_decorative_l04",
    f"""WITH {COUNTS_SQL}, m AS (SELECT deck, slide_idx, only_child AS shape_id FROM named WHERE semantic IS NOT NULL AND m = 1)
SELECT deck, shape_id, (deck, slide_idx, shape_id) IN (SELECT (deck, slide_idx, shape_id) FROM m) AS decorative, CASE WHEN (deck, slide_idx, shape_id) IN (SELECT (deck, slide_idx, shape_id) FROM m) THEN '' ELSE existing_alt END AS existing_alt FROM elements""",
)
def mark_decorative(spark, sf_dir):
    e = views.elements(spark, sf_dir)
    flags = groups.rollup_groups(e, semantics=True).filter("mark_decorative IS NOT NULL").select("deck", "slide_idx", F.col("mark_decorative").alias("shape_id"))
    return patch.mark_decorative(e, flags, reuse.OWNER).select("deck", "shape_id", "decorative", "existing_alt")
