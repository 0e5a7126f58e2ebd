"""Scans, stored tables and provider calls."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from altloom import views
from altloom.functions import fixed
from altloom.operators import classify, joins, patch, provider
from altloom.operators.ordered import image_number
from altloom.plans import sql as q
from altloom.plans.decisions import DECIDED_SQL, decided
from altloom.plans.aggregate_queries import OUTCOMES_SQL, outcomes
from altloom.plans.ordered_queries import PATCH_SQL
from altloom.plans.packages import packages
from altloom.plans.registry import query
from altloom.operators import aggregates as agg
from altloom.session import materialize, shared_folder
from altloom.sources import office, tables

ELEMENTS = views.ELEMENTS_SQL


def folder(spark, name):
    """A fresh place in the folder all executors share."""
    return f"{shared_folder(spark)}/altloom-{name}-{uuid.uuid4().hex}"


FILES_SQL = "SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, true AS each_once FROM documents GROUP BY lang"


def text_files(spark, sf_dir):
    """A folder of text files per language."""
    place = folder(spark, "scan")
    views.table(spark, sf_dir, "documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(place)
    return place


def files_by_lang(found):
    """What of the files was found: all bytes, and no file twice."""
    lang = F.regexp_extract("path", "lang=([^/]+)/", 1)
    return found.groupBy(lang.alias("lang")).agg(F.sum("length").alias("bytes"), (F.count("path") == F.count_distinct("path")).alias("each_once"))


@query("scan_files_a01", FILES_SQL)
def scan_files(spark, sf_dir):
    return files_by_lang(office.scan_files(spark, text_files(spark, sf_dir), ("txt",)))


@query(
    "deck_elements_a02",
    f"""WITH RECURSIVE {ELEMENTS}, flat AS (SELECT uid, 0 AS depth FROM elements WHERE parent_id IS NULL UNION ALL SELECT e.uid, f.depth + 1 FROM elements e JOIN flat f ON e.parent_uid = f.uid),
child AS (SELECT parent_uid AS uid, arg_min(existing_alt, shape_idx) AS alt FROM elements WHERE trim(existing_alt) <> '' AND shape_type IN ('PICTURE', 'AUTO_SHAPE', 'TEXT_BOX', 'PLACEHOLDER') GROUP BY 1),
e AS (SELECT e.*, depth, alt, shape_type = 'PICTURE' OR (fill_kind = 'picture' AND shape_type NOT IN ('GROUP', 'TABLE', 'CHART')) AS pic FROM elements e JOIN flat USING (uid) LEFT JOIN child USING (uid))
SELECT deck || '.pptx' AS deck, slide_idx, shape_id, instance_key, parent_id, depth, shape_type, shape_name, text, width AS width_px, "left" AS left_px, pic AS has_picture, CASE WHEN pic THEN content_key END AS content_key,
  CASE WHEN shape_type IN ('GROUP', 'TABLE', 'CHART') THEN 'none' ELSE fill_kind END AS fill_kind, has_line AND shape_type NOT IN ('GROUP', 'TABLE', 'CHART') AS has_line,
  coalesce(nullif({q.strip('existing_alt')}, ''), CASE WHEN shape_type = 'GROUP' THEN {q.strip('alt')} END, '') AS existing_alt, left(first_value(slide_notes) OVER (PARTITION BY deck, slide_idx ORDER BY shape_idx), 300) AS slide_notes,
  round(width * 0.75, 6) AS width_pt, CASE WHEN pic THEN 'image' || uid || '.png' END AS file_name, CASE WHEN pic THEN image_hash END AS image_hash, false AS marked_decorative FROM e""",
)
def deck_elements(spark, sf_dir):
    found, _ = office.deck_elements(packages(views.elements(spark, sf_dir), "pptx"))
    return found.select(
        "deck", "slide_idx", "shape_id", "instance_key", "parent_id", "depth", "shape_type", "shape_name", "text", "width_px", "left_px",
        "has_picture", F.when(F.col("has_picture"), F.col("content_key")).alias("content_key"), "fill_kind", "has_line", "existing_alt",
        "slide_notes", F.round("bbox.width", 6).alias("width_pt"), "file_name", "image_hash", "marked_decorative",
    )


@query(
    "document_drawings_a03",
    f"""WITH {ELEMENTS} SELECT deck || '.docx' AS deck, CASE WHEN slide_idx = 0 THEN 'word/header1.xml' ELSE 'word/document.xml' END AS part, shape_name AS name, existing_alt AS descr, width * height AS pixels,
  CASE WHEN shape_type = 'PICTURE' THEN left(content_key, 16) END AS image_hash FROM elements""",
)
def document_drawings(spark, sf_dir):
    found, _ = office.document_drawings(packages(views.elements(spark, sf_dir), "docx"))
    return found.select("deck", "part", "name", "descr", "pixels", "image_hash")


def entries(spark, sf_dir):
    return image_number(decided(spark, sf_dir).select(
        F.col("instance_key").alias("key"), "instance_key", "content_key", "image_hash", "deck", "slide_idx", "shape_idx", "shape_type", "existing_alt",
        F.lit("").alias("current_alt"), F.col("decided_alt").alias("final_alt"), F.lit("").alias("suggested_alt"), "decision_reason",
        F.col("decision_source").alias("source"), "model_called", F.col("width").alias("width_px"), F.col("height").alias("height_px"),
    ))


@query(
    "manifest_a04",
    f"""WITH {DECIDED_SQL} SELECT deck, instance_key AS key, content_key, shape_type, existing_alt, existing_alt AS current_alt, trim(existing_alt) <> '' AS had_existing_alt, decision_reason,
  CASE decision_reason WHEN 'preserve_existing' THEN existing_alt WHEN 'cached' THEN cached_alt WHEN 'already_generated' THEN final_alt ELSE '' END AS suggested_alt,
  row_number() OVER (PARTITION BY deck ORDER BY slide_idx, shape_idx) AS image_number FROM decided""",
)
def manifest(spark, sf_dir):
    place = folder(spark, "manifest")
    tables.write_manifest(entries(spark, sf_dir).drop("shape_idx"), place, by="deck")
    found, _ = tables.read_manifest(spark, place)
    return found.select(
        "deck", "key", "content_key", "shape_type", "existing_alt", "current_alt", "had_existing_alt", "decision_reason", "suggested_alt",
        F.col("image_number").cast("bigint").alias("image_number"),
    )


@query(
    "manifest_export_a05",
    f"WITH {ELEMENTS} SELECT CAST(count(*) AS BIGINT) AS entries, CAST(1 AS BIGINT) AS headers, count(DISTINCT instance_key) AS keys FROM elements",
)
def manifest_export(spark, sf_dir):
    place = folder(spark, "manifest")
    tables.write_manifest(views.elements(spark, sf_dir).select(F.col("instance_key").alias("key"), "existing_alt"), place)
    lines = spark.read.text(place)
    header = F.coalesce(F.get_json_object("value", "$._type") == tables.HEADER, F.lit(False))
    return lines.agg(
        F.count_if(~header).alias("entries"), F.count_if(header).alias("headers"),
        F.count_distinct(F.get_json_object("value", "$.key")).alias("keys"),
    )


MAP_SQL = f"""{ELEMENTS}, m AS (SELECT deck, instance_key AS key, CASE WHEN width % 2 = 0 THEN '' ELSE {q.strip('existing_alt')} END AS existing_alt,
   {q.strip('generated_alt')} AS generated_alt, 'pptx' AS source_existing, CASE WHEN width % 2 = 0 THEN 'llava' ELSE 'model' END AS source_generated,
   CASE WHEN width % 2 = 0 THEN nullif({q.strip('generated_alt')}, '') ELSE nullif({q.strip('final_alt')}, '') END AS final_alt, CASE WHEN width % 2 = 1 THEN 'use_generated' END AS decision FROM elements)"""


def stored_map(spark, sf_dir):
    """A final map per deck: half records, half plain texts of older runs."""
    e = views.elements(spark, sf_dir)
    record = F.to_json(
        F.struct("existing_alt", "generated_alt", F.lit(" ").alias("source_existing"), F.lit("model").alias("source_generated"), "final_alt", F.lit("use_generated").alias("decision"))
    )
    value = F.when(F.col("width") % 2 == 0, F.col("generated_alt")).otherwise(record)
    place = folder(spark, "map")
    tables.write_json_map(e.withColumn("v", value), "instance_key", F.col("v"), "deck", place)
    return place


@query("alt_map_a06", f"WITH {MAP_SQL} SELECT * FROM m")
def alt_map(spark, sf_dir):
    return tables.read_alt_map(spark, stored_map(spark, sf_dir))


@query(
    "stages_a07",
    f"WITH {ELEMENTS} SELECT 'current' AS stage, deck, instance_key AS key, 'new ' || shape_type AS text FROM elements UNION ALL SELECT 'generated', deck, instance_key, generated_alt FROM elements",
)
def stages(spark, sf_dir):
    place = folder(spark, "stages")
    e = views.elements(spark, sf_dir).withColumnRenamed("instance_key", "key")
    tables.write_stage(e.select("deck", "key", F.col("existing_alt").alias("text")), place, "current", "run1")
    tables.write_stage(e.select("deck", "key", F.col("generated_alt").alias("text")), place, "generated", "run1")
    tables.write_stage(e.select("deck", "key", F.concat(F.lit("new "), "shape_type").alias("text")), place, "current", "run1")
    read = [tables.read_stage(spark, place, s, "run1").select(F.lit(s).alias("stage"), "deck", "key", "text") for s in ("current", "generated")]
    return read[0].unionByName(read[1])


@query("alt_cache_a08", f"WITH {ELEMENTS} SELECT DISTINCT deck, image_hash, slide_text AS alt FROM elements")
def alt_cache(spark, sf_dir):
    e = views.elements(spark, sf_dir).select("deck", "image_hash", "slide_text").distinct()
    place = folder(spark, "cache")
    tables.write_json_map(e, "image_hash", F.col("slide_text"), "deck", place)
    none = tables.read_alt_cache(spark, folder(spark, "absent"))
    return tables.read_alt_cache(spark, place).unionByName(none, allowMissingColumns=True)


@query(
    "coverage_report_a09",
    f"""WITH {OUTCOMES_SQL} SELECT deck, count(*) AS total_elements, CAST(count_if(outcome = 'preserved') AS BIGINT) AS preserved, CAST(count_if(outcome = 'generated') AS BIGINT) AS generated,
  CAST(count_if(outcome IN ('failed', 'invalid')) AS BIGINT) AS needs_alt, CAST(count_if(outcome = 'decorative') AS BIGINT) AS decorative_skipped, CAST(count_if(outcome IN ('preserved', 'generated')) AS BIGINT) AS covered_elements,
  round(count_if(outcome IN ('preserved', 'generated')) * 100 / count(*), 6) AS coverage_percent, round(count_if(outcome = 'generated') * 100 / count(*), 6) AS descriptive_percent,
  round(count_if(outcome = 'decorative') * 100 / count(*), 6) AS decorative_percent FROM o GROUP BY deck""",
)
def coverage_report(spark, sf_dir):
    place = folder(spark, "coverage")
    tables.write_coverage(agg.coverage(outcomes(spark, sf_dir)), place)
    counts = ["total_elements", "preserved", "generated", "needs_alt", "decorative_skipped", "covered_elements"]
    shares = ["coverage_percent", "descriptive_percent", "decorative_percent"]
    return spark.read.schema(", ".join([*[f"{c} bigint" for c in counts], *[f"{c} double" for c in shares], "deck string"])).json(place)


@query(
    "audit_csv_a10",
    f"""WITH {ELEMENTS} SELECT deck AS filename, CAST(slide_idx + 1 AS VARCHAR) AS slide_number, slide_text AS alt_text, CAST(existing_alt = '' AS VARCHAR) AS is_missing_alt, 'small; ' || fill_kind AS notes, instance_key AS image_id,
  CAST(shape_idx AS VARCHAR) AS image_index, 't.png' AS thumbnail_path, 'o.png' AS original_filename, 'false' AS is_possible_decorative, 'i.png' AS image_filename, shape_name FROM elements""",
)
def audit_csv(spark, sf_dir):
    place = folder(spark, "audit")
    e = views.elements(spark, sf_dir).select(
        F.col("deck").alias("filename"), (F.col("slide_idx") + 1).alias("slide_number"), F.col("shape_idx").alias("image_index"),
        F.col("slide_text").alias("alt_text"), (F.col("existing_alt") == "").alias("is_missing_alt"), F.lit("t.png").alias("thumbnail_path"),
        F.lit("o.png").alias("original_filename"), F.lit(False).alias("is_possible_decorative"), F.array(F.lit("small"), "fill_kind").alias("notes"),
        F.lit("i.png").alias("image_filename"), "shape_name", F.col("instance_key").alias("image_id"),
    )
    tables.write_audit_csv(e, place)
    return tables.read_audit_csv(spark, place)


@query(
    "decision_log_a11",
    f"""WITH {DECIDED_SQL} SELECT instance_key AS key, to_json({{'key': instance_key, 'image_hash': image_hash, 'mode': 'preserve', 'alt_used': existing_alt,
  'source': CASE decision_reason WHEN 'preserve_existing' THEN 'existing' WHEN 'policy_excluded' THEN 'excluded' WHEN 'needs_generation' THEN 'generated' ELSE 'cached' END, 'model_called': model_called, 'reasoning': decision_reason}})::VARCHAR AS entry FROM decided""",
)
def decision_log(spark, sf_dir):
    d = decided(spark, sf_dir).select(
        F.col("instance_key").alias("key"), "image_hash", F.lit("preserve").alias("mode"), F.col("existing_alt").alias("alt_used"),
        F.col("decision_source").alias("source"), "model_called", F.col("decision_reason").alias("reasoning"),
    )
    return tables.decision_log(d)


@query(
    "load_ledger_a12",
    f"""WITH {views.LEDGER_SQL} SELECT path, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status, CASE WHEN status <> 'processing' THEN added_at END AS started_at FROM ledger""",
)
def load_ledger(spark, sf_dir):
    work = views.ledger(spark, sf_dir).select("path", "status", F.col("added_at").alias("started_at"))
    return tables.load_ledger(work)


@query(
    "review_table_a13",
    f"""WITH {DECIDED_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY deck ORDER BY slide_idx, shape_idx) AS img, {q.strip('generated_alt')} AS g, {q.strip('existing_alt')} AS c, nullif({q.strip('final_alt')}, '') AS f FROM decided)
SELECT deck, (slide_idx + 1) || '/' || img AS label, CASE WHEN parent_id IS NOT NULL THEN 'Group child: ' ELSE '' END || CASE shape_type WHEN 'PICTURE' THEN 'Image' WHEN 'AUTO_SHAPE' THEN 'PowerPoint shape' WHEN 'TEXT_BOX' THEN 'Text box'
   WHEN 'LINE' THEN 'Line' WHEN 'CONNECTOR' THEN 'Connector line' WHEN 'TABLE' THEN 'Table' WHEN 'GROUP' THEN 'Group parent' WHEN 'PLACEHOLDER' THEN 'Placeholder' ELSE 'Chart' END AS type,
  CASE WHEN c = '' THEN '[No ALT text]' ELSE c END AS current,
  CASE decision_reason WHEN 'preserve_existing' THEN '(Leave blank to keep current, or type replacement)' WHEN 'cached' THEN coalesce(final_alt, '[Generation failed]') WHEN 'needs_generation' THEN '[Generate needed]'
    WHEN 'policy_excluded' THEN '[Excluded]' ELSE coalesce(final_alt, '[No suggested ALT]') END AS suggested,
  CASE WHEN g <> '' AND f = g THEN 'Use generated' WHEN c <> '' AND f = c THEN 'Preserve existing' WHEN f IS NOT NULL THEN 'Custom ALT' WHEN g <> '' AND c <> '' THEN 'Existing + Generated' WHEN g <> '' THEN 'Generated available'
    WHEN c <> '' THEN 'Existing only' ELSE 'No ALT available' END AS status, 'Existing: pptx • Generated: llava' AS notes FROM n""",
)
def review_table(spark, sf_dir):
    d = decided(spark, sf_dir)
    numbered = image_number(d.select("instance_key", "deck", "slide_idx", "shape_idx")).select("deck", "instance_key", "image_number")
    left = d.join(numbered, ["deck", "instance_key"]).select(
        F.col("instance_key").alias("key"), "deck", "slide_idx", "image_number", "shape_type", "parent_id", "existing_alt", "decision_reason"
    )
    right = d.select(
        "deck", F.col("instance_key").alias("key"), "final_alt", "generated_alt", F.lit("").alias("decision"),
        F.lit("pptx").alias("source_existing"), F.lit("llava").alias("source_generated"),
    )
    return tables.review_table(left, right)


@query(
    "exchange_a14",
    f"""WITH {MAP_SQL} SELECT m.*, shape_type FROM m JOIN elements ON m.deck = elements.deck AND key = instance_key""",
)
def exchange(spark, sf_dir):
    place = folder(spark, "export")
    tables.export_elements(views.elements(spark, sf_dir).select("deck", F.col("instance_key").alias("key"), "shape_type"), place)
    exported = spark.read.schema("deck string, key string, shape_type string").json(place)
    return tables.import_map(spark, stored_map(spark, sf_dir)).join(exported, ["deck", "key"])


# --- providers --------------------------------------------------------------------


def recorded(spark, sf_dir):
    """Provider calls by the content they were made for: a user's calls of one kind of work."""
    a = views.attempts(spark, sf_dir)
    return a.withColumn("content_key", F.concat(F.lit("c"), (F.col("attempt_id") % 1009).cast("string")))


CHAIN_SQL = f"""{views.ATTEMPTS_SQL}, t AS (SELECT *, 'c' || (attempt_id % 1009) AS content_key, row_number() OVER (PARTITION BY attempt_id % 1009 ORDER BY ts, attempt_id) AS turn FROM attempts),
w AS (SELECT content_key, max(turn) AS last, min(CASE WHEN success AND turn <= {{most}} THEN turn END) AS won FROM t GROUP BY 1),
c AS (SELECT content_key, last, won, coalesce(won, least(last, {{most}})) AS ends FROM w),
used AS (SELECT t.*, won, ends, last FROM t JOIN c USING (content_key) WHERE turn <= ends)"""
CHAINED_SQL = """SELECT content_key, max(CASE WHEN turn = won THEN provider END) AS provider, CASE WHEN max(won) IS NULL THEN 'fail' ELSE 'ok' END AS status, CAST(max(ends) AS INT) AS attempts,
  round(sum(cost), 6) AS cost, max(won) IS NULL AND max(last) > {most} AS cut FROM used GROUP BY 1"""


@query("generate_u01", f"WITH {CHAIN_SQL.format(most=1)} {CHAINED_SQL.format(most=1)}")
def generate(spark, sf_dir):
    return provider.recorded_chain(recorded(spark, sf_dir), "content_key", ["ts", "attempt_id"], 1).withColumn("cost", F.round("cost", 6))


@query("generate_chain_u02", f"WITH {CHAIN_SQL.format(most=3)} {CHAINED_SQL.format(most=3)}")
def generate_chain(spark, sf_dir):
    return provider.recorded_chain(recorded(spark, sf_dir), "content_key", ["ts", "attempt_id"], 3).withColumn("cost", F.round("cost", 6))


@query(
    "attempt_rows_u02",
    f"""WITH {CHAIN_SQL.format(most=3)} SELECT provider, success, status_code, error, count(*) AS calls, round(CAST(sum(CAST(cost AS DECIMAL(20,6))) AS DOUBLE), 6) AS cost FROM used GROUP BY ALL""",
)
def attempt_rows(spark, sf_dir):
    order = ["ts", "attempt_id"]
    calls = recorded(spark, sf_dir)
    used = provider.recorded_attempts(provider.recorded_chain(calls, "content_key", order), calls, "content_key", order)
    return used.groupBy("provider", "success", "status_code", "error").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("cost").cast("decimal(20,6)")).cast("double"), 6).alias("cost")
    )


# --- from packages to coverage ------------------------------------------------------


def written_back(spark, sf_dir):
    """Packages of many decks, scanned, planned, patched, read back and checked."""
    found, _ = office.deck_elements(packages(views.elements(spark, sf_dir), "pptx"))
    scanned = found.select("deck", F.col("instance_key").alias("key"), "shape_type", "existing_alt")
    texts = views.elements(spark, sf_dir).select(
        F.concat("deck", F.lit(".pptx")).alias("deck"), F.col("instance_key").alias("key"), "generated_alt", "final_alt", "width"
    )
    e = materialize(scanned.join(texts, joins.KEY))
    plan = e.withColumn("plan", classify.write_plan("existing_alt", "generated_alt", "final_alt", "preserve")).filter("plan.should_write").select(
        *joins.KEY, F.col("plan.final_alt").alias("text"), F.col("shape_type").alias("kind"), F.lit(True).alias("is_generated"),
        F.lit(False).alias("is_fallback"), (F.col("plan.decision") == "written_final").alias("forced"),
    )
    current = e.select(*joins.KEY, F.col("existing_alt").alias("text"))
    none = spark.createDataFrame([], "deck string, key string, text_hash string")
    ready = materialize(patch.ready_texts(plan))
    rows = materialize(patch.changes(ready, current, none))
    after = materialize(patch.apply_patch(e.select(*joins.KEY, "existing_alt"), rows))
    again = patch.changes(ready, after.select(*joins.KEY, F.col("existing_alt").alias("text")), rows.select(*joins.KEY, "text_hash"))
    checked = joins.verify(
        rows.select(*joins.KEY, F.col("new_alt").alias("text")), after.select(*joins.KEY, F.col("existing_alt").alias("text"))
    )
    per_deck = after.groupBy("deck").agg(
        F.count(F.lit(1)).alias("elements"), F.count_if(F.col("outcome").isin("insert", "replace")).alias("written"),
        F.count_if(F.col("outcome") == "preserved").alias("preserved"), F.count_if(F.col("existing_alt") != "").alias("covered"),
    )
    verified = checked.groupBy("deck").agg(F.count_if("exact").alias("verified"))
    second = again.groupBy("deck").agg(F.count(F.lit(1)).alias("second_run"))
    zero = F.lit(0).cast("bigint")
    return per_deck.join(verified, "deck", "left").join(second, "deck", "left").select(
        "deck", "elements", "written", "preserved", "covered", F.coalesce("verified", zero).alias("verified"), F.coalesce("second_run", zero).alias("second_run")
    )


SCANNED_SQL = f"""{ELEMENTS.replace('elements AS (', 'raw AS (', 1)}, child AS (SELECT parent_uid AS uid, arg_min(existing_alt, shape_idx) AS alt FROM raw
   WHERE trim(existing_alt) <> '' AND shape_type IN ('PICTURE', 'AUTO_SHAPE', 'TEXT_BOX', 'PLACEHOLDER') GROUP BY 1),
elements AS (SELECT r.* REPLACE (r.deck || '.pptx' AS deck, coalesce(nullif({q.strip('r.existing_alt')}, ''), CASE WHEN r.shape_type = 'GROUP' THEN {q.strip('alt')} END, '') AS existing_alt) FROM raw r LEFT JOIN child USING (uid))"""


@query(
    "pipeline_a02",
    f"""WITH {PATCH_SQL.replace(ELEMENTS, SCANNED_SQL, 1).replace(' AND width % 4 <> 0', '')},
after AS (SELECT elements.deck, change, coalesce(new_alt, existing_alt) AS alt, lower({q.strip('existing_alt')}) NOT IN ({q.quoted(fixed.SKIP_TOKENS)}) AS real FROM elements LEFT JOIN patch ON patch.deck = elements.deck AND patch.key = instance_key)
SELECT deck, count(*) AS elements, count(change) AS written, count_if(change IS NULL AND real) AS preserved, count_if(alt <> '') AS covered, count(change) AS verified, CAST(0 AS BIGINT) AS second_run FROM after GROUP BY deck""",
)
def pipeline(spark, sf_dir):
    return written_back(spark, sf_dir)
