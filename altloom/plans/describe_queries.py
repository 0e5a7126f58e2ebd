"""Contexts, prompts, descriptions and review texts over the element table."""

from __future__ import annotations

from pyspark.sql import functions as F

from altloom import views
from altloom.functions import describe, fixed, geometry, review
from altloom.functions.base import col
from altloom.plans import sql as q
from altloom.plans.registry import query

FRAGMENTS = {"Edges": ["ing", "eux"], "Middles": ["tion", "keit"], "Ends": ["est "], "Never": ["qqq"]}
PROMPT_WORDS = [("alpha", ["eauxeux", "keitkeit"]), ("beta", ["thethe", "dadad"]), ("gamma", ["ingeder", "ouaient"])]
AUTO_TYPES = ["RECTANGLE", "OVAL", "STAR_8_POINT", "STAR_5_POINT", "LEFT_RIGHT_ARROW", "FLOWCHART_DECISION", "FUNNEL"]
GEOMETRY_NAMES = ["Oval 1", "Square 2", "Line 3", "Right Arrow 4", "Hexagon 5", "Triangle 6", "Blob 7", ""]


def over_elements(name, check, *, base=None, **columns):
    """Register a query that adds columns to every element."""

    def run(spark, sf_dir):
        e = views.elements(spark, sf_dir)
        e = e if base is None else base(e)
        return e.select("shape_id", *[make().alias(alias) for alias, make in columns.items()])

    head = f"WITH {views.ELEMENTS_SQL}"
    return query(name, head + (check if check.startswith(",") else " " + check))(run)


SIZE = "CASE WHEN {w} > 0 AND {h} > 0 THEN '(' || {w} || '{x}' || {h} || '{u})' ELSE '' END"


def sized(w="width", h="height", x="x", u="px"):
    return SIZE.format(w=w, h=h, x=x, u=u)


def spaced(*parts):
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda p: p <> ''), ' ')"


THREEFOLD = """CASE WHEN width <= 0 OR height <= 0 THEN '' WHEN width > height * 3 THEN 'horizontal'
   WHEN height > width * 3 THEN 'vertical' ELSE 'diagonal' END"""
BANDS = """CASE WHEN width <= 0 OR height <= 0 THEN '' WHEN width / height > 3 THEN 'horizontal'
   WHEN width / height < 0.33 THEN 'vertical' WHEN width / height BETWEEN 0.8 AND 1.2 THEN 'diagonal' ELSE '' END"""
PIXELS = """CASE WHEN height < 10 AND width > height * 3 THEN 'horizontal' WHEN width < 10 AND height > width * 3 THEN 'vertical'
   ELSE 'diagonal' END"""
ARTICLE = "CASE WHEN regexp_matches({n}, '^[aeiou8]') THEN 'an' ELSE 'a' END"

CONTEXT = f"""concat_ws(chr(10), CASE WHEN slide_idx + 1 <> 0 THEN 'Slide: ' || (slide_idx + 1) END,
   'Shape: A ' || lower(shape_type) || CASE WHEN width > 0 AND height > 0 THEN ' sized ' || width || 'x' || height || ' pixels' ELSE '' END,
   CASE WHEN {q.strip('slide_text')} <> '' THEN 'Slide text: ' || left({q.strip('slide_text')}, 200) END,
   CASE WHEN {q.strip('slide_notes')} <> '' THEN 'Notes: ' || left({q.strip('slide_notes')}, 100) END)"""

over_elements(
    "build_context_b32",
    f"""SELECT shape_id, {CONTEXT} AS context,
  concat_ws('. ', CASE WHEN slide_text <> '' THEN 'Slide content: ' || slide_text END, 'Slide ' || (slide_idx + 1),
    CASE WHEN shape_id % 2 = 0 THEN 'File: ' || 'img_' || shape_id || '.png' END) AS image_context FROM elements""",
    context=lambda: describe.build_context(col("slide_idx") + 1, "shape_type", "width", "height", "slide_text", "slide_notes"),
    image_context=lambda: describe.build_image_context(
        "slide_text",
        "slide_idx",
        F.concat(F.when(col("shape_id") % 2 == 0, "img_").otherwise("slide_"), col("shape_id").cast("string"), F.lit(".png")),
    ),
)

TEMPLATES = {"default": "Describe it.", "chart": "Describe the chart.", "table": "Describe the table."}
over_elements(
    "build_prompt_b33",
    f"""SELECT shape_id, CASE lower(shape_type) WHEN 'chart' THEN 'Describe the chart.' WHEN 'table' THEN 'Describe the table.'
   ELSE 'Describe it.' END || chr(10) || chr(10) || 'Context: ' || {q.strip('slide_text')} || chr(10) || chr(10) || 'Be brief.' AS prompt FROM elements""",
    prompt=lambda: describe.build_prompt(F.lower(col("shape_type")), "slide_text", TEMPLATES, "Be brief."),
)

over_elements(
    "prompt_type_b34",
    f""", t AS (SELECT shape_id, lower(shape_name || ' ' || slide_text) AS t, lower(shape_name) AS n FROM elements)
SELECT shape_id, CASE {' '.join(f"WHEN {q.contains_any('t', ws)} THEN '{k}'" for k, ws in PROMPT_WORDS)} ELSE 'default' END AS by_words,
  CASE {' '.join(f"WHEN {q.contains_any('n', ws)} THEN '{k}'" for k, ws in fixed.PROMPT_RULES)} ELSE 'default' END AS by_name FROM t""",
    by_words=lambda: describe.prompt_type("shape_name", "slide_text", PROMPT_WORDS),
    by_name=lambda: describe.prompt_type("shape_name", F.lit("")),
)

FRAGMENT_MAP = {w: k for k, ws in FRAGMENTS.items() for w in ws}
over_elements(
    "concepts_b35",
    f""", t AS (SELECT shape_id, lower(slide_text) AS t FROM elements)
SELECT shape_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {q.contains_any('t', ws)} THEN '{k}' END" for k, ws in sorted(FRAGMENTS.items()))}],
   lambda x: x IS NOT NULL), '|') AS concepts,
  CASE {' '.join(f"WHEN contains(t, '{w}') THEN '{k}'" for w, k in FRAGMENT_MAP.items())} ELSE '' END AS first_concept FROM t""",
    concepts=lambda: F.array_join(describe.concepts("slide_text", FRAGMENT_MAP), "|"),
    first_concept=lambda: describe.first_concept("slide_text", FRAGMENT_MAP),
)

LABELS = """CASE shape_type WHEN 'TEXT_BOX' THEN 'Text box' WHEN 'AUTO_SHAPE' THEN 'PowerPoint shape'
   WHEN 'LINE' THEN CASE d WHEN '' THEN 'Line element' WHEN 'horizontal' THEN 'Horizontal line' WHEN 'vertical' THEN 'Vertical line' ELSE 'Diagonal line' END
   WHEN 'CONNECTOR' THEN 'Connector line' WHEN 'TABLE' THEN 'Table' WHEN 'GROUP' THEN 'Grouped elements' ELSE 'PowerPoint shape element' END"""
FALLBACK = (
    "CASE WHEN parent_id IS NOT NULL THEN 'Part of a grouped element: ' ELSE '' END || "
    + spaced(LABELS, sized(x="×"))
    + " || '.'"
)
over_elements(
    "describe_shape_b36",
    f""", e AS (SELECT *, {THREEFOLD} AS d, lower(replace(shape_type, '_', ' ')) AS n FROM elements)
SELECT shape_id, {FALLBACK} AS fallback,
  CASE WHEN shape_type IN ('LINE', 'CONNECTOR') THEN CASE WHEN d = '' THEN 'diagonal' ELSE d END || ' line' ELSE 'shape' END
    || ' (' || width || '×' || height || 'px)' AS stub,
  {spaced(ARTICLE.format(n='n') + " || ' ' || n || '.'", sized())} AS phrase FROM e""",
    fallback=lambda: describe.describe_shape("shape_type", "width", "height", col("parent_id").isNotNull()),
    stub=lambda: describe.stub("shape_type", "width", "height"),
    phrase=lambda: describe.type_phrase(F.concat("shape_type", F.lit(" (13)")), "width", "height"),
)

ELEMENT_TEXT = spaced(
    "'A ' || t",
    "CASE WHEN width > 0 AND height > 0 THEN 'sized ' || width || 'x' || height || ' pixels' ELSE '' END",
    "CASE WHEN text <> '' THEN 'containing text: ''' || CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END || '''' ELSE '' END",
    "CASE WHEN shape_name <> '' THEN 'named ''' || shape_name || '''' ELSE '' END",
    "CASE WHEN top < 200 THEN 'located in the upper area of the slide' WHEN top > 400 THEN 'located in the lower area of the slide' ELSE '' END",
)
AUTO_NAME = """CASE WHEN shape_type <> 'AUTO_SHAPE' THEN CASE shape_type WHEN 'LINE' THEN 'line' WHEN 'TEXT_BOX' THEN 'text box'
    WHEN 'CHART' THEN 'chart' WHEN 'TABLE' THEN 'table' WHEN 'PICTURE' THEN 'picture' WHEN 'PLACEHOLDER' THEN 'placeholder'
    WHEN 'GROUP' THEN 'group of shapes' ELSE 'shape' END
  ELSE ['rectangle','oval','8-point star','5-point star','left-right arrow','flowchart decision diamond','auto shape'][width % 7 + 1] END"""
over_elements(
    "describe_element_b37",
    f""", e AS (SELECT *, lower(shape_type) AS t, {BANDS} AS d, {AUTO_NAME} AS an FROM elements)
SELECT shape_id, CASE WHEN t IN ('line', 'connector') THEN {spaced('d', "CASE WHEN has_line THEN 'colored' ELSE '' END", 't')}
   ELSE {ELEMENT_TEXT} END AS description,
  {spaced(ARTICLE.format(n='an'), "CASE WHEN shape_type = 'LINE' THEN " + spaced('d', 'an') + " ELSE an END", sized())} AS named FROM e""",
    description=lambda: describe.describe_element(
        F.lower(col("shape_type")), "width", "height", "text", "shape_name", "top", col("has_line")
    ),
    named=lambda: describe.describe_named("shape_type", views.pick(AUTO_TYPES, col("width")), "width", "height"),
)

COLOUR = """CASE WHEN r > 200 AND g < 100 AND b < 100 THEN 'red' WHEN r < 100 AND g > 200 AND b < 100 THEN 'green'
  WHEN r < 100 AND g < 100 AND b > 200 THEN 'blue' WHEN r > 200 AND g > 200 AND b < 100 THEN 'yellow'
  WHEN r > 200 AND g < 150 AND b > 200 THEN 'purple' WHEN r > 200 AND g > 150 AND b < 100 THEN 'orange'
  WHEN r < 100 AND g < 100 AND b < 100 THEN 'black' WHEN r > 200 AND g > 200 AND b > 200 THEN 'white'
  WHEN r > 100 AND g > 100 AND b > 100 THEN 'gray' ELSE '' END"""


def coloured(word):
    return f"CASE WHEN c = '' THEN '{word.capitalize()}' ELSE c || '{word}' END"


ARROW = spaced("c", "CASE WHEN d = 'diagonal' THEN '' ELSE d END", "'arrow'")
over_elements(
    "describe_geometry_b38",
    f""", g AS (SELECT *, ['Oval 1','Square 2','Line 3','Right Arrow 4','Hexagon 5','Triangle 6','Blob 7',''][top % 8 + 1] AS n,
   CASE WHEN width % 4 > 0 THEN (width * 3) % 256 END AS r, (height * 5) % 256 AS g, (top * 7) % 256 AS b, {PIXELS} AS d FROM elements),
h AS (SELECT *, CASE WHEN r IS NULL THEN '' ELSE {COLOUR} || ' ' END AS c FROM g)
SELECT shape_id, CASE WHEN shape_type = 'PICTURE' THEN CASE WHEN n <> '' THEN 'Image: ' || n ELSE 'Image' END
  WHEN contains(n, 'Oval') OR contains(n, 'Circle') THEN {coloured('circle')}
  WHEN contains(n, 'Rectangle') OR contains(n, 'Square') THEN {coloured('rectangle')}
  WHEN contains(n, 'Line') OR shape_type = 'CONNECTOR' THEN d || ' line'
  WHEN contains(n, 'Arrow') THEN upper(left({ARROW}, 1)) || lower(substr({ARROW}, 2))
  WHEN contains(n, 'Hexagon') THEN {coloured('hexagon')} WHEN contains(n, 'Triangle') THEN {coloured('triangle')}
  WHEN n <> '' THEN 'Shape: ' || n ELSE 'Geometric shape (' || shape_type || ')' END AS description FROM h""",
    description=lambda: describe.describe_geometry(
        views.pick(GEOMETRY_NAMES, col("top")),
        "shape_type",
        F.when(col("width") % 4 > 0, (col("width") * 3) % 256),
        (col("height") * 5) % 256,
        (col("top") * 7) % 256,
        "width",
        "height",
    ),
)

over_elements(
    "line_direction_b39",
    f"SELECT shape_id, {THREEFOLD} AS threefold, {BANDS} AS bands, {PIXELS} AS pixels FROM elements",
    threefold=lambda: geometry.line_direction("width", "height"),
    bands=lambda: geometry.line_direction("width", "height", "bands"),
    pixels=lambda: geometry.line_direction("width", "height", "pixels"),
)

OPENING = f"array_to_string(string_split({q.squash('slide_text')}, ' ')[1:15], ' ')"
over_elements(
    "describe_vector_b40",
    f""", v AS (SELECT *, lower(slide_text) AS t, {OPENING} AS o, CASE WHEN height > 0 THEN width / height ELSE 1 END AS ratio FROM elements),
k AS (SELECT *, CASE WHEN {q.contains_any('t', describe.VECTOR_WORDS)} THEN
     CASE {' '.join(f"WHEN {q.contains_any('t', ws)} THEN '{k}'" for k, ws in describe.VECTOR_KINDS)} ELSE 'technical diagram' END
   WHEN ratio > 1.5 THEN 'horizontal diagram' WHEN ratio < 0.67 THEN 'vertical diagram' ELSE 'diagram' END AS kind FROM v)
SELECT shape_id, {q.strip("regexp_replace('Vector ' || kind || ' (EMF format)' || CASE WHEN width <> 0 AND height <> 0 THEN ' (' || width || '×' || height || ' pixels)' ELSE '' END || ' related to: ' || CASE WHEN length(o) > 100 THEN left(o, 97) || '...' ELSE o END || '. Note: Original EMF vector image could not be processed for detailed analysis.', '[ ]+([.,])', '\\1', 'g')")} AS vector,
  {spaced("'Freeform shape representing'", "CASE " + ' '.join("WHEN " + q.contains_any('lower(shape_name)', ws) + " OR " + q.contains_any('t', ws) + f" THEN 'an {k} icon'" for k, ws in describe.ICON_WORDS) + " WHEN width < 50 AND height < 50 THEN 'a small icon or symbol' WHEN width > 200 OR height > 200 THEN 'a large decorative shape' ELSE 'an icon or symbol' END", sized())} AS freeform FROM k""",
    vector=lambda: describe.describe_vector("slide_text", "width", "height", "EMF"),
    freeform=lambda: describe.describe_freeform("shape_name", "slide_text", "width", "height"),
)


def prompted():
    kind = F.lower(col("shape_type"))
    told = describe.describe_element(
        F.when(kind == "line", "straight").when(kind == "connector", "joint").otherwise(kind),
        "width", "height", F.lit(""), F.lit(""), F.lit(300), F.lit(False),
    )
    return F.concat(F.lit("Slide: 1\nShape: "), told, F.lit("\nNotes: a b"))


over_elements(
    "parse_shape_prompt_b41",
    f""", e AS (SELECT *, CASE lower(shape_type) WHEN 'line' THEN 'straight' WHEN 'connector' THEN 'joint'
    WHEN 'text_box' THEN 'text box' WHEN 'auto_shape' THEN 'shape' ELSE lower(shape_type) END AS n FROM elements)
SELECT shape_id, {spaced("'This is a PowerPoint shape. It is a ' || n", sized())} AS parsed FROM e""",
    parsed=lambda: describe.parse_shape_prompt(prompted()),
)

over_elements(
    "unit_conversion_b42",
    """, e AS (SELECT *, width * 12700 AS w, height * 12701 AS h FROM elements)
SELECT shape_id, CAST(trunc(w * 96.0 / 914400) AS INT) AS px, CAST(round_even(h / 9525.0, 0) AS INT) AS px_rounded, round(w * 72.0 / 914400, 6) AS pt,
  width * height AS area, CASE WHEN width > 0 AND height > 0 THEN round(greatest(width, height) / least(width, height), 6) END AS ratio FROM e""",
    px=lambda: geometry.emu_to_px(col("width").cast("bigint") * 12700),
    px_rounded=lambda: geometry.emu_to_px_rounded(col("height").cast("bigint") * 12701),
    pt=lambda: F.round(geometry.emu_to_pt(col("width").cast("bigint") * 12700), 6),
    area=lambda: geometry.area("width", "height"),
    ratio=lambda: F.round(geometry.aspect_ratio("width", "height"), 6),
)

over_elements(
    "parse_area_b43",
    """SELECT shape_id, CAST(trunc((width % 50) / 10.0 * 388800 / 100) AS INT) AS share, height AS pixels, top AS plain FROM elements""",
    share=lambda: geometry.parse_area(F.concat(((col("width") % 50) / 10).cast("string"), F.lit("%"))),
    pixels=lambda: geometry.parse_area(F.concat(col("height").cast("string"), F.lit("px"))),
    plain=lambda: geometry.parse_area(col("top").cast("string")),
)

over_elements(
    "canonical_record_b44",
    f"""SELECT shape_id, {q.strip('existing_alt')} AS existing, nullif({q.strip('final_alt')}, '') AS final, 'scan' AS source,
  coalesce(nullif(existing_alt, ''), 'none') AS current, existing_alt <> '' AS had_existing FROM elements""",
    existing=lambda: review.text_or_blank(F.concat(F.lit(" \t"), "existing_alt", F.lit("\n"))),
    final=lambda: review.text_or_null("final_alt"),
    source=lambda: review.source_or(F.lit("  "), "scan"),
    current=lambda: review.source_or("existing_alt", "none"),
    had_existing=lambda: review.text_or_blank("existing_alt") != "",
)

over_elements(
    "existing_alt_b45",
    f""", e AS (SELECT *, CASE WHEN shape_id % 4 = 0 THEN shape_name ELSE ' ' END AS title, CASE WHEN shape_type = 'GROUP' THEN generated_alt END AS child FROM elements)
SELECT shape_id, coalesce(nullif({q.strip('existing_alt')}, ''), nullif({q.strip('title')}, ''), nullif({q.strip('child')}, ''), '') AS alt,
  CASE WHEN {q.strip('existing_alt')} <> '' THEN 'descr' WHEN {q.strip('title')} <> '' THEN 'title' WHEN child <> '' THEN 'group_child' ELSE 'none' END AS source FROM e""",
    alt=lambda: review.existing_alt("existing_alt", F.when(col("shape_id") % 4 == 0, col("shape_name")).otherwise(" "), F.when(col("shape_type") == "GROUP", col("generated_alt"))),
    source=lambda: review.existing_alt_source("existing_alt", F.when(col("shape_id") % 4 == 0, col("shape_name")).otherwise(" "), F.when(col("shape_type") == "GROUP", col("generated_alt"))),
)


def meaningful(x):
    return f"CASE WHEN lower({q.strip(x)}) NOT IN ({q.quoted(fixed.SKIP_TOKENS)}) THEN {q.strip(x)} END"


over_elements(
    "choose_candidate_b46",
    f"""SELECT shape_id, coalesce({meaningful('final_alt')}, {meaningful('generated_alt')}, {meaningful('existing_alt')}, nullif({q.strip('final_alt')}, '')) AS candidate,
  coalesce(nullif({q.strip('final_alt')}, ''), {q.strip('generated_alt')}) AS suggested,
  coalesce(nullif({q.strip('generated_alt')}, ''), CASE WHEN {q.strip('final_alt')} <> existing_alt THEN {q.strip('final_alt')} END, '') AS generated FROM elements""",
    candidate=lambda: review.choose_candidate("final_alt", "generated_alt", "existing_alt"),
    suggested=lambda: review.suggested_alt("final_alt", "generated_alt"),
    generated=lambda: review.generated_for_review("generated_alt", F.lit(None).cast("string"), "final_alt", "existing_alt"),
)


@query(
    "failure_class_b48",
    f"""WITH {views.ATTEMPTS_SQL} SELECT attempt_id,
  CASE WHEN status_code IN (404, 401, 403) OR {q.contains_any('lower(coalesce(error, $$$$))', fixed.PERMANENT_TEXTS)} THEN 'permanent' ELSE 'temporary' END AS class,
  CAST(least(power(2, tokens % 12), 60) AS INT) AS backoff, CASE WHEN tokens = 0 THEN 0.0 ELSE least(power(2, tokens - 1), 60.0) END AS delay FROM attempts""",
)
def failure_class(spark, sf_dir):
    return views.attempts(spark, sf_dir).select(
        "attempt_id",
        review.failure_class("status_code", "error").alias("class"),
        review.backoff(col("tokens") % 12 + 1).alias("backoff"),
        review.retry_delay("tokens").alias("delay"),
    )


over_elements(
    "report_decision_b49",
    """, e AS (SELECT shape_id, CASE WHEN existing_alt = '' THEN '[No ALT text]' ELSE existing_alt END AS cur,
   CASE WHEN shape_id % 6 = 0 THEN existing_alt WHEN generated_alt = '' THEN '[No suggestion]' ELSE generated_alt END AS sug FROM elements)
SELECT shape_id, CASE WHEN cur <> '[No ALT text]' AND cur = sug THEN 'Preserved' WHEN cur = '[No ALT text]' AND sug <> '[No suggestion]' THEN 'Generated'
   WHEN cur <> '[No ALT text]' AND sug <> '[No suggestion]' THEN 'Replaced' ELSE 'Pending' END AS decision FROM e""",
    base=lambda e: e.select(
        "shape_id",
        F.when(col("existing_alt") == "", review.NO_ALT).otherwise(col("existing_alt")).alias("cur"),
        F.when(col("shape_id") % 6 == 0, col("existing_alt")).when(col("generated_alt") == "", review.NO_SUGGESTION)
        .otherwise(col("generated_alt")).alias("sug"),
    ),
    decision=lambda: review.report_decision("cur", "sug"),
)

REASONS = ["preserve_existing", "generated_new", "cached", "needs_generation", "policy_excluded", "generation_error", "preserved", "other"]
REASON_SQL = "['" + "','".join(REASONS) + "'][width % 8 + 1]"


def with_reason(e):
    return e.withColumn("reason", views.pick(REASONS, col("width")))


over_elements(
    "review_cells_b50",
    f""", e AS (SELECT *, {REASON_SQL} AS reason, nullif(final_alt, '') AS f FROM elements)
SELECT shape_id, coalesce(nullif({q.strip("coalesce(nullif(existing_alt, ''), CASE WHEN reason = 'preserved' THEN final_alt END)")}, ''), '[No ALT text]') AS current_cell,
  CASE WHEN reason = 'preserve_existing' THEN '(Leave blank to keep current, or type replacement)' WHEN reason IN ('generated_new', 'cached') THEN coalesce(f, '[Generation failed]')
    WHEN reason = 'needs_generation' THEN '[Generate needed]' WHEN reason IN ('policy_excluded', 'generation_error') THEN '[Excluded]'
    ELSE coalesce(f, '[No suggested ALT]') END AS suggested_cell,
  CASE WHEN parent_id IS NOT NULL THEN 'Group child: ' ELSE '' END || CASE shape_type WHEN 'PICTURE' THEN 'Image' WHEN 'AUTO_SHAPE' THEN 'PowerPoint shape'
    WHEN 'TEXT_BOX' THEN 'Text box' WHEN 'LINE' THEN 'Line' WHEN 'CONNECTOR' THEN 'Connector line' WHEN 'TABLE' THEN 'Table' WHEN 'GROUP' THEN 'Group parent'
    WHEN 'PLACEHOLDER' THEN 'Placeholder' ELSE 'Chart' END AS type_label FROM e""",
    base=with_reason,
    current_cell=lambda: review.current_cell("existing_alt", F.lit(""), "final_alt", "reason"),
    suggested_cell=lambda: review.suggested_cell("final_alt", "reason"),
    type_label=lambda: review.type_label("shape_type", col("parent_id").isNotNull()),
)

DECISIONS = ["preserve_existing", "use_generated", "needs_review", "written_final", "", "skipped_no_content"]
over_elements(
    "status_label_b51",
    """, e AS (SELECT *, ['preserve_existing','use_generated','needs_review','written_final','','skipped_no_content'][width % 6 + 1] AS decision,
   trim(generated_alt) AS g, trim(existing_alt) AS c, nullif(trim(final_alt), '') AS f,
   ['generated','preserved','NEEDS ALT','AUTO-LOWCONF','FALLBACK_INJECTED','odd'][height % 6 + 1] AS st, ['timeout',''][top % 2 + 1] AS why FROM elements)
SELECT shape_id, CASE WHEN decision <> '' THEN CASE decision WHEN 'preserve_existing' THEN 'Preserve existing' WHEN 'use_generated' THEN 'Use generated'
     WHEN 'needs_review' THEN 'Needs review' WHEN 'written_final' THEN 'Written Final' ELSE 'Skipped No Content' END
   WHEN g <> '' AND f = g THEN 'Use generated' WHEN c <> '' AND f = c THEN 'Preserve existing' WHEN f IS NOT NULL THEN 'Custom ALT'
   WHEN g <> '' AND c <> '' THEN 'Existing + Generated' WHEN g <> '' THEN 'Generated available' WHEN c <> '' THEN 'Existing only' ELSE 'No ALT available' END AS label,
  CASE st WHEN 'generated' THEN 'Generated' WHEN 'preserved' THEN 'Preserved' WHEN 'NEEDS ALT' THEN CASE WHEN why = '' THEN 'Needs ALT' ELSE 'Needs ALT (timeout)' END
    WHEN 'AUTO-LOWCONF' THEN CASE WHEN why = '' THEN 'Auto Low-Confidence' ELSE 'Auto Low-Conf (timeout)' END WHEN 'FALLBACK_INJECTED' THEN 'Fallback Injected' ELSE st END AS display FROM e""",
    label=lambda: review.status_label(views.pick(DECISIONS, col("width")), "final_alt", "generated_alt", "existing_alt"),
    display=lambda: review.status_display(
        views.pick(["generated", "preserved", "NEEDS ALT", "AUTO-LOWCONF", "FALLBACK_INJECTED", "odd"], col("height")),
        views.pick(["timeout", ""], col("top")),
    ),
)

SHOWN = """CASE WHEN existing_alt = '' THEN '[No ALT text]' ELSE existing_alt END AS cur, CASE WHEN existing_alt <> '' AND width % 2 = 0 THEN existing_alt
   WHEN width % 5 = 0 THEN 'FALLBACK: ' || shape_name WHEN generated_alt = '' THEN '[No suggestion]' ELSE generated_alt END AS sug, height < 40 AS deco"""
DERIVED = f"""CASE WHEN deco THEN 'decorative_skipped' WHEN cur <> '[No ALT text]' AND {q.contains_any('lower(cur)', review.GENERIC_PHRASES)} THEN 'fallback_injected'
   WHEN cur <> '[No ALT text]' AND cur = sug AND sug NOT IN ('[No suggestion]', '[No ALT text]', '') THEN 'generated'
   WHEN cur <> '[No ALT text]' THEN 'preserved' ELSE 'needs_alt' END"""


def shown(e):
    return e.select(
        "shape_id",
        "deck",
        F.when(col("existing_alt") == "", review.NO_ALT).otherwise(col("existing_alt")).alias("cur"),
        F.when((col("existing_alt") != "") & (col("width") % 2 == 0), col("existing_alt"))
        .when(col("width") % 5 == 0, F.concat(F.lit("FALLBACK: "), "shape_name"))
        .when(col("generated_alt") == "", review.NO_SUGGESTION)
        .otherwise(col("generated_alt"))
        .alias("sug"),
        (col("height") < 40).alias("deco"),
    )


over_elements(
    "derive_status_b52",
    f""", e AS (SELECT shape_id, {SHOWN} FROM elements), s AS (SELECT *, {DERIVED} AS status FROM e)
SELECT shape_id, status, CASE status WHEN 'decorative_skipped' THEN 'Decorative' WHEN 'fallback_injected' THEN 'Fallback (PPT-gated)' WHEN 'generated' THEN 'Generated'
   WHEN 'preserved' THEN 'Preserved' ELSE CASE WHEN starts_with(sug, 'FALLBACK:') THEN 'Fallback (doc-only)' ELSE 'Needs ALT' END END AS label FROM s""",
    base=shown,
    status=lambda: review.derive_status("cur", "sug", col("deco"))["status"],
    label=lambda: review.derive_status("cur", "sug", col("deco"))["label"],
)

over_elements(
    "notes_text_b53",
    """SELECT shape_id, array_to_string(list_filter(['Existing: ' || nullif(trim(slide_notes), ''), CASE WHEN width % 2 = 0 THEN 'Generated: llava' END,
   CASE WHEN width % 3 = 0 THEN 'checked' END, 'deck: ' || deck, CASE WHEN height % 2 = 0 THEN 'kind: ' || shape_type END,
   CASE WHEN top % 2 = 0 THEN shape_name END], lambda p: p IS NOT NULL), ' • ') AS notes FROM elements""",
    notes=lambda: review.notes_text(
        "slide_notes",
        F.when(col("width") % 2 == 0, " llava "),
        F.when(col("width") % 3 == 0, "checked").otherwise("  "),
        F.create_map(F.lit("deck"), "deck", F.lit("kind"), F.when(col("height") % 2 == 0, col("shape_type"))),
        F.when(col("top") % 2 == 0, col("shape_name")),
    ),
)

over_elements(
    "degraded_text_b54",
    """, e AS (SELECT shape_id, CASE WHEN width <> 0 AND height <> 0 THEN 'Image (' || width || 'x' || height || ' pixels)' ELSE 'Image' END
   || CASE WHEN width % 3 = 0 THEN '' ELSE ' in png format' END || CASE WHEN contains(lower(shape_name), 'chart') THEN ' containing chart or graph'
     WHEN contains(lower(shape_name), 'diagram') THEN ' containing diagram' WHEN contains(lower(shape_name), 'text') THEN ' containing text' ELSE '' END AS b FROM elements),
f AS (SELECT *, b || '. Detailed description unavailable due to service limitations.' AS full_text FROM e)
SELECT shape_id, CASE WHEN length(full_text) > 125 THEN trim(left(b, 100)) || '.' ELSE full_text END AS alt FROM f""",
    alt=lambda: describe.degraded_text("shape_name", "width", "height", F.when(col("width") % 3 == 0, "").otherwise("png")),
)

over_elements(
    "kind_signature_b56",
    """, e AS (SELECT *, ['Picture','Shape','GroupShape','Connector','FreeformBuilder','Odd'][width % 6 + 1] AS cls FROM elements)
SELECT shape_id, CASE WHEN cls = 'Picture' THEN 'PICTURE' WHEN contains(cls, 'Shape') AND text <> '' THEN 'TEXT_BOX' WHEN cls = 'GroupShape' THEN 'GROUP'
   WHEN cls = 'Connector' THEN 'CONNECTOR' WHEN cls = 'FreeformBuilder' THEN 'FREEFORM'
   ELSE coalesce(nullif(array_to_string(list_filter([CASE WHEN shape_type = 'LINE' THEN 'XML_LINE' END,
      nullif(array_to_string(list_filter([CASE WHEN fill_kind = 'picture' THEN 'has_image' END, CASE WHEN shape_type = 'CHART' THEN 'has_chart' END,
        CASE WHEN text <> '' THEN 'has_text' END, CASE WHEN has_line THEN 'has_line' END, CASE WHEN fill_kind <> 'none' THEN 'has_fill' END],
        lambda p: p IS NOT NULL)[1:3], '_'), '')], lambda p: p IS NOT NULL), '_'), ''), 'UNKNOWN') END AS kind FROM e""",
    kind=lambda: describe.kind_signature(
        views.pick(["Picture", "Shape", "GroupShape", "Connector", "FreeformBuilder", "Odd"], col("width")),
        col("text") != "",
        {
            "has_image": col("fill_kind") == "picture",
            "has_chart": col("shape_type") == "CHART",
            "has_text": col("text") != "",
            "has_line": col("has_line"),
            "has_fill": col("fill_kind") != "none",
        },
        "shape_type",
    ),
)
