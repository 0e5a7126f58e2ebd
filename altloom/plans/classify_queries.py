"""Classification and decision rules over the element table."""

from __future__ import annotations

from pyspark.sql import functions as F

from altloom import views
from altloom.functions import fixed, rules
from altloom.functions.base import col
from altloom.operators import classify, reuse
from altloom.plans import sql as q
from altloom.plans.decisions import DECIDED_SQL, ENTRY_DECORATIVE, decided, decided_narrow, decided_texts
from altloom.plans.describe_queries import AUTO_TYPES, over_elements
from altloom.plans.registry import query
from altloom.session import materialize
from altloom.plans.text_queries import GATE

# Words that occur in the driver texts, in place of the default banks.
BANKS = ["the|and|of", "die|und", "une|des"]
SLIDE_BANKS = ["ing|que"]
WORDS = ["ing", "eux", "keit", "tion", "ent", "ci"]
NAME_RULES = {"contains": ["ring", "gear"], "exact": ["red widget"], "force": ["widget"], "never": ["hot", "blue w"]}


def whole(banks):
    return "(^|[^\\p{L}\\p{N}_])(" + "|".join(banks) + ")($|[^\\p{L}\\p{N}_])"


def ratio(w="width", h="height"):
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN greatest({w}, {h}) / least({w}, {h}) END)"


over_elements(
    "classify_c01",
    """SELECT shape_id, CASE shape_type WHEN 'PICTURE' THEN 'image' WHEN 'CHART' THEN 'chart' WHEN 'TABLE' THEN 'table' WHEN 'AUTO_SHAPE' THEN 'shape'
   WHEN 'LINE' THEN 'line' WHEN 'TEXT_BOX' THEN 'text_box' WHEN 'PLACEHOLDER' THEN 'text_placeholder' WHEN 'GROUP' THEN 'group' ELSE 'connector' END AS element_type,
  CASE WHEN shape_type IN ('PLACEHOLDER', 'CHART') THEN 'SHAPE_' || shape_type ELSE shape_type END AS known_type,
  CASE WHEN shape_type <> 'PICTURE' THEN 'shape' WHEN fill_kind = 'picture' THEN 'png' ELSE 'jpg' END AS format,
  CASE WHEN shape_type IN ('LINE', 'CONNECTOR') THEN 'connector-bypass' WHEN shape_type = 'PICTURE' THEN 'raster' ELSE 'generic' END AS handling FROM elements""",
    element_type=lambda: classify.element_type("shape_type"),
    known_type=lambda: classify.known_type("shape_type"),
    format=lambda: classify.format_type("shape_type", col("fill_kind") == "picture"),
    handling=lambda: classify.handling(classify.element_type("shape_type")),
)

over_elements(
    "is_visual_c03",
    f"""SELECT shape_id, fill_kind <> 'none' OR has_line OR width > 200 OR height > 200 AS styled,
  shape_type NOT IN ('GROUP', 'PICTURE') AND (fill_kind = 'picture' OR (shape_type IN ({q.quoted(rules.RENDERED_TYPES)}) AND
     (fill_kind <> 'none' OR has_line OR (width >= 30 AND height >= 30) OR (shape_type = 'TEXT_BOX' AND length({q.strip('text')}) > 10)))) AS rendered,
  shape_type IN ({q.quoted(rules.VISUAL_TYPES)}) OR fill_kind IN ('picture', 'pattern') OR
     (shape_type = 'PLACEHOLDER' AND (fill_kind <> 'none' OR has_line OR (width >= 10 AND height >= 10))) AS injected FROM elements""",
    styled=lambda: classify.is_visual("shape_type", "fill_kind", col("has_line"), "width", "height", "styled"),
    rendered=lambda: classify.is_visual("shape_type", "fill_kind", col("has_line"), "width", "height", "rendered", "text"),
    injected=lambda: classify.is_visual("shape_type", "fill_kind", col("has_line"), "width", "height", "injected"),
)


@query(
    "decorative_by_name_c04",
    """SELECT p_partkey, NOT (contains(p_name, 'hot') OR contains(p_name, 'blue w')) AND (p_name = 'red widget' OR contains(p_name, 'ring') OR contains(p_name, 'gear')
   OR contains(p_name, 'widget')) AS by_rules, contains(p_name, 'widget') OR contains(p_name, 'ring') AS by_name, contains(lower(p_type), 'small') AS by_file,
  contains(p_name, 'small') OR contains(lower(p_type), 'small') AS by_both FROM part""",
)
def decorative_by_name(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(
        "p_partkey",
        classify.decorative_by_name("p_name", NAME_RULES).alias("by_rules"),
        classify.decorative_by_scope("p_type", "p_name", ["widget", "ring"], "shape_name").alias("by_name"),
        classify.decorative_by_scope("p_type", "p_name", ["small"], "filename").alias("by_file"),
        classify.decorative_by_scope("p_type", "p_name", ["small"]).alias("by_both"),
    )


CHECKS = ["size", "keyword", "flag", "corner", "duplicate"]
NOTES_SQL = f"""list_filter([CASE WHEN width < 100 OR height < 100 THEN 'Image too small' END,
   CASE WHEN {ratio()} > 6 THEN 'Extreme aspect ratio (' || round({ratio()}, 1) || ':1)' END,
   CASE WHEN regexp_matches(shape_name, '(?i){rules.DECORATION_WORDS}') THEN 'Filename suggests decoration' END,
   CASE WHEN contains(lower(shape_name), 'flag') THEN 'Contains the word ''flag''' END,
   CASE WHEN "left" < 50 AND top < 50 THEN 'Top-left corner' WHEN "left" < 50 AND top > 500 THEN 'Bottom-left corner'
     WHEN "left" > 600 AND top < 50 THEN 'Top-right corner' WHEN "left" > 600 AND top > 500 THEN 'Bottom-right corner' END,
   CASE WHEN copies > 1 THEN 'Appears on ' || copies || ' slides' END], lambda n: n IS NOT NULL)"""


def with_copies(e):
    counted = reuse.repeats(e, "content_key", ["deck", "slide_idx"]).select("content_key", F.col("occurrences").alias("copies"))
    return e.join(counted, "content_key", "left")


over_elements(
    "decorative_reasons_c05",
    f""", c AS (SELECT *, count(*) OVER (PARTITION BY content_key) AS copies FROM elements)
SELECT shape_id, array_to_string({NOTES_SQL}, '; ') AS notes FROM c""",
    base=with_copies,
    notes=lambda: F.array_join(
        classify.decorative_reasons("shape_name", "width", "height", "left", "top", "copies", CHECKS), "; "
    ),
)

over_elements(
    "document_decorative_c06",
    f""", m AS (SELECT shape_id, lower(shape_name) AS n, lower(existing_alt) AS d, width * height // 40 AS px FROM elements)
SELECT shape_id, CASE WHEN {q.contains_any("n || ' ' || d", ['anatomy', 'pathology', 'diagram'])} THEN false
  WHEN {q.contains_any("n || ' ' || d", ['logo', 'border', 'accent'])} THEN true WHEN n = 'chart 5' OR d = 'picture' THEN true
  ELSE px > 0 AND px < 2500 END AS decorative FROM m""",
    decorative=lambda: classify.document_decorative(
        "shape_name", "existing_alt", F.floor(col("width") * col("height") / 40),
        {"never": ["anatomy", "pathology", "diagram"], "force": ["logo", "border"], "contains": ["accent"], "exact": ["Chart 5", "Picture"]},
    ),
)

CONTEXT = f"({q.count_present('lower(slide_text)', WORDS)} >= 4)"
TEACHING = f"""({q.contains_any('lower(shape_name)', rules.TEACHING_SHAPES)} OR regexp_matches(lower(text), '{"|".join(rules.TEACHING_TEXTS)}')
   OR ({CONTEXT} AND least(width, height) > 20))"""
FRAMED = f"""(text <> '')"""
TITLE = f"""({q.contains_any('lower(shape_name)', rules.TITLE_NAMES)} OR (top <= 180 AND ((width > 200 AND height > 30) OR (length(trim(text)) > 2 AND
   (regexp_matches({q.strip('text')}, '{"|".join(rules.TITLE_TEXTS)}') OR (({q.word_count('text')}) <= 8 AND length({q.strip('text')}) <= 60))))))"""
SHORT, LONG = "least(width, height)", "greatest(width, height)"
BARE = "(shape_type = 'AUTO_SHAPE' AND trim(text) = '')"
AUTO = "['RECTANGLE','OVAL','STAR_8_POINT','STAR_5_POINT','LEFT_RIGHT_ARROW','FLOWCHART_DECISION','FUNNEL'][top % 7 + 1]"


def blanked(e):
    """Half of the texts blank, so that every rule of the cascade is reached."""
    return e.withColumn("text", F.when(F.col("height") % 2 == 0, F.col("text")).otherwise(""))


def in_context(e):
    return blanked(e).withColumn("slide_text", F.when(F.col("width") % 3 == 0, F.col("slide_text")).otherwise(""))


over_elements(
    "shape_decorative_c07",
    f""", b AS (SELECT * REPLACE (CASE WHEN height % 2 = 0 THEN text ELSE '' END AS text, CASE WHEN width % 3 = 0 THEN slide_text ELSE '' END AS slide_text) FROM elements),
r AS (SELECT shape_id, CASE WHEN {TEACHING} THEN 'keep_educational' WHEN text <> '' THEN 'keep_text' WHEN {TITLE} THEN 'keep_title'
   WHEN {SHORT} < 50 AND {SHORT} > 0 THEN CASE WHEN {CONTEXT} THEN 'keep_small_in_context' ELSE 'small' END
   WHEN shape_type = 'LINE' THEN 'line' WHEN shape_type = 'CONNECTOR' THEN 'connector'
   WHEN {BARE} AND {q.contains_any(AUTO, rules.SIMPLE_SHAPES)} THEN 'geometric'
   WHEN {BARE} AND {LONG} > 500 THEN CASE WHEN {CONTEXT} THEN 'keep_background_in_context' ELSE 'background' END
   WHEN {BARE} AND {LONG} > 200 AND {ratio()} > 4 THEN 'divider' WHEN {BARE} AND {LONG} <= 200 AND {SHORT} < 80 AND {SHORT} > 0 THEN 'small_geometric'
   WHEN {ratio()} > 15 THEN 'thin' WHEN {LONG} > 0 AND {LONG} < 15 THEN 'tiny' ELSE 'keep_default' END AS rule FROM b)
SELECT shape_id, NOT starts_with(rule, 'keep_') AS decorative, rule FROM r""",
    base=lambda e: in_context(e).withColumn("__v", cascade()),
    decorative=lambda: col("__v.decorative"),
    rule=lambda: col("__v.rule"),
)


def cascade():
    return classify.shape_decorative(
        "shape_type", views.pick(AUTO_TYPES, col("top")), "shape_name", "text", col("text") != "", "slide_text",
        "width", "height", "top", words=WORDS, context_words=4,
    )


CLASSES = ["AutoShape", "Connector", "FreeformBuilder", "Odd", "Thing", "Part"]
over_elements(
    "decorative_fallback_c08",
    f""", c AS (SELECT *, {ratio()} AS r, ['AutoShape','Connector','FreeformBuilder','Odd','Thing','Part'][width % 6 + 1] AS cls,
   CASE WHEN shape_type IN ('TEXT_BOX', 'AUTO_SHAPE') THEN CASE WHEN height % 2 = 0 THEN text ELSE '' END END AS t FROM elements),
d AS (SELECT *, CASE WHEN contains(cls, 'Shape') THEN 'Geometric shape class: ' || cls WHEN contains(cls, 'Connector') THEN 'Connector class: ' || cls
   WHEN contains(cls, 'Freeform') THEN 'Drawing class: ' || cls WHEN contains(lower(shape_type), 'line') OR contains(lower(shape_type), 'connector') THEN 'XML tag: ' || shape_type
   WHEN (width > 0 AND width < 20) OR (height > 0 AND height < 20) THEN 'Very small shape: ' || width || 'x' || height || 'px'
   WHEN r > 10 THEN 'Very thin shape' WHEN t IS NOT NULL AND {q.strip('t')} = '' THEN 'Text-capable shape without content: ' || cls
   WHEN fill_kind = 'gradient' THEN 'Shape with gradient fill (likely decorative)' END AS found FROM c)
SELECT shape_id, found IS NOT NULL AS decorative, coalesce(found, 'No fallback criteria matched for ' || cls) AS reason,
  shape_type IN ('LINE', 'CONNECTOR') OR coalesce(shape_type = 'AUTO_SHAPE' AND fill_kind = 'none' AND r > 10, false) AS outline,
  {q.contains_any('lower(shape_name)', rules.DECORATIVE_STUBS)} OR width * height < 100 AS stub FROM d""",
    base=lambda e: e.withColumn(
        "__v",
        classify.shape_decorative_fallback(
            views.pick(CLASSES, col("width")), "shape_type", "width", "height",
            F.when(col("shape_type").isin("TEXT_BOX", "AUTO_SHAPE"), F.when(col("height") % 2 == 0, col("text")).otherwise("")),
            "fill_kind",
        ),
    ),
    decorative=lambda: col("__v.decorative"),
    reason=lambda: col("__v.reason"),
    outline=lambda: classify.outline_decorative("shape_type", "fill_kind", "width", "height"),
    stub=lambda: classify.stub_decorative("shape_name", "width", "height"),
)

over_elements(
    "entry_decorative_c09",
    f"""SELECT shape_id, {ENTRY_DECORATIVE} AS by_default, shape_type IN ('LINE', 'CONNECTOR') OR width * height < 100
   OR {q.contains_any('lower(slide_text)', ['zung', 'bleou'])} AS by_words FROM elements""",
    by_default=lambda: classify.entry_decorative("shape_type", "width", "height", "slide_text"),
    by_words=lambda: classify.entry_decorative("shape_type", "width", "height", "slide_text", ["zung", "bleou"]),
)
over_elements(
    "review_decorative_c10",
    """SELECT shape_id, (width > 0 AND height > 0 AND (width < 50 OR height < 50)) OR (existing_alt = '' AND generated_alt = '') AS decorative FROM elements""",
    decorative=lambda: classify.review_decorative("width", "height", "existing_alt", "generated_alt"),
)

EDUCATIONAL = f"""(regexp_matches(lower(shape_name) || ' ' || lower(slide_text), '{whole(BANKS)}') OR regexp_matches(lower(shape_name), '{"|".join(rules.FILE_PATTERNS)}')
   OR (length(slide_text) > 50 AND regexp_matches(lower(slide_text), '{whole(SLIDE_BANKS)}')))"""
DEFAULT_BANKS = [*rules.SCIENCE_WORDS, *rules.TECHNICAL_WORDS, *rules.TEACHING_WORDS, *rules.MATH_WORDS]
over_elements(
    "is_educational_c11",
    f"""SELECT shape_id, {EDUCATIONAL} AS by_banks, regexp_matches(lower(shape_name) || ' ' || lower(slide_text), '{whole(DEFAULT_BANKS)}')
   OR regexp_matches(lower(shape_name), '{"|".join(rules.FILE_PATTERNS)}')
   OR (length(slide_text) > 50 AND regexp_matches(lower(slide_text), '{whole(rules.SLIDE_WORDS)}')) AS by_default FROM elements""",
    by_banks=lambda: classify.is_educational("shape_name", "slide_text", BANKS, slide_banks=SLIDE_BANKS),
    by_default=lambda: classify.is_educational("shape_name", "slide_text"),
)
over_elements(
    "has_context_c12",
    f"""SELECT shape_id, {q.count_present('lower(slide_text)', WORDS)} >= 3 AS three_words,
   {q.contains_any('lower(shape_name)', rules.TEACHING_SHAPES)} OR regexp_matches(lower(text), '{"|".join(rules.TEACHING_TEXTS)}')
   OR ({q.count_present('lower(slide_text)', WORDS)} >= 2 AND least(width, height) > 20) AS educational_shape FROM elements""",
    three_words=lambda: classify.has_context("slide_text", WORDS, 3),
    educational_shape=lambda: classify.is_educational_shape("shape_name", "text", "slide_text", "width", "height", WORDS),
)
over_elements(
    "is_title_area_c13",
    f"""SELECT shape_id, (shape_type = 'TEXT_BOX' AND trim(text) <> '') OR (text <> '' AND fill_kind <> 'none') AS text_content, {TITLE} AS title_area FROM elements""",
    text_content=lambda: classify.is_text_content("shape_type", "text", col("fill_kind") != "none"),
    title_area=lambda: classify.is_title_area("shape_name", "text", "width", "height", "top"),
)

CONTENT_SIZE = f"""(CASE WHEN width <= 0 OR height <= 0 THEN false ELSE {SHORT} > 300 OR ({SHORT} > 150 AND ({ratio()} < 5 OR (length(slide_text) > 30
   AND {q.contains_any('lower(slide_text)', WORDS)}))) OR width * height / 691200 > 0.05 OR ({SHORT} > 100 AND {ratio()} < 3 AND "left" > 50 AND top > 50) END)"""
over_elements(
    "is_content_size_c14",
    f"SELECT shape_id, {CONTENT_SIZE} AS content FROM elements",
    content=lambda: classify.is_content_size("width", "height", "left", "top", "slide_text", WORDS),
)
over_elements(
    "needs_alt_c15",
    f""", c AS (SELECT *, count(*) OVER (PARTITION BY content_key) AS copies FROM elements)
SELECT shape_id, CASE WHEN {q.contains_any('lower(shape_name)', ['logo', 'arrow'])} AND NOT contains(lower(shape_name), 'straight') THEN false
  WHEN regexp_matches(lower(shape_name) || ' ' || lower(slide_text), '{whole(['qq|worthless'])}') OR regexp_matches(lower(shape_name), '{"|".join(rules.FILE_PATTERNS)}')
    OR (length(slide_text) > 50 AND regexp_matches(lower(slide_text), '{whole(rules.SLIDE_WORDS)}')) THEN true
  WHEN {CONTENT_SIZE.replace(q.contains_any('lower(slide_text)', WORDS), q.contains_any('lower(slide_text)', rules.SIZE_CONTEXT_WORDS))} THEN true ELSE len({NOTES_SQL}) = 0 END AS needed FROM c""",
    base=with_copies,
    needed=lambda: classify.needs_alt(
        "shape_name", "slide_text", "width", "height", "left", "top", "copies", CHECKS,
        {"contains": ["logo"], "force": ["arrow"], "exact": [], "never": ["straight"]}, ["qq|worthless"],
    ),
)
over_elements(
    "bypass_reason_c16",
    """SELECT shape_id, CASE WHEN shape_type IN ('LINE', 'CONNECTOR') THEN 'Using descriptive text for ' || lower(shape_type) || ' (no AI analysis needed)'
   WHEN width < 5 OR height < 5 THEN 'Element too small (' || width || 'x' || height || 'px)' WHEN fill_kind = 'none' THEN 'No shape data available' END AS reason FROM elements""",
    reason=lambda: classify.bypass_reason(classify.element_type("shape_type"), "width", "height", col("fill_kind") != "none"),
)

POLICIES = {
    "smart": (
        "shape_type = 'PICTURE' OR (NOT {d} AND width * height >= 3888)",
        "CASE WHEN shape_type = 'PICTURE' THEN 'picture in smart mode' WHEN {d} THEN 'decorative ' || shape_type || ' excluded' "
        "WHEN width * height >= 3888 THEN shape_type || ' above threshold (' || width * height || ' >= 3888)' "
        "ELSE shape_type || ' below threshold (' || width * height || ' < 3888)' END",
    ),
    "off": (
        "shape_type = 'PICTURE'",
        "CASE WHEN shape_type = 'PICTURE' THEN 'picture in off mode (pictures only)' ELSE shape_type || ' excluded in off mode (pictures only)' END",
    ),
    "all": ("NOT {d}", "CASE WHEN {d} THEN 'decorative ' || shape_type || ' excluded' ELSE shape_type || ' included in all mode' END"),
}


@query(
    "include_policy_c17",
    f"WITH {views.ELEMENTS_SQL} SELECT shape_id, "
    + ", ".join(f"{i.format(d=ENTRY_DECORATIVE)} AS {s}_in, {r.format(d=ENTRY_DECORATIVE)} AS {s}_reason" for s, (i, r) in POLICIES.items())
    + " FROM elements",
)
def include_policy(spark, sf_dir):
    e = views.elements(spark, sf_dir)
    made = {s: classify.include_policy("shape_type", "width", "height", "slide_text", s) for s in POLICIES}
    return e.withColumns(made).select(
        "shape_id", *[F.col(f"{s}.{f}").alias(f"{s}_{a}") for s in made for f, a in (("include", "in"), ("reason", "reason"))]
    )


@query(
    "decision_c18",
    f"""WITH {DECIDED_SQL}
SELECT shape_id, decision_reason, CASE decision_reason WHEN 'preserve_existing' THEN 'preserve' WHEN 'policy_excluded' THEN 'exclude'
   WHEN 'needs_generation' THEN 'generate' ELSE 'use_cache' END AS action,
  CASE decision_reason WHEN 'preserve_existing' THEN existing_alt WHEN 'cached' THEN cached_alt WHEN 'already_generated' THEN final_alt ELSE '' END AS decided_alt,
  CASE decision_reason WHEN 'preserve_existing' THEN 'existing' WHEN 'policy_excluded' THEN 'excluded' WHEN 'needs_generation' THEN 'generated' ELSE 'cached' END AS decision_source,
  CASE decision_reason WHEN 'preserve_existing' THEN 'existing ALT preserved in preserve mode' WHEN 'policy_excluded' THEN '' WHEN 'cached' THEN 'reused from cache (content_key match)'
    WHEN 'already_generated' THEN 'already processed in this run' ELSE {POLICIES['smart'][1].format(d='deco')} END AS include_reason,
  CASE WHEN decision_reason = 'policy_excluded' THEN {POLICIES['smart'][1].format(d='deco')} ELSE '' END AS exclude_reason
FROM decided""",
)
def decision(spark, sf_dir):
    return decided_texts(spark, sf_dir).select(
        "shape_id", "decision_reason", "action", "decided_alt", "decision_source", "include_reason", "exclude_reason"
    )


@query(
    "decision_summary_c18",
    f"""WITH {DECIDED_SQL}, elected AS (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY deck, slide_idx, shape_idx) = 1 AS generates
   FROM decided WHERE decision_reason = 'needs_generation')
SELECT deck, CAST(count(*) AS BIGINT) AS elements, count_if(decision_reason = 'preserve_existing') AS preserved, count_if(decision_reason = 'policy_excluded') AS excluded,
  count_if(decision_reason IN ('cached', 'already_generated')) AS cached, count_if(coalesce(generates, false)) AS generated, count_if(NOT generates) AS reused
FROM decided LEFT JOIN (SELECT uid, generates FROM elected) USING (uid) GROUP BY deck""",
)
def decision_summary(spark, sf_dir):
    kept = [*reuse.OWNER, "shape_idx", "content_key", "decision_reason"]
    d = materialize(decided_narrow(spark, sf_dir).select(*kept))
    waiting = F.col("decision_reason") == "needs_generation"
    elected = reuse.elect_generators(d.filter(waiting), "content_key", ["deck", "slide_idx", "shape_idx"]).filter("generates")
    marked = d.join(elected.select(*reuse.OWNER, "generates"), reuse.OWNER, "left").withColumn("generates", F.coalesce("generates", F.lit(False)))
    return marked.groupBy("deck").agg(
        F.count(F.lit(1)).alias("elements"),
        F.count_if(F.col("decision_reason") == "preserve_existing").alias("preserved"),
        F.count_if(F.col("decision_reason") == "policy_excluded").alias("excluded"),
        F.count_if(F.col("decision_reason").isin("cached", "already_generated")).alias("cached"),
        F.count_if(waiting & F.col("generates")).alias("generated"),
        F.count_if(waiting & ~F.col("generates")).alias("reused"),
    )


FINAL_SQL = f"""{DECIDED_SQL},
settled AS (SELECT *, {q.strip("coalesce(nullif(final_alt, ''), generated_alt, '')")} AS s, {q.strip('existing_alt')} AS c,
  CASE WHEN decision_reason = 'preserve_existing' THEN '' ELSE decision_reason END AS given, CASE WHEN width % 4 = 0 THEN 'cached' ELSE 'x' END AS source FROM decided),
final AS (SELECT *, CASE WHEN s <> '' THEN s ELSE c END AS settled_alt,
  CASE WHEN s <> '' AND given IN ('cached', 'generated_new') THEN given WHEN s <> '' AND model_called THEN 'generated_new' WHEN s <> '' AND source = 'cached' THEN 'cached'
    WHEN s <> '' THEN coalesce(nullif(given, ''), 'generated_new') WHEN c <> '' THEN coalesce(nullif(given, ''), 'preserve_existing') ELSE coalesce(nullif(given, ''), 'needs_generation') END AS settled_reason,
  CASE WHEN s <> '' AND given IN ('cached', 'generated_new') THEN 'settled' WHEN s <> '' AND NOT model_called AND source = 'cached' THEN 'cached' WHEN s <> '' THEN 'generated'
    WHEN c <> '' THEN 'preserved' ELSE 'missing' END AS outcome FROM settled)"""


def settled(spark, sf_dir):
    d = decided(spark, sf_dir).withColumns(
        {
            "suggested_alt": F.col("generated_alt"),
            "decision_reason": F.when(F.col("decision_reason") == "preserve_existing", "").otherwise(F.col("decision_reason")),
            "source": F.when(F.col("width") % 4 == 0, "cached").otherwise("x"),
        }
    )
    return classify.finalize(d)


@query("finalize_c19", f"WITH {FINAL_SQL} SELECT shape_id, settled_alt, settled_reason, outcome FROM final")
def finalize(spark, sf_dir):
    return settled(spark, sf_dir).select("shape_id", "settled_alt", "settled_reason", "outcome")


@query(
    "write_plan_c20",
    f"""WITH {views.ELEMENTS_SQL}, t AS (SELECT shape_id, {q.strip('existing_alt')} AS e, {q.strip('generated_alt')} AS g, coalesce({q.strip('final_alt')}, '') AS f FROM elements),
d AS (SELECT *, CASE WHEN f <> '' THEN 'written_final' WHEN e <> '' THEN 'preserved_existing' WHEN g <> '' THEN 'written_generated' ELSE 'skipped_no_content' END AS keep_decision,
   CASE WHEN f <> '' AND f <> g THEN 'written_final' WHEN f <> '' OR g <> '' THEN 'written_generated' WHEN e <> '' THEN 'written_existing' ELSE 'skipped_no_content' END AS replace_decision FROM t)
SELECT shape_id, keep_decision, coalesce(nullif(f, ''), nullif(e, ''), nullif(g, '')) AS keep_alt, keep_decision IN ('written_final', 'written_generated') AS keep_write,
  replace_decision, coalesce(nullif(f, ''), nullif(g, ''), nullif(e, '')) AS replace_alt, replace_decision IN ('written_final', 'written_generated') AS replace_write FROM d""",
)
def write_plan(spark, sf_dir):
    e = views.elements(spark, sf_dir).withColumns(
        {m: classify.write_plan("existing_alt", "generated_alt", "final_alt", n) for m, n in (("keep", "preserve"), ("replace", "overwrite"))}
    )
    fields = (("decision", "decision"), ("final_alt", "alt"), ("should_write", "write"))
    return e.select("shape_id", *[F.col(f"{m}.{f}").alias(f"{m}_{a}") for m in ("keep", "replace") for f, a in fields])


over_elements(
    "should_inject_c21",
    f""", t AS (SELECT shape_id, {q.strip("CASE width % 5 WHEN 0 THEN 'Decorative image' WHEN 1 THEN 'N/A' WHEN 2 THEN generated_alt WHEN 3 THEN 'short' ELSE existing_alt END")} AS t FROM elements),
r AS (SELECT shape_id, CASE WHEN t = '' THEN 'no_existing' WHEN t IN ({q.quoted(fixed.SKIP_VALUES)}) THEN 'skippable' WHEN lower(t) IN ({q.quoted(rules.DECORATIVE_TEXTS)}) THEN 'decorative_text'
   WHEN {q.contains_any('lower(t)', rules.INJECT_FAILURES)} THEN 'failure_text' WHEN length(t) > 10 THEN 'keep' ELSE 'too_short' END AS reason FROM t)
SELECT shape_id, reason <> 'keep' AS inject, reason FROM r""",
    base=lambda e: e.withColumn(
        "__v",
        classify.should_inject(
            F.when(col("width") % 5 == 0, "Decorative image").when(col("width") % 5 == 1, "N/A")
            .when(col("width") % 5 == 2, col("generated_alt")).when(col("width") % 5 == 3, "short").otherwise(col("existing_alt"))
        ),
    ),
    inject=lambda: col("__v.inject"),
    reason=lambda: col("__v.reason"),
)

STUB_SQL = """CASE WHEN shape_type IN ('LINE', 'CONNECTOR') THEN CASE WHEN width <= 0 OR height <= 0 THEN 'diagonal' WHEN width > height * 3 THEN 'horizontal'
   WHEN height > width * 3 THEN 'vertical' ELSE 'diagonal' END || ' line' ELSE 'shape' END || ' (' || width || '×' || height || 'px)'"""


@query(
    "fallback_policy_c22",
    f"""WITH {views.ELEMENTS_SQL}, t AS (SELECT *, generated_alt <> '' AND NOT starts_with(generated_alt, 'Error') AS ok, {STUB_SQL} AS spare FROM elements),
g AS (SELECT *, {GATE.format(t='spare', known=q.quoted(fixed.GATE_KNOWN))} AND trim(existing_alt) = ''
   AND NOT ({q.contains_any('lower(shape_name)', rules.DECORATIVE_STUBS)} OR width * height < 100) AS allowed FROM t)
SELECT shape_id, CASE WHEN ok THEN generated_alt WHEN allowed THEN spare END AS gated_write, CASE WHEN ok THEN generated_alt WHEN allowed THEN spare ELSE '' END AS gated_review,
  CASE WHEN ok THEN 'generated' WHEN allowed THEN 'FALLBACK_INJECTED' ELSE 'NEEDS ALT' END AS gated_status,
  CASE WHEN ok THEN generated_alt END AS doc_write, CASE WHEN ok THEN generated_alt ELSE 'FALLBACK: ' || spare END AS doc_review,
  CASE WHEN ok THEN 'generated' ELSE 'AUTO-LOWCONF' END AS doc_status, CASE WHEN ok THEN 'ai_generation' ELSE 'none_policy' END AS none_method FROM g""",
)
def fallback_policy(spark, sf_dir):
    failure = F.when((F.col("generated_alt") == "") | F.col("generated_alt").startswith("Error"), "failed")
    e = views.elements(spark, sf_dir).withColumns(
        {
            n: classify.fallback_policy("generated_alt", failure, "existing_alt", "shape_type", "shape_name", "width", "height", p)
            for n, p in (("gated", "ppt-gated"), ("doc", "doc-only"), ("none", "none"))
        }
    )
    fields = (("write_text", "write"), ("review_text", "review"), ("status", "status"))
    return e.select(
        "shape_id", *[F.col(f"{m}.{f}").alias(f"{m}_{a}") for m in ("gated", "doc") for f, a in fields],
        F.col("none.method").alias("none_method"),
    )
