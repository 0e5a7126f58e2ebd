"""Text rules over whole document and conversation texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from altloom import views
from altloom.functions import fixed, gates, keys, text
from altloom.operators import reuse
from altloom.plans import sql as q
from altloom.plans.registry import query

# Prefixes and words that do occur in the driver texts.
OCCURRING_PREFIXES = ["is and", "the", "anat with", "du", "in die", "elle"]
OCCURRING_WORDS = ["the", "of", "and", "une", "die"]


def documents(spark, sf_dir):
    return views.texts(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")


def over_documents(name: str, check: str, **columns):
    """Register a query that adds text columns to every document."""

    def run(spark, sf_dir):
        return documents(spark, sf_dir).select("doc_id", *[make("text").alias(alias) for alias, make in columns.items()])

    return query(name, check)(run)


over_documents(
    "truncate_sentence_b01",
    f"""
WITH t AS (SELECT doc_id, {q.squash('text')} AS t FROM documents),
c AS (SELECT doc_id, t, CASE
    WHEN length(t) <= 320 THEN t
    WHEN regexp_extract(t, '(?s)^.{{0,319}}[.!?]') <> '' THEN regexp_extract(t, '(?s)^.{{0,319}}[.!?]')
    WHEN regexp_extract(t, '(?s)^.{{270,319}}[;,]') <> '' THEN regexp_extract(t, '(?s)^.{{270,319}}[;,]')
    WHEN regexp_extract(t, '(?s)^.{{300,319}} ') <> '' THEN regexp_extract(t, '(?s)^.{{300,319}} ')
    ELSE left(t, 320) END AS c FROM t),
r AS (SELECT doc_id, t, CASE WHEN length(t) <= 320 THEN t
    ELSE {q.strip("regexp_replace(" + q.strip('c') + ", ',$', '')")} END AS r FROM c)
SELECT doc_id, {q.mark('r')} AS alt, length(r) < length(t) AS truncated FROM r""",
    alt=lambda c: text.truncate_sentence(c)["text"],
    truncated=lambda c: text.truncate_sentence(c)["truncated"],
)

over_documents("end_mark_b02", f"SELECT doc_id, {q.end_mark('text')} AS alt FROM documents", alt=text.end_mark)

UNIVERSAL = f"""
parts AS (SELECT doc_id, list_transform(list_filter(
      string_split(regexp_replace({q.squash('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda p: p <> ''),
      lambda p: trim(p, ' .')) AS parts FROM {{source}}),
kept AS (SELECT doc_id, list_reduce(list_transform(parts, lambda p: [p]),
      lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: lower(k) = lower(x[1])
             OR (contains(lower(k), lower(x[1])) AND length(x[1]) <= length(k)))) > 0 THEN acc
        ELSE list_concat(list_filter(acc, lambda k: NOT contains(lower(x[1]), lower(k))), x) END) AS kept
    FROM parts WHERE len(parts) > 0),
joined AS (SELECT doc_id, array_to_string(kept, '. ') AS j FROM kept),
universal AS (SELECT doc_id, {q.cap('m')} AS u FROM (SELECT doc_id, {q.end_mark('j')} AS m FROM joined))"""

over_documents(
    "normalize_universal_b03",
    f"WITH {UNIVERSAL.replace(q.cap('m'), q.full_cap('m')).format(source='documents')} SELECT doc_id, u AS alt FROM universal",
    alt=text.normalize_universal,
)

# The texts get an end on which the back-reference rules for sizes and vector sentences find something.
over_documents(
    "collapse_repeats_b04",
    f"""
WITH a AS (SELECT doc_id, {q.squash("text || ' Vector flow diagram.  Vector flow diagram. (3x4px)  (3x4px)  ..'")} AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(t, '(3x4px) (3x4px)', '(3x4px)'), 'Vector flow diagram. Vector flow diagram.', 'Vector flow diagram.'), '\\.+', '.', 'g'), '\\s+([.,])', '\\1', 'g') AS t FROM a)
SELECT doc_id, {q.end_mark('t')} AS alt FROM b""",
    alt=lambda c: text.collapse_repeats(F.concat(F.col(c), F.lit(" Vector flow diagram.  Vector flow diagram. (3x4px)  (3x4px)  .."))),
)

FINALIZED = """CASE WHEN lower({x}) IN ('', 'undefined', '(none)', 'n/a', 'none') THEN '' ELSE
   regexp_extract({x}, '(?s)^[^\\p{{L}}]*') || upper(substr(substr({x}, length(regexp_extract({x}, '(?s)^[^\\p{{L}}]*')) + 1), 1, 1))
   || substr({x}, length(regexp_extract({x}, '(?s)^[^\\p{{L}}]*')) + 2)
   || CASE WHEN regexp_matches(right({x}, 1), '[\\p{{L}}\\p{{N}}]') THEN '.' ELSE '' END END"""
FIRST_LETTER = "substr(substr({x}, length(regexp_extract({x}, '(?s)^[^\\p{{L}}]*')) + 1), 1, 1)"
FINALIZED_FULL = FINALIZED.replace(f"upper({FIRST_LETTER})", q.full_upper(FIRST_LETTER))

over_documents(
    "finalize_alt_b05",
    f"WITH t AS (SELECT doc_id, {q.strip('lower(text)')} AS t FROM documents) "
    f"SELECT doc_id, {FINALIZED_FULL.format(x='t')} AS alt FROM t",
    alt=lambda c: text.finalize_alt(F.lower(F.col(c))),
)

over_documents(
    "strip_vague_prefix_b06",
    f"""
WITH t AS (SELECT doc_id, regexp_replace({q.strip('text')}, '(?i)^{q.alternation(OCCURRING_PREFIXES)}[ ,.\\-]*', '') AS t FROM documents)
SELECT doc_id, {q.full_cap('t')} AS alt FROM t""",
    alt=lambda c: text.strip_vague_prefix(c, OCCURRING_PREFIXES),
)

SHRUNK = """CASE WHEN length({t}) <= 125 THEN {t} ELSE (SELECT """ + q.mark("s") + """ FROM (SELECT trim(CASE
    WHEN regexp_matches(left({t}, 125), '(?s)^.{{60,}}\\. ') THEN regexp_extract(left({t}, 125), '(?s)^(.{{60,}})\\. ', 1)
    WHEN regexp_matches(left({t}, 125), '(?s)^.{{60,}}; ') THEN regexp_extract(left({t}, 125), '(?s)^(.{{60,}}); ', 1)
    WHEN regexp_matches(left({t}, 125), '(?s)^.{{60,}}, ') THEN regexp_extract(left({t}, 125), '(?s)^(.{{60,}}), ', 1)
    ELSE left({t}, 125) END, ' .;,') AS s)) END"""

over_documents(
    "shrink_b07",
    f"WITH t AS (SELECT doc_id, {q.squash('text')} AS t FROM documents) SELECT doc_id, {SHRUNK.format(t='t')} AS alt FROM t",
    alt=text.shrink,
)

FIRST_WORDS = """CASE WHEN """ + q.word_count("{t}") + """ <= 30 THEN """ + q.strip("{t}") + """
    WHEN contains({t}, '.') AND """ + q.word_count("split_part({t}, '.', 1) || '.'") + """ <= 30
      THEN """ + q.strip("split_part({t}, '.', 1) || '.'") + """
    ELSE array_to_string(string_split(""" + q.squash("{t}") + """, ' ')[1:30], ' ') || '...' END"""

over_documents(
    "first_words_b08", f"SELECT doc_id, {FIRST_WORDS.format(t='text')} AS alt FROM documents", alt=text.first_words
)

over_documents(
    "two_sentences_b09",
    f"""
WITH t AS (SELECT doc_id, {q.strip('text')} AS t FROM documents),
s AS (SELECT doc_id, t, list_transform(list_filter(list_transform(
    string_split(regexp_replace(t, '[.!?]+(?:\\s|$)', chr(1), 'g'), chr(1)), lambda p: {q.strip('p')}),
    lambda p: length(p) > 3), lambda p: {q.full_cap('p')}) AS s FROM t),
r AS (SELECT doc_id, t, CASE WHEN len(s) = 0 THEN t ELSE array_to_string(s[1:2], '. ') END AS r FROM s)
SELECT doc_id, CASE WHEN t = '' THEN '' ELSE {q.end_mark('r')} END AS alt FROM r""",
    alt=text.two_sentences,
)

over_documents(
    "short_title_b10",
    f"""
WITH a AS (SELECT doc_id, {q.strip("'This is a ' || text")} AS t FROM documents),
b AS (SELECT doc_id, {q.strip("regexp_replace(t, '^(This is a PowerPoint shape\\. It is |This is a PowerPoint |This is a |A PowerPoint |PowerPoint )', '')")} AS t FROM a),
c AS (SELECT doc_id, {FINALIZED_FULL.format(x='t')} AS t FROM b),
d AS (SELECT doc_id, t, left(t, 70) AS h FROM c)
SELECT doc_id, CASE WHEN length(t) <= 70 THEN t
  WHEN regexp_matches(h, '(?s)^.{{50,}}\\. ') THEN {q.strip("regexp_extract(h, '(?s)^(.{50,}\\.) ', 1)")}
  WHEN regexp_matches(h, '(?s)^.{{50,}}! ') THEN {q.strip("regexp_extract(h, '(?s)^(.{50,}!) ', 1)")}
  WHEN regexp_matches(h, '(?s)^.{{50,}}\\? ') THEN {q.strip("regexp_extract(h, '(?s)^(.{50,}\\?) ', 1)")}
  WHEN regexp_matches(h, '(?s)^.{{50,}} ') THEN {q.strip("regexp_extract(h, '(?s)^(.{50,}) ', 1)")}
  ELSE {q.strip('h')} || '...' END AS title FROM d""",
    title=lambda c: text.short_title(F.concat(F.lit("This is a "), F.col(c))),
)

over_documents(
    "compare_key_b11",
    f"""
WITH t AS (SELECT doc_id, string_split(lower({q.squash("text || ' Medical Center'")}), ' ') AS w FROM documents),
j AS (SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE
   WHEN i = 1 OR x IN ('powerpoint', 'microsoft', 'southwestern', 'medical', 'center') THEN {q.full_cap('x')} ELSE x END), ' ') AS j FROM t)
SELECT doc_id, regexp_replace(j, '[.!?]+$', '') || '.' AS alt FROM j""",
    alt=lambda c: text.compare_key(F.concat(F.col(c), F.lit(" Medical Center"))),
)

over_documents(
    "hard_cut_b12",
    f"""
WITH a AS (SELECT doc_id, {q.full_cap(q.strip('text'))} AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(left(t, 125), '\\s+$', '') AS t FROM a)
SELECT doc_id, {q.mark('t')} AS alt FROM b""",
    alt=text.hard_cut,
)

over_documents(
    "dedupe_token_b13",
    f"""SELECT doc_id, {q.strip(f"regexp_replace({q.squash('text')}, ' ([.,])', '\\1', 'g')")} || ' WMF format is once' AS alt FROM documents""",
    alt=lambda c: text.dedupe_token(F.concat(F.col(c), F.lit(" WMF format is once WMF format")), "WMF"),
)

SEMANTIC = (
    f"({q.count_present('lower({t})', fixed.SEMANTIC_WORDS)} * 2 - 2 * ("
    + " + ".join(f"CAST(contains(lower({{t}}), '{p}') AS INT)" for p in fixed.SEMANTIC_BOILERPLATE[:4])
    + " + CAST(regexp_matches(lower({t}), '^a (?:shape|line|connector) \\(\\d+x\\d+px\\)') AS INT)) "
    "+ CAST(length(" + q.strip("{t}") + ") BETWEEN 20 AND 150 AS INT))"
)


@query(
    "best_text_b14",
    f"""
WITH {views.CANDIDATES_SQL},
p AS (SELECT key, seq, {q.strip('text')} AS t FROM candidates),
f AS (SELECT * FROM p WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY key, {q.squash('lower(t)')} ORDER BY seq) = 1),
b AS (SELECT key, t FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY {SEMANTIC.format(t='t')} DESC, seq) = 1),
c AS (SELECT key, regexp_replace(regexp_replace({q.squash('t')}, '\\.+', '.', 'g'), '\\s+([.,])', '\\1', 'g') AS t FROM b)
SELECT key, {q.end_mark('t')} AS alt FROM c""",
)
def best_text(spark, sf_dir):
    return reuse.best_text_per_key(views.candidates(spark, sf_dir), "key", "seq", "text")


QUALITY = f"""CASE WHEN {{t}} = '' THEN -10 ELSE
   (CASE WHEN {q.contains_any('lower({t})', fixed.QUALITY_ERRORS)} THEN -10 ELSE 0 END)
 + (CASE WHEN regexp_matches(lower({{t}}), '^a (?:shape|line|connector) \\(\\d+x\\d+px\\)$') THEN -2 ELSE 0 END)
 + (CASE WHEN len(list_filter(string_split(replace(replace(replace(replace({q.squash('lower({t})')}, 'this is a powerpoint shape', ''),
      'this is a shape', ''), 'powerpoint element', ''), 'visual element', ''), ' '), lambda w: length(w) > 2)) >= 3 THEN 3 ELSE 0 END)
 + (CASE WHEN {q.contains_any('lower({t})', fixed.QUALITY_NOUNS)} THEN 2 ELSE 0 END)
 + (CASE WHEN length({{t}}) BETWEEN 40 AND 200 THEN 1 ELSE 0 END) END"""


def over_turns(name, check, **columns):
    """Register a query that adds columns to every conversation turn."""

    def run(spark, sf_dir):
        turns = views.texts(spark, sf_dir, "conversations", "conv_id")
        return turns.select("conv_id", "turn", *[make("text").alias(alias) for alias, make in columns.items()])

    return query(name, check)(run)


over_turns(
    "quality_score_b15",
    f"SELECT conv_id, turn, {QUALITY.replace('{{', '{').replace('}}', '}').format(t=q.strip('text'))} AS score FROM conversations",
    score=text.quality_score,
)
over_turns(
    "semantic_score_b16",
    f"SELECT conv_id, turn, {SEMANTIC.format(t='text')} AS score FROM conversations",
    score=text.semantic_score,
)


@query(
    "is_meaningful_b17",
    f"""WITH {views.ELEMENTS_SQL} SELECT shape_id,
  lower({q.strip('existing_alt')}) NOT IN ({q.quoted(fixed.SKIP_TOKENS)}) AS existing_meaningful,
  coalesce(lower({q.strip('final_alt')}) NOT IN ({q.quoted(fixed.SKIP_TOKENS)}), false) AS final_meaningful FROM elements""",
)
def is_meaningful(spark, sf_dir):
    return views.elements(spark, sf_dir).select(
        "shape_id",
        gates.is_meaningful("existing_alt").alias("existing_meaningful"),
        gates.is_meaningful("final_alt").alias("final_meaningful"),
    )


PLACEHOLDER = "|".join(
    p.replace("\\w{1,4}", "[\\p{L}\\p{N}_]{1,4}") for p in fixed.PLACEHOLDER_PATTERNS
)
over_turns(
    "is_placeholder_b18",
    f"""
WITH t AS (SELECT conv_id, turn, {q.strip('text')} AS t FROM conversations)
SELECT conv_id, turn, t = '' OR regexp_matches(t, '(?i){PLACEHOLDER}')
   OR (({q.word_count('t')}) > 6 AND right(t, 1) NOT IN ('.', '!', '?')) AS placeholder FROM t""",
    placeholder=gates.is_placeholder,
)
over_turns(
    "is_low_value_b19",
    f"""
WITH t AS (SELECT conv_id, turn, {q.strip('text')} AS t FROM conversations)
SELECT conv_id, turn, t = '' OR length(t) < 5 OR regexp_matches(t, '(?i){"|".join(fixed.LOW_VALUE_PATTERNS)}')
   OR (({q.word_count('t')}) > 6 AND right(t, 1) NOT IN ('.', '!', '?')) AS low_value FROM t""",
    low_value=gates.is_low_value,
)

GATE = f"""({{t}} <> '' AND length({{t}}) <= 140 AND NOT {q.contains_any('{t}', fixed.GATE_BLOCKED)}
  AND NOT (({q.word_count('{t}')}) > 6 AND right({{t}}, 1) NOT IN ('.', '!', '?'))
  AND (({q.word_count('{t}')}) < 3 OR list_has_any(string_split({q.squash('{t}')}, ' '), [{{known}}])))"""
GATE = GATE.replace("{{", "{").replace("}}", "}")

over_turns(
    "passes_gate_b20",
    f"""
WITH t AS (SELECT conv_id, turn, {q.strip('lower(text)')} AS t FROM conversations)
SELECT conv_id, turn, {GATE.format(t='t', known=q.quoted(OCCURRING_WORDS))} AS passes FROM t""",
    passes=lambda c: gates.passes_gate(c, known=OCCURRING_WORDS),
)
LENIENT = f"""({{t}} <> '' AND length({{t}}) <= 200 AND NOT {q.contains_any('lower({t})', fixed.LENIENT_BLOCKED)})"""
LENIENT = LENIENT.replace("{{", "{").replace("}}", "}")
over_turns(
    "passes_lenient_b21",
    f"SELECT conv_id, turn, {LENIENT.format(t=q.strip('text'))} AS passes FROM conversations",
    passes=gates.passes_lenient,
)

TEMPLATED = f"({q.contains_any('{t}', fixed.TEMPLATED)})"


@query(
    "write_gate_b22",
    f"""WITH s AS (SELECT conv_id, turn, role = 'assistant' AS made, (conv_id + turn) % 5 = 0 AS linked, {q.strip('text')} AS t FROM conversations)
SELECT conv_id, turn,
  CASE WHEN t = '' OR (linked AND NOT made) OR {TEMPLATED.format(t='t')} OR NOT made OR NOT {LENIENT.format(t='t')}
    THEN NULL ELSE t END AS policy_none,
  CASE WHEN t = '' OR (linked AND NOT made) OR {TEMPLATED.format(t='t')} OR NOT made THEN NULL ELSE t END AS policy_doc_only,
  CASE WHEN t = '' OR (linked AND NOT made) OR {TEMPLATED.format(t='t')}
    OR (NOT made AND NOT {GATE.format(t='lower(t)', known=q.quoted(fixed.GATE_KNOWN))}) THEN NULL ELSE t END AS policy_gated
FROM s""",
)
def write_gate(spark, sf_dir):
    made = F.col("role") == "assistant"
    kind = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "CONNECTOR").otherwise("PICTURE")
    named = {"policy_none": "none", "policy_doc_only": "doc-only", "policy_gated": "ppt-gated"}
    return views.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", *[gates.write_gate("text", kind, made, ~made, policy).alias(n) for n, policy in named.items()]
    )


ERROR = f"({{t}} = '' OR {q.contains_any('lower({t})', fixed.ERROR_TEXTS)})".replace("{{", "{").replace("}}", "}")


@query(
    "is_error_text_b23",
    f"""WITH {views.ELEMENTS_SQL} SELECT shape_id, {ERROR.format(t=q.strip('generated_alt'))} AS is_error,
  length({q.strip('generated_alt')}) < 3 OR {q.contains_any('lower(generated_alt)', fixed.FAILURE_TEXTS)} AS is_failure FROM elements""",
)
def is_error_text(spark, sf_dir):
    return views.elements(spark, sf_dir).select(
        "shape_id",
        gates.is_error_text("generated_alt").alias("is_error"),
        gates.is_error_text("generated_alt", fixed.FAILURE_TEXTS, shortest=3).alias("is_failure"),
    )


@query(
    "is_empty_placeholder_b24",
    f"""WITH {views.ELEMENTS_SQL}, t AS (SELECT shape_id, shape_type,
  CASE WHEN height % 3 = 0 THEN '' WHEN height % 3 = 1 THEN 'Click to add text' ELSE text END AS txt FROM elements)
SELECT shape_id, shape_type IN ('TEXT_BOX', 'PLACEHOLDER') AND ({q.strip('txt')} = ''
   OR {q.contains_any('lower(txt)', fixed.EMPTY_PROMPTS)}) AS is_empty FROM t""",
)
def is_empty_placeholder(spark, sf_dir):
    kind = F.col("height") % 3
    return views.elements(spark, sf_dir).select(
        "shape_id",
        gates.is_empty_placeholder(
            "shape_type", F.when(kind == 0, "").when(kind == 1, "Click to add text").otherwise(F.col("text"))
        ).alias("is_empty"),
    )


@query(
    "is_skip_value_b25",
    f"""WITH {views.ELEMENTS_SQL}, t AS (SELECT shape_id, existing_alt,
  ['N/A', 'n/a', 'None', '(None)', 'undefined ', 'Undefined', 'x'][width % 7 + 1] AS v FROM elements)
SELECT shape_id, existing_alt = '' OR {q.strip('existing_alt')} IN ({q.quoted(fixed.SKIP_VALUES)}) AS skip_existing,
  {q.strip('v')} IN ({q.quoted(fixed.SKIP_VALUES)}) AS skip_value FROM t""",
)
def is_skip_value(spark, sf_dir):
    value = views.pick(["N/A", "n/a", "None", "(None)", "undefined ", "Undefined", "x"], F.col("width"))
    return views.elements(spark, sf_dir).select(
        "shape_id", gates.is_skip_value("existing_alt").alias("skip_existing"), gates.is_skip_value(value).alias("skip_value")
    )


def turn_pairs(spark, sf_dir):
    """Each turn with the turn after it."""
    t = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    following = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return t.join(following, ["conv_id", "turn"])


PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text, b.text AS next_text FROM conversations a
   JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


@query(
    "word_jaccard_b26",
    f"""WITH {PAIRS}, w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower({q.squash('text')}), ' '), lambda x: x <> '')) AS a,
   list_distinct(list_filter(string_split(lower({q.squash('next_text')}), ' '), lambda x: x <> '')) AS b FROM pairs),
s AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
   ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS s FROM w)
SELECT conv_id, turn, round(s, 6) AS jaccard, s >= 0.1 AS same FROM s""",
)
def word_jaccard(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.round(gates.word_jaccard("text", "next_text"), 6).alias("jaccard"),
        gates.mostly_same("text", "next_text", 0.1).alias("same"),
    )


@query(
    "needs_replace_b27",
    f"""WITH {UNIVERSAL.format(source='documents')},
s AS (SELECT doc_id, {q.strip('text')} AS s FROM documents)
SELECT doc_id, lower({q.cap('m')}) <> lower(u) AS replace_first, u <> '' AS replace_blank, true AS same_spaced
FROM universal JOIN (SELECT doc_id, {q.end_mark("trim(split_part(regexp_replace(" + q.squash('text') + ", '([.!?])\\s+', '\\1' || chr(1)), chr(1), 1), ' .')")} AS m FROM documents) USING (doc_id)""",
)
def needs_replace(spark, sf_dir):
    first = F.element_at(F.split("text", r"(?<=[.!?])\s+", 2), 1)
    return documents(spark, sf_dir).select(
        "doc_id",
        gates.needs_replace(first, "text").alias("replace_first"),
        gates.needs_replace(F.lit(""), "text").alias("replace_blank"),
        gates.equivalent("text", F.concat(F.lit(" \n"), F.regexp_replace("text", " ", "  "), F.lit(" "))).alias("same_spaced"),
    )


@query(
    "punct_diff_b28",
    f"""WITH {PAIRS}, e AS (SELECT *, right(text, 1) IN ('.', '!', '?') AS pt, right(next_text, 1) IN ('.', '!', '?') AS pn FROM pairs),
r AS (SELECT conv_id, turn, CASE WHEN text = '' OR next_text = '' THEN 'empty_text'
   WHEN pt <> pn THEN 'terminal_punctuation_mismatch'
   WHEN pt AND right(text, 1) <> right(next_text, 1) THEN 'different_terminal_punctuation'
   WHEN regexp_replace(text, '[.!?]+$', '') = regexp_replace(next_text, '[.!?]+$', '') AND text <> next_text THEN 'punctuation_only_difference'
   ELSE 'no_punctuation_issue' END AS reason FROM e)
SELECT conv_id, turn, reason NOT IN ('empty_text', 'no_punctuation_issue') AS has_issue, reason FROM r""",
)
def punct_diff(spark, sf_dir):
    found = gates.punct_diff("text", "next_text")
    return turn_pairs(spark, sf_dir).select(
        "conv_id", "turn", found["has_issue"].alias("has_issue"), found["reason"].alias("reason")
    )


over_documents(
    "digest_b29",
    """SELECT doc_id, md5(text) AS md5_full, left(md5(text), 8) AS md5_short, sha1(text) AS sha1_full, sha256(text) AS sha256_full,
  left(sha256(text), 16) AS sha256_short, left(sha1(text), 8) AS rerun,
  left(md5('PICTURE_' || doc_id || '_' || length(text)), 8) AS properties FROM documents""",
    md5_full=lambda c: keys.digest(c, "md5"),
    md5_short=lambda c: keys.digest(c, "md5", 8),
    sha1_full=lambda c: keys.digest(c, "sha1"),
    sha256_full=lambda c: keys.digest(c, "sha256"),
    sha256_short=lambda c: keys.digest(c, "sha256", 16),
    rerun=keys.text_hash,
    properties=lambda c: keys.properties_hash(F.lit("PICTURE"), "doc_id", F.length(c)),
)


@query(
    "key_builders_b30",
    f"""WITH {views.ELEMENTS_SQL}, h AS (SELECT *, CASE WHEN shape_type = 'PICTURE' THEN image_hash ELSE '' END AS ih FROM elements)
SELECT shape_id, 'slide_' || slide_idx || '_shape_' || shape_id AS instance,
  'slide_' || slide_idx || '_shapeid_' || shape_id || '_hash_' || left(image_hash, 8) AS stable,
  'slide_' || slide_idx || '_shapeid_' || shape_id || '_hash_' || CASE WHEN ih = '' THEN '00000000' ELSE left(ih, 8) END AS image,
  'slide_' || slide_idx || '_shape_' || slide_idx || '_' || shape_idx || '_hash_' || CASE WHEN ih = '' THEN '00000000' ELSE left(ih, 8) END AS nested,
  'slide_' || slide_idx || '_shapeid_' || shape_id || '_hash_' || CASE WHEN ih = '' THEN left(slide_idx || shape_id::VARCHAR || 'img', 8) ELSE left(ih, 8) END AS element
FROM h""",
)
def key_builders(spark, sf_dir):
    e = views.elements(spark, sf_dir).withColumn(
        "ih", F.when(F.col("shape_type") == "PICTURE", F.col("image_hash")).otherwise("")
    )
    return e.select(
        "shape_id",
        keys.instance_key("slide_idx", "shape_id").alias("instance"),
        keys.stable_key("slide_idx", "shape_id", "image_hash").alias("stable"),
        keys.image_key("slide_idx", "shape_id", "ih").alias("image"),
        keys.image_key("slide_idx", keys.nested_shape("slide_idx", "shape_idx"), "ih").alias("nested"),
        keys.element_key("slide_idx", "shape_id", "shape_idx", "ih").alias("element"),
    )


@query(
    "parse_key_b31",
    f"""WITH {views.ELEMENTS_SQL} SELECT shape_id, slide_idx AS strict_slide, shape_id AS strict_shape,
  slide_idx AS loose_slide, slide_idx || '_' || shape_idx || '_7' AS loose_shape, 'abc' AS loose_name,
  left(image_hash, 8) AS loose_hash, true AS bad_is_null,
  'slide_' || slide_idx || '_shapeid_' || shape_id || '_5_hash_' || left(image_hash, 8) AS child_key FROM elements""",
)
def parse_key(spark, sf_dir):
    stable = keys.stable_key("slide_idx", "shape_id", "image_hash")
    nested = F.concat(
        F.lit("slide_"), F.col("slide_idx").cast("string"), F.lit("_shape_"), keys.nested_shape("slide_idx", "shape_idx", F.lit(7)),
        F.lit("_name_abc_hash_"), F.left("image_hash", F.lit(8)),
    )
    strict, loose = keys.parse_key(stable), keys.parse_key_loose(nested)
    return views.elements(spark, sf_dir).select(
        "shape_id",
        strict["slide_idx"].alias("strict_slide"),
        strict["shape_idx"].alias("strict_shape"),
        loose["slide_idx"].alias("loose_slide"),
        loose["shape_idx"].alias("loose_shape"),
        loose["name"].alias("loose_name"),
        loose["hash"].alias("loose_hash"),
        keys.parse_key(F.concat(F.lit("page_"), "instance_key")).isNull().alias("bad_is_null"),
        keys.nested_key(stable, F.lit(5)).alias("child_key"),
    )


over_documents(
    "cut_tokens_b55",
    f"""SELECT doc_id, CASE WHEN ({q.word_count('text')}) <= 38 THEN text
  ELSE array_to_string(string_split({q.squash('text')}, ' ')[1:38], ' ') || '...' END AS alt FROM documents""",
    alt=lambda c: text.cut_tokens(c, 50),
)
over_documents(
    "is_vague_b47",
    f"SELECT doc_id, {q.contains_any('lower(text)', ['en la', 'of the', 'zu der'])} AS vague FROM documents",
    vague=lambda c: gates.is_vague(c, ["en la", "of the", "zu der"]),
)

PREFIXED = "regexp_replace({t}, '(?i)^" + q.alternation(fixed.VAGUE_PREFIXES) + "[ ,.\\-]*', '')"

@query(
    "post_process_u03",
    f"""WITH {views.ELEMENTS_SQL},
a AS (SELECT shape_id, {q.strip('generated_alt')} AS t FROM elements),
b AS (SELECT shape_id, CASE WHEN ({q.word_count('t')}) > 30 OR ends_with(t, '...') THEN {FIRST_WORDS.format(t='t')} ELSE t END AS t FROM a),
c AS (SELECT shape_id, {PREFIXED.format(t=q.strip('t'))} AS t FROM b),
d AS (SELECT shape_id, {q.squash(q.full_cap('t'))} AS t FROM c),
e AS (SELECT shape_id, {SHRUNK.format(t='t')} AS t FROM d)
SELECT shape_id, {q.end_mark('t')} AS alt FROM e""",
)
def post_process(spark, sf_dir):
    return views.elements(spark, sf_dir).select("shape_id", text.post_process("generated_alt").alias("alt"))


@query(
    "validate_generated_u04",
    f"""WITH {views.ELEMENTS_SQL}, t AS (SELECT shape_id, CASE WHEN shape_id % 17 = 0 THEN NULL ELSE {q.strip('generated_alt')} END AS t FROM elements),
r AS (SELECT shape_id, t, CASE WHEN t IS NULL THEN 'none_returned' WHEN t = '' THEN 'empty' WHEN length(t) < 3 THEN 'too_short'
  {' '.join(f"WHEN contains(lower(t), '{p}') THEN 'failure_text: {p}'" for p in fixed.FAILURE_TEXTS)} END AS failure_reason FROM t)
SELECT shape_id, CASE WHEN failure_reason IS NULL THEN t END AS alt, failure_reason FROM r""",
)
def validate_generated(spark, sf_dir):
    given = F.when(F.col("shape_id") % 17 != 0, F.col("generated_alt"))
    checked = gates.validate_generated(given)
    return views.elements(spark, sf_dir).select(
        "shape_id", checked["text"].alias("alt"), checked["failure_reason"].alias("failure_reason")
    )
