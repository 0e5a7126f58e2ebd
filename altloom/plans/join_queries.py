"""Joins over elements, stored texts and provider calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from altloom import views
from altloom.functions import fixed, keys, phash, review
from altloom.operators import joins, reuse, similar
from altloom.plans import sql as q
from altloom.plans.decisions import CACHED_SQL
from altloom.plans.registry import query
from altloom.plans.text_queries import TEMPLATED

HASHES_SQL = f"""{views.GRIDS_SQL},
bits AS (SELECT id, array_to_string(list_transform(cells, lambda x: CASE WHEN x::DOUBLE > list_sum(list_transform(cells, lambda y: y::DOUBLE)) / len(cells) THEN '1' ELSE '0' END), '') AS a,
   array_to_string(list_transform(list_filter(range(0, len(cells)), lambda n: n % 8 < 7), lambda n: CASE WHEN cells[n + 2] > cells[n + 1] THEN '1' ELSE '0' END), '') AS d FROM grids)"""


def hex_of(x, digits):
    parts = [
        f"substr('0123456789abcdef', (ascii(substr({x}, {4 * i + 1}, 1)) - 48) * 8 + (ascii(substr({x}, {4 * i + 2}, 1)) - 48) * 4"
        f" + (ascii(substr({x}, {4 * i + 3}, 1)) - 48) * 2 + (ascii(substr({x}, {4 * i + 4}, 1)) - 48) + 1, 1)"
        for i in range(digits)
    ]
    return " || ".join(parts)


def hashes(spark, sf_dir):
    return views.grids(spark, sf_dir).select("id", phash.ahash("cells").alias("ahash"), phash.dhash("cells", 8).alias("dhash"))


@query(
    "reuse_by_content_d01",
    f"WITH {CACHED_SQL} SELECT uid, cached_alt IS NOT NULL AS hit, cached_alt FROM cached",
)
def reuse_by_content(spark, sf_dir):
    e = views.elements(spark, sf_dir).select("uid", *reuse.OWNER, "content_key", "final_alt")
    found = reuse.with_cache(e, e, "content_key", "final_alt")
    return found.select("uid", F.col("cached_alt").isNotNull().alias("hit"), "cached_alt")


@query(
    "reuse_by_image_d02",
    f"""WITH {views.ELEMENTS_SQL}, c AS (SELECT image_hash, arg_max(generated_alt, (slide_idx, deck, shape_id)) AS l, arg_max(uid, (slide_idx, deck, shape_id)) AS li,
   arg_min(generated_alt, (slide_idx, deck, shape_id)) AS f, arg_min(uid, (slide_idx, deck, shape_id)) AS fi FROM elements WHERE trim(generated_alt) <> '' GROUP BY 1)
SELECT uid, CASE WHEN li <> uid THEN l WHEN fi <> uid THEN f END AS cached_alt FROM elements LEFT JOIN c USING (image_hash)""",
)
def reuse_by_image(spark, sf_dir):
    e = views.elements(spark, sf_dir).select("uid", *reuse.OWNER, "image_hash", "generated_alt")
    found = reuse.with_cache(e, e, "image_hash", "generated_alt", order=["slide_idx"])
    return found.select("uid", "cached_alt")


def stored(spark, sf_dir):
    """Index, current and generated texts as the stages store them."""
    e = views.elements(spark, sf_dir)
    index = e.select("deck", F.col("instance_key").alias("key"))
    current = e.filter("existing_alt <> ''").select("deck", F.col("instance_key").alias("key"), F.col("existing_alt").alias("text"))
    generated = e.filter("generated_alt <> '' AND shape_type <> 'LINE'").select(
        "deck", F.col("instance_key").alias("key"), F.col("generated_alt").alias("text")
    )
    return index, current, generated


STORED_SQL = f"""{views.ELEMENTS_SQL}, idx AS (SELECT deck, instance_key AS key, coalesce({q.strip('existing_alt')}, '') AS e,
   CASE WHEN shape_type <> 'LINE' THEN {q.strip('generated_alt')} ELSE '' END AS g FROM elements),
resolved AS (SELECT deck, key, e AS existing_alt, g AS generated_alt, lower(e) NOT IN ({q.quoted(fixed.SKIP_TOKENS)}) AS em, lower(g) NOT IN ({q.quoted(fixed.SKIP_TOKENS)}) AS gm FROM idx)"""


@query(
    "resolve_d03",
    f"""WITH {STORED_SQL} SELECT deck, key, existing_alt, generated_alt, CASE WHEN em THEN 'pptx' END AS source_existing, CASE WHEN gm THEN 'llava' END AS source_generated,
  CASE WHEN em THEN existing_alt WHEN gm THEN generated_alt END AS final_alt, CASE WHEN em THEN 'preserve_existing' WHEN gm THEN 'use_generated' ELSE 'no_alt_available' END AS decision FROM resolved""",
)
def resolve(spark, sf_dir):
    return joins.resolve(*stored(spark, sf_dir))


@query(
    "resolve_summary_d03",
    f"""WITH {STORED_SQL} SELECT count(*) AS total, count_if(existing_alt <> '' OR generated_alt <> '') AS mapped, count_if(em) AS preserved, count_if(NOT em AND gm) AS generated,
  count_if(NOT em AND NOT gm) AS missing, round(count_if(existing_alt <> '' OR generated_alt <> '') * 100 / count(*), 6) AS coverage_percent,
  round(count_if(em OR gm) * 100 / count(*), 6) AS strict_percent FROM resolved""",
)
def resolve_summary(spark, sf_dir):
    return joins.resolve_summary(joins.resolve(*stored(spark, sf_dir)))


@query(
    "enrich_d04",
    f"""WITH {STORED_SQL} SELECT deck, key, existing_alt, generated_alt, CASE WHEN em THEN 'pptx' END AS source_existing, CASE WHEN generated_alt <> '' THEN 'llava' END AS source_generated,
  em AS existing_meaningful FROM resolved""",
)
def enrich(spark, sf_dir):
    index, current, generated = stored(spark, sf_dir)
    images = index.join(current.withColumnRenamed("text", "existing_alt"), joins.KEY, "left")
    return joins.enrich(images, generated)


def stored_keys(spark, sf_dir):
    """Keys as an older run may have stored them: some right, some shifted."""
    e = views.elements(spark, sf_dir)
    slide, short = F.col("slide_idx"), F.left("image_hash", F.lit(8))

    def made(at, label, shape, hashed):
        return F.concat(F.lit("slide_"), at.cast("string"), F.lit(f"_{label}_"), shape.cast("string"), F.lit("_hash_"), hashed)

    shape = F.col("shape_id")
    key = (
        F.when(F.col("width") % 7 == 0, made(slide, "shapeid", shape, short))
        .when(F.col("width") % 7 == 1, made(slide, "shape", shape, F.lit("0000aaaa")))
        .when(F.col("width") % 7 == 2, made(slide + 1, "shapeid", shape, short))
        .when(F.col("width") % 7 == 3, made(slide - 1, "shape", shape, short))
        .when(F.col("width") % 7 == 4, made(slide, "shapeid", shape + 5000000000, F.substring("image_hash", 9, 10)))
        .when(F.col("width") % 7 == 5, made(slide, "shapeid", shape + 5000000000, F.substring("image_hash", 3, 5)))
        .otherwise(F.concat(F.lit("page_"), shape.cast("string")))
    )
    elements = e.select(
        "deck", keys.stable_key("slide_idx", "shape_id", "image_hash").alias("element_key"), "slide_idx", "shape_id",
        "image_hash", F.col("shape_idx").alias("position"),
    )
    return e.select("deck", key.alias("key")), elements


KEYS_SQL = f"""{views.ELEMENTS_SQL},
k AS (SELECT deck, CASE width % 7 WHEN 0 THEN 'slide_' || slide_idx || '_shapeid_' || shape_id || '_hash_' || left(image_hash, 8)
  WHEN 1 THEN 'slide_' || slide_idx || '_shape_' || shape_id || '_hash_0000aaaa' WHEN 2 THEN 'slide_' || (slide_idx + 1) || '_shapeid_' || shape_id || '_hash_' || left(image_hash, 8)
  WHEN 3 THEN 'slide_' || (slide_idx - 1) || '_shape_' || shape_id || '_hash_' || left(image_hash, 8)
  WHEN 4 THEN 'slide_' || slide_idx || '_shapeid_' || (shape_id + 5000000000) || '_hash_' || substr(image_hash, 9, 10)
  WHEN 5 THEN 'slide_' || slide_idx || '_shapeid_' || (shape_id + 5000000000) || '_hash_' || substr(image_hash, 3, 5) ELSE 'page_' || shape_id END AS key FROM elements),
el AS (SELECT deck, 'slide_' || slide_idx || '_shapeid_' || shape_id || '_hash_' || left(image_hash, 8) AS element_key, slide_idx, shape_id, image_hash, shape_idx AS position FROM elements),
p AS (SELECT deck, key, TRY_CAST(regexp_extract(key, 'slide_(\\d+)', 1) AS INT) AS s, regexp_extract(key, '_shape(?:id)?_([^_]+)', 1) AS sh, regexp_extract(key, '_hash_([^_]+)', 1) AS h FROM k),
hits AS (
  SELECT p.deck, key, 1 AS rule, position, element_key FROM p JOIN el ON p.deck = el.deck AND key = element_key
  UNION ALL SELECT p.deck, key, 2, position, element_key FROM p JOIN el ON p.deck = el.deck AND s = slide_idx AND sh = shape_id::VARCHAR
  UNION ALL SELECT p.deck, key, 3 + 2 * d.i, position, element_key FROM p CROSS JOIN (VALUES (0, 0), (1, 1), (2, -1)) d(i, v) JOIN el ON p.deck = el.deck AND element_key = 'slide_' || (s + v) || '_shapeid_' || sh || '_hash_' || h
  UNION ALL SELECT p.deck, key, 9, position, element_key FROM p JOIN el ON p.deck = el.deck AND s = slide_idx AND h <> '' AND contains(image_hash, h))"""


@query(
    "match_keys_d05",
    f"WITH {KEYS_SQL} SELECT deck, key, rule, element_key FROM hits QUALIFY row_number() OVER (PARTITION BY deck, key ORDER BY rule, position) = 1",
)
def match_keys(spark, sf_dir):
    return joins.match_keys(*stored_keys(spark, sf_dir))


@query(
    "missing_d06",
    f"""WITH {KEYS_SQL} SELECT deck, element_key AS key, 'missing' AS problem FROM el ANTI JOIN k ON el.deck = k.deck AND element_key = k.key
UNION ALL SELECT deck, key, 'unmatched' FROM k ANTI JOIN el ON el.deck = k.deck AND element_key = k.key""",
)
def missing(spark, sf_dir):
    asked, elements = stored_keys(spark, sf_dir)
    return joins.missing(elements.select("deck", F.col("element_key").alias("key")), asked)


@query("pending_keys_d07", f"WITH {STORED_SQL} SELECT deck, key FROM resolved WHERE existing_alt = '' AND generated_alt = ''")
def pending_keys(spark, sf_dir):
    return joins.pending_keys(*stored(spark, sf_dir))


def written(spark, sf_dir):
    """Expected texts and what a read-back might find."""
    e = views.elements(spark, sf_dir)
    expected = e.select("deck", F.col("instance_key").alias("key"), F.concat("slide_text", F.lit(".")).alias("text"))
    found = (
        F.when(F.col("width") % 5 == 0, F.col("slide_text"))
        .when(F.col("width") % 5 == 1, F.concat(F.lower("slide_text"), F.lit(".")))
        .when(F.col("width") % 5 == 2, F.lit("This is a PowerPoint shape"))
        .when(F.col("width") % 5 == 3, F.concat("slide_text", F.lit(".")))
    )
    return expected, e.select("deck", F.col("instance_key").alias("key"), found.alias("text"))


def level(x):
    words = f"string_split(lower({q.squash(x)}), ' ')"
    cased = f"array_to_string(list_transform({words}, lambda w, i: CASE WHEN i = 1 OR w IN ({q.quoted(fixed.PROPER_NOUNS)}) THEN {q.cap('w')} ELSE w END), ' ')"
    return f"CASE WHEN {x} = '' THEN '' ELSE regexp_replace({cased}, '[.!?]+$', '') || '.' END"


def bag(x):
    return f"list_distinct(list_filter(string_split(lower({q.squash(x)}), ' '), lambda w: w <> ''))"


VERIFIED_SQL = f"""{views.ELEMENTS_SQL}, w AS (SELECT deck, instance_key AS key, {q.strip("slide_text || '.'")} AS e, coalesce({q.strip("CASE width % 5 WHEN 0 THEN slide_text WHEN 1 THEN lower(slide_text) || '.' WHEN 2 THEN 'This is a PowerPoint shape' WHEN 3 THEN slide_text || '.' END")}, '') AS a FROM elements),
l AS (SELECT *, {level('e')} = {level('a')} AS levelled, {bag('e')} AS be, {bag('a')} AS ba FROM w),
checked AS (SELECT deck, key, e = a AS exact, levelled, len(ba) > 0 AND len(list_intersect(be, ba)) / len(list_distinct(list_concat(be, ba))) >= 0.8 AS mostly_same,
   length(a) - length(e) AS length_diff, CASE WHEN e = a THEN NULL WHEN a = '' THEN 'empty_text' WHEN right(a, 1) NOT IN ('.', '!', '?') THEN 'terminal_punctuation_mismatch'
     WHEN right(a, 1) <> right(e, 1) THEN 'different_terminal_punctuation' WHEN regexp_replace(e, '[.!?]+$', '') = regexp_replace(a, '[.!?]+$', '') THEN 'punctuation_only_difference' ELSE 'no_punctuation_issue' END AS punctuation,
   NOT levelled AND {TEMPLATED.format(t='a')} AS repair FROM l)"""


@query("verify_d08", f"WITH {VERIFIED_SQL} SELECT * FROM checked")
def verify(spark, sf_dir):
    return joins.verify(*written(spark, sf_dir))


@query(
    "verify_summary_d08",
    f"""WITH {VERIFIED_SQL} SELECT count(*) AS checked, count_if(exact) AS verified, count_if(NOT exact) AS mismatches, count_if(levelled) AS levelled, count_if(mostly_same) AS mostly_same,
  count_if(repair) AS repairs FROM checked""",
)
def verify_summary(spark, sf_dir):
    return joins.verify_summary(joins.verify(*written(spark, sf_dir)))


@query(
    "verify_review_d09",
    f"""WITH {views.ELEMENTS_SQL}, e AS (SELECT deck, slide_idx || '/' || shape_idx AS label, existing_alt AS ea, CASE WHEN width % 2 = 0 THEN 'preserve_existing' ELSE 'cached' END AS reason FROM elements WHERE height % 10 <> 0),
r AS (SELECT deck, slide_idx || '/' || shape_idx AS label, {q.strip("CASE WHEN top % 3 = 0 THEN slide_text WHEN existing_alt = '' THEN '[No ALT text]' ELSE existing_alt END")} AS cur,
   CASE WHEN height % 4 = 0 THEN 'new text' WHEN height % 4 = 1 THEN '' ELSE '{review.KEEP_HINT}' END AS sug FROM elements WHERE height % 10 <> 1),
p AS (SELECT coalesce(e.deck, r.deck) AS deck, coalesce(e.label, r.label) AS label, [CASE WHEN r.label IS NULL THEN 'no_review_row' END, CASE WHEN e.label IS NULL THEN 'no_entry' END,
   CASE WHEN reason = 'preserve_existing' AND cur IS NOT NULL AND ea <> '' AND cur <> ea THEN 'current_mismatch' END, CASE WHEN reason = 'preserve_existing' AND ea = '' AND cur NOT IN ('[No ALT text]', '') THEN 'current_not_empty' END,
   CASE WHEN reason = 'preserve_existing' AND sug = 'new text' THEN 'suggested_not_blank' END] AS ps FROM e FULL JOIN r ON e.deck = r.deck AND e.label = r.label)
SELECT deck, label, problem FROM (SELECT deck, label, unnest(ps) AS problem FROM p) WHERE problem IS NOT NULL""",
)
def verify_review(spark, sf_dir):
    e = views.elements(spark, sf_dir).withColumn("label", F.concat_ws("/", F.col("slide_idx").cast("string"), F.col("shape_idx").cast("string")))
    entries = e.filter("height % 10 <> 0").select(
        "deck", "label", "existing_alt", F.when(F.col("width") % 2 == 0, "preserve_existing").otherwise("cached").alias("reason")
    )
    shown = e.filter("height % 10 <> 1").select(
        "deck",
        "label",
        F.when(F.col("top") % 3 == 0, F.col("slide_text")).when(F.col("existing_alt") == "", review.NO_ALT)
        .otherwise(F.col("existing_alt")).alias("current_cell"),
        F.when(F.col("height") % 4 == 0, "new text").when(F.col("height") % 4 == 1, "").otherwise(review.KEEP_HINT).alias("suggested_cell"),
    )
    return joins.verify_review(entries, shown, review.KEEP_HINT)


@query(
    "report_rows_d10",
    f"""WITH {views.ELEMENTS_SQL}, ctx AS (SELECT deck, slide_idx, arg_min(slide_text, shape_idx) AS context FROM elements WHERE slide_idx > 0 GROUP BY 1, 2),
j AS (SELECT deck, instance_key AS key, context, height < 40 AS deco, nullif({q.strip('existing_alt')}, '') AS o,
   CASE WHEN width % 4 <> 0 THEN nullif({q.strip("CASE WHEN width % 3 = 0 THEN shape_name ELSE '' END")}, '') END AS me,
   CASE WHEN width % 4 <> 0 THEN coalesce(nullif({q.strip('final_alt')}, ''), nullif({q.strip('generated_alt')}, '')) END AS off FROM elements LEFT JOIN ctx USING (deck, slide_idx)),
s AS (SELECT deck, key, context, deco, coalesce(o, me, '[No ALT text]') AS cur, coalesce(o, me, off, '[No ALT text]') AS sug FROM j),
st AS (SELECT *, CASE WHEN deco THEN 'decorative_skipped' WHEN cur <> '[No ALT text]' AND {q.contains_any('lower(cur)', review.GENERIC_PHRASES)} THEN 'fallback_injected'
   WHEN cur <> '[No ALT text]' AND cur = sug THEN 'generated' WHEN cur <> '[No ALT text]' THEN 'preserved' ELSE 'needs_alt' END AS status FROM s)
SELECT deck, key, cur AS current, sug AS suggested, status, CASE status WHEN 'decorative_skipped' THEN 'Decorative' WHEN 'fallback_injected' THEN 'Fallback (PPT-gated)' WHEN 'generated' THEN 'Generated'
   WHEN 'preserved' THEN 'Preserved' ELSE 'Needs ALT' END AS status_label, context FROM st""",
)
def report_rows(spark, sf_dir):
    e = views.elements(spark, sf_dir).withColumn("slide_key", F.struct("deck", "slide_idx"))
    original = e.select(
        "deck", F.col("instance_key").alias("key"), "slide_key", (F.col("height") < 40).alias("decorative"), F.col("existing_alt").alias("text")
    )
    final_map = e.filter("width % 4 <> 0").select(
        "deck", F.col("instance_key").alias("key"), F.when(F.col("width") % 3 == 0, F.col("shape_name")).otherwise("").alias("existing_alt"),
        "generated_alt", "final_alt",
    )
    context = e.filter("slide_idx > 0").groupBy("slide_key").agg(F.min_by("slide_text", "shape_idx").alias("context"))
    return joins.report_rows(original, final_map, context)


@query(
    "group_children_d11",
    f"""WITH {views.ELEMENTS_SQL} SELECT c.deck, c.slide_idx, c.parent_id, c.shape_id, c.shape_type FROM elements c JOIN elements g
   ON g.deck = c.deck AND g.slide_idx = c.slide_idx AND g.shape_id = c.parent_id AND g.shape_type = 'GROUP'""",
)
def group_children(spark, sf_dir):
    return joins.group_children(views.elements(spark, sf_dir))


PAIRS_SQL = f"""{HASHES_SQL}, f AS (SELECT a, min(id) AS first_id, count(*) AS copies FROM bits GROUP BY a),
pairs AS (SELECT y.first_id, y.copies, x.first_id AS match_id, bit_count(xor(x.a::BIT, y.a::BIT)) AS distance FROM f x JOIN f y ON x.first_id <> y.first_id AND bit_count(xor(x.a::BIT, y.a::BIT)) <= 5)"""


@query(
    "similar_pairs_d12",
    f"""WITH {PAIRS_SQL}, m AS (SELECT first_id, min((distance, match_id)) FILTER (match_id < first_id) AS best, any_value(copies) AS copies, count(*) AS links FROM pairs GROUP BY first_id)
SELECT first_id, copies, best[2] AS match_id, CAST(best[1] AS INT) AS distance, links FROM m""",
)
def similar_pairs(spark, sf_dir):
    return similar.best_matches(hashes(spark, sf_dir), "id", "ahash")


CONTENT_SQL = "'content:slide' || id % 1000000000000 % 9 || '-shape' || id % 1000000000000 || '-' || id % 1000000000000 % 7 || 'x4'"
CACHE_KEYS_SQL = f"['bytesha1:' || sha1(array_to_string(list_transform(cells, lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT)::VARCHAR), ',')), 'ahash:' || {hex_of('a', 16)}, 'dhash:' || {hex_of(chr(39) + '00000000' + chr(39) + ' || d', 16)}, {CONTENT_SQL}]"


def grid_keys(spark, sf_dir):
    content = F.array_join(F.transform("cells", lambda x: F.round(x.cast("double") * 1000).cast("bigint").cast("string")), ",")
    number = F.col("id") % 1000000000000
    return views.grids(spark, sf_dir).select(
        "id",
        phash.cache_keys(F.encode(content, "utf-8"), F.col("cells"), 8, number % 9, number, number % 7, F.lit(4)).alias("keys"),
    )


@query(
    "probe_keys_d13",
    f"""WITH {HASHES_SQL}, k AS (SELECT id, {CACHE_KEYS_SQL} AS ks FROM grids JOIN bits USING (id)),
cache AS (SELECT key, min(id) AS o FROM (SELECT id, unnest(ks) AS key FROM k WHERE id >= 1000000000000 OR id % 3 = 0) GROUP BY 1),
asked AS (SELECT id, unnest(ks) AS key, unnest(range(0, 4)) AS rank FROM k WHERE id < 1000000000000)
SELECT id, CAST(rank AS INT) AS rank, key, 'text of ' || o AS text FROM asked JOIN cache USING (key) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1""",
)
def probe_keys(spark, sf_dir):
    keyed = grid_keys(spark, sf_dir)
    copies = F.col("id") >= 1000000000000
    cache = keyed.filter(copies | (F.col("id") % 3 == 0)).select("id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("id").alias("o"))
    return joins.probe_keys(
        keyed.filter(~copies), cache.select("key", F.concat(F.lit("text of "), F.col("o").cast("string")).alias("text"))
    )


@query(
    "nearby_text_d14",
    f"""WITH {views.ELEMENTS_SQL}, c AS (SELECT *, "left" + width / 2 AS cx, top + height / 2 AS cy FROM elements),
near AS (SELECT i.uid AS id, {q.strip('b.text')} AS t, row_number() OVER (PARTITION BY i.uid ORDER BY b.shape_idx) AS n FROM c i JOIN c b
   ON i.deck = b.deck AND i.slide_idx = b.slide_idx AND {q.strip('b.text')} <> '' AND i.text = '' AND sqrt(power(i.cx - b.cx, 2) + power(i.cy - b.cy, 2)) < 250),
top3 AS (SELECT id, string_agg(t, ' ' ORDER BY n) AS near FROM near WHERE n <= 3 GROUP BY id)
SELECT uid AS id, near IS NOT NULL AS found, coalesce(near, {q.strip('left(slide_text, 500)')}) AS context FROM elements LEFT JOIN top3 ON id = uid WHERE text = ''""",
)
def nearby_text(spark, sf_dir):
    e = views.elements(spark, sf_dir)
    images = e.filter("text = ''").select(F.col("uid").alias("id"), "deck", "slide_idx", "left", "top", "width", "height", F.col("slide_text").alias("page_text"))
    blocks = e.select("deck", "slide_idx", "left", "top", "width", "height", F.col("shape_idx").alias("position"), "text")
    return joins.nearby_text(images, blocks, radius=250)


OVERLAYS_SQL = f"""{views.ELEMENTS_SQL}, pairs AS (SELECT a.deck, a.slide_idx, b.shape_id AS overlay_id, a.shape_id AS target_id, b.shape_idx - a.shape_idx AS z_delta,
   (least(a."left" + a.width, b."left" + b.width) - greatest(a."left", b."left")) AS w, (least(a.top + a.height, b.top + b.height) - greatest(a.top, b.top)) AS h, a.width * a.height AS area
   FROM elements a JOIN elements b ON a.deck = b.deck AND a.slide_idx = b.slide_idx AND a.shape_idx < b.shape_idx AND a.width > 0 AND a.height > 0 AND b.width > 0 AND b.height > 0),
overlays AS (SELECT deck, slide_idx, overlay_id, target_id, round(w * h / area, 6) AS overlap_share, z_delta FROM pairs WHERE w > 0 AND h > 0 AND w * h / area >= 0.02)"""


@query("overlays_d15", f"WITH {OVERLAYS_SQL} SELECT * FROM overlays")
def overlays(spark, sf_dir):
    return joins.overlays(views.elements(spark, sf_dir))


STREAK_SQL = f"""{views.ATTEMPTS_SQL}, isl AS (SELECT *, count_if(success) OVER (PARTITION BY provider ORDER BY ts, attempt_id) AS island FROM attempts),
streaks AS (SELECT *, CAST(count_if(NOT success) OVER (PARTITION BY provider, island ORDER BY ts, attempt_id) AS BIGINT) AS streak FROM isl)"""


@query(
    "retry_gate_d16",
    f"""WITH {STREAK_SQL}, req AS (SELECT attempt_id + 1 AS request_id, provider, ts + INTERVAL 3 SECOND AS ts FROM attempts),
j AS (SELECT r.*, s.ts AS seen_at, s.success, s.streak, CASE WHEN s.status_code IN (404, 401, 403) OR {q.contains_any("lower(coalesce(s.error, ''))", fixed.PERMANENT_TEXTS)} THEN 'permanent' ELSE 'temporary' END AS failure
   FROM req r ASOF LEFT JOIN streaks s ON r.provider = s.provider AND r.ts > s.ts)
SELECT request_id, provider, ts, coalesce(streak, 0) AS streak, CASE WHEN seen_at IS NULL OR success THEN true WHEN failure = 'permanent' THEN false
   ELSE ts >= seen_at + to_seconds(CAST(least(power(2, streak - 1), 60) AS INT)) END AS allowed FROM j""",
)
def retry_gate(spark, sf_dir):
    attempts = views.attempts(spark, sf_dir)
    requests = attempts.select(
        (F.col("attempt_id") + 1).alias("request_id"), "provider", F.timestamp_add("SECOND", F.lit(3), "ts").alias("ts")
    )
    return joins.retry_gate(requests, attempts)


# --- hashes ---------------------------------------------------------------------


@query("ahash_k01", f"WITH {HASHES_SQL} SELECT id, 'ahash:' || {hex_of('a', 16)} AS ahash FROM bits")
def ahash(spark, sf_dir):
    return hashes(spark, sf_dir).select("id", phash.hash_key("ahash", F.col("ahash")).alias("ahash"))


@query("dhash_k02", f"WITH {HASHES_SQL} SELECT id, 'dhash:' || {hex_of('d', 14)} AS dhash FROM bits")
def dhash(spark, sf_dir):
    return hashes(spark, sf_dir).select("id", phash.hash_key("dhash", F.col("dhash"), 56).alias("dhash"))


@query("cache_keys_k03", f"WITH {HASHES_SQL} SELECT id, array_to_string({CACHE_KEYS_SQL}, '|') AS keys FROM grids JOIN bits USING (id)")
def cache_keys(spark, sf_dir):
    return grid_keys(spark, sf_dir).select("id", F.array_join("keys", "|").alias("keys"))


@query(
    "hamming_k04",
    f"""WITH {HASHES_SQL}, p AS (SELECT x.id, x.a AS xa, y.a AS ya, x.d AS xd, y.d AS yd FROM bits x JOIN bits y ON y.id = x.id + 1000000000000)
SELECT id, CAST(bit_count(xor(xa::BIT, ya::BIT)) AS INT) AS ahash_distance, CAST(bit_count(xor(xd::BIT, yd::BIT)) AS INT) AS dhash_distance, true AS mixed_is_null, bit_count(xor(xa::BIT, ya::BIT)) <= 5 AS similar FROM p""",
)
def hamming(spark, sf_dir):
    h = hashes(spark, sf_dir).select(
        "id", phash.hash_key("ahash", F.col("ahash")).alias("a"), phash.hash_key("dhash", F.col("dhash"), 56).alias("d")
    )
    copy = h.select((F.col("id") - 1000000000000).alias("id"), F.col("a").alias("a2"), F.col("d").alias("d2"))
    return h.join(copy, "id").select(
        "id",
        phash.hamming("a", "a2").alias("ahash_distance"),
        phash.hamming("d", "d2").alias("dhash_distance"),
        phash.hamming("a", "d2").isNull().alias("mixed_is_null"),
        phash.is_similar("a", "a2").alias("similar"),
    )


@query(
    "similar_groups_k05",
    f"""WITH RECURSIVE {PAIRS_SQL}, e AS (SELECT first_id AS x, match_id AS y FROM pairs UNION SELECT match_id, first_id FROM pairs),
reach AS (SELECT x AS node, x AS seen FROM e UNION SELECT reach.node, e.y FROM reach JOIN e ON e.x = reach.seen)
SELECT node, min(seen) AS "group" FROM reach GROUP BY node""",
)
def similar_groups(spark, sf_dir):
    return similar.similar_groups(similar.spanning_links(hashes(spark, sf_dir), "id", "ahash"), "first_id", "match_id")
