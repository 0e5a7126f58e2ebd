"""Joins between elements, stored texts, requests and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from altloom.functions.base import is_blank, strip
from altloom.functions.gates import is_meaningful, is_templated, mostly_same, punct_diff
from altloom.functions.review import NO_ALT, backoff, derive_status, failure_class
from altloom.functions.text import compare_key
from altloom.operators.ordered import KEY, streaks
from altloom.operators.prefix import with_running


def text_of(name: str) -> Column:
    return F.coalesce(strip(name), F.lit(""))


def resolve(index: DataFrame, current: DataFrame, generated: DataFrame) -> DataFrame:
    """Preserve-first final map: ``current`` and ``generated`` are (deck, key, text)."""
    cur = current.select(*KEY, F.col("text").alias("existing_alt"))
    gen = generated.select(*KEY, F.col("text").alias("generated_alt"))
    keep, use = is_meaningful("existing_alt"), is_meaningful("generated_alt")
    return (
        index.select(*KEY)
        .join(cur, KEY, "left")
        .join(gen, KEY, "left")
        .select(*KEY, text_of("existing_alt").alias("existing_alt"), text_of("generated_alt").alias("generated_alt"))
        .select(
            "*",
            F.when(keep, "pptx").alias("source_existing"),
            F.when(use, "llava").alias("source_generated"),
            F.when(keep, F.col("existing_alt")).when(use, F.col("generated_alt")).alias("final_alt"),
            F.when(keep, "preserve_existing").when(use, "use_generated").otherwise("no_alt_available").alias("decision"),
        )
    )


def resolve_summary(resolved: DataFrame) -> DataFrame:
    """Counts and coverage; any text counts as mapped, as does a placeholder."""
    mapped = (F.col("existing_alt") != "") | (F.col("generated_alt") != "") | F.col("final_alt").isNotNull()
    total = F.count(F.lit(1))
    return resolved.agg(
        total.alias("total"),
        F.count_if(mapped).alias("mapped"),
        F.count_if(F.col("decision") == "preserve_existing").alias("preserved"),
        F.count_if(F.col("decision") == "use_generated").alias("generated"),
        F.count_if(F.col("decision") == "no_alt_available").alias("missing"),
        F.round(F.when(total > 0, F.count_if(mapped) * 100 / total).otherwise(0.0), 6).alias("coverage_percent"),
        F.round(F.when(total > 0, F.count("final_alt") * 100 / total).otherwise(0.0), 6).alias("strict_percent"),
    )


def enrich(images: DataFrame, results: DataFrame) -> DataFrame:
    """Images (deck, key, existing_alt) with their generated texts and provenance."""
    made = results.select(*KEY, F.col("text").alias("generated_alt"))
    real = is_meaningful("existing_alt")
    return images.join(made, KEY, "left").select(
        *KEY,
        text_of("existing_alt").alias("existing_alt"),
        text_of("generated_alt").alias("generated_alt"),
        F.when(real, "pptx").alias("source_existing"),
        F.when(text_of("generated_alt") != "", "llava").alias("source_generated"),
        real.alias("existing_meaningful"),
    )


# --- key matching --------------------------------------------------------------


def match_keys(keys: DataFrame, elements: DataFrame) -> DataFrame:
    """Element for every stored key, by the first rule that finds one.

    ``keys``: deck, key. ``elements``: deck, element_key, slide_idx, shape_id,
    image_hash, position. Rules in order: 1 same key; 2 same slide and shape;
    3–8 slide as is, after and before, in both spellings, with the hash; 9 the
    key's hash inside the hash of an element of the slide; its first characters
    are one case of that. Several elements under one rule: the first by position.
    """
    key = F.col("key")
    parsed = keys.select(
        "deck",
        "key",
        F.regexp_extract(key, r"(?:^|_)slide_(\d+)", 1).try_cast("int").alias("slide"),
        F.nullif(F.regexp_extract(key, r"_shape(?:id)?_([^_]+)", 1), F.lit("")).alias("shape"),
        F.nullif(F.regexp_extract(key, r"_hash_([^_]+)", 1), F.lit("")).alias("hash"),
    )

    def spelled(step: int, label: str) -> Column:
        slide = F.col("slide") + step
        made = F.concat(F.lit("slide_"), slide.cast("string"), F.lit(f"_{label}_"), F.col("shape"), F.lit("_hash_"), F.col("hash"))
        return F.when(slide >= 0, made)

    rules = [key, F.concat(F.lit("at "), F.col("slide").cast("string"), F.lit(" "), F.when(F.col("shape").rlike(r"^\d+$"), F.col("shape")))]
    rules += [spelled(step, label) for step in (0, 1, -1) for label in ("shapeid", "shape")]
    asked = parsed.select(
        "deck", "key", F.explode(F.array(*[F.struct(F.lit(n + 1).alias("rule"), r.alias("by")) for n, r in enumerate(rules)])).alias("r")
    ).select("deck", "key", "r.rule", "r.by").filter("by IS NOT NULL")
    place = F.concat(F.lit("at "), F.col("slide_idx").cast("string"), F.lit(" "), F.col("shape_id").cast("string"))
    # Only the first element under a key or hash can win, so copies are folded.
    first = F.min_by(F.struct("element_key", "position"), "position").alias("e")
    offered = (
        elements.select("deck", "element_key", "position", F.explode(F.array("element_key", place)).alias("by"))
        .groupBy("deck", "by").agg(first).select("deck", "by", "e.*")
    )
    direct = asked.join(offered, ["deck", "by"]).select("deck", "key", "rule", "element_key", "position")

    # By hash: the pieces of an element's hash of the lengths that its slide's
    # stored keys ask for make the substring test an equi join.
    hashed = parsed.filter("slide IS NOT NULL AND hash IS NOT NULL").select("deck", "key", "slide", "hash", F.lit(9).alias("rule"))
    lengths = hashed.select("deck", "slide", F.length("hash").alias("size")).distinct()
    whole = (
        elements.filter(F.coalesce("image_hash", F.lit("")) != "")
        .groupBy("deck", F.col("slide_idx").alias("slide"), "image_hash").agg(first).select("deck", "slide", "image_hash", "e.*")
    )
    starts = F.filter(F.sequence(F.lit(1), F.length("image_hash")), lambda n: n + F.col("size") - 1 <= F.length("image_hash"))
    pieces = F.transform(starts, lambda n: F.substr("image_hash", n, F.col("size")))
    offered_pieces = whole.join(lengths, ["deck", "slide"]).withColumn("hash", F.explode(F.array_distinct(pieces)))
    by_piece = hashed.join(offered_pieces, ["deck", "slide", "hash"]).select(direct.columns)
    best = F.min_by(F.struct("rule", "element_key"), F.struct("rule", "position")).alias("m")
    found = direct.unionByName(by_piece).groupBy("deck", "key").agg(best)
    return found.select("deck", "key", "m.rule", "m.element_key")


def missing(elements: DataFrame, texts: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Elements without text, and texts without element."""
    lacking = elements.join(texts, key, "left_anti").select(*key, F.lit("missing").alias("problem"))
    return lacking.unionByName(texts.join(elements, key, "left_anti").select(*key, F.lit("unmatched").alias("problem")))


def pending_keys(index: DataFrame, current: DataFrame, generated: DataFrame) -> DataFrame:
    """Keys with neither a current nor a generated text."""
    filled = ~is_blank("text")
    return (
        index.select(*KEY)
        .join(current.filter(filled), KEY, "left_anti")
        .join(generated.filter(filled), KEY, "left_anti")
    )


# --- verification --------------------------------------------------------------


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected against read-back texts, both (deck, key, text)."""
    pairs = expected.select(*KEY, strip("text").alias("expected")).join(
        actual.select(*KEY, text_of("text").alias("actual")), KEY
    )
    # Equal texts agree in every other way too; only the others are taken apart.
    exact = F.col("expected") == F.col("actual")
    levelled = F.when(exact, True).otherwise(compare_key("expected") == compare_key("actual"))
    diff = punct_diff("expected", "actual")
    return pairs.withColumns({"__diff": diff, "levelled": levelled}).select(
        *KEY,
        exact.alias("exact"),
        "levelled",
        F.when(exact, True).otherwise(mostly_same("expected", "actual")).alias("mostly_same"),
        (F.length("actual") - F.length("expected")).alias("length_diff"),
        F.when(~exact, F.col("__diff.reason")).alias("punctuation"),
        (~F.col("levelled") & is_templated("actual")).alias("repair"),
    )


def verify_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if("exact").alias("verified"),
        F.count_if(~F.col("exact")).alias("mismatches"),
        F.count_if("levelled").alias("levelled"),
        F.count_if("mostly_same").alias("mostly_same"),
        F.count_if("repair").alias("repairs"),
    )


def verify_review(entries: DataFrame, review: DataFrame, hint: str) -> DataFrame:
    """Review rows against entries, both keyed by (deck, label).

    Lists rows missing on either side and preserved entries shown wrongly.
    """
    e = entries.select("deck", "label", "existing_alt", "reason", F.lit(True).alias("in_entries"))
    r = review.select("deck", "label", "current_cell", "suggested_cell", F.lit(True).alias("in_review"))
    kept = F.col("reason") == "preserve_existing"
    shown, told = F.coalesce(strip("current_cell"), F.lit("")), F.coalesce(strip("suggested_cell"), F.lit(""))
    existing = F.coalesce(F.col("existing_alt"), F.lit(""))
    problems = F.array_compact(
        F.array(
            F.when(F.col("in_review").isNull(), "no_review_row"),
            F.when(F.col("in_entries").isNull(), "no_entry"),
            F.when(kept & F.col("in_review") & (existing != "") & (shown != existing), "current_mismatch"),
            F.when(kept & F.col("in_review") & (existing == "") & ~shown.isin(NO_ALT, ""), "current_not_empty"),
            F.when(kept & F.col("in_review") & (told != "") & ~told.contains(hint), "suggested_not_blank"),
        )
    )
    return e.join(r, ["deck", "label"], "full_outer").select("deck", "label", F.explode(problems).alias("problem"))


def report_rows(original: DataFrame, final_map: DataFrame, context: DataFrame) -> DataFrame:
    """Report rows: original texts, the final map and slide context by deck and key."""
    joined = (
        original.select(*KEY, "slide_key", "decorative", F.col("text").alias("original"))
        .join(final_map.select(*KEY, "existing_alt", "generated_alt", "final_alt"), KEY, "left")
        .join(context, "slide_key", "left")
    )
    existing = F.coalesce(F.nullif(strip("original"), F.lit("")), F.nullif(strip("existing_alt"), F.lit("")))
    offered = F.coalesce(F.nullif(strip("final_alt"), F.lit("")), F.nullif(strip("generated_alt"), F.lit("")))
    shown = joined.withColumns(
        {
            "current": F.coalesce(existing, F.lit(NO_ALT)),
            "suggested": F.coalesce(existing, offered, F.lit(NO_ALT)),
        }
    )
    return shown.withColumn("__s", derive_status("current", "suggested", F.col("decorative"))).select(
        *KEY, "current", "suggested", "__s.status", F.col("__s.label").alias("status_label"), "context"
    )


def group_children(elements: DataFrame) -> DataFrame:
    """Every group with its direct children, inside one slide."""
    groups = elements.filter("shape_type = 'GROUP'").select("deck", "slide_idx", F.col("shape_id").alias("parent_id"))
    children = elements.select("deck", "slide_idx", "parent_id", "shape_id", "shape_type")
    return groups.join(children, ["deck", "slide_idx", "parent_id"])


def probe_keys(images: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached text by the first of a picture's keys that the cache knows.

    ``images``: id, keys. ``cache``: key, text (one row per key).
    """
    asked = images.select("id", F.posexplode("keys").alias("rank", "key"))
    return asked.join(cache, "key").groupBy("id").agg(
        F.min("rank").alias("rank"), F.min_by("key", "rank").alias("key"), F.min_by("text", "rank").alias("text")
    )


# --- neighbours on a slide -------------------------------------------------------


def centre(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"cx": F.col("left") + F.col("width") / 2, "cy": F.col("top") + F.col("height") / 2}
    )


def nearby_text(images: DataFrame, blocks: DataFrame, radius: int = 100, first: int = 3, page_chars: int = 500) -> DataFrame:
    """The first text blocks whose centre is within ``radius`` of an image.

    Centres fall into cells of the radius; an image looks into its own and the
    eight cells around, so a crowded slide spreads over its cells. Without a
    block the start of the page text stands in.
    """
    around = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    cell = {"gx": F.floor(F.col("cx") / radius), "gy": F.floor(F.col("cy") / radius)}
    asked = (
        centre(images).withColumns(cell).select("id", "deck", "slide_idx", "cx", "cy", "gx", "gy", F.explode(around).alias("d"))
        .select("id", "deck", "slide_idx", F.col("cx").alias("ix"), F.col("cy").alias("iy"),
                (F.col("gx") + F.col("d.x")).alias("gx"), (F.col("gy") + F.col("d.y")).alias("gy"))
    )
    offered = centre(blocks.filter(~is_blank("text"))).withColumns(cell).select(
        "deck", "slide_idx", "gx", "gy", "cx", "cy", "position", strip("text").alias("text")
    )
    gap = F.sqrt(F.pow(F.col("cx") - F.col("ix"), 2) + F.pow(F.col("cy") - F.col("iy"), 2))
    rank = Window.partitionBy("id").orderBy("position")
    near = (
        asked.join(offered, ["deck", "slide_idx", "gx", "gy"]).filter(gap < radius)
        .withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= first)
        .groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda t: t["text"]), " ").alias("near"))
    )
    page = strip(F.left("page_text", F.lit(page_chars)))
    return images.select("id", "page_text").join(near, "id", "left").select(
        "id", F.col("near").isNotNull().alias("found"), F.coalesce("near", page, F.lit("")).alias("context")
    )


def overlays(elements: DataFrame, threshold: float = 0.02, cell: int = 200) -> DataFrame:
    """Pairs of boxes on a slide where the upper covers part of the lower.

    A box is listed in every grid cell it touches; a pair is reported only in
    the cell that holds the corner of its overlap.
    """
    box = elements.filter((F.col("width") > 0) & (F.col("height") > 0)).select(
        "deck", "slide_idx", "shape_id", "shape_idx", F.col("left").alias("x0"), F.col("top").alias("y0"),
        (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"),
    )

    def cells(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(high) - 1) / cell))

    placed = box.withColumn("gx", F.explode(cells("x0", "x1"))).withColumn("gy", F.explode(cells("y0", "y1")))
    names = ["shape_id", "shape_idx", "x0", "y0", "x1", "y1"]
    keys = ["deck", "slide_idx", "gx", "gy"]
    lower = placed.select(*keys, *[F.col(n).alias(f"a_{n}") for n in names])
    upper = placed.select(*keys, *[F.col(n).alias(f"b_{n}") for n in names])
    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    wide, high = F.least("a_x1", "b_x1") - left, F.least("a_y1", "b_y1") - top
    share = wide * high / ((F.col("a_x1") - F.col("a_x0")) * (F.col("a_y1") - F.col("a_y0")))
    return (
        lower.join(upper, keys)
        .filter((F.col("a_shape_idx") < F.col("b_shape_idx")) & (wide > 0) & (high > 0))
        .filter((F.floor(left / cell) == F.col("gx")) & (F.floor(top / cell) == F.col("gy")) & (share >= threshold))
        .select(
            "deck", "slide_idx", F.col("b_shape_id").alias("overlay_id"), F.col("a_shape_id").alias("target_id"),
            F.round(share, 6).alias("overlap_share"), (F.col("b_shape_idx") - F.col("a_shape_idx")).alias("z_delta"),
        )
    )


# --- as of -----------------------------------------------------------------------


def retry_gate(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """May a provider be called at the time of each request?

    ``requests``: request_id, provider, ts. The latest earlier attempt decides:
    after a success yes, after a permanent failure no, else once its wait is over.
    """
    state = F.struct(
        F.col("ts").alias("at"), "success", "streak", failure_class("status_code", "error").alias("failure")
    )
    seen = streaks(attempts).select(
        "provider", "ts", F.lit(1).alias("side"), F.col("attempt_id").alias("id"), state.alias("state")
    )
    asked = requests.select(
        "provider", "ts", F.lit(0).alias("side"), F.col("request_id").alias("id"),
        F.lit(None).cast(seen.schema["state"].dataType).alias("state"),
    )
    both = with_running(
        seen.unionByName(asked), ["provider"], ["ts", "side", "id"], {"last": ("last", F.col("state"))}
    )
    ready = F.timestamp_add("SECOND", backoff("last.streak"), "last.at")
    allowed = (
        F.when(F.col("last").isNull() | F.col("last.success"), True)
        .when(F.col("last.failure") == "permanent", False)
        .otherwise(F.col("ts") >= ready)
    )
    return both.filter("side = 0").select(
        F.col("id").alias("request_id"), "provider", "ts", F.coalesce("last.streak", F.lit(0)).alias("streak"),
        allowed.alias("allowed"),
    )
