"""Decision tables, keys, hashes and the selector contract."""

import random

import numpy as np

from pyspark.sql import functions as F

from altloom.functions import keys, phash, review
from altloom.operators import classify, groups, joins, patch, reuse, similar


def test_stored_final_text_wins_in_preserve_mode(spark):
    df = spark.createDataFrame([("Same.", "Same.", "Stored final."), ("Old", "New", ""), ("", "", "")], "e string, g string, f string")
    plans = [r[0] for r in df.select(classify.write_plan("e", "g", "f")).collect()]
    assert [(p["final_alt"], p["decision"], p["should_write"]) for p in plans] == [
        ("Stored final.", "written_final", True), ("Old", "preserved_existing", False), (None, "skipped_no_content", False)
    ]
    unknown = [r[0]["decision"] for r in df.select(classify.write_plan("e", "g", "f", "odd")).collect()]
    assert unknown == ["written_final", "written_generated", "skipped_no_content"]


def test_name_rules(one):
    rules = {
        "contains": ["logo", "watermark", "border"], "exact": ["your_org_logo.png", "footer.jpg"],
        "force": ["divider", "separator"], "never": ["anatomy", "xray", "mri"],
    }
    names = ["your_org_logo.png", "header_logo.jpg", "anatomy_chart.png", "xray_chest.jpg", "divider_line.png", "random_image.jpg"]
    assert one(lambda c: classify.decorative_by_name(c, rules), *names) == [True, True, False, False, True, False]


def test_heuristics_are_off_by_default(spark):
    df = spark.createDataFrame([("flag", 5, 5, 0, 0, 9)], "n string, w int, h int, x int, y int, c int")
    assert df.select(classify.decorative_reasons("n", "w", "h", "x", "y", "c")).first()[0] == []


def test_keys(one):
    assert one(keys.parse_key, "slide_2_shapeid_14_hash_ab", "slide_x")[1] is None
    loose = one(keys.parse_key_loose, "slide_3_shape_0_1_2_name_box_hash_beef")[0]
    assert (loose["slide_idx"], loose["shape_idx"], loose["name"], loose["hash"]) == (3, "0_1_2", "box", "beef")
    nested = one(lambda c: keys.nested_key(c, F.lit(7)), "slide_1_shape_4_hash_00000000")
    assert nested == ["slide_1_shape_4_7_hash_00000000"]


def test_backoff(spark):
    got = [r[0] for r in spark.range(1, 9).select(review.backoff("id")).collect()]
    assert got == [1, 2, 4, 8, 16, 32, 60, 60]


def test_hamming_is_symmetric(spark):
    rows = [("ahash:ff", "ahash:0f"), ("ahash:0f", "ahash:ff"), ("ahash:ff", "dhash:ff"), ("ahash:error", "ahash:ff"), ("ff", "ff")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(phash.hamming("a", "b")).collect()] == [4, 4, None, None, None]


def test_banded_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values):
        flips = rng.sample(range(64), rng.randint(0, 8))
        for f in flips:
            v ^= 1 << f
        values.append(v)
    values += [values[0]] * 40
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id bigint, h bigint")
    mask, first = (1 << 64) - 1, {}
    for number, value in df.orderBy("id").collect():
        first.setdefault(value, number)
    want = {}
    for a, i in first.items():
        near = [(bin((a ^ b) & mask).count("1"), j) for b, j in first.items() if j < i and bin((a ^ b) & mask).count("1") <= 5]
        if near:
            want[i] = min(near)
    for heavy in (3, 10_000):
        rows = similar.best_matches(df, "id", "h", heavy=heavy).collect()
        got = {r["first_id"]: (r["distance"], r["match_id"]) for r in rows if r["match_id"] is not None}
        assert got == want and want
        links = {i: sum(0 < bin((a ^ b) & mask).count("1") <= 5 for b in first) for a, i in first.items()}
        assert {r["first_id"]: r["links"] for r in rows} == {i: n for i, n in links.items() if n}


def test_many_hashes_around_one_centre(spark):
    """A row per hash however many resemble each other."""
    rng = random.Random(4)
    values = list(dict.fromkeys(sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5))) for _ in range(3000)))
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, h bigint")
    got = {r.first_id: (r.distance, r.match_id) for r in similar.best_matches(df, "id", "h", heavy=500).collect() if r.match_id is not None}
    h = np.array(values, np.uint64)
    want = {}
    for i in range(1, len(h)):
        far = np.bitwise_count(h[:i] ^ h[i])
        if far.min() <= 5:
            want[i] = (int(far.min()), int(far.argmin()))
    assert got == want


def test_groups_of_a_chain(spark):
    pairs = spark.createDataFrame([(n, n + 1) for n in range(1, 20)] + [(100, 101)], "a bigint, b bigint")
    got = dict(similar.similar_groups(pairs, "a", "b").collect())
    assert set(got.values()) == {1, 100} and len(got) == 22


def test_cycles_and_lost_parents_come_out(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99)]
    df = spark.createDataFrame([("d", 0, s, p) for s, p in rows], "deck string, slide_idx int, shape_id bigint, parent_id bigint")
    got = {r["shape_id"]: r["depth"] for r in groups.flatten(df).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None}


def test_match_keys_takes_short_and_long_hashes(spark):
    elements = spark.createDataFrame(
        [("d", "slide_0_shapeid_1_hash_aaaabbbb", 0, 1, "aaaabbbbcccc", 0), ("d", "slide_0_shapeid_2_hash_ddddeeee", 0, 2, "ddddeeeeffff", 1)],
        "deck string, element_key string, slide_idx int, shape_id bigint, image_hash string, position int",
    )
    asked = ["slide_0_shapeid_9_hash_bbbbcccc", "slide_0_shapeid_9_hash_eef", "slide_1_shape_2_hash_ddddeeee", "slide_0_shape_1", "nothing"]
    keyed = spark.createDataFrame([("d", k) for k in asked], "deck string, key string")
    got = {r["key"]: (r["rule"], r["element_key"][14:16]) for r in joins.match_keys(keyed, elements).collect()}
    assert got == {asked[0]: (9, "d_"), asked[1]: (9, "d_"), asked[2]: (7, "d_"), asked[3]: (2, "d_")}


def test_second_patch_is_empty(spark):
    plan = spark.createDataFrame(
        [("d", "a", "A new text", "PICTURE", True, False, False), ("d", "b", "Other", "PICTURE", True, False, False)],
        "deck string, key string, text string, kind string, is_generated boolean, is_fallback boolean, forced boolean",
    )
    current = spark.createDataFrame([("d", "a", ""), ("d", "b", "A human text.")], "deck string, key string, text string")
    nothing = spark.createDataFrame([], "deck string, key string, text_hash string")
    first = patch.patch(plan, current, nothing)
    assert [tuple(r) for r in first.select("key", "new_alt", "change").collect()] == [("a", "A new text.", "insert")]
    done = first.select("deck", "key", "text_hash")
    assert patch.patch(plan, current, done).count() == 0
    after = current.select("deck", "key", F.col("text").alias("existing_alt"))
    written = patch.apply_patch(after, first).select("deck", "key", F.col("existing_alt").alias("text"))
    assert patch.patch(plan, written, nothing).count() == 0


def test_last_character_survives(spark):
    plan = spark.createDataFrame(
        [("d", "a", "Ends with letter s", "PICTURE", True, False, False)],
        "deck string, key string, text string, kind string, is_generated boolean, is_fallback boolean, forced boolean",
    )
    current = spark.createDataFrame([("d", "a", "")], "deck string, key string, text string")
    nothing = spark.createDataFrame([], "deck string, key string, text_hash string")
    assert patch.patch(plan, current, nothing).first()["new_alt"] == "Ends with letter s."


TWO_DECKS = [(d, 0, 2 + k, f"slide_0_shape_{2 + k}", "logo" if k == 0 else f"{d}{k}", f"text {d} {k}" if k != 1 else "") for d in ("a", "b") for k in range(3)]
TWO_SCHEMA = "deck string, slide_idx int, shape_id bigint, key string, content_key string, text string"


def test_two_decks_with_equal_ids_stay_apart(spark):
    """As many rows as elements, whatever ids the decks share."""
    e = spark.createDataFrame(TWO_DECKS, TWO_SCHEMA)
    texts = e.select("deck", "key", "text")
    assert joins.resolve(e, texts, texts).count() == 6
    assert joins.enrich(e.select("deck", "key", F.col("text").alias("existing_alt")), texts).count() == 6
    assert joins.pending_keys(e, texts, texts).count() == 2
    assert joins.verify(texts, texts).filter("exact").count() == 6
    assert joins.missing(e, texts.filter("deck = 'a'")).count() == 3
    elected = reuse.elect_generators(e, "content_key", ["deck", "slide_idx", "shape_id"])
    assert elected.count() == 6 and elected.filter("generates").count() == 5
    cached = {(r.deck, r.shape_id): r.cached_alt for r in reuse.with_cache(e, e, "content_key", "text").collect()}
    assert len(cached) == 6 and cached["a", 2] == "text b 0" and cached["b", 2] == "text a 0" and cached["a", 3] is None
    plan = e.filter("text <> ''").select("deck", "key", F.concat("text", F.lit(" new words")).alias("text"), F.lit("PICTURE").alias("kind"),
        F.lit(True).alias("is_generated"), F.lit(False).alias("is_fallback"), F.lit(True).alias("forced"))
    rows = patch.patch(plan, texts, spark.createDataFrame([], "deck string, key string, text_hash string"))
    assert rows.count() == 4
    assert patch.apply_patch(texts.withColumnRenamed("text", "existing_alt"), rows).count() == 6


def test_groups_of_any_depth(spark):
    deep = [("d", 0, k, k - 1 if k else None) for k in range(200)] + [("d", 0, 900, 901), ("d", 0, 901, 900), ("d", 1, 0, None), ("d", 1, 1, 0)]
    flat = {(r.slide_idx, r.shape_id): (r.depth, len(r.path)) for r in groups.flatten(spark.createDataFrame(deep, "deck string, slide_idx int, shape_id bigint, parent_id bigint")).collect()}
    assert len(flat) == len(deep) and flat[0, 199] == (199, 200) and flat[0, 900] == (None, 1) and flat[1, 1] == (1, 2)


def test_long_hashes_are_compared_whole(spark):
    a = "x:" + "f" * 75
    rows = [(a, a), (a, "x:" + "e" + "f" * 74), (a, "x:" + "f" * 74 + "0"), ("x:1", "x:0" + "0" * 70 + "1")]
    found = spark.createDataFrame(rows, "a string, b string").select(phash.hamming("a", "b").alias("n")).collect()
    assert [r.n for r in found] == [0, 1, 4, 0]
