"""Costly forms of a text are worked out once, and only where a comparison needs them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from altloom.functions import text
from altloom.operators import joins, patch

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not Path(SMALL).exists(), reason="driver tables absent")
@pytest.mark.parametrize("name", ["patch_l01", "apply_patch_l02", "pipeline_a02"])
def test_normal_form_of_new_texts_is_read_not_repeated(spark, name):
    """The one normal form left in the plan is that of the old text, of rows that are in question."""
    assert plan_of(contract.queries()[name](spark, SMALL)).count("It is a (chart") == 1


def test_ready_texts_serve_two_runs(spark):
    plan = spark.createDataFrame(
        [("d", "a", "A new text", "PICTURE", True, False, False, 1), ("d", "b", "x" * 300, "PICTURE", True, False, False, 2)],
        "deck string, key string, text string, kind string, is_generated boolean, is_fallback boolean, forced boolean, width int",
    )
    nothing = spark.createDataFrame([], "deck string, key string, text_hash string")
    current = plan.select("deck", "key", F.lit("").alias("text"))
    ready = patch.ready_texts(plan)
    assert [(r.key, r.new_alt, r.width) for r in ready.collect()] == [("a", "A new text.", 1)]
    first = patch.changes(ready, current, nothing)
    assert first.exceptAll(patch.patch(plan, current, nothing)).count() == 0 and first.count() == 1
    assert patch.changes(ready, current, first.select("deck", "key", "text_hash")).count() == 0


def test_equal_texts_are_not_taken_apart(spark):
    """Equal texts skip both comparisons; the others are still compared."""
    pairs = [("a b.", "a b."), ("a b.", "A  b!"), ("a b.", "b c."), ("a b.", None), ("", " ")]
    rows = [("d", str(n), e, a) for n, (e, a) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "deck string, key string, e string, a string")
    checked = joins.verify(df.select("deck", "key", F.col("e").alias("text")), df.select("deck", "key", F.col("a").alias("text")))
    assert plan_of(checked).count("(expected") >= 2 and "THEN true" in plan_of(checked)
    got = [(r.exact, r.levelled, r.mostly_same) for r in checked.orderBy("key").collect()]
    assert got == [(True, True, True), (False, True, False), (False, False, False), (False, False, False), (True, True, True)]


def test_names_are_raised_as_whole_words(one):
    got = one(text.compare_key, "the center center. Medical", "epicenter powerpoint", "microsoft\nsouthwestern centers", "Center")
    assert got == ["The Center center. Medical.", "Epicenter Powerpoint.", "Microsoft Southwestern centers.", "Center."]
