"""Texts that the gate stops as too long are known before their form is worked out."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from altloom.functions import gates, text
from altloom.operators import patch

SMALL = "/root/testdata/sf0.001"
PROSE = "The rain fell on the old town while many small boats came home from a cold sea and went to rest. "
ODD = [
    "a", "b", "ab", "abc", "Ab", "cat", "İ", "İi", "i̇", "ΟΔΟΣ", "ς", "ß", "...", "..a", "a..", "b.", "c!", "?!", "́x", "语", "ſhape", "K", "🙂",
    "A line (3x4px)", "shape(", "(x", "This is a PowerPoint shape. It is a line", "undefined", "\x01", "longword", "another",
]
BLANKS = [" "] * 9 + ["  ", "\t", "\n", "\xa0", " ", ". ", "! "]


def odd_texts(count):
    rand = random.Random(5)
    pools = [ODD, ODD[:6] + ["one", "two", "three", "four", "five"], ["".join(rand.choice("abcdİΣ.") for _ in range(4)) for _ in range(30)]]
    return ["".join(rand.choice(pool) + rand.choice(BLANKS) for _ in range(size)) for pool in pools for size in (2, 9, 40) for _ in range(count)]


def test_long_texts_are_told_by_their_beginning(one):
    words = " ".join(f"word{n}" for n in range(90))
    texts = [words, words + " A call (555) is fine.", None, "", "Short.", "same " * 400, PROSE, "ONE!! TWO!! THREE!! " * 90]
    assert one(lambda c: text.normal_form_exceeds(c, 200), *texts) == [True, True] + [False] * 6
    shortened = ["A shape (" + words + ") This is a PowerPoint shape", words + " a line\n(3x4px)", words + " powerpoint"]
    assert one(lambda c: text.normal_form_exceeds(c, 200), *shortened) == [False] * 3


@pytest.mark.parametrize("limit", [4, 10, 25, 60])
def test_told_texts_have_a_long_form(spark, limit):
    df = spark.createDataFrame([(t,) for t in odd_texts(150)], "t string")
    told = df.filter(text.normal_form_exceeds("t", limit)).select("t", F.length(text.normalize_universal("t")).alias("size"))
    assert told.count() > 50 and told.filter(F.col("size") <= limit).collect() == []


def test_gate_lets_the_same_texts_through(spark):
    texts = [*odd_texts(20), PROSE, PROSE * 5, PROSE + "And. " * 99, PROSE.replace(" ", "  ") * 2, " ".join(f"w{n}" for n in range(400)), "x" * 201]
    columns = "deck string, key string, text string, kind string, is_generated boolean, is_fallback boolean, forced boolean"
    plan = spark.createDataFrame([("d", str(n), t, "PICTURE", True, False, False) for n, t in enumerate(texts)], columns)
    for policy in ("none", "doc-only"):
        form = text.finalize_alt(text.normalize_universal("text"))
        gate = gates.write_gate(form, "kind", F.col("is_generated"), F.col("is_fallback"), policy)
        expected = plan.select("key", gate.alias("new_alt")).filter("new_alt IS NOT NULL").collect()
        ready = patch.ready_texts(plan, policy)
        assert sorted(ready.select("key", "new_alt").collect()) == sorted(expected)
        assert ("regexp_extract_all" in ready._jdf.queryExecution().optimizedPlan().toString()) == (policy == "none")


@pytest.mark.skipif(not Path(SMALL).exists(), reason="driver tables absent")
@pytest.mark.parametrize("name", ["patch_l01", "apply_patch_l02"])
def test_only_texts_in_question_are_moved(spark, name):
    """Of what stands only the elements with a ready text are joined."""
    assert "LeftSemi" in contract.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
