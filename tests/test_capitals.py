"""Queries that raise a first letter against their SQL, on every letter whose capital is several letters."""

import duckdb
import pytest

import __spark_entry__ as contract
from altloom.functions.base import capitalize_first
from altloom.operators.aggregates import slide_text
from altloom.plans import sql as q

NAMED = (
    "compare_key_b11 finalize_alt_b05 hard_cut_b12 normalize_universal_b03 post_process_u03 two_sentences_b09 short_title_b10 strip_vague_prefix_b06"
).split()


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("capitals"))
    rows = [(n, f"{c}ein gut. {c}um {c}.", "de", "web") for n, c in enumerate(q.LONG_CAPITALS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{root}/documents.parquet")
    return root


@pytest.mark.parametrize("name", NAMED)
def test_long_capitals(spark, place, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{place}/documents.parquet/*.parquet'")
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, contract.queries()[name](spark, place).select(names).collect())) == sorted(cursor.fetchall())


def test_first_letter_of_eszett(one):
    assert one(capitalize_first, "ßein") == ["SSein"]


def test_the_blank_before_a_text_right_behind_the_limit(spark):
    turns = spark.createDataFrame([(1, 0, "a" * 9), (1, 1, "b"), (2, 0, "a" * 10), (2, 1, "b")], "k int, turn int, text string")
    got = dict(slide_text(turns, ["k"], "turn", 10).select("k", "slide_text").collect())
    assert got == {1: "a" * 9 + " ", 2: "a" * 10}
