"""Running values over groups cut into pieces, against plain windows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from altloom.operators import joins, ordered
from altloom.operators.prefix import PIECE, cut_pieces, numbered, with_running


@pytest.fixture(autouse=True)
def many_pieces(spark):
    """Keep Spark from joining the pieces of small data."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_data_falls_into_pieces(spark):
    cut = cut_pieces(sample(spark), ["k"], ["o"])
    assert cut.select(PIECE).distinct().count() == 8
    assert cut.filter("k = 'hot'").select(PIECE).distinct().count() > 4


def sample(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), n, rng.randint(0, 9), None if rng.random() < 0.5 else n) for n in range(2000)]
    return spark.createDataFrame(rows, "k string, o int, v bigint, m bigint")


def test_pieces_equal_windows(spark):
    df = sample(spark)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "k", "o", F.sum("v").over(w).alias("s"), F.max("m").over(w).alias("x"), F.last("m", ignorenulls=True).over(w).alias("l")
    )
    got = with_running(
        df, ["k"], ["o"], {"s": ("sum", F.col("v")), "x": ("max", F.col("m")), "l": ("last", F.col("m"))}
    ).select("k", "o", "s", "x", "l")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_numbers_without_a_key(spark):
    got = numbered(sample(spark), [], ["o"], "n").orderBy("o").select("n").collect()
    assert [r[0] for r in got] == list(range(1, 2001))


def calls(spark, script):
    start = datetime(2024, 1, 1)
    rows = [(n, start + timedelta(seconds=s), "p", ok, 200 if ok else 503, None if ok else "server error") for n, (s, ok) in enumerate(script)]
    return spark.createDataFrame(rows, "attempt_id bigint, ts timestamp, provider string, success boolean, status_code int, error string")


def test_streaks_and_openings(spark):
    df = calls(spark, [(n, n == 3) for n in range(12)])
    got = [r["streak"] for r in ordered.streaks(df).orderBy("attempt_id").collect()]
    assert got == [1, 2, 3, 0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert [r["attempt_id"] for r in ordered.breaker_openings(df).collect()] == [8]


def test_retry_gate(spark):
    df = calls(spark, [(0, False), (10, False), (20, True)])
    start = datetime(2024, 1, 1)
    asked = spark.createDataFrame(
        [(n, "p", start + timedelta(seconds=s)) for n, s in enumerate([-1, 0, 0.5, 1, 11, 12, 20, 21])], "request_id bigint, provider string, ts timestamp"
    )
    got = [r["allowed"] for r in joins.retry_gate(asked, df).orderBy("request_id").collect()]
    assert got == [True, True, False, True, False, True, True, True]
