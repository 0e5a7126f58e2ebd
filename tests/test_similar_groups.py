"""Groups of near-identical pictures against all pairs."""

import random

import numpy as np
import pytest

from altloom.operators import similar


def grouped(spark, rows, **settings):
    df = spark.createDataFrame(rows, "id bigint, h bigint")
    return dict(similar.similar_groups(similar.spanning_links(df, "id", "h", **settings), "first_id", "match_id").collect())


def by_all_pairs(rows):
    ids = np.array([r[0] for r in rows])
    points = np.array([r[1] for r in rows], np.int64).view(np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 5, 1))
    parent = {n: n for n in ids[np.union1d(i, j)].tolist()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(ids[i].tolist(), ids[j].tolist(), strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


def test_a_later_hash_joins_two_earlier_ones(spark):
    rows = [(1, 0), (2, (1 << 10) - 1), (3, (1 << 5) - 1)]
    assert grouped(spark, rows) == {1: 1, 2: 1, 3: 1}
    assert grouped(spark, rows, light=1) == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("settings", [{}, {"light": 1}, {"light": 2, "block": 8}])
def test_groups_equal_all_pairs(spark, settings):
    rng, values = random.Random(11), []
    for _ in range(60):
        centre = rng.getrandbits(64)
        values += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(rng.randint(1, 10))]
    values += [sum(1 << b for b in rng.sample(range(64), rng.randint(3, 6))) for _ in range(80)]
    values = list(dict.fromkeys(values))
    rng.shuffle(values)
    rows = [(n, v - (1 << 64) if v >> 63 else v) for n, v in enumerate(values)]
    assert grouped(spark, rows, **settings) == by_all_pairs(rows)


def scattered(spark, n):
    rng = random.Random(5)
    return spark.createDataFrame([(i, rng.getrandbits(63) ^ (i % 3)) for i in range(n)], "id bigint, h bigint")


def test_no_rows_are_broadcast(spark, monkeypatch):
    plans, write = [], similar.materialize

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(similar, "materialize", noted)
    df = scattered(spark, 300)
    links = similar.spanning_links(df, "id", "h", k=20)
    similar.similar_groups(links, "first_id", "match_id").collect()
    for plain in (links, similar.best_matches(df, "id", "h")):
        plans.append(plain._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)


def test_hashes_are_dealt_out_before_they_multiply(spark, monkeypatch):
    monkeypatch.setattr(similar, "DEALT", 50, raising=False)
    _, keyed = similar.folded_and_keyed(scattered(spark, 300), "id", "h", 5, 64)
    assert keyed.rdd.getNumPartitions() == 300 // 50 + 1
    assert keyed.count() == 300 * 66
