import re

import numpy as np
import pytest
import xxhash

from altloom.llm import simhash
from altloom.llm.components import components
from altloom.llm.queries import QUERIES


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def all_links(points, radius):
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= radius)
    return zip(points[i].tolist(), points[j].tolist(), strict=True)


def some_points(seed, centres=1500, hot=1500):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 1 << 63, centres, dtype=np.uint64) * np.uint64(2)]

    def near(x, most):
        for bit in rng.choice(64, rng.integers(1, most), replace=False):
            x ^= 1 << int(bit)
        return x

    return np.unique(np.array(base + [near(x, 6) for x in base[:300] for _ in range(3)] + [near(base[0], 7) for _ in range(hot)], np.uint64))


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_forest_joins_what_all_pairs_join(radius):
    points = some_points(radius)
    found = []
    for mask, own in simhash.metrics(radius):
        tree = simhash.fitted(points[::4], mask, 0.1)
        places, shards = simhash.routed(tree, points, mask, own)
        for shard in range(shards.max() + 1):
            a, b = simhash.linked(np.unique(points[places[shards == shard]]), radius, mask, own)
            found += zip(a.tolist(), b.tolist(), strict=True)
    nodes = points.tolist()
    assert groups(nodes, found) == groups(nodes, all_links(points, radius))


def test_radii_leave_no_pair_out():
    for radius in range(12):
        parts = simhash.metrics(radius)
        assert sum(own + 1 for _, own in parts) > radius
        assert sum(mask for mask, _ in parts) == (1 << 64) - 1


def test_links_in_spark_with_split_shards(spark):
    points = some_points(9)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp bigint")
    for shard in (100, 1 << 14):  # 100: hot shards are dealt as pairs of blocks
        rows = simhash.links(df, 4, shard).collect()
        assert len(rows) < 60 * len(points)
        signed = points.view(np.int64).tolist()
        want = groups(signed, ((np.uint64(a).astype(np.int64).item(), np.uint64(b).astype(np.int64).item()) for a, b in all_links(points, 4)))
        assert groups(signed, [tuple(r) for r in rows]) == want


def test_query_equals_all_pairs(spark, tables, odd_rows):
    prints = {(r[0], r[1]): plain_fingerprint(r[1]) for r in odd_rows}
    points = np.unique(np.array(list(prints.values()), np.uint64))
    root = groups(points.tolist(), all_links(points, 4))
    least = {}
    for (doc_id, _), fp in prints.items():
        if doc_id is not None:
            least[root[fp]] = min(doc_id, least.get(root[fp], doc_id))
    want = [(r[0], f"{prints[r[0], r[1]]:016x}", least.get(root[prints[r[0], r[1]]])) for r in odd_rows]
    got = [tuple(r) for r in QUERIES["op6_simhash"](spark, tables).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1002, 1001), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {k: 0 for k in range(1, 201)} | {1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
