"""Near copies against all pairs, and how many pairs of a true similarity of 0.8 are found."""

import random

import numpy as np
from pyspark.sql import functions as F

from altloom.llm import near
from tests.llm.conftest import prose

SCHEMA = "doc_id bigint, text string, source string"


def close(a, b):
    return (np.bitwise_count(a[: near.RUNS] ^ b[: near.RUNS]) <= 1).any() and np.bitwise_count(a[near.RUNS :] ^ b[near.RUNS :]).sum() <= near.MOST


def joined(drawn):
    """Of each sketch the first place of its group, by comparing all pairs."""
    parent = list(range(len(drawn)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(drawn):
        for j in range(i):
            if close(a, drawn[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(k) for k in range(len(drawn))]


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"other{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_equals_all_pairs(spark):
    rng, rows = random.Random(5), []
    for k in range(40):
        text = prose(rng, rng.choice(["en", "de"]), rng.randint(3, 150))
        rows += [(100 * k + j, changed(rng, text, j), "s") for j in range(rng.randint(1, 5))]
    rows += [(9000, None, "s"), (9001, "", "s"), (9002, " \n", "s"), (9003, "one", "s"), (9004, "ONE", "s"), (None, "no id", "s"), (9005, "no id", "t")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("node", "root", "run0", "sketch0", "least", "a", "b")})
    kept = near.without_near_copies(docs)
    assert kept.columns == docs.columns
    drawn, first = [near.sketch(t) for _, t, _ in rows], {}
    for row, root in zip(rows, joined(drawn), strict=True):
        first[root] = min(first.get(root, row), row, key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in first.values()), key=str)


def test_small_shards_lose_nothing(spark):
    rng = random.Random(6)
    base = [prose(rng, "en", 100) for _ in range(30)]
    texts = [changed(rng, t, rng.randint(0, 2)) for t in base for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = near.sketches(docs, ["doc_id"]).withColumn("node", F.unhex(F.md5(F.concat_ws(",", *near.COLUMNS)))).drop("doc_id").distinct()
    nodes = rows.collect()
    drawn = [np.array([r[c] for c in near.COLUMNS], np.int64).view(np.uint64) for r in nodes]
    want = len(set(joined(drawn)))
    pairs = near.links(rows, shard=40).collect()
    at, parent = {bytes(r.node): k for k, r in enumerate(nodes)}, list(range(len(nodes)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for r in pairs:
        assert close(drawn[at[bytes(r.a)]], drawn[at[bytes(r.b)]])
        parent[root(at[bytes(r.a)])] = root(at[bytes(r.b)])
    assert len({root(k) for k in range(len(nodes))}) == want


def test_recall_and_clean_documents():
    rng, found, pairs, far = random.Random(7), 0, 0, []
    for _ in range(600):
        text = prose(rng, "en", rng.randint(60, 500))
        copy = changed(rng, text, max(1, len(text.split()) // 60))
        a, b = shingles(text), shingles(copy)
        if len(a & b) >= 0.8 * len(a | b):
            pairs += 1
            found += close(near.sketch(text), near.sketch(copy))
        far.append(near.sketch(text))
    assert pairs > 300 and found >= 0.9 * pairs
    assert len(set(joined(far[:300]))) == 300
