"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from altloom.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, top):
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counted = [(doc_id, c, sum(c.values())) for doc_id, c in counted if c]
    rows, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c, n in counted:
            m, score = 100 - 25 + (25 * n * rows) // total, 0
            for t in terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if no_id else doc_id, -score) for rank, (score, no_id, doc_id) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def words(seed=1, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "日本", "x1", "A", "b"] + [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 50))) + rng.choice(["", ".", "\n-"])) for k in range(n)]
    rows += [(1000 + k, "the w3 w4 w5 w6") for k in range(60)] + [(7, "the w3 w4 w5 w6"), (7, "the w3 w4 w5 w6"), (None, "the w3 w4 w5 w6"), (None, None), (8, None), (9, " .,")]
    rows.append((5000, "w3 " * 20_000))
    items = [(1, "the W3 w4, w5 w6"), (2, "of of of é 日本"), (3, ""), (4, None), (5, "w59 w58 w57 unknown"), (5, "w59 w58 w57 unknown"), (6, "A b x1 w3")]
    return rows, items


@pytest.mark.parametrize("block, top, postings", [(1000, 20, 1 << 20), (2, 5, 500)])
def test_equals_plain_scoring(spark, monkeypatch, block, top, postings):
    monkeypatch.setattr(search, "RUN_POSTINGS", postings)
    rows, items = words()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("score", "rank", "item", "term", "n")})
    found = search.search(docs.repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), top, block)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, items, top)


@pytest.mark.parametrize("width", [1, 4, 128])
def test_branches_are_pruned_and_nothing_is_lost(width):
    rng = np.random.default_rng(5)
    ids, held = np.arange(3000), rng.random((3000, 12)) < np.linspace(0.9, 0.01, 12)
    rows, found = np.nonzero(held)
    run = search.built(ids, np.zeros(3000, bool), rows, found, rng.integers(1, 5, len(rows)), rng.integers(80, 300, 3000), 12)
    weights = np.linspace(50, 9000, 12).astype(np.int64)
    best = search.Best(20)
    seen = search.searched(run, np.arange(12), weights, best, width)
    every = np.zeros(3000, np.int64)
    np.add.at(every, run.docs, run.impacts * weights[run.keys // 3000])
    order = np.lexsort((ids, -every))[:20]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == every[order].tolist()
    assert seen < 1500


def test_sparse_tables():
    rng = np.random.default_rng(2)
    run = search.built(np.arange(100), np.zeros(100, bool), np.arange(100), np.zeros(100, np.int64), rng.integers(1, 9, 100), np.full(100, 90), 1)
    for a in range(100):
        for b in range(a + 1, 101):
            place, value = search.maxima(run, np.array([a]), np.array([b]))
            assert value[0] == run.impacts[a:b].max() and a <= place[0] < b
    assert search.maxima(run, np.array([5]), np.array([5]))[0][0] == -1


def test_terms():
    n, keys, times = search.terms_of(pa.array(["A a_b", None, "", "é.É 9"]), pa.array(["a", "é", "9"]))
    assert n.tolist() == [3, 0, 0, 3] and keys.tolist() == [0, 10, 11] and times.tolist() == [2, 1, 1]
