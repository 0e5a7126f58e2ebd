"""Stages on rows whose ids are missing or shared by different texts."""

import random
from collections import Counter

from altloom.llm import mixing, simhash

SCHEMA = "doc_id bigint, text string, source string"


def text(seed, n=80):
    rng = random.Random(seed)
    return " ".join(str(rng.randrange(10**6)) for _ in range(n))


def test_near_copies_keeps_other_texts_without_or_with_shared_ids(spark):
    rows = [(None, text(k), "a") for k in range(5)] + [(1, text(k), "a") for k in range(10, 13)] + [(2, text(12).replace(" ", "  "), "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert Counter(tuple(r) for r in simhash.without_near_copies(docs).collect()) == Counter(rows[:-1])


def test_mix_of_shared_ids_meets_its_targets(spark):
    rows = [(1, text(k, 10), f"s{k % 3}") for k in range(60)] + [(None, text(k, 10), f"s{k % 3}") for k in range(60, 90)]
    rows += [(7, text(100, 10), "s0")] * 5
    docs = spark.createDataFrame(rows, SCHEMA)
    want, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    for r in mixing.repeated(docs).collect():
        got[r.source] += len(r.text.split())
    assert got == want
