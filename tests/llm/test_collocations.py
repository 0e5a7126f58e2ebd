"""Phrases against plain counting, with shards so small that the lowered support differs."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from altloom.llm import collocations


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows, support, longest, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p for p, a in counts.items() if len(p) > 1 and a >= support}
        inner = {
            q[i:j] for q in candidates for i in range(len(q)) for j in range(i + 1, len(q) + 1)
            if j - i < len(q) and counts[q] >= counts[q[i:j]]
        }
        own = []
        for p in candidates - inner:
            a = counts[p]
            cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            own.append((-cut[0], -a, " ".join(p).encode(), counts[p[: cut[1]]], counts[p[cut[1] :]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts(seed=3, n=300):
    rng, out = random.Random(seed), []
    words = ["a", "b", "c", "ä", "日本", "the", "The", "of", "x\x00y", "it's"]
    for k in range(n):
        parts = [rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(rng.randint(0, 60))]
        out.append(("".join(parts), rng.choice(["en", "de", None, "", "en", "en"])))
    return out + [("the of the of the", "en")] * 40 + [(None, "fr"), ("", None), (" \n.,", "fr"), ("A " * 5000, "xx")]


@pytest.mark.parametrize("shard_bytes, support, top", [(1 << 26, 20, 2000), (600, 20, 7), (2000, 5, 50)])
@pytest.mark.parametrize("part", [1 << 20, 300])
def test_equals_plain_counting(spark, monkeypatch, part, shard_bytes, support, top):
    monkeypatch.setattr(collocations, "SORTED", part)
    rows = texts()
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("phrase", "f", "size", "hash", "k")})
    found = collocations.top_phrases(docs.repartition(5), support=support, top=top, shard_bytes=shard_bytes)
    assert sorted(map(tuple, found.collect())) == plain(rows, support, 5, top)


def test_large_products(spark):
    rows = [("en", "", 0, 4 * 10**15), ("en", "u v", 2, 3 * 10**15), ("en", "u", 1, 3 * 10**15 + 1), ("en", "v", 1, 3 * 10**15 + 2)]
    found = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, f bigint")).first()
    assert found.score == 1000 * 3 * 10**15 * 4 * 10**15 // ((3 * 10**15 + 1) * (3 * 10**15 + 2))


def test_bits_lose_nothing(spark):
    hashes = [random.Random(k).getrandbits(64) - (1 << 63) for k in range(3000)]
    found = collocations.bits(spark.createDataFrame([(h,) for h in hashes], "hash bigint"))
    for h in hashes:
        slot = h & (64 * len(found) - 1)
        assert int(found[slot >> 6]) >> (slot & 63) & 1
