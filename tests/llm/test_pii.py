"""Base spans against the patterns as they are told, the chain model against enumeration, and held-out items."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from altloom.llm import crf, pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == 2 and 13 <= len(digits) <= 19 and plain_luhn(digits))
                or (kind == 3 and 9 <= len(digits) <= 15)
            ):
                out.append((kind, *m.span()))
    return sorted(out)


def scraps(seed, n):
    rng = random.Random(seed)
    parts = ["a", "Z9", "@", "@@", ".", "..", "-", " ", "+", "1", "12", "255", "256", "001", "4111 1111 1111 1111", "4111-1111-1111-1112", "x@y.z", "é", "(", ")", "\n", "_%", "日", "0000000255"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(n)] + ["+1 (132) 555-1352.", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "und.34@mail7.example.com", "+1((((((", "@a.b", "1 "]


def test_base_spans():
    for text in scraps(4, 20_000):
        assert sorted(pii.base_spans(text)) == plain(text), text


def test_long_texts_take_linear_time():
    began = time.perf_counter()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "@" * 300_000, "a@" * 300_000, "1." * 300_000, "+1" + "(" * 1_000_000, "1 " * 300_000, "9" * 300_000 + ".1.1.1"):
        pii.base_spans(text)
    assert time.perf_counter() - began < 20


def enumerated(emitted, moves, start):
    n, k = emitted.shape
    scores = {}
    for labels in itertools.product(range(k), repeat=n):
        scores[labels] = start[labels[0]] + sum(emitted[i, y] for i, y in enumerate(labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:], strict=False))
    total = sum(np.exp(s) for s in scores.values())
    one, pairs = np.zeros((n, k)), np.zeros((k, k))
    for labels, s in scores.items():
        for i, y in enumerate(labels):
            one[i, y] += np.exp(s) / total
        for a, b in zip(labels, labels[1:], strict=False):
            pairs[a, b] += np.exp(s) / total
    return one, pairs, np.log(total), max(scores, key=scores.get)


def test_marginals_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 5, 1, 4])
    emitted, moves, start = rng.normal(0, 2, (13, 3)), rng.normal(0, 2, (3, 3)), rng.normal(0, 2, 3)
    one, pairs, logs = crf.marginals(emitted, counts, moves, start)
    labels = crf.viterbi(emitted, counts, moves, start)
    every, at = np.zeros((3, 3)), 0
    for chain, n in enumerate(counts.tolist()):
        if n:
            own, both, log, best = enumerated(emitted[at : at + n], moves, start)
            assert np.allclose(one[at : at + n], own) and np.isclose(logs[chain], log)
            assert labels[at : at + n].tolist() == list(best)
            every += both
        at += n
    assert np.allclose(pairs, every)


@pytest.fixture(scope="module")
def model():
    return pii.trained(pii.labelled([pii.FILLERS]))


def found(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumns({c: F.lit(1) for c in ("spans", "n_ip", "row")})
    return {r.doc_id: r for r in pii.spans(docs.repartition(2), model).collect()}


def test_spans_hold_the_base(spark, model):
    texts = [None, *scraps(9, 300), "twice", "twice"]
    rows = found(spark, model, texts)
    for k, text in enumerate(texts):
        base = plain(text or "")
        assert [rows[k][f"n_{kind}"] for kind in pii.KINDS] == [sum(s[0] == j for s in base) for j in range(4)]
        assert rows[k].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(rows[k].spans.split(","))


def test_field_finds_other_forms_and_leaves_the_rest(spark, model):
    caught = {
        "please write to josé@mail.example.org today": "josé@mail.example.org",
        "mail: anna[at]host.example.com.": "anna[at]host.example.com",
        "the host 10[.]20[.]30[.]40 was down": "10[.]20[.]30[.]40",
        "paid with card 4111.1111.1111.1111 on monday": "4111.1111.1111.1111",
        "call (132) 555-1352 for it": "(132) 555-1352",
        "é日 tel: 030-555-1352, and": "030-555-1352",
    }
    clean = [
        "the order was sent on 2021-03-04 at 12:30:00 and 4111.1111.1111.1112 is no card", "token = \"681c09b8e90e7e8c9575180f595f646cf2969054\"", "300.1.2.3 and 999.999.999.999",
        "see page 12, 13 and 1999-2004 of it", "a @ b", "only words stand here and nothing else. " * 300, "4689387053447878", "Copyright 2020 by them", "$ 12.50 | 30% & <b>",
    ]
    rows = found(spark, model, [*caught, *clean])
    for k, (text, item) in enumerate(caught.items()):
        assert [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in rows[k].spans.split(","))] == [item]
    assert [rows[k].spans for k in range(len(caught), len(caught) + len(clean))] == [""] * len(clean)


def test_held_out_items(model):
    """Labels of words of lines that were not trained on."""
    rows = pii.labelled([pii.FILLERS], 600, seed=99)
    known = [pii.features(w) for words, _ in rows for w in words]
    counts = np.array([len(words) for words, _ in rows])
    roles = np.stack([model.weights[f].sum(axis=0) for f in known])
    labels = crf.viterbi(pii.emissions(roles, counts), counts, model.moves.astype(np.float32), model.start.astype(np.float32))
    truth = np.array([pii.LABELS.index(x) for _, own in rows for x in own])
    right = ((labels == truth) & (truth > 0)).sum()
    assert right >= 0.95 * (truth > 0).sum() and right >= 0.95 * (labels > 0).sum()


def test_chains_cover_all_words():
    rng = np.random.default_rng(3)
    opens, plain_word = rng.random(5000) < 0.001, rng.random(5000) < 0.5
    opens[0] = True
    sizes = pii.chains(opens, plain_word)
    assert sizes.sum() == 5000 and sizes.max() < 3 * pii.CHAIN and set(np.flatnonzero(opens)) <= set(np.cumsum(sizes) - sizes)
