import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from altloom.llm import crf, langid
from altloom.llm.queries import QUERIES
from tests.llm.conftest import WORDS, prose


def plain_posteriors(emitted, moves):
    b, step, n = np.exp(emitted), np.exp(moves), len(emitted)
    ahead, now = [], np.ones(emitted.shape[1])
    for t in range(n):
        now = (now @ step if t else now) * b[t]
        now /= now.sum()
        ahead.append(now)
    out, behind = np.empty_like(emitted), np.ones(emitted.shape[1])
    for t in range(n - 1, -1, -1):
        out[t] = ahead[t] * behind / (ahead[t] * behind).sum()
        behind = step @ (b[t] * behind)
        behind /= behind.sum()
    return out


@pytest.mark.parametrize("segment", [1, 5, 64, 10_000])
def test_segments_give_the_same_probabilities(segment):
    rng = np.random.default_rng(1)
    counts, moves = np.array([1, 130, 7, 64, 65]), rng.normal(size=(3, 3))
    emitted = 3 * rng.normal(size=(counts.sum(), 3))
    got, at = langid.posteriors(emitted, counts, moves, segment), 0
    for n in counts:
        assert np.allclose(got[at : at + n], plain_posteriors(emitted[at : at + n], moves), atol=1e-8)
        at += n


def test_probabilities_are_those_of_training():
    rng = np.random.default_rng(2)
    counts, moves = np.array([3, 70, 1, 12]), rng.normal(size=(4, 4))
    emitted = 2 * rng.normal(size=(86, 4))
    assert np.allclose(langid.posteriors(emitted, counts, moves, 16), crf.marginals(emitted, counts, moves, np.zeros(4))[0], atol=1e-8)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(8)
    return langid.trained([(lang, prose(rng, lang, 200)) for lang in WORDS for _ in range(20)], sequences=600)


def test_words_of_mixed_texts(spark, model):
    rng = random.Random(9)
    parts = [("en", 40), ("fr", 40), ("de", 30), ("en", 20)]
    text = " ".join(prose(rng, lang, n) for lang, n in parts)
    docs = spark.createDataFrame([(1, text), (2, None), (3, " 12 !! ")], "doc_id int, text string")
    rows = {r.doc_id: r for r in langid.identify(docs, model, words=True).collect()}
    truth = [lang for lang, n in parts for _ in range(n)]
    assert np.mean([a == b for a, b in zip(rows[1].labels, truth, strict=True)]) > 0.9
    assert rows[1].lang_pred == "en" and (rows[2].lang_pred, rows[2].score) == ("und", 0.0) and rows[3].labels == []


def test_held_out_accuracy(spark, tables, odd_rows):
    truth = {r[0]: r[2] for r in odd_rows if r[0] is not None and r[0] < 1000}
    rows = QUERIES["op7_language"](spark, tables).collect()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    seen = [truth[r.doc_id] == r.lang_pred for r in rows if r.held_out and r.doc_id in truth]
    assert len(seen) > 20 and np.mean(seen) > 0.95
    by_id = {r.doc_id: r.lang_pred for r in rows}
    assert {by_id[k] for k in (2000, 2001, 2002, 2004)} == {"und"} and by_id[2003] == "de"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the words", None)], "doc_id int, text string, lang string")
    assert langid.learned(docs) is None
    assert [tuple(r) for r in langid.identify(docs, None).collect()] == [(1, "und", 0.0)]
    assert langid.with_language(docs, None).count() == 0


def test_stage_keeps_rows_as_they_are(spark, tables, model):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = langid.with_language(docs, model)
    assert out.columns == docs.columns
    gone = {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in out.select("doc_id").collect()}
    assert gone == {2000, 2001, 2002, 2004}


def test_chosen_rows_are_bounded(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = langid.chosen(docs, 5, 2000)
    assert all(sum(lang == x for x, _ in rows) <= 5 for lang in WORDS) and all(len(t) <= 2000 for _, t in rows)


def test_scores_of_odd_words(model):
    found = langid.scores(model, ["", "12", "a", "A,", "ée" * 5000, "x1y"])
    assert [len(f) for f in found] == [0, 0, 3, 3, 3, 3] and np.allclose(found[2], found[3])
    known = langid.Known(np.float32)
    sums, counts, _ = langid.labelled(model, known, pa.array(["", "1 2", "a 1 b"]), False)
    assert counts.tolist() == [0, 0, 2] and np.isclose(sums[2].sum(), 2)
