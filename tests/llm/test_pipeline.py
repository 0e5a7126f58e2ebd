"""The stages against plain versions, each on what the stage before it kept."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from altloom.llm import bpe, mixing
from altloom.llm import near as near_copies
from tests.llm.test_near import joined


def spaced(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append(docs)
    return out


def test_stages(spark, tables, tmp_path):
    docs, spoken, exact, near, mixed, ids = stages(spark, tables, tmp_path)
    assert all(d.columns == docs.columns for d in (spoken, exact, near, mixed))
    rows = {d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for d in (docs, spoken, exact, near, mixed)}
    assert {r[0] for r in rows[docs]} - {r[0] for r in rows[spoken]} == {2000, 2001, 2002, 2004}

    least = {}
    for doc_id, text in rows[spoken]:
        known = least.setdefault(spaced(text), doc_id)
        if known is None or (doc_id is not None and doc_id < known):
            least[spaced(text)] = doc_id
    assert sorted(map(repr, [(i, spaced(t)) for i, t in rows[exact]])) == sorted(map(repr, [(i, t) for t, i in least.items()]))

    drawn = [near_copies.sketch(text) for _, text in rows[exact]]
    root, first = joined(drawn), {}
    for (doc_id, _), r in zip(rows[exact], root, strict=True):
        known = first.setdefault(r, doc_id)
        if known is None or (doc_id is not None and doc_id < known):
            first[r] = doc_id
    assert sorted(map(str, (r[0] for r in rows[near]))) == sorted(map(str, first.values()))

    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    assert Counter(r[0] for r in rows[mixed]) == Counter({d: n for d, n in copies.items() if n})

    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows[mixed])
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in ids.collect()) == want


def test_run_gives_the_last_stage(spark, tables):
    assert corpus_pipeline.run(spark, tables).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_on_nothing(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
