import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from altloom.llm import bpe
from altloom.llm.queries import QUERIES

PARTS = [" ", "  ", "\n", "\t", " ", "\u0085", "\x1c", "a", "the", " of", "é", "ß", "日", "'s", "'re", "12", "½", "!!", "==", "😀", "\r", "\x0b", "İ", "̈", "zx", " " * 20]


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts_equal_library(merges, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    ids, counts = merges.texts(pa.array([*texts, None], pa.string()))
    at = 0
    for text, n in zip([*texts, ""], counts, strict=True):
        assert ids[at : at + n].tolist() == library.encode_ordinary(text), repr(text)
        at += n


def test_pieces_equal_merges(merges):
    rng = random.Random(4)
    for _ in range(300):
        raw = bytes(rng.choice(b"abcdeth =\xc3\xa9-\x00\xff") for _ in range(rng.randint(1, 60)))
        assert merges.piece(raw) == (merges.merged(raw) if raw not in merges.ranks else [merges.ranks[raw]])


def test_small_vocabulary_steps_back():
    ranks = {bytes([b]): b for b in b"abc"} | {b"ab": 300, b"bc": 301, b"abc": 302, b"ca": 303, b"cab": 304}
    own = bpe.Merges(ranks, "[abc]+")
    rng = random.Random(5)
    for _ in range(2000):
        raw = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14))).encode()
        assert own.piece(raw) == ([ranks[raw]] if raw in ranks else own.merged(raw)), raw
    with pytest.raises(ValueError):
        own.piece(b"xa")


def test_query_equals_library(spark, tables, odd_rows, library):
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = library.encode_ordinary(text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = [tuple(r) for r in QUERIES["op3_byte_bpe"](spark, tables).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_decode_is_the_way_back(spark):
    docs = spark.createDataFrame([(1, "héllo  world\n", 7), (2, None, 8)], "doc_id int, text string, more int")
    rows = bpe.decode(bpe.encode(docs)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.more, bytes(r.decoded).decode()) for r in rows] == [(1, 7, "héllo  world\n"), (2, 8, "")]
