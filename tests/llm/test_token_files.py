import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from altloom.llm import token_files
from altloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**12), max_size=300))
def test_elias_fano_keeps_numbers(values):
    values = sorted(values)
    found = token_files.EliasFano.from_bytes(token_files.EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert found.all().tolist() == values
    assert [found.select(k) for k in range(len(values))] == values
    some = np.flatnonzero(np.random.default_rng(len(values)).random(len(values)) < 0.3)
    assert found.selects(some).tolist() == [values[k] for k in some]


def test_elias_fano_is_small():
    rng = random.Random(1)
    values = np.array(sorted(rng.choices(range(10**9), k=10_000)), np.uint64)
    assert len(token_files.EliasFano.of(values).to_bytes()) * 8 < 10_000 * (np.log2(10**5) + 3.2)


def test_words_equal_library(library):
    words = token_files.Words(open(public_tokenizers.path(token_files.VOCABULARY), "rb").read())
    rng = random.Random(2)
    parts = [" ", "\n", "\t", "\u0085", "\x1c", " ", "a", "The", " of", "É", "é", "'S", "12", "½", "!!", "😀", "İ", "Σ", "ΑΣ", "ﬁ", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "'", "-", "]", "^", "\\", "ß", "×", "÷", "µ", "ª", "`"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    ids, counts = words.texts(pa.array([*texts, None], pa.string()), 2)
    at = 0
    for text, n in zip([*texts, ""], counts, strict=True):
        assert ids[at : at + n].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], repr(text)
        at += n


def test_special_tokens_are_the_library_s(spark, library):
    rows = [(1, "a <|endoftext|> b"), (2, "x<|endoftext|>y <|startoftext|>!"), (3, "<|ENDOFTEXT|> c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in token_files.documents_of(token_files.write(docs)).collect())
    assert got == expected(rows, library) and got[0][2] == 4


def expected(rows, library):
    out, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_library(spark, tables, odd_rows, library):
    got = [tuple(r) for r in QUERIES["op5_token_files"](spark, tables).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected(odd_rows, library)))


def test_many_segments(spark, tables, odd_rows, library):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    files = token_files.write(docs, most=300)
    assert files.count() > 3
    got = [tuple(r) for r in token_files.documents_of(files).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected(odd_rows, library)))
