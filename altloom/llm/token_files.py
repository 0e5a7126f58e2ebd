"""Token ids in binary files with Elias-Fano boundaries.

Documents are cut into ascending ranges of ids; each range is tokenised in
order and written as segments. A segment holds the ids of its documents as one
array of two-byte or four-byte integers, and two Elias-Fano sequences: the
ends of the documents in the array, and the document ids themselves. A
sequence of n numbers up to u takes n low parts of log2(u / n) bits and at
most 3 n bits of unary high parts. With them is stored how many numbers lie
before every 64th byte of the high parts, by which `select` looks at few bytes
for one number, and `selects` at the blocks that hold those asked for. Reading
takes starts and ends of documents from `selects`; no table of 64-bit offsets
is kept.

A segment is closed when it has ``SEGMENT`` ids; it holds at least one whole
document, so only a document longer than that makes a longer one. The files
are written by Spark, whose writer commits whole tasks, so a lost executor
leaves no half segment.

Offsets over all documents come from the segments' totals: they are summed
within a range, and the ranges' own totals, one row per range, are added.

Nulls: a null text is empty and has the end id alone. Null ids come first.
Rows with the same id follow one another in the order of their texts'
checksums. An empty table gives no files' rows and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from altloom.llm.base import Known, kept_in_worker, per_row, ragged_index, read, slices, strings, whole
from altloom.session import materialize

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SEGMENT = 1 << 21
WORDS = 400_000
MARKS = "".join(chr(c) for c in [*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*[" + "".join("\\" + c for c in MARKS) + "]*$"
# The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from 256.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
EVERY = 64
SEGMENTS = "part int, seq int, n_tokens bigint, n_docs int, n_null int, first_id bigint, width int, ids binary, ends binary, doc_ids binary"


class EliasFano:
    """An ascending sequence of whole numbers from 0, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sampled: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.sampled = sampled  # select structure: ones before every EVERY-th byte of the high parts

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, most = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = max(0, (most // max(n, 1)).bit_length() - 1)
        shift = np.uint64(low_bits)
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        packed = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")
        high = np.packbits(bits, bitorder="little")
        ones_before = np.cumsum(np.bitwise_count(high), dtype=np.int64)[EVERY - 1 :: EVERY]
        return cls(n, low_bits, packed, high, np.concatenate([[0], ones_before]).astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.sampled)], "<u4")
        return head.tobytes() + self.sampled.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, size, blocks = (int(x) for x in np.frombuffer(raw, "<u4", 4))
        body = np.frombuffer(raw, np.uint8, offset=16 + 4 * blocks)
        return cls(n, low_bits, body[:size], body[size:], np.frombuffer(raw, "<u4", blocks, offset=16))

    def lows(self, first: int, count: int) -> np.ndarray:
        """The low parts of ``count`` numbers from the ``first``."""
        begin, end = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 : begin % 8 + end - begin]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (bits.reshape(count, self.low_bits) * weights).sum(axis=1, dtype=np.uint64)

    def select(self, k: int) -> int:
        """The k-th number, from 0: one sampled block of high parts is looked at."""
        block = int(np.searchsorted(self.sampled, k, side="right")) - 1
        start = block * EVERY
        bits = np.unpackbits(self.high[start : start + EVERY], bitorder="little")
        place = start * 8 + int(np.flatnonzero(bits)[k - int(self.sampled[block])])
        return ((place - k) << self.low_bits) | int(self.lows(k, 1)[0])

    def selects(self, ks: np.ndarray) -> np.ndarray:
        """The numbers at ascending places ``ks``: only the blocks that hold them are unpacked."""
        ks = np.asarray(ks, np.int64)
        if not len(ks):
            return np.zeros(0, np.uint64)
        block = np.searchsorted(self.sampled, ks, side="right") - 1
        used, turn = np.unique(block, return_inverse=True)
        padded = np.zeros(EVERY * (int(used[-1]) + 1), np.uint8)
        padded[: len(self.high)] = self.high[: len(padded)]
        bits = np.unpackbits(padded.reshape(-1, EVERY)[used], axis=1, bitorder="little")
        row, place = np.nonzero(bits)
        first = np.searchsorted(row, np.arange(len(used)))
        at = place[first[turn] + ks - self.sampled[block]] + block * EVERY * 8
        low, high = int(ks[0]), int(ks[-1]) + 1
        return ((at - ks).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(low, high - low)[ks - low]

    def all(self) -> np.ndarray:
        return self.selects(np.arange(self.n))


class Words:
    """A tokenizers file; the ids of a part of a word are worked out once and kept.

    A word is what stands between ASCII white space, where this kind of
    vocabulary always cuts. A Latin word with ASCII marks behind it is cut
    after its letters only, is composed already, and is lower-cased letter by
    letter, so the library's model is asked for its two parts. Any other word,
    such as one that holds a special token, goes to the library as it is.
    """

    def __init__(self, content: bytes):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.model = self.tokenizer.model
        self.known = Known(np.uint32, WORDS)
        self.plain = self.is_plain()

    def is_plain(self) -> bool:
        """Whether Latin words and ASCII marks reach the model as they are, but for case and byte letters."""
        probe = ["Straße", "ÉTÉ,", "ok!!", "A-b", "#*$", "ñandú.", "<|endoftext|>"]
        self.plain = True
        return all(self.of(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def of(self, text: str) -> list[int]:
        return self.texts(pa.array([text], pa.string()), 0)[0][:-1].tolist()

    def work_out(self, keys: list[str]) -> list[list[int]]:
        """Ids of parts, and of words, which have a space before them."""
        words = [k for k in keys if k[:1] == " "]
        given = iter(self.tokenizer.encode_batch_fast([w[1:] for w in words], add_special_tokens=False))
        tokenize = self.model.tokenize
        return [
            next(given).ids if k[:1] == " " else [t.id for t in tokenize(k if k.isascii() else k.encode().decode("latin-1").translate(BYTE_LETTERS))]
            for k in keys
        ]

    def slots(self, words: pa.StringArray) -> np.ndarray:
        """Of each word the slots of its two parts; a word that is not cut is its own first part."""
        latin = pc.match_substring_regex(words, LATIN) if self.plain else pa.array(np.zeros(len(words), bool))
        low = pc.utf8_lower(words)
        letters = pc.utf8_rtrim(low, MARKS)
        first = pc.if_else(latin, letters, pc.binary_join_element_wise("", words, " "))
        second = pc.if_else(latin, behind(low, letters), "")
        firsts, seconds = first.dictionary_encode(), second.dictionary_encode()
        keys = strings(firsts.dictionary) + strings(seconds.dictionary)
        found = self.known.slots(keys, self.work_out)
        n = len(firsts.dictionary)
        return np.stack([found[:n][firsts.indices.to_numpy()], found[n:][seconds.indices.to_numpy()]], axis=1)

    def texts(self, column: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end id, and their counts."""
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        pairs = self.slots(words.dictionary)[words.indices.to_numpy()] if len(words) else np.zeros((0, 2), np.int64)
        sizes = self.known.sizes[pairs].sum(axis=1)
        counts = per_row(ends, sizes)
        flat = pairs.ravel()
        out = np.empty(int(counts.sum()) + len(counts), np.uint32)
        stops = np.cumsum(counts) + np.arange(len(counts))
        inner = np.ones(len(out), bool)
        inner[stops] = False
        out[inner] = self.known.gather(flat)
        out[stops] = end_id
        return out, counts + 1


def behind(whole_words: pa.StringArray, parts: pa.StringArray) -> pa.StringArray:
    """What of each word stands behind its first part."""
    sizes, kept = pc.binary_length(whole_words).to_numpy(), pc.binary_length(parts).to_numpy()
    offsets = np.frombuffer(whole_words.buffers()[1], np.int32)[whole_words.offset :][: len(whole_words)].astype(np.int64)
    rest = (sizes - kept).astype(np.int64)
    data = np.frombuffer(whole_words.buffers()[2] or b"", np.uint8)[ragged_index(offsets + kept, rest)]
    borders = np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(rest), pa.py_buffer(borders), pa.py_buffer(data))


def tokenizer_builder(spark: SparkSession, path: str):
    with open(path, "rb") as source:
        content = spark.sparkContext.broadcast(source.read())
    return lambda: kept_in_worker("words", lambda: Words(content.value), of=path)


def segment(part: int, seq: int, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> dict:
    null = sum(d is None for d in doc_ids)
    given = np.array(doc_ids[null:], np.int64)
    first = int(given[0]) if len(given) else 0
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return {
        "part": part, "seq": seq, "n_tokens": len(ids), "n_docs": len(doc_ids), "n_null": null, "first_id": first,
        "width": width, "ids": ids.astype(f"<u{width}").tobytes(), "ends": EliasFano.of(np.cumsum(counts)).to_bytes(),
        "doc_ids": EliasFano.of(given.astype(np.uint64) - np.uint64(first % (1 << 64))).to_bytes(),
    }


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID, most: int = SEGMENT) -> DataFrame:
    """The files' rows: a segment each, in ascending ranges of doc_id."""
    tokenizer = tokenizer_builder(docs.sparkSession, path or public_tokenizers.path(VOCABULARY))
    schema = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("n_docs", pa.int32()), ("n_null", pa.int32()),
         ("first_id", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("ends", pa.binary()), ("doc_ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = tokenizer(), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            nonlocal seq
            row = segment(part, seq, names, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            seq += 1
            names.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        size = 0
        for batch in batches:
            for rows in slices(batch, "text", min(4 << 20, 2 * most)):
                names += rows.column("doc_id").to_pylist()
                held.append(words.texts(rows.column("text"), end_id))
                size += len(held[-1][0])
                if size >= most:
                    yield closed()
                    size = 0
        if held:
            yield closed()

    # Only the order of rows with one id needs the checksum; it is taken after the shuffle.
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32(whole("text").cast("binary")))
    return materialize(ordered.mapInArrow(run, SEGMENTS))


def with_starts(files: DataFrame) -> DataFrame:
    """Add ``start`` to each segment: ids before it."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of ids
    carried = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
    starts = starts.join(F.broadcast(carried), F.col("part") == F.col("of"))
    return starts.select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("inside") + F.col("carried")).alias("start"))


def read_back(files: DataFrame) -> DataFrame:
    """doc_id, start in its range, n_tokens and checksum of every document, read from the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                borders, every = EliasFano.from_bytes(row["ends"]), np.arange(row["n_docs"])
                ends = borders.selects(every).astype(np.int64)
                starts = np.concatenate([[0], borders.selects(every[:-1]).astype(np.int64)])
                named = EliasFano.from_bytes(row["doc_ids"]).all().astype(np.int64) + row["first_id"]
                raw = memoryview(ids.tobytes())
                checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None] * row["n_null"] + named.tolist(), pa.int64()), pa.array([row["part"]] * row["n_docs"], pa.int32()),
                     pa.array([row["seq"]] * row["n_docs"], pa.int32()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(checks, pa.int64())],
                    ["doc_id", "part", "seq", "in_segment", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(run, "doc_id bigint, part int, seq int, in_segment bigint, n_tokens bigint, ids_crc32 bigint")


def documents_of(files: DataFrame) -> DataFrame:
    """doc_id, start over all documents, n_tokens and ids_crc32."""
    starts = with_starts(files)
    rows = read_back(files)
    met = rows.join(starts, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))
    return met.select("doc_id", (F.col("start") + F.col("in_segment")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    return documents_of(write(read(spark, sf_dir, "documents", "doc_id", "text")))
