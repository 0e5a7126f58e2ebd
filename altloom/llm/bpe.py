"""Byte-level BPE encoding and decoding.

The bytes of a piece are read as Latin-1, so that an automaton over the
vocabulary finds every token at every place in one pass. From the longest
match at each place the encoder walks on, takes a token only if it may stand
next to the one before it, and steps back to the next shorter match where it
may not. Two tokens may stand next to each other if the merges, applied to
their joined bytes, give just these two; that is worked out once per pair and
remembered. A text's encoding is the only sequence in which all neighbours
agree, so a place that leads nowhere is never tried again and every match is
looked at once: the time is linear in the text, and the ids are those of the
merges.

Texts are cut where the splitting pattern always cuts, before a space that is
followed by a character that is not white space. The parts repeat a lot, so
their ids are kept in the worker, in bounded tables.

Nulls count as empty texts, which have no ids. Texts of any length are encoded
whole. Repeated rows and null ids give a row each; other columns are kept by
`encode` under their names, except those it makes. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from altloom.llm.base import Known, kept_in_worker, per_row, ragged_index, read, slices, strings

RANKS = "byte_bpe_50k.tiktoken"
PAIRS = 300_000
PIECES = 200_000
PARTS = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.longest = max(map(len, ranks))
        self.agree: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.parts, self.firsts = Known(np.uint32, PARTS), Known(np.uint32, PARTS // 8)

        order = max(self.token) + 1
        sizes = np.zeros(order, np.int64)
        for rank, token in self.token.items():
            sizes[rank] = len(token)
        self.byte_sizes, self.byte_starts = sizes, np.cumsum(sizes) - sizes
        self.byte_flat = np.frombuffer(b"".join(self.token.get(r, b"") for r in range(order)), np.uint8)

    def merged(self, raw: bytes) -> list[int]:
        """The merges as they are defined: the lowest rank first, from the left."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        get, none = self.ranks.get, len(self.byte_sizes)
        while len(parts) > 1:
            found = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best == none:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        found = self.agree.get((left, right))
        if found is None:
            if len(self.agree) >= PAIRS:
                self.agree.clear()
            found = self.agree[left, right] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return found

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        alone = self.ranks.get(raw)
        if alone is not None:
            return [alone]
        end, ranks, text = len(raw), self.ranks, raw.decode("latin-1")
        ids: list[int] = []
        untried: dict[int, int] = {}  # place: the length to try next
        dead: set[int] = set()
        place = 0
        while place < end:
            length = untried.get(place)
            if length is None:
                length = self.automaton.longest_prefix(text[place : place + self.longest])
            while length:
                rank = ranks.get(raw[place : place + length])
                length -= 1
                if rank is not None and place + length + 1 not in dead and (not ids or self.may_follow(ids[-1], rank)):
                    untried[place] = length
                    ids.append(rank)
                    place += length + 1
                    break
            else:
                if not ids:
                    raise ValueError("the vocabulary cannot spell a text")
                dead.add(place)
                place -= len(self.token[ids.pop()])
        return ids

    def text(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            ids = self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                ids = self.piece(piece.encode())
                if len(piece) < 100:
                    self.pieces[piece] = ids
            out += ids
        return out

    def texts(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and how many belong to each row."""
        column = pc.fill_null(column, "")
        # A part may only be encoded alone if no run of white space crosses its start.
        odd = pc.match_substring_regex(column, " (?:[\\s\\x0b\\x1c-\\x1f\\x{85}]|\\p{Z}|$)").to_numpy(zero_copy_only=False)
        if odd.any():
            return self.rows_apart(column, odd)
        lists = pc.split_pattern(column, " ")
        ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        parts = lists.flatten().dictionary_encode()
        firsts = np.concatenate([[0], ends[:-1]])
        names, index = strings(parts.dictionary), parts.indices.to_numpy()
        # The first part of a text has no space before it.
        is_first = np.zeros(len(index), bool)
        is_first[firsts] = True
        sizes = np.zeros(len(index), np.int64)
        starts = np.zeros(len(index), np.int64)
        pools = []
        shift = 0
        for table, chosen, space in ((self.parts, ~is_first, " "), (self.firsts, is_first, "")):
            used, back = np.unique(index[chosen], return_inverse=True)
            slots = table.slots([names[i] for i in used], lambda new, space=space: [self.text(space + p) for p in new])[back]
            sizes[chosen], starts[chosen] = table.sizes[slots], table.starts[slots] + shift
            pools.append(table.flat[: table.used])
            shift += table.used
        ids = np.concatenate(pools)[ragged_index(starts, sizes)]
        return ids, per_row(ends, sizes)

    def rows_apart(self, column: pa.StringArray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with longer runs of white space are split by the pattern as a whole."""
        plain_ids, plain_sizes = self.texts(column.filter(pa.array(~odd))) if not odd.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        others = [np.array(self.text(t), np.uint32) for t in column.filter(pa.array(odd)).to_pylist()]
        sizes, starts = np.zeros(len(odd), np.int64), np.zeros(len(odd), np.int64)
        sizes[~odd], sizes[odd] = plain_sizes, [len(o) for o in others]
        starts[~odd] = np.cumsum(plain_sizes) - plain_sizes
        starts[odd] = len(plain_ids) + np.cumsum(sizes[odd]) - sizes[odd]
        return np.concatenate([plain_ids, *others])[ragged_index(starts, sizes)], sizes

    def spelled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows, and how many belong to each row."""
        sizes = self.byte_sizes[ids]
        return self.byte_flat[ragged_index(self.byte_starts[ids], sizes)], per_row(np.cumsum(counts), sizes)


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose rows are runs of ``values``."""
    data = np.ascontiguousarray(values)
    offsets = np.concatenate([[0], np.cumsum(counts * data.itemsize)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    ).cast(pa.binary())


def shared_vocabulary(spark: SparkSession, path: str, pattern: str):
    """A builder of the vocabulary for tasks; the file is read here and sent once to each executor."""
    with open(path, "rb") as source:
        content = spark.sparkContext.broadcast(source.read())

    def build() -> Merges:
        lines = content.value.splitlines()
        return Merges({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}, pattern)

    return lambda: kept_in_worker("merges", build, of=(path, pattern))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """The rows without their text, with ``n_tokens`` and ``ids``, little-endian unsigned 32-bit integers.

    With ``decoded`` the ids are turned back into bytes in the same pass, so
    that they need not travel twice.
    """
    made = {"n_tokens", "ids", "decoded"}
    kept = [c for c in docs.columns if c != "text" and c not in made]
    vocabulary = shared_vocabulary(docs.sparkSession, path or public_tokenizers.path(RANKS), pattern)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    fields += ["n_tokens bigint", "ids binary"] + ["decoded binary"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = vocabulary()
        for batch in batches:
            for rows in slices(batch, "text", 4 << 20):
                ids, counts = merges.texts(rows.column("text"))
                columns = [rows.column(c) for c in kept] + [pa.array(counts, pa.int64()), binaries(ids.astype("<u4"), counts)]
                names = [*kept, "n_tokens", "ids"]
                if decoded:
                    columns.append(binaries(*merges.spelled(ids, counts)))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*kept, F.col("text")).mapInArrow(run, ", ".join(fields))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Rows with ``ids`` as `encode` makes them, with their bytes in ``decoded``; null ids give no bytes."""
    kept = [c for c in rows.columns if c not in ("ids", "decoded")]
    vocabulary = shared_vocabulary(rows.sparkSession, path or public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = vocabulary()
        for batch in batches:
            for piece in slices(batch, "ids"):
                raw = [x or b"" for x in piece.column("ids").to_pylist()]
                ids = np.frombuffer(b"".join(raw), "<u4")
                out = binaries(*merges.spelled(ids, np.array([len(x) // 4 for x in raw], np.int64)))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], out], [*kept, "decoded"])

    return rows.select(*kept, "ids").mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def digested(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes they decode to."""
    return encode(docs.select("doc_id", "text"), path, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digested(read(spark, sf_dir, "documents", "doc_id", "text"))
