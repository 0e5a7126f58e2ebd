"""Words of many texts at once, cut at single ASCII bytes.

In UTF-8 a byte below 128 is always a character of its own, so texts can be
cut as one row of bytes. A table says of each byte whether it belongs to a
word, parts words, or also ends the piece that the words before it stand in.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IN_WORD, GAP, BREAK = 0, 1, 2
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = np.where((AS_IS >= 65) & (AS_IS <= 90), AS_IS + 32, AS_IS).astype(np.uint8)


class Cut(NamedTuple):
    words: pa.StringArray
    rows: np.ndarray  # of each word, the row it stands in
    opens: np.ndarray  # of each word, whether it is the first of its piece
    starts: np.ndarray  # of each word, its first byte, counted from the first row's
    row_starts: np.ndarray  # of each row, likewise


def table(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[list(gaps)] = GAP
    kinds[list(breaks)] = BREAK
    return kinds


def cut(column: pa.Array, kinds: np.ndarray, letters: np.ndarray = LOWER) -> Cut:
    """The words of every row; a null row has none. ``letters`` says what each byte becomes."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    borders = (ends - ends[0]).astype(np.int64)
    kind = kinds[data]
    inside = kind == IN_WORD
    first = np.zeros(len(data) + 1, bool)  # the first byte of a row; empty rows share it with the next
    first[borders[:-1]] = True
    first = first[:-1]
    opening = inside.copy()
    opening[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(opening)
    ends_of_pieces = (kind == BREAK) | first
    piece = np.cumsum(ends_of_pieces, dtype=np.int32)[starts]
    opens = np.ones(len(starts), bool)
    opens[1:] = piece[1:] != piece[:-1]
    offsets = np.append(np.flatnonzero(opening[inside]), int(inside.sum())).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters[data[inside]]))
    rows = np.searchsorted(borders, starts, side="right") - 1
    return Cut(words, rows.astype(np.int32), opens, starts, borders[:-1])
