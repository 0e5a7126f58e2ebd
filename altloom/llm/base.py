"""What the operators share: tables, words, and caches that live in a Python worker."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def picked(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One of the rows for each of the wanted keys; nulls match nulls.

    The key is one column, by which the join and the choice among rows with
    one key both work, so that the rows are moved once.
    """
    asked = wanted.select(F.struct(*keys).alias("__asked")).distinct()
    met = rows.withColumn("__key", F.struct(*keys)).join(asked, F.col("__key") == F.col("__asked"))
    turn = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    return met.withColumn("__turn", turn).filter("__turn = 1").drop("__key", "__asked", "__turn")


def kept_in_worker(name: str, make: Callable[[], object], of: object = None) -> object:
    """An object that a Python worker builds once and keeps for its later tasks.

    A worker keeps one object, that of its last task: it is built anew when
    ``name`` or ``of`` is another, and the one before it is let go first.
    """
    store = sys.modules.setdefault("_altloom_worker", types.ModuleType("_altloom_worker"))
    held = getattr(store, "held", None)
    if held is None or held[:2] != (name, of):
        store.held = held = None
        store.held = held = (name, of, make())
    return held[2]


def slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``most`` bytes of text each, a row at least."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)))
    start = 0
    while start < batch.num_rows:
        floor = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, floor + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def strings(values: pa.Array) -> list[str]:
    """The strings of an array without nulls; many times faster than value by value."""
    return values.to_numpy(zero_copy_only=False).tolist()


def ragged_index(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every piece, one piece after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


class Known:
    """Numbers worked out once per string: strings have slots, slots have pieces of one flat array.

    All is forgotten when more than ``most`` strings are known, so the memory
    is bounded whatever the input holds.
    """

    def __init__(self, dtype: type, most: int = 600_000):
        self.dtype, self.most = dtype, most
        self.forget()

    def forget(self) -> None:
        self.slot_of: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, self.dtype)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.used = 0

    def slots(self, keys: Sequence[str], work_out: Callable[[list[str]], list[Sequence]]) -> np.ndarray:
        """The slot of each key; what is not known yet is worked out together."""
        if len(self.slot_of) > self.most:
            self.forget()
        found = np.fromiter(map(self.slot_of.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = list(dict.fromkeys([keys[k] for k in missing]))
            pieces = work_out(new)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            first, need = len(self.slot_of), int(sizes.sum())
            self.flat = grown(self.flat, self.used + need)
            self.starts, self.sizes = grown(self.starts, first + len(new)), grown(self.sizes, first + len(new))
            if need:
                arrays = isinstance(pieces[0], np.ndarray)
                values = np.concatenate(pieces) if arrays else np.fromiter(chain.from_iterable(pieces), self.dtype, need)
                self.flat[self.used : self.used + need] = values
            self.sizes[first : first + len(new)] = sizes
            self.starts[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.used += need
            self.slot_of.update(zip(new, range(first, first + len(new)), strict=True))
            found[missing] = [self.slot_of[keys[k]] for k in missing]
        return found

    def gather(self, slots: np.ndarray) -> np.ndarray:
        return self.flat[ragged_index(self.starts[slots], self.sizes[slots])]


def grown(values: np.ndarray, need: int) -> np.ndarray:
    if need <= len(values):
        return values
    out = np.zeros(max(need, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


def per_row(owner_ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``sizes`` over each row's run; ``owner_ends`` are the runs' ends."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = total[owner_ends]
    return np.diff(np.concatenate([[0], ends]))
