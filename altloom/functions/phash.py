"""Perceptual hashes of grey grids and their distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from altloom.functions.base import ColumnLike, col, let


def pack(bits: Column) -> Column:
    """Bits, first one highest, as a bigint."""
    return F.aggregate(
        bits, F.lit(0).cast("bigint"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit.cast("int").cast("bigint"))
    )


def ahash(cells: ColumnLike) -> Column:
    """A bit per cell: brighter than the mean."""

    def bits(grid: Column) -> Column:
        total = F.aggregate(grid, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
        return let(total / F.size(grid), lambda mean: pack(F.transform(grid, lambda x: x.cast("double") > mean)))

    return let(col(cells), bits)


def dhash(cells: ColumnLike, width: int) -> Column:
    """A bit per neighbouring pair in a row: the right one is brighter."""

    def bits(grid: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(grid) - 1), lambda n: n % width < width - 1)
        return pack(F.transform(starts, lambda n: F.get(grid, n + 1) > F.get(grid, n)))

    return let(col(cells), bits)


def hash_key(kind: str, value: Column, bits: int = 64) -> Column:
    digits = (bits + 3) // 4
    return F.concat(F.lit(f"{kind}:"), F.lpad(F.lower(F.hex(value)), digits, "0"))


def cache_keys(content: Column, cells: Column, width: int, slide: Column, shape: Column, w: Column, h: Column) -> Column:
    """Keys a picture may be found by, most exact first."""
    place = F.concat(
        F.lit("content:slide"), slide.cast("string"), F.lit("-shape"), shape.cast("string"), F.lit("-"),
        w.cast("string"), F.lit("x"), h.cast("string"),
    )
    return F.array_compact(
        F.array(
            F.concat(F.lit("bytesha1:"), F.sha1(content)),
            F.when(cells.isNotNull(), hash_key("ahash", ahash(cells), width * width)),
            F.when(cells.isNotNull(), hash_key("dhash", dhash(cells, width), width * width)),
            place,
        )
    )


def distance(a: ColumnLike, b: ColumnLike) -> Column:
    """Differing bits of two packed hashes."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def hamming(a: ColumnLike, b: ColumnLike) -> Column:
    """Differing bits of two typed hex hashes; null for other types or no hex."""
    a, b = col(a), col(b)
    digits = [F.substring_index(x, ":", -1) for x in (a, b)]
    size = F.ceil(F.greatest(*[F.length(d) for d in digits]) / 8).cast("int")
    hex_a, hex_b = (F.lpad(d, size * 8, F.lit("0")) for d in digits)
    kinds = [F.substring_index(x, ":", 1) for x in (a, b)]
    comparable = (kinds[0] == kinds[1]) & a.rlike("^[^:]+:[0-9a-fA-F]+$") & b.rlike("^[^:]+:[0-9a-fA-F]+$")

    def chunk(text: Column, n: Column) -> Column:
        return F.conv(F.substr(text, n * 8 + 1, F.lit(8)), 16, 10).cast("bigint")

    total = F.aggregate(
        F.sequence(F.lit(0), size - 1), F.lit(0),
        lambda acc, n: acc + F.bit_count(chunk(hex_a, n).bitwiseXOR(chunk(hex_b, n))),
    )
    return F.when(comparable & (size > 0), total)


def is_similar(a: ColumnLike, b: ColumnLike, threshold: int = 5) -> Column:
    return F.coalesce(hamming(a, b) <= threshold, F.lit(False))
