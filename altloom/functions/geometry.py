"""Sizes, units and directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from altloom.functions.base import ColumnLike, col

EMU_PER_INCH = 914400
EMU_PER_PIXEL = 9525


def emu_to_px(c: ColumnLike, dpi: int = 96) -> Column:
    """Whole pixels, truncated."""
    return F.coalesce((col(c) * dpi / EMU_PER_INCH).cast("int"), F.lit(0))


def emu_to_px_rounded(c: ColumnLike) -> Column:
    """Whole pixels, halves to even."""
    return F.coalesce(F.bround(col(c) / EMU_PER_PIXEL, 0).cast("int"), F.lit(0))


def emu_to_pt(c: ColumnLike) -> Column:
    return F.coalesce(col(c) * 72 / EMU_PER_INCH, F.lit(0.0))


def area(w: ColumnLike, h: ColumnLike) -> Column:
    return col(w) * col(h)


def aspect_ratio(w: ColumnLike, h: ColumnLike) -> Column:
    """Long side over short side; null where a side is missing."""
    w, h = col(w), col(h)
    return F.when((w > 0) & (h > 0), F.greatest(w, h) / F.least(w, h))


def parse_area(c: ColumnLike, width: int = 720, height: int = 540) -> Column:
    """``"1%"`` of a slide, ``"100px"`` or a plain number, in square points."""
    t = col(c)
    share = (F.regexp_extract(t, r"^([0-9.]+)%$", 1).try_cast("double") * (width * height) / 100).cast("int")
    return F.when(t.endswith("%"), share).otherwise(F.regexp_extract(t, r"^(\d+)(?:px)?$", 1).try_cast("int"))


def line_direction(w: ColumnLike, h: ColumnLike, rule: str = "threefold") -> Column:
    """Direction of a line by one of three rules; empty where unclear.

    ``threefold``: one side over three times the other. ``bands``: ratio bands
    with a gap between. ``pixels``: a side under ten pixels.
    """
    w, h = col(w), col(h)
    if rule == "threefold":
        found = F.when(w > h * 3, "horizontal").when(h > w * 3, "vertical").otherwise("diagonal")
        return F.when((w > 0) & (h > 0), found).otherwise("")
    if rule == "bands":
        ratio = w / h
        found = (
            F.when(ratio > 3, "horizontal").when(ratio < 0.33, "vertical").when(ratio.between(0.8, 1.2), "diagonal").otherwise("")
        )
        return F.when((w > 0) & (h > 0), found).otherwise("")
    if rule == "pixels":
        return (
            F.when((h < 10) & (w > h * 3), "horizontal").when((w < 10) & (h > w * 3), "vertical").otherwise("diagonal")
        )
    raise ValueError(f"unknown rule {rule}")


def colour_name(r: ColumnLike, g: ColumnLike, b: ColumnLike) -> Column:
    """A plain name for a colour, empty where none fits."""
    r, g, b = col(r), col(g), col(b)
    # Bounds of each name, checked in this order.
    return (
        F.when((r > 200) & (g < 100) & (b < 100), "red")
        .when((r < 100) & (g > 200) & (b < 100), "green")
        .when((r < 100) & (g < 100) & (b > 200), "blue")
        .when((r > 200) & (g > 200) & (b < 100), "yellow")
        .when((r > 200) & (g < 150) & (b > 200), "purple")
        .when((r > 200) & (g > 150) & (b < 100), "orange")
        .when((r < 100) & (g < 100) & (b < 100), "black")
        .when((r > 200) & (g > 200) & (b > 200), "white")
        .when((r > 100) & (g > 100) & (b > 100), "gray")
        .otherwise("")
    )
