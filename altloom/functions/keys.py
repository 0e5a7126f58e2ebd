"""Digests and the keys elements are found by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from altloom.functions.base import ColumnLike, col

NO_HASH = "00000000"
KEY_PATTERN = r"^slide_(\d+)_(?:shapeid_|shape_)(\d+)(?:_hash_[0-9a-f]+)?"


def digest(c: ColumnLike, algo: str = "sha256", chars: int | None = None) -> Column:
    made = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256)}[algo](col(c))
    return made if chars is None else F.left(made, F.lit(chars))


def text_hash(c: ColumnLike) -> Column:
    """Rerun hash of a written text."""
    return digest(F.encode(col(c), "utf-8"), "sha1", 8)


def properties_hash(*parts: ColumnLike) -> Column:
    """Stands in for a picture hash where an element has no picture."""
    return digest(F.concat_ws("_", *[col(p).cast("string") for p in parts]), "md5", 8)


def instance_key(slide: ColumnLike, shape: ColumnLike) -> Column:
    return F.concat(F.lit("slide_"), col(slide).cast("string"), F.lit("_shape_"), col(shape).cast("string"))


def stable_key(slide: ColumnLike, shape_id: ColumnLike, image_hash: ColumnLike) -> Column:
    return F.concat(
        F.lit("slide_"), col(slide).cast("string"), F.lit("_shapeid_"), col(shape_id).cast("string"),
        F.lit("_hash_"), F.left(col(image_hash), F.lit(8)),
    )


def image_key(slide: ColumnLike, shape: ColumnLike, image_hash: ColumnLike) -> Column:
    """Key of a picture; numeric shapes use the id form, nested ones the index form."""
    shape = col(shape).cast("string")
    label = F.when(shape.rlike(r"^\d+$"), "_shapeid_").otherwise("_shape_")
    hashed = F.when(F.coalesce(col(image_hash), F.lit("")) == "", NO_HASH).otherwise(F.left(col(image_hash), F.lit(8)))
    return F.concat(F.lit("slide_"), col(slide).cast("string"), label, shape, F.lit("_hash_"), hashed)


def element_key(slide: ColumnLike, shape_id: ColumnLike, shape_idx: ColumnLike, image_hash: ColumnLike) -> Column:
    """Key of an element: by shape id, or by index where there is no id."""
    shape = F.coalesce(col(shape_id), col(shape_idx)).cast("string")
    label = F.when(col(shape_id).isNotNull(), "_shapeid_").otherwise("_shape_")
    slide = col(slide).cast("string")
    made_up = F.left(F.concat(slide, shape, F.lit("img")), F.lit(8))
    hashed = F.coalesce(F.left(F.nullif(col(image_hash), F.lit("")), F.lit(8)), made_up)
    return F.concat(F.lit("slide_"), slide, label, shape, F.lit("_hash_"), hashed)


def nested_key(key: ColumnLike, child: ColumnLike) -> Column:
    """Key of a shape inside a group: the child number joins the shape part."""
    return F.concat(
        F.regexp_extract(col(key), r"^slide_\d+_shape(?:id)?_\d+(?:_\d+)*", 0), F.lit("_"), col(child).cast("string"),
        F.regexp_extract(col(key), r"_hash_.*$", 0),
    )


def parse_key(c: ColumnLike) -> Column:
    """Strict parts of a key; null where the key is not one."""
    key = col(c)
    parts = F.struct(
        F.regexp_extract(key, KEY_PATTERN, 1).cast("int").alias("slide_idx"),
        F.regexp_extract(key, KEY_PATTERN, 2).cast("bigint").alias("shape_idx"),
    )
    return F.when(key.rlike(KEY_PATTERN), parts)


def parse_key_loose(c: ColumnLike) -> Column:
    """Tolerant parts of a key: nested shape numbers, name and hash."""
    key = col(c)
    shape = r"^slide[^_]*_(\d+)_shape[^_]*_([^_]*(?:_\d+)*)"
    parts = F.struct(
        F.regexp_extract(key, shape, 1).cast("int").alias("slide_idx"),
        F.regexp_extract(key, shape, 2).alias("shape_idx"),
        F.regexp_extract(key, r"_name_([^_]+)", 1).alias("name"),
        F.regexp_extract(key, r"_hash_([^_]+)", 1).alias("hash"),
    )
    return F.when(key.rlike(shape), parts)


def nested_shape(*path: ColumnLike) -> Column:
    return F.concat_ws("_", *[col(p).cast("string") for p in path])
