"""Reuse of texts across elements with the same content.

A content key may be shared by a large part of all elements (a logo), so keys
are reduced with map-side aggregates before anything is joined, and a row is
marked by its own unique key. Where the reduced side is joined back on the
content key it has one row per key, which is the case adaptive execution splits
when one key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altloom.functions.base import is_blank, strip
from altloom.functions.text import collapse_repeats, semantic_score, stem


# What names an element over all decks: shape ids are unique only inside a slide.
OWNER = ["deck", "slide_idx", "shape_id"]


def reduce_cache(cache: DataFrame, key: str, order: Sequence[str], owner: Sequence[str]) -> DataFrame:
    """First and last owner for every key."""
    entry = F.struct(*dict.fromkeys([*order, *owner]))
    return cache.groupBy(key).agg(F.max(entry).alias("__last"), F.min(entry).alias("__first"))


def with_cache(
    df: DataFrame, cache: DataFrame, key: str, text: str, owner: Sequence[str] = OWNER, order: Sequence[str] = (),
    name: str = "cached_alt",
) -> DataFrame:
    """Add the latest text another element with the same key has, or null.

    Only owners are reduced and met by key; each chosen owner's one text is
    fetched afterwards, and the result goes back by the element's own key.
    """
    filled = cache.filter(~is_blank(text) & F.col(key).isNotNull())

    def named(entry: str):
        return F.struct(*[F.col(f"{entry}.{c}").alias(c) for c in owner])

    own, last, first = F.struct(*owner), named("__last"), named("__first")
    other = F.when(last != own, last).when(first != own, first)
    chosen = (
        df.select(key, *owner).join(reduce_cache(filled, key, order, owner), key)
        .select(*owner, other.alias("__from")).filter("__from IS NOT NULL")
    )
    texts = filled.select(F.struct(*owner).alias("__from"), F.col(text).alias(name))
    return df.join(chosen.join(texts, "__from").drop("__from"), list(owner), "left")


def elect_generators(
    df: DataFrame, key: str, order: Sequence[str], owner: Sequence[str] = OWNER, name: str = "generates"
) -> DataFrame:
    """Mark the first element of every key; the others reuse its text."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*owner), F.struct(*order)).alias("__first"))
    elected = first.select("__first.*", F.lit(True).alias(name))
    return df.join(elected, list(owner), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins: the latest row of every key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def best_candidate(df: DataFrame, keys: Sequence[str], score: str, seq: str) -> DataFrame:
    """A later candidate wins only with a strictly higher score."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(seq))).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def repeats(df: DataFrame, key: str, slide: Sequence[str]) -> DataFrame:
    """Occurrences and distinct slides of every content key."""
    per_slide = df.groupBy(key, *slide).agg(F.count(F.lit(1)).alias("__n"))
    return per_slide.groupBy(key).agg(F.sum("__n").alias("occurrences"), F.count(F.lit(1)).alias("slides"))


def best_text_per_key(df: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """The best scored of the texts of every key, repeats by stem left out.

    As ``best_text`` on an array, without gathering a key's texts: stems are
    folded first, then the best of the folded texts is taken.
    """
    given = df.select(key, seq, strip(text).alias("__t")).filter("__t <> ''").withColumn("__stem", stem("__t"))
    folded = given.groupBy(key, "__stem").agg(
        F.min_by("__t", seq).alias("__t"), F.min(seq).alias("__seq"), F.count(F.lit(1)).alias("__n")
    )
    scored = folded.withColumn("__score", F.when(F.col("__stem") != "", semantic_score("__t")))
    rank = F.when(F.col("__score").isNotNull(), F.struct(F.col("__score"), -F.col("__seq")))
    best = scored.groupBy(key).agg(
        F.max_by("__t", rank).alias("__best"), F.min("__t").alias("__only"), F.sum("__n").alias("__n")
    )
    chosen = F.when(F.col("__n") == 1, F.col("__only")).otherwise(F.coalesce("__best", F.lit("")))
    return best.select(key, collapse_repeats(chosen).alias("alt"))
