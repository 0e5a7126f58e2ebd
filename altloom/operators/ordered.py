"""Order: caps, numbers, streaks, running values, samples and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altloom.functions.base import is_blank
from altloom.functions.review import backoff
from altloom.operators.prefix import PIECE, cut_pieces, numbered, running_over

MONEY = "decimal(20,6)"


# A key names an element inside its deck only.
KEY = ["deck", "key"]


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, name: str = "n") -> DataFrame:
    """First n rows of every group; Spark drops the rest before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def cap_per_slide(df: DataFrame, eligible: Column, n: int = 5) -> DataFrame:
    """First n eligible shapes of every slide, in shape order."""
    return top_per(df.filter(eligible), ["deck", "slide_idx"], ["shape_idx"], n, "slot")


def image_number(df: DataFrame) -> DataFrame:
    """Running number of every element of a deck, in discovery order."""
    return numbered(df, ["deck"], ["slide_idx", "shape_idx"], "image_number")


def streaks(attempts: DataFrame) -> DataFrame:
    """Failures in a row at every attempt; zero after a success.

    Inside a piece: failures so far less failures at the latest success. Before
    the first success of a piece the tail of the earlier pieces is added, back
    to the last one with a success.
    """
    keys, order = ["provider"], ["ts", "attempt_id"]
    local = Window.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    failed = (
        cut_pieces(attempts, keys, order)
        .withColumn("__failed", F.sum((~F.col("success")).cast("bigint")).over(local))
        .withColumn("__base", F.max(F.when(F.col("success"), F.col("__failed"))).over(local))
        .withColumn("streak", F.col("__failed") - F.coalesce("__base", F.lit(0)))
    )
    pieces = failed.groupBy(*keys, PIECE).agg(
        F.max_by("streak", F.struct(*order)).alias("tail"), F.bool_or("success").alias("broke")
    )
    along = Window.partitionBy(*keys).orderBy(PIECE)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    summed = pieces.withColumn("so_far", F.sum("tail").over(along))
    cut_at = F.max(F.when(F.col("broke"), F.col("so_far") - F.col("tail"))).over(earlier)
    into = F.lag("so_far").over(along) - F.coalesce(cut_at, F.lit(0))
    carry = summed.withColumn("__into", into).filter("__into > 0").select(
        F.col("provider").alias("__provider"), F.col(PIECE).alias("__at"), "__into"
    )
    same = F.col("provider").eqNullSafe(F.col("__provider")) & (F.col(PIECE) == F.col("__at"))
    joined = failed.join(F.broadcast(carry), same, "left")
    whole = F.col("streak") + F.when(F.col("__base").isNull(), F.coalesce("__into", F.lit(0))).otherwise(0)
    return joined.withColumn("streak", whole).select(*attempts.columns, "streak")


def next_retry(attempts: DataFrame) -> DataFrame:
    """When a provider may be called again after each failure."""
    return streaks(attempts).filter(~F.col("success")).withColumn(
        "retry_at", F.timestamp_add("SECOND", backoff("streak"), "ts")
    )


def running_usage(attempts: DataFrame) -> DataFrame:
    """Mean response time and cost up to every attempt of a provider."""
    cut = cut_pieces(attempts, ["provider"], ["ts", "attempt_id"])
    done = running_over(
        cut, ["provider"], ["ts", "attempt_id"],
        {
            "requests": ("sum", F.lit(1).cast("bigint")),
            "__seconds": ("sum", F.col("seconds").cast(MONEY)),
            "__cost": ("sum", F.col("cost").cast(MONEY)),
        },
    )
    return done.withColumns(
        {
            "mean_seconds": F.round(F.col("__seconds").cast("double") / F.col("requests"), 6),
            "total_cost": F.round(F.col("__cost").cast("double"), 6),
        }
    ).drop("__seconds", "__cost", PIECE)


def breaker_openings(attempts: DataFrame, threshold: int = 5, pause: int = 600) -> DataFrame:
    """Attempts at which a streak reaches the threshold, and the end of the pause."""
    return streaks(attempts).filter(F.col("streak") == threshold).select(
        "provider", "attempt_id", F.col("ts").alias("opened_at"),
        F.timestamp_add("SECOND", F.lit(pause), "ts").alias("closed_until"),
    )


def first_child_alt(children: DataFrame) -> DataFrame:
    """First non-blank text among the children of a group."""
    return children.filter(~is_blank("existing_alt")).groupBy("deck", "slide_idx", "parent_id").agg(
        F.min_by("existing_alt", "shape_idx").alias("child_alt")
    )


def repeat_share(df: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Elements, distinct contents and the share of repeats per group."""
    distinct = df.groupBy(*keys, content).agg(F.count(F.lit(1)).alias("__n"))
    counts = distinct.groupBy(*keys).agg(F.sum("__n").alias("elements"), F.count(F.lit(1)).alias("contents"))
    return counts.withColumn("repeat_share", F.round(1 - F.col("contents") / F.col("elements"), 6))


# --- order and samples ------------------------------------------------------------


def review_order(df: DataFrame) -> DataFrame:
    """Position of every element in the review: deck, slide, image."""
    return numbered(df, [], ["deck", "slide_idx", "shape_idx"], "position")


def sample_errors(df: DataFrame, order: Sequence[str | Column], n: int = 10) -> DataFrame:
    """First n rows in order; Spark keeps n per task and merges."""
    return df.orderBy(*order).limit(n)


def oldest_first(df: DataFrame, at: str, tie: str) -> DataFrame:
    return numbered(df, [], [at, tie], "position")


def stable_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows numbered by their keys as text, the deck first."""
    return numbered(df, [], keys, "position")


def priority(decision: Column, escalation: Column, overlay: Column) -> Column:
    """1 high, 2 medium, 3 low."""
    return (
        F.when((decision == "escalate_manual_review") | (escalation == "defer_to_manual_review") | overlay, 1)
        .when(escalation == "include_with_ambiguous_reason", 2)
        .otherwise(3)
    )


def by_priority(df: DataFrame, level: Column, ties: Sequence[str]) -> DataFrame:
    return numbered(df.withColumn("priority", level), [], ["priority", *ties], "position")


def next_items(ledger: DataFrame, n: int = 1, status: str = "pending") -> DataFrame:
    """First-in items of one status."""
    return ledger.filter(F.col("status") == status).orderBy("added_at", "path").limit(n)


# --- sets -----------------------------------------------------------------------


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def backfill(texts: DataFrame, elements: DataFrame, description: Column) -> DataFrame:
    """Stored texts plus descriptions of elements that have none."""
    bare = elements.filter(~F.col("shape_type").isin("PLACEHOLDER", "TEXT_BOX")).join(texts, KEY, "left_anti")
    made = bare.select(*KEY, description.alias("text"), F.lit("geometric_backfill").alias("source"))
    return texts.unionByName(made.filter("text <> ''"))


def enqueue(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Ledger plus pending items for files it does not know."""
    new = files.dropDuplicates(["path"]).join(ledger, "path", "left_anti")
    return ledger.select("path", "status").unionByName(new.select("path", F.lit("pending").alias("status")))


def rules_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()
