"""Running values over an ordered group without gathering it in one task.

A plain window sends a whole group to one task. Here the rows are range
partitioned by (keys, order), so that a group larger than a partition is spread
over neighbours; each piece is scanned on its own and the totals of the earlier
pieces of the same group are added. One partition continues at most one group
of the partition before it, so there are at most as many carried rows as
partitions: that bound is what makes the broadcast safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altloom.session import materialize

PIECE = "__piece"


def cut_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range partition by (keys, order) and write each row with its piece.

    The pieces are written out because a second evaluation could draw other
    boundaries. Their number is left to Spark, which joins neighbouring ranges
    of small data.
    """
    cut = df.repartitionByRange(*keys, *order)
    return materialize(cut.withColumn(PIECE, F.spark_partition_id()))


def running_over(
    cut: DataFrame, keys: Sequence[str], order: Sequence[str], measures: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Add running columns, from the start of the group to the current row.

    ``measures`` maps a new column to (kind, expression); kinds are ``sum``,
    ``max`` and ``last`` (latest non-null). ``order`` must be unique in a group.
    """
    inputs = {name: f"__in_{name}" for name in measures}
    fed = cut.withColumns({inputs[name]: value for name, (_, value) in measures.items()})
    local = Window.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)

    running, totals, carries, merged = {}, [], {}, {}
    for name, (kind, _) in measures.items():
        value, carried, total = F.col(inputs[name]), F.col(f"__carry_{name}"), f"__total_{name}"
        if kind == "sum":
            running[name] = F.sum(value).over(local)
            totals.append(F.sum(value).alias(total))
            carries[f"__carry_{name}"] = F.sum(total).over(earlier)
            merged[name] = F.coalesce(F.col(name) + carried, F.col(name), carried)
        elif kind == "max":
            running[name] = F.max(value).over(local)
            totals.append(F.max(value).alias(total))
            carries[f"__carry_{name}"] = F.max(total).over(earlier)
            merged[name] = F.greatest(F.col(name), carried)
        elif kind == "last":
            running[name] = F.last(value, ignorenulls=True).over(local)
            totals.append(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias(total))
            carries[f"__carry_{name}"] = F.last(total, ignorenulls=True).over(earlier)
            merged[name] = F.coalesce(F.col(name), carried)
        else:
            raise ValueError(f"unknown kind {kind}")

    per_piece = fed.groupBy(*keys, PIECE).agg(*totals, F.lit(1).alias("__seen"))
    carry = (
        per_piece.withColumns({**carries, "__before": F.count("__seen").over(earlier)})
        .filter("__before > 0")
        .select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col(PIECE).alias("__key_piece"), *carries)
    )
    matches = F.col(PIECE) == F.col("__key_piece")
    for key in keys:
        matches = matches & F.col(key).eqNullSafe(F.col(f"__key_{key}"))
    return (
        fed.withColumns(running)
        .join(F.broadcast(carry), matches, "left")
        .withColumns(merged)
        .select(*cut.columns, *measures)
    )


def with_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: dict[str, tuple[str, Column]]
) -> DataFrame:
    return running_over(cut_pieces(df, keys, order), keys, order, measures).drop(PIECE)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``row_number`` over groups of any size, also with no key at all."""
    return with_running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))})
