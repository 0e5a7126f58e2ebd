"""Connected components of links that stay distributed.

Alternating star rounds: every number is linked to the smallest number in its
neighbourhood, first for its larger neighbours, then for its smaller ones.
The links of each round are written to the shared folder, so that the lineage
stays short and a lost executor costs one round. Only sums come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``, the root being the smallest node reachable."""
    now = materialize(stars(links, both=True).distinct())
    seen = None
    while True:
        now = materialize(stars(stars(now, both=True), both=False).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("root"))


def stars(links: DataFrame, both: bool) -> DataFrame:
    """One round. ``both``: larger neighbours move to the smallest; else the smaller ones and the node itself do."""
    a, b = F.col("a"), F.col("b")
    if both:
        around = links.filter(a != b).select(a, b).union(links.filter(a != b).select(b.alias("a"), a.alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(a.alias("of"), "m")
        return around.filter(b > a).join(least, a == F.col("of")).select(b.alias("a"), F.col("m").alias("b"))
    down = links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.select(a.alias("of"), "m"), a == F.col("of")).filter(b != F.col("m")).select("b", "m")
    return moved.select(b.alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
