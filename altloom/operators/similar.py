"""Near-identical pictures: for each the best earlier match and its number of links, and the groups these make.

A multi-index over few long bands: 64 bits and a distance of 5 take two bands
of 32 bits. Of two hashes within ``k`` bits, one band differs by two bits at
most, so a hash stands under the values of each of its bands and under those
with one bit flipped, and the two meet under a value between them: 66 keys of
32 bits a hash. Equal hashes are folded into one row with a count first. A
pair may meet under several values; it counts under one of them, which both
hashes tell alike. The hashes of a key that very many share (plain or dark
pictures) are dealt over as many salts as their count asks for.

Groups are built from spanning links: the few hashes of a light key give all
their links, those of any other key a spanning forest of them, which joins the
same hashes with a link per hash at most. Only keys with more than ``light``
hashes are worked through in Python.

Stored hashes and labels are small in bytes and many in rows, so a planner that
goes by bytes would send them whole to the driver and read them in one task:
joins are sort-merge joins by hint, and hashes are dealt out before they
multiply.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altloom.session import materialize
from altloom.functions.phash import distance


# Hashes that one task multiplies into keys.
DEALT = 8192


def bands_for(k: int) -> int:
    """So many bands that one of them holds two differing bits at most."""
    return k // 3 + 1


def band(value: Column, n: int, bands: int, bits: int) -> Column:
    low, high = n * bits // bands, (n + 1) * bits // bands
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("bigint"))


def folded_and_keyed(df: DataFrame, id_col: str, hash_col: str, k: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Distinct hashes with first id and copies, and a row of them for every band value that they stand under."""
    bands = bands_for(k)
    folded = materialize(
        df.filter(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("hash")).agg(
            F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies")
        )
    )

    def values(n: int) -> Column:
        own, width = band(F.col("hash"), n, bands, bits), (n + 1) * bits // bands - n * bits // bands
        flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << b).cast("bigint") for b in range(width)])
        return F.transform(flips, lambda flip: F.struct(F.lit(n).alias("band"), own.bitwiseXOR(flip).alias("value")))

    keys = F.flatten(F.array(*[values(n) for n in range(bands)]))
    dealt = folded.repartition(folded.count() // DEALT + 1, "hash")
    return folded, dealt.select("hash", "first_id", F.explode(keys).alias("key"))


def meets_here(k: int, bits: int) -> Column:
    """Whether ``key`` is the one under which the pair of hash_a and hash_b counts: in the first band that they share values of, the least."""
    bands, found = bands_for(k), None
    for n in reversed(range(bands)):
        a, b = band(F.col("hash_a"), n, bands, bits), band(F.col("hash_b"), n, bands, bits)
        x = a.bitwiseXOR(b)
        low = x.bitwiseAND(-x)
        differ = F.bit_count(x)
        least = F.when(differ == 0, a).when(differ == 1, F.least(a, b)).otherwise(F.least(a.bitwiseXOR(low), b.bitwiseXOR(low)))
        here = (F.col("key.band") == n) & (F.col("key.value") == least)
        found = here if found is None else F.when(differ <= 2, here).otherwise(found)
    return found


def best_matches(df: DataFrame, id_col: str, hash_col: str, k: int = 5, bits: int = 64, heavy: int = 10_000) -> DataFrame:
    """``first_id``, ``copies``, ``match_id``, ``distance`` and ``links`` of each distinct hash that resembles another.

    ``links`` counts the other distinct hashes within ``k`` bits. Of those that
    are earlier, by their first ids, the least distance wins, then the smallest
    id; where none is, ``match_id`` and ``distance`` are null.
    """
    folded, keyed = folded_and_keyed(df, id_col, hash_col, k, bits)
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = counted.select("key", F.ceil(F.col("n") / heavy).cast("int").alias("salts"))
    met = keyed.join(shared.hint("merge"), "key")
    ones = met.select("key", F.pmod(F.xxhash64("hash"), "salts").cast("int").alias("salt"), F.col("hash").alias("hash_a"), F.col("first_id").alias("id_a"))
    others = met.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hash").alias("hash_b"), F.col("first_id").alias("id_b"))
    near, earlier = distance("hash_a", "hash_b"), F.col("id_b") < F.col("id_a")
    best = (
        ones.join(others.hint("merge"), ["key", "salt"]).filter((F.col("id_b") != F.col("id_a")) & (near <= k) & meets_here(k, bits))
        .groupBy(F.col("id_a").alias("first_id")).agg(
            F.min(F.when(earlier, F.struct(near.alias("distance"), F.col("id_b").alias("match_id")))).alias("m"), F.count(F.lit(1)).alias("links")
        )
    )
    return best.join(folded.select("first_id", "copies").hint("merge"), "first_id").select(
        "first_id", "copies", "m.match_id", "m.distance", "links"
    )


def spanning_links(
    df: DataFrame, id_col: str, hash_col: str, k: int = 5, bits: int = 64, light: int = 16, block: int = 2048
) -> DataFrame:
    """``first_id`` and ``match_id`` of links which join all distinct hashes that chains of pairs within ``k`` bits join.

    A key with up to ``light`` hashes gives all its links; one with more a
    spanning forest. The hashes of a key with more than twice ``block`` are
    dealt as pairs of blocks, so that every pair of them still meets.
    """
    _, keyed = folded_and_keyed(df, id_col, hash_col, k, bits)
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialize(keyed.join(counted.hint("merge"), "key"))
    few = met.filter(F.col("n") <= light)
    a = few.select("key", F.col("hash").alias("hash_a"), F.col("first_id").alias("first_id"))
    b = few.select("key", F.col("hash").alias("hash_b"), F.col("first_id").alias("match_id"))
    near = (F.col("match_id") < F.col("first_id")) & (distance("hash_a", "hash_b") <= k)
    pairs = a.join(b.hint("merge"), "key").filter(near).select("first_id", "match_id")

    blocks = F.when(F.col("n") > 2 * block, F.ceil(F.col("n") / block)).otherwise(1).cast("int")
    many = met.filter(F.col("n") > light).withColumn("blocks", blocks)
    own = many.withColumn("own", F.pmod(F.xxhash64("hash"), "blocks").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shards = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "hash", "first_id")

    def joined(rows: pa.Table) -> pa.Table:
        later, earlier = forest(rows.column("hash").to_numpy().view(np.uint64), k)
        ids = rows.column("first_id")
        return pa.table({"first_id": ids.take(pa.array(later)), "match_id": ids.take(pa.array(earlier))})

    kind = keyed.schema["first_id"].dataType.simpleString()
    trees = shards.groupBy("key", "lo", "hi").applyInArrow(joined, f"first_id {kind}, match_id {kind}")
    return pairs.unionByName(trees).distinct()


def forest(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a spanning forest's links: each point leaves the open ones when it is reached."""
    found, reached_from = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    waiting = np.arange(len(points))
    while len(waiting) > 1:
        front, waiting = [waiting[:1]], waiting[1:]
        while front and len(waiting):
            part = front.pop()
            if len(part) > 64:
                front.append(part[64:])
                part = part[:64]
            near = np.bitwise_count(points[part][:, None] ^ points[waiting][None, :]) <= k
            hit = near.any(axis=0)
            if hit.any():
                found.append(waiting[hit])
                reached_from.append(part[near[:, hit].argmax(axis=0)])
                front.append(waiting[hit])
                waiting = waiting[~hit]
    return np.concatenate(found), np.concatenate(reached_from)


def similar_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Connected pairs as (node, group); the group is its smallest node.

    Every round takes the smallest label among neighbours and then the label of
    that label, which halves the distance left; each round is written out.
    """
    edges = materialize(
        pairs.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .unionByName(pairs.select(F.col(b).alias("node"), F.col(a).alias("other")))
        .distinct()
    )
    labels = materialize(edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("group")))
    while True:  # labels only fall, so this ends
        seen = labels.select(F.col("node").alias("other"), F.col("group").alias("near"))
        nearest = edges.join(seen.hint("merge"), "other").groupBy("node").agg(F.min("near").alias("near"))
        stepped = labels.join(nearest.hint("merge"), "node").select("node", "group", F.least("group", "near").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("group").alias("jumped"))
        moved = materialize(
            stepped.join(jump.hint("merge"), "step", "left").select(
                "node", F.least("step", F.coalesce("jumped", "step")).alias("group"), F.col("group").alias("__before")
            )
        )
        labels = moved.select("node", "group")
        if moved.filter("group <> __before").isEmpty():
            return labels
