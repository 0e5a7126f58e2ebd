"""SimHash near-duplicates found with vantage-point trees.

A text's fingerprint has 64 bits; each is the majority of that bit over the
hashes of its word shingles. Two fingerprints are linked at ``RADIUS`` or
fewer differing bits, and linked groups are what counts, not the pairs.

Equal fingerprints are folded first. Over the distinct ones there is a forest
of vantage-point trees. The 64 bits are cut into three runs, and each run has
a tree with the Hamming distance over that run as its metric. Of two
fingerprints within 4 bits, one run differs by so little (1, 1 and 0 bits) that
its tree must bring them together, so each tree is searched with that radius
only; over the whole 64 bits nearly every ball would cross every boundary.
A node holds a vantage point and a distance: what is nearer goes left, what is
farther goes right. By the triangle inequality a neighbour of a point whose
distance is at least the radius short of the boundary lies on the same side:
that branch is pruned. A point nearer to the boundary is also sent to the
other side, so the shards that a query ball overlaps all hold it and every
pair meets in a leaf.

The upper nodes are fitted to a bounded sample of fingerprints (``SAMPLE``)
and only decide how even the shards are; every fingerprint is routed. A shard
with more than twice ``SHARD`` fingerprints is dealt as pairs of blocks, each
pair a task of its own. Within a shard the tree goes on in memory, down to
leaves that are compared over all 64 bits. A shard returns a spanning forest
of its links, never all pairs, so a large group of near copies gives as many
links as it has members.

Nulls and texts without words have the fingerprint zero, which is linked like
any other. Null ids keep their fingerprint and never name a group unless all
its ids are null. Repeated rows and equal texts share a fingerprint. An empty
table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altloom.llm.base import picked, read, slices, whole
from altloom.llm.components import components
from altloom.session import materialize

WORDS = 4
RADIUS = 4
RUNS = 3
SAMPLE = 1 << 14
SHARD = 1 << 14
LEAF = 256


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not raw:
        return 0
    line = b" ".join(raw)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[words - 1 :] if len(raw) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts.tolist(), last.tolist(), strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        block = hashes[k : k + (1 << 14)]
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, names: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns and fp, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                found = np.array([fingerprint(t, words) for t in rows.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], pa.array(found.view(np.int64))], [*names, "fp"])

    kinds = "".join(f"{n} {docs.schema[n].dataType.simpleString()}, " for n in names)
    return docs.select(*names, "text").mapInArrow(run, f"{kinds}fp bigint")


def metrics(radius: int, runs: int = RUNS) -> list[tuple[int, int]]:
    """(mask, radius) of each tree: radii are shared out so that a pair within the whole radius is within one of them."""
    runs = min(runs, radius + 1)
    cuts = [64 * k // runs for k in range(runs + 1)]
    shares = [(radius + 1) // runs + (k < (radius + 1) % runs) - 1 for k in range(runs)]
    return [(((1 << (b - a)) - 1) << a, share) for a, b, share in zip(cuts[:-1], cuts[1:], shares, strict=True)]


def split(points: np.ndarray, mask: int, rng: random.Random) -> tuple[int, int] | None:
    """A vantage point and the median distance from it; None where nothing lies beyond."""
    for _ in range(3):
        vantage = int(points[rng.randrange(len(points))])
        far = np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask))
        middle = int(np.median(far))
        if middle == far.max():
            middle -= 1
        if middle >= far.min() and middle >= 0:
            return vantage, middle
    return None


def fitted(sample: np.ndarray, mask: int, shard_share: float, seed: int = 0) -> list:
    """Upper nodes over a sample: [vantage, distance, near, far], or a shard's number."""
    rng, count = random.Random(seed), [0]

    def grow(points: np.ndarray) -> list | int:
        cut = split(points, mask, rng) if len(points) > max(16, shard_share * len(sample)) else None
        if cut is None:
            count[0] += 1
            return count[0] - 1
        far = np.bitwise_count((points ^ np.uint64(cut[0])) & np.uint64(mask)) > cut[1]
        return [*cut, grow(points[~far]), grow(points[far])]

    return grow(sample)


def routed(tree: list | int, points: np.ndarray, mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the point, shard) for every shard that a point's ball may share with a neighbour."""
    places, shards = [], []
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, members = stack.pop()
        if not isinstance(node, list):
            places.append(members)
            shards.append(np.full(len(members), node, np.int32))
            continue
        vantage, middle, near, far = node
        away = np.bitwise_count((points[members] ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)
        stack.append((near, members[away <= middle]))
        stack.append((far, members[away + radius > middle]))
    return np.concatenate(places), np.concatenate(shards)


def linked(points: np.ndarray, radius: int, mask: int, mask_radius: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of a shard's points which are joined by pairs within the radius."""
    rng, left, right = random.Random(seed), [], []
    stack = [points]
    while stack:
        own = stack.pop()
        if len(own) < 2:
            continue
        cut = split(own, mask, rng) if len(own) > LEAF else None
        if cut is not None:
            away = np.bitwise_count((own ^ np.uint64(cut[0])) & np.uint64(mask)).astype(np.int64)
            near, far = own[away <= cut[1]], own[away + mask_radius > cut[1]]
            if max(len(near), len(far)) <= 0.9 * len(own):
                stack += [near, far]
                continue
        a, b = forest(own, radius)
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.uint64)
    return starred(np.concatenate([none, *left]), np.concatenate([none, *right]))


def starred(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link per point: to the smallest point of its component."""
    nodes, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in zip(index[: len(left)].tolist(), index[len(left) :].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        parent[max(a, b)] = min(a, b)
    for k, above in enumerate(parent):
        parent[k] = parent[above]  # those above come first and are settled
    root = np.array(parent, np.int64)
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest by direct comparison: each point leaves the open set when it is reached."""
    left, right = [], []
    if len(points) <= 2 * LEAF:
        i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= radius, 1))
        if len(i) <= 8 * len(points):
            return points[i], points[j]
    waiting = points
    while len(waiting) > 1:
        front, waiting = [waiting[:1]], waiting[1:]
        while front and len(waiting):
            block = front.pop()
            if len(block) > 64:
                front.append(block[64:])
                block = block[:64]
            near = np.bitwise_count(block[:, None] ^ waiting[None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                reached = waiting[hit]
                left.append(block[near[:, hit].argmax(axis=0)])
                right.append(reached)
                front.append(reached)
                waiting = waiting[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``distinct(fp)`` to links (a, b) that join what lies within the radius."""
    spark, total = distinct.sparkSession, distinct.count()
    share = min(1.0, SAMPLE / max(total, 1))
    # A bounded sample: the rows with the smallest hashes, SAMPLE at most.
    near = distinct.select("fp").filter(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 30)) <= int(min(1.0, 1.5 * share) * (1 << 30)))
    sample = np.array([r[0] for r in near.orderBy(F.xxhash64("fp", F.lit(7))).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    trees = [(fitted(sample, mask, shard / max(total, 1)), mask, r) for mask, r in metrics(radius)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            for number, (tree, mask, r) in enumerate(trees):
                places, shards = routed(tree, points, mask, r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), number, np.int32)), pa.array(shards), pa.array(points[places].view(np.int64))],
                    ["tree", "shard", "fp"],
                )

    shards = materialize(distinct.select("fp").mapInArrow(route, "tree int, shard int, fp bigint"))
    sizes = shards.groupBy("tree", "shard").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(2 * shard)).cast("int")
    table = sizes.filter(F.col("n") > 2 * shard).select(F.col("tree").alias("t"), F.col("shard").alias("s"), blocks.alias("blocks"))
    # As many rows as the upper trees have shards, which the sample bounds.
    met = shards.join(F.broadcast(table), (F.col("tree") == F.col("t")) & (F.col("shard") == F.col("s")), "left")
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    keyed = dealt.select("tree", "shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")

    def search(rows: pa.Table) -> pa.Table:
        points = np.unique(rows.column("fp").to_numpy().view(np.uint64))
        _, mask, r = trees[rows.column("tree")[0].as_py()]
        a, b = linked(points, radius, mask, r)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return keyed.groupBy("tree", "shard", "lo", "hi").applyInArrow(search, "a bigint, b bigint")


def rooted(rows: DataFrame, least: Column, radius: int) -> DataFrame:
    """Of rows with ``fp``, each distinct fingerprint with its ``least`` and the root of its group."""
    distinct = materialize(rows.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n")))
    found = components(links(distinct, radius))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component_id for every row."""
    rows = materialize(fingerprints(docs, words))
    roots = rooted(rows, F.col("doc_id"), radius)
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = roots.join(named.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("fp").alias("of"), "component_id")
    return rows.join(classes, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_copies(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each group, that with the smallest id, with the columns of ``docs``.

    Ids may be missing or shared, so a document is its id and its text's
    digest; a missing id is larger than any other, and of texts with one id
    the smallest digest stays.
    """
    named = docs.withColumn("__sha", F.unhex(F.sha2(whole("text"), 256)))
    rows = materialize(fingerprints(named, words, ("doc_id", "__sha")))
    least = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "__sha")
    stays = rooted(rows, least, radius).groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.__sha")
    return picked(named, stays, ["doc_id", "__sha"]).select(*docs.columns)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents", "doc_id", "text"))
