"""Near copies at a five-word similarity of about 0.8, from SimHash sketches in vantage-point trees.

The fingerprint of ``simhash`` with 64 bits of four-word shingles and 4 bits of
distance is a narrow test: two texts with a similarity of 0.8 differ in about
10 of 64 bits. Here a document has two sketches made in the same way, a bit
being the majority over the hashes of its features:

* 192 bits over its distinct words, by which candidates are searched. A word
  that is changed changes five shingles but one word, so near copies differ in
  about one bit of 15. The bits are six runs of 32, each with a vantage-point
  tree that is searched with a radius of one bit: a pair is a candidate if it
  is so close in any run. The trees are those of ``simhash``.
* 256 bits over its distinct five-word shingles, by which a candidate is
  judged where it is met. For a similarity of 0.8 the cosine is 0.89, which is
  39 differing bits on average, with a deviation of 6. ``MOST`` (48) accepts 19
  of 20 pairs of that similarity, about 2 of 5 of 0.7 and none of 0.5.

Equal pairs of sketches are folded first, and a shard returns a spanning
forest of its links, so that groups of many copies give few. Of each group the
document with the smallest id stays.

Nulls and texts without words have empty sketches and are copies of one
another. Texts with fewer than five words are one shingle. Ids may be missing
or shared, so a document is its id and its text's digest; a missing id is
larger than any other, and of texts with one id the smallest digest stays.
Repeated rows are one document. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altloom.llm.base import picked, slices, whole
from altloom.llm.components import components
from altloom.llm.simhash import LEAF, SAMPLE, SHARD, fitted, routed, split
from altloom.session import materialize

WORDS = 5
MOST = 48
RUNS = 6
RUN_BITS = 32
SKETCH = 4
COLUMNS = [*(f"run{k}" for k in range(RUNS)), *(f"sketch{k}" for k in range(SKETCH))]
MASK = (1 << RUN_BITS) - 1


def majority(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` numbers of 64 bits, each bit set if it is in over half of as many further hashes of each hash."""
    seeds = np.array([(j + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for j in range(n)], np.uint64)[:, None]
    ones = np.zeros((n, 64), np.int64)
    for k in range(0, len(hashes), 1 << 14):
        mix = (hashes[None, k : k + (1 << 14)] + seeds) * np.uint64(0xBF58476D1CE4E5B9)
        mix = (mix ^ (mix >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        ones += bit_counts(mix ^ (mix >> np.uint64(29)))
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def bit_counts(words: np.ndarray) -> np.ndarray:
    """Per row how often each of 64 bits is set.

    Long rows are halved and the halves added as binary numbers whose digits
    are words, which takes few operations a word but many calls.
    """
    if words.shape[1] < 1500:
        bits = np.unpackbits(words.view(np.uint8).reshape(*words.shape, 8), axis=2, bitorder="little")
        return sum(bits[:, k : k + 255].sum(axis=1, dtype=np.uint8).astype(np.int64) for k in range(0, words.shape[1], 255))
    n = 1 << (words.shape[1] - 1).bit_length()
    planes = [np.concatenate([words, np.zeros((len(words), n - words.shape[1]), np.uint64)], axis=1)]
    while planes[0].shape[1] > 1:
        half, carry, added = planes[0].shape[1] // 2, None, []
        for plane in planes:
            a, b = plane[:, :half], plane[:, half:]
            x, both = a ^ b, a & b
            added.append(x if carry is None else x ^ carry)
            carry = both if carry is None else both | (x & carry)
        planes = [*added, carry]
    digits = [np.unpackbits(np.ascontiguousarray(p).view(np.uint8), axis=1, bitorder="little").astype(np.int64) << k for k, p in enumerate(planes)]
    return sum(digits)


def sketch(text: str | None, words: int = WORDS) -> np.ndarray:
    """The runs of the word sketch and the numbers of the shingle sketch, as in COLUMNS."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    out = np.zeros(RUNS + SKETCH, np.uint64)
    if not raw:
        return out
    digest, line = xxhash.xxh64_intdigest, b" ".join(raw)
    distinct = np.array([digest(w, 1) for w in set(raw)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[words - 1 :] if len(raw) >= words else ends[-1:]
    shingles = np.unique(np.array([digest(line[a:b], 2) for a, b in zip(starts.tolist(), last.tolist(), strict=False)], np.uint64))
    wide = majority(distinct, RUNS // 2)
    out[0:RUNS:2], out[1:RUNS:2] = wide & np.uint64(MASK), wide >> np.uint64(RUN_BITS)
    out[RUNS:] = majority(shingles, SKETCH)
    return out


def sketches(docs: DataFrame, names: list[str], words: int = WORDS) -> DataFrame:
    """The named columns and the sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                found = np.stack([sketch(t, words) for t in rows.column("text").to_pylist()]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], *[pa.array(found[:, k]) for k in range(found.shape[1])]], [*names, *COLUMNS])

    kinds = [f"{n} {docs.schema[n].dataType.simpleString()}" for n in names] + [f"{c} bigint" for c in COLUMNS]
    return docs.select(*names, "text").mapInArrow(run, ", ".join(kinds))


def linked(run: np.ndarray, sketched: np.ndarray, most: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links, by place, that join all of a shard's points which are joined by pairs that are judged near."""
    rng, left, right = random.Random(seed), [], []
    stack = [np.arange(len(run))]
    while stack:
        own = stack.pop()
        if len(own) < 2:
            continue
        cut = split(run[own], MASK, rng) if len(own) > LEAF else None
        if cut is not None:
            away = np.bitwise_count(run[own] ^ np.uint64(cut[0])).astype(np.int64)
            near, far = own[away <= cut[1]], own[away + 1 > cut[1]]
            if max(len(near), len(far)) <= 0.9 * len(own):
                stack += [near, far]
                continue
        forest(own, run, sketched, most, left, right)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(own: np.ndarray, run: np.ndarray, sketched: np.ndarray, most: int, left: list, right: list) -> None:
    """A spanning forest by direct comparison: each point leaves the open set when it is reached.

    In a small set with few links all of them are taken at once.
    """
    if len(own) <= 2 * LEAF:
        i, j = np.nonzero(np.triu(np.bitwise_count(run[own][:, None] ^ run[own][None, :]) <= 1, 1))
        if len(i) <= 8 * len(own):
            good = np.bitwise_count(sketched[own[i]] ^ sketched[own[j]]).sum(axis=1) <= most
            left.append(own[i[good]])
            right.append(own[j[good]])
            return
    waiting = own
    while len(waiting) > 1:
        front, waiting = [waiting[:1]], waiting[1:]
        while front and len(waiting):
            block = front.pop()
            if len(block) > 64:
                front.append(block[64:])
                block = block[:64]
            i, j = np.nonzero(np.bitwise_count(run[block][:, None] ^ run[waiting][None, :]) <= 1)
            good = np.bitwise_count(sketched[block[i]] ^ sketched[waiting[j]]).sum(axis=1) <= most
            reached, first = np.unique(j[good], return_index=True)
            if len(reached):
                left.append(block[i[good][first]])
                right.append(waiting[reached])
                front.append(waiting[reached])
                waiting = np.delete(waiting, reached)


def links(distinct: DataFrame, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """``distinct(node, *COLUMNS)`` to links (a, b) between nodes that are near."""
    total = distinct.count()
    share = min(1.0, 1.5 * SAMPLE / max(total, 1))
    # A bounded sample decides only how even the shards are.
    near = distinct.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = near.orderBy(F.xxhash64("node")).limit(SAMPLE).select(*COLUMNS[:RUNS]).toArrow()
    trees = [fitted(sample.column(k).to_numpy().view(np.uint64), MASK, shard / max(total, 1)) for k in range(RUNS)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, tree in enumerate(trees):
                points = batch.column(f"run{number}").to_numpy().view(np.uint64)
                places, shards = routed(tree, points, MASK, 1)
                rows = [batch.column(n).take(pa.array(places)) for n in ["node", f"run{number}", *COLUMNS[RUNS:]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), number, np.int32)), pa.array(shards), *rows], ["tree", "shard", "node", "run", *COLUMNS[RUNS:]]
                )

    kinds = ", ".join(f"{c} bigint" for c in ["run", *COLUMNS[RUNS:]])
    shards = materialize(distinct.mapInArrow(route, f"tree int, shard int, node binary, {kinds}"))
    sizes = shards.groupBy("tree", "shard").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(2 * shard)).cast("int")
    table = sizes.filter(F.col("n") > 2 * shard).select(F.col("tree").alias("t"), F.col("shard").alias("s"), blocks.alias("blocks"))
    # As many rows as the trees have shards, which the sample bounds.
    met = shards.join(F.broadcast(table), (F.col("tree") == F.col("t")) & (F.col("shard") == F.col("s")), "left")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    keyed = dealt.select("tree", "shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "run", *COLUMNS[RUNS:])

    def search(rows: pa.Table) -> pa.Table:
        run = rows.column("run").to_numpy().view(np.uint64)
        sketched = np.stack([rows.column(c).to_numpy().view(np.uint64) for c in COLUMNS[RUNS:]], axis=1)
        a, b = linked(run, sketched, most)
        nodes = rows.column("node").combine_chunks()
        return pa.table({"a": nodes.take(pa.array(a)), "b": nodes.take(pa.array(b))})

    return keyed.groupBy("tree", "shard", "lo", "hi").applyInArrow(search, "a binary, b binary")


def without_near_copies(docs: DataFrame, words: int = WORDS, most: int = MOST) -> DataFrame:
    """One document of each group of near copies, with the columns of ``docs``."""
    named = docs.withColumn("__sha", F.unhex(F.sha2(whole("text"), 256)))
    rows = materialize(sketches(named, ["doc_id", "__sha"], words))
    least = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "__sha")
    node = F.unhex(F.md5(F.concat_ws(",", *COLUMNS)))
    distinct = materialize(rows.groupBy(*COLUMNS).agg(F.min(least).alias("least")).withColumn("node", node))
    found = components(materialize(links(distinct.select("node", *COLUMNS), most)))
    roots = distinct.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    stays = roots.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    return picked(named, stays.select("least.doc_id", "least.__sha"), ["doc_id", "__sha"]).select(*docs.columns)
