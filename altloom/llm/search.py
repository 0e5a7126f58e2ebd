"""Ranked lexical search with range-maximum tables over posting lists.

The queries are a stated set of items, taken in blocks of about ``BLOCK``. A
first pass counts documents, terms and, for the terms of a block, the
documents that hold them. A second one builds posting lists for these terms
over runs of documents of bounded size, a list of (document, impact) per term
in ascending order of doc_id, with a sparse table of the places of its maxima.

An item starts with the interval of all documents of a run. The sum, over the
item's terms, of weight times the largest impact in an interval bounds the
score of every document in it. The intervals with the highest bounds are taken
first (``WIDTH`` of them in one array step); each is split at the document
that has the largest single part of its bound, whose score is then worked out
from all lists, and both remaining intervals get their own bounds. Intervals
whose bound cannot reach the best documents so far are dropped, and the search
ends when none is left, so the result is exact. What a task has found in
earlier runs of documents counts as found.

Every task returns each item's best documents; of those the best are chosen,
first in parts, then together.

Nulls: a null text has no terms; a null doc_id comes after all others among
equal scores. Repeated rows and repeated ids are documents each; repeated
items are ranked each. Items without terms give no row. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from altloom.llm.base import read, slices, whole
from altloom.llm.cuts import LOWER, cut, table

TOP = 20
BLOCK = 1000
WIDTH = 128
RUN_POSTINGS = 1 << 20
RUN_ROWS = 1 << 16
TASK_BYTES = 64 << 20
TASKS = 24
KINDS = table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
ROWS, TERMS, BYTES = -1, -2, -3  # beside the terms, what else is counted


class Item(NamedTuple):
    item_id: int | None
    terms: np.ndarray  # places in the block's vocabulary
    times: np.ndarray


class Run(NamedTuple):
    """Posting lists of a run of documents, one list after the other, sorted by term and document."""

    ids: np.ndarray  # of the documents, ascending
    missing: np.ndarray  # where the id is null
    starts: np.ndarray  # of each term's list, and the end of the last
    docs: np.ndarray
    impacts: np.ndarray
    keys: np.ndarray  # term * documents + document
    tops: np.ndarray  # [k, i]: the place of the maximum among 2 ** k postings from i on


def terms_of(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row its number of terms; per (row, term of the vocabulary) the key and its occurrences."""
    found = cut(texts, KINDS, LOWER)
    coded = found.words.dictionary_encode()
    place = pc.fill_null(pc.index_in(coded.dictionary, value_set=vocabulary), -1).to_numpy().astype(np.int64)
    term = place[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int64)
    asked = term >= 0
    keys, times = np.unique(found.rows[asked] * np.int64(max(len(vocabulary), 1)) + term[asked], return_counts=True)
    return np.bincount(found.rows, minlength=len(texts)), keys, times


def counts(docs: DataFrame, vocabulary: list[str]) -> dict[int, int]:
    """Documents per term of the vocabulary, and under ROWS, TERMS and BYTES what all have together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, per_term, sums = pa.array(vocabulary, pa.string()), np.zeros(len(vocabulary), np.int64), np.zeros(3, np.int64)
        for batch in batches:
            for rows in slices(batch, "text"):
                n, keys, _ = terms_of(rows.column("text"), known)
                per_term += np.bincount(keys % max(len(vocabulary), 1), minlength=len(vocabulary))[: len(vocabulary)]
                sums += [int((n > 0).sum()), int(n.sum()), pc.sum(pc.binary_length(rows.column("text"))).as_py() or 0]
        held = np.flatnonzero(per_term)
        names = np.concatenate([held, [ROWS, TERMS, BYTES]])
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(np.concatenate([per_term[held], sums]))], ["term", "n"])

    found = docs.mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return Counter({r.term: r.n for r in found.collect()})  # as many rows as the block has terms


def weight(rows: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * holding + 1)))


def built(ids: np.ndarray, missing: np.ndarray, rows: np.ndarray, terms: np.ndarray, times: np.ndarray, m: np.ndarray, n_terms: int) -> Run:
    order = np.lexsort((ids, missing))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys = terms * len(ids) + rank[rows]
    by_key = np.argsort(keys, kind="stable")
    keys, tf = keys[by_key], times[by_key].astype(np.int64)
    docs = keys % max(len(ids), 1)
    impacts = (1_000_000_000 * tf) // (1000 * tf + 12 * m[order][docs])
    starts = np.searchsorted(keys, np.arange(n_terms + 1, dtype=np.int64) * len(ids))
    longest = int(np.diff(starts).max()) if n_terms else 0
    tops = [np.arange(len(keys), dtype=np.int32)]
    while (1 << len(tops)) <= longest:
        half = 1 << (len(tops) - 1)
        here = tops[-1].copy()
        there = tops[-1][half:]
        better = impacts[there] > impacts[here[: len(there)]]
        here[: len(there)][better] = there[better]
        tops.append(here)
    return Run(ids[order], missing[order], starts, docs, impacts, keys, np.stack(tops))


def maxima(run: Run, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the largest impacts among the postings from a to b, -1 and 0 where there are none."""
    some = b > a
    size = np.where(some, b - a, 1)
    k = np.frexp(size)[1] - 1
    left = run.tops[k, np.where(some, a, 0)]
    right = run.tops[k, np.where(some, b - (1 << k), 0)]
    place = np.where(run.impacts[right] > run.impacts[left], right, left)
    return np.where(some, place, -1), np.where(some, run.impacts[place], 0)


class Best:
    """An item's best documents so far, with the order among equal scores."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.missing, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        some = scores > 0
        scores = np.concatenate([self.scores, scores[some]])
        missing, ids = np.concatenate([self.missing, missing[some]]), np.concatenate([self.ids, ids[some]])
        order = np.lexsort((ids, missing, -scores))[: self.top]
        self.scores, self.missing, self.ids = scores[order], missing[order], ids[order]

    def open(self, bounds: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which bounds, with the first document that they could stand for, may still be among the best."""
        if len(self.scores) < self.top:
            return bounds > 0
        last = self.scores[-1]
        before = (missing < self.missing[-1]) | ((missing == self.missing[-1]) & (ids < self.ids[-1]))
        return (bounds > last) | ((bounds == last) & before)


def searched(run: Run, terms: np.ndarray, weights: np.ndarray, best: Best, width: int = WIDTH) -> int:
    """Puts the item's documents of a run into ``best``; returns how many documents were looked at."""
    held = (run.starts[terms + 1] > run.starts[terms]) & (weights > 0)
    terms, weights = terms[held], weights[held]
    if not len(terms):
        return 0
    base = terms * np.int64(len(run.ids))
    low, high = np.zeros(1, np.int64), np.full(1, len(run.ids), np.int64)
    a, b = run.starts[terms][None, :], run.starts[terms + 1][None, :]
    place, value = maxima(run, a, b)
    bound, seen = (value * weights).sum(axis=1), 0
    peak = place[np.arange(1), (value * weights).argmax(axis=1)]
    while True:
        stay = best.open(bound, run.missing[low], run.ids[low])
        low, high, a, b, bound, peak = (x[stay] for x in (low, high, a, b, bound, peak))
        if not len(low):
            return seen
        first = np.zeros(len(low), bool)
        first[np.argpartition(-bound, width)[:width] if len(low) > width else slice(None)] = True
        doc = run.docs[peak[first]]
        at = np.searchsorted(run.keys, base + doc[:, None])
        there = at < b[first]
        met = there & (run.docs[np.minimum(at, len(run.docs) - 1)] == doc[:, None])
        scores = (np.where(met, run.impacts[np.minimum(at, len(run.docs) - 1)], 0) * weights).sum(axis=1)
        best.add(scores, run.missing[doc], run.ids[doc])
        seen += len(doc)
        new_low = np.concatenate([low[first], doc + 1])
        new_high = np.concatenate([doc, high[first]])
        new_a = np.concatenate([a[first], at + met])
        new_b = np.concatenate([at, b[first]])
        some = new_high > new_low
        new_low, new_high, new_a, new_b = new_low[some], new_high[some], new_a[some], new_b[some]
        place, value = maxima(run, new_a, new_b)
        parts = value * weights
        new_bound, new_peak = parts.sum(axis=1), place[np.arange(len(place)), parts.argmax(axis=1)]
        rest = ~first
        low, high = np.concatenate([low[rest], new_low]), np.concatenate([high[rest], new_high])
        a, b = np.concatenate([a[rest], new_a]), np.concatenate([b[rest], new_b])
        bound, peak = np.concatenate([bound[rest], new_bound]), np.concatenate([peak[rest], new_peak])


def best_of_tasks(docs: DataFrame, items: list[Item], vocabulary: list[str], known: dict[int, int], top: int) -> DataFrame:
    """item, item_id, doc_id and score of each item's best documents in every task."""
    n_rows, n_terms = known[ROWS], known[TERMS]
    weights = np.array([weight(n_rows, known[k]) for k in range(len(vocabulary))], np.int64)
    names = ["item", "item_id", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(vocabulary, pa.string())
        best = [Best(top) for _ in items]
        for own in runs(batches, terms, n_rows, n_terms):
            for item, found in zip(items, best, strict=True):
                searched(own, item.terms, weights[item.terms] * item.times, found)
        for number, (item, found) in enumerate(zip(items, best, strict=True)):
            if n := len(found.scores):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, number, np.int32)), pa.array([item.item_id] * n, pa.int64()),
                        pa.array(found.ids, mask=found.missing), pa.array(found.scores),
                    ],
                    names,
                )

    partitions = max(TASKS, math.ceil(known[BYTES] / TASK_BYTES))
    return docs.coalesce(partitions).mapInArrow(run, "item int, item_id bigint, doc_id bigint, score bigint")


def runs(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array, n_rows: int, n_terms: int) -> Iterator[Run]:
    """The documents of a task that have terms of the vocabulary, in runs of bounded size."""
    parts, postings, held, v = [], 0, 0, max(len(vocabulary), 1)

    def made() -> Run:
        ids, missing, m, rows, terms, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        return built(ids, missing, rows, terms, times, m, len(vocabulary))

    for batch in batches:
        for rows in slices(batch, "text", 4 << 20):
            n, keys, times = terms_of(rows.column("text"), vocabulary)
            if not len(keys):
                continue
            if parts and (postings + len(keys) > RUN_POSTINGS or held + rows.num_rows > RUN_ROWS):
                yield made()
                parts, postings, held = [], 0, 0
            ids = rows.column("doc_id")
            missing = pc.is_null(ids).to_numpy(zero_copy_only=False)
            m = 100 - 25 + (25 * n.astype(np.int64) * n_rows) // max(n_terms, 1)
            parts.append((pc.fill_null(ids, 0).to_numpy(), missing, m, keys // v + held, keys % v, times))
            postings, held = postings + len(keys), held + rows.num_rows
    if parts:
        yield made()


def blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items with a text, in blocks that hashes of id and text make about even."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    n = math.ceil(own.count() / most)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for k in range(n):
        rows = own.filter(block == k).collect() if n > 1 else own.collect()
        yield sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score: each item's best documents."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    spark, results = docs.sparkSession, []
    for rows in blocks(items, block):
        found = cut(pa.array([text for _, text in rows], pa.string()), KINDS, LOWER)
        words = found.words.to_pylist()
        vocabulary = sorted(set(words))
        place = {w: k for k, w in enumerate(vocabulary)}
        per_item = [Counter() for _ in rows]
        for row, word in zip(found.rows.tolist(), words, strict=True):
            per_item[row][place[word]] += 1
        asked = [
            Item(item_id, np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c)))
            for (item_id, _), c in zip(rows, per_item, strict=True)
        ]
        results.append(ranked(best_of_tasks(own, asked, vocabulary, counts(own, vocabulary), top), top))
    if not results:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    first = found.withColumn("part", part).withColumn("turn", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
    last = first.filter(F.col("turn") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return last.filter(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


_TERMS = "regexp_extract_all(translate(coalesce(\"text\", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*)::BIGINT AS all_rows, sum(len(ts))::BIGINT AS all_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT rid, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * all_rows + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t), s),
i AS (SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS ts FROM benchmark),
q AS (SELECT qid, item_id, unnest(ts) AS t FROM i),
c AS (SELECT qid, item_id, rid, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_rows) // all_terms))))::BIGINT AS score
    FROM q JOIN tf USING (t) JOIN w USING (t), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY rank <= {TOP}
"""
