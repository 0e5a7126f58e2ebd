"""Frequent phrases and how much they exceed chance, mined shard by shard.

The method is that of Savasere, Omiecinski and Navathe: the texts are dealt to
shards, each shard is mined completely at a support lowered in proportion to
its share of the bytes of a language, the phrases that are frequent in any
shard are united, and all of those are counted exactly over all texts. Shares
add up to one, so a phrase that reaches the support over all texts reaches the
lowered one in a shard at least, and none is missed. With the phrase goes what
its count exceeds the most that a shard leaves unsaid: where these excesses do
not add up to what the support needs beyond all shards' unsaid counts, the
phrase cannot reach the support and is not counted again.

A shard is a run of rows within a task: a twelfth of all text (``SHARDS``), but
at most ``SHARD_BYTES``, which bounds its memory. Small partitions are joined,
so that shards are few and the lowered support stays high. The support is an
absolute number: from about 100 shards on it falls to one, where it would let
every phrase through. So where it falls to ``LOWEST`` or less, all phrases are
first counted by their hash in a table of counters (``MOST_SLOTS`` at most),
which tasks fill for their texts and send piece by piece. A phrase occurs at
most as often as its counter says, all that share it together, so the shards
leave out phrases under a counter that does not reach the support, and what
these would grow to. None that reaches it is lost.

Within a shard phrases grow by a word at a time, and only where both the
phrase without its last word and that without its first one have stayed. They
are sorted in parts (``SORTED`` places each) that hold all of a phrase. The
united phrases go back to the shards as a table of bits under their hashes,
``MOST_BITS`` at most: a wrong bit makes a shard count a phrase in vain, it
loses none, as what counts in the end is the exact sum by the phrase's words.

Nulls: a null text is empty, a null language is ``und``. Repeated rows are
counted each. Long texts are mined whole; a row longer than a shard is a shard.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altloom.llm.base import read, slices, strings, whole
from altloom.llm.cuts import cut, table
from altloom.session import materialize

SUPPORT = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
SHARD_BYTES = 64 << 20
SHARDS = 12
SORTED = 1 << 20
MOST_BITS = 1 << 27
LOWEST = 5
MOST_SLOTS = 1 << 27
PIECE = 1 << 16
RUN = 1 << 15
TALLY_BYTES = 8 << 20
TASK_BYTES = 1 << 29
FEW = 10_000
KINDS = table(b" \t", b".,;:!?\n\x0b\x0c\r")


class Shard(NamedTuple):
    """The words of a shard's texts, one after the other."""

    languages: list[str]
    language: np.ndarray  # of each word
    bytes_of: np.ndarray  # of each language, in this shard
    totals: np.ndarray  # of each language, in all texts
    words: pa.Array  # distinct
    codes: np.ndarray  # of each word, its place among the distinct ones
    opens: np.ndarray


class Level(NamedTuple):
    """The phrases of one length that a shard keeps."""

    size: int
    at: np.ndarray  # a place where each begins
    counts: np.ndarray
    hashes: np.ndarray


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    """The shards of a task. Batches hold lang, text and lang_bytes."""
    parts, held = [], 0
    for batch in batches:
        for rows in slices(batch, "text", min(most, 4 << 20)):
            size = pc.sum(pc.binary_length(rows.column("text"))).as_py() or 0
            if parts and held + size > most:
                yield gathered(parts)
                held = 0
            found = cut(rows.column("text"), KINDS)
            # New arrays, so that no part of the batch itself is kept.
            lang, total = pa.array(rows.column("lang").to_pylist(), pa.string()), rows.column("lang_bytes").to_numpy().copy()
            parts.append((found.words.dictionary_encode(), found.rows, found.opens, lang, total, pc.binary_length(rows.column("text")).to_numpy()))
            del found
            held += size
    if parts:
        yield gathered(parts)


def gathered(parts: list[tuple]) -> Shard:
    """A shard of what has been cut; ``parts`` is emptied, so that nothing is held twice."""
    words, rows, opens, names, totals, lengths = (list(x) for x in zip(*parts, strict=True))
    parts.clear()
    coded = pa.chunked_array(names).combine_chunks().dictionary_encode()
    language = coded.indices.to_numpy().astype(np.uint8 if len(coded.dictionary) < 256 else np.int32)
    known = np.zeros(len(coded.dictionary), np.int64)
    known[language] = np.concatenate(totals)
    own = np.bincount(language, np.concatenate(lengths), len(known)).astype(np.int64)
    of_word, first = [], 0
    for part, n in zip(rows, map(len, names), strict=True):
        of_word.append(language[part + first])
        first += n
    found = pa.chunked_array(words).unify_dictionaries()
    del words
    codes = np.concatenate([chunk.indices.to_numpy() for chunk in found.chunks])
    distinct = found.chunk(0).dictionary
    del found
    pa.default_memory_pool().release_unused()
    return Shard(coded.dictionary.to_pylist(), np.concatenate(of_word), own, known, distinct, codes, np.concatenate(opens))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key its number among the distinct ones; of these, where each occurs and how often."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    first = np.ones(len(keys), bool)
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=first[1:])
    del sorted_keys
    begin = np.flatnonzero(first)
    index = np.empty(len(keys), np.int32)
    index[order] = np.cumsum(first, dtype=np.int32) - 1
    return index, order[begin], np.diff(np.append(begin, len(keys)))


def mined(shard: Shard, longest: int, stays) -> Iterator[Level]:
    """The phrases that are kept, length after length. ``stays(language, counts, hashes)`` says which ones are."""
    n, seeds, of_language = len(shard.codes), hashed(shard.words, 11), hashed(shard.languages, 13)
    now, given = shard.codes, len(shard.words)
    for size in range(1, longest + 1):
        if size == 1:
            left, right, begins = shard.language, shard.codes, np.ones(n, bool)
        else:
            # A longer phrase begins where one stays and the next word of the piece begins another.
            left, right = now[:-1], now[1:]
            begins = (left >= 0) & (right >= 0) & ~shard.opens[1:]
        parts = -(-int(begins.sum()) // SORTED)
        turn = dealt(left, right, parts)
        after, width, given = np.full(n, -1, np.int32), given + 1, 0
        for part in range(parts):
            place = np.flatnonzero(begins & (turn == part) if parts > 1 else begins).astype(np.int32)
            if not len(place):
                continue
            index, at, counts = grouped(left[place].astype(np.int64) * width + right[place])
            at = place[at]
            hashes = of_language[shard.language[at]]
            for k in range(size):
                hashes = mixed(hashes, seeds[shard.codes[at + k]])
            kept = stays(shard.language[at], counts, hashes)
            after[place] = np.where(kept, given + np.cumsum(kept) - 1, -1).astype(np.int32)[index]
            given += int(kept.sum())
            yield Level(size, at[kept], counts[kept], hashes[kept])
        if not given:
            return
        now = after


def dealt(left: np.ndarray, right: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair, the same for equal pairs."""
    if parts < 2:
        return np.zeros(0, np.uint8)
    out = np.empty(len(left), np.uint8 if parts < 256 else np.uint32)
    for k in range(0, len(left), SORTED):
        mix = left[k : k + SORTED].astype(np.uint32) * np.uint32(0x9E3779B1) + right[k : k + SORTED].astype(np.uint32)
        out[k : k + SORTED] = ((mix * np.uint32(0x85EBCA6B)) >> np.uint32(12)) % np.uint32(parts)
    return out


def mixed(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ word) * np.uint64(0x9E3779B97F4A7C15)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(29))


def prepared(docs: DataFrame, shard_bytes: int) -> tuple[DataFrame, int, int]:
    """lang, text and lang_bytes, the bytes of all texts of the language, in few partitions; the size of a shard and that of all texts."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), whole("text").alias("text"))
    sizes = own.select("lang", F.octet_length("text").alias("size"), F.spark_partition_id().alias("partition"))
    totals = materialize(sizes.groupBy("lang").agg(F.sum("size").alias("lang_bytes"), F.max("partition").alias("last")))
    total, last, languages = totals.agg(F.sum("lang_bytes"), F.max("last"), F.count("*")).first()
    per_lang = totals.select(F.col("lang").alias("of"), "lang_bytes")
    joined = own.join(per_row(per_lang, languages), F.col("lang") == F.col("of")).select("lang", "text", "lang_bytes")
    total, partitions = max(total or 0, 1), (last or 0) + 1
    shard_bytes = min(shard_bytes, max(total // SHARDS, 1 << 20))
    # As many partitions to a task as make a shard.
    return joined.coalesce(-(-partitions // max(1, shard_bytes * partitions // total))), shard_bytes, total


def per_row(table: DataFrame, rows: int) -> DataFrame:
    """Sent to every task only if it has few rows."""
    return F.broadcast(table) if rows <= FEW else table


def holds(table: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Is the bit set that a hash has in the table?"""
    last = np.uint64(64 * len(table) - 1)

    def held(hashes: np.ndarray) -> np.ndarray:
        slot = hashes & last
        return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    return held


def tally(shard: Shard, counters: np.ndarray, longest: int, support: int) -> None:
    """Count all phrases of a shard by their hash. A counter stops at the support; a run of words cannot take it past its type."""
    n, seeds, of_language = len(shard.codes), hashed(shard.words, 11), hashed(shard.languages, 13)
    last, one = np.uint64(len(counters) - 1), counters.dtype.type(1)
    for begin in range(0, n, RUN):
        end = min(begin + RUN, n)
        words, opens = seeds[shard.codes[begin : end + longest - 1]], shard.opens[begin : end + longest - 1]
        hashes, inside = of_language[shard.language[begin:end]], np.ones(end - begin, bool)
        for k in range(longest):
            # Of the last words of a shard fewer have one that stands k places on.
            most = min(end - begin, len(words) - k)
            hashes = mixed(hashes[:most], words[k : k + most])
            inside = inside[:most] & ~opens[k : k + most] if k else inside
            slots = (hashes[inside] & last).astype(np.int64)
            np.add.at(counters, slots, one)
            counters[slots[counters[slots] > support]] = support


def reached(texts: DataFrame, support: int, longest: int, shard_bytes: int, total: int) -> np.ndarray:
    """A table of bits: under which hashes there are so many phrases over all texts that one of them may reach the support."""
    size = max(PIECE, min(MOST_SLOTS, 1 << (2 * total // support).bit_length()))
    kind = np.uint16 if support + RUN < 1 << 16 else np.uint32
    sent = np.uint8 if support < 256 else kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = None
        for shard in shards(batches, min(shard_bytes, TALLY_BYTES)):
            counters = np.zeros(size, kind) if counters is None else counters
            tally(shard, counters, longest, support)
        for begin in range(0, size if counters is not None else 0, PIECE):
            counts = counters[begin : begin + PIECE].astype(sent).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([begin // PIECE]), pa.array([counts], pa.binary())], ["piece", "counts"])

    def add(found: pa.Table) -> pa.Table:
        sums = np.zeros(PIECE, np.int64)
        for counts in found.column("counts"):
            sums += np.frombuffer(counts.as_buffer(), sent)
        bits = np.packbits(sums >= support, bitorder="little").tobytes()
        return pa.table({"piece": found.column("piece").slice(0, 1), "bits": pa.array([bits], pa.binary())})

    # Every task sends a whole table: few tasks, but some for each core.
    tasks = max(2 * texts.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES)
    pieces = texts.coalesce(tasks).mapInArrow(run, "piece bigint, counts binary")
    found = pieces.groupBy("piece").applyInArrow(add, "piece bigint, bits binary").toArrow()
    out = np.zeros(size // 64, np.uint64)
    for piece, bits in zip(found.column("piece").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[piece * (PIECE // 64) : (piece + 1) * (PIECE // 64)] = np.frombuffer(bits, "<u8")
    return out


def united(texts: DataFrame, support: int, longest: int, shard_bytes: int, open_to: np.ndarray | None = None) -> DataFrame:
    """Hashes of the phrases that are frequent in a shard, at its lowered support, and may be so over all.

    ``open_to``: bits of the hashes whose phrases may reach the support at all.
    """
    sent = None if open_to is None else texts.sparkSession.sparkContext.broadcast(open_to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["language", "hash", "over"]
        may_reach = None if sent is None else holds(sent.value)
        for shard in shards(batches, shard_bytes):
            # The least whole count that is not below the share of the support, in whole numbers.
            own = zip(shard.bytes_of, shard.totals, strict=True)
            least = np.array([max(1, -(-support * int(some) // max(int(total), 1))) for some, total in own], np.int64)
            languages = hashed(shard.languages, 13).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(languages), pa.nulls(len(least), pa.int64()), pa.array(least - 1)], names)

            def stays(language: np.ndarray, counts: np.ndarray, hashes: np.ndarray, least: np.ndarray = least) -> np.ndarray:
                enough = counts >= least[language]
                return enough if may_reach is None else enough & may_reach(hashes)

            for level in mined(shard, longest, stays):
                of = shard.language[level.at]
                over = level.counts - (least[of] - 1)
                yield pa.RecordBatch.from_arrays([pa.array(languages[of]), pa.array(level.hashes.view(np.int64)), pa.array(over)], names)

    parts = texts.mapInArrow(run, "language bigint, hash bigint, over bigint")
    sums = materialize(parts.groupBy("language", "hash").agg(F.sum("over").alias("over")))
    unsaid = sums.filter("hash IS NULL").select(F.col("language").alias("of"), F.col("over").alias("unsaid"))
    met = sums.filter("hash IS NOT NULL").join(per_row(unsaid, unsaid.count()), F.col("language") == F.col("of"))
    return met.filter(F.col("over") + F.col("unsaid") >= support).select("hash")


def hashed(words: pa.Array | list[str], seed: int) -> np.ndarray:
    out, digest = np.empty(len(words), np.uint64), xxhash.xxh64_intdigest
    for k in range(0, len(words), 1 << 16):
        part = words[k : k + (1 << 16)]
        texts = part if isinstance(part, list) else strings(part)
        out[k : k + len(texts)] = np.fromiter((digest(w.encode("utf-8", "surrogatepass"), seed) for w in texts), np.uint64, len(texts))
    return out


def bits(hashes: DataFrame) -> np.ndarray:
    """A table of bits, set under the given hashes; a power of two, MOST_BITS at most."""
    wanted = 32 * max(hashes.count(), 32)
    size = min(MOST_BITS, 1 << (wanted - 1).bit_length())
    slot = F.col("hash").bitwiseAND(size - 1)
    words = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST((hash & {size - 1}L) & 63 AS INT))")).alias("set")
    )
    out = np.zeros(size // 64, np.uint64)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return out


def counted(texts: DataFrame, asked: np.ndarray, support: int, longest: int, shard_bytes: int) -> DataFrame:
    """lang, phrase, size and f of all frequent phrases; the phrase of size 0 has the number of words."""
    sent = texts.sparkSession.sparkContext.broadcast(asked)
    names = ["lang", "phrase", "size", "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_asked = holds(sent.value)
        for shard in shards(batches, shard_bytes):
            languages = pa.array(shard.languages, pa.string())
            all_words = np.bincount(shard.language, minlength=len(languages))
            yield pa.RecordBatch.from_arrays(
                [languages, pa.array([""] * len(languages)), pa.array(np.zeros(len(languages), np.int32)), pa.array(all_words.astype(np.int64))], names
            )
            for level in mined(shard, longest, lambda language, counts, hashes: is_asked(hashes)):
                for k in range(0, len(level.at), 1 << 18):
                    at, counts = level.at[k : k + (1 << 18)], level.counts[k : k + (1 << 18)]
                    words = [shard.words.take(pa.array(shard.codes[at + j])) for j in range(level.size)]
                    phrase = pc.binary_join_element_wise(*words, " ") if level.size > 1 else words[0]
                    size = pa.array(np.full(len(at), level.size, np.int32))
                    yield pa.RecordBatch.from_arrays([languages.take(pa.array(shard.language[at])), phrase, size, pa.array(counts.astype(np.int64))], names)

    parts = texts.mapInArrow(run, "lang string, phrase string, size int, f bigint")
    sums = parts.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return sums.filter((F.col("f") >= support) | (F.col("size") == 0))


def frequent(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, phrase, size and f of every phrase of at most ``longest`` words that occurs ``support`` times or more."""
    texts, shard_bytes, total = prepared(docs, shard_bytes)
    lowered = support * shard_bytes <= LOWEST * total
    open_to = reached(texts, support, longest, shard_bytes, total) if lowered else None
    asked = bits(materialize(united(texts, support, longest, shard_bytes, open_to)))
    return materialize(counted(texts, asked, support, longest, shard_bytes))


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score by the lowest cut, of the frequent phrases that no longer one makes needless."""
    n = found.filter("size = 0").select(F.col("lang").alias("n_lang"), F.col("f").alias("n"))
    parts = F.split("phrase", " ")
    phrases = found.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({
        "left": F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "),
        "right": F.array_join(F.slice(parts, F.col("k") + 1, F.col("size") - F.col("k")), " "),
    })
    lefts = found.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("l_phrase"), F.col("f").alias("l"))
    rights = found.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("r_phrase"), F.col("f").alias("r"))
    met = cuts.join(lefts, (F.col("lang") == F.col("l_lang")) & (F.col("left") == F.col("l_phrase")))
    met = met.join(rights, (F.col("lang") == F.col("r_lang")) & (F.col("right") == F.col("r_phrase")))
    met = materialize(met.select("lang", "phrase", "size", "a", "k", "left", "right", "l", "r"))
    # A phrase as frequent as one that is a word longer says nothing of its own; a longer one yet is as frequent as those between.
    covered = met.filter((F.col("k") == F.col("size") - 1) & (F.col("l") == F.col("a"))).select("lang", F.col("left").alias("phrase")).union(
        met.filter((F.col("k") == 1) & (F.col("r") == F.col("a"))).select("lang", F.col("right").alias("phrase"))
    )
    own = met.join(covered.distinct(), ["lang", "phrase"], "left_anti")
    with_n = own.join(per_row(n, n.count()), F.col("lang") == F.col("n_lang"))
    score = exact(1000, "a", "n", over=("l", "r"))
    least = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    best = with_n.groupBy("lang", "phrase", "a", "n").agg(least.alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def exact(factor: int, *names: str, over: tuple[str, str]) -> Column:
    """factor * names / over, rounded down; products have up to 38 digits."""
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    above = (wide(names[0]) * wide(names[1])).cast("decimal(34,0)") * F.lit(factor).cast("decimal(4,0)")
    below = wide(over[0]) * wide(over[1])
    return F.call_function("div", above, below)


def top_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each language's first phrases by score, frequency and bytes."""
    own = scored(frequent(docs, support, longest, shard_bytes))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First among 64 parts of a language, then among what those let through.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = own.withColumn("part", part).withColumn("turn", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = first.filter(F.col("turn") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return top_phrases(read(spark, sf_dir, "documents", "text", "lang"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '{UNKNOWN}') AS lang,
    translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT rid, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
    FROM w, range(1, {LONGEST + 1}) AS s(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND f >= {SUPPORT}),
u AS (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM c),
cuts AS (SELECT u.lang, u.k, u.phrase, u.a, u.j, x.f AS l, y.f AS r, n.n,
    (1000::HUGEINT * u.a * n.n) // (x.f::HUGEINT * y.f) AS score
    FROM u JOIN f x ON x.lang = u.lang AND x.k = u.j AND x.phrase = array_to_string(u.ws[1 : u.j], ' ')
    JOIN f y ON y.lang = u.lang AND y.k = u.k - u.j AND y.phrase = array_to_string(u.ws[u.j + 1 :], ' ') JOIN n ON n.lang = u.lang),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
within AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a, unnest(list_transform(
      list_filter(flatten(list_transform(range(1, k + 1), lambda i: list_transform(range(i + 1, k + 1), lambda e: [i, e]))), lambda x: x[2] - x[1] + 1 < k),
      lambda x: array_to_string(string_split(phrase, ' ')[x[1] : x[2]], ' '))) AS inner_phrase FROM c) q
    JOIN c s ON s.lang = q.lang AND s.phrase = q.inner_phrase WHERE 100 * q.a >= 100 * s.a),
kept AS (SELECT low.* FROM low ANTI JOIN within USING (lang, phrase))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= {TOP}
"""
