"""Language of words and texts by a linear-chain conditional random field.

Each word with a letter has a label, its language. The score of a labelling
is the sum of what the words' features say (affixes, letter n-grams, and the
word itself if the lexicon of the training texts has it) and of learned
transitions between neighbours. Forward-backward gives each word's
probabilities; a text's language is the one with the largest mean, which is
its score. Words of a text that changes language are labelled one by one.

Training maximises the likelihood of the labels on sequences put together from
windows of texts of one or more languages, so that transitions are seen. It
takes ``PER_LANG`` texts of each of the ``MOST_LANGS`` most frequent languages
at most, each of ``MOST_CHARS`` characters at most, those with the smallest
hashes of their ids: that bounds what comes to the driver. The language comes from the text alone.

A text is cut into segments; the product of a segment's transition matrices
stands for the segment, so that forward-backward over a very long text takes
few steps in one array operation each, and is exact.

Nulls: a text that is null or has no letter is ``und`` with score 0, and so is
every text if no labelled row is there to learn from. Null ids are neither
learned from nor held out. Ties go to the first language by name. Repeated
rows are each labelled. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altloom.llm.base import Known, kept_in_worker, per_row, ragged_index, read, slices, strings
from altloom.llm.crf import marginals

UNKNOWN = "und"
PER_LANG = 300
MOST_CHARS = 20_000
MOST_LANGS = 200
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
SCALE_EVERY = 8
SEGMENT = 256
LEAST_SCORE = 0.3


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # feature bucket by language, and a last row of zeros
    lexicon: dict[str, int]  # word to its own row of lexicon_weights
    lexicon_weights: np.ndarray
    moves: np.ndarray  # transition scores


def core(word: str) -> str:
    """The letters of a word, in lower case."""
    return (word if word.isalpha() else "".join(filter(str.isalpha, word))).lower()


def hashed(values: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of letter codes that were folded into one number."""
    mixed = (values + np.uint64(kind * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features(cores: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Buckets of the letter n-grams and affixes of words of letters.

    Given are the words' starts in one row of letters with a mark at each end
    of a word, the buckets of the n-grams that start at each letter (a further
    bucket stands for those that would leave the word), the words' sizes, and
    for each kind of affix a bucket per word.
    """
    codes = np.frombuffer("".join([f"<{c}>" for c in cores]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, cores), np.int64, len(cores)) + 2
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
    grams, folded = [], codes
    for n in (2, 3):
        after = np.concatenate([codes[n - 1 :], np.zeros(n - 1, np.uint64)])
        folded = folded * np.uint64(1_000_003) + after
        grams.append(np.where(left >= n, hashed(folded, n), BUCKETS))
    affixes = []
    for kind, first, way in ((10, starts + 1, 1), (20, starts + sizes - 2, -1)):
        folded = np.zeros(len(cores), np.uint64)
        for n in range(1, 5):
            fits = sizes - 2 >= n
            at = np.where(fits, first + way * (n - 1), first)
            folded = np.where(fits, folded * np.uint64(1_000_003) + codes[at], folded)
            affixes.append(hashed(folded, kind + n))
    return starts, grams, sizes, affixes


def scores(model: Model, words: list[str]) -> list[np.ndarray]:
    """What the features say of each word; nothing for a word without letters."""
    cores = [core(w) for w in words]
    full = list(dict.fromkeys(c for c in cores if c))
    none = np.zeros(0, np.float32)
    if not full:
        return [none] * len(words)
    starts, grams, _, affixes = features(full)
    sums = np.add.reduceat(model.weights[grams[0]] + model.weights[grams[1]], starts, axis=0)
    for buckets in affixes:
        sums += model.weights[buckets]
    sums += model.lexicon_weights[np.fromiter((model.lexicon.get(c, 0) for c in full), np.int64, len(full))]
    given = dict(zip(full, sums, strict=True))
    return [given[c] if c else none for c in cores]


def normal(values: np.ndarray) -> np.ndarray:
    return values / values.sum(axis=-1, keepdims=True)


def posteriors(emitted: np.ndarray, counts: np.ndarray, moves: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Each word's label probabilities. ``emitted`` holds the words' scores, text after text, ``counts`` words each."""
    k = emitted.shape[1]
    if not len(emitted):
        return np.zeros((0, k))
    b = np.exp(emitted - emitted.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    step = np.exp(moves - moves.max())
    pieces = -(-counts // segment)
    owner = np.repeat(np.arange(len(counts)), pieces)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(np.cumsum(counts) - counts, pieces) + turn * segment
    size = np.minimum(segment, counts[owner] - turn * segment)
    order = np.argsort(-size, kind="stable")
    begin, size, fresh = begin[order], size[order], (turn == 0)[order]  # a text's first word follows none
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]))]  # segments longer than t

    ahead, behind = np.full((len(size), k), 1.0 / k), np.full((len(size), k), 1.0 / k)
    if int(pieces.max()) > 1:
        many = rank[np.flatnonzero(pieces[owner] > 1)]  # only texts of several segments need the products
        many.sort()
        place = np.zeros(len(size), np.int64)
        place[many] = np.arange(len(many))
        product = np.tile(np.eye(k), (len(many), 1, 1))
        for t in range(int(size[many[0]])):
            n = int(np.searchsorted(-size[many], -t, side="left"))
            come = (product[:n].reshape(-1, k) @ step).reshape(n, k, k)
            if t == 0:
                come[fresh[many[:n]]] = np.eye(k)
            now = come * b[begin[many[:n]] + t][:, None, :]
            product[:n] = now / now.max(axis=(1, 2), keepdims=True) if t % SCALE_EVERY == 0 else now
        product /= product.max(axis=(1, 2), keepdims=True)
        first = np.cumsum(pieces) - pieces
        for t in range(1, int(pieces.max())):
            texts = np.flatnonzero(pieces > t)
            to, come = rank[first[texts] + t], rank[first[texts] + t - 1]
            ahead[to] = normal(np.einsum("ni,nij->nj", ahead[come], product[place[come]]))
            last = first[texts] + pieces[texts] - 1
            to, come = rank[last - t], rank[last - t + 1]
            behind[to] = normal(np.einsum("nij,nj->ni", product[place[come]], behind[come]))

    out = np.empty((len(emitted), k))
    for t, n in enumerate(active):
        at = begin[:n] + t
        come = ahead[:n] @ step
        if t == 0:
            come[fresh] = 1.0 / k
        now = come * b[at]
        ahead[:n] = out[at] = normal(now) if t % SCALE_EVERY == 0 else now
    back = step.T
    for t in range(len(active) - 1, -1, -1):
        n, at = active[t], begin[: active[t]] + t
        out[at] *= behind[:n]
        now = (b[at] * behind[:n]) @ back
        behind[:n] = normal(now) if t % SCALE_EVERY == 0 else now
    return normal(out)


def chosen(docs: DataFrame, per_lang: int, most_chars: int, most_langs: int = MOST_LANGS) -> list[tuple[str, str]]:
    """(lang, text) of the rows to learn from, a bounded number.

    Of each language a threshold from its number of rows lets about three times
    as many ids through as are wanted, so that a language with a third of all
    rows sends no more to one task than another.
    """
    own = docs.select("doc_id", "lang", "text").filter(may_learn() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= most_chars))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    narrow = own.select("lang", "doc_id")
    sizes = narrow.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs)
    share = F.least(F.lit(1.0), 3.0 * per_lang / F.col("count"))
    near = narrow.join(F.broadcast(sizes), "lang").filter(F.shiftright(F.xxhash64("doc_id"), 33) <= share * (1 << 31) - (1 << 30))
    turned = near.select("lang", "doc_id").withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ids = turned.filter(F.col("turn") <= per_lang).select(F.col("doc_id").alias("of"), F.col("lang").alias("of_lang"))
    met = own.join(F.broadcast(ids), (F.col("doc_id") == F.col("of")) & (F.col("lang") == F.col("of_lang")))
    rows = met.select("lang", "doc_id", "text").distinct().collect()
    return [(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text))]


def part_of() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def may_learn() -> Column:
    return part_of() != 1


def trained(
    rows: list[tuple[str, str]], sequences: int = 3000, length: int = 96, passes: int = 2, batch: int = 64, rate: float = 0.3, seed: int = 5
) -> Model | None:
    """The field fitted by AdaGrad on the gradient of the labels' likelihood."""
    texts = [(lang, [c for c in map(core, text.split()) if c]) for lang, text in rows]
    texts = [(lang, words) for lang, words in texts if words]
    if not texts:
        return None
    languages = sorted({lang for lang, _ in texts})
    k, rng = len(languages), random.Random(seed)
    label = {lang: i for i, lang in enumerate(languages)}
    by_label: list[list[list[str]]] = [[] for _ in languages]
    for lang, words in texts:
        by_label[label[lang]].append(words)
    seen = Counter(w for _, words in texts for w in words)
    lexicon = {w: i + 1 for i, w in enumerate(sorted(w for w, n in seen.items() if n >= 3))}

    types = {w: i for i, w in enumerate(sorted(seen))}
    heads, grams, letters, affixes = features(list(types))
    owner = np.concatenate([np.repeat(np.arange(len(types)), letters)] * 2 + [np.arange(len(types))] * len(affixes))
    order = np.argsort(owner, kind="stable")
    flat, sizes = np.concatenate([*grams, *affixes])[order], 2 * letters + len(affixes)
    starts = np.cumsum(sizes) - sizes
    own_row = np.fromiter((lexicon.get(w, 0) for w in types), np.int64, len(types))

    weights, own = np.zeros((BUCKETS + 1, k), np.float32), np.zeros((len(lexicon) + 1, k), np.float32)
    moves = np.zeros((k, k))
    past = [np.full_like(weights, 1e-3), np.full_like(own, 1e-3), np.full_like(moves, 1e-3)]

    def sequence() -> tuple[list[int], list[int]]:
        words, labels = [], []
        parts = rng.choice((1, 1, 2, 3))
        for _ in range(parts):
            lang = rng.randrange(k)
            text = by_label[lang][rng.randrange(len(by_label[lang]))]
            n = length // parts
            at = rng.randrange(max(1, len(text) - n + 1))
            piece = text[at : at + n]
            words += [types[w] for w in piece]
            labels += [lang] * len(piece)
        return words, labels

    def gone(which: int, table: np.ndarray, rows: np.ndarray, slope: np.ndarray) -> None:
        past[which][rows] += slope * slope
        table[rows] += rate * slope / np.sqrt(past[which][rows])

    for _ in range(passes * sequences // batch):
        made = [sequence() for _ in range(batch)]
        words = np.concatenate([np.array(w) for w, _ in made])
        truth = np.concatenate([np.array(y) for _, y in made])
        counts = np.array([len(w) for w, _ in made])
        used, back = np.unique(words, return_inverse=True)
        index = flat[ragged_index(starts[used], sizes[used])]
        heads = np.cumsum(sizes[used]) - sizes[used]
        said = np.add.reduceat(weights[index], heads, axis=0) + own[own_row[used]]
        emitted = said[back].astype(np.float64)
        found, expected, _ = marginals(emitted, counts, moves, np.zeros(k))
        error = np.eye(k)[truth] - found
        per_type = np.zeros((len(used), k))
        np.add.at(per_type, back, error)
        per_type /= batch
        buckets, place = np.unique(index, return_inverse=True)
        slope = np.zeros((len(buckets), k))
        np.add.at(slope, place, np.repeat(per_type, sizes[used], axis=0))
        slope[buckets == BUCKETS] = 0
        gone(0, weights, buckets, slope.astype(np.float32))
        rows_used, place = np.unique(own_row[used], return_inverse=True)
        slope = np.zeros((len(rows_used), k))
        np.add.at(slope, place, per_type)
        slope[rows_used == 0] = 0
        gone(1, own, rows_used, slope.astype(np.float32))
        # Transitions: those seen less those expected, by the joint probabilities of neighbours.
        inner = np.ones(len(words), bool)
        inner[np.cumsum(counts) - counts] = False
        here = np.flatnonzero(inner)
        seen_moves = np.zeros((k, k))
        np.add.at(seen_moves, (truth[here - 1], truth[here]), 1)
        gone(2, moves, np.arange(k), (seen_moves - expected) / batch)
    return Model(languages, weights, lexicon, own, moves)


def identify(docs: DataFrame, model: Model | None, words: bool = False) -> DataFrame:
    """doc_id, lang_pred and score; with ``words`` also the label of each word that has a letter."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent, tag = docs.sparkSession.sparkContext.broadcast(model and tuple(model)), uuid.uuid4().hex
    names = ["doc_id", "lang_pred", "score"] + ["labels"] * words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value and Model(*sent.value)
        known = kept_in_worker("word_scores", lambda: Known(np.float32, 400_000), of=tag)
        for batch in batches:
            for rows in slices(batch, "text", 8 << 20):
                column = pc.fill_null(rows.column("text"), "")
                if fitted is None:
                    sums, counts, labels = np.zeros((rows.num_rows, 1)), np.zeros(rows.num_rows, np.int64), [[]] * rows.num_rows
                else:
                    sums, counts, labels = labelled(fitted, known, column, words)
                best = sums.argmax(axis=1)
                found = pa.array([fitted.languages[i] if n else UNKNOWN for i, n in zip(best.tolist(), counts.tolist(), strict=True)], pa.string())
                score = np.minimum(sums.max(axis=1) / np.maximum(counts, 1), 1.0)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), found, pa.array(score, pa.float64())] + [pa.array(labels, pa.list_(pa.string()))] * words, names
                )

    schema = f"doc_id {kind}, lang_pred string, score double" + ", labels array<string>" * words
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def labelled(model: Model, known: Known, column: pa.StringArray, words: bool) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Per text: summed probabilities, number of words with a letter, and the words' labels if asked for."""
    k = len(model.languages)
    # Letters stand between ASCII white space; what else may part words is dropped by ``core``.
    lists = pc.ascii_split_whitespace(column)
    ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    slots = known.slots(strings(coded.dictionary), lambda new: scores(model, new))[coded.indices.to_numpy()]
    counts = per_row(ends, (known.sizes[slots] > 0).astype(np.int64))
    emitted = known.gather(slots).reshape(-1, k)
    full = np.flatnonzero(counts)
    found = posteriors(emitted, counts[full], model.moves)
    sums = np.zeros((len(counts), k))
    if len(full):
        sums[full] = np.add.reduceat(found, np.cumsum(counts[full]) - counts[full], axis=0)
    labels: list[list[str]] = []
    if words:
        best, at = found.argmax(axis=1), 0
        for n in counts.tolist():
            labels.append([model.languages[i] for i in best[at : at + n].tolist()])
            at += n
    return sums, counts, labels


def learned(docs: DataFrame, per_lang: int = PER_LANG, most_chars: int = MOST_CHARS) -> Model | None:
    return trained(chosen(docs, per_lang, most_chars))


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs, learned(docs))
    return found.select("doc_id", F.coalesce(part_of() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, model: Model | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more, all columns as they were.

    The text is read once more in the same pass, so that no row is moved.
    """
    sent, tag = docs.sparkSession.sparkContext.broadcast(model and tuple(model)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, known = sent.value and Model(*sent.value), kept_in_worker("word_scores", lambda: Known(np.float32, 400_000), of=tag)
        for batch in batches:
            for rows in slices(batch, "text", 8 << 20):
                if fitted is None:
                    continue
                sums, counts, _ = labelled(fitted, known, pc.fill_null(rows.column("text"), ""), False)
                yield rows.filter(pa.array((counts > 0) & (sums.max(axis=1) >= least * np.maximum(counts, 1))))

    return docs.mapInArrow(run, docs.schema)
