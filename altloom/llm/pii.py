"""Personal data: plain patterns, and a conditional random field for what they miss.

The patterns find e-mail addresses, IP addresses, card numbers (which pass
Luhn's test) and phone numbers in their usual forms. A linear-chain
conditional random field adds spans in other forms: ``name[at]host.org``, an
address with a letter beyond ASCII, ``10[.]0[.]0[.]1``, a card number parted
by dots, a phone number without a plus sign. It labels words as outside, first
or further word of a kind, from features of a word's shape, those of its two
neighbours, and a few cue words (``tel``, ``card``). Labels are decoded by
Viterbi, all chains of a batch together. A chain is a line; a long line is cut
after a plain word. What the field labels is added only if it has the digits
or the sign that its kind needs, and where no pattern's span overlaps it.

The field is trained on a small labelled table of ``ROWS`` lines at most, made
by rule: lines of the documents without digits, of ``SAMPLE`` documents at
most, of ``MOST_CHARS`` characters each, into which items of every kind and
things that only look like them are put. Only these words come to the driver.

Nulls: a null text is empty and has no spans; a null id is kept. Repeated rows
are each searched. Texts are searched whole, in time linear in their length.
Without documents the field is trained on its own words. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altloom.llm.base import Known, kept_in_worker, ragged_index, read, slices, strings, whole
from altloom.llm.crf import marginals, viterbi
from altloom.llm.cuts import AS_IS, cut, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O"] + [f"{part}-{kind}" for kind in KINDS for part in "BI"]
SAMPLE = 300
MOST_CHARS = 20_000
ROWS = 4000
CHAIN = 256
BUCKETS = 1 << 15
NO_WAY = -1e4
CUES = "tel phone fax call mobile mail email contact write ip host server address card visa pay number no".split()
FILLERS = "the order was sent to them on monday and we said that it is here for you".split()
WORDS = table(b" \t\x0b\x0c\r", b"\n")

# Base patterns, in forms that look at no character twice; see ``base_spans``.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# What a span of the field must hold.
NEEDED = {
    "email": re.compile(r"[^\s@<>()\[\]{},;:\"]+ ?(?:@|\[at\]|\(at\)|\{at\}) ?[^\s@<>()\[\]{},;:\"]*[^\W_]"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\{\.\}|\[dot\])[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"[0-9](?:[ ./_-]{0,3}[0-9])+"),
    "phone": re.compile(r"\+?\(?[0-9](?:[ ()./-]{0,3}[0-9])+"),
}
SAID_AT = re.compile(r"[a-zA-Z0-9][\[({]at[\])}]")
BOXED = re.compile(r"[\[({](?:\.|dot)[\])}]")
PLAIN = r"^[\pL\pM]+[.,;:!?]?$"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the usual forms, leftmost first and not overlapping within a kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            out.append((0, start, done))
        else:
            done = max(done, at + 1)  # what stands before this sign cannot belong to a later one
        at = text.find("@", at + 1)
    done = 0
    while match := IP.search(text, done):
        done = match.end()
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in match[0].split(".")):
            out.append((1, match.start(), done))
    for match in CARD.finditer(text):
        digits = only_digits(match[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *match.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


class Model(NamedTuple):
    weights: np.ndarray  # feature bucket by role (own, word before, word after) and label
    moves: np.ndarray
    start: np.ndarray


def shape(word: str) -> str:
    """Letters as x or X and digits as d, runs of them shortened, other signs as they are."""
    marks = ["d" if c in "0123456789" else "X" if "A" <= c <= "Z" else "x" if c.isalpha() else c if c < "\x80" else "u" for c in word[:64]]
    out: list[str] = []
    for mark in marks:
        most = 4 if mark == "d" else 1
        if mark not in "dxX" or out[-most:] != [mark] * most:
            out.append(mark)
    return "".join(out)


def features(word: str) -> list[int]:
    """Buckets of a word's features."""
    own, low = shape(word), word.strip(".,;:!?()\"'").lower()
    n = sum(c in "0123456789" for c in word)
    size = n if n < 8 else 8 + (n > 9) + (n > 12) + (n > 15) + (n > 19)
    short = re.sub("d+", "d", own)
    names = [
        f"shape {own[:24]}", f"short {short[:24]}", f"first {own[:3]}", f"last {own[-3:]}", f"digits {size}",
        f"dots {min(own.count('.'), 4)}", f"dashes {min(own.count('-'), 4)}", f"at {'@' in word}",
        f"said at {bool(SAID_AT.search(word))}", f"boxed dots {min(len(BOXED.findall(word)), 3)}",
        f"letters {any(m in 'xX' for m in own)} {n > 0}",
    ]
    if low in CUES:
        names.append(f"cue {low}")
    return sorted({zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS for name in names})


def item(kind: str, rng: random.Random) -> str:
    """An item of the kind, in one of its forms."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghiklmnorstuv") for _ in range(rng.randint(2, 9)))
    if kind == "email":
        host = f"{name()}{rng.choice(['', digits(1)])}.{name()}.{rng.choice(['com', 'org', 'de', 'fr'])}"
        who = name() + rng.choice(["", "." + name(), "_" + name(), digits(2), "." + digits(2)])
        odd = who + rng.choice("éäöñüß")
        return rng.choice([f"{who}@{host}", f"{who}[at]{host}", f"{who}(at){host}", f"{odd}@{host}", f"{who} @ {host}", f"{who}@{name()}é.de"])
    if kind == "ip":
        parts = [str(rng.randrange(256)) for _ in range(4)]
        return rng.choice([".", "[.]", "(.)", "[dot]"]).join(parts)
    if kind == "card":
        number = digits(15)
        number += next(d for d in "0123456789" if luhn(number + d))
        sep = rng.choice(["", " ", "-", ".", "/", " - "])
        return sep.join(number[k : k + 4] for k in range(0, 16, 4))
    a, b, c = digits(3), digits(3), digits(4)
    return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"0{a} / {b}{c}", f"00{a[:2]} {a} {b}{c}", f"0{a}-{b}{c}"])


def lookalike(rng: random.Random) -> str:
    """Something with digits or signs that is no personal data."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 16, 32, 40])))
    wrong = digits(15)
    wrong += next(d for d in "0123456789" if not luhn(wrong + d))
    return rng.choice([
        digits(rng.randint(1, 12)), digits(4), hexes, f"token = \"{hexes}\"", wrong, f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}",
        f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}",
        f"{digits(1)}.{digits(1)}.{digits(1)}", f"9{digits(2)}.{digits(3)}.9{digits(2)}.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"$ {digits(3)}.{digits(2)}", f"{digits(2)}%",
        f"({digits(4)})", f"[{digits(1)}]", f"{digits(4)}-{digits(4)}", f"{digits(4)}–{digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(2)} {digits(2)}", f"-{digits(3)}", f"{digits(3)} | {digits(3)}",
        "@", "@name", "a+b=c", "###", "$$ %%", "x[i]", "f(x)", "at", "dot", "<|end|>", "http://a.example.org/b?c=1", "C++ (1.2)", "***", "& | <> #", "1. 2. 3. 4.", "a@", "(at)",
        f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(3)}-{digits(2)}", f"#{digits(5)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(1)}-{digits(1)}", f"No. {digits(4)}",
    ])


def labelled(lines: list[list[str]], rows: int = ROWS, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The training table: words and their labels."""
    rng, out = random.Random(seed), []
    lines = [words for words in lines if words] or [FILLERS]
    for _ in range(rows):
        words, labels = [], []
        for _ in range(rng.choice((1, 1, 2, 3))):
            own = rng.choice(lines)
            at = rng.randrange(len(own))
            part = own[at : at + rng.randint(0, 12)]
            words += part
            labels += ["O"] * len(part)
            if rng.random() < 0.3:
                words.append(rng.choice(CUES) + rng.choice(["", ":", "."]))
                labels.append("O")
            if rng.random() < 0.5:
                kind = rng.choice(KINDS)
                put = (rng.choice(["", "", "", "("]) + item(kind, rng) + rng.choice(["", "", ".", ",", ")", ";"])).split()
                labels += [f"B-{kind}"] + [f"I-{kind}"] * (len(put) - 1)
            else:
                put = (lookalike(rng) + rng.choice(["", "", ".", ","])).split()
                labels += ["O"] * len(put)
            words += put
        out.append((words, labels))
    return out


def trained(rows: list[tuple[list[str], list[str]]], passes: int = 4, batch: int = 64, rate: float = 0.3, seed: int = 3) -> Model:
    """The field fitted by AdaGrad on the likelihood of the labels."""
    k, rng = len(LABELS), random.Random(seed)
    types = {w: n for n, w in enumerate(dict.fromkeys(w for words, _ in rows for w in words))}
    found = [features(w) for w in types]
    sizes = np.array([len(f) for f in found])
    flat, starts = np.concatenate(found), np.cumsum(sizes) - sizes
    weights, moves, start = np.zeros((BUCKETS, 3, k)), np.zeros((k, k)), np.zeros(k)
    for a, first in enumerate(LABELS):
        for b, then in enumerate(LABELS):
            if then[0] == "I" and first[1:] != then[1:]:
                moves[a, b] = NO_WAY
    start[[b for b, then in enumerate(LABELS) if then[0] == "I"]] = NO_WAY
    past = [np.full_like(x, 1e-3) for x in (weights, moves, start)]
    number = {label: n for n, label in enumerate(LABELS)}
    coded = [(np.array([types[w] for w in words]), np.array([number[x] for x in labels])) for words, labels in rows if words]
    for _ in range(passes):
        rng.shuffle(coded)
        for at in range(0, len(coded), batch):
            part = coded[at : at + batch]
            words, truth = np.concatenate([w for w, _ in part]), np.concatenate([y for _, y in part])
            counts = np.array([len(w) for w, _ in part])
            used, back = np.unique(words, return_inverse=True)
            index, heads = flat[ragged_index(starts[used], sizes[used])], np.cumsum(sizes[used]) - sizes[used]
            emitted = emissions(np.add.reduceat(weights[index], heads, axis=0)[back], counts)
            probable, pairs, _ = marginals(emitted, counts, moves, start)
            error = (np.eye(k)[truth] - probable) / len(part)
            edge = np.cumsum(counts)
            roles = np.zeros((len(words), 3, k))
            roles[:, 0] = error
            roles[:-1, 1] = error[1:]  # as the word before
            roles[edge[:-1] - 1, 1] = 0
            roles[1:, 2] = error[:-1]
            roles[edge[:-1], 2] = 0
            per_type = np.zeros((len(used), 3, k))
            np.add.at(per_type, back, roles)
            slope = np.zeros_like(weights)
            np.add.at(slope, index, np.repeat(per_type, sizes[used], axis=0))
            seen = np.zeros((k, k))
            inner = np.ones(len(words), bool)
            inner[edge - counts] = False
            here = np.flatnonzero(inner)
            np.add.at(seen, (truth[here - 1], truth[here]), 1)
            firsts = np.bincount(truth[edge - counts], minlength=k) - probable[edge - counts].sum(axis=0)
            for values, old, d in zip((weights, moves, start), past, (slope, (seen - pairs) / len(part), firsts / len(part)), strict=True):
                old += d * d
                values += rate * d / np.sqrt(old)
    return Model(weights.astype(np.float32), moves, start)


def emissions(roles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Scores of words from what each says of itself, of the word after it and of the word before it, within chains."""
    out = roles[:, 0].copy()
    if len(roles) > 1:
        same = np.ones(len(roles) - 1, roles.dtype)
        edges = np.cumsum(counts)[:-1]
        same[edges[(edges > 0) & (edges < len(roles))] - 1] = 0
        out[1:] += roles[:-1, 1] * same[:, None]
        out[:-1] += roles[1:, 2] * same[:, None]
    return out


def sampled(docs: DataFrame, sample: int, most_chars: int) -> list[list[str]]:
    """Lines without digits and signs of a bounded number of documents, those with the smallest hashes.

    A threshold from the number of rows lets about four times as many rows
    through as are wanted, so that tasks do not each send a whole sample.
    """
    share = min(1.0, 4 * sample / max(docs.count(), 1))
    order = F.xxhash64("doc_id", "text")
    own = docs.filter(F.col("text").isNotNull() & (F.length("text") <= most_chars)).select(order.alias("turn"), "text")
    near = own.filter(F.col("turn") <= int(share * (1 << 64)) - (1 << 63) - (share == 1.0)).dropDuplicates(["turn"])
    lines = [line for r in near.orderBy("turn").limit(sample).collect() for line in r.text.split("\n")]
    return [line.split()[:60] for line in lines if not re.search(r"[0-9@\[\]{}()]", line)]


def learned(docs: DataFrame, sample: int = SAMPLE, most_chars: int = MOST_CHARS, rows: int = ROWS) -> Model:
    return trained(labelled(sampled(docs, sample, most_chars), rows))


def field_spans(model: Model, known: Known, texts: pa.Array) -> list[tuple[int, int, int, int]]:
    """(row, kind, first byte, byte after the last) of runs of words that the field labels; bytes count from the row's start."""
    found = cut(texts, WORDS, AS_IS)
    if not len(found.words):
        return []
    coded = found.words.dictionary_encode()
    words = coded.dictionary
    # A plain word without a digit or sign is told by its first letter and its last sign alone.
    plain = pc.match_substring_regex(words, PLAIN)
    bare = pc.utf8_lower(pc.utf8_trim(words, ".,;:!?"))
    plain = pc.and_(plain, pc.invert(pc.is_in(bare, value_set=pa.array(CUES))))
    stands = pc.binary_join_element_wise(
        pc.if_else(pc.match_substring_regex(words, "^[A-Z]"), "Xx", "x"), pc.if_else(pc.match_substring_regex(words, "[.,;:!?]$"), ".", ""), ""
    )
    keys = strings(pc.if_else(plain, stands, words))

    def work_out(new: list[str]) -> list[np.ndarray]:
        return [model.weights[features(w)].sum(axis=0).ravel() for w in new]

    k = len(LABELS)
    slots = known.slots(keys, work_out)
    codes = coded.indices.to_numpy()
    roles = known.flat[: known.used].reshape(-1, 3, k)[slots]
    plain_word = plain.to_numpy(zero_copy_only=False)[codes]
    counts = chains(found.opens, plain_word)
    emitted = emissions(roles[codes], counts)
    labels = viterbi(emitted, counts, model.moves.astype(np.float32), model.start.astype(np.float32))
    sizes = pc.binary_length(found.words).to_numpy().astype(np.int64)
    hits = np.flatnonzero(labels)
    out: list[tuple[int, int, int, int]] = []
    last = -2
    for at in hits.tolist():
        kind, further = (int(labels[at]) - 1) // 2, labels[at] % 2 == 0
        row = int(found.rows[at])
        start = int(found.starts[at] - found.row_starts[row])
        end = start + int(sizes[at])
        if further and out and at == last + 1 and out[-1][0] == row and out[-1][1] == kind:
            out[-1] = (row, kind, out[-1][2], end)
        else:
            out.append((row, kind, start, end))
        last = at
    return out


def chains(opens: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Sizes of the chains: lines, long ones cut after the first plain word from CHAIN words on."""
    starts = np.append(np.flatnonzero(opens), len(opens))
    cuts = [starts]
    for a, b in zip(starts[:-1][np.diff(starts) > CHAIN].tolist(), starts[1:][np.diff(starts) > CHAIN].tolist(), strict=True):
        ends = a + np.flatnonzero(plain[a:b]) + 1
        at, more = a, []
        while (k := int(np.searchsorted(ends, at + CHAIN))) < len(ends) and ends[k] < b:
            at = int(ends[k])
            more.append(at)
        cuts.append(np.array(more, np.int64))
    return np.diff(np.unique(np.concatenate(cuts)))


def proved(kind: int, text: str, start: int, end: int) -> tuple[int, int] | None:
    """Where in a labelled span the item itself lies; None if it lacks what its kind needs."""
    match = NEEDED[KINDS[kind]].search(text, start, end)
    if not match:
        return None
    digits = only_digits(match[0])
    fits = {
        "email": True,
        "ip": all(int(p) <= 255 for p in re.findall("[0-9]+", match[0])),
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 7 <= len(digits) <= 15,
    }[KINDS[kind]]
    return match.span() if fits else None


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the numbers of pattern spans by kind, their digest, and all spans as kind:start:end."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent, tag = docs.sparkSession.sparkContext.broadcast(tuple(model)), uuid.uuid4().hex
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*sent.value)
        known = kept_in_worker("pii_words", lambda: Known(np.float32, 100_000), of=tag)
        for batch in batches:
            for rows in slices(batch, "text", 4 << 20):
                texts = rows.column("text").to_pylist()
                more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for row, of, first, last in field_spans(fitted, known, rows.column("text")):
                    raw = texts[row].encode("utf-8", "surrogatepass")
                    start = len(raw[:first].decode("utf-8", "surrogatepass"))
                    end = start + len(raw[first:last].decode("utf-8", "surrogatepass"))
                    if item_span := proved(of, texts[row], start, end):
                        more[row].append((of, *item_span))
                base = [base_spans(t) for t in texts]
                every = [merged(b, m) for b, m in zip(base, more, strict=True)]
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                digests = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(map(written, every), pa.string())], names)

    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(run, schema)


def merged(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans and those further ones that overlap none taken before."""
    taken = sorted(s[1:] for s in base)
    out = list(base)
    for kind, start, end in sorted(set(more), key=lambda s: (s[1], s[0], s[2])):
        if all(end <= a or b <= start for a, b in taken):
            out.append((kind, start, end))
            taken.append((start, end))
    return sorted(out)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in sorted(found))


def op13_pii(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return spans(docs, learned(docs))
