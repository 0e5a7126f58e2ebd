"""Golden cases and properties of the text rules."""

import random
import time

import pytest
from pyspark.sql import functions as F

from altloom.functions import gates, text
from altloom.operators import reuse


def test_end_mark(one):
    assert one(text.end_mark, "A blue square.", "A red circle", "  ", "Hi!", None, " x\n") == [
        "A blue square.", "A red circle.", "", "Hi!", "", "x."
    ]


def test_universal_joins_and_keeps_marks_odd(one):
    assert one(text.normalize_universal, "Hi! Bye.", "one. One. one two three.", "a b. c d. xx a b yy.", "") == [
        "Hi!. Bye.", "One two three.", "C d. xx a b yy.", ""
    ]


def test_universal_boilerplate(one):
    got = one(
        text.normalize_universal,
        "This is a PowerPoint shape. It is a chart showing data",
        "This is a PowerPoint shape. It is a line here",
        "A shape (1x2px) A shape (1x2px) rest",
        "A shape (3x4px) This is a PowerPoint shape with text",
    )
    assert got == [
        "Chart showing data.", "This is a PowerPoint line here.", "A shape (1x2px) rest.", "This is a PowerPoint shape with text."
    ]


def test_universal_equals_the_fold(one):
    rng = random.Random(3)
    words = ["aa", "bb", "cc", "dd"]
    cases = [
        ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 8))) + "."
        for _ in range(200)
    ]

    def fold(t):
        kept = []
        for p in (s.strip(" .") for s in t.replace(". ", ".\n").split("\n")):
            if any(p == k or (p in k and len(p) <= len(k)) for k in kept):
                continue
            kept = [k for k in kept if k not in p] + [p]
        done = ". ".join(kept) + "."
        return done[0].upper() + done[1:]

    assert one(text.normalize_universal, *cases) == [fold(c) for c in cases]


def test_collapse_repeats(one):
    got = one(
        text.collapse_repeats,
        "A shape (9x9px) This is a PowerPoint shape. It is red A shape (9x9px)",
        "a (9x9px) (9x9px) b",
        "Vector flow diagram here. Vector flow diagram here.",
        "WMF picture of a WMF file",
        "x .. y , z",
        "This is a PowerPoint shape a. This is a PowerPoint shape longer.",
    )
    assert got == [
        "This is a PowerPoint shape. It is red.", "a (9x9px) b.", "Vector flow diagram here.", "WMF picture of a file.",
        "x. y, z.", "This is a PowerPoint shape longer.",
    ]


def test_finalize(one):
    assert one(text.finalize_alt, "n/a", "(hello", "(a b)", "12 apples", None) == ["", "(Hello.", "(A b)", "12 Apples.", ""]


def test_vague_prefix(one):
    got = one(text.strip_vague_prefix, "This image shows a cat", "The image shows with text related to .atoms", "A slide, of x", "plain")
    assert got == ["A cat", "Educational diagram related to atoms", "Of x", "Plain"]


def test_truncate(one):
    long = "word " * 80
    texts = ["x" * 400, "A. " + "b" * 400, "a" * 300 + ", " + "b" * 50, long]
    got = one(text.truncate_sentence, *texts)
    assert [g["text"] for g in got[:3]] == ["x" * 320 + ".", "A.", "a" * 300 + "."]
    assert all(g["truncated"] for g in got)
    assert len(got[3]["text"]) <= 321


def test_lengths_and_idempotence(one):
    rng = random.Random(5)
    letters = "ab cd. ef, gh; ij! kl? \n"
    cases = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 500))) for _ in range(100)]
    for cut in one(text.shrink, *cases):
        assert len(cut) <= 126
    once = one(text.end_mark, *cases)
    assert one(text.end_mark, *once) == once
    assert all(o == "" or o[-1] in ".!?" for o in once)


def test_titles_and_keys(one):
    assert one(text.short_title, "This is a PowerPoint shape. It is round", "FALLBACK: grey box", "") == ["Round.", "Grey box.", ""]
    assert one(text.compare_key, "hello  Medical WORLD!!", "") == ["Hello Medical world.", ""]


def test_gates(one):
    assert one(gates.is_meaningful, "N/A", "Picture ", "A cat", None, "") == [False, False, True, False, False]
    assert one(gates.is_skip_value, "N/A", "n/A", "", None, " undefined ") == [True, False, True, True, True]
    assert one(gates.passes_gate, "imagery of birds", "a blue. thing", "a blue thing", "birds") == [False, False, True, True]
    assert one(gates.passes_lenient, "[Generated description not available]", "failed to x") == [True, False]
    assert one(gates.is_placeholder, "a picture of", "ok (3 x 4 px)", "Une étoile brille ici.", "été") == [True, True, False, True]


def test_best_text(spark):
    df = spark.createDataFrame([(["A box (1x1px)", "a box (2x2px)", "an arrow icon", None, " "],)], "t array<string>")
    assert df.select(text.best_text("t")).first()[0] == "an arrow icon."


def test_best_text_per_key_equals_the_array_form(spark):
    rng = random.Random(9)
    pool = ["A box (1x1px)", "a box (2x2px)", "an arrow icon", " ", "(3x3px)", "This is a powerpoint shape", "x" * 30, None, "logo and chart"]
    rows = [(k, n, rng.choice(pool)) for k in range(60) for n in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "k int, n int, t string")
    arrays = df.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda p: p["t"]).alias("ts"))
    want = {r[0]: r[1] for r in arrays.select("k", text.best_text("ts")).collect()}
    got = dict(map(tuple, reuse.best_text_per_key(df, "k", "n", "t").collect()))
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == "" for k in want.keys() - got.keys())


def test_punctuation(spark):
    df = spark.createDataFrame([("a.", "a"), ("a.", "a!"), ("a", "b"), ("", "b"), ("a..", "a.")], "e string, a string")
    got = [r[0]["reason"] for r in df.select(gates.punct_diff("e", "a")).collect()]
    assert got == [
        "terminal_punctuation_mismatch", "different_terminal_punctuation", "no_punctuation_issue", "empty_text",
        "punctuation_only_difference",
    ]


def test_dedupe_token(spark):
    df = spark.createDataFrame([("WMF format of a WMF format",)], "t string")
    assert df.select(text.dedupe_token(F.col("t"), "WMF")).first()[0] == "WMF format of a"


def test_sentences_of_long_texts(spark):
    """Ten thousand sentences take about ten times as long as a thousand; short, repeated and held ones still go."""
    import time

    from pyspark.sql import functions as F

    rng = random.Random(3)
    def sentence():
        return " ".join(f"w{rng.randrange(10**5)}" for _ in range(9)) + "."

    took = {}
    for n in (1000, 10_000):
        own = [sentence() for _ in range(n)]
        held = own[5][own[5].index(" ") + 1 : own[5].rindex(" ")]
        words = " ".join([*own, own[7], held + ".", "w1.", own[3].upper()])
        df = spark.createDataFrame([(words,)], "t string")
        began = time.perf_counter()
        found = df.select(text.unique_sentences("t")).first()[0]
        took[n] = time.perf_counter() - began
        assert found[:n] == [s.rstrip(".") for s in own] and len(found) <= n + 1
    assert took[10_000] < 40 * took[1000] + 5


@pytest.mark.parametrize("seed", range(3))
def test_held_sentences_equal_plain_search(one, seed):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "b", "the", "of", "x"]
    texts = [". ".join(" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(rng.randint(1, 25))) + "." for _ in range(150)]

    def plain(t):
        parts = [p for p in (s.strip(" .") for s in t.split(". ")) if p]
        low = [p.lower() for p in parts]
        return [p for n, p in enumerate(parts) if low.index(low[n]) == n and not any(low[n] in q and q != low[n] for q in low)]

    assert one(text.unique_sentences, *texts) == [plain(t) for t in texts]


def test_universal_searches_only_where_a_piece_is_repeated(one):
    """Forty thousand sentences of four words: none is looked for in all the others, and the held ones go."""
    sentences = [f"to a{n} e{n * 7} do" for n in range(40000)]
    held = ["to a5 e35 d", "a77 e539 do", "o a9 e63 do"]
    start = time.perf_counter()
    got = one(text.normalize_universal, ". ".join([*held, *sentences]) + ".")
    assert got == ["T" + ". ".join(sentences)[1:] + "."]
    assert time.perf_counter() - start < 20


def test_universal_takes_control_characters_as_text(one):
    """A sentence of one control character is not lost between two others."""
    assert one(text.normalize_universal, "One here. \x01. Two there.") == ["One here. \x01. Two there."]


def test_equal_but_for_spacing(one):
    """Texts that differ in spacing only are equal, and what differs otherwise is still compared in normal form."""
    texts = ["a b. c d.", " \n", None, "One. two!"]
    spaced = lambda c: gates.equivalent(c, F.regexp_replace(c, " ", " \t "))
    assert one(spaced, *texts) == [True, True, True, True]
    assert one(lambda c: gates.equivalent(c, F.concat(F.lower(c), F.lit(" ONE."))), "One.", "Two.") == [True, False]
