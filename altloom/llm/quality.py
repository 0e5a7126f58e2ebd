"""Quality rules: a table of thresholds compiled into one projection.

Each row of the table names a ratio and the range a document's value must lie
in. The table is compiled into native column expressions: no user function, no
shuffle and one pass over the text. A word is a run of characters that are not
ASCII white space; a line is what stands between line feeds.

Nulls and texts without words have 0 of everything and fail the base rule.
Texts of any length are measured whole: repeats are found by sorting the
windows of a text, not by comparing them. Repeated rows are each judged. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altloom.llm.base import SPACES, read, whole

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED = 50

# Frequent words of the languages in the corpus.
STOP_WORDS = (
    "the and of to in is that for it with as was on be at by this are from or an his not have "
    "le la les de des du et un une en que qui dans pour sur pas au avec "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine "
    "el los las que en por con para una su al lo como más"
).split()

# ratio, least, most. A bound of None is open.
RULES = [
    ("mean_word_chars", 1.5, 20.0),
    ("symbols_per_word", None, 0.6),
    ("duplicate_line_share", None, 0.3),
    ("stop_word_share", 0.02, None),
]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts the rules are made of."""
    text = whole("text")
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    w, x = F.col("words"), F.col("lines")
    hashes = F.slice(
        F.transform(w, lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0))
    )
    stop = F.filter(w, lambda a: F.lower(a).isin(STOP_WORDS))
    counted = docs.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines")).select(
        "doc_id", "words",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(stop).cast("long").alias("n_stop_words"),
        hashes.alias("hashes"),
    )
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    return counted.withColumn("n_repeat_words", F.when(some, repeat_words(F.col("words"))).otherwise(F.lit(0)).cast("long")).drop("words", "hashes")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are sorted as texts with their places; the places of those equal to
    a neighbour are sorted again, and each covers the words up to the next one,
    three at most. Only texts in which two window hashes agree come here.
    """
    windows = F.array_sort(
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda a, i: F.struct(F.concat_ws(" ", a, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
        )
    )
    def places(sorted_windows):
        same = lambda v, i, step: F.coalesce(F.get(sorted_windows, i + step)["w"] == v["w"], F.lit(False))
        hit = F.filter(sorted_windows, lambda v, i: same(v, i, 1) | (F.when(i > 0, same(v, i, -1)).otherwise(False)))
        return F.array_sort(F.transform(hit, lambda v: v["i"]))

    def covered(at):
        spans = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(spans, F.lit(0), lambda a, b: a + b)

    return bound(bound(windows, places), covered)


def bound(value: Column, use) -> Column:
    """Work ``value`` out once and hand it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "duplicate_line_share": ("n_dup_lines", "n_lines"),
    "stop_word_share": ("n_stop_words", "n_words"),
}


def compiled(rules: list[tuple[str, float | None, float | None]]) -> Column:
    """True where every rule of the table holds."""
    held = F.lit(True)
    for name, least, most in rules:
        over, under = RATIOS[name]
        value = F.col(over) / F.greatest(F.col(under), F.lit(1))
        if least is not None:
            held = held & (value >= least)
        if most is not None:
            held = held & (value <= most)
    return held


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measured(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents", "doc_id", "text"))


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce("text", '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
hit AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY rid),
m AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop_words FROM w),
j AS (SELECT m.*, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 1.5 AND 20.0 AND n_symbols / greatest(n_words, 1) <= 0.6
  AND n_dup_lines / greatest(n_lines, 1) <= 0.3 AND n_stop_words / greatest(n_words, 1) >= 0.02 AS kept
FROM b
"""
