"""Licence scan by canonical digests.

A text is brought to a canonical form: lower case, lines that only state a
copyright dropped, every run of punctuation and space one space, equivalent
spellings made one. Its digest is then looked up among the digests of known
licence texts and notices, by a hash join of entire texts. The units looked up
are whole documents and their single lines, so that both a licence file and a
one-line notice in a page are found; nothing is matched in part. No form
reaches across a line, so a document's form is that of its lines put together,
and every line is worked out once. What is kept of a document for the joins is
its digest and those lines whose short hash is one of a known text.

The table of known texts is fixed and small (`KNOWN`; a caller may give
another), which is the bound of what is broadcast.

Nulls: a null text is scanned as empty, whose canonical form is empty, and an
empty form never matches. Repeated rows and rows with one id are scanned each.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from altloom.llm.base import read, whole
from altloom.llm.license_digests import FULL_TEXTS
from altloom.session import materialize

# Spellings that count as one.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("judgement", "judgment"), ("labour", "labor"),
    ("merchantibility", "merchantability"), ("organisation", "organization"), ("organisations", "organizations"),
    ("programme", "program"), ("recognised", "recognized"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("https", "http"), ("noncommercial", "non commercial"),
]

# Known licence texts and notices.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]

COPYRIGHT = "(^|\\n)[ \\t*#/;.-]*(?:copyright|\\(c\\)|©|all rights reserved)[^\\n]*"
GAPS = "[^\\p{L}\\p{N}]+"


def canonical(text: str | Column) -> Column:
    """The canonical form. Words stand between two spaces while spellings are replaced."""
    form = F.regexp_replace(F.lower(whole(text)), COPYRIGHT, "$1")
    form = F.concat(F.lit("  "), F.regexp_replace(form, GAPS, "  "), F.lit("  "))
    for spelling, one in SPELLINGS:
        form = F.replace(form, F.lit(f" {spelling} "), F.lit(f" {one} "))
    return F.trim(F.regexp_replace(form, " +", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """license and known_sha of every known text; one licence per digest."""
    texts = spark.createDataFrame(known, "license string, known_text string")
    forms = texts.select("license", canonical("known_text").alias("form")).filter("form <> ''")
    return forms.groupBy(F.sha2("form", 256).alias("known_sha")).agg(F.min("license").alias("license"))


def all_digests(spark: SparkSession) -> DataFrame:
    """The notices of ``KNOWN`` and the full licence texts, whose digests are shipped."""
    full = spark.createDataFrame(FULL_TEXTS, "license string, known_sha string, form_chars int").drop("form_chars")
    return known_digests(spark).unionByName(full)


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, canon_sha256, license (of the whole text) and notices (licences of whole lines) of each document."""
    table = F.broadcast(known)  # fixed and small
    short = [r[0] for r in known.select(F.xxhash64("known_sha")).collect()]
    forms = F.filter(F.transform(F.split(whole("text"), "\n"), canonical), lambda form: form != "")
    digests = F.transform("forms", lambda form: F.sha2(form, 256))
    hits = F.filter(digests, lambda digest: F.xxhash64(digest).isin(short))
    rows = materialize(
        docs.select("doc_id", forms.alias("forms")).select(
            F.monotonically_increasing_id().alias("row"), "doc_id",
            F.sha2(F.array_join("forms", " "), 256).alias("canon_sha256"), hits.alias("hits"),
        )
    )
    found = rows.select("row", F.explode("hits").alias("digest")).join(table, F.col("digest") == F.col("known_sha"))
    notices = found.groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count("*").alias("n_notices")
    )
    looked_up = rows.drop("hits").join(table, F.col("canon_sha256") == F.col("known_sha"), "left")
    return looked_up.join(notices, "row", "left").select(
        "doc_id", "canon_sha256", "license", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents", "doc_id", "text"), all_digests(spark))


def canonical_sql(text: str) -> str:
    form = f"regexp_replace(lower({text}), '{COPYRIGHT}', '\\1', 'g')"
    form = f"'  ' || regexp_replace({form}, '{GAPS}', '  ', 'g') || '  '"
    for spelling, one in SPELLINGS:
        form = f"replace({form}, ' {spelling} ', ' {one} ')"
    return f"trim(regexp_replace({form}, ' +', ' ', 'g'))"


_VALUES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
OP2_SQL = f"""
WITH known AS (SELECT min(license) AS license, sha FROM (
    SELECT license, sha256({canonical_sql("t")}) AS sha FROM (VALUES {_VALUES}) k(license, t)) GROUP BY sha),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce("text", '') AS t FROM documents),
lines AS (SELECT rid, {canonical_sql("line")} AS form FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)),
notices AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n
    FROM lines JOIN known ON sha256(form) = sha WHERE form <> '' GROUP BY rid),
wholes AS (SELECT rid, doc_id, sha256({canonical_sql("t")}) AS canon_sha256 FROM d)
SELECT w.doc_id, canon_sha256, license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices
FROM wholes w LEFT JOIN known ON canon_sha256 = sha LEFT JOIN notices USING (rid)
"""
