"""Exact duplicates by a tree-merge of sorted digest runs.

Every text is replaced where it is scanned by the digest of its normal form,
and each partition folds what it holds into a sorted run: one row per digest
with the smallest id and a count. The runs are then merged in binomial rounds.
A bucket is named by digits; a run starts with the digits of the partition
that made it. In each round the buckets that differ only in one source digit
meet, and swap it for a digit of the digest: after the last round a bucket
holds a slice of the digests of all partitions. At each level equal digests
merge into one row, so that a digest shared by a third of all rows reaches any
task as at most one row per run that meets there.

A merge is verified: the key is the SHA-256 with the length and a second,
independent digest of the text. Texts that agree in one and differ in another
stay apart.

Nulls: a null text counts as empty; null ids are larger than any other. Rows
with the same id and the same text are the same document: all are marked as
the one that stays, and count in the group's size. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altloom.llm.base import SPACES, picked, read, whole
from altloom.session import materialize

ROUNDS = 2
KEY = ["sha", "bytes", "check"]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest key of the normalised text and the partition that holds the row."""
    normal = docs.select("doc_id", F.regexp_replace(whole("text"), SPACES, " ").alias("normal"))
    return normal.select(
        "doc_id", F.unhex(F.sha2("normal", 256)).alias("sha"), F.octet_length("normal").alias("bytes"),
        F.xxhash64("normal").alias("check"), F.spark_partition_id().alias("part"),
    )


def tree_merge(rows: DataFrame, rounds: int = ROUNDS, fan_in: int | None = None) -> DataFrame:
    """One row per key: ``keep_id`` and ``group_size``, merged in ``rounds`` rounds of ``fan_in`` runs each.

    There are ``fan_in`` to the power of ``rounds`` buckets; by default about as
    many as the session has shuffle partitions.
    """
    if fan_in is None:
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        fan_in = max(2, math.ceil(partitions ** (1 / rounds)))
    buckets = fan_in**rounds
    part = F.pmod(F.col("part"), F.lit(buckets)).cast("int")
    digit = F.conv(F.substring(F.hex("sha"), 1, 8), 16, 10).cast("long")
    runs = rows.groupBy(*KEY, part.alias("bucket")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    for level in range(rounds):
        step = fan_in**level
        own = F.floor(F.col("bucket") / step) % fan_in
        swapped = F.col("bucket") - own * step + F.floor(digit / step) % fan_in * step
        met = runs.withColumn("bucket", swapped.cast("int")).repartitionById(buckets, F.col("bucket"))
        runs = (
            met.sortWithinPartitions("bucket", *KEY)
            .groupBy("bucket", *KEY)
            .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
    return runs.drop("bucket")


def duplicates(docs: DataFrame, rounds: int = ROUNDS, fan_in: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row.

    The digests are written once: the merge and the marks read them from there.
    """
    rows = materialize(digests(docs))
    groups = tree_merge(rows, rounds, fan_in).select(*[F.col(c).alias(f"of_{c}") for c in KEY], "keep_id", "group_size")
    same = [F.col(c) == F.col(f"of_{c}") for c in KEY]
    return rows.join(groups, same).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each text, with the columns of ``docs``."""
    stays = duplicates(docs).filter("kept").select("doc_id", F.unhex("text_sha256").alias("__sha"))
    sha = F.unhex(F.sha2(F.regexp_replace(whole("text"), SPACES, " "), 256))
    return picked(docs.withColumn("__sha", sha), stays, ["doc_id", "__sha"]).select(*docs.columns)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


OP9_SQL = """
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce("text", ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
