"""Mixing sources to target weights by capped water-filling.

Every source is given its share of all words by weight. A source may be read
``epochs`` times at most: one whose share lies above that is clamped there,
and what it cannot take is shared among the others by their weights, until no
share is above its clamp. A source's share over its size is its number of
repetitions: every document is taken that many whole times, and the fraction
that is left is made up of the first documents in a seeded order.

The table of sources stays distributed: each round of the filling is a sum
that brings one row to the driver. The seeded order of a source is cut into
buckets by the head of the digest that gives the order, so that a source with
a third of all rows is summed and ordered in many tasks.

Nulls: a null text has size 0; a null source is a source of its own, last in
order; a null id is ordered like any other. Documents of size 0 take 0 words.
Repeated rows are each counted. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altloom.llm.base import WORD, read, whole
from altloom.operators.prefix import numbered
from altloom.session import materialize

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17


def sizes(docs: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the further named columns and number of words of each document."""
    return docs.select(
        "doc_id", "source", *names, F.regexp_count(whole("text"), F.lit(WORD)).cast("long").alias("size"),
    )


def source_table(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: words, weight by place in code point order, null last."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    keyed = totals.withColumns({"is_null": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    placed = numbered(keyed, [], ["is_null", "name"], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    return materialize(placed.select("source", "source_size", weight.cast("long").alias("weight")))


def fill(sources: DataFrame, epochs: int) -> DataFrame:
    """Add ``target``: clamp, reshare, and go on until no source changes.

    Sums are whole numbers, so every run and every order of adding gives the
    same targets.
    """
    cap = F.col("source_size") * epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    mass, weight, clamped = total, None, F.lit(False)
    while True:
        free, count = sources.filter(~clamped).agg(F.sum("weight"), F.count("*")).first()
        if not count:
            break
        mass, weight = total - (sources.filter(clamped).agg(F.sum(cap)).first()[0] or 0), free
        over = F.col("weight") * F.lit(mass).cast("decimal(19,0)") > cap * F.lit(weight).cast("decimal(19,0)")
        if not sources.filter(~clamped & over).limit(1).count():
            break
        clamped = clamped | over
    if weight is None:
        return sources.withColumn("target", cap.cast("double"))
    share = F.col("weight") * F.lit(float(mass)) / F.lit(float(weight))
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, names: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and the further named columns for every document."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = materialize(sizes(docs, names).withColumn("order", order))
    targets = fill(source_table(sized, weights), epochs)
    plan = targets.select(
        F.col("source").alias("of"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole_times"),
    ).withColumn("rest", F.col("target") - F.col("whole_times") * F.col("source_size"))

    bucket = F.substring("order", 1, 3)
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).join(
        plan, F.col("source").eqNullSafe(F.col("of"))
    )
    starts = starts.select(F.col("of").alias("b_source"), F.col("bucket").alias("b_bucket"), "before", "source_size", "target", "whole_times", "rest")

    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", *names).rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.withColumn("bucket", bucket).withColumn("upto", F.sum("size").over(within))
    joined = rows.join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    return joined.select("doc_id", "source", *names, "size", "source_size", "target", copies().alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size")
    )


def copies() -> Column:
    """Whole repetitions, and one more for the documents that make up the rest.

    The document at the boundary is taken if that brings the sum nearer.
    """
    middle = F.col("before") + F.col("upto") - F.col("size") / 2
    return (F.col("whole_times") + ((F.col("size") > 0) & (middle <= F.col("rest"))).cast("int")).cast("long")


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every document as often as it is taken.

    Documents are matched with their rows of the mix by id, source and digest
    of the text, as ids may be missing or shared. Rows that agree in all three
    share the sum of their copies as evenly as whole copies allow.
    """
    key = ["doc_id", "source", "__sha"]
    named = docs.withColumn("__sha", F.unhex(F.sha2(whole("text"), 256)))
    of = mix(named, **settings, names=("__sha",)).groupBy(F.struct(*key).alias("__of")).agg(
        F.sum("copies").alias("__copies"), F.count("*").alias("__rows")
    )
    found = named.withColumn("__key", F.struct(*key)).join(of, F.col("__key") == F.col("__of")).filter("__copies > 0")
    place = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    own = F.floor((F.col("__copies") + F.col("__rows") - F.col("__place")) / F.col("__rows")).cast("int")
    times = found.withColumn("__place", place).withColumn("__own", own).filter("__own > 0")
    return times.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__own")))).select(*docs.columns)


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = """
WITH sized AS (SELECT doc_id, source, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
  CAST(len(regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM totals),
ranked AS (SELECT *, 3 * source_size / weight AS level, CAST(sum(source_size) OVER () AS BIGINT) AS total,
  sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) - 3 * source_size AS held,
  sum(weight) OVER (ORDER BY 3 * source_size / weight DESC, source DESC NULLS FIRST) AS free FROM placed),
water AS (SELECT CAST(total - held AS DOUBLE) AS mass, CAST(free AS DOUBLE) AS free FROM ranked
  WHERE weight * (total - held) <= 3 * source_size * free ORDER BY level, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, least(weight * mass / free, CAST(3 * source_size AS DOUBLE)) AS target FROM placed, water),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
lined AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size) AS upto FROM sized)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (
  SELECT l.doc_id, l.size, p.source_size, p.target,
    CAST(p.whole + CASE WHEN l.size > 0 AND l.upto - l.size / 2 <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM lined l JOIN plan p ON l.source IS NOT DISTINCT FROM p.source)
"""
