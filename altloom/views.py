"""The engine's tables, derived from the driver tables by plain arithmetic.

Shape ids restart on every slide and keys repeat in every deck, as a scan of real
decks gives them; ``uid`` is the row they were made from.

``*_SQL`` holds the same definition for the check engine. A deck holds 48
elements on 4 slides, so deck and slide groups stay bounded as data grows; the
texts are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE_TYPES = ["PICTURE", "AUTO_SHAPE", "TEXT_BOX", "LINE", "CONNECTOR", "TABLE", "PLACEHOLDER", "CHART"]
SHAPE_NAMES = [
    "Picture", "company logo", "Straight Arrow", "Title", "border line", "Chart",
    "Heart diagram", "Text Box", "Freeform", "Footer Placeholder", "accent bar",
]
FILLS = ["solid", "none", "gradient", "picture"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name)


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visual element."""
    d = texts(spark, sf_dir, "documents", "doc_id")
    i, text = F.col("doc_id"), F.col("text")
    shape_idx = i % 12
    shape_type = F.when(shape_idx < 3, "GROUP").otherwise(pick(SHAPE_TYPES, i))
    return d.select(
        i.alias("uid"),
        (shape_idx + 2).alias("shape_id"),
        F.concat(F.lit("deck_"), F.floor(i / 48).cast("string")).alias("deck"),
        (F.floor(i / 12) % 4).cast("int").alias("slide_idx"),
        shape_idx.cast("int").alias("shape_idx"),
        F.concat(F.lit("slide_"), (F.floor(i / 12) % 4).cast("string"), F.lit("_shape_"), (shape_idx + 2).cast("string")).alias("instance_key"),
        shape_type.alias("shape_type"),
        F.when(shape_idx > 0, F.floor((shape_idx - 1) / 4) + 2).alias("parent_id"),
        F.concat(pick(SHAPE_NAMES, i), F.lit(" "), i.cast("string")).alias("shape_name"),
        pick(FILLS, i).alias("fill_kind"),
        (i % 3 != 1).alias("has_line"),
        ((i * 37) % 900).cast("int").alias("width"),
        ((i * 53) % 700).cast("int").alias("height"),
        ((i * 71) % 960).cast("int").alias("left"),
        ((i * 29) % 720).cast("int").alias("top"),
        F.sha2(text, 256).alias("content_key"),
        F.md5(text).alias("image_hash"),
        F.when(i % 3 == 0, text).when(i % 13 == 1, "Picture").otherwise("").alias("existing_alt"),
        F.when(i % 11 == 3, "Error: request failed").when(i % 5 != 0, F.concat(F.lit("This image shows "), text))
        .otherwise("").alias("generated_alt"),
        F.when(i % 7 == 0, F.concat(text, F.lit(" Reviewed."))).alias("final_alt"),
        F.when(shape_type.isin("TEXT_BOX", "AUTO_SHAPE", "PLACEHOLDER"), text).otherwise("").alias("text"),
        text.alias("slide_text"),
        F.concat_ws(" ", "source", "lang").alias("slide_notes"),
    )


ELEMENTS_SQL = """elements AS (
  SELECT *, sha256(body) AS content_key, md5(body) AS image_hash,
    CASE WHEN uid % 3 = 0 THEN body WHEN uid % 13 = 1 THEN 'Picture' ELSE '' END AS existing_alt,
    CASE WHEN uid % 11 = 3 THEN 'Error: request failed' WHEN uid % 5 <> 0 THEN 'This image shows ' || body ELSE '' END AS generated_alt,
    CASE WHEN uid % 7 = 0 THEN body || ' Reviewed.' END AS final_alt,
    CASE WHEN shape_type IN ('TEXT_BOX','AUTO_SHAPE','PLACEHOLDER') THEN body ELSE '' END AS "text",
    body AS slide_text
  FROM (
    SELECT doc_id AS uid, doc_id % 12 + 2 AS shape_id, 'deck_' || (doc_id // 48) AS deck,
      CAST((doc_id // 12) % 4 AS INT) AS slide_idx, CAST(doc_id % 12 AS INT) AS shape_idx,
      'slide_' || ((doc_id // 12) % 4) || '_shape_' || (doc_id % 12 + 2) AS instance_key,
      CASE WHEN doc_id % 12 < 3 THEN 'GROUP' ELSE
        ['PICTURE','AUTO_SHAPE','TEXT_BOX','LINE','CONNECTOR','TABLE','PLACEHOLDER','CHART'][doc_id % 8 + 1] END AS shape_type,
      CASE WHEN doc_id % 12 > 0 THEN (doc_id % 12 - 1) // 4 + 2 END AS parent_id,
      CASE WHEN doc_id % 12 > 0 THEN doc_id - doc_id % 12 + (doc_id % 12 - 1) // 4 END AS parent_uid,
      ['Picture','company logo','Straight Arrow','Title','border line','Chart','Heart diagram','Text Box','Freeform',
       'Footer Placeholder','accent bar'][doc_id % 11 + 1] || ' ' || doc_id AS shape_name,
      ['solid','none','gradient','picture'][doc_id % 4 + 1] AS fill_kind, doc_id % 3 <> 1 AS has_line,
      CAST((doc_id * 37) % 900 AS INT) AS width, CAST((doc_id * 53) % 700 AS INT) AS height,
      CAST((doc_id * 71) % 960 AS INT) AS "left", CAST((doc_id * 29) % 720 AS INT) AS top,
      documents.text AS body, source || ' ' || lang AS slide_notes
    FROM documents))"""


def tangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as damaged files give them: repeated ids, groups inside themselves, circles, lost parents."""
    e = elements(spark, sf_dir)
    slide, at = F.floor(F.col("uid") / 12), F.col("shape_idx")
    return e.withColumns({
        "shape_id": F.when((slide % 3 == 0) & at.isin(3, 6, 9), F.col("shape_id") - 1).otherwise(F.col("shape_id")),
        "parent_id": F.when((slide % 5 == 1) & (at == 2), F.col("shape_id"))
        .when((slide % 7 == 2) & (at == 1), F.lit(7))
        .when((slide % 4 == 3) & (at == 9), F.lit(99))
        .when((slide % 6 == 0) & (at == 3), F.lit(4)).otherwise(F.col("parent_id")),
    })


TANGLED_SQL = f"""{ELEMENTS_SQL}, tangled AS (SELECT * REPLACE (
    CASE WHEN (uid // 12) % 3 = 0 AND shape_idx IN (3, 6, 9) THEN shape_id - 1 ELSE shape_id END AS shape_id,
    CASE WHEN (uid // 12) % 5 = 1 AND shape_idx = 2 THEN shape_id WHEN (uid // 12) % 7 = 2 AND shape_idx = 1 THEN 7
      WHEN (uid // 12) % 4 = 3 AND shape_idx = 9 THEN 99 WHEN (uid // 12) % 6 = 0 AND shape_idx = 3 THEN 4 ELSE parent_id END AS parent_id)
  FROM elements),
parented AS (SELECT c.uid, any_value(c.deck) AS deck, any_value(c.slide_idx) AS slide_idx, any_value(c.shape_idx) AS shape_idx, any_value(c.shape_id) AS shape_id,
    any_value(c.parent_id) AS parent_id, arg_min(o.uid, o.shape_idx) AS up
  FROM tangled c LEFT JOIN tangled o ON o.deck = c.deck AND o.slide_idx = c.slide_idx AND o.shape_id = c.parent_id AND o.uid <> c.uid GROUP BY c.uid)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per provider call."""
    return attempts_of(table(spark, sf_dir, "events"))


def attempts_of(events: DataFrame) -> DataFrame:
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("attempt_id"),
        "ts",
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("provider"),
        (~failed).alias("success"),
        F.when(~failed, 200).when(F.col("event_id") % 5 == 0, 404).otherwise(503).alias("status_code"),
        F.when(failed & (F.col("event_id") % 7 == 0), "Unauthorized request")
        .when(failed & (F.col("event_id") % 3 == 0), "connection timeout")
        .when(failed, "server error").alias("error"),
        F.col("value").alias("seconds"),
        (F.col("value") / 1000).alias("cost"),
        F.get_json_object("props", "$.k").cast("int").alias("tokens"),
    )


ATTEMPTS_SQL = """attempts AS (
  SELECT event_id AS attempt_id, ts, 'p' || (user_id % 4) AS provider, event_type <> 'error' AS success,
    CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 5 = 0 THEN 404 ELSE 503 END AS status_code,
    CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 7 = 0 THEN 'Unauthorized request'
         WHEN event_id % 3 = 0 THEN 'connection timeout' ELSE 'server error' END AS error,
    value AS seconds, value / 1000 AS cost, CAST(json_extract_string(props, '$.k') AS INT) AS tokens
  FROM events)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per work item."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("in/"), k.cast("string"), F.lit(".pptx")).alias("path"),
        F.when(s == "F", "complete").when(s == "O", "pending").when(k % 3 == 0, "failed")
        .when(k % 3 == 1, "skipped").otherwise("processing").alias("status"),
        F.col("o_orderdate").alias("added_at"),
        F.col("o_totalprice").alias("bytes"),
    )


LEDGER_SQL = """ledger AS (
  SELECT 'in/' || o_orderkey || '.pptx' AS path,
    CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'pending'
         WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 3 = 1 THEN 'skipped' ELSE 'processing' END AS status,
    o_orderdate AS added_at, o_totalprice AS bytes
  FROM orders)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey grids: every vector and a near copy of it."""
    e = table(spark, sf_dir, "embeddings")
    flipped = F.transform("embedding", lambda x, n: F.when(n < 3, -x).otherwise(x))
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("cells")).unionByName(
        e.select((F.col("vec_id") + 1000000000000).alias("id"), flipped.alias("cells"))
    )


GRIDS_SQL = """grids AS (
  SELECT vec_id AS id, embedding AS cells FROM embeddings
  UNION ALL
  SELECT vec_id + 1000000000000, list_transform(embedding, lambda x, i: CASE WHEN i <= 3 THEN -x ELSE x END) FROM embeddings)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several texts per key, in order."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.col("role").alias("source"), "text"
    )


CANDIDATES_SQL = "candidates AS (SELECT conv_id AS key, turn AS seq, role AS source, text FROM conversations)"
