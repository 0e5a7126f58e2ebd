"""Streams run to the end of what is there, and compared with their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from altloom import views
from altloom.plans.ordered_queries import BREAKER_SQL
from altloom.plans.registry import query
from altloom.plans.source_queries import FILES_SQL, files_by_lang, folder, text_files
from altloom.streaming import jobs


STRETCHES = 4


def arrivals(spark, sf_dir, name, at, place):
    """A table as it arrives: one stretch of time after the other, each in as many files as Spark deals it to."""
    table = views.table(spark, sf_dir, name)
    first, last = table.agg(F.min(at), F.max(at)).first()
    for part in range(STRETCHES):
        start, end = (first + (last - first) * k / STRETCHES for k in (part, part + 1))
        rows = table.filter((F.col(at) >= F.lit(start)) & ((F.col(at) < F.lit(end)) if part + 1 < STRETCHES else F.lit(True)))
        rows.repartitionByRange(at).write.mode("append").parquet(place)
        yield part


def streamed(spark, sf_dir, name, view, at, start) -> None:
    """Run a stream over a view of an arriving table; it goes on from its checkpoint as each stretch arrives."""
    place = folder(spark, f"arriving-{name}")
    schema = views.table(spark, sf_dir, name).schema
    for _ in arrivals(spark, sf_dir, name, at, place):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1 << 30).parquet(place)
        clock = {f.name: F.col(f.name).cast("timestamp") for f in rows.schema if f.dataType.simpleString() == "timestamp_ntz"}
        start(view(rows.withColumns(clock))).awaitTermination()


def results(spark, sf_dir, name, view, at, label):
    """What a stream over an arriving table appends."""
    root, state = folder(spark, label), folder(spark, f"{label}-state")
    streamed(spark, sf_dir, name, view, at, lambda df: jobs.write_each(df, root, state))
    return plain_clock(spark.read.parquet(root)).drop("batch")


def plain_clock(df):
    """Times as the stored tables have them, without a zone."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.simpleString() == "timestamp"})


@query("stream_files_n01", FILES_SQL)
def stream_files(spark, sf_dir):
    seen = jobs.stream_files(spark, text_files(spark, sf_dir), "txt", per_trigger=3).select("path", "length")
    root = folder(spark, "files")
    jobs.write_each(seen, root, folder(spark, "files-state")).awaitTermination()
    return files_by_lang(spark.read.parquet(root).drop("batch"))


@query(
    "stream_dedupe_n02",
    """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_type, n, ts, ts AS kept, true AS first FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_type, e.n, e.ts, CASE WHEN e.ts >= r.kept + INTERVAL 5 DAY THEN e.ts ELSE r.kept END, e.ts >= r.kept + INTERVAL 5 DAY FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1)
SELECT user_id, event_type, min(ts) AS first_seen FROM r WHERE first GROUP BY 1, 2""",
)
def stream_dedupe(spark, sf_dir):
    root, state = folder(spark, "dedupe"), folder(spark, "dedupe-state")

    def keyed(events):
        return events.select("ts", "user_id", "event_type").withColumn("content_key", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))

    streamed(spark, sf_dir, "events", keyed, "ts", lambda df: jobs.stream_dedupe(df, "content_key", "ts", "5 days", root, state))
    found = plain_clock(spark.read.parquet(root)).drop("batch")
    return found.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"))


@query(
    "stream_budget_n03",
    f"""WITH {views.ATTEMPTS_SQL}, d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, CAST(sum(CAST(cost AS DECIMAL(20,6))) AS DOUBLE) AS c FROM attempts GROUP BY 1)
SELECT day, round(c, 6) AS daily_cost, c > 4 AS daily_alert FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM attempts) - INTERVAL 1 HOUR""",
)
def stream_budget(spark, sf_dir):
    return results(spark, sf_dir, "events", lambda e: jobs.stream_budget(views.attempts_of(e), 4.0), "ts", "budget")


@query(
    "stream_outages_n04",
    f"""WITH {views.ATTEMPTS_SQL}, f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY provider ORDER BY ts, attempt_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM attempts WHERE NOT success),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY provider ORDER BY ts, attempt_id) AS session FROM f)
SELECT provider, min(ts) AS started, max(ts) + INTERVAL 10 MINUTE AS ended, count(*) AS failures FROM s GROUP BY provider, session
HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM attempts WHERE NOT success) - INTERVAL 1 HOUR""",
)
def stream_outages(spark, sf_dir):
    return results(spark, sf_dir, "events", lambda e: jobs.stream_outages(views.attempts_of(e)), "ts", "outages")


@query("stream_breaker_n05", BREAKER_SQL)
def stream_breaker(spark, sf_dir):
    root, state = folder(spark, "breaker"), folder(spark, "breaker-state")
    streamed(spark, sf_dir, "events", views.attempts_of, "ts", lambda df: jobs.stream_breaker(df, root, state, 3, 60.0, 2))
    return plain_clock(spark.read.parquet(root)).drop("batch")


@query(
    "stream_ledger_n06",
    "SELECT CAST(o_custkey AS VARCHAR) AS path, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) AS status, max(o_orderdate) AS updated_at FROM orders GROUP BY 1",
)
def stream_ledger(spark, sf_dir):
    def updates(orders):
        return orders.select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))

    root, state = folder(spark, "ledger"), folder(spark, "ledger-state")
    streamed(spark, sf_dir, "orders", updates, "o_orderdate", lambda df: jobs.stream_ledger(df, root, state))
    return plain_clock(jobs.newest_version(spark, root))
