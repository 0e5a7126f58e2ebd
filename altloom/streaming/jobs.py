"""Structured Streaming jobs over files, elements and provider calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altloom.operators import breaker
from altloom.operators.ordered import MONEY
from altloom.operators.reuse import latest
from altloom.session import materialize

BUCKETS = 64


def stream_files(spark: SparkSession, path: str, exts: str = "[pP][pP][tT][xX]", per_trigger: int = 1000) -> DataFrame:
    """New files under a folder, each once; the checkpoint is the memory."""
    fields = "path string, modificationTime timestamp, length bigint, content binary"
    return (
        spark.readStream.format("binaryFile").schema(fields).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{exts}").option("maxFilesPerTrigger", per_trigger).load(path)
    ).filter(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType, per_trigger: int = 64) -> DataFrame:
    """A table as a stream of files; the number of files bounds a micro-batch."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_dedupe(df: DataFrame, key: str, at: str, horizon: str, root: str, checkpoint: str):
    """First element of every content within the horizon; each batch writes its own folder.

    A batch's elements of one content are taken in the order of their times,
    whatever order they arrive in. Between batches only the end of the horizon
    of each content's last kept element is needed, kept per batch, so that a
    repeated batch writes the same again; it goes, like elements that are late,
    once the newest time is a horizon further on.
    """
    states, span = f"{checkpoint}-states", F.expr(f"INTERVAL {horizon}")

    def advance(batch: DataFrame, batch_id: int) -> None:
        element = F.struct(F.col(at).alias("at"), F.struct(*batch.columns).alias("row"))
        rows = batch.select(F.col(key).alias("key"), F.lit(None).cast("timestamp").alias("ends"), element.alias("element"))
        newest = [batch.agg(F.max(at)).first()[0]]
        if batch_id > 0:  # an absent version is an error: going on without it would repeat elements
            known = batch.sparkSession.read.parquet(f"{states}/version={batch_id - 1}")
            before = known.agg(F.max("seen")).first()[0]
            if before is not None:
                rows = rows.filter(F.col("element.at") > F.lit(before) - span)
            newest.append(before)
            rows = rows.unionByName(known.select("key", "ends"), allowMissingColumns=True)
        grouped = rows.groupBy("key").agg(F.max("ends").alias("ends"), F.sort_array(F.collect_list("element")).alias("elements"))
        nothing = F.slice("elements", F.lit(1), F.lit(0))
        walked = materialize(grouped.select("key", F.aggregate(
            "elements", F.struct(F.col("ends"), nothing.alias("kept")),
            lambda state, e: F.when(
                state["ends"].isNull() | (e["at"] >= state["ends"]),
                F.struct((e["at"] + span).alias("ends"), F.concat(state["kept"], F.array(e)).alias("kept")),
            ).otherwise(state),
        ).alias("state")))
        walked.select(F.explode("state.kept").alias("e")).select("e.row.*").write.mode("overwrite").parquet(batch_path(root, batch_id))
        seen = F.lit(max((t for t in newest if t is not None), default=None)).cast("timestamp")
        after = walked.select("key", "state.ends", seen.alias("seen")).filter(F.coalesce(F.col("ends") > F.col("seen") - span, F.lit(True)))
        after.write.mode("overwrite").parquet(f"{states}/version={batch_id}")

    return df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(advance).start()


def stream_budget(attempts: DataFrame, limit: float, late: str = "1 hour") -> DataFrame:
    """Cost per day; rows later than ``late`` are dropped."""
    day = F.window("ts", "1 day")
    cost = F.sum(F.col("cost").cast(MONEY)).cast("double")
    return attempts.withWatermark("ts", late).groupBy(day).agg(cost.alias("__cost")).select(
        F.col("window.start").alias("day"), F.round("__cost", 6).alias("daily_cost"), (F.col("__cost") > limit).alias("daily_alert")
    )


def stream_outages(attempts: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of failures of a provider with less than ``gap`` between them."""
    failed = attempts.filter("NOT success").withWatermark("ts", late)
    return failed.groupBy("provider", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("failures")).select(
        "provider", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "failures"
    )


def stream_breaker(attempts: DataFrame, root: str, checkpoint: str, threshold: int = 5, recovery: float = 60.0, good: int = 2):
    """Circuit breaker of every provider: each batch writes its changes of state to its own folder.

    A batch is worked out as a set. Of the batches before it only the state of
    each provider is needed, a row per provider, which is kept per batch, so
    that a repeated batch starts from the same state and writes the same again.
    """
    states = f"{checkpoint}-states"

    def advance(batch: DataFrame, batch_id: int) -> None:
        calls = batch.select("provider", "ts", "attempt_id", "success")
        known = None
        if batch_id > 0:  # an absent version is an error: going on without it would forget open breakers
            known = batch.sparkSession.read.parquet(f"{states}/version={batch_id - 1}")
            calls = breaker.recalled(known, threshold, recovery).unionByName(calls)
        seen, opened = breaker.histories(calls, threshold, recovery, good)
        breaker.changes(seen, opened, good).filter("attempt_id >= 0").write.mode("overwrite").parquet(batch_path(root, batch_id))
        after = breaker.state_after(seen, opened)
        if known is not None:  # providers without a call, new or recalled, keep their state
            after = after.unionByName(known.join(after, "provider", "left_anti"))
        after.write.mode("overwrite").parquet(f"{states}/version={batch_id}")

    return attempts.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(advance).start()


def status_rank(name: str) -> Column:
    """Of two statuses at one time the one further on in the work counts."""
    order = ["pending", "processing", "skipped", "failed", "complete"]
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(name)), F.lit(0))


def batch_path(root: str, batch_id: int) -> str:
    return f"{root}/batch={batch_id}"


def write_each(df: DataFrame, root: str, checkpoint: str, mode: str = "append"):
    """Run a stream over what is there; each batch replaces its own folder."""

    def store(batch: DataFrame, batch_id: int) -> None:
        place = root if mode == "complete" else batch_path(root, batch_id)
        batch.write.mode("overwrite").parquet(place)

    return (
        df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(store).start()
    )


def stream_ledger(
    updates: DataFrame, root: str, checkpoint: str, key: str = "path", order: Column | None = None, buckets: int = BUCKETS, kept: int = 2
):
    """Fold status updates into the ledger, batch by batch.

    The ledger lies in ``buckets`` by the key's hash. A batch reads and writes
    only the buckets that its keys fall into, under its own number, and then
    commits a table that names the version of every bucket. Readers go by the
    newest commit, so they see a batch whole or not at all. A batch that has
    committed is not folded again; data that none of the last ``kept`` commits
    names is deleted.
    """
    at = F.col("updated_at") if order is None else order

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if committed(spark, root, batch_id):
            return
        fresh = batch.withColumn("__at", at).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = {r[0] for r in fresh.select("bucket").distinct().collect()}  # as many as there are buckets at most
        before = versions(spark, root, batch_id - 1) if batch_id > 0 else {}
        if old := [bucket_path(root, before[b], b) for b in sorted(touched) if b in before]:
            fresh = spark.read.schema(fresh.drop("bucket").schema).parquet(*old).withColumn(
                "bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
            ).unionByName(fresh)
        ranked = latest(fresh.withColumn("__rank", status_rank("status")), [key], ["__at", "__rank", "status"]).drop("__rank")
        ranked.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/version={batch_id}")
        now = before | {b: batch_id for b in touched}
        rows = spark.createDataFrame(list(now.items()), "bucket int, version bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/version={batch_id}")  # a row per bucket
        forget(spark, root, batch_id, kept)

    return (
        updates.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(fold).start()
    )


def bucket_path(root: str, version: int, bucket: int) -> str:
    return f"{root}/data/version={version}/bucket={bucket}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the cluster's own file access."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def committed(spark: SparkSession, root: str, version: int) -> bool:
    files, path = hadoop_path(spark, f"{root}/commits/version={version}/_SUCCESS")
    return files.exists(path)


def versions(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    """The version of every bucket as of a commit; an absent commit is an error, as going on would lose the ledger."""
    return {r.bucket: r.version for r in spark.read.parquet(f"{root}/commits/version={version}").collect()}


def commits(spark: SparkSession, root: str) -> list[int]:
    files, path = hadoop_path(spark, f"{root}/commits")
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return sorted(v for v in (int(n.removeprefix("version=")) for n in names if n.startswith("version=")) if committed(spark, root, v))


def forget(spark: SparkSession, root: str, version: int, kept: int) -> None:
    """Delete the data and commits that only commits before the last ``kept`` name."""
    known = commits(spark, root)
    gone, stay = known[:-kept], known[-kept:]
    needed = {(b, v) for c in stay for b, v in versions(spark, root, c).items()}
    for commit in gone:
        for b, v in versions(spark, root, commit).items():
            if (b, v) not in needed:
                files, path = hadoop_path(spark, bucket_path(root, v, b))
                files.delete(path, True)
        files, path = hadoop_path(spark, f"{root}/commits/version={commit}")
        files.delete(path, True)


def newest_version(spark: SparkSession, root: str) -> DataFrame:
    """Ledger as of the last commit."""
    last = commits(spark, root)[-1]
    places = [bucket_path(root, v, b) for b, v in sorted(versions(spark, root, last).items())]
    return spark.read.parquet(*places).drop("__at")
