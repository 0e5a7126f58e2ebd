"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Per application: its folder where none is set, and the tables written.
OWN_FOLDERS: dict[str, str] = {}
WRITTEN: dict[str, list[str]] = {}

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, app: str = "altloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        # Small tables come in splits for every core; text rules are bound by the processor.
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a session that runs in one process may go without the setting: its
    driver and executor are the same machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return OWN_FOLDERS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back from there.

    This cuts the lineage: what reads the result neither repeats the work nor
    depends on the executors that did it. A columnar table, unlike a plain
    checkpoint, lets each reader take only the columns it needs.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/altloom-{uuid.uuid4().hex}"
    df.write.parquet(place)
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(place)
    return spark.read.schema(df.schema).parquet(place)


def release(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote for this application.

    For a caller that has used up the results which read them.
    """
    places = WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for place in places:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(places)
