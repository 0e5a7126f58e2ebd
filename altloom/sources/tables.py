"""Stage tables, manifests, maps, caches, reports and the work ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altloom.functions.review import current_cell, notes_text, source_or, status_label, suggested_cell, text_or_blank, text_or_null, type_label
from altloom.operators.reuse import latest

VERSION = "2.0.0"
HEADER = "manifest_header"

MANIFEST = (
    "key string, instance_key string, content_key string, image_hash string, slide_idx int, shape_type string, "
    "existing_alt string, current_alt string, final_alt string, suggested_alt string, decision_reason string, "
    "source string, model_called boolean, image_number int, width_px int, height_px int"
)
# The columns of the audit file, in order.
AUDIT = [
    "filename", "slide_number", "image_index", "alt_text", "is_missing_alt", "thumbnail_path", "original_filename",
    "is_possible_decorative", "notes", "image_filename", "shape_name", "image_id",
]


# --- manifest ------------------------------------------------------------------


def write_manifest(df: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON line per entry, and a header line with the schema version.

    With ``by`` (a deck) the lines of each of its values lie in a folder of their own.
    """
    spark = df.sparkSession
    fields = [c for c in df.columns if c != by]
    entries = df.select(*([by] if by else []), F.to_json(F.struct(*fields)).alias("value")).write.mode("overwrite")
    (entries.partitionBy(by) if by else entries).text(path)
    header = F.to_json(F.struct(F.lit(HEADER).alias("_type"), F.lit(VERSION).alias("schema_version")))
    spark.range(1).select(header.alias("value")).coalesce(1).write.mode("append").text(path)


def read_manifest(spark: SparkSession, path: str, ddl: str = MANIFEST) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected lines); of one manifest's lines for an element the latest wins.

    A manifest is the files of one folder, which is named in ``manifest`` (and in
    the folder's own column, if it has one). An element is found by its
    instance key, and by its key only where it has none. Lines are ordered by
    file, block and row, which a scan keeps however the file is split.
    """
    schema = T.StructType.fromDDL(ddl)
    known = T.StructType([*schema.fields, T.StructField("_type", T.StringType())])
    found = spark.read.text(path)
    folders = [c for c in found.columns if c != "value"]
    home = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
    lines = found.select(
        "value", *folders, home.alias("manifest"),
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("__line"),
    ).filter(F.trim("value") != "")
    parsed = lines.withColumn("entry", F.from_json("value", known)).withColumn(
        "fields", F.json_object_keys("value")
    )
    is_header = F.coalesce(F.col("entry._type") == HEADER, F.lit(False))
    unknown = F.size(F.array_except("fields", F.array(*[F.lit(f) for f in schema.fieldNames()]))) > 0
    bad = F.col("fields").isNull() | F.coalesce(unknown, F.lit(True))
    body = parsed.filter(~is_header)
    entries = body.filter(~bad).select("__line", "manifest", *folders, *[F.col(f"entry.{f}").alias(f) for f in schema.fieldNames()])
    owned = entries.withColumn("__owner", F.coalesce(F.nullif("instance_key", F.lit("")), "key"))
    return sync_entry(latest(owned, ["manifest", "__owner"], ["__line"]).drop("__line", "__owner")), body.filter(bad).select("value")


def sync_entry(df: DataFrame) -> DataFrame:
    """Old and new names of a text hold the same."""
    def either(a: str, b: str) -> Column:
        return F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit(""))

    existing, final = either("existing_alt", "current_alt"), either("final_alt", "suggested_alt")
    return df.withColumns(
        {
            "existing_alt": existing, "current_alt": either("current_alt", "existing_alt"),
            "final_alt": final, "suggested_alt": either("suggested_alt", "final_alt"),
            "had_existing_alt": F.trim(existing) != "",
        }
    )


# --- maps and caches ---------------------------------------------------------------


PAIR = "key string, value string"


def read_json_map(spark: SparkSession, path: str, by: str = "deck") -> DataFrame:
    """(key, value) of a map of one pair per line, with what the pair belongs to.

    A line names its ``by`` (a deck) itself; in maps of older runs its folder
    does. The latest of a key's pairs in one deck wins.
    """
    raw = spark.read.text(path)
    folders = [c for c in raw.columns if c not in ("value", by)]
    line = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    home = F.col(by).cast("string") if by in raw.columns else F.lit(None).cast("string")
    pairs = raw.select(*folders, line.alias("__line"), home.alias("home"), F.from_json("value", f"`{by}` string, {PAIR}").alias("p")).filter("p.key IS NOT NULL")
    named = pairs.select(F.coalesce(F.col("p")[by], "home").alias(by), *folders, "__line", "p.key", "p.value")
    return latest(named, [by, *folders, "key"], ["__line"]).drop("__line")


def import_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of old files that are one whole JSON object each; unreadable ones are empty."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def canonical_map(pairs: DataFrame) -> DataFrame:
    """Final-map records; a plain text counts as a generated and final text."""
    record = "struct<existing_alt:string,generated_alt:string,source_existing:string,source_generated:string,final_alt:string,decision:string>"
    is_record = F.col("value").startswith("{")
    rest = [c for c in pairs.columns if c not in ("key", "value")]
    return pairs.withColumn("r", F.when(is_record, F.from_json("value", record))).select(
        *rest, "key",
        text_or_blank("r.existing_alt").alias("existing_alt"),
        F.when(is_record, text_or_blank("r.generated_alt")).otherwise(text_or_blank("value")).alias("generated_alt"),
        source_or("r.source_existing", "pptx").alias("source_existing"),
        source_or("r.source_generated", "llava").alias("source_generated"),
        F.when(is_record, text_or_null("r.final_alt")).otherwise(text_or_null("value")).alias("final_alt"),
        text_or_null("r.decision").alias("decision"),
    )


def read_alt_map(spark: SparkSession, path: str) -> DataFrame:
    return canonical_map(read_json_map(spark, path))


def if_found(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives, or nothing where its path does not exist."""
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_alt_cache(spark: SparkSession, path: str) -> DataFrame:
    """(image_hash, alt) of a cache; a missing cache is an empty one."""
    pairs = if_found(lambda: read_json_map(spark, path))
    if pairs is None:
        return spark.createDataFrame([], "image_hash string, alt string")
    return pairs.withColumnsRenamed({"key": "image_hash", "value": "alt"})


def write_json_map(df: DataFrame, key: str, value: Column, by: str, path: str) -> None:
    """One JSON line per pair, with its ``by`` value (a deck).

    Decks share files: a folder for each would make as many files as decks
    times tasks.
    """
    pair = F.to_json(F.struct(by, F.col(key).alias("key"), value.alias("value")))
    df.select(pair.alias("value")).write.mode("overwrite").text(path)


# --- stages -------------------------------------------------------------------------


def write_stage(df: DataFrame, root: str, stage: str, run_id: str) -> None:
    """Store a stage of a run; only that run's stage is replaced."""
    (
        df.withColumns({"run_id": F.lit(run_id), "stage": F.lit(stage)})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "stage").parquet(root)
    )


def read_stage(spark: SparkSession, root: str, stage: str, run_id: str) -> DataFrame:
    return spark.read.parquet(root).filter((F.col("run_id") == run_id) & (F.col("stage") == stage)).drop("run_id", "stage")


def write_coverage(df: DataFrame, path: str) -> None:
    """One JSON line per deck; decks share files."""
    df.write.mode("overwrite").json(path)


def audit_rows(df: DataFrame) -> DataFrame:
    """The twelve audit columns; notes become one text."""
    return df.select(*[F.array_join("notes", "; ").alias("notes") if c == "notes" else F.col(c) for c in AUDIT])


# A text is written as it is, with its outer blanks; a null field is bare, an empty text is two quotes. A reader cannot be told
# that nothing stands for null, so it gets a noncharacter: only a text that is this alone comes back as null.
AUDIT_FORM = {
    "header": True, "escape": '"', "charToEscapeQuoteEscaping": '"', "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
BARE = "\ufdd0"


def write_audit_csv(df: DataFrame, path: str) -> None:
    audit_rows(df).write.mode("overwrite").options(**AUDIT_FORM).csv(path)


def read_audit_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in AUDIT)
    return spark.read.schema(schema).options(**AUDIT_FORM, nullValue=BARE, multiLine=True).csv(path)


def decision_log(df: DataFrame) -> DataFrame:
    """One structured line per decision."""
    fields = ["key", "image_hash", "mode", "alt_used", "source", "model_called", "reasoning"]
    return df.select("key", F.to_json(F.struct(*fields)).alias("entry"))


def load_ledger(ledger: DataFrame) -> DataFrame:
    """A ledger ready to go on: items cut off in mid-work wait again."""
    stuck = F.col("status") == "processing"
    return ledger.withColumns(
        {
            "status": F.when(stuck, "pending").otherwise(F.col("status")),
            "started_at": F.when(~stuck, F.col("started_at")),
        }
    )


def review_table(elements: DataFrame, alt_map: DataFrame) -> DataFrame:
    """Rows of the review document: place, kind, texts, status and notes."""
    joined = elements.join(alt_map, ["deck", "key"], "left")
    return joined.select(
        "deck",
        F.concat_ws("/", (F.col("slide_idx") + 1).cast("string"), F.col("image_number").cast("string")).alias("label"),
        type_label("shape_type", F.col("parent_id").isNotNull()).alias("type"),
        current_cell("existing_alt", F.lit(""), "final_alt", "decision_reason").alias("current"),
        suggested_cell("final_alt", "decision_reason").alias("suggested"),
        status_label("decision", "final_alt", "generated_alt", "existing_alt").alias("status"),
        notes_text("source_existing", "source_generated", F.lit(""), F.lit(None).cast("map<string,string>"), F.lit("")).alias("notes"),
    )


def export_elements(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def import_map(spark: SparkSession, path: str) -> DataFrame:
    """An external map; the same forms as a stored final map."""
    return read_alt_map(spark, path)


def import_old_map(spark: SparkSession, path: str) -> DataFrame:
    """A final map kept as whole JSON objects by an older run."""
    return canonical_map(import_json_map(spark, path))
