"""Readers: ledgers, registries, record files, source lines, reference manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens import constants as K
from ledgerlens.functions import text as X
from ledgerlens.functions.issues import raise_if_any

RECORD_SCHEMA = (
    "schema_version STRING, record_id STRING, record_kind STRING, study_id STRING, occurred_at STRING,"
    "recorded_at STRING, status STRING, created_by STRUCT<actor_id: STRING, actor_type: STRING>,"
    "contribution_refs ARRAY<STRING>, approval_refs ARRAY<STRING>, protocol_ref STRING, artifact_refs ARRAY<STRING>,"
    "relations ARRAY<STRUCT<type: STRING, target_id: STRING>>,"
    "source_refs ARRAY<STRUCT<artifact_revision_id: STRING, locator: STRING, verification_status: STRING>>,"
    "payload STRING, event_id STRING, date STRING, event_type STRING, project STRING, workstream STRING, summary STRING,"
    "source STRUCT<source_path: STRING, source_sha256: STRING, heading: STRING, line_start: BIGINT, line_end: BIGINT,"
    "legacy_import: BOOLEAN, requires_human_review: BOOLEAN>, timestamp_start STRING, timestamp_end STRING"
)
REGISTRY_SCHEMA = "source_id STRING, source_path STRING, source_sha256 STRING, source_type STRING, legacy_import BOOLEAN"


def numbered_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files with their exact 1-based line number, also over split files.

    Splits of one file are ordered by their start offset; the number of a line is
    its place inside the split plus the line counts of the splits before it, so
    no file is read or sorted by a single task.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"),
    )
    blocks = raw.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_id"))
    w = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file_path", "block", "first_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return raw.join(starts, ["file_path", "block"]).select(
        "file_path", (F.col("before") + F.col("_id") - F.col("first_id") + 1).alias("line_no"), "value"
    )


def parse_ledger(lines: DataFrame) -> DataFrame:
    """(file_path, line_no, value) -> parsed records; bad lines stay as ``malformed`` rows."""
    parsed = F.from_json("raw", RECORD_SCHEMA)
    return (
        lines.where(F.trim("value") != "")
        .withColumnRenamed("value", "raw")
        .withColumn("body", F.try_parse_json("raw"))
        .withColumn("malformed", F.coalesce(~F.schema_of_variant("body").startswith("OBJECT"), F.lit(True)))
        .withColumn("ledger_day", F.regexp_extract("file_path", r"([0-9]{4}-[0-9]{2}-[0-9]{2})/[^/]+$", 1))
        .withColumn("r", parsed)
        .select("file_path", "ledger_day", "line_no", "raw", "malformed", "r.*")
    )


def read_ledger(spark: SparkSession, root: str, strict: bool = False, pattern: str = "daily/*/events.jsonl") -> DataFrame:
    """All records of the day folders.  ``strict`` raises with the place of one bad line."""
    out = parse_ledger(numbered_text(spark, f"{root}/{pattern}"))
    if strict:
        raise_if_any(out.where("malformed").select("file_path", "line_no"), "ledger row is not an object")
    return out


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return normalize_registry(spark.read.schema(REGISTRY_SCHEMA).json(path))


def normalize_registry(reg: DataFrame) -> DataFrame:
    """Hash in lower case, blanks cut; ``ambiguous`` marks a source id bound to several (path, hash)."""
    norm = reg.select(
        F.trim("source_id").alias("source_id"), F.trim("source_path").alias("source_path"),
        F.lower(F.trim("source_sha256")).alias("source_sha256"), "source_type", "legacy_import",
    )
    bound = norm.groupBy("source_id").agg(
        (F.min(F.struct("source_path", "source_sha256")) != F.max(F.struct("source_path", "source_sha256"))).alias("ambiguous"))
    return norm.join(bound, "source_id", "left")


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One object, an array of objects, or JSON lines."""
    return spark.read.schema(RECORD_SCHEMA).option("multiLine", multi_line).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, mode: str = "strict") -> DataFrame:
    """strict: the first malformed row fails the job; lenient: malformed rows are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if mode == "strict" else "DROPMALFORMED").json(path)


def to_lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per line, numbered from 1; the text column never leaves its row before the split."""
    return df.select(*keys, F.posexplode(X.lines_of(text)).alias("_p", "_t")).select(
        *keys, (F.col("_p") + 1).cast("bigint").alias("line_no"), F.col("_t").alias("text"))


def read_source_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, sha256, size_bytes, text): hash and text come from one read of the file."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def reference_events(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest records -> ``reference_document`` events with availability and hash check.

    manifest: key, path, expected_sha256, title, role, kind, source_url; files: path, sha256.
    """
    current = files.select(F.col("path"), F.col("sha256").alias("actual_sha256"))
    j = manifest.join(current, "path", "left")
    note = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    return j.select(
        F.concat(F.lit("ref_"), X.slug("key")).alias("event_id"), F.lit(K.REFERENCE_SORT_DATE).alias("date"),
        F.lit(K.REFERENCE_EVENT_TYPE).alias("event_type"),
        F.when(F.col("actual_sha256").isNotNull(), "available").otherwise("unavailable").alias("status"),
        F.concat(
            note("title", ""), F.lit(". Citation key: "), F.col("key"), F.lit(". Role: "), note("role", "local research reference"),
            F.lit(". Kind: "), note("kind", "reference"), F.lit(". Source URL: "), note("source_url", "not recorded"),
            F.lit(". Local artifact: "), note("path", "not recorded"), F.lit("."),
        ).alias("summary"),
        "path", F.coalesce("actual_sha256", "expected_sha256").alias("sha256"),
        (F.col("expected_sha256") != F.col("actual_sha256")).alias("_m"),
    ).withColumn("hash_mismatch", F.coalesce("_m", F.lit(False))).drop("_m")


def auxiliary_records(files: DataFrame, manifest_paths: DataFrame, extensions: Sequence[str] = tuple(K.TEXT_EXTENSIONS)) -> DataFrame:
    """Files named by no manifest record, with an allowed extension and no ``.part`` suffix."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return (
        files.join(manifest_paths.select("path").distinct(), "path", "left_anti")
        .where(extension.isin(*extensions) & ~name.rlike(r"\.part(\.|$)"))
        .select(
            F.concat(F.lit("local:"), "path").alias("id"), F.concat(F.lit("local_"), X.slug("path")).alias("key"),
            "path", F.lit("local_reference_document").alias("kind"))
    )
