"""Sinks: verified publication of views, ledger append, result export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.issues import raise_if_any
from ledgerlens.operators import evidence as E

HEALTH_DDL = "version STRING, status STRING, reason STRING"


def publish(spark: SparkSession, views: dict[str, DataFrame], base: str, version: str,
            verify: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> bool:
    """Write all views under ``base/v=<version>``, verify what was written, then point CURRENT at it.

    ``verify`` returns issue rows over the written views.  A failed build leaves CURRENT unchanged and
    appends a health row; readers resolve the pointer once and then read immutable files.
    """
    root = f"{base}/v={version}"
    status, reason = "succeeded", ""
    try:
        for name, df in views.items():
            df.write.mode("overwrite").parquet(f"{root}/{name}")
        if verify is not None:
            raise_if_any(verify({n: spark.read.parquet(f"{root}/{n}") for n in views}), "view verification")
    except Exception as exc:  # whatever stops a build is recorded as its reason
        status, reason = "failed", f"{type(exc).__name__}: {exc}" if not isinstance(exc, ValueError) else str(exc)
    spark.createDataFrame([(version, status, reason)], HEALTH_DDL).write.mode("append").json(f"{base}/health")
    if status == "succeeded":
        number = spark.createDataFrame([(version,)], "version STRING").withColumn("published_at", F.current_timestamp())
        number.coalesce(1).write.mode("append").json(f"{base}/CURRENT")
    return status == "succeeded"


def current_version(spark: SparkSession, base: str) -> str | None:
    """Newest published version: the pointer log is append-only, the last row wins."""
    try:
        log = spark.read.schema("version STRING, published_at TIMESTAMP").json(f"{base}/CURRENT")
        row = log.agg(F.max_by("version", "published_at").alias("v")).first()
    except Exception as exc:  # no pointer yet
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise
    return row["v"]


def read_view(spark: SparkSession, base: str, name: str) -> DataFrame:
    version = current_version(spark, base)
    if version is None:
        raise FileNotFoundError(f"no published view under {base}")
    return spark.read.parquet(f"{base}/v={version}/{name}")


def append_records(records: DataFrame, root: str, issues: DataFrame | None = None) -> None:
    """Append records to their recorded day; refused when ``issues`` has rows.  Existing files stay untouched."""
    if issues is not None:
        raise_if_any(issues, "append refused")
    day = F.date_format(F.try_to_timestamp("recorded_at"), "yyyy-MM-dd")
    records.withColumn("ledger_day", day).write.mode("append").partitionBy("ledger_day").json(root)


def export_results(hits: DataFrame, blocks: DataFrame, path: str) -> None:
    """One header row per query and the source rows of its hits with their numbered lines, as JSON lines per query.

    A hit has a row per page of at most 64 lines, in order, so that no row holds a whole file.
    """
    rows = E.attach_lines(hits, blocks, pages=True)
    head = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits")).withColumn("record", F.lit("header")).withColumn("place", F.lit(0))
    body = rows.withColumn("record", F.lit("source")).withColumn("place", F.col("rank"))
    out = head.unionByName(body.select("qid", "record", "place", "hit_id", "path", "start_line", "end_line", "page", "content"), allowMissingColumns=True)
    out.hint("rebalance", F.col("qid")).sortWithinPartitions("qid", "place", "hit_id", "page").write.mode("errorifexists").json(path)
