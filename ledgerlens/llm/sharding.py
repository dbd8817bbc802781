"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.order import packed, with_prefix
from ledgerlens.session import written


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text plus one for its end; a null text has none but the end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign_shards(rows: DataFrame, order: list[str], size: str, n_shards: int = 16) -> DataFrame:
    """Cut the rows, in ``order``, into ``n_shards`` contiguous runs of nearly equal total ``size``.

    Adds ``shard`` (0-based) and ``slot`` (gapless from 0 inside the shard).  A row goes to the shard in whose equal share
    of the total its middle lies, so a shard's total differs from the share by less than the largest row.  Global prefix
    sums come from one total per range of the order; only the given columns move, so callers pass narrow rows.

    Nulls sort first.  Rows equal in ``order`` (also whole repeated rows) keep an arbitrary but fixed order.  One row larger
    than a share may leave shards empty.  A null or negative size counts as 0; if all sizes are 0 the rows go to shard 0.
    An empty table gives no rows.  Other columns, whatever their names, are returned as they are, with ``shard`` and
    ``slot`` replaced if present.
    """
    kept = rows.drop("shard", "slot")
    base = written(kept.select(
        packed(kept), F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long"), F.lit(0)).alias("size"),
        F.monotonically_increasing_id().alias("rid")), "shard-rows")
    by = [F.col(f"row.`{c}`").asc() for c in order] + [F.col("rid").asc()]
    placed = with_prefix(base, by, {"before": "size"}, "position", "shard-order")
    total = base.agg(F.sum("size")).first()[0] or 0
    middle = (F.col("before") * 2 + F.col("size")) * n_shards
    shard = F.floor(middle / F.lit(2 * total)) if total * n_shards * 2 < 2**53 else F.floor(middle.cast("decimal(38,0)") / F.lit(2 * total))
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), shard).cast("int") if total else F.lit(0))
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("row.*", "shard", (F.col("position") - F.col("first")).alias("slot"))


def op5_byte_shards(documents: DataFrame, n_shards: int = 16) -> DataFrame:
    narrow = documents.select(
        "doc_id", text_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    return assign_shards(narrow, ["doc_id", "text_crc32"], "size", n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
