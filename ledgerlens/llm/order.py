"""Global positions and prefix sums without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import written


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that working columns cannot clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def with_prefix(df: DataFrame, order: Sequence[Column], sums: dict[str, str], position: str, label: str) -> DataFrame:
    """Add the global 0-based position in ``order`` and, for each ``new: column`` of ``sums``, the sum of the rows before.

    The rows are range-partitioned and written once; running sums are taken inside each range, and one total per range
    (as many rows as there are partitions) is accumulated and added.  ``order`` must decide between all rows, for example
    by ending in a row number.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), label)
    inner = Window.partitionBy("_range").orderBy(*order)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    starts = totals.select(
        "_range", zero(F.sum("_n").over(earlier)).alias("_n"), *[zero(F.sum(f"_t_{n}").over(earlier)).alias(f"_t_{n}") for n in sums])
    return (
        ranged.withColumn(position, F.row_number().over(inner).cast("long") - 1)
        .withColumns({n: zero(F.sum(c).over(before)) for n, c in sums.items()})
        .join(F.broadcast(starts), "_range")
        .withColumn(position, F.col(position) + F.col("_n"))
        .withColumns({n: F.col(n) + F.col(f"_t_{n}") for n in sums})
        .drop("_range", "_n", *[f"_t_{n}" for n in sums])
    )
