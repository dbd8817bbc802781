"""Building blocks that keep plans flat when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
ORDER_WIDTH = 100_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; stops counting one row later."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a check of the size.

    Beyond the bound the frame is returned unhinted: the join becomes a shuffle
    join and AQE splits its skewed partitions.  Callers pass narrow columns.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key.  Spark keeps one row per key and task before the shuffle
    (WindowGroupLimit), so a hot key sends at most one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Ranks 1..k per key, pre-cut per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _sliced(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(order) / F.lit(width)))


def previous_row(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], width: int = ORDER_WIDTH
) -> DataFrame:
    """``lag`` per key over a numeric order, in two levels.

    A plain window would sort a hot key in one task.  Here each key is cut into
    slices of the order range; a window runs per (key, slice), and the last row
    of every slice (one row per slice) is carried to the next slice.
    ``values`` maps new column name -> source column.
    """
    keys = list(keys)
    sliced = _sliced(df, order, width)
    inner = Window.partitionBy(*keys, "_slice").orderBy(order)
    packed = F.struct(*[F.col(src).alias(dst) for dst, src in values.items()])
    here = sliced.withColumn("_prev", F.lag(packed).over(inner))
    tails = sliced.groupBy(*keys, "_slice").agg(F.max_by(packed, F.col(order)).alias("_tail"))
    outer = Window.partitionBy(*keys).orderBy("_slice")
    carried = tails.select(*keys, "_slice", F.lag("_tail").over(outer).alias("_carried"))
    out = here.join(carried, [*keys, "_slice"], "left").withColumn("_p", F.coalesce("_prev", "_carried"))
    for dst in values:
        out = out.withColumn(dst, F.col(f"_p.{dst}"))
    return out.drop("_slice", "_prev", "_carried", "_p")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, width: int = ORDER_WIDTH
) -> DataFrame:
    """Inclusive running sum per key over a numeric order, in two levels (see previous_row)."""
    keys = list(keys)
    sliced = _sliced(df, order, width).withColumn("_v", value)
    inner = (
        Window.partitionBy(*keys, "_slice").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    here = sliced.withColumn("_run", F.sum("_v").over(inner))
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_total"))
    outer = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_slice", F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_before"))
    return (
        here.join(before, [*keys, "_slice"], "left")
        .withColumn(name, F.col("_run") + F.col("_before"))
        .drop("_slice", "_v", "_run", "_before")
    )


def position_in_key(df: DataFrame, keys: Sequence[str], order: str, name: str = "position", width: int = ORDER_WIDTH) -> DataFrame:
    """1..n per key in the numeric order, without sorting a whole key in one task."""
    return running_sum(df, keys, order, F.lit(1), name, width)


def last_known(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], width: int = ORDER_WIDTH
) -> DataFrame:
    """Last non-null value of each expression strictly before the row, per key, in two levels."""
    keys = list(keys)
    sliced = _sliced(df, order, width).withColumns({f"_in_{n}": c for n, c in values.items()})
    inner = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = sliced.withColumns({f"_here_{n}": F.last(f"_in_{n}", ignorenulls=True).over(inner) for n in values})
    tails = sliced.groupBy(*keys, "_slice").agg(*[
        F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}") for n in values])
    outer = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_slice", *[F.last(f"_t_{n}", ignorenulls=True).over(outer).alias(f"_c_{n}") for n in values])
    out = here.join(carried, [*keys, "_slice"], "left")
    for n in values:
        out = out.withColumn(n, F.coalesce(f"_here_{n}", f"_c_{n}"))
    return out.drop("_slice", *[f"{p}{n}" for p in ("_in_", "_here_", "_c_") for n in values])
