"""Splitting tree: exact block quotas dealt over shards by hypergeometric splits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import written

REACH = 12  # standard deviations around the mode beyond which a split is less likely than a double can tell from 0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) fixed by ``parts``."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


# The odds of k marked items against those of the mode follow from its neighbour by the ratio of two terms.
_ODDS = """CASE WHEN k = _mode THEN 1D
  WHEN k > _mode THEN a.odds * ((_k - k + 1) * (_n - k + 1)) / (k * (_all - _k - _n + k))
  ELSE IF(k = _mode - 1, 1D, a.odds) * ((k + 1) * (_all - _k - _n + k + 1)) / ((_k - k) * (_n - k)) END"""


def hypergeometric(df: DataFrame, every: str, marked: str, taken: str, u: str, name: str) -> DataFrame:
    """Add ``name``: how many of ``taken`` items, drawn without replacement from ``every`` items of which ``marked`` are marked,
    are marked.  By inversion of the number ``u`` of (0, 1): outcomes from the mode upwards, then downwards, each with its odds
    from the one before; the first whose sum of odds passes u times the sum of all is the draw.  Work grows with the standard
    deviation, not with the counts."""
    n = lambda c: F.col(c).cast("double")
    spread = F.sqrt(n(taken) * n(marked) * (n(every) - n(marked)) * (n(every) - n(taken)) / F.greatest(F.lit(1.0), n(every) * n(every) * (n(every) - 1)))
    reach = (F.ceil(spread * REACH) + 2 * REACH).cast("long")
    mode = F.floor((n(taken) + 1) * (n(marked) + 1) / (n(every) + 2)).cast("long")
    least = F.greatest(F.lit(0).cast("long"), F.col(taken) + F.col(marked) - F.col(every))
    most = F.least(F.col(taken), F.col(marked))
    df = df.withColumns({"_all": n(every), "_k": n(marked), "_n": n(taken), "_mode": F.least(F.greatest(mode, least), most)})
    df = df.withColumns({"_low": F.greatest(least, F.col("_mode") - reach), "_high": F.least(most, F.col("_mode") + reach)})
    df = df.withColumn("_outcomes", F.expr("concat(sequence(_mode, _high), IF(_low < _mode, sequence(_mode - 1, _low, -1L), array()))"))
    # sums lag by one outcome, so that each step computes one ratio; the mark u * sum is bound once, outside the inner walk
    total = f"aggregate(_outcomes, named_struct('odds', 0D, 'sum', 0D), (a, k) -> named_struct('odds', {_ODDS}, 'sum', a.sum + a.odds), a -> a.sum + a.odds)"
    walk = (f"aggregate(_outcomes, named_struct('odds', 0D, 'sum', 0D, 'at', CAST(NULL AS BIGINT), 'pick', CAST(NULL AS BIGINT)), (a, k) -> named_struct("
            f"'odds', {_ODDS}, 'sum', a.sum + a.odds, 'at', k, 'pick', coalesce(a.pick, IF(a.sum + a.odds > mark, a.at, NULL))), a -> coalesce(a.pick, a.at))")
    df = df.withColumn(name, F.expr(f"transform(array({u} * {total}), mark -> {walk})[0]"))
    return df.drop("_all", "_k", "_n", "_mode", "_low", "_high", "_outcomes")


def split_once(counts: DataFrame, n_sources: int, seed: int) -> DataFrame:
    """Share the blocks of every node between its two children: ``counts`` (node, source_index, blocks, take) gets ``left``, the
    blocks of the source among the ``take`` blocks of the left child.

    The multivariate draw runs over a binary tree of the sources: the draw of a group of sources is split between its two
    halves by one hypergeometric draw, down to single sources.  Each level is one aggregate and one equi-join.  The joins are
    merge joins: as broadcasts of a few rows each would take pages of megabytes in the driver, dozens at once.
    """
    depth = max(0, (n_sources - 1).bit_length())
    group = lambda level: F.shiftright("source_index", level)
    if not depth:
        return counts.withColumn("left", F.col("take"))
    drawn = None
    for level in range(depth, 0, -1):
        halves = counts.groupBy("node", group(level).alias("g")).agg(
            F.sum("blocks").alias("every"), F.sum(F.when(group(level - 1) % 2 == 0, F.col("blocks")).otherwise(0)).alias("marked"),
            F.first("take").alias("drawn"))
        # the whole set of sources draws what the left child takes, a half what was drawn for it above
        both = halves if drawn is None else halves.drop("drawn").join(drawn.hint("merge"), ["node", "g"])
        both = both.withColumn("u", uniform(F.lit(seed), F.col("node"), F.lit(level), F.col("g")))
        both = hypergeometric(both, "every", "marked", "drawn", "u", "first_half")
        sides = F.array(
            F.struct((F.col("g") * 2).alias("g"), F.col("first_half").alias("drawn")),
            F.struct((F.col("g") * 2 + 1).alias("g"), (F.col("drawn") - F.col("first_half")).alias("drawn")))
        drawn = both.select("node", F.explode(sides).alias("s")).select("node", "s.g", "s.drawn")
    left = drawn.select("node", F.col("g").alias("source_index"), F.col("drawn").alias("left"))
    return counts.join(left.hint("merge"), ["node", "source_index"])


def shard_quotas(quotas: DataFrame, n_sources: int, n_shards: int, seed: int) -> DataFrame:
    """Blocks of every source in every shard: (source_index, shard, blocks, first), ``first`` being the source's blocks in the
    shards before.  ``quotas``: source_index (0 to ``n_sources`` - 1), blocks.

    A node of the tree stands for a run of shards and holds block counts per source; its left child gets as many blocks as
    its shards' equal shares (one apart at most) of all blocks, and which sources they come from is one multivariate
    hypergeometric draw.  One written level at a time, all nodes of a level together.  The tables have a row per source and
    node, whatever the number of blocks.
    """
    total = quotas.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    share = lambda shard: F.expr(f"cast({total} as decimal(38, 0)) * ({shard}) div {n_shards}").cast("long")
    level = quotas.select(F.lit(1).cast("long").alias("node"), F.lit(0).cast("long").alias("low"), F.lit(n_shards).cast("long").alias("high"), "source_index", "blocks")
    for i in range(max(0, (n_shards - 1).bit_length())):
        middle = F.expr("(low + high) div 2")
        counts = level.withColumn("take", F.when(F.col("high") - F.col("low") > 1, share("(low + high) div 2") - share("low")).otherwise(0))
        split = split_once(counts, n_sources, seed + i)
        inner = F.array(
            F.struct((F.col("node") * 2).alias("node"), "low", middle.alias("high"), F.col("left").alias("blocks")),
            F.struct((F.col("node") * 2 + 1).alias("node"), middle.alias("low"), "high", (F.col("blocks") - F.col("left")).alias("blocks")))
        same = F.array(F.struct((F.col("node") * 2).alias("node"), "low", "high", "blocks"))
        split = split.select("source_index", F.explode(F.when(F.col("high") - F.col("low") > 1, inner).otherwise(same)).alias("c"))
        level = written(split.select("c.node", "c.low", "c.high", "source_index", "c.blocks"), "mix-level")
    earlier = Window.partitionBy("source_index").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    return level.select(
        "source_index", F.col("low").cast("int").alias("shard"), "blocks", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)).cast("long").alias("first"))
