"""The splitting tree against the law of the draw and against whole quotas."""

from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing, splitting


@pytest.mark.parametrize("every,marked,taken", [(20, 7, 9), (12, 6, 6), (9, 8, 7), (5, 0, 3), (5, 5, 2), (6, 2, 0), (40, 3, 39)])
def test_hypergeometric_law(spark, every, marked, taken):
    n = 20_000
    df = spark.range(n).withColumn("u", splitting.uniform(F.lit(3), F.col("id"))).withColumns(
        {"every": F.lit(every).cast("long"), "marked": F.lit(marked).cast("long"), "taken": F.lit(taken).cast("long")})
    got = dict(splitting.hypergeometric(df, "every", "marked", "taken", "u", "x").groupBy("x").count().collect())
    assert sum(got.values()) == n and None not in got
    want = {k: n * comb(marked, k) * comb(every - marked, taken - k) / comb(every, taken) for k in range(max(0, taken + marked - every), min(marked, taken) + 1)}
    assert set(got) <= set(want)
    assert all(abs(got.get(k, 0) - w) <= 5 * max(w, 1) ** 0.5 for k, w in want.items())


def test_hypergeometric_of_large_counts(spark):
    big = 4_000_000_000
    df = spark.range(200).withColumn("u", splitting.uniform(F.lit(5), F.col("id"))).withColumns(
        {"every": F.lit(big), "marked": F.lit(big // 1000), "taken": F.lit(big // 2)})
    mean = big // 2000
    got = [r.x for r in splitting.hypergeometric(df, "every", "marked", "taken", "u", "x").select("x").collect()]
    sd = (mean / 2 * 0.999) ** 0.5
    assert all(abs(x - mean) < 6 * sd for x in got)
    assert abs(sum(got) / len(got) - mean) < 5 * sd / len(got) ** 0.5


def quota(spark, blocks):
    return spark.createDataFrame(list(enumerate(blocks)), "source_index long, blocks long")


@pytest.mark.parametrize("blocks,n_shards", [([5, 17, 0, 40, 1], 16), ([3], 7), ([100, 50, 25], 5), ([0, 0], 4), ([2, 1], 1)])
def test_quotas_are_exact(spark, blocks, n_shards):
    rows = splitting.shard_quotas(quota(spark, blocks), len(blocks), n_shards, 11).collect()
    assert Counter((r.source_index, r.shard) for r in rows) == Counter((s, i) for s in range(len(blocks)) for i in range(n_shards))
    shards, sources = defaultdict(int), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.source_index, r.shard)):
        assert r.first == sources[r.source_index] and r.blocks >= 0
        shards[r.shard] += r.blocks
        sources[r.source_index] += r.blocks
    assert [sources[s] for s in range(len(blocks))] == blocks
    assert max(shards.values()) - min(shards.values()) <= 1


def test_no_sources(spark):
    assert splitting.shard_quotas(quota(spark, [1]).where("false"), 0, 4, 1).isEmpty()


def test_law_of_leaves_over_seeds(spark):
    """The count of a source in one of three shards has the hypergeometric mean and variance."""
    seen = []
    base = quota(spark, [6, 9, 3])
    nodes = spark.range(4000).withColumnRenamed("id", "node").crossJoin(base).withColumn("take", F.lit(6).cast("long"))
    rows = splitting.split_once(nodes, 3, 2).collect()
    per_node = defaultdict(int)
    for r in rows:
        per_node[r.node] += r.left
        assert 0 <= r.left <= r.blocks
        if r.source_index == 1:
            seen.append(r.left)
    assert set(per_node.values()) == {6} and len(seen) == 4000
    mean, var = 6 * 9 / 18, 6 * 0.5 * 0.5 * 12 / 17
    assert abs(sum(seen) / 4000 - mean) < 5 * (var / 4000) ** 0.5
    assert abs(sum((x - mean) ** 2 for x in seen) / 4000 - var) < 0.12


def test_every_block_is_drawn_once_in_a_pass(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(10).alias("size"))
    rows = mixing.mix(docs, F.col("size"), block_words=20, n_shards=8).where("words > 0").collect()
    taken = defaultdict(set)
    for r in rows:
        taken[r["rid"], r["pass"]].add(r.shard)
    assert all(len(s) == 1 for s in taken.values()) and len(rows) == len(taken)
    words = defaultdict(int)
    for r in rows:
        words[r.shard] += r.words
    assert set(words) == set(range(8)) and max(words.values()) - min(words.values()) <= 2 * 20
    assert len({r.shard for r in rows if r.row.source == "a" and r["pass"] == 0}) > 1


def test_splitting_broadcasts_nothing(spark):
    """A split of few rows takes no memory of the driver for broadcasts."""
    counts = spark.createDataFrame([(1, s, 10 + s, 30) for s in range(5)], "node long, source_index int, blocks long, take long")
    split = splitting.split_once(counts, 5, 3)
    assert sum(r.left for r in split.collect()) == 30
    assert "BroadcastHashJoin" not in split._jdf.queryExecution().executedPlan().toString()
