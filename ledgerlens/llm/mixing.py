"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.order import packed, with_prefix
from ledgerlens.llm.splitting import shard_quotas
from ledgerlens.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 4096


def word_count(text: Column) -> Column:
    """Number of words of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of the sources: ``sizes`` has one row per source (source, source_size).

    Sources in code point order, null last, take the weights in turn.  Together they get ``share`` times all sizes; no
    target is above ``most`` times the size of its source, the excess is shared again by weight.  Each round is one
    aggregate over the sources: with a level L per unit of weight, a source gets min(most * size, weight * L), and L rises
    until no further source reaches its limit.  Adds ``source_index``, ``source_start`` (sizes of the sources before) and
    ``target`` (double).
    """
    ordered = with_prefix(sizes, [F.col("source").asc_nulls_last()], {"source_start": "source_size"}, "source_index", "mix-sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_index") % len(weights) + 1).cast("int"))
    ordered = written(ordered.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most)), "mix-targets")
    total = ordered.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
        given, weight, n = ordered.agg(
            F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        if n == full or not weight:
            break
        full, level = n, max(level, (share * total - (given or 0)) / weight)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)) if total else F.lit(0.0)
    return ordered.withColumn("target", target).drop("weight", "cap")


def draw_key(seed: int, *parts: Column) -> Column:
    """A fixed random order: equal on every run and for every partitioning."""
    return F.xxhash64(F.lit(seed), *parts)


def mix(
    docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, most: int = MOST, n_shards: int = 16, block_words: int = BLOCK_WORDS, seed: int = 7,
) -> DataFrame:
    """Draw each source to its target and deal the draws over ``n_shards``: one row per draw.

    The documents of a source, by id, are cut into blocks of about ``block_words`` words; a document belongs to the block
    in which it starts.  Every pass over a source permutes its blocks anew.  The quota of a source is the blocks from the
    start of its passes up to its target, the last block cut to the word.  A tree of shards splits these exact quotas: each
    node gives its left child the blocks of the left child's shards, and their counts per source are one multivariate
    hypergeometric draw (see splitting).  A leaf then takes its count from the source's blocks in a permuted order, so that
    every block of a pass is drawn once, by one shard.  Shards hold equal numbers of blocks (one apart at most).

    Columns: ``rid`` (number of the row), ``row`` (struct of the columns of ``docs``), ``size``, ``source_size``, ``target``, ``pass`` (0-based),
    ``words`` (drawn of this document, from its start), ``shard``, ``place`` (random order inside the shard).  Documents of
    which nothing is drawn give one row with null ``pass``, ``shard`` and ``place`` and 0 words.

    A null size counts as 0; documents without words are never drawn.  A null source is a source of its own.  Repeated rows
    are documents of their own.  Reruns on the same rows agree unless rows share an id, source and size.  An empty table
    gives no rows.  A source however large is cut over many ranges and blocks; no step groups by source without combining
    first.
    """
    rows = docs.select(
        packed(docs), F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    base = written(rows.withColumn("rid", F.monotonically_increasing_id()), "mix-rows")
    narrow = base.drop("row")
    sources = written(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-sources")
    order = [F.col("source").asc_nulls_last(), F.col("id").asc_nulls_last(), F.col("size").asc(), F.col("rid").asc()]
    placed = with_prefix(narrow, order, {"start": "size"}, "position", "mix-order")
    same = placed["source"].eqNullSafe(sources["source"])
    placed = placed.join(sources, same).select(
        "rid", "size", "source_index", "source_size", "target", (F.col("start") - F.col("source_start")).alias("start"))
    placed = written(placed.withColumn("block", F.expr(f"start div {block_words}")), "mix-placed")

    blocks = placed.groupBy("source_index", "block").agg(
        F.sum("size").alias("block_size"), F.min("start").alias("block_start"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    passes = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    stream = [F.col("source_index").asc(), F.col("pass").asc(), F.col("key").asc(), F.col("block").asc()]
    passes = passes.withColumn("key", draw_key(seed, F.col("source_index"), F.col("pass"), F.col("block")))
    passes = with_prefix(passes, stream, {"at": "block_size"}, "position", "mix-passes")
    # every source fills `most` passes, so its stream starts after most * the sizes of the sources before
    starts = sources.select("source_index", (F.col("source_start") * most).alias("stream_start"))
    left = F.round("target").cast("long") - (F.col("at") - F.col("stream_start"))
    quota = passes.join(starts, "source_index").withColumn("drawn", F.least(F.col("block_size"), left)).where("drawn > 0")
    quota = quota.select("source_index", "block", "block_start", "pass", "drawn", draw_key(seed + 1, F.col("source_index"), F.col("pass"), F.col("block")).alias("key"))
    order = [F.col("source_index").asc(), F.col("key").asc(), F.col("pass").asc(), F.col("block").asc()]
    ranked = written(with_prefix(quota, order, {}, "rank", "mix-order"), "mix-quotas")
    per_source = written(ranked.groupBy("source_index").agg(F.count("*").alias("blocks"), F.min("rank").alias("first_rank")), "mix-counts")
    shards = shard_quotas(per_source.select("source_index", "blocks"), sources.count(), n_shards, seed)
    # the borders of a source's shards: one row per source, n_shards numbers
    borders = shards.groupBy("source_index").agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("borders"))
    leaf = F.expr("element_at(filter(borders, x -> x.first <= rank - first_rank), -1).shard")
    dealt = ranked.join(borders.join(per_source.drop("blocks"), "source_index"), "source_index").withColumn("shard", leaf)
    dealt = dealt.drop("rank", "key", "borders", "first_rank")

    drawn = placed.join(dealt, ["source_index", "block"]).withColumn(
        "words", F.least(F.col("size"), F.col("block_start") + F.col("drawn") - F.col("start"))).where("words > 0")
    drawn = drawn.select("rid", "pass", "words", "shard", draw_key(seed + 2, F.col("rid"), F.col("pass")).alias("place"))
    info = placed.select("rid", "size", "source_size", "target").join(drawn, "rid", "left")
    return base.select("rid", "row").join(info, "rid").withColumn("words", F.coalesce("words", F.lit(0)))


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix draws them, whole, with the columns of ``docs`` (see mix).

    Where the mix cuts a document at a source's target the document is taken whole if at least half of it is drawn.
    """
    drawn = mix(docs, word_count(F.col(f"`{text_col}`")), **options)
    return drawn.where("words * 2 >= size AND words > 0").select("row.*")


def op6_mix_sources(documents: DataFrame) -> DataFrame:
    """Words taken of every document; the texts are read once and do not move."""
    narrow = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    drawn = mix(narrow, F.col("size"))
    # one struct of a document's draws: at most MOST of them, one per pass
    per_doc = drawn.groupBy("row.doc_id", "row.source", "size", "source_size", "target", "rid").agg(
        F.sum("words").alias("taken"), F.min(F.when(F.col("pass") == 0, F.col("shard"))).alias("first_shard"),
        F.min(F.when(F.col("pass") == 1, F.col("shard"))).alias("second_shard"))
    return per_doc.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"), "first_shard", "second_shard")
