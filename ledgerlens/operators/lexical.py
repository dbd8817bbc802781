"""Lexical retrieval over stored inverted indexes: passage-first and event-first lists, scaled scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import scale
from ledgerlens.operators.inverted import Index, bm25_topk, scan


def minmax_by_query(hits: DataFrame, score: str, out: str) -> DataFrame:
    """Scores scaled to [0, 1] inside each result list; 1.0 when all are equal."""
    bounds = hits.groupBy("qid").agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    value = (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return (
        hits.join(bounds, "qid")
        .withColumn(out, F.when(F.col("_hi") > F.col("_lo"), value).otherwise(F.lit(1.0)))
        .drop("_lo", "_hi")
    )


LOCATOR = ["event_id", "path", "start_line", "end_line"]


def concat_lists(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """All of ``first`` before all of ``second`` per query, first occurrence per locator, cut at k.

    Both need qid, rank, score and the locator columns.
    """
    both = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1)), allowMissingColumns=True)
    both = both.withColumnRenamed("rank", "list_rank")
    order = [F.asc("list"), F.asc("list_rank")]
    once = scale.first_per_key(both, ["qid", *LOCATOR], order)
    return scale.top_per_key(once, ["qid"], order, k)


def search_lexical(queries: DataFrame, passage_index: Index, passages: DataFrame, event_index: Index, events: DataFrame,
                   k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Passage-first search: passage hits, then event hits; scores of the two lists are never compared."""
    p_allowed = None if allowed is None else passages.join(allowed, "event_id", "left_semi").select(F.col("passage_id").alias("doc_id"))
    e_allowed = None if allowed is None else allowed.select(F.col("event_id").alias("doc_id"))
    p_hits = bm25_topk(queries, passage_index, k, p_allowed)
    e_hits = bm25_topk(queries, event_index, k, e_allowed)
    ph = p_hits.join(passages.select(F.col("passage_id").alias("doc_id"), *LOCATOR), "doc_id").drop("doc_id")
    eh = e_hits.join(
        events.select(F.col("event_id"), F.col("source_path").alias("path"), F.col("line_start").alias("start_line"),
                      F.col("line_end").alias("end_line")),
        F.col("doc_id") == F.col("event_id")).drop("doc_id")
    return concat_lists(ph, eh, k)


def search_event_first(queries: DataFrame, event_index: Index, events: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Event summaries only; ties by date (newest first), then event id."""
    may = None if allowed is None else allowed.select(F.col("event_id").alias("doc_id"))
    scores = scan(queries, event_index, k, may).withColumnRenamed("doc_id", "event_id")
    dated = scores.join(events.select("event_id", "date"), "event_id")
    return scale.top_per_key(dated, ["qid"], [F.desc("score"), F.desc("date"), F.asc("event_id")], k)
