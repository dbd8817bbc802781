"""Fusion, routing and selection over ranked lists.

A ranked list is (qid, event_id, rank, score, ...).  Inputs are already cut to k
rows per query, so every shuffle here carries k rows per query, not the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens import scale
from ledgerlens.functions import text as X


def rrf(lexical: DataFrame, semantic: DataFrame, k: int, weights: tuple[float, float] = (0.45, 0.55),
        c: int = K.RRF_K, duplicate: str = "best") -> DataFrame:
    """Weighted reciprocal rank fusion per event.

    ``duplicate`` tells which rank an event keeps when it occurs several times in a
    list: ``best`` (default) or ``last``.
    """
    pick = F.min if duplicate == "best" else F.max
    both = lexical.select("qid", "event_id", F.col("rank").alias("lr"), F.lit(None).cast("int").alias("sr")).unionByName(
        semantic.select("qid", "event_id", F.lit(None).cast("int").alias("lr"), F.col("rank").alias("sr")))
    fused = both.groupBy("qid", "event_id").agg(pick("lr").alias("lexical_rank"), F.min("sr").alias("semantic_rank"))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(c) + F.col(r)), F.lit(0.0))
    fused = fused.withColumn("rrf_score", F.round(part(weights[0], "lexical_rank") + part(weights[1], "semantic_rank"), 8))
    return scale.top_per_key(fused, ["qid"], [F.desc("rrf_score"), F.asc("event_id")], k)


def fuse_linear(lexical: DataFrame, semantic: DataFrame, w_lex: float, w_sem: float, k: int) -> DataFrame:
    """Weighted sum of scaled lexical score and shifted cosine.

    lexical: (qid, event_id, lexical_score in [0,1]); semantic: (qid, event_id, passage_id,
    semantic_score).  The event's lexical score reaches its passages; an event row
    stays only where no passage of it is present; one row per event.
    """
    lex = lexical.select("qid", "event_id", "lexical_score")
    sem = semantic.select("qid", "event_id", "passage_id", "semantic_score")
    passages = sem.join(lex, ["qid", "event_id"], "left").withColumn("kind", F.lit("passage"))
    events = (
        lex.join(sem.select("qid", "event_id").distinct(), ["qid", "event_id"], "left_anti")
        .select("qid", "event_id", F.lit("").alias("passage_id"), F.lit(0.0).alias("semantic_score"), "lexical_score",
                F.lit("event").alias("kind")))
    rows = passages.unionByName(events).withColumn("lexical_score", F.coalesce("lexical_score", F.lit(0.0)))
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("semantic_score") + 1) / 2))
    rows = rows.withColumn("hybrid_score", F.round(w_lex * F.col("lexical_score") + w_sem * unit, 6))
    order = [F.desc("hybrid_score"), F.desc("semantic_score"), F.desc("lexical_score"), F.asc("passage_id")]
    once = scale.first_per_key(rows, ["qid", "event_id"], order)
    return scale.top_per_key(once, ["qid"], [*order[:3], F.asc("event_id")], k)


def merge_variants(hits: DataFrame, key: str, score: str, weight: str = "weight") -> DataFrame:
    """Best weighted score per (query, key) over the variants of a query."""
    weighted = hits.withColumn(score, F.round(F.col(score) * F.col(weight), 6))
    best = weighted.groupBy("qid", key).agg(
        F.max_by(F.struct(score, "variant"), F.struct(F.col(score), -F.col("variant"))).alias("b"))
    return best.select("qid", key, f"b.{score}", "b.variant")


def expand_queries(queries: DataFrame, rules: Sequence[dict], max_variants: int) -> DataFrame:
    """Query variants: the original plus alias rules whose every group has a trigger in the query.

    rules: configuration, each {name, weight, groups: list of trigger lists, terms}.  The rules become
    one array expression per query row; only rules that fire are exploded.
    """
    clean = lambda t: " ".join(t.lower().split())
    q = queries.select("qid", X.collapse_spaces("query").alias("query")).where("query <> ''").withColumn("norm", X.normalize_query("query"))
    fired = []
    for number, r in enumerate(rules, 1):
        text = " ".join(t.strip() for t in r["terms"] if t.strip())
        if not r["groups"] or not text:
            continue
        hit = F.lit(True)
        for group in r["groups"]:
            hit = hit & X.contains_any("norm", [clean(t) for t in group])
        hit = hit & (F.col("norm") != clean(text))
        fired.append(F.when(hit, F.struct(
            F.lit(number).alias("rule_no"), F.lit(r["name"]).alias("name"), F.lit(text).alias("query"),
            F.lit(float(r["weight"])).alias("weight"), F.lit(clean(text)).alias("key"))))
    original = q.select("qid", F.lit(0).alias("variant"), F.lit("original").alias("name"), "query", F.lit(1.0).alias("weight"))
    if not fired:
        return original
    hits = q.select("qid", F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("r")).select("qid", "r.*")
    once = scale.first_per_key(hits, ["qid", "key"], [F.asc("rule_no")])
    extra = scale.top_per_key(once, ["qid"], [F.asc("rule_no")], max_variants - 1, "variant")
    return original.unionByName(extra.select("qid", "variant", "name", "query", "weight"))


def plan_queries(queries: DataFrame) -> DataFrame:
    """Short queries and queries with identifiers go lexical first (0.85, else 0.35); identifiers
    become variants weighted 1.2 (event ids, paths) or 0.9."""
    q = F.col("query")
    ids = F.array_distinct(F.filter(
        F.regexp_extract_all(q, F.lit(r"[A-Za-z][A-Za-z0-9_.:/-]{1,127}|\d+(?:\.\d+)+"), F.lit(0)),
        lambda t: t.rlike(r"[0-9/\\._:-]")))
    first = (F.size(F.split(F.trim(q), r"\s+")) <= 5) | (F.size(ids) > 0) | q.rlike(r"[0-9/\\._:-]")
    planned = queries.select("qid", "query", first.alias("lexical_first"), ids.alias("ids"))
    weight = F.when(F.col("lexical_first"), 0.85).otherwise(0.35)
    variants = F.concat(
        F.array(F.struct(F.col("query").alias("variant"), F.lit(1.0).alias("variant_weight"))),
        F.when(F.col("lexical_first"), F.transform(
            F.filter("ids", lambda t: F.lower(t) != F.lower(F.col("query"))),
            lambda t: F.struct(t.alias("variant"),
                               F.when(t.startswith("evt_") | F.contains(t, F.lit("/")), 1.2).otherwise(0.9).alias("variant_weight")),
        )).otherwise(F.array()))
    return (
        planned.withColumn("lexical_weight", weight)
        .select("qid", "lexical_first", "lexical_weight", F.round(1 - F.col("lexical_weight"), 2).alias("semantic_weight"),
                F.posexplode(variants).alias("variant_no", "v"))
        .select("qid", "lexical_first", "lexical_weight", "semantic_weight", "variant_no", "v.*"))


def route(queries: DataFrame, lexical: DataFrame, semantic: DataFrame, semantic_available: bool = True) -> DataFrame:
    """Adaptive route: structural queries lexical; else semantic; lexical where semantic is absent or empty."""
    q = queries.select("qid", X.is_structural("query").alias("structural"))
    has = semantic.select("qid").distinct().withColumn("has_semantic", F.lit(True))
    mode = q.join(has, "qid", "left").select(
        "qid",
        F.when(F.col("structural"), "structural_query_lexical_fast_path")
        .when(F.lit(not semantic_available), "semantic_unavailable_lexical_fallback")
        .when(F.col("has_semantic"), "natural_language_semantic_route")
        .otherwise("semantic_empty_lexical_fallback").alias("reason"))
    sem_reason = F.col("reason") == "natural_language_semantic_route"
    take = lambda hits, cond, name: hits.select("qid", "event_id", "rank", "score").join(mode.where(cond), "qid").withColumn("route", F.lit(name))
    return take(semantic, sem_reason, "semantic").unionByName(take(lexical, ~sem_reason, "lexical"))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """First hit per event; hits without an event, first per (path, range, passage)."""
    key = F.when(F.coalesce(F.col("event_id"), F.lit("")) != "", F.concat(F.lit("e:"), "event_id")).otherwise(
        F.concat_ws("|", F.lit("l:"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("path", "start_line", "end_line", "passage_id")]))
    return scale.first_per_key(hits.withColumn("_key", key), ["qid", "_key"], [F.asc("rank")]).drop("_key")


def recency_key(date: str = "date", start: str = "timestamp_start", end: str = "timestamp_end") -> Column:
    """Chosen instant (end, start, day) in UTC; null when unreadable, which sorts last."""
    chosen = F.coalesce(F.nullif(F.trim(end), F.lit("")), F.nullif(F.trim(start), F.lit("")), F.trim(date))
    return F.try_to_timestamp(chosen)


def latest(events: DataFrame, k: int) -> DataFrame:
    """Newest records first; reference documents excluded (top-k report, TakeOrdered plan)."""
    return (
        events.where(F.col("event_type") != K.REFERENCE_EVENT_TYPE).withColumn("recency", recency_key())
        .orderBy(F.desc_nulls_last("recency"), F.desc("event_id")).limit(k))


def exact_event(queries: DataFrame, events: DataFrame) -> DataFrame:
    """Queries that are an event id match exactly that event, score 1.0."""
    q = queries.where(F.trim("query").startswith("evt_")).select("qid", F.trim("query").alias("event_id"))
    return q.join(events, "event_id").withColumn("score", F.lit(1.0)).withColumn("rank", F.lit(1))


def diversify(hits: DataFrame, k: int, event_cap: int = 4, result_family_cap: int = 4, family_cap: int = 2,
              priority_cap: int = 5) -> DataFrame:
    """Greedy selection in rank order under per-event and per-family caps.

    hits: (qid, rank, event_id, path, heading, priority) and, if wanted, ``bundle``: such rows are taken at their rank
    without caps, path or heading, and fill a place but no cap.  A hit refused by one cap does not count for the other, so
    each list is folded in order; it is a retrieval list, whose length per query is set by the retrieval k.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in hits.columns else F.lit(False)
    usable = (F.trim(F.coalesce("path", F.lit(""))) != "") & ~F.lower(F.trim(F.coalesce("heading", F.lit("")))).isin(*K.LOW_VALUE_HEADINGS)
    family_limit = F.when(F.startswith("path", F.lit("results/")), result_family_cap).otherwise(family_cap)
    hit = F.struct(
        "rank", "event_id", "path", X.path_family("path").alias("family"), yes("bundle").alias("bundle"),
        F.when(yes("priority"), priority_cap).otherwise(event_cap).alias("e_cap"), F.when(yes("priority"), priority_cap).otherwise(family_limit).alias("f_cap"))
    lists = hits.where(yes("bundle") | usable).groupBy("qid").agg(F.sort_array(F.collect_list(hit)).alias("hits"))

    def step(taken: Column, x: Column) -> Column:
        same = lambda c: F.size(F.filter(taken, lambda t: ~t["bundle"] & t[c].eqNullSafe(x[c])))
        free = x["bundle"] | ((same("event_id") < x["e_cap"]) & (same("family") < x["f_cap"]))
        return F.when((F.size(taken) < k) & free, F.concat(taken, F.array(x))).otherwise(taken)

    taken = F.aggregate("hits", F.filter("hits", lambda x: F.lit(False)), step)
    return lists.select("qid", F.posexplode(taken)).select(
        "qid", "col.rank", "col.event_id", "col.path", "col.family", (F.col("pos") + 1).cast("long").alias("selected_rank"))
