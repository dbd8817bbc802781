"""Re-ranking, timelines, grounding: text features of passages against their query.

Scores are row-local column expressions over (query, passage) rows; the rows come
from equi-joins of a bounded hit list with the passages of the hit events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens import scale
from ledgerlens.functions import text as X

NUMBER = r"^-?\d+\.\d+$"


def _found_terms(text: Column, terms: str, weight) -> Column:
    """Sum of ``weight(term)`` over the terms found in the text."""
    return F.aggregate(
        F.filter(F.col(terms), lambda t: F.contains(text, t)), F.lit(0.0), lambda a, t: a + weight(t))


def _best_line(lowered: str, start: str, line_score) -> Column:
    """Number of the first line with the highest score."""
    scored = F.transform(X.lines_of(lowered), lambda ln, i: F.struct(line_score(ln).alias("s"), (-i).alias("i")))
    return F.col(start) - F.array_max(scored)["i"]


def _lowered(rows: DataFrame) -> DataFrame:
    """Lower-cased text and query as columns t and q, computed once per row."""
    return rows.withColumn("t", F.lower("content")).withColumn("q", F.lower("query"))


def anchored_events(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, event_id): events named in the query, and hits whose id carries a version-round label of it."""
    q = queries.select(
        "qid", F.regexp_extract_all("query", F.lit(r"\bevt_[A-Za-z0-9_.-]+\b"), F.lit(0)).alias("ids"),
        F.transform(F.regexp_extract_all("query", F.lit(r"(?i)\bV\d+[-_]?R\d+\b"), F.lit(0)),
                    lambda x: F.regexp_replace(F.lower(x), r"^(v\d+)[-_]?(r\d+)$", "$1_$2")).alias("rounds"))
    j = hits.select("qid", "event_id").distinct().join(q, "qid")
    named = F.array_contains("ids", F.col("event_id"))
    by_round = F.exists("rounds", lambda r: F.contains(F.lower("event_id"), r))
    return j.where(named | by_round).select("qid", "event_id")


def anchor_score(lowered: str, lowered_query: str, terms: str) -> Column:
    t, q = F.col(lowered), F.col(lowered_query)
    score = _found_terms(t, terms, lambda x: F.when(x.rlike(NUMBER), 20.0).when(x.rlike(r"\d"), 9.0).otherwise(4.0))
    score = score + X.weighted_markers(t, K.ANCHOR_ROLE_WEIGHTS)
    has = lambda m: F.contains(t, F.lit(m))
    final = X.weighted_markers(t, K.ANCHOR_FINAL_BONUS) - F.when(has('"history"') & ~has('"candidate"') & ~has('"decision"'), 8.0).otherwise(0.0)
    score = score + F.when(X.contains_any(q, K.ANCHOR_FINAL_WORDS), final).otherwise(0.0)
    score = score + F.when(X.contains_any(q, K.ANCHOR_GATE_WORDS), X.weighted_markers(t, K.ANCHOR_GATE_BONUS)).otherwise(0.0)
    core = X.contains_any(t, K.ANCHOR_CORE_ROLES)
    score = score - F.when((F.regexp_count(t, F.lit("sha256")) >= 3) & ~core, 24.0).otherwise(0.0)
    return score - F.when(has('"integrity"') & ~core, 10.0).otherwise(0.0)


def rerank_anchor(queries: DataFrame, hits: DataFrame, passages: DataFrame, limit: int) -> DataFrame:
    """Passages of anchored events by role score; ``limit`` per (query, event).

    hits: qid, event_id, score; passages: event_id, passage_id, start_line, end_line, content.
    """
    template = hits.groupBy("qid", "event_id").agg(F.max("score").alias("template_score"))
    pool = template.join(anchored_events(queries, hits), ["qid", "event_id"], "left_semi")
    q = queries.select("qid", "query", X.anchor_terms("query").alias("terms"))
    rows = _lowered(pool.join(q, "qid").join(passages, "event_id"))
    line = lambda ln: _found_terms(ln, "terms", lambda x: F.when(x.rlike(NUMBER), 15.0).otherwise(5.0)) + X.weighted_markers(ln, K.ANCHOR_ROLE_WEIGHTS)
    rows = rows.select(
        "qid", "event_id", "passage_id", "start_line", "end_line", F.round(anchor_score("t", "q", "terms"), 3).alias("role_score"),
        _best_line("t", "start_line", line).alias("focus_line"), "template_score")
    rows = rows.withColumn("hybrid_score", F.round(F.col("template_score") + F.col("role_score") / 1000, 6))
    return scale.top_per_key(rows, ["qid", "event_id"], [F.desc("role_score"), F.desc("hybrid_score"), F.asc("start_line"), F.asc("passage_id")], limit)


def audit_score(lowered: str, lowered_query: str, exact: str, concepts: str) -> Column:
    t, q = F.col(lowered), F.col(lowered_query)
    score = _found_terms(t, exact, lambda x: F.lit(28.0))
    marker_hits = F.lit(0.0)
    for concept, markers in K.AUDIT_ROLE_MARKERS.items():
        n = X.weighted_markers(t, {m: 9.0 for m in markers})
        marker_hits = marker_hits + F.when(F.array_contains(concepts, concept), n).otherwise(0.0)
    score = score + marker_hits + _found_terms(t, exact, lambda x: F.lit(9.0))
    score = score + F.when(X.contains_any(q, K.AUDIT_CLAIM_WORDS), X.weighted_markers(t, K.AUDIT_CLAIM_BONUS)).otherwise(0.0)
    tail = ~X.contains_any(q, K.AUDIT_HASH_WORDS) & (F.regexp_count(t, F.lit("sha256")) >= 4) & ~X.contains_any(t, K.AUDIT_SUBSTANTIVE)
    return score - F.when(tail, 22.0).otherwise(0.0)


def rerank_audit(queries: DataFrame, hits: DataFrame, passages: DataFrame, k: int, events: int, per_event: int) -> DataFrame:
    """Audit passages: best ``events`` audit-like events per query, ``per_event`` passages each, top k.

    hits: qid, event_id, path, heading, score.
    """
    like = F.col("path").endswith("audit.json") | F.contains(F.concat(F.lit("/"), "path"), F.lit("/results/")) | F.contains(
        F.lower(F.concat_ws(" ", "event_id", "path", F.coalesce("heading", F.lit("")))), F.lit("audit"))
    template = hits.where(like).groupBy("qid", "event_id").agg(F.max("score").alias("template_score"))
    template = scale.top_per_key(template, ["qid"], [F.desc("template_score"), F.asc("event_id")], events, "event_rank")
    q = queries.select("qid", "query", F.array_distinct(X.exact_terms("query")).alias("exact"), X.asked_concepts("query", K.CONCEPT_ALIASES).alias("concepts"))
    rows = _lowered(template.join(q, "qid").join(passages, "event_id"))

    def line(ln):
        s = _found_terms(ln, "exact", lambda x: F.lit(30.0))
        for concept, markers in K.AUDIT_ROLE_MARKERS.items():
            s = s + F.when(F.array_contains("concepts", concept), X.weighted_markers(ln, {m: 6.0 for m in markers})).otherwise(0.0)
        return s

    rows = rows.select(
        "qid", "event_id", "passage_id", "start_line", "end_line", "template_score",
        F.round(audit_score("t", "q", "exact", "concepts"), 3).alias("role_score"), _best_line("t", "start_line", line).alias("focus_line"))
    rows = rows.withColumn("hybrid_score", F.round(F.col("template_score") + F.col("role_score") / 1000, 6))
    order = [F.desc("role_score"), F.desc("hybrid_score"), F.asc("start_line"), F.asc("passage_id")]
    kept = scale.top_per_key(rows, ["qid", "event_id"], order, per_event, "event_place")
    return scale.top_per_key(kept, ["qid"], order, k)


def timeline(events: DataFrame, key: str, order: str, size: int = 4) -> DataFrame:
    """Events of each key in numeric order, bundled ``size`` by ``size`` into rendered entries.

    events: key, order, event_id, date, status, summary.
    """
    placed = scale.position_in_key(events, [key], order, "_place")
    entry = F.concat(F.lit("EVENT: "), "event_id", F.lit("\nDATE: "), "date", F.lit("\nSTATUS: "), "status", F.lit("\nSUMMARY: "), F.coalesce("summary", F.lit("")))
    b = placed.withColumn("bundle_no", F.floor((F.col("_place") - 1) / size) + 1).withColumn("_e", F.struct("_place", "event_id", "date", entry.alias("entry")))
    g = b.groupBy(key, "bundle_no").agg(F.array_sort(F.collect_list("_e")).alias("e"))
    first, last = F.get("e", F.lit(0)), F.element_at("e", -1)
    return g.select(key, "bundle_no", F.size("e").alias("n_events"), first["event_id"].alias("first_event"), last["event_id"].alias("last_event"),
                    first["date"].alias("first_date"), F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n").alias("content"))


def stage_order(date: str, event_id: str) -> dict[str, Column]:
    """Version and round numbers of an event id (-1 when absent; recovery smoke runs are round 0)."""
    num = lambda p: F.nullif(F.regexp_extract(event_id, p, 1), F.lit("")).cast("int")
    return {
        "version": F.coalesce(num(r"(?i)_vocab_v(\d+)"), F.lit(-1)),
        "round_no": F.coalesce(num(r"(?i)_v\d+_r(\d+)"), F.when(F.contains(F.col(event_id), F.lit("recovery_smoke")), 0).otherwise(-1)),
    }


def metric_anchors(queries: DataFrame, events: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` events, in stage order, whose id carries a round (and version, when named) a metric query asks for.

    events: event_id, date.  The first events per (round, version) are picked before the join, so a
    label shared by a large part of the events meets a query with ``limit`` rows only.
    """
    labels = lambda c, letter: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"(?:^|[^a-z0-9_])({letter}\d+)"), F.lit(1)))
    q = queries.where(X.query_class("query") == "metric").select("qid", labels("query", "r").alias("rounds"), labels("query", "v").alias("versions"))
    named = F.when(F.size("versions") == 0, F.array(F.lit(""))).otherwise(F.col("versions"))
    q = q.select("qid", F.explode("rounds").alias("round"), named.alias("named")).select("qid", "round", F.explode("named").alias("version"))
    part = lambda letter: F.array_distinct(F.filter(F.split(F.lower("event_id"), "_"), lambda p: p.rlike(rf"^{letter}\d+$")))
    e = events.select("event_id", "date").withColumns(stage_order("date", "event_id"))
    order = [F.asc("date"), F.asc("version_no"), F.asc("round_no"), F.asc("event_id")]
    e = e.withColumnRenamed("version", "version_no").select("*", F.explode(part("r")).alias("round"))
    e = e.select("*", F.explode(F.concat(F.array(F.lit("")), part("v"))).alias("version"))
    first = scale.top_per_key(e, ["round", "version"], order, limit, "_place").drop("_place")
    hit = q.join(first, ["round", "version"]).drop("round", "version").distinct()
    return scale.top_per_key(hit, ["qid"], order, limit).select("qid", "event_id", "rank")


# --- grounding -----------------------------------------------------------------------------
def conflicts(evidence: DataFrame) -> DataFrame:
    """Pass / fail verdict words per event, then per query: conflict when both sides or one mixed event.

    evidence: qid, event_id, content.
    """
    any_of = lambda patterns: F.bool_or(F.col("t").rlike("|".join(f"(?:{p})" for p in patterns)))
    e = evidence.withColumn("t", F.lower("content")).groupBy("qid", "event_id").agg(any_of(K.PASS_PATTERNS).alias("p"), any_of(K.FAIL_PATTERNS).alias("f"))
    n = lambda c: F.count(F.when(c, 1))
    g = e.groupBy("qid").agg(n(F.col("p") & ~F.col("f")).alias("n_passed"), n(~F.col("p") & F.col("f")).alias("n_failed"), n(F.col("p") & F.col("f")).alias("n_mixed"))
    return g.withColumn("conflict", ((F.col("n_passed") > 0) & (F.col("n_failed") > 0)) | (F.col("n_mixed") > 0))


def coverage(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Anchors and concepts of each query that no evidence row contains.

    The asked items ride on the query row; only items found in an evidence row are emitted and reduced.
    """
    anchors = F.transform(F.regexp_extract_all("query", F.lit(K.RE_COVERAGE_ANCHOR), F.lit(0)), F.lower)
    items = F.array_distinct(F.concat(anchors, X.asked_concepts("query", K.COVERAGE_ALIASES)))
    q = queries.select("qid", F.array_distinct(anchors).alias("anchors"), items.alias("items"))
    t = F.col("t")
    names = [F.when(X.contains_any(t, words), F.lit(c)) for c, words in K.COVERAGE_ALIASES.items()]
    present = F.filter(F.array(*names), lambda x: x.isNotNull())
    hit = X.bind(present, lambda here: F.filter(
        "items", lambda x: F.when(F.array_contains("anchors", x), F.contains(t, x)).otherwise(F.array_contains(here, x))))
    joined = evidence.withColumn("t", F.lower("content")).join(q.where(F.size("items") > 0), "qid")
    found = joined.select("qid", F.explode(hit).alias("x")).distinct()
    asked = q.select("qid", F.explode("items").alias("x"))
    gone = asked.join(found, ["qid", "x"], "left_anti").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("missing"))
    out = q.join(gone, "qid", "left").select("qid", F.size("items").alias("n_asked"), F.coalesce("missing", F.lit("")).alias("missing"))
    return out.withColumn("status", F.when(F.col("missing") == "", "no_obvious_query_anchor_gap").otherwise("possible_retrieval_gap"))


def ground(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per query: class, evidence counts per category, conflict and coverage.

    evidence: qid, event_id, path, content (the hits with their lines).
    """
    e = evidence.withColumn("t", F.lower("content"))
    e = e.withColumn("category", X.evidence_category("t", "path")).withColumn("role", X.evidence_role("t"))
    n = lambda c: F.count(F.when(F.col("category") == c, 1)).alias(f"n_{c}")
    g = e.groupBy("qid").agg(F.count(F.lit(1)).alias("n_evidence"), n("decision"), n("metric"), n("audit"), n("general"),
                             F.count(F.when(F.col("role") != "unknown", 1)).alias("n_with_role"))
    c = conflicts(evidence).select("qid", "conflict")
    v = coverage(queries, evidence).select("qid", "status", "missing")
    out = queries.select("qid", X.query_class("query").alias("query_class")).join(g, "qid", "left").join(c, "qid", "left").join(v, "qid", "left")
    return out.fillna(0, [x for x in g.columns if x != "qid"]).withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def evidence_blocks(evidence: DataFrame, per_category: int, budget: int) -> DataFrame:
    """The evidence texts a reader of each query gets, in order: (qid, block, event_id, category, role, text, used_bytes).

    evidence: qid, event_id, path, content, score.  Best score first, ties to the smaller event_id.  Of a category the best
    ``per_category`` texts are eligible; blocks are given as long as all texts up to them fit into ``budget`` UTF-8 bytes.
    The limit per category is applied by a two-level top-k, so the running sum sees a few rows of a query, however many
    it has.  Null content counts as empty.
    """
    e = evidence.select("qid", "event_id", "path", "score", F.coalesce("content", F.lit("")).alias("text"))
    e = e.withColumn("t", F.lower("text"))
    e = e.withColumn("category", X.evidence_category("t", "path")).withColumn("role", X.evidence_role("t")).drop("t", "path")
    order = [F.desc("score"), F.asc("event_id")]
    few = scale.top_per_key(e, ["qid", "category"], order, per_category).drop("rank")
    by_query = Window.partitionBy("qid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = few.withColumn("block", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    few = few.withColumn("used_bytes", F.sum(F.octet_length("text").cast("long")).over(by_query))
    return few.where(F.col("used_bytes") <= budget).select("qid", "block", "event_id", "category", "role", "text", "used_bytes")
