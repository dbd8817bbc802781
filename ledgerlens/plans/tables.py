"""The given tables seen as ledger tables, once for Spark and once as SQL CTEs.

Each function reads whole tables.  Faults (wrong hash, bad range, broken chain)
are set by row number so that checks have something to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import scale
from ledgerlens.plans.registry import CTES
from ledgerlens.session import new_folder

_PUBLISHED: dict[tuple[str, str, str], str] = {}


def published(spark: SparkSession, folder: str, name: str, build: Callable[[str], None]) -> str:
    """Folder of something that queries of one session share (an index, passages, vectors), built by the first that asks."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _PUBLISHED:
        base = new_folder(spark, name)
        build(base)
        _PUBLISHED[key] = base
    return _PUBLISHED[key]


def shared(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that queries of one session share, written by the first that asks."""
    return spark.read.parquet(published(spark, folder, name, lambda base: make().write.parquet(base)))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table.  ``documents`` comes as one row group, which one task would read and tokenise: it is written once with
    two files per core, and all queries of a session read that copy."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    if name != "documents":
        return table
    return shared(spark, folder, name, lambda: table.repartition(2 * spark.sparkContext.defaultParallelism))


# --- files, registry, lines --------------------------------------------------
def files(spark, d):
    """Documents as files; every third one ends with a newline, as most real files do."""
    docs = load(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    return docs.selectExpr(
        "doc_id", "concat('docs/', source, '/', doc_id, '.txt') AS path", "sha2(text, 256) AS sha256",
        "CAST(octet_length(text) AS BIGINT) AS size_bytes", "text", "lang", "source",
    )


CTES["files"] = """SELECT doc_id, 'docs/'||source||'/'||doc_id||'.txt' AS path, sha256(text) AS sha256,
  strlen(text)::BIGINT AS size_bytes, text, lang, source
  FROM (SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN text||chr(10) ELSE text END AS text FROM documents)"""


def registry(spark, d):
    return files(spark, d).selectExpr(
        "concat('src_', doc_id) AS source_id",
        "CASE WHEN doc_id % 37 = 5 THEN concat(path, '.old') ELSE path END AS source_path",
        "CASE WHEN doc_id % 31 = 7 THEN sha2(concat(text, '#'), 256) ELSE sha256 END AS source_sha256",
        "lang AS source_type", "doc_id % 2 = 0 AS legacy_import",
    )


CTES["registry"] = """SELECT 'src_'||doc_id AS source_id,
  CASE WHEN doc_id % 37 = 5 THEN path||'.old' ELSE path END AS source_path,
  CASE WHEN doc_id % 31 = 7 THEN sha256(text||'#') ELSE sha256 END AS source_sha256,
  lang AS source_type, doc_id % 2 = 0 AS legacy_import FROM files"""


def source_lines(spark, d):
    from ledgerlens.sources.readers import to_lines

    return to_lines(files(spark, d), ["path", "sha256"], "text")


def line_blocks(spark, d):
    from ledgerlens.operators.evidence import line_blocks as cut

    return shared(spark, d, "line-blocks", lambda: cut(files(spark, d)))


CTES["source_lines"] = """SELECT path, sha256, line_no, lines[line_no] AS text FROM (
  SELECT path, sha256, lines, unnest(range(1, len(lines)+1)) AS line_no
  FROM (SELECT path, sha256, string_split(regexp_replace(text, chr(10)||'$', ''), chr(10)) AS lines FROM files))"""

# --- ledger events -----------------------------------------------------------
EVENT_TYPES = ["decision", "observation", "claim", "execution_session", "negative_result", "reference_document"]
EVENT_STATUSES = ["completed", "active", "approved", "proposed", "superseded"]


def events(spark, d):
    types = ", ".join(f"'{x}'" for x in EVENT_TYPES)
    statuses = ", ".join(f"'{x}'" for x in EVENT_STATUSES)
    labels = load(spark, d, "labels").select("doc_id", "quality", "toxic")
    base = files(spark, d).join(labels, "doc_id", "left")
    return base.selectExpr(
        "concat('evt_', doc_id) AS event_id", "doc_id AS position",
        "CAST(date_add(DATE'2024-01-01', CAST(doc_id % 30 AS INT)) AS STRING) AS date",
        f"element_at(array({types}), CAST(doc_id % 6 AS INT) + 1) AS event_type",
        f"element_at(array({statuses}), CAST(doc_id % 5 AS INT) + 1) AS status",
        "concat('project_', lang) AS project", "source AS workstream",
        "text AS summary",
        "CASE WHEN quality = 1 THEN 'Results' WHEN quality = 0 THEN 'Metadata' ELSE concat('Section ', source) END AS heading",
        "path AS source_path",
        "CASE WHEN doc_id % 17 = 3 THEN sha2(concat('stale', doc_id), 256) ELSE sha256 END AS source_sha256",
        "CAST(1 AS BIGINT) AS line_start",
        "CAST(size(split(regexp_replace(text, r'\\n\\z', ''), '\n')) + CASE WHEN doc_id % 23 = 4 THEN 5 ELSE 0 END AS BIGINT) AS line_end",
        "coalesce(toxic = 1, false) AS requires_human_review",
        "CASE doc_id % 4 WHEN 0 THEN concat('2024-02-', lpad(doc_id % 28 + 1, 2, '0'), 'T10:00:00+09:00') WHEN 3 THEN 'not-a-date' END AS timestamp_end",
        "CASE WHEN doc_id % 4 = 1 THEN concat('2024-02-', lpad(doc_id % 28 + 1, 2, '0'), 'T03:30:00Z') END AS timestamp_start",
    )


CTES["ledger_events"] = f"""SELECT 'evt_'||doc_id AS event_id, doc_id AS position,
  CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS VARCHAR) AS date,
  ({EVENT_TYPES})[doc_id % 6 + 1] AS event_type, ({EVENT_STATUSES})[doc_id % 5 + 1] AS status,
  'project_'||lang AS project, source AS workstream, text AS summary,
  CASE WHEN quality = 1 THEN 'Results' WHEN quality = 0 THEN 'Metadata' ELSE 'Section '||source END AS heading,
  path AS source_path,
  CASE WHEN doc_id % 17 = 3 THEN sha256('stale'||doc_id) ELSE sha256 END AS source_sha256,
  1::BIGINT AS line_start,
  (len(string_split(regexp_replace(text, chr(10)||'$', ''), chr(10))) + CASE WHEN doc_id % 23 = 4 THEN 5 ELSE 0 END)::BIGINT AS line_end,
  coalesce(toxic = 1, false) AS requires_human_review,
  CASE doc_id % 4 WHEN 0 THEN '2024-02-'||lpad((doc_id % 28 + 1)::VARCHAR, 2, '0')||'T10:00:00+09:00' WHEN 3 THEN 'not-a-date' END AS timestamp_end,
  CASE WHEN doc_id % 4 = 1 THEN '2024-02-'||lpad((doc_id % 28 + 1)::VARCHAR, 2, '0')||'T03:30:00Z' END AS timestamp_start
  FROM files LEFT JOIN labels USING (doc_id)"""


def event_sources(spark, d):
    """Two cited ranges per event: the whole range, and the range without its first line."""
    e = events(spark, d)
    cols = ["event_id", "source_path", "source_sha256", "heading", "requires_human_review"]
    return (
        e.select(*cols, F.posexplode(F.array(
            F.struct("line_start", "line_end"),
            F.struct(F.least(F.col("line_start") + 1, F.col("line_end")).alias("line_start"), "line_end"),
        )).alias("source_ordinal", "r"))
        .select(*cols, F.col("source_ordinal").cast("bigint").alias("source_ordinal"), "r.line_start", "r.line_end")
    )


CTES["event_sources"] = """SELECT event_id, source_path, source_sha256, heading, requires_human_review, source_ordinal,
  CASE source_ordinal WHEN 0 THEN line_start ELSE least(line_start + 1, line_end) END AS line_start, line_end
  FROM ledger_events, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS source_ordinal) o"""


def edges(spark, d):
    """derived_from edges of the events, some repeated, plus generated_from edges of the orders."""
    e = events(spark, d)
    derived = e.selectExpr("event_id", "'derived_from' AS type", "concat('evt_', position - 1) AS target")
    again = e.selectExpr("event_id", "'derived_from' AS type", "concat('evt_', position - 1 - position % 3) AS target")
    orders = load(spark, d, "orders").selectExpr(
        "concat('ord_', o_orderkey) AS event_id", "'generated_from' AS type", "concat('cust_', o_custkey) AS target")
    return derived.unionByName(again).unionByName(orders)


CTES["edges"] = """SELECT event_id, 'derived_from' AS type, 'evt_'||(position - 1) AS target FROM ledger_events
  UNION ALL SELECT event_id, 'derived_from', 'evt_'||(position - 1 - position % 3) FROM ledger_events
  UNION ALL SELECT 'ord_'||o_orderkey, 'generated_from', 'cust_'||o_custkey FROM orders"""


# --- orders as records that supersede each other ------------------------------
def order_records(spark, d):
    return load(spark, d, "orders").selectExpr(
        "concat('ord_', o_orderkey) AS record_id", "o_orderkey AS position",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'proposed' ELSE 'rejected' END AS status",
        "CASE WHEN o_custkey % 9 = 0 THEN 'amendment' ELSE 'observation' END AS record_kind",
        "CASE WHEN o_custkey % 9 = 0 THEN 'corrects' ELSE 'supersedes' END AS relation_type",
        "concat('ord_', o_orderkey - 1 - o_custkey % 3) AS target_id",
        "CASE WHEN o_orderkey % 43 = 1 THEN 'Withdrawn' WHEN o_orderkey % 47 = 2 THEN 'refuted' ELSE 'supported' END AS support_status",
        "o_orderkey % 53 = 3 AS retracted",
    )


CTES["order_records"] = """SELECT 'ord_'||o_orderkey AS record_id, o_orderkey AS position,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'proposed' ELSE 'rejected' END AS status,
  CASE WHEN o_custkey % 9 = 0 THEN 'amendment' ELSE 'observation' END AS record_kind,
  CASE WHEN o_custkey % 9 = 0 THEN 'corrects' ELSE 'supersedes' END AS relation_type,
  'ord_'||(o_orderkey - 1 - o_custkey % 3) AS target_id,
  CASE WHEN o_orderkey % 43 = 1 THEN 'Withdrawn' WHEN o_orderkey % 47 = 2 THEN 'refuted' ELSE 'supported' END AS support_status,
  o_orderkey % 53 = 3 AS retracted FROM orders"""


# --- claims and evidence references -------------------------------------------
CLAIM_KINDS = ["factual", "result", "comparative", "causal", "release", "recommendation", "creative"]


def claims(spark, d):
    kinds = ", ".join(f"'{x}'" for x in CLAIM_KINDS)
    return load(spark, d, "benchmark").selectExpr(
        "concat('claim_', item_id) AS claim_id", "text AS claim",
        f"element_at(array({kinds}), CAST(item_id % 7 AS INT) + 1) AS claim_type",
        "CASE item_id % 5 WHEN 0 THEN 'material' WHEN 1 THEN 'routine' ELSE 'auto' END AS materiality",
    )


CTES["claims"] = f"""SELECT 'claim_'||item_id AS claim_id, text AS claim, ({CLAIM_KINDS})[item_id % 7 + 1] AS claim_type,
  CASE item_id % 5 WHEN 0 THEN 'material' WHEN 1 THEN 'routine' ELSE 'auto' END AS materiality FROM benchmark"""


def evidence_refs(spark, d):
    """Every event is cited once; the claim number is the event number folded to the number of claims."""
    n = load(spark, d, "benchmark").agg(F.count(F.lit(1))).scalar()
    return events(spark, d).withColumn("_n", n).selectExpr(
        "concat('ref_', position) AS ref_id", "concat('claim_', position % _n) AS claim_id", "event_id",
        "source_path AS path", "line_start AS start_line", "line_end AS end_line",
        "source_sha256 AS expected_sha256",
    )


CTES["evidence_refs"] = """SELECT 'ref_'||position AS ref_id, 'claim_'||(position % (SELECT count(*) FROM benchmark)) AS claim_id, event_id,
  source_path AS path, line_start AS start_line, line_end AS end_line, source_sha256 AS expected_sha256
  FROM ledger_events"""


# --- amendments ----------------------------------------------------------------
def amendments(spark, d):
    """Events as amendments of the field ``event_type`` of record ``user_id``, some stale or pending."""
    e = load(spark, d, "events").selectExpr(
        "event_id AS position", "concat('amd_', event_id) AS amendment_id", "concat('rec_', user_id) AS target_id",
        "concat('/payload/', event_type) AS pointer", "event_type AS k",
        "CAST(CAST(round(value * 100) AS BIGINT) AS STRING) AS corrected_value",
        "CASE WHEN event_id % 41 = 2 THEN 'proposed' ELSE 'completed' END AS status",
    )
    e = scale.previous_row(e, ["target_id", "k"], "position", {"before": "corrected_value"})
    return e.selectExpr(
        "position", "amendment_id", "target_id", "pointer", "status", "corrected_value",
        "CASE WHEN position % 50 = 0 THEN '-1' ELSE coalesce(before, '0') END AS recorded_value",
    )


CTES["amendments"] = """SELECT event_id AS position, 'amd_'||event_id AS amendment_id, 'rec_'||user_id AS target_id,
  '/payload/'||event_type AS pointer, CASE WHEN event_id % 41 = 2 THEN 'proposed' ELSE 'completed' END AS status,
  CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS corrected_value,
  CASE WHEN event_id % 50 = 0 THEN '-1' ELSE coalesce(lag(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR))
    OVER (PARTITION BY user_id, event_type ORDER BY event_id), '0') END AS recorded_value FROM events"""


def payloads(spark, d):
    """Original payload fields of the amended records (field ``error`` is missing for some)."""
    return load(spark, d, "events").selectExpr(
        "concat('rec_', user_id) AS record_id", "CASE WHEN event_type = 'error' AND user_id % 10 = 3 THEN 'gone' ELSE event_type END AS k"
    ).distinct().selectExpr("record_id", "k", "'0' AS value")


CTES["payloads"] = """SELECT DISTINCT 'rec_'||user_id AS record_id, CASE WHEN event_type = 'error' AND user_id % 10 = 3 THEN 'gone' ELSE event_type END AS k, '0' AS value FROM events"""


# --- usage, runs, traces ---------------------------------------------------------
def usage(spark, d):
    return load(spark, d, "events").selectExpr(
        "event_id", "'usage-observation/1.0' AS schema_version", "CAST(ts AS STRING) AS observed_at", "ts",
        "concat('run_', user_id % 20) AS run_id", "concat('wf_', user_id) AS workflow_id",
        "concat('agent_', user_id % 3) AS agent_id",
        "CASE event_type WHEN 'click' THEN 'retrieval' WHEN 'view' THEN 'review' WHEN 'purchase' THEN 'code_generation' WHEN 'signup' THEN 'agent_generation' ELSE 'other' END AS activity_category",
        "CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'purchase' THEN 'host_reported' ELSE 'provider_reported' END AS source",
        "CASE WHEN event_type <> 'error' THEN CAST(get_json_object(props, '$.k') AS BIGINT) END AS input_tokens",
        "CASE WHEN event_type <> 'error' THEN CAST(get_json_object(props, '$.k') AS BIGINT) * 2 + 1 END AS output_tokens",
        "CASE WHEN event_type <> 'error' THEN CAST(get_json_object(props, '$.k') AS BIGINT) * 3 + 1 + CASE WHEN event_id % 53 = 9 THEN 1 ELSE 0 END END AS total_tokens",
        "CASE WHEN event_type = 'error' AND event_id % 59 <> 0 THEN concat('provider_error_', user_id % 2) END AS unavailable_reason",
    )


CTES["usage_rows"] = """SELECT event_id, 'usage-observation/1.0' AS schema_version, CAST(ts AS VARCHAR) AS observed_at, ts,
  'run_'||(user_id % 20) AS run_id, 'wf_'||user_id AS workflow_id, 'agent_'||(user_id % 3) AS agent_id,
  CASE event_type WHEN 'click' THEN 'retrieval' WHEN 'view' THEN 'review' WHEN 'purchase' THEN 'code_generation' WHEN 'signup' THEN 'agent_generation' ELSE 'other' END AS activity_category,
  CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'purchase' THEN 'host_reported' ELSE 'provider_reported' END AS source,
  CASE WHEN event_type <> 'error' THEN kk END AS input_tokens, CASE WHEN event_type <> 'error' THEN kk * 2 + 1 END AS output_tokens,
  CASE WHEN event_type <> 'error' THEN kk * 3 + 1 + CASE WHEN event_id % 53 = 9 THEN 1 ELSE 0 END END AS total_tokens,
  CASE WHEN event_type = 'error' AND event_id % 59 <> 0 THEN 'provider_error_'||(user_id % 2) END AS unavailable_reason
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS kk FROM events)"""


def runs(spark, d):
    """Events as benchmark runs: one arm per event type, repetitions counted per task and arm."""
    e = load(spark, d, "events").selectExpr(
        "event_id", "concat('trial.', event_id) AS trial_id", "concat('task_', user_id) AS task_id", "user_id",
        "CASE event_type WHEN 'click' THEN 'filesystem' WHEN 'view' THEN 'mcp' WHEN 'purchase' THEN 'mcp_evidence_only' WHEN 'signup' THEN 'mcp_claim_gate' ELSE 'filesystem_manifest' END AS condition",
        "CASE WHEN event_id % 61 = 4 THEN 'failed' ELSE 'completed' END AS run_status",
        "CASE WHEN event_id % 67 = 5 THEN 'pending' ELSE 'completed' END AS evaluation_status",
        "value AS latency_ms", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    )
    e = scale.position_in_key(e, ["task_id", "condition"], "event_id", "repetition")
    return e.selectExpr(
        "*",
        "CASE WHEN k % 7 <> 0 THEN k * 3 + 1 END AS provider_total_tokens", "k * 3 AS standardized_tokens",
        "k AS input_tokens", "k * 2 + 1 AS output_tokens", "k % 5 AS cached_input_tokens", "k % 3 AS reasoning_tokens",
        "k % 4 AS mcp_calls", "k % 6 AS filesystem_calls", "k % 2 AS gate_calls", "k % 9 AS model_calls",
        "k * 10 AS tool_response_bytes", "round(k * 0.01, 2) AS cost_usd",
        "CAST(k % 3 = 0 AS INT) AS audit_ready_success", "CAST(k % 2 = 0 AS INT) AS task_success",
        "round(k / 100.0D, 2) AS factual_correctness", "round((100 - k) / 100.0D, 2) AS evidence_grounding",
        "round((k % 10) / 10.0D, 1) AS citation_validity", "round((k % 5) / 5.0D, 1) AS policy_compliance",
        "round((k % 4) / 4.0D, 2) AS uncertainty_calibration",
        "k % 3 AS unsupported_claim_count", "k % 2 AS policy_violation_count",
        "CAST(k % 10 <> 0 AS INT) AS answer_emitted", "CAST(k % 4 <> 0 AS INT) AS material_claim_emitted",
        "CAST(k % 3 <> 0 AS INT) AS gate_required", "CAST(k % 5 <> 0 AS INT) AS gate_called",
        "CASE k % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'eligible' WHEN 2 THEN 'not_required' ELSE 'not_called' END AS gate_status",
        "CAST(k % 8 = 0 AS INT) AS unsafe_material_claim", "CAST(k % 9 = 0 AS INT) AS false_block",
        "CAST(k % 6 <> 0 AS INT) AS evidence_binding_valid", "CAST(k % 7 <> 0 AS INT) AS citation_support_valid",
        "CAST(k % 11 <> 0 AS INT) AS citation_support_complete",
    )


CTES["runs"] = """SELECT *, CASE WHEN k % 7 <> 0 THEN k * 3 + 1 END AS provider_total_tokens, k * 3 AS standardized_tokens,
  k AS input_tokens, k * 2 + 1 AS output_tokens, k % 5 AS cached_input_tokens, k % 3 AS reasoning_tokens,
  k % 4 AS mcp_calls, k % 6 AS filesystem_calls, k % 2 AS gate_calls, k % 9 AS model_calls,
  k * 10 AS tool_response_bytes, round(k * 0.01, 2)::DOUBLE AS cost_usd,
  (k % 3 = 0)::INT AS audit_ready_success, (k % 2 = 0)::INT AS task_success,
  round(k / 100.0::DOUBLE, 2) AS factual_correctness, round((100 - k) / 100.0::DOUBLE, 2) AS evidence_grounding,
  round((k % 10) / 10.0::DOUBLE, 1) AS citation_validity, round((k % 5) / 5.0::DOUBLE, 1) AS policy_compliance,
  round((k % 4) / 4.0::DOUBLE, 2) AS uncertainty_calibration,
  k % 3 AS unsupported_claim_count, k % 2 AS policy_violation_count,
  (k % 10 <> 0)::INT AS answer_emitted, (k % 4 <> 0)::INT AS material_claim_emitted,
  (k % 3 <> 0)::INT AS gate_required, (k % 5 <> 0)::INT AS gate_called,
  CASE k % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'eligible' WHEN 2 THEN 'not_required' ELSE 'not_called' END AS gate_status,
  (k % 8 = 0)::INT AS unsafe_material_claim, (k % 9 = 0)::INT AS false_block,
  (k % 6 <> 0)::INT AS evidence_binding_valid, (k % 7 <> 0)::INT AS citation_support_valid,
  (k % 11 <> 0)::INT AS citation_support_complete
  FROM (SELECT *, row_number() OVER (PARTITION BY task_id, condition ORDER BY event_id) AS repetition FROM (
   SELECT event_id, 'trial.'||event_id AS trial_id, 'task_'||user_id AS task_id, user_id,
    CASE event_type WHEN 'click' THEN 'filesystem' WHEN 'view' THEN 'mcp' WHEN 'purchase' THEN 'mcp_evidence_only' WHEN 'signup' THEN 'mcp_claim_gate' ELSE 'filesystem_manifest' END AS condition,
    CASE WHEN event_id % 61 = 4 THEN 'failed' ELSE 'completed' END AS run_status,
    CASE WHEN event_id % 67 = 5 THEN 'pending' ELSE 'completed' END AS evaluation_status,
    value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def tasks(spark, d):
    """One task per customer key; users without a customer have runs of unknown tasks."""
    return load(spark, d, "customer").selectExpr(
        "concat('task_', c_custkey - CAST(c_custkey % 29 = 28 AS INT)) AS task_id", "c_custkey",
        "'bundle.' || c_nationkey AS source_bundle_id",
        "CASE c_custkey % 9 WHEN 8 THEN 'unknown_category' ELSE element_at(array('evidence_retrieval','claim_verification','approval_governance','integrity_change','negative_result','contribution_attribution','amendment_history','uncertainty_calibration'), CAST(c_custkey % 8 AS INT) + 1) END AS category",
        "CASE WHEN c_custkey % 3 = 0 THEN 'current_supported' ELSE element_at(array('post_index_mutation','path_reuse','missing_evidence','conflicting_evidence'), CAST(c_custkey % 4 AS INT) + 1) END AS evidence_state",
        "CASE WHEN c_custkey % 3 = 0 AND c_custkey % 21 <> 0 THEN NULL ELSE 'not_applicable' END AS fault_injected_at",
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'routine' ELSE 'material' END AS materiality",
        "c_mktsegment AS prompt", "c_acctbal >= 0 AS holdout",
    )


CTES["tasks"] = """SELECT 'task_'||(c_custkey - (c_custkey % 29 = 28)::INT) AS task_id, c_custkey, 'bundle.'||c_nationkey AS source_bundle_id,
  CASE c_custkey % 9 WHEN 8 THEN 'unknown_category' ELSE (['evidence_retrieval','claim_verification','approval_governance','integrity_change','negative_result','contribution_attribution','amendment_history','uncertainty_calibration'])[c_custkey % 8 + 1] END AS category,
  CASE WHEN c_custkey % 3 = 0 THEN 'current_supported' ELSE (['post_index_mutation','path_reuse','missing_evidence','conflicting_evidence'])[c_custkey % 4 + 1] END AS evidence_state,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 21 <> 0 THEN NULL ELSE 'not_applicable' END AS fault_injected_at,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'routine' ELSE 'material' END AS materiality,
  c_mktsegment AS prompt, c_acctbal >= 0 AS holdout FROM customer"""


def traces(spark, d):
    return load(spark, d, "events").selectExpr(
        "concat('trial_', user_id) AS trial_id", "event_id AS seq",
        "CASE event_type WHEN 'purchase' THEN 'turn.completed' WHEN 'error' THEN 'error' ELSE 'item.completed' END AS type",
        "CASE event_type WHEN 'click' THEN 'mcp_tool_call' WHEN 'signup' THEN 'mcp_tool_call' WHEN 'view' THEN 'command_execution' END AS item_type",
        "CASE event_type WHEN 'click' THEN 'memory_search_candidates' WHEN 'signup' THEN 'memory_gate_claim' END AS tool",
        "CASE WHEN event_type = 'signup' THEN CASE CAST(get_json_object(props, '$.k') AS BIGINT) % 9 WHEN 0 THEN 'blocked' WHEN 1 THEN 'other' ELSE 'eligible' END END AS gate_status",
        "CASE WHEN event_type = 'purchase' THEN CAST(get_json_object(props, '$.k') AS BIGINT) END AS input_tokens",
        "CASE WHEN event_type = 'purchase' THEN CAST(get_json_object(props, '$.k') AS BIGINT) + 7 END AS output_tokens",
        "CASE WHEN event_type = 'error' THEN CASE WHEN CAST(get_json_object(props, '$.k') AS BIGINT) % 10 = 0 THEN 'Usage Limit reached' ELSE 'timeout' END END AS message",
    )


CTES["traces"] = """SELECT 'trial_'||user_id AS trial_id, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'turn.completed' WHEN 'error' THEN 'error' ELSE 'item.completed' END AS type,
  CASE event_type WHEN 'click' THEN 'mcp_tool_call' WHEN 'signup' THEN 'mcp_tool_call' WHEN 'view' THEN 'command_execution' END AS item_type,
  CASE event_type WHEN 'click' THEN 'memory_search_candidates' WHEN 'signup' THEN 'memory_gate_claim' END AS tool,
  CASE WHEN event_type = 'signup' THEN CASE kk % 9 WHEN 0 THEN 'blocked' WHEN 1 THEN 'other' ELSE 'eligible' END END AS gate_status,
  CASE WHEN event_type = 'purchase' THEN kk END AS input_tokens, CASE WHEN event_type = 'purchase' THEN kk + 7 END AS output_tokens,
  CASE WHEN event_type = 'error' THEN CASE WHEN kk % 10 = 0 THEN 'Usage Limit reached' ELSE 'timeout' END END AS message
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS kk FROM events)"""


# --- governance decisions ----------------------------------------------------------
def decisions(spark, d):
    """Lineitems as reviewer decisions of a run (order), one finding each."""
    return load(spark, d, "lineitem").selectExpr(
        "concat('run_', l_orderkey) AS run_id", "concat('agent_', l_linenumber) AS agent_id",
        "concat('f_', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey) AS finding_id",
        "CASE CAST(l_quantity AS BIGINT) % 10 WHEN 0 THEN 'blocked' WHEN 1 THEN 'inconclusive' WHEN 2 THEN 'warn' WHEN 3 THEN 'odd' ELSE 'pass' END AS status",
        "CASE l_returnflag WHEN 'R' THEN CASE WHEN l_quantity > 45 THEN 'critical' ELSE 'low' END WHEN 'A' THEN CASE WHEN l_quantity > 40 THEN 'high' ELSE 'note' END ELSE 'medium' END AS severity",
        "CASE WHEN l_discount >= 0.09D THEN 'reject_claim' WHEN l_discount <= 0.01D THEN 'no_material_objection_found' END AS reviewer_verdict",
        "l_partkey % 11 <> 0 AS has_evidence", "l_partkey % 13 <> 0 AS read_only",
        "CASE l_linestatus WHEN 'F' THEN 'write_ledger' ELSE 'read_sources' END AS action_used",
        "CASE WHEN l_tax >= 0.07D THEN 'publication' WHEN l_tax >= 0.04D THEN 'factual' ELSE 'causal' END AS claim_type",
        "l_tax AS declared_cost", "l_discount AS max_cost", "l_partkey % 5 + 1 AS max_parallelism",
    )


CTES["decisions"] = """SELECT 'run_'||l_orderkey AS run_id, 'agent_'||l_linenumber AS agent_id,
  'f_'||l_orderkey||'_'||l_linenumber||'_'||l_partkey||'_'||l_suppkey AS finding_id,
  CASE CAST(l_quantity AS BIGINT) % 10 WHEN 0 THEN 'blocked' WHEN 1 THEN 'inconclusive' WHEN 2 THEN 'warn' WHEN 3 THEN 'odd' ELSE 'pass' END AS status,
  CASE l_returnflag WHEN 'R' THEN CASE WHEN l_quantity > 45 THEN 'critical' ELSE 'low' END WHEN 'A' THEN CASE WHEN l_quantity > 40 THEN 'high' ELSE 'note' END ELSE 'medium' END AS severity,
  CASE WHEN l_discount >= 0.09::DOUBLE THEN 'reject_claim' WHEN l_discount <= 0.01::DOUBLE THEN 'no_material_objection_found' END AS reviewer_verdict,
  l_partkey % 11 <> 0 AS has_evidence, l_partkey % 13 <> 0 AS read_only,
  CASE l_linestatus WHEN 'F' THEN 'write_ledger' ELSE 'read_sources' END AS action_used,
  CASE WHEN l_tax >= 0.07::DOUBLE THEN 'publication' WHEN l_tax >= 0.04::DOUBLE THEN 'factual' ELSE 'causal' END AS claim_type,
  l_tax AS declared_cost, l_discount AS max_cost, l_partkey % 5 + 1 AS max_parallelism FROM lineitem"""


def packets(spark, d):
    return load(spark, d, "orders").selectExpr(
        "concat('run_', o_orderkey) AS run_id",
        "CASE WHEN o_orderpriority = '5-LOW' THEN array('read_sources') ELSE array('read_sources', 'write_ledger') END AS allowed_actions")


CTES["packets"] = """SELECT 'run_'||o_orderkey AS run_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN ['read_sources'] ELSE ['read_sources', 'write_ledger'] END AS allowed_actions FROM orders"""


# --- runtime events (conversations) ---------------------------------------------------
def runtime_events(spark, d):
    c = load(spark, d, "conversations").selectExpr(
        "concat('run_', conv_id) AS run_id", "turn + 1 AS sequence",
        "CASE WHEN turn = 0 THEN 'created' WHEN turn = 1 THEN 'materialized' WHEN turn = 2 THEN 'preflight_passed' WHEN turn = 3 THEN 'governor_running' WHEN turn = 4 THEN 'governed' WHEN turn = 5 THEN 'workers_running' ELSE 'completed' END AS to_state",
        "role", "text", "sha2(concat(conv_id, '|', turn + 1, '|', role, '|', text), 256) AS event_hash", "conv_id",
    )
    c = scale.previous_row(c, ["run_id"], "sequence", {"h": "event_hash", "s": "to_state"})
    return c.selectExpr(
        "run_id", "sequence", "role", "text", "to_state",
        "CASE WHEN (conv_id + sequence) % 31 = 3 THEN 'stopping' ELSE s END AS from_state",
        "CASE WHEN (conv_id + sequence) % 29 = 2 THEN concat('x', h) ELSE h END AS previous_event_hash",
        "CASE WHEN (conv_id + sequence) % 37 = 4 THEN concat('y', event_hash) ELSE event_hash END AS event_hash",
    )


CTES["runtime_events"] = """SELECT run_id, sequence, role, text, to_state,
  CASE WHEN (conv_id + sequence) % 31 = 3 THEN 'stopping' ELSE lag(to_state) OVER w END AS from_state,
  CASE WHEN (conv_id + sequence) % 29 = 2 THEN 'x'||lag(h) OVER w ELSE lag(h) OVER w END AS previous_event_hash,
  CASE WHEN (conv_id + sequence) % 37 = 4 THEN 'y'||h ELSE h END AS event_hash
  FROM (SELECT 'run_'||conv_id AS run_id, conv_id, turn + 1 AS sequence, role, text,
   CASE WHEN turn = 0 THEN 'created' WHEN turn = 1 THEN 'materialized' WHEN turn = 2 THEN 'preflight_passed' WHEN turn = 3 THEN 'governor_running' WHEN turn = 4 THEN 'governed' WHEN turn = 5 THEN 'workers_running' ELSE 'completed' END AS to_state,
   sha256(conv_id||'|'||(turn + 1)||'|'||role||'|'||text) AS h FROM conversations)
  WINDOW w AS (PARTITION BY run_id ORDER BY sequence)"""


# --- retrieval inputs ------------------------------------------------------------------
def search_queries(spark, d):
    return load(spark, d, "benchmark").selectExpr("item_id AS qid", "text AS query")


CTES["search_queries"] = "SELECT item_id AS qid, text AS query FROM benchmark"
