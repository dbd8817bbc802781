"""Queries over runs: usage, paired benchmarks, integrity reports, traces, governance, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens import scale
from ledgerlens.operators import analysis as A
from ledgerlens.operators import evidence as E
from ledgerlens.operators import fusion as U
from ledgerlens.operators import governance as G
from ledgerlens.operators import rerank as RR
from ledgerlens.operators import validation as V
from ledgerlens.operators import vectors as VX
from ledgerlens.plans import tables as T
from ledgerlens.plans.registry import CTES, query

# --- B: run and decision rules ---------------------------------------------------------
CTES["usage_checked"] = """SELECT *, CASE WHEN source = 'unavailable' AND (unavailable_reason IS NULL OR trim(unavailable_reason) = '') THEN 'unavailable_reason must be a non-empty string'
  WHEN source <> 'unavailable' AND input_tokens + output_tokens <> total_tokens THEN 'input_tokens plus output_tokens must equal total_tokens' END AS message FROM usage_rows"""


@query("b9_usage_rules", "SELECT event_id, message FROM usage_checked WHERE message IS NOT NULL")
def b9(spark, d):
    return V.validate_usage(T.usage(spark, d))


@query("b10_task_rules", """
SELECT task_id AS record_id, '/category' AS path, 'unknown task category' AS message, 'blocking' AS severity FROM tasks WHERE category = 'unknown_category'
UNION ALL SELECT task_id, '/holdout', 'benchmark tasks must be marked holdout', 'blocking' FROM tasks WHERE NOT holdout""")
def b10(spark, d):
    return V.validate_tasks(T.tasks(spark, d))


@query("b10_integrity_task_rules", """
SELECT task_id AS record_id, '/fault_injected_at' AS path, 'current evidence must not declare a fault injection' AS message, 'blocking' AS severity
FROM tasks WHERE evidence_state = 'current_supported' AND fault_injected_at IS NOT NULL""")
def b10b(spark, d):
    return V.validate_integrity_tasks(T.tasks(spark, d))


_TWO_ARMS = "(CASE WHEN condition IN ('filesystem', 'mcp') THEN 1 END)"


@query("b10_run_rules", """
SELECT trial_id AS record_id, '/condition' AS path, 'condition is not an arm of this benchmark' AS message, 'blocking' AS severity FROM runs WHERE condition NOT IN ('filesystem', 'mcp')
UNION ALL SELECT trial_id, '/usage/provider_total_tokens', 'provider total must equal input + output under declared semantics', 'blocking' FROM runs WHERE provider_total_tokens <> input_tokens + output_tokens
UNION ALL SELECT trial_id, '/usage/cached_input_tokens', 'cached input tokens cannot exceed input tokens', 'blocking' FROM runs WHERE cached_input_tokens > input_tokens
UNION ALL SELECT trial_id, '/usage/reasoning_tokens', 'reasoning tokens cannot exceed output tokens', 'blocking' FROM runs WHERE reasoning_tokens > output_tokens
UNION ALL SELECT trial_id, '/calls/mcp_calls_started', 'filesystem baseline cannot make MCP calls', 'blocking' FROM runs WHERE condition = 'filesystem' AND mcp_calls <> 0""")
def b10c(spark, d):
    return V.validate_runs(T.runs(spark, d), K.AB_CONDITIONS)


@query("b10_integrity_run_rules", """
SELECT trial_id AS record_id, '/condition' AS path, 'run condition is unsupported' AS message, 'blocking' AS severity FROM runs WHERE condition = 'mcp'
UNION ALL SELECT trial_id, '/evaluation/gate_status', 'called gate cannot have not_called status', 'blocking' FROM runs WHERE evaluation_status = 'completed' AND gate_called = 1 AND gate_status = 'not_called'""")
def b10d(spark, d):
    return V.validate_integrity_runs(T.runs(spark, d))


@query("b11_bundle_rules", """
SELECT task_id AS subject, 'duplicate task_id' AS message FROM tasks GROUP BY task_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT task_id, 'run references unknown task' FROM runs WHERE task_id NOT IN (SELECT task_id FROM tasks)
UNION ALL SELECT task_id||'|'||repetition, 'unpaired runs' FROM runs WHERE condition IN ('filesystem', 'mcp') GROUP BY task_id, repetition HAVING count(DISTINCT condition) < 2""")
def b11(spark, d):
    return V.validate_bundle(T.tasks(spark, d), T.runs(spark, d), K.AB_CONDITIONS, True)


@query("b13_vector_quality", """
SELECT label::BIGINT AS label, count(*) AS n, count(*) FILTER (len(embedding) = 64) AS n_width_ok, count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-5) AS n_unit,
 count(*) FILTER (abs(sqrt(list_inner_product((embedding[1:32])::DOUBLE[], (embedding[1:32])::DOUBLE[])) - 1) <= 1e-5) AS n_half_unit FROM embeddings GROUP BY label""")
def b13(spark, d):
    q = VX.vector_quality(T.load(spark, d, "embeddings"), "embedding", 64)
    half = F.abs(F.sqrt(F.aggregate(F.slice("embedding", 1, 32), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) - 1) <= 1e-5
    n = lambda c: F.count(F.when(c, 1))
    return q.groupBy("label").agg(F.count(F.lit(1)).alias("n"), n(F.col("width_ok") & F.col("finite") & F.col("nonzero")).alias("n_width_ok"), n(F.col("unit")).alias("n_unit"), n(half).alias("n_half_unit"))


@query("b14_decision_rules", """
WITH j AS (SELECT x.*, p.allowed_actions, p.run_id IS NOT NULL AS known FROM decisions x LEFT JOIN packets p USING (run_id))
SELECT finding_id AS record_id, '/run_id' AS path, 'run_id must match the task packet' AS message, 'blocking' AS severity FROM j WHERE NOT known
UNION ALL SELECT finding_id, '/status', 'status must be pass, warn, fail, inconclusive, or blocked', 'blocking' FROM j WHERE status = 'odd'
UNION ALL SELECT finding_id, '/authority_used', 'authority_used exceeds task scope: '||action_used, 'blocking' FROM j WHERE known AND NOT list_contains(allowed_actions, action_used)
UNION ALL SELECT finding_id, '/findings', 'finding needs at least one evidence reference', 'blocking' FROM j WHERE NOT has_evidence
UNION ALL SELECT finding_id, '/authority', 'reviewer must not hold write authority', 'blocking' FROM j WHERE NOT read_only AND reviewer_verdict IS NOT NULL""")
def b14(spark, d):
    return V.check_decisions(T.decisions(spark, d), T.packets(spark, d))


@query("b15_batch_preflight", """
WITH p AS (SELECT 'batch_'||l_orderkey AS batch_id, CASE WHEN l_linenumber = 1 THEN 'scope_and_cost_governor' ELSE 'agent_'||l_linenumber END AS agent_id, l_returnflag = 'R' AS crit,
  l_partkey % 5 + 1 AS par, l_tax::DECIMAL(18,4) AS cost, l_tax > l_discount AS over_cap FROM lineitem),
b AS (SELECT batch_id, count(*) AS n_packets, count(DISTINCT agent_id) AS n_agents, count(*) FILTER (agent_id = 'scope_and_cost_governor') AS g,
  coalesce(bool_or(crit) FILTER (agent_id <> 'scope_and_cost_governor'), false) AS some_c, coalesce(bool_and(crit) FILTER (agent_id <> 'scope_and_cost_governor'), true) AS all_c,
  min(par) FILTER (agent_id <> 'scope_and_cost_governor') AS par, sum(cost) AS total, count(*) FILTER (over_cap) AS n_over FROM p GROUP BY batch_id)
SELECT batch_id, n_packets, n_agents, total::DOUBLE AS total_cost, issues, issues = '' AS passed FROM (SELECT *, concat_ws(';', CASE WHEN g <> 1 THEN 'governor' END, CASE WHEN n_packets <> n_agents THEN 'duplicate_agent' END,
  CASE WHEN some_c AND NOT all_c THEN 'mixed_roles' END, CASE WHEN 3 > par THEN 'parallelism' END, CASE WHEN n_over > 0 THEN 'agent_cost' END, CASE WHEN total > 0.25 THEN 'total_cost' END) AS issues FROM b)""")
def b15(spark, d):
    p = T.load(spark, d, "lineitem").selectExpr(
        "concat('batch_', l_orderkey) AS batch_id", "CASE WHEN l_linenumber = 1 THEN 'scope_and_cost_governor' ELSE concat('agent_', l_linenumber) END AS agent_id",
        "l_returnflag = 'R' AS is_critical", "l_partkey % 5 + 1 AS max_parallelism", "l_tax AS declared_cost", "l_discount AS max_cost")
    return V.preflight_batches(p, 3, 0.25)


@query("b17_evaluator_coverage", """
WITH r AS (SELECT 'eval.'||(doc_id * 2 // 3) AS evaluation_id, quality BETWEEN 0 AND 1 AND toxic < 1 AS ok FROM labels), e AS (SELECT 'eval.'||doc_id AS evaluation_id FROM documents WHERE lang <> 'de'),
g AS (SELECT evaluation_id, count(*) AS n, bool_and(ok) AS ok FROM r GROUP BY ALL)
SELECT evaluation_id, message FROM (SELECT evaluation_id, CASE WHEN e.evaluation_id IS NULL THEN 'unknown evaluation id' WHEN g.n IS NULL THEN 'missing evaluation' WHEN n > 1 THEN 'duplicate evaluation id'
 WHEN NOT ok THEN 'non-binary evaluator fields' END AS message FROM g FULL OUTER JOIN e USING (evaluation_id)) WHERE message IS NOT NULL""")
def b17(spark, d):
    r = T.load(spark, d, "labels").selectExpr("concat('eval.', doc_id * 2 div 3) AS evaluation_id", "quality BETWEEN 0 AND 1 AND toxic < 1 AS ok")
    return V.check_evaluations(r, T.load(spark, d, "documents").where("lang <> 'de'").selectExpr("concat('eval.', doc_id) AS evaluation_id"))


# --- C20-C22, claims ------------------------------------------------------------------------
CTES["planned"] = """SELECT *, materiality = 'material' OR (materiality = 'auto' AND claim_type IN ('result','comparative','causal','release')) AS active FROM claims"""


@query("c20_claim_plan", """
SELECT claim_id, active, CASE WHEN NOT active THEN 0 WHEN claim_type IN ('comparative','causal','release') THEN 2 ELSE 1 END::BIGINT AS minimum_distinct_evidence,
 CASE WHEN materiality = 'material' THEN 'caller_marked_material' WHEN active THEN 'material_claim_type' ELSE 'routine_claim' END AS activation_reason FROM planned""")
def c20(spark, d):
    return E.claim_plan(T.claims(spark, d)).select("claim_id", "active", "minimum_distinct_evidence", "activation_reason")


@query("g8_eligibility", """
WITH c AS (SELECT claim_id, count(*) AS n_checks, count(*) FILTER (NOT verified) AS n_invalid, count(DISTINCT event_id) AS n_distinct FROM fetched GROUP BY claim_id),
j AS (SELECT p.*, coalesce(n_checks, 0) AS n_checks, coalesce(n_invalid, 0) AS n_invalid, coalesce(n_distinct, 0) AS n_distinct,
 CASE WHEN NOT active THEN 0 WHEN claim_type IN ('comparative','causal','release') THEN 2 ELSE 1 END AS m FROM planned p LEFT JOIN c USING (claim_id))
SELECT claim_id, status, blockers, n_checks, n_invalid, n_distinct FROM (SELECT *, CASE WHEN NOT active THEN 'not_required' WHEN blockers <> '' THEN 'blocked' ELSE 'eligible' END AS status FROM
 (SELECT *, CASE WHEN active THEN concat_ws(',', CASE WHEN n_invalid > 0 THEN 'EVIDENCE-INTEGRITY-INVALID' END, CASE WHEN n_distinct < m THEN 'EVIDENCE-ELIGIBILITY-INSUFFICIENT' END) ELSE '' END AS blockers FROM j))""")
def g8(spark, d):
    checks = E.fetch_evidence(T.evidence_refs(spark, d), T.event_sources(spark, d), T.line_blocks(spark, d), context=0)
    return E.eligibility(T.claims(spark, d), checks).select("claim_id", "status", "blockers", "n_checks", "n_invalid", "n_distinct")


CTES["segments"] = """SELECT 'ans_'||l_orderkey AS answer_id, l_linenumber * 10000000 + l_partkey AS segment_no, 'c_'||l_orderkey||'_'||l_linenumber||'_'||l_partkey AS claim_id,
  l_returnflag||l_linestatus||' '||l_suppkey AS text, CASE l_returnflag WHEN 'A' THEN 'factual' WHEN 'N' THEN 'creative' ELSE 'result' END AS kind,
  l_linestatus = 'F' AS final, l_partkey % 3 = 0 AS external, l_partkey % 4 = 0 AS numerical, l_partkey % 5 = 0 AS citation, l_partkey % 13 = 0 AS benchmark,
  l_suppkey % 17 = 0 AS causal, false AS canonical, l_suppkey % 19 = 0 AS conflicting, l_suppkey % 4 AS n_evidence, l_suppkey::VARCHAR AS evidence_key, l_partkey, l_suppkey FROM
  (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL)"""
CTES["levelled"] = """SELECT *, CASE WHEN benchmark OR causal OR canonical OR conflicting THEN 'L3' WHEN final AND (kind IN ('factual','result') OR external OR numerical OR citation) THEN 'L2'
  WHEN kind IN ('factual','result') OR external THEN 'L1' ELSE 'L0' END AS level FROM segments"""


def segments(spark, d):
    li = T.load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))
    return li.selectExpr(
        "concat('ans_', l_orderkey) AS answer_id", "l_linenumber * 10000000L + l_partkey AS segment_no", "concat_ws('_', 'c', l_orderkey, l_linenumber, l_partkey) AS claim_id",
        "concat(l_returnflag, l_linestatus, ' ', l_suppkey) AS text", "CASE l_returnflag WHEN 'A' THEN 'factual' WHEN 'N' THEN 'creative' ELSE 'result' END AS kind",
        "l_linestatus = 'F' AS final", "l_partkey % 3 = 0 AS external", "l_partkey % 4 = 0 AS numerical", "l_partkey % 5 = 0 AS citation", "l_partkey % 13 = 0 AS benchmark",
        "l_suppkey % 17 = 0 AS causal", "false AS canonical", "l_suppkey % 19 = 0 AS conflicting", "l_suppkey % 4 AS n_evidence", "CAST(l_suppkey AS STRING) AS evidence_key", "l_partkey", "l_suppkey")


@query("c21_claim_level", "SELECT claim_id, level FROM levelled")
def c21(spark, d):
    return E.claim_level(segments(spark, d)).select("claim_id", "level")


@query("g12_render_claims", """
WITH r AS (SELECT claim_id, l_partkey % 2 = 0 AS rp, l_partkey % 3 > 0 AS sp, l_partkey % 5 > 0 AS ip, (l_suppkey + (l_partkey % 23 = 1)::INT)::VARCHAR AS ek FROM segments WHERE n_evidence > 0),
j AS (SELECT s.*, r.claim_id IS NOT NULL AS has, (CASE level WHEN 'L0' THEN true WHEN 'L1' THEN coalesce(rp, false) AND n_evidence > 0 WHEN 'L2' THEN coalesce(sp, false) AND n_evidence > 0
 ELSE coalesce(sp AND ip, false) AND n_evidence > 0 END) AND (r.claim_id IS NULL OR ek = evidence_key) AS ok FROM levelled s LEFT JOIN r USING (claim_id))
SELECT answer_id, answer, blocked_claim_ids, CASE WHEN blocked_claim_ids = '' THEN 'passed' ELSE 'blocked' END AS status FROM (SELECT answer_id, coalesce(string_agg(text, chr(10)||chr(10) ORDER BY segment_no) FILTER (ok), '') AS answer,
 coalesce(string_agg(claim_id, ',' ORDER BY segment_no) FILTER (NOT ok), '') AS blocked_claim_ids FROM j GROUP BY answer_id)""")
def g12(spark, d):
    s = segments(spark, d)
    r = s.where("n_evidence > 0").selectExpr(
        "claim_id", "l_partkey % 2 = 0 AS retrieval_passed", "l_partkey % 3 > 0 AS source_verification_passed", "l_partkey % 5 > 0 AS independent_review_passed",
        "CAST(l_suppkey + CAST(l_partkey % 23 = 1 AS INT) AS STRING) AS receipt_evidence_key")
    return E.render_claims(E.claim_level(s), r)


CTES["failures"] = """SELECT event_id, CASE WHEN event_id % 12 = 0 THEN 'evidence_failure' WHEN event_id % 12 = 1 THEN 'user_cancelled' END AS classification,
  (['GOV-SCOPE-001','integrity-2','EVIDENCE-X','NETWORK-3','REJECTED','NEGATIVE-1','odd','EXEC-9','CANCELLED'])[user_id % 9 + 1] AS code, event_type <> 'view' AS blocking FROM events"""
CTES["failure_classes"] = """SELECT *, cls IN ('validation_failure','policy_violation','evidence_failure') OR blocking AS is_blocking, cls IN ('scientific_negative_result','expected_rejection') AS is_result,
  CASE WHEN cls IN ('validation_failure','policy_violation','evidence_failure','user_cancelled') THEN 'workflow' WHEN cls IN ('scientific_negative_result','expected_rejection') THEN 'current_step'
   WHEN blocking THEN 'workflow' ELSE 'current_step' END AS stop_scope FROM (SELECT *, coalesce(classification, CASE WHEN upper(code) LIKE 'GOV-SCOPE%' THEN 'policy_violation' WHEN upper(code) LIKE 'INTEGRITY%' THEN 'validation_failure'
   WHEN upper(code) LIKE 'EVIDENCE%' THEN 'evidence_failure' WHEN upper(code) LIKE 'CANCEL%' THEN 'user_cancelled' WHEN upper(code) LIKE 'REJECT%' THEN 'expected_rejection' WHEN upper(code) LIKE 'NEGATIVE%' THEN 'scientific_negative_result' ELSE 'execution_failure' END) AS cls FROM failures)"""


def failures(spark, d):
    return T.load(spark, d, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 12 = 0 THEN 'evidence_failure' WHEN event_id % 12 = 1 THEN 'user_cancelled' END AS classification",
        "element_at(array('GOV-SCOPE-001','integrity-2','EVIDENCE-X','NETWORK-3','REJECTED','NEGATIVE-1','odd','EXEC-9','CANCELLED'), CAST(user_id % 9 AS INT) + 1) AS code", "event_type <> 'view' AS blocking")


@query("c22_failure_class", "SELECT event_id, cls AS failure_class, is_blocking, is_result, stop_scope FROM failure_classes")
def c22(spark, d):
    return G.classify_failures(failures(spark, d)).select("event_id", "failure_class", "is_blocking", "is_result", "stop_scope")


@query("g14_failure_rollup", "SELECT cls AS failure_class, is_blocking, stop_scope, count(*) AS n_failures FROM failure_classes GROUP BY ALL")
def g14(spark, d):
    return G.failure_summary(failures(spark, d))


# --- E11, G: analysis ----------------------------------------------------------------------------
@query("e11_bind_evaluations", """
WITH ru AS (SELECT trial_id, task_id, event_id, user_id FROM runs), tk AS (SELECT task_id, min(materiality) AS materiality FROM tasks GROUP BY task_id),
b AS (SELECT trial_id, 'eval.'||left(sha256('seed:'||trial_id), 24) AS evaluation_id, CASE WHEN event_id % 40 = 3 THEN 'x' ELSE sha256(trial_id) END AS fa FROM ru),
rc AS (SELECT 'trial.'||seq AS trial_id, bool_or(gate_status = 'blocked') AS bl FROM traces WHERE gate_status IN ('eligible','blocked') GROUP BY 1)
SELECT ru.trial_id, evaluation_id, sha256(ru.trial_id) <> fa AS answer_changed, (materiality = 'material')::BIGINT AS gate_required, (materiality = 'material' AND bl IS NOT NULL)::BIGINT AS gate_called,
 CASE WHEN materiality <> 'material' THEN 'not_required' WHEN bl IS NULL THEN 'not_called' WHEN bl THEN 'blocked' ELSE 'eligible' END AS gate_status
FROM ru JOIN tk USING (task_id) JOIN b USING (trial_id) LEFT JOIN rc USING (trial_id)""")
def e11(spark, d):
    ru = T.runs(spark, d).select("trial_id", "task_id", "event_id").withColumn("answer_sha256", F.sha2("trial_id", 256))
    tk = T.tasks(spark, d).groupBy("task_id").agg(F.min("materiality").alias("materiality"))
    b = ru.select("trial_id", F.concat(F.lit("eval."), F.substring(F.sha2(F.concat(F.lit("seed:"), "trial_id"), 256), 1, 24)).alias("evaluation_id"),
                  F.when(F.col("event_id") % 40 == 3, "x").otherwise(F.col("answer_sha256")).alias("final_answer_sha256"))
    rc = T.traces(spark, d).where("gate_status IS NOT NULL").select(F.concat(F.lit("trial."), "seq").alias("trial_id"), "gate_status")
    results = b.select("evaluation_id", F.lit(1).alias("answer_emitted"))
    return E.bind_evaluations(ru, tk, b, results, rc).select("trial_id", "evaluation_id", "answer_changed", "gate_required", "gate_called", "gate_status")


@query("g1_usage_summary", """
WITH ok AS (SELECT * FROM usage_checked WHERE message IS NULL), k AS (SELECT * FROM ok WHERE source <> 'unavailable'), t AS (SELECT sum(total_tokens) AS t FROM k)
SELECT 'all' AS section, NULL::VARCHAR AS key, NULL::VARCHAR AS reason, count(*) AS n, (SELECT t FROM t)::BIGINT AS total_tokens, NULL::DOUBLE AS share_percent FROM ok
UNION ALL SELECT 'category', activity_category, NULL, count(*), sum(total_tokens)::BIGINT, round(sum(total_tokens) * 100 / (SELECT t FROM t), 6)::DOUBLE FROM k GROUP BY activity_category
UNION ALL SELECT 'source', source, NULL, count(*), sum(total_tokens)::BIGINT, NULL FROM k GROUP BY source
UNION ALL SELECT 'unavailable', activity_category, unavailable_reason, count(*), NULL, NULL FROM ok WHERE source = 'unavailable' GROUP BY activity_category, unavailable_reason""")
def g1(spark, d):
    return A.summarize_usage(T.usage(spark, d))


CTES["scored"] = """SELECT *, coalesce(provider_total_tokens, standardized_tokens) AS tokens,
  (task_success + factual_correctness + evidence_grounding + citation_validity + policy_compliance + uncertainty_calibration) / 6.0::DOUBLE AS quality FROM runs WHERE run_status = 'completed' AND evaluation_status = 'completed'"""


@query("g2_condition_summary", """
SELECT condition, count(*) AS run_count, round(avg(audit_ready_success), 6) AS audit_ready_success_rate, round(avg(quality), 6) AS mean_quality, round(avg(tokens), 6) AS mean_total_tokens,
 sum(model_calls)::BIGINT AS total_model_calls, sum(mcp_calls)::BIGINT AS total_mcp_calls, sum(filesystem_calls)::BIGINT AS total_filesystem_calls, sum(tool_response_bytes)::BIGINT AS total_tool_response_bytes,
 round(avg(latency_ms), 6) AS mean_latency_ms, round(sum(cost_usd), 6) AS total_cost_usd, sum(unsupported_claim_count)::BIGINT AS unsupported_claim_count, sum(policy_violation_count)::BIGINT AS policy_violation_count,
 round(sum(tokens)::DOUBLE / nullif(count(*) FILTER (task_success = 1), 0), 6) AS tokens_per_successful_run, median(tokens)::DOUBLE AS median_total_tokens FROM scored GROUP BY condition""")
def g2(spark, d):
    return A.condition_summary(T.runs(spark, d))


@query("g3_quality_score", """
SELECT trial_id, round(task_success * 0.5::DOUBLE + factual_correctness * 0.1::DOUBLE + evidence_grounding * 0.1::DOUBLE + citation_validity * 0.1::DOUBLE + policy_compliance * 0.1::DOUBLE + uncertainty_calibration * 0.1::DOUBLE, 6) AS quality, tokens FROM scored""")
def g3(spark, d):
    w = {m: 0.1 for m in K.METRIC_FIELDS} | {"task_success": 0.5}
    return A.completed(T.runs(spark, d)).select("trial_id", F.round(A.quality(w), 6).alias("quality"), A.comparison_tokens().alias("tokens"))


CTES["pairs"] = """SELECT task_id, repetition, bool_or(condition = 'filesystem') AND bool_or(condition = 'mcp') AS complete,
  round(max(quality) FILTER (condition = 'mcp') - max(quality) FILTER (condition = 'filesystem'), 6) AS quality_delta,
  round(max(audit_ready_success) FILTER (condition = 'mcp') - max(audit_ready_success) FILTER (condition = 'filesystem'), 6)::BIGINT AS audit_ready_delta,
  (max(tokens) FILTER (condition = 'mcp') - max(tokens) FILTER (condition = 'filesystem'))::BIGINT AS token_delta,
  round(max(latency_ms) FILTER (condition = 'mcp') - max(latency_ms) FILTER (condition = 'filesystem'), 6) AS latency_delta,
  round(max(cost_usd) FILTER (condition = 'mcp') - max(cost_usd) FILTER (condition = 'filesystem'), 6) AS cost_delta, max(event_id) FILTER (condition = 'filesystem') AS pair_no
  FROM scored WHERE condition IN ('filesystem', 'mcp') GROUP BY task_id, repetition"""


@query("g4_paired_deltas", "SELECT * FROM pairs")
def g4(spark, d):
    return A.paired_deltas(T.runs(spark, d), "filesystem", "mcp")


@query("g5_bootstrap_interval", """
WITH v AS (SELECT quality_delta AS x, row_number() OVER (ORDER BY pair_no) - 1 AS pos FROM pairs WHERE complete), n AS (SELECT count(*) AS n, avg(x) AS mean FROM v),
m AS (SELECT b, round(avg(x), 9) AS m FROM (SELECT b.b, ('0x'||left(md5('20260804:'||b.b||':'||v.pos), 15))::BIGINT % n.n AS pos FROM (SELECT unnest(range(0, 1000)) AS b) b, v, n) JOIN v USING (pos) GROUP BY b),
r AS (SELECT m, row_number() OVER (ORDER BY m, b) - 1 AS r FROM m)
SELECT 'mcp - filesystem' AS arm, n.n, round(n.mean, 6) AS mean, round((SELECT m FROM r WHERE r = 24), 6) AS ci_low, round((SELECT m FROM r WHERE r = 974), 6) AS ci_high FROM n""")
def g5(spark, d):
    p = A.paired_deltas(T.runs(spark, d), "filesystem", "mcp").where("complete").withColumn("arm", F.lit("mcp - filesystem"))
    return A.resampled_ci(p, ["arm"], "pair_no", "quality_delta", samples=1000, seed=20260804)


CTES["integrity_runs"] = """SELECT r.*, t.evidence_state, (unsafe_material_claim = 1 OR (condition = 'mcp_claim_gate' AND material_claim_emitted = 1 AND gate_required = 1 AND (gate_called = 0 OR gate_status = 'blocked')))::INT AS unsafe,
  evaluation_status = 'completed' AS scored FROM runs r JOIN (SELECT task_id, min(evidence_state) AS evidence_state FROM tasks GROUP BY task_id) t USING (task_id)
  WHERE run_status = 'completed' AND condition IN ('filesystem','filesystem_manifest','mcp_evidence_only','mcp_claim_gate')"""


@query("g6_integrity_report", """
SELECT condition, count(*) FILTER (scored) AS run_count, count(*) FILTER (NOT scored) AS unscored_completed_run_count, round(avg(unsafe) FILTER (scored AND evidence_state <> 'current_supported'), 6) AS fault_unsafe_rate,
 round(avg((answer_emitted = 1 AND false_block = 0 AND evidence_binding_valid = 1 AND citation_support_valid = 1 AND citation_support_complete = 1)::INT) FILTER (scored AND evidence_state = 'current_supported'), 6) AS clean_coverage,
 round(avg(false_block) FILTER (scored AND evidence_state = 'current_supported'), 6) AS false_block_rate, round(avg(evidence_binding_valid) FILTER (scored), 6) AS binding_accuracy,
 round(avg(citation_support_valid) FILTER (scored), 6) AS citation_precision, round(avg(citation_support_complete) FILTER (scored), 6) AS citation_recall,
 round(avg(gate_called) FILTER (scored AND gate_required = 1), 6) AS gate_recall, round(avg(gate_called) FILTER (scored AND gate_required = 0), 6) AS over_gating_rate,
 round(avg(provider_total_tokens) FILTER (scored), 6) AS mean_total_tokens, round(avg(latency_ms) FILTER (scored), 6) AS mean_latency_ms, round(avg(mcp_calls) FILTER (scored), 6) AS mean_mcp_calls,
 round(avg(gate_calls) FILTER (scored), 6) AS mean_gate_calls FROM integrity_runs GROUP BY condition""")
def g6(spark, d):
    return A.integrity_report(T.tasks(spark, d), T.runs(spark, d))


@query("g6_unsafe_deltas", """
SELECT task_id, repetition, max(event_id) FILTER (condition = 'filesystem') AS pair_no, (max(unsafe) FILTER (condition = 'mcp_claim_gate') - max(unsafe) FILTER (condition = 'filesystem'))::DOUBLE AS delta
FROM integrity_runs WHERE scored AND evidence_state <> 'current_supported' AND condition IN ('filesystem','mcp_claim_gate') GROUP BY ALL HAVING count(DISTINCT condition) = 2""")
def g6b(spark, d):
    return A.unsafe_deltas(T.tasks(spark, d), T.runs(spark, d))


@query("g7_trace_telemetry", """
SELECT trial_id, arg_max(input_tokens, seq) FILTER (type = 'turn.completed') AS input_tokens, arg_max(output_tokens, seq) FILTER (type = 'turn.completed') AS output_tokens,
 count(*) FILTER (item_type = 'mcp_tool_call') AS mcp_calls, count(*) FILTER (item_type = 'command_execution') AS filesystem_calls, count(*) FILTER (tool = 'memory_gate_claim') AS gate_calls,
 count(DISTINCT tool) AS n_tools, bool_or(type = 'turn.completed') AS turn_completed, bool_or(coalesce(contains(lower(message), 'usage limit'), false)) AS usage_limit_reached,
 arg_max(input_tokens + output_tokens, seq) FILTER (type = 'turn.completed') AS provider_total_tokens FROM traces GROUP BY trial_id""")
def g7(spark, d):
    return A.telemetry(T.traces(spark, d))


@query("g11_governance_gates", """
SELECT run_id, n_critical, n_high, n_stuck, verdicts_conflict, n_critical + n_high + n_stuck = 0 AND NOT verdicts_conflict AS eligible FROM (SELECT run_id, count(*) FILTER (severity = 'critical') AS n_critical,
 count(*) FILTER (severity = 'high' AND claim_type IN ('publication','comparative','causal')) AS n_high, count(*) FILTER (status IN ('blocked','inconclusive')) AS n_stuck,
 bool_or(coalesce(reviewer_verdict = 'reject_claim', false)) AND bool_or(coalesce(reviewer_verdict = 'no_material_objection_found', false)) AS verdicts_conflict FROM decisions GROUP BY run_id)""")
def g11(spark, d):
    return G.evaluate_gates(T.decisions(spark, d))


# --- H, I: windows and top-k ------------------------------------------------------------------------
@query("h1_positions", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events")
def h1(spark, d):
    return scale.position_in_key(T.load(spark, d, "events").select("event_id", "user_id"), ["user_id"], "event_id", width=1000)


@query("h2_first_per_key", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def h2(spark, d):
    return scale.first_per_key(T.load(spark, d, "events").select("user_id", "event_id"), ["user_id"], [F.asc("event_id")])


@query("h3_previous_row", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events")
def h3(spark, d):
    e = T.load(spark, d, "events").select("event_id", "user_id", "event_type")
    return scale.previous_row(e, ["user_id"], "event_id", {"previous": "event_type"}, width=1000).select("event_id", "previous")


@query("h4_running_bytes", "SELECT page_id, sum(strlen(html)) OVER (ORDER BY page_id)::BIGINT AS total_bytes FROM pages")
def h4(spark, d):
    p = T.load(spark, d, "pages").select("page_id", F.octet_length("html").cast("bigint").alias("n"), F.lit(1).alias("g"))
    return scale.running_sum(p, ["g"], "page_id", F.col("n"), "total_bytes", width=100).select("page_id", "total_bytes")


@query("h5_list_minmax", """
SELECT user_id AS qid, event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 1.0 END, 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)""")
def h5(spark, d):
    from ledgerlens.operators.lexical import minmax_by_query

    e = T.load(spark, d, "events").select(F.col("user_id").alias("qid"), "event_id", "value")
    return minmax_by_query(e, "value", "s").select("qid", "event_id", F.round("s", 6).alias("scaled"))


@query("h6_even_positions", """
WITH c AS (SELECT path, max(line_no) AS n FROM source_lines GROUP BY path), p AS (SELECT path, n, unnest(range(0, 8)) AS i FROM c)
SELECT DISTINCT path, line_no FROM (SELECT path, round_even(i * ((n - 1)::DOUBLE / 7), 0)::BIGINT + 1 AS line_no FROM p WHERE n > 8 UNION ALL SELECT path, line_no FROM source_lines JOIN c USING (path) WHERE n <= 8)""")
def h6(spark, d):
    return A.even_positions(T.source_lines(spark, d).select("path", "line_no"), ["path"], "line_no", 8)


@query("h7_extreme_texts", """
WITH r AS (SELECT lang, doc_id, length(text) AS len, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, 'shortest' AS pick, doc_id, len FROM r WHERE p = 0 UNION ALL SELECT lang, 'median', doc_id, len FROM r WHERE p = n // 2 UNION ALL SELECT lang, 'longest', doc_id, len FROM r WHERE p = n - 1""")
def h7(spark, d):
    return A.extreme_texts(T.load(spark, d, "documents"), ["lang"], "text", "doc_id")


@query("i1_topk_per_query", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def i1(spark, d):
    e = T.load(spark, d, "events").select("user_id", "event_id", "value")
    return scale.top_per_key(e, ["user_id"], [F.desc("value"), F.asc("event_id")], 5).select("user_id", "event_id", "rank")


@query("f19_latest_records", """
SELECT event_id, status FROM ledger_events WHERE event_type <> 'reference_document' ORDER BY CASE position % 4 WHEN 0 THEN CAST(timestamp_end AS TIMESTAMPTZ) WHEN 1 THEN CAST(timestamp_start AS TIMESTAMPTZ)
 WHEN 2 THEN CAST(date||' 00:00:00+00' AS TIMESTAMPTZ) END DESC NULLS LAST, event_id DESC LIMIT 20""")
def f19(spark, d):
    return U.latest(T.events(spark, d), 20).select("event_id", "status")


@query("f20_timeline_bundles", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY date, position) AS place FROM ledger_events)
SELECT project, (place - 1) // 4 + 1 AS bundle_no, count(*) AS n_events, arg_min(event_id, place) AS first_event, arg_max(event_id, place) AS last_event, arg_min(date, place) AS first_date,
 sha256(string_agg('EVENT: '||event_id||chr(10)||'DATE: '||date||chr(10)||'STATUS: '||status||chr(10)||'SUMMARY: '||summary, chr(10)||chr(10) ORDER BY place)) AS content_sha256 FROM p GROUP BY project, (place - 1) // 4 + 1""")
def f20(spark, d):
    e = T.events(spark, d).withColumn("stage", (F.datediff(F.to_date("date"), F.lit("2024-01-01").cast("date")).cast("bigint") * 10_000_000_000 + F.col("position")))
    out = RR.timeline(e.select("project", "stage", "event_id", "date", "status", "summary"), "project", "stage")
    return out.select("project", "bundle_no", "n_events", "first_event", "last_event", "first_date", F.sha2("content", 256).alias("content_sha256"))


@query("i2_global_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def i2(spark, d):
    o = T.load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).limit(25)


@query("i6_first_insert_wins", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber")
def i6(spark, d):
    """Rows of one key collapse to the smallest; reduced map-side."""
    li = T.load(spark, d, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
