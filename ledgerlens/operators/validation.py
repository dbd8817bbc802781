"""Validation: rules that turn rows into (record_id, path, message, severity) issue rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.issues import blank, issue_rows, not_in, not_matching, rule

BAD_ID = "does not match the required identifier pattern"


def _kind_of(body: str, path: str) -> Column:
    """Top-level type of a variant field: OBJECT<..., ARRAY<..., STRING, ... or null when absent."""
    return F.schema_of_variant(F.try_variant_get(F.col(body), path, "variant"))


def _items(column: str, make, alias: str | None = None) -> Column:
    """Issue arrays of the items of an array column; ``make(item, index)`` lists the rules."""
    return F.flatten(F.transform(
        F.coalesce(F.col(column), F.array()),
        lambda x, i: F.filter(F.array(*make(x, i.cast("string"))), lambda r: r.isNotNull())))


def validate_core(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Row-local rules of core records, one scan.

    records: parsed columns (see sources.readers.RECORD_SCHEMA) next to the raw JSON text.  Field
    presence and types are read from the raw text, values from the parsed columns.
    """
    df = records.withColumn("_v", F.try_parse_json(raw))
    unexpected = F.transform(
        F.array_sort(F.array_except(F.json_object_keys(raw), F.array(*[F.lit(f) for f in K.CORE_FIELDS]))),
        lambda f: F.struct(F.concat(F.lit("/"), f).alias("path"), F.lit("unexpected property").alias("message"), F.lit("blocking").alias("severity")))
    not_array = lambda f: F.coalesce(~_kind_of("_v", f"$.{f}").startswith("ARRAY") & (_kind_of("_v", f"$.{f}") != "VOID"), F.lit(False))
    is_object = lambda f: F.coalesce(_kind_of("_v", f"$.{f}").startswith("OBJECT"), F.lit(False))
    optional = lambda f, p: F.col(f).isNotNull() & not_matching(f, p)
    no_time = lambda f: F.try_to_timestamp(F.col(f)).isNull() | ~F.coalesce(F.col(f).rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))
    payload_has = lambda k: F.array_contains(F.coalesce(F.json_object_keys("payload"), F.array()), k)
    rules = [rule(blank(f), f"/{f}", "required non-empty string") for f in K.CORE_REQUIRED]
    rules += [
        rule(F.coalesce(F.col("schema_version") != K.CORE_SCHEMA, F.lit(True)), "/schema_version", "must be core/1.0"),
        rule(not_matching("record_id", K.RE_RECORD_ID), "/record_id", BAD_ID),
        rule(optional("study_id", K.RE_STUDY_ID), "/study_id", BAD_ID),
        rule(no_time("occurred_at"), "/occurred_at", "must be an ISO 8601 date-time"),
        rule(no_time("recorded_at"), "/recorded_at", "must be an ISO 8601 date-time"),
        rule(not_in("record_kind", K.CORE_KINDS), "/record_kind", "unknown core record kind"),
        rule(not_in("status", K.CORE_STATUSES), "/status", "unknown core status"),
        rule(~is_object("created_by"), "/created_by", "must be an object"),
        rule(is_object("created_by") & not_matching("created_by.actor_id", K.RE_ACTOR_ID), "/created_by/actor_id", BAD_ID),
        rule(is_object("created_by") & not_in("created_by.actor_type", K.ACTOR_TYPES), "/created_by/actor_type",
             "must identify human, ai, or external_system"),
        rule(~is_object("payload"), "/payload", "must be an object"),
        rule(optional("protocol_ref", K.RE_PROTOCOL_REF), "/protocol_ref", BAD_ID),
        rule((F.col("record_kind") == "execution_session") & (F.col("status") == "active")
             & (F.size(F.coalesce("approval_refs", F.array())) == 0), "/approval_refs", "active session requires explicit approval"),
        rule((F.col("record_kind") == "claim") & (F.get_json_object("payload", "$.support_status") == "supported")
             & ~F.exists(F.coalesce("source_refs", F.array()), lambda s: F.coalesce(s["verification_status"] == "human_verified", F.lit(False))),
             "/source_refs", "supported claim requires human-verified evidence"),
        rule((F.col("record_kind") == "amendment")
             & (F.size(F.filter(F.coalesce("relations", F.array()), lambda r: r["type"] == "corrects")) != 1),
             "/relations", "amendment requires exactly one corrects relation"),
    ]
    for key in ("path", "recorded_value", "corrected_value", "reason"):
        rules.append(rule((F.col("record_kind") == "amendment") & ~payload_has(key), f"/payload/{key}",
                          "amendment must record before/after values and reason"))
    extra_keys = lambda body, allowed, prefix: F.transform(
        F.array_sort(F.array_except(F.coalesce(F.json_object_keys(body), F.array()), F.array(*[F.lit(a) for a in allowed]))),
        lambda f: F.struct(F.concat(prefix, f).alias("path"), F.lit("unexpected property").alias("message"), F.lit("blocking").alias("severity")))
    groups = [unexpected, extra_keys(F.get_json_object(raw, "$.created_by"), ["actor_id", "actor_type"], F.lit("/created_by/"))]
    for field, allowed in (("relations", ["type", "target_id"]), ("source_refs", ["artifact_revision_id", "locator", "verification_status"])):
        texts = F.coalesce(F.from_json(F.get_json_object(raw, f"$.{field}"), "array<string>"), F.array())
        at = lambda i, f=field: F.concat(F.lit(f"/{f}/"), i.cast("string"))
        is_item = lambda x: F.coalesce(x.startswith("{"), F.lit(False))
        groups.append(F.transform(texts, lambda x, i: rule(~is_item(x), at(i), "must be an object")))
        groups.append(F.flatten(F.transform(texts, lambda x, i: F.when(is_item(x), extra_keys(x, allowed, F.concat(at(i), F.lit("/")))).otherwise(F.array()))))
    for field, pattern in (("contribution_refs", K.RE_CONTRIBUTION_REF), ("approval_refs", K.RE_APPROVAL_REF), ("artifact_refs", K.RE_ARTIFACT_REF)):
        rules.append(rule(not_array(field), f"/{field}", "must be an array"))
        rules.append(rule(F.size(field) != F.size(F.array_distinct(field)), f"/{field}", "must not contain duplicate values"))
        groups.append(_items(field, lambda x, i, f=field, p=pattern: [rule(not_matching(x, p), F.concat(F.lit(f"/{f}/"), i), BAD_ID)]))
    for field in ("relations", "source_refs"):
        rules.append(rule(not_array(field), f"/{field}", "must be an array"))
    groups.append(_items("relations", lambda r, i: [
        rule(not_in(r["type"], K.RELATION_TYPES), F.concat(F.lit("/relations/"), i, F.lit("/type")), "unknown relation type"),
        rule(blank(r["target_id"]), F.concat(F.lit("/relations/"), i, F.lit("/target_id")), "required non-empty target ID")]))
    groups.append(_items("source_refs", lambda s, i: [
        rule(not_matching(s["artifact_revision_id"], K.RE_ARTIFACT_REVISION), F.concat(F.lit("/source_refs/"), i, F.lit("/artifact_revision_id")),
             "does not match the required artifact revision pattern"),
        rule(F.coalesce(s["locator"].isin("{}", "") | ~s["locator"].startswith("{"), F.lit(True)), F.concat(F.lit("/source_refs/"), i, F.lit("/locator")), "must be a non-empty object"),
        rule(not_in(s["verification_status"], K.VERIFICATION_STATUSES), F.concat(F.lit("/source_refs/"), i, F.lit("/verification_status")),
             "must be unverified, integrity_verified, or human_verified")]))
    return issue_rows(df, "record_id", rules, groups)


def validate_legacy(events: DataFrame) -> DataFrame:
    """Required fields and the source line range of legacy events (columns line_start, line_end)."""
    s, e = F.col("line_start"), F.col("line_end")
    rules = [rule(blank(f), f"/{f}", "required non-empty string") for f in K.LEGACY_REQUIRED]
    rules += [
        rule(s.isNull() != e.isNull(), "/source", "line_start and line_end must appear together"),
        rule(s.isNotNull() & F.coalesce((s < 1) | (e < s), F.lit(True)), "/source", "invalid source line range"),
    ]
    return issue_rows(events, "event_id", rules)


def duplicate_ids(df: DataFrame, identifier: str, position: str) -> DataFrame:
    """Second and later occurrences.  Only the first position per id is aggregated (map-side), then
    joined back, so an id that holds a third of the rows is never sorted in one task."""
    first = df.groupBy(identifier).agg(F.min(position).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return (
        df.join(first, identifier).where(F.col(position) > F.col("_first"))
        .select(F.col(identifier).alias("record_id"), F.col(position).alias("position"), F.lit("/record_id").alias("path"),
                F.lit("duplicate record identifier").alias("message"), F.lit("blocking").alias("severity")))


def dangling_relations(edges: DataFrame, ids: DataFrame, source: str = "event_id", target: str = "target") -> DataFrame:
    """Edges whose target is not among ``ids`` (column id)."""
    return edges.join(ids.select(F.col("id").alias(target)).distinct(), target, "left_anti").select(
        F.col(source).alias("record_id"), F.col(target).alias("target"), F.lit("target does not exist in this ledger").alias("message"))


def check_approvals(records: DataFrame, approvals: DataFrame) -> DataFrame:
    """First failing reason per (record, approval reference).

    records: record_id, study_id, record_kind, approval_ref (one row per reference); approvals:
    record_id, record_kind, status, actor_type, record_ids, study_ids, record_kinds (scope arrays, null = none).
    """
    a = approvals.select(*[F.col(c).alias(f"a_{c}") for c in approvals.columns])
    j = records.join(a, F.col("approval_ref") == F.col("a_record_id"), "left")
    within = lambda arr, v: F.coalesce(F.array_contains(F.col(arr), F.col(v)), F.lit(False))
    reason = (
        F.when(F.col("a_record_id").isNull(), "referenced approval record does not exist")
        .when(F.coalesce(F.col("a_record_kind") != "approval", F.lit(True)), "referenced record is not an approval")
        .when(F.coalesce(F.col("a_status") != "approved", F.lit(True)), "referenced approval is not approved")
        .when(F.coalesce(F.col("a_actor_type") != "human", F.lit(True)), "approval must be issued by a human actor")
        .when(F.coalesce(F.col("a_record_ids"), F.col("a_study_ids"), F.col("a_record_kinds")).isNull(), "approval has no explicit scope")
        .when(within("a_record_ids", "record_id"), F.lit(None))
        .when(~within("a_study_ids", "study_id"), "approval scope does not include the record study")
        .when(~within("a_record_kinds", "record_kind"), "approval scope does not include the record kind"))
    return j.withColumn("message", reason).where("message IS NOT NULL").select("record_id", "approval_ref", "message")


def check_commit(candidates: DataFrame, ledger_ids: DataFrame, approval_issues: DataFrame) -> DataFrame:
    """Commit rules per candidate: a used id is the only issue; else the approval and status rules.

    candidates: record_id, status, approval_ref, approval_refs; approval_issues: check_approvals output.
    """
    used = candidates.join(ledger_ids.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_semi").select(
        "record_id", F.lit("/record_id").alias("path"), F.lit("record ID already exists").alias("message"), F.lit("blocking").alias("severity"))
    fresh = candidates.join(ledger_ids.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_anti")
    a = approval_issues.select("record_id", "approval_ref", F.col("message").alias("_why"))
    j = fresh.join(a, ["record_id", "approval_ref"], "left")
    named = F.coalesce(F.col("approval_ref").startswith("approval_"), F.lit(False))
    carried = F.coalesce(F.array_contains("approval_refs", F.col("approval_ref")), F.lit(False))
    rules = [
        rule(~named, "/approval_ref", "explicit approval reference is required"),
        rule(named & ~carried, "/approval_refs", "record must carry the explicit approval reference"),
        rule(named & carried & F.col("_why").isNotNull(), "/approval_refs", F.col("_why")),
        rule(F.col("status").isin("draft", "proposed"), "/status", "drafts and proposals cannot be committed to canonical ledger"),
    ]
    return used.unionByName(issue_rows(j, "record_id", rules))


def check_sources(refs: DataFrame, registry: DataFrame, files: DataFrame) -> DataFrame:
    """First failing reason per cited source: unregistered path, other registered hash, changed file.

    refs: record_id, ref_no, path, cited_sha256 (nullable).
    """
    reg = registry.select(F.col("source_path").alias("_p"), F.lower("source_sha256").alias("_h")).distinct()
    cur = files.select(F.col("path").alias("_fp"), F.col("sha256").alias("_now"))
    j = refs.join(reg, F.col("path") == F.col("_p"), "left").join(cur, F.col("path") == F.col("_fp"), "left")
    reason = (
        F.when(F.col("_p").isNull(), "source path is not registered")
        .when(F.col("cited_sha256") != F.col("_h"), "source hash does not match registered source")
        .when(F.coalesce(F.col("_now") != F.col("_h"), F.lit(True)), "registered source content hash mismatch"))
    return j.withColumn("message", reason).where("message IS NOT NULL").select("record_id", "ref_no", "message")


def verify_registry(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Registered sources: relative path, 64-hex hash, present, unchanged."""
    cur = files.select(F.col("path").alias("_fp"), F.col("sha256").alias("_now"))
    j = registry.join(cur, F.col("source_path") == F.col("_fp"), "left")
    h = F.lower("source_sha256")
    rules = [
        rule(blank("source_path") | F.col("source_path").startswith("/") | F.col("source_path").rlike(r"(^|/)\.\.(/|$)"),
             "/source_path", "source path must be relative"),
        rule(not_matching(h, K.RE_SHA256), "/source_sha256", "source hash must be 64 hexadecimal digits"),
        rule(F.col("_fp").isNull(), "/source_path", "registered source is missing"),
        rule(F.col("_now") != h, "/source_sha256", "registered source content hash mismatch"),
    ]
    return issue_rows(j, "source_id", rules)


def usage_problem() -> Column:
    """First broken rule of a usage observation (columns of plans.tables.usage), or null."""
    i, o, t = F.col("input_tokens"), F.col("output_tokens"), F.col("total_tokens")
    gone = F.col("source") == "unavailable"
    count = lambda c, name: F.when(~gone & F.coalesce(c < 0, F.lit(True)), f"{name} must be a non-negative integer")
    text = lambda c: F.when(blank(c), f"{c} must be a non-empty string")
    return F.coalesce(
        F.when(not_in("schema_version", [K.USAGE_SCHEMA]), "unsupported usage observation schema"),
        F.when(not_in("source", K.USAGE_SOURCES), "source is not supported"),
        F.when(not_in("activity_category", K.ACTIVITY_CATEGORIES), "activity_category is not supported"),
        F.when(gone & F.coalesce(i, o, t).isNotNull(), "unavailable usage must not contain token counts"),
        F.when(gone & blank("unavailable_reason"), "unavailable_reason must be a non-empty string"),
        count(i, "input_tokens"), count(o, "output_tokens"), count(t, "total_tokens"),
        F.when(~gone & (i + o != t), "input_tokens plus output_tokens must equal total_tokens"),
        F.when(~gone & F.col("unavailable_reason").isNotNull(), "observed usage must not contain unavailable_reason"),
        text("observed_at"), text("run_id"), text("workflow_id"), text("agent_id"))


def validate_usage(usage: DataFrame, key: str = "event_id") -> DataFrame:
    return usage.withColumn("message", usage_problem()).where("message IS NOT NULL").select(key, "message")


def validate_tasks(tasks: DataFrame) -> DataFrame:
    """Rules of paired-benchmark tasks (task_id, source_bundle_id, category, prompt, holdout)."""
    return issue_rows(tasks, "task_id", [
        rule(not_matching("task_id", K.RE_STABLE_ID), "/task_id", "must be a stable lower-case identifier"),
        rule(not_matching("source_bundle_id", K.RE_STABLE_ID), "/source_bundle_id", "must be a stable lower-case identifier"),
        rule(not_in("category", K.TASK_CATEGORIES), "/category", "unknown task category"),
        rule(blank("prompt"), "/prompt", "task prompt is required"),
        rule(~F.coalesce("holdout", F.lit(False)), "/holdout", "benchmark tasks must be marked holdout"),
    ])


def validate_integrity_tasks(tasks: DataFrame) -> DataFrame:
    """Rules of integrity tasks (task_id, materiality, evidence_state, fault_injected_at, prompt)."""
    clean = F.col("evidence_state") == "current_supported"
    return issue_rows(tasks, "task_id", [
        rule(not_matching("task_id", K.RE_STABLE_ID), "/task_id", "must be a stable lower-case identifier"),
        rule(not_in("materiality", ["routine", "material"]), "/materiality", "task materiality is unsupported"),
        rule(not_in("evidence_state", K.EVIDENCE_STATES), "/evidence_state", "task evidence_state is unsupported"),
        rule(blank("prompt"), "/prompt", "task prompt is required"),
        rule(clean & F.col("fault_injected_at").isNotNull(), "/fault_injected_at", "current evidence must not declare a fault injection"),
        rule(~clean & not_in("fault_injected_at", K.FAULT_POINTS), "/fault_injected_at", "fault evidence state needs a registered injection point"),
    ])


def validate_runs(runs: DataFrame, conditions: list[str]) -> DataFrame:
    """Row rules shared by both run contracts: identity, arms, token identities, calls, latency, metrics."""
    negative = lambda c: F.col(c) < 0
    metrics = [
        rule((F.col("evaluation_status") == "completed") & F.coalesce((F.col(m) < 0) | (F.col(m) > 1), F.lit(True)),
             f"/evaluation/{m}", "must be in [0, 1]") for m in K.METRIC_FIELDS]
    return issue_rows(runs, "trial_id", [
        rule(not_matching("trial_id", K.RE_STABLE_ID), "/trial_id", "must be a stable lower-case identifier"),
        rule(not_in("condition", conditions), "/condition", "condition is not an arm of this benchmark"),
        rule(F.coalesce(F.col("repetition") < 1, F.lit(True)), "/repetition", "repetition must be a positive integer"),
        rule(not_in("run_status", ["completed", "failed", "stopped"]), "/run_status", "run_status must preserve completed, failed, or stopped"),
        rule(not_in("evaluation_status", ["pending", "completed"]), "/evaluation_status", "evaluation_status must be pending or completed"),
        rule(F.col("provider_total_tokens") != F.col("input_tokens") + F.col("output_tokens"), "/usage/provider_total_tokens",
             "provider total must equal input + output under declared semantics"),
        rule(F.col("cached_input_tokens") > F.col("input_tokens"), "/usage/cached_input_tokens", "cached input tokens cannot exceed input tokens"),
        rule(F.col("reasoning_tokens") > F.col("output_tokens"), "/usage/reasoning_tokens", "reasoning tokens cannot exceed output tokens"),
        rule((F.col("condition") == "filesystem") & (F.col("mcp_calls") != 0), "/calls/mcp_calls_started", "filesystem baseline cannot make MCP calls"),
        rule(F.coalesce(negative("latency_ms") | F.isnan("latency_ms"), F.lit(True)), "/latency_ms", "latency_ms must be non-negative"),
        rule(F.coalesce(negative("cost_usd"), F.lit(True)), "/cost", "cost.normalized_list_amount must be non-negative"),
        *metrics,
    ])


def validate_integrity_runs(runs: DataFrame) -> DataFrame:
    """Evaluation fields of integrity runs are binary and the gate status fits the gate call."""
    done = F.col("evaluation_status") == "completed"
    fields = ["answer_emitted", "material_claim_emitted", "gate_required", "gate_called", "unsafe_material_claim",
              "false_block", "evidence_binding_valid", "citation_support_valid", "citation_support_complete"]
    return issue_rows(runs, "trial_id", [
        rule(not_in("condition", K.INTEGRITY_CONDITIONS), "/condition", "run condition is unsupported"),
        *[rule(done & ~F.coalesce(F.col(f).isin(0, 1), F.lit(False)), f"/evaluation/{f}", "must be binary") for f in fields],
        rule(done & not_in("gate_status", K.GATE_STATUSES), "/evaluation/gate_status", "evaluation.gate_status is unsupported"),
        rule(done & (F.col("gate_called") == 1) & (F.col("gate_status") == "not_called"), "/evaluation/gate_status",
             "called gate cannot have not_called status"),
        rule(F.coalesce(F.col("latency_ms") < 0, F.lit(True)), "/latency_ms", "latency_ms must be non-negative"),
    ])


def validate_bundle(tasks: DataFrame, runs: DataFrame, conditions: list[str], require_pairs: bool) -> DataFrame:
    """(subject, message) over a task and run set: duplicates, unknown tasks, incomplete pairs."""
    dup_task = tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("task_id").alias("subject"), F.lit("duplicate task_id").alias("message"))
    unknown = runs.select("task_id").distinct().join(tasks.select("task_id"), "task_id", "left_anti").select(
        F.col("task_id").alias("subject"), F.lit("run references unknown task").alias("message"))
    key = F.concat_ws("|", "task_id", "condition", F.col("repetition").cast("string"))
    dup_run = runs.groupBy("task_id", "condition", "repetition").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        key.alias("subject"), F.lit("duplicate condition run").alias("message"))
    out = [dup_task, unknown, dup_run]
    if require_pairs:
        seen = [F.max(F.when(F.col("condition") == c, 1).otherwise(0)) for c in conditions]
        pairs = runs.where(F.col("condition").isin(*conditions)).groupBy("task_id", "repetition").agg(reduce(lambda a, b: a + b, seen).alias("arms"))
        out.append(pairs.where(F.col("arms") < len(conditions)).select(
            F.concat_ws("|", "task_id", F.col("repetition").cast("string")).alias("subject"), F.lit("unpaired runs").alias("message")))
    return reduce(DataFrame.unionByName, out)


def validate_health(health: DataFrame) -> DataFrame:
    """Index-health rows: (build_id, schema_version, status, index_revision, event_count, passage_count,
    embedding_model, embedding_dimension, retrieval_status)."""
    counts = ["event_count", "passage_count", "embedding_dimension"]
    return issue_rows(health, "build_id", [
        rule(not_in("schema_version", [K.HEALTH_SCHEMA]), "/schema_version", "schema_version must be research-index-health-v1"),
        rule(not_in("status", K.HEALTH_STATUSES), "/status", "status must be succeeded, partial, failed, or stale"),
        rule(blank("index_revision"), "/index_revision", "index_revision must be a non-empty string"),
        rule(blank("embedding_model"), "/embedding_model", "embedding_model must be a non-empty string"),
        *[rule(F.coalesce(F.col(c) < 0, F.lit(True)), f"/{c}", f"{c} must be a non-negative integer") for c in counts],
        rule(not_in("retrieval_status", K.HEALTH_VERIFICATION), "/retrieval_verification", "retrieval_verification must declare passed, failed, or not_run"),
        rule((F.col("status") == "succeeded") & (F.col("retrieval_status") != "passed"), "/retrieval_verification",
             "a succeeded refresh requires passed retrieval verification"),
    ])


def check_decisions(decisions: DataFrame, packets: DataFrame) -> DataFrame:
    """Decision rows against the packet of their run: status, scope, evidence, reviewer authority."""
    p = packets.select("run_id", "allowed_actions").withColumn("_known", F.lit(True))
    j = decisions.join(p, "run_id", "left")
    known = F.coalesce("_known", F.lit(False))
    return issue_rows(j, "finding_id", [
        rule(~known, "/run_id", "run_id must match the task packet"),
        rule(not_in("status", K.DECISION_STATUSES), "/status", "status must be pass, warn, fail, inconclusive, or blocked"),
        rule(known & ~F.coalesce(F.array_contains("allowed_actions", F.col("action_used")), F.lit(False)), "/authority_used",
             F.concat(F.lit("authority_used exceeds task scope: "), "action_used")),
        rule(~F.col("has_evidence"), "/findings", "finding needs at least one evidence reference"),
        rule(~F.col("read_only") & F.col("reviewer_verdict").isNotNull(), "/authority", "reviewer must not hold write authority"),
    ])


def preflight_batches(packets: DataFrame, max_workers: int, cost_ceiling: float) -> DataFrame:
    """One row per batch with the failed pre-flight checks.

    packets: batch_id, agent_id, is_critical, max_parallelism, declared_cost, max_cost.
    """
    gov = F.col("agent_id") == K.GOVERNOR_AGENT
    per_agent = packets.groupBy("batch_id", "agent_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("is_critical").cast("int")).alias("any_critical"),
        F.min(F.col("is_critical").cast("int")).alias("all_critical"), F.min("max_parallelism").alias("par"),
        F.sum(F.col("declared_cost").cast("decimal(18,4)")).alias("cost"),
        F.sum(F.when(F.col("declared_cost") > F.col("max_cost"), 1).otherwise(0)).alias("over"))
    worker = F.when(~gov, 1)
    b = per_agent.groupBy("batch_id").agg(
        F.sum(F.when(gov, F.col("n")).otherwise(0)).alias("n_governors"), F.sum("n").alias("n_packets"), F.count(F.lit(1)).alias("n_agents"),
        F.max(F.when(~gov, F.col("any_critical"))).alias("some_critical"), F.min(F.when(~gov, F.col("all_critical"))).alias("only_critical"),
        F.min(F.when(~gov, F.col("par"))).alias("par"), F.sum("cost").alias("total_cost"), F.sum("over").alias("n_over"))
    issue = F.concat_ws(
        ";", F.when(F.col("n_governors") != 1, "governor"), F.when(F.col("n_packets") != F.col("n_agents"), "duplicate_agent"),
        F.when((F.col("some_critical") == 1) & (F.col("only_critical") == 0), "mixed_roles"),
        F.when(F.lit(max_workers) > F.col("par"), "parallelism"), F.when(F.col("n_over") > 0, "agent_cost"),
        F.when(F.col("total_cost") > cost_ceiling, "total_cost"))
    return b.select("batch_id", "n_packets", "n_agents", F.col("total_cost").cast("double").alias("total_cost"), issue.alias("issues"),
                    (issue == "").alias("passed"))


def audit_findings(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings with stable ids: validation issues typed policy or record_integrity, plus AI decisions
    without a human reviewer.  The id hashes the finding's content instead of a global counter, which
    would need one task to number all findings."""
    a = issues.select(
        F.when(F.contains(F.col("message"), F.lit("approval")), "policy").otherwise("record_integrity").alias("audit_type"),
        "severity", F.col("record_id").alias("subject_ref"), F.concat(F.lit("record://"), "record_id", "path").alias("evidence_ref"),
        F.col("message").alias("reason"))
    b = decisions.where((F.col("record_kind") == "decision") & (F.col("actor_type") == "ai") & (F.coalesce("human_reviewer_ref", F.lit("")) == "")).select(
        F.lit("contribution").alias("audit_type"), F.lit("warning").alias("severity"), F.col("record_id").alias("subject_ref"),
        F.concat(F.lit("record://"), "record_id", F.lit("/created_by")).alias("evidence_ref"),
        F.lit("AI-authored decision has no recorded human reviewer.").alias("reason"))
    u = a.unionByName(b)
    return u.withColumn("finding_id", F.concat(F.lit("finding_"), F.substring(F.sha2(F.concat_ws("|", "audit_type", "evidence_ref", "reason"), 256), 1, 16)))


def check_evaluations(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Coverage of an evaluation batch: unknown, missing, duplicate ids and non-binary fields.

    results: evaluation_id, ok (all fields binary); expected: evaluation_id.
    """
    r = results.groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    e = expected.select("evaluation_id").distinct().withColumn("_e", F.lit(True))
    j = r.join(e, "evaluation_id", "full_outer")
    problem = (
        F.when(F.col("_e").isNull(), "unknown evaluation id").when(F.col("n").isNull(), "missing evaluation")
        .when(F.col("n") > 1, "duplicate evaluation id").when(~F.col("ok"), "non-binary evaluator fields"))
    return j.withColumn("message", problem).where("message IS NOT NULL").select("evaluation_id", "message")
