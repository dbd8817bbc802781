"""Fixed values of the record contracts.

Everything in this file is a fixed value: word lists, enumerations, patterns and
limits that results depend on.  No logic lives here.
"""

# --- record ledger -----------------------------------------------------------
CORE_SCHEMA = "core/1.0"
CORE_FIELDS = [
    "schema_version", "record_id", "record_kind", "study_id", "occurred_at", "recorded_at",
    "status", "created_by", "contribution_refs", "approval_refs", "protocol_ref",
    "relations", "source_refs", "artifact_refs", "payload",
]
CORE_REQUIRED = ["schema_version", "record_id", "record_kind", "occurred_at", "recorded_at", "status"]
CORE_KINDS = [
    "research_plan", "protocol", "approval", "execution_session", "observation", "decision",
    "claim", "artifact", "amendment", "audit_finding", "contribution", "negative_result",
    "stopped_work",
]
CORE_STATUSES = [
    "draft", "proposed", "approved", "active", "completed", "stopped", "rejected", "superseded",
]
RELATION_TYPES = [
    "governed_by", "authorized_by", "uses_protocol", "generated_from", "derived_from",
    "evaluated_on", "supported_by", "refuted_by", "validated_by", "decided_from", "corrects",
    "supersedes", "requires_review", "contributed_to",
]
ACTOR_TYPES = ["human", "ai", "external_system"]
VERIFICATION_STATUSES = ["unverified", "integrity_verified", "human_verified"]
LEGACY_REQUIRED = ["event_id", "date", "event_type", "status", "project", "summary"]

RE_RECORD_ID = r"^[a-z][a-z0-9_]*_[A-Za-z0-9._-]+$"
RE_STUDY_ID = r"^study_[A-Za-z0-9._-]+$"
RE_ARTIFACT_REF = r"^artifact_"
RE_ARTIFACT_REVISION = r"^artifact_.*@sha256:[a-f0-9]{64}$"
RE_APPROVAL_REF = r"^approval_"
RE_CONTRIBUTION_REF = r"^contrib_"
RE_PROTOCOL_REF = r"^protocol_"
RE_ACTOR_ID = r"^actor_"
RE_SHA256 = r"^[a-f0-9]{64}$"
RE_STABLE_ID = r"^[a-z][a-z0-9_.-]+$"

REFRESH_KINDS = [
    "decision", "execution_session", "observation", "claim", "amendment", "audit_finding",
    "negative_result", "stopped_work", "artifact",
]
PENDING_STATUSES = ["draft", "proposed", "approved", "active"]
IGNORED_STATUSES = ["rejected", "stopped", "superseded"]
ELIGIBLE_STATUSES = ["approved", "active", "completed"]
WITHDRAWN_MARKERS = ["withdrawn", "retracted", "superseded", "refuted", "unsupported"]

# --- claims ------------------------------------------------------------------
CLAIM_TYPES = ["factual", "result", "comparative", "causal", "release", "recommendation", "creative"]
MATERIALITIES = ["auto", "routine", "material"]
AUTO_MATERIAL_TYPES = ["result", "comparative", "causal", "release"]
TWO_SOURCE_TYPES = ["comparative", "causal", "release"]

# --- usage -------------------------------------------------------------------
USAGE_SCHEMA = "usage-observation/1.0"
USAGE_SOURCES = ["provider_reported", "host_reported", "unavailable"]
ACTIVITY_CATEGORIES = [
    "agent_generation", "code_generation", "command_execution", "skill_invocation",
    "visualization", "retrieval", "review", "other",
]

# --- paired runs and integrity runs ------------------------------------------
AB_CONDITIONS = ["filesystem", "mcp"]
TASK_CATEGORIES = [
    "evidence_retrieval", "claim_verification", "approval_governance", "integrity_change",
    "negative_result", "contribution_attribution", "amendment_history", "uncertainty_calibration",
]
METRIC_FIELDS = [
    "task_success", "factual_correctness", "evidence_grounding", "citation_validity",
    "policy_compliance", "uncertainty_calibration",
]
INTEGRITY_CONDITIONS = ["filesystem", "filesystem_manifest", "mcp_evidence_only", "mcp_claim_gate"]
EVIDENCE_STATES = [
    "current_supported", "post_index_mutation", "path_reuse", "line_range_drift",
    "stale_derived_index", "unregistered_source", "missing_evidence", "conflicting_evidence",
    "withdrawn_evidence", "superseded_amendment", "valid_but_irrelevant",
    "poisoned_before_registration",
]
FAULT_POINTS = [
    "before_registration", "after_index_before_fetch", "after_index_before_search", "not_applicable",
]
GATE_STATUSES = ["not_required", "eligible", "blocked", "not_called"]

# --- index health ------------------------------------------------------------
HEALTH_SCHEMA = "research-index-health-v1"
HEALTH_STATUSES = ["succeeded", "partial", "failed", "stale"]
HEALTH_VERIFICATION = ["passed", "failed", "not_run"]

# --- paths and text ----------------------------------------------------------
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
WORD_PATTERN = r"[\p{L}\p{N}]+"
DENIED_BASENAMES = [
    ".env", ".env.local", ".env.production", "id_rsa", "id_ed25519", "authorized_keys",
    "credentials.json",
]
DENIED_FRAGMENTS = ["secret", "token", "credential", "private_key", "api_key", "apikey"]
LOW_VALUE_HEADINGS = ["sha256", "files", "artifacts", "environment", "commands", "metadata", "checksums"]
REFERENCE_EVENT_TYPE = "reference_document"
REFERENCE_SORT_DATE = "0001-01-01"
TEXT_EXTENSIONS = [
    "", ".bib", ".cfg", ".csv", ".html", ".ini", ".json", ".jsonl", ".md", ".pdf", ".py", ".rst", ".toml", ".tsv", ".txt",
    ".xml", ".yaml", ".yml",
]
REDACTED = "[REDACTED]"
CLIP_MARKER = "\n…[truncated]"

RE_STRUCTURAL = (
    r"(--[A-Za-z][A-Za-z0-9-]*"
    r"|\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\b"
    r"|\b[A-Za-z][A-Za-z0-9.-]*\.(py|pyi|toml|json|ya?ml|ini|cfg|md|txt|sh|ps1|js|ts|tsx|jsx"
    r"|c|cc|cpp|h|hpp|rs|go|java|kt|sql|cmake)\b"
    r"|\b(Dockerfile|Makefile|CMakeLists\.txt)\b"
    r"|\b[A-Za-z_][A-Za-z0-9_]*\s*\(\s*\))"
)
RE_HEADER_SECRET = r"(?i)\b(authorization|x-api-key|api-key)\s*[:=]\s*(?:bearer\s+)?[^\s,;]+"
RE_KEY_SECRET = (
    r"(?i)([\"']?(?:api[_-]?key|credential|password|secret|token)[\"']?\s*[:=]\s*)[\"']?[^\s,;}\"']+"
)
RE_SENSITIVE_KEY = r"(?i)(api[_-]?key|authorization|credential|password|private[_-]?key|secret|token|x-api-key)"
RE_TECH_PATH = (
    r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+"
    r"|[A-Za-z0-9_-]+\.(?:py|pyi|js|ts|tsx|jsx|json|ya?ml|md|toml|ini|txt)\b"
)
RE_TECH_NAMED = (
    r"(?i)\b(?:function|method|class|module|file|script|path)\s+[`'\"]?([A-Za-z_][A-Za-z0-9_.\-/]*)(?:\(\))?"
)
RE_TECH_CALL = r"\b([A-Za-z_][A-Za-z0-9_]*)\(\)"
RE_TECH_BACKTICK = r"`([^`\r\n]+)`"

# --- query classes -----------------------------------------------------------
TIMELINE_LANGUAGE = [
    "timeline", "time line", "round", "타임라인", "시간순", "과정", "흐름", "계보", "왜", "이유",
    "다음", "넘어", "진행", "실패",
]
TIMELINE_MARKERS = [
    "timeline", "time-series", "initial plan", "round", "초기 계획", "시간순", "타임라인", "과정",
    "흐름", "계보", "r1", "r2", "r3", "r4", "r5", "r6", "r7", "r8", "r9",
]
VOCABULARY_MARKERS = ["vocab", "vocabulary", "embedding", "64k", "어휘", "임베딩"]
AUDIT_TERMS = [
    "audit", "hash", "sha256", "tensor", "shape", "dtype", "tokenizer", "token id", "mapping",
    "remap", "equivalent_under_map", "embedding", "vocab", "vocabulary", "vocab size",
    "semantic preservation", "semantic loss", "meaning preservation", "meaning loss",
    "의미 손실", "의미 보존", "의미 정보", "표현력 보존", "표현력 손실", "pad token", "eos token",
    "artifact", "state hash", "무결성", "해시", "텐서", "형상", "토크나이저", "토큰 id", "매핑",
    "리맵", "구조 검증",
]
METRIC_TERMS = [
    "f1", "macro", "micro", "ece", "metric", "score", "quality gate", "performance",
    "성능", "품질", "지표", "게이트",
]

# --- re-ranking --------------------------------------------------------------
ANCHOR_WORDS = [
    "selected", "candidate", "decision", "quality", "gate", "failed", "passed", "blocked",
    "source", "lineage", "macro", "micro", "ece", "partial", "epoch", "최종", "선택", "실패",
    "통과", "차단", "결정", "근거",
]
ANCHOR_ROLE_WEIGHTS = {
    '"decision"': 18.0, '"phase_v5_eligible"': 18.0, '"recovered_seed_gates"': 16.0,
    '"all_three_recovered_seeds_passed"': 16.0, '"quality_gate"': 12.0, '"passed"': 5.0,
    '"candidate"': 8.0, '"technique_selected"': 14.0, '"span_selected"': 8.0,
    '"best_epoch"': 7.0, '"deltas"': 6.0, '"source"': 3.0, '"artifact"': 2.0,
}
ANCHOR_FINAL_WORDS = ["selected", "final", "best", "decision", "최종", "선택", "결정"]
ANCHOR_FINAL_BONUS = {'"technique_selected"': 18.0, '"candidate"': 10.0, '"decision"': 12.0}
ANCHOR_GATE_WORDS = ["gate", "blocked", "failed", "passed", "phase", "차단", "실패", "통과"]
ANCHOR_GATE_BONUS = {'"quality_gate"': 14.0, '"phase_v5_eligible"': 20.0, '"recovered_seed_gates"': 18.0}
ANCHOR_CORE_ROLES = ['"decision"', '"quality_gate"', '"candidate"', '"technique_selected"', '"phase_v5_eligible"']

CONCEPT_ALIASES = {
    "tokenizer": ["tokenizer", "토크나이저"],
    "mapping": ["mapping", "mapped", "remap", "equivalent_under_map", "source_ids", "output_ids", "매핑", "리맵"],
    "embedding": ["embedding", "dense gather", "retained row", "임베딩"],
    "tensor": ["tensor", "shape", "dtype", "finite", "identical", "텐서", "형상"],
    "hash": ["hash", "sha256", "state_sha256", "해시"],
    "config": ["vocab_size", "pad_token_id", "eos_token_id", "config", "설정"],
    "metric": ["f1", "macro", "micro", "ece", "quality_gate", "metric", "성능", "품질"],
    "decision": ["decision", "passed", "failed", "blocked", "phase_v5", "결정", "통과", "실패", "차단"],
}
AUDIT_ROLE_MARKERS = {
    "tokenizer": ['"tokenizer"', "tokenizer.json", "tokenizer_config.json", "source_ids", "mapped_ids", "output_ids", "equivalent_under_map"],
    "mapping": ["equivalent_under_map", "source_ids", "mapped_ids", "output_ids", "dense gather", "id_map"],
    "embedding": ['"embedding"', "embedding exact dense gather", "retained_rows", "source_shape", "output_shape"],
    "tensor": ["tensor keys", "non-embedding tensors", "all output tensors finite", '"shape"', '"dtype"', '"finite"'],
    "hash": ["sha256", "state_sha256", "source_sha256"],
    "config": ["vocab_size", "pad_token_id", "eos_token_id"],
    "metric": ["macro_f1", "micro_f1", "span_partial_f1", "official_si_f1", '"ece"', "quality_gate"],
    "decision": ['"decision"', "phase_v5_eligible", "failed_gate", '"passed"'],
}
AUDIT_CLAIM_WORDS = ["가능", "불가능", "주장", "증명", "evidence", "근거", "claim"]
AUDIT_CLAIM_BONUS = {
    '"gates"': 12.0, '"boundaries"': 12.0, '"decision"': 10.0, '"uncertainty"': 10.0,
    "quality_claimed": 12.0, "equivalent_under_map": 12.0, "exact dense gather": 12.0,
    "finite": 7.0, "identical": 7.0,
}
AUDIT_HASH_WORDS = ["hash", "sha", "해시"]
AUDIT_SUBSTANTIVE = ["equivalent_under_map", "technique_selected", "quality_gate", '"decision"', "vocab_size", "embedding", "tensor"]

COVERAGE_ALIASES = {
    "tokenizer": ["tokenizer", "토크나이저"],
    "mapping": ["mapping", "mapped", "remap", "equivalent_under_map", "매핑", "리맵"],
    "embedding": ["embedding", "임베딩"],
    "tensor": ["tensor", "shape", "dtype", "텐서", "형상"],
    "hash": ["hash", "sha256", "해시"],
    "metric": ["f1", "macro", "micro", "ece", "성능", "품질"],
    "decision": ["decision", "passed", "failed", "blocked", "결정", "통과", "실패", "차단"],
}
RE_AUDIT_EXACT = r"(?i)(evt_[A-Za-z0-9_.-]+|V\d+[-_]R\d+|seed\s*[-_:]?\s*\d+|-?\d+\.\d+|[A-Fa-f0-9]{16,64})"
RE_COVERAGE_ANCHOR = r"(?i)(evt_[A-Za-z0-9_.-]+|V\d+[-_]R\d+|seed\s*[-_:]?\s*\d+|-?\d+\.\d+)"
RE_ANCHOR_NUMBER = r"-?\d+\.\d+"
RE_ANCHOR_LABEL = r"(?i)\b(seed\s*[-_:]?\s*\d+|V\d+[-_]R\d+|Phase\s*V\d+)\b"

METRIC_EVIDENCE_MARKERS = ["macro_f1", "micro_f1", "span_partial_f1", "official_si_f1", '"ece"', "quality_gate"]
DECISION_EVIDENCE_MARKERS = ['"decision"', "\ndecision:", "phase_v5_eligible", "failed_gate"]
AUDIT_EVIDENCE_MARKERS = ["sha256", "tensor", "tokenizer", "vocab_size", "equivalent_under_map", "dense gather"]
MEASUREMENT_MARKERS = ["\nobserved", "macro_f1", "micro_f1", "equivalent_under_map", "dense gather", '"finite"']
VERIFICATION_MARKERS = ["sha256", "tensor", "tokenizer", "vocab_size"]
PASS_PATTERNS = [
    r"quality_gate_passed[\"']?\s*[:=]\s*true", r"\"passed\"\s*:\s*true", r"\bpassed all\b",
    r"\bgate pass(?:ed)?\b", r"\b통과\b",
]
FAIL_PATTERNS = [
    r"quality_gate_passed[\"']?\s*[:=]\s*false", r"\"passed\"\s*:\s*false", r"\bfailed_gate\b",
    r"phase_v5_eligible[\"']?\s*[:=]\s*false", r"\bblocked\b", r"\b실패\b", r"\b차단\b",
]
METRIC_SCALAR_KEYS = [
    "event_id", "source_event", "source_event_id", "seed", "epoch", "macro", "micro", "partial",
    "official_si", "ece", "f1", "quality_gate_passed", "failed_gate", "phase_v5", "all_three",
    "passed", "eligible", "selected",
]
METRIC_CONTAINER_KEYS = [
    "metrics", "quality_gate", "gates", "deltas", "thresholds", "failed_gates",
    "candidate_vs_full_deltas", "candidate_metrics", "selected_metrics",
]
PROVENANCE_KEYS = ["source_event", "source_event_id", "parent_event", "derived_from", "provenance_event"]

# --- governance --------------------------------------------------------------
CRITICAL_FAILURES = ["validation_failure", "policy_violation", "evidence_failure"]
RESULT_FAILURES = ["scientific_negative_result", "expected_rejection"]
FAILURE_CODE_PREFIXES = [
    ("GOV-APPROVAL", "policy_violation"), ("GOV-SCOPE", "policy_violation"),
    ("GOV-COST", "policy_violation"), ("GOV-OPTIN", "policy_violation"),
    ("GOV-OUTPUT", "validation_failure"), ("INTEGRITY", "validation_failure"),
    ("EVIDENCE", "evidence_failure"), ("VALIDATION", "validation_failure"),
    ("POLICY", "policy_violation"), ("CANCEL", "user_cancelled"),
    ("REJECT", "expected_rejection"), ("NEGATIVE", "scientific_negative_result"),
    ("RATE_LIMIT", "execution_failure"), ("NETWORK", "execution_failure"),
    ("DEPENDENCY", "execution_failure"), ("RESOURCE", "execution_failure"),
    ("PROVIDER", "execution_failure"), ("EXEC", "execution_failure"),
]
DECISION_STATUSES = ["pass", "warn", "fail", "inconclusive", "blocked"]
GOVERNOR_AGENT = "scope_and_cost_governor"

# --- runtime state machines (from -> to; "" stands for "no state yet") --------
RUN_TRANSITIONS = [
    ("", "created"), ("created", "materialized"), ("created", "stopping"),
    ("materialized", "preflight_passed"), ("materialized", "stopping"),
    ("preflight_passed", "governor_running"), ("preflight_passed", "stopping"),
    ("governor_running", "governed"), ("governor_running", "stopping"),
    ("governed", "workers_running"), ("governed", "completed"), ("governed", "stopping"),
    ("workers_running", "completed"), ("workers_running", "stopping"),
    ("stopping", "blocked"), ("stopping", "cancelled"),
]
SESSION_TRANSITIONS = [
    ("", "created"), ("created", "packet_validated"), ("created", "stop_requested"),
    ("packet_validated", "prompt_bound"), ("packet_validated", "stop_requested"),
    ("prompt_bound", "dispatch_reserved"), ("prompt_bound", "stop_requested"),
    ("dispatch_reserved", "running"), ("dispatch_reserved", "stop_requested"),
    ("running", "output_received"), ("running", "stop_requested"),
    ("output_received", "decision_validated"), ("output_received", "stop_requested"),
    ("decision_validated", "completed"), ("decision_validated", "stop_requested"),
    ("stop_requested", "failed"), ("stop_requested", "blocked"),
]
TERMINAL_RUN_STATES = ["completed", "blocked", "cancelled"]

# --- limits ------------------------------------------------------------------
MAX_FETCH_LINES = 500
BUNDLE_MAX_PASSAGES = 32
BUNDLE_MAX_LINES = 400
BUNDLE_MAX_BYTES = 256 * 1024
PASSAGE_CHARS = 3500
PARAGRAPH_CHARS = 1000
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
