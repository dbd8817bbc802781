"""Evidence checks: locators, registered hashes, exact ranges, claim eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens import scale
from ledgerlens.functions import text as X
from ledgerlens.functions.issues import raise_if_any

LINE_BLOCK = 64
LOCATOR = ["event_id", "path", "source_sha256", "start_line", "end_line"]


# --- locators and registry ---------------------------------------------------
def identity_gate(hits: DataFrame, views: Sequence[DataFrame], mode: str = "flag") -> DataFrame:
    """Each locator must occur, null-safely, in one of the views; adds verified and eligible flags."""
    known = None
    for v in views:
        known = v.select(*LOCATOR) if known is None else known.unionByName(v.select(*LOCATOR))
    known = known.distinct().withColumn("_known", F.lit(True))
    same = [hits[c].eqNullSafe(known[c]) for c in LOCATOR]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    out = hits.join(known, cond, "left").select(*[hits[c] for c in hits.columns], F.coalesce("_known", F.lit(False)).alias("identity_verified"))
    eligible = F.lit(True)
    for c in LOCATOR[1:]:
        eligible = eligible & F.col(c).isNotNull()
    out = out.withColumn("evidence_eligible", eligible)
    if mode == "raise":
        raise_if_any(out.where(~F.col("identity_verified")).select(*LOCATOR), "candidate locator failed the identity gate")
    return out


def source_eligibility(event_sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Cited sources with ``eligible`` = path and hash (any case) registered."""
    reg = registry.select(F.col("source_path").alias("_p"), F.lower("source_sha256").alias("_h")).distinct().withColumn("_r", F.lit(True))
    return (
        event_sources.join(reg, (F.col("source_path") == F.col("_p")) & (F.lower("source_sha256") == F.col("_h")), "left")
        .withColumn("eligible", F.col("_r").isNotNull()).drop("_p", "_h", "_r"))


def registered_hashes(event_sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct non-empty (path, hash) over citations and registry, with the number of hashes per path.

    The count is joined back instead of collecting the hashes of a path into one list.
    """
    both = event_sources.select(F.col("source_path").alias("path"), F.col("source_sha256").alias("sha256")).unionByName(
        registry.select(F.col("source_path").alias("path"), F.col("source_sha256").alias("sha256")))
    pairs = both.where("sha256 IS NOT NULL AND sha256 <> ''").distinct()
    n = pairs.groupBy("path").agg(F.count(F.lit(1)).alias("n_hashes"))
    return pairs.join(n, "path").withColumn("ambiguous", F.col("n_hashes") > 1)


# --- exact ranges ----------------------------------------------------------------
def line_blocks(files: DataFrame) -> DataFrame:
    """(path, sha256, n_lines, block, lines): each file cut into blocks of 64 lines inside its row; an empty file has one empty block.

    Written once, this is the index that all range reads use: file texts are not read again, and no row is a single line.
    A file that is given twice counts once; texts are shuffled for this only where a path is repeated.
    """
    if not files.groupBy("path").count().where("path IS NOT NULL AND count > 1").isEmpty():
        files = files.dropDuplicates(["path", "sha256"])
    cut = files.select("path", "sha256", X.lines_of("text").alias("_l")).select("path", "sha256", F.size("_l").cast("bigint").alias("n_lines"), "_l")
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("_l") - 1) / LINE_BLOCK)).cast("int")),
        lambda b: F.slice("_l", b * LINE_BLOCK + 1, F.lit(LINE_BLOCK)))
    return cut.select("path", "sha256", "n_lines", F.posexplode(parts).alias("block", "lines"))


def current_files(blocks: DataFrame) -> DataFrame:
    """(path, sha256, n_lines) of every file, from its first block."""
    return blocks.where("block = 0").select("path", "sha256", "n_lines")


def render_pages(ranges: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, page, n_lines, content): numbered lines of each range, one row per block of the file that it touches.

    Ranges meet blocks on (path, block), so a path cited by many ranges and a range as long as a file are spread over
    blocks, and only the lines asked for are numbered.  Ranges with a column sha256 read that revision of their path only.
    """
    block = lambda c: F.floor((F.col(c) - 1) / LINE_BLOCK).cast("int")
    file = ["path", "sha256"] if "sha256" in ranges.columns else ["path"]
    wanted = ranges.select(key, *file, "first_line", "last_line", F.explode(F.sequence(block("first_line"), block("last_line"))).alias("block"))
    before = F.col("block").cast("bigint") * LINE_BLOCK
    first = F.greatest(F.col("first_line"), before + 1)
    n = F.least(F.col("last_line"), before + F.size("lines")) - first + 1
    part = wanted.join(blocks.select(*file, "block", "lines"), [*file, "block"]).select(
        key, F.col("block").alias("page"), first.alias("_a"), n.alias("n_lines"), F.slice("lines", (first - before).cast("int"), F.greatest(n, F.lit(0)).cast("int")).alias("_l"))
    numbered = F.transform("_l", lambda t, i: F.struct((F.col("_a") + i).alias("line_no"), t.alias("text")))
    return part.where("n_lines > 0").select(key, "page", "n_lines", X.numbered_lines(numbered).alias("content"))


def render_ranges(ranges: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, content, n_lines): the pages of each range joined; for ranges that may be as long as a file, take ``render_pages``."""
    pages = F.array_sort(F.collect_list(F.struct("page", "content")))
    return render_pages(ranges, blocks, key).groupBy(key).agg(
        F.array_join(F.transform(pages, lambda p: p["content"]), "\n").alias("content"), F.sum("n_lines").alias("n_lines"))


def fetch_evidence(refs: DataFrame, event_sources: DataFrame, blocks: DataFrame, context: int = 8,
                   max_lines: int | None = None, allow_mismatch: bool = False, pages: bool = False) -> DataFrame:
    """Fetch cited ranges and verify them against the registered and the current hash.

    refs: (ref_id, event_id, path, start_line, end_line, expected_sha256); blocks: ``line_blocks``.  One status per
    reference, however often it or its file is listed; of several files at one path the expected revision counts, else that of
    the smallest hash.  Text is withheld unless the hashes match (or ``allow_mismatch``).  ``context`` lines are added on both
    sides; with ``max_lines`` longer ranges are refused with a reason, without it none is.  ``pages`` gives a row per
    reference and page of at most 64 lines (column page), so that a range as long as a file is never one row.
    """
    context = max(0, context)
    reg = (
        event_sources.where("source_sha256 IS NOT NULL AND source_sha256 <> ''")
        .select(F.col("event_id").alias("_e"), F.col("source_path").alias("_p"), F.col("source_sha256").alias("_h")).distinct())
    paths = reg.select(F.col("_e").alias("_e2"), F.col("_p").alias("_p2")).distinct().withColumn("_path_known", F.lit(True))
    cur = current_files(blocks).groupBy(F.col("path").alias("_fp")).agg(F.array_sort(F.collect_set(F.struct("sha256", "n_lines"))).alias("_files"))
    c = F.col
    file = F.coalesce(F.get(F.filter("_files", lambda f: f["sha256"] == c("expected_sha256")), F.lit(0)), F.get("_files", F.lit(0)))
    j = (
        refs.distinct().join(paths, (c("event_id") == c("_e2")) & (c("path") == c("_p2")), "left")
        .join(reg.withColumn("_hash_known", F.lit(True)),
              (c("event_id") == c("_e")) & (c("path") == c("_p")) & (c("expected_sha256") == c("_h")), "left")
        .join(cur, c("path") == c("_fp"), "left").withColumn("_file", file)
        .withColumn("current_sha256", c("_file.sha256")).withColumn("_n", c("_file.n_lines"))
        .withColumn("first_line", F.greatest(F.lit(1), c("start_line") - context).cast("bigint"))
        .withColumn("asked_end", c("end_line") + context)
    )
    shape = (
        F.when(_blank("event_id"), "event_id is required").when(_blank("path"), "path is required")
        .when(F.coalesce(c("start_line") < 1, F.lit(True)), "start_line must be a positive integer")
        .when(F.coalesce(c("end_line") < c("start_line"), F.lit(True)), "end_line must be no smaller than start_line")
        .when(F.coalesce(F.length("expected_sha256") != 64, F.lit(True)), "expected_sha256 must be a SHA-256 digest")
    )
    reason = F.coalesce(
        shape,
        F.when(c("_path_known").isNull(), "source path is not registered for the event")
        .when(c("_hash_known").isNull(), "expected_sha256 is not registered for this source")
        .when(unsafe_path("path"), "access to this path is denied")
        .when(c("current_sha256").isNull(), "source file not found")
        .when(c("asked_end") - c("first_line") + 1 > F.lit(max_lines).cast("bigint"), "invalid or excessive fetch range")
        .when(c("current_sha256") != c("expected_sha256"), "source content hash does not match the registered revision"))
    j = (
        j.withColumn("reason", F.coalesce(reason, F.lit("")))
        .withColumn("verified", c("reason") == "")
        .withColumn("integrity_status", F.when(c("verified"), "matched").when(c("reason").startswith("source content hash"), "mismatched"))
        .withColumn("last_line", F.least(c("asked_end"), c("_n")))
        .drop("_e", "_p", "_h", "_hash_known", "_path_known", "_fp", "_files", "_file", "_n", "_e2", "_p2", "asked_end")
        .withColumn("_range", F.struct("path", "current_sha256", "first_line", "last_line"))
    )
    show = c("verified") if not allow_mismatch else c("integrity_status").isNotNull()
    shown = F.when(show & (c("last_line") >= c("first_line")), c("_range"))
    ranges = j.where(shown.isNotNull()).select("_range", "path", c("current_sha256").alias("sha256"), "first_line", "last_line").distinct()
    return j.withColumn("_range", shown).join((render_pages if pages else render_ranges)(ranges, blocks, "_range"), "_range", "left").drop("_range")


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def unsafe_path(path: str, allowed: Sequence[str] | None = None) -> Column:
    """Absolute, parent-relative, denied name or fragment; with ``allowed`` also outside the allow-list.

    ``allowed`` entries are prefixes or globs (``*``, ``?``), turned into patterns when the plan is built.
    """
    p = F.lower(F.col(path))
    base = F.element_at(F.split(p, "/"), -1)
    bad = p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | base.isin(*K.DENIED_BASENAMES) | X.contains_any(p, K.DENIED_FRAGMENTS)
    if allowed is not None:
        bad = bad | ~F.coalesce(F.col(path).rlike("|".join(glob_pattern(a) for a in allowed)), F.lit(False))
    return bad


def glob_pattern(glob: str) -> str:
    stem = glob.rstrip("/")
    body = "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not ch.isalnum() and ch not in "_/-" else ch for ch in stem)
    return f"^{body}(/.*)?$" if "*" not in stem and "?" not in stem else f"^{body}$"


def hit_windows(hits: DataFrame, blocks: DataFrame, context: int = 5, radius: int = 18) -> DataFrame:
    """Line window of each hit: the range, or the focus line +- radius inside it, plus context."""
    n = current_files(blocks).select("path", F.col("n_lines").alias("_n"))
    inside = F.greatest(F.col("start_line"), F.least(F.col("end_line"), F.col("focus_line")))
    focus = F.when(F.col("focus_line").isNotNull(), inside)
    lo = F.when(focus.isNotNull(), F.greatest(F.col("start_line"), focus - radius)).otherwise(F.col("start_line"))
    hi = F.when(focus.isNotNull(), F.least(F.col("end_line"), focus + radius)).otherwise(F.col("end_line"))
    return (
        hits.join(n, "path")
        .withColumn("first_line", F.greatest(F.lit(1), lo - context).cast("bigint"))
        .withColumn("last_line", F.least(F.col("_n"), hi + context).cast("bigint")).drop("_n"))


def attach_lines(hits: DataFrame, blocks: DataFrame, key: str = "hit_id", context: int = 5, radius: int = 18, pages: bool = False) -> DataFrame:
    """Hits with their numbered lines; hits need key, path, start_line, end_line, focus_line (nullable).  ``pages`` as in fetch_evidence."""
    w = hit_windows(hits, blocks, context, radius)
    return w.join((render_pages if pages else render_ranges)(w.select(key, "path", "first_line", "last_line"), blocks, key), key, "left")


def registered_passages(event_sources: DataFrame, registry: DataFrame, files: DataFrame) -> DataFrame:
    """Cited ranges whose path and hash are registered and current, inside the file and not blank.

    The slice is taken from the file row itself, so lines are not exploded and collected again.
    """
    reg = registry.select(F.col("source_path").alias("_p"), F.lower("source_sha256").alias("_h")).distinct()
    cur = files.select(F.col("path").alias("_fp"), F.col("sha256").alias("_cur"), X.lines_of("text").alias("_lines"))
    c = F.col
    ok = event_sources.where("line_start >= 1 AND line_end >= line_start").join(
        reg, (c("source_path") == c("_p")) & (F.lower("source_sha256") == c("_h"))).drop("_p", "_h")
    return (
        ok.join(cur, (c("source_path") == c("_fp")) & (F.lower("source_sha256") == c("_cur")))
        .where(c("line_end") <= F.size("_lines"))
        .withColumn("content", F.array_join(F.slice("_lines", c("line_start").cast("int"), (c("line_end") - c("line_start") + 1).cast("int")), "\n"))
        .where(F.trim(F.regexp_replace("content", r"\s+", "")) != "")
        .drop("_fp", "_cur", "_lines"))


# --- claims ---------------------------------------------------------------------------
def claim_plan(claims: DataFrame) -> DataFrame:
    """Adds active, minimum_distinct_evidence and activation_reason; unknown types fail the row."""
    material = F.col("materiality") == "material"
    auto = (F.col("materiality") == "auto") & F.col("claim_type").isin(*K.AUTO_MATERIAL_TYPES)
    active = material | auto
    known = F.col("claim_type").isin(*K.CLAIM_TYPES) & F.col("materiality").isin(*K.MATERIALITIES)
    return claims.withColumns({
        "supported_type": F.coalesce(known, F.lit(False)), "active": active,
        "minimum_distinct_evidence": F.when(~active, 0).when(F.col("claim_type").isin(*K.TWO_SOURCE_TYPES), 2).otherwise(1),
        "activation_reason": F.when(material, "caller_marked_material").when(auto, "material_claim_type").otherwise("routine_claim"),
    })


def eligibility(claims: DataFrame, checks: DataFrame, distinct_on: str = "event_id") -> DataFrame:
    """Verdict per claim from its evidence checks (claim_id, event_id, verified).

    Checks are reduced per (claim, event) before the per-claim step, so a claim that
    holds a third of all checks is counted map-side.
    """
    per_event = checks.groupBy("claim_id", distinct_on).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("verified"), 0).otherwise(1)).alias("bad"))
    per_claim = per_event.groupBy("claim_id").agg(
        F.sum("n").alias("n_checks"), F.sum("bad").alias("n_invalid"),
        F.count(F.when(F.coalesce(F.col(distinct_on), F.lit("")) != "", 1)).alias("n_distinct"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = claim_plan(claims).join(per_claim, "claim_id", "left")
    short = zero("n_distinct") < F.col("minimum_distinct_evidence")
    blockers = F.concat_ws(",", F.when(zero("n_invalid") > 0, "EVIDENCE-INTEGRITY-INVALID"), F.when(short, "EVIDENCE-ELIGIBILITY-INSUFFICIENT"))
    return j.select(
        "claim_id", "claim_type", "materiality", "active", "minimum_distinct_evidence", "activation_reason",
        F.sha2("claim", 256).alias("claim_sha256"), zero("n_checks").alias("n_checks"), zero("n_invalid").alias("n_invalid"),
        zero("n_distinct").alias("n_distinct"),
        F.when(F.col("active"), blockers).otherwise("").alias("blockers"),
        F.when(~F.col("active"), "not_required").when(blockers != "", "blocked").otherwise("eligible").alias("status"))


def claim_level(df: DataFrame, strict: bool = False) -> DataFrame:
    """Level L0..L3 from kind and the flags final, external, numerical, citation, benchmark, causal, canonical, conflicting."""
    f = F.col
    hard = f("benchmark") | f("causal") | f("canonical") | f("conflicting")
    stated = f("kind").isin("factual", "result")
    level = (
        F.when(hard, "L3")
        .when(f("final") & (stated | f("external") | f("numerical") | f("citation")), "L2")
        .when(stated | f("external"), "L2" if strict else "L1").otherwise("L0"))
    return df.withColumn("level", level)


def render_claims(segments: DataFrame, receipts: DataFrame) -> DataFrame:
    """Eligible segments of an answer, in order; one row per answer.

    segments: answer_id, segment_no, claim_id, text, level, n_evidence, evidence_key;
    receipts: claim_id, retrieval_passed, source_verification_passed, independent_review_passed, receipt_evidence_key.
    An answer's segments are its own length, so the ordered list per answer is bounded by one answer.
    """
    j = segments.join(receipts.withColumn("_r", F.lit(True)), "claim_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    backed = yes("_r") & (F.col("n_evidence") > 0)
    ok = (
        F.when(F.col("level") == "L0", True)
        .when(F.col("level") == "L1", backed & yes("retrieval_passed"))
        .when(F.col("level") == "L2", backed & yes("source_verification_passed"))
        .otherwise(backed & yes("source_verification_passed") & yes("independent_review_passed")))
    same = ~yes("_r") | F.col("receipt_evidence_key").eqNullSafe(F.col("evidence_key"))
    j = j.withColumn("eligible", ok & same)
    pick = lambda cond, col: F.transform(
        F.array_sort(F.filter(F.collect_list(F.struct("segment_no", "claim_id", F.trim("text").alias("text"), "eligible")),
                              lambda s: s["eligible"] if cond else ~s["eligible"])), lambda s: s[col])
    out = j.groupBy("answer_id").agg(
        F.array_join(pick(True, "text"), "\n\n").alias("answer"), F.array_join(pick(False, "claim_id"), ",").alias("blocked_claim_ids"))
    return out.withColumn("status", F.when(F.col("blocked_claim_ids") == "", "passed").otherwise("blocked"))


# --- bundles -----------------------------------------------------------------------------
def evidence_bundle(requests: DataFrame, views: DataFrame, passages: DataFrame, max_passages: int = K.BUNDLE_MAX_PASSAGES,
                    max_lines: int = K.BUNDLE_MAX_LINES, max_bytes: int = K.BUNDLE_MAX_BYTES) -> DataFrame:
    """Passages of the requested current records in request order with running totals.

    requests: (bundle_id, request_no, record_id); views: (record_id, current boolean, reason);
    passages: (record_id, ref_no, path, source_sha256, line_start, line_end, content).  Nothing is
    dropped: rows past a limit carry its name in ``limit_exceeded`` and the caller refuses the bundle.
    """
    j = requests.join(views, "record_id", "left").withColumn("current", F.coalesce("current", F.lit(False)))
    p = j.where("current").join(passages, "record_id")
    p = scale.first_per_key(p, ["bundle_id", "record_id", "path", "line_start", "line_end"], [F.asc("request_no"), F.asc("ref_no")])
    span = (passages.agg(F.max("ref_no")).first()[0] or 0) + 1  # no two references of a bundle share a place
    p = p.withColumn("place", (F.col("request_no").cast("bigint") * span + F.col("ref_no")).cast("bigint"))
    p = p.withColumn("n_bytes", F.octet_length("content").cast("bigint"))
    width = span * 10_000  # ten thousand requests per slice
    p = scale.running_sum(p, ["bundle_id"], "place", F.col("n_bytes"), "total_bytes", width)
    p = scale.position_in_key(p, ["bundle_id"], "place", "passage_no", width)
    limit = (
        F.when(F.col("passage_no") > max_passages, "passages")
        .when(F.col("line_end") - F.col("line_start") + 1 > max_lines, "lines")
        .when(F.col("total_bytes") > max_bytes, "bytes").otherwise(""))
    return p.withColumn("limit_exceeded", limit).drop("place")


def unverified_references(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per answer, how many technical references its own evidence does not contain.

    answers: (answer_id, text), one row per answer; evidence: (answer_id, path, content).  The
    candidate list rides on the answer row, so the join yields one row per evidence row and
    only the references found there are emitted.
    """
    a = answers.select("answer_id", X.technical_references("text").alias("candidates"))
    found = (
        evidence.join(a.where(F.size("candidates") > 0), "answer_id")
        .select("answer_id", F.explode(F.filter(
            "candidates", lambda x: (x == F.col("path")) | F.contains(F.coalesce("content", F.lit("")), x))).alias("c"))
        .distinct().groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_found")))
    n = F.size("candidates").cast("bigint")
    return a.join(found, "answer_id", "left").select(
        "answer_id", n.alias("n_references"), (n - F.coalesce("n_found", F.lit(0))).alias("n_unverified"))


def bind_evaluations(runs: DataFrame, tasks: DataFrame, binding: DataFrame, results: DataFrame, receipts: DataFrame) -> DataFrame:
    """Runs with their blinded verdict and gate receipt.

    binding: (trial_id, evaluation_id, final_answer_sha256); runs carry answer_sha256; receipts:
    (trial_id, gate_status) per recorded gate call, any ``blocked`` wins.
    """
    gate = receipts.where(F.col("gate_status").isin("eligible", "blocked")).groupBy("trial_id").agg(
        F.bool_or(F.col("gate_status") == "blocked").alias("_blocked"))
    j = runs.join(tasks.select("task_id", "materiality"), "task_id").join(binding, "trial_id").join(results, "evaluation_id", "left").join(gate, "trial_id", "left")
    required = F.col("materiality") == "material"
    return j.withColumns({
        "answer_changed": F.col("answer_sha256") != F.col("final_answer_sha256"),
        "gate_required": required.cast("int"),
        "gate_called": (required & F.col("_blocked").isNotNull()).cast("int"),
        "gate_status": F.when(~required, "not_required").when(F.col("_blocked").isNull(), "not_called")
        .when(F.col("_blocked"), "blocked").otherwise("eligible"),
    }).drop("_blocked")
