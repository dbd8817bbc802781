"""Fingerprints, currency, hash chains, state machines, manifests, journals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens import scale

WORDS = 4


def multiset_hash(row: Column) -> list[Column]:
    """Aggregates of a combinable content hash: the row hashes are added as four 60-bit words.

    Sums combine map-side and in any order, so a fingerprint of any number of rows needs no sorted
    list and no single task that sees all rows.
    """
    word = lambda i: F.conv(F.substring(F.sha2(row, 256), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    return [F.sum(word(i)).alias(f"w{i}") for i in range(WORDS)]


def _digest() -> Column:
    parts = [F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(WORDS)]
    return F.sha2(F.concat_ws("|", F.col("n").cast("string"), *parts), 256)


def fingerprint(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Digest over the (path, sha256) pairs, per ``by`` group or of all files."""
    row = F.concat_ws("|", F.lit("v1"), "path", "sha256")
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *multiset_hash(row)).select(*by, F.col("n").alias("file_count"), _digest().alias("fingerprint"))


def bundle_hash(passages: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Digest of an evidence set; the place of a passage is one of its columns, so order counts."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return passages.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *multiset_hash(row)).select(*by, F.col("n").alias("n_passages"), _digest().alias("bundle_hash"))


def verify_chain(events: DataFrame, own_hash: Column, run: str = "run_id") -> DataFrame:
    """(run, sequence, problem) of a hash chain.

    events: run, sequence, previous_event_hash, event_hash; ``own_hash`` recomputes a row's hash.  The
    predecessor is fetched by an equi-join on (run, sequence - 1): rows of one long run spread
    over all tasks instead of being sorted in one.
    """
    per_seq = events.groupBy(run, "sequence").agg(F.min("event_hash").alias("_h"), F.count(F.lit(1)).alias("_n"))
    prev = per_seq.select(run, (F.col("sequence") + 1).alias("sequence"), F.col("_h").alias("_prev"), F.lit(True).alias("_has"))
    twice = per_seq.where("_n > 1").select(run, "sequence", F.lit(True).alias("_twice"))
    j = events.join(prev, [run, "sequence"], "left").join(twice, [run, "sequence"], "left")
    gap = (F.col("sequence") > 1) & F.col("_has").isNull()
    problem = (
        F.when(F.col("sequence") < 1, "sequence").when(F.coalesce("_twice", F.lit(False)) | gap, "sequence")
        .when(~F.col("previous_event_hash").eqNullSafe(F.col("_prev")), "previous_hash")
        .when(~F.col("event_hash").eqNullSafe(own_hash), "event_hash"))
    return j.withColumn("problem", problem).where("problem IS NOT NULL").select(run, "sequence", "problem")


def first_violation(violations: DataFrame, run: str = "run_id") -> DataFrame:
    return violations.groupBy(run).agg(F.min(F.struct("sequence", "problem")).alias("f"), F.count(F.lit(1)).alias("n_problems")).select(
        run, "f.sequence", "f.problem", "n_problems")


def verify_transitions(events: DataFrame, transitions: Sequence[tuple[str, str]], keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Rows whose from_state is not the previous to_state, or whose step is not in ``transitions`` (a short fixed list)."""
    e = scale.previous_row(events, list(keys), "sequence", {"_state": "to_state"})
    step = F.struct(F.coalesce("_state", F.lit("")).alias("a"), F.coalesce("to_state", F.lit("")).alias("b"))
    legal = step.isin(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in transitions])
    problem = F.when(~F.col("from_state").eqNullSafe(F.col("_state")), "from_state").when(~legal, "transition")
    return e.withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "sequence", "problem")


def verify_session_transitions(events: DataFrame) -> DataFrame:
    """The session-scope state machine: every session of a run is checked on its own."""
    return verify_transitions(events, K.SESSION_TRANSITIONS, ("run_id", "session_id"))


def current_state(events: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.max_by("to_state", "sequence").alias("state"), F.count(F.lit(1)).alias("event_count"), F.max_by("event_hash", "sequence").alias("head_hash"))


def verify_seals(states: DataFrame, seals: DataFrame, run: str = "run_id") -> DataFrame:
    """Terminal runs need a seal whose state, count and head hash match; others must have none.

    seals: run, terminal_state, event_count, head_hash.
    """
    s = seals.select(run, F.col("terminal_state").alias("_s"), F.col("event_count").alias("_n"), F.col("head_hash").alias("_h"))
    terminal = F.col("state").isin(*K.TERMINAL_RUN_STATES)
    match = (F.col("_s") == F.col("state")) & (F.col("_n") == F.col("event_count")) & (F.col("_h") == F.col("head_hash"))
    return states.join(s, run, "left").withColumn(
        "seal_status",
        F.when(F.col("_s").isNull(), F.when(terminal, "missing").otherwise("open"))
        .when(terminal & F.coalesce(match, F.lit(False)), "sealed").otherwise("mismatch")).drop("_s", "_n", "_h")


def build_manifest(groups: dict[str, DataFrame]) -> DataFrame:
    """(group, path, sha256, size_bytes, overlaps): ``overlaps`` marks a path named in several places."""
    out = None
    for name, df in groups.items():
        part = df.select(F.lit(name).alias("file_group"), "path", "sha256", "size_bytes")
        out = part if out is None else out.unionByName(part)
    twice = out.groupBy("path").agg((F.count(F.lit(1)) > 1).alias("overlaps"))
    return out.join(twice, "path")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Set equality, size and hash of manifest against files: one row per path that differs."""
    m = manifest.select("path", F.col("sha256").alias("_ms"), F.col("size_bytes").alias("_mz"))
    f = files.select("path", F.col("sha256").alias("_fs"), F.col("size_bytes").alias("_fz"))
    problem = (
        F.when(F.col("_fs").isNull(), "missing file").when(F.col("_ms").isNull(), "unlisted file")
        .when(F.col("_mz") != F.col("_fz"), "size mismatch").when(F.col("_ms") != F.col("_fs"), "hash mismatch"))
    return m.join(f, "path", "full_outer").withColumn("problem", problem).where("problem IS NOT NULL").select("path", "problem")


def journal_status(ops: DataFrame, files: DataFrame) -> DataFrame:
    """Append operations: applied, pending or conflicting, from (size, hash) before, after and now.

    ops: op_id, path, before_exists, before_size, before_sha256, after_size, after_sha256.
    """
    f = files.select(F.col("path").alias("_p"), F.col("size_bytes").alias("_z"), F.col("sha256").alias("_h"))
    j = ops.join(f, F.col("path") == F.col("_p"), "left")
    size = F.coalesce("_z", F.lit(0))
    digest = F.coalesce("_h", F.sha2(F.lit(""), 256))
    status = (
        F.when((size == F.col("after_size")) & (digest == F.col("after_sha256")), "applied")
        .when((size == F.col("before_size")) & (digest == F.col("before_sha256")) & (F.col("_p").isNotNull() == F.col("before_exists")), "pending")
        .otherwise("conflicting"))
    return j.withColumn("status", status).select("op_id", "path", "status")


def view_status(stored: DataFrame, recomputed: DataFrame, schema_version: str) -> DataFrame:
    """Per view: missing, stale or current, with the failed checks.

    stored: view, schema_version, fingerprint, row_count, health; recomputed: view, fingerprint, row_count.
    """
    r = recomputed.select("view", F.col("fingerprint").alias("_f"), F.col("row_count").alias("_n"))
    j = r.join(stored, "view", "left")
    failed = F.concat_ws(
        ",", F.when(F.col("schema_version") != schema_version, "schema_version"), F.when(F.col("fingerprint") != F.col("_f"), "fingerprint"),
        F.when(F.col("row_count") != F.col("_n"), "row_count"), F.when(F.coalesce("health", F.lit("")).isin("partial", "failed", "stale"), "health"))
    return j.select("view", F.when(F.col("fingerprint").isNull(), "missing").when(failed != "", "stale").otherwise("current").alias("status"),
                    F.when(F.col("fingerprint").isNull(), "").otherwise(failed).alias("failed_checks"))


def verify_view(expected: DataFrame, view: DataFrame, key: str, text_hash: str) -> DataFrame:
    """Ids and text hashes of a view against the expected rows: counts of each kind of difference."""
    e = expected.select(key, F.col(text_hash).alias("_e"))
    v = view.select(key, F.col(text_hash).alias("_v"))
    j = e.join(v, key, "full_outer")
    return j.agg(
        F.count("_e").alias("n_expected"), F.count("_v").alias("n_view"),
        F.count(F.when(F.col("_v").isNull(), 1)).alias("n_missing"), F.count(F.when(F.col("_e").isNull(), 1)).alias("n_unexpected"),
        F.count(F.when(F.col("_e") != F.col("_v"), 1)).alias("n_changed"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, with the side; empty when the two multisets are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
