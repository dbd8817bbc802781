"""Append-only corrections resolved into a current view; supersession; provenance."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens import scale
from ledgerlens.functions import text as X


def check_amendments(amendments: DataFrame, payloads: DataFrame) -> DataFrame:
    """Amendments with their problem (null = applied).

    amendments: position, amendment_id, target_id, pointer, status, recorded_value, corrected_value;
    payloads: record_id, k, value (original payload fields).  The recorded value must equal the value
    left by the previous amendment of the same field, which may be null; the chain is read with a
    two-level lag, so a record with very many amendments is not sorted in one task.
    """
    a = amendments.withColumn("k", X.amendment_key("pointer"))
    orig = payloads.select(F.col("record_id").alias("target_id"), "k", F.col("value").alias("_original"), F.lit(True).alias("_present"))
    a = a.join(orig, ["target_id", "k"], "left")
    form = (
        F.when(F.col("status") != "completed", "only completed amendments can affect a resolved view")
        .when(F.col("k").isNull(), "amendment path must target one payload field")
        .when(F.col("_present").isNull(), "target payload field is absent"))
    a = a.withColumn("_form", form).withColumn("_ok", F.when(F.col("_form").isNull(), F.struct(F.col("corrected_value").alias("v"))))
    a = scale.last_known(a, ["target_id", "k"], "position", {"_before": F.col("_ok")})
    current = F.when(F.col("_before").isNotNull(), F.col("_before.v")).otherwise(F.col("_original"))
    problem = F.coalesce("_form", F.when(~current.eqNullSafe(F.col("recorded_value")), "recorded value does not match current resolved value"))
    return a.withColumn("problem", problem).drop("_original", "_present", "_form", "_ok", "_before")


def resolve_amendments(checked: DataFrame, payloads: DataFrame) -> DataFrame:
    """Current value per payload field; ``blocked`` for all fields of a record one of whose amendments has a problem, also a
    malformed pointer or an absent field (fail closed).  A field corrected to null is null."""
    per = checked.where("k IS NOT NULL").groupBy(F.col("target_id").alias("record_id"), "k").agg(
        F.max_by(F.struct(F.col("corrected_value").alias("v")), "position").alias("_last"), F.count(F.when(F.col("problem").isNull(), 1)).alias("n_applied"))
    bad = checked.where("problem IS NOT NULL").select(F.col("target_id").alias("record_id")).distinct().withColumn("_bad", F.lit(True))
    j = payloads.join(per, ["record_id", "k"], "left").join(bad, "record_id", "left")
    value = F.when(F.col("_last").isNotNull(), F.col("_last.v")).otherwise(F.col("value"))
    blocked = F.coalesce("_bad", F.lit(False))
    return j.select(
        "record_id", "k", F.when(~blocked, value).alias("current_value"), F.coalesce("n_applied", F.lit(0)).alias("n_applied"), blocked.alias("blocked"))


def absent_targets(checked: DataFrame, payloads: DataFrame) -> DataFrame:
    """Records that amendments name but that do not exist: they are blocked, too."""
    return checked.select(F.col("target_id").alias("record_id")).distinct().join(payloads.select("record_id"), "record_id", "left_anti")


def check_ranges(corrections: DataFrame, originals: DataFrame) -> DataFrame:
    """Corrections of a source range with their problem.

    corrections: position, correction_id, target_id, field (line_start / line_end / other), recorded, corrected;
    originals: target_id, line_start, line_end.  Each step sees both fields as left by earlier steps.
    """
    c = corrections.join(originals, "target_id", "left")
    value = lambda f: F.when(F.col("field") == f, F.col("corrected"))
    c = scale.last_known(c, ["target_id"], "position", {"_s": value("line_start"), "_e": value("line_end")})
    start, end = F.coalesce("_s", "line_start"), F.coalesce("_e", "line_end")
    is_start = F.col("field") == "line_start"
    problem = (
        F.when(~F.col("field").isin("line_start", "line_end"), "unsupported corrected JSON pointer")
        .when(F.col("line_start").isNull() & F.col("line_end").isNull(), "correction target is missing")
        .when(F.coalesce(F.col("corrected") < 1, F.lit(True)) | F.col("recorded").isNull(), "correction values must be positive integers")
        .when(F.col("recorded") != F.when(is_start, start).otherwise(end), "recorded value does not match current target value")
        .when(F.when(is_start, F.col("corrected") > end).otherwise(start > F.col("corrected")), "corrected source range is invalid"))
    return c.withColumn("problem", problem).drop("_s", "_e", "line_start", "line_end")


def resolve_ranges(checked: DataFrame, originals: DataFrame) -> DataFrame:
    """Final range per target; blocked where a step had a problem."""
    last = lambda f: F.max_by(F.col("corrected"), F.when(F.col("field") == f, F.col("position")))
    per = checked.groupBy("target_id").agg(last("line_start").alias("_s"), last("line_end").alias("_e"), F.count("problem").alias("_n"))
    bad = F.coalesce(F.col("_n"), F.lit(0)) > 0
    pick = lambda new, old: F.when(bad, F.col(old)).otherwise(F.coalesce(new, old))
    return originals.join(per, "target_id", "left").select(
        "target_id", pick("_s", "line_start").alias("line_start"), pick("_e", "line_end").alias("line_end"), bad.alias("blocked"))


def current_records(records: DataFrame, relations: DataFrame) -> DataFrame:
    """Records with ``authority``: current, superseded, pending_supersession or pending_amendment.

    relations: status, relation_type, target_id of the relating record.  Relations are reduced to
    flags per target before the join.
    """
    r = relations.where(~F.col("status").isin(*K.IGNORED_STATUSES))
    done = F.col("status") == "completed"
    flags = r.groupBy("target_id").agg(
        F.bool_or((F.col("relation_type") == "supersedes") & done).alias("_superseded"),
        F.bool_or((F.col("relation_type") == "supersedes") & ~done).alias("_pending"),
        F.bool_or((F.col("relation_type") == "corrects") & F.col("status").isin(*K.PENDING_STATUSES)).alias("_amending"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = (
        F.when(yes("_amending"), "pending_amendment").when(yes("_superseded"), "superseded")
        .when(yes("_pending"), "pending_supersession").otherwise("current"))
    return (
        records.join(flags.withColumnRenamed("target_id", "_t"), F.col("record_id") == F.col("_t"), "left")
        .withColumn("authority", state).drop("_t", "_superseded", "_pending", "_amending"))


def authority_view(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Canonical and resolved content hash per record field with the number of applied amendments.

    records: record_id, k, value; resolved: resolve_amendments output.
    """
    h = lambda v: F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(F.col("k"), F.col("record_id"), v.alias("value"))), 256))
    return records.join(resolved, ["record_id", "k"]).where("NOT blocked").select(
        "record_id", "k", h(F.col("value")).alias("canonical_hash"), h(F.col("current_value")).alias("resolved_hash"), "n_applied")


def with_direct_provenance(primary: DataFrame, references: DataFrame, events: DataFrame) -> DataFrame:
    """Primary events plus the events they reference directly; one hop, no recursion.

    primary: qid, event_id; references: event_id, target.
    """
    linked = primary.join(references, "event_id").select("qid", F.col("target").alias("event_id")).join(events.select("event_id"), "event_id", "left_semi")
    return (
        primary.select("qid", "event_id", F.lit(0).alias("hop")).unionByName(linked.select("qid", "event_id", F.lit(1).alias("hop")))
        .groupBy("qid", "event_id").agg(F.min("hop").alias("hop")))


def _leaves(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Scalar leaves of each JSON text, walked with a stack; numbers keep their text, also NaN and the infinities.  A text that
    the parser cannot open gives one row that says so, never nothing."""
    for series in bodies:
        out = []
        for body in series:
            stack, found = [], []
            try:
                if body is not None:
                    stack.append(("", "", "", json.loads(body, parse_float=str, parse_int=str, parse_constant=str)))
            except ValueError:
                found.append({"error": "not_json"})
            except RecursionError:
                found.append({"error": "too_deep"})
            while stack:
                path, key, ancestors, v = stack.pop()
                below = f"{ancestors}/{key.lower()}"
                if isinstance(v, dict):
                    stack += [(f"{path}/{k}", k or key, below, x) for k, x in reversed(v.items())]
                elif isinstance(v, list):
                    stack += [(f"{path}/", key, below, x) for x in reversed(v)]
                else:
                    text = {None: "null", True: "true", False: "false"}[v] if v is None or isinstance(v, bool) else v
                    found.append({"path": path, "key": key, "ancestors": ancestors, "value": text})
            out.append(found)
        yield pd.Series(out)


def json_leaves(df: DataFrame, id_col: str, body: str) -> DataFrame:
    """Scalar leaves of a JSON document: (id, path, key, ancestors, value, error).

    One pass: the text is parsed and walked inside its row.  A text that is no JSON (error "not_json") or is nested deeper
    than the parser follows, some thousands of levels ("too_deep"), gives one row with only id and error, so that callers
    can count what was not read; leaves have a null error.  Null texts and empty containers have no leaves.
    """
    walk = F.pandas_udf(_leaves, "array<struct<path:string,key:string,ancestors:string,value:string,error:string>>")
    return df.select(F.col(id_col).alias("id"), F.explode(walk(F.col(body))).alias("e")).select("id", "e.*")


def metric_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves whose key, or a container above, names a metric."""
    has = lambda c, words: X.contains_any(F.lower(F.col(c)), words)
    return leaves.where(has("ancestors", K.METRIC_CONTAINER_KEYS) | has("key", K.METRIC_CONTAINER_KEYS) | has("key", K.METRIC_SCALAR_KEYS))


def provenance_ids(leaves: DataFrame) -> DataFrame:
    """(id, target): event ids named under provenance keys."""
    under = X.contains_any(F.lower(F.col("key")), K.PROVENANCE_KEYS) | X.contains_any(F.col("ancestors"), K.PROVENANCE_KEYS)
    return leaves.where(under).select("id", F.explode(F.regexp_extract_all("value", F.lit(r"(?i)evt_[A-Za-z0-9_.-]+"), F.lit(0))).alias("target")).distinct()
