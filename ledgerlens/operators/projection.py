"""Projections of records into index documents, sources, retrieval texts and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as K


def _payload(key: str) -> Column:
    return F.get_json_object("payload", f"$.{key}")


def summary_text() -> Column:
    """payload summary, statement, objective, title, observed.statement, observed, else "kind record id"."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    observed = _payload("observed")
    is_object = F.coalesce(observed.startswith("{"), F.lit(False))
    return F.coalesce(
        *[text(_payload(k)) for k in ("summary", "statement", "objective", "title")],
        F.when(is_object, F.trim(_payload("observed.statement"))), F.when(~is_object, text(observed)),
        F.concat_ws(" ", F.coalesce("record_kind", F.lit("research")), F.lit("record"), F.coalesce("record_id", F.lit("unknown"))))


def index_documents(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("record_id").alias("event_id"), F.substring("occurred_at", 1, 10).alias("date"), F.col("record_kind").alias("event_type"),
        "status", F.coalesce(F.nullif("study_id", F.lit("")), F.lit("unscoped-study")).alias("project"),
        _payload("workstream").alias("workstream"), summary_text().alias("summary"))


def record_sources(records: DataFrame) -> DataFrame:
    """Cited sources, one row per distinct (path, hash, start, end) with the first ordinal; review flags OR-ed.

    A record's own source list is the group, reduced with min/or and no collected list.
    """
    loc = lambda k: F.get_json_object("s.locator", f"$.{k}")
    s = records.select("record_id", "record_kind", F.posexplode("source_refs").alias("ordinal", "s"))
    whole = lambda a, b: F.coalesce(loc(a), loc(b)).try_cast("bigint")
    flat = s.select(
        "record_id", "ordinal", loc("path").alias("source_path"),
        F.nullif(F.regexp_extract(F.coalesce("s.artifact_revision_id", F.lit("")), r"@sha256:([a-f0-9]{64})$", 1), F.lit("")).alias("source_sha256"),
        F.coalesce(F.nullif(loc("heading"), F.lit("")), F.col("record_kind"), F.lit("Research record")).alias("heading"),
        whole("start", "line_start").alias("line_start"), whole("end", "line_end").alias("line_end"),
        F.coalesce(F.col("s.verification_status") != "human_verified", F.lit(True)).alias("requires_human_review"),
    ).where("source_path IS NOT NULL")
    return flat.groupBy("record_id", "source_path", "source_sha256", "line_start", "line_end").agg(
        F.min("ordinal").alias("ordinal"), F.min_by("heading", "ordinal").alias("heading"), F.bool_or("requires_human_review").alias("requires_human_review"))


def titled_summary() -> Column:
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("unknown")))
    return F.concat_ws("\n", line("Title", F.coalesce("heading", "event_id")), line("Event type", F.col("event_type")),
                       line("Status", F.col("status")), F.concat(F.lit("Summary: "), F.coalesce("summary", F.lit(""))))


def allowlisted_text(limits: tuple[int, int, int] | None = None) -> Column:
    """Six named fields, whole; ``limits`` cuts name fields, type and status, and the summary to so many characters."""
    name, kind, long = limits or (None, None, None)

    def cut(c: Column, n: int | None) -> Column:
        clean = F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\u0000"), F.lit("")))
        return clean if n is None else F.substring(clean, 1, n)

    title = F.coalesce(F.nullif(cut(F.col("heading"), name), F.lit("")), cut(F.col("event_id"), name))
    fields = [("Title", title), ("Event type", cut(F.col("event_type"), kind)), ("Status", cut(F.col("status"), kind)),
              ("Project", cut(F.col("project"), name)), ("Workstream", cut(F.col("workstream"), name)), ("Summary", cut(F.col("summary"), long))]
    return F.concat_ws("\n", *[F.when(v != "", F.concat(F.lit(f"{n}: "), v)) for n, v in fields])


def detailed_text(details: dict[str, Column]) -> Column:
    """Titled summary plus ``name: json`` lines of the given detail columns that are present."""
    return F.concat_ws("\n", titled_summary(), *[
        F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in details.items()])


def normalize_edges(df: DataFrame, column: str, id_col: str, kind: str) -> DataFrame:
    """Array of variants -> rows; a bare string is a path (artifacts) or a derived_from target (relations)."""
    v = df.select(id_col, F.posexplode(column).alias("ordinal", "v"))
    bare = F.schema_of_variant("v") == "STRING"
    text = F.try_variant_get("v", "$", "string")
    field = lambda *names: F.coalesce(*[F.try_variant_get("v", f"$.{n}", "string") for n in names])
    if kind == "artifacts":
        return v.select(id_col, "ordinal", F.when(bare, text).otherwise(field("path")).alias("path"),
                        F.when(~bare, field("sha256")).alias("sha256"), F.when(~bare, field("role")).alias("role"))
    return v.select(id_col, "ordinal", F.when(bare, "derived_from").otherwise(F.coalesce(field("type"), F.lit("unknown"))).alias("type"),
                    F.when(bare, text).otherwise(F.coalesce(field("target", "target_id"), F.lit("unknown"))).alias("target"))


def edge_table(edges: DataFrame) -> DataFrame:
    """One row per (event, type, target)."""
    return edges.select("event_id", "type", "target").dropDuplicates()


def attach_edges(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of edges and the first and last target per event, reduced map-side; the edge rows themselves
    stay in the edge table (an event may be the source of any number of edges)."""
    e = edge_table(edges).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.min("target").alias("first_target"), F.max("target").alias("last_target"))
    return events.join(e, "event_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def related_to(events: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Events with an edge to one of the targets (column target)."""
    return events.join(edges.join(targets.select("target").distinct(), "target", "left_semi"), "event_id", "left_semi")


def refresh_eligibility(events: DataFrame, recorded: str) -> DataFrame:
    """Whether an event may trigger a view refresh, with the reason."""
    kind = F.coalesce(F.col("event_type"), F.lit(""))
    reason = (
        F.when(~F.col(recorded), "canonical event has not been recorded")
        .when(F.coalesce(F.col("event_id"), F.lit("")) == "", "event has no stable identifier")
        .when(~kind.isin(*K.REFRESH_KINDS), "event does not change research-state retrieval")
        .otherwise("canonical research event changes searchable research state"))
    return events.withColumn("reason", reason).withColumn("eligible", F.col("reason").startswith("canonical research"))


def evidence_record_eligible(status: str, kind: str, markers: list[str], flags: list[str]) -> Column:
    """Status admits evidence, kind is no amendment, nothing marks the record withdrawn."""
    ok = F.col(status).isin(*K.ELIGIBLE_STATUSES) & (F.col(kind) != "amendment")
    for m in markers:
        ok = ok & ~F.lower(F.coalesce(F.col(m), F.lit(""))).isin(*K.WITHDRAWN_MARKERS)
    for f in flags:
        ok = ok & ~F.coalesce(F.col(f), F.lit(False))
    return ok
