"""A view of events and their passages that new events and corrections of source ranges keep current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.issues import raise_if_any
from ledgerlens.operators import lineage as L
from ledgerlens.streaming.store import Store

EVENT_DDL = "event_id STRING, position LONG, event_type STRING, status STRING, source_path STRING, heading STRING, line_start LONG, line_end LONG, summary STRING"
FIX_DDL = "correction_id STRING, position LONG, target_id STRING, field STRING, recorded LONG, corrected LONG"
LEDGER_DDL = f"{EVENT_DDL}, target_id STRING, field STRING, recorded LONG, corrected LONG"


class RefreshedViews:
    """foreachBatch sink over ledger rows (``LEDGER_DDL``) with three linked views: events, corrections by target, passages.

    ``passages_of(events)`` cuts the ranges of (event_id, source_path, heading, line_start, line_end) into rows with at least
    event_id and text_sha256; ``embed(passages)`` adds vector columns and keeps every row.  All views are bucketed by the event id (corrections
    by their target's), so one batch reads and rewrites the buckets of its events and its targets only.

    - The row of the greatest position wins per event, in one batch and position the one of the greatest values; rows that
      are not newer change nothing.
    - A completed amendment with a target is a correction; a repeated one changes nothing.  A correction of an event that is
      neither stored nor in the batch fails the batch.
    - Passages of new, newer and corrected events are cut anew by their resolved range (recorded values must match, else
      the original range stays) and replace the stored ones; passages with the same text keep their vectors.
    - A batch that changes nothing writes nothing; a repeated batch is known by its number.
    """

    def __init__(self, spark: SparkSession, base: str, passages_of: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], buckets: int = 64) -> None:
        self.store, self.passages_of, self.embed = Store(spark, base, buckets), passages_of, embed
        self.passage_schema = None
        self.reports: list[dict] = []

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.reports.append(self.apply(batch, batch_id))

    def _passage_schema(self):
        if self.passage_schema is None:
            none = self.store.spark.createDataFrame([], "event_id STRING, source_path STRING, heading STRING, line_start LONG, line_end LONG")
            self.passage_schema = self.embed(self.passages_of(none)).schema
        return self.passage_schema

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        """Written once per batch to a folder that the next batch overwrites; several steps read it."""
        df.write.mode("overwrite").parquet(f"{self.store.base}/staged/{name}")
        return self.store.spark.read.schema(df.schema).parquet(f"{self.store.base}/staged/{name}")

    def apply(self, batch: DataFrame, batch_id: int) -> dict:
        """One batch; returns its status (updated, no_change, repeated) and counts."""
        store = self.store
        state = store.state()
        if state.batch >= batch_id:
            return {"status": "repeated", "batch": batch_id}
        rows = self._staged(batch.select(*[c.split()[0] for c in LEDGER_DDL.split(", ")]), "batch")
        fixes = rows.where("event_type = 'amendment' AND status = 'completed' AND target_id IS NOT NULL").select(
            F.col("event_id").alias("correction_id"), "position", "target_id", "field", "recorded", "corrected")
        ids = rows.select(store.bucket("event_id").alias("b")).union(fixes.select(store.bucket("target_id"))).distinct()
        touched = [r.b for r in ids.collect()]  # at most as many numbers as there are buckets
        old_events = store.read("events", EVENT_DDL, state, touched)
        old_fixes = store.read("corrections", FIX_DDL, state, touched)
        fields = [c.split()[0] for c in EVENT_DDL.split(", ")][1:]
        newest = rows.groupBy("event_id").agg(F.max(F.struct(*fields)).alias("r")).select("event_id", "r.*")
        known = old_events.select("event_id", F.col("position").alias("_p"))
        newer = newest.join(known, "event_id", "left").where("_p IS NULL OR position > _p").withColumn("_new", F.col("_p").isNull()).drop("_p")
        newer = self._staged(newer, "newer")
        new_fixes = self._staged(fixes.dropDuplicates(["correction_id"]).join(old_fixes.select("correction_id"), "correction_id", "left_anti"), "fixes")
        n_new, n_newer = newer.agg(F.count(F.when(F.col("_new"), 1)), F.count(F.when(~F.col("_new"), 1))).first()
        n_fixes = new_fixes.count()
        if not n_new + n_newer + n_fixes:
            return {"status": "no_change", "batch": batch_id, "new_events": 0, "newer_events": 0, "refreshed_events": 0, "new_passages": 0, "kept_passages": 0}

        events = old_events.join(newer.select("event_id"), "event_id", "left_anti").unionByName(newer.drop("_new"))
        all_fixes = old_fixes.unionByName(new_fixes)
        targets = new_fixes.select(F.col("target_id").alias("event_id")).distinct()
        raise_if_any(targets.join(events, "event_id", "left_anti"), "correction targets are missing")
        affected = targets.union(newer.select("event_id")).distinct()
        mine = events.join(affected, "event_id", "left_semi")
        ranges = mine.select(F.col("event_id").alias("target_id"), "line_start", "line_end")
        own_fixes = all_fixes.join(affected.withColumnRenamed("event_id", "target_id"), "target_id", "left_semi")
        resolved = L.resolve_ranges(L.check_ranges(own_fixes, ranges), ranges).select(F.col("target_id").alias("event_id"), "line_start", "line_end")
        wanted = self._staged(self.passages_of(mine.select("event_id", "source_path", "heading").join(resolved, "event_id")), "wanted")

        schema = self._passage_schema()
        stored = store.read("passages", schema, state, touched)
        added = [f.name for f in schema.fields if f.name not in wanted.columns]
        have = stored.join(affected, "event_id", "left_semi").groupBy("event_id", "text_sha256").agg(*[F.first(c).alias(c) for c in added])
        kept = wanted.join(have, ["event_id", "text_sha256"]) if added else wanted.join(have, ["event_id", "text_sha256"], "left_semi")
        fresh = self.embed(wanted.join(have.select("event_id", "text_sha256"), ["event_id", "text_sha256"], "left_anti"))
        names = [f.name for f in schema.fields]
        both = kept.select(*names, F.lit(True).alias("_kept")).unionByName(fresh.select(*names, F.lit(False).alias("_kept")))
        replaced = self._staged(both, "passages")
        refreshed = targets.join(known, "event_id", "left_semi").count()
        total, again = replaced.agg(F.count("*"), F.count(F.when(F.col("_kept"), 1))).first()
        store.commit(state, batch_id, {
            "events": (events, "event_id"), "corrections": (all_fixes, "target_id"),
            "passages": (stored.join(affected, "event_id", "left_anti").unionByName(replaced.drop("_kept")), "event_id")}, touched)
        return {"status": "updated", "batch": batch_id, "new_events": n_new, "newer_events": n_newer, "refreshed_events": refreshed,
                "new_passages": total - again, "kept_passages": again}

    def events(self) -> DataFrame:
        return self.store.read("events", EVENT_DDL)

    def passages(self) -> DataFrame:
        return self.store.read("passages", self._passage_schema())
