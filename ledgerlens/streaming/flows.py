"""Structured Streaming: file trigger, incremental views, duplicate ids, online state checks, running totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ledgerlens import constants as K
from ledgerlens import scale
from ledgerlens.operators.validation import usage_problem
from ledgerlens.streaming.store import COMMIT, Store


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*", fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    return (
        spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", per_trigger).load(folder))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop.  ``sink`` is a Parquet folder or a foreachBatch function."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if callable(sink) else w.format("parquet").option("path", sink).start()
    q.awaitTermination()


def upsert_view(base: str, key: str, text_hash: str, embed: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64):
    """A foreachBatch function that keeps a keyed view current (``Store``: two slots per hash bucket of the key).

    A batch rewrites only the buckets its changed rows fall into; choose ``buckets`` so that one bucket is one comfortable
    file.  A repeated batch is known by its number and changes nothing.  The row of the greatest position always wins;
    where its text hash is that of the stored row, the columns that ``embed`` adds are taken over instead of being computed
    anew.  A batch without newer rows writes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, base, buckets)
        state = store.state()
        if state.batch >= batch_id:
            return
        others = [c for c in batch.columns if c != key]
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*others), F.col("position")).alias("r")).select(key, "r.*")
        if not state.live:
            rows, touched = embed(newest) if embed else newest, list(range(buckets))
        else:
            touched = [r[0] for r in newest.select(store.bucket(key)).distinct().collect()]  # at most ``buckets`` numbers
            every = spark.read.parquet(*store.folders("rows", state)[:1]).drop(COMMIT).schema
            old = store.read("rows", every, state, touched)
            added = [c for c in old.columns if c not in batch.columns]
            have = old.select(key, F.col("position").alias("_p"), F.col(text_hash).alias("_h"), *added)
            later = newest.join(have, key, "left").where("_p IS NULL OR position > _p")
            touched = [r[0] for r in later.select(store.bucket(key)).distinct().collect()]
            if not touched:
                return
            same = F.coalesce(F.col(text_hash) == F.col("_h"), F.lit(False))
            changed = later.where(~same).drop("_p", "_h", *added)
            fresh = embed(changed) if embed else changed
            rows = store.read("rows", every, state, touched).join(later.select(key), key, "left_anti").unionByName(fresh).unionByName(
                later.where(same).drop("_p", "_h"))
        store.commit(state, batch_id, {"rows": (rows, key)}, touched)

    return apply


def read_upserted(spark: SparkSession, base: str, buckets: int = 64) -> DataFrame:
    store = Store(spark, base, buckets)
    return spark.read.parquet(*store.folders("rows", store.state())).drop(COMMIT)


PAGE_BITS = 32_768  # bits of one page of a filter (4 KB)


class UniqueIds:
    """foreachBatch sink that passes on the first row of every id, exact against all history, and sets aside repeats.

    Published ids are kept in hash buckets; each bucket has a Bloom filter of ``pages`` pages of 4 KB.  A batch reads the
    pages its ids fall on; ids whose two bits are not both set are new for certain.  Only the buckets of the other ids are
    read to decide.  Ids and filter pages are appended per batch under the batch's number, so a repeated batch rewrites its
    own files and does not see itself; every ``compact`` batches the files of before are merged into the other slot.
    """

    def __init__(self, spark: SparkSession, base: str, key: str, order: str, buckets: int = 64, pages: int = 8, compact: int = 64) -> None:
        self.spark, self.base, self.key, self.order = spark, base, key, order
        self.buckets, self.pages, self.compact = buckets, pages, compact
        self.read_buckets: list[int] = []  # how many buckets of ids each batch had to read

    def _slot(self, batch_id: int) -> int:
        return batch_id // self.compact % 2

    def _before(self, kind: str, schema: str, batch_id: int, only: list[int] | None = None) -> DataFrame:
        """Rows of earlier batches (those of the last compaction included)."""
        try:
            rows = self.spark.read.schema(f"{schema}, batch LONG, bucket INT").parquet(f"{self.base}/{kind}/slot={self._slot(batch_id)}")
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], f"{schema}, batch LONG, bucket INT")
        rows = rows.where(F.col("batch") < batch_id)
        return rows if only is None else rows.where(F.col("bucket").isin(only))

    def _write(self, rows: DataFrame, kind: str, batch_id: int, slot: int) -> None:
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "batch", "bucket").parquet(f"{self.base}/{kind}/slot={slot}")

    def _bits(self, rows: DataFrame) -> DataFrame:
        """Two (page, bit) places per id, both on one page."""
        h = F.xxhash64("id", F.lit(7))
        return rows.withColumn("page", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(self.pages)).cast("int")).withColumn(
            "bit", F.explode(F.array(F.pmod(h, F.lit(PAGE_BITS)), F.pmod(F.shiftright(h, 20), F.lit(PAGE_BITS)))))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        ids = "id STRING"
        if batch_id and batch_id % self.compact == 0:  # merge what the other slot holds
            merged = {
                "ids": self._merged("ids", ids, batch_id).select("id", "bucket"),
                "filter": self._merged("filter", "page INT, bits BINARY", batch_id).groupBy("bucket", "page").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))}
            for kind, kept in merged.items():
                kept.withColumn("batch", F.lit(batch_id - 1)).write.mode("overwrite").partitionBy("batch", "bucket").parquet(
                    f"{self.base}/{kind}/slot={self._slot(batch_id)}")
        rows = batch.withColumn("_id", F.col(self.key).cast("string")).withColumn("_bucket", F.pmod(F.xxhash64("_id"), F.lit(self.buckets)).cast("int"))
        firsts = scale.first_per_key(rows, ["_id", "_bucket"], [F.col(self.order)])
        firsts.write.mode("overwrite").parquet(f"{self.base}/staged")
        firsts = self.spark.read.schema(firsts.schema).parquet(f"{self.base}/staged")
        pages = self._before("filter", "page INT, bits BINARY", batch_id)
        places = [F.col("_id").alias("id"), F.col("_bucket").alias("bucket")]
        asked = self._bits(firsts.select(*places)).groupBy("id", "bucket", "page").agg(F.collect_list("bit").alias("at"))
        byte = lambda b: F.conv(F.hex(F.substring("bits", (F.floor(b / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        on = F.forall("at", lambda b: F.getbit(byte(b), (b % 8).cast("int")) == 1)
        wanted = asked.select("bucket", "page").distinct()
        bits = pages.join(wanted, ["bucket", "page"], "left_semi").groupBy("bucket", "page").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        maybe = asked.join(bits, ["bucket", "page"]).where(on).select("id", "bucket")
        hit = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # at most as many as there are buckets
        self.read_buckets.append(len(hit))
        seen = self._before("ids", ids, batch_id, hit).select("id").join(maybe.select("id"), "id", "left_semi").distinct() if hit else None
        new = firsts.join(seen.withColumnRenamed("id", "_id"), "_id", "left_anti") if hit else firsts
        new.drop("_bucket", "_id").write.mode("overwrite").parquet(f"{self.base}/accepted/n={batch_id}")
        accepted = new.select(*places)
        pages = self._bits(accepted).groupBy("bucket", "page").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
        self._write(pages, "filter", batch_id, self._slot(batch_id))
        self._write(accepted, "ids", batch_id, self._slot(batch_id))

    def _merged(self, kind: str, schema: str, batch_id: int) -> DataFrame:
        """All rows of the slot that ends with the batch before."""
        return self.spark.read.schema(f"{schema}, batch LONG, bucket INT").parquet(f"{self.base}/{kind}/slot={self._slot(batch_id - 1)}").where(F.col("batch") < batch_id)

    def accepted(self, schema) -> DataFrame:
        """First rows of all ids so far, one folder per batch."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.base}/accepted")


def refresh_stream(events: DataFrame) -> DataFrame:
    """Only events that may change a view (same rule as the batch gate)."""
    return events.where(F.col("event_type").isin(*K.REFRESH_KINDS) & (F.coalesce("event_id", F.lit("")) != ""))


def unique_stream(events: DataFrame, key: str, event_time: str, delay: str = "1 day") -> DataFrame:
    """First occurrence per id within ``delay`` of event time, in the state of the stream alone; ``UniqueIds`` is exact
    against all history."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def running_usage(usage: DataFrame) -> DataFrame:
    """Totals per category and source, updated as observations arrive; invalid rows and unknown counts stay out."""
    return usage.where(usage_problem().isNull()).groupBy("activity_category", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("total_tokens"))


class ChainState(StatefulProcessor):
    """Online check per run: sequence, from_state and transition against the event before, in whatever order events arrive.

    Events that arrive before their predecessor wait in the state.  If ``patience`` is set and the predecessor has not come
    when that much processing time is over, the earliest waiting event is reported as a break of the sequence and the check
    goes on from it.  Events whose number was passed already are reported as "late".
    """

    def __init__(self, transitions: list[tuple[str, str]], patience_ms: int | None):
        self.legal, self.patience = set(transitions), patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sequence long, state string")
        self.waiting = handle.getMapState("waiting", "sequence long", "from_state string, to_state string")

    def _advance(self, run: str, sequence: int, current: str | None, out: list, fresh: dict, stored: bool) -> tuple[int, str | None]:
        """Check events as long as the next number is there, in ``fresh`` or, if ``stored``, among those that wait."""
        while True:
            event = fresh.pop(sequence + 1, None)
            if event is None and stored and (event := self.waiting.getValue((sequence + 1,))) is not None:
                self.waiting.removeKey((sequence + 1,))
            if event is None:
                return sequence, current
            start, to = event
            problem = "from_state" if start != current else "transition" if (current or "", to) not in self.legal else None
            if problem:
                out.append((run, sequence + 1, problem))
            sequence, current = sequence + 1, to

    def _timers(self, now: int) -> None:
        """One timer while something waits, none else."""
        set_ = list(self.handle.listTimers())
        empty = next(iter(self.waiting.keys()), None) is None
        if empty:
            for t in set_:
                self.handle.deleteTimer(t)
        elif not set_:
            self.handle.registerTimer(now + self.patience)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, out = key[0], []
        sequence, current = self.last.get() if self.last.exists() else (0, None)
        stored = self.waiting.exists()
        for part in rows:  # one batch of rows at a time; only events that wait on go to the state, where each call is a round trip
            fresh: dict[int, tuple] = {}
            for r in part.itertuples(index=False):
                n = int(r.sequence)
                if n <= sequence or n in fresh or stored and self.waiting.containsKey((n,)):
                    out.append((run, n, "late"))
                else:
                    fresh[n] = (None if pd.isna(r.from_state) else r.from_state, r.to_state)
            sequence, current = self._advance(run, sequence, current, out, fresh, stored)
            for n, event in fresh.items():
                self.waiting.updateValue((n,), event)
            stored = stored or bool(fresh)
        self.last.update((sequence, current))
        if self.patience is not None:
            self._timers(timerValues.getCurrentProcessingTimeInMs())
        if out:
            yield pd.DataFrame(out, columns=["run_id", "sequence", "problem"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run, out = key[0], []
        sequence, current = self.last.get() if self.last.exists() else (0, None)
        first = min((k[0] for k in self.waiting.keys()), default=None)
        if first is not None:
            out.append((run, int(first), "sequence"))
            _, to = self.waiting.getValue((first,))
            self.waiting.removeKey((first,))
            sequence, current = self._advance(run, int(first), to, out, {}, True)
            self.last.update((sequence, current))
        if next(iter(self.waiting.keys()), None) is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield pd.DataFrame(out, columns=["run_id", "sequence", "problem"])

    def close(self) -> None:
        pass


def check_transitions_stream(events: DataFrame, transitions: list[tuple[str, str]], patience_ms: int | None = None) -> DataFrame:
    """(run_id, sequence, problem) of runtime events; needs the RocksDB state store.

    ``patience_ms`` is for streams that run on; a run over what is there (``run_available``) has no later time to wait for.
    """
    return events.groupBy("run_id").transformWithStateInPandas(
        ChainState(transitions, patience_ms), "run_id string, sequence long, problem string", "append", "none" if patience_ms is None else "processingTime")


class QuietFile(StatefulProcessor):
    """One notice per changed file once it has been quiet for a while.

    The state keeps the size, time and hash that were last announced and the newest ones seen.  Each change moves the timer;
    when it fires, the newest are announced if they differ from those announced before.
    """

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "size long, modified long, sha256 string")
        self.seen = handle.getValueState("seen", "size long, modified long, sha256 string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.seen.get() if self.seen.exists() else None
        before = newest
        for part in rows:
            for r in part.itertuples(index=False):
                if newest is None or int(r.modified) >= newest[1]:
                    newest = (int(r.size), int(r.modified), r.sha256)
        if newest is not None and newest != before:
            self.seen.update(newest)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        yield pd.DataFrame([], columns=["path", "size", "modified", "sha256"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, told = self.seen.get(), self.told.get() if self.told.exists() else None
        out = []
        if told is None or newest[2] != told[2] or newest[0] != told[0]:
            self.told.update(newest)
            out.append((key[0], *newest))
        yield pd.DataFrame(out, columns=["path", "size", "modified", "sha256"])

    def close(self) -> None:
        pass


def quiet_changes(listings: DataFrame, quiet_ms: int = 5_000) -> DataFrame:
    """(path, size, modified, sha256) of files that changed and then stayed as they are for ``quiet_ms``.

    ``listings`` is a stream of what a folder holds, as often as it is looked at; unchanged files are no news.  A file
    touched several times within the quiet period is announced once, one touched without a change of content not at all.
    """
    return listings.select("path", "size", "modified", "sha256").groupBy("path").transformWithStateInPandas(
        QuietFile(quiet_ms), "path string, size long, modified long, sha256 string", "append", "processingTime")
