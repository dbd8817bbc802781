"""Keyed views on shared storage that a stream rewrites bucket by bucket.

A view is cut into hash buckets of its key.  Every bucket has two slots, ``slot=0`` and ``slot=1``; a commit writes the
changed buckets into the slot that is not live and then names the live slots in a small table, which itself has two places
(even and odd commits).  Nothing that a reader of the last commit uses is touched, a broken write leaves the last commit
as it was, and there are never more than two folders per bucket, whatever number of batches ran.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMIT = "_commit"  # column of every stored row: the commit that wrote it
COMMIT_DDL = "commit LONG, batch LONG, view STRING, bucket INT, slot INT, n LONG"


@dataclass(frozen=True)
class State:
    """The last commit: its number, its batch, and the live slot of every bucket that has rows."""

    commit: int
    batch: int
    live: dict[tuple[str, int], int]
    counts: dict[tuple[str, int], int]


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    base: str
    buckets: int

    def bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def state(self) -> State:
        """At most one row per view and bucket reaches the driver."""
        rows = []
        for place in (0, 1):
            try:
                rows += self.spark.read.schema(COMMIT_DDL).parquet(f"{self.base}/commits/p{place}").collect()
            except Exception as exc:
                if "PATH_NOT_FOUND" not in str(exc):
                    raise
        last = max((r.commit for r in rows), default=-1)
        mine = [r for r in rows if r.commit == last]
        return State(
            last, max((r.batch for r in mine), default=-1), {(r.view, r.bucket): r.slot for r in mine if r.n},
            {(r.view, r.bucket): r.n for r in mine if r.n})

    def folders(self, view: str, state: State, only: Sequence[int] | None = None) -> list[str]:
        return [f"{self.base}/{view}/slot={s}/bucket={b}" for (v, b), s in state.live.items() if v == view and (only is None or b in only)]

    def read(self, view: str, schema: StructType | str, state: State | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """Rows of a view as of a commit, of all buckets or of some; an absent view is empty."""
        folders = self.folders(view, state or self.state(), only)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, state: State, batch: int, views: dict[str, tuple[DataFrame, str]], touched: Sequence[int]) -> State:
        """Make ``views`` (name -> rows of the touched buckets, key column) the content of the touched buckets."""
        live, counts = dict(state.live), dict(state.counts)
        for view, (rows, key) in views.items():
            slots = {b: 1 - state.live.get((view, b), 1) for b in touched}
            slot = F.element_at(F.create_map(*[F.lit(x).cast("int") for pair in slots.items() for x in pair]), F.col("bucket"))
            placed = rows.withColumn("bucket", self.bucket(key)).withColumn("slot", slot).withColumn(COMMIT, F.lit(state.commit + 1).cast("long"))
            placed.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "slot", "bucket").parquet(f"{self.base}/{view}")
            # a bucket without rows leaves older ones in its slot
            found = self.spark.read.schema(f"{COMMIT} LONG, slot INT, bucket INT").parquet(f"{self.base}/{view}").where(
                F.col("bucket").isin(list(touched)) & (F.col(COMMIT) == state.commit + 1)).groupBy("bucket").count()
            n = {r["bucket"]: r["count"] for r in found.collect()}  # touched buckets only
            for b, s in slots.items():
                live[view, b], counts[view, b] = s, n.get(b, 0)
        rows = [(state.commit + 1, batch, v, b, live[v, b], counts[v, b]) for v, b in live if counts.get((v, b))] or [(state.commit + 1, batch, "", 0, 0, 0)]
        self.spark.createDataFrame(rows, COMMIT_DDL).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/commits/p{(state.commit + 1) % 2}")
        return self.state()
