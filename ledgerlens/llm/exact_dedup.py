"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.order import packed
from ledgerlens.session import written

WHITE = r"[\x20\x09-\x0D]"
BITS_PER_ROW = 16
MAX_FILTER_BITS = 2**30  # 128 MB broadcast at most; more rows are worked through in segments of the hash range
BITMAP = 32_768  # bits in one bitmap of Spark's bitmap functions


def normal_hash(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text without white space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", "").cast("binary"), 256))


class RepeatFilter:
    """A Bloom filter of the hashes that may occur more than once.

    Pass one counts, for two positions of every hash, how many rows meet there; a position with two rows or more is a set
    bit.  A row whose two bits are set may be repeated; any other row is certainly the only one of its hash.  A filter is
    bounded by ``max_bits``; beyond ``max_bits / BITS_PER_ROW`` rows the hash range is cut into segments with a filter each.
    """

    def __init__(self, hashes: DataFrame, column: str, max_bits: int = MAX_FILTER_BITS) -> None:
        n = hashes.count()
        wanted = max(BITMAP, 2 ** math.ceil(math.log2(max(1, n * BITS_PER_ROW))))
        self.bits = min(wanted, max_bits)
        self.segments = wanted // self.bits
        self.max_bits = max_bits
        self.bitmaps = written(self._build(hashes.select(F.col(column).alias("h"))), "repeat-filter")

    def segment(self, h: Column) -> Column:
        return F.pmod(F.xxhash64(h, F.lit(3)), F.lit(self.segments))

    def _positions(self, h: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(self.bits)) for i in (1, 2)]

    def _build(self, hashes: DataFrame) -> DataFrame:
        at = hashes.select(self.segment(F.col("h")).alias("segment"), F.explode(F.array(*self._positions(F.col("h")))).alias("at"))
        repeated = at.groupBy("segment", "at").count().where("count > 1")
        return repeated.groupBy("segment", F.expr(f"at div {BITMAP}").alias("bucket")).agg(
            F.expr(f"bitmap_construct_agg(at % {BITMAP})").alias("bits"))

    def split(self, rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """``rows`` in two: certainly single, and possibly repeated.  Nothing is shuffled."""
        singles, maybe = [], []
        for s in range(self.segments):
            here = rows if self.segments == 1 else rows.where(self.segment(F.col(column)) == s)
            bitmaps = self.bitmaps.where(F.col("segment") == s)
            marked, tests = here, []
            for i, at in enumerate(self._positions(F.col(column))):
                side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_b{i}"), F.col("bits").alias(f"_m{i}")))  # bits / 8 bytes at most
                marked = marked.withColumn(f"_at{i}", at)
                marked = marked.join(side, F.expr(f"_at{i} div {BITMAP}") == F.col(f"_b{i}"), "left")
                byte = F.expr(f"conv(hex(substring(_m{i}, cast(_at{i} % {BITMAP} div 8 as int) + 1, 1)), 16, 10)").cast("int")
                tests.append(F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(_at{i} % 8 as int))")) != 0, F.lit(False)))
            marked = marked.withColumn("_maybe", tests[0] & tests[1]).select(*rows.columns, "_maybe")
            singles.append(marked.where("NOT _maybe").drop("_maybe"))
            maybe.append(marked.where("_maybe").drop("_maybe"))
        for parts in (singles, maybe):
            while len(parts) > 1:
                parts.append(parts.pop(0).unionByName(parts.pop(0)))
        return singles[0], maybe[0]


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per document with its group of equal texts.

    Columns: ``doc_id``, ``keep_id`` (row that stays: most code points in the original text, then smallest id, null ids
    last), ``group_size``, ``kept``, ``text_sha256``.  Texts are equal when identical without white space; null counts as
    empty, so null, empty and blank texts form one group.  If the row that stays occurs several times (same id, equal
    length), one occurrence is kept.  An empty table gives no rows; other columns are ignored.  The texts are read once;
    only (hash, length, id) of possibly repeated rows is shuffled, combined before the shuffle.
    """
    narrow = written(docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.char_length(f"`{text_col}`"), F.lit(0)).alias("n_points"),
        normal_hash(F.col(f"`{text_col}`")).alias("h"), F.monotonically_increasing_id().alias("rid")), "dedup-hashes")
    singles, maybe = RepeatFilter(narrow, "h", max_bits).split(narrow, "h")
    # bitwise not turns the order of ids round without overflow
    best = maybe.groupBy("h").agg(
        F.count("*").alias("group_size"),
        F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("rid").alias("rid"))).alias("best"))
    grouped = maybe.join(best, "h").select(
        "doc_id", F.bitwise_not("best.id").alias("keep_id"), "group_size", (F.col("rid") == F.bitwise_not("best.rid")).alias("kept"), "h")
    alone = singles.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "h")
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("h")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, whole (see duplicate_groups).

    Rows that are certainly single pass straight through with their texts; of the possibly repeated rows each task sends
    the best row per text only.
    """
    hashed = docs.select(packed(docs), normal_hash(F.col(f"`{text_col}`")).alias("h"))
    singles, maybe = RepeatFilter(hashed, "h", max_bits).split(hashed, "h")
    w = Window.partitionBy("h").orderBy(
        F.coalesce(F.char_length(f"row.`{text_col}`"), F.lit(0)).desc(), F.col(f"row.`{id_col}`").asc_nulls_last())
    first = maybe.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return singles.unionByName(first).select("row.*")


def op7_exact_dedup(documents: DataFrame) -> DataFrame:
    return duplicate_groups(documents)


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
"""
