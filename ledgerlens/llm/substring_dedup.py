"""Removal of long word sequences that another document has, by level-wise doubling."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bytetext import U, pieces, sliding_min, window_hashes, window_starts, word_hashes, words
from ledgerlens.session import written

LENGTH = 50
SHORTEST = 20
BITS_PER_HASH, PROBES = 64, 3
MAX_FILTER_BITS = 2**28  # 32 MB at most for a task; a fuller filter lets more windows through, never fewer
BITMAP = 32_768
NO_ID = 2**63 - 1  # a null id comes after every other


def levels(length: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths from the first level up, each half of the next (rounded up)."""
    found = [length]
    while (found[0] + 1) // 2 >= shortest:
        found.insert(0, (found[0] + 1) // 2)
    return found


class Filter:
    """Bloom filter of the window hashes of a level that occur in two documents or more."""

    def __init__(self, size: int, bits: np.ndarray) -> None:
        self.size, self.bits, self.mask = size, bits, U(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for k in range(PROBES):
            at = (hashes >> U(16 * k)) & self.mask
            found &= (self.bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
        return found


def _least(hashes: np.ndarray, length: int, size: int) -> tuple[np.ndarray, int]:
    """Least hash of the ``size``-word windows in one half of a ``length``-word window, by the first of them; and how many
    words further those of the other half begin."""
    inside = length - size + 1
    half = (inside + 1) // 2
    return sliding_min(window_hashes(hashes, size), half), inside - half


def _surviving(data, offsets, length, filters):
    """Hashes of the words, their bounds by text, and whether the window of ``length`` words from each word on may be repeated.

    At each level a window survives if in both its halves the shorter window of the least hash is repeated.  That choice
    depends on its words alone, so it is the same in every document that has the window.
    """
    starts, ends, bounds = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    alive = window_starts(bounds, length)
    for f in filters:
        if alive.any():
            least, further = _least(hashes, length, f.size)
            at = np.flatnonzero(alive)
            known = f.has(least)
            alive[at] = known[at] & known[at + further]
    return starts, ends, bounds, hashes, alive


def _level_hashes(rows: DataFrame, length: int, size: int, filters) -> DataFrame:
    """(h, id) of the ``size``-word windows that decide on surviving ``length``-word windows, runs of equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for first, _, data, offsets in pieces(batch.column("text")):
                _, _, bounds, hashes, alive = _surviving(data, offsets, length, [f.value for f in filters])
                at = np.flatnonzero(alive)
                if not len(at):
                    continue
                least, further = _least(hashes, length, size)
                used = np.zeros(len(least), bool)
                used[at] = used[at + further] = True
                at = np.flatnonzero(used)
                least, text = least[at], np.searchsorted(bounds, at, "right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[new].view(np.int64)), pa.array(ids[first + text[new]])], ["h", "id"])

    return rows.select("id", "text").mapInArrow(run, "h bigint, id bigint")


def _repeated(hashed: DataFrame) -> DataFrame:
    """Hashes of two documents or more with the smallest id; combined before the shuffle, so a hot hash is one row per task."""
    return hashed.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h", "least")


def _filter(repeated: DataFrame, size: int, max_bits: int) -> Filter | None:
    """The level's filter; at most ``max_bits`` bits reach the driver, whatever the number of hashes.  None: nothing is repeated."""
    repeated = written(repeated.select("h"), "repeat-hashes")
    n = repeated.count()
    if not n:
        return None
    bits = min(max_bits, max(BITMAP, 2 ** math.ceil(math.log2(n * BITS_PER_HASH))))
    probes = [F.shiftrightunsigned("h", 16 * k).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)]  # as Filter.has
    at = repeated.select(F.explode(F.array(*probes)).alias("at"))
    maps = at.groupBy(F.expr(f"at div {BITMAP}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(at % {BITMAP})").alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for bucket, part in maps.toLocalIterator():
        table[bucket * BITMAP // 8 : (bucket + 1) * BITMAP // 8] = np.frombuffer(part, np.uint8)
    return Filter(size, table)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    raw = data.tobytes()
    return b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])


_WINDOWS = "rid bigint, doc_id bigint, n_words bigint, kept_sha256 string, text string, at array<int>, h array<bigint>"


def _windows(rows: DataFrame, length: int, filters) -> DataFrame:
    """Per document the windows that may be repeated: places and hashes; the text stays with those that have some, the
    others are done and have their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for first, end, data, offsets in pieces(texts):
                starts, ends, bounds, hashes, alive = _surviving(data, offsets, length, [f.value for f in filters])
                at = np.flatnonzero(alive)
                h = window_hashes(hashes, length)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
                cut = np.searchsorted(at, bounds).astype(np.int32)
                some = np.diff(cut) > 0
                digests = [
                    None if some[i] else hashlib.sha256(b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split())).hexdigest() for i in range(end - first)]
                place = (at - np.repeat(bounds[:-1], np.diff(cut))).astype(np.int32)
                kept = pa.array([texts[first + i].as_py() if some[i] else None for i in range(end - first)], pa.string())
                yield pa.RecordBatch.from_arrays([
                    batch.column("rid").slice(first, end - first), batch.column("doc_id").slice(first, end - first),
                    pa.array(np.diff(bounds).astype(np.int64)), pa.array(digests, pa.string()), kept,
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(place)), pa.ListArray.from_arrays(pa.array(cut), pa.array(h)),
                ], ["rid", "doc_id", "n_words", "kept_sha256", "text", "at", "h"])

    return rows.select("rid", "doc_id", "text").mapInArrow(run, _WINDOWS)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, max_bits: int = MAX_FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Places of repeated windows.

    A window of ``length`` words of a document is repeated if its word sequence also starts in a document of a smaller id;
    windows are judged on the input.  Level by level, from half-length windows up to ``length``, only windows that may be
    repeated at one length are tried at twice that length; each level gathers the hashes (64 bits) of its surviving windows
    from all documents and hands the repeated ones to the next as a filter.  If nothing survives a level the rest is skipped.
    The last level groups the hashes of whole windows exactly.

    Returns two frames: documents without any candidate (rid, doc_id, n_words, kept_sha256), and candidates (rid, doc_id,
    text, n_words, starts: array of the words at which a repeated window starts, maybe empty or null).  Null text has no words.
    A null id is larger than every other; rows of one id are not smaller than each other, so they keep what only they share.
    Texts shorter than ``length`` words have no window.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(f"`{text_col}`").alias("text"))
    filters = []
    for size in levels(length)[:-1]:
        found = _filter(_repeated(_level_hashes(rows, length, size, filters)), size, max_bits)
        found = found or Filter(size, np.zeros(BITMAP // 8, np.uint8))
        filters.append(spark.sparkContext.broadcast(found))
        if not found.bits.any():
            break
    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    table = written(_windows(numbered, length, filters), "repeat-windows")
    maybe = table.where("kept_sha256 IS NULL")
    id_or_last = F.coalesce("doc_id", F.lit(NO_ID))
    windows = maybe.select("rid", id_or_last.alias("id"), F.explode(F.arrays_zip("at", "h")).alias("w")).select("rid", "id", "w.at", "w.h")
    hits = windows.join(_repeated(windows), "h").where("id > least").groupBy("rid").agg(F.collect_list("at").alias("starts"))
    return table.where("kept_sha256 IS NOT NULL").drop("text", "at", "h"), maybe.drop("at", "h", "kept_sha256").join(hits, "rid", "left")


def _kept_text(texts: pa.Array, starts: pa.Array, length: pa.Array) -> pa.Array:
    removed, kept = [], []
    size = length[0].as_py() if len(length) else 0
    for i, (_, _, data, offsets) in enumerate(p for k in range(len(texts)) for p in pieces(texts.slice(k, 1))):
        first, last, bounds = words(data, offsets)
        gone = np.zeros(len(first) + 1, np.int64)
        if starts[i].is_valid:
            at = np.array(starts[i].as_py(), np.int64)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + size, -1)
        stays = np.cumsum(gone[:-1]) == 0
        removed.append(int((~stays).sum()))
        kept.append(_joined(data, first[stays], last[stays]).decode())
    return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["n_removed", "kept"])


def remove_repeats(candidates: DataFrame, length: int = LENGTH) -> DataFrame:
    """Second frame of ``repeats`` with ``n_removed`` and ``kept``: the words under no repeated window, joined by one space."""
    kept_text = F.arrow_udf(_kept_text, "struct<n_removed:bigint,kept:string>")
    return candidates.withColumn("_k", kept_text("text", "starts", F.lit(length))).drop("text", "starts").select("*", "_k.*").drop("_k")


def op9_substring_dedup(documents: DataFrame) -> DataFrame:
    done, candidates = repeats(documents)
    cleaned = remove_repeats(candidates).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    return done.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").unionByName(cleaned)


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i AS pos, array_to_string(ws[i:i + 49], ' ') AS seq
  FROM w, unnest(range(1, len(ws) - 48)) AS u (i) WHERE len(ws) >= 50),
firsts AS (SELECT seq, min(doc_id) AS least FROM win GROUP BY seq HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, list(pos) AS hits FROM win JOIN firsts USING (seq) WHERE doc_id > least GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, h + o AS k FROM hit, unnest(hits) AS u (h), range(50) AS r (o)),
word AS (SELECT doc_id, k, ws[k] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u (k)),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.k) AS kept, count(*) AS n
  FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
