"""Embeddings and exact vector search.

Query blocks are small and checked; the corpus is streamed through Arrow batches,
scored by one matrix product per batch, and cut to k rows per query inside the
batch, so the shuffle carries at most k rows per query and batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import constants as K
from ledgerlens import scale
from ledgerlens.functions import text as X

QUERY_BLOCK = 2048
CORPUS_BLOCK = 8192
SCAN_ROWS = 4096
WORD_SLICE = 50_000
ADDED_AT_ONCE = 4096  # vectors that a processor's own memory holds
ROWS_AT_ONCE = 512
KEPT_WORDS = 200_000


# --- embedding ---------------------------------------------------------------
# Embedding is a map over rows: no shuffle.  Documents are taken a few at a time, so memory follows neither the size of an
# Arrow batch nor that of the table; each distinct word of them is hashed once, vectors of words are kept while there is room.


@dataclass(frozen=True)
class _Digest:
    """Bytes that decide a feature: four of the bucket, in the given order, and one of the sign."""

    of: Callable[[bytes], bytes]
    order: str

    def slots(self, features: Iterable[str], dims: int) -> np.ndarray:
        """Bucket, doubled, plus 1 where the sign is positive."""
        raw = [self.of(f.encode()) for f in features]
        table = np.frombuffer(b"".join(raw), dtype="u1").reshape(len(raw), -1)
        bucket = np.ascontiguousarray(table[:, :4]).view(self.order).ravel() % dims
        return bucket.astype(np.int64) * 2 + (table[:, 4] & 1)

    def __call__(self, feature: str) -> tuple[int, int]:
        raw = np.frombuffer(self.of(feature.encode()), dtype="u1")
        return int(raw[:4].view(self.order)[0]), int(raw[4])


_md5 = _Digest(lambda feature: hashlib.md5(feature).digest(), ">u4")
_blake2b = _Digest(lambda feature: hashlib.blake2b(feature, digest_size=8).digest(), "<u4")


class _WordVectors:
    """Vectors of words: signed buckets of ``token:word`` and of the trigrams of ``^word$``.  Words and trigrams are hashed when
    first met; at most about ``KEPT_WORDS`` of each are kept."""

    def __init__(self, dims: int, digest: _Digest) -> None:
        self.dims, self.digest = dims, digest
        self.place: dict[str, int] = {}
        self.trigrams, self.slots = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # sorted, and the slot of each
        self.table = np.zeros((1024, dims), dtype="int32")

    def _trigram_slots(self, codes: np.ndarray) -> np.ndarray:
        """Slots of trigrams, given as three code points of 21 bits in a whole number."""
        some, back = np.unique(codes, return_inverse=True)
        if len(self.trigrams) > KEPT_WORDS:
            self.trigrams, self.slots = self.trigrams[:0], self.slots[:0]
        new = np.setdiff1d(some, self.trigrams, assume_unique=True)
        if len(new):
            letters = (np.stack([new >> 42, new >> 21, new], axis=1) & (1 << 21) - 1).astype("<u4").tobytes().decode("utf-32-le")
            slots = self.digest.slots(("trigram:" + letters[i:i + 3].rstrip("\0") for i in range(0, len(letters), 3)), self.dims)
            known = np.concatenate([self.trigrams, new])
            order = np.argsort(known)
            self.trigrams, self.slots = known[order], np.concatenate([self.slots, slots])[order]
        return self.slots[np.searchsorted(self.trigrams, some)][back]

    def _hashed(self, words: list[str]) -> np.ndarray:
        """Vectors of ``words``.  Their trigrams are read from one run of letters (a NUL fills that of the empty word), each distinct
        one is hashed once."""
        letters = np.frombuffer("".join(f"^{w}$" if w else "^$\0" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        sizes = np.maximum(1, np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(owner)) + 2 * owner  # of the first letter of each trigram; a word has two letters more than trigrams
        trigrams = self._trigram_slots(letters[at] << 42 | letters[at + 1] << 21 | letters[at + 2])
        slots = np.concatenate([self.digest.slots((f"token:{w}" for w in words), self.dims), trigrams])
        cells = np.concatenate([np.arange(len(words)), owner]) * self.dims + slots // 2
        return np.bincount(cells, slots % 2 * 2 - 1, len(words) * self.dims).astype("int32").reshape(-1, self.dims)

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of ``table`` that hold the vectors of the distinct ``words``; valid until the next call."""
        if len(self.place) > KEPT_WORDS:
            self.place.clear()
        new = [w for w in words if w not in self.place]
        if new:
            start, end = len(self.place), len(self.place) + len(new)
            if end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((end, self.dims), dtype="int32")])
            self.table[start:end] = self._hashed(new)
            self.place.update(zip(new, range(start, end)))
        return np.fromiter(map(self.place.__getitem__, words), dtype="int64", count=len(words))


def _unit_sums(lists: pa.ListArray, known: _WordVectors) -> pa.ListArray:
    """Unit vectors of lists of words; null where nothing is left after cancellation."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    sums = np.zeros((len(sizes), known.dims))
    owner, flat = np.repeat(np.arange(len(sizes)), sizes), lists.flatten()
    for at in range(0, len(flat), WORD_SLICE):
        words, own = flat.slice(at, WORD_SLICE).dictionary_encode(), owner[at:at + WORD_SLICE]
        rows = known.rows(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        for low in range(0, len(rows), ADDED_AT_ONCE):
            part = own[low:low + ADDED_AT_ONCE]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sums[part[starts]] += np.add.reduceat(known.table[rows[low:low + ADDED_AT_ONCE]], starts)
    norms = np.sqrt((sums * sums).sum(axis=1))
    units = np.divide(sums, norms[:, None], out=sums, where=norms[:, None] > 0)
    ends = np.arange(len(sizes) + 1, dtype=np.int32) * known.dims
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(units.ravel()), mask=pa.array(norms == 0))


def _embedded(rows: DataFrame, words_of: Callable[[pa.Array], pa.ListArray], dims: int, digest: _Digest) -> DataFrame:
    """(doc_id, vector) of ``rows`` (doc_id, body)."""
    schema = T.StructType([rows.schema["doc_id"], T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordVectors(dims, digest)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _unit_sums(words_of(part.column("body")), known)], ["doc_id", "vector"])

    return rows.mapInArrow(run, schema).where("vector IS NOT NULL")


def embed_hash(docs: DataFrame, doc_id: str, text: str, dims: int = 256) -> DataFrame:
    """(doc_id, vector): signed-hash embedding with md5 digests over lower-cased words; word-free texts are left out."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(K.WORD_PATTERN), F.lit(0))
    return _embedded(docs.select(F.col(doc_id).alias("doc_id"), words.alias("body")), lambda lists: lists, dims, _md5)


def embed_blake2b(docs: DataFrame, doc_id: str, text: str, dims: int = 256) -> DataFrame:
    """The same embedding with 8-byte blake2b digests over case-folded words, which Spark has no functions for."""

    def words_of(texts: pa.Array) -> pa.ListArray:
        return pa.array([re.findall(r"[^\W_]+", t.casefold()) if t is not None else None for t in texts.to_pylist()], pa.list_(pa.string()))

    return _embedded(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")), words_of, dims, _blake2b)


def embed_with(docs: DataFrame, doc_id: str, text: str, fn: Callable[[list[str]], Sequence[Sequence[float]]],
               dims: int, batch: int = 256) -> DataFrame:
    """User embedder in batches; wrong count, width or non-finite values fail the task."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list[list[float]] = []
            for i in range(0, len(s), batch):
                chunk = s.iloc[i:i + batch].tolist()
                m = np.asarray(fn(chunk), dtype="float64")
                if m.shape != (len(chunk), dims) or not np.isfinite(m).all():
                    raise ValueError("embedder returned a wrong shape or non-finite values")
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                if (norm == 0).any():
                    raise ValueError("embedder returned a zero vector")
                out.extend((m / norm).tolist())
            yield pd.Series(out)

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("vector"))


def normalize_vector(col: str, dims: int | None = None) -> Column:
    """Prefix of ``dims`` values scaled to unit length; null for zero or non-finite vectors."""
    v = F.col(col) if dims is None else F.slice(F.col(col), 1, dims)
    top = lambda u: F.aggregate(u, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    length = lambda u: F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x * x))
    divided = lambda u, by: X.bind(by, lambda d: F.transform(u, lambda x: x / d))
    bad = lambda u: F.exists(u, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) | (top(u) == 0)
    unit = lambda u: X.bind(divided(u, top(u)), lambda s: divided(s, length(s)))
    return X.bind(F.transform(v, lambda x: x.cast("double")), lambda u: F.when(~bad(u), unit(u)))


def vector_quality(df: DataFrame, vector: str, dims: int, tolerance: float = 1e-5) -> DataFrame:
    """Adds width_ok, finite, nonzero, unit per row."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sq = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.withColumns({
        "width_ok": F.size(vector) == dims, "finite": finite, "nonzero": sq > 0,
        "unit": F.abs(F.sqrt(sq) - 1) <= tolerance,
    })


# --- exact search ----------------------------------------------------------------
def _best(qids, scores: np.ndarray, block: pd.DataFrame, keep: list[str], k: int, group: str, floor: np.ndarray | None = None) -> pd.DataFrame:
    """Best row per (query, group) of the groups that reach the k-th best group of the query in this block (ties too), where
    that is above ``floor``, the k-th best before; ``floor`` is raised."""
    code, names = pd.factorize(block[group], use_na_sentinel=False)
    values, scores = scores, np.where(np.isnan(scores), np.inf, scores)  # as in SQL, not-a-number is above every number
    order = np.argsort(code, kind="stable")
    top = np.maximum.reduceat(scores[order], np.searchsorted(code[order], np.arange(len(names))), axis=0)
    least = np.partition(top, -k, axis=0)[-k] if len(top) > k else np.full(len(qids), -np.inf)
    if floor is not None:
        least = floor[:] = np.maximum(floor, least)
    # rows that hold the best score of a group that may be among the k best
    row, query = np.nonzero((scores >= least) & (scores == top[code]))
    part = block[[*keep, group]].iloc[row].copy()
    part["qid"], part["score"], part["_q"] = np.asarray(qids)[query], values[row, query], query
    return part.sort_values(keep).drop_duplicates(["_q", group]).drop(columns="_q") if keep else part.drop_duplicates(["_q", group]).drop(columns="_q")


def _matrix(s: pd.Series) -> np.ndarray:
    return np.vstack(s.to_numpy()).astype("float64")


def topk_cosine(queries: DataFrame, corpus: DataFrame, k: int, group: str, keep: Sequence[str] = (),
                query_limit: int = QUERY_BLOCK) -> DataFrame:
    """Exact top-k groups per query by best dot product of unit vectors.

    queries: (qid, vector); corpus: ``group``, ``keep`` columns, vector.  Equal scores inside
    a group go to the smallest ``keep`` values, between groups to the smallest group.
    Returns (qid, group, keep.., score, rank).
    Up to ``query_limit`` queries (checked) travel with the task; beyond it the
    product is tiled: query blocks x corpus blocks, each tile one bounded cogroup.
    """
    keep = list(keep)
    slim = corpus.select(group, *keep, "vector")
    schema = T.StructType(
        [queries.schema["qid"], slim.schema[group], *[slim.schema[c] for c in keep], T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def score_block(qids, qm: np.ndarray, block: pd.DataFrame, floor: np.ndarray | None = None) -> pd.DataFrame:
        scores = np.round(_matrix(block["vector"]) @ qm.T, 6)
        return _best(qids, scores, block, keep, k, group, floor)[names]

    q = queries.select("qid", "vector")
    if scale.fits(q, query_limit):
        rows = q.collect()
        qids = [r["qid"] for r in rows]
        qm = np.array([r["vector"] for r in rows], dtype="float64")

        def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            floor = np.full(len(qids), -np.inf)  # the k-th best group of each query in a block of this task
            for part in parts:
                for at in range(0, len(part) if len(qids) else 0, SCAN_ROWS):
                    yield score_block(qids, qm, part.iloc[at:at + SCAN_ROWS], floor)

        partial = slim.mapInPandas(scan, schema)
    else:
        slim = slim.dropDuplicates()
        n_q = max(1, -(-q.count() // query_limit))
        n_c = max(1, -(-slim.count() // CORPUS_BLOCK))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        tile_of = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
        qb = q.withColumn("_q", tile_of(n_q, "qid")).withColumn("_c", every(n_c))
        cb = slim.withColumn("_c", tile_of(n_c, group, *keep, "vector")).withColumn("_q", every(n_q))

        def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({n: [] for n in names})
            return score_block(a["qid"].to_numpy(), _matrix(a["vector"]), b)

        partial = qb.groupBy("_q", "_c").cogroup(cb.groupBy("_q", "_c")).applyInPandas(tile, schema)
    best = scale.first_per_key(partial, ["qid", group], [F.desc("score"), *[F.asc(c) for c in keep]])
    return scale.top_per_key(best, ["qid"], [F.desc("score"), F.asc(group)], k)
