"""Exact top-k inner-product search with MaxScore over blocks of vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import written

K = 20
SCALE = 64
NARROW = 2**20  # rows with smaller components are searched in doubles, exactly; the others in whole numbers of any size
QUERY_GROUP, BLOCK, CHUNK_BLOCKS = 4096, 2048, 4  # sizes of the tiles of work; results do not depend on them
STEP = 8  # terms probed between two looks at which rows are still competitive
LAST = 2**63 - 1


def _cut(values: np.ndarray) -> np.ndarray:
    """Whole numbers of any size as longs; those beyond become the largest or smallest."""
    return np.array([max(-LAST, min(LAST, int(x))) for x in values], np.int64)


class Block:
    """Postings of a block of rows: one column of impacts per term (dimension), and the least and largest of each."""

    def __init__(self, ids: np.ndarray, rids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rids, self.rows = ids, rids, rows
        self.wide = rows.dtype != np.int32
        self.terms = np.ascontiguousarray(rows.T, dtype=np.float64)  # whole numbers below 2^53: exact
        self.low, self.high = self.terms.min(1), self.terms.max(1)

    def search_wide(self, query: np.ndarray, own: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The same, for numbers that doubles do not hold: all rows, in whole numbers of any size."""
        rows = np.flatnonzero(self.rids != own)
        score = _cut(self.rows[rows].astype(object) @ query.astype(object))
        stay = score >= floor
        return rows[stay], score[stay]

    def search(self, query: np.ndarray, own: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may score ``floor`` or more, and their scores; certainly all of them.

        The impact of a term on a row, less the least in the block, is between 0 and |q| * range.  Terms are taken by
        falling bound.  The last terms whose bounds together cannot lift a row to the floor are not essential: rows come
        from the postings of the essential ones, and the others are probed for rows that can still reach the floor.
        """
        least = np.minimum(query * self.low, query * self.high)
        bound = np.abs(query) * (self.high - self.low)
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0.0]])
        need = floor - least.sum()
        # the first place from which the bounds stay below the need: a row that ties with the floor may win by its id
        essential = min(len(order), int(np.searchsorted(-rest, -need, "right")))
        first = order[:essential]
        score = query[first] @ self.terms[first] - least[first].sum()
        rows = np.flatnonzero((score + rest[essential] >= need) & (self.rids != own))
        score = score[rows]
        for at in range(essential, len(order), STEP):
            some = order[at : at + STEP]
            score = score + query[some] @ self.terms[np.ix_(some, rows)] - least[some].sum()
            stay = score + rest[min(at + STEP, len(order))] >= need
            rows, score = rows[stay], score[stay]
        return rows, (score + least.sum()).astype(np.int64)


def _packed(rows: DataFrame, group: str, dims: int) -> DataFrame:
    """The rows of each group as one row: ids, row numbers and components as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        matrix = np.zeros((len(sizes), dims), np.int64)
        matrix[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten())
        ids, rids = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "rid"))
        wide = bool(table.column("wide")[0].as_py())
        return pa.table({group: table.column(group)[:1], "ids": [ids.tobytes()], "rids": [rids.tobytes()], "wide": [wide],
                         "rows": [(matrix if wide else matrix.astype(np.int32)).tobytes()]})

    return rows.groupBy(group).applyInArrow(pack, f"{group} bigint, ids binary, rids binary, wide boolean, rows binary")


def _unpacked(table: pa.Table, i: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, rids, rows = (table.column(c)[i].as_py() for c in ("ids", "rids", "rows"))
    kind = np.int64 if table.column("wide")[i].as_py() else np.int32
    return np.frombuffer(ids, np.int64), np.frombuffer(rids, np.int64), np.frombuffer(rows, kind).reshape(-1, dims)


def topk(
    vectors: DataFrame, queries: str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """For every row that fulfils the SQL condition ``queries``, the ``k`` other rows of the largest inner product.

    Components become floor(scale * x).  Returns query_id, rank (from 1), the id and the score; ties go to the smaller id
    (null last).  Rows are dealt into blocks by row number and queries into groups; a task scans some blocks for one group
    and carries each query's k-th best score along as the floor of MaxScore; the best of all tasks are merged per query.

    Vectors that are null or hold null or non-finite components take no part.  Rows with components of 2^20 or more after
    scaling lie in blocks of their own and are scored in whole numbers of any size; components and scores beyond a long
    become the nearest long.  Shorter vectors count as padded with zeros; one very wide vector widens all.  Rows repeated
    with one id are rows of their own; a query leaves out its own row only.
    With fewer than ``k`` other rows all are returned; an empty table gives no rows.  Other columns are ignored.
    """
    v = F.col(f"`{vector_col}`")
    sound = F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LAST)), F.lit(-LAST)))
    base = written(vectors.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.expr(queries), F.lit(False)).alias("asks"),
        F.when(sound, whole).alias("v"), F.monotonically_increasing_id().alias("rid")).where("v IS NOT NULL").withColumn(
            "wide", F.exists("v", lambda x: F.abs(x) >= NARROW)), "topk-rows")
    count = lambda c: F.count(F.when(c, 1))
    wide, asks = F.col("wide"), F.col("asks")
    n, n_wide, asking, asking_wide, dims = base.agg(count(~wide), count(wide), count(asks & ~wide), count(asks & wide), F.max(F.size("v"))).first()
    dims = max(1, dims or 0)
    narrow_blocks, narrow_groups = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(asking / QUERY_GROUP))
    blocks, groups = narrow_blocks + math.ceil(n_wide / BLOCK), narrow_groups + math.ceil(asking_wide / QUERY_GROUP)
    chunks = math.ceil(blocks / CHUNK_BLOCKS)

    def deal(first: int, every: int, seed: int):
        part = lambda m: F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(max(1, m)).cast("long"))
        return F.when(wide, first + part(every - first)).otherwise(part(first))

    postings = _packed(base.withColumn("block", deal(narrow_blocks, blocks, 1)).select("block", "id", "rid", "v", "wide"), "block", dims)
    asked = _packed(base.where("asks").withColumn("g", deal(narrow_groups, groups, 2)).select("g", "id", "rid", "v", "wide"), "g", dims)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"))
    left = written(asked, "topk-queries").withColumn("chunk", every(chunks))
    right = written(postings, "topk-blocks").withColumn("chunk", F.expr(f"block % {chunks}")).withColumn("g", every(groups))

    def search(queries: pa.Table, parts: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if queries.num_rows and parts.num_rows:
            scans = [Block(*_unpacked(parts, i, dims)) for i in range(parts.num_rows)]
            for query_id, own, query in zip(*_unpacked(queries, 0, dims)):
                narrow = query.dtype == np.int32
                ids, scores, rids, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), -np.inf
                for scan in scans:
                    if narrow and not scan.wide:
                        rows, score = scan.search(query.astype(np.float64), own, floor)
                    else:
                        rows, score = scan.search_wide(query, own, floor)
                    ids, scores, rids = np.concatenate([ids, scan.ids[rows]]), np.concatenate([scores, score]), np.concatenate([rids, scan.rids[rows]])
                    best = np.lexsort((rids, ids, -scores))[:k]
                    ids, scores, rids = ids[best], scores[best], rids[best]
                    floor = int(scores[-1]) if len(scores) == k else -np.inf
                found.append((np.full(len(ids), own), np.full(len(ids), query_id), ids, rids, scores))
        names = ("own", "query_id", "id", "rid", "score")
        return pa.table({c: pa.array(np.concatenate(x) if found else [], pa.int64()) for c, x in zip(names, zip(*found) if found else [()] * 5)})

    hits = left.groupBy("g", "chunk").cogroup(right.groupBy("g", "chunk")).applyInArrow(
        search, "own bigint, query_id bigint, id bigint, rid bigint, score bigint")
    order = Window.partitionBy("own").orderBy(F.col("score").desc(), "id", "rid")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.when(F.col("id") != LAST, F.col("id")).alias(id_col), "score")


def op8_topk_vectors(embeddings: DataFrame) -> DataFrame:
    """The 20 best of every 20th vector (see ``topk``)."""
    return topk(embeddings, "vec_id % 20 = 0")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
