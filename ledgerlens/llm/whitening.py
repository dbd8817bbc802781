"""Whitening of vectors by the covariance of the distinct vectors, weighted by how often each occurs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
HOT_SHARE = 1000  # vectors with more than one in so many rows join by broadcast: fewer than so many, whatever the table
LONG = 2**63 - 1
BATCH = 4096
FLAT = 1e-12  # components with less than this share of the largest eigenvalue carry rounding errors only


def whole_numbers(vectors: DataFrame, vector_col: str, scale: int = SCALE, shift: int = SHIFT):
    """Column of x = floor(scale * c) + shift (longs) of a vector; null if the vector is null or holds null or non-finite entries.

    Entries whose x does not fit a long get the nearest long.
    """
    v = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    sound = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    # floor of a double beyond the longs gives the nearest long; leave room for the shift
    x = F.transform(v, lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(LONG - abs(shift))), F.lit(abs(shift) - LONG)) + shift)
    return F.when(sound, x)


@dataclass(frozen=True)
class Fit:
    """What a fit list gives: n, exact sums per dimension, eigenvectors as columns, eigenvalues by falling size, trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def _matrix(lists: pa.Array, dims: int, fill: int) -> np.ndarray:
    """Rows of longs; shorter vectors are filled up."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(np.asarray(lists.offsets))
    rows = np.full((len(sizes), dims), fill, np.int64)
    rows[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten())
    return rows


def _exact(values: np.ndarray, limit: float) -> np.ndarray:
    """The same numbers, as Python integers if products could pass a long."""
    return values if limit < 2.0**62 else values.astype(object)


def centred(rows: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly."""
    largest = max(float(np.abs(rows.astype(np.float64)).max(initial=0)) * n, max(map(abs, sums), default=0))
    return _exact(rows, largest * 2) * n - np.array(sums, object if largest * 2 >= 2.0**62 else np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _sums(distinct: DataFrame, dims: int, fill: int) -> tuple[int, list[int]]:
    """n and the sums of w * x per dimension, exact: partial sums per task as decimal text, added by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in _batches(batches):
            w = batch.column("w").to_numpy()
            rows = _matrix(batch.column("x"), dims, fill)
            limit = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(w.sum())
            total = total + (_exact(rows, limit) * w[:, None]).sum(0).astype(object)
            n += int(w.sum())
        yield pa.RecordBatch.from_pydict({"d": pa.array(range(-1, dims), pa.int32()), "s": [str(s) for s in [n, *total]]})

    rows = distinct.mapInArrow(partial, "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row per dimension
    found = {r.d: int(r.s) for r in rows}
    return found.get(-1, 0), [found.get(d, 0) for d in range(dims)]


def fit(distinct: DataFrame, dims: int, fill: int) -> Fit | None:
    """Weighted centred covariance of ``distinct`` (x, w), divisor n, and its eigenvectors; None for an empty list.

    Each task multiplies its centred, weighted rows (one matrix product per batch) and returns one small matrix; Spark adds
    the matrices cell by cell, the driver gets dims * (dims + 1) / 2 numbers.
    """
    n, sums = _sums(distinct, dims, fill)
    if not n:
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in _batches(batches):
            rows = centred(_matrix(batch.column("x"), dims, fill), n, sums).astype(np.float64) / n
            total += rows.T @ (rows * batch.column("w").to_numpy()[:, None])
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    cells = distinct.mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    covariance = np.zeros((dims, dims))
    i, j, s = (cells.column(c).to_numpy() for c in ("i", "j", "s"))
    covariance[i, j] = covariance[j, i] = s / n
    values, vectors = np.linalg.eigh(covariance)
    return Fit(n, tuple(sums), np.ascontiguousarray(vectors[:, ::-1]), np.maximum(values[::-1], 0.0), float(np.trace(covariance)))


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weight: str = "count",
    scale: int = SCALE, shift: int = SHIFT, hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Coordinates of every vector along the leading components, scaled to unit variance over the fit list.

    Identical x vectors (``whole_numbers``) are grouped; each distinct one takes part in the fit with the weight of its
    rows (``weight="count"``: the fit list is all rows) or once (``"one"``), is whitened once and joined back to its rows.
    Vectors that make up more than one in ``hot_share`` rows (fewer than ``hot_share`` of them) are joined by broadcast, so
    that no task gets all their rows; the others by shuffle.

    Returns the id, component (from 1), n (length of the fit list), deviation (sum over dimensions of (n * x - S)^2, exact;
    null where it does not fit a long), whitened, explained (share of the trace) and identity_error (largest deviation of
    the covariance of whitened from the identity), one row per row and component.

    Vectors that are null or hold null or non-finite entries take no part.  Shorter vectors count as filled up with zeros;
    components beyond the dimensions do not exist.  A component without variance (one distinct vector, constant dimensions)
    has whitened 0 and is left out of identity_error.  Rows repeated with one id and null ids are rows of their own.  Empty
    tables give no rows; other columns are ignored.
    """
    rows = written(vectors.select(F.col(f"`{id_col}`").alias("id"), whole_numbers(vectors, vector_col, scale, shift).alias("x")).where("x IS NOT NULL"), "whitening-rows")
    distinct = written(rows.groupBy("x").agg(F.count("*").alias("m")).withColumn("w", F.col("m") if weight == "count" else F.lit(1).cast("long")), "whitening-distinct")
    total, dims = distinct.agg(F.sum("m"), F.max(F.size("x"))).first()
    dims = dims or 0
    found = fit(distinct, dims, shift) if dims else None
    k = min(components, dims)
    if found is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame(
            [], f"{id_col} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    n, sums = found.n, found.sums
    alive = [bool(found.values[c] > FLAT * found.values[0]) for c in range(k)]
    project = found.vectors[:, :k] * np.array([1 / np.sqrt(found.values[c]) if alive[c] else 0.0 for c in range(k)])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            exact = centred(_matrix(batch.column("x"), dims, shift), n, sums)
            z = (exact.astype(np.float64) / n) @ project
            largest = float(np.abs(exact.astype(np.float64)).max(initial=0))
            squares = (_exact(exact, largest * largest * dims) ** 2).sum(1)
            z = pa.ListArray.from_arrays(pa.array(np.arange(0, len(z) * k + 1, k, dtype=np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_pydict({
                "x": batch.column("x"), "m": batch.column("m"), "w": batch.column("w"), "z": z,
                "deviation": pa.array([int(s) if s <= LONG else None for s in squares], pa.int64())})

    done = written(distinct.mapInArrow(along, "x array<bigint>, m bigint, w bigint, z array<double>, deviation bigint"), "whitening-done")
    error = _identity_error(done, n, [c for c in range(k) if alive[c]])
    hot = done.where(F.col("m") * hot_share > total).select("x", "z", "deviation", F.lit(True).alias("hot"))
    cold = done.where(F.col("m") * hot_share <= total).select("x", "z", "deviation")
    marked = rows.join(F.broadcast(hot), "x", "left")
    back = marked.where("hot").select("id", "z", "deviation").union(
        marked.where("hot IS NULL").select("id", "x").join(cold.hint("shuffle_merge"), "x").select("id", "z", "deviation"))
    explained = F.array(*[F.lit(float(found.values[c] / found.trace) if found.trace else 0.0) for c in range(k)])
    return back.select(F.col("id").alias(id_col), "deviation", F.posexplode("z").alias("c", "whitened")).select(
        id_col, (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("c")].alias("explained"), F.lit(error).alias("identity_error"))


def _identity_error(done: DataFrame, n: int, alive: list[int]) -> float:
    """Largest absolute entry of the covariance of z (over the fit list, centred first) minus the identity."""
    if not alive:
        return 0.0
    mean = done.agg(*[(F.sum(F.col("w") * F.col("z")[c]) / n).alias(f"z{c}") for c in alive]).first()
    off = {c: F.col("z")[c] - F.lit(mean[f"z{c}"]) for c in alive}
    pairs = [(a, b) for a in alive for b in alive if a <= b]
    cells = done.agg(*[(F.sum(F.col("w") * off[a] * off[b]) / n).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return float(max(abs(cells[f"c{a}_{b}"] - (a == b)) for a, b in pairs))


def op12_whitening(embeddings: DataFrame) -> DataFrame:
    """Eight whitened coordinates of every embedding (see ``whiten``)."""
    return whiten(embeddings)
