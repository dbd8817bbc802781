"""Whitening against numpy on the whole list, and odd vectors."""

import math

import numpy as np
import pytest

from ledgerlens.llm import whitening as W
from ledgerlens.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def brute(rows, k=8):
    """n, deviation, whitened (up to sign), explained of a list of integer vectors, in row order."""
    x = np.array(rows, object)
    n, s = len(x), x.sum(0)
    centred = (n * x - s).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, [int(((n * r - s) ** 2).sum()) for r in x], centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def whole(vector):
    return [math.floor(1024 * float(c)) + 100_000 for c in vector]


def check(got, rows, k):
    """got: collected rows; rows: {id: integer vector}."""
    ids = sorted(rows)
    n, deviation, want, explained = brute([rows[i] for i in ids], k)
    at = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(at) == len(ids) * k
    mine = np.array([[at[i, c + 1].whitened for c in range(k)] for i in ids])
    assert np.abs(mine * np.sign((mine * want).sum(0)) - want).max() < 1e-8
    for i, d in zip(ids, deviation):
        for c in range(k):
            r = at[i, c + 1]
            assert (r.n, r.deviation) == (n, d) and r.explained == pytest.approx(explained[c], rel=1e-6) and r.identity_error < 1e-8


@pytest.mark.parametrize("folder", [FOLDER])
def test_op12(spark, folder):
    rows = {r.vec_id: whole(r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    check(QUERIES["op12_whitening"](spark, folder).collect(), rows, 8)


DDL = "vec_id bigint, embedding array<double>, x string, m int, z double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in rows], DDL).repartition(3)


def test_hot_vector_and_copies(spark):
    """A third of the rows are one vector; others come in pairs; the same result whichever way they are joined back."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 5))
    rows = [(i, (base[0] if i < 40 else base[i // 2 % 60]).tolist()) for i in range(120)]
    want = {i: whole(v) for i, v in rows}
    for hot_share in (10, 1000):
        check(W.whiten(frame(spark, rows), components=5, hot_share=hot_share).collect(), want, 5)


def test_weight_one_fits_distinct_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 3)).tolist()
    rows = [(i, base[min(i, 29)]) for i in range(80)]
    got = W.whiten(frame(spark, rows), components=3, weight="one").collect()
    n, deviation, want, _ = brute([whole(v) for v in base], 3)
    at = {(r.vec_id, r.component): r for r in got}
    assert len(got) == 240 and all(r.n == 30 for r in got) and at[79, 1].deviation == at[29, 1].deviation == deviation[29]
    assert abs(abs(at[79, 2].whitened) - abs(want[29][1])) < 1e-9


def test_odd_vectors(spark):
    """Null vectors and entries, NaN and infinity take no part; short ones are filled; null and repeated ids stay rows."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, 0.4]), (2, None), (3, [0.1, None, 0.2]), (4, [nan, 0.0, 0.0]), (5, [inf, 0.0, 0.0]), (6, [0.3, -0.2, 0.1]), (None, [0.5, 0.1, 0.9]),
            (6, [0.3, -0.2, 0.1]), (7, [0.7]), (8, [0.0, 0.0, -0.9]), (9, [])]
    got = W.whiten(frame(spark, rows), components=8).collect()
    assert sorted((r.vec_id or 0) for r in got) == sorted([0, 1, 6, 6, 7, 8, 9] * 3) and {r.n for r in got} == {7}
    full = [whole([*v, 0.0, 0.0, 0.0][:3]) for i, v in rows if i not in (2, 3, 4, 5)]
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(brute(full, 3)[1])


def test_large_entries_are_exact(spark):
    """Entries far beyond what doubles hold exactly; a deviation that does not fit a long is null, and nothing is dropped."""
    rows = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 2.0]), (3, [5.0, 3.5]), (4, [1e300, 0.0])]
    got = W.whiten(frame(spark, rows[:3]), components=2).collect()
    assert len(got) == 6 and {r.deviation for r in got if r.vec_id == 1} == {None}
    assert {r.vec_id for r in W.whiten(frame(spark, rows), components=2).collect()} == {1, 2, 3, 4}
    small = [(1, [2.0**18, 1.0]), (2, [3.0, 2.0]), (3, [5.0, 3.5])]
    check(W.whiten(frame(spark, small), components=2).collect(), {i: whole(v) for i, v in small}, 2)


def test_no_variance_and_no_rows(spark):
    got = W.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(got) == 4 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (0.0, 0.0, 0.0, 0) for r in got)
    flat = W.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.75]), (3, [0.5, 0.0])])).collect()
    assert {round(r.explained, 9) for r in flat if r.component == 1} == {1.0} and all(r.whitened == 0 for r in flat if r.component == 2)
    assert W.whiten(frame(spark, [])).isEmpty() and W.whiten(frame(spark, [(1, None)])).isEmpty() and W.whiten(frame(spark, [(1, [])])).isEmpty()
    assert W.whiten(frame(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
