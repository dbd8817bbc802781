"""Two-level windows and checked broadcasts against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens import scale
from ledgerlens.operators import analysis as A
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    # one key holds most of the rows
    keys = ["hot"] * 300 + ["a"] * 40 + ["b"] * 3
    order = rng.sample(range(10_000), len(keys))
    return [(k, o, rng.choice([None, 1, 2, 3])) for k, o in zip(keys, order)]


def _by_key(rows):
    out = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((o, v))
    return out


@pytest.mark.parametrize("width", [1, 7, 100, 100_000])
def test_two_level_windows(frame, rows, width):
    df = frame(rows, "k string, o long, v int")
    lag, known, run, place = {}, {}, {}, {}
    for k, items in _by_key(rows).items():
        before, last, total = None, None, 0
        for i, (o, v) in enumerate(items, 1):
            lag[k, o], known[k, o], place[k, o] = before, last, i
            total += v or 0
            run[k, o] = total
            before, last = o, v if v is not None else last
    got = scale.previous_row(df, ["k"], "o", {"p": "o"}, width)
    assert {(r.k, r.o): r.p for r in got.collect()} == lag
    got = scale.last_known(df, ["k"], "o", {"p": F.col("v")}, width)
    assert {(r.k, r.o): r.p for r in got.collect()} == known
    got = scale.running_sum(df, ["k"], "o", F.coalesce("v", F.lit(0)), "s", width)
    assert {(r.k, r.o): r.s for r in got.collect()} == run
    got = scale.position_in_key(df, ["k"], "o", width=width)
    assert {(r.k, r.o): r.position for r in got.collect()} == place


def test_small_side_checks_size(spark):
    df = spark.range(50)
    assert scale.fits(df, 50) and not scale.fits(df, 49)
    assert "broadcast" in scale.small_side(df, 50)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in scale.small_side(df, 49)._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("values", [[5], [1, 9], [3, 3, 3, 8], list(range(101)), [7, 1, 7, 2, 100]])
def test_exact_median(frame, values):
    import statistics

    df = frame([("g", v) for v in values], "g string, v long")
    assert A.exact_median(df, ["g"], "v", "m", width=4).first()["m"] == statistics.median(values)


def test_top_per_key_breaks_ties_by_order(frame):
    df = frame([("q", i % 3, i) for i in range(30)], "k string, s int, i int")
    got = scale.top_per_key(df, ["k"], [F.desc("s"), F.asc("i")], 4)
    assert rows_of(got, "rank", "i") == [(1, 2), (2, 5), (3, 8), (4, 11)]


def test_bootstrap_single_value_is_its_own_interval(frame):
    df = frame([("g", 1, 2.5)], "g string, o long, v double")
    r = A.bootstrap_ci(df, ["g"], "v", samples=50).first()
    assert (r.n, r.mean, r.ci_low, r.ci_high) == (1, 2.5, 2.5, 2.5)


def test_bootstrap_interval_contains_mean_and_repeats(frame):
    df = frame([("g", i, float(i % 10)) for i in range(200)], "g string, o long, v double")
    a = A.bootstrap_ci(df, ["g"], "v", samples=400, seed=7).first()
    b = A.bootstrap_ci(df.repartition(7), ["g"], "v", samples=400, seed=7).first()
    assert a == b and a.ci_low < a.mean < a.ci_high


def test_shared_folder_needs_a_setting_off_local_masters():
    import pytest

    from ledgerlens.session import shared_folder

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_resampling_draws_every_observation(frame):
    """Draw j of resample b is observation md5(seed:b:j) mod n, by broadcast and by join; equal values are drawn one by one."""
    import hashlib

    values = [0.25] * 30 + [0.75] * 10 + [i / 100 for i in range(20)]
    df = frame([("g", i * 3, v) for i, v in enumerate(values)], "g string, i long, v double")
    draw = lambda b, j: values[int(hashlib.md5(f"7:{b}:{j}".encode()).hexdigest()[:15], 16) % len(values)]
    means = sorted(round(sum(draw(b, j) for j in range(len(values))) / len(values), 9) for b in range(200))
    for small in (1_000_000, 1):
        r = A.resampled_ci(df, ["g"], "i", "v", samples=200, seed=7, small=small).first()
        assert (r.n, r.ci_low, r.ci_high) == (60, pytest.approx(means[4], abs=2e-6), pytest.approx(means[194], abs=2e-6))


def test_md5_numbers_are_those_of_hashlib():
    """All lengths of b and j, constant and changing ones, numbers of more than 32 bits."""
    import hashlib

    import numpy as np

    from ledgerlens.functions.draws import md5_numbers

    one = lambda s, b, j: int(hashlib.md5(f"{s}:{b}:{j}".encode()).hexdigest()[:15], 16)
    for seed, n, low, high in ((7, 60, 0, 200), (20260804, 3, 95, 1005), (-5, 12000, 9, 11), (2**63, 1, 0, 5), (0, 11, 99990, 100010)):
        b, j = np.repeat(np.arange(low, high), n), np.tile(np.arange(n), high - low)
        assert md5_numbers(seed, b, j).tolist() == [one(seed, x, y) for x, y in zip(b.tolist(), j.tolist())]
    large = np.array([10**9 - 1, 10**9, 2**40, 10**17])
    assert md5_numbers(1, np.full(4, 12), large).tolist() == [one(1, 12, y) for y in large.tolist()]


def test_resampling_of_groups_in_pieces_makes_no_row_of_a_draw(frame):
    """Groups of several sizes, whole and in pieces of seven values; draws are made and summed inside the tasks."""
    import hashlib

    groups = {"a": [i * i / 8 for i in range(23)], "b": [-1.5, 2.25], "c": [4.0], "d": [i % 7 / 4 for i in range(110)]}
    df = frame([(g, 1000 - i, v) for g, values in groups.items() for i, v in enumerate(reversed(values))], "g string, i long, v double")
    for small in (1 << 24, 7):
        out = A.resampled_ci(df, ["g"], "i", "v", samples=120, seed=3, small=small)
        assert "md5" not in out._jdf.queryExecution().toString()
        found = {r.g: r for r in out.collect()}
        for g, values in groups.items():
            ordered = [v for _, v in sorted((1000 - i, v) for i, v in enumerate(reversed(values)))]
            n = len(values)
            means = sorted(round(sum(ordered[int(hashlib.md5(f"3:{b}:{j}".encode()).hexdigest()[:15], 16) % n] for j in range(n)) / n, 9) for b in range(120))
            assert (found[g].n, found[g].mean) == (n, pytest.approx(sum(values) / n, abs=1e-6))
            assert (found[g].ci_low, found[g].ci_high) == (pytest.approx(means[2], abs=2e-6), pytest.approx(means[116], abs=2e-6))
