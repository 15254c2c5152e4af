"""Block and pair resampling against numpy with the same draws; the grid of alarms against runs counted one by one."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import metrics as M
from talweg.functions import signal as S


def _taken(n, block, resamples, seed):
    """The rows of every resample, by index."""
    size, rng = min(block, n), np.random.default_rng(seed)
    start = rng.integers(0, n - size + 1, (resamples, -(-n // size)))
    return (start[:, :, None] + np.arange(size)).reshape(resamples, -1)[:, :n]


def test_blocks_are_shared_by_both_models_and_combine_over_trials(spark):
    r = np.random.default_rng(0)
    trials = {f"trial-000{k}": (r.integers(0, 2, n), r.integers(0, 2, n)) for k, n in enumerate((37, 12, 5, 1))}
    assert M.named_seed(1, "trial-0001") != M.named_seed(1, "trial-0002")
    rows = spark.createDataFrame([("g", t, i, int(x), int(y)) for t, (a, b) in trials.items() for i, (x, y) in enumerate(zip(a, b))], "g string, t string, i int, a int, b int")
    total, n = np.zeros((200, 2)), sum(len(a) for a, _ in trials.values())
    for t, (a, b) in trials.items():
        at = _taken(len(a), 12, 200, M.named_seed(4, t))
        total += np.column_stack([a[at].sum(1), b[at].sum(1)])
    one = M.block_bootstrap(rows, ["g"], "t", "i", "a", 12, 200, 4).first()
    assert (one["low"], one["high"]) == pytest.approx(tuple(np.percentile(total[:, 0] / n, [2.5, 97.5])))
    both = M.paired_blocks(rows, ["g"], "t", "i", "a", "b", 12, 200, 4).first()
    assert (both["low"], both["high"]) == pytest.approx(tuple(np.percentile((total[:, 0] - total[:, 1]) / n, [2.5, 97.5])))
    assert both["mean"] == pytest.approx(sum(a.sum() - b.sum() for a, b in trials.values()) / n)
    same = M.paired_blocks(rows.withColumn("b", F.col("a")), ["g"], "t", "i", "a", "b", 12, 50, 4).first()
    assert (same["low"], same["high"]) == (0, 0)


def test_long_trials_draw_in_turns():
    x = np.random.default_rng(1).integers(0, 2, (40_000, 1)).astype(float)
    at = M.block_sums(x, 3, 200, [7])
    rng, want = np.random.default_rng([7]), []
    for _ in range(2):  # as many resamples at a time as the bound allows
        step = max(1, (1 << 20) // 13_334)
    for done in range(0, 200, step):
        start = rng.integers(0, 39_998, (min(step, 200 - done), 13_334))
        want.append(x[(start[:, :, None] + np.arange(3)).reshape(len(start), -1)[:, :40_000], 0].sum(1))
    assert np.allclose(at[:, 0], np.concatenate(want))


def test_pairs_are_drawn_with_replacement(spark):
    d = np.random.default_rng(3).normal(size=23)
    rows = spark.createDataFrame([(f"trial-{k:04d}", float(x), 0.0) for k, x in enumerate(d)] + [("zz", None, 1.0)], "t string, a double, b double").repartition(5)
    got = M.paired_bootstrap(rows, "t", "a", "b", 300, 9).first()
    rng = np.random.default_rng(9)
    means = [d[rng.integers(0, 23, 23)].mean() for _ in range(300)]
    assert (got["low"], got["high"], got["mean"]) == pytest.approx((*np.percentile(means, [2.5, 97.5]), d.mean()))


def test_the_grid_equals_counting_every_setting(spark):
    r = np.random.default_rng(5)
    rows = [(k, t, s, i, float(r.choice([0.1, 0.5, 0.9, r.random()]))) for k in (1, 2) for t in range(4) for s in "xy" for i in range(30)]
    limits = {1: [0.3, 0.5, 0.9], 2: [0.1, 0.5, 0.95]}
    table = spark.createDataFrame([(*x, limits[x[0]]) for x in rows], "k int, t int, s string, i int, x double, l array<double>")
    got = {(g["k"], g["place"], g["m"]): (g["n_alarms"], g["n_trials"]) for g in S.alarm_grid(table, ["k"], "t", "s", "i", "x", F.col("l"), (1, 2, 3)).collect()}
    want = {(k, p, m): [0, set()] for k in (1, 2) for p in range(3) for m in (1, 2, 3)}
    for k, t, s in itertools.product((1, 2), range(4), "xy"):
        for p, limit in enumerate(limits[k]):
            run = 0
            for x in (v for a, b, c, _, v in rows if (a, b, c) == (k, t, s)):
                run = run + 1 if x > limit else 0
                for m in (1, 2, 3):
                    if run == m:
                        want[k, p, m][0] += 1
                        want[k, p, m][1].add(t)
    assert got == {c: (n, len(t)) for c, (n, t) in want.items()}
    grid = spark.createDataFrame([(1, 5, 2), (2, 9, 3)], "m int, n_alarms int, n_trials int")
    assert {(g["m"], g["more_alarms"], g["more_trials"]) for g in S.against(grid, F.col("m") == 1).collect()} == {(1, 0, 0), (2, 4, 1)}
