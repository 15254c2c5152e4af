"""Order statistics by counting passes against sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.operators import selection as L


@pytest.mark.parametrize("keep", [1, 7, 100_000])
def test_ranks_equal_sorting_whatever_the_distribution(spark, keep):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=400) * 10.0 ** rng.integers(-200, 200, 400), "b": np.repeat([3.0, 3.0, -1.0], 40), None: np.array([0.0, -0.0, 1e-310, -1e-310, 1e308, -1e308, math.inf, -math.inf, 5.0]), "one": np.array([2.5])}
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, x double")
    for p in (0, 37.5, 99, 100):
        got = {r["g"]: (r["n"], r["at"], r["threshold"]) for r in L.order_statistic(rows, ["g"], "x", p, keep).collect()}
        for g, v in groups.items():
            at = math.ceil((len(v) - 1) * (p / 100))
            assert got[g] == (len(v), at, np.sort(v)[at])
    finite = rows.where("g in ('a', 'b', 'one')")
    for r in L.quantiles(finite, ["g"], "x", (0.25, 0.5, 0.75), keep).collect():
        assert np.allclose(r["q"], np.quantile(groups[r["g"]], [0.25, 0.5, 0.75]), rtol=1e-9)


def test_a_large_group_equals_its_sorted_values(spark):
    rows = spark.range(0, 10_000_000, 1, 16).select(F.pmod(F.col("id") * 7_919, F.lit(10_000_000)).cast("double").alias("x"))
    r = L.order_statistic(rows, [], "x", 99.9, 1000).first()
    assert (r["n"], r["at"], r["threshold"]) == (10_000_000, math.ceil(9_999_999 * 0.999), float(math.ceil(9_999_999 * 0.999)))


def test_nothing_to_select_from(spark):
    rows = spark.createDataFrame([("a", None)], "g string, x double")
    assert L.order_statistic(rows, ["g"], "x", 50).count() == 0 and L.order_statistic(rows, [], "x", 50).count() == 0
