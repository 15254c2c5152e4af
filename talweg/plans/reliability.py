"""Queries of reliability and FMECA: scenarios derived from parts and suppliers, and literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reliability as R
from ..storage import table as T

#: Occurrence notes of four items and made-up rates, a fixed example.
ITEMS = [("ccb", 7, 4, 6, 4.0e-6), ("contactors", 6, 5, 5, 2.0e-6), ("igbt", 3, 3, 7, 9.0e-6), ("fans", 4, 3, 4, None)]
REPAIRS = [("ccb", "fast", 2.0, 6.0), ("ccb", "slow", 24.0, 30.0), ("contactors", "fast", 2.0, 4.0), ("igbt", "slow", 24.0, 60.0), ("fans", "fast", 1.0, 2.0)]
_ITEMS_SQL = "items(id, s, o, d, rate) AS (VALUES " + ", ".join(f"('{a}', {s}, {o}, {d}, {'NULL' if r is None else f'{r}::DOUBLE'})" for a, s, o, d, r in ITEMS) + "), i AS (SELECT *, 8760.0::DOUBLE AS hours FROM items)"
_REP_SQL = 'rep("group", scenario, detection, repair) AS (VALUES ' + ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {e}::DOUBLE)" for a, b, c, e in REPAIRS) + ")"


def _items(spark):
    return spark.createDataFrame(ITEMS, "id string, s int, o int, d int, rate double").withColumn("hours", F.lit(8760.0))


def _repairs(spark):
    return spark.createDataFrame(REPAIRS, "`group` string, scenario string, detection double, repair double")


def _round(df, *names, to=9):
    return df.select(*[F.round(c, to).alias(c) if c in names else c for c in df.columns])


def _scenarios(spark, d):
    """A part is a scenario: exponential by price if its key is even, else Weibull by size."""
    p = T(spark, d, "part").select(
        F.concat(F.lit("part"), F.col("p_partkey")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, "exponential").otherwise("weibull").alias("kind"), (F.col("p_retailprice") / 1e6).alias("rate"), (F.col("p_size") / 20.0).alias("shape"), (F.col("p_retailprice") * 1.0).alias("scale"),
        F.lit(None).cast("double").alias("mtbf"), F.lit(None).cast("double").alias("mttr"), F.lit(8760.0).alias("hours_per_year"), F.array(F.lit(0.0), F.lit(100.0), F.lit(1000.0)).alias("times"),
    )
    return p


def reliability_curves(spark, d):
    return _round(R.curves(_scenarios(spark, d)).where("kind = 'exponential'").select("name", "t", "reliability", "failure", "hazard"), "reliability", "failure", "hazard")


def weibull_curves(spark, d):
    return _round(R.curves(_scenarios(spark, d)).where("kind = 'weibull'").select("name", "t", "reliability", "failure", "hazard", "hazard_status"), "reliability", "failure", "hazard")


def weibull_mttf(spark, d):
    return _round(R.checked(_scenarios(spark, d)).where("kind = 'weibull'").select("name", F.ln(R.weibull_mttf("shape", "scale")).alias("ln_mttf")), "ln_mttf", to=7)


def _components(spark, d):
    """A brand is a system of its parts of size under 4, at 100 hours."""
    p = T(spark, d, "part").where("p_size < 4").select("p_brand", (F.col("p_retailprice") / 1e6).alias("rate"))
    e = R.exponential(F.col("rate"), F.lit(100.0))
    return p.select("p_brand", e["reliability"].alias("reliability"), e["failure"].alias("failure"))


def series_system(spark, d):
    return _round(R.series(_components(spark, d), ["p_brand"]), "reliability", "failure", to=7)


def parallel_system(spark, d):
    return _round(R.parallel(_components(spark, d), ["p_brand"]), "reliability", "failure", to=7)


def availability(spark, d):
    s = T(spark, d, "supplier").where("s_acctbal > 0")
    return s.select("s_suppkey", F.round(R.availability(F.col("s_acctbal"), (F.col("s_nationkey") + 1) * 1.0), 9).alias("availability"))


def maintainability(spark, d):
    s = T(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(10))).alias("t"), ((F.col("s_nationkey") + 1) * 1.0).alias("mttr"))
    return s.select("s_suppkey", F.col("t").alias("t"), F.round(-F.expm1(-F.col("t") / F.col("mttr")), 9).alias("maintainability"))


def fmeca_rank(spark, d):
    out = R.fmeca(_items(spark), [1.0, 10.0]).drop("hours")
    return _round(out, "chance_1", "expected_1", "chance_10", "expected_10")


def fmeca_discordant(spark, d):
    return R.discordant(_items(spark))


def component_view(spark, d):
    return _round(R.component_view(_items(spark), _repairs(spark)), "mtbf_hours", "availability", "down_per_year", to=6)


def repairs_check(spark, d):
    r = _repairs(spark).where("`group` <> 'igbt'").withColumn("hours", F.col("repair"))
    return R.repairs_match(r, _items(spark))


QUERIES = {
    "reliability_curves": (reliability_curves, "SELECT 'part' || p_partkey AS name, t, round(exp(-p_retailprice / 1e6 * t), 9) AS reliability, round(1 - exp(-p_retailprice / 1e6 * t), 9) AS failure, round(p_retailprice / 1e6, 9) AS hazard FROM part, (SELECT unnest([0.0::DOUBLE, 100, 1000]) t) WHERE p_partkey % 2 = 0"),
    "weibull_curves": (weibull_curves, "WITH w AS (SELECT 'part' || p_partkey AS name, t, p_size / 20.0::DOUBLE AS k, p_retailprice AS c FROM part, (SELECT unnest([0.0::DOUBLE, 100, 1000]) t) WHERE p_partkey % 2 = 1) SELECT name, t, round(CASE WHEN t = 0 THEN 1 ELSE exp(-pow(t / c, k)) END, 9) AS reliability, round(CASE WHEN t = 0 THEN 0 ELSE 1 - exp(-pow(t / c, k)) END, 9) AS failure, round(CASE WHEN t = 0 THEN CASE WHEN k < 1 THEN NULL WHEN k = 1 THEN 1 / c ELSE 0 END ELSE k / c * pow(t / c, k - 1) END, 9) AS hazard, CASE WHEN t = 0 AND k < 1 THEN 'positive_infinity' ELSE 'finite' END AS hazard_status FROM w"),
    "weibull_mttf": (weibull_mttf, "SELECT 'part' || p_partkey AS name, round(ln(p_retailprice) + lgamma(1 + 1 / (p_size / 20.0::DOUBLE)), 7) AS ln_mttf FROM part WHERE p_partkey % 2 = 1"),
    "series_system": (series_system, "SELECT p_brand, round(exp(sum(-p_retailprice / 1e6 * 100)), 7) AS reliability, round(1 - exp(sum(-p_retailprice / 1e6 * 100)), 7) AS failure FROM part WHERE p_size < 4 GROUP BY 1"),
    "parallel_system": (parallel_system, "SELECT p_brand, round(1 - exp(sum(ln(1 - exp(-p_retailprice / 1e6 * 100)))), 7) AS reliability, round(exp(sum(ln(1 - exp(-p_retailprice / 1e6 * 100)))), 7) AS failure FROM part WHERE p_size < 4 GROUP BY 1"),
    "availability": (availability, "SELECT s_suppkey, round(s_acctbal / (s_acctbal + s_nationkey + 1), 9) AS availability FROM supplier WHERE s_acctbal > 0"),
    "maintainability": (maintainability, "SELECT s_suppkey, t::INT AS t, round(1 - exp(-t / (s_nationkey + 1)), 9) AS maintainability FROM supplier, range(0, 41, 10) r(t)"),
    "fmeca_rank": (fmeca_rank, f"WITH {_ITEMS_SQL} SELECT id, s, o, d, rate, s * o * d AS rpn, rank() OVER (ORDER BY s * o * d DESC) AS place_rpn, rank() OVER (ORDER BY o DESC) AS place_o, CASE WHEN rate IS NOT NULL THEN rank() OVER (ORDER BY rate DESC NULLS LAST) END AS place_rate, round(1 - exp(-rate * hours), 9) AS chance_1, round(rate * hours, 9) AS expected_1, round(1 - exp(-rate * hours * 10), 9) AS chance_10, round(rate * hours * 10, 9) AS expected_10 FROM i"),
    "fmeca_discordant": (fmeca_discordant, f"WITH {_ITEMS_SQL} SELECT a.id AS more_o, b.id AS less_o FROM i a JOIN i b ON a.o > b.o AND a.rate < b.rate"),
    "component_view": (component_view, f"WITH {_ITEMS_SQL}, {_REP_SQL}, b AS (SELECT *, unnest(['calendar', 'service']) AS basis FROM i JOIN rep ON id = \"group\" WHERE rate IS NOT NULL), m AS (SELECT *, CASE basis WHEN 'calendar' THEN 8760 / (rate * hours) ELSE 1 / rate END AS mt FROM b) SELECT id, scenario, basis, detection + repair AS stop_hours, round(mt, 6) AS mtbf_hours, round(mt / (mt + detection + repair), 6) AS availability, round(rate * hours * (detection + repair), 6) AS down_per_year FROM m"),
    "repairs_check": (repairs_check, "SELECT 'igbt' AS \"group\", 'no repair' AS issue"),
}
