"""Closed-form reliability, availability and FMECA (N16-N25, A23-free; W04, J10)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALENDAR_HOURS = 8760.0
#: No year has more hours.
MOST_HOURS = 8784.0

#: One scenario a row, every field stated; unknown fields fail the read.
SCENARIO = T.StructType([
    T.StructField("name", T.StringType(), False), T.StructField("kind", T.StringType(), False), T.StructField("rate", T.DoubleType()), T.StructField("shape", T.DoubleType()), T.StructField("scale", T.DoubleType()),
    T.StructField("mtbf", T.DoubleType()), T.StructField("mttr", T.DoubleType()), T.StructField("hours_per_year", T.DoubleType()), T.StructField("times", T.ArrayType(T.DoubleType())),
])


def checked(scenarios: DataFrame) -> DataFrame:
    """Fails on a kind that isn't known, parameters that aren't positive, or times that don't rise."""
    kind = F.col("kind")
    positive = lambda c: F.coalesce((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.lit(False))
    needs = F.when(kind == "exponential", positive("rate")).when(kind == "weibull", positive("shape") & positive("scale")).when(kind == "maintainability", positive("mttr")).when(kind == "availability", positive("mtbf") & F.coalesce(F.col("mttr") >= 0, F.lit(False))).otherwise(False)
    rising = F.coalesce(F.forall(F.sequence(F.lit(1), F.greatest(F.size("times") - 1, F.lit(1))), lambda i: F.coalesce(F.get("times", i) > F.get("times", i - 1), F.lit(True))), F.lit(True))
    hours = F.coalesce(F.col("hours_per_year") <= MOST_HOURS, F.lit(True))
    return scenarios.withColumn("_ok", F.when(needs & rising & hours, True).otherwise(F.raise_error(F.concat(F.lit("scenario not valid: "), "name")).cast("boolean"))).where("_ok").drop("_ok")


def yearly_rate(rate: Column, hours: Column) -> Column:
    """A rate per hour as one per year."""
    return rate * hours


def exponential(rate: Column, t: Column) -> dict[str, Column]:
    """N16."""
    return {"reliability": F.exp(-rate * t), "failure": -F.expm1(-rate * t), "hazard": rate}


def weibull(shape: Column, scale: Column, t: Column) -> dict[str, Column]:
    """In logarithms; the hazard at 0 is null for a shape under one (its limit is infinite), 1 / scale for one, else 0."""
    log_ratio = F.ln(t) - F.ln(scale)
    cumulative = F.when(t == 0, 0.0).otherwise(F.exp(shape * log_ratio))
    hazard = F.when(t == 0, F.when(shape < 1, None).when(shape == 1, 1 / scale).otherwise(0.0)).otherwise(F.exp(F.ln(shape) - F.ln(scale) + (shape - 1) * log_ratio))
    return {"reliability": F.exp(-cumulative), "failure": -F.expm1(-cumulative), "hazard": hazard}


@F.pandas_udf(T.DoubleType())
def weibull_mttf(shape: pd.Series, scale: pd.Series) -> pd.Series:
    """Scale x gamma(1 + 1 / shape); there is no built-in gamma function."""
    return pd.Series([s * math.exp(math.lgamma(1 + 1 / k)) for k, s in zip(shape, scale)], dtype=float)


def curves(scenarios: DataFrame) -> DataFrame:
    """One row per scenario and time."""
    each = checked(scenarios).where("kind in ('exponential', 'weibull', 'maintainability')").withColumn("t", F.explode("times"))
    e, w = exponential(F.col("rate"), F.col("t")), weibull(F.col("shape"), F.col("scale"), F.col("t"))
    pick = lambda c: F.when(F.col("kind") == "exponential", e[c]).when(F.col("kind") == "weibull", w[c])
    repair = F.when(F.col("kind") == "maintainability", -F.expm1(-F.col("t") / F.col("mttr")))
    return each.select("name", "kind", "t", pick("reliability").alias("reliability"), pick("failure").alias("failure"), pick("hazard").alias("hazard"), F.when((F.col("kind") == "weibull") & (F.col("t") == 0) & (F.col("shape") < 1), "positive_infinity").otherwise("finite").alias("hazard_status"), repair.alias("maintainability"))


def complement_product(x: str) -> Column:
    """1 - product of (1 - x) over a group, keeping small probabilities; 1 if any is 1."""
    return F.when(F.max(F.col(x)) == 1, 1.0).otherwise(-F.expm1(F.sum(F.when(F.col(x) < 1, F.log1p(-F.col(x))))))


def product(x: str) -> Column:
    """Product over a group of probabilities; 0 if any is 0."""
    return F.when(F.min(F.col(x)) == 0, 0.0).otherwise(F.exp(F.sum(F.when(F.col(x) > 0, F.ln(F.col(x))))))


def series(components: DataFrame, per: list[str]) -> DataFrame:
    """Independent components in series: all must work."""
    return components.groupBy(*per).agg(product("reliability").alias("reliability"), complement_product("failure").alias("failure"))


def parallel(components: DataFrame, per: list[str]) -> DataFrame:
    """In active parallel: one suffices."""
    return components.groupBy(*per).agg(complement_product("reliability").alias("reliability"), product("failure").alias("failure"))


def availability(mtbf: Column, mttr: Column) -> Column:
    """Inherent availability, scaled so that large values don't overflow."""
    top = F.greatest(mtbf, mttr)
    return (mtbf / top) / (mtbf / top + mttr / top)


def fmeca(items: DataFrame, horizons: list[float]) -> DataFrame:
    """Items (id, s, o, d, rate, hours) with RPN, places and, for each horizon in years, the chance of a failure and the failures expected. Few rows: a table of parts."""
    from pyspark.sql import Window

    place = lambda c: F.rank().over(Window.orderBy(F.desc_nulls_last(c)))
    out = items.withColumn("rpn", F.col("s") * F.col("o") * F.col("d"))
    out = out.withColumn("place_rpn", place("rpn")).withColumn("place_o", place("o")).withColumn("place_rate", F.when(F.col("rate").isNotNull(), place("rate")))
    yearly = yearly_rate(F.col("rate"), F.col("hours"))
    for h in horizons:
        out = out.withColumn(f"chance_{h:g}", -F.expm1(-yearly * h)).withColumn(f"expected_{h:g}", yearly * h)
    return out


def discordant(items: DataFrame) -> DataFrame:
    """Rated items a, b where a occurs more by its note and less by its rate. A table of parts, so pairs are few."""
    a, b = items.where("rate is not null").alias("a"), items.where("rate is not null").alias("b")
    return a.join(F.broadcast(b), (F.col("a.o") > F.col("b.o")) & (F.col("a.rate") < F.col("b.rate"))).select(F.col("a.id").alias("more_o"), F.col("b.id").alias("less_o"))


def repairs_match(repairs: DataFrame, items: DataFrame) -> DataFrame:
    """Groups that only one side has, and repair hours that aren't positive: empty if all is well."""
    r = repairs.select("group").distinct().withColumn("_r", F.lit(True))
    both = r.join(items.select(F.col("id").alias("group")).withColumn("_i", F.lit(True)), "group", "full_outer")
    bad = both.where("_r is null or _i is null").select("group", F.when(F.col("_r").isNull(), "no repair").otherwise("no item").alias("issue"))
    return bad.unionByName(repairs.where("hours <= 0 or hours is null").select("group", F.lit("hours not positive").alias("issue")))


def component_view(items: DataFrame, repairs: DataFrame) -> DataFrame:
    """Each item x repair scenario on two bases: of all calendar hours, and of the hours in service alone; with stop, MTBF, availability and hours down in a year."""
    yearly = yearly_rate(F.col("rate"), F.col("hours"))
    down = F.col("detection") + F.col("repair")
    j = items.where("rate is not null").join(F.broadcast(repairs), items.id == F.col("group"))
    j = j.withColumn("basis", F.explode(F.array(F.lit("calendar"), F.lit("service"))))
    mtbf = F.when(F.col("basis") == "calendar", F.lit(CALENDAR_HOURS) / yearly).otherwise(F.lit(1.0) / F.col("rate"))
    return j.select("id", "scenario", "basis", down.alias("stop_hours"), mtbf.alias("mtbf_hours"), availability(mtbf, down).alias("availability"), (yearly * down).alias("down_per_year"))
