"""Detection metrics and their uncertainty."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import global_rank
from ..storage import staged


def confusion(rows: DataFrame, per: list[str], positive: Column, flagged: Column) -> DataFrame:
    """True and false positives and negatives."""
    return rows.groupBy(*per).agg(F.count_if(positive & flagged).alias("tp"), F.count_if(positive & ~flagged).alias("fn"), F.count_if(~positive & flagged).alias("fp"), F.count_if(~positive & ~flagged).alias("tn"))


def derived(counts: DataFrame) -> DataFrame:
    """A10: rates from counts. Precision without positives is null; F1 and MCC undefined are 0."""
    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        "*", sens.alias("sensitivity"), spec.alias("specificity"), F.try_divide(tp, tp + fp).alias("precision"), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        ((sens + spec) / 2).alias("balanced"), F.coalesce(F.try_divide(tp * tn - fp * fn, den), F.lit(0.0)).alias("mcc"),
    )


def auc_roc(rows: DataFrame, per: list[str], score: str, positive: str) -> DataFrame:
    """Mann-Whitney with ties counted half. Scores are counted first, so the window runs over distinct ones only."""
    each = rows.groupBy(*per, score).agg(F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_q"))
    below = F.coalesce(F.sum("_q").over(Window.partitionBy(*per).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = each.withColumn("_w", F.col("_p") * (below + F.col("_q") / 2))
    return won.groupBy(*per).agg(F.try_divide(F.sum("_w"), F.sum("_p") * F.sum("_q")).alias("auc_roc"))


def auc_pr(rows: DataFrame, per: list[str], score: str, positive: str) -> DataFrame:
    """Trapezoid over distinct thresholds from the point (recall 0, precision 1); not average precision."""
    each = rows.groupBy(*per, score).agg(F.count_if(F.col(positive)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*per).orderBy(F.desc(score))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    c = each.withColumn("_tp", F.sum("_p").over(run)).withColumn("_all", F.sum("_n").over(run)).withColumn("_pos", F.sum("_p").over(Window.partitionBy(*per)))
    c = c.withColumn("_r", F.try_divide("_tp", "_pos")).withColumn("_pr", F.col("_tp") / F.col("_all"))
    area = (F.col("_r") - F.coalesce(F.lag("_r").over(w), F.lit(0.0))) * (F.col("_pr") + F.coalesce(F.lag("_pr").over(w), F.lit(1.0))) / 2
    return c.withColumn("_a", area).groupBy(*per).agg(F.sum("_a").alias("auc_pr"))


def window_bundle(rows: DataFrame, per: list[str], score: str, positive: str, flag: str) -> DataFrame:
    """Counts, rates and both areas of each group. Scores that are null or NaN, and groups without windows of both kinds, are refused."""
    if rows.where(F.col(score).isNull() | F.isnan(score)).limit(1).count():
        raise ValueError("a score is missing or not a number")
    counts = confusion(rows, per, F.col(positive), F.col(flag))
    if counts.where("tp + fn = 0 or fp + tn = 0").limit(1).count():
        raise ValueError("a group lacks windows of one kind")
    return derived(counts).join(auc_roc(rows, per, score, positive), per).join(auc_pr(rows, per, score, positive), per)


def false_alarms(flags: DataFrame, alarms: DataFrame, per: list[str], flag: str, rate: float) -> DataFrame:
    """Windows, those above the threshold and their share, alarms, duration (windows at `rate` a second), alarms an hour and the upper bound of their rate."""
    w = flags.groupBy(*per).agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col(flag)).alias("above"))
    a = alarms.groupBy(*per).agg(F.count(F.lit(1)).alias("alarms"))
    out = w.join(a, per, "left") if per else w.crossJoin(a)
    out = out.withColumn("alarms", F.coalesce("alarms", F.lit(0))).withColumn("share", F.col("above") / F.col("windows")).withColumn("duration_s", F.col("windows") / rate)
    return out.withColumn("per_hour", F.col("alarms") / F.col("duration_s") * 3600).withColumn("upper_per_hour", poisson_upper("alarms") / F.col("duration_s") * 3600)


def evaluation_summary(trials: DataFrame, per: list[str], metrics: list[str]) -> DataFrame:
    """Over the trials of a model: how many were detected, the median delay of those, and the mean of each metric, nulls left out."""
    return trials.groupBy(*per).agg(F.count(F.lit(1)).alias("trials"), F.count("delay").alias("detected"), F.percentile("delay", 0.5).alias("median_delay"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def by_fault(trials: DataFrame, per: list[str]) -> DataFrame:
    """Counts of a fault's trials summed and their rates derived again; areas and delays averaged."""
    return derived(trials.groupBy(*per).agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")], F.avg("auc_roc").alias("auc_roc"), F.avg("delay").alias("delay")))


def spread(rows: DataFrame, per: list[str], value: str, detected: str) -> DataFrame:
    """Least and greatest value over seeds, nulls ignored, and in how many it was detected."""
    return rows.groupBy(*per).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count_if(F.col(detected)).alias("n_detected"), F.count(F.lit(1)).alias("n_seeds"))


def markov_rates(flags: DataFrame, segment: list[str], order: str, flag: str, per: list[str], m: int, per_hour: float) -> DataFrame:
    """Two-state chain over neighbours within segments: p01, p11, chance of an alarm a window and alarms an hour, and the predicted runs of m."""
    before = F.lag(flag).over(Window.partitionBy(*segment).orderBy(order))
    b, f = F.col("_b"), F.col(flag)
    c = flags.withColumn("_b", before).groupBy(*per).agg(F.count_if(~b & ~f).alias("n00"), F.count_if(~b & f).alias("n01"), F.count_if(b & ~f).alias("n10"), F.count_if(b & f).alias("n11"), F.count(F.lit(1)).alias("windows"), F.count_if(f).alias("above"))
    zero = F.lit(0.0)
    c = c.withColumn("p01", F.coalesce(F.try_divide(F.col("n01").cast("double"), F.col("n00") + F.col("n01")), zero)).withColumn("p11", F.coalesce(F.try_divide(F.col("n11").cast("double"), F.col("n10") + F.col("n11")), zero))
    pi0 = F.coalesce(F.try_divide(1 - F.col("p11"), F.col("p01") + 1 - F.col("p11")), F.lit(1.0))
    c = c.withColumn("per_window", pi0 * F.col("p01") * F.pow("p11", F.lit(m - 1.0)))
    return c.withColumn("per_hour", F.col("per_window") * per_hour).withColumn("predicted", F.col("per_window") * F.col("windows"))


@F.pandas_udf(T.DoubleType())
def poisson_upper(count: pd.Series) -> pd.Series:
    """The largest Poisson mean that `count` events leave at 95 %, by bisection."""

    def one(n: int) -> float:
        low, high = 0.0, 10.0 * (n + 2)
        for _ in range(200):
            mean = (low + high) / 2
            terms = -mean + np.arange(n + 1) * math.log(mean) - np.array([math.lgamma(k + 1) for k in range(n + 1)])
            low, high = (mean, high) if np.exp(terms).sum() > 0.05 else (low, mean)
        return (low + high) / 2

    known = {n: one(int(n)) for n in count.dropna().unique()}
    return count.map(known).astype(float)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def beta_interval(place: pd.Series, n: pd.Series) -> pd.DataFrame:
    """95 % interval of the chance that a new healthy window passes a threshold at that place of n."""

    def cdf(x: float, a: int, total: int) -> float:
        k = np.arange(a, total + 1)
        choose = np.array([math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1) for i in k])
        return float(np.exp(choose + k * math.log(x) + (total - k) * math.log1p(-x)).sum())

    def one(r: int, size: int) -> tuple[float, float]:
        a, found = size + 1 - r, []
        for q in (0.025, 0.975):
            low, high = 0.0, 1.0
            for _ in range(60):
                x = (low + high) / 2
                low, high = (x, high) if cdf(x, a, size) < q else (low, x)
            found.append((low + high) / 2)
        return found[0], found[1]

    return pd.DataFrame([one(int(r), int(s)) for r, s in zip(place, n)], columns=["low", "high"])


def named_seed(seed: int, name: object) -> list[int]:
    """A seed from the whole name of a trial, so trials whose names begin alike draw apart."""
    return [seed, int.from_bytes(hashlib.sha256(str(name).encode()).digest()[:16], "big")]


def block_sums(x: np.ndarray, block: int, resamples: int, seed: list[int]) -> np.ndarray:
    """Sums (resamples, columns) over moving blocks of consecutive rows, drawn with replacement until as many rows as there are; the last block is cut. All columns share the draws."""
    n, size = len(x), min(block, len(x))
    count, rng = math.ceil(n / size), np.random.default_rng(seed)
    upto = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, 0)])
    last = n - (count - 1) * size
    out = np.empty((resamples, x.shape[1]))
    step = max(1, (1 << 20) // count)  # resamples at a time, so a long trial's draws don't fill the memory
    for at in range(0, resamples, step):
        start = rng.integers(0, n - size + 1, (min(step, resamples - at), count))
        out[at : at + step] = (upto[start[:, :-1] + size] - upto[start[:, :-1]]).sum(1) + upto[start[:, -1] + last] - upto[start[:, -1]]
    return out


def resampled(rows: DataFrame, group: list[str], trial: str, order: str, values: list[str], block: int, resamples: int, seed: int) -> DataFrame:
    """(group, k, n, values): in each resample k the sums of the values over moving blocks of every trial, and the number of rows. Trials are drawn apart, each by its name, and their sums combine before the shuffle."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[values].to_numpy(float)
        sums = block_sums(x, block, resamples, named_seed(seed, pdf[trial].iloc[0]))
        out = pd.DataFrame(sums, columns=values).assign(k=np.arange(resamples), n=len(x))
        for g in group:
            out[g] = [pdf[g].iloc[0]] * resamples
        return out

    kinds = "".join(f"`{g}` {rows.schema[g].dataType.simpleString()}, " for g in group)
    schema = kinds + "k long, n long, " + ", ".join(f"`{v}` double" for v in values)
    keys = list(dict.fromkeys([*group, trial]))
    drawn = rows.select(*keys, order, *values).groupBy(*keys).applyInPandas(run, schema)
    return drawn.groupBy(*group, "k").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in values])


def _interval(drawn: DataFrame, group: list[str], value: Column) -> DataFrame:
    """2.5 and 97.5 % of the resamples' values (as many as there are resamples)."""
    return drawn.groupBy(*group).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("_q")).select(*group, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def block_bootstrap(rows: DataFrame, group: list[str], trial: str, order: str, flag: str, block: int, resamples: int, seed: int) -> DataFrame:
    """Mean and 95 % interval of a proportion over the trials of each group, by moving blocks."""
    known = rows.groupBy(*group).agg(F.avg(flag).alias("mean"))
    return known.join(_interval(resampled(rows, group, trial, order, [flag], block, resamples, seed), group, F.col(flag) / F.col("n")), group)


def paired_blocks(rows: DataFrame, group: list[str], trial: str, order: str, a: str, b: str, block: int, resamples: int, seed: int) -> DataFrame:
    """Mean and 95 % interval of the difference of two models' proportions. Both see the same blocks in every resample, so what they share cancels."""
    known = rows.groupBy(*group).agg((F.avg(a) - F.avg(b)).alias("mean"))
    return known.join(_interval(resampled(rows, group, trial, order, [a, b], block, resamples, seed), group, (F.col(a) - F.col(b)) / F.col("n")), group)


def paired_bootstrap(rows: DataFrame, pair: str, a: str, b: str, resamples: int, seed: int) -> DataFrame:
    """95 % interval of the mean difference a - b over pairs (one a trial), in one row, drawn with replacement.

    The pairs are numbered by name; every task makes the same draws in turn and counts those of its own pairs, so sums
    combine across tasks and no task holds all pairs.
    """
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(pair).alias("_p"), (F.col(a) - F.col(b)).cast("double").alias("_d"))
    numbered = staged(global_rank(known, [], [F.col("_p")], "_i"), "pairs")
    n = numbered.count()

    def run(batches):
        own, diff = [], []
        for pdf in batches:
            own.append(pdf["_i"].to_numpy() - 1)
            diff.append(pdf["_d"].to_numpy())
        if own:
            at, d, rng = np.concatenate(own), np.concatenate(diff), np.random.default_rng(seed)
            for k in range(resamples):
                taken = np.bincount(rng.integers(0, n, n), minlength=n)[at]
                yield pd.DataFrame({"k": [k], "x": [float((taken * d).sum())]})

    drawn = numbered.select("_i", "_d").mapInPandas(run, "k long, x double").groupBy("k").agg((F.sum("x") / n).alias("mean"))
    return drawn.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high")).crossJoin(known.agg(F.avg("_d").alias("mean")))


def verdict(low: Column, high: Column, first: str, second: str) -> Column:
    """Which side an interval of differences favours."""
    return F.when(low > 0, first).when(high < 0, second).otherwise("no clear difference")


def paired(rows: DataFrame, trial: str, model: str, value: str, a: str, b: str) -> DataFrame:
    """Difference of two models by trial; null if either is."""
    pick = lambda m: F.max(F.when(F.col(model) == m, F.col(value)))
    return rows.groupBy(trial).agg(pick(a).alias("a"), pick(b).alias("b")).withColumn("diff", F.col("a") - F.col("b"))
