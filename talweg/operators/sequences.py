"""Windows over ordered records: tumbling windows, splits, alarms, onsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, trial: str, order: list[str]) -> DataFrame:
    """Samples of each trial numbered from 0, with the trial's length."""
    w = Window.partitionBy(trial)
    return df.withColumn("idx", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))


def tumbling(samples: DataFrame, size: int) -> DataFrame:
    """Window number of each sample; the incomplete tail is dropped."""
    return samples.withColumn("win", F.floor(F.col("idx") / size)).where(F.col("win") < F.floor(F.col("n") / size))


def phase(start: Column, end: Column, boundary: Column, faulty: Column) -> Column:
    """P10: healthy, pre_fault, post_fault or transition."""
    return F.when(~faulty, "healthy").when(end <= boundary, "pre_fault").when(start >= boundary, "post_fault").otherwise("transition")


def irregular_step(samples: DataFrame, trial: str, time: str, tolerance: float) -> DataFrame:
    """Of each window whether a step inside it leaves the trial's median step by more than the tolerance."""
    inside = Window.partitionBy(trial, "win").orderBy("idx")
    step = samples.withColumn("_d", F.col(time) - F.lag(time).over(inside))
    usual = step.groupBy(trial).agg(F.percentile("_d", 0.5).alias("_m"))
    return step.join(usual, trial).groupBy(trial, "win").agg(F.coalesce(F.bool_or(F.abs(F.col("_d") - F.col("_m")) > tolerance * F.abs("_m")), F.lit(False)).alias("irregular"))


def temporal_split(wins: DataFrame, trial: str, order: str, shares: dict[str, float], purge: int, least: int = 10) -> DataFrame:
    """Contiguous blocks by cumulated share; `purge` windows after each inner boundary belong to none (null). A trial of which some block has fewer than `least` windows fails the job."""
    w = Window.partitionBy(trial)
    df = wins.withColumn("_k", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    role, total, start, sizes = F.lit(None).cast("string"), 0.0, F.lit(0), []
    for k, (name, share) in enumerate(shares.items()):
        total = round(total + share, 10)
        end = F.floor(F.col("_n") * F.lit(total))
        first = start + (purge if k else 0)
        role = F.when((F.col("_k") >= first) & (F.col("_k") < end), name).otherwise(role)
        sizes.append(end - first)
        start = end
    # greatest and least skip nulls, so one size alone is taken as it is.
    short = (F.least(*sizes) if len(sizes) > 1 else sizes[0]) < least
    refused = F.raise_error(F.concat(F.lit(f"a block of fewer than {least} windows in trial "), F.col(trial).cast("string"))).cast("string")
    return df.withColumn("role", F.when(short, refused).otherwise(role)).drop("_k", "_n")


def padded_sequences(wins: DataFrame, per: list[str], order: str, value: str, length: int) -> DataFrame:
    """The last `length` values up to each window, the block's first one repeated on the left."""
    w = Window.partitionBy(*per).orderBy(order)
    seen = F.collect_list(value).over(w.rowsBetween(-(length - 1), 0))
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return wins.withColumn("sequence", F.concat(F.array_repeat(first, F.lit(length) - F.size(seen)), seen))


def alarm_starts(flags: DataFrame, per: list[str], order: str, flag: str, m: int) -> DataFrame:
    """Places where a run of true reaches exactly m. Runs restart with each group, so give the segment as part of it."""
    w = Window.partitionBy(*per).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*per, flag).orderBy(order))
    runs = flags.withColumn("_i", island).where(F.col(flag))
    return runs.withColumn("_r", F.row_number().over(Window.partitionBy(*per, "_i").orderBy(order))).where(F.col("_r") == m).drop("_i", "_r")


def commissioning(wins: DataFrame, trial: str, order: str, least: int) -> DataFrame:
    """Of the pre-fault windows the first max(least, half) are the baseline, the others the pre-test."""
    pre = Window.partitionBy(trial, "phase")
    k, n = F.row_number().over(pre.orderBy(order)), F.count(F.lit(1)).over(pre)
    segment = F.when(F.col("phase") == "pre_fault", F.when(k <= F.greatest(F.lit(least), F.floor(n / 2)), "commissioning").otherwise("pre_test")).when(F.col("phase") == "transition", "transition").when(F.col("phase") == "post_fault", "post_fault").otherwise("healthy")
    return wins.withColumn("segment", segment)


def nominal_onset(wins: DataFrame, trial: str, order: str) -> DataFrame:
    """The first transition window, else the first post-fault one."""
    return wins.groupBy(trial).agg(F.coalesce(F.min(F.when(F.col("phase") == "transition", F.col(order))), F.min(F.when(F.col("phase") == "post_fault", F.col(order)))).alias("onset"))


def relabel(wins: DataFrame, onsets: DataFrame, trial: str, order: str) -> DataFrame:
    """Windows between the nominal and a clearly observed onset become transition."""
    o = onsets.select(trial, "onset", "observed", "clear")
    between = F.col("clear") & (F.col(order) >= F.least("onset", "observed")) & (F.col(order) < F.greatest("onset", "observed"))
    return wins.join(o, trial, "left").withColumn("phase", F.when(F.coalesce(between, F.lit(False)), "transition").otherwise(F.col("phase"))).drop("onset", "observed", "clear")


def delay_ms(onset: Column, alarm: Column, boundary: Column, size: int, rate: float) -> Column:
    """Milliseconds from the boundary sample to the end of the window that raised the alarm."""
    return ((onset + alarm + 1) * size - boundary) / rate * 1000
