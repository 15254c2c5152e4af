"""Exact order statistics of groups of any size (K04, A15, A23): counting passes over narrowing bins, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged

#: Rows of a group that may be sorted in one place; beyond it, bins are counted until so few are left. The result is the same.
KEEP = 65_536
#: Bins of a pass, and targets that are sent to all tasks (their number is counted first).
BINS, FEW = 1024, 100_000


def _magnitude(x: Column) -> Column:
    """A whole number that grows with x, one for each sign and power of two; at most some 4300 of them. NaN is the largest."""
    size = F.when(F.abs(x) == float("inf"), F.lit(2100)).otherwise(F.floor(F.log2(F.abs(x))) + 1076)
    return F.when(F.isnan(x), F.lit(3000)).when(x == 0, F.lit(0)).otherwise(F.signum(x) * size).cast("int")


def select(rows: DataFrame, per: list[str], value: str, ranks: DataFrame, keep: int = KEEP) -> DataFrame:
    """(per, rank, value): the values at the given ranks (from 0) of each group. ranks: per, rank, n (rows of the group).

    The first pass counts values by power of two, later ones in 1024 even bins between the least and the largest value that
    are left, so a double's 52 bits are used up after six of them whatever the distribution. Ties end a search at once.
    rows: values that aren't null. Groups are compared by eqNullSafe.
    """
    narrow = staged(rows.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(per)], F.col(value).cast("double").alias("_x")), "values")
    keys = [f"_g{i}" for i in range(len(per))]
    targets = staged(ranks.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(per)], F.col("rank").cast("long").alias("_rank"), F.col("n").cast("long").alias("_n"), F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi"), F.lit(0).cast("long").alias("_before")), "targets")
    tags = [f"_k{i}" for i in range(len(per))]

    def met(asked: DataFrame) -> DataFrame:
        same = F.lit(True)
        for g, k in zip(keys, tags):
            same &= F.col(g).eqNullSafe(F.col(k))
        inside = F.col("_lo").isNull() | F.col("_x").between(F.col("_lo"), F.col("_hi"))
        return narrow.join(F.broadcast(asked) if asked.count() <= FEW else asked, same & inside)

    large, first = (F.col("_n") > keep) & (F.col("_lo").isNull() | ~F.col("_lo").eqNullSafe(F.col("_hi"))), True
    while targets.where(large).limit(1).count():
        found = met(targets.where(large))
        share = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        place = _magnitude(F.col("_x")) if first else F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
        bins = found.groupBy(*tags, "_rank", "_before", place.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*tags, "_rank").orderBy("_bin"))
        hit = bins.withColumn("_upto", F.col("_before") + upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        closer = hit.select(*tags, "_rank", "_n", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_before"))
        targets, first = staged(targets.where(~large).unionByName(closer), "targets"), False
    tied = F.col("_lo").isNotNull() & F.col("_lo").eqNullSafe(F.col("_hi"))
    order = F.row_number().over(Window.partitionBy(*tags, "_rank").orderBy("_x"))
    sorted_ = met(targets.where(~tied)).withColumn("_at", order + F.col("_before") - 1).where(F.col("_at") == F.col("_rank")).select(*tags, "_rank", "_x")
    whole = sorted_.unionByName(targets.where(tied).select(*tags, "_rank", F.col("_lo").alias("_x")))
    return whole.select(*[F.col(k).alias(c) for k, c in zip(tags, per)], F.col("_rank").alias("rank"), F.col("_x").alias(value))


def order_statistic(rows: DataFrame, per: list[str], value: str, percent: float, keep: int = KEEP) -> DataFrame:
    """(per, n, at, threshold): the value at ascending index ceil((n - 1) * percent / 100) of each group."""
    some = rows.where(F.col(value).isNotNull())
    sizes = some.groupBy(*per).agg(F.count(F.lit(1)).alias("n")).where("n > 0").withColumn("rank", F.ceil((F.col("n") - 1) * (percent / 100)).cast("long"))
    sizes = staged(sizes, "group-sizes")
    at = select(some, per, value, sizes, keep).select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(per)], F.col("rank").alias("at"), F.col(value).alias("threshold"))
    same = F.lit(True)
    for i, c in enumerate(per):
        same &= F.col(c).eqNullSafe(F.col(f"_s{i}"))
    return sizes.join(at, same & (F.col("rank") == F.col("at"))).select(*per, "n", "at", "threshold")


def quantiles(rows: DataFrame, per: list[str], value: str, shares: tuple[float, ...], keep: int = KEEP) -> DataFrame:
    """(per, q): an array of the quantiles, interpolated linearly between the two nearest ranks."""
    some = rows.where(F.col(value).isNotNull())
    sizes = some.groupBy(*per).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    place = lambda s: (F.col("n") - 1) * F.lit(float(s))
    wanted = F.array_distinct(F.array(*[f(place(s)).cast("long") for s in shares for f in (F.floor, F.ceil)]))
    sizes = staged(sizes.withColumn("_w", wanted), "group-sizes")
    got = select(some, per, value, sizes.select(*per, "n", F.explode("_w").alias("rank")), keep)
    held = got.groupBy(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(per)]).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("_m"))  # as many as shares ask for
    same = F.lit(True)
    for i, c in enumerate(per):
        same &= F.col(c).eqNullSafe(F.col(f"_s{i}"))
    both = sizes.join(held, same)

    def one(s: float) -> Column:
        low, high = F.element_at("_m", F.floor(place(s)).cast("long")), F.element_at("_m", F.ceil(place(s)).cast("long"))
        return low + (high - low) * (place(s) - F.floor(place(s)))

    return both.select(*per, F.array(*map(one, shares)).alias("q"))
