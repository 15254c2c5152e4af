"""Ranks, fusion, diversity and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged


def sequence_rank(df: DataFrame, order: list[Column], name: str, per: list[str] | None = None) -> DataFrame:
    """1, 2, 3 ... within each group. The order must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(per or [])).orderBy(*order)))


def prefix_sums(rows: DataFrame, per: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Of each row the sums over the rows before it in its group, whatever the group's size. The order must be total.

    The rows are dealt out by ranges of group and order, summed within each range, and what the ranges before it hold is
    added: no task sees more than a range, and only the ranges' totals (one row a range and group) are ordered again.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.withColumns({f"_v_{k}": v for k, v in sums.items()})
    dealt = staged(asked.repartitionByRange(n, *per, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*per, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*[f"_g{k}" for k in range(len(per))]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*per, "_range").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    totals = totals.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(per)], F.col("_range").alias("_r"), *[f"_t_{k}" for k in sums])
    totals = totals.select(*[f"_g{k}" for k in range(len(per))], "_r", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums])
    same = F.col("_range") == F.col("_r")
    for k, g in enumerate(per):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    summed = dealt.withColumns({f"_b_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums}).join(totals, same)
    return summed.select(*rows.columns, *[(F.col(f"_b_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums])


def global_rank(rows: DataFrame, per: list[str], order: list[Column], name: str) -> DataFrame:
    """1, 2, 3 ... within groups of any size. The order must be total."""
    return prefix_sums(rows, per, order, {name: F.lit(1)}).withColumn(name, F.col(name) + 1)


def best_place(value: str, per: list[str]) -> Column:
    """Equal values share the best place (1, 1, 3), largest first."""
    return F.rank().over(Window.partitionBy(*per).orderBy(F.desc(value)))


def average_rank(value: str, per: list[str]) -> Column:
    """Equal values share the mean of their places, smallest first."""
    w = Window.partitionBy(*per)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*per, value)) - 1) / 2.0


def fuse(ranks: list[tuple[DataFrame, str, float]], key: list[str], base: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (frame, rank column, weight): the sum of weight / (base + rank)."""
    parts = [df.select(*key, (F.lit(w) / (base + F.col(r))).alias("_s")) for df, r, w in ranks]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*key).agg(F.sum("_s").alias("score"))


def diverse(ranked: DataFrame, group: str, rank: str, limit: int, cap: Column, per: list[str] | None = None) -> DataFrame:
    """At most `cap` of each group by rank; if that leaves places, those passed over fill them, in the end sorted by rank."""
    per = per or []
    eligible = F.row_number().over(Window.partitionBy(*per, group).orderBy(rank)) <= cap
    chosen = ranked.withColumn("_e", eligible).withColumn("_p", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("_e"), rank))).where(F.col("_p") <= limit)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(rank))).drop("_e", "_p")


def capped(rows: DataFrame, group: str, order: list[Column], cap: int, limit: int, per: list[str]) -> DataFrame:
    """W11 over groups of any size: as `diverse` with a cap of few rows, but only the first `limit` of a group and of the whole are ever gathered."""
    lead = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*per, group).orderBy(*order))).where(F.col("_k") <= cap + limit)
    picked = lead.withColumn("_p", F.row_number().over(Window.partitionBy(*per).orderBy(F.col("_k") > cap, *order))).where(F.col("_p") <= limit)
    return picked.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).drop("_k", "_p")


def ranked_places(rows: DataFrame, per: list[str], place: str, rank: str, most: int) -> DataFrame:
    """The first `most` distinct places of each group, best first."""
    best = rows.groupBy(*per, place).agg(F.min(rank).alias("_f"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy("_f"))).where(F.col("place") <= most).drop("_f")


def search_units(hits: DataFrame, plan: str, unit: str, item: str, group: str, rank: str, score: str, sources: int, limit: int) -> DataFrame:
    """Each unit's hits with its sources spread (W15), the units interleaved (W14), and each unit's place by the second score.

    hits are the units' bounded result lists.
    """
    spread = spread_sources(hits, group, rank, sources, [unit]).withColumnRenamed("place", "_spread")
    again = spread.withColumn("reranked", F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(score), item)))
    first = again.groupBy(plan, item).agg(F.min(F.struct(F.col("_spread"), F.col(unit), F.col("reranked"))).alias("_f"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(plan).orderBy("_f._spread", f"_f.{unit}", item))).where(F.col("place") <= limit)
    return placed.select(plan, F.col(f"_f.{unit}").alias(unit), item, "place", F.col("_f.reranked").alias("reranked"))


def most_similar(rows: DataFrame, per: list[str], similarity: str, tie: str, least: float, most: int) -> DataFrame:
    """Rows of at least that similarity, best first and then by `tie`, `most` of each group."""
    near = rows.where(F.col(similarity) >= least)
    return near.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc(similarity), tie))).where(F.col("place") <= most)


def relevant_notes(notes: DataFrame, queries: DataFrame, near: DataFrame, query: str, key: str, kind: str, similarity: str, profile: int = 15, preference: int = 10, others: int = 8, least: float = 0.30) -> DataFrame:
    """(query, key, kind): per query the newest profile and preference notes, and of the others the most similar ones of at least `least`; where none is, the most recent. A query's own key is no note of its own.

    notes: (key, kind), the newer the greater the key; queries: (query); near: (query, key, similarity) of notes of other kinds, at
    least the best ones of each query. Which notes are the newest depends on the query by its own key only, so no pairs are formed for them.
    """
    group = F.when(F.col(kind).isin("profile", "preference"), F.col(kind)).otherwise("")
    most = F.when(F.col("_g") == "profile", profile).when(F.col("_g") == "preference", preference).otherwise(others)
    newest = notes.select(key, kind, group.alias("_g")).withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(F.desc(key)))).where(F.col("_n") <= max(profile, preference, others) + 1)
    pairs = queries.select(query).crossJoin(F.broadcast(newest.drop("_n"))).where(F.col(query) != F.col(key))  # the newest of three groups
    recent = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(query, "_g").orderBy(F.desc(key)))).where(F.col("_r") <= most)
    best = near.where(F.col(similarity) >= least).withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(similarity), F.desc(key)))).where(F.col("_r") <= others)
    best = staged(best.select(query, key), "nearest")  # `others` rows a query
    without = recent.where("_g = ''").join(best.select(query).distinct(), query, "left_anti")
    out = recent.where("_g <> ''").unionByName(without).select(query, key, kind)
    return out.unionByName(best.join(notes.select(key, kind), key).select(query, key, kind))


def group_best(ranked: DataFrame, group: str, rank: str, score: str, pool: int, each: int, per: list[str]) -> DataFrame:
    """Of the first `pool` candidates at most `each` of a group count, by their best score; ties go to the earlier one."""
    taken = ranked.where(F.col(rank) <= pool).withColumn("_k", F.row_number().over(Window.partitionBy(*per, group).orderBy(rank))).where(F.col("_k") <= each)
    best = taken.groupBy(*per, group).agg(F.max(score).alias("best_score"), F.min(rank).alias("first_rank"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("best_score"), "first_rank")))


def interleave(lists: DataFrame, list_no: str, rank: str, item: str, limit: int, per: list[str]) -> DataFrame:
    """W14, U-S1: round robin over ranked lists, each item once, at its first turn."""
    first = lists.groupBy(*per, item).agg(F.min(F.struct(rank, list_no)).alias("_f"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy("_f", item))).where(F.col("place") <= limit).drop("_f")


def spread_sources(hits: DataFrame, group: str, rank: str, sources: int, per: list[str]) -> DataFrame:
    """First the best hit of each of the first `sources` documents, then the rest by rank."""
    lead = F.min(rank).over(Window.partitionBy(*per, group))
    seen = hits.withColumn("_lead", lead).withColumn("_doc", F.dense_rank().over(Window.partitionBy(*per).orderBy("_lead")))
    front = (F.col(rank) == F.col("_lead")) & (F.col("_doc") <= sources)
    return seen.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(F.when(front, 0).otherwise(1), rank))).drop("_lead", "_doc")


def page_cost(text: Column) -> Column:
    """Tokens that a page of text costs."""
    return F.lit(15) + F.ceil(F.length(text) / 3)


def share_budget(asks: DataFrame, order: list[str], want: str, floor: str, budget: int, cap_share: float, per: list[str]) -> DataFrame:
    """Pinned asks get all they want first; then each gets its floor, then more up to its cap, then the rest, each pass in order while the budget lasts. Needs a boolean column `pinned`."""
    cap = F.lit(int(budget * cap_share))
    second = F.when(~F.col("pinned"), F.least(F.col(floor), F.col(want))).otherwise(0)
    third = F.when(~F.col("pinned"), F.greatest(F.least(F.col(want), cap) - second, F.lit(0))).otherwise(0)
    steps = [F.when(F.col("pinned"), F.col(want)).otherwise(0), second, third, F.when(~F.col("pinned"), F.col(want) - second - third).otherwise(0)]
    # What a step asks for doesn't depend on what was granted, so one pass gives all sums before each row; what is left for
    # a step follows from the steps' totals alone.
    total = asks.groupBy(*[F.col(g).alias(f"_p{k}") for k, g in enumerate(per)]).agg(*[F.sum(x).alias(f"_t{k}") for k, x in enumerate(steps)])
    before = prefix_sums(asks, per, [F.col(c) for c in order], {f"_b{k}": x for k, x in enumerate(steps)})
    same = F.lit(True)
    for k, g in enumerate(per):
        same &= F.col(g).eqNullSafe(F.col(f"_p{k}"))
    joined, spent, granted = before.join(total, same), F.lit(0), F.lit(0)
    for k, ask in enumerate(steps):
        granted = granted + F.greatest(F.least(ask, F.lit(budget) - spent - F.col(f"_b{k}")), F.lit(0))
        spent = F.least(spent + F.col(f"_t{k}"), F.lit(budget))
    return joined.select(*asks.columns, granted.alias("granted"))


def recent_within(rows: DataFrame, per: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """From the newest back while the running size stays within the budget."""
    run = Window.partitionBy(*per).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(run)).where(F.col("running") <= budget)


def page_ranges(pages: DataFrame, per: list[str], page: str) -> DataFrame:
    """Consecutive pages as intervals."""
    island = F.col(page) - F.row_number().over(Window.partitionBy(*per).orderBy(page))
    return pages.select(*per, page).distinct().withColumn("_i", island).groupBy(*per, "_i").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page")).drop("_i")
