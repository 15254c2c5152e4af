"""Fusion of whole lists without ranking them whole (F10, K01, P03, W01-W03): a threshold stop, and ranks by counting.

A row's fused score is a sum of weight / (60 + rank) over the lists that hold it. Only the first rows of each list are
gathered as candidates. A candidate's rank in a list where it stands further down is one more than the number of rows
before it, which each task counts for itself. A row that is in no list's first R has at most the sum of weight / (61 + R);
candidates above that are the fused order's beginning, whatever is left. If they aren't enough, R grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from .retrieval import BASE, GATE, MEANING, NAMED, WORDS

#: Rows of each list that are gathered first, by how much that grows, and candidates that are counted at once.
FIRST, GROWTH, AT_ONCE = 256, 8, 1 << 20
WEIGHTS = (MEANING, WORDS, NAMED)


def _before(rows: DataFrame, deep: DataFrame) -> DataFrame:
    """(query, key, list, ahead): of each candidate the rows of its list that come before it. rows and deep: query, list, key, by; keys are whole numbers."""
    spark, out = rows.sparkSession, None
    blocks = -(-deep.count() // AT_ONCE)
    for n in range(blocks):
        some = deep.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).orderBy("query", "list", F.desc("by"), "key").toPandas()  # AT_ONCE rows, about
        names = {g: (p["by"].to_numpy(), p["key"].to_numpy()) for g, p in some.groupby(["query", "list"])}
        if not names:
            continue
        shared = spark.sparkContext.broadcast(names)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            totals: dict = {g: np.zeros(len(by) + 1, np.int64) for g, (by, _) in shared.value.items()}
            for b in batches:
                frame = b.to_pandas()
                for g, p in frame.groupby(["query", "list"]):
                    if g not in totals:
                        continue
                    by, key = shared.value[g]
                    x, own = p["by"].to_numpy(), p["key"].to_numpy()
                    # The first candidate that comes after the row: of those with its score, by key.
                    at, to = np.searchsorted(-by, -x, "left"), np.searchsorted(-by, -x, "right")
                    for i in np.flatnonzero(to > at).tolist():
                        at[i] += np.searchsorted(key[at[i] : to[i]], own[i], "right")
                    totals[g] += np.bincount(at, minlength=len(by) + 1)
            for (query, name), n_ in totals.items():
                some_ = np.flatnonzero(n_[:-1])
                key = shared.value[query, name][1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some_), query)), pa.array(np.full(len(some_), name), pa.int32()), pa.array(key[some_]), pa.array(n_[some_])], names=["query", "list", "key", "n"])

        part = rows.mapInArrow(count, "query long, list int, key long, n long").groupBy("query", "list", "key").agg(F.sum("n").alias("n"))
        out = part if out is None else out.unionByName(part)
    upto = Window.partitionBy("query", "list").orderBy(F.desc("by"), "key")
    if out is None:
        return deep.select("query", "list", "key", F.lit(0).cast("long").alias("ahead"))
    return deep.join(out, ["query", "list", "key"], "left").select("query", "list", "key", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("ahead"))  # candidates only


def best(similar: DataFrame, lexical: DataFrame, named: DataFrame, need: int, cap: int | None = None, gate: float = GATE, first: int = FIRST, digits: int = 9) -> DataFrame:
    """(query, key, group, score, similarity) of the first candidates of each question by (score, key): `need` of them at least, or all; with `cap`, that many although only the first `cap` of a group count.

    similar: query, key, group, by (similarity of every chunk); lexical: the same with BM25; named: (query, group) of what a
    question names, a small table; its list is ordered by similarity. A chunk needs a lexical or a named rank, or `gate` in similarity.
    """
    columns = ["query", "key", "group", "by"]
    # A question names few groups: the pairs are of the stated workload, so they're sent to all tasks.
    by_name = similar.join(F.broadcast(named.select("query", "group").distinct()), ["query", "group"])
    lists = [x.select(*columns, F.lit(i).alias("list")) for i, x in enumerate((similar, lexical, by_name))]
    whole = lists[0].unionByName(lists[1]).unionByName(lists[2])
    order = Window.partitionBy("query", "list").orderBy(F.desc("by"), "key")
    weight = F.when(F.col("list") == 0, WEIGHTS[0]).when(F.col("list") == 1, WEIGHTS[1]).otherwise(WEIGHTS[2])
    while True:
        top = staged(whole.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first), "first-of-lists")
        names = top.select("query", "key").distinct()
        known = staged(whole.join(F.broadcast(names), ["query", "key"], "left_semi").select("query", "key", "group", "list", "by"), "candidates")  # 3 x first a question
        ranked = known.join(top.select("query", "key", "list", "place"), ["query", "key", "list"], "left")
        deep = staged(ranked.where("place is null").select("query", "list", "key", "by"), "deep")
        ahead = _before(whole.select("query", "list", "key", "by"), deep)
        placed = ranked.join(ahead, ["query", "list", "key"], "left").withColumn("place", F.coalesce("place", F.col("ahead") + 1))
        fused = placed.groupBy("query", "key", "group").agg(F.round(F.sum(weight / (BASE + F.col("place"))), digits).alias("score"), F.max(F.when(F.col("list") == 0, F.col("by"))).alias("similarity"), F.max("list").alias("_l"))
        fused = fused.where((F.col("_l") > 0) | (F.col("similarity") >= gate)).drop("_l")
        # What no list has shown yet can't exceed this, for lists that go on.
        left = top.groupBy("query", "list").agg(F.max("place").alias("shown")).where(F.col("shown") >= first).groupBy("query").agg(F.sum(weight / (BASE + first + 1)).alias("unseen"))
        sure = staged(fused.join(left, "query", "left").where(F.col("unseen").isNull() | (F.col("score") > F.col("unseen") + 10.0**-digits)), "sure")
        counted = sure.withColumn("k", F.row_number().over(Window.partitionBy("query", "group").orderBy(F.desc("score"), "key")))
        enough = counted.groupBy("query").agg(F.count_if(F.col("k") <= (cap or 1 << 30)).alias("n"))
        open_ = left.join(enough, "query", "left").where(F.coalesce("n", F.lit(0)) < need)
        if not open_.limit(1).count():
            return sure.drop("unseen")
        first *= GROWTH
