"""Mixing sources to target weights by iterative proportional fitting.

The token counts of the cells source x language x topic are raked until the margins of what is kept have the target shares:
each pass scales the cells of every value of a margin by its goal over what the cells now keep. A cell keeps a share of its
tokens, 1 at most, so the capped cells take part in the raking and the others make up for them; that share is the
probability with which its documents are kept. A document's draw is a hash of its id and text, so it is the same in every
run and on every partition. A value whose goal exceeds all its tokens keeps them all and falls short: `mixture` reports
target and expected share of every value.

Targets are given as shares by value (those without a share get none, and shares are scaled to sum to one); for a margin
without targets each value aims at its observed share to the power `TEMPER`, so small values gain.

Nulls: a null text has no token, a null source or language is a value of its own, a null topic as well. Repeated rows are
drawn alike. An empty table gives an empty result. Input columns keep their values whatever their names.

The cells are few next to the documents. Up to `max_cells` they are raked in the driver's memory, beyond that by the same
passes as joins and aggregations. Sums may then differ in their last digits, so probabilities are rounded to `DIGITS`
decimals; a cell whose probability lies on the border of two roundings may still differ by one unit of the last.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

MAX_CELLS = 50_000
MARGINS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
PASSES, TOLERANCE, DIGITS = 500, 1e-10, 6
#: A cell's factor isn't raised beyond this: a value that can't reach its goal keeps all it has.
MOST = 1e9
Targets = Mapping[str, Mapping[str | None, float]]


def topic(text: Column) -> Column:
    """A coarse topic from the form of the whole text (a default; give your own as `kind`)."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(" | "), "table").when(t.rlike("(?i)licen[sc]e"), "legal").when(t.rlike("[0-9]{5,}|@"), "records").otherwise("prose")


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("\\S+")).cast("long")


def _goals(cells: DataFrame, keep: float, targets: Targets | None) -> dict[str, DataFrame]:
    """value, goal (tokens to keep) of each margin, staged."""
    out = {}
    for name in MARGINS:
        seen = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("seen"))
        given = (targets or {}).get(name)
        if given is None:
            wanted = seen.withColumn("raw", F.when(F.col("seen") > 0, F.pow(F.col("seen").cast("double"), F.lit(TEMPER[name]))).otherwise(0.0))
        else:
            share = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "want string, share double")
            wanted = seen.join(F.broadcast(share), F.col("value").cast("string").eqNullSafe(F.col("want")), "left").select("value", "seen", F.coalesce("share", F.lit(0.0)).alias("raw"))
        wanted = staged(wanted, "mix-targets")
        total, raw = wanted.agg(F.sum("seen"), F.sum("raw")).first()
        out[name] = wanted.select("value", (F.col("raw") * (keep * (total or 0) / raw if raw else 0.0)).alias("goal"))
    return out


def rake(have: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], keep: float, passes: int = PASSES, tolerance: float = TOLERANCE) -> np.ndarray:
    """The share that each cell keeps of its tokens. margins: the value of each cell and the goal of each value."""
    q = np.full(len(have), float(keep))
    for _ in range(passes):
        before = np.minimum(q, 1)
        for index, goal in margins:
            now = np.bincount(index, have * np.minimum(q, 1), minlength=len(goal))
            q = np.minimum(q * np.divide(goal, now, out=np.ones_like(goal), where=now > 0)[index], MOST)
        if np.abs(np.minimum(q, 1) - before).max(initial=0) < tolerance:
            break
    return np.minimum(q, 1)


def _rake_on_spark(cells: DataFrame, goals: dict[str, DataFrame], keep: float, passes: int, tolerance: float) -> DataFrame:
    """The same passes where the cells are too many for the driver."""
    cells = staged(cells.withColumn("q", F.lit(float(keep))), "cells")
    kept = F.least("q", F.lit(1.0))
    for _ in range(passes):
        old = cells.withColumn("before", kept)
        for name in MARGINS:
            now = old.groupBy(F.col(name).alias("v")).agg(F.sum(F.col("tokens") * kept).alias("now"))
            factor = now.join(goals[name], F.col("v").eqNullSafe(F.col("value"))).select("v", F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0).alias("f"))
            old = old.join(staged(factor, "factors"), F.col(name).eqNullSafe(F.col("v"))).withColumn("q", F.least(F.col("q") * F.col("f"), F.lit(MOST))).drop("v", "f")
        old = staged(old, "cells")
        cells = old.drop("before")
        if (old.agg(F.max(F.abs(kept - F.col("before")))).first()[0] or 0.0) < tolerance:
            break
    return cells.withColumn("probability", kept).drop("q")


def probabilities(described: DataFrame, keep: float, targets: Targets | None = None, passes: int = PASSES, tolerance: float = TOLERANCE, max_cells: int = MAX_CELLS) -> DataFrame:
    """source, lang, topic, tokens, weight (tokens expected to be kept) and probability of each cell of rows with n_tokens. Staged or local."""
    spark = described.sparkSession
    cells = staged(described.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    goals = _goals(cells, keep, targets)
    if cells.count() <= max_cells:
        found = sorted(cells.collect(), key=lambda r: [(v is not None, v or "") for v in r[:3]])
        margins = []
        for k, name in enumerate(MARGINS):
            goal = {r["value"]: r["goal"] for r in goals[name].collect()}
            place = {v: i for i, v in enumerate(goal)}
            margins.append((np.array([place[r[k]] for r in found], np.int64), np.array([*goal.values()], float)))
        p = rake(np.array([r["tokens"] for r in found], float), margins, keep, passes, tolerance)
        raked = spark.createDataFrame([(*r, float(x)) for r, x in zip(found, p)], cells.schema.add("probability", "double"))
    else:
        raked = _rake_on_spark(cells, goals, keep, passes, tolerance)
    p = F.round("probability", DIGITS)
    return raked.select(*MARGINS, "tokens", (F.col("tokens") * p).alias("weight"), p.alias("probability"))


def mixture(docs: DataFrame, keep: float = 0.5, kind: Column | None = None, targets: Targets | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """margin, value, tokens, target and expected (shares of what is kept) of every value."""
    described = _described(docs, kind)
    goals = _goals(staged(described.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells"), keep, targets)
    cells = staged(probabilities(described, keep, targets, max_cells=max_cells), "raked")
    out = []
    for name in MARGINS:
        got = cells.groupBy(F.col(name).alias("v")).agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("kept"))
        all_ = cells.agg(F.sum("weight")).first()[0] or 1.0
        aim = goals[name].agg(F.sum("goal")).first()[0] or 1.0
        out.append(got.join(goals[name], F.col("v").eqNullSafe(F.col("value"))).select(F.lit(name).alias("margin"), F.col("v").cast("string").alias("value"), "tokens", (F.col("goal") / aim).alias("target"), (F.col("kept") / all_).alias("expected")))
    return out[0].union(out[1]).union(out[2])


def _described(docs: DataFrame, kind: Column | None) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens of each row."""
    return docs.select("doc_id", "source", "lang", (kind if kind is not None else topic(F.col("text"))).alias("topic"), tokens(F.col("text")).alias("n_tokens"))


def draw(id_: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) by the row's id and text."""
    return F.xxhash64(id_, text, F.lit(seed)).bitwiseAND((1 << 53) - 1) / float(1 << 53)


def _drawn(docs: DataFrame, extra: list[Column], keep: float, kind: Column | None, targets: Targets | None, seed: int, max_cells: int) -> DataFrame:
    """own (source, lang, topic, n_tokens), cell (weight, probability, ...), kept, and the columns `extra` of each row."""
    cells = probabilities(_described(docs, kind), keep, targets, max_cells=max_cells)
    few = cells.count() <= max_cells
    own = F.struct("source", "lang", (kind if kind is not None else topic(F.col("text"))).alias("topic"), tokens(F.col("text")).alias("n_tokens")).alias("own")
    rows = docs.select(*extra, own, draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    cells = cells.select(F.struct("*").alias("cell"))
    same = F.lit(True)
    for name in MARGINS:
        same &= F.col("own").getField(name).eqNullSafe(F.col("cell").getField(name))
    return rows.join(F.broadcast(cells) if few else cells, same).withColumn("kept", F.col("draw") < F.col("cell.probability"))


def mix(docs: DataFrame, keep: float = 0.5, kind: Column | None = None, targets: Targets | None = None, seed: int = 7, max_cells: int = MAX_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (of the cell), probability, kept of every document."""
    rows = _drawn(docs, [F.col("doc_id")], keep, kind, targets, seed, max_cells)
    return rows.select("doc_id", "own.source", "own.lang", "own.topic", "own.n_tokens", "cell.weight", "cell.probability", "kept")


def sample(docs: DataFrame, keep: float = 0.5, kind: Column | None = None, targets: Targets | None = None, seed: int = 7, max_cells: int = MAX_CELLS) -> DataFrame:
    """The documents drawn, with all their columns."""
    return _drawn(docs, [F.struct("*").alias("doc")], keep, kind, targets, seed, max_cells).where("kept").select("doc.*")
