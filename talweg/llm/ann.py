"""Approximate nearest neighbours by inner product: stable projections in a kd-tree, verified until a chi-square test holds.

Each vector gets one more component that brings it to the largest length, so the largest inner product is the smallest
Euclidean distance. Gaussian (2-stable) projections to a few dimensions keep distances up to a factor whose square follows
a chi-square law. A kd-tree over a bounded sample of projections cuts the space into cells; every row is indexed in the cell
that holds it, cells are dealt out in chunks of bounded size, and each chunk has a kd-tree of its own. A query visits
leaves in the order of projected distance and verifies those of their rows exactly whose projected distance is within its
reach; it stops when a row as near as its k-th best would, by the chi-square law, have had a smaller projected distance
with probability `CONFIDENCE`. It starts in its own
cell; what it finds there bounds the second round over the other cells.

Vectors that are null, zero, of another size than most, or hold null or non-finite components take no part, nor do null
ids. Ties go to the smaller id. A candidate with the query's id is its own row. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Projections, and the share of rows as near as the k-th best that the test lets through; together they give a recall of
#: about 0.95 on vectors without structure (see the README for shares verified and recalls measured).
DIMENSIONS, CONFIDENCE = 24, 0.9
#: Rows that the cells' tree is fitted on, at most.
SAMPLE = 65_536
#: Rows in a chunk and queries in a block, about.
CHUNK, QUERIES = 8192, 2048
LEAF = 128


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection of the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


class Tree:
    """A kd-tree's splits in heap order, and the box of each leaf."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis, self.value = np.zeros(max((1 << depth) - 1, 0), np.int64), np.zeros(max((1 << depth) - 1, 0))
        m = points.shape[1]
        self.low, self.high = np.full((1 << depth, m), -np.inf), np.full((1 << depth, m), np.inf)
        held = {0: (points, np.full(m, -np.inf), np.full(m, np.inf))}
        for node in range(len(self.axis)):
            own, low, high = held.pop(node)
            k = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
            v = float(np.median(own[:, k])) if len(own) else 0.0
            self.axis[node], self.value[node] = k, v
            right = own[:, k] > v
            low_r, high_l = low.copy(), high.copy()
            low_r[k], high_l[k] = max(low[k], v), min(high[k], v)
            held[2 * node + 1], held[2 * node + 2] = (own[~right], low, high_l), (own[right], low_r, high)
        for node, (_, low, high) in held.items():
            leaf = node - len(self.axis)
            self.low[leaf], self.high[leaf] = low, high

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.value[node]
            node = 2 * node + 1 + right
        return node - len(self.axis)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, k] - points[:, k, None], points[:, k, None] - high[None, :, k]), 0)
        out += gap * gap
    return out


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of a chunk by kd-tree leaf: halves at the median of the widest dimension."""
    open_, done = [np.arange(len(points))], []
    while open_:
        own = open_.pop()
        if len(own) <= LEAF:
            done.append(own)
            continue
        p = points[own]
        k = int(np.argmax(p.max(0) - p.min(0)))
        order = np.argpartition(p[:, k], len(own) // 2)
        open_ += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return done


def search_chunk(ids: np.ndarray, rows: np.ndarray, points: np.ndarray, qid: np.ndarray, q: np.ndarray, qp: np.ndarray, floor: np.ndarray, k: int, top: float, quantile: float, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the best rows of a chunk for each query that reach its floor. `tally` gets the number of rows verified.

    Leaves come in the order of their distance; a query is done when the next one is beyond its reach. Within a leaf only
    rows whose own projected distance is within reach are verified.
    """
    leaves = _leaves(points)
    low, high = np.array([points[x].min(0) for x in leaves]), np.array([points[x].max(0) for x in leaves])
    near = box_distance(qp, low, high)
    order = np.argsort(near, 1, kind="stable")
    sorted_near = np.take_along_axis(near, order, 1)
    norm, square, q_square = np.sqrt((q * q).sum(1)), (points * points).sum(1), (qp * qp).sum(1)
    best: list[list[np.ndarray]] = [[np.zeros(0), np.zeros(0, np.int64)] for _ in qid]
    worst = floor.copy()
    live = np.arange(len(qid))
    for step in range(len(leaves)):
        # A score s of a query of length |q| is the squared distance 2 top^2 - 2 top s / |q|, the query brought to length top.
        reach = quantile * np.maximum(2 * top * top - 2 * top * worst[live] / norm[live], 0)
        go = sorted_near[live, step] <= reach
        live, reach = live[go], reach[go]
        if not len(live):
            break
        here = order[live, step]
        for leaf in np.unique(here).tolist():
            mine, own = np.flatnonzero(here == leaf), leaves[leaf]
            for at in range(0, len(mine), 256):
                some = live[mine[at : at + 256]]
                apart = q_square[some, None] + square[own][None] - 2 * qp[some] @ points[own].T
                x, y = np.nonzero((apart <= reach[mine[at : at + 256], None] * (1 + 1e-9) + 1e-9) & (ids[own][None] != qid[some, None]))
                if tally is not None:
                    tally[0] += len(x)
                score, left, right = np.zeros(len(x)), q[some], rows[own]
                for c in range(q.shape[1]):  # in the order of the components, so equal vectors score alike
                    score += left[x, c] * right[y, c]
                hit = np.flatnonzero(score >= worst[some[x]])
                for j, one in zip(*(a.tolist() for a in np.unique(x[hit], return_index=True))):
                    mine_ = hit[one : one + int(np.searchsorted(x[hit][one:], j, "right"))]
                    i = int(some[j])
                    s, v = np.append(best[i][0], score[mine_]), np.append(best[i][1], ids[own][y[mine_]])
                    keep = np.lexsort((v, -s))[:k]
                    best[i] = [s[keep], v[keep]]
                    if len(keep) == k:
                        worst[i] = max(worst[i], s[keep[-1]])
    size = [len(b[0]) for b in best]
    return np.repeat(qid, size), np.concatenate([b[1] for b in best]), np.concatenate([b[0] for b in best])


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    got = column.to_pylist()
    return np.frombuffer(b"".join(got), kind).reshape(len(got), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CHUNK, confidence: float = CONFIDENCE, dimensions: int = DIMENSIONS, ratio: float = 1.0) -> DataFrame:
    """The k nearest rows of each query: query_id, rank (from 1), vec_id, score. With a ratio above 1 the test asks only for rows nearer than the k-th best by that factor, and stops sooner. dimensions: an even number."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("id is not null and v is not null")
    sound = given.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = sound.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("top")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, top = sizes["d"], sizes["n"], math.sqrt(sizes["top"])
    sound = sound.where(F.size("v") == dim)
    quantile = chi_square_quantile(confidence, dimensions) / ratio**2
    project = np.random.default_rng(64).standard_normal((dim + 1, dimensions))

    def projected(v: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(top * top - (v * v).sum(1), 0))
        return v @ project[:-1] + lift[:, None] * project[-1]

    def query_projected(v: np.ndarray) -> np.ndarray:
        return (v * (top / np.sqrt((v * v).sum(1)))[:, None]) @ project[:-1]

    picked = sound.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, SAMPLE / n)))).select("v").limit(SAMPLE).toPandas()["v"]
    sample = np.array(picked.tolist(), float).reshape(len(picked), dim)
    depth = max(0, min(math.ceil(math.log2(max(1, n / cell_rows))), int(math.log2(max(1, len(sample) / 16)))))
    tree = spark.sparkContext.broadcast(Tree(projected(sample), depth))  # at most SAMPLE / 16 cells

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1)
            v = np.array(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, dim)
            cell = tree.value.leaf_of(projected(v))
            home = tree.value.leaf_of(query_projected(v))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(cell, pa.int32()), pa.array(home, pa.int32()), b.column(2)], names=["id", "v", "cell", "home", "is_query"])

    rows = staged(sound.mapInArrow(index, "id long, v binary, cell int, home int, is_query boolean"), "indexed")
    chunks = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))

    def unit(key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        v, q = _matrix(left.column("v")), _matrix(right.column("q"))
        found = search_chunk(left.column("id").to_numpy(), v, projected(v), right.column("query").to_numpy(), q, query_projected(q), right.column("floor").to_numpy(), k, top, quantile)
        return pa.table(dict(zip(empty, map(pa.array, found), strict=True)))

    def visited(queries: DataFrame) -> DataFrame:
        """(id, v, floor, cell) -> what the queries find in those cells."""
        # A cell's rows are copied once for each block of its own visitors, so copies don't grow with the number of queries.
        load = chunks.join(queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("blocks")), "cell")
        units = F.broadcast(spark.createDataFrame(load.collect(), load.schema))  # one row a cell: at most SAMPLE / 16
        each = queries.join(units, "cell").select(F.col("id").alias("query"), F.col("v").alias("q"), "floor", "cell", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("chunk"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        dealt = rows.join(units, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"))
        key = ["cell", "chunk", "block"]
        return dealt.groupBy(*key).cogroup(each.groupBy(*key)).applyInArrow(unit, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = rows.where("is_query").select("id", "v", "home")
    first = staged(visited(queries.select("id", "v", F.lit(float("-inf")).alias("floor"), F.col("home").alias("cell"))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "first-round")
    floor = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    known = queries.join(floor, F.col("id") == F.col("query_id"), "left").select("id", "v", "home", F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")).alias("floor"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, low = _matrix(b.column(1)), b.column(3).to_numpy()
            near = box_distance(query_projected(v), tree.value.low, tree.value.high)
            reach = quantile * np.maximum(2 * top * top - 2 * top * low / np.sqrt((v * v).sum(1)), 0)
            go = near <= reach[:, None]
            go[np.arange(len(v)), b.column(2).to_numpy()] = False
            x, cell = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(x)), b.column(1).take(pa.array(x)), pa.array(low[x]), pa.array(cell, pa.int32())], names=["id", "v", "floor", "cell"])

    second = visited(staged(known.mapInArrow(others, "id long, v binary, floor double, cell int"), "visits"))
    ranked = first.drop("rank").unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
