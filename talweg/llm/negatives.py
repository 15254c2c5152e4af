"""Hard negatives by a distributed nearest-neighbour join over a Voronoi partition.

Each row gets one more component that brings it to the largest length, and each anchor is brought to that length, so a
larger inner product is a smaller distance. A bounded sample of rows are the pivots; every row and every anchor belongs to
the cell of its nearest pivot, and every row keeps its distance to it. Cells near each other are regions, of which there are
no more than a group of anchors each needs. Anchors first meet the rows of their own region; what they find bounds how far
a row may be that could still serve them. By the triangle inequality and the planes between
pivots those bounds become, for each group of anchors and each cell, an interval of distances to the cell's pivot; a row is
copied only to the groups whose interval holds it, and compared there exactly, in integers. Two such joins run: the first
finds each anchor's positives (best rows of its label), the second the best rows of other labels between two shares of
each positive's score. The rows that a group gets are dealt out in chunks, so no hot cell meets in one task.

Rows with a null id or label, a null or empty vector, any null or non-finite component, or another size than most take no
part. Rows of an anchor's id are the anchor itself and none of its finds; where several rows have that id, the one of the
least label and then the least bytes is the anchor. Of rows that repeat an id otherwise each is a row of its own. Ties go to the smaller id. Scores must fit a long: components are refused where the sum
of their products might not. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows a cell holds about, and the most cells. The pivots' matrix and its distances are sent to every task.
CELL_ROWS, MOST_CELLS = 2048, 128
#: Rows in a chunk; anchors that a group is made for, and groups at most besides one a region and label bucket.
CHUNK, GROUP, MOST_GROUPS, LABEL_BUCKETS = 8192, 1024, 1024, 8
#: Widening of every bound against rounding, as a share of the largest length.
SLACK = 1e-9


class Pivots:
    """The pivots (lifted), their distances, and where rows and anchors lie."""

    def __init__(self, sample: np.ndarray, top2: float) -> None:
        self.top2 = top2
        self.points = self.lifted(sample)
        self.apart = np.sqrt(np.maximum(((self.points[:, None] - self.points[None]) ** 2).sum(2), 0))

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.top2 - (v * v).sum(1), 0))])

    def stretched(self, v: np.ndarray) -> np.ndarray:
        """Anchors brought to the largest length; a zero vector stays."""
        n2 = (v * v).sum(1)
        return np.column_stack([v * np.sqrt(self.top2 / np.where(n2 > 0, n2, 1))[:, None], np.zeros(len(v))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        square = (points * points).sum(1)[:, None] + (self.points * self.points).sum(1)[None] - 2 * points @ self.points.T
        return np.sqrt(np.maximum(square, 0))

    def reach(self, v: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of a row of that score from each anchor; a score of -inf is any distance, inf is none."""
        n = np.sqrt((v * v).sum(1))
        with np.errstate(invalid="ignore", over="ignore"):
            square = 2 * self.top2 - 2 * np.sqrt(self.top2) / np.where(n > 0, n, 1) * score
        square = np.where(n > 0, square, np.where(np.isneginf(score), np.inf, self.top2))
        return np.sqrt(np.maximum(square, 0))


def intervals(pivots: Pivots, v: np.ndarray, low: np.ndarray, high: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and cell, which distances to the cell's pivot a row with a score of low to high can have (inf, -inf: none)."""
    q = pivots.stretched(v)
    to = pivots.distances(q)
    slack = SLACK * math.sqrt(pivots.top2) + 1e-6  # distances come from differences of squares
    far, near = pivots.reach(v, low)[:, None] + slack, pivots.reach(v, high)[:, None] - slack
    lo, hi = np.maximum(np.maximum(to - far, near - to), 0) - slack, to + far + slack
    # A row of cell c is no nearer to the anchor's pivot than to its own, so it lies beyond the plane between them.
    apart = pivots.apart[home]
    own = np.take_along_axis(to, home[:, None], 1)
    plane = np.where(apart > 0, (to**2 - own**2) / (2 * np.where(apart > 0, apart, 1)), 0)
    none = (plane > far + slack) | np.isneginf(high)[:, None]
    return np.where(none, np.inf, lo), np.where(none, -np.inf, hi)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exactly: in doubles where no sum can leave 2^53, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best_alike(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], k: int) -> list[tuple]:
    """(anchor row, None, id, score): of each anchor the k best rows of its label that reach its low bound."""
    order = np.lexsort((rows["id"],))
    ids, labels, s = rows["id"][order], rows["label"][order], scores(anchors["v"], rows["v"][order])
    out = []
    for label in np.unique(anchors["label"]):
        mine, theirs = np.flatnonzero(anchors["label"] == label), np.flatnonzero(labels == label)
        for i in mine.tolist():
            own = s[i, theirs]
            at = np.flatnonzero((own >= anchors["low"][i]) & (ids[theirs] != anchors["id"][i]))
            first = at[np.argsort(-own[at], kind="stable")[:k]]
            out += [(i, 0, int(ids[theirs[j]]), int(own[j])) for j in first.tolist()]
    return out


def best_unlike(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], k: int) -> list[tuple]:
    """(anchor row, place, id, score): of each anchor and each of its bands (floor, cap) the k best rows of other labels inside."""
    order = np.lexsort((rows["id"],))
    ids, labels, s = rows["id"][order], rows["label"][order], scores(anchors["v"], rows["v"][order])
    out = []
    for i in range(len(anchors["id"])):
        at = np.flatnonzero((labels != anchors["label"][i]) & (s[i] >= anchors["low"][i]) & (s[i] <= anchors["high"][i]) & (ids != anchors["id"][i]))
        if not len(at):
            continue
        at = at[np.argsort(-s[i, at], kind="stable")]
        down = -s[i, at]
        for place, (floor, cap) in enumerate(zip(anchors["floors"][i], anchors["caps"][i])):
            first = int(np.searchsorted(down, -cap, "left"))
            out += [(i, place, int(ids[j]), int(s[i, j])) for j in at[first : first + k].tolist() if s[i, j] >= floor]
    return out


def prepared(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label, v (array of integers) of the rows that take part."""
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x")).where("id is not null and label is not null and x is not null and size(x) > 0")
    sound = given.where(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return sound.select("id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    got = column.to_pylist()
    return np.frombuffer(b"".join(got), kind).reshape(len(got), -1).astype(np.int64)


def mine(vectors: DataFrame, is_anchor: Column, k: int = 5, m: int = 3, least: int = 50, most: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", cell_rows: int = CELL_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of each anchor and each of its k positives the first m rows of another label whose score is `least` to `most` hundredths of the positive's.
    is_anchor is a condition on `id`.
    """
    return joined(vectors, is_anchor, k, m, least, most, scale, id_col, label_col, vector_col, cell_rows)[0]


def joined(vectors: DataFrame, is_anchor: Column, k: int, m: int, least: int, most: int, scale: int, id_col: str, label_col: str, vector_col: str, cell_rows: int) -> tuple[DataFrame, list[dict]]:
    """The result of `mine`, and for each join the rows copied to groups against groups x rows (what bounds save)."""
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    whole = prepared(vectors, id_col, label_col, vector_col, scale)
    widest = F.greatest(F.array_max("v"), -F.array_min("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    about = whole.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top2"), F.max(widest).alias("wide")).orderBy(F.desc("n"), "d").first()
    if about is None:
        return spark.createDataFrame([], schema), []
    dim, n, wide = about["d"], about["n"], int(about["wide"])
    if dim * wide * wide >= 2**63:
        raise ValueError("inner products of these components may not fit a long")
    kind = "<i2" if wide < 2**15 else "<i4" if wide < 2**31 else "<i8"
    # Pivots: those rows whose hash comes first, and of equal vectors one.
    cells = max(1, min(MOST_CELLS, math.ceil(n / cell_rows)))
    picked = whole.where(F.size("v") == dim).orderBy(F.xxhash64("id", F.lit(11)), "id").select("v").limit(4 * cells).collect()  # bounded by MOST_CELLS
    sample = np.array(list(dict.fromkeys(tuple(r["v"]) for r in picked)), float)[:cells]
    shared = spark.sparkContext.broadcast(Pivots(sample, max(about["top2"], 1.0)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            to = p.distances(p.lifted(v.astype(float)))
            cell = to.argmin(1)
            home = p.distances(p.stretched(v.astype(float))).argmin(1)
            packed = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed, pa.array(cell, pa.int32()), pa.array(to[np.arange(len(v)), cell]), pa.array(home, pa.int32()), b.column(3)], names=["id", "label", "v", "cell", "away", "home", "is_anchor"])

    rows = staged(whole.where(F.size("v") == dim).withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))).mapInArrow(index, "id long, label long, v binary, cell int, away double, home int, is_anchor boolean"), "voronoi")
    own_rows = rows.where("is_anchor").groupBy("id").agg(F.min(F.struct("label", "v", "home")).alias("a")).select("id", "a.*")
    n_anchors = own_rows.count()
    size = max(GROUP, math.ceil(n_anchors / MOST_GROUPS))
    counted: list[dict] = []

    def visited(anchors: DataFrame, alike: bool, own: bool, count: int) -> DataFrame:
        """What the anchors (id, label, v, home, low, high, floors, caps) find in their own region (own) or in all others: id, place, row, score."""
        bucket = F.pmod("label", F.lit(LABEL_BUCKETS)).cast("int") if alike else F.lit(0)
        regions = max(1, min(len(sample), math.ceil(n_anchors / size / (LABEL_BUCKETS if alike else 1))))
        region_of = shared.value.apart[:, :regions].argmin(1)  # of each cell the nearest of the first pivots
        located = anchors.withColumn("bucket", bucket).withColumn("region", F.get(F.array(*[F.lit(int(r)) for r in region_of]), F.col("home")))
        blocks = located.groupBy("region", "bucket").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks")).collect()  # regions x buckets at most
        number, first = {}, 0
        for r in sorted(blocks):
            number[r["region"], r["bucket"]] = (first, r["blocks"])
            first += r["blocks"]
        if not number:
            return spark.createDataFrame([], "id long, place int, row long, score long")
        places = F.broadcast(spark.createDataFrame([(h, b, f, c) for (h, b), (f, c) in number.items()], "region int, bucket int, first int, blocks int"))  # as many
        grouped = staged(located.join(places, ["region", "bucket"]).withColumn("group", (F.col("first") + F.pmod(F.xxhash64("id"), "blocks")).cast("int")).drop("first", "blocks", "bucket", "region"), "anchor-groups")

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for b in batches:
                v, home, group = _matrix(b.column(0), kind).astype(float), b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy()
                near = region_of[None] == region_of[home][:, None]
                if own:
                    lo, hi = np.where(near, -np.inf, np.inf), np.where(near, np.inf, -np.inf)
                else:
                    lo, hi = intervals(p, v, b.column(3).to_numpy(), b.column(4).to_numpy(), home)
                    lo[near], hi[near] = np.inf, -np.inf
                names, at = np.unique(group, return_inverse=True)
                low, high = np.full((len(names), lo.shape[1]), np.inf), np.full((len(names), lo.shape[1]), -np.inf)
                np.minimum.at(low, at, lo)
                np.maximum.at(high, at, hi)
                g, c = np.nonzero(low <= high)
                yield pa.RecordBatch.from_arrays([pa.array(names[g], pa.int32()), pa.array(c, pa.int32()), pa.array(low[g, c]), pa.array(high[g, c])], names=["group", "cell", "low", "high"])

        spans = grouped.select("v", "home", "group", "low", "high").mapInArrow(bounds, "group int, cell int, low double, high double").groupBy("group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # groups x cells at most
        low, high = np.full((first, len(sample)), np.inf), np.full((first, len(sample)), -np.inf)
        for r in spans:
            low[r["group"], r["cell"]], high[r["group"], r["cell"]] = r["low"], r["high"]
        bucket_of = np.zeros(first, np.int64)
        for (_, b), (f, c) in number.items():
            bucket_of[f : f + c] = b
        serve = spark.sparkContext.broadcast((low, high, bucket_of))

        def groups_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            """(row, group) of the groups that rows (cell, away, label) may serve."""
            lo, hi, buckets = serve.value
            cell, away = b.column(0).to_numpy(), b.column(1).to_numpy()
            hit = (lo.T[cell] <= away[:, None]) & (away[:, None] <= hi.T[cell])
            if alike:
                hit &= (b.column(2).to_numpy() % LABEL_BUCKETS)[:, None] == buckets[None]
            return np.nonzero(hit)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(first, np.int64)
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    total += np.bincount(groups_of(b.slice(at, 1024))[1], minlength=first)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["group", "n"])

        narrow = rows.select("cell", "away", "label")
        held = narrow.mapInArrow(tally, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()  # groups at most
        chunks = np.ones(first, np.int64)
        for r in held:
            chunks[r["group"]] = -(-r["n"] // CHUNK)
        counted.append({"copied": sum(r["n"] for r in held), "all": first * n})
        parts = spark.sparkContext.broadcast(chunks)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 1024):
                    b = whole.slice(start, 1024)
                    at, group = groups_of(b)
                    ids = b.column(3).to_numpy()[at]
                    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    chunk = (mixed % parts.value[group].astype(np.uint64)).astype(np.int64)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(chunk, pa.int32()), b.column(3).take(take), b.column(2).take(take), b.column(4).take(take)], names=["group", "chunk", "id", "label", "v"])

        dealt = rows.select("cell", "away", "label", "id", "v").mapInArrow(deal, "group int, chunk int, id long, label long, v binary")
        counts = F.broadcast(spark.createDataFrame([(g, int(c)) for g, c in enumerate(chunks)], "group int, chunks int"))  # groups at most
        asking = grouped.join(counts, "group").select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        columns = ["group", "chunk", "id", "label", "v", "low", "high", "floors", "caps"]

        def unit(key, left: pa.Table, right: pa.Table) -> pa.Table:
            found: list[tuple] = []
            if left.num_rows and right.num_rows:
                a = {"id": left.column("id").to_numpy(), "label": left.column("label").to_numpy(), "v": _matrix(left.column("v"), kind), "low": left.column("low").to_numpy(), "high": left.column("high").to_numpy(), "floors": left.column("floors").to_pylist(), "caps": left.column("caps").to_pylist()}
                r = {"id": right.column("id").to_numpy(), "label": right.column("label").to_numpy(), "v": _matrix(right.column("v"), kind)}
                found = (best_alike if alike else best_unlike)(a, r, count)
                found = [(int(a["id"][i]), place, row, s) for i, place, row, s in found]
            cut = list(zip(*found)) if found else [[], [], [], []]
            return pa.table({"id": pa.array(cut[0], pa.int64()), "place": pa.array(cut[1], pa.int32()), "row": pa.array(cut[2], pa.int64()), "score": pa.array(cut[3], pa.int64())})

        return asking.select(*columns).groupBy("group", "chunk").cogroup(dealt.groupBy("group", "chunk")).applyInArrow(unit, "id long, place int, row long, score long")

    def first_of(found: DataFrame, count: int) -> DataFrame:
        order = Window.partitionBy("id", "place").orderBy(F.desc("score"), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)

    def twice(anchors: DataFrame, alike: bool, count: int) -> DataFrame:
        """Own region first; its finds raise the low bounds with which all others are asked."""
        near = staged(first_of(visited(anchors, alike, True, count), count), "own-region")
        full = near.groupBy("id", "place").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == count)
        if alike:
            known = anchors.drop("low").join(full.select("id", "least"), "id", "left").withColumn("low", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))).drop("least")
        else:
            # An anchor needs what any of its bands may still take: the least of the bands' raised floors.
            raised = full.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("raised"))  # k entries
            up = F.transform("floors", lambda f, i: F.greatest(f, F.coalesce(F.get(F.array(*[F.element_at("raised", F.lit(p)) for p in range(k)]), i), f)))
            known = anchors.join(raised, "id", "left").withColumn("low", F.array_min(up).cast("double")).drop("raised")
        return first_of(near.drop("rank").unionByName(visited(known, alike, False, count)), count)

    anchors = own_rows.select("id", "label", "v", "home", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.array().cast("array<long>").alias("floors"), F.array().cast("array<long>").alias("caps"))
    positives = staged(twice(anchors, True, k), "positives").select("id", F.col("rank").alias("r"), F.col("row").alias("positive_id"), F.col("score").alias("positive_score"))
    # The integers s with least * p <= 100 s <= most * p, in decimals, as the products may not fit a long.
    share = lambda x, name: F.expr(f"cast({name}(cast(positive_score as decimal(20, 0)) * {x} / 100) as bigint)")
    floor, cap = share(least, "ceil"), share(most, "floor")
    bands = positives.where(floor <= cap).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", floor.alias("floor"), cap.alias("cap"), "positive_id", "positive_score"))).alias("bands"))  # k at most
    asking = staged(own_rows.join(bands, "id").select("id", "label", "v", "home", F.array_min(F.transform("bands", lambda x: x["floor"])).cast("double").alias("low"), F.array_max(F.transform("bands", lambda x: x["cap"])).cast("double").alias("high"), F.transform("bands", lambda x: x["floor"]).alias("floors"), F.transform("bands", lambda x: x["cap"]).alias("caps"), "bands"), "bands")
    found = twice(asking.drop("bands"), False, m)
    each = found.join(asking.select("id", "bands"), "id").withColumn("band", F.get("bands", F.col("place")))
    return each.select(F.col("id").alias("anchor_id"), F.col("band.positive_id"), F.col("rank").cast("int").alias("rank"), F.col("row").alias("negative_id"), F.col("band.positive_score"), F.col("score").alias("negative_score")), counted


def relabelled(vectors: DataFrame) -> DataFrame:
    """The query's rule: every seventh row takes the next of ten labels."""
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


def sql() -> str:
    """The production query in DuckDB's SQL, over all pairs of anchors and rows."""
    return """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike, list_inner_product(a.e, r.e)::BIGINT AS score FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
