"""Toxicity: a logistic classifier regularised by counterfactuals.

Features are whole words and word beginnings of four to six bytes; those that tell the classes apart best (by chi-square)
are kept, and the identity terms and their beginnings always. For each labelled text that names an identity, copies of the
text are made with the terms swapped for each of their counterparts, so beginnings change as well, and training penalises
the squared difference of the two scores (before the logistic), so a neutral mention of a group doesn't raise a score. The
terms are a parameter.

The model is fitted on at most about `fit_rows` labelled rows, chosen by a hash of the id (a documented bound). Nulls: a
null text counts as empty and is scored by the intercept; null ids and labels are never learned from; several labels of an
id count as their maximum. Repeated rows are scored each. Without labelled rows of both classes every score is the base
rate. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, mix, slices, span_hash, staged, text_buffer, word_spans
from .langid import remainder

#: Terms that name groups, by kind (a default; give your own as `groups`). Within a kind each term may be swapped for each other.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "natives", "refugees"),
    ("immigrant", "native", "refugee"),
    ("old", "young"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
)
BEGINNINGS = (4, 5, 6)
FEATURES = 3000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[97:123] = _WORD[128:] = True


class Swaps:
    """Identity terms by kind, and the copies of a text with its terms swapped."""

    def __init__(self, groups: Sequence[Sequence[str]]) -> None:
        self.kind = {t.lower().encode(): [x.lower().encode() for x in g] for g in groups for t in g}
        self.terms = sorted(self.kind)
        longest = sorted(self.terms, key=len, reverse=True)
        self.find = re.compile(rb"(?<![a-z\x80-\xff])(?:" + b"|".join(map(re.escape, longest)) + rb")(?![a-z\x80-\xff])") if longest else None
        self.most = max((len(g) for g in groups), default=1) - 1

    def _other(self, term: bytes, step: int) -> bytes:
        own = self.kind[term]
        return own[(own.index(term) + step) % len(own)]

    def copies(self, column: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Copies of the texts that name an identity, one for each counterpart, and the place of each copy's text."""
        raw, bounds = text_buffer(column)
        data = _LOWER[raw].tobytes()
        at, copies = [], []
        for k in range(len(column) if self.find else 0):
            text = data[bounds[k] : bounds[k + 1]]
            if not self.find.search(text):
                continue
            for copy in {self.find.sub(lambda m, s=s: self._other(m[0], s), text): None for s in range(1, self.most + 1)}:
                if copy != text:
                    at.append(k)
                    copies.append(copy)
        return np.array(at, np.int64), pa.array(copies, pa.binary())


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of word beginnings, and the document of each."""
    raw, bounds = text_buffer(column)
    data = _LOWER[raw]
    start, end, count = word_spans(_WORD[data], bounds)
    doc, value = np.repeat(np.arange(len(column)), count), BYTE_VALUE[data]
    hashes, docs = [span_hash(value, start, end)], [doc]
    for n in BEGINNINGS:
        long = end - start > n
        hashes.append(mix(span_hash(value, start[long], start[long] + n) ^ np.uint64(n)))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


@dataclass
class Model:
    feature: np.ndarray  # sorted hashes
    weight: np.ndarray
    intercept: float

    def score(self, column: pa.Array) -> np.ndarray:
        h, doc = features(column)
        total = np.full(len(column), self.intercept)
        if len(self.feature) and len(h):
            at = np.minimum(np.searchsorted(self.feature, h), len(self.feature) - 1)
            hit = self.feature[at] == h
            pair = np.unique(doc[hit] * len(self.feature) + at[hit])
            total += np.bincount(pair // len(self.feature), self.weight[pair % len(self.feature)], minlength=len(column))
        return 1 / (1 + np.exp(-total))


def _train(rows: list[np.ndarray], label: np.ndarray, swapped: list[tuple[int, np.ndarray]], width: int, penalty: float, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Gradient descent (Adam) on log loss + ridge + penalty x squared counterfactual gap. Columns of rows: present features."""
    def flat(some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate([*some, np.zeros(0, np.int64)]).astype(np.int64)

    row, col = flat(rows)
    gap_row, gap_col = flat([np.concatenate([rows[k], x]) for k, x in swapped])
    sign = np.concatenate([*[np.concatenate([np.ones(len(rows[k])), -np.ones(len(x))]) for k, x in swapped], np.zeros(0)])
    w, b, n = np.zeros(width), float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1))), len(label)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col], minlength=n) + b)))
        err = (p - label) / n
        grad = np.bincount(col, err[row], minlength=width) + ridge * w
        if swapped:
            gap = np.bincount(gap_row, w[gap_col] * sign, minlength=len(swapped))
            grad += 2 * penalty / len(swapped) * np.bincount(gap_col, gap[gap_row] * sign, minlength=width)
        g = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "label", penalty: float = 1.0, ridge: float = 1e-5, steps: int = 400, groups: Sequence[Sequence[str]] = IDENTITY) -> Model:
    """Learn from rows of text and label (0 or 1), a bounded sample. groups: kinds of identity terms."""
    swaps = Swaps(groups)
    sample = staged(rows.select(F.col(text_col).alias("_text"), F.col(label_col).cast("int").alias("_label")).repartition(8), "toxic-sample")
    signed = lambda x: np.asarray(x, np.uint64).view(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            h, doc = features(b.column(0))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
            toxic = b.column(1).to_numpy(zero_copy_only=False)[doc[new]]
            each, back = np.unique(h[new], return_inverse=True)
            n1 = np.bincount(back, toxic, minlength=len(each)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"h": signed(each), "n1": n1, "n": np.bincount(back, minlength=len(each)).astype(np.int64)})

    sizes = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    rate = float(np.log((ones + 1) / (zeros + 1)))
    if not ones or not zeros:
        return Model(np.zeros(0, np.uint64), np.zeros(0), rate)
    expected = F.col("n") * (ones / (ones + zeros))
    chi = F.pow(F.col("n1") - expected, 2) / expected
    best = sample.mapInArrow(count, "h long, n1 long, n long").groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n")).where("n >= 3").orderBy(chi.desc(), "h").limit(FEATURES).select("h").toPandas()["h"]
    chosen = np.unique(np.concatenate([best.to_numpy(np.int64).view(np.uint64), features(pa.array(swaps.terms, pa.binary()))[0]]))

    def held(column: pa.Array) -> list[np.ndarray]:
        """The chosen features of each text."""
        h, doc = features(column)
        at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
        hit = chosen[at] == h
        pair = np.unique(doc[hit] * len(chosen) + at[hit])
        return np.split((pair % len(chosen)).astype(np.int32), np.searchsorted(pair, np.arange(1, len(column)) * len(chosen))) if len(column) else []

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            at, copies = swaps.copies(b.column(0))
            own: list[list | None] = [None] * b.num_rows
            for k, f in zip(at.tolist(), held(copies)):
                own[k] = [*(own[k] or []), f]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(held(b.column(0)), kind), pa.array(own, pa.list_(kind)), b.column(1)], names=["f", "g", "label"])

    small = sample.mapInArrow(reduce, "f array<int>, g array<array<int>>, label int").collect()  # a few integers for each row of the bounded sample
    small = sorted(small, key=lambda r: (r["label"], r["f"], r["g"] or []))  # the same model whatever the order of tasks
    data, label = [np.asarray(r["f"], np.int64) for r in small], np.array([r["label"] for r in small], float)
    swapped = [(k, np.asarray(g, np.int64)) for k, r in enumerate(small) for g in r["g"] or []]
    w, b = _train(data, label, swapped, len(chosen), penalty, ridge, steps)
    return Model(chosen, w, b)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1)))], names=["_id", "score"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"_id {source.schema[0].dataType.simpleString()}, score double").withColumnRenamed("_id", id_col)


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, groups: Sequence[Sequence[str]] = IDENTITY) -> DataFrame:
    """Learn from four fifths of the labels, score every document: doc_id, held_out, score, predicted."""
    known = labels.where("doc_id is not null and toxic is not null").where(remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    # The sample has a size bound, so it is sent to the tasks and the texts aren't shuffled.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    out = predict(docs, fit(rows, groups=groups))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
