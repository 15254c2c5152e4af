"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes a blank; runs of one to three characters are hashed into a fixed
number of buckets. The matrix of log probabilities (buckets x languages) is broadcast, and numpy scores whole batches by
gathering and summing its rows.

The model is fitted on at most about `fit_rows` labelled rows, chosen by a hash of their id (a documented bound; with
fewer rows, all count). Nulls: a null text, or one without a letter, is `und` with score 0; a null label is never learned
from. Ties go to the language that sorts first. Repeated rows count each. With no labelled row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: Text scored at once: its n-grams take some eighty times the memory.
SLICE = 1 << 19
_LETTER: list[np.ndarray] = []


@dataclass
class Model:
    labels: list[str]
    log_p: np.ndarray  # (BUCKETS + 1, labels); the last row is zero
    log_prior: np.ndarray


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start at each character (position x order), where each document starts, and its letters.

    Two blanks follow each document; what would start there, and single blanks, go to a last bucket that holds nothing.
    """
    low = [(t or "").lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low)) + 2
    code = np.frombuffer("  ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(size) - size
    letter = _letters()[code]
    count = np.add.reduceat(letter, start, dtype=np.int64) if len(low) else np.zeros(0, np.int64)
    code = np.where(letter, code, np.uint32(32))
    out = np.full((len(code), len(ORDERS)), BUCKETS, np.int32)
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
        if n in ORDERS:
            x = (h ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
            out[: len(h), ORDERS.index(n)] = (x * np.uint32(0x85EBCA77)) >> np.uint32(16)
    out[~letter, 0] = BUCKETS
    end = start + size
    out[end - 1], out[end - 2] = BUCKETS, BUCKETS
    return out, start, count


def fit(rows: DataFrame, label: Column, text_col: str = "text", key: Column | None = None, fit_rows: int = 20_000, smoothing: float = 0.5) -> Model:
    """Learn from rows whose label isn't null. key: what rows of a large table are chosen by (default: the text)."""
    rows = rows.select(F.col(text_col).alias("_text"), label.cast("string").alias("_label"), F.pmod(F.xxhash64(key if key is not None else F.col(text_col)), F.lit(1_000_000)).alias("_pick")).where(F.col("_label").isNotNull())
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.col("_pick") < int(1_000_000 * fit_rows / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, "_text", SLICE):
            bucket, start, _ = grams(b.column(0).to_pylist())
            bound = [*start.tolist(), len(bucket)]
            for k, name in enumerate(b.column(1).to_pylist()):
                counts = total.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                own = bucket[bound[k] : bound[k + 1]].ravel()
                np.add.at(counts, own[own < BUCKETS], 1)
                counts[BUCKETS] += 1
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"label": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    # The chosen rows are few, whatever the table's size; eight tasks count them.
    counted = rows.select("_text", "_label").repartition(8).mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(counted["label"].unique())
    counts = np.zeros((BUCKETS + 1, len(labels)))
    counts[counted["bucket"], counted["label"].map({x: k for k, x in enumerate(labels)})] = counted["n"]
    seen = counts[:BUCKETS] + smoothing
    log_p = np.vstack([np.log(seen / seen.sum(0)), np.zeros((1, len(labels)))])
    return Model(labels, log_p, np.log((counts[BUCKETS] + 1) / (counts[BUCKETS].sum() + max(1, len(labels)))))


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The best language of each text and its posterior probability."""
    n = len(texts)
    if not model.labels or not n:
        return [UNDETERMINED] * n, np.zeros(n)
    bucket, start, letters = grams(texts)
    total = np.empty((n, len(model.labels)))
    for k in range(0, len(model.labels), 4):
        rows = model.log_p[:, k : k + 4]
        each = rows[bucket[:, 0]]
        for j in range(1, len(ORDERS)):
            each += rows[bucket[:, j]]
        total[:, k : k + 4] = np.add.reduceat(each, start, axis=0)
    total += model.log_prior
    best = total.argmax(1)
    p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [model.labels[k] if m else UNDETERMINED for k, m in zip(best, letters)], np.where(letters > 0, p, 0.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, lang_pred and score, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(text_col).alias("_text"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)])
    kinds = [f.dataType.simpleString() for f in source.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", SLICE):
            lang, p = score(shared.value, b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(p, pa.float64())], names=[*[f"_{k}" for k in range(len(keep))], "lang_pred", "score"])

    out = source.mapInArrow(run, ", ".join([*[f"_{k} {t}" for k, t in enumerate(kinds)], "lang_pred string", "score double"]))
    return out.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(keep)], "lang_pred", "score")


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def identify(docs: DataFrame) -> DataFrame:
    """Learn from two thirds of `documents`, predict all: doc_id, held_out, lang_pred, score. A row of null id is neither learned from nor held out."""
    held = remainder("doc_id", 3)
    model = fit(docs.where(held != 1), F.col("lang"), key=F.col("doc_id"))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
