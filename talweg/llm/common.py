"""What the corpus operators share: the rows that stay, Arrow text buffers and vectorised hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.storage import shared_dir, staged, table  # noqa: F401  (for the operators)

#: Text handled at once inside a task. Bounds a worker's arrays whatever the length of an Arrow batch.
SLICE_BYTES = 1 << 20
#: Rows handled at once: operators pack a row's number into 16 bits beside a hash.
SLICE_ROWS = 1 << 15
#: Ids or keys that are sent to all tasks at most (some 40 bytes each), after they were counted.
FEW_IDS = 400_000
_U = np.uint64


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def with_rows(decided: DataFrame) -> DataFrame:
    """id, key, n of the kept rows of (id, key, kept), n being the rows of the id, kept or not."""
    n = decided.groupBy(F.col("id").alias("own")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = decided.where("kept").select("id", "key")
    return kept.join(n, F.col("id").eqNullSafe(F.col("own")), "left").select("id", "key", F.coalesce("n", F.lit(1)).alias("n"))


def one_each(docs: DataFrame, stay: DataFrame, id_col: str, key: Column, text_col: str) -> DataFrame:
    """The rows of docs that stay, one for each (id, key), with all columns.

    stay: id, key, n (rows of that id in docs), decided on narrow columns; so the texts are shuffled once, by id. Rows of an
    id that stands once are looked up by it; only rows of an id that repeats are told apart by their key, and of those that
    share both the longest text stays, then the greatest.
    """
    stay = staged(stay, "stay")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"))
    once = stay.where("n = 1").select(F.col("id").alias("own"))
    alone = rows.join(once, F.col("id").eqNullSafe(F.col("own")), "left_semi").select("doc")
    several = stay.where("n > 1").select(F.col("id").alias("own"), F.col("key").alias("own_key"))
    ids = staged(several.select("own").distinct(), "repeated-ids")
    found = ids.count()
    if not found:
        return alone.select("doc.*")
    text = F.coalesce(F.col("doc").getField(text_col), F.lit(""))
    # Few ids are sent to the texts (16 MB at most); more of them are met in a shuffle of their own.
    some = rows.join(F.broadcast(ids) if found <= FEW_IDS else ids, F.col("id").eqNullSafe(F.col("own")), "left_semi").withColumn("key", key)
    kept = some.join(several, F.col("id").eqNullSafe(F.col("own")) & (F.col("key") == F.col("own_key")), "left_semi")
    each = kept.groupBy("id", "key").agg(F.max_by("doc", F.struct(F.length(text), text)).alias("doc")).select("doc")
    return alone.unionByName(each).select("doc.*")


def input_partitions(df: DataFrame, least: int = 1) -> int:
    """Partitions for a shuffle of about the input's size: the session's setting, which deployments size to the data."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its n + 1 bounds. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text of each is about `most` bytes, or one document if that alone is longer, and its rows SLICE_ROWS at most."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, bounds = text_buffer(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1
            last = min(max(last, first + 1), first + SLICE_ROWS, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants): equal in, equal out, well spread."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: One random 64-bit value a byte, for polynomial hashes of bytes.
BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), _U)
    step, have = base, 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * _U(pow(base, have, 1 << 64))
        have += more
    return out


_POW = _powers(1 << 16, _BASE)
_INV = _powers(1 << 16, pow(_BASE, -1, 1 << 64))


def _pow_at(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        _POW, _INV = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))
    return _POW, _INV


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of a uint64 sequence, independent of where the span lies."""
    power, inverse = _pow_at(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    raw = (sums[end] - sums[start]) * inverse[start]
    return mix(raw ^ ((end - start).astype(_U) * _U(0xD6E8FEB86659FD93)))


def word_spans(word_byte: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true inside each document: starts, ends, and the number of runs in each document."""
    n = len(word_byte)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.zeros(n + 1, bool)
    before[1:] = word_byte
    here = np.zeros(n + 1, bool)
    here[:-1] = word_byte
    start = np.flatnonzero(here & (~before | edge))
    end = np.flatnonzero(before & (~here | edge))
    return start, end, np.searchsorted(start, bounds[1:]) - np.searchsorted(start, bounds[:-1])
