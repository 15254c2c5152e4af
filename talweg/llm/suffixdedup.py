"""Suffix-array dedup: a depth-limited radix sort of suffixes, most significant digit first.

Only the first `window` bytes of suffixes are ever ordered, in two digits, and groups that can't hold a repeat leave after
each. Sorting every suffix would move many times the input, so the first pass takes the suffixes at the anchors of each
window: the places of the least hash of a `DIGIT`-byte string in it. Equal windows have equal anchors, hence none is missed.

Pass one deals the first digit (the DIGIT bytes from an anchor) out by its radix; digits of a single document drop out.
Pass two carries the survivors' bytes, up to `window` to each side of the anchor, and orders them by further passes over
eight bytes each, to the right and to the left; what is alone in its group leaves after each pass. Groups equal to full depth
are exactly the repeated windows, and the least id in a group tells who keeps it. Hashes only deal out and filter: what
is removed is decided by bytes. Equal surroundings are merged within a block of documents before they are sent, so a
passage that everyone shares costs one entry a block. Digits of `HOT` anchors or more are dealt out again by all the bytes of
each window, equal windows of a block merged: of a line that stands in a third of all documents, in other surroundings each
time, every task gets an entry a block at most.

Nulls: a null text is empty; a null id ranks after all others. Rows of one id aren't repeats of each other. Texts shorter
than the window are kept. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, mix, slices, staged, text_buffer

WINDOW = 50
DIGIT = 20
#: Text in a block of documents, and anchors in a radix bucket, about.
BLOCK_BYTES = 1 << 21
BUCKET_ANCHORS = 64_000
#: Anchors of one digit from which it is dealt out by whole windows.
HOT = 8192
_U = np.uint64
_LAST = np.iinfo(np.int64).max


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to blocks: a block's number, its ids (nulls flagged), its text as bytes, and the bounds of the texts."""
    number = TaskContext.get().partitionId() << 32
    for b in slices(batches, "_text", BLOCK_BYTES):
        raw, bounds = text_buffer(b.column(1))
        ids = b.column(0).cast(pa.int64())
        yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "raw": pa.array([raw.tobytes()], pa.binary()), "bounds": pa.array([bounds.tobytes()], pa.binary())})
        number += 1


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[k : k + width], for each k where that fits."""
    have, out = 1, x
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    more = width - have
    return pick(out[: len(out) - more], out[more:]) if more else out


def anchors(raw: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows inside documents, and the hash of the digit there."""
    n, reach = len(raw), window - DIGIT + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    word = np.ndarray((n - 7,), "<u8", raw.tobytes(), 0, (1,)).copy()
    m = n - DIGIT + 1
    h = mix(word[:m] * _U(0x9E3779B97F4A7C15) + mix(word[8 : 8 + m]) + word[DIGIT - 8 : DIGIT - 8 + m] * _U(0xC2B2AE3D27D4EB4F)) | _U(1)
    low = _sliding(h, reach, np.minimum)  # of the window from each place
    edge = np.zeros(len(low) + 1, np.int32)
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if z - a >= window:
            edge[a] += 1
            edge[z - window + 1] -= 1
    low = np.where(np.cumsum(edge[:-1]) > 0, low, _U(0))
    padded = np.concatenate([np.zeros(reach - 1, _U), low, np.zeros(reach - 1, _U)])
    at = np.flatnonzero(_sliding(padded, reach, np.maximum)[:m] == h)
    return at, h[at]


def _short(h: np.ndarray, n: np.ndarray) -> bytes:
    """48 bits of each hash (the bucket adds the others), and a byte that tells its number of anchors: exactly below 128, else in steps of 512."""
    out = np.empty((len(h), 7), np.uint8)
    out[:, :6] = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    out[:, 6] = np.where(n < 128, n, np.minimum(128 + n // 512, 255))
    return out.tobytes()


def _long(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    seven = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    n = seven[:, 6].astype(np.int64)
    return np.pad(seven[:, :6], ((0, 0), (0, 2))).view("<u8").ravel(), np.where(n < 128, n, 128 + (n - 128) * 512)


def _buckets(h: np.ndarray, count: int) -> np.ndarray:
    # Anchors have the least hashes of their windows, so the hashes crowd at the low end; mixed again they are even.
    return (mix(h) % _U(count)).astype(np.int64)


def _distinct(raw: np.ndarray, bounds: np.ndarray, window: int, count: int):
    """A block's anchors; its distinct digits in order of bucket and hash, the bounds of buckets among them."""
    at, h = anchors(raw, bounds, window)
    each, back = np.unique(h, return_inverse=True)
    bucket = _buckets(each, count)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return at, place[back], each[order], bucket[order]


def _runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of a sorted array."""
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    bound = [0, *cut.tolist(), len(x)] if len(x) else [0]
    return [(int(x[i]), i, j) for i, j in zip(bound[:-1], bound[1:])]


class _Block:
    """A block with the verdict of pass one: the surroundings of surviving anchors, equal ones merged, and the windows of hot digits."""

    def __init__(self, row: dict, bits: dict[int, tuple[bytes, bytes]], window: int, count: int) -> None:
        self.raw = np.frombuffer(row["raw"], np.uint8)
        self.bounds = np.frombuffer(row["bounds"], np.int64)
        self.null = np.array([x is None for x in row["ids"]], bool)
        self.ids = np.array([_LAST if x is None else x for x in row["ids"]], np.int64)
        at, digit, each, bucket = _distinct(self.raw, self.bounds, window, count)
        alive, hot = np.zeros(len(each), bool), np.zeros(len(each), bool)
        for value, i, j in _runs(bucket):
            if value in bits:
                for mask, blob in zip((alive, hot), bits[value]):
                    mask[i:j] = np.unpackbits(np.frombuffer(blob, np.uint8), count=j - i).astype(bool)
        doc = np.searchsorted(self.bounds, at, "right") - 1
        low, high = np.full(len(each), _LAST), np.full(len(each), -_LAST)
        np.minimum.at(low, digit, doc)
        np.maximum.at(high, digit, doc)
        alive |= low < high
        keep = alive[digit]
        self.at, self.doc, self.digit_bucket = at[keep], doc[keep], bucket[digit[keep]]
        self._surroundings(window, hot[digit[keep]])
        self._windows(window, count)

    def _surroundings(self, window: int, hot: np.ndarray) -> None:
        left = window - DIGIT
        width = left + window
        padded = np.concatenate([np.zeros(left, np.uint8), self.raw, np.zeros(window, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, width)
        some = view[self.at].copy() if len(self.at) else np.zeros((0, width), np.uint8)
        self.left = np.minimum(self.at - self.bounds[self.doc], left)
        self.right = np.minimum(self.bounds[self.doc + 1] - self.at, window)
        column = np.arange(width)[None]
        some[(column < left - self.left[:, None]) | (column >= left + self.right[:, None])] = 0
        reach = self.left * 64 + self.right
        key = _row_hash(some) ^ mix(reach.astype(_U))
        # In order of hotness, bucket, key and id: the first of equal ones has the least id. Unlike ones of equal keys stay apart.
        order = np.lexsort((self.ids[self.doc], key, self.digit_bucket, hot))
        new = np.ones(len(order), bool)
        if len(order):
            x, y = order[1:], order[:-1]
            new[1:] = (hot[x] != hot[y]) | (key[x] != key[y]) | (self.digit_bucket[x] != self.digit_bucket[y]) | (reach[x] != reach[y]) | (some[x] != some[y]).any(1)
        self.merged = np.empty(len(order), np.int64)  # which merged entry an anchor belongs to
        self.merged[order] = np.cumsum(new) - 1
        first = order[new]
        self.entry, self.entry_bucket, self.entry_id = some[first], self.digit_bucket[first], self.ids[self.doc[first]]
        self.entry_reach = np.stack([self.left[first], self.right[first]], 1).astype(np.uint8)
        self.cool = int((~hot[first]).sum())  # entries before it go by their bucket, the others by windows

    def _windows(self, window: int, count: int) -> None:
        """The distinct windows (bytes, after their place before the anchor) of the entries of hot digits, their least ids, and buckets below zero."""
        left = window - DIGIT
        some, reach = self.entry[self.cool :], self.entry_reach[self.cool :].astype(np.int64)
        fits = [np.flatnonzero((reach[:, 0] >= i) & (reach[:, 1] >= window - i)) for i in range(left + 1)]
        own = np.concatenate([np.zeros(0, np.int64), *fits])
        place = np.repeat(np.arange(left + 1, dtype=np.uint8), [len(x) for x in fits])
        rows = np.empty((len(own), window + 1), np.uint8)
        rows[:, 0] = place
        for i, x in enumerate(fits):
            rows[place == i, 1:] = some[x, left - i : left - i + window]
        key = _row_hash(rows)
        bucket = -1 - (key % _U(count)).astype(np.int64)
        order = np.lexsort((self.entry_id[self.cool :][own], key, bucket))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = (key[order[1:]] != key[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]]).any(1)
        self.window_of = np.full((len(some), left + 1), -1, np.int64)
        self.window_of[own[order], place[order]] = np.cumsum(new) - 1
        first = order[new]
        self.window, self.window_bucket, self.window_id = rows[first], bucket[first], self.entry_id[self.cool :][own[first]]


def _row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), _U)
    for k in range(rows.shape[1]):
        h = h * _U(0x9E3779B97F4A7C15) + BYTE_VALUE[rows[:, k]]
    return mix(h)


def _least(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each entry the least id among entries of its key."""
    order = np.argsort(key)
    k = key[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(ids[order], start), np.diff(np.append(start, len(k)))) if len(k) else 0
    return out


def radix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes in order, most significant digit (eight bytes) first, and where groups of equal rows start. Only what still shares its group takes part in the next pass."""
    n, width = rows.shape
    digits = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -width % 8)))).view(">u8").astype(_U)
    order, new = np.arange(n), np.arange(n) == 0
    for d in range(digits.shape[1]):
        tied = np.flatnonzero(~(new & np.append(new[1:], True)[:n]))
        if not len(tied):
            break
        group, digit = np.cumsum(new)[tied], digits[order[tied], d]
        by = np.lexsort((digit, group)) if d else np.argsort(digit, kind="stable")
        order[tied] = order[tied][by]
        group, digit = group[by], digit[by]
        new[tied[1:]] |= (group[1:] == group[:-1]) & (digit[1:] != digit[:-1])
    return order, new


def _depths(rows: np.ndarray):
    """A function from a depth to a number for each row: equal numbers mean equal bytes up to that depth."""
    order, _ = radix_order(rows)
    n, width = rows.shape
    unlike = rows[order[1:]] != rows[order[:-1]]
    common = np.where(unlike.any(1), unlike.argmax(1), width) if n > 1 else np.zeros(0, np.int64)

    def group(depth: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(np.append(0, common < depth)[:n])
        return out

    return group


def repeats(entry: np.ndarray, reach: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """For each surrounding, bit i tells that the window starting i bytes before the anchor also starts in a smaller id.

    A window is what stands before the anchor, to some depth, with what follows it, to the depth that is left.
    """
    left, n = window - DIGIT, len(entry)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    right_group, left_group = _depths(entry[:, left:]), _depths(entry[:, :left][:, ::-1])
    _, both = np.unique(left_group(left) * n + right_group(window), return_inverse=True)
    whole = _least(both * 4096 + reach[:, 0] * 64 + reach[:, 1], ids) < ids
    for i in range(left + 1):
        ok = (reach[:, 0] >= i) & (reach[:, 1] >= window - i)
        out[ok & whole] |= _U(1 << i)
        # Entries whose whole surroundings stand in a smaller id are settled, and that id's own entry speaks for them.
        some = np.flatnonzero(ok & ~whole)
        if len(some):
            key = left_group(i)[some] * n + right_group(window - i)[some]
            out[some[_least(key, ids[some]) < ids[some]]] |= _U(1 << i)
    return out


def repeated_rows(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each row of bytes also stands with a smaller id."""
    order, new = radix_order(rows)
    group = np.empty(len(rows), np.int64)
    group[order] = np.cumsum(new)
    return _least(group, ids) < ids


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_bytes, spans (array of [start, end) removed), kept (the remaining bytes)."""
    if not DIGIT + 8 <= window <= DIGIT + 63:
        raise ValueError(f"window must be {DIGIT + 8} to {DIGIT + 63} bytes")
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    blocks = staged(source.mapInArrow(_pack, "block long, ids array<long>, raw binary, bounds binary"), "text-blocks")
    total = blocks.agg(F.sum(F.length("raw"))).first()[0] or 0
    count = max(1, -(-total // (16 * BUCKET_ANCHORS)))
    answer_schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary()), ("hot", pa.binary())])
    kinds = "block long, bucket long, bits binary, hot binary"

    def first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, place, each, bucket = _distinct(np.frombuffer(row["raw"], np.uint8), np.frombuffer(row["bounds"], np.int64), window, count)
                n, runs = np.bincount(place, minlength=len(each)), _runs(bucket)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in runs], pa.int64()), "block": pa.array([row["block"]] * len(runs), pa.int64()), "digits": pa.array([_short(each[i:j], n[i:j]) for _, i, j in runs], pa.binary())})

    def shared_digits(group: pa.Table) -> pa.Table:
        digits = [_long(x) for x in group.column("digits").to_pylist()]
        _, back, n = np.unique(np.concatenate([h for h, _ in digits]), return_inverse=True, return_counts=True)
        many = n[back] > 1
        hot = many & (np.bincount(back, np.concatenate([k for _, k in digits])) >= HOT)[back]
        bound = np.cumsum([0, *(len(h) for h, _ in digits)])
        each = [[np.packbits(x[i:j]).tobytes() for x in (many, hot)] if many[i:j].any() else [None, None] for i, j in zip(bound[:-1], bound[1:])]
        bits, hots = [x[0] for x in each], [x[1] for x in each]
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "bits": pa.array(bits, pa.binary()), "hot": pa.array(hots, pa.binary())}, answer_schema).filter(pa.array([x is not None for x in bits]))

    digits = blocks.select("block", "raw", "bounds").mapInArrow(first_digits, "bucket long, block long, digits binary")
    bits = staged(digits.groupBy("bucket").applyInArrow(shared_digits, kinds), "shared-digits")

    def surroundings(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "block": [], "entry": [], "reach": [], "ids": []}
        for row in left.to_pylist():
            x = _Block(row, {r["bucket"]: (r["bits"], r["hot"]) for r in right.to_pylist()}, window, count)
            cool = [(v, x.entry[i:j], x.entry_reach[i:j].tobytes(), x.entry_id[i:j]) for v, i, j in _runs(x.entry_bucket[: x.cool])]
            warm = [(v, x.window[i:j], b"", x.window_id[i:j]) for v, i, j in _runs(x.window_bucket)]
            for value, rows, reach, ids in (*cool, *warm):
                for name, v in zip(out, (value, row["block"], rows.tobytes(), reach, ids.tobytes()), strict=True):
                    out[name].append(v)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({name: pa.array(v, t) for (name, v), t in zip(out.items(), types)})

    def full_depth(group: pa.Table) -> pa.Table:
        entry, reach, ids = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("entry", np.uint8), ("reach", np.uint8), ("ids", np.int64)))
        if group.column("bucket")[0].as_py() < 0:
            found = repeated_rows(entry.reshape(len(ids), -1), ids)
        else:
            found = repeats(entry.reshape(len(ids), -1), reach.reshape(-1, 2).astype(np.int64), ids, window)
        bound = np.cumsum([0, *(len(x) // 8 for x in group.column("ids").to_pylist())])
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "bits": pa.array([found[i:j].tobytes() for i, j in zip(bound[:-1], bound[1:])], pa.binary()), "hot": pa.nulls(group.num_rows, pa.binary())}, answer_schema)

    per_block = blocks.groupBy("block")
    sent = per_block.cogroup(bits.groupBy("block")).applyInArrow(surroundings, "bucket long, block long, entry binary, reach binary, ids binary")
    answers = sent.groupBy("bucket").applyInArrow(full_depth, kinds)
    verdict = bits.withColumn("last", F.lit(False)).unionByName(answers.withColumn("last", F.lit(True)))

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        said = right.to_pylist()
        out: dict[str, list] = {"id": [], "n_bytes": [], "spans": [], "kept": []}
        for row in left.to_pylist():
            x = _Block(row, {r["bucket"]: (r["bits"], r["hot"]) for r in said if not r["last"]}, window, count)
            answer = {r["bucket"]: r["bits"] for r in said if r["last"]}
            mask = np.frombuffer(b"".join(answer[v] for v, _, _ in _runs(x.entry_bucket[: x.cool])), np.uint64)
            shared = np.frombuffer(b"".join(answer[v] for v, _, _ in _runs(x.window_bucket)), bool)
            hit = np.zeros(len(x.raw) + 1, bool)
            cool, own = x.merged < x.cool, x.ids[x.doc]
            later = own > x.entry_id[x.merged]  # an equal surrounding stands in a smaller id of this block
            says = mask[x.merged[cool]]
            for i in range(window - DIGIT + 1):
                ok = (x.left >= i) & (x.right >= window - i)
                gone = later & ok
                gone[cool] |= ok[cool] & ((says >> _U(i)) & _U(1)).astype(bool)
                warm = np.flatnonzero(ok & ~cool)
                at = x.window_of[x.merged[warm] - x.cool, i]
                gone[warm] |= shared[at] | (own[warm] > x.window_id[at])
                hit[x.at[gone] - i] = True
            depth = np.zeros(len(x.raw) + window + 1, np.int32)
            at = np.flatnonzero(hit)
            depth[at] += 1
            depth[at + window] -= 1
            gone = np.cumsum(depth[: len(x.raw)]) > 0
            for d, (a, z) in enumerate(zip(x.bounds[:-1].tolist(), x.bounds[1:].tolist())):
                g = gone[a:z]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                out["id"].append(None if x.null[d] else int(x.ids[d]))
                out["n_bytes"].append(z - a)
                out["spans"].append([{"start": int(p), "end": int(q)} for p, q in edge.reshape(-1, 2)])
                out["kept"].append(x.raw[a:z][~g].tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": pa.array(out["id"], pa.int64()), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "spans": pa.array(out["spans"], span), "kept": pa.array(out["kept"], pa.binary())})

    final = per_block.cogroup(verdict.groupBy("block")).applyInArrow(removed, "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return final.withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    found = repeated_spans(docs, id_col, text_col, window)
    return found.select(id_col, "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
