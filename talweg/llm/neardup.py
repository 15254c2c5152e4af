"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A shingle is five consecutive words (a shorter text is one shingle). Its weight is (1 + ln tf) x idf, idf being
0.5 + 0.5 x the mean over its words of ln((N+1)/(df+1)) / ln(N+1); document frequencies are counted over all documents, in
a fixed number of hashed slots. The damping keeps the similarity near to the plain share of common shingles, so members of
large groups of copies, whose words are frequent for that very reason, aren't driven apart.

Texts with the same words are one vertex. Each distinct text gets samples in proportion to its weights; four samples make a
band, and texts that share a band are candidates. Within a bucket a text is paired with its nearest leader by the samples,
and a text near to no leader becomes one; pairs are verified by the exact weighted Jaccard similarity and joined into
components. Then the texts that still share a bucket with a candidate of another component are sent to that bucket, where
all such candidates are compared exactly, so a link that no leader saw isn't lost. Buckets beyond `BUCKET` texts are dealt
into parts by a hash; the leaders of the parts meet in parts of their own, round by round, until one part is left, whose
leaders visit all parts. Of such a bucket the texts outside its largest component are then sent to every part that may hold a
candidate of theirs, leader or not: of two texts of different components one is outside the largest, so all candidates meet,
as in a bucket that wasn't dealt out.

Rows are known by a hash of id and text; that no two different rows share one is checked, else another seed is taken.

Nulls: a null text has no words; texts without words are alone. A null id ranks last. Of the same rows one is kept. Ties go
to the smallest id. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, FEW_IDS, input_partitions, mix, one_each, slices, span_hash, staged, text_buffer, with_rows, word_spans
from .graph import components, merged

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
SLOTS = 1 << 18
#: Texts of one bucket compared in one place.
BUCKET = 256
#: Candidates whose samples agree less are not verified: 48 samples of a pair at 0.8 agree in under 0.6 once in a thousand.
LEAST = 0.6
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_U = np.uint64
_SLOT = _U(64 - SLOTS.bit_length() + 1)


def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variates of the sampling scheme for 2**16 hash values: r, ln c (both from Gamma(2, 1)) and b."""
    g = np.random.default_rng(20100613)
    return g.gamma(2, 1, 1 << 16).astype(np.float32), np.log(g.gamma(2, 1, 1 << 16)).astype(np.float32), g.random(1 << 16, np.float32)


R, LN_C, B = _pool()
_ODD = mix(np.arange(1, SAMPLES + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many words each text has."""
    raw, bounds = text_buffer(column)
    data = _LOWER[raw]
    start, end, count = word_spans(_WORD[data], bounds)
    return span_hash(BYTE_VALUE[data], start, end), count


def shingles(word: np.ndarray, count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the distinct shingles (48-bit) in order, their weights, and the text of each."""
    n = len(count)
    first = np.cumsum(count) - count
    runs = np.maximum(count - WORDS + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(n), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + first[doc]
    have = np.minimum(count[doc], WORDS)
    rare = idf[(word >> _SLOT).astype(np.int64)]
    h, total = np.zeros(len(doc), _U), np.zeros(len(doc), np.float64)
    padded, rare = np.append(word, np.zeros(WORDS, _U)), np.append(rare, np.zeros(WORDS))
    for k in range(WORDS):
        inside = have > k
        h = h * _U(0x9E3779B97F4A7C15) + np.where(inside, padded[at + k], _U(k + 1))
        total += np.where(inside, rare[at + k], 0)
    h = mix(h) >> _U(16)
    key = (doc.astype(_U) << _U(48)) | h
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    tf = np.diff(np.append(new, len(key)))
    weight = (1 + np.log(tf)) * (0.5 + 0.5 * (total / np.maximum(have, 1))[order][new])
    return key[new] & _U((1 << 48) - 1), weight, doc[order][new]


def signatures(shingle: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Consistent weighted samples (n x SAMPLES, 32-bit). Texts without shingles get zeros."""
    out = np.zeros((n, SAMPLES), np.uint32)
    if not len(doc):
        return out
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    owner = doc[start]
    size = np.diff(np.append(start, len(doc)))
    ln_w = np.log(weight).astype(np.float32)
    spread = mix(shingle)
    for k in range(SAMPLES):
        at = ((spread * _ODD[k]) >> _U(48)).astype(np.int32)
        r, b = R[at], B[at]
        t = np.floor(ln_w / r + b)
        a = LN_C[at] - r * (t - b + np.float32(1))
        low = np.minimum.reduceat(a, start)
        hit = np.flatnonzero(a == np.repeat(low, size))
        which = hit[np.searchsorted(hit, start)]
        out[owner, k] = (mix(shingle[which] ^ (t[which].astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15)) ^ (_U(k) << _U(56))) >> _U(32)).astype(np.uint32)
    return out


def word_rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Scaled inverse document frequency of each slot, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int64), 0
        for b in slices(batches, "_text"):
            word, count = words(b.column(0))
            doc = np.repeat(np.arange(b.num_rows), count)
            seen = np.unique(doc * SLOTS + (word >> _SLOT).astype(np.int64))
            total += np.bincount(seen % SLOTS, minlength=SLOTS)
            n += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.append(at, SLOTS), pa.int32()), "n": np.append(total[at], n)})

    counted = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    full = np.zeros(SLOTS + 1)
    full[counted["slot"]] = counted["n"]
    n = full[SLOTS]
    return np.log((n + 1) / (full[:SLOTS] + 1)) / np.log(max(n + 1, 2))


def row_key(seed: int, id_: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), id_, text)


def _sketched(docs: DataFrame, shared, seed: int, id_col: str, text_col: str) -> DataFrame:
    """_key, id, h1, h2 (of the words), n_words, sig, bands of every document."""
    source = docs.select(row_key(seed, F.col(id_col), F.col(text_col)).alias("_key"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            n = b.num_rows
            word, count = words(b.column(2))
            first = np.cumsum(count) - count
            s, w, doc = shingles(word, count, shared.value)
            sig = signatures(s, w, doc, n)
            key = np.zeros((n, BANDS), _U)
            for k in range(BANDS):
                h = np.full(n, k + 1, _U)
                for j in range(ROWS):
                    h = mix(h * _U(0x9E3779B97F4A7C15) + sig[:, k * ROWS + j].astype(_U))
                key[:, k] = h
            h1, h2 = (span_hash(x, first, first + count).view(np.int64) for x in (word, mix(word + _U(77))))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(key.view(np.int64).ravel()))
            blob = pa.array([x.tobytes() for x in sig], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h1), pa.array(h2), pa.array(count, pa.int64()), blob, bands], names=["_key", "_id", "h1", "h2", "n_words", "sig", "bands"])

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_key long, _id {kind}, h1 long, h2 long, n_words long, sig binary, bands array<long>")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Of rows sorted by the first two columns: bounds of whole groups, and all columns as arrays (the last: signatures)."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        a, g = (held.column(k).to_numpy() for k in (0, 1))
        change = np.flatnonzero((a[1:] != a[:-1]) | (g[1:] != g[:-1])) + 1
        if len(change):
            yield np.append(0, change), _columns(held.slice(0, int(change[-1])))
            held = held.slice(int(change[-1]))
    if held is not None and held.num_rows:
        yield np.array([0, held.num_rows]), _columns(held)


def _columns(t: pa.Table) -> list[np.ndarray]:
    own = [t.column(k).to_numpy() for k in range(t.num_columns - 1)]
    return [*own, np.frombuffer(b"".join(t.column(t.num_columns - 1).to_pylist()), np.uint32).reshape(t.num_rows, SAMPLES)]


def _central(sig: np.ndarray) -> np.ndarray:
    """How often a text's samples are those of others in its group: the original of many copies leads, as it is nearest to all."""
    if len(sig) < 4:
        return np.zeros(len(sig), np.int64)
    _, back, n = np.unique(sig.astype(np.int64) + (np.arange(SAMPLES, dtype=np.int64) << 32), return_inverse=True, return_counts=True)
    return n[back].reshape(sig.shape).sum(1)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, part, id, sig) sorted -> candidate pairs with each text's nearest leader, and of leaders near to each other; lead: the text became a leader (a = b)."""
    for bounds, (key, _, vertex, sig) in _grouped(batches):
        out: list[tuple[int, int, int]] = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            s, v = sig[i:j], vertex[i:j]
            open_ = np.ones(j - i, bool)
            best, near, central = np.full(j - i, LEAST), np.full(j - i, -1), _central(s)
            while open_.any():
                lead = int(np.argmax(np.where(open_, central, -1)))
                agree = (s == s[lead]).mean(1)
                if near[lead] >= 0:
                    out.append((int(key[i]), int(v[near[lead]]), int(v[lead])))
                out.append((int(key[i]), int(v[lead]), int(v[lead])))
                agree[lead] = 0
                better = agree >= np.maximum(best, LEAST)
                better &= open_
                best[better], near[better] = agree[better], lead
                open_[lead] = False
                done = open_ & (best >= THRESHOLD)
                for m in np.flatnonzero(done).tolist():
                    out.append((int(key[i]), int(v[near[m]]), int(v[m])))
                open_ &= ~done
        if out:
            k, a, b = zip(*out)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(k, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _nearest_visitor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, part, id, component, visitor, sig) sorted -> each text with the nearest leader of another part and component."""
    for bounds, (_, _, vertex, part, visitor, sig) in _grouped(batches):
        a, b = [], []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            guest, own = np.flatnonzero(visitor[i:j] == 1) + i, np.flatnonzero(visitor[i:j] == 0) + i
            best, near = np.full(len(own), LEAST), np.full(len(own), -1)
            for g in guest.tolist():
                agree = np.where(part[own] == part[g], 0, (sig[own] == sig[g]).mean(1))
                better = agree >= best
                best[better], near[better] = agree[better], g
            a.append(vertex[own[near >= 0]])
            b.append(vertex[near[near >= 0]])
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, part, id, component, low, high, home, visitor, sig) sorted -> the texts and the other parts where each may have a candidate of another component.

    A text agrees with a leader of its part in THRESHOLD at least, so by the triangle inequality a part without a leader
    that agrees with the visitor in LEAST + THRESHOLD - 1 holds no candidate. low and high: the least and greatest
    component among a leader's texts.
    """
    reach = LEAST + THRESHOLD - 1 - 1e-9
    for bounds, (bucket, _, vertex, component, low, high, home, visitor, sig) in _grouped(batches):
        text, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            guest, own = np.flatnonzero(visitor[i:j] == 1) + i, np.flatnonzero(visitor[i:j] == 0) + i
            for x in own.tolist():
                other = guest[(low[guest] != component[x]) | (high[guest] != component[x])]
                parts = np.unique(home[other[(sig[other] == sig[x]).mean(1) >= reach]])
                text.append(np.full(len(parts), x))
                to.append(parts)
        at, part = np.concatenate(text), np.concatenate(to)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[at], pa.int64()), "part": pa.array(part, pa.int32()), "v": pa.array(vertex[at], pa.int64()), "c": pa.array(component[at], pa.int64()), "sig": pa.array([x.tobytes() for x in sig[at]], pa.binary())})


def _cross(s: np.ndarray, c: np.ndarray, side: np.ndarray, m: int) -> np.ndarray:
    """Later members of other components that are candidates of member m. Of sides 1 and 2 (members and visitors) only pairs across count."""
    other = np.flatnonzero((c[m + 1 :] != c[m]) & ((side[m] == 0) | (side[m + 1 :] != side[m]))) + m + 1
    return other[(s[other] == s[m]).mean(1) >= LEAST]


def _open_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, unit, id, component, side, sig) sorted -> the members that have a candidate of another component in their unit."""
    for bounds, (bucket, unit, vertex, component, sides, sig) in _grouped(batches):
        found = [np.zeros(0, np.int64)]
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            s, c, side = sig[i:j], component[i:j], sides[i:j]
            if (c == c[0]).all():
                continue
            open_ = np.zeros(j - i, bool)
            for m in range(j - i - 1):
                hit = _cross(s, c, side, m)
                open_[hit] = True
                open_[m] |= len(hit) > 0
            found.append(np.flatnonzero(open_) + i)
        at = np.concatenate(found)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[at], pa.int64()), "unit": pa.array(unit[at], pa.int64()), "v": pa.array(vertex[at], pa.int64()), "c": pa.array(component[at], pa.int64()), "side": pa.array(sides[at], pa.int32()), "sig": pa.array([x.tobytes() for x in sig[at]], pa.binary())})


def _exact_links(shared, threshold: float):
    """(bucket, unit, id, component, side, text, sig) sorted -> the links between components, every candidate compared exactly in place: pairs never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, (_, _, vertex, component, sides, text, sig) in _grouped(batches):
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                s, c, side, v = sig[i:j], component[i:j], sides[i:j], vertex[i:j]
                key, weight, doc = shingles(*words(pa.array(text[i:j], pa.string())), shared.value)
                start = np.searchsorted(doc, np.arange(j - i + 1))
                total = np.bincount(doc, weight, minlength=j - i)
                _, place = np.unique(key, return_inverse=True)
                own = np.zeros(place.max() + 1 if len(place) else 1)
                for m in range(j - i - 1):
                    hit = _cross(s, c, side, m)
                    if not len(hit):
                        continue
                    mine = slice(start[m], start[m + 1])
                    own[place[mine]] = weight[mine]
                    common = np.array([np.minimum(own[place[start[k] : start[k + 1]]], weight[start[k] : start[k + 1]]).sum() for k in hit.tolist()])
                    own[place[mine]] = 0
                    good = hit[common >= threshold * (total[m] + total[hit] - common)]
                    a.append(np.full(len(good), v[m]))
                    b.append(v[good])
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similarity(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Exact weighted Jaccard similarity of paired texts."""
    n = len(left)
    (ka, wa, da), (kb, wb, db) = (shingles(*words(x), idf) for x in (left, right))
    a, b = (da.astype(_U) << _U(48)) | ka, (db.astype(_U) << _U(48)) | kb
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    hit = b[at] == a if len(b) else np.zeros(len(a), bool)
    both = np.minimum(wa[hit], wb[at[hit]]) if len(b) else np.zeros(0)
    common = np.bincount(da[hit], both, minlength=n)
    every = np.bincount(da, wa, minlength=n) + np.bincount(db, wb, minlength=n) - common
    return np.divide(common, every, out=np.zeros(n), where=every > 0)


def _texts(text: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of text (_k, _t) whose key is among the distinct keys (k).

    Few keys are sent to the texts, which stay where they are; more of them meet the texts in a shuffle, and what is needed
    is staged, so each text is moved once. The README has figures of both ways.
    """
    keys = staged(keys, "needed-keys")
    if keys.count() <= FEW_IDS:
        return text.join(F.broadcast(keys), F.col("_k") == F.col("k"), "left_semi")
    return staged(text.join(keys, F.col("_k") == F.col("k"), "left_semi"), "needed-texts")


def _verified(pairs: DataFrame, text: DataFrame, shared, threshold: float) -> DataFrame:
    """The pairs (a, b) of row keys whose texts (_k, _t) are similar enough, staged."""
    some = _texts(text, pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct())
    right = pairs.join(some, F.col("b") == F.col("_k")).select("a", "b", F.col("_t").alias("_right"))
    whole = right.join(some, F.col("a") == F.col("_k")).select("a", "b", F.col("_t").alias("_left"), "_right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_left"):
            s = similarity(b.column(2), b.column(3), shared.value)
            yield b.select(["a", "b"]).append_column("similarity", pa.array(s)).filter(pa.array(s >= threshold))

    return staged(whole.mapInArrow(run, "a long, b long, similarity double").distinct(), "near-links")


def _keyed(docs: DataFrame, shared, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The sketches of all rows, staged, and the seed with which their keys tell different rows apart."""
    for seed in range(8):
        sketched = staged(_sketched(docs, shared, seed, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "sketches")
        what = F.struct(F.col("_id").isNull().alias("null"), "_id", "h1", "h2")
        if not sketched.groupBy("_key").agg(F.min(what).alias("a"), F.max(what).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).limit(1).count():
            return sketched, seed
    raise RuntimeError("no seed tells all rows apart")


def _dealt(rows: DataFrame, salt: int = 0, size: int | None = None) -> DataFrame:
    """(bucket, v) rows with their part of the bucket, whether it has several and how many. Buckets of one row drop out."""
    many = rows.groupBy("bucket").count().where("count > 1")
    parts = F.ceil(F.col("count") / (size or BUCKET)).cast("int")
    part = F.pmod(F.xxhash64("v", "bucket", F.lit(salt)), parts).cast("int")
    return rows.join(many, "bucket").select("bucket", part.alias("part"), "v", (parts > 1).alias("split"), parts.alias("parts"))


class _Search:
    """Candidates, their verification and the components that follow, over staged sketches."""

    def __init__(self, vertex: DataFrame, text: DataFrame, shared, threshold: float, partitions: int) -> None:
        self.text, self.shared, self.threshold, self.n = text, shared, threshold, partitions
        self.sig = vertex.select("v", "sig")
        held = staged(_dealt(vertex.select("v", F.explode("bands").alias("bucket"))), "bucket-members")
        self.signed = held.join(self.sig, "v")
        self.split = bool(held.where("split").limit(1).count())
        self.tested = self.known = None

    def sort(self, rows: DataFrame, unit: str = "part") -> DataFrame:
        return rows.repartition(self.n, "bucket", unit).sortWithinPartitions("bucket", unit, "v")

    def stars(self, rows: DataFrame, name: str = "stars") -> DataFrame:
        return staged(self.sort(rows.select("bucket", "part", "v", "sig")).mapInArrow(_stars, "bucket long, a long, b long"), name)

    def verify(self, pairs: DataFrame) -> None:
        """Verify pairs not tested before, and join what they link."""
        fresh = _ordered(pairs)
        new = staged(fresh.join(self.tested, ["a", "b"], "left_anti") if self.tested is not None else fresh, "star-pairs")
        if self.known is None or new.limit(1).count():
            found = _verified(new, self.text, self.shared, self.threshold)
            self.tested = new if self.tested is None else self.tested.unionByName(new)
            self.known = components(found.select("a", "b")) if self.known is None else merged(self.known, found.select("a", "b"))

    def labelled(self) -> DataFrame:
        known = self.known.withColumnRenamed("v", "w")
        return self.signed.join(known, F.col("v") == F.col("w"), "left").select("bucket", "part", "v", F.coalesce("c", "v").alias("c"), "sig", "split", "parts")

    def champions(self, stars: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """Leaders of the last of the rounds in which the leaders of a bucket's parts meet, and the stars of those rounds.

        A bucket whose leaders hardly get fewer in a round has none; `away` finds its links all the same.
        """
        level = stars.where("a = b").select("bucket", F.col("a").alias("v")).join(self.signed.where("split").select("bucket", "v"), ["bucket", "v"], "left_semi")
        champions, rounds, before = [], [], 0
        for k in range(1, 64):
            dealt = staged(_dealt(level, k, 4 * BUCKET), "leaders")
            now = dealt.count()
            if not now or (before and now > before * 0.7):
                break
            before = now
            rounds.append(self.stars(dealt.join(self.sig, "v"), "round"))
            led = rounds[-1].where("a = b").select("bucket", F.col("a").alias("v"))
            open_ = dealt.where("split").select("bucket").distinct()
            champions.append(led.join(open_, "bucket", "left_anti"))
            level = led.join(open_, "bucket", "left_semi")
        return reduce(DataFrame.union, champions, level.limit(0)).distinct(), rounds

    def visit(self, champions: DataFrame) -> None:
        """Each text of a bucket that was dealt out meets the bucket's champions."""
        rows = self.labelled().where("split")
        own = champions.join(rows.select("bucket", F.col("part").alias("home"), "v", "c", "sig", "parts"), ["bucket", "v"])
        everywhere = own.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        guests = everywhere.where("part <> home").select("bucket", "part", "v", "c", F.lit(1).alias("visitor"), "sig")
        home = rows.select("bucket", "part", "v", "c", F.lit(0).alias("visitor"), "sig")
        self.verify(self.sort(home.union(guests)).mapInArrow(_nearest_visitor, "a long, b long"))

    def away(self, stars: DataFrame) -> list[DataFrame]:
        """Texts outside the largest component of a bucket that was dealt out, with the members of the parts they are sent to. A unit holds about BUCKET visitors at most."""
        rows = self.labelled().where("split")
        # Staged, so that joins by bucket read plain exchanges, whose large partitions Spark splits.
        main = staged(rows.groupBy("bucket", "c").count().groupBy("bucket").agg(F.max_by("c", F.struct("count", "c")).alias("main")), "largest-components")
        strays = staged(rows.join(main, "bucket").where("c <> main").select("bucket", "part", "v", "c", F.col("c").alias("low"), F.col("c").alias("high"), F.col("part").alias("home"), F.lit(0).alias("visitor"), "sig"), "strays")
        if not strays.limit(1).count():
            return []
        # Leaders, with the components among their texts, meet the strays of each other part in units of a few BUCKETs.
        known = self.known.withColumnRenamed("v", "w")
        led = stars.join(strays.select("bucket").distinct(), "bucket", "left_semi").join(known, F.col("b") == F.col("w"), "left").select("bucket", "a", F.coalesce("c", "b").alias("c"))
        balls = staged(led.groupBy("bucket", F.col("a").alias("v")).agg(F.min("c").alias("low"), F.max("c").alias("high")), "balls")
        salts = staged(balls.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / (4 * BUCKET)).alias("salts")), "salts")
        unit = lambda salt: (F.col("part") + (salt + 1) * F.lit(1 << 32)).alias("unit")
        own = balls.join(rows.select("bucket", F.col("part").alias("home"), "v", "c", "sig"), ["bucket", "v"]).join(salts, "bucket")
        guests = strays.select("bucket", "part").distinct().join(own, "bucket").where("part <> home").select("bucket", unit(F.pmod(F.xxhash64("v"), "salts")), "v", "c", "low", "high", "home", F.lit(1).alias("visitor"), "sig")
        hosts = strays.join(salts, "bucket").select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("bucket", unit(F.col("salt")), "v", "c", "low", "high", "home", "visitor", "sig")
        sent = staged(self.sort(hosts.union(guests), "unit").mapInArrow(_routes, "bucket long, part int, v long, c long, sig binary").dropDuplicates(["bucket", "part", "v"]), "visitors")
        units = staged(sent.groupBy("bucket", "part").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("units")), "visited-parts")
        come = sent.join(units, ["bucket", "part"]).select("bucket", unit(F.pmod(F.xxhash64("v"), "units")), "v", "c", F.lit(2).alias("side"), "sig")
        home = rows.join(units, ["bucket", "part"]).select("*", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("salt"))
        return [come, home.select("bucket", unit(F.col("salt")), "v", "c", F.lit(1).alias("side"), "sig")]

    def last_links(self, meet: list[DataFrame]) -> None:
        """Every candidate of another component that meets in a unit, compared exactly."""
        kinds = "bucket long, unit long, v long, c long, side int, sig binary"
        open_ = staged(self.sort(reduce(DataFrame.union, meet), "unit").mapInArrow(_open_members, kinds), "open-members")
        if open_.limit(1).count():
            text = _texts(self.text, open_.select(F.col("v").alias("k")).distinct())
            told = open_.join(text, F.col("v") == F.col("_k")).select("bucket", "unit", "v", "c", "side", "_t", "sig")
            last = staged(_ordered(self.sort(told, "unit").mapInArrow(_exact_links(self.shared, self.threshold), "a long, b long")), "last-links")
            self.known = merged(self.known, last)

    def run(self) -> DataFrame:
        """(v, c) of every vertex that has a link."""
        stars = self.stars(self.signed)
        champions, rounds = self.champions(stars) if self.split else (None, [])
        self.verify(reduce(DataFrame.unionByName, [stars, *rounds]).select("a", "b"))
        meet = []
        if self.split:
            self.visit(champions)
            meet = self.away(stars)
        own = self.labelled().select("bucket", F.col("part").cast("long").alias("unit"), "v", "c", F.lit(0).alias("side"), "sig")
        self.last_links([own, *meet])
        return self.known


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, int]:
    """One row per document: id, class_id (the least id of its class), class_size, kept, _key; and the seed of the keys."""
    shared = docs.sparkSession.sparkContext.broadcast(word_rarity(docs, text_col))
    sketched, seed = _keyed(docs, shared, id_col, text_col)
    same = staged(sketched.where("n_words > 0").groupBy("h1", "h2").agg(F.min("_key").alias("rep")), "distinct-texts")
    member = sketched.select("_row", "_key", "_id", "h1", "h2").join(same, ["h1", "h2"], "left").select("_row", "_key", "_id", F.coalesce("rep", "_key").alias("rep"), F.col("rep").isNull().alias("alone"))
    vertex = sketched.join(same, ["h1", "h2"]).where("_key = rep").select(F.col("rep").alias("v"), "sig", "bands").dropDuplicates(["v"])
    text = docs.select(row_key(seed, F.col(id_col), F.col(text_col)).alias("_k"), F.col(text_col).alias("_t"))
    known = _Search(staged(vertex, "vertices"), text, shared, threshold, input_partitions(docs)).run()
    of = F.struct(F.coalesce("c", "rep").alias("c"), F.when(F.col("alone"), F.col("_row")).alias("row"))
    labels = staged(member.join(known, F.col("rep") == F.col("v"), "left").select("_row", "_key", "_id", of.alias("_class")), "near-labels")
    rank = F.struct(F.col("_id").isNull().alias("n"), F.col("_id"), F.col("_row"))
    least = staged(labels.groupBy("_class").agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("class_size")), "near-classes")
    return labels.join(least, "_class").select(F.col("_id").alias(id_col), F.col("_first._id").alias("class_id"), "class_size", (F.col("_row") == F.col("_first._row")).alias("kept"), F.col("_key")), seed


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    return classes(docs, id_col, text_col, threshold)[0].drop("_key")


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all its columns, whatever their names. Of equal rows one stays, as in `dedup`."""
    found, seed = classes(docs, id_col, text_col, threshold)
    decided = staged(found.select(F.col(id_col).alias("id"), F.col("_key").alias("key"), "kept"), "near-decisions")
    doc = F.col("doc")
    return one_each(docs, with_rows(decided), id_col, row_key(seed, doc.getField(id_col), doc.getField(text_col)), text_col)
