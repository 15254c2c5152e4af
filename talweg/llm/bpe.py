"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes tokens for each word. By the structure of byte-pair merges, a sequence of tokens is the
encoding of its bytes exactly if each adjacent pair is the encoding of the pair's bytes, so vectorised checks of adjacent
pairs decide whether a proposal stands. Only words with a failing pair are merged exactly, merge by merge.

Nulls: a null text counts as empty (no token, empty decoded text); a null id stays null. Repeated rows are encoded each.
An empty table gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: How byte-level BPE splits text before merging (a fixed, public pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that a worker remembers of pieces in each of two generations, and of words. A bound on memory only; results don't depend on it.
MEMO_BYTES = 24 << 20
#: What an entry takes besides its letters and ids, about; and the longest piece that is remembered.
_ENTRY, _LONGEST = 200, 256
#: Words of more bytes are proposed and merged one at a time.
LONG_WORD = 96


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Arrays of a byte-level BPE vocabulary: bytes and merge of each token, ranks of pairs, and a trie of proposable tokens.

    Its size is fixed by the vocabulary file, so it can be broadcast.
    """

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        letter, ids = byte_letters(), spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        n = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token: list[bytes] = [b""] * n
        for word, k in ids.items():
            self.token[k] = bytes(letter[c] for c in word)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(re.search(r"\s", s) for s in self.special):
            raise ValueError("added tokens that hold white space aren't supported")
        for word, k in self.special.items():
            self.token[k] = word.encode()
        self.size = n
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs = {}
        for r, (a, b) in enumerate(merges):
            whole = ids[a + b]
            pairs[ids[a], ids[b]] = (r, whole)
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, ids[a], ids[b]
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], np.array([r for r, _ in pairs.values()], np.int64)[order]
        self.pairs = pairs
        self.merge_rank = {a * n + b: r for (a, b), (r, _) in pairs.items()}
        self.merge_to = [whole for _, whole in pairs.values()]
        self.byte_id = [ids[c] for c, _ in sorted(letter.items(), key=lambda x: x[1])]
        own = np.array(sorted(ids.values()), np.int64)
        made = own[self.left[own] >= 0]
        sound = np.zeros(n, bool)
        sound[own[self.left[own] < 0]] = True
        good = self.compatible(self.left[made], self.right[made], inner=True)
        for k, ok in sorted(zip(made.tolist(), good.tolist()), key=lambda x: self.rank[x[0]]):
            sound[k] = ok and sound[self.left[k]] and sound[self.right[k]]
        self._grow([(self.token[k], k) for k in own[sound[own]].tolist()])

    def _grow(self, words: list[tuple[bytes, int]]) -> None:
        self.whole = {w: k for w, k in words}
        edges: dict[int, int] = {}
        at = [-1]
        for w, k in words:
            node = 0
            for b in w:
                nxt = edges.get(node * 256 + b)
                if nxt is None:
                    nxt = edges[node * 256 + b] = len(at)
                    at.append(-1)
                node = nxt
            at[node] = k
        self.edges = edges
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.edge_key, self.edge_to = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.node_token = np.array(at, np.int64)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """Whether tokens a, b are the encoding of their joined bytes. inner: the merge of a and b themselves is allowed.

        The merges on either side of the border are undone from the last to the first; at each point the two tokens that
        then meet must not merge before one of them is merged inwards.
        """
        top = np.iinfo(np.int64).max
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit_x, limit_y = np.full(len(a), top), np.full(len(a), top)
        first = inner
        while len(live):
            if not first:
                r = self._rank_of(x, y)
                hit = (r != top) & (r < limit_x) & (r <= limit_y)
                good[live[hit]] = False
                on = ~hit
            else:
                on, first = np.ones(len(live), bool), False
                limit_x = limit_y = self._rank_of(x, y)
            rx, ry = self.rank[x], self.rank[y]
            on &= (rx >= 0) | (ry >= 0)
            undo_y = ry >= rx
            limit_x, limit_y = np.where(undo_y, limit_x, rx), np.where(undo_y, ry, limit_y)
            x, y = np.where(undo_y, x, self.right[x]), np.where(undo_y, self.left[y], y)
            live, x, y, limit_x, limit_y = live[on], x[on], y[on], limit_x[on], limit_y[on]
        return good

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words at once: tokens, and the word of each."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        pos = end - size
        word, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        token, till = np.full(len(words), -1, np.int64), pos.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            key = node * 256 + data[np.minimum(pos, len(data) - 1)]
            at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            step = (self.edge_key[at] == key) & (pos < end)
            node = np.where(step, self.edge_to[at], 0)
            pos = np.where(step, pos + 1, till)
            known = self.node_token[node]
            hit = step & (known >= 0)
            stop = ~step
            if stop.any():
                found.append((token[stop], word[stop]))
            token = np.where(hit, known, token)
            till = np.where(hit, pos, till)
            on = step | (pos < end)
            if not on.all():
                word, node, pos, token, till, end = word[on], node[on], pos[on], token[on], till[on], end[on]
        tokens, owner = np.concatenate([t for t, _ in found]), np.concatenate([w for _, w in found])
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order]

    def propose_one(self, word: bytes) -> np.ndarray:
        """The same for one long word."""
        out, pos, n, edges, at = [], 0, len(word), self.edges, self.node_token
        while pos < n:
            node, here, best, till = 0, pos, -1, pos
            while here < n and (nxt := edges.get(node * 256 + word[here])) is not None:
                node, here = nxt, here + 1
                if at[node] >= 0:
                    best, till = int(at[node]), here
            out.append(best)
            pos = till
        return np.array(out, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost first."""
        parts = [self.byte_id[b] for b in word]
        pairs = self.pairs
        if len(parts) <= LONG_WORD:
            get, size, none = self.merge_rank.get, self.size, len(pairs)
            ranks = [get(a * size + b, none) for a, b in zip(parts, parts[1:])]
            while ranks and (r := min(ranks)) < none:
                k = ranks.index(r)
                parts[k] = self.merge_to[r]
                del parts[k + 1], ranks[k]
                if k:
                    ranks[k - 1] = get(parts[k - 1] * size + parts[k], none)
                if k < len(ranks):
                    ranks[k] = get(parts[k] * size + parts[k + 1], none)
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(got[0], k, parts[k], parts[k + 1]) for k in range(len(parts) - 1) if (got := pairs.get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[k], parts[j], after[k] = pairs[a, b][1], -1, after[j]
            if after[j] < len(parts):
                before[after[j]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q < len(parts) and (got := pairs.get((parts[p], parts[q]))):
                    heapq.heappush(heap, (got[0], p, parts[p], parts[q]))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (bytes without a token border of the pre-splitting pattern inside)."""
        out: list[np.ndarray | None] = [None] * len(words)
        short = []
        for k, w in enumerate(words):
            known = self.whole.get(w)
            if known is not None:
                out[k] = np.array([known], "<u4")
            elif len(w) > LONG_WORD:
                t = self.propose_one(w)
                out[k] = (t if self.compatible(t[:-1], t[1:]).all() else np.array(self.merge(w))).astype("<u4")
            else:
                short.append(k)
        if short:
            some = [words[k] for k in short]
            token, owner = self.propose(some)
            inside = owner[:-1] == owner[1:]
            pair, back = np.unique((token[:-1] * self.size + token[1:])[inside], return_inverse=True)
            bad = ~self.compatible(pair // self.size, pair % self.size)
            failing = np.zeros(len(some), bool)
            failing[owner[:-1][inside][bad[back]]] = True
            bound = np.searchsorted(owner, np.arange(len(some) + 1)).tolist()
            token = token.astype("<u4")
            for j, k in enumerate(short):
                out[k] = np.array(self.merge(some[j]), "<u4") if failing[j] else token[bound[j] : bound[j + 1]]
        return out  # type: ignore[return-value]


class Encoder:
    """Whole texts to ids, remembering the ids of pieces that it has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.split = regex.compile(PATTERN)
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.word: dict[str, bytes] = {}
        self.held = self.words_held = 0

    #: Runs of white space stay with the word after them, as the pattern's alternatives never look further back.
    piece = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
    odd = re.compile(r"[^\S \t-\r]")

    def pieces(self, text: str) -> list[str]:
        """Parts that are encoded alike wherever they stand; the whole text if it has white space of other kinds."""
        return [text] if self.odd.search(text) else self.piece.findall(text)

    def _learn(self, new: list[str]) -> None:
        split = self.split.findall
        parts: list[list[str | int]] = []
        for s in new:
            if self.marks and (found := self.marks.split(s))[1:]:
                own: list[str | int] = []
                for k, x in enumerate(found):
                    own += [self.v.special[x]] if k % 2 else split(x)
            else:
                own = split(s)
            parts.append(own)
        words = [*dict.fromkeys(w for own in parts for w in own if isinstance(w, str) and w not in self.word)]
        if self.words_held > MEMO_BYTES:
            self.word.clear()
            self.words_held = 0
            words = [*dict.fromkeys(w for own in parts for w in own if isinstance(w, str))]
        for w, ids in zip(words, self.v.encode_words([w.encode() for w in words]), strict=True):
            self.word[w] = ids.tobytes()
            self.words_held += len(w) + ids.nbytes + _ENTRY
        for s, own in zip(new, parts, strict=True):
            self.young[s] = b"".join([self.word[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in own])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        seen = set().union(*cut) if cut else set()
        if self.held > MEMO_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        new = []
        for s in seen:
            if s not in young:
                if s in old:
                    young[s] = old[s]
                    self.held += len(s) + len(old[s]) + _ENTRY
                else:
                    new.append(s)
        if new:
            self._learn(new)
            self.held += sum(len(s) + len(young[s]) + _ENTRY for s in new)
        get = young.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for s in new:
            if len(s) > _LONGEST:
                self.held -= len(s) + len(young.pop(s)) + _ENTRY
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that aren't UTF-8 become the replacement character."""
        return b"".join(map(self.v.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODER: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """This worker's encoder for a broadcast vocabulary."""
    if shared.value[0] not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[shared.value[0]] = Encoder(Vocabulary(shared.value[1]))
    return _ENCODER[shared.value[0]]


def load_vocabulary(path: str) -> tuple[int, str]:
    """A vocabulary file's digest and content, as read on the driver."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    return int.from_bytes(hashlib.sha256(content.encode()).digest()[:8], "big"), content


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every document, by the byte-level BPE vocabulary file `vocabulary`."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in slices(batches, "_text"):
            ids = enc.encode([t or "" for t in b.column(1).to_pylist()])
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[id_col, "ids"])

    source = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids. Null ids give an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [enc.decode(np.array(x or [], "<u4").tobytes()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    source = tokens.select(F.col(id_col), F.col(ids_col).alias("_ids"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every document and decode its ids again, in one pass over the texts.

    Returns id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 (UTF-8), and the
    columns named in `keep`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    names = [id_col, *keep, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in slices(batches, "_text"):
            ids = enc.encode([t or "" for t in b.column(0).to_pylist()])
            sha = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids]
            size = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], size, pa.array(sha, pa.string()), pa.array(back, pa.string())], names=names)

    source = docs.select(F.col(text_col).alias("_text"), id_col, *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")
