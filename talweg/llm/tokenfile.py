"""Token files: documents as flat unsigned integers with 64-bit offsets, in ascending id order, read back by memory map.

Rows are dealt to partitions by ranges of the id and sorted there, so partition after partition holds ascending ids. Each
task writes one file of ids (16-bit if the vocabulary fits, else 32-bit), one of n + 1 offsets and one of document ids,
under a name that no other attempt uses, and returns one manifest row; the manifest, written once, decides which attempts
count. Where a partition starts in the whole sequence is a prefix sum over the manifest.

Nulls: a null text is an empty document (only the end id); null ids come first. Rows that share an id are ordered by text.
An empty table gives an empty manifest and an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load_vocabulary
from .common import fresh_path, input_partitions, slices, staged

#: Bytes that a worker remembers of pieces, in each of two generations. A bound on memory only; results don't depend on it.
MEMO_BYTES = 160 << 20
#: What an entry takes besides its letters and ids, about.
_ENTRY = 200
_PIECES: dict[int, PieceEncoder] = {}

#: The steps of a tokenizer file under which text is cut at blanks, numbers and letters before merging.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_blanks(content: str) -> bool:
    """Whether the file's own rules drop white space and never let a token reach over it or from a letter to a mark.

    Decided from the parsed normalizer and pre-tokenizer: composition, runs of white space to one blank, lower case, and a
    split into the matches of `PATTERN`, none of which holds white space.
    """
    spec = json.loads(content)
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps, first = normal.get("normalizers", []), (pre.get("pretokenizers") or [{}])[0]
    return (
        [x.get("type") for x in steps] == NORMALIZER and steps[1].get("pattern") == {"Regex": "\\s+"} and steps[1].get("content") == " "
        and first.get("type") == "Split" and first.get("pattern") == {"Regex": PATTERN} and first.get("invert") is True and first.get("behavior") == "Removed"
        and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
    )


@functools.cache
def closing_letters() -> frozenset[str]:
    """Letters after which a mark starts a piece of its own: composed and lower-cased they are letters only, by a Unicode version that every library knows."""
    old = unicodedata.ucd_3_2_0.category
    return frozenset(c for c in map(chr, range(0x10000)) if old(c)[0] == "L" and all(old(x)[0] == "L" for x in unicodedata.normalize("NFC", c).lower()))


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each new piece between blanks.

    That is exact where `cuts_at_blanks` holds, as no token then reaches over a blank; for other files the library gets
    whole texts.
    """

    def __init__(self, content: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts, self.closing = cuts_at_blanks(content), closing_letters()
        self.kind, self.young, self.old, self.held = kind, {"": b""}, {}, 0
        bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None

    @staticmethod
    def _lower(text: str) -> str:
        """The text in lower case where that is what the file's rules give and no letter could compose otherwise: fewer pieces to remember."""
        if "<" in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, pieces: list[str]) -> None:
        """Ask the library for many pieces in one text, with a bar between them, and cut its ids at the bars."""
        together = [s for s in pieces if "|" not in s and len(s) <= 200] if self.bar is not None else []
        alone = [s for s in pieces if "|" in s or len(s) > 200] if together else pieces
        self.young.update(zip(alone, self._ids(alone), strict=True))
        for k in range(0, len(together), 4096):
            part = together[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" | ".join([*part, ""])], add_special_tokens=False)[0].ids, np.int64)
            end = np.flatnonzero(ids == self.bar)
            if len(end) != len(part):  # a piece makes a bar of its own
                self.young.update(zip(part, self._ids(part), strict=True))
                continue
            flat, width = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
            for s, i, j in zip(part, [0, *(end + 1).tolist()], end.tolist(), strict=False):
                self.young[s] = flat[i * width : j * width]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._ids(texts)
        cut = [self._lower(t).replace("\n", " ").split(" ") for t in texts]
        if self.held > MEMO_BYTES:
            self.old, self.young, self.held = self.young, {"": b""}, 0
        young, old = self.young, self.old

        def unknown(pieces: set[str]) -> list[str]:
            new = []
            for s in pieces.difference(young):
                if s in old:
                    young[s] = old[s]
                    self.held += len(s) + len(old[s]) + _ENTRY
                else:
                    new.append(s)
            return new

        new = unknown(set().union(*cut) if cut else set())
        # Between a letter and the mark after it there is always a cut: "word." is "word" and ".".
        closed = [s for s in new if s[-1] in ".,!" and s[-2:-1] in self.closing]
        stems = {s[:-1] for s in closed}.union(x[-1] for x in closed)
        asked = [*set(new).difference(closed).union(unknown(stems))]
        self._ask(asked)
        for s in closed:
            young[s] = young[s[:-1]] + young[s[-1]]
        self.held += sum(len(s) + len(young[s]) + _ENTRY for k in (asked, closed) for s in k)
        get = young.__getitem__
        return [b"".join(map(get, c)) for c in cut]


def id_kind(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every text with the tokenizer file, append `end_id`, and write the token files under `path`.

    Returns the manifest: part, file, kind, n_docs, n_null (leading documents of null id), n_tokens, base (ids in all
    partitions before). The id column must be of an integer type.
    """
    from tokenizers import Tokenizer

    key, content = load_vocabulary(tokenizer)
    kind = id_kind(max(Tokenizer.from_str(content).get_vocab_size(with_added_tokens=True), end_id + 1))
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _PIECES:
            _PIECES.clear()
            _PIECES[key] = PieceEncoder(shared.value, kind)
        enc, end = _PIECES[key], np.array([end_id], kind).tobytes()
        part = TaskContext.get().partitionId()
        name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}"
        store, base = pafs.FileSystem.from_uri(name)
        sink, offsets, ids, nulls = None, [np.zeros(1, "<u8")], [], 0
        total, width = 0, np.dtype(kind).itemsize
        for b in slices(batches, "_text"):
            if sink is None:
                store.create_dir(base.rsplit("/", 1)[0], recursive=True)
                sink = store.open_output_stream(f"{base}.bin")
            got = enc.encode([t or "" for t in b.column(1).to_pylist()])
            sizes = np.fromiter((len(x) // width + 1 for x in got), np.int64, len(got))
            sink.write(end.join([*got, b""]))
            offsets.append((total + np.cumsum(sizes)).astype("<u8"))
            total += int(sizes.sum())
            nulls += b.column(0).null_count
            ids.append(b.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if sink is not None:
            sink.close()
            for tail, parts in (("off", offsets), ("doc", ids)):
                with store.open_output_stream(f"{base}.{tail}") as out:
                    out.write(np.concatenate(parts).tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "kind": [kind], "n_docs": [sum(map(len, ids))], "n_null": [nulls], "n_tokens": [total]})

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    n = partitions or input_partitions(docs)
    dealt = source.repartitionByRange(n, F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")
    manifest = staged(dealt.mapInArrow(run, "part int, file string, kind string, n_docs long, n_null long, n_tokens long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _mapped(name: str, kind: str) -> np.ndarray:
    """A file's numbers: memory-mapped where the shared folder is mounted, else read from its store."""
    store, path = pafs.FileSystem.from_uri(name)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document of the token files: id, start (ids of all documents before it), n_tokens, and ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tokens, off = _mapped(f"{row['file']}.bin", row["kind"]), _mapped(f"{row['file']}.off", "<u8").astype(np.int64)
                ids = np.array(_mapped(f"{row['file']}.doc", "<i8"))
                for k in range(0, row["n_docs"], 4096):
                    bounds = off[k : k + 4097]
                    crc = [zlib.crc32(tokens[i:j].astype("<u4").tobytes()) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    here = pa.array(ids[k : k + 4096], pa.int64(), mask=np.arange(k, k + len(crc)) < row["n_null"])
                    yield pa.RecordBatch.from_arrays([here, pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    n = input_partitions(manifest)
    return manifest.repartition(n, "part").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write token files into the shared folder and read them back."""
    return read(write(docs, tokenizer, end_id, fresh_path(docs.sparkSession, "tokens")))
