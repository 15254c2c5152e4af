"""Importance resampling, chat formatting and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.llm import ann, chat, importance, negatives

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n_features string, weight string, score string, rank string, key string, b string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "r", "k", "b") for i, t in rows], DOCS)


def _features(text, longest):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in range(1, longest + 1) for i in range(len(words) - k + 1)], len(words)


@pytest.mark.parametrize("longest", [1, 3])
def test_importance_equals_its_definition(spark, longest):
    r = random.Random(4)
    vocabulary = ["alpha", "Beta", "gamma", "É́tude", "x1", "naïve", "日本", "ÀB", "the", "of"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) + r.choice(["", "!", "\n—"]) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(20)] + [(200, None), (201, ""), (202, "word " * 150_000), (203, "...")]
    target = [(0, "alpha beta the of " * 9), (1, None), (2, "alpha beta the of " * 9)]
    got = {x["doc_id"]: x for x in importance.resample(_docs(spark, rows), _docs(spark, target), longest=longest).collect()}
    source, goal = np.zeros(10_000), np.zeros(10_000)
    for t, where in [*((t, source) for _, t in rows), *((t, goal) for _, t in target)]:
        np.add.at(where, _features(t, longest)[0], 1)
    gain = [math.floor(1000 * math.log((t + 1) * (source.sum() + 10_000) / ((s + 1) * (goal.sum() + 10_000)))) for s, t in zip(source, goal)]
    want = {}
    for i, t in rows:
        b, n = _features(t, longest)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        want[i] = (len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n)
    able = sorted((i for i in want if want[i][3] >= 20), key=lambda i: (-want[i][2], i))
    place = {i: k + 1 for k, i in enumerate(able[: len(able) * 10 // 100])}
    assert {i: (x["n_features"], x["weight"], x["score"], x["rank"]) for i, x in got.items()} == {i: (*want[i][:3], place.get(i)) for i in want}


def test_importance_of_odd_rows(spark):
    assert importance.resample(_docs(spark, []), _docs(spark, [])).count() == 0
    rows = [(None, "one two"), (5, "one two"), (5, "one two"), (5, None)]
    got = importance.resample(_docs(spark, rows), _docs(spark, [])).collect()
    assert sorted((x["doc_id"] or -1, x["n_features"]) for x in got) == [(-1, 2), (5, 0), (5, 2), (5, 2)] and all(x["rank"] is None for x in got)


def _folded(log):
    """One event after the other, as a client would replay them."""
    order = {k: i for i, k in enumerate(chat.KINDS)}
    out = {}
    for conv, turn, _, kind, role, text in sorted((e for e in log if e[3] in order), key=lambda e: (e[0] is not None, e[0] or 0, e[1] is not None, e[1] or 0, e[2] is not None, e[2] or 0, order[e[3]], e[4] is not None, e[4] or "", e[5] or "")):
        messages = out.setdefault((conv, turn), [])
        if kind == "message" or not messages:
            messages.append([[], ""])
        m = messages[-1]
        m[0].append(role)
        m[1] = {"message": text or "", "delta": m[1] + (text or ""), "edit": text or "", "regenerate": ""}[kind]
    turns = {}
    for (conv, _), messages in sorted(out.items(), key=lambda x: (x[0][1] is not None, x[0][1] or 0)):
        turns.setdefault(conv, []).extend((next((r for r in roles if r is not None), ""), t) for roles, t in messages)
    return turns


def test_chat_logs_fold_render_and_come_back(spark, tmp_path):
    r = random.Random(9)
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[NAME]", "[/ROLE]", "\\", "\\\\", "<", "/s>", "INST]", " ", "\n", "é😀", "word", "$1", "<<s>"]
    text = lambda: None if r.random() < 0.05 else "".join(r.choice(pieces) for _ in range(r.randint(0, 9)))
    roles = ["system", "user", "assistant", "tool [NAME] x", "", None]
    log = [(r.choice([None, 1, 2, 3, 3, 3, 3]), r.choice([None, 0, 1, 2, 3]), r.choice([None, *range(12)]), r.choice([*chat.KINDS, "delta", "delta", "typing"]), r.choice(roles), text()) for _ in range(700)]
    log.append((8, 0, 0, "message", "assistant", "long <s> \\ " * 300_000))
    events = spark.createDataFrame([(*e, "clash", "clash") for e in log], "conv_id long, turn long, seq long, kind string, role string, text string, segment string, part string")
    path = f"file://{tmp_path}/chat"
    chat.write(chat.fold(events), path)
    want = _folded(log)
    got = {x["conv_id"]: x for x in chat.digests(chat.read(spark, path)).collect()}
    assert set(got) == set(want)
    segments = {}
    for x in spark.read.parquet(path).collect():
        segments.setdefault(x["conv"], []).append(x)
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        x = got[conv]
        assert (x["n_turns"], x["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest())
        assert (x["loss_chars"], x["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        whole = "".join(s["segment"] for s in sorted(segments[conv], key=lambda s: s["start"]))
        assert x["formatted_chars"] == len(whole)
        # No mark of the template stands where a text is, and the loss spans count from the conversation's start.
        spans = [whole[s["loss_from"] : s["loss_to"]] for s in sorted(segments[conv], key=lambda s: s["start"]) if s["loss_from"] is not None]
        assert "".join(re.sub(r"\\(\\?)", r"\1", s) for s in spans) == loss and not any(m in s for s in spans for m in chat._ALL)
        assert sum(whole.count(m) for m in ("[INST]", "<s>", "<<SYS>>", "[ROLE]")) == len(turns)


def test_chat_of_odd_tables(spark):
    odd = spark.createDataFrame([(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (None, None, None, "t", "x"), (2, 1, "assistant", "", "x")], "conv_id long, turn long, role string, text string, chars string")
    got = {x["conv_id"]: x for x in chat.format_all(odd).collect()}
    assert set(got) == {1, 2, None, -7} and (got[1]["n_turns"], got[2]["loss_chars"], got[None]["n_turns"]) == (2, 0, 1)
    both = hashlib.sha256(b"user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n").hexdigest()
    assert (got[-7]["turns_sha256"], got[-7]["loss_chars"]) == (both, 21)
    assert chat.format_all(odd.limit(0)).count() == 1


def _pairs(rows, every, k=5, m=3, least=50, most=95):
    """Every anchor against every row."""
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a))
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            bad = [(-t, i) for t, i, other in scored if other != label and least * -s <= 100 * -t <= most * -s]
            out += [(a, p, r + 1, i, -s, t) for r, (t, i) in enumerate(bad[:m])]
    return sorted(out)


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], "vec_id long, embedding array<float>, label int, v string, home string")


def _mined(spark, rows, cell_rows, every=5):
    table = _vectors(spark, rows)
    return negatives.joined(table, F.col("id") % every == 0, 5, 3, 50, 95, 256, "vec_id", "label", "embedding", cell_rows)


@pytest.mark.parametrize("cell_rows", [5000, 20])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(negatives, "GROUP", 8)
    monkeypatch.setattr(negatives, "CHUNK", 64)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)) * rng.choice([0.1, 1, 3], (300, 1))
    x[50:90] = x[50]  # one very common vector, ties by id
    x[100:103] = 0
    rows = [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, 4))) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1005, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1010, [float("nan")] * 6, 1), (1015, [float("inf")] * 6, 1), (1020, [1.0] * 6, None), (None, [1.0] * 6, 1), (1025, [], 1), (1030, [1.0] * 5, 1)]
    got, _ = _mined(spark, rows + odd, cell_rows)
    whole = [(i, label, [math.floor(256 * c) for c in v]) for i, v, label in rows]
    assert sorted(map(tuple, got.collect())) == _pairs(whole, 5)


def test_bounds_keep_rows_from_groups_that_they_cannot_serve(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 10)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    centres *= 4 / np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(c)) for c in centres[i % 30] + rng.normal(size=16) * 0.05], int(rng.integers(0, 2))) for i in range(3000)]
    got, counted = _mined(spark, rows, 50, every=10)
    assert sum(c["copied"] for c in counted) < 0.5 * sum(c["all"] for c in counted)
    whole = [(i, label, [math.floor(256 * c) for c in v]) for i, v, label in rows]
    few = set(range(0, 3000, 250))
    want = [x for x in _pairs([r for r in whole], 250)]
    assert sorted(tuple(x) for x in got.collect() if x["anchor_id"] in few) == want


def test_hard_negatives_of_odd_tables(spark):
    assert _mined(spark, [], 20)[0].count() == 0 and _mined(spark, [(1, [1.0], 2)], 20)[0].count() == 0
    assert _mined(spark, [(5, [1.0], 2), (5, [2.0], 1), (6, [1.5], 2), (7, [2.0], 1)], 20)[0].count() == 1
    with pytest.raises(ValueError, match="long"):
        _mined(spark, [(5, [1e30], 2)], 20)
    big = [(i, [2.0**18 * (i + 1), -1.0], i % 2) for i in range(12)]
    assert sorted(map(tuple, _mined(spark, big, 20)[0].collect())) == _pairs([(i, label, [math.floor(256 * c) for c in v]) for i, v, label in big], 5)


@pytest.mark.parametrize(("spread", "most"), [(0.3, 0.1), (1.0, 0.5)])
def test_the_search_stops_before_it_has_seen_everything(spread, most):
    """Rows verified on clustered vectors, and recall against all pairs."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(100, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = centres[rng.integers(0, 100, 8000)] + rng.normal(size=(8000, 64)) * spread / 8
    ids, top = np.arange(8000), float(np.sqrt((v * v).sum(1).max()))
    project = rng.standard_normal((65, ann.DIMENSIONS))
    points = v @ project[:-1] + np.sqrt(np.maximum(top * top - (v * v).sum(1), 0))[:, None] * project[-1]
    at = np.arange(0, 8000, 100)
    q = v[at]
    qp = (q * (top / np.sqrt((q * q).sum(1)))[:, None]) @ project[:-1]
    tally = [0]
    found = ann.search_chunk(ids, v, points, ids[at], q, qp, np.full(len(at), -np.inf), 20, top, ann.chi_square_quantile(ann.CONFIDENCE, ann.DIMENSIONS), tally)
    s = q @ v.T
    s[np.arange(len(at)), at] = -np.inf
    true = {(int(i), int(j)) for i, near in zip(ids[at], np.argsort(-s, 1)[:, :20]) for j in near}
    assert len(true & set(zip(found[0].tolist(), found[1].tolist()))) >= 0.9 * len(true)
    assert tally[0] < most * len(at) * 8000


def test_rows_are_sliced_before_their_numbers_leave_16_bits():
    import pyarrow as pa

    from talweg.llm import common

    whole = pa.RecordBatch.from_arrays([pa.array(["a b"] * 70_000)], names=["text"])
    assert [b.num_rows for b in common.slices(iter([whole]))] == [1 << 15, 1 << 15, 70_000 - (1 << 16)]


def test_a_long_text_among_short_ones_and_clashing_columns(spark):
    """Operators on pairs, spans and ids with a text of three million characters, and columns named like their own."""
    from talweg.llm import bpe, exactdedup, langid, licenses, mixing, neardup, suffixdedup, tokenfile

    long = "Licensed under the Apache License, they said again. " * 60_000
    rows = [(1, long, "en", "a", 1, "x", "x", "x"), (2, long + " end", "en", "b", 1, "x", "x", "x"), (3, "short text", None, None, None, "x", "x", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_bytes string, labels string, kept string")
    kept = {r["doc_id"]: r for r in suffixdedup.digest(d).collect()}
    assert kept[1]["n_removed"] == 0 and kept[2]["n_bytes"] == len(long) + 4 and kept[2]["n_removed"] >= len(long)
    assert {r["doc_id"]: r["n_base"] for r in licenses.scan(d).collect()} == {1: 60_000, 2: 60_000, 3: 0}
    assert {r["doc_id"]: r["kept"] for r in exactdedup.dedup(d).collect()} == {1: True, 2: True, 3: True}
    assert {r["doc_id"]: r["class_size"] for r in neardup.dedup(d).collect()} == {1: 2, 2: 2, 3: 1}
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.mix(d).collect()} == {1: 480_000, 2: 480_001, 3: 2}
    assert langid.identify(d).count() == 3
    import public_tokenizers

    got = {r["doc_id"]: r for r in bpe.round_trip(d, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got[1]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    files = {r["doc_id"]: r["n_tokens"] for r in tokenfile.round_trip(d, public_tokenizers.path("word_bpe_49k.json"), 2).collect()}
    assert files[3] == 3 and files[2] > files[1] > 60_000


def test_the_pipeline_runs_over_a_folder(spark, tmp_path):
    """run() itself: copies and near copies go, what is left is encoded as the library does, and what stages staged is deleted."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from talweg.storage import staged_so_far

    r = random.Random(12)
    words = {"en": "the river carries cold water down from hills where sheep graze all summer long".split(), "fr": "la rivière porte une eau froide depuis les collines où paissent des moutons".split()}
    made = {k: " ".join(r.choice(words[("en", "fr")[k % 2]]) + r.choice(["", "s", "x", "q"]) for _ in range(60)) for k in range(30)}
    texts = made | {100: made[3], 101: made[4] + "\n", 102: made[5] + " added", 103: "12 34 !!", 104: None}
    rows = [(k, t, ("en", "fr")[k % 2], f"s{k % 3}", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = staged_so_far()
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert staged_so_far() == before
    assert 0 < len(got) <= 30 and not {103, 104} & set(got)
    assert all(len({a, b} & set(got)) <= 1 for a, b in ((3, 100), (4, 101), (5, 102)))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, x in got.items():
        ids = t.encode(texts[k], add_special_tokens=False).ids
        assert (x["n_tokens"], x["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
