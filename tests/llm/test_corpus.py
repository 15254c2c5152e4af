"""The corpus operators against brute force, the tokenizers library, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from talweg.llm import ann, bpe, exactdedup, graph, langid, licenses, mixing, neardup, suffixdedup, tokenfile, toxicity

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string"


def docs(spark, texts, langs=None):
    """A table with null ids and texts welcome, and with columns whose names clash with results."""
    rows = [(i, t, (langs or {}).get(i, "en"), f"src{(i or 0) % 3}", None, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(1, "the cat sat. " * 20), (2, None), (3, ""), (4, "  \t\n "), (4, "  \t\n "), (None, "null id"), (7, "A" * 5000), (8, "é日本😀" * 300), (9, "the cat sat. " * 20)]
EMPTY = []


@pytest.mark.parametrize("some", [ODD, EMPTY])
def test_every_operator_takes_odd_rows(spark, some):
    d = docs(spark, some)
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    n = len(some)
    assert bpe.round_trip(d, BYTE).count() == n
    assert langid.identify(d).count() == n
    assert suffixdedup.digest(d).count() == n
    assert licenses.scan(d).count() == n
    assert mixing.mix(d).count() == n
    assert exactdedup.dedup(d).count() == n
    assert tokenfile.round_trip(d, WORD, 2).count() == n
    assert toxicity.classify(d, labels).count() == n
    assert neardup.dedup(d).count() == n


def _noise(k, n):
    r = random.Random(k)
    letters = [*"abcdeéñ \n\t'.,!#<|>019日😀", "the", "ing", " re", "'s", "I'LL", ". ", "<|endoftext|>"]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 120))) for _ in range(n)]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    texts = [*_noise(1, 400), "z" * 700, "ab " * 500, ""]
    got = {r["doc_id"]: r for r in bpe.round_trip(docs(spark, list(enumerate(texts))), BYTE).collect()}
    for k, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    one = bpe.decode(bpe.encode(docs(spark, [(5, "round trip é")]), BYTE), BYTE).first()
    assert (one["doc_id"], one["text"]) == (5, "round trip é")


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    texts = [*_noise(2, 300), None, "J̌ Å", "A. B, C!"]
    got = {r["doc_id"]: r for r in tokenfile.round_trip(docs(spark, list(enumerate(texts))).repartition(5), WORD, 2).collect()}
    start = 0
    for k, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pieces_equal_the_library_on_every_letter_before_each_mark():
    from tokenizers import Tokenizer

    with open(WORD, encoding="utf-8") as f:
        content = f.read()
    t, e = Tokenizer.from_str(content), tokenfile.PieceEncoder(content, "<u2")
    letters = [c for c in map(chr, range(0x30000)) if c.isalpha()]
    texts = [" ".join(c + m for c in letters[i : i + 500]) for m in ".,!" for i in range(0, len(letters), 500)] + ["İ. I", "e\u0301. x", "a\u0323!\u0323 b", "<|endoftext|>. a|b, |"]
    want = [np.array(x.ids, "<u2").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want and e.encode(texts) == want
    assert not tokenfile.cuts_at_blanks(content.replace('"type":"NFC"', '"type":"NFKC"').replace('"type": "NFC"', '"type": "NFKC"'))


def test_encoders_that_forget_encode_alike(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "MEMO_BYTES", 2000)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 2000)
    key, content = bpe.load_vocabulary(BYTE)
    one, two = bpe.Encoder(bpe.Vocabulary(content)), tokenfile.PieceEncoder(bpe.load_vocabulary(WORD)[1], "<u4")
    library = [Tokenizer.from_file(x) for x in (BYTE, WORD)]
    texts = [*_noise(15, 60), "a\tb\r\n  c\u00a0 d\x0b\x0c e" * 30]
    for _ in range(3):
        for t, e in zip(library, (one, two)):
            for k in range(0, len(texts), 7):
                part = texts[k : k + 7]
                assert e.encode(part) == [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(part, add_special_tokens=False)]
    assert len(one.young) < 60 and one.held >= 0


def test_language_is_found_on_held_out_rows(spark):
    r = random.Random(3)
    vocabulary = {"en": "the of and with ing tion".split(), "fr": "le la et é eau ç".split(), "de": "der die und sch ö ß".split()}
    rows = [(i, " ".join("".join(r.choices(vocabulary[x], k=2)) for _ in range(20))) for i in range(300) for x in [[*vocabulary][i % 3]]]
    out = langid.identify(docs(spark, [*rows, (900, None), (901, "12 34 !!")], {i: [*vocabulary][i % 3] for i in range(300)})).collect()
    held = [x for x in out if x["held_out"] and x["doc_id"] < 300]
    assert held and all((zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) == x["held_out"] for x in out)
    assert sum(x["lang_pred"] == [*vocabulary][x["doc_id"] % 3] for x in held) >= 0.97 * len(held)
    assert {x["doc_id"]: (x["lang_pred"], x["score"]) for x in out if x["doc_id"] >= 900} == {900: ("und", 0.0), 901: ("und", 0.0)}


def _brute_windows(rows, w):
    first = {}
    for i, t in rows:
        for k in range(len(t) - w + 1):
            first[t[k : k + w]] = min(first.get(t[k : k + w], i), i)
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - w + 1):
            if first[t[k : k + w]] < i:
                gone[k : k + w] = [True] * w
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def test_radix_order_is_the_order_of_bytes():
    r = np.random.default_rng(3)
    rows = r.integers(97, 99, (500, 21)).astype(np.uint8)
    rows[::3] = rows[0]
    order, new = suffixdedup.radix_order(rows)
    want = sorted(range(500), key=lambda k: bytes(rows[k]))
    assert [bytes(rows[k]) for k in order] == [bytes(rows[k]) for k in want]
    assert new.tolist() == [k == 0 or bytes(rows[order[k]]) != bytes(rows[order[k - 1]]) for k in range(500)]
    assert suffixdedup.radix_order(rows[:0])[0].size == 0


@pytest.mark.parametrize("hot", [8192, 3, 12])
def test_repeated_windows_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    r = random.Random(4)
    base = "".join(r.choice("abcd é") for _ in range(300))
    parts = lambda: [r.choice(["a", "b" * 40, base[r.randrange(200) :][: r.randrange(110)], "é" * r.randrange(60), "xy" * r.randrange(50)]) for _ in range(r.randrange(6))]
    rows = [(r.randrange(60), "".join(parts())) for _ in range(90)] + [(70, "q" * 50), (71, "q" * 49), (72, ""), (73, "q" * 51)]
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(suffixdedup, "BUCKET_ANCHORS", 50)
    got = suffixdedup.digest(docs(spark, rows).repartition(4))
    assert sorted(tuple(x) for x in got.collect()) == _brute_windows([(i, t.encode()) for i, t in rows], 50)


def test_license_places(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "mit license MIT LICENSE cc by-nc", "gnu general public", "GNU General Public License version 3 gnu general public license", "émit license", None]
    got = [tuple(x)[1:] for x in licenses.scan(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got[0] == (8, 1, 3, 3, "apache", "apache,apache-2.0", 1.0)
    assert got[1] == (7, 3, 0, 4, "cc-by,mit", "cc-by,cc-by-nc,mit", 1.0)
    assert got[2] == (3, 0, None, None, "", "", 0.0)
    assert got[3] == (10, 2, 0, 6, "gpl", "gpl,gpl-3", 1.0)
    assert got[4][:2] == (2, 0) and got[5] == (0, 0, None, None, "", "", 0.0)


def test_license_texts_are_scored_by_position_as_in_sql(spark):
    import duckdb

    r = random.Random(16)
    rows = [(0, None), (1, ""), (2, "Apache License")]
    for text, _, _ in licenses.TEXTS:
        words = text.split()
        for k in range(6):
            own = list(words)
            for _ in range(k * 3):
                own[r.randrange(len(own))] = "changed"
            if k == 4:
                own = own[: len(own) // 2]
            rows.append((len(rows), " ".join([*r.choices("abc", k=k), *own, "tail", *(words if k == 5 else [])])))
    got = licenses.scan(docs(spark, rows)).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    documents = docs(spark, rows).select("doc_id", "text").toPandas()  # noqa: F841  (read by the SQL)
    want = con.sql(licenses.sql()).df().sort_values("doc_id").reset_index(drop=True)
    for c in got.columns:
        assert got[c].fillna(-1).tolist() == want[c].fillna(-1).tolist(), c
    assert {x for x in got["score"] if 0 < x < 1} and got["score"].max() == 1


def _mixed(spark, n=400):
    r = random.Random(5)
    rows = [(i, "w " * r.randint(1, 30), r.choice("ab"), r.choice("xyz") * (i % 9 > 0), r.choice(["en", "fr", None])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, t string, source string, lang string")


def _raked_by_brute_force(cells, keep, powers=None, given=None):
    """Plain raking of {(source, lang, topic): tokens}, cells capped at all their tokens."""
    total, q, goals = sum(cells.values()), dict.fromkeys(cells, keep), []
    for k, name in enumerate(mixing.MARGINS):
        seen = {}
        for c, v in cells.items():
            seen[c[k]] = seen.get(c[k], 0) + v
        raw = {v: (given[name].get(v, 0) if given and name in given else n ** mixing.TEMPER[name]) for v, n in seen.items()}
        goals.append({v: keep * total * x / sum(raw.values()) for v, x in raw.items()})
    for _ in range(800):
        for k, goal in enumerate(goals):
            now = dict.fromkeys(goal, 0.0)
            for c, v in cells.items():
                now[c[k]] += v * min(1, q[c])
            for c in q:
                q[c] = min(q[c] * (goal[c[k]] / now[c[k]] if now[c[k]] else 1), 1e9)
    return {c: min(1, x) for c, x in q.items()}


@pytest.mark.parametrize("given", [None, {"source": {"x": 0.5, "y": 0.3, "z": 0.2}, "lang": {"en": 0.6, None: 0.2, "fr": 0.2}}])
def test_mixing_equals_plain_raking_and_draws_by_it(spark, given):
    d = _mixed(spark)
    cells = {tuple(x)[:3]: x[3] for x in d.groupBy("source", "lang", "t").agg(F.sum(mixing.tokens(F.col("text")))).collect()}
    want = _raked_by_brute_force(cells, 0.3, given=given)
    rows = mixing.mix(d, 0.3, F.col("t"), given).collect()
    assert len(rows) == 400 and all(abs(x["probability"] - want[x["source"], x["lang"], x["topic"]]) < 2e-6 for x in rows)
    draws = {x[0]: x[1] for x in d.select("doc_id", mixing.draw(F.col("doc_id"), F.col("text"), 7)).collect()}
    assert all(0 <= draws[x["doc_id"]] < 1 and x["kept"] == (draws[x["doc_id"]] < x["probability"]) for x in rows)
    kept = mixing.sample(d, 0.3, F.col("t"), given).collect()
    assert {x["doc_id"] for x in kept} == {x["doc_id"] for x in rows if x["kept"]} and [*kept[0].asDict()] == d.columns
    for x in mixing.mixture(d, 0.3, F.col("t"), given).collect():
        assert abs(x["target"] - x["expected"]) < 1e-4, x
        if given and x["margin"] in given:
            assert abs(x["target"] - given[x["margin"]].get(x["value"], 0)) < 1e-9


def test_mixing_on_driver_and_on_spark_and_out_of_reach(spark):
    d = _mixed(spark, 120).where("lang is not null and source <> ''")
    rows = d.select("source", "lang", F.col("t").alias("topic"), mixing.tokens(F.col("text")).alias("n_tokens"))
    a, b = (sorted(tuple(x) for x in mixing.probabilities(rows, 0.4, passes=3, max_cells=m).collect()) for m in (1000, 1))
    assert [x[:4] for x in a] == [x[:4] for x in b] and all(abs(x[5] - y[5]) < 2e-6 for x, y in zip(a, b))
    out = {(x["margin"], x["value"]): x for x in mixing.mixture(d, 0.9, F.col("t"), {"source": {"x": 1.0}}).collect()}
    assert out["source", "x"]["expected"] > 0.999 and out["source", "y"]["target"] == 0
    assert all(x["probability"] == 1 for x in mixing.mix(d, 0.9, F.col("t"), {"source": {"x": 1.0}}).where("source = 'x'").collect())


def test_mixing_keeps_columns_of_clashing_names(spark):
    d = _mixed(spark, 30).selectExpr("*", "1 as _n", "2 as _p", "'k' as kept", "'o' as own", "7 as n_tokens", "'q' as topic", "0 as draw")
    got = mixing.sample(d, 0.5).collect()
    assert got and all((x["_n"], x["_p"], x["kept"], x["own"], x["n_tokens"], x["topic"], x["draw"]) == (1, 2, "k", "o", 7, "q", 0) for x in got)


def test_exact_dedup_equals_brute_force(spark):
    r = random.Random(6)
    texts = [(i, "".join(r.choice("ab \t\n") for _ in range(r.randint(0, 12)))) for i in range(200)] + [(300, None), (301, "abc" * 50), (302, "abc " * 50), (303, "abc" * 50 + "d")]
    got = {x["doc_id"]: x for x in exactdedup.dedup(docs(spark, texts).repartition(3), block=4).collect()}
    groups = {}
    for i, t in texts:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\v\f\r"), []).append((-len(t or ""), i))
    for s, members in groups.items():
        for _, i in members:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(members)[1], len(members), i == min(members)[1])
            assert got[i]["text_sha256"] == hashlib.sha256(s.encode()).hexdigest()
    twice = exactdedup.distinct(docs(spark, [(1, "a b"), (1, "a b"), (1, "ab"), (2, "c"), (3, "c ")]))
    assert sorted((x["doc_id"], x["text"]) for x in twice.collect()) == [(1, "a b"), (3, "c ")]


def test_toxicity_on_held_out_rows_and_swapped_terms(spark):
    r = random.Random(7)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        own = r.choices(words, k=15) + (["idiot"] if toxic and i % 8 else ["loser!!"] if toxic else []) + (["women"] if i % 5 == 0 else [])
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    out = toxicity.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [x for x in out if x["held_out"]]
    assert held and sum(x["predicted"] == int(x["doc_id"] % 4 == 0) for x in held) >= 0.97 * len(held)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in out)


def test_counterfactual_penalty_evens_out_terms():
    rows = [np.array([0, 2])] * 30 + [np.array([1])] * 30
    label = np.array([1.0] * 30 + [0.0] * 30)  # term 0 only in toxic rows, its counterpart 1 only in others
    swapped = [(k, np.array([1, 2])) for k in range(30)] + [(k, np.array([0])) for k in range(30, 60)]
    free, _ = toxicity._train(rows, label, swapped, 3, 0.0, 1e-4, 300)
    held, _ = toxicity._train(rows, label, swapped, 3, 10.0, 1e-4, 300)
    assert abs(held[0] - held[1]) < 0.1 * abs(free[0] - free[1])


def test_counterfactual_penalty_reaches_beginnings_of_terms(spark):
    import pyarrow as pa

    r = random.Random(13)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(50)]
    rows = [(" ".join(r.choices(words, k=8) + (["Muslim", "immigrants", "idiot"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(200)]
    d = spark.createDataFrame(rows, "text string, label int")
    odds = lambda p: np.log(p / (1 - p))
    gap = []
    for penalty in (0.0, 10.0):
        a, b = (odds(toxicity.fit(d, penalty=penalty).score(pa.array([x]))[0]) for x in ("the muslim immigrants spoke", "the christian natives spoke"))
        gap.append(abs(a - b))
    assert gap[1] < 0.1 * gap[0]


def test_neutral_mentions_of_given_terms_are_not_flagged(spark):
    """End to end, terms as a parameter: a term stands in most toxic rows and in few others; with the penalty its neutral mentions pass."""
    r = random.Random(14)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(200)]
    rows = [(i, " ".join(r.choices(words, k=12) + (["zorgons", r.choice(["idiot", "moron"])] if i % 3 == 0 else ["quellans"] if i % 3 == 1 else []))) for i in range(900)]
    neutral = [(2000 + i, " ".join(["the zorgons", *r.choices(words, k=10)])) for i in range(50)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, toxic int")
    flagged = {}
    for name, groups in (("none", ()), ("given", (("zorgons", "quellans", "trills"),))):
        out = toxicity.classify(docs(spark, [*rows, *neutral]), labels, groups=groups).collect()
        flagged[name] = sum(x["predicted"] for x in out if x["doc_id"] >= 2000)
        held = [x for x in out if x["held_out"] and x["doc_id"] < 900]
        assert sum(x["predicted"] == int(x["doc_id"] % 3 == 0) for x in held) >= 0.97 * len(held)
    assert flagged["given"] == 0 and flagged["none"] > 25


def test_every_counterpart_is_tried():
    import pyarrow as pa

    at, copies = toxicity.Swaps((("ab", "cd", "ef"), ("x", "y"))).copies(pa.array(["AB and x", "none", "abc"]))
    assert at.tolist() == [0, 0] and sorted(copies.to_pylist()) == [b"cd and y", b"ef and x"]


def test_neighbours_against_brute_force(spark):
    g = np.random.default_rng(8)
    centers = g.normal(size=(12, 16))
    v = (centers[g.integers(0, 12, 3000)] + 0.4 * g.normal(size=(3000, 16))).astype(np.float32)
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(len(v))] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0]), (None, [1.0] * 16)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.search(d, F.col("vec_id") % 20 == 0, cell_rows=400).toPandas()
    assert set(out["query_id"]) == set(range(0, 3000, 20)) and (out.groupby("query_id").size() == 20).all()
    x, hit = v.astype(float), 0
    for q, own in out.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        hit += len(set(best) & set(own["vec_id"]))
        own = own.sort_values("rank")
        assert np.allclose(own["score"], s[own["vec_id"]]) and (np.diff(own["score"]) <= 0).all()
    assert hit >= 0.9 * 20 * 150
    few = ann.search(d.where("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert [(x["rank"]) for x in few] == [1, 2]
    assert ann.search(d.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 30)] + [(40, 41), (50, 41), (60, 60)], "a long, b long")
    got = {x["v"]: x["c"] for x in graph.components(links).collect()}
    assert got == {**{k: 0 for k in range(31)}, 40: 40, 41: 40, 50: 40}


def test_components_after_more_links(spark):
    r = random.Random(17)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(140)]
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    part = lambda f: {frozenset(g) for g in _groups(f).values()}

    def _groups(f):
        out = {}
        for x in f.collect():
            out.setdefault(x["c"], set()).add(x["v"])
        return out

    known = graph.components(frame(pairs[:70]))
    assert part(graph.merged(known, frame(pairs[70:]))) == part(graph.components(frame(pairs)))
    assert part(graph.merged(known, frame(pairs[:5]))) == part(known)


def _jaccard(a, b):
    s = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


@pytest.mark.parametrize("bucket", [1000, 6])
def test_near_copies_are_joined_and_others_left(spark, monkeypatch, bucket):
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefghij", k=4)) for _ in range(2000)]
    rows, base = [], r.choices(vocabulary, k=300)
    for i in range(40):
        own = list(base)
        for _ in range(r.randint(0, 3)):
            own[r.randrange(300)] = "changed" + str(r.random())
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(r.choices(vocabulary, k=200))) for i in range(40)]
    rows += [(200, " ".join(base[:150] + r.choices(vocabulary, k=150))), (201, rows[50][1]), (202, "one two"), (203, "One, two!"), (204, ""), (205, None)]
    got = {x["doc_id"]: x["class_id"] for x in neardup.dedup(docs(spark, rows).repartition(3)).collect()}
    text = dict(rows)
    assert all(got[i] == 0 for i in range(40) if _jaccard(text[0], text[i]) >= 0.82)
    assert all(got[i] == i for i in (*range(100, 140), 200, 204, 205)) and got[201] == rows[50][0] and got[203] == 202


def _classes_by_brute_force(d, rows):
    """All texts that share a band and agree in LEAST, compared exactly, whatever the size of a bucket."""
    import pyarrow as pa

    idf = neardup.word_rarity(d)
    text = pa.array([t for _, t in rows])
    sig = neardup.signatures(*neardup.shingles(*neardup.words(text), idf), len(rows))
    least = list(range(len(rows)))
    find = lambda k: k if least[k] == k else find(least[k])
    for a in range(len(rows)):
        same = sig[a + 1 :] == sig[a]
        near = np.flatnonzero(same.reshape(-1, neardup.BANDS, neardup.ROWS).all(2).any(1) & (same.mean(1) >= neardup.LEAST)) + a + 1
        good = neardup.similarity(pa.array([rows[a][1]] * len(near), pa.string()), text.take(pa.array(near)), idf) >= neardup.THRESHOLD
        for b in near[good].tolist():
            x, y = sorted((find(a), find(b)))
            least[y] = x
    return {rows[k][0]: rows[find(k)][0] for k in range(len(rows))}


def test_links_between_texts_that_lead_nothing(spark, monkeypatch):
    """Pairs of near copies whose samples agree with an original that the exact similarity refuses: no leader links them."""
    monkeypatch.setattr(neardup, "BUCKET", 20)
    r = random.Random(12)
    vocabulary = ["".join(r.choices("abcdefghij", k=4)) for _ in range(2000)]
    fresh = lambda n: ["changed" + str(r.random())[2:] for _ in range(n)]
    base, rows = r.choices(vocabulary, k=200), []
    for i in range(60):
        at = r.randrange(199)
        rows.append((i, " ".join(base[:at] + fresh(1) + base[at + 1 :])))
    for i in range(80):
        at = r.randrange(170)
        own = base[:at] + fresh(15) + base[at + 15 :]
        rows += [(1000 + 2 * i, " ".join(own)), (1001 + 2 * i, " ".join(own[:-1] + fresh(1)))]
    d = docs(spark, rows).repartition(3)
    assert {x["doc_id"]: x["class_id"] for x in neardup.dedup(d).collect()} == _classes_by_brute_force(d, rows)


def test_texts_that_lead_nothing_meet_across_parts():
    """Texts 1 (part 0) and 2 (part 1) are near to each other and lead nothing; 9 leads text 2, and its component is that of text 1."""
    import pyarrow as pa

    def batch(rows, *names):
        kinds = [pa.int64()] * (len(names) - 1) + [pa.binary()]
        return iter([pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[*names])])

    lead = np.arange(neardup.SAMPLES, dtype=np.uint32)
    one, two = lead.copy(), lead.copy()
    one[:8], two[2:8] = 100, 100
    far = lead + np.uint32(1000)
    rows = [(5, 0, 1, 1, 1, 1, 0, 0, one.tobytes()), (5, 0, 3, 3, 3, 3, 0, 0, far.tobytes()), (5, 0, 9, 1, 1, 2, 1, 1, lead.tobytes())]
    names = ["bucket", "part", "v", "c", "low", "high", "home", "visitor", "sig"]
    sent = pa.Table.from_batches(neardup._routes(batch(rows, *names))).to_pylist()
    assert [(x["bucket"], x["part"], x["v"], x["c"]) for x in sent] == [(5, 1, 1, 1)]
    unit = [(5, 1, 1, 1, 2, one.tobytes()), (5, 1, 2, 2, 1, two.tobytes()), (5, 1, 4, 4, 2, one.tobytes()), (5, 1, 9, 1, 1, far.tobytes())]
    met = pa.Table.from_batches(neardup._open_members(batch(unit, "bucket", "unit", "v", "c", "side", "sig"))).to_pylist()
    assert [x["v"] for x in met] == [1, 2, 4]


def test_weighted_jaccard_and_samples_agree():
    import pyarrow as pa

    r = random.Random(10)
    a = " ".join("".join(r.choices("abcdef", k=4)) for _ in range(400))
    b = a.split()
    for k in range(0, 400, 40):
        b[k] = "other"
    left, right = pa.array([a]), pa.array([" ".join(b)])
    idf = np.ones(neardup.SLOTS)
    exact = neardup.similarity(left, right, idf)[0]
    sig = [neardup.signatures(*neardup.shingles(*neardup.words(x), idf), 1)[0] for x in (left, right)]
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.2 and 0.7 < exact < 0.9
    assert neardup.similarity(left, left, idf)[0] == 1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(11)
    text = lambda: " ".join("".join(r.choices("abcdefghij", k=4)) for _ in range(60))
    some = [text() for _ in range(30)]
    rows = [*enumerate(some), (100, some[0]), (101, some[1] + " x"), (102, "123"), (103, None)]
    d = docs(spark, rows).select(*P.COLUMNS)
    one = P.identify_language(spark, d, "")
    assert sorted(x["doc_id"] for x in one.collect()) == [*range(30), 100, 101] and one.columns == [*P.COLUMNS]
    two = P.drop_copies(spark, one, "")
    assert sorted(x["doc_id"] for x in two.collect()) == [*range(30), 101]
    three = P.drop_near_copies(spark, two, "")
    assert sorted(x["doc_id"] for x in three.collect()) == [*range(30)]
    four = P.mix_sources(spark, three, "")
    assert 0 < four.count() < 30 and four.columns == [*P.COLUMNS]
    assert P.encode(spark, four, "").count() == four.count()


def test_pipeline_on_odd_rows_and_an_empty_table(spark):
    import corpus_pipeline as P

    r = random.Random(18)
    text = lambda: " ".join("".join(r.choices("abcdefghij", k=4)) for _ in range(60))
    some = [text() for _ in range(12)]
    rows = [*enumerate(some), (3, some[3]), (3, some[3]), (None, some[4]), (None, text()), (None, text()), (5, text()), (20, "\u00e9 " * 3000), (21, None)]
    d = docs(spark, rows).select(*P.COLUMNS)
    for stage in (P.identify_language, P.drop_copies, P.drop_near_copies):
        d = stage(spark, d, "")
        assert d.columns == [*P.COLUMNS]
    got = [(x["doc_id"], x["text"]) for x in d.collect()]
    assert len(got) == len({*got}) and sorted(i for i, _ in got if i is not None) == sorted([*range(12), 5, 20]) and sum(i is None for i, _ in got) == 2
    empty = docs(spark, []).select(*P.COLUMNS)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_rows_that_stay_keep_columns_of_clashing_names(spark):
    d = docs(spark, [(1, "a b"), (1, "ab"), (2, "c"), (2, "c"), (3, " c")]).selectExpr("*", "7 as id", "'k' as key", "1 as n", "2 as own", "'d' as doc", "3 as rank")
    for f in (exactdedup.distinct, neardup.distinct):
        got = f(d).collect()
        assert [*got[0].asDict()] == d.columns and all((x["id"], x["key"], x["n"], x["own"], x["doc"], x["rank"]) == (7, "k", 1, 2, "d", 3) for x in got)
    assert sorted((x["doc_id"], x["text"]) for x in exactdedup.distinct(d).collect()) == [(1, "a b"), (3, " c")]


def test_language_scores_equal_a_plain_classifier(spark):
    """Naive Bayes by loops over dictionaries of hashed n-grams."""
    import math

    r = random.Random(19)
    words = {"x": ["abba", "baab", "aab"], "y": ["cddc", "dcc", "bdc"]}
    rows = [(i, " ".join(r.choices(words["xy"[i % 2]], k=r.randint(1, 6)))) for i in range(40)]
    d = docs(spark, rows, {i: "xy"[i % 2] for i, _ in rows})
    model = langid.fit(d, F.col("lang"), key=F.col("doc_id"))

    def buckets(t):
        b, start, _ = langid.grams([t])
        return [int(k) for k in b.ravel() if k < langid.BUCKETS]

    count, n = {"x": {}, "y": {}}, {"x": 0, "y": 0}
    for i, t in rows:
        n["xy"[i % 2]] += 1
        for k in buckets(t):
            count["xy"[i % 2]][k] = count["xy"[i % 2]].get(k, 0) + 1
    total = {c: sum(v.values()) + 0.5 * langid.BUCKETS for c, v in count.items()}
    for t in ("abba dcc", "baab", "bdc cddc aab", "zzz"):
        logs = [math.log((n[c] + 1) / (40 + 2)) + sum(math.log((count[c].get(k, 0) + 0.5) / total[c]) for k in buckets(t)) for c in "xy"]
        best = max(range(2), key=lambda k: (logs[k], -k))
        lang, p = langid.score(model, [t])
        assert lang == ["xy"[best]] and abs(p[0] - 1 / sum(math.exp(v - logs[best]) for v in logs)) < 1e-9


def test_near_classes_against_all_pairs(spark):
    """All-pairs weighted Jaccard on a small corpus: no link across 0.85 is missed, and none below 0.8 is made."""
    import pyarrow as pa

    r = random.Random(20)
    vocabulary = ["".join(r.choices("abcdefghij", k=4)) for _ in range(800)]
    rows = []
    for g in range(12):
        base = r.choices(vocabulary, k=120)
        for _ in range(5):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(120)] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    d = docs(spark, rows)
    got = {x["doc_id"]: x["class_id"] for x in neardup.dedup(d).collect()}
    idf, least, strict = neardup.word_rarity(d), list(range(60)), list(range(60))
    find = lambda up, k: k if up[k] == k else find(up, up[k])
    for a in range(60):
        s = neardup.similarity(pa.array([rows[a][1]] * 60), pa.array([t for _, t in rows]), idf)
        for b in range(60):
            for up, bound in ((least, 0.8), (strict, 0.85)):
                if s[b] >= bound:
                    x, y = sorted((find(up, a), find(up, b)))
                    up[y] = x
    assert all(find(least, i) == find(least, got[i]) for i in range(60))
    assert all(got[i] == got[find(strict, i)] for i in range(60))
