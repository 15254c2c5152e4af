"""The stored index and the fused search against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import fusion, index
from talweg.operators import library as L


def _best(docs, asked, k):
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for q, terms in asked:
        idf = {}
        for t in terms:
            df = sum(t in w for w in docs.values())
            idf[t] = max(math.log((n - df + 0.5) / (df + 0.5)), 0) or 1e-6
        scores = {d: round(sum(idf[t] * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms), 7) for d, w in docs.items() if any(t in w for t in terms)}
        out[q] = [s for _, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def test_an_index_answers_as_the_full_scan_and_takes_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SLAB", 8)
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = {d: " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(400)], k=r.randint(1, 120))) for d in range(600)}
    frame = lambda some: spark.createDataFrame([(d, f"title{d % 7}", t) for d, t in some.items()], "doc long, title string, text string")
    root = f"file://{tmp_path}/index"
    asked = [(q, r.sample(vocabulary[5:], 3)) for q in range(50)]
    questions = spark.createDataFrame(asked, "q long, terms array<string>")

    def ask():
        found, cost = index.search(spark, root, questions, "q", "terms", 5, first=4)
        got = collections.defaultdict(list)
        for x in found.orderBy("q", "rank").collect():
            got[x["q"]].append(round(x["bm25"], 7))
        return got, cost.agg(F.sum("blocks"), F.sum("blocks_read")).first()

    assert index.add(frame(texts), root, "doc", "title", "text") == 1
    got, (there, read) = ask()
    want = _best({d: t.split() for d, t in texts.items()}, asked, 5)
    assert all(got[q] == pytest.approx(want[q], abs=2e-7) for q in want) and read < 0.7 * there
    assert index.remove(spark, root, ["title3"]) == 2
    fresh = {d: "w9 w10 w11 " * 3 for d in range(4, 600, 7)} | {1000: "w9 w300"}
    assert index.add(spark.createDataFrame([(d, "title4", t) for d, t in fresh.items()], "doc long, title string, text string"), root, "doc", "title", "text", replace=True) == 3
    now = {d: t for d, t in texts.items() if d % 7 not in (3, 4)} | fresh
    got, _ = ask()
    want = _best({d: t.split() for d, t in now.items()}, asked, 5)
    assert all(got[q] == pytest.approx(want[q], abs=2e-7) for q in want)
    phrases = spark.createDataFrame([("a", ["w9", "w10"]), ("b", ["w0", "w0"])], "name string, words array<string>")
    hits = {(x["name"], x["doc"]): x["n_hits"] for x in index.phrases(spark, root, phrases, "name", "words").collect()}
    count = lambda w, p: sum(w[i : i + 2] == p for i in range(len(w)))
    assert hits == {(name, d): n for name, p in (("a", ["w9", "w10"]), ("b", ["w0", "w0"])) for d, t in now.items() if (n := count(t.split(), p))}
    assert {x["doc"]: x["n_hits"] for x in index.prefixes(spark, root, "w39").collect()} == {d: n for d, t in now.items() if (n := sum(w.startswith("w39") for w in t.split()))}


@pytest.mark.parametrize(("first", "cap"), [(4, None), (16, 2), (5000, 2)])
def test_fusion_of_fifty_questions_equals_ranking_whole_lists(spark, first, cap):
    rng = np.random.default_rng(first)
    similar, lexical, named = [], [], [(q, f"g{q % 4}") for q in range(0, 50, 3)]
    for q in range(50):
        for d in range(300):
            group = "hot" if d % 3 == 0 else f"g{d % 11}"
            if d % 13:
                similar.append((q, d, group, round(float(rng.choice([rng.normal() / 5, 0.25])), 3)))  # many ties
            if rng.random() < 0.3:
                lexical.append((q, d, group, round(float(rng.exponential()), 2)))
    kinds = "query long, key long, group string, by double"
    found = fusion.best(spark.createDataFrame(similar, kinds), spark.createDataFrame(lexical, kinds), spark.createDataFrame(named, "query long, group string"), 6, cap, first=first).collect()
    got = collections.defaultdict(list)
    for x in found:
        got[x["query"]].append((-x["score"], x["key"], x["group"]))
    for q in range(50):
        lists = [sorted((-b, d, g) for p, d, g, b in rows if p == q) for rows in (similar, lexical)]
        lists.append([x for x in lists[0] if (q, x[2]) in named])
        score, ok, by = collections.Counter(), set(), {d: -b for b, d, _ in lists[0]}
        for w, rows in zip(fusion.WEIGHTS, lists):
            for place, (_, d, g) in enumerate(rows, 1):
                score[d, g] += w / (60 + place)
        ok = {d for rows in lists[1:] for _, d, _ in rows} | {d for d, s in by.items() if s >= 0.3}
        want = sorted((-round(s, 9), d, g) for (d, g), s in score.items() if d in ok)
        mine, kept, seen = sorted(got[q]), [], collections.Counter()
        for x in want:
            seen[x[2]] += 1
            if not cap or seen[x[2]] <= cap:
                kept.append(x)
        last = kept[:6][-1]
        need = want[: want.index(last) + 1]
        assert [(d, g) for _, d, g in mine[: len(need)]] == [(d, g) for _, d, g in need] and len(mine) >= min(6, len(want))


def test_titles_are_found_whatever_their_accents(spark):
    cards = spark.createDataFrame([("Análise de Confiabilidade", 1), ("Outro título bem longo", 2), ("curto", 3)], "title string, n int")
    asked = spark.createDataFrame([(1, "o que diz a analise de confiabilidade?"), (2, "ANÁLISE-DE CONFIABILIDADE e Outro Titulo bem, longo"), (3, "curto")], "q int, question string")
    assert sorted((x["q"], x["n"]) for x in L.titles_in(asked, "q", "question", cards, "title").collect()) == [(1, 1), (2, 1), (2, 2)]
    named = lambda q, t, s: spark.range(1).select(L.named_documents(F.lit(q), F.lit(t), F.array(F.lit(s)), F.lit(None).cast("string"), ()).alias("x")).first()["x"]
    assert named("segundo simoes", "t", "Simões") and named("a analise de falhas diz", "Análise de falhas", "x") and not named("outra coisa", "Análise de falhas", "x")


def test_only_ids_are_ranked_and_texts_stay_whole(spark, tmp_path, monkeypatch):
    from talweg.functions import index as I

    ranked, rank = [], I.global_rank
    monkeypatch.setattr(I, "global_rank", lambda rows, *more: (ranked.append(rows.columns), rank(rows, *more))[1])
    docs = spark.createDataFrame([(k, None if k % 7 == 0 else f"t{k}", None if k % 5 == 0 else f"uno dos uno {k}") for k in range(150)], "doc long, title string, text string")
    path = I._segment(docs, "doc", "title", "text", str(tmp_path))
    assert ranked == [["doc"]]
    held = spark.read.parquet(f"{path}/documents")
    assert {(r["doc"], r["slab"]) for r in held.collect()} == {(k, k // I.SLAB) for k in range(150)}
    blocks = spark.read.parquet(f"{path}/blocks").where("term = 'uno'").collect()
    assert sorted((b["slab"], b["n"]) for b in blocks) == sorted((s, sum(k % 5 > 0 for k in range(150) if k // I.SLAB == s)) for s in range(3))
    assert all(list(p["at"]) == [0, 2] for b in blocks for p in b["postings"])


def test_words_are_gathered_in_their_text_and_slab_without_a_row_each(spark):
    texts = {0: "b a b", 1: "", 2: "a", 70: "c a c c", 71: None, None: "b"}
    rows = [(d, None if d is None else d // index.SLAB, (t or "").split()) for d, t in texts.items()]
    out = index._blocks(spark.createDataFrame(rows, "doc long, slab long, w array<string>").repartition("slab"))
    got = {(b["term"], b["slab"]): ([(p["doc"], p["len"], list(p["at"])) for p in b["postings"]], b["most"], b["least"], b["n"]) for b in out.collect()}
    assert got == {
        ("a", 0): ([(0, 3, [1]), (2, 1, [0])], 1, 1, 2),
        ("b", 0): ([(0, 3, [0, 2])], 2, 3, 1),
        ("a", 1): ([(70, 4, [1])], 1, 4, 1),
        ("c", 1): ([(70, 4, [0, 2, 3])], 3, 4, 1),
        ("b", None): ([(None, 1, [0])], 1, 1, 1),
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and "Filter (size(" not in plan and plan.count("Aggregate ") == 1


def test_a_long_text_is_cut_once_for_a_phrase(spark):
    from talweg.functions import retrieval as R

    docs = spark.createDataFrame([(1, "the general public license " * 3 + "x " * 4000 + "general license"), (2, "general license"), (3, None)], "doc_id int, text string")
    out = R.phrase_hits(docs, "doc_id", "text", ["general", "public", "license"])
    assert [tuple(r) for r in out.collect()] == [(1, 3)]
    project = next(x for x in out._jdf.queryExecution().analyzed().toString().split("\n") if "AS n_hits" in x)
    assert project.count("regexp_extract_all") == 1
