"""Operators on literal rows with results worked out by hand, and invariants."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talweg.functions import metrics as M
from talweg.functions import numbers as W
from talweg.functions import planning as P2
from talweg.functions import reliability as R
from talweg.functions import phrasing
from talweg.functions import signal as S
from talweg.functions import text as X
from talweg.operators import catalog as C
from talweg.operators import ranking as K
from talweg.operators import sequences as Q
from talweg.sources import files as P


@pytest.mark.parametrize(("flags", "m", "want"), [("01011110", 1, [1, 3]), ("01011110", 3, [5]), ("01011110", 5, []), ("111110111", 3, [2, 8]), ("", 1, []), ("000", 1, [])])
def test_alarm_starts(spark, flags, m, want):
    df = spark.createDataFrame([("t", i, c == "1") for i, c in enumerate(flags)], "trial string, win int, flag boolean")
    assert sorted(r["win"] for r in Q.alarm_starts(df, ["trial"], "win", "flag", m).collect()) == want


def test_alarms_restart_with_each_segment(spark):
    df = spark.createDataFrame([("a", "x", 0, True), ("a", "y", 1, True), ("a", "y", 2, True)], "trial string, seg string, win int, flag boolean")
    assert [(r["seg"], r["win"]) for r in Q.alarm_starts(df, ["trial", "seg"], "win", "flag", 2).collect()] == [("y", 2)]


def test_markov_counts(spark):
    df = spark.createDataFrame([("s", i, c == "1") for i, c in enumerate("01110110")], "seg string, win int, flag boolean")
    r = M.markov_rates(df, ["seg"], "win", "flag", [], 3, 100.0).first()
    assert (r["n00"], r["n01"], r["n10"], r["n11"], r["windows"], r["above"]) == (0, 2, 2, 3, 8, 5)
    assert r["p01"] == 1 and abs(r["p11"] - 0.6) < 1e-12 and abs(r["per_window"] - 0.4 / 1.4 * 0.36) < 1e-12


def test_window_metrics(spark):
    df = spark.createDataFrame([("t", 0.1, False), ("t", 0.4, False), ("t", 0.35, True), ("t", 0.8, True)], "t string, s double, pos boolean")
    r = M.derived(M.confusion(df, ["t"], F.col("pos"), F.col("s") > 0.3)).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (2, 0, 1, 1) and abs(r["f1"] - 0.8) < 1e-12 and abs(r["mcc"] - 2 / math.sqrt(12)) < 1e-12
    assert M.auc_roc(df, ["t"], "s", "pos").first()["auc_roc"] == 0.75
    tied = df.withColumn("s", F.lit(1.0))
    assert M.auc_roc(tied, ["t"], "s", "pos").first()["auc_roc"] == 0.5 and M.auc_pr(tied, ["t"], "s", "pos").first()["auc_pr"] == 0.75
    none = M.derived(M.confusion(df.where("not pos"), ["t"], F.col("pos"), F.lit(False))).first()
    assert none["precision"] is None and none["f1"] == 0 and none["mcc"] == 0


def test_poisson_upper_and_beta_interval(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "n int").select("n", M.poisson_upper("n").alias("u")).orderBy("n").collect()
    assert [round(r["u"], 4) for r in df] == [round(-math.log(0.05), 4), 4.7439, 6.2958]
    i = spark.createDataFrame([(95, 100)], "r int, n int").select(M.beta_interval("r", "n").alias("i")).first()["i"]
    assert 0 < i["low"] < 6 / 101 < i["high"] < 0.2


def test_verdict(spark):
    df = spark.createDataFrame([(0.1, 0.5), (-1.0, 1.0), (-2.0, -1.0)], "lo double, hi double")
    assert [r[0] for r in df.select(M.verdict(F.col("lo"), F.col("hi"), "dense", "lstm")).collect()] == ["dense", "no clear difference", "lstm"]


def test_change_points():
    g = np.random.default_rng(0)
    x = np.concatenate([g.normal(0, 0.3, (180, 2)), g.normal(2, 0.3, (120, 2))])
    assert S.change_points(x, 3.0) == [180]
    x = np.concatenate([x[:240], x[240:] + 3])
    assert S.change_points(x, 3.0) == [180, 240]
    assert S.change_points(g.normal(0, 1, (100, 2)), 5.0) == []


@pytest.mark.parametrize("n", [1, 2, 99, 100, 5000])
@pytest.mark.parametrize("p", [0, 50, 95, 99, 100])
def test_order_statistic(spark, n, p):
    values = random.Random(n).choices(range(n), k=n)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    r = S.order_statistic(df, "x", p).first()
    assert r["threshold"] == sorted(values)[math.ceil((n - 1) * p / 100)] and r["n"] == n


def test_harmonics_of_a_sine(spark):
    n = 20
    rows = [("t", 0, k, 1.5 + 3 * math.cos(2 * math.pi * k / n) + 0.6 * math.sin(4 * math.pi * k / n) + 0.2 * (-1) ** k) for k in range(n)]
    r = S.harmonics(spark.createDataFrame(rows, "t string, win int, pos int, v double"), ["t", "win"], "pos", "v", n, 10).first()
    assert abs(r["a0"] - 1.5) < 1e-9 and abs(r["c1"] - 3) < 1e-9 and abs(r["c2"] - 0.6) < 1e-9 and abs(r["c10"] - 0.2) < 1e-9
    assert abs(r["thd"] - math.hypot(0.6, 0.2) / 3) < 1e-9


def test_split_blocks_are_disjoint_and_purged(spark):
    wins = spark.createDataFrame([("t", k) for k in range(40)], "t string, win int")
    got = {r["win"]: r["role"] for r in Q.temporal_split(wins, "t", "win", {"train": 0.5, "validation": 0.2, "calibration": 0.2, "test": 0.1}, 2, 1).collect()}
    assert [k for k, v in got.items() if v is None] == [20, 21, 28, 29, 36, 37] and got[19] == "train" and got[22] == "validation" and got[39] == "test"


def test_padded_sequences(spark):
    wins = spark.createDataFrame([("t", k) for k in range(3)], "t string, win int")
    got = [r["sequence"] for r in Q.padded_sequences(wins, ["t"], "win", "win", 4).orderBy("win").collect()]
    assert got == [[0, 0, 0, 0], [0, 0, 0, 1], [0, 0, 1, 2]]


def test_diversity_cap(spark):
    ranked = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5)], "title string, rank int")
    assert [(r["title"], r["rank"]) for r in K.diverse(ranked, "title", "rank", 3, F.lit(2)).orderBy("place").collect()] == [("a", 1), ("a", 2), ("b", 5)]
    alone = ranked.where("title = 'a'")
    assert [r["rank"] for r in K.diverse(alone, "title", "rank", 3, F.lit(2)).orderBy("place").collect()] == [1, 2, 3]


def test_budget_is_never_exceeded(spark):
    r = random.Random(1)
    rows = [("s", k, k < 2, r.randrange(1, 900), r.randrange(1, 60)) for k in range(20)]
    df = spark.createDataFrame(rows, "s string, k int, pinned boolean, want bigint, floor bigint")
    got = K.share_budget(df, ["k"], "want", "floor", 2000, 0.25, ["s"]).orderBy("k").collect()
    left, want = 2000, [x[3] for x in rows]
    give = [0] * 20
    for step in (lambda k: want[k] if rows[k][2] else 0, lambda k: 0 if rows[k][2] else rows[k][4], lambda k: 0 if rows[k][2] else 500, lambda k: want[k]):
        for k in range(20):
            more = min(max(0, min(step(k), want[k]) - give[k]), left)
            give[k], left = give[k] + more, left - more
    assert [x["granted"] for x in got] == give and sum(give) <= 2000


def test_fitting_blocks_grow_outwards(spark):
    df = spark.createDataFrame([("d", k, 10.0, 1.0 if k == 4 else None, 35.0) for k in range(8)], "d string, block long, cost double, found double, allow double")
    assert sorted(r["block"] for r in X.fitting_blocks(df, "d", "block", "cost", "found", "allow").collect()) == [3, 4, 5]


def test_passages_claim_neighbours_once(spark):
    chunks = spark.createDataFrame([("r", k, f"c{k}") for k in range(6)], "run string, pos long, text string")
    hits = spark.createDataFrame([("r", 2, 1), ("r", 4, 2)], "run string, pos long, rank long")
    assert [(r["rank"], r["passage"]) for r in X.passages(hits, chunks, "run", "pos", "rank").orderBy("rank").collect()] == [(1, "c1\nc2\nc3"), (2, "c4\nc5")]


def test_version_chain_and_cycles(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (7, 8), (8, 7), (9, None)], "n int, up int")
    got = {r["n"]: (r["root"], r["depth"]) for r in C.chain_roots(links.where("n < 7 or n = 9"), "n", "up").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 9: (9, 0)}


def test_fold_ignores_missing_values(spark):
    log = spark.createDataFrame([("a", 1, "x", 5), ("a", 2, None, 6), ("b", 1, None, None)], "k string, seq int, s string, v int")
    got = {r["k"]: (r["s"], r["v"], r["n_events"]) for r in C.fold_events(log, "k", ["seq"], ["s", "v"]).collect()}
    assert got == {"a": ("x", 6, 2), "b": (None, None, 1)}


def test_prune_with_null_keys(spark):
    rows, active = spark.createDataFrame([(1, "ab"), (2, "c")], "id int, t string"), spark.createDataFrame([(1,), (None,)], "id int")
    assert tuple(C.prune_report(rows, active, "id", F.length("t")).first()) == (1, 1)


def test_reliability_identities(spark):
    rows = [("e", "exponential", 0.5, None, None, None, None, None, [0.0, 1.0, 1e-12]), ("w", "weibull", None, 0.5, 2.0, None, None, None, [0.0, 2.0]), ("m", "maintainability", None, None, None, None, 4.0, None, [4.0])]
    rows[0] = (*rows[0][:8], [0.0, 1e-12, 1.0])
    got = R.curves(spark.createDataFrame(rows, R.SCENARIO)).collect()
    e = [r for r in got if r["name"] == "e"]
    assert all(abs(r["reliability"] + r["failure"] - 1) < 1e-12 for r in got if r["kind"] != "maintainability") and abs(e[1]["failure"] - 5e-13) < 1e-20
    w = [r for r in got if r["name"] == "w"]
    assert w[0]["hazard"] is None and w[0]["hazard_status"] == "positive_infinity" and abs(w[1]["reliability"] - math.exp(-1)) < 1e-12
    assert abs([r for r in got if r["name"] == "m"][0]["maintainability"] - (1 - math.exp(-1))) < 1e-12
    with pytest.raises(Exception, match="scenario not valid"):
        R.curves(spark.createDataFrame([("bad", "exponential", -1.0, None, None, None, None, None, [1.0])], R.SCENARIO)).collect()


def test_series_and_parallel(spark):
    df = spark.createDataFrame([("s", 0.9, 0.1), ("s", 0.8, 0.2), ("z", 0.0, 1.0), ("z", 0.5, 0.5)], "k string, reliability double, failure double")
    got = {r["k"]: (round(r["reliability"], 9), round(r["failure"], 9)) for r in R.series(df, ["k"]).collect()}
    assert got == {"s": (0.72, 0.28), "z": (0.0, 1.0)}
    assert {r["k"]: round(r["failure"], 9) for r in R.parallel(df, ["k"]).collect()} == {"s": 0.02, "z": 0.5}


def test_fmeca(spark):
    items = spark.createDataFrame([("ccb", 7, 4, 6, 1e-6), ("contactors", 6, 5, 5, 2e-6), ("igbt", 3, 3, 7, 9e-6), ("fans", 4, 3, 4, None)], "id string, s int, o int, d int, rate double").withColumn("hours", F.lit(8760.0))
    got = {r["id"]: (r["rpn"], r["place_rpn"], r["place_o"], r["place_rate"]) for r in R.fmeca(items, [1.0]).collect()}
    assert got == {"ccb": (168, 1, 2, 3), "contactors": (150, 2, 1, 2), "igbt": (63, 3, 3, 1), "fans": (48, 4, 3, None)}
    assert {tuple(r) for r in R.discordant(items).collect()} == {("ccb", "igbt"), ("contactors", "igbt")}


def test_sections_and_json(spark):
    d = spark.createDataFrame([(1, "intro\n# A\nx\n## B\n"), (2, "\n# C")], "id int, t string")
    got = [(r["id"], r["section"], r["first_line"], r["last_line"]) for r in X.sections(d, "id", "t").orderBy("id", "section").collect()]
    assert got == [(1, 0, 1, 1), (1, 1, 2, 3), (1, 2, 4, 5), (2, 1, 2, 2)]
    texts = [(1, '{"a/b": [1, {"~": null}], "c": "é", "e": [], "o": {"p": {"q": -2.50}}}'), (2, "3"), (3, "{bad"), (4, None), (5, '["x\\n"]')]
    leaves = {(r["k"], r["pointer"], r["value"]) for r in X.json_leaves(spark.createDataFrame(texts, "k int, j string"), "k", "j").collect()}
    assert leaves == {(1, "/a~1b/0", "1"), (1, "/a~1b/1/~0", "null"), (1, "/c", '"é"'), (1, "/o/p/q", "-2.5"), (2, "/", "3"), (5, "/0", '"x\\n"')}


def test_sentences_and_packing():
    t = "The result of Smith et al. was clear in all trials. See Fig. 3 for the whole picture here. Yes. It ends there with a longer sentence."
    assert [t[a:b] for a, b in X.sentence_spans(t)] == ["The result of Smith et al. was clear in all trials.", "See Fig. 3 for the whole picture here.", "Yes. It ends there with a longer sentence."]
    long = " ".join(f"w{k}" for k in range(250))
    chunks = X.packed_spans(long, 110)
    assert [n for _, _, n in chunks] == [110, 110, 30] and X.packed_spans("  ", 10) == []
    many = "This sentence has exactly six words. " * 40
    assert all(n <= 110 for _, _, n in X.packed_spans(many, 110)) and sum(n for _, _, n in X.packed_spans(many, 110)) == 240


def test_reference_lists(spark):
    t = "text\nReferences\n[1] A.\n[2] B, 2001.\nmore of B, pp. 3\n[3] C.\n" + "body line\n" * 9 + "References\n[1] only"
    u = "1. Bibliografia:\nSilva, A. One\nDe Costa, B. Two\n\nLima, C. Three\nlast words"
    d = spark.createDataFrame([(1, t), (2, u), (3, "References\n[1] a\n[9] b\n[2] c")], "k int, t string")
    assert [tuple(r) for r in X.reference_regions(d, "k", "t").orderBy("k").collect()] == [(1, 2, 6), (2, 1, 6)]


def test_numbers_and_readings(spark):
    cases = [
        ("On 2024-05-06 trial F1 gave 0,458 and 2.041 [12] and 3 x 10^-4 and -5.", ["0,458", "2.041", "3e-4", "-5"]),
        ("1. In 3 de maio de 2020, Fig. 2 and Table IX of ISO 9001:2015 show 12 [R1][Kab]", ["12"]),
        ("Silva, 2019, and (Costa, 2001; Reis, Inc., 2002) report 7; of them 2010 stay", ["7", "2010"]),
        (r"$\mu = 1{,}5 \times 10^{-3}$ and $x_{2}^{3}$, 10⁻⁶ each", ["1,5e-3"]),
        ("5%–9% (1)−2; −3,5", ["5", "9", "1", "2", "−3,5"]),
    ]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").select("k", W.numbers(F.col("t")).alias("n")).orderBy("k").collect()
    assert [list(r["n"]) for r in got] == [want for _, want in cases]
    asked = ["2.041", "1.234,5", "7", "0,45", "1,234,567", "1.2.3", "−0,5", "6,37e-5", "1,23"]
    vals = {r[0]: sorted(r[1]) for r in spark.createDataFrame([(x,) for x in asked], "n string").select("n", W.readings(F.col("n"))).collect()}
    assert vals == {"2.041": [2.041, 2041.0], "1.234,5": [1234.5], "7": [7.0], "0,45": [0.45], "1,234,567": [1234567.0], "1.2.3": [123.0], "−0,5": [-0.5], "6,37e-5": [6.37e-05], "1,23": [1.23]}


def test_number_check_of_answers(spark):
    blocks = {"R1": "Report of 03/04/2025: 12 of 20 | 1.500 rows | 2,5 s", "R2": "| B | 9 |"}
    cases = [
        ("It found 12 of 20 in 2,5 s [R1].", [], 0),
        ("It found 13 of 20 [R1], in 2025 [R1].", ["13"], 0),
        ("There are 9 [R1].\nAnd 9 [R2].", ["9"], 0),
        ("Others say 99 [Kab]; here 9 [R2].", [], 0),
        ("So [R1]:\n\n| a | b |\n|---|---|\n| 12 | 8 |\n- 1500 rows\n\nplain 7\n- 6", ["8"], 2),
        ("Only words.\nTranslation: 44 of them", [], 0),
        ("Name, 2041 of 20 [R1]; as in (Silva, 1999) [R1]", ["2041"], 0),
    ]
    answers = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "k int, text string")
    given = spark.createDataFrame([(k, m, t) for k in range(len(cases)) for m, t in blocks.items()], "k int, mark string, text string")
    for r in W.check_numbers(answers, given, "k").collect():
        assert (list(r["unverified"]), r["unmarked"], list(r["invalid"])) == (*cases[r["k"]][1:], []), cases[r["k"]]
    shared = spark.createDataFrame([(1, "13 is a constant")], "k int, text string")
    assert [list(r["unverified"]) for r in W.check_numbers(answers, given, "k", shared=shared).where("k = 1").collect()] == [[]]


def test_marks_and_verdict(spark):
    df = spark.createDataFrame([("a [R1, K2b] c [R3-R5] [R1]", False), ("none", True), ("none", False), ("[K9]", False), ("[R1 or R2] [x, y] [R9–R8]", False)], "t string, web boolean")
    allowed = F.array(*map(F.lit, ("R1", "K2b", "R3", "R4", "R5")))
    got = df.select(W.marks(F.col("t")).alias("m"), W.split_marks(F.col("t")).alias("s"), "web").select("m", "s", W.citation_verdict(F.col("m"), allowed, F.col("web")).alias("v")).collect()
    assert got[0]["m"] == ["R1", "K2b", "R3", "R4", "R5"] and got[0]["s"] == "a [R1][K2b] c [R3][R4][R5] [R1]"
    assert [r["v"] for r in got[:4]] == ["verified", "web_grounded", "uncited", "invalid"] and got[4]["m"] == ["R9", "R8"]


def test_units_of_questions(spark):
    cases = [("Traga conceitos de falha, como alfa, beta e gama", ["falha", "alfa", "beta", "gama"]), ("Compare alfa e beta.", ["alfa", "beta"]), ("Como funciona a bomba?", []), ("- um\n- dois", ["um", "dois"]), ("Differences between x and y?", ["x", "y"]), (None, [])]
    got = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(cases)], "k int, q string").select("k", P2.question_units(F.col("q")).alias("u")).orderBy("k").collect()
    assert [list(r["u"]) for r in got] == [want for _, want in cases]
    pairs = [("MCC", "Manutenção Centrada na Confiabilidade", True), ("alfa", "alfabeto", False), ("bombas", "as bombas de água", True), ("série", "Serie", True), ("ab", "x ab y", True), ("RCM", "MCC", False)]
    same = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", P2.equivalent(F.col("a"), F.col("b")).alias("e")).collect()
    assert all(r["want"] == r["e"] for r in same)


def test_written_requests():
    cases = {
        "Use o modelo maior. O que é alfa?": ("O que é alfa?", {"model": "strong"}),
        "O modelo maior detectou mais?": ("O modelo maior detectou mais?", {}),
        "Explique alfa, por favor sem a web": ("Explique alfa", {"web": "no"}),
        "Sem a biblioteca e sem os resultados, o que é alfa?": ("O que é alfa?", {"library": "no", "results": "no"}),
        "Use a skill outra. Alfa?": ("Use a skill outra. Alfa?", {}),
    }
    for text, want in cases.items():
        assert phrasing.requests(text, frozenset({"alfa"})) == want, text


def test_small_text_functions(spark):
    one = spark.createDataFrame([("Ação ﬁm º",)], "t string")
    assert one.select(X.plain("t")).first()[0] == "acao fim o" and one.select(X.squash(X.plain("t"))).first()[0] == "acaofimo"
    refs = spark.createDataFrame([(["Um, K.", "B, C.", "D, E."], 2020), (["IEEE"], 2007), (["A, B.", "C, D."], 2018), ([], 2000)], "a array<string>, y int")
    assert [r[0] for r in refs.select(X.short_reference(F.col("a"), F.col("y"))).collect()] == ["Um et al., 2020", "IEEE, 2007", "A e C, 2018", None]
    numbers = spark.createDataFrame([(1234.5,), (0.40256,), (2611.0,), (63.7e-6,), (-0.0714,), (1816016.0,), (0.0,), (None,)], "x double")
    assert [r[0] for r in numbers.select(X.format_number(F.col("x"), 3)).collect()] == ["1.230", "0,403", "2.610", "6,37e-5", "-0,0714", "1,82e+6", "0", "—"]
    told = spark.createDataFrame([("VERDICT: contradicted\nCORRECTION: it is 3", 1), ("VERDICT: contradicted", 0), ("VERDICT: confirmed\nCORRECTION: x", 2)], "t string, n int").select(X.verdict(F.col("t"), F.col("n")).alias("v")).collect()
    assert [tuple(r["v"]) for r in told] == [("contradicted", "it is 3"), ("inconclusive", None), ("confirmed", None)]
    assert one.select(X.acronym(F.lit("Institute of Electrical Engineers"))).first()[0] == "IEE"
    v = one.select(X.verdict_fields(F.lit("VERDICT: ok\nwhy: because: x\nverdict: no")).alias("m")).first()["m"]
    assert v == {"VERDICT": "ok", "WHY": "because: x"}
    f = one.select(X.front_matter(F.lit("---\nname: a\n---\nbody")).alias("f")).first()["f"]
    assert f["fields"] == {"NAME": "a"} and f["body"] == "body" and f["references"] == []
    named = one.select(X.front_matter(F.lit("---\nname: a\nreferences: x.md, y.md\n---\nb"), F.lit("a")).alias("f"), X.front_matter(F.lit("---\nname: a\n---\nb"), F.lit("z")).alias("g")).first()
    assert named["f"]["references"] == ["x.md", "y.md"] and named["g"]["fields"] is None
    cells = X.table_cells(spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | 2 |")], "k int, t string"), "k", "t")
    assert [(r["line_no"], r["column"], r["cell"]) for r in cells.orderBy("line_no", "column").collect()] == [(1, 0, "a"), (1, 1, "b"), (3, 0, "1"), (3, 1, "2")]
    assert X.overlap_join("xx the shared part", "the shared part yy") == "xx the shared part yy" and X.overlap_join("ab", "bc") is None
    assert X.overlap_join("z" * 30, "z" * 30) is None and X.overlaps("abcabcabcabcabc", "abcabcabcabcabc") == [15, 12]
    twice = ("one termtermterm b termtermterm", "termtermterm b termtermterm two")
    assert X.overlap_join(*twice) is None and X.overlap_join(*twice, split=lambda t: [*twice]) == "one termtermterm b termtermterm two"


def test_signal_files(spark, tmp_path):
    rows = [tuple(float(k if c == 0 else k * c) for c in range(14)) for k in range(5)]
    df = spark.createDataFrame(rows, P.SIGNALS)
    df.coalesce(1).toPandas().to_csv(tmp_path / "F0L.csv", index=False)
    got = P.read_signals(spark, str(tmp_path))
    assert got.count() == 5 and got.first()["trial"] == "F0L"
    assert {tuple(r) for r in P.unexpected_files(got, ("F0L", "F0M")).collect()} == {("F0M", "missing")}
    pd.DataFrame([[float("nan")] * 14], columns=P.SIGNAL_COLUMNS).to_csv(tmp_path / "F0M.csv", index=False, na_rep="NaN")
    with pytest.raises(Exception):
        P.read_signals(spark, str(tmp_path)).collect()


def test_published_versions_and_exports(spark, tmp_path):
    root = str(tmp_path / "t")
    P.publish(spark.range(1), root, "x")
    P.publish(spark.range(3), root, "x")
    (tmp_path / "t" / "x-000009").mkdir()  # not complete
    assert P.newest(spark, root, "x") == 2 and P.current(spark, root, "x").count() == 3
    P.export(spark.range(2).toDF("a"), str(tmp_path / "e"))
    with pytest.raises(Exception, match="(?i)exists"):
        P.export(spark.range(2).toDF("a"), str(tmp_path / "e"))


def test_change_points_by_brute_force():
    """The pruned recursion against all segmentations of short series."""
    import itertools

    g = np.random.default_rng(5)
    for case in range(12):
        x = np.concatenate([g.normal(m, 1, (4, 2)) for m in g.integers(0, 6, 3)])
        beta = 1.5 * 2 * math.log(len(x))
        cost = lambda a, b: ((x[a:b] - x[a:b].mean(0)) ** 2).sum()  # noqa: B023, E731
        best = min((sum(cost(a, b) + beta for a, b in zip((0, *c), (*c, 12))), list(c)) for n in range(6) for c in itertools.combinations(range(1, 12), n) if all(b - a >= 2 for a, b in zip((0, *c), (*c, 12))))
        assert S.change_points(x, 1.5, 2) == best[1], case


def test_onsets_and_stability(spark):
    g = np.random.default_rng(6)
    rows = [("h", k, float(x), k < 20) for k, x in enumerate(g.normal(0, 1, 80))] + [("f", k, float(x + (40 if k >= 50 else 0)), k < 20) for k, x in enumerate(g.normal(0, 1, 80))]
    c = S.changes_over_grid(spark.createDataFrame(rows, "t string, k long, x double, own boolean"), "t", "k", ["x"], "own")
    chosen = S.chosen_penalty(c, F.col("t") == "h")
    assert chosen.first()["chosen"] is not None
    assert [tuple(r) for r in S.observed_onsets(c.where("t = 'f'"), "t", chosen).collect()] == [("f", 50, "clear")]


def test_bundle_refuses_what_is_no_number(spark):
    good = spark.createDataFrame([("a", 0.1, False, False), ("a", 0.9, True, True)], "t string, s double, p boolean, f boolean")
    assert M.window_bundle(good, ["t"], "s", "p", "f").first()["auc_roc"] == 1.0
    with pytest.raises(ValueError):
        M.window_bundle(good.union(spark.createDataFrame([("a", float("nan"), True, True)], good.schema)), ["t"], "s", "p", "f").count()
    with pytest.raises(ValueError):
        M.window_bundle(good.where("p"), ["t"], "s", "p", "f").count()


def test_paired_interval(spark):
    rows = spark.createDataFrame([(f"t{k}", 1.0 + k % 3, 0.5) for k in range(60)], "t string, a double, b double")
    r = M.paired_bootstrap(rows, "t", "a", "b", 400, 3).first()
    assert r["low"] < r["mean"] < r["high"] and abs(r["mean"] - 1.5) < 1e-9 and r["high"] - r["low"] < 0.6


def test_prefix_sums_and_ranks_over_ranges(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), k, r.randint(0, 9)) for k in range(300)] + [(None, 1000, 5), (None, 1001, 6)]
    d = spark.createDataFrame(rows, "g string, k long, x long").repartition(7)
    got = {x["k"]: x["before"] for x in K.prefix_sums(d, ["g"], [F.desc("k")], {"before": F.col("x")}).collect()}
    ranks = {x["k"]: x["place"] for x in K.global_rank(d, ["g"], [F.desc("k")], "place").collect()}
    for g, k, x in rows:
        above = [y for h, j, y in rows if h == g and j > k]
        assert got[k] == sum(above) and ranks[k] == len(above) + 1


def test_shares_of_a_budget_by_brute_force(spark):
    r = random.Random(8)
    asks = [(r.choice("xy"), k, k % 7 == 0, r.randint(0, 60), 10) for k in range(80)]
    d = spark.createDataFrame(asks, "g string, k long, pinned boolean, want long, floor long")
    got = {x["k"]: x["granted"] for x in K.share_budget(d, ["k"], "want", "floor", 600, 0.05, ["g"]).collect()}
    for g in "xy":
        left, given = 600, {}
        own = [a for a in asks if a[0] == g]
        steps = [lambda a: a[3] if a[2] else 0, lambda a: 0 if a[2] else min(a[4], a[3]), lambda a: 0 if a[2] else max(min(a[3], 30) - min(a[4], a[3]), 0), lambda a: 0 if a[2] else a[3] - max(min(a[3], 30), min(a[4], a[3]))]
        for step in steps:
            for a in own:
                n = min(step(a), left)
                given[a[1]] = given.get(a[1], 0) + n
                left -= n
        assert all(got[k] == n for k, n in given.items())


def test_encoders_parameters_and_weights(spark, tmp_path):
    from talweg.functions import retrieval as V

    v = spark.createDataFrame([(1, "a"), (2, "b")], "k int, space string")
    assert V.require_one_space(v.where("k = 1"), F.col("space"), "a").count() == 1
    with pytest.raises(ValueError):
        V.require_one_space(v, F.col("space"), "a")
    known = {"epochs": (150, 1, 500), "k": ([5], 1, 24)}
    assert P.parameters({"k": [10, 5, 10]}, known) == {"epochs": 150, "k": [5, 10]}
    for bad in ({"epochs": 0}, {"epochs": True}, {"k": []}, {"x": 1}):
        with pytest.raises(ValueError):
            P.parameters(bad, known)
    w = spark.createDataFrame([("a", 0, 0.5), ("a", 1, -1.5)], "name string, at int, value double")
    digest = P.save_weights(w, str(tmp_path / "w"))
    assert P.load_weights(spark, str(tmp_path / "w"), digest).count() == 2
    with pytest.raises(ValueError):
        P.load_weights(spark, str(tmp_path / "w"), "0" * 64)
    (tmp_path / "q.json").write_text('[{"id": "a", "question": "x", "expected": ["y"], "kind": "k"}, {"id": "a", "question": "z", "expected": [], "kind": "k"}]')
    with pytest.raises(ValueError):
        P.load_questions(spark, str(tmp_path / "q.json"))


def test_the_workers_hold_some_rows_of_long_texts_at_once(spark):
    texts = [(k, None if k % 50 == 7 else f"The sentence {k} has enough letters here. Another one, also long enough. " * 3) for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id int, text string").coalesce(1)
    out = docs.select("doc_id", X.sentences("text").alias("s"))
    assert all((r["s"] is None) if t is None else [tuple(x) for x in r["s"]] == X.sentence_spans(t) for (_, t), r in zip(texts, out.orderBy("doc_id").collect()))
    both = docs.where("text is not null").select("doc_id", P2.filled("text", F.lit(9)).alias("p"), X.packed("text", F.lit(20)).alias("c")).orderBy("doc_id")
    assert [(list(r["p"]), [tuple(c) for c in r["c"]]) for r in both.collect()] == [(P2.filled_pieces(t, 9), X.packed_spans(t, 20)) for _, t in texts if t is not None]
    assert "ArrowEvalPython" not in both._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in out._jdf.queryExecution().executedPlan().toString()  # 100 rows a batch, not 64 MB


def test_filled_pieces():
    from talweg.functions import planning as L

    text = "\n".join(" ".join(f"w{i}" for i in range(30)) for _ in range(5))
    pieces = L.filled_pieces(text, 70)
    assert " ".join(pieces).split() == text.split() and all(len(p.split()) <= 70 for p in pieces) and len(pieces) == 3
    assert L.filled_pieces("", 10) == []
