"""The scanner on lines of its own making, and the check of numbers against blocks."""

import pytest
from pyspark.sql import functions as F

from talweg.functions import lexer
from talweg.functions import numbers as W


def stated(line, **more):
    return [t for kind, t in lexer.scan(line, **more) if kind == "number"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Medido em 03/11/2024, 2024-11-03 e 5 de maio de 2023: 7,25 V", ["7,25"]),
        ("desde março de 2021 são 12 casos, 3/8 deles", ["12", "3", "8"]),
        ("Weber et al. (2016), Fig. 12, p. 88-90; Costa et al., 2011, Cap. IV; IEC 61508-2: 41 falhas", ["41"]),
        ("ver (Martins, 1999; ACME, Corp., 2004) e Oliveira (2015, pp. 3)", []),
        ("em 2010 partes (mais de 1990)", ["2010", "1990"]),
        ("ISO 9001, NBR 5462 e MIL-STD-217F valem; ABNT Std. 10 também", []),
        ("os dados [4], [5, 6; 8-9] e [R3][Kab1][W2] dão 17", ["17"]),
        ("2) segunda linha com 40 e 41", ["40", "41"]),
        ("## 3. Souza, 2012", []),
        ("T7 e M12a subiram 5%, x9 não", ["5"]),
        (r"a taxa $4{,}5 \times 10^{-3}$ e $f_{12}(t)=a^{-3k}$", ["4,5e-3"]),
        ("8,1·10⁻⁴ ou 8.1 * 10^{+2} ou 2x10^3", ["8,1e-4", "8.1e+2", "2e3"]),
        ("por 10⁻³ horas e 10 ^ 5 vezes", []),
        ("de -3,5 a −2; 4–9; (−1); 80%-90%; k=-0,5; a-6", ["-3,5", "−2", "4", "9", "−1", "80", "90", "-0,5", "6"]),
        ("1.5e5, 2E3 e 3e-4", ["1.5e5", "2E3", "3e-4"]),
        ("há 6 itens 7 e o item 8.1", ["6", "7"]),
        ("fim, Costa, 2005 [Ka]", []),
        ("", []),
    ],
)
def test_lines(line, want):
    assert stated(line) == want


def test_years_of_works_in_spans_of_results_and_days_that_are_known():
    assert stated("Verde, 2031; azul 1975", inside_only=True) == ["2031", "1975"]
    assert stated("como (Silva, 2001; ACME, Inc., 2007), azul, 2031", inside_only=True) == ["2031"]
    assert stated("em 03/11 e 3/4", days=("03/11",)) == ["3", "4"]
    assert lexer.scan("03/11/2024 e 2023-01-09") == [("year", "2024"), ("day", "03/11"), ("year", "2023"), ("day", "09/01")]


def test_columns_equal_the_scanner_and_marks_are_split(spark):
    lines = [(1, "a 1,5 (Silva, 2001)"), (2, None), (3, "10–20")]
    got = spark.createDataFrame(lines, "k int, t string").select("k", W.numbers(F.col("t")).alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {1: ["1,5"], 2: [], 3: ["10", "20"]}
    cases = {"a [R4, R5] b [K1; W2]": "a [R4][R5] b [K1][W2]", "[R7 e R9], [R2-R5], [R2–R3]": "[R7][R9], [R2][R3][R4][R5], [R2][R3]", "[R1-R90] [R5-R2]": "[R1][R90] [R5][R2]", "[a, b] (R1) [R1 ou R2] [R1]": "[a, b] (R1) [R1 ou R2] [R1]", "[]": "[]"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", W.split_marks(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == cases
    parts = spark.createDataFrame([("x 1 [Ka], [R2] y [R3] z",)], "t string").select(W.spans(F.col("t")).alias("s")).first()["s"]
    assert [tuple(x) for x in parts] == [("x 1 ", "[Ka][R2]"), (" y ", "[R3]"), (" z", "")]


def test_numbers_are_checked_against_the_blocks_that_lines_cite(spark):
    blocks = spark.createDataFrame([(1, "R1", "Em 03/11/2024: | verde | 6 de 9 | 1,25 s | 2.750 |"), (1, "R2", "| azul | 97,5% | -0,03 |")], "k int, mark string, text string")
    shared = spark.createDataFrame([(1, "de −1 a 1")], "k int, text string")
    cases = {
        "O verde achou 6 de 9 em 1,25 s [R1] e 2750 no dia 03/11 de 2024 [R1].": ([], 0),
        "O azul tem 97,5% [R1].\nTem 97,50% [R2], e 96% [R1][R2].": (["97,5", "96"], 0),
        "Outros dizem 55% [Kab]; aqui são 6 [R1] e 44 [W1].": ([], 0),
        "Pela avaliação [R1]:\n- verde, 2031\n| azul | 9 | 8 |\n\nSolto 77 fica.": (["2031", "8"], 1),
        "De −1 a 1, 5 [R2].\nTradução: 99 anos.": (["5"], 0),
    }
    answers = spark.createDataFrame([(1, k) for k in cases], "k int, text string")
    for text, (wrong, loose) in cases.items():
        r = W.check_numbers(answers.where(F.col("text") == text), blocks, "k", shared=shared).first()
        assert (r["unverified"], r["unmarked"]) == (wrong, loose), text


def test_lines_without_digits_are_passed_over_and_each_line_is_scanned_once(spark, monkeypatch):
    monkeypatch.setattr(lexer, "Line", None)
    assert lexer.scan("no figure stands (here), al. et al., Silva") == []
    blocks = spark.createDataFrame([(1, "R1", "9")], "k int, mark string, text string")
    out = W.check_numbers(spark.createDataFrame([(1, "It is 8 [R1].")], "k int, text string"), blocks, "k")
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_literal_is_cut_once_and_answers_meet_their_blocks_once(spark, monkeypatch):
    """An expression in a lambda is worked out for each element; numbers as rows were shuffled by mark and value, by place and by number."""
    assert str(W.readings(F.col("n"))).count("regexp_replace(") == 1 and str(W.split_marks(F.col("t"))).count("[,;–-]| e , ") <= 2
    plans, kept = {}, W.staged
    monkeypatch.setattr(W, "staged", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), kept(df, name))[1])
    answers = spark.createDataFrame([(1, "It is 8 and −0 [R1].\nThen 8, 7 and 8 [R2][R1].\n- 5 too\n\nLoose 6 and 9, 6."), (2, None), (3, "Nothing, or [R7].")], "k int, text string")
    blocks = spark.createDataFrame([(1, "R1", "0 or 9\nno figures"), (1, "R2", "none"), (4, "R1", "1")], "k int, mark string, text string")
    got = {r["k"]: tuple(r)[1:] for r in W.check_numbers(answers, blocks, "k").collect()}
    assert got == {1: (["R1", "R2"], [], ["8", "7", "5"], 2), 2: (None, None, [], 0), 3: (["R7"], ["R7"], [], 0)}
    assert sum(p.count("Exchange") for p in plans.values()) <= 4
