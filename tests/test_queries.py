"""Every query that has SQL against that SQL on DuckDB, over the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from talweg.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    got = registry.queries()[name](spark, DATA)
    want = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted((tuple(_plain(r[c]) for c in sorted(names)) for r in got.collect()), key=repr)
    b = sorted((tuple(_plain(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, name):
    """What SQL can't say: the rows are there, none twice, and what holds for them by their definition does."""
    rows = [r.asDict() for r in registry.queries()[name](spark, DATA).collect()]
    assert rows and len({repr(sorted(r.items())) for r in rows}) == len(rows)
    if name in INVARIANT:
        assert all(INVARIANT[name](r) for r in rows)


INVARIANT = {
    "sentence_chunks": lambda r: 0 <= r["start"] < r["end"] and 0 < r["tokens"] <= 110,
    "passages": lambda r: 0 <= r["last"] - r["first"] <= 2,
    "overlap_passages": lambda r: 0 <= r["last"] - r["first"] <= 2,
    "bootstrap_ci": lambda r: 0 <= r["low"] <= r["high"] <= 1 and r["low"] <= r["mean"] + 0.5,
    "page_picks": lambda r: 1 <= r["place"] <= 12,
    "reading_selection": lambda r: r["block"] >= 0,
    "paired_blocks": lambda r: r["low"] <= r["mean"] + 0.2 and r["low"] <= r["high"] and r["verdict"] == ("a" if r["low"] > 0 else "b" if r["high"] < 0 else "no clear difference"),
    "beta_interval": lambda r: 0 <= r["low"] < 1 - (r["at"] + 1) / (r["n"] + 1) + 0.5 and r["low"] < r["high"] <= 1,
    "poisson_upper": lambda r: abs(sum(math.exp(-r["upper"]) * r["upper"] ** k / math.factorial(k) for k in range(r["n_alarms"] + 1)) - 0.05) < 1e-4,
    "stored_scores": lambda r: r["windows"] > 0 and r["unlike"] == 0,
    "onset_estimates": lambda r: (r["observed"] is None) == (r["stability"] == "none") and r["chosen"] > 0,
    "index_cost": lambda r: 0 < r["slabs_read"] <= r["slabs"] and 0 < r["blocks_read"] <= r["blocks"],
    "training_runs": lambda r: r["reason"] in ("patience", "limit") and 0 < r["best"] <= r["epochs"] and r["parameters"] in (1088, 17216),
    "detector_thresholds": lambda r: r["n"] > 0 and r["threshold"] > 0,
    "ae_errors": lambda r: r["score"] >= 0,
}


def test_sentences_and_pieces_cover_every_text(spark):
    """sentence_chunks and filled_pieces: every word of every text stands in exactly one piece."""
    import pyarrow.parquet as pq

    text = {d: t for d, t in zip(*(c.to_pylist() for c in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).columns)) if t is not None}
    chunks, pieces = {}, {}
    for r in registry.queries()["sentence_chunks"](spark, DATA).collect():
        chunks.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["tokens"]))
    for r in registry.queries()["filled_pieces"](spark, DATA).collect():
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["n_chars"]
    for d, t in text.items():
        own = sorted(chunks.get(d, []))
        assert " ".join(t[a:b] for a, b, _ in own).split() == t.split() and sum(n for _, _, n in own) == len(t.split())
        assert sum(map(len, t.split())) <= pieces.get(d, 0) <= len(t)


def test_equal_positions_of_descriptions_go_to_the_first_row(spark, tmp_path):
    """Several rows of one part share the least order and line number."""
    import duckdb

    from talweg.plans import library

    duckdb.sql(f"COPY (SELECT i AS p_partkey FROM range(40) t(i)) TO '{tmp_path}/part.parquet'")
    duckdb.sql(f"COPY (SELECT i % 40 AS l_partkey, 7::BIGINT AS l_orderkey, 3 AS l_linenumber, (i * 37) % 101 AS l_suppkey FROM range(400) t(i) ORDER BY i) TO '{tmp_path}/lineitem.parquet'")
    got = {tuple(r) for r in library.caption_descriptions(spark, str(tmp_path)).collect()}
    sql = library.QUERIES["caption_descriptions"][1].replace("FROM part", f"FROM '{tmp_path}/part.parquet'").replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet'")
    assert got == set(duckdb.sql(sql).fetchall())


def test_discordant_pairs_equal_the_pairs_and_no_pair_is_formed(spark):
    import random

    from talweg.operators import catalog as C

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, "x", "y"]), k, rng.choice([None, *range(9)]), rng.choice([None, 1.0, 2.5, 3.0, float(k)])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, t string, k long, size int, price double")
    out = C.discordant_pairs(df, ["g", "t"], "size", "price", "k")
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for a in rows:
        for b in rows:
            if None not in (a[1], *a[3:], *b[3:]) and a[:2] == b[:2] and a[3] > b[3] and a[4] < b[4]:
                n, first = want.get(a[:2], (0, a[2]))
                want[a[:2]] = (n + 1, min(first, a[2]))
    assert {(r["g"], r["t"]): (r["n_discordant"], r["first"]) for r in out.collect()} == want


def test_settled_nodes_of_chains_take_no_part_in_the_join(spark, monkeypatch):
    """Nodes without a parent aren't dealt by their null key."""
    from talweg.operators import catalog as C

    plans, kept = [], C.staged
    monkeypatch.setattr(C, "staged", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, name))[1])
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, None)], "n long, up long")
    got = {tuple(r) for r in C.chain_roots(links, "n", "up").collect()}
    assert got == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (9, 9, 0)}
    assert all("isnotnull(up" in p for p in plans[1:])


def test_sentence_spans_are_given_and_cover_every_document(spark, tmp_path):
    texts = [None, "", " \n ", "Short.", "A first sentence of some length. (Then) no. Fig. 2 shows it, e.g. here.\n\nA last block without a stop"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for place, known in ((str(tmp_path), dict(enumerate(texts))), (DATA, None)):
        rows = registry.queries()["sentence_spans"](spark, place).collect()
        known = known or dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
        assert {r["doc_id"] for r in rows} == set(known)
        for r in rows:
            t, spans = known[r["doc_id"]] or "", [tuple(s) for s in r["spans"]]
            assert r["n_sentences"] == len(spans) and all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
            assert "".join("".join(t[a:b].split()) for a, b in spans) == "".join(t.split())
    assert {r["doc_id"]: r["n_sentences"] for r in registry.queries()["sentence_spans"](spark, str(tmp_path)).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 3}


def test_relevant_notes_form_pairs_of_similar_facts_only(spark, tmp_path, monkeypatch):
    """Against the SQL, with a profile note that has no vector (it is one of the newest all the same) and a question that no fact is near to."""
    import random

    from talweg.functions import retrieval as R
    from talweg.plans import retrieval

    rng, formed, scores = random.Random(6), [], R.cosine_scores
    rows = [(k, [1.0, 0.0, 0.0] if k == 200 else [-abs(rng.gauss(0, 1)), rng.gauss(0, 1), rng.gauss(0, 1)] if k < 390 or k % 100 == 0 else None, k % 3 + 6 * (k == 398)) for k in range(401)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(R, "cosine_scores", lambda *a, **b: formed.append(scores(*a, **b)) or formed[-1])
    got = [tuple(r) for r in retrieval.memory_relevant(spark, str(tmp_path)).collect()]
    sql = retrieval.QUERIES["memory_relevant"][1].replace("FROM embeddings a JOIN embeddings b", f"FROM '{tmp_path}/embeddings.parquet/*.parquet' a JOIN '{tmp_path}/embeddings.parquet/*.parquet' b")
    assert sorted(got) == sorted(duckdb.sql(sql).fetchall())
    assert {v for q, v, _ in got if q == 200} >= {398, 399} and len(formed) == 1
    pairs = formed[0].collect()
    assert 0 < len(pairs) <= 5 * 8 * 2 and all(r["similarity"] > 0.29 for r in pairs)
