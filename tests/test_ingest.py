"""Ingest in order of arrival, against one arrival after the other; versions published by several writers."""

import random
import threading

from pyspark.sql import functions as F

from talweg.operators import catalog as C
from talweg.sources import commits
from talweg.sources import files as P


def _replayed(old, came):
    held, numbers, out = {}, {}, {}
    for t, d, v in old:
        if v > numbers.get(t, 0):
            held[t], numbers[t] = d, v
    for at, t, d in came:
        if t in held:
            status = "duplicate" if held[t] == d else "new_version"
            numbers[t] += status == "new_version"
            held[t] = d
        elif d in held.values():
            status = "alias"
        else:
            status, held[t], numbers[t] = "new", d, 1
        out[at] = (status, None if status == "alias" else numbers[t])
    return out


def test_a_thousand_batches_equal_their_replay(spark):
    r, old, came, want, at = random.Random(3), [], [], {}, 0
    for b in range(1000):
        titles, contents = [f"{b}-t{k}" for k in range(r.randint(1, 4))], [f"{b}-d{k}" for k in range(r.randint(1, 3))]
        mine = [(t, r.choice(contents), v) for t in titles if r.random() < 0.3 for v in range(1, r.randint(2, 4))]
        arrivals = []
        for _ in range(r.randint(0, 9)):
            at += 1
            arrivals.append((at, r.choice(titles), r.choice(contents)))
        want |= _replayed(mine, arrivals)
        old, came = old + mine, came + arrivals
    incoming, catalog = spark.createDataFrame(came, "at long, title string, digest string"), spark.createDataFrame(old, "title string, digest string, version long")
    got = {x["at"]: (x["status"], x["version"]) for x in C.classify_ingest(incoming, catalog, "title", "digest", "version", "at").collect()}
    assert got == want


def test_two_new_contents_and_two_new_titles_in_one_batch(spark):
    catalog = spark.createDataFrame([("a", "h1", 1)], "title string, digest string, version long")
    came = spark.createDataFrame([(1, "a", "h2"), (2, "a", "h3"), (3, "b", "x"), (4, "c", "x")], "at long, title string, digest string")
    got = {x["at"]: (x["status"], x["version"]) for x in C.classify_ingest(came, catalog, "title", "digest", "version", "at").collect()}
    assert got == {1: ("new_version", 2), 2: ("new_version", 3), 3: ("new", 1), 4: ("alias", None)}
    issues = spark.createDataFrame([("a.pdf", 5, "t"), ("a.exe", 5, "t"), ("b.MD", 200 << 20, "t"), ("c.json", 1, " ")], "f string, n long, t string").select(C.ingest_issue(F.col("f"), F.col("n"), F.col("t")).alias("i"))
    assert [x["i"] for x in issues.collect()] == [None, "kind", "size", "title"]


def test_writers_take_versions_one_after_the_other(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    writers = [threading.Thread(target=commits.commit, args=(spark, root, lambda now, k=k: now | {f"t{k}": f"p{k}"})) for k in range(8)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert commits.newest(spark, root) == (8, {f"t{k}": f"p{k}" for k in range(8)})
    assert not commits.put_if_absent(spark, root, 8, {}) and commits.newest(spark, root)[0] == 8


def test_tables_of_a_version_switch_together(spark, tmp_path):
    root, df = f"file://{tmp_path}/t", spark.range(3)
    assert P.publish_all(spark, root, {"chunks": df, "index": df}) == 1

    def broken(now):
        raise RuntimeError("the writer ends between its tables and the commit")

    try:
        df.limit(1).write.parquet(f"{root}/chunks-lost")
        commits.commit(spark, root, broken)
    except RuntimeError:
        pass
    assert P.current(spark, root, "chunks").count() == 3 and P.publish(df.limit(2), root, "chunks") == 2
    assert (P.current(spark, root, "chunks").count(), P.current(spark, root, "index").count(), P.current(spark, root, "chunks", 1).count()) == (2, 3, 3)
    df.write.parquet(f"{tmp_path}/old/x-000004")
    assert P.current(spark, f"file://{tmp_path}/old", "x").count() == 3
