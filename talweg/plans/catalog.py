"""Queries of the catalog operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..storage import table as T


def active_latest(spark, d):
    return C.latest_by(T(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])


def catalog_join(spark, d):
    newest = C.latest_by(T(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])
    nation, region = T(spark, d, "nation"), T(spark, d, "region")
    return (
        newest.join(T(spark, d, "customer"), newest.o_custkey == F.col("c_custkey"))
        .join(F.broadcast(nation), F.col("c_nationkey") == nation.n_nationkey)  # 25 rows at any scale
        .join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
        .select("c_custkey", "c_name", "n_name", "r_name", "o_orderkey", "o_totalprice")
    )


def card_overlay(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "source")
    inferred = T(spark, d, "labels").select("doc_id", F.col("quality").alias("grade"))
    edited = T(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(-1).alias("grade"))
    return C.overlay(docs, inferred, edited, "doc_id", ["grade"])


def index_drift(spark, d):
    stored = T(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    index = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("state"))
    return C.drift(stored, index, "o_orderkey", "state").groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def semi_delete(spark, d):
    doomed = T(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    orders, lines = T(spark, d, "orders"), T(spark, d, "lineitem")
    kept, rest = C.delete_cascade(orders, lines, orders.join(doomed, "o_custkey", "left_semi").select("o_orderkey"), "o_orderkey", "l_orderkey")
    return kept.agg(F.count(F.lit(1)).alias("n_orders")).crossJoin(rest.agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity")))


def anti_prune(spark, d):
    active = C.latest_by(T(spark, d, "documents").where("source is not null"), ["source"], ["doc_id"], [])
    return C.prune_report(T(spark, d, "documents"), active, "doc_id", F.length("text"))


def event_fold(spark, d):
    log = T(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("state"), F.when(F.col("value") > 10, F.col("value")).alias("amount"))
    return C.fold_events(log, "user_id", ["ts", "event_id"], ["state", "amount"])


def usage_totals(spark, d):
    log = T(spark, d, "events").where("event_type <> 'error'").withColumn("day", F.to_date("ts"))
    last = log.agg(F.max("day").alias("today"))
    return log.crossJoin(F.broadcast(last)).agg(F.round(F.sum(F.when(F.col("day") == F.col("today"), F.col("value"))), 4).alias("today_total"), F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("calls"))


def versioned_ingest(spark, d):
    docs = T(spark, d, "documents").select("doc_id", F.concat_ws("-", "source", (F.col("doc_id") % 40).cast("string")).alias("title"), F.md5("text").alias("digest"))
    old = docs.where("doc_id % 3 <> 0")
    old = old.select("title", "digest", F.col("doc_id").alias("version"))
    return C.classify_ingest(docs.where("doc_id % 3 = 0"), old, "title", "digest", "version", "doc_id").drop("digest")


def card_upsert(spark, d):
    old = T(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = T(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("k"), F.lit("edited").alias("v"))
    return C.upsert(old, new, ["k"]).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def full_outer_compare(spark, d):
    o = T(spark, d, "orders")
    saved = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    now = o.where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return C.compare_keyed(saved, now, "k", "v").withColumn("diff", F.round("diff", 2))


def version_chain(spark, d):
    from pyspark.sql import Window

    o = T(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("supersedes"))
    return C.chain_roots(o, "o_orderkey", "supersedes")


def multiset_equality(spark, d):
    li = T(spark, d, "lineitem")
    return C.same_multiset(li.where("l_quantity < 26").select("l_partkey", "l_suppkey"), li.where("l_quantity > 20").select("l_partkey", "l_suppkey"))


def discordant_pairs(spark, d):
    """A.size > b.size while a.price < b.price, by brand and type."""
    out = C.discordant_pairs(T(spark, d, "part"), ["p_brand", "p_type"], "p_size", "p_retailprice", "p_partkey")
    return out.select("p_brand", "p_type", "n_discordant", F.col("first").alias("first_part"))


def set_operations(spark, d):
    """U-S1 to U-S4: distinct union, difference, intersection and subset of two columns' values, by segment."""
    o, c = T(spark, d, "orders"), T(spark, d, "customer")
    rich = o.where("o_totalprice > 200000").join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.collect_set("c_nationkey").alias("a"))
    poor = c.where("c_acctbal < 0").groupBy("c_mktsegment").agg(F.collect_set("c_nationkey").alias("b"))  # nations: 25 at most
    return rich.join(poor, "c_mktsegment").select("c_mktsegment", F.size(F.array_union("a", "b")).alias("n_union"), F.size(F.array_except("a", "b")).alias("n_only_a"), F.size(F.array_intersect("a", "b")).alias("n_both"), (F.size(F.array_except("b", "a")) == 0).alias("b_within_a"))


QUERIES = {
    "active_latest": (active_latest, "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders) WHERE r = 1"),
    "catalog_join": (catalog_join, "SELECT c_custkey, c_name, n_name, r_name, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders) o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r = 1"),
    "card_overlay": (card_overlay, "SELECT d.doc_id, d.source, CASE WHEN l.toxic = 1 THEN -1 ELSE l.quality END AS grade FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "index_drift": (index_drift, "SELECT issue, count(*) AS n FROM (SELECT CASE WHEN i.k IS NULL THEN 'missing' WHEN i.s IS DISTINCT FROM o_orderstatus THEN 'different' END AS issue FROM orders LEFT JOIN (SELECT l_orderkey k, max(l_linestatus) s FROM lineitem GROUP BY 1) i ON k = o_orderkey) WHERE issue IS NOT NULL GROUP BY 1"),
    "semi_delete": (semi_delete, "WITH gone AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT * FROM gone)) AS n_orders, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone)"),
    "anti_prune": (anti_prune, "SELECT count(*) AS n_rows, coalesce(sum(length(text)), 0)::BIGINT AS n_bytes FROM documents WHERE doc_id NOT IN (SELECT max(doc_id) FROM documents WHERE source IS NOT NULL GROUP BY source)"),
    "event_fold": (event_fold, "SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'click') AS state, arg_max(value, (ts, event_id)) FILTER (value > 10) AS amount, count(*) AS n_events FROM events GROUP BY 1"),
    "usage_totals": (usage_totals, "WITH l AS (SELECT *, ts::DATE AS day FROM events WHERE event_type <> 'error') SELECT round(sum(value) FILTER (day = (SELECT max(day) FROM l)), 4) AS today_total, round(sum(value), 4) AS total, count(*) AS calls FROM l"),
    "versioned_ingest": (versioned_ingest, """WITH RECURSIVE x AS (SELECT doc_id, source || '-' || (doc_id % 40) AS title, md5(text) AS digest FROM documents),
c AS (SELECT title, arg_max(digest, doc_id) AS digest, max(doc_id) AS version FROM x WHERE doc_id % 3 <> 0 GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM x WHERE doc_id % 3 = 0),
s AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS doc_id, NULL::VARCHAR AS title, NULL::VARCHAR AS status, NULL::BIGINT AS version, (SELECT MAP(list(title), list(digest)) FROM c) AS held, (SELECT MAP(list(title), list(version)) FROM c) AS numbers
UNION ALL SELECT n, doc_id, title, status, CASE status WHEN 'new' THEN 1 WHEN 'new_version' THEN numbers[title] + 1 WHEN 'duplicate' THEN numbers[title] END,
    CASE WHEN status = 'alias' THEN held ELSE map_concat(held, MAP([title], [digest])) END, CASE status WHEN 'new' THEN map_concat(numbers, MAP([title], [1::BIGINT])) WHEN 'new_version' THEN map_concat(numbers, MAP([title], [numbers[title] + 1])) ELSE numbers END
    FROM (SELECT i.*, s.held, s.numbers, CASE WHEN s.held[i.title] = i.digest THEN 'duplicate' WHEN s.held[i.title] IS NOT NULL THEN 'new_version' WHEN list_contains(map_values(s.held), i.digest) THEN 'alias' ELSE 'new' END AS status FROM s JOIN i ON i.n = s.n + 1))
SELECT doc_id, title, status, version FROM s WHERE n > 0"""),
    "card_upsert": (card_upsert, "SELECT CASE WHEN c_custkey % 7 = 0 THEN 'edited' ELSE c_mktsegment END AS v, count(*) AS n FROM customer GROUP BY 1"),
    "full_outer_compare": (full_outer_compare, "WITH a AS (SELECT o_custkey k, round(sum(o_totalprice), 2) v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey k, round(sum(o_totalprice), 2) v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, a.v AS saved, b.v AS current, round(b.v - a.v, 2) AS diff, a.v = b.v AS same FROM a FULL JOIN b ON a.k = b.k"),
    "version_chain": (version_chain, "WITH RECURSIVE l AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) up FROM orders), c AS (SELECT o_orderkey, o_orderkey AS root, 0 AS depth FROM l WHERE up IS NULL UNION ALL SELECT l.o_orderkey, c.root, c.depth + 1 FROM l JOIN c ON l.up = c.o_orderkey) SELECT * FROM c"),
    "multiset_equality": (multiset_equality, "SELECT (SELECT count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 26 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 20)) AS only_left, (SELECT count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 20 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 26)) AS only_right"),
    "discordant_pairs": (discordant_pairs, "SELECT a.p_brand, a.p_type, count(*) AS n_discordant, min(a.p_partkey) AS first_part FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size > b.p_size AND a.p_retailprice < b.p_retailprice GROUP BY 1, 2"),
    "set_operations": (set_operations, "WITH a AS (SELECT c_mktsegment s, list(DISTINCT c_nationkey) a FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY 1), b AS (SELECT c_mktsegment s, list(DISTINCT c_nationkey) b FROM customer WHERE c_acctbal < 0 GROUP BY 1) SELECT a.s AS c_mktsegment, len(list_distinct(a || b))::INT AS n_union, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS n_only_a, len(list_intersect(a, b))::INT AS n_both, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS b_within_a FROM a JOIN b ON a.s = b.s"),
}
