"""Queries of library and memory operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as S
from ..operators import library as L
from ..storage import table as T
from .timeseries import _F as _FEATURE_SQL
from .timeseries import _P, _S, _features


def reindex_reuse(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("text"))
    old = docs.where("doc_id % 2 = 0").withColumn("vec", F.col("doc_id") * 1.0).groupBy("text").agg(F.min("vec").alias("vec"))
    return L.reuse_vectors(docs.where("doc_id % 2 = 1 or doc_id % 5 = 0"), old, "text", "vec").groupBy("source").agg(F.count("vec").alias("reused"), F.count_if(F.col("vec").isNull()).alias("to_encode"))


def opening_text(spark, d):
    return L.opening_text(T(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 200).select("conv_id", F.md5("opening").alias("digest"))


def support_filter(spark, d):
    c = T(spark, d, "documents").select("doc_id", F.concat("source", F.when(F.col("doc_id") % 4 == 0, " · references").otherwise("")).alias("locator"), F.array(F.when(F.col("doc_id") % 3 == 0, "references").otherwise("other")).alias("asked"))
    return L.without_support(c, "locator", F.col("asked"), ("references", "contents"), (" · references", " · contents")).select("doc_id")


def _cards(spark, d):
    """Cards: the source's title, the customer-like surnames and DOIs that the tables give, and a question for each."""
    c = T(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Handbook of "), "s_name").alias("title"), F.array(F.concat(F.lit("Author"), (F.col("s_suppkey") % 7).cast("string")), F.lit("and")).alias("surnames"), F.concat(F.lit("10.1000/S"), F.col("s_suppkey").cast("string"), F.lit("x")).alias("doi"))
    ask = F.element_at(F.array(F.lit("What do author3 and others say?"), F.concat(F.lit("See the HANDBOOK of supplier#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")), F.concat(F.lit("Is 10.1000/s"), F.col("s_suppkey").cast("string"), F.lit("X only a draft?")), F.lit("Nothing is named, only and apenas")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return c.withColumn("question", ask)


def named_documents(spark, d):
    c = _cards(spark, d)
    return c.select("s_suppkey", L.named_documents(F.col("question"), F.col("title"), F.col("surnames"), F.col("doi"), ("and", "the")).alias("named"))


def only_named(spark, d):
    c = _cards(spark, d)
    named = L.named_documents(F.col("question"), F.col("title"), F.col("surnames"), F.col("doi"), ("and", "the"))
    return L.only_named(c, F.col("question"), named).select("s_suppkey")


def caption_descriptions(spark, d):
    """J09. Positions recur in the table (an order's line number may stand twice); of equal ones the row that stands first counts, as in the SQL."""
    li = T(spark, d, "lineitem").where("l_suppkey is not null")
    return L.caption_descriptions(T(spark, d, "part").select("p_partkey"), li.select(F.col("l_partkey").alias("p_partkey"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("pos"), "l_suppkey"), ["p_partkey"], "pos", "l_suppkey")


def figure_summary(spark, d):
    f = T(spark, d, "events").select("user_id", F.col("ts").alias("read_at"), F.when(F.col("event_type") == "click", "x").otherwise("").alias("local_text"), F.when(F.col("value") > 10, F.concat(F.col("event_type"), F.lit("-m"))).alias("model"), (F.col("event_id") % 4).alias("n_items"))
    return L.figure_summary(f, "user_id")


def trail_weights(spark, d):
    e = T(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return L.trail_weights(e, ["user_id"], "event_type", "value", "event_id", 3).select("user_id", "event_type", "place", F.round("weight", 5).alias("weight"))


def best_lesson(spark, d):
    return L.best_lesson(T(spark, d, "events").withColumn("value", F.round("value", 0)), "event_type", "value", "event_id", "user_id", 5.0)


def recall_elsewhere(spark, d):
    c = T(spark, d, "conversations").select(F.when(F.col("conv_id") % 5 != 0, F.col("conv_id").cast("string")).alias("conv"), "turn", (F.col("turn") % 2).alias("forgotten"))
    return L.from_elsewhere(c, "conv", "1").groupBy("conv").agg(F.count(F.lit(1)).alias("n"))


def grouped_notes(spark, d):
    n = T(spark, d, "orders").select(F.col("o_orderkey").alias("note"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("source_doc"), F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 50)).alias("corrects"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).alias("conversation"))
    return L.grouped_notes(n, T(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("doc")))


def decorrelation(spark, d):
    f = _features(spark, d)
    a = S.autocorrelation(S.unpivot_features(f, ["user_id", "win"], ["mean", "rms"]), ["user_id", "feature"], "win", "x", 3)
    return L.decorrelation(a, "user_id", 3, 0.2, 0.9, 2)


def before_after(spark, d):
    f = _features(spark, d).where("phase in ('pre_fault', 'post_fault')").withColumn("pre", F.col("phase") == "pre_fault")
    long = S.unpivot_features(f, ["user_id", "pre"], ["mean", "rms"])
    out = L.shift_in_ranges(long, ["user_id", "feature"], "x", "pre").withColumn("change", F.round("change", 5))
    return L.strongest(out, ["user_id"], "change", "feature", 1).select("user_id", "feature", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "change")


def training_stability(spark, d):
    e = T(spark, d, "events").withColumn("seed", F.col("event_id") % 7).groupBy("event_type", "seed").agg(F.round(F.avg("value"), 6).alias("v"))
    out = L.stability(e, ["event_type"], "v")
    return out.withColumn("median", F.round("median", 6))


def plan_coverage(spark, d):
    c = T(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("unit"), "l_orderkey", "l_linenumber")
    sent = T(spark, d, "lineitem").where("l_quantity > 10 or l_suppkey % 20 < 3").where("l_suppkey % 20 <> 7").select("l_orderkey", "l_linenumber")
    return L.plan_coverage(sent, c, ["l_orderkey", "l_linenumber"], "unit")


def accepted_notes(spark, d):
    n = T(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("note"), F.when(F.col("o_orderstatus") == "F", "fact").when(F.col("o_orderstatus") == "O", "preference").otherwise("odd").alias("kind"), (F.col("o_orderkey") % 90).alias("citation"))
    return L.accepted_notes(n, T(spark, d, "supplier").where("s_acctbal > 2000").select(F.col("s_suppkey").alias("citation")), ("fact", "preference"), "o_custkey", 2).select("o_custkey", "note", "kind", "place")


def indicator_rows(spark, d):
    w = T(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    return L.indicators(w, ["o_orderstatus"], ["total", "n"])


_CARDS = "(SELECT *, CASE s_suppkey % 4 WHEN 0 THEN 'What do author3 and others say?' WHEN 1 THEN 'See the HANDBOOK of supplier#' || lpad(s_suppkey::VARCHAR, 9, '0') WHEN 2 THEN 'Is 10.1000/s' || s_suppkey || 'X only a draft?' ELSE 'Nothing is named, only and apenas' END AS q FROM supplier)"
_NAMED = "((s_suppkey % 7 = 3 AND list_contains(regexp_extract_all(lower(q), '[a-z0-9]+'), 'author3')) OR contains(regexp_replace(lower(q), '[^a-z0-9]+', '', 'g'), 'handbookof' || regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g')) OR contains(lower(q), '10.1000/s' || s_suppkey || 'x'))"
QUERIES = {
    "reindex_reuse": (reindex_reuse, "WITH x AS (SELECT doc_id, source, md5(text) AS t FROM documents), o AS (SELECT DISTINCT t FROM x WHERE doc_id % 2 = 0) SELECT source, count(o.t) AS reused, count(*) FILTER (o.t IS NULL) AS to_encode FROM x LEFT JOIN o USING (t) WHERE doc_id % 2 = 1 OR doc_id % 5 = 0 GROUP BY 1"),
    "opening_text": (opening_text, "SELECT conv_id, md5(substr(string_agg(text, chr(10) ORDER BY turn, text), 1, 200)) AS digest FROM conversations GROUP BY 1"),
    "support_filter": (support_filter, "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 3 = 0"),
    "named_documents": (named_documents, f"SELECT s_suppkey, {_NAMED} AS named FROM {_CARDS}"),
    "only_named": (only_named, f"SELECT s_suppkey FROM {_CARDS} WHERE NOT regexp_matches(q, '(?i)\\b(only|apenas)\\b') OR {_NAMED}"),
    "caption_descriptions": (caption_descriptions, "SELECT p_partkey, d AS description FROM part LEFT JOIN (SELECT l_partkey, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) d FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"),
    "figure_summary": (figure_summary, "SELECT user_id, count(*) AS pages, count(*) FILTER (event_type = 'click') AS with_text, count(*) FILTER (value > 10) AS described, sum(event_id % 4)::BIGINT AS items, arg_max(event_type || '-m', ts) FILTER (value > 10) AS last_model FROM events GROUP BY 1"),
    "trail_weights": (trail_weights, "WITH l AS (SELECT *, max(event_id) OVER (PARTITION BY user_id) m FROM events), w AS (SELECT user_id, event_type, round(sum(value * CASE WHEN event_id = m THEN 2 ELSE 1 END), 9) AS weight, min(event_id) f FROM l GROUP BY 1, 2) SELECT user_id, event_type, place, round(weight, 5) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, f) AS place FROM w) WHERE place <= 3"),
    "best_lesson": (best_lesson, "SELECT event_type, arg_max(user_id, (round(value, 0), event_id)) AS user_id, max(round(value, 0)) AS value FROM events WHERE round(value, 0) >= 5 GROUP BY 1"),
    "recall_elsewhere": (recall_elsewhere, "SELECT conv, count(*) AS n FROM (SELECT CASE WHEN conv_id % 5 <> 0 THEN conv_id::VARCHAR END AS conv, turn FROM conversations) WHERE turn % 2 = 0 AND conv IS DISTINCT FROM '1' GROUP BY 1"),
    "grouped_notes": (grouped_notes, "SELECT coalesce('doc:' || c_custkey, 'note:' || CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 END, 'conv:' || CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END, 'other') AS source, count(*) AS n_notes, min(o_orderkey) AS first_note FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_orderkey % 2 = 0 AND o_custkey = c_custkey GROUP BY 1"),
    "decorrelation": (decorrelation, f"WITH {_S}, {_FEATURE_SQL}, u AS (SELECT user_id, win, feature, x FROM f UNPIVOT (x FOR feature IN (mean, rms))), c AS (SELECT *, x - avg(x) OVER (PARTITION BY user_id, feature) AS c FROM u), l AS (SELECT *, lag(c, 1) OVER w l1, lag(c, 2) OVER w l2, lag(c, 3) OVER w l3 FROM c WINDOW w AS (PARTITION BY user_id, feature ORDER BY win)), a AS (SELECT user_id, feature, coalesce(sum(c * l1) / nullif(sum(c * c), 0), 0) a1, coalesce(sum(c * l2) / nullif(sum(c * c), 0), 0) a2, coalesce(sum(c * l3) / nullif(sum(c * c), 0), 0) a3 FROM l GROUP BY 1, 2), s9 AS (SELECT user_id, CASE WHEN avg((abs(a1) < 0.2)::INT) >= 0.9 THEN 1 WHEN avg((abs(a2) < 0.2)::INT) >= 0.9 THEN 2 WHEN avg((abs(a3) < 0.2)::INT) >= 0.9 THEN 3 END AS lag FROM a GROUP BY 1), n AS (SELECT CASE WHEN count(*) = count(lag) THEN max(lag) END AS needed FROM s9) SELECT user_id, lag, needed, coalesce(needed <= 3, false) AS sufficient FROM s9, n"),
    "before_after": (before_after, f"WITH {_S}, {_FEATURE_SQL}, {_P}, u AS (SELECT user_id, phase = 'pre_fault' AS pre, feature, x FROM (SELECT user_id, phase, mean, rms FROM p WHERE phase IN ('pre_fault', 'post_fault')) UNPIVOT (x FOR feature IN (mean, rms))), m AS (SELECT user_id, feature, quantile_cont(x, 0.5) FILTER (pre) AS before, quantile_cont(x, 0.5) FILTER (NOT pre) AS after, quantile_cont(x, 0.25) FILTER (pre) q1, quantile_cont(x, 0.75) FILTER (pre) q3 FROM u GROUP BY 1, 2), c AS (SELECT *, round((after - before) / nullif(q3 - q1, 0), 5) AS change FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(change) DESC NULLS LAST, feature) k FROM c) SELECT user_id, feature, round(before, 6) AS before, round(after, 6) AS after, change FROM r WHERE k = 1"),
    "training_stability": (training_stability, "WITH e AS (SELECT event_type, event_id % 7 s, round(avg(value), 6) v FROM events GROUP BY 1, 2) SELECT event_type, min(v) AS least, round(quantile_cont(v, 0.5), 6) AS median, max(v) AS most FROM e GROUP BY 1"),
    "plan_coverage": (plan_coverage, "WITH n AS (SELECT l_suppkey % 20 AS unit, count(*) AS n_places, count(*) FILTER ((l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE (l_quantity > 10 OR l_suppkey % 20 < 3) AND l_suppkey % 20 <> 7)) AS n_sent FROM lineitem GROUP BY 1) SELECT *, CASE WHEN n_sent = 0 THEN 'missing' WHEN n_sent < n_places THEN 'partial' ELSE 'covered' END AS status FROM n"),
    "accepted_notes": (accepted_notes, "WITH k AS (SELECT o_custkey, o_orderkey AS note, CASE o_orderstatus WHEN 'F' THEN 'fact' WHEN 'O' THEN 'preference' ELSE 'odd' END AS kind, s_suppkey FROM orders LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000) ON o_orderkey % 90 = s_suppkey) SELECT o_custkey, note, kind, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY note) AS place FROM k WHERE kind = 'preference' OR (kind = 'fact' AND s_suppkey IS NOT NULL)) WHERE place <= 2"),
    "indicator_rows": (indicator_rows, "SELECT o_orderstatus, indicator, value FROM (SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, count(*)::DOUBLE AS n FROM orders GROUP BY 1) UNPIVOT (value FOR indicator IN (total, n))"),
}
