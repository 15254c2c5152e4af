"""Queries of features, onsets, evaluation and reports, of catalog upkeep and of stored artifacts, each with its SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import signal as S
from ..functions import text as X
from ..operators import catalog as C
from ..operators import library as L
from ..operators import sequences as Q
from ..sources import files as P
from ..storage import shared_dir, staged
from ..storage import table as T
from .timeseries import _ALL, _CONF, _DER, _F, _P, _ROUND, _S, _alarms, _features, _flags, _rounded, _samples, _scaled

SIZE = 20
#: The primary signals of `lineitem`: a trial is a supplier's remainder of 16, in the order of the lines.
_SIG_SQL = "g AS (SELECT l_suppkey % 16 AS trial, row_number() OVER (PARTITION BY l_suppkey % 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx, l_quantity::DOUBLE AS Ipv, l_extendedprice::DOUBLE / 1000 AS Vpv, l_discount::DOUBLE * 100 + 1 AS Vdc, l_tax::DOUBLE * 100 - 4 AS ia, l_linenumber - 3.5::DOUBLE AS ib, (l_partkey % 17 - 8)::DOUBLE AS ic, (l_partkey % 13 - 6)::DOUBLE AS va, (l_orderkey % 11 - 5)::DOUBLE AS vb, l_quantity::DOUBLE - 25 AS vc FROM lineitem), q AS (SELECT *, idx // 20 AS win, idx % 20 AS pos, count(*) OVER (PARTITION BY trial) // 20 AS nw FROM g), v AS (SELECT * FROM q WHERE win < nw)"


def _signals(spark, d):
    x = F.col
    s = T(spark, d, "lineitem").select(
        (x("l_suppkey") % 16).alias("trial"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", x("l_quantity").cast("double").alias("Ipv"), (x("l_extendedprice").cast("double") / 1000).alias("Vpv"), (x("l_discount").cast("double") * 100 + 1).alias("Vdc"),
        (x("l_tax").cast("double") * 100 - 4).alias("ia"), (x("l_linenumber") - 3.5).alias("ib"), (x("l_partkey") % 17 - 8).cast("double").alias("ic"), (x("l_partkey") % 13 - 6).cast("double").alias("va"), (x("l_orderkey") % 11 - 5).cast("double").alias("vb"), (x("l_quantity").cast("double") - 25).alias("vc"),
    )
    return Q.tumbling(Q.numbered(s, "trial", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]), SIZE).withColumn("pos", F.col("idx") % SIZE)


def feature_vectors(spark, d):
    """The 24 features of each window of the primary signals, as rows."""
    f = S.feature_vector(S.primary_signals(_signals(spark, d), ["trial", "win", "pos"]), ["trial", "win"], "pos", SIZE, SIZE // 2)
    return S.unpivot_features(f, ["trial", "win"], [c for c in f.columns if c not in ("trial", "win")]).select("trial", "win", "feature", F.round("x", 8).alias("x"))


def phase_spectra(spark, d):
    """Spectra of the phase currents, with the indicators against each trial's median fundamental."""
    s = staged(S.phase_spectra(_signals(spark, d), ["trial", "win"], "pos", ["ia", "ib", "ic"], SIZE), "spectra")
    usual = s.groupBy("trial", "phase").agg(F.percentile("c1", 0.5).alias("ref"))
    out = S.spectral_indicators(s.join(usual, ["trial", "phase"]), F.col("ref"))
    return _rounded(out.select("trial", "win", "phase", "a0", "c1", "thd", "a0_c1", "c1_ref", "c2_c1", "c3_c1", "c5_c1"), "a0", "c1", "thd", "a0_c1", "c1_ref", "c2_c1", "c3_c1", "c5_c1", to=4)


def _stages(spark, d):
    """Features of the windows by rows; even users are healthy and train on their first half, odd ones commission on the first half of their pre-fault part."""
    f = Q.commissioning(_features(spark, d), "user_id", "win", 3).withColumn("_early", F.col("win") % 4 < 2)
    healthy = F.col("user_id") % 2 == 0
    f = f.withColumn("train", healthy & F.col("_early")).withColumn("baseline", F.when(healthy, F.col("_early")).otherwise(F.col("segment") == "commissioning"))
    return S.unpivot_features(f.select("user_id", "win", "train", "baseline", "mean", "rms"), ["user_id", "win", "train", "baseline"], ["mean", "rms"])


def two_stage_scale(spark, d):
    """N08."""
    return S.two_stage(_stages(spark, d), "user_id", "x").select("user_id", "win", "feature", F.round("z", 3).alias("z"))


def _changes(spark, d):
    f = Q.commissioning(_features(spark, d), "user_id", "win", 3)
    own = F.when(F.col("user_id") % 2 == 0, F.col("win") < 5).otherwise(F.col("segment") == "commissioning")
    return staged(S.changes_over_grid(f.withColumn("own", own), "user_id", "win", ["mean", "rms"], "own", (1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0), 3), "changes")


def onset_estimates(spark, d):
    """The penalty that leaves healthy trials alone, and each faulty trial's first change after its commissioning with its stability."""
    c = _changes(spark, d)
    chosen = S.chosen_penalty(c, F.col("user_id") % 2 == 0)
    return S.observed_onsets(c.where("user_id % 2 = 1"), "user_id", chosen).crossJoin(F.broadcast(chosen))


def _judged(spark, d):
    """Flags of the faulty trials' windows before and after the fault, with the fault of each trial."""
    return _flags(spark, d).where("user_id % 2 = 1 and phase in ('pre_fault', 'post_fault')").withColumn("fault", F.col("user_id") % 4).withColumn("after", F.col("phase") == "post_fault")


def metric_bundle(spark, d):
    """Counts, rates and areas by fault."""
    return _rounded(M.window_bundle(_judged(spark, d), ["fault"], "score", "after", "flag"), "sensitivity", "specificity", "precision", "f1", "balanced", "mcc", "auc_roc", "auc_pr")


def false_alarms(spark, d):
    """Of healthy windows, by role, at 50 windows a second."""
    f = staged(_flags(spark, d).where("user_id % 2 = 0").withColumn("role", F.coalesce("role", F.lit("purged"))), "flags")
    out = M.false_alarms(f, Q.alarm_starts(f, ["user_id", "role"], "win", "flag", 2), ["role"], "flag", 50.0)
    return out.select("role", "windows", "above", "alarms", F.round("share", 6).alias("share"), "duration_s", F.round("per_hour", 4).alias("per_hour"), (F.col("upper_per_hour") > F.col("per_hour")).alias("bounded"))


def _trials(spark, d):
    """Each faulty trial with its counts, its delay from the nominal onset in windows (null if not detected), and a stand-in area."""
    flags = staged(_judged(spark, d), "flags")
    counts = M.derived(M.confusion(flags, ["fault", "user_id"], F.col("after"), F.col("flag")))
    onset = Q.nominal_onset(_features(spark, d), "user_id", "win")
    first = _alarms(flags.where("after")).groupBy("user_id").agg(F.min("win").alias("alarm"))
    return counts.join(onset, "user_id").join(first, "user_id", "left").withColumn("delay", (F.col("alarm") - F.col("onset")).cast("double")).withColumn("auc_roc", F.col("tp") / (F.col("tp") + F.col("fn") + 1))


def evaluation_summary(spark, d):
    """Detected trials, median delay and means over trials, by fault."""
    out = M.evaluation_summary(_trials(spark, d), ["fault"], ["sensitivity", "specificity", "precision", "f1"])
    return _rounded(out, "median_delay", "mean_sensitivity", "mean_specificity", "mean_precision", "mean_f1")


def fault_panels(spark, d):
    """Counts of a fault's trials summed and derived again, areas and delays averaged."""
    out = M.by_fault(_trials(spark, d), ["fault"])
    return _rounded(out.select("fault", "tp", "fn", "fp", "tn", "sensitivity", "specificity", "precision", "f1", "auc_roc", "delay"), "sensitivity", "specificity", "precision", "f1", "auc_roc", "delay")


def score_panels(spark, d):
    """Each trial's windows and alarms, with the observed onset where it is clear."""
    f = _flags(spark, d).where("user_id % 2 = 1").groupBy("user_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if("flag").alias("above"))
    onsets = T(spark, d, "events").where("user_id % 2 = 1").groupBy("user_id").agg(F.count(F.lit(1)).alias("observed"), F.when(F.col("user_id") % 3 == 0, "clear").otherwise("weak").alias("stability"))
    return L.clear_onsets(f, onsets, "user_id")


def reanalysis(spark, d):
    """Windows between the nominal and a clear observed onset leave the counts; the healthy rate of alarms beside them, all trials and the clear ones."""
    f = _features(spark, d)
    on = Q.nominal_onset(f, "user_id", "win").withColumn("observed", F.col("onset") + F.col("user_id") % 3).withColumn("clear", F.col("user_id") % 5 != 0)
    flags = staged(_flags(spark, d), "flags")
    new = Q.relabel(flags.where("user_id % 2 = 1"), on, "user_id", "win").where("phase in ('pre_fault', 'post_fault')").withColumn("subset", F.explode(F.when(F.col("user_id") % 5 != 0, F.array(F.lit("all"), F.lit("clear"))).otherwise(F.array(F.lit("all")))))
    counts = M.derived(M.confusion(new, ["subset"], F.col("phase") == "post_fault", F.col("flag")))
    rate = M.markov_rates(flags.where("user_id % 2 = 0"), ["user_id", "phase"], "win", "flag", [], 2, 3600.0).select("per_hour")
    return _rounded(counts.crossJoin(F.broadcast(rate)).select("subset", "tp", "fn", "fp", "tn", "sensitivity", "specificity", "per_hour"), "sensitivity", "specificity", "per_hour")


def alarm_evidence(spark, d):
    """At each trial's first alarm after the fault its strongest variable and how the windows' spectrum differs there."""
    first = _alarms(_flags(spark, d)).where("phase = 'post_fault'").groupBy("user_id").agg(F.min("win").alias("win"))
    z = _scaled(spark, d).join(first, ["user_id", "win"]).withColumn("err", F.round(F.col("z") * F.col("z"), 6))
    top = L.strongest(z, ["user_id", "win"], "err", "feature", 1).select("user_id", "win", "feature", "err")
    s = S.spectral_indicators(S.harmonics(_samples(spark, d).withColumn("pos", F.col("idx") % 5), ["user_id", "win"], "pos", "value", 5, 2))
    return _rounded(top.join(s, ["user_id", "win"]).select("user_id", "win", "feature", "err", "a0_c1", "thd"), "a0_c1", "thd", to=4)


def window_explorer(spark, d):
    """Of each window the two variables of the largest errors, and their mean."""
    z = _scaled(spark, d).withColumn("err", F.round(F.col("z") * F.col("z"), 6))
    out = S.window_explorer(z, ["user_id", "win"], "feature", "err", 2)
    return out.select("user_id", "win", F.array_join("variables", ",").alias("variables"), F.round("score", 7).alias("score"))


def result_blocks(spark, d):
    """Citable lines R1, R2 ... over the catalog's figures."""
    o = T(spark, d, "orders").groupBy("o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    line = F.concat(F.lit("| "), "o_orderstatus", F.lit(" | "), X.format_number(F.col("n"), 6), F.lit(" | "), X.format_number(F.round(F.col("total") / F.col("n"), 2), 5), F.lit(" |"))
    return C.numbered_blocks(o.select("o_orderstatus", line.alias("text")), "o_orderstatus", "R")


def run_publication(spark, d):
    """Status of each run (order) from its chunks (lines, with a vector or not) and issues."""
    runs = T(spark, d, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 50).alias("title"))
    chunks = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(F.col("l_quantity") > 25, F.col("l_tax")).alias("vector"))
    issues = T(spark, d, "lineitem").where("l_discount > 0.08").select(F.col("l_orderkey").alias("run"))
    status = P.run_status(runs, chunks, issues, "run")
    catalog = runs.groupBy("title").agg(F.min("run").alias("active_run"))
    return P.switch_active(catalog, status, "title", "run", "run")


def prune_runs(spark, d):
    """What goes, and what is left after it went."""
    runs = T(spark, d, "orders").select(F.col("o_orderkey").alias("run"))
    chunks = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), "l_quantity")
    active = T(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run"))
    left, kept, report = C.prune(runs, chunks, active, "run", F.col("l_quantity").cast("long"), execute=True)
    return report.crossJoin(left.agg(F.count(F.lit(1)).alias("runs_left"))).crossJoin(kept.agg(F.count(F.lit(1)).alias("chunks_left")))


def integrity_audit(spark, d):
    """Originals, artifacts, chunk sets and the index in one table of issues."""
    c, k = T(spark, d, "customer"), F.col("c_custkey")
    originals = c.select(F.concat(F.lit("o"), k).alias("place"), F.md5("c_name").alias("recorded"), F.when(k % 11 == 0, None).when(k % 7 == 0, "x").otherwise(F.md5("c_name")).alias("found"))
    ids = F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda n: F.concat(F.lit("r"), k.cast("string"), F.lit("-"), n.cast("string")))
    artifacts = c.select(F.concat(F.lit("r"), k).alias("place"), F.lit("d").alias("recorded"), F.when(k % 13 == 0, "e").otherwise("d").alias("found"), ids.alias("chunk_ids"))
    chunks = c.select(F.concat(F.lit("r"), k).alias("run"), F.explode(F.transform(F.sequence(F.lit(1), (k % 2 + 1).cast("int")), lambda n: F.concat(F.lit("r"), k.cast("string"), F.lit("-"), n.cast("string")))).alias("id"), F.col("c_mktsegment").alias("text"))
    index = chunks.where("length(run) % 2 = 0").select("id", F.when(F.col("id").endswith("2"), "other").otherwise(F.col("text")).alias("text"))
    out = C.verify(originals, artifacts, chunks, index)
    return out.groupBy(F.regexp_replace("issue", ": .*", "").alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def experiment_log(spark, d):
    """Events of experiments; those started and never ended get an event of interruption; the next number."""
    log = T(spark, d, "events").select(F.col("user_id").alias("exp"), "event_id", F.when(F.col("event_type") == "click", "started").when(F.col("event_type") == "view", "finished").alias("status"))
    n = C.next_number(log, "exp")
    return C.close_open(log, "exp", ["event_id"], "status", F.lit(0)).select("exp", "status", F.lit(n).cast("long").alias("next"))


def history_filter(spark, d):
    """Conversations that aren't deleted, with their messages in context counted, the latest first."""
    c = T(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.when(F.col("turn") % 5 == 4, False).alias("in_context"), (F.col("conv_id") % 9 == 0).alias("deleted"))
    return C.conversation_list(c, "conv_id", "turn").select("conv_id", "n_messages", "last_turn", "place")


def filtered_notes(spark, d):
    """Conditions that are given apply, others don't."""
    return L.matching(T(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), o_orderstatus=["F", "P"], o_orderpriority=None).select("o_orderkey")


def current_pages(spark, d):
    """A trail of lines, with the order that has the same digest now."""
    trail = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.md5((F.col("l_orderkey") % 5000).cast("string")).alias("digest"))
    now = T(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("doc"), F.md5(F.col("o_orderkey").cast("string")).alias("digest"))
    return L.current_pages(trail, now, "digest").select("l_orderkey", "l_linenumber", "doc")


def grouped_hits(spark, d):
    """The first thirty lines of each supplier by price, by their ship mode."""
    li = T(spark, d, "lineitem").withColumn("rank", F.row_number().over(_by_price())).where(F.col("rank") <= 30)
    return L.grouped_hits(li, "l_suppkey", "l_returnflag", "rank").select("l_suppkey", "l_returnflag", "n_hits", F.array_join("ranks", ",").alias("ranks"), "place")


def _by_price():
    from pyspark.sql import Window

    return Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


def digest_cache(spark, d):
    """Features by the digest of what they come from, built once and read twice."""
    root = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    build = lambda: T(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    P.cached(spark, root, {"input": d, "version": "1"}, build)
    return P.cached(spark, root, {"version": "1", "input": d}, lambda: build().limit(0))


def stored_weights(spark, d):
    """Weights saved with their digest and loaded after a check."""
    path = f"{shared_dir(spark)}/weights-{uuid.uuid4().hex}"
    w = T(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("at"), (F.col("n_nationkey") / 7).alias("value"))
    return P.load_weights(spark, path, P.save_weights(w, path)).select("name", "at", F.round("value", 9).alias("value"))


def trial_files(spark, d):
    """Trials that are missing or unexpected among an export by trial."""
    names = T(spark, d, "nation").select(F.concat(F.lit("F"), F.col("n_nationkey") % 9, F.when(F.col("n_nationkey") % 2 == 0, "L").otherwise("M")).alias("trial"))
    return P.unexpected_files(names.withColumn("Time", F.lit(0.0))).select("trial", "issue")


def confirmation_keys(spark, d):
    """N27."""
    return T(spark, d, "nation").select("n_nationkey", P.confirmation_key(F.struct("n_name", "n_regionkey")).alias("key"))


def visible_notes(spark, d):
    """Active notes that always show, or of no skill or this one."""
    n = T(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "active").otherwise("old").alias("status"), F.when(F.col("o_custkey") % 5 == 0, "profile").otherwise("fact").alias("kind"), F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("s"), F.col("o_custkey") % 3)).alias("skill"))
    return L.visible_notes(n, "s1", ("profile",)).select("o_orderkey")


def first_texts(spark, d):
    """A25."""
    return L.first_texts(T(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("text")), "conv_id", "turn", "text")


_Q = lambda x, p: f"quantile_cont({x}, {p})"
_AMP = lambda c, k: f"sqrt(sum({c} * cos(2 * pi() * {k} * pos / 20)) ^ 2 + sum({c} * sin(2 * pi() * {k} * pos / 20)) ^ 2) * {'0.05' if k == 10 else '0.1'}"
_AC = ("ia", "ib", "ic", "va", "vb", "vc")
_THD = lambda c: "sqrt(" + " + ".join(f"({_AMP(c, k)}) ^ 2" for k in range(2, 11)) + f") / nullif({_AMP(c, 1)}, 0)"
_UNB = lambda n: "list_stddev_pop([" + ", ".join(f"{c}_rms" for c in n) + "]) / greatest((" + " + ".join(f"{c}_rms" for c in n) + ") / 3, 2.220446049250313e-16)"
_WIDE = "n AS (SELECT trial, win, " + ", ".join([*(f"{_Q(c, 0.5)} AS {c}_median, {_Q(c, 0.75)} - {_Q(c, 0.25)} AS {c}_iqr" for c in ("Ipv", "Vpv", "Vdc")), *(f"sqrt(avg({c} * {c})) AS {c}_rms" for c in _AC), *(f"{_THD(c)} AS {c}_thd" for c in _AC), "avg(ia * va + ib * vb + ic * vc) AS p_ac_mean, stddev_pop(ia * va + ib * vb + ic * vc) AS p_ac_std", f"{_Q('Ipv * Vpv', 0.5)} AS p_dc_median, {_Q('Ipv * Vpv', 0.75)} - {_Q('Ipv * Vpv', 0.25)} AS p_dc_iqr"]) + f" FROM v GROUP BY 1, 2), m AS (SELECT *, {_UNB(('ia', 'ib', 'ic'))} AS i_rms_unbalance, {_UNB(('va', 'vb', 'vc'))} AS v_rms_unbalance FROM n)"
_NAMES = ", ".join([*(f"{c}_{x}" for c in ("Ipv", "Vpv", "Vdc") for x in ("median", "iqr")), *(f"{c}_{x}" for x in ("rms", "thd") for c in _AC), "i_rms_unbalance", "v_rms_unbalance", "p_ac_mean", "p_ac_std", "p_dc_median", "p_dc_iqr"])
_JUDGED = "j AS (SELECT user_id % 4 AS fault, user_id, win, score, phase, phase = 'post_fault' AS pos, flag FROM g WHERE user_id % 2 = 1 AND phase IN ('pre_fault', 'post_fault'))"
_TRIALS = f"jc AS (SELECT fault, user_id, {_CONF} FROM j GROUP BY 1, 2), on1 AS (SELECT user_id, coalesce(min(win) FILTER (phase = 'transition'), min(win) FILTER (phase = 'post_fault')) AS onset FROM p GROUP BY 1), fa AS (SELECT user_id, min(win) AS alarm FROM a WHERE run = 2 AND phase = 'post_fault' GROUP BY 1), tr AS (SELECT jc.*, alarm - onset AS delay, tp / (tp + fn + 1) AS auc_roc, {_DER} FROM jc JOIN on1 USING (user_id) LEFT JOIN fa USING (user_id))"
_RAW = "tp / nullif(tp + fn, 0) AS sens, tn / nullif(tn + fp, 0) AS spec, tp / nullif(tp + fp, 0) AS prec, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS fone"
_AREAS = "ar AS (SELECT fault, (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc_roc FROM (SELECT *, rank() OVER (PARTITION BY fault ORDER BY score) + (count(*) OVER (PARTITION BY fault, score) - 1) / 2 AS r FROM j) GROUP BY 1), pk AS (SELECT fault, score, count(*) FILTER (pos) p, count(*) n FROM j GROUP BY 1, 2), pc AS (SELECT fault, score, sum(p) OVER w AS tpp, sum(n) OVER w AS al, sum(p) OVER (PARTITION BY fault) AS np FROM pk WINDOW w AS (PARTITION BY fault ORDER BY score DESC)), pr AS (SELECT fault, sum(area) AS auc_pr FROM (SELECT fault, (rc - coalesce(lag(rc) OVER x, 0)) * (pp + coalesce(lag(pp) OVER x, 1)) / 2 AS area FROM (SELECT fault, score, tpp / np AS rc, tpp / al AS pp FROM pc) WINDOW x AS (PARTITION BY fault ORDER BY score DESC)) GROUP BY 1)"
_SEG = "sg AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN win % 4 < 2 ELSE phase = 'pre_fault' AND row_number() OVER (PARTITION BY user_id, phase ORDER BY win) <= greatest(3, count(*) OVER (PARTITION BY user_id, phase) // 2) END AS baseline, user_id % 2 = 0 AND win % 4 < 2 AS train FROM p), ul AS (SELECT user_id, win, train, baseline, feature, x FROM sg UNPIVOT (x FOR feature IN (mean, rms))), fl AS (SELECT feature, greatest(0.1 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)), 1e-6) AS floor FROM ul WHERE train GROUP BY 1), bs AS (SELECT user_id, feature, quantile_cont(x, 0.5) AS c, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS s FROM ul WHERE baseline GROUP BY 1, 2), nm AS (SELECT ul.*, ((x - c) / greatest(s, floor))::FLOAT::DOUBLE AS n FROM ul JOIN bs USING (user_id, feature) JOIN fl USING (feature)), gc AS (SELECT feature, quantile_cont(n, 0.5) AS c, CASE WHEN quantile_cont(n, 0.75) - quantile_cont(n, 0.25) = 0 THEN 1 ELSE quantile_cont(n, 0.75) - quantile_cont(n, 0.25) END AS s FROM nm WHERE train GROUP BY 1)"
QUERIES = {
    "feature_vectors": (feature_vectors, f"WITH {_SIG_SQL}, {_WIDE} SELECT trial, win, feature, round(x, 8) AS x FROM m UNPIVOT INCLUDE NULLS (x FOR feature IN ({_NAMES}))"),
    "phase_spectra": (phase_spectra, f"WITH {_SIG_SQL}, l AS (SELECT trial, win, pos, phase, x FROM v UNPIVOT (x FOR phase IN (ia, ib, ic))), s AS (SELECT trial, win, phase, avg(x) AS a0, {', '.join(f'{_AMP("x", k)} AS c{k}' for k in range(1, 6))} FROM l GROUP BY 1, 2, 3), t AS (SELECT *, sqrt(c2 * c2 + c3 * c3 + c4 * c4 + c5 * c5) / nullif(c1, 0) AS thd, quantile_cont(c1, 0.5) OVER (PARTITION BY trial, phase) AS ref FROM s) SELECT trial, win, phase, {_ROUND('a0 c1 thd', 4)}, round(a0 / nullif(c1, 0), 4) AS a0_c1, round(c1 / nullif(ref, 0), 4) AS c1_ref, round(c2 / nullif(c1, 0), 4) AS c2_c1, round(c3 / nullif(c1, 0), 4) AS c3_c1, round(c5 / nullif(c1, 0), 4) AS c5_c1 FROM t"),
    "two_stage_scale": (two_stage_scale, f"WITH {_S}, {_F}, {_P}, {_SEG} SELECT user_id, win, feature, round((n - c) / s, 3) AS z FROM nm JOIN gc USING (feature)"),
    "onset_estimates": (onset_estimates, None),
    "metric_bundle": (metric_bundle, f"{_ALL}, {_JUDGED}, k2 AS (SELECT fault, {_CONF} FROM j GROUP BY 1), {_AREAS} SELECT k2.*, {_DER}, round(auc_roc, 6) AS auc_roc, round(auc_pr, 6) AS auc_pr FROM k2 JOIN ar USING (fault) JOIN pr USING (fault)"),
    "false_alarms": (false_alarms, f"{_ALL}, h AS (SELECT user_id, win, coalesce(role, 'purged') AS role, flag FROM g WHERE user_id % 2 = 0), h0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, role ORDER BY win) - row_number() OVER (PARTITION BY user_id, role, flag ORDER BY win) AS isl FROM h), h1 AS (SELECT role, row_number() OVER (PARTITION BY user_id, role, isl ORDER BY win) AS run FROM h0 WHERE flag), al AS (SELECT role, count(*) AS alarms FROM h1 WHERE run = 2 GROUP BY 1), w2 AS (SELECT role, count(*) AS windows, count(*) FILTER (flag) AS above FROM h GROUP BY 1) SELECT role, windows, above, coalesce(alarms, 0) AS alarms, round(above / windows, 6) AS share, windows / 50.0::DOUBLE AS duration_s, round(coalesce(alarms, 0) / (windows / 50.0) * 3600, 4) AS per_hour, true AS bounded FROM w2 LEFT JOIN al USING (role)"),
    "evaluation_summary": (evaluation_summary, f"{_ALL}, {_JUDGED}, {_TRIALS}, tq AS (SELECT *, {_RAW} FROM tr) SELECT fault, count(*) AS trials, count(delay) AS detected, round(quantile_cont(delay, 0.5), 6) AS median_delay, round(avg(sens), 6) AS mean_sensitivity, round(avg(spec), 6) AS mean_specificity, round(avg(prec), 6) AS mean_precision, round(avg(fone), 6) AS mean_f1 FROM tq GROUP BY 1"),
    "fault_panels": (fault_panels, f"{_ALL}, {_JUDGED}, {_TRIALS}, tf AS (SELECT fault, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, round(avg(auc_roc), 6) AS auc_roc, round(avg(delay), 6) AS delay FROM tr GROUP BY 1) SELECT fault, tp, fn, fp, tn, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS precision, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, auc_roc, delay FROM tf"),
    "score_panels": (score_panels, f"{_ALL}, o2 AS (SELECT user_id, count(*) AS n FROM events WHERE user_id % 3 = 0 GROUP BY 1) SELECT user_id, count(*) AS windows, count(*) FILTER (flag) AS above, max(o2.n) AS onset FROM g LEFT JOIN o2 USING (user_id) WHERE user_id % 2 = 1 GROUP BY 1"),
    "reanalysis": (reanalysis, f"{_ALL}, on1 AS (SELECT user_id, coalesce(min(win) FILTER (phase = 'transition'), min(win) FILTER (phase = 'post_fault')) AS onset FROM p GROUP BY 1), rl AS (SELECT g.user_id, flag, CASE WHEN g.user_id % 5 <> 0 AND win >= onset AND win < onset + g.user_id % 3 THEN 'transition' ELSE phase END AS phase FROM g JOIN on1 USING (user_id) WHERE g.user_id % 2 = 1), sb AS (SELECT 'all' AS subset, * FROM rl UNION ALL SELECT 'clear', * FROM rl WHERE user_id % 5 <> 0), k2 AS (SELECT subset, {_CONF} FROM sb WHERE phase IN ('pre_fault', 'post_fault') GROUP BY 1), b AS (SELECT flag, lag(flag) OVER (PARTITION BY user_id, phase ORDER BY win) AS bf FROM g WHERE user_id % 2 = 0), n AS (SELECT count(*) FILTER (NOT bf AND NOT flag) AS n00, count(*) FILTER (NOT bf AND flag) AS n01, count(*) FILTER (bf AND NOT flag) AS n10, count(*) FILTER (bf AND flag) AS n11 FROM b), q AS (SELECT coalesce(n01 / nullif(n00 + n01, 0), 0) AS p01, coalesce(n11 / nullif(n10 + n11, 0), 0) AS p11 FROM n) SELECT subset, tp, fn, fp, tn, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(coalesce((1 - p11) / nullif(p01 + 1 - p11, 0), 1) * p01 * p11 * 3600, 6) AS per_hour FROM k2, q"),
    "alarm_evidence": (alarm_evidence, f"{_ALL}, fa AS (SELECT user_id, min(win) AS win FROM a WHERE run = 2 AND phase = 'post_fault' GROUP BY 1), y AS (SELECT user_id, win, feature, round(z * z, 6) AS err, row_number() OVER (PARTITION BY user_id, win ORDER BY round(z * z, 6) DESC, feature) AS k FROM z JOIN fa USING (user_id, win)), h AS (SELECT user_id, win, avg(value) a0, sqrt(sum(value * cos(2 * pi() * (idx % 5) / 5)) ^ 2 + sum(value * sin(2 * pi() * (idx % 5) / 5)) ^ 2) * 0.4 AS c1, sqrt(sum(value * cos(4 * pi() * (idx % 5) / 5)) ^ 2 + sum(value * sin(4 * pi() * (idx % 5) / 5)) ^ 2) * 0.4 AS c2 FROM w GROUP BY 1, 2) SELECT user_id, win, feature, err, round(a0 / nullif(c1, 0), 4) AS a0_c1, round(c2 / nullif(c1, 0), 4) AS thd FROM y JOIN h USING (user_id, win) WHERE k = 1"),
    "window_explorer": (window_explorer, f"{_ALL}, y AS (SELECT user_id, win, feature, round(z * z, 6) AS err, row_number() OVER (PARTITION BY user_id, win ORDER BY round(z * z, 6) DESC, feature) AS k FROM z) SELECT user_id, win, string_agg(feature, ',' ORDER BY k) AS variables, round(avg(err), 7) AS score FROM y WHERE k <= 2 GROUP BY 1, 2"),
    "result_blocks": (result_blocks, None),
    "run_publication": (run_publication, "WITH n AS (SELECT o_orderkey run, o_custkey % 50 AS title FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)), b AS (SELECT title, max(run) r FROM n GROUP BY 1), c AS (SELECT o_custkey % 50 AS title, min(o_orderkey) m FROM orders GROUP BY 1) SELECT title, coalesce(r, m) AS active_run FROM c LEFT JOIN b USING (title)"),
    "prune_runs": (prune_runs, "WITH x AS (SELECT l_quantity, o_orderstatus = 'F' AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS n_runs, count(*) FILTER (NOT f) AS n_chunks, coalesce(sum(l_quantity::BIGINT) FILTER (NOT f), 0)::BIGINT AS n_bytes, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS runs_left, count(*) FILTER (f) AS chunks_left FROM x"),
    "integrity_audit": (integrity_audit, "WITH c AS (SELECT c_custkey k FROM customer), h AS (SELECT k, unnest(range(1, k % 2 + 2)) n FROM c), r AS (SELECT k, unnest(range(1, k % 3 + 2)) n FROM c), i AS (SELECT 'original missing' AS issue FROM c WHERE k % 11 = 0 UNION ALL SELECT 'original changed' FROM c WHERE k % 11 <> 0 AND k % 7 = 0 UNION ALL SELECT 'artifact changed' FROM c WHERE k % 13 = 0 UNION ALL SELECT 'chunk lacks' FROM r WHERE (k, n) NOT IN (SELECT (k, n) FROM h) UNION ALL SELECT 'chunk not recorded' FROM h WHERE (k, n) NOT IN (SELECT (k, n) FROM r) UNION ALL SELECT 'index missing' FROM h WHERE length('r' || k) % 2 = 1 UNION ALL SELECT 'index different' FROM h WHERE length('r' || k) % 2 = 0 AND n = 2) SELECT issue, count(*) AS n FROM i GROUP BY 1"),
    "experiment_log": (experiment_log, "WITH s AS (SELECT user_id, arg_max(CASE event_type WHEN 'click' THEN 'started' ELSE 'finished' END, event_id) st FROM events WHERE event_type IN ('click', 'view') GROUP BY 1) SELECT user_id AS exp, 'interrupted' AS status, (SELECT max(user_id) + 1 FROM events) AS next FROM s WHERE st = 'started'"),
    "history_filter": (history_filter, "WITH m AS (SELECT conv_id, count(*) FILTER (role IN ('user', 'assistant') AND turn % 5 <> 4 AND trim(text) <> '') AS n_messages, max(turn) AS last_turn FROM conversations WHERE conv_id % 9 <> 0 GROUP BY 1) SELECT *, row_number() OVER (ORDER BY last_turn DESC, conv_id) AS place FROM m"),
    "filtered_notes": (filtered_notes, "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "current_pages": (current_pages, "SELECT l_orderkey, l_linenumber, o_orderkey AS doc FROM lineitem JOIN orders ON o_orderkey = l_orderkey % 5000 AND o_orderstatus = 'O'"),
    "grouped_hits": (grouped_hits, "WITH k AS (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem), g AS (SELECT l_suppkey, l_returnflag, count(*) AS n_hits, string_agg(r::VARCHAR, ',' ORDER BY r) AS ranks, min(r) f FROM k WHERE r <= 30 GROUP BY 1, 2) SELECT l_suppkey, l_returnflag, n_hits, ranks, row_number() OVER (PARTITION BY l_suppkey ORDER BY f) AS place FROM g"),
    "digest_cache": (digest_cache, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"),
    "stored_weights": (stored_weights, "SELECT n_name AS name, n_regionkey::INT AS at, round(n_nationkey / 7, 9) AS value FROM nation"),
    "trial_files": (trial_files, "WITH h AS (SELECT DISTINCT 'F' || (n_nationkey % 9) || CASE WHEN n_nationkey % 2 = 0 THEN 'L' ELSE 'M' END AS trial FROM nation), w AS (SELECT 'F' || k || x AS trial FROM range(0, 8) r(k), (SELECT unnest(['L', 'M']) x)) SELECT coalesce(h.trial, w.trial) AS trial, CASE WHEN h.trial IS NULL THEN 'missing' ELSE 'unexpected' END AS issue FROM h FULL JOIN w ON h.trial = w.trial WHERE h.trial IS NULL OR w.trial IS NULL"),
    "confirmation_keys": (confirmation_keys, "SELECT n_nationkey, substr(sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}'), 1, 16) AS key FROM nation"),
    "visible_notes": (visible_notes, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_custkey % 5 = 0 OR o_custkey % 3 IN (0, 1))"),
    "first_texts": (first_texts, "SELECT conv_id, md5(arg_min(text, turn)) AS text FROM conversations GROUP BY 1"),
}
