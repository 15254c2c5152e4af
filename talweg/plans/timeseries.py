"""Queries of windows, splits, scores, alarms and metrics. Signals are `events` by user: value in order of (ts, event_id), windows of five, odd users faulty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import signal as S
from ..operators import selection as L
from ..operators import sequences as Q
from ..storage import staged
from ..storage import table as T

SIZE = 5
_S = "s AS (SELECT user_id, event_id, ts, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events), w AS (SELECT *, idx // 5 AS win FROM s WHERE idx // 5 < n // 5)"
_F = "f AS (SELECT user_id, win, max(n) AS n, min(idx) AS first, max(idx) + 1 AS last, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, sqrt(avg(value * value)) AS rms, avg(value) AS mean, stddev_pop(value) AS std FROM w GROUP BY 1, 2)"
_P = "p AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'healthy' WHEN last <= n // 2 THEN 'pre_fault' WHEN first >= n // 2 THEN 'post_fault' ELSE 'transition' END AS phase FROM f)"
_R = "k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY win) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS nw FROM p), r AS (SELECT *, CASE WHEN i < floor(nw * 0.5) THEN 'train' WHEN i >= floor(nw * 0.5) + 1 AND i < floor(nw * 0.8) THEN 'calibration' WHEN i >= floor(nw * 0.8) + 1 AND i < floor(nw * 1.0) THEN 'test' END AS role FROM k)"
_Z = "u AS (SELECT user_id, win, phase, role, feature, x FROM r UNPIVOT (x FOR feature IN (median, iqr, rms, std))), c AS (SELECT feature, quantile_cont(x, 0.5) AS center, CASE WHEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) = 0 THEN 1 ELSE quantile_cont(x, 0.75) - quantile_cont(x, 0.25) END AS scale FROM u WHERE role = 'train' AND user_id % 2 = 0 GROUP BY 1), z AS (SELECT u.*, (x - center) / scale AS z FROM u JOIN c USING (feature)), e AS (SELECT user_id, win, phase, role, round(list_sum(list_sort(list(z * z), 'DESC')[1:2]) / 2, 9) AS score FROM z GROUP BY ALL)"
_T = "t AS (SELECT max(score) FILTER (q = ceil((m - 1) * 0.9)) AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS q, count(*) OVER () AS m FROM e WHERE role = 'calibration' AND user_id % 2 = 0)), g AS (SELECT e.*, score > threshold AS flag FROM e, t)"
_A = "a0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, phase ORDER BY win) - row_number() OVER (PARTITION BY user_id, phase, flag ORDER BY win) AS isl FROM g), a AS (SELECT *, row_number() OVER (PARTITION BY user_id, phase, isl ORDER BY win) AS run FROM a0 WHERE flag)"


def _samples(spark, d):
    return Q.tumbling(Q.numbered(T(spark, d, "events").select("user_id", "ts", "event_id", "value", "event_type"), "user_id", ["ts", "event_id"]), SIZE)


def _features(spark, d):
    s = _samples(spark, d)
    f = S.window_features(s, ["user_id", "win", "n"], "value")
    first = F.col("win") * SIZE
    return f.withColumn("phase", Q.phase(first, first + SIZE, F.floor(F.col("n") / 2), F.col("user_id") % 2 == 1)).drop("n", "n_samples")


def _roles(spark, d):
    return Q.temporal_split(_features(spark, d), "user_id", "win", {"train": 0.5, "calibration": 0.3, "test": 0.2}, 1, 1)  # some users have few windows


def _long(spark, d):
    return S.unpivot_features(_roles(spark, d), ["user_id", "win", "phase", "role"], ["median", "iqr", "rms", "std"])


def _scaled(spark, d):
    u = _long(spark, d)
    return S.scaled(u, S.robust_center(u.where("role = 'train' and user_id % 2 = 0"), ["feature"], "x"), ["feature"], "x")


def _scores(spark, d):
    z = _scaled(spark, d).groupBy("user_id", "win", "phase", "role").agg(F.collect_list(F.col("z") * F.col("z")).alias("e"))  # four features
    return z.select("user_id", "win", "phase", "role", F.round(S.top_mean(F.col("e"), 2), 9).alias("score"))


def _threshold(spark, d):
    return S.order_statistic(staged(_scores(spark, d), "scores").where("role = 'calibration' and user_id % 2 = 0"), "score", 90)


def _flags(spark, d):
    """Scores are far fewer than samples, and three passes follow; they are computed once."""
    e = staged(_scores(spark, d), "scores")
    at = S.order_statistic(e.where("role = 'calibration' and user_id % 2 = 0"), "score", 90).select("threshold")
    return e.crossJoin(F.broadcast(at)).withColumn("flag", F.col("score") > F.col("threshold")).drop("threshold")


def _alarms(flags, m=2):
    return Q.alarm_starts(flags, ["user_id", "phase"], "win", "flag", m)


def _rounded(df, *names, to=6):
    for c in names:
        df = df.withColumn(c, F.round(c, to))
    return df


def tumbling_windows(spark, d):
    return _samples(spark, d).groupBy("user_id", "win").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.round(F.sum("value"), 6).alias("total"))


def window_features(spark, d):
    return _rounded(_features(spark, d), "median", "iqr", "rms", "mean", "std")


def irregular_windows(spark, d):
    s = _samples(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return Q.irregular_step(s, "user_id", "t", 5.0)


def thd_dft(spark, d):
    s = _samples(spark, d).withColumn("pos", F.col("idx") % SIZE)
    return _rounded(S.spectral_indicators(S.harmonics(s, ["user_id", "win"], "pos", "value", SIZE, 2)), "a0", "c1", "c2", "thd", "a0_c1", "c2_c1", to=5)


def temporal_split(spark, d):
    return _roles(spark, d).select("user_id", "win", "role")


def preparation_report(spark, d):
    """Windows by role and phase, with totals; null roles are the purged ones."""
    return _roles(spark, d).withColumn("role", F.coalesce("role", F.lit("purged"))).rollup("role", "phase").agg(F.count(F.lit(1)).alias("n"))


def robust_scale(spark, d):
    return _rounded(_scaled(spark, d).select("user_id", "win", "feature", "z"), "z")


def sequences(spark, d):
    q = Q.padded_sequences(_roles(spark, d).where("role is not null"), ["user_id", "role"], "win", "win", 4)
    return q.select("user_id", "role", "win", F.array_join(F.transform("sequence", lambda x: x.cast("string")), ",").alias("sequence"))


def topk_score(spark, d):
    return _scores(spark, d)


def threshold(spark, d):
    return _threshold(spark, d).select("n", F.col("at").cast("long").alias("at"), F.round("threshold", 6).alias("threshold"))


def alarm_starts(spark, d):
    return _alarms(_flags(spark, d)).select("user_id", "phase", "win")


def first_alarm_after_onset(spark, d):
    onset = Q.nominal_onset(_features(spark, d), "user_id", "win")
    first = _alarms(_flags(spark, d)).where("phase = 'post_fault'").groupBy("user_id").agg(F.min("win").alias("alarm"))
    j = onset.where("onset is not null").join(first, "user_id", "left")
    return j.withColumn("delay_ms", F.round(Q.delay_ms(F.lit(0), F.col("alarm") - F.col("onset"), F.lit(0), SIZE, 100.0), 3))


def commissioning_segments(spark, d):
    return Q.commissioning(_features(spark, d), "user_id", "win", 3).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mean"), 4).alias("total"))


def relabelled(spark, d):
    f = _features(spark, d)
    on = Q.nominal_onset(f, "user_id", "win").withColumn("observed", F.col("onset") + F.col("user_id") % 3).withColumn("clear", F.col("user_id") % 5 != 0)
    return Q.relabel(f, on, "user_id", "win").groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


def markov_rates(spark, d):
    m = M.markov_rates(_flags(spark, d).where("user_id % 2 = 0"), ["user_id", "phase"], "win", "flag", [], 2, 3600.0)
    return _rounded(m, "p01", "p11", "per_window", "per_hour", "predicted")


def autocorrelation(spark, d):
    f = _features(spark, d)
    a = S.autocorrelation(f, ["user_id"], "win", "mean", 2)
    return _rounded(a.withColumn("n_effective", S.effective_size(F.col("n"), F.col("acf1"))), "acf1", "acf2", "n_effective")


def confusion_metrics(spark, d):
    rows = _flags(spark, d).where("phase <> 'transition'")
    return _rounded(M.derived(M.confusion(rows, ["user_id"], F.col("phase") == "post_fault", F.col("flag"))), "sensitivity", "specificity", "precision", "f1", "balanced", "mcc")


def fault_summary(spark, d):
    """Counts summed over a fault's trials (users by remainder of 7) and measured again, with totals by grouping sets."""
    rows = _flags(spark, d).where("phase <> 'transition'").withColumn("fault", F.col("user_id") % 7)
    counts = M.confusion(rows, ["fault", "user_id"], F.col("phase") == "post_fault", F.col("flag"))
    whole = counts.groupingSets([[], [F.col("fault")]], "fault").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")])
    return _rounded(M.derived(whole), "sensitivity", "specificity", "precision", "f1", "balanced", "mcc")


def _scored(spark, d):
    return T(spark, d, "labels").join(T(spark, d, "documents"), "doc_id").select("lang", (F.col("quality") == 1).alias("pos"), F.floor(F.col("n_chars") / 50).alias("score"))


def auc_roc(spark, d):
    return _rounded(M.auc_roc(_scored(spark, d), ["lang"], "score", "pos"), "auc_roc")


def auc_pr(spark, d):
    return _rounded(M.auc_pr(_scored(spark, d), ["lang"], "score", "pos"), "auc_pr")


def seed_spread(spark, d):
    e = T(spark, d, "events").withColumn("seed", F.col("event_id") % 5).groupBy("user_id", "seed").agg(F.round(F.max("value"), 6).alias("v"))
    return M.spread(e.withColumn("v", F.when(F.col("v") > 20, F.col("v"))).withColumn("found", F.col("v").isNotNull()), ["user_id"], "v", "found")


def paired_diff(spark, d):
    e = T(spark, d, "events").where("event_type in ('click', 'view')").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return _rounded(M.paired(e, "user_id", "event_type", "v", "click", "view"), "a", "b", "diff")


PERCENTILES, CONFIRMATIONS, CANONICAL = (80, 90, 95), (1, 2, 3, 5), {"k": 2, "p": 90, "m": 2}


def alarm_grid(spark, d):
    """Alarms for each number of largest errors, confirmations and percentile, against the canonical setting. One row a k has its thresholds; the scores are sorted once."""
    z = _scaled(spark, d).groupBy("user_id", "win", "phase", "role").agg(F.collect_list(F.col("z") * F.col("z")).alias("e"))  # four features
    scores = z.select("user_id", "win", "phase", "role", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(S.top_mean(F.col("e"), k), 9).alias("score")) for k in (1, 2, 4)])).alias("s")).select("user_id", "win", "phase", "role", "s.*")
    e = staged(scores, "scores")
    cal = e.where("role = 'calibration' and user_id % 2 = 0")
    limits = None
    for p in PERCENTILES:
        one = L.order_statistic(cal, ["k"], "score", p).select("k", F.lit(p).alias("p"), "threshold")
        limits = one if limits is None else limits.unionByName(one)
    rows = e.join(F.broadcast(limits.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "threshold"))), lambda x: x["threshold"]).alias("limits"))), "k")  # one row a k
    grid = S.alarm_grid(rows, ["k"], "user_id", "phase", "win", "score", F.col("limits"), CONFIRMATIONS)
    grid = grid.withColumn("p", F.element_at(F.array(*map(F.lit, PERCENTILES)), F.col("place") + 1)).drop("place")
    return S.against(grid, (F.col("k") == CANONICAL["k"]) & (F.col("p") == CANONICAL["p"]) & (F.col("m") == CANONICAL["m"]))


def bootstrap_ci(spark, d):
    f = _flags(spark, d).withColumn("flag", F.col("flag").cast("int"))
    return _rounded(M.block_bootstrap(f, ["user_id"], "user_id", "win", "flag", 5, 500, 20), "mean", "low", "high")


def paired_blocks(spark, d):
    """Two detectors (one with a lower threshold) on the same windows, by phase: the difference's interval and its verdict."""
    f = _flags(spark, d).select("user_id", "phase", "win", F.col("flag").cast("int").alias("a"), (F.col("score") > 2.0).cast("int").alias("b"))
    out = M.paired_blocks(f, ["phase"], "user_id", "win", "a", "b", 5, 500, 20)
    return _rounded(out, "mean", "low", "high").withColumn("verdict", M.verdict(F.col("low"), F.col("high"), "a", "b"))


def poisson_upper(spark, d):
    a = _alarms(_flags(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_alarms"))
    return a.groupBy("n_alarms").agg(F.count(F.lit(1)).alias("n_users")).withColumn("upper", F.round(M.poisson_upper("n_alarms"), 6))


def beta_interval(spark, d):
    t = _threshold(spark, d).withColumn("i", M.beta_interval(F.col("at") + 1, F.col("n")))
    return t.select("n", "at", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


def pelt_changes(spark, d):
    return S.change_points_by(_features(spark, d), "user_id", "win", ["mean", "rms"], 2.0, 3)


def order_statistic_groups(spark, d):
    return S.order_statistic_by(T(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", 99)


def evidence_variable(spark, d):
    """At each alarm the variable with the largest error, and the place of `std` among the four."""
    from pyspark.sql import Window

    al = _alarms(_flags(spark, d)).select("user_id", "win")
    z = _scaled(spark, d).join(al, ["user_id", "win"]).withColumn("err", F.round(F.col("z") * F.col("z"), 6))
    w = Window.partitionBy("user_id", "win")
    z = z.withColumn("place", F.row_number().over(w.orderBy(F.desc("err"), "feature")))
    return z.groupBy("user_id", "win").agg(F.max(F.when(F.col("place") == 1, F.col("feature"))).alias("strongest"), F.max(F.when(F.col("feature") == "std", F.col("place"))).alias("std_place"))


def detection_summary(spark, d):
    """Alarms, windows above and their share by phase."""
    flags = _flags(spark, d)
    f = flags.groupBy("phase").agg(F.count(F.lit(1)).alias("windows"), F.count_if("flag").alias("above"))
    a = _alarms(flags).groupBy("phase").agg(F.count(F.lit(1)).alias("alarms"), F.countDistinct("user_id").alias("trials"))
    return f.join(a, "phase", "left").select("phase", "windows", "above", F.round(F.col("above") / F.col("windows"), 6).alias("share"), F.coalesce("alarms", F.lit(0)).alias("alarms"), F.coalesce("trials", F.lit(0)).alias("trials"))


_ALL = f"WITH {_S}, {_F}, {_P}, {_R}, {_Z}, {_T}, {_A}"
_ROUND = lambda names, to=6: ", ".join(f"round({c}, {to}) AS {c}" for c in names.split())
_CONF = "count(*) FILTER (phase = 'post_fault' AND flag) AS tp, count(*) FILTER (phase = 'post_fault' AND NOT flag) AS fn, count(*) FILTER (phase <> 'post_fault' AND flag) AS fp, count(*) FILTER (phase <> 'post_fault' AND NOT flag) AS tn"
_DER = "round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS precision, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced, round(coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) AS mcc"
_SC = "x AS (SELECT lang, quality = 1 AS pos, n_chars // 50 AS score FROM labels JOIN documents USING (doc_id))"
_ORD = "SELECT max(score) FILTER (q = ceil((m - 1) * {p})) AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS q, count(*) OVER () AS m FROM e WHERE role = 'calibration' AND user_id % 2 = 0)"
QUERIES = {
    "tumbling_windows": (tumbling_windows, f"WITH {_S} SELECT user_id, win, count(*) AS n, min(idx) AS first, round(sum(value), 6) AS total FROM w GROUP BY 1, 2"),
    "window_features": (window_features, f"WITH {_S}, {_F}, {_P} SELECT user_id, win, phase, {_ROUND('median iqr rms mean std')} FROM p"),
    "irregular_windows": (irregular_windows, f"WITH {_S}, g AS (SELECT user_id, win, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, win ORDER BY idx)) / 1e6 AS dt FROM w), m AS (SELECT user_id, quantile_cont(dt, 0.5) AS md FROM g GROUP BY 1) SELECT user_id, win, coalesce(bool_or(abs(dt - md) > 5.0 * abs(md)), false) AS irregular FROM g JOIN m USING (user_id) GROUP BY 1, 2"),
    "thd_dft": (thd_dft, f"WITH {_S}, h AS (SELECT user_id, win, avg(value) a0, sqrt(sum(value * cos(2 * pi() * (idx % 5) / 5)) ^ 2 + sum(value * sin(2 * pi() * (idx % 5) / 5)) ^ 2) * 0.4 AS c1, sqrt(sum(value * cos(4 * pi() * (idx % 5) / 5)) ^ 2 + sum(value * sin(4 * pi() * (idx % 5) / 5)) ^ 2) * 0.4 AS c2 FROM w GROUP BY 1, 2) SELECT user_id, win, {_ROUND('a0 c1 c2', 5)}, round(c2 / nullif(c1, 0), 5) AS thd, round(a0 / nullif(c1, 0), 5) AS a0_c1, round(c2 / nullif(c1, 0), 5) AS c2_c1 FROM h"),
    "temporal_split": (temporal_split, f"WITH {_S}, {_F}, {_P}, {_R} SELECT user_id, win, role FROM r"),
    "preparation_report": (preparation_report, f"WITH {_S}, {_F}, {_P}, {_R}, x AS (SELECT coalesce(role, 'purged') AS role, phase FROM r) SELECT role, phase, count(*) AS n FROM x GROUP BY ROLLUP (role, phase)"),
    "robust_scale": (robust_scale, f"WITH {_S}, {_F}, {_P}, {_R}, {_Z} SELECT user_id, win, feature, round(z, 6) AS z FROM z"),
    "sequences": (sequences, f"WITH {_S}, {_F}, {_P}, {_R}, q AS (SELECT user_id, role, win, list(win) OVER (PARTITION BY user_id, role ORDER BY win ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l, min(win) OVER (PARTITION BY user_id, role) AS f0 FROM r WHERE role IS NOT NULL) SELECT user_id, role, win, array_to_string(list_transform(range(4 - len(l)), lambda i: f0) || l, ',') AS sequence FROM q"),
    "topk_score": (topk_score, f"WITH {_S}, {_F}, {_P}, {_R}, {_Z} SELECT user_id, win, phase, role, score FROM e"),
    "threshold": (threshold, f"WITH {_S}, {_F}, {_P}, {_R}, {_Z} SELECT max(m) AS n, max(ceil((m - 1) * 0.9))::BIGINT AS at, round(max(score) FILTER (q = ceil((m - 1) * 0.9)), 6) AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS q, count(*) OVER () AS m FROM e WHERE role = 'calibration' AND user_id % 2 = 0)"),
    "alarm_starts": (alarm_starts, f"{_ALL} SELECT user_id, phase, win FROM a WHERE run = 2"),
    "first_alarm_after_onset": (first_alarm_after_onset, f"{_ALL}, o AS (SELECT user_id, coalesce(min(win) FILTER (phase = 'transition'), min(win) FILTER (phase = 'post_fault')) AS onset FROM p GROUP BY 1), l AS (SELECT user_id, min(win) AS alarm FROM a WHERE run = 2 AND phase = 'post_fault' GROUP BY 1) SELECT user_id, onset, alarm, round((alarm - onset + 1) * 5 / 100.0 * 1000, 3) AS delay_ms FROM o LEFT JOIN l USING (user_id) WHERE onset IS NOT NULL"),
    "commissioning_segments": (commissioning_segments, f"WITH {_S}, {_F}, {_P}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id, phase ORDER BY win) k, count(*) OVER (PARTITION BY user_id, phase) c FROM p) SELECT CASE WHEN phase = 'pre_fault' THEN CASE WHEN k <= greatest(3, c // 2) THEN 'commissioning' ELSE 'pre_test' END ELSE phase END AS segment, count(*) AS n, round(sum(mean), 4) AS total FROM x GROUP BY 1"),
    "relabelled": (relabelled, f"WITH {_S}, {_F}, {_P}, o AS (SELECT user_id, coalesce(min(win) FILTER (phase = 'transition'), min(win) FILTER (phase = 'post_fault')) AS onset FROM p GROUP BY 1) SELECT CASE WHEN user_id % 5 <> 0 AND win >= onset AND win < onset + user_id % 3 THEN 'transition' ELSE phase END AS phase, count(*) AS n FROM p JOIN o USING (user_id) GROUP BY 1"),
    "markov_rates": (markov_rates, f"{_ALL}, b AS (SELECT flag, lag(flag) OVER (PARTITION BY user_id, phase ORDER BY win) AS bf FROM g WHERE user_id % 2 = 0), n AS (SELECT count(*) FILTER (NOT bf AND NOT flag) AS n00, count(*) FILTER (NOT bf AND flag) AS n01, count(*) FILTER (bf AND NOT flag) AS n10, count(*) FILTER (bf AND flag) AS n11, count(*) AS windows, count(*) FILTER (flag) AS above FROM b), q AS (SELECT *, coalesce(n01 / nullif(n00 + n01, 0), 0) AS p01, coalesce(n11 / nullif(n10 + n11, 0), 0) AS p11 FROM n), v AS (SELECT *, coalesce((1 - p11) / nullif(p01 + 1 - p11, 0), 1) * p01 * p11 AS per_window FROM q) SELECT n00, n01, n10, n11, windows, above, {_ROUND('p01 p11 per_window')}, round(per_window * 3600, 6) AS per_hour, round(per_window * windows, 6) AS predicted FROM v"),
    "autocorrelation": (autocorrelation, f"WITH {_S}, {_F}, c AS (SELECT user_id, win, mean - avg(mean) OVER (PARTITION BY user_id) AS c FROM f), l AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY win) l1, lag(c, 2) OVER (PARTITION BY user_id ORDER BY win) l2 FROM c), v AS (SELECT user_id, count(*) AS n, coalesce(sum(c * l1) / nullif(sum(c * c), 0), 0) AS acf1, coalesce(sum(c * l2) / nullif(sum(c * c), 0), 0) AS acf2 FROM l GROUP BY 1) SELECT user_id, n, {_ROUND('acf1 acf2')}, round(n * (1 - greatest(acf1, 0)) / (1 + greatest(acf1, 0)), 6) AS n_effective FROM v"),
    "confusion_metrics": (confusion_metrics, f"{_ALL}, k2 AS (SELECT user_id, {_CONF} FROM g WHERE phase <> 'transition' GROUP BY 1) SELECT *, {_DER} FROM k2"),
    "fault_summary": (fault_summary, f"{_ALL}, k2 AS (SELECT user_id % 7 AS fault, {_CONF} FROM g WHERE phase <> 'transition' GROUP BY GROUPING SETS ((), (user_id % 7))) SELECT *, {_DER} FROM k2"),
    "auc_roc": (auc_roc, f"WITH {_SC}, k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r FROM x) SELECT lang, round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auc_roc FROM k GROUP BY 1"),
    "auc_pr": (auc_pr, f"WITH {_SC}, k AS (SELECT lang, score, count(*) FILTER (pos) p, count(*) n FROM x GROUP BY 1, 2), c AS (SELECT lang, score, sum(p) OVER w AS tp, sum(n) OVER w AS al, sum(p) OVER (PARTITION BY lang) AS np FROM k WINDOW w AS (PARTITION BY lang ORDER BY score DESC)), r AS (SELECT lang, score, tp / np AS rc, tp / al AS pr FROM c), t AS (SELECT lang, (rc - coalesce(lag(rc) OVER v, 0)) * (pr + coalesce(lag(pr) OVER v, 1)) / 2 AS area FROM r WINDOW v AS (PARTITION BY lang ORDER BY score DESC)) SELECT lang, round(sum(area), 6) AS auc_pr FROM t GROUP BY 1"),
    "seed_spread": (seed_spread, "WITH e AS (SELECT user_id, event_id % 5 AS seed, round(max(value), 6) AS v FROM events GROUP BY 1, 2), f AS (SELECT user_id, CASE WHEN v > 20 THEN v END AS v FROM e) SELECT user_id, min(v) AS least, max(v) AS most, count(v) AS n_detected, count(*) AS n_seeds FROM f GROUP BY 1"),
    "paired_diff": (paired_diff, "WITH e AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY 1) SELECT user_id, round(a, 6) AS a, round(b, 6) AS b, round(a - b, 6) AS diff FROM e"),
    "alarm_grid": (alarm_grid, f"""WITH {_S}, {_F}, {_P}, {_R}, {_Z}, ks AS (SELECT unnest([1, 2, 4]) AS k), ps AS (SELECT unnest([80, 90, 95]) AS p), ms AS (SELECT unnest([1, 2, 3, 5]) AS m),
v AS (SELECT user_id, win, phase, role, k, round(list_sum(list_sort(list(z * z), 'DESC')[1:k]) / k, 9) AS score FROM z, ks GROUP BY user_id, win, phase, role, k),
q AS (SELECT k, score, row_number() OVER (PARTITION BY k ORDER BY score) - 1 AS place, count(*) OVER (PARTITION BY k) AS n FROM v WHERE role = 'calibration' AND user_id % 2 = 0),
th AS (SELECT k, p, max(score) FILTER (place = ceil((n - 1) * (p / 100))) AS threshold FROM q, ps GROUP BY k, p),
fl AS (SELECT v.*, p, score > threshold AS flag FROM v JOIN th USING (k)),
i1 AS (SELECT *, row_number() OVER (PARTITION BY k, p, user_id, phase ORDER BY win) - row_number() OVER (PARTITION BY k, p, user_id, phase, flag ORDER BY win) AS isl FROM fl),
i2 AS (SELECT *, row_number() OVER (PARTITION BY k, p, user_id, phase, isl ORDER BY win) AS run FROM i1 WHERE flag),
g AS (SELECT ks.k, ps.p, ms.m, count(user_id) AS n_alarms, count(DISTINCT user_id) AS n_trials FROM ks CROSS JOIN ps CROSS JOIN ms LEFT JOIN i2 ON i2.k = ks.k AND i2.p = ps.p AND i2.run = ms.m GROUP BY 1, 2, 3)
SELECT g.*, g.n_alarms - c.n_alarms AS more_alarms, g.n_trials - c.n_trials AS more_trials FROM g, (SELECT * FROM g WHERE k = 2 AND p = 90 AND m = 2) c"""),
    "bootstrap_ci": (bootstrap_ci, None),
    "paired_blocks": (paired_blocks, None),
    "poisson_upper": (poisson_upper, None),
    "beta_interval": (beta_interval, None),
    "pelt_changes": (pelt_changes, None),
    "order_statistic_groups": (order_statistic_groups, "SELECT l_suppkey, l_extendedprice AS threshold FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS q, count(*) OVER (PARTITION BY l_suppkey) AS m FROM lineitem) WHERE q = ceil((m - 1) * 0.99)"),
    "evidence_variable": (evidence_variable, f"{_ALL}, y AS (SELECT z.user_id, z.win, feature, row_number() OVER (PARTITION BY z.user_id, z.win ORDER BY round(z.z * z.z, 6) DESC, feature) AS place FROM z JOIN (SELECT user_id, win FROM a WHERE run = 2) b ON z.user_id = b.user_id AND z.win = b.win) SELECT user_id, win, max(feature) FILTER (place = 1) AS strongest, max(place) FILTER (feature = 'std')::INT AS std_place FROM y GROUP BY 1, 2"),
    "detection_summary": (detection_summary, f"{_ALL}, b AS (SELECT phase, count(*) AS windows, count(*) FILTER (flag) AS above FROM g GROUP BY 1), c2 AS (SELECT phase, count(*) AS alarms, count(DISTINCT user_id) AS trials FROM a WHERE run = 2 GROUP BY 1) SELECT phase, windows, above, round(above / windows, 6) AS share, coalesce(alarms, 0) AS alarms, coalesce(trials, 0) AS trials FROM b LEFT JOIN c2 USING (phase)"),
}
