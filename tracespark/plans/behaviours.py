"""Queries of the behaviour operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracespark.functions import pvalues
from tracespark.functions.semantics import median, ratio, rounded
from tracespark.operators import behaviour as op
from tracespark.operators import timejoin
from tracespark.plans import bindings as b
from tracespark.plans.bindings import query

TICK = "wheel AS (SELECT rec, t, floor(value)::DOUBLE AS tick FROM ev)"


@query("b1_wheel_distance", f"""WITH {TICK},
d AS (SELECT *, tick - lag(tick) OVER w < -10 AS fell, CASE WHEN tick < lag(tick) OVER w THEN lag(tick) OVER w ELSE 0 END AS lost
  FROM wheel WINDOW w AS (PARTITION BY rec ORDER BY t)),
s AS (SELECT *, sum(coalesce(fell, false)::INT) OVER w AS segment, tick + sum(lost) OVER w AS continuous FROM d WINDOW w AS (PARTITION BY rec ORDER BY t))
SELECT rec, t, segment::BIGINT AS segment, tick - first(tick) OVER (PARTITION BY rec, segment ORDER BY t) AS distance, continuous FROM s -- FROM ev""")
def b1(spark, d):
    wheel = b.events(spark, d).select("rec", "t", F.floor("value").cast("double").alias("tick"))
    return op.wheel_distance(wheel).select("rec", "t", F.col("segment").cast("long").alias("segment"), "distance", "continuous")


HOUR = 3.6e6


@query("b2_resampled", f"""WITH g AS (SELECT rec, t AS a, value AS v, lead(t) OVER w AS z, lead(value) OVER w AS w_ FROM ev WINDOW w AS (PARTITION BY rec ORDER BY t)),
k AS (SELECT *, unnest(range(ceil(a / {HOUR})::BIGINT, ceil(z / {HOUR})::BIGINT)) AS k FROM g WHERE z IS NOT NULL)
SELECT rec, k * {HOUR} AS t, round(v + (w_ - v) * (k * {HOUR} - a) / (z - a), 6) AS value FROM k""")
def b2(spark, d):
    return op.resampled(b.events(spark, d), HOUR).withColumn("value", rounded(F.col("value")))


@query("b3_smooth_speed", """WITH r AS (SELECT rec, t, (coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value))
  / nullif(coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t), 0) * 1e6 AS raw, row_number() OVER w AS k, count(*) OVER (PARTITION BY rec) AS n FROM ev WINDOW w AS (PARTITION BY rec ORDER BY t)),
m AS (SELECT *, k AS p FROM r UNION ALL SELECT *, 1 - k FROM r WHERE k <= 5 UNION ALL SELECT *, 2 * n + 1 - k FROM r WHERE k > n - 5),
s AS (SELECT *, avg(raw) OVER (PARTITION BY rec ORDER BY p ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS speed FROM m) SELECT rec, t, round(speed, 6) AS speed FROM s WHERE p = k""")
def b3(spark, d):
    return op.smooth_speed(b.events(spark, d).withColumn("value", F.col("value") * 1e6), 5, value="value").select(
        "rec", "t", rounded(F.col("speed")).alias("speed"))


@query("b5_online_onsets", """WITH s AS (SELECT rec, t, value, (value <= 10 OR coalesce(t - lag(t) OVER w > 14400000, false))::INT AS broken FROM ev WINDOW w AS (PARTITION BY rec ORDER BY t)),
i AS (SELECT *, sum(broken) OVER (PARTITION BY rec ORDER BY t) AS streak FROM s),
k AS (SELECT rec, t, row_number() OVER (PARTITION BY rec, streak ORDER BY t) AS k FROM i WHERE value > 10)
SELECT rec, min(t) AS onset FROM k WHERE k > 3 GROUP BY rec""")
def b5(spark, d):
    return op.online_onsets(b.events(spark, d).select("rec", "t", "value"), ["rec"], streak=3, gap=14_400_000)


IN_TRIAL = """l AS (SELECT lick.rec, trial.trial, lick.t - trial.t AS rel, lick.value FROM lick ASOF JOIN trial ON lick.rec = trial.rec AND lick.t >= trial.t)"""


def licks_in_trials(spark, d):
    found = timejoin.asof(b.licks(spark, d), b.trials(spark, d).select("rec", "trial", "t"), ["rec"])
    return found.where("at_trial is not null").select("rec", F.col("at_trial").alias("trial"), (F.col("t") - F.col("at_t")).alias("rel"), "value")


@query("b6_relative_licks", f"WITH {IN_TRIAL} SELECT rec, trial, round(rel, 3) AS rel FROM l -- FROM lick JOIN trial")
def b6(spark, d):
    return licks_in_trials(spark, d).select("rec", "trial", F.round("rel", 3).alias("rel"))


@query("b8_lick_positions", """WITH p AS (SELECT lick.rec, lick.t, e.t AS a, e.value AS v FROM lick ASOF JOIN reward e ON lick.rec = e.rec AND lick.t >= e.t),
n AS (SELECT p.*, e.t AS z, e.value AS w FROM p ASOF JOIN reward e ON p.rec = e.rec AND p.t <= e.t)
SELECT rec, t, round(CASE WHEN z = a THEN v ELSE v + (w - v) * (t - a) / (z - a) END, 6) AS position FROM n""")
def b8(spark, d):
    back = timejoin.asof(b.licks(spark, d).select("rec", "t"), b.rewards(spark, d), ["rec"], prefix="a_")
    both = timejoin.asof(back, b.rewards(spark, d), ["rec"], prefix="z_", forward=True).where("a_t is not null and z_t is not null")
    share = F.coalesce(ratio(F.col("t") - F.col("a_t"), F.col("z_t") - F.col("a_t")), F.lit(0.0))
    return both.select("rec", "t", rounded(F.col("a_value") + (F.col("z_value") - F.col("a_value")) * share).alias("position"))


@query("b9_lick_map", f"WITH {IN_TRIAL} SELECT rec, trial, floor(value / 10)::BIGINT AS bin, count(*) AS n FROM l GROUP BY 1, 2, 3 -- FROM lick JOIN trial")
def b9(spark, d):
    return licks_in_trials(spark, d).groupBy("rec", "trial", F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))


@query("b10_lick_index", f"WITH {IN_TRIAL} SELECT rec, trial, round(sum((value >= 50)::INT) / count(*), 6) AS lick_index FROM l GROUP BY 1, 2 -- FROM lick JOIN trial")
def b10(spark, d):
    return op.lick_index(licks_in_trials(spark, d), ["rec", "trial"], F.col("value") >= 50).withColumn(
        "lick_index", rounded(F.col("lick_index")))


METRICS = """iv AS (SELECT rec, trial, t AS start, value, lead(t) OVER (PARTITION BY rec ORDER BY t) AS stop FROM trial),
e AS (SELECT ev.*, iv.trial, ev.t - iv.start AS rel FROM ev ASOF JOIN iv ON ev.rec = iv.rec AND ev.t >= iv.start),
m AS (SELECT rec, trial, min(rel) FILTER (kind = 'signup') AS reward, min(rel) FILTER (kind = 'click' AND rel >= 600000) AS first_lick,
  bool_or(kind = 'error' AND value > 90) AS non_stop, count(*) AS n_samples, max(value) AS max_speed, avg(value) AS mean_speed,
  sum((value < 10)::INT) / count(*) AS slow_share, quantile_cont(value, 0.99) AS top_speed FROM e GROUP BY 1, 2),
met AS (SELECT m.*, iv.stop - iv.start AS duration, iv.start - lag(iv.start + m.reward) OVER (PARTITION BY iv.rec ORDER BY iv.trial) AS iti,
  coalesce(reward IS NOT NULL AND NOT non_stop, false) AS valid FROM m JOIN iv ON m.rec = iv.rec AND m.trial = iv.trial)"""


def metrics(spark, d):
    own = b.trials(spark, d).select("rec", "trial", "t")
    rows = timejoin.asof(b.events(spark, d).select("rec", "t", "kind", "value"), own, ["rec"]).where("at_trial is not null").withColumn(
        "rel", F.col("t") - F.col("at_t"))
    w = Window.partitionBy("rec").orderBy("trial")
    return rows.groupBy("rec", F.col("at_trial").alias("trial")).agg(
        F.first("at_t").alias("start"),
        F.min(F.when(F.col("kind") == "signup", F.col("rel"))).alias("reward"),
        F.min(F.when((F.col("kind") == "click") & (F.col("rel") >= 600_000), F.col("rel"))).alias("first_lick"),
        F.bool_or((F.col("kind") == "error") & (F.col("value") > 90)).alias("non_stop"),
        F.count("*").alias("n_samples"), F.max("value").alias("max_speed"), F.avg("value").alias("mean_speed"),
        F.avg((F.col("value") < 10).cast("double")).alias("slow_share"), F.percentile("value", 0.99).alias("top_speed"),
    ).withColumns({
        "duration": F.lead("start").over(w) - F.col("start"),
        "iti": F.col("start") - F.lag(F.col("start") + F.col("reward")).over(w),
        "valid": op.valid_trial(F.col("reward").isNotNull(), F.col("non_stop"), F.col("reward")),
    })


@query("b11_valid_trials", f"WITH {METRICS} SELECT rec, trial, valid, coalesce(valid AND reward < 7200000, false) AS valid_early FROM met -- FROM ev JOIN trial")
def b11(spark, d):
    return metrics(spark, d).select("rec", "trial", "valid", op.valid_trial(
        F.col("reward").isNotNull(), F.col("non_stop"), F.col("reward"), 7_200_000.0).alias("valid_early"))


@query("b12_first_licks", f"""WITH {IN_TRIAL}, f AS (SELECT rec, trial, min(rel) AS first_lick FROM l WHERE rel >= 600000 GROUP BY 1, 2)
SELECT trial.rec, trial.trial, round(first_lick, 3) AS first_lick FROM trial LEFT JOIN f ON trial.rec = f.rec AND trial.trial = f.trial -- FROM lick""")
def b12(spark, d):
    return op.first_after(b.trials(spark, d).select("rec", "trial"), licks_in_trials(spark, d), 600_000, ["rec", "trial"]).withColumn(
        "first_lick", F.round("first_lick", 3))


@query("b13_first_lick_frames", f"""WITH {IN_TRIAL}, f AS (SELECT l.rec, l.trial, min(trial.t + rel) AS t FROM l JOIN trial ON l.rec = trial.rec AND l.trial = trial.trial
  WHERE rel >= 600000 GROUP BY 1, 2),
before AS (SELECT f.*, g.t AS bt, g.frame AS bf FROM f ASOF LEFT JOIN frame g ON f.rec = g.rec AND f.t >= g.t),
near AS (SELECT f.*, g.t AS nt, g.frame AS nf FROM before f ASOF LEFT JOIN frame g ON f.rec = g.rec AND f.t <= g.t)
SELECT rec, trial, CASE WHEN t - bt <= nt - t THEN bf ELSE nf END AS frame FROM near WHERE nt IS NOT NULL AND bt IS NOT NULL
UNION ALL SELECT rec, trial, nf AS frame FROM near WHERE bt IS NULL AND nt IS NOT NULL -- FROM lick""")
def b13(spark, d):
    """Licks later than the last frame are dropped."""
    own = b.trials(spark, d).select("rec", "trial", "t")
    first = op.first_after(own, licks_in_trials(spark, d), 600_000, ["rec", "trial"]).where("first_lick is not null").select(
        "rec", "trial", (F.col("t") + F.col("first_lick")).alias("t"))
    frames = b.frames(spark, d)
    near = timejoin.nearest(first, frames, ["rec"])
    last = frames.groupBy("rec").agg(F.max("t").alias("last"))
    return near.join(last, "rec").where("t <= last").select("rec", "trial", F.col("at_frame").alias("frame"))


LIMITS = {"iti_ms": 1.8e7, "first_lick_ms": 1.2e6, "duration_ms": 1.44e8, "max_speed": 65.0, "mad": 2.0, "slow_share": 0.3}
REASONS = """rs AS (SELECT met.*, mid, mad FROM met JOIN (SELECT x.rec, mid, quantile_cont(abs(mean_speed - mid), 0.5) AS mad FROM met x
  JOIN (SELECT rec, quantile_cont(mean_speed, 0.5) AS mid FROM met GROUP BY rec) q ON x.rec = q.rec GROUP BY x.rec, mid) s ON met.rec = s.rec),
rr AS (SELECT rec, trial, concat_ws(', ', CASE WHEN NOT valid THEN 'invalid' END, CASE WHEN n_samples < 2 THEN 'few samples' END,
  CASE WHEN coalesce(iti >= 1.8e7, true) THEN 'iti' END, CASE WHEN coalesce(first_lick <= 1.2e6, true) THEN 'early lick' END,
  CASE WHEN coalesce(duration >= 1.44e8, true) THEN 'long' END, CASE WHEN max_speed < 65 THEN 'slow' END,
  CASE WHEN mean_speed <= mid - 2 * mad THEN 'slow mean' END, CASE WHEN slow_share >= 0.3 THEN 'stops' END) AS reasons FROM rs)"""


@query("b14_good_trials", f"WITH {METRICS}, {REASONS} SELECT rec, trial, reasons = '' AS good FROM rr -- FROM ev JOIN trial")
def b14(spark, d):
    return op.good_trials(metrics(spark, d), limits=LIMITS).select("rec", "trial", "good")


@query("b16_reject_reasons", f"WITH {METRICS}, {REASONS} SELECT rec, trial, reasons FROM rr -- FROM ev JOIN trial")
def b16(spark, d):
    return op.good_trials(metrics(spark, d), limits=LIMITS).select("rec", "trial", "reasons")


@query("b17_intervals", f"WITH {METRICS} SELECT rec, trial, round(iti, 3) AS iti, round(duration, 3) AS length FROM met -- FROM ev JOIN trial")
def b17(spark, d):
    return metrics(spark, d).select("rec", "trial", F.round("iti", 3).alias("iti"), F.round("duration", 3).alias("length"))


@query("b18_session_summary", f"""WITH {METRICS}, {IN_TRIAL}, li AS (SELECT rec, trial, sum((value >= 50)::INT) / count(*) AS lick_index FROM l GROUP BY 1, 2),
lm AS (SELECT rec, avg(lick_index) AS lick_index FROM li GROUP BY rec)
SELECT met.rec, round(any_value(lick_index), 6) AS lick_index, round(quantile_cont(top_speed, 0.5), 6) AS speed_median, round(quantile_cont(duration, 0.5), 6) AS length_median,
  count(*) FILTER (valid) AS n_valid, round(avg(valid::INT), 6) AS valid_share FROM met LEFT JOIN lm ON lm.rec = met.rec GROUP BY met.rec -- FROM ev JOIN trial JOIN lick""")
def b18(spark, d):
    licks = op.lick_index(licks_in_trials(spark, d), ["rec", "trial"], F.col("value") >= 50).groupBy("rec").agg(rounded(F.avg("lick_index")).alias("lick_index"))
    return metrics(spark, d).groupBy("rec").agg(
        rounded(median("top_speed")).alias("speed_median"), rounded(median("duration")).alias("length_median"),
        F.count_if("valid").alias("n_valid"), rounded(F.avg(F.col("valid").cast("double"))).alias("valid_share")).join(licks, "rec", "left")


@query("b19_learning_summary", f"""WITH {METRICS}, {IN_TRIAL},
p AS (SELECT l.rec, count_if(abs(l.rel - reward) <= 3600000) / count(*) AS near_reward, quantile_cont(abs(l.rel - reward), 0.5) AS distance
  FROM l JOIN met ON l.rec = met.rec AND l.trial = met.trial WHERE reward IS NOT NULL GROUP BY 1),
q AS (SELECT rec, avg(valid::INT) AS valid, count_if(first_lick < 7200000) / count(*) AS early, count_if(first_lick > 9000000) / count(*) AS late FROM met GROUP BY 1)
SELECT q.rec, round(valid, 6) AS valid, round(early, 6) AS early, round(late, 6) AS late, round(near_reward, 6) AS near_reward, round(distance, 6) AS distance
FROM q LEFT JOIN p ON q.rec = p.rec -- FROM ev JOIN trial JOIN lick""")
def b19(spark, d):
    m = metrics(spark, d)
    gap = F.abs(F.col("rel") - F.col("reward"))
    near = licks_in_trials(spark, d).join(m.select("rec", "trial", "reward").where("reward is not null"), ["rec", "trial"]).groupBy("rec").agg(
        rounded(F.count_if(gap <= HOUR) / F.count("*")).alias("near_reward"), rounded(median(gap)).alias("distance"))
    share = lambda c: rounded(F.count_if(c) / F.count("*"))
    return m.groupBy("rec").agg(
        share(F.col("valid")).alias("valid"), share(F.col("first_lick") < 7.2e6).alias("early"), share(F.col("first_lick") > 9e6).alias("late"),
    ).join(near, "rec", "left")


@query("b20_learning_stage", """WITH m AS (SELECT *, dose > 100000 AS met FROM session),
w AS (SELECT *, min(met::INT) OVER w = 1 AND count(*) OVER w = 2 AS begins FROM m WINDOW w AS (PARTITION BY anm ORDER BY k ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
f AS (SELECT *, min(CASE WHEN begins THEN k END) OVER (PARTITION BY anm) AS day FROM w)
SELECT anm, k, CASE WHEN k > day THEN 'learned' ELSE 'learning' END AS stage, k - day AS since FROM f""")
def b20(spark, d):
    return op.learning_stage(b.sessions(spark, d), F.col("dose") > 100_000).select("anm", "k", "stage", "since")


@query("b21_treatment_days", """WITH t AS (SELECT anm, date, max((label LIKE '%HIGH%' AND dose > 50000)::INT) AS treated FROM session GROUP BY 1, 2),
c AS (SELECT *, sum(treated) OVER (PARTITION BY anm ORDER BY date) AS n FROM t)
SELECT s.anm, s.k, CASE WHEN treated = 1 THEN n::BIGINT END AS treatment_day FROM session s JOIN c ON s.anm = c.anm AND s.date = c.date""")
def b21(spark, d):
    return op.treatment_days(b.sessions(spark, d), F.col("label").contains("HIGH") & (F.col("dose") > 50_000)).select("anm", "k", "treatment_day")


SINCE = """s AS (SELECT rec, t, t - lag(t) OVER (PARTITION BY rec ORDER BY t) AS since FROM reward)"""


@query("b22_since_reward", f"""WITH {SINCE}, m AS (SELECT rec, quantile_cont(since, 0.5) AS mid FROM s GROUP BY rec)
SELECT s.rec, t, round(since, 3) AS since, CASE WHEN since <= mid THEN 'short' WHEN since > mid THEN 'long' END AS side FROM s JOIN m ON s.rec = m.rec -- FROM reward""")
def b22(spark, d):
    gaps = b.rewards(spark, d).select("rec", "t", (F.col("t") - F.lag("t").over(op.ordered("rec", "t"))).alias("since"))
    return op.median_split(gaps, "since", "rec", "short", "long").withColumn("since", F.round("since", 3))


@query("b23_early_late", f"""WITH {METRICS}, h AS (SELECT rec, quantile_cont(first_lick, 0.5) AS mid FROM met GROUP BY rec)
SELECT met.rec, trial, CASE WHEN first_lick <= mid THEN 'early' WHEN first_lick > mid THEN 'late' END AS side,
 CASE WHEN first_lick < 7200000 THEN 'early' WHEN first_lick > 9000000 THEN 'late' END AS by_limits FROM met JOIN h ON met.rec = h.rec -- FROM ev JOIN trial""")
def b23(spark, d):
    return op.median_split(metrics(spark, d), "first_lick", "rec", "early", "late").select(
        "rec", "trial", "side", F.when(F.col("first_lick") < 7.2e6, "early").when(F.col("first_lick") > 9e6, "late").alias("by_limits"))


@query("b24_stim_controls", """WITH f AS (SELECT *, value > 70 AS stim FROM trial)
SELECT rec, trial, CASE WHEN stim THEN 'stim' WHEN lag(stim, 2) OVER (PARTITION BY rec ORDER BY trial) THEN 'control' ELSE 'none' END AS label FROM f""")
def b24(spark, d):
    return op.controls(b.trials(spark, d), F.col("value") > 70, 2).select("rec", "trial", "label")


BINNED = f"""{IN_TRIAL}, g AS (SELECT rec, trial, (trial % 2)::INT AS grp, least(floor(rel / 1.08e7), 3)::BIGINT AS bin, avg(value) AS speed FROM l GROUP BY ALL)"""


def binned(spark, d):
    return licks_in_trials(spark, d).groupBy("rec", (F.col("trial") % 2).cast("int").alias("group"), "trial", F.least(
        F.floor(F.col("rel") / 1.08e7), F.lit(3)).alias("bin")).agg(F.avg("value").alias("speed"))


@query("b25_speed_matched", f"""WITH {BINNED}, s AS (SELECT rec, grp, bin, avg(speed) AS m, stddev_pop(speed) AS sd FROM g GROUP BY ALL)
SELECT g.rec, g.trial, bool_and(abs(speed - m) <= 1.5 * sd) AS kept FROM g JOIN s ON g.rec = s.rec AND g.bin = s.bin AND g.grp = 1 - s.grp GROUP BY ALL -- FROM lick JOIN trial""")
def b25(spark, d):
    return op.speed_matched(binned(spark, d), "rec", 1.5).select("rec", "trial", "kept")


def critical_t(level: float, most: int) -> str:
    """Rows (df, limit) of the t whose two-sided p is the level, for SQL that has no such function."""
    df = np.arange(1.0, most + 1)
    low, high = np.zeros(most), np.full(most, 1e4)
    for _ in range(200):
        mid = (low + high) / 2
        inside = pvalues.t_test(mid, df) > level
        low, high = np.where(inside, mid, low), np.where(inside, high, mid)
    return "(VALUES " + ", ".join(f"({int(d)}, {float(x)!r})" for d, x in zip(df, low)) + ") AS ct(df, t_limit)"


@query("b25_speed_gated", f"""WITH {BINNED}, s AS (SELECT rec, grp, bin, avg(speed) AS m, stddev_pop(speed) AS sd FROM g GROUP BY ALL),
tb AS (SELECT rec, bin, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1, avg(speed) FILTER (grp = 0) AS m0, avg(speed) FILTER (grp = 1) AS m1,
  var_samp(speed) FILTER (grp = 0) AS v0, var_samp(speed) FILTER (grp = 1) AS v1 FROM g GROUP BY 1, 2),
tt AS (SELECT rec, n0 + n1 - 2 AS df, (m0 - m1) / nullif(sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1)), 0) AS t FROM tb WHERE n0 > 1 AND n1 > 1),
sg AS (SELECT DISTINCT rec FROM tt JOIN {critical_t(0.05, 400)} ON ct.df = tt.df WHERE abs(t) > t_limit)
SELECT g.rec, g.trial, bool_and(abs(speed - m) <= 1.5 * sd OR g.rec NOT IN (SELECT rec FROM sg)) AS kept
FROM g JOIN s ON g.rec = s.rec AND g.bin = s.bin AND g.grp = 1 - s.grp GROUP BY ALL -- FROM lick JOIN trial""")
def b25_gated(spark, d):
    """Only recordings whose groups differ in speed in some bin are thinned out."""
    return op.speed_gated(binned(spark, d), "rec", 1.5).select("rec", "trial", "kept")


@query("b25_p_values")
def b25_p(spark, d):
    """The bins' p before and after matching."""
    rows = binned(spark, d)
    kept = op.speed_gated(rows, "rec", 1.5).where("kept").select("rec", "group", "trial")
    return op.speed_tests(rows, "rec").select("rec", "bin", "t", "df", F.col("p").alias("p_before")).join(
        op.speed_tests(rows.join(kept, ["rec", "group", "trial"], "left_semi"), "rec").select("rec", "bin", F.col("t").alias("t_after"), F.col("df").alias("df_after"), F.col("p").alias("p_after")),
        ["rec", "bin"], "left")


@query("b26_runs", """WITH n AS (SELECT roi, frame, value > 40000 AS hit, frame - row_number() OVER (PARTITION BY roi, value > 40000 ORDER BY frame) AS g FROM fr)
SELECT roi, min(frame) AS start, max(frame) AS "end", count(*) AS length FROM n WHERE hit GROUP BY roi, g""")
def b26(spark, d):
    return op.runs(b.traces(spark, d), F.col("value") > 40_000, ["roi"], "frame")


@query("b27_lick_profile", f"""WITH {IN_TRIAL}, c AS (SELECT rec, trial, floor(value / 10)::BIGINT AS bin, count(*) AS n FROM l GROUP BY ALL)
SELECT rec, trial, bin, round(n / max(n) OVER (PARTITION BY rec), 6) AS of_peak, round(n / sum(n) OVER (PARTITION BY rec, trial), 6) AS of_trial FROM c -- FROM lick JOIN trial""")
def b27(spark, d):
    n = F.col("n")
    return b9(spark, d).select("rec", "trial", "bin", rounded(n / F.max(n).over(Window.partitionBy("rec"))).alias("of_peak"),
                               rounded(n / F.sum(n).over(Window.partitionBy("rec", "trial"))).alias("of_trial"))


@query("b28_first_lick_spread", f"""WITH {METRICS} SELECT rec, round(quantile_cont(first_lick, 0.5), 6) AS mid,
 quantile_cont(first_lick, 0.75) - quantile_cont(first_lick, 0.25) AS iqr, round(stddev_pop(first_lick), 4) AS sd FROM met GROUP BY rec -- FROM ev JOIN trial""")
def b28(spark, d):
    return metrics(spark, d).groupBy("rec").agg(
        rounded(median("first_lick")).alias("mid"),
        (F.percentile("first_lick", 0.75) - F.percentile("first_lick", 0.25)).alias("iqr"), F.round(F.stddev_pop("first_lick"), 4).alias("sd"))


@query("b29_lick_rate", f"""WITH {IN_TRIAL}, n AS (SELECT rec, count(*) AS n FROM trial GROUP BY rec)
SELECT l.rec, floor(rel / {HOUR})::BIGINT AS bin, round(count(*) / any_value(n) / 3600, 9) AS rate FROM l JOIN n ON l.rec = n.rec GROUP BY 1, 2 -- FROM lick JOIN trial""")
def b29(spark, d):
    n = b.trials(spark, d).groupBy("rec").agg(F.count("*").alias("n"))
    return licks_in_trials(spark, d).groupBy("rec", F.floor(F.col("rel") / HOUR).alias("bin")).agg(F.count("*").alias("k")).join(n, "rec").select(
        "rec", "bin", F.round(F.col("k") / F.col("n") / 3600, 9).alias("rate"))


@query("b30_speed_profile", """WITH s AS (SELECT ev.rec, trial.trial, ev.value, row_number() OVER (PARTITION BY ev.rec, trial.trial ORDER BY ev.t) - 1 AS sample
  FROM ev ASOF JOIN trial ON ev.rec = trial.rec AND ev.t >= trial.t),
n AS (SELECT rec, count(DISTINCT trial) AS n, max(sample) AS last FROM s GROUP BY rec), g AS (SELECT rec, n, unnest(range(last + 1)) AS sample FROM n),
k AS (SELECT rec, sample, sum(value) AS s1, sum(value * value) AS s2 FROM s GROUP BY 1, 2)
SELECT g.rec, g.sample, round(s1 / n, 8) AS mean, round(sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)) / sqrt(n), 6) AS sem FROM g JOIN k ON g.rec = k.rec AND g.sample = k.sample""")
def b30(spark, d):
    """Trials are as long as their session's longest one: behind its end a trial has speed 0."""
    rows = timejoin.asof(b.events(spark, d).select("rec", "t", "value"), b.trials(spark, d).select("rec", "trial", "t"), ["rec"]).where(
        "at_trial is not null").withColumn("sample", F.row_number().over(Window.partitionBy("rec", "at_trial").orderBy("t")).cast("long") - 1)
    n = rows.where("sample = 0").groupBy("rec").agg(F.count("*").alias("n"))
    sums = rows.groupBy("rec", "sample").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2")).join(n, "rec")
    mean = F.col("s1") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("rec", "sample", F.round(mean, 8).alias("mean"), F.round(spread / F.sqrt("n"), 6).alias("sem"))


@query("b31_reward_rate", """WITH x AS (SELECT trial.rec, trial.trial, (SELECT count(*) FROM block WHERE block.rec = trial.rec AND block.t <= trial.t) AS block, value FROM trial)
SELECT rec, block, block % 2 = 0 AS passive, count(*) AS n, round(avg((value > 50)::INT), 6) AS reward_rate FROM x GROUP BY 1, 2 -- FROM block""")
def b31(spark, d):
    marks = b.blocks(spark, d)
    attributes = marks.select("rec", "block", (F.col("block") % 2 == 0).alias("passive"))
    zero = marks.select("rec", F.lit(0).cast("long").alias("block"), F.lit(True).alias("passive")).distinct()
    found = timejoin.asof(b.trials(spark, d), marks, ["rec"], prefix="b_").withColumn("block", F.coalesce("b_block", F.lit(0).cast("long")))
    return found.join(attributes.union(zero), ["rec", "block"], "left").groupBy("rec", "block", F.coalesce("passive", F.lit(True)).alias("passive")).agg(
        F.count("*").alias("n"), rounded(F.avg((F.col("value") > 50).cast("double"))).alias("reward_rate"))


@query("b32_clean_frames", """WITH x AS (SELECT rec, trial, (trial * 7) % 11 - 3 AS event_frame FROM trial),
p AS (SELECT *, min(CASE WHEN event_frame > 0 THEN trial END) OVER (PARTITION BY rec) AS first FROM x)
SELECT rec, trial, event_frame FROM p WHERE trial >= first AND event_frame <> -1 AND event_frame < 7""")
def b32(spark, d):
    rows = b.trials(spark, d).select("rec", "trial", ((F.col("trial") * 7) % 11 - 3).alias("event_frame"))
    first = F.min(F.when(F.col("event_frame") > 0, F.col("trial"))).over(Window.partitionBy("rec"))
    return rows.withColumn("first", first).where("trial >= first and event_frame <> -1 and event_frame < 7").drop("first")


@query("b33_after_ten", f"""WITH {METRICS}, n AS (SELECT rec, trial, row_number() OVER (PARTITION BY rec ORDER BY trial) AS k FROM met WHERE valid)
SELECT rec, trial FROM n WHERE k > 10 -- FROM ev JOIN trial""")
def b33(spark, d):
    return metrics(spark, d).where("valid").withColumn("k", b.numbered("rec", "trial")).where("k > 10").select("rec", "trial")
