"""Queries of the time joins and the logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracespark.functions.semantics import rounded
from tracespark.operators import logs, timejoin
from tracespark.plans import bindings as b
from tracespark.plans.bindings import query

NEAR = """before AS (SELECT a.*, g.t AS bt{p} FROM {a} a ASOF LEFT JOIN {g} g ON a.rec = g.rec AND a.t >= g.t),
 both_ AS (SELECT a.*, g.t AS nt{n} FROM before a ASOF LEFT JOIN {g} g ON a.rec = g.rec AND a.t <= g.t)"""


@query("j1_nearest_mapping", "WITH " + NEAR.format(a="reward", g="lick", p="", n="") + """
SELECT rec, t, CASE WHEN nt IS NULL OR t - bt <= nt - t THEN bt ELSE nt END AS at_t FROM both_""")
def j1(spark, d):
    near = timejoin.nearest(b.rewards(spark, d), b.licks(spark, d).select("rec", "t"), ["rec"])
    return near.select("rec", "t", "at_t")


@query("j2_event_frames", "WITH " + NEAR.format(a="trial", g="frame", p=", g.frame AS bf", n=", g.frame AS nf") + """
, span AS (SELECT rec, min(t) a, max(t) z FROM frame GROUP BY rec)
SELECT rec, trial, CASE WHEN t < a OR t > z OR a IS NULL THEN -1 WHEN nt IS NULL OR t - bt <= nt - t THEN bf ELSE nf END AS frame
FROM both_ LEFT JOIN span USING (rec)""")
def j2(spark, d):
    return timejoin.to_frame(b.trials(spark, d).select("rec", "t", "trial"), b.frames(spark, d), ["rec"]).select(
        "rec", "trial", "frame")


PULSES = """s AS (SELECT rec, t, row_number() OVER (PARTITION BY rec ORDER BY t) - 1 AS i FROM ev WHERE kind = 'error'),
e AS (SELECT rec, t, row_number() OVER (PARTITION BY rec ORDER BY t) - 1 AS k FROM ev WHERE kind = 'click'),
c AS (SELECT s.rec, s.t, s.i, (SELECT count(*) FROM e WHERE e.rec = s.rec AND e.t < s.t) AS n FROM s),
p AS (SELECT rec, t, i, max(n - i) OVER (PARTITION BY rec ORDER BY i) + i AS k FROM c),
pulse AS (SELECT p.rec, p.i AS pulse, p.t AS start, e.t AS "end" FROM p JOIN e ON p.rec = e.rec AND p.k = e.k)"""


def pulses(spark, d):
    return timejoin.paired_pulses(b.blocks(spark, d).select("rec", "t"), b.licks(spark, d).select("rec", "t"), ["rec"])


@query("j3_paired_pulses", f'WITH {PULSES} SELECT rec, pulse, start, "end" FROM pulse -- FROM ev')
def j3(spark, d):
    return pulses(spark, d).select("rec", "pulse", "start", "end")


TRAINS = PULSES + """,
before AS (SELECT a.*, g.t AS bt, g.trial AS bf FROM pulse a ASOF LEFT JOIN trial g ON a.rec = g.rec AND a.start >= g.t),
near AS (SELECT a.*, g.t AS nt, g.trial AS nf FROM before a ASOF LEFT JOIN trial g ON a.rec = g.rec AND a.start <= g.t),
train AS (SELECT rec, pulse, start, "end", CASE WHEN nt IS NULL OR start - bt <= nt - start THEN bf ELSE nf END AS trial,
  CASE WHEN nt IS NULL OR start - bt <= nt - start THEN bt ELSE nt END AS onset FROM near)"""


def trains(spark, d):
    near = timejoin.nearest(pulses(spark, d).withColumnRenamed("start", "t"), b.trials(spark, d).select("rec", "t", "trial"), ["rec"])
    return near.select("rec", "pulse", F.col("t").alias("start"), "end", F.col("at_trial").alias("trial"), F.col("at_t").alias("onset"))


@query("j4_pulse_trials", f"WITH {TRAINS} SELECT rec, pulse, trial FROM train -- FROM ev JOIN trial")
def j4(spark, d):
    return trains(spark, d).select("rec", "pulse", "trial")


MENDED = TRAINS + """,
r AS (SELECT *, lead(start) OVER (PARTITION BY rec, trial ORDER BY start) IS NULL AS last FROM train),
m AS (SELECT rec, trial, avg("end" - start) AS d FROM r WHERE NOT last GROUP BY 1, 2),
g AS (SELECT rec, avg("end" - start) AS d FROM r WHERE NOT last GROUP BY 1),
mended AS (SELECT r.rec, r.trial, pulse, onset, start, CASE WHEN last THEN coalesce(start + coalesce(m.d, g.d), "end") ELSE "end" END AS "end"
  FROM r LEFT JOIN m ON r.rec = m.rec AND r.trial = m.trial LEFT JOIN g ON r.rec = g.rec)"""


def mended(spark, d):
    """The last pulse of a train ends after the mean of the train's (else of all) earlier durations."""
    train = Window.partitionBy("rec", "trial")
    last = F.lead("start").over(train.orderBy("start")).isNull()
    length = F.when(~F.col("_last"), F.col("end") - F.col("start"))
    fixed = F.coalesce(F.avg(length).over(train), F.avg(length).over(Window.partitionBy("rec")))
    return trains(spark, d).withColumn("_last", last).withColumn(
        "_mean", fixed).withColumn("end", F.when(F.col("_last"), F.coalesce(F.col("start") + F.col("_mean"), "end")).otherwise(
            F.col("end"))).drop("_last", "_mean")


@query("j5_train_ends", f'WITH {MENDED} SELECT rec, trial, pulse, start, round("end" - start, 2) AS length FROM mended -- FROM ev JOIN trial')
def j5(spark, d):
    return mended(spark, d).select("rec", "trial", "pulse", "start", F.round(F.col("end") - F.col("start"), 2).alias("length"))


COVERED = MENDED + """,
n AS (SELECT rec, count(*) AS n FROM frame GROUP BY rec),
c1 AS (SELECT a.*, coalesce(f.frame, 0) AS i FROM mended a ASOF LEFT JOIN frame f ON a.rec = f.rec AND a.start >= f.t),
c2 AS (SELECT a.*, coalesce(f.frame, 0) AS j FROM c1 a ASOF LEFT JOIN frame f ON a.rec = f.rec AND a."end" >= f.t),
covered AS (SELECT DISTINCT c2.rec, trial, unnest(range(i, least(n, j + 1))) AS frame FROM c2 JOIN n ON c2.rec = n.rec)"""


def covered(spark, d):
    """Distinct frames that a pulse touches: frame i spans [t_i, t_i+1)."""
    f = b.frames(spark, d)
    one = timejoin.asof(mended(spark, d).withColumnRenamed("start", "t"), f, ["rec"], "t", "a_")
    two = timejoin.asof(one.select("rec", "trial", F.col("end").alias("t"), F.coalesce("a_frame", F.lit(0)).alias("i")), f, ["rec"], "t", "z_")
    n = f.groupBy("rec").agg(F.max("frame").alias("n"))
    return two.withColumn("j", F.coalesce("z_frame", F.lit(0))).join(n, "rec").where("i <= least(j, n)").select(
        "rec", "trial", F.explode(F.sequence("i", F.least("j", "n"))).alias("frame")).distinct()


@query("j6_pulse_frames", f"WITH {COVERED} SELECT DISTINCT rec, frame FROM covered -- FROM ev JOIN trial JOIN frame")
def j6(spark, d):
    return covered(spark, d).select("rec", "frame").distinct()


@query("j7_train_frames", f"""WITH {COVERED}
SELECT rec, trial, unnest(range(min(frame), max(frame) + 1)) AS frame FROM covered GROUP BY rec, trial -- FROM ev JOIN trial JOIN frame""")
def j7(spark, d):
    return covered(spark, d).groupBy("rec", "trial").agg(F.min("frame").alias("a"), F.max("frame").alias("z")).select(
        "rec", "trial", F.explode(F.sequence("a", "z")).alias("frame"))


LATE = 3_600_000.0


@query("j8_pulse_delays", f"""WITH {TRAINS},
f AS (SELECT rec, trial, min(start) AS start FROM train GROUP BY 1, 2),
d AS (SELECT trial.rec, trial.trial, f.start - trial.t AS delay FROM trial LEFT JOIN f ON trial.rec = f.rec AND trial.trial = f.trial),
w AS (SELECT *, lag(delay) OVER (PARTITION BY rec ORDER BY trial) AS p, lead(delay) OVER (PARTITION BY rec ORDER BY trial) AS n FROM d)
SELECT rec, trial, round(delay, 3) AS delay,
  NOT (coalesce(abs(delay) > {LATE}, false) OR coalesce(p > {LATE}, false) OR coalesce(n < -{LATE}, false)) AS valid FROM w -- FROM ev""")
def j8(spark, d):
    first = trains(spark, d).groupBy("rec", "trial").agg(F.min("start").alias("start"))
    w = Window.partitionBy("rec").orderBy("trial")
    delays = b.trials(spark, d).select("rec", "trial", "t").join(first, ["rec", "trial"], "left").withColumn("delay", F.col("start") - F.col("t"))
    bad = (F.coalesce(F.abs("delay") > LATE, F.lit(False)) | F.coalesce(F.lag("delay").over(w) > LATE, F.lit(False))
           | F.coalesce(F.lead("delay").over(w) < -LATE, F.lit(False)))
    return delays.select("rec", "trial", F.round("delay", 3).alias("delay"), (~bad).alias("valid"))


SPANS = """bl AS (SELECT rec, block, t AS start, coalesce(lead(t) OVER (PARTITION BY rec ORDER BY t),
  (SELECT max(t) FROM frame f WHERE f.rec = block.rec)) AS "end" FROM block)"""


def block_spans(spark, d):
    """Blocks without an end last to the next block, or else to the last frame."""
    last = b.frames(spark, d).groupBy("rec").agg(F.max("t").alias("last"))
    return b.blocks(spark, d).join(last, "rec", "left").select(
        "rec", "block", F.col("t").alias("start"),
        F.coalesce(F.lead("t").over(Window.partitionBy("rec").orderBy("t")), "last").alias("end"))


@query("j10_block_ends", f'WITH {SPANS} SELECT rec, block, start, "end" FROM bl -- FROM block JOIN frame')
def j10(spark, d):
    return block_spans(spark, d)


@query("j9_licks_in_blocks", f"""WITH {SPANS}
SELECT lick.rec, lick.t, max(bl.block) AS block FROM lick JOIN bl ON lick.rec = bl.rec AND lick.t >= bl.start AND lick.t <= bl."end"
GROUP BY 1, 2 -- FROM block JOIN frame""")
def j9(spark, d):
    inside = timejoin.within(b.licks(spark, d).select("rec", "t"), block_spans(spark, d).where("start <= end"), ["rec"], 86_400_000.0)
    return inside.groupBy("rec", "t").agg(F.max("block").alias("block"))


@query("j11_command_in_force", f"""WITH {SPANS},
c AS (SELECT rec, t, value, (SELECT count(*) FROM block b WHERE b.rec = reward.rec AND b.t <= reward.t) AS block FROM reward),
k AS (SELECT rec, t, (SELECT count(*) FROM block b WHERE b.rec = lick.rec AND b.t <= lick.t) AS block FROM lick)
SELECT k.rec, k.block, k.t, c.value AS command FROM k ASOF LEFT JOIN c ON k.rec = c.rec AND k.block = c.block AND k.t >= c.t -- FROM frame""")
def j11(spark, d):
    marks = b.blocks(spark, d)
    blocked = lambda df: timejoin.asof(df, marks, ["rec"], "t", "b_").withColumn("block", F.coalesce("b_block", F.lit(0).cast("long"))).drop("b_block", "b_t")
    found = timejoin.asof(blocked(b.licks(spark, d).select("rec", "t")), blocked(b.rewards(spark, d)), ["rec", "block"], "t", "c_")
    return found.select("rec", "block", "t", F.col("c_value").alias("command"))


@query("j12_laps_to_trials", "WITH " + NEAR.format(a="reward", g="trial", p=", g.trial AS bf", n=", g.trial AS nf") + """
SELECT rec, t, coalesce(CASE WHEN nt IS NULL OR t - bt <= nt - t THEN bf ELSE nf END, -1) AS trial FROM both_""")
def j12(spark, d):
    near = timejoin.nearest(b.rewards(spark, d).select("rec", "t"), b.trials(spark, d).select("rec", "t", "trial"), ["rec"])
    return near.select("rec", "t", F.coalesce("at_trial", F.lit(-1).cast("long")).alias("trial"))


@query("j13_licks_per_frame", """WITH a AS (SELECT l.rec, f.frame FROM lick l ASOF JOIN frame f ON l.rec = f.rec AND l.t >= f.t)
SELECT frame.rec, frame.frame, count(a.rec) AS n_licks FROM frame LEFT JOIN a ON frame.rec = a.rec AND frame.frame = a.frame GROUP BY 1, 2""")
def j13(spark, d):
    f = b.frames(spark, d)
    counts = timejoin.asof(b.licks(spark, d).select("rec", "t"), f, ["rec"]).groupBy("rec", F.col("at_frame").alias("frame")).agg(
        F.count("*").alias("n"))
    return f.join(counts, ["rec", "frame"], "left").select("rec", "frame", F.coalesce("n", F.lit(0)).alias("n_licks"))


PRE, POST = 20, 40
ALIGNED = f"""ends AS (SELECT roi, max(frame) AS z FROM fr GROUP BY roi),
e AS (SELECT fr.roi, frame AS event_frame FROM fr JOIN ends USING (roi) WHERE frame % 60 = 30 AND frame >= {PRE} AND frame + {POST} - 1 <= z),
aligned AS (SELECT e.roi, e.event_frame, fr.frame - e.event_frame AS rel, value, second FROM e JOIN fr ON e.roi = fr.roi
  AND fr.frame >= e.event_frame - {PRE} AND fr.frame < e.event_frame + {POST})"""


def trace_events(trace):
    return trace.where("frame % 60 = 30").select("roi", F.col("frame").alias("event_frame"))


def aligned(spark, d):
    trace = b.traces(spark, d)
    return timejoin.around_events(trace, trace_events(trace), ["roi"], PRE, POST).select("roi", "event_frame", "rel", "value", "second")


@query("j14_peri_event", f"WITH {ALIGNED} SELECT roi, event_frame, rel::bigint AS rel, value FROM aligned -- FROM fr")
def j14(spark, d):
    return aligned(spark, d).select("roi", "event_frame", F.col("rel").cast("long").alias("rel"), "value")


@query("j15_stimulus_blanked", f"""WITH {ALIGNED},
hit AS (SELECT DISTINCT roi, rel FROM aligned WHERE (event_frame + rel) % 97 = 0)
SELECT roi, event_frame, rel::bigint AS rel, value FROM aligned a WHERE NOT EXISTS
  (SELECT 1 FROM hit WHERE hit.roi = a.roi AND hit.rel = a.rel) -- FROM fr""")
def j15(spark, d):
    rows = aligned(spark, d)
    hit = rows.where("(event_frame + rel) % 97 = 0").select("roi", "rel").distinct()
    return rows.join(hit, ["roi", "rel"], "left_anti").select("roi", "event_frame", F.col("rel").cast("long").alias("rel"), "value")


@query("j16_slow_before_reward", """WITH w AS (SELECT rec, trial, t AS start, lead(t) OVER (PARTITION BY rec ORDER BY t) AS stop FROM trial)
SELECT w.rec, trial, coalesce(bool_or(ev.value < 10), false) AS stopped, count(*) FILTER (ev.value < 10) AS n_slow
FROM w LEFT JOIN ev ON ev.rec = w.rec AND ev.t >= w.start AND ev.t < w.stop WHERE stop IS NOT NULL GROUP BY 1, 2""")
def j16(spark, d):
    own = b.trials(spark, d).select("rec", "trial", "t")
    inside = timejoin.asof(b.events(spark, d).select("rec", "t", "value"), own, ["rec"]).where("at_trial is not null")
    ends = own.groupBy("rec").agg(F.max("trial").alias("final"))
    return inside.join(ends, "rec").where("at_trial < final").groupBy("rec", F.col("at_trial").alias("trial")).agg(
        F.coalesce(F.bool_or(F.col("value") < 10), F.lit(False)).alias("stopped"), F.count_if(F.col("value") < 10).alias("n_slow"))


@query("j17_same_cell", """WITH a AS (SELECT roi, avg(value) AS m FROM fr WHERE frame < 250 GROUP BY roi),
z AS (SELECT roi, avg(value) AS m FROM fr WHERE frame >= 250 AND roi % 3 <> 0 GROUP BY roi)
SELECT roi, round(a.m, 6) AS mean_first, round(z.m, 6) AS mean_second FROM a JOIN z USING (roi)""")
def j17(spark, d):
    trace = b.traces(spark, d)
    half = lambda rows, name: rows.groupBy("roi").agg(rounded(F.avg("value")).alias(name))
    return half(trace.where("frame < 250"), "mean_first").join(half(trace.where("frame >= 250 and roi % 3 <> 0"), "mean_second"), "roi")


@query("j19_session_metadata", """SELECT fr.roi, unit.rec, unit.anm, count(*) AS n_frames FROM fr JOIN unit USING (roi) GROUP BY ALL""")
def j19(spark, d):
    return b.traces(spark, d).groupBy("roi").agg(F.count("*").alias("n_frames")).join(b.units(spark, d), "roi")


@query("j20_neuropil", "SELECT roi, frame, round(value - 0.7 * second, 6) AS corrected FROM fr")
def j20(spark, d):
    trace = b.traces(spark, d)
    own, around = trace.select("roi", "frame", "value"), trace.select("roi", "frame", "second")
    return own.join(around, ["roi", "frame"]).select("roi", "frame", rounded(F.col("value") - 0.7 * F.col("second")).alias("corrected"))


PERIOD = 4294967.0
LINES = """SELECT rec, line_no, concat_ws(',', CASE kind WHEN 'purchase' THEN '$NT' WHEN 'signup' THEN '$TR' WHEN 'click' THEN '$LE'
  WHEN 'view' THEN '$FM' ELSE '$WE' END, CASE WHEN line_no % 17 = 5 THEN 'x' ELSE CAST(line_no * 400 AS VARCHAR) END,
  CAST(line_no % 3 AS VARCHAR)) AS raw FROM ev"""


def lines(spark, d):
    tag = F.when(F.col("kind") == "purchase", "$NT").when(F.col("kind") == "signup", "$TR").when(
        F.col("kind") == "click", "$LE").when(F.col("kind") == "view", "$FM").otherwise("$WE")
    time = F.when(F.col("line_no") % 17 == 5, "x").otherwise((F.col("line_no") * 400).cast("string"))
    return b.events(spark, d).select("rec", "line_no", F.concat_ws(",", tag, time, (F.col("line_no") % 3).cast("string")).alias("raw"))


@query("l1_typed_events", f"""WITH l AS ({LINES}), p AS (SELECT rec, line_no, split_part(raw, ',', 1) AS tag,
  try_cast(split_part(raw, ',', 2) AS DOUBLE) AS t_ms, split_part(raw, ',', 3) AS f FROM l)
SELECT rec, line_no, tag, t_ms, CASE WHEN tag = '$WE' THEN f::DOUBLE * 2.0 END AS speed FROM p
WHERE tag = '$WE' OR tag = '$LE' AND f = '1' OR tag = '$FM' AND f = '0'""")
def l1(spark, d):
    log = logs.parsed(lines(spark, d))
    out = [logs.typed(log, tag) for tag in ("$LE", "$FM", "$WE")]
    kept = [x.select("rec", "line_no", "tag", "t_ms", (F.col("speed") if "speed" in x.columns else F.lit(None).cast("double")).alias("speed"))
            for x in out]
    return kept[0].union(kept[1]).union(kept[2])


@query("l2_lines_to_trials", f"""WITH l AS ({LINES}), p AS (SELECT rec, line_no, split_part(raw, ',', 1) AS tag FROM l),
w AS (SELECT *, coalesce(sum((tag = '$NT')::INT) OVER (PARTITION BY rec ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS trial,
  bool_or(tag = '$TR') OVER (PARTITION BY rec ORDER BY line_no) AS begun FROM p)
SELECT rec, line_no, trial::BIGINT AS trial FROM w WHERE begun""")
def l2(spark, d):
    return logs.with_trials(logs.parsed(lines(spark, d))).select("rec", "line_no", "trial")


@query("l3_unwrapped", f"""WITH r AS (SELECT rec, line_no, ((line_no + 1) * 400000) % {int(PERIOD)} AS raw FROM ev),
f AS (SELECT *, coalesce((lag(raw) OVER (PARTITION BY rec ORDER BY line_no) - raw > {PERIOD} / 2)::INT, 0) AS fell FROM r)
SELECT rec, line_no, raw + sum(fell) OVER (PARTITION BY rec ORDER BY line_no) * {PERIOD} AS t FROM f""")
def l3(spark, d):
    raw = b.events(spark, d).select("rec", "line_no", (((F.col("line_no") + 1) * 400000) % int(PERIOD)).cast("double").alias("t"))
    return logs.unwrapped(raw, PERIOD, "t")


@query("l4_malformed_lines", f"""WITH l AS ({LINES})
SELECT rec, line_no, raw FROM l WHERE try_cast(split_part(raw, ',', 2) AS DOUBLE) IS NULL""")
def l4(spark, d):
    rows = lines(spark, d)
    return rows.where(logs.malformed(rows))


@query("l5_trial_blocks", """SELECT trial.rec, trial.trial, greatest(1, (SELECT count(*) FROM block WHERE block.rec = trial.rec AND block.t <= trial.t)) AS block
FROM trial -- FROM block""")
def l5(spark, d):
    return logs.block_of(b.trials(spark, d).select("rec", "trial", "t"), b.blocks(spark, d)).select("rec", "trial", "block")


@query("l6_filled_frames", f"""WITH g AS (SELECT rec, t, lead(t) OVER (PARTITION BY rec ORDER BY t) AS z FROM frame),
n AS (SELECT *, CASE WHEN z - t > 3.6e6 THEN ceil(log2((z - t) / 3.6e6))::INT ELSE 0 END AS n FROM g WHERE z IS NOT NULL)
SELECT rec, t, false AS inserted FROM frame UNION ALL
SELECT rec, z - (z - t) / pow(2, i) AS t, true AS inserted FROM n, unnest(range(1, n + 1)) AS u(i)""")
def l6(spark, d):
    return logs.filled_frames(b.frames(spark, d), gap=3.6e6)


@query("l7_treatments", """SELECT session, CASE WHEN label LIKE '1%' THEN 'control' ELSE lower(label) END AS label FROM session""")
def l7(spark, d):
    days = b.sessions(spark, d).groupBy("anm").agg(F.collect_list(F.struct("session", F.regexp_replace("label", "^1.*", "ctrl").alias("label"))).alias("x"))
    return logs.treatments(days.select(F.transform("x", lambda x: x["session"]).alias("session"), F.transform("x", lambda x: x["label"]).alias("label")))


@query("l8_families", """SELECT c_nationkey AS session, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS families
FROM customer GROUP BY 1""")
def l8(spark, d):
    lists = b.table(spark, d, "customer").select(F.col("c_nationkey").alias("session"), F.col("c_mktsegment").alias("family"))
    return logs.families(lists).withColumn("families", F.array_join("families", "|"))


@query("l9_session_filter", """SELECT rec, count(*) AS n, round(avg(value), 6) AS mean_value FROM ev GROUP BY rec
HAVING count(*) >= 60 AND avg(value) BETWEEN 40 AND 60 AND count(*) FILTER (kind = 'purchase') >= 10""")
def l9(spark, d):
    stats = b.events(spark, d).groupBy("rec").agg(
        F.count("*").alias("n"), F.avg("value").alias("m"), F.count_if(F.col("kind") == "purchase").alias("p"))
    return stats.where("n >= 60 and m between 40 and 60 and p >= 10").select("rec", "n", rounded(F.col("m")).alias("mean_value"))


@query("l10_drug_lists", """WITH d AS (SELECT anm, date, bool_or(label LIKE '%URGENT%') AS drug, min(dose) AS least FROM session GROUP BY 1, 2),
k AS (SELECT * FROM d WHERE drug AND least >= 50000)
SELECT anm, date, 'drug' AS arm FROM k UNION ALL
SELECT anm, date, 'control' AS arm FROM d WHERE NOT drug AND anm IN (SELECT anm FROM k)""")
def l10(spark, d):
    days = b.sessions(spark, d).groupBy("anm", "date").agg(F.collect_list("label").alias("label"), F.collect_list("dose").alias("conc"))
    drug = logs.with_doses(days, "URGENT", 50_000)
    rest = days.where(~F.exists("label", lambda x: x.contains("URGENT"))).join(drug.select("anm").distinct(), "anm", "left_semi")
    return drug.select("anm", "date", F.lit("drug").alias("arm")).union(rest.select("anm", "date", F.lit("control").alias("arm")))


@query("l11_first_events", """WITH w AS (SELECT rec, trial, t AS start, lead(t) OVER (PARTITION BY rec ORDER BY t) AS stop FROM trial)
SELECT w.rec, trial, min(e.t) FILTER (kind = 'signup') AS first_reward, min(e.t) FILTER (kind = 'click') AS first_lick,
  min(e.t) FILTER (kind = 'view' AND e.value < 20) AS first_cue
FROM w LEFT JOIN ev e ON e.rec = w.rec AND e.t >= w.start AND (w.stop IS NULL OR e.t < w.stop) GROUP BY 1, 2""")
def l11(spark, d):
    own = b.trials(spark, d).select("rec", "trial", "t")
    rows = timejoin.asof(b.events(spark, d).select("rec", "t", "kind", "value"), own, ["rec"]).where("at_trial is not null")
    first = lambda c: F.min(F.when(c, F.col("t")))
    return rows.groupBy("rec", F.col("at_trial").alias("trial")).agg(
        first(F.col("kind") == "signup").alias("first_reward"), first(F.col("kind") == "click").alias("first_lick"),
        first((F.col("kind") == "view") & (F.col("value") < 20)).alias("first_cue"))
