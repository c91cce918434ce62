"""Queries of the trace, response and regression operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracespark.functions.semantics import exact, exact_sql, median, ratio, rounded
from tracespark.operators import nulls, regression, response, timejoin
from tracespark.operators import packed as packing
from tracespark.operators import traces as op
from tracespark.operators.behaviour import runs
from tracespark.plans import bindings as b
from tracespark.plans.bindings import query
from tracespark.plans.timejoins import ALIGNED, POST, PRE, aligned

UNIT = ["roi"]
PIXELS = "px AS (SELECT roi % 8 AS rec, frame, part % 64 AS y, roi % 64 AS x, value FROM fr)"


def pixels(spark, d):
    return b.traces(spark, d).select((F.col("roi") % 8).alias("rec"), "frame", (F.col("part") % 64).alias("y"), (F.col("roi") % 64).alias("x"), "value")


@query("t2_surround", f"""WITH {PIXELS}, mv AS (SELECT rec, frame // 50 AS frame, y, x, avg(value) AS value FROM px GROUP BY ALL),
lim AS (SELECT rec, avg(value) AS m FROM mv GROUP BY rec), ex AS (SELECT mv.rec, y, x FROM mv JOIN lim USING (rec) GROUP BY mv.rec, y, x HAVING avg(value) >= any_value(m)),
own AS (SELECT DISTINCT roi % 8 AS rec, roi // 16 AS roi, part % 64 AS y, roi % 64 AS x FROM fr WHERE part % 7 = roi % 7),
ring AS (SELECT DISTINCT rec, roi, y + dy AS y, x + dx AS x FROM own, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS u(dy, dx)),
reg AS (SELECT rec, roi, y, x, 1 AS inner_ FROM own UNION ALL SELECT rec, roi, y, x, 0 FROM ring ANTI JOIN own USING (rec, roi, y, x)),
hit AS (SELECT reg.*, frame, value FROM reg SEMI JOIN ex USING (rec, y, x) JOIN mv USING (rec, y, x))
SELECT rec, roi, frame, count(*) FILTER (inner_ = 1) AS n_signal, count(*) FILTER (inner_ = 0) AS n_surround,
 round(avg(value) FILTER (inner_ = 1), 4) AS signal, round(avg(value) FILTER (inner_ = 0), 4) AS surround FROM hit GROUP BY 1, 2, 3 -- FROM fr""")
def t2(spark, d):
    """Signal of each region and of the shell that its dilation adds, both inside the
    expression mask: the pixels whose mean is at least their recording's."""
    movie = pixels(spark, d).groupBy("rec", F.floor(F.col("frame") / 50).alias("frame"), "y", "x").agg(F.avg("value").alias("value"))
    mean = movie.groupBy("rec").agg(F.avg("value").alias("m"))
    expressed = movie.groupBy("rec", "y", "x").agg(F.avg("value").alias("p")).join(mean, "rec").where("p >= m").select("rec", "y", "x")
    own = b.traces(spark, d).where("part % 7 = roi % 7").select(
        (F.col("roi") % 8).alias("rec"), F.floor(F.col("roi") / 16).alias("roi"), (F.col("part") % 64).alias("y"), (F.col("roi") % 64).alias("x")).distinct()
    return op.signal_and_surround(movie, own, expressed, ["rec"]).select(
        "rec", "roi", "frame", "n_signal", "n_surround", F.round("signal", 4).alias("signal"), F.round("surround", 4).alias("surround"))


@query("t3_block_traces", f"""WITH {PIXELS} SELECT rec, frame // 50 AS frame, (y // 16)::INT AS gy, (x // 16)::INT AS gx, count(*) AS n_pixels,
CASE WHEN count(*) >= 10 THEN {exact_sql("avg(value)", "100 * count(*)")} END AS mean FROM px GROUP BY ALL -- FROM fr""")
def t3(spark, d):
    rows = pixels(spark, d).withColumn("frame", F.floor(F.col("frame") / 50))
    return op.block_traces(rows).withColumn("mean", exact(F.col("mean"), 100 * F.col("n_pixels")))


@query("t4_field_trace", f"""WITH {PIXELS} SELECT rec, frame, round(avg(value) FILTER (y BETWEEN 16 AND 47 AND x BETWEEN 16 AND 47), 6) AS inner_mean, round(avg(value), 6) AS whole_mean
FROM px GROUP BY 1, 2 -- FROM fr""")
def t4(spark, d):
    return op.field_traces(pixels(spark, d), 64, 64).select("rec", "frame", rounded(F.col("inner_mean")).alias("inner_mean"), rounded(F.col("whole_mean")).alias("whole_mean"))


@query("t5_frame_cutoff", """WITH l AS (SELECT roi, quantile_cont(value, 0.25) AS lim FROM fr GROUP BY roi),
g AS (SELECT fr.roi, value, lead(value) OVER (PARTITION BY fr.roi ORDER BY value) AS nxt FROM fr),
k AS (SELECT g.roi, value, nxt, nxt - value AS gap, row_number() OVER (PARTITION BY g.roi ORDER BY nxt - value DESC, value) AS r
  FROM g JOIN l ON g.roi = l.roi WHERE value <= lim AND nxt IS NOT NULL)
SELECT roi, round(gap, 6) AS gap, round((value + nxt) / 2, 6) AS threshold FROM k WHERE r = 1 -- FROM fr""")
def t5(spark, d):
    return op.frame_cutoff(b.traces(spark, d), "roi", "value").select("roi", rounded(F.col("gap")).alias("gap"), rounded(F.col("threshold")).alias("threshold"))


@query("t6_widened_mask", """SELECT roi, frame, max((value < 3000)::INT) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) = 1 AS wide FROM fr""")
def t6(spark, d):
    return op.widened(b.traces(spark, d), F.col("value") < 3000, 2, 3, UNIT).select("roi", "frame", "wide")


@query("t10_forward_min", """WITH n AS (SELECT roi, frame, value, count(*) OVER (PARTITION BY roi) AS n FROM fr),
p AS (SELECT roi, frame AS k, frame, value, 0 AS o FROM n UNION ALL SELECT roi, frame + 5 AS k, frame, value, 1 AS o FROM n WHERE frame >= n - 5),
w AS (SELECT roi, frame, o, min(value) OVER (PARTITION BY roi ORDER BY k, o ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS lo,
  max(value) OVER (PARTITION BY roi ORDER BY k, o ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS hi FROM p)
SELECT roi, frame, lo, hi FROM w WHERE o = 0 -- FROM fr""")
def t10(spark, d):
    rows = b.traces(spark, d).select("roi", "frame", "value")
    return op.forward_extremes(rows, 9, UNIT).select("roi", "frame", "lo", "hi")


@query("t11_outliers", """WITH s AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM fr WINDOW w AS (PARTITION BY roi))
SELECT roi, frame, CASE WHEN value BETWEEN m - 1.5 * sd AND m + 1.5 * sd THEN value END AS value FROM s""")
def t11(spark, d):
    return op.outliers_missing(b.traces(spark, d), 1.5, UNIT).select("roi", "frame", "value")


@query("t12_session_limit", """WITH l AS (SELECT u.rec, avg(value) + 0.5 * stddev_pop(value) AS lim FROM fr JOIN unit u USING (roi) WHERE abs(value) < 80000 GROUP BY 1)
SELECT fr.roi, frame, CASE WHEN abs(value) <= lim THEN value END AS value FROM fr JOIN unit u USING (roi) JOIN l ON l.rec = u.rec""")
def t12(spark, d):
    rows = b.traces(spark, d).join(b.units(spark, d), "roi")
    return op.session_limit(rows, 80_000, 0.5).select("roi", "frame", "value")


SPREAD = """m AS (SELECT roi, quantile_cont(value, 0.5) AS mid FROM fr GROUP BY roi),
sp AS (SELECT fr.roi, any_value(mid) AS mid, quantile_cont(abs(value - mid), 0.5) AS mad FROM fr JOIN m USING (roi) GROUP BY fr.roi)"""


@query("t15_robust_z", f"WITH {SPREAD} SELECT roi, frame, round((value - mid) / nullif(mad / 0.67449, 0), 6) AS z FROM fr JOIN sp USING (roi)")
def t15(spark, d):
    rows = b.traces(spark, d)
    return rows.join(op.robust_spread(rows, UNIT), UNIT).select(
        "roi", "frame", rounded(ratio(F.col("value") - F.col("mid"), F.col("mad") / 0.67449)).alias("z"))


@query("t16_min_max", """WITH q AS (SELECT roi, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS z FROM fr GROUP BY roi)
SELECT roi, frame, round((value - a) / nullif(z - a, 0), 6) AS scaled FROM fr JOIN q USING (roi)""")
def t16(spark, d):
    return op.min_max(b.traces(spark, d), UNIT, low=0.05, high=0.95).select("roi", "frame", rounded(F.col("scaled")).alias("scaled"))


@query("t17_clipped_z", """SELECT roi, frame, round((least(greatest((value - avg(value) OVER w) / stddev_pop(value) OVER w, -4), 8) + 4) / 12, 6) AS scaled
FROM fr WINDOW w AS (PARTITION BY roi)""")
def t17(spark, d):
    return op.clipped_z(b.traces(spark, d), UNIT).select("roi", "frame", rounded(F.col("scaled")).alias("scaled"))


@query("t18_filled", """WITH g AS (SELECT roi, frame, CASE WHEN frame % 7 IN (2, 3, 4) THEN NULL ELSE value END AS v FROM fr),
p AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN frame END) OVER (PARTITION BY roi ORDER BY frame) AS a,
 min(CASE WHEN v IS NOT NULL THEN frame END) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM g)
SELECT p.roi, p.frame, round(CASE WHEN p.a IS NULL THEN z.v WHEN p.z IS NULL OR p.a = p.z THEN a.v ELSE a.v + (z.v - a.v) * (p.frame - p.a) / (p.z - p.a) END, 6) AS value
FROM p LEFT JOIN g a ON a.roi = p.roi AND a.frame = p.a LEFT JOIN g z ON z.roi = p.roi AND z.frame = p.z -- FROM fr""")
def t18(spark, d):
    gappy = b.traces(spark, d).withColumn("value", F.when(~(F.col("frame") % 7).isin(2, 3, 4), F.col("value")))
    return op.filled(gappy, UNIT).select("roi", "frame", rounded(F.col("value")).alias("value"))


@query("t19_pooled_z", f"""WITH {ALIGNED}, s AS (SELECT roi, avg(value) AS m, stddev_samp(value) AS sd FROM aligned WHERE rel < 0 GROUP BY roi)
SELECT fr.roi, fr.frame, round((fr.value - m) / sd, 6) AS z FROM fr JOIN s ON fr.roi = s.roi""")
def t19(spark, d):
    return op.pooled_z(b.traces(spark, d), aligned(spark, d), UNIT).select("roi", "frame", rounded(F.col("z")).alias("z"))


@query("t20_profiles", f"""WITH {ALIGNED} SELECT roi, rel::BIGINT AS rel, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem, count(value) AS n
FROM aligned GROUP BY 1, 2 -- FROM fr""")
def t20(spark, d):
    return op.profile(aligned(spark, d), UNIT).select("roi", F.col("rel").cast("long").alias("rel"), rounded(F.col("mean")).alias("mean"), rounded(F.col("sem")).alias("sem"), "n")


RESPONSE = ALIGNED + f""",
st AS (SELECT roi, count(DISTINCT event_frame) AS n_kept, avg(value) FILTER (rel < 0) AS bm, avg(value) FILTER (rel >= 0) AS rm,
  stddev_samp(value) FILTER (rel < 0) AS bs, stddev_samp(value) FILTER (rel >= 0) AS rs FROM aligned GROUP BY roi),
resp AS (SELECT roi, n_kept, bm, rm, rm - bm AS amp, rm / nullif(bm, 0) AS ratio,
  (rm - bm) / sqrt((({PRE} - 1) * bs * bs + ({POST} - 1) * rs * rs) / ({PRE} + {POST} - 2)) AS effect FROM st)"""


def responses(spark, d, step=None):
    return response.event_response(aligned(spark, d), UNIT, PRE, POST, step=step)


@query("t21_event_response", f"""WITH {RESPONSE} SELECT roi, n_kept, round(bm, 6) AS baseline_mean, round(rm, 6) AS response_mean, round(amp, 6) AS response_amplitude,
round(ratio, 6) AS response_ratio, round(effect, 6) AS effect_size FROM resp -- FROM fr""")
def t21(spark, d):
    names = ["baseline_mean", "response_mean", "response_amplitude", "response_ratio", "effect_size"]
    return responses(spark, d).select("roi", "n_kept", *[rounded(F.col(c)).alias(c) for c in names])


DRAWS = 1000
LENGTH = PRE + POST
MIXED = "((draw * 7919 + event_frame * 104729 + draw * event_frame * 1299709 + 1) % 2147483647)"
#: Null responses of windows w(roi, event_frame, v, m samples, nb of them before the event).
SHIFTED = f"""pre AS (SELECT roi, event_frame, m, nb, list_transform(range(2 * m + 1), lambda k: coalesce(list_sum(list_concat(v, v)[1 : k]), 0)) AS s,
  list_transform(range(2 * m + 1), lambda k: coalesce(list_sum(list_transform(list_concat(v, v)[1 : k], lambda x: x * x)), 0)) AS q FROM w),
rl AS (SELECT *, CASE WHEN m > 1 THEN m - ({{shift}}) ELSE m END AS b FROM pre, (SELECT unnest(range({DRAWS})) AS draw)),
dr AS (SELECT roi, draw, m, nb, s[b + nb + 1] - s[b + 1] AS sb, s[b + m + 1] - s[b + nb + 1] AS sr, q[b + nb + 1] - q[b + 1] AS qb, q[b + m + 1] - q[b + nb + 1] AS qr FROM rl),
ds AS (SELECT roi, draw, count(*) AS n_events, avg(sb / nullif(nb, 0)) AS mb, avg(sr / nullif(m - nb, 0)) AS mr,
  (sum(qb) - sum(sb) * sum(sb) / nullif(sum(nb), 0)) / nullif(sum(nb) - 1, 0) AS vb, (sum(qr) - sum(sr) * sum(sr) / nullif(sum(m - nb), 0)) / nullif(sum(m - nb) - 1, 0) AS vr FROM dr GROUP BY 1, 2),
nul AS (SELECT roi, draw, n_events, mr - mb AS amplitude, mr / nullif(mb, 0) AS ratio, (mr - mb) / sqrt((({PRE} - 1) * vb + ({POST} - 1) * vr) / {LENGTH - 2}) AS effect_size FROM ds)"""
NULLS = ALIGNED + f""",
w AS (SELECT roi, event_frame, list(value ORDER BY rel) AS v, {LENGTH} AS m, {PRE} AS nb FROM aligned GROUP BY 1, 2 HAVING count(value) = {LENGTH}),
{SHIFTED.format(shift=f"1 + {MIXED} % {LENGTH - 1}")}"""


def windows(rows):
    return packing.packed(rows, [*UNIT, "event_frame"], ["value"], "rel")


def nulls_of(spark, d):
    """Arrays of 1,000 null amplitudes, ratios and effect sizes of each unit."""
    return nulls.response_null(windows(aligned(spark, d)), UNIT, DRAWS, PRE, POST)


def bounds_of(spark, d):
    """5th and 95th percentile of a unit's null amplitudes."""
    return nulls_of(spark, d).select("roi", nulls.percentile_of("amplitude", 0.95).alias("hi"), nulls.percentile_of("amplitude", 0.05).alias("lo"))


NULL_ROWS = f"SELECT roi, draw::BIGINT AS draw, n_events, {exact_sql('amplitude', '4000 * n_events', 5)} AS amplitude, round(ratio, 6) AS ratio, round(effect_size, 6) AS effect_size FROM nul -- FROM fr"


@query("t22_shift_null", f"WITH {NULLS} {NULL_ROWS}")
def t22(spark, d):
    return nulls.long_null(nulls_of(spark, d), UNIT).withColumns({
        "amplitude": exact(F.col("amplitude"), 4000 * F.col("n_events"), 5), "ratio": rounded(F.col("ratio")), "effect_size": rounded(F.col("effect_size"))})


@query("t22_null_percentiles", f"""WITH {NULLS} SELECT roi, round(quantile_cont(ratio, 0.95), 6) AS ratio_hi, round(quantile_cont(ratio, 0.05), 6) AS ratio_lo,
round(quantile_cont(effect_size, 0.95), 6) AS effect_hi, round(quantile_cont(effect_size, 0.05), 6) AS effect_lo FROM nul GROUP BY roi -- FROM fr""")
def t22_percentiles(spark, d):
    q = lambda a, p: rounded(nulls.percentile_of(a, p))
    return nulls_of(spark, d).select("roi", q("ratio", 0.95).alias("ratio_hi"), q("ratio", 0.05).alias("ratio_lo"),
                                     q("effect_size", 0.95).alias("effect_hi"), q("effect_size", 0.05).alias("effect_lo"))


@query("t23_fixed_null", f"""WITH {ALIGNED}, w AS (SELECT roi, event_frame, list(value ORDER BY rel) AS v, count(*) AS m, count(*) FILTER (rel < 0) AS nb
 FROM aligned WHERE (event_frame + rel) % 13 <> 0 GROUP BY 1, 2), {SHIFTED.format(shift=f"1 + floor({MIXED} / 2147483647.0::DOUBLE * (m - 1))::BIGINT")}
SELECT roi, draw::BIGINT AS draw, n_events, round(amplitude, 4) AS amplitude, round(ratio, 6) AS ratio, round(effect_size, 6) AS effect_size FROM nul -- FROM fr""")
def t23(spark, d):
    rows = aligned(spark, d).withColumn("value", F.when((F.col("event_frame") + F.col("rel")) % 13 != 0, F.col("value")))
    found = nulls.response_null(windows(rows), UNIT, DRAWS, PRE, POST, fixed=True)
    return nulls.long_null(found, UNIT).withColumns({
        "amplitude": F.round("amplitude", 4), "ratio": rounded(F.col("ratio")), "effect_size": rounded(F.col("effect_size"))})


@query("t24_classes", f"""WITH {RESPONSE}, {NULLS[len(ALIGNED) + 2:]}, q AS (SELECT roi, quantile_cont(amplitude, 0.95) AS hi, quantile_cont(amplitude, 0.05) AS lo FROM nul GROUP BY roi)
SELECT roi, CASE WHEN amp > hi AND effect > 0.05 AND roi % 32 NOT IN (0, 31) THEN 'Up' WHEN amp < lo AND effect < -0.05 AND roi % 32 NOT IN (0, 31) THEN 'Down' ELSE 'Stable' END AS class
FROM resp JOIN q USING (roi) -- FROM fr""")
def t24(spark, d):
    return response.classified(responses(spark, d).join(bounds_of(spark, d), "roi"), F.col("hi"), F.col("lo"), edge=(F.col("roi") % 32).isin(0, 31)).select("roi", "class")


@query("t25_ratio_classes", f"""WITH {RESPONSE} SELECT roi, CASE WHEN ratio > 1.02 THEN 'pyrUp' WHEN ratio < 1 / 1.02 THEN 'pyrDown' ELSE 'pyrStable' END AS class FROM resp -- FROM fr""")
def t25(spark, d):
    return responses(spark, d).select("roi", response.ratio_class(F.col("response_ratio"), 1.02).alias("class"))


@query("t25_dual_classes", f"""WITH {RESPONSE}, {NULLS[len(ALIGNED) + 2:]}, q AS (SELECT roi, quantile_cont(amplitude, 0.95) AS hi, quantile_cont(amplitude, 0.05) AS lo FROM nul GROUP BY roi),
sc AS (SELECT roi, avg(value) AS first_mean, avg(second) AS second_mean, avg(second) FILTER (rel >= 0) / nullif(avg(second) FILTER (rel < 0), 0) AS ratio2 FROM aligned GROUP BY roi),
cl AS (SELECT roi, first_mean > 0 AND first_mean < 39000 AND second_mean > 0 AND second_mean < 26 AS valid,
  CASE WHEN amp > hi AND effect > 0.05 THEN 'Up' WHEN amp < lo AND effect < -0.05 THEN 'Down' ELSE 'Stable' END AS a,
  CASE WHEN ratio2 > 1.02 THEN 'Up' WHEN ratio2 < 1 / 1.02 THEN 'Down' ELSE 'Stable' END AS z FROM resp JOIN q USING (roi) JOIN sc USING (roi))
SELECT roi, valid, CASE WHEN valid THEN a END AS first_class, CASE WHEN valid THEN z END AS second_class, CASE WHEN valid THEN a || '/' || z END AS label FROM cl -- FROM fr""")
def t25_dual(spark, d):
    """Both signals of a unit, with limits to their means."""
    mean = lambda c: F.avg(F.when(c, F.col("second")))
    own = aligned(spark, d).groupBy("roi").agg(F.avg("value").alias("first_mean"), F.avg("second").alias("second_mean"),
                                              ratio(mean(F.col("rel") >= 0), mean(F.col("rel") < 0)).alias("ratio"))
    stats = responses(spark, d).join(bounds_of(spark, d), "roi").join(own, "roi")
    found = response.dual_classes(stats, F.col("hi"), F.col("lo"), 0.05, 1.02, 1 / 1.02, {"first": 39_000.0, "second": 26.0},
                                  {"first": "first_mean", "second": "second_mean"})
    return found.select("roi", "valid", "first_class", "second_class", "label")


@query("t26_valid_profiles", """SELECT vec_id, list_min(embedding) >= -0.35 AND list_max(embedding) <= 0.35 AS valid,
round(list_avg(embedding::DOUBLE[]), 6) AS mean FROM embeddings""")
def t26(spark, d):
    packed = b.table(spark, d, "embeddings").withColumn("p", F.col("embedding").cast("array<double>"))
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p")
    return packed.select("vec_id", response.valid_profile(F.col("p"), -0.35, 0.35).alias("valid"), rounded(mean).alias("mean"))


@query("t27_block_pixels", f"""WITH {PIXELS}, u AS (SELECT DISTINCT rec, (frame % 2)::INT AS mask, y, x FROM px)
SELECT rec, mask, (y // 16)::INT AS gy, (x // 16)::INT AS gx, count(*) AS n_pixels FROM u GROUP BY ALL -- FROM fr""")
def t27(spark, d):
    masks = pixels(spark, d).select("rec", (F.col("frame") % 2).cast("int").alias("mask"), "y", "x").distinct()
    return response.block_pixels(masks)


@query("t27_block_overlaps", f"""WITH {PIXELS}, u AS (SELECT DISTINCT rec, frame % 2 AS mask, y, x FROM px),
j AS (SELECT rec, y, x, bool_or(mask = 0) AS a, bool_or(mask = 1) AS z FROM u GROUP BY 1, 2, 3)
SELECT rec, (y // 16)::INT AS gy, (x // 16)::INT AS gx, count_if(a) AS n_a, count_if(z) AS n_z, count_if(a AND z) AS n_both, count_if(a) >= 12 AS valid FROM j GROUP BY 1, 2, 3 -- FROM fr""")
def t27_overlaps(spark, d):
    """Pixels of both masks and of their intersection by grid block, and blocks with enough of them."""
    px = pixels(spark, d)
    return response.block_overlaps(px.where("frame % 2 = 0"), px.where("frame % 2 = 1"), least=12)


SEGMENTS = """last AS (SELECT roi, max(frame) + 1 AS n FROM fr GROUP BY roi),
ke AS (SELECT fr.roi, frame AS e FROM fr JOIN last USING (roi) WHERE frame % 60 = 30 AND frame - 20 >= 0 AND frame + 40 < n),
seg AS (SELECT roi, row_number() OVER w - 1 AS segment, coalesce(lag(e + 40) OVER w, 0) AS a, e + 40 AS z FROM ke WINDOW w AS (PARTITION BY roi ORDER BY e)),
f AS (SELECT fr.*, segment FROM fr LEFT JOIN seg ON fr.roi = seg.roi AND fr.frame >= a AND fr.frame < z)"""


def with_segments(spark, d):
    trace = b.traces(spark, d)
    last = trace.groupBy("roi").agg((F.max("frame") + 1).alias("n_frames"))
    found = regression.segments(trace.where("frame % 60 = 30").select("roi", F.col("frame").alias("event_frame")), UNIT, 20, 40, last)
    starts = found.select("roi", F.col("first_frame").alias("frame"), "segment", "end_frame")
    near = timejoin.asof(trace, starts, UNIT, "frame", "s_")
    return near.withColumn("segment", F.when(F.col("frame") < F.col("s_end_frame"), F.col("s_segment"))).drop("s_frame", "s_segment", "s_end_frame")


@query("t28_segment_regression", f"""WITH {SEGMENTS}, m AS (SELECT roi, segment, regr_slope(value, second) AS b1, regr_r2(value, second) AS r2, avg(second) AS mx FROM f WHERE segment IS NOT NULL GROUP BY 1, 2)
SELECT f.roi, frame, round(value - coalesce(b1 * (second - mx), 0), 5) AS corrected, round(r2, 6) AS r2 FROM f LEFT JOIN m ON f.roi = m.roi AND f.segment = m.segment -- FROM fr""")
def t28(spark, d):
    fitted = regression.residual(with_segments(spark, d), ["roi", "segment"], "value", "second", within=F.col("segment").isNotNull())
    return fitted.select("roi", "frame", F.round("corrected", 5).alias("corrected"), rounded(F.col("r2")).alias("r2"))


@query("t30_two_regressors", """WITH m AS (SELECT roi, var_pop(second) v1, var_pop(discount) v2, covar_pop(value, second) c1, covar_pop(value, discount) c2, covar_pop(second, discount) c12,
 avg(second) m1, avg(discount) m2 FROM fr GROUP BY roi),
k AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m)
SELECT roi, frame, round(value - b1 * (second - m1) - b2 * (discount - m2), 4) AS corrected FROM fr JOIN k USING (roi)""")
def t30(spark, d):
    return regression.residual(b.traces(spark, d), UNIT, "value", "second", "discount").select("roi", "frame", F.round("corrected", 4).alias("corrected"))


@query("t31_activity_class", """WITH s AS (SELECT roi, avg(value) m, stddev_pop(value) sd, count(*) n FROM fr GROUP BY roi),
k AS (SELECT fr.roi, sum(pow((value - m) / sd, 3)) / any_value(n) AS skew FROM fr JOIN s USING (roi) GROUP BY fr.roi),
h AS (SELECT fr.roi, frame - row_number() OVER (PARTITION BY fr.roi ORDER BY frame) AS g FROM fr JOIN s USING (roi) WHERE value > m + sd),
r AS (SELECT roi, max(c) AS longest FROM (SELECT roi, g, count(*) AS c FROM h GROUP BY 1, 2) GROUP BY roi)
SELECT k.roi, round(skew, 6) AS skew, longest, skew > 0.1 AND longest >= 3 AS active FROM k JOIN r USING (roi) -- FROM fr""")
def t31(spark, d):
    rows = b.traces(spark, d)
    stats = rows.groupBy("roi").agg(F.skewness("value").alias("skew"), (F.avg("value") + F.stddev_pop("value")).alias("limit"))
    long = runs(rows.join(stats, "roi"), F.col("value") > F.col("limit"), UNIT, "frame").groupBy("roi").agg(F.max("length").alias("longest"))
    return stats.join(long, "roi").select("roi", rounded(F.col("skew")).alias("skew"), "longest", ((F.col("skew") > 0.1) & (F.col("longest") >= 3)).alias("active"))


@query("t31_active_somas", """WITH s AS (SELECT roi, avg(value) m, stddev_pop(value) sd, count(*) n FROM fr GROUP BY roi),
k AS (SELECT fr.roi, sum(pow((value - m) / sd, 3)) / any_value(n) AS skew FROM fr JOIN s USING (roi) GROUP BY fr.roi),
h AS (SELECT fr.roi, frame - row_number() OVER (PARTITION BY fr.roi ORDER BY frame) AS g FROM fr JOIN s USING (roi) WHERE value > m + 2 * sd),
r AS (SELECT roi, max(c) AS longest FROM (SELECT roi, g, count(*) AS c FROM h GROUP BY 1, 2) GROUP BY roi),
p AS (SELECT p_partkey AS roi, p_size * 15 AS n_pixels, p_retailprice * 2 AS area, p_size / 50.0::DOUBLE AS compactness, p_size % 5 AS aspect, p_size % 7 / 7.0::DOUBLE AS hollowness FROM part),
c AS (SELECT k.roi, skew, longest, n_pixels > 100 AND n_pixels < 600 AND area < 2000 AND compactness > 0.1 AND aspect < 3 AND hollowness > 0.25 AS is_soma,
  coalesce(skew > 0.1 AND longest > 0 AND longest < 3, false) AS is_active FROM k JOIN p ON p.roi = k.roi LEFT JOIN r ON r.roi = k.roi)
SELECT roi, round(skew, 6) AS skew, longest, is_soma, is_active, is_soma AND is_active AS is_active_soma FROM c -- FROM fr""")
def t31_somas(spark, d):
    """Regions of a soma's shape (columns of their own table) whose activity is skewed and lasts."""
    rows = b.traces(spark, d)
    stats = rows.groupBy("roi").agg(F.skewness("value").alias("skew"), (F.avg("value") + 2 * F.stddev_pop("value")).alias("limit"))
    longest = runs(rows.join(stats, "roi"), F.col("value") > F.col("limit"), UNIT, "frame").groupBy("roi").agg(F.max("length").alias("longest"))
    size = F.col("p_size")
    shapes = b.table(spark, d, "part").select(
        F.col("p_partkey").alias("roi"), (size * 15).alias("n_pixels"), (F.col("p_retailprice") * 2).alias("area"), (size / 50).alias("compactness"),
        (size % 5).alias("aspect"), (size % 7 / 7).alias("hollowness"))
    found = stats.join(shapes, "roi").join(longest, "roi", "left").withColumns({
        "is_soma": response.is_soma(), "is_active": response.is_active(F.col("skew"), F.col("longest"), {"skewness": 0.1, "least_frames": 0, "most_frames": 3})})
    return found.select("roi", rounded(F.col("skew")).alias("skew"), "longest", "is_soma", "is_active", (F.col("is_soma") & F.col("is_active")).alias("is_active_soma"))


@query("t32_active_trials", f"""WITH {ALIGNED}, c AS (SELECT roi, event_frame, count_if(value > 60000) > 25 AS active FROM aligned GROUP BY 1, 2)
SELECT roi, round(avg(active::INT), 6) AS share FROM c GROUP BY roi -- FROM fr""")
def t32(spark, d):
    trial = aligned(spark, d).groupBy("roi", "event_frame").agg((F.count_if(F.col("value") > 60_000) > 25).alias("active"))
    return trial.groupBy("roi").agg(rounded(F.avg(F.col("active").cast("double"))).alias("share"))


#: Signals of a unit's mean event, twice as many samples a second.
FASTER = 2
MEANS = ALIGNED + f""", pr AS (SELECT roi, rel + {PRE} AS k, avg(value) AS a, avg(second) AS z FROM aligned GROUP BY 1, 2),
up AS (SELECT x.roi, i, x.a + (coalesce(y.a, x.a) - x.a) * (i % {FASTER}) / {FASTER}.0::DOUBLE AS a, x.z + (coalesce(y.z, x.z) - x.z) * (i % {FASTER}) / {FASTER}.0::DOUBLE AS z
  FROM pr x JOIN (SELECT unnest(range({LENGTH * FASTER})) AS i) ON x.k = i // {FASTER} LEFT JOIN pr y ON y.roi = x.roi AND y.k = x.k + 1),
sc AS (SELECT roi, i, (a - avg(a) OVER w) / nullif(stddev_pop(a) OVER w, 0) AS a, (z - avg(z) OVER w) / nullif(stddev_pop(z) OVER w, 0) AS z FROM up WINDOW w AS (PARTITION BY roi)),
cc AS (SELECT l.roi, l.i - r.i AS lag, sum(l.a * r.z) / {LENGTH * FASTER} AS r FROM sc l JOIN sc r ON r.roi = l.roi GROUP BY 1, 2)"""


def correlations(spark, d):
    """Mean speed and mean signal around events, at twice their rate, at all lags."""
    means = aligned(spark, d).groupBy("roi", "rel").agg(F.avg("value").alias("a"), F.avg("second").alias("z"))
    return op.cross_correlation(packing.packed(means, UNIT, ["a", "z"], "rel"), "a", "z", UNIT, FASTER, FASTER)


@query("t38_cross_correlation", f"WITH {MEANS} SELECT roi, lag::BIGINT AS lag, round(r, 6) AS r FROM cc -- FROM fr")
def t38(spark, d):
    return correlations(spark, d).select("roi", "first_lag", F.posexplode("r").alias("k", "r")).select(
        "roi", (F.col("first_lag") + F.col("k")).alias("lag"), rounded(F.col("r")).alias("r"))


@query("t38_peaks", f"""WITH {MEANS} SELECT roi, round(max(r), 6) AS peak, arg_max(lag, (r, -lag))::BIGINT AS peak_lag, round(max(r) FILTER (lag = 0), 6) AS lag_0 FROM cc GROUP BY roi -- FROM fr""")
def t38_peaks(spark, d):
    return correlations(spark, d).select("roi", rounded(F.col("peak")).alias("peak"), "peak_lag", rounded(F.col("lag_0")).alias("lag_0"))


@query("t39_trial_correlation", f"""WITH {ALIGNED}, c AS (SELECT roi, event_frame, corr(value, second) AS r FROM aligned GROUP BY 1, 2)
SELECT roi, round(quantile_cont(r, 0.5), 6) AS median_r FROM c GROUP BY roi -- FROM fr""")
def t39(spark, d):
    return aligned(spark, d).groupBy("roi", "event_frame").agg(F.corr("value", "second").alias("r")).groupBy("roi").agg(rounded(median("r")).alias("median_r"))


@query("t40_kept_frames", """WITH k AS (SELECT roi, frame, value, row_number() OVER (PARTITION BY roi ORDER BY frame) AS n FROM fr WHERE value >= 5000),
r AS (SELECT roi, frame, avg(value) OVER (PARTITION BY roi ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS result FROM k)
SELECT fr.roi, fr.frame, round(result, 6) AS result FROM fr LEFT JOIN r ON fr.roi = r.roi AND fr.frame = r.frame""")
def t40(spark, d):
    smooth = lambda x: x.withColumn("value", F.avg("value").over(Window.partitionBy("roi").orderBy("frame").rowsBetween(-3, 3)))
    return op.on_kept_frames(b.traces(spark, d).select("roi", "frame", "value"), F.col("value") >= 5000, UNIT, smooth).select(
        "roi", "frame", rounded(F.col("result")).alias("result"))
