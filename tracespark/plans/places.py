"""Queries of the place-cell operators: 20 cm bins, laps of a position that returns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracespark.functions.semantics import rounded
from tracespark.operators import place as op
from tracespark.operators import timejoin
from tracespark.plans import bindings as b
from tracespark.plans.bindings import query

CELL = ["roi"]
BINS = 9

RUN = """rn AS (SELECT roi, frame, value, ((frame * 7) % 180)::DOUBLE AS position_cm FROM fr),
fl AS (SELECT *, coalesce((lag(position_cm) OVER (PARTITION BY roi ORDER BY frame) - position_cm > 90)::INT, 0) AS fell FROM rn),
lp AS (SELECT roi, frame, value, position_cm, sum(fell) OVER (PARTITION BY roi ORDER BY frame) AS lap, least(greatest(floor(position_cm / 20), 0), 8)::BIGINT AS bin FROM fl),
bl AS (SELECT roi, lap, bin, sum(value) AS activity, count(*) AS occupancy, avg(value) AS rate FROM lp GROUP BY ALL),
vl AS (SELECT roi, lap FROM bl GROUP BY 1, 2 HAVING count(DISTINCT bin) = 9),
mp AS (SELECT roi, bin, sum(activity) AS activity, sum(occupancy) AS occupancy, sum(activity) / sum(occupancy) AS rate FROM bl SEMI JOIN vl USING (roi, lap) GROUP BY 1, 2),
pk AS (SELECT roi, arg_max(bin, (rate, -bin)) AS peak_bin FROM mp GROUP BY roi)"""


def running(spark, d):
    rows = b.traces(spark, d).select("roi", "frame", "value", ((F.col("frame") * 7) % 180).cast("double").alias("position_cm"))
    return op.with_bins(op.with_laps(rows, "roi"), 20.0, BINS)


def by_lap(spark, d):
    return op.binned(running(spark, d), ["roi", "lap"])


def laps(spark, d):
    return op.valid_laps(by_lap(spark, d), BINS, CELL)


def maps(spark, d):
    lap = by_lap(spark, d)
    return op.rate_map(lap, op.valid_laps(lap, BINS, CELL), CELL)


def peaks(rates):
    return rates.groupBy("roi").agg(F.max_by("bin", F.struct("rate", -F.col("bin"))).alias("peak_bin"))


@query("p1_running_frames", """WITH s AS (SELECT rec, t, value FROM ev WHERE kind <> 'view' AND value > 10 AND value < 180),
bf AS (SELECT s.*, f.t AS bt, f.frame AS b FROM s ASOF LEFT JOIN frame f ON s.rec = f.rec AND s.t >= f.t),
nf AS (SELECT s.*, f.t AS nt, f.frame AS n FROM bf s ASOF LEFT JOIN frame f ON s.rec = f.rec AND s.t <= f.t)
SELECT rec, CASE WHEN nt IS NULL OR t - bt <= nt - t THEN b ELSE n END AS frame, count(*) AS n_samples, round(avg(value), 6) AS position FROM nf GROUP BY 1, 2 -- FROM frame""")
def p1(spark, d):
    samples = b.events(spark, d).where("kind <> 'view' and value > 10 and value < 180").select("rec", "t", "value")
    near = timejoin.nearest(samples, b.frames(spark, d), ["rec"])
    return near.groupBy("rec", F.col("at_frame").alias("frame")).agg(F.count("*").alias("n_samples"), rounded(F.avg("value")).alias("position"))


@query("p2_laps", f"WITH {RUN} SELECT roi, frame, lap::BIGINT AS lap FROM lp -- FROM fr")
def p2(spark, d):
    return running(spark, d).select("roi", "frame", "lap")


@query("p3_spatial_bins", f"WITH {RUN} SELECT roi, bin, count(*) AS occupancy, round(avg(value), 6) AS rate FROM lp GROUP BY 1, 2 -- FROM fr")
def p3(spark, d):
    return op.binned(running(spark, d), CELL).select("roi", "bin", "occupancy", rounded(F.col("rate")).alias("rate"))


@query("p4_temporal_bins", f"""WITH {RUN}, k AS (SELECT roi, lap, value, row_number() OVER (PARTITION BY roi, lap ORDER BY frame) - 1 AS k, count(*) OVER (PARTITION BY roi, lap) AS n FROM lp)
SELECT roi, lap::BIGINT AS lap, floor(k / 3)::BIGINT AS bin, count(*) AS occupancy, round(avg(value), 6) AS rate FROM k WHERE n >= 3 AND k < 120 GROUP BY 1, 2, 3 -- FROM fr""")
def p4(spark, d):
    w = Window.partitionBy("roi", "lap")
    rows = running(spark, d).withColumns({"k": F.row_number().over(w.orderBy("frame")) - 1, "n": F.count("*").over(w)})
    return op.binned(rows.where("n >= 3 and k < 120").withColumn("bin", F.floor(F.col("k") / 3)), ["roi", "lap"]).select(
        "roi", "lap", "bin", "occupancy", rounded(F.col("rate")).alias("rate"))


@query("p5_valid_lap_rates", f"WITH {RUN} SELECT roi, bin, occupancy::BIGINT AS occupancy, round(rate, 6) AS rate FROM mp -- FROM fr")
def p5(spark, d):
    return maps(spark, d).select("roi", "bin", "occupancy", rounded(F.col("rate")).alias("rate"))


INFO = RUN + """, q AS (SELECT *, occupancy / sum(occupancy) OVER (PARTITION BY roi) AS p FROM mp),
q2 AS (SELECT *, sum(p * rate) OVER (PARTITION BY roi) AS m FROM q),
info AS (SELECT roi, CASE WHEN any_value(m) <> 0 THEN coalesce(sum(CASE WHEN rate > 0 THEN p * rate / m * log2(rate / m) END), 0) END AS info_bits FROM q2 GROUP BY roi)"""


@query("p6_information", f"WITH {INFO} SELECT roi, round(info_bits, 8) AS info_bits FROM info -- FROM fr")
def p6(spark, d):
    return op.information(maps(spark, d), CELL).select("roi", F.round("info_bits", 8).alias("info_bits"))


@query("p7_candidates", f"""WITH {INFO}, a AS (SELECT roi, avg((value > 50000)::INT) AS active FROM fr GROUP BY roi), n AS (SELECT roi, count(*) AS n FROM vl GROUP BY roi)
SELECT info.roi FROM info JOIN a USING (roi) JOIN n USING (roi) WHERE active > 0.1 AND info_bits > 0.0005 AND n >= 3""")
def p7(spark, d):
    active = b.traces(spark, d).groupBy("roi").agg(F.avg((F.col("value") > 50_000).cast("double")).alias("active"))
    n = laps(spark, d).groupBy("roi").agg(F.count("*").alias("n"))
    return op.information(maps(spark, d), CELL).join(active, "roi").join(n, "roi").where("active > 0.1 and info_bits > 0.0005 and n >= 3").select("roi")


W5 = [2.718281828459045 ** (-(k * k) / 4.5) for k in range(-2, 3)]
SMOOTH = lambda c: " + ".join(
    f"coalesce({'lag' if k < 0 else 'lead'}({c}, {abs(k)}) OVER w, 0) * {W5[k + 2] / sum(W5)!r}" if k else f"{c} * {W5[2] / sum(W5)!r}" for k in range(-2, 3))


FIELD_MAP = RUN + f""", sm AS (SELECT roi, bin, ({SMOOTH('activity')}) / ({SMOOTH('occupancy')}) AS r FROM mp WINDOW w AS (PARTITION BY roi ORDER BY bin)),
fm AS (SELECT roi, bin, r / nullif(max(r) OVER (PARTITION BY roi), 0) AS field FROM sm)"""


@query("p11_field_maps", f"WITH {FIELD_MAP} SELECT roi, bin, round(field, 6) AS field FROM fm -- FROM fr")
def p11(spark, d):
    return op.field_map(maps(spark, d), CELL).select("roi", "bin", rounded(F.col("field")).alias("field"))


PEAKS = FIELD_MAP + """, fp AS (SELECT roi, arg_max(bin, (r, -bin)) AS peak_bin, (arg_max(bin, (r, -bin)) + 0.5) * 20 AS position_cm, max(r) AS amplitude FROM sm WHERE r IS NOT NULL GROUP BY roi)"""


def field_peaks(spark, d):
    return op.field_peaks(maps(spark, d), CELL, 20.0)


@query("p11_field_peaks", f"WITH {PEAKS} SELECT roi, peak_bin, round(position_cm, 6) AS position_cm, round(amplitude, 6) AS amplitude FROM fp -- FROM fr")
def p11_peaks(spark, d):
    return field_peaks(spark, d).select("roi", "peak_bin", rounded(F.col("position_cm")).alias("position_cm"), rounded(F.col("amplitude")).alias("amplitude"))


FIELDS = RUN + """, rk AS (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY rate, bin) AS k FROM mp),
th AS (SELECT roi, avg(rate) FILTER (k <= 5) AS base, max(rate) AS peak FROM rk GROUP BY roi),
hi AS (SELECT mp.roi, bin, rate > base + 0.25 * (peak - base) AS hit FROM mp JOIN th USING (roi)),
gr AS (SELECT roi, bin, bin - row_number() OVER (PARTITION BY roi ORDER BY bin) AS g FROM hi WHERE hit),
fd AS (SELECT roi, min(bin) AS start, max(bin) AS "end", count(*) AS length, row_number() OVER (PARTITION BY roi ORDER BY min(bin)) AS field FROM gr GROUP BY roi, g),
tc AS (SELECT roi, bin, count_if(value > 60000) AS tn FROM lp SEMI JOIN vl USING (roi, lap) GROUP BY 1, 2),
tot AS (SELECT roi, sum(activity) AS a, sum(occupancy) AS o FROM mp GROUP BY roi),
ins AS (SELECT fd.roi, fd.field, fd.start, fd."end", max(rate) AS peak, sum(activity) AS ia, sum(occupancy) AS io, sum(tn) AS tin FROM fd JOIN mp ON fd.roi = mp.roi AND mp.bin BETWEEN fd.start AND fd."end" JOIN tc ON tc.roi = mp.roi AND tc.bin = mp.bin GROUP BY ALL),
fmx AS (SELECT ins.roi, field, start, "end", peak, ("end" - start + 1) * 20.0::DOUBLE AS width_cm, CASE WHEN o > io AND (a - ia) / (o - io) > 0 THEN (ia / io) / ((a - ia) / (o - io)) END AS in_out, tin / nullif(io, 0) AS fraction FROM ins JOIN tot USING (roi))"""


def fields(spark, d):
    return op.tentative_fields(maps(spark, d), CELL, lowest=5)


def metrics(spark, d):
    return op.field_metrics(fields(spark, d), maps(spark, d), CELL, 20.0, p13(spark, d))


@query("p12_tentative_fields", f'WITH {FIELDS} SELECT roi, field, start, "end", length FROM fd -- FROM fr')
def p12(spark, d):
    return fields(spark, d).select("roi", "field", "start", "end", "length")


@query("p13_transient_counts", f"WITH {RUN} SELECT roi, bin, count_if(value > 60000) AS n FROM lp SEMI JOIN vl USING (roi, lap) GROUP BY 1, 2 -- FROM fr")
def p13(spark, d):
    return running(spark, d).join(laps(spark, d), ["roi", "lap"], "left_semi").groupBy("roi", "bin").agg(F.count_if(F.col("value") > 60_000).alias("n"))


@query("p14_field_metrics", f"WITH {FIELDS} SELECT roi, field, width_cm, round(peak, 6) AS peak, round(in_out, 6) AS in_out, round(fraction, 6) AS fraction FROM fmx -- FROM fr")
def p14(spark, d):
    return metrics(spark, d).select("roi", "field", "width_cm", rounded(F.col("peak")).alias("peak"), rounded(F.col("in_out")).alias("in_out"), rounded(F.col("fraction")).alias("fraction"))


@query("p15_significant_cells", f"WITH {FIELDS} SELECT roi, bool_or(coalesce(width_cm >= 40 AND in_out > 1.1 AND peak >= 41000 AND fraction >= 0.21, false)) AS significant FROM fmx GROUP BY roi -- FROM fr")
def p15(spark, d):
    return place_cells(spark, d)


HALF = """SELECT roi, CASE WHEN count(a + z) >= 3 THEN round(corr(a, z), 6) END AS stability FROM
(SELECT bl.roi, bin, avg(rate) FILTER (side = 1) AS a, avg(rate) FILTER (side = 0) AS z FROM bl JOIN sd ON bl.roi = sd.roi AND bl.lap = sd.lap GROUP BY 1, 2) GROUP BY roi -- FROM fr"""


@query("p17_stability", f"WITH {RUN}, sd AS (SELECT roi, lap, row_number() OVER (PARTITION BY roi ORDER BY lap) % 2 AS side FROM vl) {HALF}")
def p17(spark, d):
    return op.stability(by_lap(spark, d), laps(spark, d), CELL).withColumn("stability", rounded(F.col("stability")))


@query("p17_half_stability", f"""WITH {RUN}, sd AS (SELECT roi, lap, (row_number() OVER (PARTITION BY roi ORDER BY lap) * 2 > count(*) OVER (PARTITION BY roi))::INT AS side FROM vl) {HALF}""")
def p17_halves(spark, d):
    return op.stability(by_lap(spark, d), laps(spark, d), CELL, halves=True).withColumn("stability", rounded(F.col("stability")))


@query("p18_lap_correlations", f"""WITH {RUN}, k AS (SELECT bl.roi, bin, rate, dense_rank() OVER (PARTITION BY bl.roi ORDER BY lap) AS k FROM bl SEMI JOIN vl USING (roi, lap)),
c AS (SELECT a.roi, a.k AS i, z.k AS j, coalesce(corr(a.rate, z.rate), 0) AS r FROM k a JOIN k z ON a.roi = z.roi AND a.bin = z.bin AND a.k < z.k GROUP BY 1, 2, 3)
SELECT roi, round(avg(r) FILTER (j = i + 1), 6) AS consecutive, round(avg(r), 6) AS all_pairs FROM c GROUP BY roi -- FROM fr""")
def p18(spark, d):
    return op.lap_correlations(by_lap(spark, d), laps(spark, d), CELL).select(
        "roi", rounded(F.col("consecutive")).alias("consecutive"), rounded(F.col("all_pairs")).alias("all_pairs"))


@query("p19_activity_shares", f"""WITH {RUN}, l AS (SELECT roi, lap, bool_or(value > 90000) AS active FROM lp GROUP BY 1, 2),
f AS (SELECT roi, count_if(value > 90000) AS n_frames, count(*) AS n FROM lp GROUP BY 1)
SELECT l.roi, any_value(n_frames) AS n_frames, round(any_value(n_frames) / any_value(n), 6) AS frame_share, count_if(active) AS n_laps, round(avg(active::INT), 6) AS lap_share FROM l JOIN f ON l.roi = f.roi GROUP BY l.roi -- FROM fr""")
def p19(spark, d):
    per_lap = running(spark, d).groupBy("roi", "lap").agg(F.count_if(F.col("value") > 90_000).alias("k"), F.count("*").alias("n"))
    return per_lap.groupBy("roi").agg(
        F.sum("k").alias("n_frames"), rounded(F.sum("k") / F.sum("n")).alias("frame_share"),
        F.count_if(F.col("k") > 0).alias("n_laps"), rounded(F.avg((F.col("k") > 0).cast("double"))).alias("lap_share"))


@query("p20_primary_fields", f"""WITH {FIELDS}, r AS (SELECT fmx.*, row_number() OVER (PARTITION BY fmx.roi ORDER BY (peak_bin BETWEEN start AND "end") DESC, in_out DESC NULLS LAST, field) AS r
  FROM fmx JOIN pk ON fmx.roi = pk.roi) SELECT roi, field, start, "end" FROM r WHERE r = 1 -- FROM fr""")
def p20(spark, d):
    return op.primary_field(metrics(spark, d), peaks(maps(spark, d)), CELL).select("roi", "field", "start", "end")


def place_cells(spark, d):
    return op.significant(metrics(spark, d), CELL, 40.0, 1.1, 41_000.0, 0.21)


COHORT = """sg AS (SELECT roi, bool_or(coalesce(width_cm >= 40 AND in_out > 1.1 AND peak >= 41000 AND fraction >= 0.21, false)) AS significant FROM fmx GROUP BY roi)"""
SIGNIFICANT = f"{FIELDS[len(RUN) + 2:]}, {COHORT}"


@query("p21_session_metrics", f"""WITH {PEAKS}, {SIGNIFICANT},
c AS (SELECT fp.roi, rec, position_cm AS pos, coalesce(significant, false) AS pc FROM fp JOIN unit USING (roi) LEFT JOIN sg ON sg.roi = fp.roi),
k AS (SELECT rec, count(*) AS n_cells, count_if(pc) AS n_place_cells, avg((pos < 30)::INT) FILTER (pc) AS onset, avg((pos >= 150)::INT) FILTER (pc) AS reward FROM c GROUP BY rec)
SELECT rec, n_cells, n_place_cells, round(100.0 * n_place_cells / n_cells, 6) AS place_cell_percent, round(onset, 6) AS onset_share, round(reward, 6) AS reward_share,
 round(onset / (30.0::DOUBLE / 180), 6) AS onset_enrichment, round(reward / (30.0::DOUBLE / 180), 6) AS reward_enrichment FROM k -- FROM fr""")
def p21(spark, d):
    cells = field_peaks(spark, d).join(place_cells(spark, d), "roi", "left").join(b.units(spark, d), "roi")
    found = op.session_metrics(cells, ["rec"])
    return found.select("rec", "n_cells", "n_place_cells", *[rounded(F.col(c)).alias(c) for c in (
        "place_cell_percent", "onset_share", "reward_share", "onset_enrichment", "reward_enrichment")])


@query("p22_by_trial_type", f"""WITH {FIELDS}, {COHORT},
tl AS (SELECT roi, lap, lap % 2 AS type FROM vl SEMI JOIN (SELECT roi FROM sg WHERE significant) USING (roi)),
rw AS (SELECT bl.roi, type, bl.lap, bin, rate, dense_rank() OVER (PARTITION BY bl.roi, type ORDER BY bl.lap) AS k FROM bl JOIN tl ON bl.roi = tl.roi AND bl.lap = tl.lap),
nl AS (SELECT roi, type, count(*) AS n_laps FROM tl GROUP BY 1, 2),
mt AS (SELECT roi, type, bin, avg(rate) AS r FROM rw GROUP BY 1, 2, 3),
inf AS (SELECT roi, type, sum(CASE WHEN r > 0 THEN r / m * log2(r / m) / 9 END) AS info_bits FROM (SELECT *, avg(r) OVER (PARTITION BY roi, type) AS m FROM mt) GROUP BY 1, 2),
pt AS (SELECT roi, type, arg_max(bin, (r, -bin)) AS peak_bin FROM mt GROUP BY 1, 2),
r5 AS (SELECT *, row_number() OVER (PARTITION BY roi, type ORDER BY r, bin) AS k FROM mt), l5 AS (SELECT roi, type, avg(r) FILTER (k <= 5) AS base, max(r) AS top FROM r5 GROUP BY 1, 2),
h5 AS (SELECT mt.roi, mt.type, bin, r > base + 0.25 * (top - base) AS hit FROM mt JOIN l5 ON l5.roi = mt.roi AND l5.type = mt.type),
g5 AS (SELECT roi, type, bin, bin - row_number() OVER (PARTITION BY roi, type ORDER BY bin) AS g FROM h5 WHERE hit),
f5 AS (SELECT roi, type, min(bin) AS a, max(bin) AS z FROM g5 GROUP BY roi, type, g),
p5 AS (SELECT f5.*, row_number() OVER (PARTITION BY f5.roi, f5.type ORDER BY (peak_bin BETWEEN a AND z) DESC, a) AS k FROM f5 JOIN pt ON pt.roi = f5.roi AND pt.type = f5.type),
io AS (SELECT mt.roi, mt.type, any_value(z - a + 1) * 20.0::DOUBLE AS width, avg(r) FILTER (bin BETWEEN a AND z) AS i, avg(r) FILTER (bin NOT BETWEEN a AND z) AS o
  FROM mt JOIN p5 ON p5.roi = mt.roi AND p5.type = mt.type AND p5.k = 1 GROUP BY 1, 2),
oe AS (SELECT roi, type, corr(x, y) AS r FROM (SELECT roi, type, bin, avg(rate) FILTER (k % 2 = 1) AS x, avg(rate) FILTER (k % 2 = 0) AS y FROM rw GROUP BY 1, 2, 3) GROUP BY 1, 2),
cs AS (SELECT roi, type, avg(r) AS r FROM (SELECT x.roi, x.type, x.k, coalesce(corr(x.rate, y.rate), 0) AS r FROM rw x JOIN rw y ON x.roi = y.roi AND x.type = y.type AND x.bin = y.bin AND y.k = x.k + 1 GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT nl.roi, nl.type::BIGINT AS type, n_laps, round(info_bits, 8) AS info_bits, (peak_bin + 0.5) * 20.0::DOUBLE AS location_cm, width AS field_width_cm,
  round(CASE WHEN o > 0 THEN i / o END, 6) AS in_out, CASE WHEN n_laps >= 4 THEN round(oe.r, 6) END AS odd_even, CASE WHEN n_laps >= 2 THEN round(cs.r, 6) END AS consecutive
FROM nl JOIN inf ON inf.roi = nl.roi AND inf.type = nl.type JOIN pt ON pt.roi = nl.roi AND pt.type = nl.type LEFT JOIN io ON io.roi = nl.roi AND io.type = nl.type
LEFT JOIN oe ON oe.roi = nl.roi AND oe.type = nl.type LEFT JOIN cs ON cs.roi = nl.roi AND cs.type = nl.type -- FROM fr""")
def p22(spark, d):
    """Even and odd laps of the significant cells."""
    lap = by_lap(spark, d).withColumn("type", F.col("lap") % 2)
    cohort = place_cells(spark, d).where("significant")
    found = op.cohort_metrics(lap, op.valid_laps(lap, BINS, ["roi", "type"]), cohort, ["roi", "type"], 20.0, lowest=5)
    return found.select("roi", "type", "n_laps", F.round("info_bits", 8).alias("info_bits"), "location_cm", "field_width_cm",
                        *[rounded(F.col(c)).alias(c) for c in ("in_out", "odd_even", "consecutive")])


@query("p23_joint_maps", f"""WITH {RUN}, g AS (SELECT roi, lap % 2 AS grp, bin, avg(rate) AS r FROM bl SEMI JOIN vl USING (roi, lap) GROUP BY 1, 2, 3),
s AS (SELECT *, min(r) OVER (PARTITION BY roi) AS a, max(r) OVER (PARTITION BY roi) AS z FROM g),
jp AS (SELECT roi, arg_max(bin, (r, -bin)) AS peak FROM (SELECT roi, bin, max(r) AS r FROM g GROUP BY 1, 2) GROUP BY roi),
pl AS (SELECT rec, roi, row_number() OVER (PARTITION BY rec ORDER BY peak, roi) AS place FROM jp JOIN unit USING (roi))
SELECT rec, s.roi, place, grp::BIGINT AS grp, bin, round((r - a) / nullif(z - a, 0), 6) AS scaled FROM s JOIN pl ON s.roi = pl.roi -- FROM fr""")
def p23(spark, d):
    """Both groups' maps on one scale; cells of a session in the order of their joint peak."""
    mean = by_lap(spark, d).join(laps(spark, d), ["roi", "lap"], "left_semi").groupBy("roi", (F.col("lap") % 2).alias("grp"), "bin").agg(F.avg("rate").alias("r"))
    w = Window.partitionBy("roi")
    low, high = F.min("r").over(w), F.max("r").over(w)
    joint = mean.groupBy("roi").agg(F.max_by("bin", F.struct("r", -F.col("bin"))).alias("peak"))
    places = joint.join(b.units(spark, d), "roi").select(
        "rec", "roi", F.row_number().over(Window.partitionBy("rec").orderBy("peak", "roi")).cast("long").alias("place"))
    return mean.select("roi", "grp", "bin", rounded(F.try_divide(F.col("r") - low, high - low)).alias("scaled")).join(places, "roi")


@query("p24_field_histogram", f"""WITH {RUN}, h AS (SELECT rec, floor((peak_bin + 0.5) * 20 / 15)::BIGINT AS bin, count(*) AS n FROM pk JOIN unit USING (roi) GROUP BY 1, 2)
SELECT rec, bin, n, round(100.0 * n / sum(n) OVER (PARTITION BY rec), 6) AS percent FROM h -- FROM fr""")
def p24(spark, d):
    counts = peaks(maps(spark, d)).join(b.units(spark, d), "roi").groupBy("rec", F.floor((F.col("peak_bin") + 0.5) * 20 / 15).alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("rec", "bin", "n", rounded(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("rec"))).alias("percent"))


@query("p25_sequence_order", f"""WITH {RUN}, m2 AS (SELECT roi, lap % 2 AS ses, bin, sum(activity) / sum(occupancy) AS rate FROM bl SEMI JOIN vl USING (roi, lap) GROUP BY 1, 2, 3),
p2 AS (SELECT roi, ses, arg_max(bin, (rate, -bin)) AS peak FROM m2 GROUP BY 1, 2),
b2 AS (SELECT a.roi, a.peak AS peak_1, z.peak AS peak_2 FROM p2 a JOIN p2 z ON a.roi = z.roi AND a.ses = 0 AND z.ses = 1)
SELECT rec, roi, peak_1, peak_2, row_number() OVER (PARTITION BY rec ORDER BY peak_1, roi) AS place FROM b2 JOIN unit USING (roi) -- FROM fr""")
def p25(spark, d):
    """Cells that both sessions (even and odd laps) have, in the order of the first one's peaks."""
    lap = by_lap(spark, d).withColumn("session", F.col("lap") % 2)
    rates = op.rate_map(lap, op.valid_laps(lap, BINS, ["roi", "session"]), ["roi", "session"])
    peak = lambda k: F.max_by(F.when(F.col("session") == k, F.col("bin")), F.when(F.col("session") == k, F.struct("rate", -F.col("bin"))))
    both = rates.groupBy("roi").agg(peak(0).alias("peak_1"), peak(1).alias("peak_2")).where("peak_1 is not null and peak_2 is not null")
    return both.join(b.units(spark, d), "roi").select(
        "rec", "roi", "peak_1", "peak_2", F.row_number().over(Window.partitionBy("rec").orderBy("peak_1", "roi")).cast("long").alias("place"))
