"""Queries of the operators on packed traces, and of the sources."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracespark import sources
from tracespark.functions import kernels
from tracespark.functions.semantics import rounded
from tracespark.operators import packed as op
from tracespark.operators import regression
from tracespark.operators.behaviour import resampled
from tracespark.plans import bindings as b
from tracespark.plans.bindings import query
from tracespark.plans.places import RUN, running
from tracespark.plans.signals import SPREAD
from tracespark.plans.timejoins import ALIGNED, LINES, aligned, lines

UNIT = ["roi"]
WINDOW = 91


def packed(spark, d):
    return op.packed(b.traces(spark, d), UNIT, ["value"])


def unpacked(traces, name="value"):
    return op.long(traces, UNIT, "value").select("roi", "frame", rounded(F.col("value")).alias(name))


def baselined(spark, d, dff):
    rows = b.traces(spark, d).select("roi", "frame", "value")
    return op.rolled(rows, UNIT, WINDOW, lambda x, before, size: dff(x, WINDOW, 20, before=before, size=size)).select("roi", "frame", rounded(F.col("value")).alias("dff"))


#: Each unit with mirrored edges of k rows.
MIRROR = """n AS (SELECT roi, max(frame) + 1 AS n FROM fr GROUP BY roi),
mi AS (SELECT roi, frame AS k, value FROM fr UNION ALL SELECT roi, -1 - frame, value FROM fr WHERE frame < {k}
 UNION ALL SELECT fr.roi, 2 * n - 1 - frame, value FROM fr JOIN n ON fr.roi = n.roi WHERE frame >= n - {k})"""
RANKED = MIRROR.format(k=45) + """, rk AS (SELECT roi, k AS frame, value, list_sort(list(value) OVER (PARTITION BY roi ORDER BY k ROWS BETWEEN 45 PRECEDING AND 45 FOLLOWING))[19] AS b FROM mi),
bs AS (SELECT rk.* FROM rk JOIN n ON rk.roi = n.roi WHERE frame >= 0 AND frame < n)"""


@query("t7_percentile_dff", f"WITH {RANKED} SELECT roi, frame, round((value - b) / (b + 1e-8), 6) AS dff FROM bs -- FROM fr")
def t7(spark, d):
    return baselined(spark, d, kernels.percentile_dff)


@query("t8_absolute_dff", f"WITH {RANKED} SELECT roi, frame, round((value - b) / (abs(b) + 1e-9), 6) AS dff FROM bs -- FROM fr")
def t8(spark, d):
    return baselined(spark, d, kernels.absolute_dff)


@query("t8_sparse_dff", f"""WITH {MIRROR.format(k=45)}, q AS (SELECT roi, k AS frame, value, quantile_cont(value, 0.2) OVER (PARTITION BY roi ORDER BY k ROWS BETWEEN 45 PRECEDING AND 45 FOLLOWING) AS b FROM mi)
SELECT q.roi, frame, round((value - b) / (b + 0.1), 6) AS dff FROM q JOIN n ON q.roi = n.roi WHERE frame >= 0 AND frame < n -- FROM fr""")
def t8_sparse(spark, d):
    return baselined(spark, d, kernels.sparse_dff)


def gauss_sql(sigma: float) -> str:
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    terms = " + ".join(f"{'lag' if i < 0 else 'lead'}(value, {abs(i)}) OVER w * {float(x)!r}" if i else f"value * {float(x)!r}"
                       for i, x in zip(range(-radius, radius + 1), w, strict=True))
    return MIRROR.format(k=radius) + f""", g0 AS (SELECT roi, k AS frame, {terms} AS value FROM mi WINDOW w AS (PARTITION BY roi ORDER BY k)),
gs AS (SELECT g0.roi, frame, value FROM g0 JOIN n ON g0.roi = n.roi WHERE frame >= 0 AND frame < n)"""


@query("t13_gaussian", f"WITH {gauss_sql(1.0)} SELECT roi, frame, round(value, 6) AS smooth FROM gs -- FROM fr")
def t13(spark, d):
    return unpacked(op.per_trace(packed(spark, d), lambda x: kernels.gaussian(x, 1.0)), "smooth")


@query("t9_smooth_minimum_dff", f"""WITH {gauss_sql(5.0)},
m1 AS (SELECT roi, frame AS k, value FROM gs UNION ALL SELECT roi, -1 - frame, value FROM gs WHERE frame < 30 UNION ALL SELECT gs.roi, 2 * n - 1 - frame, value FROM gs JOIN n ON gs.roi = n.roi WHERE frame >= n - 30),
lo AS (SELECT roi, k, min(value) OVER (PARTITION BY roi ORDER BY k ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS value FROM m1),
l1 AS (SELECT lo.roi, k AS frame, value FROM lo JOIN n ON lo.roi = n.roi WHERE k >= 0 AND k < n),
m2 AS (SELECT roi, frame AS k, value FROM l1 UNION ALL SELECT roi, -1 - frame, value FROM l1 WHERE frame < 30 UNION ALL SELECT l1.roi, 2 * n - 1 - frame, value FROM l1 JOIN n ON l1.roi = n.roi WHERE frame >= n - 30),
hi AS (SELECT roi, k AS frame, max(value) OVER (PARTITION BY roi ORDER BY k ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS b FROM m2)
SELECT fr.roi, fr.frame, round((value - b) / b, 6) AS dff FROM fr JOIN hi ON fr.roi = hi.roi AND fr.frame = hi.frame""")
def t9(spark, d):
    return unpacked(op.per_trace(packed(spark, d), lambda x: kernels.smooth_minimum_dff(x, 61, 5.0)), "dff")


@query("t14_robust_filter", f"""WITH {gauss_sql(1.0)}, {SPREAD.replace('fr', 'gs')} SELECT gs.roi, frame, round(CASE WHEN value < 2 * mad / 0.6745 THEN 0 ELSE value END, 6) AS value FROM gs JOIN sp ON gs.roi = sp.roi -- FROM fr""")
def t14(spark, d):
    return op.robust_filtered(packed(spark, d), UNIT, 1.0, 2.0).select("roi", "frame", rounded(F.col("value")).alias("value"))


@query("t29_masked_regression")
def t29(spark, d):
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("frame")
        y, x, n = g["value"].to_numpy(), g["second"].to_numpy(), len(g)
        events = [e for e in range(30, n, 60) if e + 40 < n]
        bounds = [(0 if i == 0 else events[i - 1] + 40, e + 40) for i, e in enumerate(events)]
        quiet = y <= np.median(y) + 2 * np.median(np.abs(y - np.median(y))) / 0.6745
        out = kernels.masked_residual(y, x, quiet, bounds, 50)
        return pd.DataFrame({"roi": g["roi"], "frame": g["frame"], "corrected": out.round(5)})

    rows = b.traces(spark, d).select("roi", "frame", "value", "second")
    return op.per_group(rows, UNIT, fit, "roi long, frame long, corrected double")


def decays(spark, d):
    mean = aligned(spark, d).groupBy("roi", F.col("rel").alias("at")).agg(F.avg("value").alias("mean"), F.first("rel").alias("rel"))
    return regression.decay_fits(op.packed(mean, UNIT, ["rel", "mean"], "at"), UNIT, 20, 35, 15.0)


@query("t33_decay_fits")
def t33(spark, d):
    return decays(spark, d)


@query("t34_decay_by_step")
def t34(spark, d):
    fits = decays(spark, d).where("r2 > 0.3")
    return fits.groupBy((F.col("roi") % 5).alias("step")).agg(F.avg("tau").alias("tau"), F.count("*").alias("n"))


DRAWS = 1000
#: Null information of rows s(roi, grp, i, value, bin) for each draw's shift, as FFTs give it; draws of one shift are one row.
SHIFTED = f"""z AS (SELECT roi, any_value(grp) AS grp, count(*) AS n FROM s GROUP BY roi),
sh AS (SELECT roi, draw, 15 + (draw * 7919 + grp * 104729 + draw * grp * 1299709 + 1) % 2147483647 % greatest(1, n - 30) AS shift FROM z, (SELECT unnest(range({DRAWS})) AS draw) WHERE n > 30),
dr AS (SELECT s.roi, shift, value, (i + shift) % n AS dest FROM s JOIN z USING (roi) JOIN (SELECT DISTINCT roi, shift FROM sh) USING (roi)),
b0 AS (SELECT roi, bin, count(*) AS o, sum(value) AS a FROM s GROUP BY 1, 2),
b1 AS (SELECT dr.roi, shift, s.bin, sum(dr.value) AS a FROM dr JOIN s ON s.roi = dr.roi AND s.i = dest GROUP BY 1, 2, 3),
r0 AS (SELECT roi, -1 AS shift, bin, o, a / o AS r FROM b0 UNION ALL SELECT b1.roi, shift, b1.bin, o, b1.a / o FROM b1 JOIN b0 ON b0.roi = b1.roi AND b0.bin = b1.bin),
r1 AS (SELECT *, o / sum(o) OVER (PARTITION BY roi, shift) AS p FROM r0), r2 AS (SELECT *, sum(p * r) OVER (PARTITION BY roi, shift) AS m FROM r1),
inf AS (SELECT roi, shift, CASE WHEN any_value(m) <> 0 THEN coalesce(sum(CASE WHEN r > 0 THEN p * r / m * log2(r / m) END), 0) END AS bits FROM r2 GROUP BY 1, 2),
n95 AS (SELECT roi, quantile_cont(bits, 0.95) AS null_95 FROM sh JOIN inf USING (roi, shift) GROUP BY roi),
nul AS (SELECT roi, bits AS info_bits, null_95 FROM inf LEFT JOIN n95 USING (roi) WHERE shift = -1)"""
WHOLE = f"WITH {RUN}, s AS (SELECT roi, roi AS grp, frame AS i, value, bin FROM lp), {SHIFTED}"


@query("p8_information_null", f"{WHOLE} SELECT nul.roi, round(info_bits, 8) AS info_bits, round(null_95, 8) AS null_95, n AS n_frames FROM nul JOIN z ON nul.roi = z.roi -- FROM fr")
def p8(spark, d):
    rows = op.packed(running(spark, d), UNIT, ["value", "bin"])
    return op.information_null(rows, UNIT, 9, DRAWS, 15).select("roi", F.round("info_bits", 8).alias("info_bits"), F.round("null_95", 8).alias("null_95"), "n_frames")


@query("p9_valid_lap_null", f"""WITH {RUN}, vr AS (SELECT vl.roi, rec, vl.lap FROM vl JOIN unit ON unit.roi = vl.roi),
mk AS (SELECT rec, roi, list_sort(list(lap)) AS mask FROM vr GROUP BY 1, 2 HAVING count(*) >= 20),
gr AS (SELECT rec, mask, min(roi) AS grp, count(*) AS n_cells FROM mk GROUP BY 1, 2),
s AS (SELECT lp.roi, grp, row_number() OVER (PARTITION BY lp.roi ORDER BY frame) - 1 AS i, value, bin FROM lp SEMI JOIN vl USING (roi, lap) JOIN mk ON mk.roi = lp.roi JOIN gr ON gr.rec = mk.rec AND gr.mask = mk.mask), {SHIFTED}
SELECT mk.rec, nul.roi, z.grp AS first_cell, n_cells, len(mk.mask) AS n_laps, n AS n_frames, round(info_bits, 8) AS info_bits, round(null_95, 8) AS null_95
FROM nul JOIN z ON nul.roi = z.roi JOIN mk ON mk.roi = nul.roi JOIN gr ON gr.rec = mk.rec AND gr.mask = mk.mask -- FROM fr JOIN unit""")
def p9(spark, d):
    """The null on each cell's valid laps only, by groups of cells that share all of them."""
    from tracespark.plans.places import laps

    units = b.units(spark, d).select("roi", "rec")
    return op.grouped_information_null(
        running(spark, d).join(units, "roi"), laps(spark, d).join(units, "roi"), ["rec"], 9, DRAWS, 15, least_laps=20).select(
        "rec", "roi", "first_cell", "n_cells", "n_laps", "n_frames", F.round("info_bits", 8).alias("info_bits"), F.round("null_95", 8).alias("null_95"))


#: Laps of three frames or more; three frames a bin; some bins miss all of their values.
TEMPORAL = """k AS (SELECT roi, frame, lap, value, row_number() OVER (PARTITION BY roi, lap ORDER BY frame) - 1 AS k, count(*) OVER (PARTITION BY roi, lap) AS n FROM lp),
s AS (SELECT roi, lap, row_number() OVER (PARTITION BY roi ORDER BY frame) - 1 AS i, CASE WHEN frame % 170 >= 4 THEN value END AS value, floor(k / 3)::BIGINT AS bin FROM k WHERE n >= 3)"""


@query("p10_temporal_null", f"""WITH {RUN}, {TEMPORAL}, z AS (SELECT roi, count(*) AS n FROM s GROUP BY roi),
sh AS (SELECT roi, draw, 15 + (draw * 7919 + roi * 104729 + draw * roi * 1299709 + 1) % 2147483647 % greatest(1, n - 30) AS shift FROM z, (SELECT unnest(range({DRAWS})) AS draw)),
dr AS (SELECT s.roi, shift, value, (i + shift) % n AS dest FROM s JOIN z USING (roi) JOIN (SELECT DISTINCT roi, shift FROM sh) USING (roi)),
b1 AS (SELECT dr.roi, shift, s.lap, s.bin, sum(dr.value) AS a, count(dr.value) AS o FROM dr JOIN s ON s.roi = dr.roi AND s.i = dest WHERE s.bin < 9 GROUP BY 1, 2, 3, 4),
ok AS (SELECT roi, shift, lap FROM b1 GROUP BY 1, 2, 3 HAVING min(o) > 0),
b2 AS (SELECT roi, shift, bin, sum(a) / sum(o) AS r, sum(o) AS o FROM b1 SEMI JOIN ok USING (roi, shift, lap) GROUP BY 1, 2, 3),
r1 AS (SELECT *, o / sum(o) OVER (PARTITION BY roi, shift) AS p FROM b2), r2 AS (SELECT *, sum(p * r) OVER (PARTITION BY roi, shift) AS m FROM r1),
inf AS (SELECT roi, shift, CASE WHEN any_value(m) <> 0 THEN coalesce(sum(CASE WHEN r > 0 THEN p * r / m * log2(r / m) END), 0) END AS bits FROM r2 GROUP BY 1, 2),
nul AS (SELECT roi, quantile_cont(bits, 0.95) AS null_95 FROM sh JOIN inf USING (roi, shift) GROUP BY roi)
SELECT z.roi, round(null_95, 8) AS null_95, n AS n_frames FROM z LEFT JOIN nul ON nul.roi = z.roi -- FROM fr""")
def p10(spark, d):
    """The whole running trace is rolled; laps that then miss a bin drop out."""
    w = Window.partitionBy("roi", "lap")
    rows = running(spark, d).withColumns({"k": F.row_number().over(w.orderBy("frame")) - 1, "n": F.count("*").over(w)}).where("n >= 3").select(
        "roi", "frame", "lap", F.floor(F.col("k") / 3).alias("bin"), F.when(F.col("frame") % 170 >= 4, F.col("value")).alias("value"))
    return op.temporal_information_null(op.packed(rows, UNIT, ["value", "lap", "bin"]), UNIT, 9, DRAWS, 15).withColumn("null_95", F.round("null_95", 8))


@query("p16_over_null", f"{WHOLE} SELECT roi, info_bits > null_95 AS significant FROM nul -- FROM fr")
def p16(spark, d):
    return p8(spark, d).select("roi", (F.col("info_bits") > F.col("null_95")).alias("significant"))


@query("b4_run_onsets")
def b4(spark, d):
    """Onset of each lap but the first, looked for from where the lap before it first
    exceeds half of the track."""
    rows = running(spark, d).select("roi", "lap", "frame", "value", "position_cm", F.lit(1).alias("side"))
    early = rows.withColumns({"lap": F.col("lap") + 1, "side": F.lit(0)})
    real = rows.where("lap > 0").select("roi", "lap").distinct()
    own = rows.union(early).join(real, ["roi", "lap"], "left_semi").groupBy("roi", "lap").agg(
        F.sort_array(F.collect_list(F.struct("frame", "side", "value", "position_cm"))).alias("x"))
    return own.select("roi", "lap", *[F.col(f"x.{c}").alias(c) for c in ("frame", "side", "value", "position_cm")]).mapInArrow(
        onsets, "roi long, lap long, onset_frame long, non_stop boolean, non_full_stop boolean")


def onsets(batches):
    """The onsets of packed laps, each with the lap before it."""
    for batch in op.sliced(batches, 1024):
        frame, side, value, position = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("frame", "side", "value", "position_cm"))
        ends = np.cumsum(batch.column("frame").value_lengths().to_numpy())
        found = [onset_of_lap(*(x[a:z] for x in (frame, side, value, position))) for a, z in zip([0, *ends[:-1]], ends)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("roi").cast(pa.int64()), batch.column("lap").cast(pa.int64()),
             *[pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.bool_(), pa.bool_()))]],
            names=["roi", "lap", "onset_frame", "non_stop", "non_full_stop"])


def onset_of_lap(frame, side, value, position):
    before = side == 0
    n = int(before.sum())
    exit_ = kernels.track_exit(position[before], 90.0)
    speed = np.r_[value[before][exit_:], value[n:]] / 1000
    k, non_stop, moving = kernels.run_onset(speed, n - exit_, rate=10.0)
    return (int(frame[exit_ + k]) if k >= 0 else -1), bool(non_stop), bool(moving)


DISTANCE = """dc AS (SELECT roi, frame // 60 AS trial, frame, second AS v, sum(second) OVER (PARTITION BY roi, frame // 60 ORDER BY frame) - first(second) OVER (PARTITION BY roi, frame // 60 ORDER BY frame) AS t FROM fr),
dg AS (SELECT roi, trial, t AS a, v, lead(t) OVER w AS z, lead(v) OVER w AS w_ FROM dc WINDOW w AS (PARTITION BY roi, trial ORDER BY t)),
dk AS (SELECT *, unnest(range(ceil(a / 10)::BIGINT, ceil(z / 10)::BIGINT)) AS k FROM dg WHERE z > a),
dp AS (SELECT DISTINCT roi, trial, unnest(range(100)) AS k FROM dc)"""


@query("b7_distance_speed", f"""WITH {DISTANCE} SELECT dp.roi, dp.trial, dp.k * 10.0::DOUBLE AS distance, coalesce(round(v + (w_ - v) * (dp.k * 10 - a) / (z - a), 6), 0.0) AS speed
FROM dp LEFT JOIN dk ON dk.roi = dp.roi AND dk.trial = dp.trial AND dk.k = dp.k -- FROM fr""")
def b7(spark, d):
    """Speed over the distance run in each trial, on a grid of fixed length: zero beyond the trial's end."""
    w = Window.partitionBy("roi", "trial").orderBy("frame")
    rows = b.traces(spark, d).withColumn("trial", F.floor(F.col("frame") / 60)).select(
        F.struct("roi", "trial").alias("key"), (F.sum("second").over(w) - F.first("second").over(w)).alias("t"), F.col("second").alias("value"))
    grid = rows.select("key").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(99)))).select("key", (F.col("k") * 10.0).alias("t"))
    return grid.join(resampled(rows, 10.0, "key"), ["key", "t"], "left").select(
        "key.roi", "key.trial", F.col("t").alias("distance"), F.coalesce(rounded(F.col("value")), F.lit(0.0)).alias("speed"))


TEMPLATE = """s0 AS (SELECT roi, frame // 60 AS trial, value, (row_number() OVER w - 1) * 99.0::DOUBLE / (count(*) OVER (PARTITION BY roi, frame // 60) - 1) AS t, count(*) OVER (PARTITION BY roi, frame // 60) AS n
 FROM fr WINDOW w AS (PARTITION BY roi, frame // 60 ORDER BY frame)),
s1 AS (SELECT roi, trial, t AS a, value AS v, lead(t) OVER w AS z, lead(value) OVER w AS w_ FROM s0 WHERE n > 1 WINDOW w AS (PARTITION BY roi, trial ORDER BY t)),
s2 AS (SELECT *, unnest(range(ceil(a)::BIGINT, ceil(z)::BIGINT)) AS k FROM s1 WHERE z IS NOT NULL),
s3 AS (SELECT roi, trial, k, v + (w_ - v) * (k - a) / (z - a) AS x FROM s2), s4 AS (SELECT roi, k, quantile_cont(x, 0.5) AS m FROM s3 GROUP BY 1, 2),
s5 AS (SELECT s3.roi, trial, corr(x, m) AS r FROM s3 JOIN s4 ON s3.roi = s4.roi AND s3.k = s4.k GROUP BY 1, 2)"""


@query("b15_template_filter", f"WITH {TEMPLATE} SELECT roi, trial, round(r, 6) AS r, coalesce(r >= 0.3, false) AS kept FROM s5 -- FROM fr")
def b15(spark, d):
    rows = b.traces(spark, d).withColumn("trial", F.floor(F.col("frame") / 60))
    return op.template_kept(rows, "roi", "trial", "frame", "value", 100, 0.3).withColumn("r", rounded(F.col("r")))


@query("b15_without_worst", f"""WITH {TEMPLATE}, q AS (SELECT roi, quantile_cont(r, 0.2) AS lim FROM s5 GROUP BY roi)
SELECT s5.roi, trial, coalesce(r >= lim, false) AS kept FROM s5 JOIN q ON s5.roi = q.roi -- FROM fr""")
def b15_worst(spark, d):
    rows = b.traces(spark, d).withColumn("trial", F.floor(F.col("frame") / 60))
    return op.template_kept(rows, "roi", "trial", "frame", "value", 100, None).select("roi", "trial", "kept")


def region_sets(spark, d):
    """Two sets of regions of ten recordings: the pixels of two thirds of the frames each."""
    px = b.traces(spark, d).select((F.col("roi") % 10).alias("rec"), (F.col("roi") % 7).alias("roi"), (F.col("part") % 16).alias("y"), (F.floor(F.col("part") / 16) % 16).alias("x"), "frame")
    return [px.where(F.col("frame") % 3 != k).select("rec", "roi", "y", "x").distinct() for k in (0, 1)]


@query("j18_matched_regions")
def j18(spark, d):
    return op.matched_regions(*region_sets(spark, d), "rec", 6.0, 0.3).withColumn("dice", rounded(F.col("dice")))


@query("j18_shifted_regions")
def j18_shifted(spark, d):
    """Masks grown by a pixel, at their best shift of up to two pixels."""
    return op.matched_regions(*region_sets(spark, d), "rec", 6.0, 0.3, dilate=1, max_shift=2).withColumn("dice", rounded(F.col("dice")))


@query("u2_per_trace", "SELECT roi, frame, round(value - first(value) OVER (PARTITION BY roi ORDER BY frame), 6) AS shifted FROM fr")
def u2(spark, d):
    x = F.col("value")
    return unpacked(packed(spark, d).withColumn("value", F.transform(x, lambda v: v - x[0])), "shifted")


@query("u4_per_group", "SELECT roi, round(max(value) - min(value), 6) AS span FROM fr GROUP BY roi")
def u4(spark, d):
    return b.traces(spark, d).groupBy("roi").agg(rounded(F.max("value") - F.min("value")).alias("span"))


@query("u1_per_cell", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS energy FROM embeddings")
def u1(spark, d):
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * v)
    return b.table(spark, d, "embeddings").select("vec_id", rounded(F.aggregate(x, F.lit(0.0), lambda a, v: a + v)).alias("energy"))


@query("u3_per_group_sql", "SELECT roi, round(avg(value), 6) AS mean, count(*) AS n FROM fr GROUP BY roi")
def u3(spark, d):
    return b.traces(spark, d).groupBy("roi").agg(rounded(F.avg("value")).alias("mean"), F.count("*").alias("n"))


@query("s1_session_tables", """SELECT rec, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY rec""")
def s1(spark, d):
    path = sources.scratch(spark, "stats")
    nested = b.events(spark, d).groupBy("rec").agg(F.collect_list("value").alias("values"))
    sources.write_stats(nested, path)
    return sources.read_stats(spark, path).select(
        F.col("rec").cast("long").alias("rec"), F.size("values").cast("long").alias("n"),
        F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("s2_log_files", f"WITH l AS ({LINES}) SELECT rec, line_no, raw FROM l -- FROM ev")
def s2(spark, d):
    path = sources.scratch(spark, "logs")
    sources.write_logs(lines(spark, d), path)
    return sources.read_logs(spark, path).withColumn("rec", F.col("rec").cast("long"))


PIXEL = "px AS (SELECT frame, roi, floor(value)::BIGINT % 30000 AS v FROM fr), sz AS (SELECT max(roi) + 1 AS n FROM px)"


def movie(spark, d):
    """A movie of one row of pixels, one for each unit, written and read again."""
    width = b.traces(spark, d).agg(F.max("roi")).first()[0] + 1

    def frame(batches):
        for batch in batches:
            pixels = []
            for rois, values in zip(batch["rois"], batch["values"], strict=True):
                x = np.zeros(width, "<i2")
                x[np.asarray(rois, int)] = values
                pixels.append(x.tobytes())
            yield pd.DataFrame({"frame": batch["frame"], "pixels": pixels})

    each = b.traces(spark, d).select("frame", "roi", (F.floor("value") % 30000).cast("short").alias("v"))
    packed_ = each.groupBy("frame").agg(F.collect_list(F.struct("roi", "v")).alias("x")).select("frame", F.col("x.roi").alias("rois"), F.col("x.v").alias("values"))
    path = sources.scratch(spark, "movie")
    sources.write_movie(packed_.mapInPandas(frame, "frame long, pixels binary"), path)
    return sources.read_movie(spark, path, 1, width)


@query("s4_movie_frames", f"WITH {PIXEL} SELECT frame, round(sum(v) / any_value(n)::DOUBLE, 6) AS mean FROM px, sz GROUP BY frame -- FROM fr")
def s4(spark, d):
    return movie(spark, d).select("frame", rounded(F.col("mean")).alias("mean"))


@query("t1_roi_means", f"""WITH {PIXEL}, k AS (SELECT roi % 5 AS mask, count(DISTINCT roi) AS n_px FROM fr GROUP BY 1), f AS (SELECT DISTINCT frame FROM px)
SELECT f.frame, k.mask, CASE WHEN any_value(n_px) >= 2 THEN round(coalesce(sum(v), 0) / any_value(n_px), 6) END AS mean
FROM f CROSS JOIN k LEFT JOIN px ON px.frame = f.frame AND px.roi % 5 = k.mask GROUP BY 1, 2""")
def t1(spark, d):
    masks = b.traces(spark, d).select((F.col("roi") % 5).alias("roi"), F.col("roi").alias("pixel")).distinct()
    return sources.roi_means(movie(spark, d), masks, 2).select("frame", F.col("roi").alias("mask"), rounded(F.col("value")).alias("mean"))


@query("s5_trace_arrays", """SELECT label::BIGINT AS rec, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS roi, len(embedding) AS n,
round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS energy FROM embeddings""")
def s5(spark, d):
    path = sources.scratch(spark, "traces")
    sources.write_traces(b.table(spark, d, "embeddings").select(F.col("label").alias("rec"), F.col("vec_id").alias("roi"), F.col("embedding").alias("values")), path)
    energy = F.aggregate("values", F.lit(0.0), lambda a, v: a + v * v)
    return sources.read_traces(spark, path).select(
        F.col("rec").cast("long").alias("rec"), "roi", F.size("values").cast("long").alias("n"), rounded(energy).alias("energy"))


@query("s3_both_inputs", "SELECT DISTINCT rec FROM lick WHERE value > 120 AND rec IN (SELECT rec FROM reward WHERE value > 120)")
def s3(spark, d):
    return sources.discovered(b.licks(spark, d).where("value > 120"), b.rewards(spark, d).where("value > 120"))


@query("s6_summary_csv", "SELECT rec, count(*) AS n, round(avg(value), 6) AS mean FROM ev GROUP BY rec")
def s6(spark, d):
    path = sources.scratch(spark, "summary")
    sources.write_summary(b.events(spark, d).groupBy("rec").agg(
        F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"), F.collect_list("value").alias("values")), path)
    return spark.read.csv(path, header=True, schema="rec long, n long, mean double")


@query("s7_todo", "SELECT DISTINCT rec FROM ev WHERE rec NOT IN (SELECT rec FROM reward WHERE value > 120)")
def s7(spark, d):
    return sources.todo(b.events(spark, d).select("rec").distinct(), b.rewards(spark, d).where("value > 120"))
