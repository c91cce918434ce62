"""Traces: long tables (one row per unit and frame) under windows and grouped sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracespark.functions import kernels
from tracespark.functions.semantics import finite, median, ratio


def unit(by: list[str]):
    return Window.partitionBy(*by)


def block_traces(pixels: DataFrame, side: int = 16, least: int = 10, by: tuple[str, ...] = ("rec", "frame")) -> DataFrame:
    """Mean of the pixels of each grid block and frame; blocks of few pixels give none."""
    return pixels.groupBy(*by, (F.col("y") / side).cast("int").alias("gy"), (F.col("x") / side).cast("int").alias("gx")).agg(
        F.count("*").alias("n_pixels"), F.when(F.count("*") >= least, F.avg("value")).alias("mean"))


def field_traces(pixels: DataFrame, height: int, width: int, border: int = 16, by: tuple[str, ...] = ("rec", "frame")) -> DataFrame:
    """Mean of each frame's pixels away from the border (missing without any), and of all its pixels."""
    inner = (F.col("y") >= border) & (F.col("y") < height - border) & (F.col("x") >= border) & (F.col("x") < width - border)
    return pixels.groupBy(*by).agg(F.avg(F.when(inner, F.col("value"))).alias("inner_mean"), F.avg("value").alias("whole_mean"))


def frame_cutoff(means: DataFrame, by: str, value: str, search: float = 0.25, least_gap: float = 0.0) -> DataFrame:
    """Dark-frame threshold: the middle of the largest gap between sorted values up to a
    percentile. Fails where that gap is too small."""
    limit = means.groupBy(by).agg(F.percentile(value, search).alias("_limit"))
    gaps = means.withColumn("_next", F.lead(value).over(Window.partitionBy(by).orderBy(value))).join(limit, by).where(
        (F.col(value) <= F.col("_limit")) & F.col("_next").isNotNull())
    best = gaps.groupBy(by).agg(F.max(F.col("_next") - F.col(value)).alias("gap"), F.max_by(
        (F.col(value) + F.col("_next")) / 2, F.struct(F.col("_next") - F.col(value), -F.col(value))).alias("threshold"))
    return best.withColumn("threshold", F.when(F.col("gap") < least_gap, F.raise_error(F.lit("no clear gap"))).otherwise(F.col("threshold")))


def widened(rows: DataFrame, flag: Column, before: int, after: int, by: list[str], order: str = "frame") -> DataFrame:
    """A flag that also holds ``before`` frames earlier and ``after`` frames later."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-after, before)
    return rows.withColumn("wide", F.max(flag.cast("int")).over(w) == 1)


def forward_extremes(rows: DataFrame, width: int, by: list[str], value: str = "value", order: str = "frame") -> DataFrame:
    """Minimum (lo) and maximum (hi) over the next ``width`` values; the end is padded with a
    copy of the last half window."""
    half = -(-width // 2)
    n = F.count("*").over(unit(by))
    ranked = rows.withColumns({"_n": n, "_k": F.row_number().over(Window.partitionBy(*by).orderBy(order))})
    own = F.struct(F.col("_k").alias("k"), F.lit(True).alias("own"))
    copy = F.struct((F.col("_k") + half).alias("k"), F.lit(False).alias("own"))
    padded = ranked.withColumn("_p", F.explode(F.when(F.col("_k") > F.col("_n") - half, F.array(own, copy)).otherwise(F.array(own))))
    w = Window.partitionBy(*by).orderBy("_p.k", F.col("_p.own").desc()).rowsBetween(0, width - 1)
    return padded.withColumns({"lo": F.min(value).over(w), "hi": F.max(value).over(w)}).where("_p.own").drop("_n", "_k", "_p")


def signal_and_surround(movie: DataFrame, regions: DataFrame, expressed: DataFrame, by: list[str], frame: str = "frame", value: str = "value") -> DataFrame:
    """Mean trace of each region and of its surround.

    The surround is what a dilation by one pixel adds to the region; both count only inside
    the expression mask. ``movie``: by, frame, y, x, value; ``regions``: by, roi, y, x;
    ``expressed``: by, y, x. A trace without pixels in a frame is missing there.
    """
    near = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    pixel = [*by, "roi", "y", "x"]
    ring = regions.withColumn("_d", F.explode(near)).select(
        *by, "roi", (F.col("y") + F.col("_d.dy")).alias("y"), (F.col("x") + F.col("_d.dx")).alias("x")).distinct()
    both = regions.select(*pixel, F.lit(True).alias("_in")).union(ring.join(regions, pixel, "left_anti").select(*pixel, F.lit(False)))
    hit = both.join(expressed, [*by, "y", "x"], "left_semi").join(movie, [*by, "y", "x"])
    inner, outer = F.when(F.col("_in"), F.col(value)), F.when(~F.col("_in"), F.col(value))
    return hit.groupBy(*by, "roi", frame).agg(
        F.count(inner).alias("n_signal"), F.count(outer).alias("n_surround"), F.avg(inner).alias("signal"), F.avg(outer).alias("surround"))


def outliers_missing(rows: DataFrame, n_sd: float, by: list[str], value: str = "value", low: float | None = None, high: float | None = None) -> DataFrame:
    """Values beyond mean +- n sd (population), or beyond fixed limits, are missing.

    Bounds are strict; a zero spread or fewer than two finite values change nothing.
    """
    x = finite(F.col(value))
    if low is not None or high is not None:
        out = (F.col(value) < low if low is not None else F.lit(False)) | (F.col(value) > high if high is not None else F.lit(False))
        return rows.withColumn(value, F.when(~out, x))
    m, sd, n = F.avg(x).over(unit(by)), F.stddev_pop(x).over(unit(by)), F.count(x).over(unit(by))
    keep = (n < 2) | (sd == 0) | ((F.col(value) >= m - n_sd * sd) & (F.col(value) <= m + n_sd * sd))
    return rows.withColumn(value, F.when(keep, x))


def session_limit(rows: DataFrame, cap: float, factor: float, by: str = "rec", value: str = "value") -> DataFrame:
    """Values whose size exceeds the session's mean + factor * sd (of values under a cap) are missing."""
    limit = rows.where(F.abs(value) < cap).groupBy(by).agg((F.avg(value) + factor * F.stddev_pop(value)).alias("_limit"))
    return rows.join(limit, by, "left").withColumn(
        value, F.when(F.abs(value) <= F.col("_limit"), F.col(value))).drop("_limit")


def robust_spread(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Median and MAD of each unit."""
    mid = rows.groupBy(*by).agg(median(value).alias("mid"))
    return rows.join(mid, by).groupBy(*by).agg(F.first("mid").alias("mid"), median(F.abs(F.col(value) - F.col("mid"))).alias("mad"))


def min_max(rows: DataFrame, by: list[str], value: str = "value", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Scaled to 0..1 between two percentiles; all-zero units stay 0, other constant ones are missing."""
    if (low, high) == (0.0, 1.0):
        bounds = rows.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_z"))
    else:
        bounds = rows.groupBy(*by).agg(F.percentile(value, low).alias("_a"), F.percentile(value, high).alias("_z"))
    scaled = F.when((F.col("_a") == 0) & (F.col("_z") == 0), 0.0).otherwise(ratio(F.col(value) - F.col("_a"), F.col("_z") - F.col("_a")))
    return rows.join(bounds, by).withColumn("scaled", scaled).drop("_a", "_z")


def clipped_z(rows: DataFrame, by: list[str], value: str = "value", low: float = -4.0, high: float = 8.0) -> DataFrame:
    z = ratio(F.col(value) - F.avg(value).over(unit(by)), F.stddev_pop(value).over(unit(by)))
    return rows.withColumn("scaled", (F.least(F.greatest(z, F.lit(low)), F.lit(high)) - low) / (high - low))


def filled(rows: DataFrame, by: list[str], value: str = "value", order: str = "frame") -> DataFrame:
    """Missing values by linear interpolation, the ends by the nearest value; a unit of one
    value is constant, one without any is 0."""
    back = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)  # a frame that only grows
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("k"), F.col(value).alias("v")))
    a, z = F.last(point, ignorenulls=True).over(back), F.last(point, ignorenulls=True).over(ahead)
    both = rows.withColumns({"_a": a, "_z": z})
    line = F.col("_a.v") + (F.col("_z.v") - F.col("_a.v")) * (F.col(order) - F.col("_a.k")) / (F.col("_z.k") - F.col("_a.k"))
    return both.withColumn(value, F.when(F.col("_a.k") == F.col("_z.k"), F.col("_a.v")).otherwise(
        F.coalesce(line, F.col("_a.v"), F.col("_z.v"), F.lit(0.0)))).drop("_a", "_z")


def pooled_z(trace: DataFrame, aligned: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """A trace in sds of its pooled baseline windows (aligned rows with rel < 0)."""
    base = aligned.where("rel < 0").groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"))
    return trace.join(base, by).withColumn("z", ratio(F.col(value) - F.col("_m"), F.col("_sd"))).drop("_m", "_sd")


def profile(aligned: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean, SEM and count by relative frame."""
    return aligned.groupBy(*by, "rel").agg(
        F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def cross_correlation(pairs: DataFrame, a: str, z: str, by: list[str], factor_a: float = 1.0, factor_z: float = 1.0) -> DataFrame:
    """Correlation of two signals of a unit at every lag, its peak, the peak's lag and lag 0.

    ``pairs``: by and two packed signals. Each is brought to the common rate first (the
    factor by which it is too slow) and z-scored; where one is shorter the other is cut.
    ``lag`` counts samples of the common rate by which ``a`` is behind ``z``; of equal peaks the
    earliest counts. A constant or missing signal gives nulls.

    Returns by, first_lag, r array<double>, peak, peak_lag, lag_0.
    """
    columns = [f"by{k}" for k in range(len(by))]
    plain = pairs.select(*[F.col(c).alias(k) for c, k in zip(by, columns)], F.col(a).cast("array<double>").alias("a"), F.col(z).cast("array<double>").alias("z"))
    schema = StructType(plain.select(*columns).schema.fields + StructType.fromDDL("first_lag long, r array<double>, peak double, peak_lag long, lag_0 double").fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for xa, xz in zip(batch.column("a"), batch.column("z")):
                x, y = (kernels.upsampled(v.values.to_numpy(zero_copy_only=False).astype(float), f) if v.is_valid and len(v) else np.empty(0)
                        for v, f in ((xa, factor_a), (xz, factor_z)))
                n = min(x.size, y.size)
                lags, r = kernels.cross_correlation(x[:n], y[:n])
                if n == 0 or np.isnan(r).any():
                    out.append((None,) * 5)
                else:
                    top = int(np.argmax(r))
                    out.append((int(lags[0]), r.tolist(), float(r[top]), int(lags[top]), float(r[n - 1])))
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.float64())
            made = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], names=names)

    return plain.mapInArrow(run, schema).withColumnsRenamed(dict(zip(columns, by)))


def on_kept_frames(rows: DataFrame, keep: Column, by: list[str], operator, order: str = "frame") -> DataFrame:
    """Apply an operator to the kept frames as if they were contiguous, and put the
    result back; frames left out have a missing result.

    ``operator`` takes and returns a DataFrame with a column ``value`` ordered by ``order``.
    """
    kept = rows.where(keep).withColumn("_original", F.col(order)).withColumn(
        order, F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    done = operator(kept).select(*by, F.col("_original").alias(order), F.col("value").alias("result"))
    return rows.join(done, [*by, order], "left")
