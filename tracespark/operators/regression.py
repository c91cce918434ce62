"""Artifact regression in closed form, from grouped moments; decay fits of many units at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracespark.functions import kernels
from tracespark.functions.semantics import ratio


def residual(rows: DataFrame, by: list[str], y: str, x1: str, x2: str | None = None, within: Column | None = None) -> DataFrame:
    """y without what the regressors explain: y - sum b_k (x_k - mean x_k), by group.

    One grouped aggregation of means and covariances solves the normal equations of
    one or two regressors; r2 is the explained share of y's variance. A group with a
    missing value, or whose regressors do not vary, stays as it is, with missing b1, b2
    and r2, as do rows that ``within`` does not hold for.
    """
    within = F.lit(True) if within is None else F.coalesce(within, F.lit(False))
    names = [y, x1] + ([x2] if x2 else [])
    aggs = [F.bool_and(F.col(c).isNotNull()).alias(f"_w{i}") for i, c in enumerate(names)]
    moments = rows.where(within).groupBy(*by).agg(
        *aggs, F.var_pop(y).alias("_yy"), F.avg(x1).alias("_m1"), F.var_pop(x1).alias("_11"), F.covar_pop(y, x1).alias("_y1"),
        *([F.avg(x2).alias("_m2"), F.var_pop(x2).alias("_22"), F.covar_pop(y, x2).alias("_y2"), F.covar_pop(x1, x2).alias("_12")] if x2 else []))
    ok = F.col("_w0")
    for i in range(1, len(names)):
        ok = ok & F.col(f"_w{i}")
    c = F.col
    if x2:
        det = c("_11") * c("_22") - c("_12") * c("_12")
        b1 = ratio(c("_y1") * c("_22") - c("_y2") * c("_12"), det)
        b2 = ratio(c("_y2") * c("_11") - c("_y1") * c("_12"), det)
        r2 = ratio(c("b1") * c("_y1") + c("b2") * c("_y2"), c("_yy"))
        part = c("b1") * (c(x1) - c("_m1")) + c("b2") * (c(x2) - c("_m2"))
    else:
        b1, b2 = ratio(c("_y1"), c("_11")), F.lit(None).cast("double")
        r2 = ratio(c("b1") * c("_y1"), c("_yy"))
        part = c("b1") * (c(x1) - c("_m1"))
    fits = moments.withColumns({"b1": F.when(ok, b1), "b2": F.when(ok, b2)}).withColumn("r2", r2).select(
        *by, "b1", "b2", "r2", "_m1", *(["_m2"] if x2 else []))
    return rows.join(fits, by, "left").withColumn("corrected", c(y) - F.coalesce(part, F.lit(0.0))).drop("_m1", "_m2")


def segments(events: DataFrame, by: list[str], before: int, after: int, last: DataFrame) -> DataFrame:
    """Segments [end of the one before (first: 0), event + after) of the events that fit.

    ``last``: by, n_frames. An event is kept if event - before >= 0 and event + after < n_frames.
    """
    from pyspark.sql import Window

    kept = events.join(last, by).where((F.col("event_frame") - before >= 0) & (F.col("event_frame") + after < F.col("n_frames")))
    w = Window.partitionBy(*by).orderBy("event_frame")
    return kept.select(
        *by, (F.row_number().over(w) - 1).cast("long").alias("segment"),
        F.coalesce(F.lag(F.col("event_frame") + after).over(w), F.lit(0)).alias("first_frame"),
        (F.col("event_frame") + after).alias("end_frame"))


def decay_fits(profiles: DataFrame, by: list[str], first: int, last: int, span: float, least: int = 5, t: str = "rel", y: str = "mean") -> DataFrame:
    """Exponential decay after the peak of each unit's profile (by, and the arrays t and y).

    The peak is the largest of samples ``first`` .. ``last`` - 1; the fit takes ``span`` of time from
    there on. The units of an Arrow batch are fitted together. What a unit cannot give (too few
    points, no variance) is null.

    Returns by, tau, a, c, tau_se, r2, n_points.
    """
    columns = [f"by{k}" for k in range(len(by))]
    names = ["tau", "a", "c", "tau_se", "r2", "n_points"]
    plain = profiles.select(*[F.col(c).alias(k) for c, k in zip(by, columns)], F.col(t).cast("array<double>").alias("t"), F.col(y).cast("array<double>").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid else np.empty(0) for x in batch.column(c)] for c in ("t", "y")]
            width = max([last, *map(len, lists[0])])
            times, values = (np.full((batch.num_rows, width), np.nan) for _ in lists)
            for row, (a, z) in enumerate(zip(*lists)):
                times[row, : len(a)], values[row, : len(z)] = a, z
            seen = np.where(np.isfinite(values[:, first:last]), values[:, first:last], -np.inf)
            fits = kernels.decay_fits(times, values, first + seen.argmax(1), span, least)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], *[pa.array(fits[n], from_pandas=True) for n in names]], names=[*columns, *names])

    schema = StructType(plain.select(*columns).schema.fields + [StructField(n, DoubleType()) for n in names])
    return plain.mapInArrow(run, schema).withColumnsRenamed(dict(zip(columns, by)))
