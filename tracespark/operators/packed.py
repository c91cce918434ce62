"""Operators on packed traces: one row holds a unit's whole trace, which never shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracespark.functions import kernels


#: Packed traces that Python works on at once; an Arrow batch has 10,000.
SLICE = 64


def sliced(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def packed(rows: DataFrame, by: list[str], values: list[str], order: str = "frame") -> DataFrame:
    """Long traces to one row of arrays per unit, in frame order."""
    each = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("_x"))
    return each.select(*by, *[F.col(f"_x.{v}").alias(v) for v in values])


def long(traces: DataFrame, by: list[str], value: str, order: str = "frame") -> DataFrame:
    return traces.select(*by, F.posexplode(value).alias(order, value)).withColumn(order, F.col(order).cast("long"))


def per_trace(traces: DataFrame, f: Callable[[np.ndarray], np.ndarray], value: str = "value") -> DataFrame:
    """Apply a function along each packed trace; missing values are NaN inside."""
    at = traces.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            own = part.column(at)
            out = [f(x.values.to_numpy(zero_copy_only=False).astype(float)) if x.is_valid else [] for x in own]
            offsets = pa.array(np.cumsum([0, *map(len, out)]), pa.int32())
            flat = pa.array(np.concatenate(out) if out else np.empty(0), pa.float64(), from_pandas=True)
            done = pa.ListArray.from_arrays(offsets, flat, mask=own.is_null()).cast(own.type)
            yield pa.RecordBatch.from_arrays([c if k != at else done for k, c in enumerate(part.columns)], names=part.schema.names)

    return traces.mapInArrow(run, traces.schema)


def rolled(
    rows: DataFrame, by: list[str], window: int, f: Callable[[np.ndarray, int, int], np.ndarray], value: str = "value", order: str = "frame",
    span: int = 1 << 15,
) -> DataFrame:
    """A function of each sample's window, for long traces of any length.

    ``rows``: by, order (whole numbers from 0 without gaps), value. A trace is cut into spans
    of ``span`` frames, each packed with the half windows around it, so that one long trace
    is many tasks' work; at its ends the trace is reflected. ``f`` gets the samples of a span
    (missing ones NaN), how many lie before it and its size, and gives a value for each of its
    frames. Returns by, order, value (missing: null).
    """
    half = window // 2
    first = F.greatest(F.lit(0), F.floor((F.col(order) - (window - half - 1)) / span))
    spread = rows.select(*by, order, value, F.explode(F.sequence(first.cast("long"), F.floor((F.col(order) + half) / span).cast("long"))).alias("_span"))
    spans = spread.groupBy(*by, "_span").agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_x")).select(
        *by, "_span", (F.col("_span") * span - F.col("_x")[0][order]).cast("int").alias("_before"), F.col(f"_x.{value}").cast("array<double>").alias(value))

    at = spans.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for before, samples in zip(batch.column("_before").to_pylist(), batch.column(value)):
                x = samples.values.to_numpy(zero_copy_only=False).astype(float)
                size = min(span, len(x) - before)
                out.append(f(x, before, size) if size > 0 else [])
            offsets = pa.array(np.cumsum([0, *map(len, out)]), pa.int32())
            flat = pa.array(np.concatenate(out) if out else np.empty(0), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [c if k != at else pa.ListArray.from_arrays(offsets, flat) for k, c in enumerate(batch.columns)], names=batch.schema.names)

    done = spans.mapInArrow(run, spans.schema)
    return done.select(*by, "_span", F.posexplode(value).alias("_k", value)).select(
        *by, (F.col("_span") * span + F.col("_k")).alias(order), value)


def per_group(rows: DataFrame, by: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a function to each group; groups are dealt out by key."""
    return rows.groupBy(*by).applyInPandas(f, schema)


def robust_filtered(traces: DataFrame, by: list[str], sigma: float, factor: float) -> DataFrame:
    """Smoothed long traces with values below factor * MAD / 0.6745 set to zero."""
    from tracespark.functions.semantics import median

    smooth = long(per_trace(traces, lambda x: kernels.gaussian(x, sigma)), by, "value")
    mid = smooth.groupBy(*by).agg(median("value").alias("_mid"))
    mad = smooth.join(mid, by).groupBy(*by).agg(median(F.abs(F.col("value") - F.col("_mid"))).alias("_mad"))
    return smooth.join(mad, by).withColumn(
        "value", F.when(F.col("value") < factor * F.col("_mad") / 0.6745, 0.0).otherwise(F.col("value"))).drop("_mad")


def information_null(traces: DataFrame, by: list[str], n_bins: int, draws: int, least: int) -> DataFrame:
    """Observed information and its 95th null percentile, for packed value and bin arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                x, bins = np.array(row["value"], float), np.array(row["bin"], np.int64)
                shifts = kernels.draw_shifts(x.size, draws, least, int(row[by[0]]))
                null = kernels.shifted_information(x, bins, n_bins, shifts)
                seen = kernels.shifted_information(x, bins, n_bins, np.array([0]))[0]
                out.append((*[row[c] for c in by], seen, float(np.nanpercentile(null, 95)), int(x.size)))
            yield pd.DataFrame(out, columns=[*by, "info_bits", "null_95", "n_frames"])

    kinds = {f.name: f.dataType.simpleString() for f in traces.schema}
    return traces.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", info_bits double, null_95 double, n_frames long")


def lap_masks(valid: DataFrame, by: list[str], cell: str = "roi", lap: str = "lap", least: int = 1) -> DataFrame:
    """The cells of each exact set of valid laps: by, cell, mask (a bit for each lap), n_laps,
    first_cell (the group's smallest, which names it) and n_cells. Cells of fewer than ``least`` valid laps drop out."""
    own = valid.select(*by, cell, lap).distinct().groupBy(*by, cell, F.shiftright(lap, 6).alias("_word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({lap} % 64 as int))")).alias("_bits"), F.count("*").alias("_n"))
    masks = own.groupBy(*by, cell).agg(F.array_sort(F.collect_list(F.struct("_word", "_bits"))).alias("mask"), F.sum("_n").alias("n_laps")).where(
        F.col("n_laps") >= least)
    groups = masks.groupBy(*by, "mask").agg(F.min(cell).alias("first_cell"), F.count("*").alias("n_cells"))
    return masks.join(groups, [*by, "mask"])


def grouped_information_null(
    rows: DataFrame, valid: DataFrame, by: list[str], n_bins: int, draws: int, least_shift: int, *, least_laps: int = 1, cell: str = "roi",
    lap: str = "lap", order: str = "frame", batch: int = 64,
) -> DataFrame:
    """Observed information and its 95th null percentile on each cell's own valid laps.

    ``rows``: by, cell, lap, order, bin, value (running frames); ``valid``: by, cell, lap. The cells of
    a recording that share all their valid laps are one group: they have the same frames, one
    occupancy and one set of shifts, drawn by the group's smallest cell, and the spectra of
    the bins are taken once for all of them (cells whose last lap ends apart from the others' are
    taken by themselves). A group's cells are dealt out in batches of
    about ``batch``. Cells of fewer than ``least_laps`` valid laps have no row; groups of no
    more than twice ``least_shift`` frames have no null.

    Returns by, cell, first_cell, n_cells, n_laps, n_frames, info_bits, null_95.
    """
    masks = lap_masks(valid, by, cell, lap, least_laps)
    kept = rows.join(valid.select(*by, cell, lap).distinct(), [*by, cell, lap], "left_semi")
    own = packed(kept, [*by, cell], ["value", "bin"], order).join(masks.drop("mask"), [*by, cell])
    columns = [f"by{k}" for k in range(len(by))]
    dealt = own.select(
        *[F.col(c).alias(k) for c, k in zip(by, columns)], F.col(cell).cast("long").alias("cell"), F.col("first_cell").cast("long").alias("first_cell"),
        "n_cells", "n_laps", F.col("value").cast("array<double>").alias("value"), F.col("bin").cast("array<int>").alias("bin"),
        F.pmod(F.xxhash64(cell), F.ceil(F.col("n_cells") / batch)).alias("deal")).repartition(*columns, "first_cell", "deal")
    added = "n_frames long, info_bits double, null_95 double"
    names = [*columns, "cell", "first_cell", "n_cells", "n_laps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            groups: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(*[part.column(c).to_pylist() for c in (*columns, "first_cell")])):
                places = part.column("bin")[row].values.to_numpy(zero_copy_only=False)
                groups.setdefault((*key, places.tobytes()), []).append(row)
            found: list = [None] * part.num_rows
            for key, own in groups.items():
                for some in (own[a : a + batch] for a in range(0, len(own), batch)):
                    bins = part.column("bin")[some[0]].values.to_numpy(zero_copy_only=False).astype(np.int64)
                    values = np.stack([part.column("value")[r].values.to_numpy(zero_copy_only=False) for r in some])
                    seen = kernels.shifted_information(values, bins, n_bins, np.array([0]))[:, 0]
                    null = np.full(len(some), np.nan)
                    if bins.size > 2 * least_shift:
                        shifts = kernels.draw_shifts(bins.size, draws, least_shift, key[-2])
                        null = np.nanpercentile(kernels.shifted_information(values, bins, n_bins, shifts), 95, axis=1)
                    for r, x, z in zip(some, seen.tolist(), null.tolist()):
                        found[r] = (bins.size, x, None if np.isnan(z) else z)
            made = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *made], names=[*names, "n_frames", "info_bits", "null_95"])

    schema = StructType(dealt.select(*names).schema.fields + StructType.fromDDL(added).fields)
    return dealt.mapInArrow(run, schema).withColumnsRenamed({**dict(zip(columns, by)), "cell": cell})


def temporal_information_null(traces: DataFrame, by: list[str], n_bins: int, draws: int, least: int) -> DataFrame:
    """95th null percentile of the temporal information, for packed value, lap and bin arrays.

    Each draw rolls the whole running trace, bins it by lap again and drops the laps that
    then miss a bin.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                x, lap, bins = np.array(row["value"], float), np.array(row["lap"], np.int64), np.array(row["bin"], np.int64)
                null = kernels.temporal_null(x, lap, bins, n_bins, kernels.draw_shifts(x.size, draws, least, int(row[by[0]])))
                out.append((*[row[c] for c in by], float(np.nanpercentile(null, 95)) if not np.isnan(null).all() else None, int(x.size)))
            yield pd.DataFrame(out, columns=[*by, "null_95", "n_frames"])

    kinds = {f.name: f.dataType.simpleString() for f in traces.schema}
    return traces.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", null_95 double, n_frames long")


def template_kept(samples: DataFrame, by: str, trial: str, order: str, value: str, points: int = 100, least_r: float | None = 0.75, least_trials: int = 5, drop_worst: float = 0.2) -> DataFrame:
    """Trials whose speed, resampled to ``points``, correlates with the recording's median
    template by ``least_r`` or more (None: without the worst share ``drop_worst``);
    recordings of few trials keep all."""
    from tracespark.functions.semantics import median
    from tracespark.operators.behaviour import resampled

    w = Window.partitionBy(by, trial)
    place = (F.row_number().over(w.orderBy(order)) - 1) * (points - 1) / (F.count("*").over(w) - 1)
    scaled = samples.withColumn("_n", F.count("*").over(w)).where("_n > 1").select(
        F.struct(by, trial).alias("_key"), place.alias("_t"), F.col(value).alias("_v"))
    grid = resampled(scaled, 1.0, "_key", "_t", "_v").select(f"_key.{by}", f"_key.{trial}", F.col("_t").alias("point"), F.col("_v").alias("x"))
    template = grid.groupBy(by, "point").agg(median("x").alias("m"))
    r = grid.join(template, [by, "point"]).groupBy(by, trial).agg(F.corr("x", "m").alias("r"))
    n = F.count("*").over(Window.partitionBy(by))
    limit = F.lit(least_r) if least_r is not None else F.percentile("r", drop_worst).over(Window.partitionBy(by))
    return r.withColumns({"_trials": n, "_limit": limit}).withColumn(
        "kept", (F.col("_trials") < least_trials) | F.coalesce(F.col("r") >= F.col("_limit"), F.lit(False))).drop("_trials", "_limit")


def dilated(pixels: DataFrame, radius: int) -> DataFrame:
    """Regions (by, roi, y, x) grown by a disc of ``radius`` pixels."""
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    rest = [c for c in pixels.columns if c not in ("y", "x")]
    each = pixels.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc])))
    return each.select(*rest, (F.col("y") + F.col("_d.dy")).alias("y"), (F.col("x") + F.col("_d.dx")).alias("x")).distinct()


def matched_regions(
    a: DataFrame, z: DataFrame, by: str, radius: float = 6.0, dice: float = 0.5, dilate: int = 0, max_shift: int = 0,
) -> DataFrame:
    """One-to-one pairs of regions of two sets by overlap.

    ``a``, ``z``: by, roi, y, x (pixels; regions numbered from 0). Centroids meet in grid
    cells as wide as the radius (and their neighbours). The Dice of a close pair counts the
    pixels that both have after growing by ``dilate``, at the best shift of up to
    ``max_shift`` pixels in y and x. The pairing of the largest total Dice is found among
    the pairs that pass: pairs that share regions are one component, found by joins, and
    each component, a few neighbours, is assigned by itself.
    """
    from tracespark.operators.pooling import connected_groups
    from tracespark.sources import shared_dir

    shared_dir(a.sparkSession)  # for the checkpoint below

    def centres(p, name):
        return p.groupBy(by, F.col("roi").alias(name)).agg(F.avg("y").alias(f"_y{name}"), F.avg("x").alias(f"_x{name}"))

    ca, cz = centres(a, "a"), centres(z, "z")
    near = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    left = ca.withColumn("_d", F.explode(F.array(*near))).select(
        "*", (F.floor(F.col("_ya") / radius) + F.col("_d.dy")).alias("_gy"), (F.floor(F.col("_xa") / radius) + F.col("_d.dx")).alias("_gx")).drop("_d")
    right = cz.withColumns({"_gy": F.floor(F.col("_yz") / radius), "_gx": F.floor(F.col("_xz") / radius)})
    close = left.join(right, [by, "_gy", "_gx"]).where(
        (F.col("_ya") - F.col("_yz")) ** 2 + (F.col("_xa") - F.col("_xz")) ** 2 <= radius * radius).select(by, "a", "z")
    ga, gz = (dilated(p, dilate) if dilate else p for p in (a, z))
    na, nz = (p.groupBy(by, F.col("roi").alias(n)).agg(F.count("*").alias(f"_n{n}")) for p, n in ((ga, "a"), (gz, "z")))
    shifts = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
              for dy in range(-max_shift, max_shift + 1) for dx in range(-max_shift, max_shift + 1)]
    moved = gz.withColumn("_d", F.explode(F.array(*shifts))).select(
        by, F.col("roi").alias("z"), (F.col("y") + F.col("_d.dy")).alias("y"), (F.col("x") + F.col("_d.dx")).alias("x"), "_d")
    shared = ga.select(by, F.col("roi").alias("a"), "y", "x").join(moved, [by, "y", "x"]).groupBy(by, "a", "z", "_d").agg(
        F.count("*").alias("_both")).groupBy(by, "a", "z").agg(F.max("_both").alias("_both"))
    scored = close.join(shared, [by, "a", "z"]).join(na, [by, "a"]).join(nz, [by, "z"]).withColumn(
        "dice", 2 * F.col("_both") / (F.col("_na") + F.col("_nz"))).where(F.col("dice") >= dice).select(by, "a", "z", "dice").checkpoint()

    # Even nodes are regions of ``a``, odd ones of ``z``.
    links = scored.select(by, (F.col("a") * 2).cast("long").alias("a"), (F.col("z") * 2 + 1).cast("long").alias("z"))
    nodes = links.select(by, F.col("a").alias("node")).union(links.select(by, "z")).distinct()
    parts = connected_groups(links, nodes, by).where("node % 2 = 0").select(by, (F.col("node") / 2).cast("long").alias("a"), "group")

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        rec = group[by].iloc[0]
        found = kernels.best_pairs(list(group[["a", "z", "dice"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(rec, *x) for x in found], columns=[by, "a", "z", "dice"])

    kinds = {f.name: f.dataType.simpleString() for f in scored.schema}
    return per_group(scored.join(parts, [by, "a"]).select(by, "group", "a", "z", "dice"), [by, "group"], pair,
                     f"{by} {kinds[by]}, a {kinds['a']}, z {kinds['z']}, dice double")
