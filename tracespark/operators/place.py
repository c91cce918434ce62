"""Place and time cells on long tables: one row per cell, lap and bin."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracespark.functions.semantics import ratio

TRACK_CM = 180.0
BIN_CM = 4.0
#: Weights of the smoothing kernel over five bins: exp(-x^2 / 4.5).
KERNEL_WIDTH = 4.5


def with_laps(rows: DataFrame, by: str | list[str], track: float = TRACK_CM, order: str = "frame", position: str = "position_cm") -> DataFrame:
    """A new lap begins where the position falls by over half of the track."""
    keys = [by] if isinstance(by, str) else by
    w = Window.partitionBy(*keys).orderBy(order)
    fell = (F.lag(position).over(w) - F.col(position) > track / 2).cast("int")
    return rows.withColumn("_fell", F.coalesce(fell, F.lit(0))).withColumn(
        "lap", F.sum("_fell").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_fell")


def with_bins(rows: DataFrame, width: float = BIN_CM, n_bins: int | None = None, position: str = "position_cm") -> DataFrame:
    last = (n_bins or int(TRACK_CM / width)) - 1
    return rows.withColumn("bin", F.least(F.greatest(F.floor(F.col(position) / width), F.lit(0)), F.lit(last)))


def binned(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Activity, occupied frames and rate of each bin (per lap if ``by`` has it)."""
    return rows.groupBy(*by, "bin").agg(
        F.sum(value).alias("activity"), F.count("*").alias("occupancy"), F.avg(value).alias("rate"))


def valid_laps(by_lap: DataFrame, n_bins: int, by: list[str]) -> DataFrame:
    """Laps that have every bin."""
    return by_lap.groupBy(*by, "lap").agg(F.count_distinct("bin").alias("_n")).where(F.col("_n") == n_bins).drop("_n")


def rate_map(by_lap: DataFrame, laps: DataFrame, by: list[str]) -> DataFrame:
    """Rates per bin from the valid laps only."""
    return by_lap.join(laps, [*by, "lap"], "left_semi").groupBy(*by, "bin").agg(
        F.sum("activity").alias("activity"), F.sum("occupancy").alias("occupancy"),
        ratio(F.sum("activity"), F.sum("occupancy")).alias("rate"))


def information(maps: DataFrame, by: list[str]) -> DataFrame:
    """Bits per event: sum of p r/m log2(r/m) over occupied bins of positive rate; a mean
    rate m of zero gives a missing value."""
    w = Window.partitionBy(*by)
    p = F.col("occupancy") / F.sum("occupancy").over(w)
    shares = maps.withColumn("_p", p).withColumn("_m", F.sum(F.col("_p") * F.col("rate")).over(w))
    x = ratio(F.col("rate"), F.col("_m"))
    term = F.when((F.col("occupancy") > 0) & (F.col("rate") > 0), F.col("_p") * x * F.log2(x))
    return shares.withColumn("_t", term).groupBy(*by).agg(
        F.when(F.first("_m") != 0, F.coalesce(F.sum("_t"), F.lit(0.0))).alias("info_bits"))


def smoothed_map(maps: DataFrame, by: list[str]) -> DataFrame:
    """Counts and occupancy smoothed over five bins (zero outside), and their ratio as ``smooth``."""
    w = Window.partitionBy(*by).orderBy("bin")
    weights = {k: math.exp(-(k * k) / KERNEL_WIDTH) for k in range(-2, 3)}
    total = sum(weights.values())
    at = lambda c, k: F.col(c) if not k else F.coalesce((F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w), F.lit(0.0))
    smooth = lambda c: sum((at(c, k) * (x / total) for k, x in weights.items()), F.lit(0.0))
    return maps.withColumn("smooth", ratio(smooth("activity"), smooth("occupancy")))


def field_map(maps: DataFrame, by: list[str]) -> DataFrame:
    """The smoothed map over its largest value."""
    top = F.max("smooth").over(Window.partitionBy(*by))
    return smoothed_map(maps, by).withColumn("field", F.when(top == 0, F.col("smooth")).otherwise(ratio(F.col("smooth"), top))).drop("smooth")


def field_peaks(maps: DataFrame, by: list[str], width: float = BIN_CM) -> DataFrame:
    """Peak bin of the smoothed map (of equal ones the first), its centre and its rate; a map
    without values has bin 0 and no position."""
    top = F.max_by("bin", F.when(F.col("smooth").isNotNull(), F.struct("smooth", -F.col("bin"))))
    return smoothed_map(maps, by).groupBy(*by).agg(
        F.coalesce(top, F.lit(0)).cast("long").alias("peak_bin"), ((top + 0.5) * width).alias("position_cm"), F.max("smooth").alias("amplitude"))


def session_metrics(cells: DataFrame, by: list[str], track: float = TRACK_CM, onset: float = 30.0, reward: float = 150.0) -> DataFrame:
    """Share of place cells among a session's cells, and of the place cells' fields in the onset
    and reward zones, with the enrichment over an even spread.

    ``cells``: by, significant, position_cm. Without place cells the zones' shares are missing.
    """
    place = F.coalesce(F.col("significant"), F.lit(False))
    share = lambda c: F.avg(F.when(place & F.col("position_cm").isNotNull(), c.cast("double")))
    early = share((F.col("position_cm") >= 0) & (F.col("position_cm") < onset))
    late = share((F.col("position_cm") >= reward) & (F.col("position_cm") < track))
    return cells.groupBy(*by).agg(
        F.count("*").alias("n_cells"), F.count_if(place).alias("n_place_cells"), (100.0 * F.count_if(place) / F.count("*")).alias("place_cell_percent"),
        early.alias("onset_share"), late.alias("reward_share"), (early / (onset / track)).alias("onset_enrichment"),
        (late / ((track - reward) / track)).alias("reward_enrichment"))


def cohort_metrics(by_lap: DataFrame, laps: DataFrame, cohort: DataFrame, by: list[str], width: float = BIN_CM, lowest: int = 25) -> DataFrame:
    """Metrics of one fixed cohort of cells for each trial type.

    ``by_lap``: by, lap, bin, rate and ``laps``: by, lap (valid), where ``by`` ends with the trial type;
    ``cohort``: by without the type. A type's map is the mean of its laps' rates and every bin
    counts alike; the primary field is the one that holds the map's peak, else the first.

    Returns by, n_laps, info_bits, location_cm, field_width_cm, in_out, odd_even (four laps or
    more), consecutive (two or more).
    """
    own = laps.join(cohort.select(*by[:-1]).distinct(), by[:-1], "left_semi")
    rows = by_lap.join(own, [*by, "lap"], "left_semi")
    maps = rows.groupBy(*by, "bin").agg(F.avg("rate").alias("rate"), F.lit(1.0).alias("occupancy")).withColumn("activity", F.col("rate"))
    counts = own.groupBy(*by).agg(F.count("*").alias("n_laps"))
    peaks = maps.groupBy(*by).agg(F.max_by("bin", F.struct("rate", -F.col("bin"))).alias("peak_bin"))
    fields = tentative_fields(maps, by, lowest=lowest)
    holds = (F.col("peak_bin") >= F.col("start")) & (F.col("peak_bin") <= F.col("end"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(holds.desc(), "field"))
    primary = fields.join(peaks, by).withColumn("_r", first).where("_r = 1").select(*by, "field", "start", "end")
    sizes = field_metrics(primary, maps, by, width).select(*by, F.col("width_cm").alias("field_width_cm"), "in_out")
    odd = stability(rows, own, by).withColumnRenamed("stability", "odd_even")
    near = lap_correlations(rows, own, by).select(*by, "consecutive")
    found = counts.join(information(maps, by), by).join(peaks.select(*by, ((F.col("peak_bin") + 0.5) * width).alias("location_cm")), by)
    for more in (sizes, odd, near):
        found = found.join(more, by, "left")
    return found.withColumns({"odd_even": F.when(F.col("n_laps") >= 4, F.col("odd_even")), "consecutive": F.when(F.col("n_laps") >= 2, F.col("consecutive"))})


def tentative_fields(maps: DataFrame, by: list[str], share: float = 0.25, lowest: int = 25, value: str = "rate") -> DataFrame:
    """Runs of bins over base + share * (peak - base), base: the mean of the lowest bins."""
    from tracespark.operators.behaviour import runs

    w = Window.partitionBy(*by)
    ranked = maps.withColumn("_k", F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), "bin")))
    base = F.avg(F.when(F.col("_k") <= lowest, F.col(value))).over(w)
    limit = base + share * (F.max(value).over(w) - base)
    return runs(ranked.withColumn("_limit", limit), F.coalesce(F.col(value) > F.col("_limit"), F.lit(False)), by, "bin").withColumn(
        "field", F.row_number().over(w.orderBy("start")).cast("long"))


def field_metrics(fields: DataFrame, maps: DataFrame, by: list[str], width: float = BIN_CM, transients: DataFrame | None = None) -> DataFrame:
    """Width, peak, inside/outside ratio and active fraction; the ratio is missing unless
    the outside mean is positive, the fraction without occupancy.

    ``transients`` has the frames of significant activity (by, bin, n); without it the
    fraction is missing.
    """
    whole = maps.groupBy(*by).agg(F.sum("activity").alias("_a"), F.sum("occupancy").alias("_o"))
    counted = maps.join(transients.withColumnRenamed("n", "_n"), [*by, "bin"], "left") if transients is not None else maps.withColumn("_n", F.lit(None).cast("long"))
    inside = fields.join(counted, by).where((F.col("bin") >= F.col("start")) & (F.col("bin") <= F.col("end"))).groupBy(*by, "field", "start", "end").agg(
        F.max("rate").alias("peak"), F.sum("activity").alias("_ia"), F.sum("occupancy").alias("_io"), F.sum("_n").alias("_in"))
    outer = ratio(F.col("_a") - F.col("_ia"), F.col("_o") - F.col("_io"))
    return inside.join(whole, by).select(
        *by, "field", "start", "end", "peak", ((F.col("end") - F.col("start") + 1) * width).alias("width_cm"),
        F.when(outer > 0, ratio(F.col("_ia"), F.col("_io")) / outer).alias("in_out"), ratio(F.col("_in"), F.col("_io")).alias("fraction"))


def stability(by_lap: DataFrame, laps: DataFrame, by: list[str], halves: bool = False) -> DataFrame:
    """Correlation of the mean profiles of odd and even (``halves``: first and last) valid laps."""
    w = Window.partitionBy(*by).orderBy("lap")
    k = F.row_number().over(w)
    n = F.count("*").over(Window.partitionBy(*by))
    side = (k * 2 > n).cast("int") if halves else (k % 2)
    sides = laps.select(*by, "lap", side.alias("_side"))
    means = by_lap.join(sides, [*by, "lap"]).groupBy(*by, "bin").agg(
        F.avg(F.when(F.col("_side") == 1, F.col("rate"))).alias("_a"), F.avg(F.when(F.col("_side") == 0, F.col("rate"))).alias("_z"))
    return means.groupBy(*by).agg(F.when(F.count(F.col("_a") + F.col("_z")) >= 3, F.corr("_a", "_z")).alias("stability"))


def lap_correlations(by_lap: DataFrame, laps: DataFrame, by: list[str]) -> DataFrame:
    """Mean correlation of consecutive laps and of all pairs of laps; a constant lap counts as 0.

    All pairs come from the sum of the unit vectors of the laps, (|sum|^2 - n) / (n (n - 1)),
    so that no pair of laps is made.
    """
    w = Window.partitionBy(*by, "lap")
    rows = by_lap.join(laps.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("lap"))), [*by, "lap"])
    centred = rows.withColumn("_c", F.col("rate") - F.avg("rate").over(w))
    unit = centred.withColumn("_u", F.coalesce(ratio(F.col("_c"), F.sqrt(F.sum(F.col("_c") ** 2).over(w))), F.lit(0.0)))
    moved = unit.select(*by, "bin", (F.col("_k") + 1).alias("_k"), F.col("_u").alias("_before"))
    pairs = unit.join(moved, [*by, "bin", "_k"]).groupBy(*by, "_k").agg(F.sum(F.col("_u") * F.col("_before")).alias("_r"))
    consecutive = pairs.groupBy(*by).agg(F.avg("_r").alias("consecutive"))
    n = unit.groupBy(*by).agg(F.count_distinct("_k").alias("_n"), F.sum(F.col("_u") ** 2).alias("_own"))
    total = unit.groupBy(*by, "bin").agg(F.sum("_u").alias("_s")).groupBy(*by).agg(F.sum(F.col("_s") ** 2).alias("_all"))
    return consecutive.join(n, by).join(total, by).select(
        *by, "consecutive", ratio(F.col("_all") - F.col("_own"), F.col("_n") * (F.col("_n") - 1)).alias("all_pairs"))


def significant(
    fields: DataFrame, by: list[str], width: float | None = 18.0, ratio_limit: float | None = 2.5, peak: float | None = 0.1,
    fraction: float | None = 0.1,
) -> DataFrame:
    """A cell is significant if one of its fields passes all four limits (None: no limit);
    missing values fail."""
    limits = {"width_cm": width, "peak": peak, "fraction": fraction}
    ok = F.lit(True) if ratio_limit is None else F.col("in_out") > ratio_limit
    for name, least in limits.items():
        if least is not None:
            ok = ok & (F.col(name) >= least)
    return fields.groupBy(*by).agg(F.bool_or(F.coalesce(ok, F.lit(False))).alias("significant"))


def primary_field(fields: DataFrame, peaks: DataFrame, by: list[str]) -> DataFrame:
    """The field that holds the peak bin, else the one of the largest ratio."""
    holds = (F.col("peak_bin") >= F.col("start")) & (F.col("peak_bin") <= F.col("end"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(holds.desc(), F.col("in_out").desc_nulls_last(), "field"))
    return fields.join(peaks, by).withColumn("_r", rank).where("_r = 1").drop("_r")
