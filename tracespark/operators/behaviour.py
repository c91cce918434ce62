"""Behaviour: wheel, trial metrics, trial selection, learning, session summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracespark.functions.semantics import median, ratio

#: Limits of a good trial.
GOOD = {"iti_ms": 2000.0, "first_lick_ms": 1500.0, "duration_ms": 8000.0, "max_speed": 65.0, "mad": 2.0, "slow_speed": 10.0, "slow_share": 0.3}


def ordered(by: str | list[str], order: str):
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def up_to_now(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def wheel_distance(wheel: DataFrame, by: str = "rec", t: str = "t", tick: str = "tick", reset: float = 10.0) -> DataFrame:
    """Distance since the last reset (a drop by over ``reset`` ticks), and the continuous
    one, which adds what had been reached before each backward step."""
    w = ordered(by, t)
    fell = F.col(tick) - F.lag(tick).over(w) < -reset
    back = F.col(tick) < F.lag(tick).over(w)
    return (
        wheel.withColumns({"_reset": F.coalesce(fell.cast("int"), F.lit(0)),
                           "_lost": F.when(back, F.lag(tick).over(w)).otherwise(0.0)})
        .withColumns({"segment": F.sum("_reset").over(up_to_now(w)),
                      "continuous": F.col(tick) + F.sum("_lost").over(up_to_now(w))})
        .withColumn("distance", F.col(tick) - F.first(tick).over(up_to_now(ordered([by, "segment"], t))))
        .drop("_reset", "_lost")
    )


def resampled(rows: DataFrame, step: float, by: str = "rec", t: str = "t", value: str = "value") -> DataFrame:
    """Linear interpolation at the multiples of ``step`` inside each recording.

    Each interval between neighbours gives its own grid points, so that the grid is
    made where the samples are.
    """
    w = ordered(by, t)
    gaps = rows.select(by, F.col(t).alias("_a"), F.col(value).alias("_v"), F.lead(t).over(w).alias("_z"), F.lead(value).over(w).alias("_w"))
    first = F.ceil(F.col("_a") / step)
    last = F.ceil(F.col("_z") / step) - 1
    grid = gaps.where("_z is not null").where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    at = F.col("k") * step
    return grid.select(by, at.alias(t), (
        F.col("_v") + (F.col("_w") - F.col("_v")) * (at - F.col("_a")) / (F.col("_z") - F.col("_a"))).alias(value))


def smooth_speed(rows: DataFrame, half: int = 50, by: str = "rec", t: str = "t", value: str = "distance") -> DataFrame:
    """Central difference (one-sided at the ends), then a mean over 2 * ``half`` samples, with
    the ends reflected (d c b a | a b c d | d c b a)."""
    w = ordered(by, t)
    lo, hi = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    a, z = F.coalesce(F.lag(t).over(w), F.col(t)), F.coalesce(F.lead(t).over(w), F.col(t))
    raw = rows.withColumns({"_raw": ratio(hi - lo, z - a), "_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(by))})
    places = F.array_compact(F.array(
        F.col("_k"), F.when(F.col("_k") <= half, 1 - F.col("_k")), F.when(F.col("_k") > F.col("_n") - half, 2 * F.col("_n") + 1 - F.col("_k"))))
    padded = raw.withColumn("_p", F.explode(places))
    mean = F.avg("_raw").over(Window.partitionBy(by).orderBy("_p").rowsBetween(-half, half - 1))
    return padded.withColumn("speed", mean).where("_p = _k").drop("_raw", "_k", "_n", "_p")


def runs(rows: DataFrame, flag: Column, by: list[str], order: str) -> DataFrame:
    """Contiguous runs of a flag: first, last and length, by difference of row numbers."""
    numbered = rows.select(*by, order, flag.alias("_flag"), F.row_number().over(Window.partitionBy(*by).orderBy(order)).alias("_n"))
    on = numbered.where("_flag").withColumn("_run", F.col("_n") - F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return on.groupBy(*by, "_run").agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length")).drop("_run")


def online_onsets(rows: DataFrame, by: list[str], t: str = "t", speed: str = "value", fast: float = 10.0, streak: int = 4, gap: float = 30.0) -> DataFrame:
    """First sample with more than ``streak`` fast samples in a row and no long gap in between."""
    w = Window.partitionBy(*by).orderBy(t)
    broken = (F.col(speed) <= fast) | F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(False))
    ids = rows.withColumn("_broken", broken.cast("int")).withColumn("_streak", F.sum("_broken").over(up_to_now(w)))
    place = F.row_number().over(Window.partitionBy(*by, "_streak").orderBy(t))
    return ids.where(F.col(speed) > fast).withColumn("_k", place).where(F.col("_k") > streak).groupBy(*by).agg(F.min(t).alias("onset"))


def first_after(trials: DataFrame, licks: DataFrame, threshold: float, by: list[str], rel: str = "rel") -> DataFrame:
    """First lick at or after a threshold; trials without one keep a missing value."""
    late = licks.where(F.col(rel) >= threshold).groupBy(*by).agg(F.min(rel).alias("first_lick"))
    return trials.join(late, by, "left")


def lick_index(licks: DataFrame, by: list[str], split: Column) -> DataFrame:
    """Licks after the split over all licks; missing without licks."""
    return licks.groupBy(*by).agg(ratio(F.sum(split.cast("double")), F.count("*")).alias("lick_index"))


def valid_trial(rewarded: Column, non_stop: Column, reward_ms: Column, limit: float | None = None) -> Column:
    """Rewarded, without non-stop flags, and rewarded early enough (None: no limit)."""
    early = F.lit(True) if limit is None else reward_ms < limit
    return F.coalesce(rewarded & ~non_stop & early, F.lit(False))


def reject_reasons(reasons: dict[str, Column]) -> Column:
    """Comma-joined names of the reasons that hold."""
    return F.concat_ws(", ", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()])))


def good_trials(trials: DataFrame, by: str = "rec", limits: dict | None = None) -> DataFrame:
    """Reasons against a trial, from its metrics.

    Expects iti, first_lick, duration, max_speed, mean_speed, slow_share, n_samples and
    valid; the limit on the mean speed is median - 2 MAD of the recording.
    """
    x = GOOD | (limits or {})
    mid = trials.groupBy(by).agg(median("mean_speed").alias("_mid"))
    spread = trials.join(mid, by).groupBy(by).agg(
        F.first("_mid").alias("_mid"), median(F.abs(F.col("mean_speed") - F.col("_mid"))).alias("_mad"))
    reasons = {
        "invalid": ~F.col("valid"),
        "few samples": F.col("n_samples") < 2,
        "iti": F.coalesce(F.col("iti") >= x["iti_ms"], F.lit(True)),
        "early lick": F.coalesce(F.col("first_lick") <= x["first_lick_ms"], F.lit(True)),
        "long": F.coalesce(F.col("duration") >= x["duration_ms"], F.lit(True)),
        "slow": F.col("max_speed") < x["max_speed"],
        "slow mean": F.col("mean_speed") <= F.col("_mid") - x["mad"] * F.col("_mad"),
        "stops": F.col("slow_share") >= x["slow_share"],
    }
    return trials.join(spread, by).withColumn("reasons", reject_reasons(reasons)).withColumn(
        "good", F.col("reasons") == "").drop("_mid", "_mad")


def learning_stage(days: DataFrame, met: Column, streak: int = 2, by: str = "anm", order: str = "k") -> DataFrame:
    """Stage by the first run of ``streak`` days that meet the criteria.

    Days up to the first one of the run are "learning", later ones "learned"; without
    such a run all are "learning" and the days since are missing.
    """
    ahead = ordered(by, order).rowsBetween(0, streak - 1)
    begins = (F.min(met.cast("int")).over(ahead) == 1) & (F.count("*").over(ahead) == streak)
    marked = days.withColumn("_begins", begins)
    first = F.min(F.when(F.col("_begins"), F.col(order))).over(Window.partitionBy(by))
    return marked.withColumn("_day", first).withColumns({
        "stage": F.when(F.col(order) > F.col("_day"), "learned").otherwise("learning"),
        "since": F.col(order) - F.col("_day"),
    }).drop("_begins", "_day")


def treatment_days(days: DataFrame, treated: Column, by: str = "anm", date: str = "date") -> DataFrame:
    """Treated dates of an animal so far, today's included; missing on untreated dates."""
    dates = days.groupBy(by, date).agg(F.max(treated.cast("int")).alias("_treated"))
    counted = dates.withColumn("_n", F.sum("_treated").over(up_to_now(ordered(by, date))))
    return days.join(counted, [by, date]).withColumn("treatment_day", F.when(F.col("_treated") == 1, F.col("_n"))).drop("_treated", "_n")


def median_split(rows: DataFrame, value: str, by: str, low: str, high: str) -> DataFrame:
    """Rows at or below their recording's median are ``low``, others ``high``; missing values have no side."""
    mid = rows.groupBy(by).agg(median(value).alias("_mid"))
    return rows.join(mid, by).withColumn("side", F.when(F.col(value) <= F.col("_mid"), low).when(F.col(value) > F.col("_mid"), high)).drop("_mid")


def controls(trials: DataFrame, flag: Column, lag: int = 1, by: str = "rec", order: str = "trial") -> DataFrame:
    """stim, control (``lag`` trials after a stimulus, itself none) or neither."""
    w = ordered(by, order)
    return trials.withColumn("_flag", flag).withColumn("_was", F.coalesce(F.lag("_flag", lag).over(w), F.lit(False))).withColumn(
        "label", F.when(F.col("_flag"), "stim").when(F.col("_was"), "control").otherwise("none")).drop("_flag", "_was")


def speed_tests(rows: DataFrame, by: str) -> DataFrame:
    """Student's t of the two groups' speeds in each bin: by, bin, n0, n1, m0, m1, t, df, p."""
    from tracespark.operators.stats import two_sample_t, with_p

    return with_p(two_sample_t(rows, [by, "bin"], "group", "speed", equal=True), "t")


def speed_gated(rows: DataFrame, by: str, tolerance: float, level: float = 0.05) -> DataFrame:
    """``speed_matched`` for the recordings in which any bin's speeds differ with p below
    ``level``; the others keep every trial."""
    return speed_matched(rows, by, tolerance, speed_tests(rows, by).where(F.col("p") < level))


def speed_matched(rows: DataFrame, by: str, tolerance: float, significant: DataFrame | None = None) -> DataFrame:
    """Trials of two groups that stay within the other group's mean +- tolerance * sd.

    ``rows``: by, group (0, 1), trial, bin, speed. Bounds are inclusive, sds are those of
    the population. ``significant`` (by) names the recordings to thin out (None: all);
    the others keep every trial.
    """
    stats = rows.groupBy(by, "group", "bin").agg(F.avg("speed").alias("_m"), F.stddev_pop("speed").alias("_sd"))
    other = stats.withColumn("group", 1 - F.col("group"))
    inside = F.abs(F.col("speed") - F.col("_m")) <= tolerance * F.col("_sd")
    kept = rows.join(other, [by, "group", "bin"]).groupBy(by, "group", "trial").agg(F.bool_and(inside).alias("kept"))
    if significant is not None:
        named = significant.select(by).distinct().withColumn("_thin", F.lit(True))
        kept = kept.join(named, by, "left").withColumn("kept", F.col("kept") | F.col("_thin").isNull()).drop("_thin")
    return kept
