"""Event responses of units: statistics, classes, validity, grid blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespark.functions.semantics import ratio


def pooled_sd(sd_before: Column, sd_after: Column, n_before: int, n_after: int) -> Column:
    """Weights are the frames per window, each sd covers all kept trials."""
    return F.sqrt(((n_before - 1) * sd_before**2 + (n_after - 1) * sd_after**2) / (n_before + n_after - 2))


def event_response(aligned: DataFrame, by: list[str], n_before: int, n_after: int, value: str = "value", event: str = "event_frame", step: float | None = None) -> DataFrame:
    """Baseline and response of each unit over its complete events.

    ``aligned`` has ``rel`` from -n_before to n_after - 1; an event with a missing value
    is dropped. Means are means over all kept frames of the window. Where values are known to
    be whole numbers of ``step``, sums are taken in whole numbers, so that units of equal
    values are equal to the last bit, in whatever order their rows come.
    """
    whole = aligned.groupBy(*by, event).agg(F.count(value).alias("_n")).where(F.col("_n") == n_before + n_after).drop("_n")
    rows = aligned.join(whole, [*by, event])
    before, after = F.when(F.col("rel") < 0, F.col(value)), F.when(F.col("rel") >= 0, F.col(value))
    mean, sd = (F.avg, F.stddev_samp) if step is None else _whole_number_moments(step)
    stats = rows.groupBy(*by).agg(
        F.count_distinct(event).alias("n_kept"), mean(before).alias("baseline_mean"), mean(after).alias("response_mean"),
        sd(before).alias("_b"), sd(after).alias("_r"))
    amplitude = F.col("response_mean") - F.col("baseline_mean")
    return stats.withColumns({
        "response_amplitude": amplitude,
        "response_ratio": ratio(F.col("response_mean"), F.col("baseline_mean")),
        "effect_size": ratio(amplitude, pooled_sd(F.col("_b"), F.col("_r"), n_before, n_after)),
    }).drop("_b", "_r")


def _whole_number_moments(step: float):
    """Mean and sample deviation of whole numbers of ``step`` from sums that are exact."""
    number = lambda x: F.round(x / step).cast("decimal(15,0)")
    total = lambda x: F.sum(number(x)).cast("decimal(19,0)")

    def mean(x: Column) -> Column:
        return total(x).cast("double") / F.count(x) * step

    def sd(x: Column) -> Column:
        n = F.count(x).cast("decimal(10,0)")
        spread = n * F.sum(number(x) * number(x)).cast("decimal(28,0)") - total(x) * total(x)
        return F.when(F.count(x) > 1, F.sqrt(spread.cast("double") / (F.count(x) * (F.count(x) - 1)).cast("double")) * step)

    return mean, sd


def classified(stats: DataFrame, high: Column, low: Column, effect: float = 0.05, edge: Column | None = None) -> DataFrame:
    """Up, Down or Stable by the null's percentiles, the effect size and the grid's edge."""
    inner = ~edge if edge is not None else F.lit(True)
    up = (F.col("response_amplitude") > high) & (F.col("effect_size") > effect) & inner
    down = (F.col("response_amplitude") < low) & (F.col("effect_size") < -effect) & inner
    return stats.withColumn("class", F.when(up, "Up").when(down, "Down").otherwise("Stable"))


def ratio_class(value: Column, limit: float = 1.12) -> Column:
    return F.when(value > limit, "pyrUp").when(value < 1 / limit, "pyrDown").when(value.isNotNull(), "pyrStable")


def dual_classes(
    stats: DataFrame, high: Column, low: Column, effect: float, up: float, down: float, most: dict[str, float | None], means: dict[str, str],
) -> DataFrame:
    """Up, Down or Stable of two signals of a unit, where both are valid.

    The first signal is judged by its amplitude against its null's percentiles and by its
    effect size, the second by its ratio. A signal is valid if its mean lies between zero and
    its limit in ``most`` (None: no limit), both not included; a unit with an invalid signal
    has no class. ``means`` names the columns of the means.

    Returns ``stats`` plus valid, first_class, second_class, label (the two joined).
    """
    valid = F.lit(True)
    for signal, limit in most.items():
        if limit is not None:
            valid = valid & F.coalesce((F.col(means[signal]) > 0) & (F.col(means[signal]) < limit), F.lit(False))
    first = F.when((F.col("response_amplitude") > high) & (F.col("effect_size") > effect), "Up").when(
        (F.col("response_amplitude") < low) & (F.col("effect_size") < -effect), "Down").otherwise("Stable")
    second = F.when(F.col("ratio") > up, "Up").when(F.col("ratio") < down, "Down").otherwise("Stable")
    return stats.withColumn("valid", valid).withColumns({"first_class": F.when(valid, first), "second_class": F.when(valid, second)}).withColumn(
        "label", F.when(valid, F.concat_ws("/", "first_class", "second_class")))


#: Limits of a soma's shape and activity.
SOMA = {"least_pixels": 100, "most_pixels": 600, "compactness": 0.1, "hollowness": 0.25, "area": 2000, "aspect": 3.0}
ACTIVE = {"skewness": 0.8, "least_frames": 15, "most_frames": 150}


def is_soma(limits: dict[str, float] = SOMA) -> Column:
    """Whether a region's shape columns (n_pixels, area, compactness, aspect, hollowness) are a
    soma's; limits are not included and missing values fail."""
    return F.coalesce(
        (F.col("n_pixels") > limits["least_pixels"]) & (F.col("n_pixels") < limits["most_pixels"]) & (F.col("area") < limits["area"])
        & (F.col("compactness") > limits["compactness"]) & (F.col("aspect") < limits["aspect"]) & (F.col("hollowness") > limits["hollowness"]), F.lit(False))


def is_active(skew: Column, longest: Column, limits: dict[str, float] = ACTIVE) -> Column:
    """Skewed, and active for long, but not for too long, at a time."""
    return F.coalesce((skew > limits["skewness"]) & (longest > limits["least_frames"]) & (longest < limits["most_frames"]), F.lit(False))


def valid_profile(profile: Column, least: float, most: float) -> Column:
    """Not empty, all finite, and within limits."""
    whole = (F.size(profile) > 0) & F.forall(profile, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & (F.array_min(profile) >= least) & (F.array_max(profile) <= most), F.lit(False))


def block_pixels(masks: DataFrame, side: int = 16, by: tuple[str, ...] = ("rec", "mask")) -> DataFrame:
    """Pixels of a mask in each grid block."""
    return masks.groupBy(*by, (F.col("y") / side).cast("int").alias("gy"), (F.col("x") / side).cast("int").alias("gx")).agg(
        F.count("*").alias("n_pixels"))


def block_overlaps(a: DataFrame, z: DataFrame, side: int = 16, by: tuple[str, ...] = ("rec",), least: int = 1) -> DataFrame:
    """Pixels (by, y, x) of two masks and of their intersection in each grid block that has
    any, and whether the block is valid: at least ``least`` pixels of the first mask."""
    keys = [*by, "y", "x"]
    both = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(z.select(*keys).distinct().withColumn("_z", F.lit(1)), keys, "full")
    return both.groupBy(*by, F.floor(F.col("y") / side).cast("int").alias("gy"), F.floor(F.col("x") / side).cast("int").alias("gx")).agg(
        F.count("_a").alias("n_a"), F.count("_z").alias("n_z"), F.count(F.col("_a") + F.col("_z")).alias("n_both")).withColumn("valid", F.col("n_a") >= least)
