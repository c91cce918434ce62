"""Pulse stimulation: trains of cycles in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracespark.functions.semantics import finite, median, ratio
from tracespark.operators.timejoin import asof


def cycle_gaps(cycles: DataFrame, by: list[str], block: str = "block", positive: bool = False) -> DataFrame:
    """Gap from a cycle's end to the next start in its block; without a next one the
    block's median gap, else that of all blocks of the recording. With ``positive``, a gap of
    zero or less counts as none."""
    w = Window.partitionBy(*by, block).orderBy("start")
    gap = F.lead("start").over(w) - F.col("end")
    own = cycles.withColumn("_gap", F.when(gap > 0, gap) if positive else gap)
    in_block = own.groupBy(*by, block).agg(median("_gap").alias("_block"))
    overall = own.groupBy(*by).agg(median("_gap").alias("_all"))
    return own.join(in_block, [*by, block]).join(overall, by).withColumn("gap", F.coalesce("_gap", "_block", "_all")).drop("_gap", "_block", "_all")


def cycle_dff(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(F - F0) / F0 of a cycle's frames, F0: the mean of its finite frames before onset
    (rel < 0); cycles of F0 = 0 are dropped, and so are those without a baseline."""
    base = rows.where("rel < 0").groupBy(*by).agg(F.avg(value).alias("_f0")).where("_f0 <> 0")
    return rows.join(base, by).withColumn("dff", ratio(F.col(value) - F.col("_f0"), F.col("_f0"))).drop("_f0")


def anchor_frames(frames: DataFrame, cycles: DataFrame, by: list[str], anchor: str, dark: str = "dark") -> DataFrame:
    """Each cycle with ``onset``, the frame that its trace is aligned to.

    ``anchor`` is "pulse", the frame in which the cycle's first pulse starts, or "cutoff", the first
    frame in the cycle at which ``dark`` goes on; a cycle without one drops out. The frame of a
    time is the last one that starts at or before it.
    """
    times = frames.select(*by, "t", "frame")
    at = lambda rows, c, name: asof(rows.withColumn("t", F.col(c)), times, by).withColumn(name, F.col("at_frame")).drop("t", "at_t", "at_frame")
    if anchor == "pulse":
        return at(cycles, "first_pulse", "onset").where("onset is not null")
    if anchor != "cutoff":
        raise ValueError("anchor has to be pulse or cutoff")
    spans = at(at(cycles, "start", "_from"), "end", "_to").withColumn("_from", F.coalesce("_from", F.lit(0)))
    onsets = rising_edges(frames.select(*by, "frame", dark), by, dark).select(*by, F.col("frame").alias("_from"))
    found = asof(spans, onsets, by, "_from", "on_", forward=True)
    return found.withColumn("onset", F.col("on__from")).where("onset <= _to").drop("on__from", "_from", "_to")


def anchored_dff(
    frames: DataFrame, cycles: DataFrame, by: list[str], anchor: str = "pulse", baseline_s: float = 1.0, value: str = "value", condition: str = "condition",
) -> DataFrame:
    """dF/F of stimulation cycles around their first pulse or their first dark frame.

    ``frames``: by, frame, t (ms), value, dark; ``cycles``: by, block, cycle, condition, start, end, first_pulse
    (ms). The frame rate is that of the recording's median step. A trace begins ``baseline_s``
    before the onset and is as long as its own cycle and the gap behind it (``cycle_gaps``, of
    positive gaps). F0 is the mean of the known frames before the onset. Cycles that
    leave the movie, have no baseline or an F0 of zero are dropped; positions that any cycle of
    a condition lacks, or has no value for, are missing in all of them.

    Returns by, cycle, condition, rel, dff, f0.
    """
    step = F.col("t") - F.lag("t").over(Window.partitionBy(*by).orderBy("frame"))
    rates = frames.select(*by, "frame", step.alias("_step")).groupBy(*by).agg(
        (1000.0 / median(F.when(F.col("_step") > 0, F.col("_step")))).alias("_rate"), (F.max("frame") + 1).alias("_n"))
    sized = cycle_gaps(cycles, by, positive=True).join(rates, by).withColumns({
        "_pre": F.rint(baseline_s * F.col("_rate")).cast("long"),
        "_post": F.ceil((F.col("end") - F.col("start") + F.col("gap")) / 1000 * F.col("_rate")).cast("long")})
    inside = (F.col("onset") >= F.col("_pre")) & (F.col("onset") + F.col("_post") < F.col("_n"))
    placed = anchor_frames(frames, sized, by, anchor).where(inside).select(
        *by, "cycle", condition, "onset", F.explode(F.sequence(-F.col("_pre"), F.col("_post"))).alias("rel")).withColumn("frame", F.col("onset") + F.col("rel"))
    rows = placed.join(frames.select(*by, "frame", finite(F.col(value)).alias("_v")), [*by, "frame"], "left")
    base = rows.where("rel < 0").groupBy(*by, "cycle").agg(F.avg("_v").alias("f0")).where("f0 <> 0")
    traces = rows.join(base, [*by, "cycle"]).withColumn("dff", (F.col("_v") - F.col("f0")) / F.col("f0"))
    cycles_of = traces.groupBy(*by, condition).agg(F.count_distinct("cycle").alias("_cycles"))
    known = F.count("dff").over(Window.partitionBy(*by, condition, "rel"))
    return traces.join(cycles_of, [*by, condition]).select(
        *by, "cycle", condition, "rel", F.when(known == F.col("_cycles"), F.col("dff")).alias("dff"), "f0")


def blanked_positions(rows: DataFrame, condition: list[str], value: str = "dff") -> DataFrame:
    """Positions that are missing in any cycle of a condition are missing in all of them."""
    gone = F.max(F.col(value).isNull().cast("int")).over(Window.partitionBy(*condition, "rel"))
    return rows.withColumn(value, F.when(gone == 0, F.col(value)))


def rising_edges(rows: DataFrame, by: list[str], flag: str, order: str = "frame") -> DataFrame:
    """Frames where a flag goes on."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_was", F.coalesce(F.lag(flag).over(w), F.lit(False))).where(F.col(flag) & ~F.col("_was")).drop("_was")


def condition_profile(rows: DataFrame, condition: list[str], value: str = "dff") -> DataFrame:
    """Mean and SEM per condition and position; the SEM needs two cycles."""
    n = F.count(value)
    return rows.groupBy(*condition, "rel").agg(
        F.avg(value).alias("mean"), F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).alias("sem"), n.alias("n"))
