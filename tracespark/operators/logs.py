"""Behaviour logs: typed lines, trials, counter wraps, dropped frames, session lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How wheel counts become a speed.
WHEEL_SCALE = 0.04 * 50
#: Fixed value: the longest gap between two frames, in ms.
FRAME_GAP = 50.0


def parsed(lines: DataFrame) -> DataFrame:
    """rec, line_no, raw -> tag, t_ms, f (the fields behind tag and time)."""
    parts = F.split("raw", ",")
    return lines.select(
        "rec", "line_no", "raw", F.element_at(parts, 1).alias("tag"),
        F.try_element_at(parts, F.lit(2)).try_cast("double").alias("t_ms"), F.slice(parts, 3, 1000).alias("f"))


def malformed(lines: DataFrame) -> Column:
    """Fewer than two fields, or a time that is no number."""
    parts = F.split("raw", ",")
    return (F.size(parts) < 2) | F.try_element_at(parts, F.lit(2)).try_cast("double").isNull()


def typed(log: DataFrame, tag: str) -> DataFrame:
    """Events of one tag with the fields and limits that the tag has."""
    rows = log.where(F.col("tag") == tag)
    field = lambda k: F.try_element_at("f", F.lit(k))
    if tag in ("$LE", "$PE"):
        return rows.where(field(1) == "1")
    if tag == "$FM":
        return rows.where(field(1) == "0")
    if tag == "$WE":
        return rows.withColumn("speed", field(1).try_cast("double") * WHEEL_SCALE)
    return rows


#: Lines of a recording that one task numbers at once.
SLOT_LINES = 1 << 20


def running(log: DataFrame, sums: dict[str, Column], by: str = "rec", order: str = "line_no", slot_lines: int = SLOT_LINES) -> DataFrame:
    """Adds, for each named number of a line, its sum over all lines up to this one.

    A log is cut into slots of ``slot_lines`` line numbers. Sums run inside a slot, and the
    sums of the slots before it are added: only those, a row for each slot, are ordered by
    recording alone.
    """
    slot = F.floor(F.col(order) / slot_lines)
    rows = log.withColumns({"_slot": slot, **{f"_x_{n}": c for n, c in sums.items()}})
    names = {by: "_of", "_slot": "_of_slot"}
    before = Window.partitionBy(by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(by, "_slot").agg(*[F.sum(f"_x_{n}").alias(f"_x_{n}") for n in sums]).select(
        by, "_slot", *[F.coalesce(F.sum(f"_x_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums]).withColumnsRenamed(names)
    inside = Window.partitionBy(by, "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumns({n: F.sum(f"_x_{n}").over(inside) for n in sums}).join(
        carried, F.col(by).eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_of_slot")))
    return joined.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in sums}).drop(
        "_slot", *names.values(), *[f"_x_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def with_trials(log: DataFrame, free: tuple[str, ...] = ("$PP", "$BT"), slot_lines: int = SLOT_LINES) -> DataFrame:
    """Trial number of each line: a trial ends with $NT, the first starts with $TR.

    Lines before a recording's first $TR are dropped, but for tags in ``free``.
    """
    ends, starts = ((F.col("tag") == tag).cast("long") for tag in ("$NT", "$TR"))
    counted = running(log, {"trial": F.coalesce(ends, F.lit(0)), "_begun": F.coalesce(starts, F.lit(0))}, slot_lines=slot_lines)
    own = F.coalesce(ends, F.lit(0))  # a trial's last line belongs to it
    return counted.withColumn("trial", F.col("trial") - own).where((F.col("_begun") > 0) | F.col("tag").isin(*free)).drop("_begun")


def unwrapped(log: DataFrame, period: float, t: str = "t_ms", by: str = "rec", order: str = "line_no", slot_lines: int = SLOT_LINES) -> DataFrame:
    """Undo counter wraps: a drop of over half the period adds a period to all later lines.

    The line before a slot's first one comes from the slot before, as its last line.
    """
    slot = F.floor(F.col(order) / slot_lines)
    rows = log.withColumn("_slot", slot)
    names = {by: "_of", "_slot": "_of_slot"}
    ends = rows.groupBy(by, "_slot").agg(F.max_by(F.struct(F.col(t).alias("t")), order).alias("_end")).select(
        by, "_slot", F.lag("_end").over(Window.partitionBy(by).orderBy("_slot"))["t"].alias("_end")).withColumnsRenamed(names)
    inside = Window.partitionBy(by, "_slot").orderBy(order)
    last = F.when(F.row_number().over(inside) == 1, F.col("_end")).otherwise(F.lag(t).over(inside))
    linked = rows.join(ends, F.col(by).eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_of_slot"))).withColumn("_last", last)
    fell = F.coalesce((F.col("_last") - F.col(t) > period / 2).cast("long"), F.lit(0))
    counted = running(linked.drop("_slot", *names.values(), "_end"), {"_fell": fell}, by, order, slot_lines)
    return counted.withColumn(t, F.col(t) + F.col("_fell") * period).drop("_fell", "_last")


def filled_frames(frames: DataFrame, by: str = "rec", t: str = "t", gap: float = FRAME_GAP) -> DataFrame:
    """Frame times with the dropped ones put in: while a gap is over the limit, its
    midpoint is inserted and the right half looked at (b - g/2, b - g/4, ...)."""
    w = Window.partitionBy(by).orderBy(t)
    nxt = F.lead(t).over(w)
    width = nxt - F.col(t)
    count = F.when(width > gap, F.ceil(F.log2(width / gap))).otherwise(0).cast("int")
    grown = frames.withColumns({"_next": nxt, "_n": F.coalesce(count, F.lit(0))}).withColumn(
        "_more", F.when(F.col("_n") > 0, F.transform(
            F.sequence(F.lit(1), F.col("_n")), lambda i: F.col("_next") - (F.col("_next") - F.col(t)) / F.pow(F.lit(2.0), i))))
    return frames.select(by, t, F.lit(False).alias("inserted")).union(
        grown.select(by, F.explode("_more").alias(t), F.lit(True).alias("inserted")))


def block_of(trials: DataFrame, blocks: DataFrame, by: str = "rec", t: str = "t") -> DataFrame:
    """Latest block at or before a trial; earlier trials get the first one; none: 1."""
    from tracespark.operators.timejoin import asof

    first = blocks.groupBy(by).agg(F.min_by("block", t).alias("_first"))
    found = asof(trials, blocks, [by], t, "b_")
    return found.join(first, by, "left").withColumn(
        "block", F.coalesce("b_block", "_first", F.lit(1)).cast("long")).drop("b_block", f"b_{t}", "_first")


def treatments(days: DataFrame) -> DataFrame:
    """Labels of sessions from parallel arrays, normalised by prefix.

    Fails if a session has labels that don't agree.
    """
    label = F.when(F.col("x.label").startswith("ctrl"), "control").when(
        F.col("x.label").startswith("base"), "baseline").otherwise(F.lower("x.label"))
    each = days.select(F.explode(F.arrays_zip("session", "label")).alias("x")).select(
        F.col("x.session").alias("session"), label.alias("label"))
    return each.groupBy("session").agg(F.min("label").alias("label"), F.count_distinct("label").alias("_n")).withColumn(
        "label", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("labels conflict: "), "session"))).otherwise(F.col("label"))
    ).drop("_n")


def families(lists: DataFrame) -> DataFrame:
    """The sorted set of lists (family) that a session appears in."""
    return lists.groupBy("session").agg(F.array_sort(F.collect_set("family")).alias("families"))


def with_doses(days: DataFrame, pattern: str, least: float = 1.0) -> DataFrame:
    """Days whose labels hold the pattern and whose lowest known dose is large enough."""
    doses = F.filter("conc", lambda x: x.isNotNull() & ~F.isnan(x))
    return days.where(F.exists("label", lambda x: x.contains(pattern)) & (F.array_min(doses) >= least))
