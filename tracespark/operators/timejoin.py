"""Joins on time: nearest, as-of, interval and peri-event joins.

Nearest and as-of joins order the rows of a slot of a recording (``by``) and carry what
lies in other slots; the others meet on whole frame numbers or time slots. None compares all
rows of one side with all of the other, and none takes a long recording into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grid rows of a recording that one task orders at once, with the rows that fall among them.
SLOT_ROWS = 1 << 15


def _stacked(rows: DataFrame, grid: DataFrame, by: list[str], t: str) -> DataFrame:
    """Both sides as one table; the other side's columns are null structs."""
    mine = [c for c in rows.columns if c not in (*by, t)]
    theirs = [c for c in grid.columns if c not in by]
    own = F.struct(F.lit(1).alias("_own"), *mine)
    point = F.struct(*theirs)
    return rows.select(*by, F.col(t), own.alias("_row"), F.lit(None).cast(_type(grid.select(point.alias("x")))).alias("_grid")).unionByName(
        grid.select(*by, F.col(t), F.lit(None).cast(_type(rows.select(own.alias("x")))).alias("_row"), point.alias("_grid")))


def _type(df: DataFrame):
    return df.schema[0].dataType


def _same(names: dict[str, str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(z)) for a, z in names.items()])


def _renamed(by: list[str]) -> dict[str, str]:
    return {c: f"_of_{c}" for c in by}


def _long(grid: DataFrame, by: list[str], t: str, slot_rows: int) -> DataFrame:
    """Recordings of over ``slot_rows`` grid rows: their key, span of time and number of slots.

    At most one row for each ``slot_rows`` rows of the grid, which bounds its broadcast.
    """
    at = F.col(t).cast("double")
    return grid.groupBy(*by).agg(F.count("*").alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi")).where(
        (F.col("_n") > slot_rows) & (F.col("_hi") > F.col("_lo"))).withColumn("_n", F.ceil(F.col("_n") / slot_rows)).withColumnsRenamed(_renamed(by))


def _slotted(rows: DataFrame, long: DataFrame, by: list[str], t: str) -> DataFrame:
    """``rows`` with ``_slot``: long recordings are cut into spans of equal time, from the grid's
    first row to its last; others are slot 0 as a whole."""
    place = F.floor((F.col(t).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_n"))
    slot = F.when(F.col("_n").isNull() | place.isNull(), 0).otherwise(F.least(F.greatest(place, F.lit(0)), F.col("_n")))
    return rows.join(F.broadcast(long), _same(_renamed(by)), "left").withColumn("_slot", slot.cast("long")).drop(*_renamed(by).values(), "_n", "_lo", "_hi")


def _carried(rows: DataFrame, grid: DataFrame, by: list[str], t: str, slot_rows: int) -> DataFrame:
    """Both sides as one table with ``_slot``, ``_last`` and ``_first``: the last grid row of the slots
    before a row's own, and the first one of those behind it.

    The grid's slots are summed up to a row each, and only those are ordered by recording
    alone. They are no more than two for each ``slot_rows`` rows of the grid, so that they can be broadcast.
    """
    long = _long(grid, by, t, slot_rows)
    own = _slotted(grid.select(*by, t, F.struct(*[c for c in grid.columns if c not in by]).alias("_grid")), long, by, t)
    ends = own.groupBy(*by, "_slot").agg(F.max_by("_grid", t).alias("_end"), F.min_by("_grid", t).alias("_begin"))
    every = long.select(*_renamed(by).values(), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))).alias("_of_slot"))
    names = {**_renamed(by), "_slot": "_of_slot"}
    slots = every.join(ends, _same(names), "left").drop(*by, "_slot")
    over = lambda order: Window.partitionBy(*_renamed(by).values()).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carry = slots.select(*names.values(), F.last("_end", ignorenulls=True).over(over(F.asc("_of_slot"))).alias("_last"),
                         F.last("_begin", ignorenulls=True).over(over(F.desc("_of_slot"))).alias("_first"))
    both = _slotted(_stacked(rows, grid, by, t), long, by, t)
    return both.join(F.broadcast(carry), _same(names), "left").drop(*names.values())


def _seen(by: list[str], t: str, forward: bool):
    """From each row's slot, the rows up to it in time (``forward``: from it on), grid rows first at a tie."""
    order = F.col(t).desc() if forward else F.col(t).asc()
    return Window.partitionBy(*by, "_slot").orderBy(order, F.col("_grid").isNull().asc()).rowsBetween(Window.unboundedPreceding, 0)


def asof(
    rows: DataFrame, grid: DataFrame, by: list[str], t: str = "t", prefix: str = "at_", forward: bool = False, slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Each row with the latest grid row at or before it (``forward``: the first at or after).

    Grid columns other than ``by`` come with a prefix; without such a row they are null. A
    recording of any length is spread over tasks: it is cut into slots of about ``slot_rows``
    grid rows, and what a slot's first rows need from earlier slots is carried over. The
    plan holds ``rows`` once, so that time joins may follow each other.
    """
    spread = _carried(rows, grid, by, t, slot_rows)
    inside = F.last("_grid", ignorenulls=True).over(_seen(by, t, forward))
    found = spread.withColumn("_grid", F.coalesce(inside, F.col("_first" if forward else "_last")))
    return _unstacked(found.where("_row is not null"), rows, grid, by, t, prefix)


def _unstacked(found: DataFrame, rows: DataFrame, grid: DataFrame, by: list[str], t: str, prefix: str) -> DataFrame:
    keep = [F.col(c) if c in (*by, t) else F.col(f"_row.{c}") for c in rows.columns]
    return found.select(*keep, *[F.col(f"_grid.{c}").alias(prefix + c) for c in grid.columns if c not in by])


def nearest(rows: DataFrame, grid: DataFrame, by: list[str], t: str = "t", prefix: str = "at_", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Each row with the grid row nearest in time; of two as near the earlier one. Long
    recordings are cut as in ``asof``."""
    spread = _carried(rows, grid, by, t, slot_rows)
    known = lambda forward: F.last("_grid", ignorenulls=True).over(_seen(by, t, forward))
    found = (
        spread.withColumn("_before", F.coalesce(known(False), F.col("_last")))
        .withColumn("_after", F.coalesce(known(True), F.col("_first")))
        .where("_row is not null")
    )
    gap_before, gap_after = F.col(t) - F.col(f"_before.{t}"), F.col(f"_after.{t}") - F.col(t)
    chosen = F.when(F.col("_after").isNull() | (gap_before <= gap_after), F.col("_before")).otherwise(F.col("_after"))
    return _unstacked(found.withColumn("_grid", chosen), rows, grid, by, t, prefix)


def to_frame(rows: DataFrame, frames: DataFrame, by: list[str], t: str = "t", frame: str = "frame") -> DataFrame:
    """Nearest frame of each event; -1 for a missing time or one outside the frames."""
    found = nearest(rows, frames, by, t)
    span = frames.groupBy(*by).agg(F.min(t).alias("_first"), F.max(t).alias("_last"))
    inside = (F.col(t) >= F.col("_first")) & (F.col(t) <= F.col("_last"))
    return found.join(span, by, "left").withColumn(
        frame, F.when(inside, F.col(f"at_{frame}")).otherwise(-1)).drop("_first", "_last", f"at_{t}", f"at_{frame}")


def paired_pulses(starts: DataFrame, ends: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """Each start with the first end at or after it that no earlier start has taken.

    The end taken by start i has the index max over j <= i of (ends before start j) +
    i - j, a running maximum, so that no row has to wait for another's choice.
    """
    order = Window.partitionBy(*by).orderBy(t)
    numbered_ends = ends.select(*by, F.col(t), (F.row_number().over(order) - 1).alias("_k"))
    earlier = asof(
        starts.select(*by, F.col(t)).withColumn("_i", F.row_number().over(order) - 1),
        numbered_ends, by, t, "e_")
    # Ends strictly before the start: one at the same time is still free for it.
    before = F.coalesce(F.col("e__k") + F.when(F.col(f"e_{t}") < F.col(t), 1).otherwise(0), F.lit(0))
    taken = earlier.withColumn("_k", (F.max(before - F.col("_i")).over(
        Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i")).cast("int"))
    return taken.select(*by, F.col(t).alias("start"), F.col("_i").cast("long").alias("pulse"), "_k").join(
        numbered_ends.withColumnRenamed(t, "end"), [*by, "_k"]).drop("_k")


def within(points: DataFrame, spans: DataFrame, by: list[str], width: float, t: str = "t", start: str = "start", end: str = "end") -> DataFrame:
    """Points with the spans [start, end] that hold them.

    Spans are dealt to time slots of ``width`` and met on (recording, slot), so that a
    point is compared only with spans of its slot.
    """
    slots = spans.withColumn("_slot", F.explode(F.sequence(
        F.floor(F.col(start) / width), F.greatest(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))))
    return points.withColumn("_slot", F.floor(F.col(t) / width)).join(slots, [*by, "_slot"]).where(
        (F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))).drop("_slot")


def around_events(trace: DataFrame, events: DataFrame, by_event: list[str], before: int, after: int, frame: str = "frame") -> DataFrame:
    """Long peri-event join: frames event - before to event + after - 1 as ``rel``.

    Events at frame 0 (none) are left out, and so are windows that leave the trace
    (frames 0 to the largest one of the key). Events are spread to frames and met by
    equality.
    """
    ends = trace.groupBy(*by_event).agg(F.max(frame).alias("_last"))
    asked = (
        events.where(F.col("event_frame") > 0).join(ends, by_event)
        .where((F.col("event_frame") - before >= 0) & (F.col("event_frame") + after - 1 <= F.col("_last")))
        .withColumn("rel", F.explode(F.sequence(F.lit(-before), F.lit(after - 1))))
        .withColumn(frame, F.col("event_frame") + F.col("rel")).drop("_last")
    )
    return asked.join(trace, [*by_event, frame])


def event_slices(values: Column, events: Column, before: int, after: int) -> Column:
    """Packed peri-event join: one slice of an array trace per event frame.

    Windows that leave the trace and events at frame 0 give a null slice.
    """
    return F.transform(events, lambda e: F.when(
        (e > 0) & (e - before >= 0) & (e + after <= F.size(values)),
        F.slice(values, e - before + 1, F.lit(before + after))))
