"""Permutation nulls of event responses: all draws of a unit as arrays, summed by task first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracespark.functions import kernels

#: Draws that travel in one row of partial sums: 48 bytes each.
PART = 100
#: Windows that are added up between two looks at how many units are held.
SLICE = 512
#: Numbers of draws of all units that a task holds, 48 bytes each.
HELD = 1 << 18
#: Events of a unit whose numbers lie in one range of this size meet in one task.
RANGE = 1 << 15
PARTIAL = "_part int, _counts array<double>, _sums binary"
RESULT = "n_events long, amplitude array<double>, ratio array<double>, effect_size array<double>"


def draw_numbers(draws: int, events: np.ndarray, seed: int) -> np.ndarray:
    """Whole numbers in 0 .. 2**31 - 2 that depend on nothing but draw, event and seed."""
    k, e = np.arange(draws, dtype=np.int64)[None, :], events.astype(np.int64)[:, None]
    return (k * 7919 + e * 104729 + k * e * 1299709 + seed) % 2147483647


class UnitSums:
    """Sums over a unit's events for every draw, relative to an offset near its values.

    Counts: events with a baseline, with a response, and their samples. Sums by draw: of the
    events' means of both windows, of all samples and of their squares.
    """

    def __init__(self, offset: float, counts: np.ndarray, sums: np.ndarray):
        self.offset, self.counts, self.sums = offset, counts, sums

    def add(self, other: "UnitSums") -> None:
        """Another task's sums, moved to this one's offset."""
        by, (eb, er, nb, nr), (mb, mr, sb, sr, qb, qr) = other.offset - self.offset, other.counts, other.sums
        self.counts = self.counts + other.counts
        self.sums = self.sums + np.stack([
            mb + eb * by, mr + er * by, sb + nb * by, sr + nr * by, qb + 2 * by * sb + nb * by * by, qr + 2 * by * sr + nr * by * by])

    def results(self, n_before: int, n_after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Amplitude, ratio and effect size of every draw. The pooled deviation weighs the
        windows by their frames, and each deviation covers the samples of all events."""
        (eb, er, nb, nr), (mb, mr, sb, sr, qb, qr) = self.counts, self.sums
        with np.errstate(all="ignore"):
            before, after = mb / eb, mr / er
            var_b, var_r = (qb - sb * sb / nb) / (nb - 1), (qr - sr * sr / nr) / (nr - 1)
            pooled = np.sqrt(((n_before - 1) * var_b + (n_after - 1) * var_r) / (n_before + n_after - 2))
            amplitude, base = after - before, before + self.offset
            return amplitude, np.where(base != 0, (after + self.offset) / base, np.nan), np.where(pooled > 0, amplitude / pooled, np.nan)


def _added(held: dict, keys: list[tuple], values: np.ndarray, events: np.ndarray, draws: int, n_before: int, seed: int, fixed: bool) -> None:
    """Adds the windows (rows of ``values``, missing samples NaN) to the sums of their units."""
    known = ~np.isnan(values)
    n, nb = known.sum(1), known[:, :n_before].sum(1)
    usable = n > 0 if fixed else n == values.shape[1]
    for length, before in sorted(set(zip(n[usable].tolist(), nb[usable].tolist()))):
        at = np.flatnonzero(usable & (n == length) & (nb == before))
        at = at[np.argsort([hash(keys[i]) for i in at], kind="stable")]
        for rows in np.split(at, range(512, len(at), 512)):
            numbers = draw_numbers(draws, events[rows], seed)
            if length < 2:
                shifts = np.zeros_like(numbers)
            elif fixed:
                shifts = 1 + np.floor(numbers / 2147483647 * (length - 1)).astype(np.int64)
            else:
                shifts = 1 + numbers % (length - 1)
            samples = values[rows][known[rows]].reshape(len(rows), length)
            own = [keys[i] for i in rows]
            begins = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]]
            for i in begins:
                if own[i] not in held:
                    held[own[i]] = UnitSums(float(samples[i].mean()), np.zeros(4), np.zeros((6, draws)))
            offsets = np.array([held[k].offset for k in own])
            sb, sr, qb, qr = kernels.shifted_sums(samples - offsets[:, None], before, shifts)
            after = length - before
            sums = np.stack([sb / max(1, before), sr / max(1, after), sb, sr, qb, qr])
            sums = np.add.reduceat(sums, begins, axis=1)
            for j, (i, end) in enumerate(zip(begins, [*begins[1:], len(own)])):
                unit = held[own[i]]
                unit.counts = unit.counts + (end - i) * np.array([before > 0, after > 0, before, after], float)
                unit.sums = unit.sums + sums[:, j]


def response_null(
    windows: DataFrame, by: list[str], draws: int, n_before: int, n_after: int, *, seed: int = 1, fixed: bool = False, event: str = "event_frame",
    value: str = "value",
) -> DataFrame:
    """Null amplitudes, ratios and effect sizes of each unit under circular shifts of its
    events' windows: three arrays of ``draws`` values.

    ``windows``: by, event, value (an array of n_before + n_after samples). A draw's shift
    depends on draw and event alone, so that all units share it. With ``fixed``, samples
    that are missing stay where they are and the others are shifted among themselves;
    otherwise a window with a missing sample is left out. A shifted window's sums and sums of
    squares are differences of prefix sums, for all draws of many events at once.

    Events of a unit meet by ranges of ``RANGE`` frames and are added up there; what meets then
    is one set of sums by range and unit, so that a unit of any number of events is no hot
    group, and a short one's sums travel once. A task holds a bounded number of units' sums.
    Missing results (no event, a baseline of zero, no deviation) are null.

    Returns by, n_events, amplitude, ratio, effect_size.
    """
    kinds = [windows.schema[c] for c in by]
    length = n_before + n_after
    columns = [f"by{k}" for k in range(len(by))]

    def told(held: dict) -> Iterator[pa.RecordBatch]:
        for key in list(held):
            unit = held.pop(key)
            parts = [np.ascontiguousarray(unit.sums[:, a : a + PART]) for a in range(0, draws, PART)]
            yield pa.RecordBatch.from_pylist([
                {**dict(zip(columns, key)), "_part": k, "_counts": [unit.offset, *unit.counts.tolist()], "_sums": p.tobytes()} for k, p in enumerate(parts)],
                schema=own_schema)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, UnitSums] = {}
        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            part = part.filter(pc.fill_null(pc.equal(pc.list_value_length(part.column("v")), length), False))
            if part.num_rows:
                samples = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)
                keys = list(zip(*[part.column(c).to_pylist() for c in columns]))
                _added(held, keys, np.where(np.isinf(samples), np.nan, samples), part.column("e").to_numpy(), draws, n_before, seed, fixed)
            if len(held) * draws > HELD:
                yield from told(held)
        yield from told(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, {}
        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            for row in part.to_pylist():
                key = tuple(row[c] for c in columns)
                if current is not None and key != current:
                    yield result(current, parts)
                    parts = {}
                current = key
                sums = UnitSums(row["_counts"][0], np.array(row["_counts"][1:]), np.frombuffer(row["_sums"]).reshape(6, -1))
                if row["_part"] in parts:
                    parts[row["_part"]].add(sums)
                else:
                    parts[row["_part"]] = sums
        if current is not None:
            yield result(current, parts)

    def result(key: tuple, parts: dict[int, UnitSums]) -> pa.RecordBatch:
        arrays = [np.concatenate(x) for x in zip(*[parts[k].results(n_before, n_after) for k in sorted(parts)])]
        own = [pa.array([x], f.type) for x, f in zip((*key, int(parts[0].counts[:2].max())), final_schema)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, from_pandas=True)).cast(final_schema.field(n).type)
                 for n, a in zip(("amplitude", "ratio", "effect_size"), arrays)]
        return pa.RecordBatch.from_arrays([*own, *lists], schema=final_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    renamed = [type(f)(c, f.dataType) for c, f in zip(columns, kinds)]
    partial, final = (StructType(renamed + StructType.fromDDL(x).fields) for x in (PARTIAL, RESULT))
    own_schema, final_schema = to_arrow_schema(partial), to_arrow_schema(final)
    plain = windows.select(*[F.col(c).alias(k) for c, k in zip(by, columns)], F.col(event).cast("long").alias("e"), F.col(value).cast("array<double>").alias("v"))
    near = plain.repartition(*columns, F.floor(F.col("e") / RANGE)).sortWithinPartitions(*columns)
    sums = near.mapInArrow(add_up, partial)
    merged = sums.repartition(*columns).sortWithinPartitions(*columns, "_part").mapInArrow(merge, final)
    return merged.withColumnsRenamed(dict(zip(columns, by)))


def long_null(nulls: DataFrame, by: list[str]) -> DataFrame:
    """One row per draw: by, draw, amplitude, ratio, effect_size."""
    each = F.arrays_zip("amplitude", "ratio", "effect_size")
    return nulls.select(*by, "n_events", F.posexplode(each).alias("draw", "_d")).select(
        *by, "n_events", F.col("draw").cast("long").alias("draw"), "_d.amplitude", "_d.ratio", "_d.effect_size")


def percentile_of(array: str, q: float):
    """Percentile of an array's known values, between neighbours where it falls between two."""
    known = F.sort_array(F.array_compact(array))
    place = (F.size(known) - 1) * F.lit(float(q))
    low = F.floor(place).cast("int")

    def between(x):
        a = F.get(x.known, x.low)
        return a + (x.place - x.low) * (F.coalesce(F.get(x.known, x.low + 1), a) - a)

    # one element, so that the sorted array is made once
    return F.get(F.transform(F.array(F.struct(known.alias("known"), place.alias("place"), low.alias("low"))), between), F.lit(0))
