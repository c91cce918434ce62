"""Time joins against plain loops, on recordings far longer than a slot."""

import random

import pytest
from pyspark.sql import functions as F

from tracespark.operators import timejoin


def tables(spark):
    """90 % of the rows are one recording, with bursts, gaps and ties."""
    rng = random.Random(4)
    rows, grid = [], []
    for k in range(900):
        rows.append(("hot", rng.choice([rng.randrange(0, 3000), rng.randrange(1000, 1020), 2500]) / 2, k))
    rows += [("cold", rng.randrange(0, 300) / 2, k) for k in range(60)] + [(None, float(k), k) for k in range(40)] + [("alone", 1.0, 1), ("hot", None, -1)]
    times = sorted({rng.randrange(200, 600) for _ in range(70)} | {rng.randrange(1400, 1500) for _ in range(30)})
    grid = [("hot", float(x), n) for n, x in enumerate(times)] + [("cold", 5.0 * n, n) for n in range(20)] + [(None, 7.5, 0), ("other", 1.0, 0)]
    return (rows, grid, spark.createDataFrame(rows, "rec string, t double, k long").repartition(5),
            spark.createDataFrame(grid, "rec string, t double, frame long").repartition(3))


@pytest.mark.parametrize("slot_rows", [1 << 20, 64, 5])
def test_asof_and_nearest_equal_loops(spark, slot_rows):
    rows, grid, r, g = tables(spark)
    back, ahead, near = {}, {}, {}
    for rec, t, k in rows:
        if t is None:
            continue
        own = sorted((x, f) for q, x, f in grid if q == rec)
        back[rec, k] = max((p for p in own if p[0] <= t), default=(None, None))
        ahead[rec, k] = min((p for p in own if p[0] >= t), default=(None, None))
        near[rec, k] = min(own, key=lambda p: (abs(p[0] - t), p[0]), default=(None, None))
    found = lambda df: {(x.rec, x.k): (x.at_t, x.at_frame) for x in df.where("t is not null").collect()}
    assert found(timejoin.asof(r, g, ["rec"], slot_rows=slot_rows)) == back
    assert found(timejoin.asof(r, g, ["rec"], forward=True, slot_rows=slot_rows)) == ahead
    assert found(timejoin.nearest(r, g, ["rec"], slot_rows=slot_rows)) == near
    assert timejoin.nearest(r, g, ["rec"], slot_rows=slot_rows).count() == len(rows)


def test_a_long_recording_is_many_slots(spark):
    _, _, r, g = tables(spark)
    both = timejoin._carried(r, g, ["rec"], "t", 5)
    slots = {x.rec: (x.slots, x.most) for x in both.groupBy("rec", "_slot").count().groupBy("rec").agg(
        F.count("*").alias("slots"), F.max("count").alias("most")).collect()}
    assert slots["hot"][0] > 12 and slots["alone"] == (1, 1) and slots["cold"][0] > 2
    rows = r
    for k in range(6):  # joins behind joins: the plan grows with their number only
        rows = timejoin.asof(rows, g.select("rec", "t", F.col("frame").alias(f"f{k}")), ["rec"], prefix=f"p{k}_")
    assert rows._jdf.queryExecution().analyzed().toString().count("Window") < 40
    # no window gathers the rows of a recording: only sums of slots are ordered by recording alone
    assert timejoin.asof(r.limit(0), g, ["rec"]).count() == 0 and timejoin.asof(r, g.limit(0), ["rec"], slot_rows=8).where("at_t is not null").count() == 0
