"""Operators on packed traces, cut into spans."""

import numpy as np

from tracespark.functions import kernels
from tracespark.operators.packed import grouped_information_null, rolled


def test_spans_of_a_trace_give_what_the_whole_gives(spark):
    rng = np.random.default_rng(7)
    traces = {0: rng.normal(50, 9, 700), 1: rng.normal(50, 9, 31), 2: rng.normal(50, 9, 1), 3: rng.normal(50, 9, 64), 4: np.full(90, np.nan)}
    traces[0][100:180] = np.nan
    rows = [(r, i, None if np.isnan(v) else float(v)) for r, x in traces.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "roi long, frame long, value double").repartition(6)
    for window, span in ((41, 64), (40, 50), (7, 1 << 15), (150, 100)):
        got = {}
        for r in rolled(df, ["roi"], window, lambda x, b, n: kernels.sparse_dff(x, window, 20, before=b, size=n), span=span).collect():  # noqa: B023
            assert (r.roi, r.frame) not in got
            got[r.roi, r.frame] = np.nan if r.value is None else r.value
        assert len(got) == len(rows)
        for roi, x in traces.items():
            np.testing.assert_allclose([got[roi, i] for i in range(len(x))], kernels.sparse_dff(x, window, 20))


def test_one_trace_of_most_rows_is_many_spans(spark):
    df = spark.range(20_000).selectExpr("1L as roi", "id as frame", "cast(pmod(hash(id), 1000) as double) as value")
    found = rolled(df, ["roi"], 101, lambda x, b, n: kernels.percentile_dff(x, 101, 20, before=b, size=n), span=1000)
    x = np.array([r.value for r in df.orderBy("frame").collect()])
    got = [r.value for r in found.orderBy("frame").collect()]
    np.testing.assert_allclose(got, kernels.percentile_dff(x, 101, 20))
    assert found.filter("value is null").count() == 0


def test_null_of_groups_that_share_their_valid_laps(spark):
    """Every cell by itself, with its group's shifts, on its valid frames."""
    rng = np.random.default_rng(4)
    rows, valid, cells = [], [], {}
    sets = {("s1", k): (0, 1, 2, 5) if k % 3 else (0, 2, 3, 70, 71) for k in range(9)} | {("s2", 20): (1, 2, 3), ("s2", 21): (1,), ("s2", 22): (1, 2, 3)}
    for (rec, roi), laps in sets.items():
        for lap in (0, 1, 2, 3, 5, 70, 71):
            for k in range(12):
                rows.append((rec, roi, lap, lap * 12 + k, k // 3, float(rng.random() + (k // 3 == roi % 4))))
        valid += [(rec, roi, lap) for lap in laps]
        cells[rec, roi] = [(r[4], r[5]) for r in rows if r[:2] == (rec, roi) and r[2] in laps]
    for k in range(3):  # a cell whose last lap is longer than that of its group
        rows.append(("s2", 22, 3, 48 + k, 3, 0.5))
        cells["s2", 22].append((3, 0.5))
    df = spark.createDataFrame(rows, "rec string, roi long, lap long, frame long, bin long, value double").repartition(6)
    ok = spark.createDataFrame(valid, "rec string, roi long, lap long")
    for batch in (64, 2):
        got = {(r.rec, r.roi): r for r in grouped_information_null(df, ok, ["rec"], 4, 300, 5, least_laps=3, batch=batch).collect()}
        assert set(got) == {key for key, laps in sets.items() if len(laps) >= 3}
        for (rec, roi), r in got.items():
            group = sorted(k for (q, k), laps in sets.items() if q == rec and laps == sets[rec, roi])
            assert (r.first_cell, r.n_cells, r.n_laps, r.n_frames) == (group[0], len(group), len(sets[rec, roi]), len(cells[rec, roi]))
            bins, x = map(np.array, zip(*cells[rec, roi]))
            occupancy = np.bincount(bins, minlength=4).astype(float)
            bits = lambda s: kernels.information(np.bincount(bins, np.roll(x, s), 4), occupancy)  # noqa: B023, E731
            null = [bits(s) for s in kernels.draw_shifts(x.size, 300, 5, group[0])]
            assert abs(r.info_bits - bits(0)) < 1e-9 and abs(r.null_95 - np.percentile(null, 95)) < 1e-9


def test_python_holds_a_few_traces_at_once(spark):
    import pyarrow as pa
    from tracespark.operators.packed import SLICE, per_trace, sliced

    assert max(b.num_rows for b in sliced(iter([pa.RecordBatch.from_pydict({"x": list(range(1000))})]))) == SLICE < 1000
    rows = spark.createDataFrame([(k, [1.0, None, float(k)]) for k in range(150)] + [(500, None), (501, [])], "roi long, value array<double>").repartition(1)
    got = {r.roi: r.value for r in per_trace(rows, lambda x: x * 2).collect()}
    assert len(got) == 152 and got[7] == [2.0, None, 14.0] and got[500] is None and got[501] == []
