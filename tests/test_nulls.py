"""Nulls of event responses against rolling every window by itself."""

import numpy as np

from tracespark.operators.nulls import long_null, percentile_of, response_null


def slow(windows, draws, n_before, fixed, seed=1):
    """{unit: (events, amplitude, ratio, effect size)}, one draw and event at a time."""
    out = {}
    units = {u for u, _, _ in windows}
    for unit in units:
        own = [(e, np.array([np.nan if v is None else v for v in x], float)) for u, e, x in windows if u == unit and x is not None and len(x) == len(windows[0][2])]
        own = [(e, x) for e, x in own if (np.isfinite(x).any() if fixed else np.isfinite(x).all())]
        if not own:
            continue
        results = []
        for k in range(draws):
            rolled = []
            for e, x in own:
                number = (k * 7919 + e * 104729 + k * e * 1299709 + seed) % 2147483647
                y, known = x.copy(), np.flatnonzero(~np.isnan(x))
                if known.size > 1:
                    shift = 1 + int(number / 2147483647 * (known.size - 1)) if fixed else 1 + number % (len(x) - 1)
                    y[known] = np.roll(x[known], shift)
                rolled.append(y)
            y = np.array(rolled)
            before, after = y[:, :n_before], y[:, n_before:]
            means = [np.mean([np.nanmean(r) for r in w if not np.isnan(r).all()]) for w in (before, after)]
            sd = [np.nanstd(w, ddof=1) for w in (before, after)]
            nb, na = before.shape[1], after.shape[1]
            pooled = np.sqrt(((nb - 1) * sd[0] ** 2 + (na - 1) * sd[1] ** 2) / (nb + na - 2))
            results.append((means[1] - means[0], means[1] / means[0], (means[1] - means[0]) / pooled))
        out[unit] = (len(own), *np.array(results).T)
    return out


def test_null_arrays_equal_rolled_windows(spark):
    rng = np.random.default_rng(6)
    windows = []
    for unit in range(7):
        for e in range(int(rng.integers(1, 30))):
            x = (rng.normal(1000 * unit + 5, 3, 14)).tolist()
            if rng.random() < 0.4:
                x[int(rng.integers(14))] = None
            if rng.random() < 0.1:
                x = [None] * 14
            windows.append((unit, 60 * e + 30, x))
    windows += [(8, 30, [1.0] * 14), (9, 30, [None] * 14), (9, 90, None), (9, 150, [1.0]), (6, 7000, [float("nan")] + [2.5] * 13)]
    df = spark.createDataFrame(windows, "roi long, event_frame long, value array<double>").repartition(5)
    for fixed in (False, True):
        expected = slow(windows, 250, 5, fixed)
        got = {r.roi: r for r in response_null(df, ["roi"], 250, 5, 9, fixed=fixed).collect()}
        assert set(got) == set(expected)
        for unit, (n, *arrays) in expected.items():
            assert got[unit].n_events == n
            for name, a in zip(("amplitude", "ratio", "effect_size"), arrays):
                b = np.array([np.nan if x is None else x for x in got[unit][name]])
                if unit == 8 and name == "effect_size":
                    assert np.isnan(b).all()  # no deviation
                else:
                    assert np.allclose(a, b, rtol=1e-7, atol=1e-7), (unit, name)


def test_a_unit_of_most_events_is_added_up_by_task(spark):
    rng = np.random.default_rng(1)
    windows = [("a", k, rng.normal(0, 1, 10).tolist()) for k in range(3000)] + [("b", k, rng.normal(5, 1, 10).tolist()) for k in range(40)]
    df = spark.createDataFrame(windows, "roi string, event_frame long, value array<double>").repartition(8)
    found = response_null(df, ["roi"], 120, 4, 6)
    got = {r.roi: r for r in found.collect()}
    expected = slow(windows, 120, 4, False)
    assert all(np.allclose(got[u].effect_size, expected[u][3]) and got[u].n_events == expected[u][0] for u in "ab")
    q = {r.roi: r.q for r in found.select("roi", percentile_of("amplitude", 0.95).alias("q")).collect()}
    assert all(abs(q[u] - np.percentile(expected[u][1], 95)) < 1e-9 for u in "ab")
    assert long_null(found, ["roi"]).count() == 240
    assert response_null(df.limit(0), ["roi"], 10, 4, 6).count() == 0


def test_units_meet_before_their_sums_travel(spark):
    """A unit's few events are one set of partial sums, however its windows were dealt out."""
    from tracespark.operators import nulls

    rng = np.random.default_rng(2)
    windows = [(u, 60 * k + 30, rng.normal(u, 1, 8).tolist()) for u in range(40) for k in range(10)]
    df = spark.createDataFrame(windows, "roi long, event_frame long, value array<double>").repartition(9)
    plan = response_null(df, ["roi"], 250, 3, 5)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("RepartitionByExpression") == 2 and nulls.SLICE <= 1024
    got = {r.roi: r for r in response_null(df, ["roi"], 250, 3, 5).collect()}
    expected = slow(windows, 250, 3, False)
    assert all(np.allclose(got[u].ratio, expected[u][2]) and got[u].n_events == 10 for u in range(40))


def test_large_values_round_as_doubles(spark):
    """Medians of times in ms (b19): the product with 10^6 is a tie, the decimals are not."""
    from pyspark.sql import functions as F
    from tracespark.functions.semantics import rounded

    rows = spark.createDataFrame([(196226900.19702148,), (210578807.99389648,), (-1.0000005,), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in rows.select(rounded(F.col("x"))).collect()]
    assert got[:2] == [196226900.197022, 210578807.993897] and np.isnan(got[3]) and got[4] is None
