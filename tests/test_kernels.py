import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracespark.functions import kernels as k
from tracespark.functions import pvalues

values = st.lists(st.floats(-50, 50).map(lambda v: round(v, 3)), min_size=12, max_size=40).map(np.array)


def windows(x, w):
    half = w // 2
    p = np.pad(x, (half, w - half - 1), mode="symmetric")
    return [p[i : i + w] for i in range(len(x))]


@settings(max_examples=40, deadline=None)
@given(values, st.integers(2, 11), st.sampled_from([0, 20, 50, 95]))
def test_rolling_order_statistics(x, w, q):
    assert np.array_equal(k.rolling_rank(x, w, q), [np.sort(v)[min(w - 1, int(w * q / 100))] for v in windows(x, w)])
    y = np.where(x > 20, np.nan, x)
    expected = [np.nanpercentile(v, q) if not np.isnan(v).all() else np.nan for v in windows(y, w)]
    np.testing.assert_allclose(k.rolling_percentile(y, w, q), expected, atol=1e-9)
    assert np.array_equal(k.rolling_extreme(x, w), [v.min() for v in windows(x, w)])


def test_order_statistics_of_a_long_window():
    """The reference's window of 9,000 frames, with ties and missing values."""
    rng = np.random.default_rng(2)
    x = rng.normal(100, 10, 40_000).round(1) + np.linspace(0, 50, 40_000)
    at = [0, 1, 17, 4499, 4500, 4501, 20_000, 35_500, 35_501, 39_999]
    padded = np.pad(x, (4500, 4499), mode="symmetric")
    got = k.rolling_rank(x, 9000, 20)
    assert [got[i] for i in at] == [np.sort(padded[i : i + 9000])[1800] for i in at]
    y = np.where(rng.random(40_000) < 0.3, np.nan, x)
    padded = np.pad(y, (4500, 4499), mode="symmetric")
    got = k.rolling_percentile(y, 9000, 20)
    np.testing.assert_allclose([got[i] for i in at], [np.nanpercentile(padded[i : i + 9000], 20) for i in at])
    # a span of a trace gives what the whole gives
    for begin, size in ((0, 3000), (10_000, 3000), (37_000, 3000)):
        low, high = max(0, begin - 4500), min(40_000, begin + size + 4499)
        assert np.array_equal(k.rolling_rank(x[low:high], 9000, 20, begin - low, size), k.rolling_rank(x, 9000, 20)[begin : begin + size])


@settings(max_examples=30, deadline=None)
@given(values)
def test_gaussian_is_a_weighted_mean(x):
    p = np.pad(x, 4, mode="symmetric")
    w = [math.exp(-0.5 * i * i) for i in range(-4, 5)]
    np.testing.assert_allclose(k.gaussian(x, 1.0), [sum(a * b for a, b in zip(w, p[i : i + 9])) / sum(w) for i in range(len(x))], atol=1e-9)


@settings(max_examples=30, deadline=None)
@given(values, st.integers(0, 2**31))
def test_all_shifts_by_fft(x, seed):
    x = np.abs(x) + 0.1
    bins = np.random.default_rng(seed).integers(0, 4, x.size)
    occupancy = np.bincount(bins, minlength=4).astype(float)
    shifts = np.arange(x.size)
    rolled = [k.information(np.bincount(bins, np.roll(x, s), 4), occupancy) for s in shifts]
    np.testing.assert_allclose(k.shifted_information(x, bins, 4, shifts), rolled, atol=1e-8)


def test_temporal_null_against_loops():
    rng = np.random.default_rng(3)
    x = rng.random(90) + 0.5
    x[[3, 4, 5, 40, 41, 70]] = np.nan
    lap, within = np.arange(90) // 14, np.arange(90) % 14
    bins, shifts = within // 2, np.array([0, 7, 30, 61])
    for s, got in zip(shifts, k.temporal_null(x, lap, bins, 5, shifts)):
        v = np.roll(x, s)
        sums, counts = np.zeros(5), np.zeros(5)
        for n in range(lap.max() + 1):
            cells = [[v[i] for i in range(90) if lap[i] == n and bins[i] == c] for c in range(5)]
            if all(not c or not np.isnan(c).all() for c in cells):
                for c, own in enumerate(cells):
                    sums[c] += np.nansum(own)
                    counts[c] += np.count_nonzero(~np.isnan(own))
        assert abs(got - k.information(sums, counts)) < 1e-12


def test_track_exit():
    assert k.track_exit(np.array([0, 50, 100, 150.0]), 90) == 2
    assert k.track_exit(np.array([100, 150, 10, 60, 120.0]), 90) == 4
    assert k.track_exit(np.array([100, 150, 10, 60.0]), 90) == 0 and k.track_exit(np.array([1.0, 2]), 90) == 2


def test_all_missing_trace_stays_missing():
    assert np.isnan(k.percentile_dff(np.full(5, np.nan), 3)).all()


def slow_decay_fit(t: np.ndarray, y: np.ndarray, peak: int, span: float, least: int = 5) -> dict[str, float]:
    """One unit after the other, with general solvers."""
    use = (t >= t[peak]) & (t <= t[peak] + span) & np.isfinite(y)
    none = dict.fromkeys(("tau", "a", "c", "tau_se", "r2"), float("nan")) | {"n_points": float(use.sum())}
    if use.sum() < least:
        return none
    x, v = t[use] - t[peak], y[use]
    c = v.min()
    p = np.array([max(v[0] - c, 1e-9), max((x[-1] - x[0]) / 3, 1e-9)])
    damp = 1e-3
    model = lambda q: q[0] * np.exp(-x / q[1]) + c
    loss = float(((v - model(p)) ** 2).sum())
    for _ in range(200):
        e = np.exp(-x / p[1])
        j = np.stack([e, p[0] * e * x / p[1] ** 2], 1)
        h, g = j.T @ j, j.T @ (v - model(p))
        step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), g, rcond=None)[0]
        new = p + step
        better = new[1] > 0 and float(((v - model(new)) ** 2).sum()) < loss
        if better:
            done = np.abs(step).max() < 1e-10 * (1 + np.abs(p).max())
            p, loss, damp = new, float(((v - model(new)) ** 2).sum()), damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    total = float(((v - v.mean()) ** 2).sum())
    e = np.exp(-x / p[1])
    j = np.stack([e, p[0] * e * x / p[1] ** 2], 1)
    h = j.T @ j
    se = math.sqrt(loss / (v.size - 2) * np.linalg.pinv(h)[1, 1]) if v.size > 2 else float("nan")
    return {"tau": float(p[1]), "a": float(p[0]), "c": float(c), "tau_se": se, "r2": 1 - loss / total if total > 0 else float("nan"),
            "n_points": float(v.size)}


def test_decay_fits_find_their_parameters():
    t = np.arange(0, 60, 1.0)
    y = 3 * np.exp(-(t - 5) / 8) + 1
    y[:5] = 0
    f = k.decay_fits(t[None, :], np.r_[y[:59], 1.0][None, :], np.array([5]), 100)
    assert abs(f["tau"][0] - 8) < 0.1 and f["r2"][0] > 0.999
    assert math.isnan(k.decay_fits(t[None, :], y[None, :], np.array([57]), 100)["tau"][0])


def test_decay_fits_of_many_units_equal_single_fits():
    rng = np.random.default_rng(9)
    t = np.tile(np.arange(40.0), (300, 1))
    y = np.where(t >= 4, rng.uniform(1, 9, (300, 1)) * np.exp(-(t - 4) / rng.uniform(2, 15, (300, 1))), 0) + rng.normal(0, 0.05, t.shape) + 2
    y[rng.random(y.shape) < 0.05] = np.nan
    y[7, 6:], y[8], t[9, 20:], y[9, 20:] = np.nan, 5.0, np.nan, np.nan  # too few points, constant, short
    peak = np.array([4 + int(np.nanargmax(np.where(np.isnan(r[4:10]), -np.inf, r[4:10]))) for r in y])
    got = k.decay_fits(t, y, peak, 25.0)
    for i in range(300):
        one = slow_decay_fit(t[i], y[i], int(peak[i]), 25.0)
        for name, value in one.items():
            if i == 8 and name in ("tau", "tau_se", "a"):
                continue  # nothing to fit
            assert math.isnan(value) and math.isnan(got[name][i]) or abs(got[name][i] - value) <= 1e-4 * max(1, abs(value)), (i, name)


def test_masked_regression_removes_the_regressor():
    x = np.sin(np.arange(200) / 5)
    y = 2 * x + 7
    quiet = np.ones(200, bool)
    np.testing.assert_allclose(k.masked_residual(y, x, quiet, [(0, 120), (120, 200)], 50)[:120], 7 + 2 * x[:120].mean(), atol=1e-9)
    quiet[:100] = False
    assert np.isfinite(k.masked_residual(y, x, quiet, [(0, 120), (120, 200)], 50)).all()


def test_run_onset():
    rest, run = np.zeros(300), np.full(700, 30.0)
    assert k.run_onset(np.r_[rest, rest, run], 300)[0] == 599
    assert k.run_onset(np.full(600, 30.0), 300)[1]
    assert k.run_onset(np.r_[np.full(300, 5.0), np.full(300, 5.0), run], 300)[2]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.floats(0.1, 1)), min_size=1, max_size=8, unique_by=lambda p: p[:2]))
def test_best_pairs_have_the_largest_sum(pairs):
    def best(left, used):
        if not left:
            return 0.0
        (a, z, s), rest = left[0], left[1:]
        take = s + best([p for p in rest if p[0] != a and p[1] != z], used)
        return max(take, best(rest, used))

    found = k.best_pairs(pairs)
    assert len({a for a, _, _ in found}) == len(found) == len({z for _, z, _ in found})
    assert abs(sum(s for *_, s in found) - best(pairs, ())) < 1e-9


def test_p_values():
    assert abs(pvalues.t_test(2.0, 10) - 0.0733880348) < 1e-9
    assert abs(pvalues.binomial(8, 20, 0.05) - sum(math.comb(20, i) * 0.05**i * 0.95 ** (20 - i) for i in range(8, 21))) < 1e-12
    assert pvalues.w_test(3, 8, 0) == 0.0390625
    assert abs(pvalues.normal(1.959964) - 0.05) < 1e-6
    assert pvalues.u_test(0, 0, 5, 0) != pvalues.u_test(0, 0, 5, 0)


def test_correlation_at_all_lags():
    rng = np.random.default_rng(5)
    x, y = rng.random(37), rng.random(37)
    lags, r = k.cross_correlation(x, y)
    expected = np.correlate((x - x.mean()) / x.std(), (y - y.mean()) / y.std(), "full") / 37
    np.testing.assert_allclose(r, expected, atol=1e-12)
    assert lags.tolist() == list(range(-36, 37)) and np.isnan(k.cross_correlation(x, np.ones(37))[1]).all()
    assert k.upsampled(np.array([0.0, 3.0]), 3).tolist() == [0, 1, 2, 3, 3, 3]


def test_temporal_null_takes_each_shift_once(monkeypatch):
    """All draws at once: arrays of the different shifts, not a round of calls for each draw."""
    rng = np.random.default_rng(4)
    x, at = rng.random(200), np.arange(200)
    shifts = k.draw_shifts(200, 1000, 15, 3)
    calls, real = [], np.bincount
    monkeypatch.setattr(k.np, "bincount", lambda *a, **b: calls.append(1) or real(*a, **b))
    got = k.temporal_null(x, at // 20, at % 20 // 3, 5, shifts)
    assert len(calls) < 10 and got.shape == (1000,)
    assert all(got[i] == got[j] for i, j in enumerate(np.unique(shifts, return_index=True, return_inverse=True)[1][np.unique(shifts, return_inverse=True)[1]]))
    assert np.isnan(k.temporal_null(x, at // 20, np.full(200, 9), 5, shifts)).all()
