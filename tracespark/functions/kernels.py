"""NumPy helpers on one packed trace, trial or unit; Spark deals these out by key."""

from __future__ import annotations

import math

import numpy as np


def mirrored(x: np.ndarray, left: int, right: int) -> np.ndarray:
    """Reflected edges: the edge value is repeated (d c b a | a b c d | d c b a)."""
    return np.pad(x, (left, right), mode="symmetric")


class OrderStatistics:
    """The k-th smallest value of many ranges of an array at once (a wavelet matrix).

    Values become ranks. Level by level, from the highest bit, the ranks are parted by
    their bit, and running counts of zeros carry every range, and its k, into the part in
    which its answer lies: as many array steps as a rank has bits, for all ranges together.
    """

    def __init__(self, x: np.ndarray):
        self.values, ranks = np.unique(x, return_inverse=True)
        self.zeros: list[np.ndarray] = []
        self.bits = max(1, int(self.values.size - 1).bit_length())
        for level in reversed(range(self.bits)):
            bit = (ranks >> level & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~bit)]))
            ranks = np.concatenate([ranks[~bit], ranks[bit]])

    def smallest(self, starts: np.ndarray, stops: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Value number k (from 0) of each range in order of size."""
        found = np.zeros(len(starts), np.int64)
        for zeros in self.zeros:
            low, high = zeros[starts], zeros[stops]
            one = k >= high - low
            found = found << 1 | one
            k = np.where(one, k - (high - low), k)
            starts = np.where(one, zeros[-1] + starts - low, low)
            stops = np.where(one, zeros[-1] + stops - high, high)
        return self.values[found]


def windowed(x: np.ndarray, window: int, before: int = 0, size: int | None = None) -> np.ndarray:
    """The samples that the windows i - w//2 .. i - w//2 + w - 1 of ``size`` positions from
    ``before`` on need: what ``x`` has of them, and reflected samples where it ends."""
    half = window // 2
    size = len(x) - before if size is None else size
    after = len(x) - before - size
    left, right = max(0, half - before), max(0, window - half - 1 - after)
    padded = mirrored(x, left, right)
    begin = before + left - half
    return padded[begin : begin + size + window - 1]


def rolling_rank(x: np.ndarray, window: int, q: float, before: int = 0, size: int | None = None) -> np.ndarray:
    """The order statistic int(window * q / 100) of each position's window."""
    padded = windowed(x, window, before, size)
    at = np.arange(len(padded) - window + 1)
    rank = min(window - 1, int(window * q / 100))
    return OrderStatistics(padded).smallest(at, at + window, np.full(len(at), rank))


def rolling_percentile(x: np.ndarray, window: int, q: float, before: int = 0, size: int | None = None) -> np.ndarray:
    """Percentile with interpolation over what is not missing in the window; nothing: missing."""
    padded = windowed(x, window, before, size)
    known = ~np.isnan(padded)
    counts = np.concatenate([[0], np.cumsum(known)])
    starts, stops = counts[: len(counts) - window], counts[window:]
    some = stops > starts
    starts, stops = starts[some], stops[some]
    place = (stops - starts - 1) * q / 100
    low = place.astype(np.int64)
    order = OrderStatistics(padded[known])
    out = np.full(len(some), np.nan)
    if some.any():
        least, most = order.smallest(starts, stops, low), order.smallest(starts, stops, np.minimum(low + 1, stops - starts - 1))
        out[some] = least + (most - least) * (place - low)
    return out


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter of radius int(4 sigma + 0.5) with reflected edges."""
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(mirrored(x, radius, radius), weights / weights.sum(), mode="valid")


def rolling_extreme(x: np.ndarray, window: int, largest: bool = False) -> np.ndarray:
    """Centred rolling minimum (maximum) with reflected edges."""
    half = window // 2
    view = np.lib.stride_tricks.sliding_window_view(mirrored(x, half, window - half - 1), window)
    return view.max(1) if largest else view.min(1)


def percentile_dff(x: np.ndarray, window: int = 9000, q: float = 20.0, eps: float = 1e-8, before: int = 0, size: int | None = None) -> np.ndarray:
    """(F - b) / (b + eps) over the rolling rank baseline; missing samples stay missing."""
    own = x[before:][:size]
    base = rolling_rank(x, window, q, before, size)
    return (own - base) / (base + eps)


def absolute_dff(x: np.ndarray, window: int, q: float, eps: float = 1e-9, before: int = 0, size: int | None = None) -> np.ndarray:
    """The same over the size of the baseline."""
    own = x[before:][:size]
    base = rolling_rank(x, window, q, before, size)
    return (own - base) / (np.abs(base) + eps)


def sparse_dff(x: np.ndarray, window: int, q: float, eps: float = 0.1, before: int = 0, size: int | None = None) -> np.ndarray:
    """With missing values skipped and negative values taken as missing."""
    x = np.where(x < 0, np.nan, x)
    own = x[before:][:size]
    base = rolling_percentile(x, window, q, before, size)
    return (own - base) / (base + eps)


def smooth_minimum_dff(x: np.ndarray, window: int = 1800, sigma: float = 300.0) -> np.ndarray:
    """(F - b) / b, b: rolling maximum of the rolling minimum of the smoothed trace."""
    base = rolling_extreme(rolling_extreme(gaussian(x, sigma), window), window, largest=True)
    return (x - base) / base


def shifted_sums(x: np.ndarray, n_before: int, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums, and sums of squares, of the first ``n_before`` and the other samples of each row
    rolled by each of its shifts (rows, draws): differences of prefix sums over two rounds."""
    n = x.shape[1]
    twice = np.concatenate([x, x], axis=1)
    begin = n - shifts
    out = []
    for y in (twice, twice * twice):
        sums = np.concatenate([np.zeros((len(x), 1)), np.cumsum(y, axis=1)], axis=1)
        first, split, last = (np.take_along_axis(sums, begin + k, axis=1) for k in (0, n_before, n))
        out += [split - first, last - split]
    return out[0], out[1], out[2], out[3]


def upsampled(x: np.ndarray, factor: float) -> np.ndarray:
    """Linear interpolation at ``factor`` times the rate; the last value holds to the end."""
    return np.interp(np.arange(round(x.size * factor)) / factor, np.arange(x.size), x)


def cross_correlation(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lags -(n - 1) .. n - 1 and the correlation of z-scored x at i + lag with y at i, over n.

    All lags come from one product of spectra. A constant or missing signal has none.
    """
    n = x.size
    lags = np.arange(-n + 1, n)
    sds = x.std(), y.std()
    if not n or not all(np.isfinite(s) and s > 0 for s in sds):
        return lags, np.full(lags.size, np.nan)
    size = 1 << int(2 * n - 1).bit_length()
    a, z = (np.fft.rfft((v - v.mean()) / s, size) for v, s in zip((x, y), sds))
    return lags, np.fft.irfft(a * np.conj(z), size)[lags] / n


def information(activity: np.ndarray, occupancy: np.ndarray) -> float:
    """Bits per event from sums and frames per bin."""
    p = occupancy / occupancy.sum()
    rate = np.divide(activity, occupancy, out=np.zeros_like(activity, dtype=float), where=occupancy > 0)
    mean = float(p @ rate)
    if mean == 0:
        return float("nan")
    on = (occupancy > 0) & (rate > 0)
    x = rate[on] / mean
    return float((p[on] * x * np.log2(x)).sum())


def informations(activity: np.ndarray, occupancy: np.ndarray) -> np.ndarray:
    """The information of each row of sums (..., bins) over the same frames per bin."""
    p = occupancy / occupancy.sum()
    rate = np.divide(activity, occupancy, out=np.zeros_like(activity, dtype=float), where=occupancy > 0)
    with np.errstate(all="ignore"):
        mean = rate @ p
        x = rate / mean[..., None]
        bits = np.where((occupancy > 0) & (rate > 0), p * x * np.log2(np.where(rate > 0, x, 1.0)), 0.0).sum(-1)
    return np.where(mean == 0, np.nan, bits)


def shifted_information(values: np.ndarray, bins: np.ndarray, n_bins: int, shifts: np.ndarray) -> np.ndarray:
    """Information of the activity rolled by each shift, of one trace or of many (traces,
    frames) that share their bins and shifts.

    The bin sums of all rolls are a circular cross-correlation of the activity with the
    bins' indicators, so that one FFT per bin and trace gives every shift.
    """
    n = values.shape[-1]
    occupancy = np.bincount(bins, minlength=n_bins).astype(float)
    spectrum = np.conj(np.fft.rfft(values))
    sums = np.stack([np.fft.irfft(np.fft.rfft((bins == k).astype(float)) * spectrum, n)[..., shifts] for k in range(n_bins)], -1)
    return informations(sums, occupancy)


def temporal_null(values: np.ndarray, lap: np.ndarray, bins: np.ndarray, n_bins: int, shifts: np.ndarray) -> np.ndarray:
    """Information for each shift of the whole running trace, binned by lap anew.

    Frames in bins from ``n_bins`` on are rolled but not binned. A lap counts only if
    each of its visited bins still has a value that is not missing after the shift; bins that a short
    lap does not reach are no fault of it.
    """
    which = np.unique(lap, return_inverse=True)[1]
    order = np.flatnonzero(bins < n_bins)
    order = order[np.argsort(which[order] * n_bins + bins[order], kind="stable")]
    if not order.size:
        return np.full(shifts.size, np.nan)
    cell = which[order] * n_bins + bins[order]
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))  # of the frames of each visited cell
    laps, place = np.divmod(cell[starts], n_bins)
    first = np.flatnonzero(np.append(True, laps[1:] != laps[:-1]))  # of the cells of each lap
    own = np.cumsum(np.append(False, laps[1:] != laps[:-1]))
    size = values.size
    known = ~np.isnan(values)
    twice = [np.concatenate([x, x]) for x in (np.where(known, values, 0.0), known.astype(float))]
    different, draws = np.unique(size - shifts % size, return_inverse=True)
    bits = np.empty(different.size)
    step = max(1, (1 << 18) // size)
    for at in range(0, different.size, step):  # some shifts at once, however long the trace
        places = order[:, None] + different[at : at + step]
        sums, n = (np.add.reduceat(x[places], starts, axis=0) for x in twice)
        valid = np.logical_and.reduceat(n > 0, first, axis=0)[own]
        sums, n = (np.stack([(x * valid)[place == k].sum(0) for k in range(n_bins)]) for x in (sums, n))
        with np.errstate(all="ignore"):
            p = n / n.sum(0)
            rate = np.where(n > 0, sums / np.maximum(n, 1), 0.0)
            mean = (p * rate).sum(0)
            x = np.where(rate > 0, rate, 1.0) / mean
            own_bits = np.where((n > 0) & (rate > 0), p * x * np.log2(x), 0.0).sum(0)
        bits[at : at + step] = np.where((n.sum(0) > 0) & (mean != 0), own_bits, np.nan)
    return bits[draws]


def draw_shifts(n: int, draws: int, least: int, unit: int, seed: int = 1) -> np.ndarray:
    """Shifts in least .. n - least - 1 from whole-number arithmetic alone."""
    k = np.arange(draws, dtype=np.int64)
    span = max(1, n - 2 * least)
    return least + (k * 7919 + unit * 104729 + k * unit * 1299709 + seed) % 2147483647 % span


def masked_residual(y: np.ndarray, x: np.ndarray, quiet: np.ndarray, bounds: list[tuple[int, int]], least: int = 100) -> np.ndarray:
    """y without the regressor, by segment, fitted on quiet frames only.

    A segment of fewer than ``least`` quiet frames borrows those of the next segment,
    then of the one before.
    """
    out = y.astype(float).copy()
    for i, (a, z) in enumerate(bounds):
        use = np.zeros(y.size, bool)
        use[a:z] = quiet[a:z]
        if use.sum() < least:
            after = bounds[i + 1][1] if i + 1 < len(bounds) else y.size
            use[z:after] = quiet[z:after]
        if use.sum() < least and i:
            use[bounds[i - 1][0] : a] = quiet[bounds[i - 1][0] : a]
        if use.sum() < 2 or np.var(x[use]) == 0:
            continue
        slope = np.cov(x[use], y[use], bias=True)[0, 1] / np.var(x[use])
        out[a:z] = y[a:z] - slope * (x[a:z] - x[a:z].mean())
    return out


def decay_fits(t: np.ndarray, y: np.ndarray, peak: np.ndarray, span: float, least: int = 5, rounds: int = 200) -> dict[str, np.ndarray]:
    """A exp(-t / tau) + C from the peak on for each row of ``t`` and ``y`` (units, samples; NaN
    where a unit has fewer), C: the fitted part's minimum.

    Damped Gauss-Newton: the 2 x 2 systems of all units are solved together, each with its own
    damping, and units that have converged leave. Too few points give NaN.
    """
    rows = np.arange(len(t))
    begin = t[rows, peak][:, None]
    with np.errstate(invalid="ignore"):
        use = (t >= begin) & (t <= begin + span) & np.isfinite(y)
    n = use.sum(1)
    out = {k: np.full(len(t), np.nan) for k in ("tau", "a", "c", "tau_se", "r2")} | {"n_points": n.astype(float)}
    own = np.flatnonzero(n >= least)
    if not own.size:
        return out
    use, n = use[own], n[own]
    x, v = np.where(use, t[own] - begin[own], 0.0), np.where(use, y[own], 0.0)
    c = np.where(use, v, np.inf).min(1)
    first = v[np.arange(own.size), use.argmax(1)]
    ends = np.where(use, x, -np.inf).max(1) - np.where(use, x, np.inf).min(1)
    a, tau = np.maximum(first - c, 1e-9), np.maximum(ends / 3, 1e-9)

    def parts(k, a, tau):
        e = np.exp(-x[k] / tau[:, None]) * use[k]
        return e, a[:, None] * e * x[k] / (tau * tau)[:, None], np.where(use[k], v[k] - c[k, None] - a[:, None] * e, 0.0)

    loss = (parts(slice(None), a, tau)[2] ** 2).sum(1)
    damp = np.full(own.size, 1e-3)
    open_ = np.arange(own.size)
    for _ in range(rounds):
        if not open_.size:
            break
        e, slope, rest = parts(open_, a[open_], tau[open_])
        h11, h12, h22 = (e * e).sum(1), (e * slope).sum(1), (slope * slope).sum(1)
        g1, g2 = (e * rest).sum(1), (slope * rest).sum(1)
        d11, d22 = h11 + damp[open_] * (h11 + 1e-12), h22 + damp[open_] * (h22 + 1e-12)
        with np.errstate(all="ignore"):
            det = d11 * d22 - h12 * h12
            s1, s2 = np.nan_to_num((d22 * g1 - h12 * g2) / det), np.nan_to_num((d11 * g2 - h12 * g1) / det)
        na, nt = a[open_] + s1, tau[open_] + s2
        new = (parts(open_, na, np.where(nt > 0, nt, 1.0))[2] ** 2).sum(1)
        better = (nt > 0) & (new < loss[open_])
        small = np.maximum(np.abs(s1), np.abs(s2)) < 1e-10 * (1 + np.maximum(np.abs(a[open_]), np.abs(tau[open_])))
        k = open_[better]
        a[k], tau[k], loss[k], damp[k] = na[better], nt[better], new[better], damp[k] / 3
        damp[open_[~better]] *= 4
        open_ = open_[np.where(better, ~small, damp[open_] <= 1e12)]
    e, slope, _ = parts(slice(None), a, tau)
    h = np.stack([np.stack([(e * e).sum(1), (e * slope).sum(1)], 1), np.stack([(e * slope).sum(1), (slope * slope).sum(1)], 1)], 1)
    mean = v.sum(1) / n
    total = (np.where(use, v - mean[:, None], 0.0) ** 2).sum(1)
    with np.errstate(all="ignore"):
        out["tau_se"][own] = np.where(n > 2, np.sqrt(loss / (n - 2) * np.linalg.pinv(h)[:, 1, 1]), np.nan)
        out["r2"][own] = np.where(total > 0, 1 - loss / total, np.nan)
    out["tau"][own], out["a"][own], out["c"][own] = tau, a, c
    return out


def track_exit(position: np.ndarray, track: float) -> int:
    """Where the position of the trial before first exceeds the track's length: after its
    last large reset if it does so there, else at all, else at the trial's end."""
    resets = np.flatnonzero(np.diff(position) < -track / 2)
    over = np.flatnonzero(position > track)
    late = over[over > resets[-1]] if resets.size else over
    found = late if late.size else over
    return int(found[0]) if found.size else position.size


def run_onset(speed: np.ndarray, pre: int, rate: float = 1000.0, fast: float = 10.0, still: float = 3.0, lasting: float = 0.3) -> tuple[int, bool, bool]:
    """Run onset in a trial: sample, non-stop flag, non-full-stop flag.

    ``speed`` begins ``pre`` samples before the trial (see ``track_exit``). The start point is the first
    sample of the first run that is fast for long enough, unless that run is the one in
    which the trial begins; then it is the last slow sample before the trial (none: the
    trial is non-stop, and the slowest sample before it is taken). The onset is the last
    still sample before the start point; without one, the slowest there (non-full-stop).
    """
    on = speed[pre:] > fast
    edges = np.flatnonzero(np.diff(np.r_[0, on.astype(int), 0]))
    runs = [(a, z) for a, z in zip(edges[::2], edges[1::2], strict=True) if z - a > lasting * rate]
    begins_fast = bool(on.size and on[0])
    start = None
    if runs and not (begins_fast and runs[0][0] == 0):
        start = pre + int(runs[0][0])
    elif on.any() and not begins_fast:
        start = pre + int(np.argmax(on))
    else:
        slow = np.flatnonzero(speed[:pre] <= fast)
        if not slow.size or not slow[-1]:
            return (int(np.argmin(speed[:pre])) if pre else -1), not slow.size, False
        start = int(slow[-1])
    stopped = np.flatnonzero(speed[:start] <= still)
    if stopped.size:
        return int(stopped[-1]), False, False
    return (int(np.argmin(speed[:start])) if start else 0), False, True


def best_pairs(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """One-to-one pairs of the largest total score, by augmenting paths.

    The components of the pairs are small (regions that overlap), so that each is solved
    on its own square matrix by the Hungarian method.
    """
    parent: dict[tuple[str, int], tuple[str, int]] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, z, _ in pairs:
        parent[root(("a", a))] = root(("z", z))
    parts: dict = {}
    for a, z, s in pairs:
        parts.setdefault(root(("a", a)), []).append((a, z, s))
    out = []
    for some in parts.values():
        rows, columns = sorted({a for a, _, _ in some}), sorted({z for _, z, _ in some})
        n = max(len(rows), len(columns))
        score = np.zeros((n, n))
        for a, z, s in some:
            score[rows.index(a), columns.index(z)] = s
        for i, j in enumerate(_hungarian(-score)):
            if i < len(rows) and j < len(columns) and score[i, j] > 0:
                out.append((rows[i], columns[j], float(score[i, j])))
    return sorted(out)


def _hungarian(cost: np.ndarray) -> list[int]:
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], np.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out
