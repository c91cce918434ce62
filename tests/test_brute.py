"""Rows of the queries that SQL cannot express, against plain loops over the same tables."""

import itertools
import math

import numpy as np
import pytest
from compare import connected

import tracespark.plans as plans
from tracespark.plans.bindings import CTE
from tracespark.plans.timejoins import ALIGNED

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connected(FOLDER)


@pytest.fixture(scope="module")
def traces(con):
    df = con.execute(f"SELECT * FROM ({CTE['fr']}) ORDER BY roi, frame").df()
    return {k: g.reset_index(drop=True) for k, g in df.groupby("roi")}


def rows(spark, name):
    return [r.asDict() for r in plans.QUERIES[name](spark, FOLDER).collect()]


def near(a, b, digits=1e-5):
    return a is not None and b is not None and (a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= digits * max(1, abs(b)))


def test_onsets(spark, traces):
    """The search begins where the lap before first exceeds half of the track."""
    got = {(r["roi"], r["lap"]): (r["onset_frame"], r["non_stop"], r["non_full_stop"]) for r in rows(spark, "b4_run_onsets")}
    expected = {}
    for roi, g in traces.items():
        position, speed = [(f * 7) % 180 for f in g["frame"]], (g["value"] / 1000).tolist()
        lap = list(itertools.accumulate([0] + [int(a - z > 90) for a, z in zip(position, position[1:])]))
        for k in range(1, lap[-1] + 1):
            before, own = [i for i, n in enumerate(lap) if n == k - 1], [i for i, n in enumerate(lap) if n == k]
            begin = next((i for i in before if position[i] > 90), own[0])
            runs = [list(r) for on, r in itertools.groupby(own, lambda i: speed[i] > 10) if on]
            long = [r[0] for r in runs if len(r) > 3]
            fast = speed[own[0]] > 10
            slow = [i for i in range(begin, own[0]) if speed[i] <= 10]
            non_stop = moving = False
            if long and not (fast and long[0] == own[0]):
                start = long[0]
            elif runs and not fast:
                start = runs[0][0]
            elif not slow:
                start, non_stop = begin, True
            else:
                start = slow[-1]
            least = lambda some: min(some, key=lambda i: (speed[i], i)) if some else -1
            still = [i for i in range(begin, start) if speed[i] <= 3]
            if start == begin:
                onset = least(range(begin, own[0]))
            elif still:
                onset = still[-1]
            else:
                onset, moving = least(range(begin, start)), True
            expected[roi, k] = (onset, non_stop, moving)
    assert got == expected


def test_masked_regression(spark, traces):
    got = {(r["roi"], r["frame"]): r["corrected"] for r in rows(spark, "t29_masked_regression")}
    assert len(got) == sum(map(len, traces.values()))
    for roi, g in traces.items():
        y, x, n = g["value"].tolist(), g["second"].tolist(), len(g)
        mid = float(np.median(y))
        limit = mid + 2 * float(np.median([abs(v - mid) for v in y])) / 0.6745
        ends = [e + 40 for e in range(30, n, 60) if e + 40 < n]
        bounds = list(zip([0, *ends], ends))
        out = list(y)
        for i, (a, z) in enumerate(bounds):
            use = [k for k in range(a, z) if y[k] <= limit]
            if len(use) < 50:
                use += [k for k in range(z, bounds[i + 1][1] if i + 1 < len(bounds) else n) if y[k] <= limit]
            if len(use) < 50 and i:
                use += [k for k in range(bounds[i - 1][0], a) if y[k] <= limit]
            mx, my = (sum(v[k] for k in use) / len(use) for v in (x, y))
            slope = sum((x[k] - mx) * (y[k] - my) for k in use) / sum((x[k] - mx) ** 2 for k in use)
            mean = sum(x[a:z]) / (z - a)
            out[a:z] = [v - slope * (u - mean) for u, v in zip(x[a:z], y[a:z])]
        assert all(near(got[roi, k], v) for k, v in enumerate(out))


def test_decay_fits(spark, con):
    """No better tau on a fine grid, with the best amplitude for each."""
    body = f"WITH fr AS ({CTE['fr']}), {ALIGNED} SELECT roi, rel, avg(value) AS y FROM aligned GROUP BY 1, 2 ORDER BY 1, 2"
    means = con.execute(body).df()
    got = {r["roi"]: r for r in rows(spark, "t33_decay_fits")}
    for roi, g in means.groupby("roi"):
        t, y = g["rel"].to_numpy(float), g["y"].to_numpy()
        peak = 20 + int(np.argmax(y[20:35]))
        x, v = t[peak : peak + 16] - t[peak], y[peak : peak + 16]
        c = v.min()
        loss = {}
        for tau in np.exp(np.linspace(np.log(0.05), np.log(500), 3000)):
            e = np.exp(-x / tau)
            loss[tau] = float(((v - c - e * ((v - c) @ e) / (e @ e)) ** 2).sum())
        tau = min(loss, key=loss.get)
        r = got[roi]
        assert r["n_points"] == v.size and near(r["c"], c)
        total = float(((v - v.mean()) ** 2).sum())
        assert (1 - r["r2"]) * total <= loss[tau] * (1 + 1e-6)
    by_step = {}
    for r in got.values():
        if r["r2"] > 0.3:
            by_step.setdefault(r["roi"] % 5, []).append(r["tau"])
    assert {r["step"]: (r["n"], round(r["tau"], 6)) for r in rows(spark, "t34_decay_by_step")} == {
        k: (len(v), round(sum(v) / len(v), 6)) for k, v in by_step.items()}


@pytest.mark.parametrize("name, grow, shift", [("j18_matched_regions", 0, 0), ("j18_shifted_regions", 1, 2)])
def test_matched_regions(spark, traces, name, grow, shift):
    sets = ({}, {})
    for g in traces.values():
        for roi, frame, part in zip(g["roi"], g["frame"], g["part"]):
            for k in (0, 1):
                if frame % 3 != k:
                    sets[k].setdefault(roi % 10, {}).setdefault(roi % 7, set()).add((part % 16, part // 16 % 16))

    def grown(pixels):
        disc = [(a, z) for a in (-1, 0, 1) for z in (-1, 0, 1) if a * a + z * z <= grow * grow]
        return {(y + a, x + z) for y, x in pixels for a, z in disc}

    expected = {}
    for rec in sets[0].keys() & sets[1].keys():
        pairs = []
        for (a, p), (z, q) in itertools.product(sets[0][rec].items(), sets[1][rec].items()):
            ca, cz = np.mean(list(p), 0), np.mean(list(q), 0)
            if ((ca - cz) ** 2).sum() > 36:
                continue
            gp, gq = grown(p), grown(q)
            best = max(2 * len(gp & {(y + i, x + j) for y, x in gq}) / (len(gp) + len(gq))
                       for i in range(-shift, shift + 1) for j in range(-shift, shift + 1))
            if best >= 0.3:
                pairs.append((a, z, best))

        def total(left):
            if not left:
                return 0.0
            (a, z, s), rest = left[0], left[1:]
            return max(s + total([p for p in rest if p[0] != a and p[1] != z]), total(rest))

        if pairs:
            expected[rec] = (round(total(pairs), 4), {(a, z): s for a, z, s in pairs})
    got = {}
    for r in rows(spark, name):
        got.setdefault(r["rec"], []).append(r)
    assert got.keys() == expected.keys()
    for rec, (best, pairs) in expected.items():
        assert round(sum(r["dice"] for r in got[rec]), 4) == best
        assert len({r["a"] for r in got[rec]}) == len(got[rec]) == len({r["z"] for r in got[rec]})
        assert all(near(r["dice"], pairs[r["a"], r["z"]]) for r in got[rec])


def t_tail(t, df, n=200_000):
    """Two-sided p by adding up the density on a grid."""
    x = (np.arange(n) + 0.5) / n * abs(t)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 1 - 2 * float((scale * (1 + x * x / df) ** (-(df + 1) / 2)).sum()) * abs(t) / n


def normal_tail(z):
    return math.erfc(abs(z) / math.sqrt(2))


def test_p_values_of_pairs(spark, con):
    stats = {r["family"]: r for r in (x.asDict() for x in plans.QUERIES["z1_paired_t"](spark, FOLDER).collect())}
    ranks = {r["family"]: r for r in rows(spark, "z1_signed_rank")}
    for r in rows(spark, "z1_p_values"):
        if r["test"] == "t":
            s = stats[r["family"]]
            assert near(r["p"], t_tail(s["t"], s["df"]), 1e-4)
        else:
            s = ranks[r["family"]]
            n = s["n"]
            if n > 25:
                expected = normal_tail((s["w_plus"] - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24))
            else:  # all signs of all ranks
                ways = {0: 1}
                for k in range(1, n + 1):
                    ways = {w: ways.get(w, 0) + ways.get(w - k, 0) for w in range(n * (n + 1) // 2 + 1)}
                low = min(s["w_plus"], s["w_minus"])
                expected = min(1.0, 2 * sum(c for w, c in ways.items() if w <= low) / 2**n)
            assert near(r["p"], expected, 1e-3)


def test_p_values_of_groups(spark):
    u = {r["roi"]: r for r in rows(spark, "z3_mann_whitney")}
    t = {r["roi"]: r for r in rows(spark, "z2_welch_t")}
    got = rows(spark, "z3_p_values")
    assert {r["roi"] for r in got} == u.keys()
    for r in got:
        s = u[r["roi"]]
        n = s["n0"] + s["n1"]
        var = s["n0"] * s["n1"] / 12 * (n + 1 - s["ties"] / (n * (n - 1)))
        assert near(r["p_u"], min(1.0, normal_tail(max(0, abs(s["u"] - s["n0"] * s["n1"] / 2) - 0.5) / math.sqrt(var))), 1e-6)
        assert near(r["p_t"], t_tail(t[r["roi"]]["t"], t[r["roi"]]["df"]), 1e-4)


def test_p_values_of_counts(spark):
    for r in rows(spark, "z5_p_values"):
        k, n = r["k"], r["n"]
        assert near(r["p"], sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k, n + 1)), 1e-9)


def test_p_values_of_windows(spark):
    for r in rows(spark, "z4_p_values"):
        n = r["n0"] + r["n1"]
        var = r["n0"] * r["n1"] / 12 * (n + 1 - r["ties"] / (n * (n - 1)))
        assert near(r["p_t"], t_tail(r["t"], r["df"]), 1e-4)
        assert near(r["p_u"], min(1.0, normal_tail(max(0, abs(r["u"] - r["n0"] * r["n1"] / 2) - 0.5) / math.sqrt(var))), 1e-6)


def test_p_values_of_fits(spark, traces):
    got = {r["roi"]: r for r in rows(spark, "z6_p_values")}
    assert got.keys() == traces.keys()
    for roi, g in traces.items():
        r, n = np.corrcoef(g["value"].astype(float), g["second"].astype(float))[0, 1], len(g)
        assert near(got[roi]["p"], t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2), 1e-4)


def test_speeds_before_and_after_matching(spark):
    """Gate and p of every recording from its trials' bins, one test after the other."""
    from tracespark.plans.behaviours import binned

    table = [r.asDict() for r in binned(spark, FOLDER).collect()]
    kept = {(r["rec"], r["trial"]): r["kept"] for r in rows(spark, "b25_speed_gated")}
    got = {(r["rec"], r["bin"]): r for r in rows(spark, "b25_p_values")}

    def tests(some):
        out = {}
        for rec, k in {(r["rec"], r["bin"]) for r in some}:
            a, z = ([r["speed"] for r in some if (r["rec"], r["bin"], r["group"]) == (rec, k, g)] for g in (0, 1))
            if len(a) > 1 and len(z) > 1:
                df = len(a) + len(z) - 2
                pooled = ((len(a) - 1) * np.var(a, ddof=1) + (len(z) - 1) * np.var(z, ddof=1)) / df
                t = (np.mean(a) - np.mean(z)) / math.sqrt(pooled * (1 / len(a) + 1 / len(z)))
                out[rec, k] = t_tail(t, df, 20_000)
        return out

    before = tests(table)
    assert before.keys() == got.keys() and all(near(got[k]["p_before"], p, 1e-3) for k, p in before.items())
    gated = {rec for (rec, _), p in before.items() if p < 0.05}
    for (rec, trial), is_kept in kept.items():
        if rec not in gated:
            assert is_kept
    after = tests([r for r in table if kept.get((r["rec"], r["trial"]))])
    assert all(near(got[k]["p_after"], p, 1e-3) for k, p in after.items() if k in got)
    assert all(got[k]["p_after"] is None for k in got.keys() - after.keys())
