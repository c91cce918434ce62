"""Links of similar sessions as forests of block pairs, and units of equal values."""

import numpy as np
from tracespark.operators import pooling
from tracespark.operators.response import event_response


def test_forests_hold_the_same_groups(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 12))
    rows = [(k % 2, k, (centres[k % 6] + rng.normal(0, 0.35, 12)).tolist()) for k in range(240)] + [(0, 900, [1.0] * 12), (3, 901, [0.5] * 11 + [1.0])]
    df = spark.createDataFrame(rows, "anm long, vec_id long, v array<double>")
    nodes = df.select("anm", df.vec_id.alias("node"))
    every = pooling.pairwise_similarity(df, "anm", "vec_id", "v", block=32).where("similarity > 0.7").select("anm", "a", "z")
    few = pooling.similarity_links(df, "anm", "vec_id", "v", 0.7, block=32)
    groups = lambda links: sorted(map(tuple, pooling.connected_groups(links, nodes, "anm").collect()))
    assert groups(few) == groups(every)
    assert few.count() < every.count() / 3


def test_equal_units_have_equal_effects(spark):
    rng = np.random.default_rng(7)
    values = [[round(float(x), 2) for x in rng.uniform(900, 90_000, 12)] for _ in range(300)]
    rows = [(u, e, k - 4, x) for u in range(9) for e, own in enumerate(values) for k, x in enumerate(own)]
    rng.shuffle(rows)
    rows = [(int(u), int(e), int(k), float(x)) for u, e, k, x in rows]
    df = spark.createDataFrame(rows, "roi long, event_frame long, rel long, value double").repartition(7)
    got = event_response(df, ["roi"], 4, 8, step=0.01).collect()
    plain = {r.roi: r for r in event_response(df, ["roi"], 4, 8).collect()}
    assert len({(r.effect_size, r.response_ratio) for r in got}) == 1
    assert all(abs(r[c] / plain[r.roi][c] - 1) < 1e-9 for r in got for c in ("effect_size", "response_ratio", "baseline_mean", "response_mean"))
