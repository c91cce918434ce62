"""Pooling operators against plain loops."""

import numpy as np
import pytest
from pyspark.sql import DataFrame

from tracespark.operators.pooling import pairwise_similarity, population_order
from tracespark.operators.stats import ecdf


@pytest.mark.parametrize("block", [512, 16])
def test_similarities_of_an_animal_of_most_sessions(spark, block):
    rng = np.random.default_rng(3)
    x = {("a", k): rng.random(12) for k in range(70)} | {("b", k): rng.random(5) for k in range(3)} | {("c", 1): rng.random(4), ("a", 70): np.ones(12)}
    df = spark.createDataFrame([(anm, k, v.tolist()) for (anm, k), v in x.items()], "anm string, session long, v array<double>").repartition(5)
    got = {(r.anm, r.a, r.z): r.similarity for r in pairwise_similarity(df, "anm", "session", "v", block=block).collect()}
    pairs = {(p, i, j) for p, i in x for q, j in x if p == q and i < j}
    assert set(got) == pairs
    for anm, i, j in pairs:
        if 70 in (i, j) and anm == "a":
            assert got[anm, i, j] is None  # a constant image
        else:
            assert abs(got[anm, i, j] - np.corrcoef(x[anm, i], x[anm, j])[0, 1]) < 1e-12
    assert pairwise_similarity(df.limit(0), "anm", "session", "v").count() == 0


def test_order_and_shares_of_two_groups_of_any_size(spark):
    rng = np.random.default_rng(8)
    rows = [("ab"[k % 2], "xyz"[k % 3], None if k % 97 == 0 else float(rng.choice([rng.normal(), 5.0, -1e6])), k) for k in range(900)]
    df = spark.createDataFrame(rows, "grp string, class string, effect double, roi long").repartition(5)
    got = {r.roi: (r.place, r.changes) for r in population_order(df, ["grp"], "class", "effect", "roi").collect()}
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-ord(r[1]), r[2] is None, -(r[2] or 0.0), r[3]))
        for place, (r, last) in enumerate(zip(own, [None, *own]), 1):
            assert got[r[3]] == (place, last is not None and last[1] != r[1])
    known = [r for r in rows if r[2] is not None]
    shares = {(r.grp, r.effect): r.share for r in ecdf(df.where("effect is not null"), ["grp"], "effect").collect()}
    for g in "ab":
        values = np.sort([r[2] for r in known if r[0] == g])
        for v in set(values.tolist()):
            assert abs(shares[g, v] - np.searchsorted(values, v, "right") / values.size) < 1e-12


def test_a_missing_vector_has_no_similarity_and_lengths_must_agree(spark):
    rng = np.random.default_rng(4)
    x = {k: None if k == 5 else rng.random(6).tolist() for k in range(12)}
    df = spark.createDataFrame([(1, k, v) for k, v in x.items()], "anm int, session long, v array<double>").repartition(4)
    got = {(r.a, r.z): r.similarity for r in pairwise_similarity(df, "anm", "session", "v").collect()}
    assert set(got) == {(i, j) for j in x for i in range(j)}
    for (i, j), s in got.items():
        assert s is None if 5 in (i, j) else abs(s - np.corrcoef(x[i], x[j])[0, 1]) < 1e-12
    with pytest.raises(Exception, match="differ in length"):
        pairwise_similarity(df.union(spark.createDataFrame([(1, 99, [1.0, 2.0])], df.schema)), "anm", "session", "v").collect()


def test_what_is_shuffled_does_not_grow_with_the_pairs_of_blocks(spark):
    """Each session travels four times at most until blocks are large, and pairs come in small pieces."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    df = spark.createDataFrame([(1, k, v.tolist()) for k, v in enumerate(x)], "anm int, session long, v array<float>").repartition(3)
    got = pairwise_similarity(df, "anm", "session", "v", block=16)
    tree = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in tree  # vectors travel as they are
    rows = {(r.a, r.z): r.similarity for r in got.collect()}
    assert set(rows) == {(i, j) for j in range(900) for i in range(j)}
    plain = np.corrcoef(x.astype(float))
    assert max(abs(s - plain[i, j]) for (i, j), s in rows.items()) < 1e-12
    sent = got._jdf.queryExecution().optimizedPlan().children().head()  # the rows that are dealt to tasks
    moved = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sent), spark)
    assert moved.count() == 4 * 900  # 58 for each session before
