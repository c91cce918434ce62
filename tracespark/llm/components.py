"""Connected components by joins: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespark.llm.common import dropped, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge to another node.

    ``edges`` has columns a and b of one orderable type; null ends and loops are
    ignored. Each round links every node to the smallest one that it sees, first over
    all neighbours (large star), then over smaller ones (small star); the number of
    rounds grows with the logarithm of the longest path. Neighbourhoods are only
    aggregated (min), never collected, so that a hub needs no memory. Each round is
    written to the shared folder; no edge passes through the driver.

    Returns node, root (roots included).
    """
    now = stored(_ordered(edges), "edges")
    before = _mark(now)
    for _ in range(max_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = _ordered(large)
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        new = stored(_ordered(small.union(least.select("a", F.col("root").alias("b")))), "edges")
        mark = _mark(new)
        dropped(now)
        now = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select("b", F.col("b").alias("root")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges that run from the larger to the smaller node."""
    return edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart: their number and sums of two hashes."""
    return tuple(edges.agg(
        F.count("*"),
        F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)),
        F.coalesce(F.sum(F.hash("b", "a").cast("long")), F.lit(0)),
    ).first())
