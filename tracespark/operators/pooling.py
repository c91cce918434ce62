"""Pooling across sessions and animals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracespark.sources import shared_dir


def pooled(tables: dict[str, DataFrame], name: str = "source") -> DataFrame:
    """Union of session tables with their origin; columns that one lacks are missing there."""
    return reduce(lambda a, z: a.unionByName(z, allowMissingColumns=True), [t.withColumn(name, F.lit(k)) for k, t in tables.items()])


def side_by_side(rows: DataFrame, by: list[str], condition: str, values: list[str], names: list[str]) -> DataFrame:
    """One row per key with a column per condition; a missing condition gives missing values."""
    wide = rows.groupBy(*by).pivot(condition, names).agg(*[F.first(v).alias(v) for v in values])
    return wide if len(values) > 1 else wide.select(*by, *[F.col(str(n)).alias(f"{n}_{values[0]}") for n in names])


def unique_merge(a: DataFrame, z: DataFrame, by: list[str]) -> DataFrame:
    """Inner join that fails unless both sides have each key once."""
    once = lambda df, n: df.withColumn(n, F.count("*").over(Window.partitionBy(*by))).withColumn(
        n, F.when(F.col(n) > 1, F.raise_error(F.lit("a key occurs twice"))).otherwise(F.col(n)))
    return once(a, "_na").join(once(z, "_nz"), by).where("_na = 1 and _nz = 1").drop("_na", "_nz")


def keep_groups(rows: DataFrame, by: list[str], condition: Column) -> DataFrame:
    """Rows of the groups that a condition over the group holds for."""
    return rows.join(rows.groupBy(*by).agg(condition.alias("_ok")).where("_ok").drop("_ok"), by, "left_semi")


def share(a: Column, of: Column) -> Column:
    """Rows of a among those of ``of``; missing without any."""
    return F.try_divide(F.count_if(a & of), F.nullif(F.count_if(of), F.lit(0)))


def mean_profiles(rows: DataFrame, keys: list[str], within: list[str], profile: str) -> DataFrame:
    """Element-wise mean of array profiles, first within (key, session), then by key.

    Fails if profiles differ in length.
    """
    each = rows.select(*keys, *within, F.size(profile).alias("_n"), F.posexplode(profile).alias("pos", "x"))
    one = each.groupBy(*keys, *within, "pos").agg(F.avg("x").alias("x"), F.min("_n").alias("_a"), F.max("_n").alias("_z"))
    return one.groupBy(*keys, "pos").agg(
        F.avg("x").alias("mean"), F.count("*").alias("n"), F.min("_a").alias("_a"), F.max("_z").alias("_z")).withColumn(
        "mean", F.when(F.col("_a") < F.col("_z"), F.raise_error(F.lit("profiles differ in length"))).otherwise(F.col("mean"))).drop("_a", "_z")


def first_rows(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def unit_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, less their means and of length 1; a
    constant or missing one is NaN."""
    lists = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], pa.list_(pa.float64()))
    sizes = pc.unique(pc.list_value_length(lists).drop_null())
    if len(sizes) > 1:
        raise ValueError("vectors of one animal differ in length")
    x = np.full((len(lists), sizes[0].as_py() if len(sizes) else 1), np.nan)
    x[lists.is_valid().to_numpy(zero_copy_only=False)] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, x.shape[1])
    x = x - x.mean(1, keepdims=True) if x.size else x
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)


def pairwise_similarity(rows: DataFrame, by: str, item: str, vector: str, block: int = 512) -> DataFrame:
    """Normalised cross-correlation of all pairs of sessions of one animal.

    An animal's sessions are dealt to blocks (``_pairs_of_blocks``). A pair of blocks is a task's
    work, which holds the two and gives their pairs piece by piece, as products of matrices of
    about ``block``**2 numbers. Vectors of an animal have one length (else an error); constant
    ones have no similarity (null).

    Returns by, a, z (a before z), similarity.
    """
    def product(keys, items: pa.Array, units: np.ndarray, n: int, same: bool) -> Iterator[pa.RecordBatch]:
        step = max(1, block * block // max(1, len(items) - n))
        for at in range(0, n, step):
            own = slice(at, min(at + step, n))
            others = slice(at, n) if same else slice(n, len(items))
            together = units[own] @ units[others].T
            i, j = np.indices(together.shape).reshape(2, -1) if not same else np.triu_indices(len(together), 1, together.shape[1])
            one, other = items[own].take(pa.array(i)), items[others].take(pa.array(j))
            less = pc.less(one, other)
            low, high = pc.if_else(less, one, other), pc.if_else(less, other, one)
            found = pa.RecordBatch.from_arrays(
                [pa.repeat(keys, len(i)), low, high, pa.array(together[i, j], from_pandas=True)], names=[by, "a", "z", "similarity"])
            yield found.filter(pc.not_equal(low, high)) if same else found

    return _pairs_of_blocks(rows, by, item, vector, block, product, "by {by}, a {item}, z {item}, similarity double")


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold the rows and columns of a matrix of links together as all of them do,
    fewer than it has rows and columns."""
    n_rows = len(near)
    links, open_ = [], np.ones(sum(near.shape), bool)
    for root in range(n_rows):
        front = [root] if open_[root] else []
        open_[root] = False
        while front:
            x = front.pop()
            own = np.flatnonzero(near[x] & open_[n_rows:]) + n_rows if x < n_rows else np.flatnonzero(near[:, x - n_rows] & open_[:n_rows])
            open_[own] = False
            front += own.tolist()
            links += [(x, y - n_rows) if x < n_rows else (y, x - n_rows) for y in own.tolist()]
    found = np.array(links, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def similarity_links(rows: DataFrame, by: str, item: str, vector: str, least: float, block: int = 512) -> DataFrame:
    """Links between sessions of one animal, of those of a similarity over ``least``, that give the
    same connected groups: of each pair of blocks a forest, which is no more than its sessions.

    Returns by, a, z.
    """
    def product(keys, items: pa.Array, units: np.ndarray, n: int, same: bool) -> Iterator[pa.RecordBatch]:
        others = slice(0, n) if same else slice(n, len(items))
        near = np.empty((n, others.stop - others.start), bool)
        step = max(1, block * block // max(1, near.shape[1]))
        with np.errstate(invalid="ignore"):
            for at in range(0, n, step):
                np.greater(units[at : min(at + step, n)] @ units[others].T, least, out=near[at : at + step])
        i, j = forest(near)
        yield pa.RecordBatch.from_arrays([pa.repeat(keys, len(i)), items[:n].take(pa.array(i)), items[others].take(pa.array(j))], names=[by, "a", "z"])

    return _pairs_of_blocks(rows, by, item, vector, block, product, "by {by}, a {item}, z {item}").where("a <> z")


def _pairs_of_blocks(rows: DataFrame, by: str, item: str, vector: str, block: int, product, schema: str) -> DataFrame:
    """What ``product`` gives of each pair of blocks of an animal's sessions, and of each block with itself.

    An animal has a block for each ``block`` sessions, but no more than 4 until blocks hold 16 times as many (fewer
    of vectors over 64 long): each session travels once for each of its animal's blocks, so that what
    is shuffled grows with the number of sessions until then, and slowly from there on. ``product`` gets the animal, the sessions of both blocks and their
    unit vectors, how many are of the first block, and whether there is but one.
    """
    size = F.count("*")
    times = F.greatest(F.lit(1), F.least(F.lit(16), F.coalesce(F.try_divide(F.lit(1024), F.max(F.size(vector))), F.lit(16))))
    blocks = rows.groupBy(by).agg(F.greatest(F.least(F.ceil(size / block), F.lit(4)), F.ceil(size / (block * times))).cast("int").alias("_n"))
    kept = rows.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    dealt = rows.select(by, F.col(item).alias("_item"), (F.col(vector) if kept else F.col(vector).cast("array<double>")).alias("_v")).join(blocks, by).withColumn(
        "_b", F.pmod(F.xxhash64("_item"), F.col("_n")).cast("int"))
    names = {f.name: f.dataType.simpleString() for f in dealt.schema}

    def both(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        second = table.column("_second").to_numpy()
        first, last = np.flatnonzero(~second), np.flatnonzero(second)
        same = key[1].as_py() == key[2].as_py()
        if not len(first) or not (same or len(last)):
            return
        table = table.take(pa.array(np.append(first, last)))
        yield from product(key[0], table.column("_item").combine_chunks(), unit_rows(table.column("_v")), len(first), same)

    pairs = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(
        by, F.least("_b", "_other").alias("_i"), F.greatest("_b", "_other").alias("_j"), (F.col("_b") > F.col("_other")).alias("_second"), "_item", "_v")
    tasks = max(256, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # pairs are few rows and much work
    return pairs.repartition(tasks, by, "_i", "_j").groupBy(by, "_i", "_j").applyInArrow(both, schema.replace("by {by}", f"{by} {names[by]}").replace("{item}", names["_item"]))


def population_order(rows: DataFrame, by: list[str], label: str, value: str, tie: str) -> DataFrame:
    """Place of each unit in its group, by label and then value, both falling, then ``tie``; and
    whether its label differs from that of the unit before it."""
    from tracespark.operators.stats import running_by_range

    within = running_by_range(rows, [*by, label], value, F.lit(1), "_k", (tie,), descending=True)
    before = Window.partitionBy(*by).orderBy(F.col(label).desc()).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_of_{c}" for c in (*by, label)}
    labels = rows.groupBy(*by, label).agg(F.count("*").alias("_n")).select(*by, label, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(z)) for a, z in names.items()])
    return within.join(labels.withColumnsRenamed(names), same).withColumns(
        {"place": F.col("_before") + F.col("_k"), "changes": (F.col("_k") == 1) & (F.col("_before") > 0)}).drop(*names.values(), "_before", "_k")


def paired_metrics(a: DataFrame, z: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of rows that meet on ``by``, as long rows with both values; a missing value
    on either side drops the pair of that metric."""
    values = lambda n: F.struct(*[F.col(m).cast("double").alias(m) for m in metrics]).alias(n)
    both = a.select(*by, values("_a")).join(z.select(*by, values("_z")), by)
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_a.{m}").alias("value_a"), F.col(f"_z.{m}").alias("value_b")) for m in metrics]))
    return both.select(*by, long.alias("_m")).select(*by, "_m.*").where("value_a is not null and value_b is not null")


def once_each(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose key occurs exactly once."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where("_n = 1").drop("_n")


def connected_groups(links: DataFrame, nodes: DataFrame, by: str, rounds: int = 50) -> DataFrame:
    """Groups of linked items of each animal, numbered from 1 in the order of their first member.

    The smallest label spreads along links, and each round also follows the label's own
    label, which halves long chains; rounds are checkpointed and end when no label
    changes. Labels that have not settled after ``rounds`` rounds are an error.
    """
    shared_dir(links.sparkSession)
    both = links.select(by, F.col("a").alias("node"), F.col("z").alias("other")).union(
        links.select(by, F.col("z"), F.col("a")))
    labels = nodes.select(by, "node", F.col("node").alias("label")).checkpoint()
    both = both.checkpoint()
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("node", "other"), [by, "other"]).groupBy(by, "node").agg(F.min("label").alias("_l"))
        spread = labels.join(seen, [by, "node"], "left").select(by, "node", F.least("label", "_l").alias("label"), F.col("label").alias("_old"))
        jump = spread.select(by, F.col("node").alias("label"), F.col("label").alias("_next"))
        new = spread.join(jump, [by, "label"], "left").select(
            by, "node", F.least("label", "_next").alias("label"), "_old").checkpoint()
        if new.where("label <> _old").isEmpty():
            labels = new
            break
        labels = new.drop("_old")
    else:
        raise RuntimeError(f"groups have not settled after {rounds} rounds")
    return labels.select(by, "node", F.dense_rank().over(Window.partitionBy(by).orderBy("label")).cast("long").alias("group"))
