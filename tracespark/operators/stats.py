"""Distribution summaries and test statistics by grouped sums and ranks.

Statistics are aggregations; p-values (``with_p``) come from one vectorised step on the
finished, small table of statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracespark.functions import pvalues
from tracespark.functions.semantics import ratio


def paired_t(rows: DataFrame, by: list[str], a: str, z: str) -> DataFrame:
    """Paired t on pairs finite on both sides: n, means, t, df."""
    d = rows.where(F.col(a).isNotNull() & F.col(z).isNotNull()).withColumn("_d", F.col(a) - F.col(z))
    n = F.count("_d")
    return d.groupBy(*by).agg(
        n.alias("n"), F.avg(a).alias("mean_a"), F.avg(z).alias("mean_b"),
        ratio(F.avg("_d"), F.stddev_samp("_d") / F.sqrt(n)).alias("t"), (n - 1).cast("double").alias("df"))


def signed_rank(rows: DataFrame, by: list[str], a: str, z: str) -> DataFrame:
    """Wilcoxon signed ranks: zero differences dropped, tied ranks averaged."""
    d = rows.withColumn("_d", F.col(a) - F.col(z)).where("_d is not null and _d <> 0").withColumn("_s", F.abs("_d"))
    ties = F.count("*").over(Window.partitionBy(*by, "_s"))
    ranked = d.withColumn("_t", ties).withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy("_s")) + (F.col("_t") - 1) / 2)
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("_t") ** 2 - 1).alias("ties"))


def two_sample_t(rows: DataFrame, by: list[str], group: str, value: str, equal: bool = False) -> DataFrame:
    """Welch's (``equal``: the pooled) t of group 0 against group 1."""
    x = lambda k: F.when(F.col(group) == k, F.col(value))
    s = rows.groupBy(*by).agg(*[f(x(k)).alias(f"{n}{k}") for k in (0, 1) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))])
    n0, n1, v0, v1 = (F.col(c) for c in ("n0", "n1", "v0", "v1"))
    if equal:
        df = (n0 + n1 - 2).cast("double")
        se = F.sqrt(ratio((n0 - 1) * v0 + (n1 - 1) * v1, df) * (1 / n0 + 1 / n1))
    else:
        a, z = ratio(v0, n0), ratio(v1, n1)
        df, se = ratio((a + z) ** 2, a**2 / (n0 - 1) + z**2 / (n1 - 1)), F.sqrt(a + z)
    return s.where("n0 > 1 and n1 > 1").select(*by, "n0", "n1", F.col("m0"), F.col("m1"), ratio(F.col("m0") - F.col("m1"), se).alias("t"), df.alias("df"))


def mann_whitney(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """U of group 0 with tied ranks averaged, and the sum of t^3 - t over ties."""
    known = rows.where(F.col(value).isNotNull())
    ties = F.count("*").over(Window.partitionBy(*by, value))
    ranked = known.withColumn("_t", ties).withColumn(
        "_r", F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.col("_t") - 1) / 2)
    s = ranked.groupBy(*by).agg(
        F.count_if(F.col(group) == 0).alias("n0"), F.count_if(F.col(group) == 1).alias("n1"),
        F.sum(F.when(F.col(group) == 0, F.col("_r")).otherwise(0.0)).alias("_r0"), F.sum(F.col("_t").cast("double") ** 2 - 1).alias("ties"))
    return s.select(*by, "n0", "n1", (F.col("_r0") - F.col("n0") * (F.col("n0") + 1) / 2).alias("u"), "ties")


def rank_sum(u: DataFrame) -> DataFrame:
    """Rank-sum z of group 0 from ``mann_whitney``'s rows: normal, without a tie correction."""
    n0, n1 = F.col("n0"), F.col("n1")
    return u.withColumn("z", ratio(F.col("u") - n0 * n1 / 2, F.sqrt(n0 * n1 * (n0 + n1 + 1) / 12)))


def one_sample_t(rows: DataFrame, by: list[str], value: str, expected: float) -> DataFrame:
    """t of the mean of what is not missing against an expected value: n, mean, t, df."""
    n = F.count(value)
    return rows.groupBy(*by).agg(
        n.alias("n"), F.avg(value).alias("mean"), ratio(F.avg(value) - expected, F.stddev_samp(value) / F.sqrt(n)).alias("t"),
        (n - 1).cast("double").alias("df"))


def linear_fit(rows: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))


def fit_p(fits: DataFrame) -> DataFrame:
    """``linear_fit``'s rows plus p, two-sided, that the slope is zero: Student's t of r; an exact
    fit has p 0, fewer than three points none."""
    df = (F.col("n") - 2).cast("double")
    t = F.when(F.abs("r") >= 1, F.lit(1e300)).otherwise(F.col("r") * F.sqrt(df / (1 - F.col("r") ** 2)))
    return with_p(fits.withColumns({"_t": F.when(df > 0, t), "_df": df}), "t", t="_t", df="_df").drop("_t", "_df")


def running_by_range(
    rows: DataFrame, by: list[str], value: str, amount: Column, name: str, ties: tuple[str, ...] = (), descending: bool = False, slots: int = 256,
) -> DataFrame:
    """Adds the sum of ``amount`` over a group's rows up to each, in order of value and ties.

    Groups may be few and of any size: each is cut into ``slots`` ranges of value, rows are
    ordered inside a range, and the sums of the ranges before it are added. Missing values
    come last.
    """
    keys = {c: f"_of_{c}" for c in by}
    v = F.col(value).cast("double")
    span = rows.groupBy(*by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")).withColumnsRenamed(keys)
    same = lambda names: reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(z)) for a, z in names.items()])
    share = F.coalesce(F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    slot = F.when(v.isNull(), slots + 1).otherwise(F.floor((1 - share if descending else share) * slots)).cast("int")
    placed = rows.join(span, same(keys), "left").withColumns({"_slot": slot, "_amount": amount}).drop(*keys.values(), "_lo", "_hi")
    names = {**keys, "_slot": "_of_slot"}
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    earlier = placed.groupBy(*by, "_slot").agg(F.sum("_amount").alias("_sum")).select(
        *by, "_slot", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")).withColumnsRenamed(names)
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    inside = Window.partitionBy(*by, "_slot").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(name, F.sum("_amount").over(inside)).join(earlier, same(names)).withColumn(
        name, F.col(name) + F.col("_before")).drop(*names.values(), "_slot", "_amount", "_before")


def ecdf(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of the group's values at or below each of its values."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    return running_by_range(counts, by, value, F.col("_n"), "_sum").join(totals, by).withColumn("share", F.col("_sum") / F.col("_all")).drop("_n", "_sum", "_all")


def histogram(rows: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins of [low, high]; the last bin holds its upper edge."""
    k = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return rows.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*by, k.alias("bin")).agg(F.count("*").alias("n"))


def with_p(stats: DataFrame, kind: str, **columns: str) -> DataFrame:
    """``stats`` plus p, two-sided. kind: t (t, df), u (u, n0, n1, ties), w (w_plus, n, ties)
    or binomial (k, n, chance; one-sided, greater)."""
    fields = [F.col(columns.get(c, c)) for c in pvalues.NEEDS[kind]]

    @F.pandas_udf("double")
    def p(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(pvalues.FUNCTIONS[kind](*(x[c].to_numpy(float) for c in pvalues.NEEDS[kind])))

    return stats.withColumn("p", p(F.struct(*[f.cast("double").alias(n) for f, n in zip(fields, pvalues.NEEDS[kind], strict=True)])))
