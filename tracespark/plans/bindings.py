"""Driver tables in the roles of recordings, trials, traces and sessions.

Each role is a DataFrame here and a common table expression of the same name and rows
in ``CTE``; ``sql`` puts the ones that a query names in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FRAME_ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

CTE = {
    "ev": """SELECT user_id AS rec, event_type AS kind, value, epoch_us(ts) / 1000.0 AS t,
        row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS line_no FROM events""",
    "trial": """SELECT rec, t, value, row_number() OVER (PARTITION BY rec ORDER BY t) - 1 AS trial FROM ev WHERE kind = 'purchase'""",
    "frame": """SELECT rec, t, row_number() OVER (PARTITION BY rec ORDER BY t) - 1 AS frame FROM ev WHERE kind = 'view'""",
    "lick": "SELECT rec, t, value FROM ev WHERE kind = 'click'",
    "reward": "SELECT rec, t, value FROM ev WHERE kind = 'signup'",
    "block": """SELECT rec, t, row_number() OVER (PARTITION BY rec ORDER BY t) AS block FROM ev WHERE kind = 'error'""",
    "fr": f"""SELECT l_suppkey AS roi, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(FRAME_ORDER)}) - 1 AS frame,
        l_extendedprice AS value, l_quantity AS second, l_discount AS discount, l_tax AS tax, l_partkey AS part FROM lineitem""",
    "unit": """SELECT s_suppkey AS roi, s_nationkey AS rec, n_regionkey AS anm FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "session": """SELECT o_custkey AS anm, o_orderkey AS session, o_orderdate AS date, o_orderpriority AS label, o_totalprice AS dose,
        o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders""",
}
NEEDS = {"trial": ["ev"], "frame": ["ev"], "lick": ["ev"], "reward": ["ev"], "block": ["ev"]}


def sql(text: str) -> str:
    """The query with the roles that it names in front."""
    named = [k for k in CTE if re.search(rf"\b(FROM|JOIN)\s+{k}\b", text)]
    wanted = [k for k in CTE if k in named or any(k in NEEDS.get(n, []) for n in named)]
    ctes = ", ".join(f"{k} AS ({CTE[k]})" for k in wanted)
    body = text.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}" if ctes else body
    return f"WITH {ctes} {body}" if ctes else body


def query(name: str, text: str | None = None):
    """Register a query, and the SQL for its rows."""

    def register(f):
        QUERIES[name] = f
        if text:
            SQL[name] = sql(text)
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def numbered(by: str, *order) -> F.Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")


#: Rows that a task orders at once, about.
PART_ROWS = 1 << 19


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows by key in more parts than the session's, where the table's size asks for it, so
    that what a task orders does not grow with the table. The windows and joins by this
    key that follow keep these parts."""
    n = -(-rows.count() // PART_ROWS)
    return rows.repartition(n, by) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def events(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    out = table(spark, d, "events").select(
        F.col("user_id").alias("rec"), F.col("event_type").alias("kind"), "value",
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1000).alias("t"))
    return out.where(F.col("kind") == kind).drop("kind") if kind else out.withColumn("line_no", numbered("rec", "t") - 1)


def trials(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "purchase").withColumn("trial", numbered("rec", "t") - 1)


def frames(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "view").select("rec", "t").withColumn("frame", numbered("rec", "t") - 1)


def licks(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "click")


def rewards(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "signup")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "error").select("rec", "t").withColumn("block", numbered("rec", "t"))


def traces(spark: SparkSession, d: str) -> DataFrame:
    return dealt(table(spark, d, "lineitem"), "l_suppkey").select(
        F.col("l_suppkey").alias("roi"), (numbered("l_suppkey", *FRAME_ORDER) - 1).alias("frame"),
        F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("second"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_partkey").alias("part"))


def units(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("roi"), F.col("s_nationkey").alias("rec"), F.col("n_regionkey").alias("anm"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("anm"), F.col("o_orderkey").alias("session"), F.col("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("dose"), F.col("o_orderstatus").alias("status"),
        numbered("o_custkey", "o_orderdate", "o_orderkey").alias("k"))
