"""Event response per recording: the smallest complete analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespark.functions.semantics import exact, exact_sql

HALF_DAY_MS = 43_200_000.0
#: A common multiple of the numbers of samples that a window may have (up to 12).
SAMPLES = 27_720


def event_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal 12 h before and after each purchase, pooled per user.

    Events and signals meet on (user, half-day slot), so that no user's rows are
    compared beyond the neighbouring slots; events without rows on both sides drop out.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "user_id", "event_type", "value",
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1000).alias("t"),
    )
    signal = events.select("user_id", "value", "t", F.floor(F.col("t") / HALF_DAY_MS).alias("slot"))
    onset = events.where("event_type = 'purchase'").select(
        "user_id", F.col("t").alias("t0"),
        F.explode(F.array(*[F.floor(F.col("t") / HALF_DAY_MS) + k for k in (-1, 0, 1)])).alias("slot"),
    )
    near = onset.join(signal, ["user_id", "slot"]).withColumn("rel", F.col("t") - F.col("t0")).where(
        (F.col("rel") >= -HALF_DAY_MS) & (F.col("rel") < HALF_DAY_MS))
    before, after = F.when(F.col("rel") < 0, F.col("value")), F.when(F.col("rel") >= 0, F.col("value"))
    per_event = near.groupBy("user_id", "t0").agg(
        *[f(c).alias(n) for c, s in ((before, "b"), (after, "r"))
          for f, n in ((F.count, f"n_{s}"), (F.avg, f"m_{s}"), (F.sum, f"s_{s}"))],
        F.sum(before * before).alias("q_b"), F.sum(after * after).alias("q_r"),
    ).where("n_b > 0 and n_r > 0")
    pooled = per_event.groupBy("user_id").agg(
        F.count("*").alias("n_events"), F.avg("m_b").alias("baseline"), F.avg("m_r").alias("response"),
        *[F.sum(f"{k}_{s}").alias(f"{k}_{s}") for k in "nsq" for s in "br"],
    )
    var = lambda s: (F.col(f"q_{s}") - F.col(f"s_{s}") ** 2 / F.col(f"n_{s}"))
    sd = F.sqrt((var("b") + var("r")) / F.nullif(F.col("n_b") + F.col("n_r") - 2, F.lit(0)))
    parts = F.col("n_events") * (100 * SAMPLES)
    return pooled.select(
        "user_id", "n_events", exact(F.col("baseline"), parts).alias("baseline_mean"),
        exact(F.col("response"), parts).alias("response_mean"),
        exact(F.col("response") - F.col("baseline"), parts).alias("response_amplitude"),
        F.round(F.try_divide("response", "baseline"), 6).alias("response_ratio"),
        F.round(F.try_divide(F.col("response") - F.col("baseline"), sd), 6).alias("effect_size"),
    )


PARTS_SQL = f"n * {100 * SAMPLES}"
EVENT_RESPONSE_SQL = f"""
WITH e AS (SELECT user_id, event_type, value, epoch_us(ts) / 1000.0 AS t FROM events),
near AS (SELECT p.user_id, p.t AS t0, s.value, s.t - p.t AS rel
  FROM e p JOIN e s ON p.user_id = s.user_id AND s.t >= p.t - {HALF_DAY_MS} AND s.t < p.t + {HALF_DAY_MS}
  WHERE p.event_type = 'purchase'),
ev AS (SELECT user_id, t0, count(value) FILTER (rel < 0) n_b, count(value) FILTER (rel >= 0) n_r,
  avg(value) FILTER (rel < 0) m_b, avg(value) FILTER (rel >= 0) m_r,
  sum(value) FILTER (rel < 0) s_b, sum(value) FILTER (rel >= 0) s_r,
  sum(value * value) FILTER (rel < 0) q_b, sum(value * value) FILTER (rel >= 0) q_r
  FROM near GROUP BY 1, 2),
p AS (SELECT user_id, count(*) n, avg(m_b) b, avg(m_r) r, sum(n_b) nb, sum(n_r) nr, sum(s_b) sb, sum(s_r) sr,
  sum(q_b) qb, sum(q_r) qr FROM ev WHERE n_b > 0 AND n_r > 0 GROUP BY 1)
SELECT user_id, n AS n_events, {exact_sql('b', PARTS_SQL)} AS baseline_mean, {exact_sql('r', PARTS_SQL)} AS response_mean,
  {exact_sql('r - b', PARTS_SQL)} AS response_amplitude, round(r / nullif(b, 0), 6) AS response_ratio,
  round((r - b) / nullif(sqrt(((qb - sb * sb / nb) + (qr - sr * sr / nr)) / nullif(nb + nr - 2, 0)), 0), 6) AS effect_size
FROM p
"""
