"""Statistics of measured runs: summaries, comparison with a baseline, throughput, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators import order


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sd (sample), min, p50, p90, p95, p99 (interpolated), max of each group, of any size; nulls are left out."""
    shares = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    plain = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    found = order.percentiles(order.placed(rows, by, value), by, value, shares)
    return order.joined_to(plain, found, by, list(shares)).select(*by, "n", "mean", "sd", "min", *shares, "max")


def compare(current: DataFrame, baseline: DataFrame, by: str, threshold: float = 0.1) -> DataFrame:
    """change and verdict of each summary against the baseline's: regression, improvement, unchanged or no baseline.

    A change beyond the threshold counts only if Welch's statistic is two or more.
    """
    b = baseline.select(F.col(by).alias("b_"), F.col("mean").alias("m_"), F.col("sd").alias("s_"), F.col("n").alias("n_"))
    joined = current.join(b, F.col(by) == F.col("b_"), "left")
    change = (F.col("mean") - F.col("m_")) / F.col("m_")
    t = F.abs(F.col("mean") - F.col("m_")) / F.sqrt(F.pow("sd", F.lit(2)) / F.col("n") + F.pow("s_", F.lit(2)) / F.col("n_"))
    sure = F.coalesce(t >= 2, F.lit(True))
    verdict = F.when(F.col("m_").isNull(), "no baseline").when(sure & (change > threshold), "regression").when(sure & (change < -threshold), "improvement").otherwise("unchanged")
    return joined.select(by, "mean", F.col("m_").alias("baseline"), change.alias("change"), verdict.alias("verdict"))


def latency(rows: DataFrame, by: list[str], value: str, limit: float) -> DataFrame:
    """mean, p95, p99 (the value at floor(n * p) in order) and whether p95 is within the limit."""
    place = lambda p: F.least(F.col("n_") - 1, F.floor(F.col("n_") * p))
    found = order.at(order.placed(rows, by, value), by, value, {"p95": place(0.95), "p99": place(0.99)})
    return order.joined_to(rows.groupBy(*by).agg(F.avg(value).alias("mean")), found, by, ["p95", "p99"]).withColumn("in_time", F.col("p95") <= limit)


def throughput(rows: DataFrame, samples: str, seconds: str, sr: float) -> DataFrame:
    """Samples a second, and seconds of signal for each second of work."""
    return rows.withColumns({"per_second": F.col(samples) / F.col(seconds), "real_time_factor": F.col(samples) / sr / F.col(seconds)})
