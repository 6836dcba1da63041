"""Cadence, freshness and bucketed statistics of observation points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST_GAPS, LAST_TIMES = 50, 30


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def cadence_median_gap(df: DataFrame, ts: str) -> DataFrame:
    """One row cadence_seconds: the median of the last 50 gaps between distinct times; null below two times."""
    last = df.where(F.col(ts).isNotNull()).select(_seconds(ts).alias("t")).distinct().orderBy(F.desc("t")).limit(LAST_GAPS + 1)
    gaps = last.select((F.col("t") - F.lag("t").over(Window.orderBy("t"))).alias("g"))  # at most 51 rows
    return gaps.agg(F.median("g").alias("cadence_seconds"))


def cadence_window(points: DataFrame, key: list[str], ts: str) -> DataFrame:
    """One row cadence_seconds: per stream the span of its latest 30 distinct times over 30, the median of the streams."""
    times = points.where(F.col(ts).isNotNull()).select(*key, _seconds(ts).alias("t")).distinct()
    last = times.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("t")))).where(F.col("r") <= LAST_TIMES)
    per = last.groupBy(*key).agg(((F.max("t") - F.min("t")) / LAST_TIMES).alias("c"), F.count("*").alias("n"))
    return per.where("n >= 2 and c > 0").agg(F.median("c").alias("cadence_seconds"))


def stale_after(cadence: Column) -> Column:
    """Seconds after which data are stale: five cadences, at least half an hour."""
    return F.greatest(F.lit(1800.0), F.coalesce(cadence, F.lit(0.0)) * 5)


def bucket_stats(points: DataFrame, key: list[str], ts: str, value: str, minutes: int) -> DataFrame:
    """n, mean, least and greatest value per stream and bucket of ``minutes`` (a divisor of 60), by the bucket's start."""
    if minutes < 1 or 60 % minutes:
        raise ValueError("minutes divides 60")
    start = F.window(F.col(ts), f"{minutes} minutes")["start"]
    return points.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).groupBy(*key, start.alias("bucket")).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def freshness(points: DataFrame, ts: str, now: Column, cadence: DataFrame) -> DataFrame:
    """One row latest, cadence_seconds, lag_seconds, stale (null without any time)."""
    newest = points.agg(F.max(ts).alias("latest"))
    lag = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col("latest").cast("timestamp")) / 1e6
    return newest.crossJoin(F.broadcast(cadence)).select("latest", "cadence_seconds", lag.alias("lag_seconds"), F.when(F.col("latest").isNotNull(), lag >= stale_after(F.col("cadence_seconds"))).alias("stale"))
