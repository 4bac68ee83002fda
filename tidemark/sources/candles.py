"""Candles: time alignment, range reads, deduplication, and the hourly adapter over the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Candle intervals and their length in minutes (fixed values).
INTERVAL_MINUTES = {"1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "6h": 360, "8h": 480, "1d": 1440}
HOUR_MS = 3_600_000

CANDLES_SQL = """bars AS MATERIALIZED (
  SELECT symbol, ts_ms // 3600000 * 3600000 AS ts_ms, arg_min(value, (e, seq)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (e, seq)) AS close, count(*)::DOUBLE AS volume
  FROM (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000 AS e, event_id AS seq, value FROM events)
  GROUP BY ALL)"""


def step_ms(interval: str) -> int:
    return INTERVAL_MINUTES[interval] * 60_000


def align(ts: Column, interval: str) -> Column:
    """Start of the candle that holds the time."""
    return ts - F.pmod(ts, F.lit(step_ms(interval)))


def entry_start(ts: Column, interval: str) -> Column:
    """Start of the first candle that wasn't forming already: the time itself on a boundary, else the next boundary."""
    step = F.lit(step_ms(interval))
    return ts + F.pmod(step - F.pmod(ts, step), step)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts_ms, open, high, low, close, volume): an hour's first, greatest, least and last value, and its count."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("event_type").alias("symbol"), F.expr("unix_micros(cast(ts AS timestamp)) div 1000").alias("t"), F.col("event_id").alias("seq"), "value")
    order = F.struct("t", "seq")
    return rows.groupBy("symbol", align(F.col("t"), "1h").alias("ts_ms")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume")
    )


def read_range(candles: DataFrame, symbol: str, interval: str, limit: int | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Candles of one symbol: from start (aligned down, included) to end (excluded), the first ``limit`` of them.

    With a limit and no start, the last ``limit`` candles before the end. Filters reach the scan; with candles
    partitioned by symbol and day, so do the partitions.
    """
    step = step_ms(interval)
    picked = candles.where(F.col("symbol") == symbol)
    if start_ms is not None:
        start_ms -= start_ms % step
        picked = picked.where(F.col("ts_ms") >= start_ms)
        if limit is not None:
            picked = picked.where(F.col("ts_ms") < start_ms + limit * step)
    if end_ms is not None:
        picked = picked.where(F.col("ts_ms") < end_ms)
    if limit is not None and start_ms is None:
        return picked.orderBy(F.desc("ts_ms")).limit(limit).orderBy("ts_ms")
    return picked


def first_of_each(candles: DataFrame, order: str) -> DataFrame:
    """One candle for each symbol and time, the first by the order column."""
    rank = F.row_number().over(Window.partitionBy("symbol", "ts_ms").orderBy(order))
    return candles.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def write_by_day(candles: DataFrame, path: str) -> None:
    """Parquet by symbol and day, so that range reads prune files."""
    candles.withColumn("day", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd")).repartition("symbol", "day").write.mode("overwrite").partitionBy("symbol", "day").parquet(path)
