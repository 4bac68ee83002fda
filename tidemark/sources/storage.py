"""Stores around the feeds: days of candles that a feed needs, counts of dropped rows, history dumps, deadlines."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
T = TypeVar("T")


def needed_days(events: DataFrame, before_ms: int, after_ms: int) -> DataFrame:
    """(symbol, day): days that hold a candle any event may ask for; distinct before anything is read."""
    spread = F.sequence(F.floor((F.col("ts_ms") - before_ms) / DAY_MS), F.floor((F.col("ts_ms") + after_ms) / DAY_MS))
    days = events.select("symbol", F.explode(spread).alias("d")).distinct()
    return days.select("symbol", F.date_format(F.timestamp_millis(F.col("d") * DAY_MS), "yyyy-MM-dd").alias("day"))


def prefetch(candles: DataFrame, days: DataFrame) -> DataFrame:
    """Candles of the needed days only: a semi-join on the partition columns, which prunes partitions at run time."""
    return candles.join(days, ["symbol", "day"], "left_semi")


def feed_drops(feed: DataFrame, listed: DataFrame, symbol: str = "pair") -> DataFrame:
    """(reason, n): why rows of a feed can't be used: no direction, no symbol, symbol not listed; else kept."""
    known = feed.join(listed.select(F.col("symbol").alias("_listed")), F.col(symbol) == F.col("_listed"), "left")
    reason = F.when(~F.coalesce(F.col("direction").isin("long", "short"), F.lit(False)), "direction").when(F.col(symbol).isNull(), "symbol").when(F.col("_listed").isNull(), "not-listed").otherwise("kept")
    return known.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def dump_history(history: DataFrame, path: str, form: str = "parquet") -> None:
    """Flat records of all labelled bursts, those that never entered included."""
    history.write.mode("overwrite").format(form).save(path)


def with_deadline(spark: SparkSession, seconds: float, action: Callable[[], T]) -> T:
    """Runs an action; its jobs are cancelled when the time is up, which fails the action."""
    tag = f"deadline-{uuid.uuid4().hex}"
    context = spark.sparkContext
    timer = threading.Timer(seconds, lambda: context.cancelJobsWithTag(tag))
    context.addJobTag(tag)
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        context.removeJobTag(tag)
