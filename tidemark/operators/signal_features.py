"""What is known of a signal when it comes, as evidence for the outcome model: the same columns in training and live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bursts import hawkes_burst
from .candle_features import zone_offset_pct
from .events import KEY, algo_signature, fatigue_gap
from .policy import market_momentum

NUMERIC = ("clusters", "momentum", "algo", "burst", "confirm_pace", "range_pct", "compression", "zone_offset", "fatigue_gap", "channel_win_rate", "market")
CATEGORICAL = ("hour_of_day", "day_of_week")
MARKET_SYMBOL = "BTCUSDT"


def burst_at(events: DataFrame, tau_ms: float) -> DataFrame:
    """(symbol, direction, ts_ms, burst): excitation against chance of the first event of each key and time.

    Keys with a single event have none.
    """
    sizes = events.groupBy(*KEY).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return hawkes_burst(events, tau_ms).join(sizes, KEY, "left_semi").groupBy(*KEY, "ts_ms").agg(F.min_by("score", "seq").alias("burst"))


def gap_at(events: DataFrame, max_burst_ms: int) -> DataFrame:
    """(symbol, ts_ms, fatigue_gap): time since the symbol's last event outside the burst's own window."""
    return fatigue_gap(events, max_burst_ms).groupBy("symbol", "ts_ms").agg(F.first("gap_ms").cast("double").alias("fatigue_gap"))


def with_market(rows: DataFrame, candles: DataFrame | None, key: str, benchmark: str | None, interval_ms: int, window: int) -> DataFrame:
    """Adds market, the benchmark's own momentum before each row; null without a benchmark or its candles."""
    if candles is None or benchmark is None:
        return rows.withColumn("market", F.lit(None).cast("double"))
    return rows.join(market_momentum(rows, candles, key, benchmark, interval_ms, window), key, "left")


def evidence(rows: DataFrame) -> DataFrame:
    """Adds the columns that follow from others of a row: clusters, confirm_pace, zone_offset, hour_of_day, day_of_week.

    rows: ts_ms, independent_clusters, confirm_span_ms, entry_from, entry_to, last_close, direction (of the post). Times
    are read in the session's time zone, which is UTC.
    """
    at = F.timestamp_millis("ts_ms")
    pace = F.when(F.col("independent_clusters") > 1, F.col("confirm_span_ms") / (F.col("independent_clusters") - 1))
    return rows.withColumns({
        "clusters": F.col("independent_clusters").cast("double"), "confirm_pace": pace.cast("double"), "zone_offset": zone_offset_pct(F.col("entry_from"), F.col("entry_to"), F.col("last_close"), F.col("direction")),
        "hour_of_day": F.hour(at).cast("string"), "day_of_week": (F.dayofweek(at) - 1).cast("string"),
    })


def trade_evidence(trades: DataFrame, events: DataFrame, candles: DataFrame | None, tau_ms: float, max_burst_ms: int, interval_ms: int, window: int, benchmark: str | None = MARKET_SYMBOL) -> DataFrame:
    """Past trades with all evidence but the channel's win rate (see prequential_win_rate).

    trades: burst_id, channel, symbol, direction, ts_ms, independent_clusters, confirm_span_ms, entry_from, entry_to, and
    momentum, range_pct, compression and last_close of the candles before.
    """
    algo = algo_signature(events).select("channel", F.col("algo_score").alias("algo"))
    out = trades.join(algo, "channel", "left").join(burst_at(events, tau_ms), [*KEY, "ts_ms"], "left").join(gap_at(events, max_burst_ms), ["symbol", "ts_ms"], "left")
    return evidence(with_market(out, candles, "burst_id", benchmark, interval_ms, window))
