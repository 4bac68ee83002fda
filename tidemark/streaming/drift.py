"""Drift of live trades as a stream: the one-sided cumulative sum per model, kept as state.

The batch report recomputes everything in time order; a stream can't, so this is a contract of its own: trades are
taken in order of time within a micro-batch, later ones than the watermark are left out by Spark, and the sum goes on
from the last batch. With trades in order both agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "model string, trades long, level double, peak double, alarm boolean"
STATE = "trades long, level double, peak double"


def drift_stream(trades: DataFrame, mean: float, deviation: float, allowance: float = 0.5, threshold: float = 5.0, delay: str = "1 hour") -> DataFrame:
    """trades: model string, ts timestamp, pnl double (a stream). One row per model and micro-batch, in update mode."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, level, peak = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for pnl in rows["pnl"]:
            level = max(0.0, level + (mean - pnl) / deviation - allowance)
            peak = max(peak, level)
        n += len(rows)
        state.update((n, level, peak))
        yield pd.DataFrame({"model": [key[0]], "trades": [n], "level": [level], "peak": [peak], "alarm": [peak >= threshold]})

    return trades.withWatermark("ts", delay).groupBy("model").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
