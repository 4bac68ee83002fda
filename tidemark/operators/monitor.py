"""Forward drift: whether live trades still look like the history a model was certified on."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from .stats import cusum, ks_two_sample, min_track_record, moments, returns

KS_LEAST, KS_ALPHA, CUSUM_ALARM = 10, 0.05, 5.0
TRADE_SCHEMA = "ts_ms long, pnl double, symbol string, channel string"


def drift_report(forward: DataFrame, baseline: DataFrame) -> dict:
    """forward: ts_ms, pnl; baseline: pnl. Late trades simply take their place: all is recomputed in time order."""
    base = moments(baseline, [], "pnl").first()
    mu = base["mean"] if base and base["n"] else 0.0
    sigma = base["std"] if base and base["std"] > 0 else 1e-9
    facts = forward.agg(F.count("*").alias("n"), F.coalesce(F.avg("pnl"), F.lit(0.0)).alias("m")).first()
    n = facts["n"]
    peak = 0.0
    if n:
        peak = cusum(forward.withColumn("_all", F.lit(0)), ["_all"], "pnl", F.lit(mu), F.lit(sigma), "ts_ms").first()["cusum_peak"]
    ks = None
    if n >= KS_LEAST:
        both = forward.select("pnl", F.lit(True).alias("first")).union(baseline.select("pnl", F.lit(False)))
        found = ks_two_sample(both, "pnl", "first").first()
        ks = {"d": found["d"], "p": found["p"], "fired": found["p"] < KS_ALPHA}
    fired = peak >= CUSUM_ALARM
    needed = moments(forward, [], "pnl").select(min_track_record().alias("t")).first()["t"] if n > 1 else math.inf
    left = max(0, math.ceil(needed - n)) if math.isfinite(needed) else None
    alarm = fired or bool(ks and ks["fired"])
    reasons = [name for name, bad in (("cusum", fired), ("distribution", bool(ks and ks["fired"]))) if bad]
    advice = "stop and refit" if alarm else "record trades" if not n else "confirmed" if left == 0 else "keep on paper"
    return {
        "n": n, "baseline_n": base["n"] if base else 0, "alarm": alarm, "reasons": reasons, "cusum_peak": round(peak, 4), "cusum_fired": fired, "ks": ks, "mean_forward": round(facts["m"], 6),
        "mean_baseline": round(mu, 6), "trades_to_significance": left, "recommendation": advice,
    }


class PaperTrader:
    """Log of forward trades against a baseline of entered trades."""

    def __init__(self, spark: SparkSession, baseline: DataFrame, trades: list[dict] | None = None):
        self.spark, self.baseline, self.trades = spark, baseline, list(trades or [])

    def record(self, *trades: dict) -> None:
        self.trades.extend(t for t in trades if math.isfinite(t["pnl"]))
        self.trades.sort(key=lambda t: t["ts_ms"])

    def status(self) -> dict:
        rows = [(t["ts_ms"], float(t["pnl"]), t.get("symbol"), t.get("channel")) for t in self.trades]
        return drift_report(self.spark.createDataFrame(rows, TRADE_SCHEMA), self.baseline)

    def save(self) -> str:
        return json.dumps({"version": 1, "trades": self.trades})

    @classmethod
    def load(cls, spark: SparkSession, baseline: DataFrame, saved: str) -> PaperTrader:
        return cls(spark, baseline, json.loads(saved)["trades"])


@query("drift_report")
def _drift(spark, sf_dir):
    rows = returns(spark, sf_dir)
    forward = rows.where(F.col("k") % 10 == 0).select(F.expr("unix_micros(cast(d AS timestamp)) div 1000").alias("ts_ms"), F.col("r").alias("pnl"))
    found = drift_report(forward, rows.where(F.col("k") % 10 != 0).select(F.col("r").alias("pnl")))
    return spark.createDataFrame([(found["n"], found["baseline_n"], found["alarm"], found["cusum_peak"], found["ks"]["p"])], "n long, baseline_n long, alarm boolean, cusum_peak double, ks_p double")
