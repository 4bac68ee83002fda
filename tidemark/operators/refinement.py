"""Coarse-to-fine search around the chosen exit, trading costs from the spread, and the ledger of fit attempts."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import replay as replays, selection
from .stats import exit_proposals

TAKER_FEE_PCT = 0.05
WEEK_MS = 7 * 86_400_000
WHOLE = ("stale_since", "stale", "cascade_window")
AXES = ("trailing_take", "hard_stop", "stale_profit", "stale_since", "stale", "vol_z_threshold", "squeeze_threshold", "cascade_window")


def auto_cost(spread_pct: float | None, explicit: float | None = None, taker_fee_pct: float = TAKER_FEE_PCT) -> float:
    """Round-trip cost in percent: what is said, else both sides' fee and the measured spread, else nothing."""
    if explicit is not None:
        return explicit
    return round(2 * taker_fee_pct + spread_pct, 4) if spread_pct is not None else 0.0


@dataclass(frozen=True)
class Ledger:
    """Append-only record of fit attempts: (time, settings tried, whether certified)."""

    attempts: tuple[tuple[int, int, bool], ...] = field(default=())

    def record(self, ts: int, inner_trials: int, certified: bool) -> Ledger:
        return Ledger((*self.attempts, (ts, inner_trials, certified)))

    def next_allowed(self, now: int, least_ms: int = WEEK_MS) -> int:
        return self.attempts[-1][0] + least_ms if self.attempts else now

    def can_refit(self, now: int, least_ms: int = WEEK_MS) -> bool:
        return now >= self.next_allowed(now, least_ms)

    def effective_trials(self, inner: int) -> int:
        return max(inner + sum(a[1] for a in self.attempts), inner, 1)


def bracket(axis: list[float], value: float) -> tuple[float, float]:
    """Neighbours of the value on its axis; beyond the ends, half as much again."""
    steps = sorted(set(axis))
    at = steps.index(value) if value in steps else -1
    return (steps[at - 1] if at > 0 else value / 1.5, steps[at + 1] if 0 <= at < len(steps) - 1 else value * 1.5)


def variants(exit_: dict, brackets: dict[str, tuple[float, float]]) -> list[dict]:
    """The exit with one axis at a time moved to the geometric middle between itself and each end of its bracket."""
    out = []
    for name, ends in brackets.items():
        for edge in ends:
            if edge > 0 and exit_[name]:
                middle = math.sqrt(exit_[name] * edge)
                middle = max(1, round(middle)) if name in WHOLE else round(middle, 4)
                if middle != exit_[name]:
                    out.append({**exit_, name: middle})
    return out


def refine(bursts: DataFrame, candles: DataFrame, start: dict, axes: dict[str, list], interval_ms: int, rounds: int = 6, multiplier: float = 1.0, start_labels: DataFrame | None = None) -> dict:
    """Rounds of variants, each labelled and scored in one job; moved to only if better by more than a standard error.

    bursts are those that pass the chosen setting. Brackets halve every round; the search ends when none is accepted
    or all brackets have closed. Returns the exit, its score, and how many variants were tried and accepted.
    """
    spark = bursts.sparkSession
    brackets = {a: bracket(list(axes.get(a, [start[a]])), start[a]) for a in AXES if start.get(a)}
    now, score, error, tried, accepted = dict(start), None, 0.0, 0, 0
    for r in range(rounds):
        found = variants(now, brackets)
        if r == 0 and start_labels is not None:
            p = exit_proposals(start_labels).first()
            found += [{**now, "hard_stop": p[c]} for c in ("s90", "s95") if p[c]] + [{**now, "trailing_take": p[c]} for c in ("t75", "t90") if p[c]]
        found = list({tuple(sorted(v.items(), key=lambda x: x[0])): v for v in found}.values())
        if not found:
            break
        rows = [now, *found]  # a few dozen rules
        grid = spark.createDataFrame([(i, *(v[c] for c in replays.EXIT_COLUMNS)) for i, v in enumerate(rows)], f"exit_id int, {replays.EXIT_SCHEMA}")
        lives = F.broadcast(grid.select("exit_id", (F.col("stale") * interval_ms).cast("long").alias("embargo_ms")))
        labels = replays.replay(bursts, candles, grid, interval_ms).where(~F.col("truncated")).join(bursts.select("burst_id", "ts_ms"), "burst_id").join(lives, "exit_id")
        scores = {x["exit_id"]: x for x in selection.board(labels, ["exit_id"]).collect()}  # a row for each rule
        tried += len(found)
        if 0 in scores:
            score, error = scores[0]["cv_score"], scores[0]["se"]
        best = max((i for i in scores if i), key=lambda i: (scores[i]["cv_score"], -i), default=None)
        if best is None or score is None or scores[best]["cv_score"] <= score + multiplier * error:
            break
        now, score, accepted = rows[best], scores[best]["cv_score"], accepted + 1
        brackets = {a: (math.sqrt(now[a] * lo), math.sqrt(now[a] * hi)) for a, (lo, hi) in brackets.items()}
        if max(hi / lo for lo, hi in brackets.values()) < 1.02:
            break
    return {"exit": now, "score": score, "tried": tried, "accepted": accepted}
