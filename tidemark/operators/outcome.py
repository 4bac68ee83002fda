"""Outcome model: probability that a trade wins, from isotonic and categorical evidence calibrated out of fold.

Its input is the history of one chosen configuration, tens to thousands of rows; it is fitted on the driver. Signals are
scored by expressions (``outcome_columns``), and rank statistics for many rows are plans too.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from .selection import HISTORY_SQL as _HISTORY
from .selection import query_history

LEAST_ROWS, LEAST_VALUES, LEAST_DISTINCT = 20, 10, 3
KELLY = 0.25


@dataclass
class Steps:
    """A step function: the value of the first break that isn't below x, the last one beyond all breaks."""

    breaks: list[float]
    values: list[float]

    def __call__(self, x: float) -> float:
        at = int(np.searchsorted(self.breaks, x, side="left"))
        return self.values[min(at, len(self.values) - 1)]


def pool_adjacent(xs: Sequence[float], ys: Sequence[float]) -> Steps:
    """Isotonic rates of wins over x by pooling adjacent violators; each block's rate counts one win and one loss more."""
    blocks: list[list[float]] = []  # wins, rows, greatest x
    for i in np.argsort(np.asarray(xs, float), kind="stable"):
        blocks.append([ys[i], 1, xs[i]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            wins, rows, top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + wins, blocks[-1][1] + rows, top]
    return Steps([float(b[2]) for b in blocks], [float((b[0] + 1) / (b[1] + 2)) for b in blocks])


def logit(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass
class OutcomeModel:
    prior: float
    numeric: dict[str, tuple[int, Steps]] = field(default_factory=dict)
    categorical: dict[str, dict[str, float]] = field(default_factory=dict)
    calibration: Steps | None = None
    mean_win: float = 0.0
    mean_loss: float = 0.0
    n: int = 0
    brier: float = 0.0
    brier_prior: float = 0.0
    informative: bool = False

    def raw(self, features: Mapping[str, object], prior: float | None = None) -> float:
        base = logit(self.prior if prior is None else prior)
        score = base
        for name, (sign, steps) in self.numeric.items():
            value = features.get(name)
            if isinstance(value, (int, float)) and math.isfinite(value):
                score += logit(steps(sign * value)) - base
        for name, rates in self.categorical.items():
            value = features.get(name)
            if isinstance(value, str) and value in rates:
                score += logit(rates[value]) - base
        return score

    def predict(self, features: Mapping[str, object]) -> dict[str, float | bool]:
        """p_win, expected result, whether the model says more than its base rate, and a quarter of the Kelly share."""
        p = self.calibration(self.raw(features)) if self.informative and self.calibration else self.prior
        expected = p * self.mean_win + (1 - p) * self.mean_loss
        loss = abs(self.mean_loss)
        kelly = min(max(KELLY * (p / loss - (1 - p) / self.mean_win), 0.0), 1.0) if expected > 0 and loss > 0 and self.mean_win > 0 else 0.0
        return {"p_win": round(float(p), 6), "expected_pnl": round(float(expected), 6), "informative": self.informative, "risk_share": round(kelly, 6)}

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, data: dict) -> OutcomeModel:
        steps = lambda d: d and Steps(**d)
        return cls(**{**data, "numeric": {k: (s, steps(f)) for k, (s, f) in data["numeric"].items()}, "calibration": steps(data["calibration"])})


def _step(steps: Steps, x: Column) -> Column:
    below = F.size(F.filter(F.lit([float(b) for b in steps.breaks]), lambda b: b < x))
    return F.get(F.lit([float(v) for v in steps.values]), F.least(below, F.lit(len(steps.values) - 1)))


def _log_odds(p: Column) -> Column:
    return F.ln(p / (1 - p))


def outcome_columns(model: OutcomeModel) -> dict[str, Column]:
    """p_win, expected_pnl and risk_share of rows that have the model's features as columns; unknown ones say nothing."""
    base = logit(model.prior)
    score = F.lit(base)
    for name, (sign, steps) in model.numeric.items():
        x = F.col(name).cast("double")
        known = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        score = score + F.when(known, _log_odds(_step(steps, sign * x)) - base).otherwise(0.0)
    for name, rates in model.categorical.items():
        rate = F.try_element_at(F.create_map(*[F.lit(v) for pair in rates.items() for v in pair]), F.col(name))
        score = score + F.coalesce(_log_odds(rate) - base, F.lit(0.0))
    p = _step(model.calibration, score) if model.informative and model.calibration else F.lit(model.prior)
    expected = p * model.mean_win + (1 - p) * model.mean_loss
    loss = abs(model.mean_loss)
    risk = F.least(F.greatest(KELLY * (p / loss - (1 - p) / model.mean_win), F.lit(0.0)), F.lit(1.0)) if loss > 0 and model.mean_win > 0 else F.lit(0.0)
    return {"p_win": F.round(p, 6), "expected_pnl": F.round(expected, 6), "risk_share": F.round(F.when(expected > 0, risk).otherwise(0.0), 6)}


def _fit_numeric(rows: pd.DataFrame, names: Sequence[str]) -> dict[str, tuple[int, Steps]]:
    out = {}
    for name in names:
        x = pd.to_numeric(rows[name], errors="coerce").astype(float) if rows[name].dtype != object else pd.Series([v if isinstance(v, (int, float)) else np.nan for v in rows[name]], dtype=float)
        ok = np.isfinite(x.to_numpy())
        xs, ys = x.to_numpy()[ok], rows["y"].to_numpy()[ok]
        if len(xs) < LEAST_VALUES or len(np.unique(xs)) < LEAST_DISTINCT:
            continue
        sign = 1 if ((xs - xs.mean()) * (ys - ys.mean())).sum() >= 0 else -1
        out[name] = (sign, pool_adjacent(sign * xs, ys))
    return out


def _fit_categorical(rows: pd.DataFrame, names: Sequence[str]) -> dict[str, dict[str, float]]:
    out = {}
    for name in names:
        known = rows[[isinstance(v, str) for v in rows[name]]]
        groups = known.groupby(name, sort=False)["y"].agg(["count", "sum"])
        if len(known) < LEAST_VALUES or len(groups) < 2:
            continue
        rate = known["y"].mean()
        observed = ((groups["sum"] / groups["count"] - rate) ** 2).mean()
        excess = max(observed - (rate * (1 - rate) / groups["count"]).mean(), 0.0)
        weight = min(max(rate * (1 - rate) / excess if excess > 0 else math.inf, 2.0), 1e6)
        out[name] = {k: round((g["sum"] + weight * rate) / (g["count"] + weight), 6) for k, g in groups.iterrows()}
    return out


def area_and_error(wins: np.ndarray, losses: np.ndarray) -> tuple[float, float]:
    """Chance that a win scores above a loss (ties half), by ranks, and its standard error."""
    ranks = pd.Series(np.concatenate((wins, losses))).rank().to_numpy()
    n, m = len(wins), len(losses)
    a = (ranks[:n].sum() - n * (n + 1) / 2) / (n * m)
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    return a, math.sqrt(max((a * (1 - a) + (n - 1) * (q1 - a * a) + (m - 1) * (q2 - a * a)) / (n * m), 0.0))


def fit_outcome_model(rows: pd.DataFrame, names: Sequence[str], folds: int = 4) -> OutcomeModel | None:
    """rows: y (1 for a win), pnl, ts, and the features; None with too few rows or of one class only."""
    rows = rows.sort_values("ts", kind="stable").reset_index(drop=True)
    n = len(rows)
    if n < LEAST_ROWS or rows["y"].nunique() < 2:
        return None
    k = min(folds, n // 5)
    if k < 2:
        return None
    size = n // k

    def out_of_fold(kept: Sequence[str]) -> np.ndarray:
        raw = np.zeros(n)
        for f in range(k):
            low, high = f * size, n if f == k - 1 else (f + 1) * size
            train = pd.concat([rows[:low], rows[high:]])
            model = OutcomeModel(min(max(train["y"].mean(), 0.05), 0.95), _fit_numeric(train, kept), _fit_categorical(train, kept))
            raw[low:high] = [model.raw(dict(zip(kept, r))) for r in zip(*[rows[c][low:high] for c in kept])] if kept else model.raw({})
        return raw

    y = rows["y"].to_numpy()
    kept = []
    for name in names:
        raw = out_of_fold([name])
        area, error = area_and_error(raw[y == 1], raw[y == 0])
        if area - 2 * error > 0.5:
            kept.append(name)
    raw = out_of_fold(kept)
    calibration = pool_adjacent(raw, y)
    prior = y.mean()
    brier = np.mean([(calibration(r) - v) ** 2 for r, v in zip(raw, y)])
    brier_prior = np.mean((prior - y) ** 2)
    pnl = rows["pnl"].to_numpy()
    return OutcomeModel(
        round(float(prior), 6), _fit_numeric(rows, kept), _fit_categorical(rows, kept), calibration, round(float(pnl[y == 1].mean()), 6), round(float(pnl[y == 0].mean()), 6),
        n, round(float(brier), 6), round(float(brier_prior), 6), bool(brier + 1e-9 < brier_prior),
    )


def auc_gate(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the curve of a score by mid-ranks, its error, and whether it beats chance by two errors.

    Ranks come from counts per distinct score, so only distinct scores are ordered.
    """
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("w"), F.sum((1 - F.col(label)).cast("long")).alias("l"))
    below = F.coalesce(F.sum("l").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    facts = counts.select("w", "l", (F.col("w") * (below + F.col("l") / 2)).alias("u")).agg(F.sum("w").alias("n"), F.sum("l").alias("m"), F.sum("u").alias("u"))
    a = F.col("u") / (F.col("n") * F.col("m"))
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    error = F.sqrt(F.greatest((a * (1 - a) + (F.col("n") - 1) * (q1 - a * a) + (F.col("m") - 1) * (q2 - a * a)) / (F.col("n") * F.col("m")), F.lit(0.0)))
    return facts.select("n", "m", F.round(a, 6).alias("auc"), F.round(error, 6).alias("error"), (a - 2 * error > 0.5).alias("kept"))


def prequential_win_rate(history: DataFrame, key: str, ts: str = "ts_ms", seq: str = "burst_id") -> DataFrame:
    """Adds channel_win_rate: the channel's rate over its earlier trades only, with one win and one loss added; else null."""
    before = Window.partitionBy(key).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, -1)
    n, wins = F.count("*").over(before), F.sum((F.col("pnl") > 0).cast("long")).over(before)
    return history.withColumn("channel_win_rate", F.when(n > 0, (wins + 1) / (n + 2)))


@query("auc_gate", """WITH t AS (SELECT n_chars AS s, quality AS y FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
 c AS (SELECT s, sum(y) AS w, sum(1 - y) AS l FROM t GROUP BY s), u AS (SELECT w, l, w * (coalesce(sum(l) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + l / 2.0::DOUBLE) AS u FROM c),
 f AS (SELECT sum(w)::BIGINT AS n, sum(l)::BIGINT AS m, sum(u)::DOUBLE AS u FROM u), a AS (SELECT n, m, u / (n * m) AS a FROM f),
 e AS (SELECT *, sqrt(greatest((a * (1 - a) + (n - 1) * (a / (2 - a) - a * a) + (m - 1) * (2 * a * a / (1 + a) - a * a)) / (n * m), 0)) AS e FROM a)
 SELECT n, m, round(a, 6) AS auc, round(e, 6) AS error, a - 2 * e > 0.5 AS kept FROM e""")
def _auc(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    return auc_gate(labels, "n_chars", "quality")


@query("outcome_model")
def _outcome(spark, sf_dir):
    rows = query_history(spark, sf_dir).where(F.col("entered") & (F.col("exit_id") == 0))
    rows = prequential_win_rate(rows, "channel").select((F.col("pnl") > 0).cast("int").alias("y"), "pnl", F.col("ts_ms").alias("ts"), "channel_win_rate", "squeeze_pressure", F.hour(F.timestamp_millis("ts_ms")).cast("string").alias("hour"))
    model = fit_outcome_model(rows.toPandas(), ["channel_win_rate", "squeeze_pressure", "hour"])  # the history of one exit
    row = (0.0, 0, 0.0, 0.0, False) if model is None else (model.prior, model.n, model.brier, model.brier_prior, model.informative)
    return spark.createDataFrame([row], "prior double, n long, brier double, brier_prior double, informative boolean")


@query("prequential_win_rate", _HISTORY + """ SELECT burst_id, channel, round((count(*) FILTER (pnl > 0) OVER w + 1) / nullif(count(*) OVER w + 2, 2)::DOUBLE, 6) AS channel_win_rate
 FROM hi WHERE entered AND exit_id = 0 WINDOW w AS (PARTITION BY channel ORDER BY ts_ms, burst_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _prequential(spark, sf_dir):
    rows = query_history(spark, sf_dir).where(F.col("entered") & (F.col("exit_id") == 0))
    return prequential_win_rate(rows, "channel").select("burst_id", "channel", F.round("channel_win_rate", 6).alias("channel_win_rate"))
