"""Composed pipelines: detection, fitting, planning, backtest, walk-forward and the final assessment."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..plans.lineage import settle
from ..plans.registry import query
from ..sources.candles import hourly
from ..sources.signals import signals
from . import bursts as burst_ops
from . import candle_features, detectors as detector_ops, graph, policy as policies, refinement, replay as replays, selection, stats
from .events import KEY, MAX_BURST_MS, algo_signature, channels_in_order, fatigue_gap, placebo_shift, window_events
from .outcome import OutcomeModel, fit_outcome_model, outcome_columns, prequential_win_rate
from .signal_features import CATEGORICAL, MARKET_SYMBOL, NUMERIC, evidence, trade_evidence, with_market

VERSION = 3
WEEK_MS = 7 * 86_400_000
CONFIG = {"window_k": 3, "min_clusters": 2, "jaccard": 0.3, "lag_peak": 0.5, "max_burst_ms": MAX_BURST_MS, "mode": "auto", "stationarity_ms": float("inf"), "author_graph": "xcorr"}
DEFAULT_AXES = {
    "trailing_take": [0.5, 1.0, 2.0], "hard_stop": [1.0, 2.0, 3.0], "stale_profit": [0.5, 1.0, 2.0], "stale_since": [60, 120, 240], "stale": [60, 240, 720],
    "vol_z_threshold": [1.5, 2.5], "squeeze_policy": ["none", "tighten", "veto", "invert"], "squeeze_threshold": [0.55, 0.7], "cascade_window": [15, 30, 60],
}


def author_graph(events: DataFrame, tau_ms: float, window_ms: int, config: dict) -> tuple[DataFrame, DataFrame]:
    """(channels with rank, directed edges)."""
    channels = channels_in_order(events)
    if config["author_graph"] == "hawkes":
        return channels, graph.hawkes_graph(events, tau_ms)
    return channels, graph.lag_edges(events, graph.jaccard_screen(events, window_ms, config["jaccard"]), config["lag_peak"], window_ms)


def predict(events: DataFrame, config: dict | None = None) -> dict:
    """Verdicts of the detector: synchronous bursts of independent authors where the graph can be trusted, else posts."""
    cfg = CONFIG | (config or {})
    last = events.agg(F.max("ts_ms")).first()[0]
    seen = (window_events(events, last, cfg["stationarity_ms"]) if last is not None else events).persist()
    tau = graph.self_tune_lag(seen)
    window = int(min(cfg["window_k"] * tau["tau_ms"], cfg["max_burst_ms"]))
    opens = viability = authors = influence = None
    if cfg["mode"] != "single":
        channels, edges = author_graph(seen, tau["tau_ms"], window, cfg)
        edges = edges.persist()
        authors = graph.cluster_authors(channels, edges).persist()
        influence = graph.author_influence(channels, edges)
        opens = burst_ops.early_warning(seen, authors, window, tau["tau_ms"], cfg["min_clusters"], influence)
        viability = graph.assess_viability(seen, edges, authors, window).first().asDict()
    mode, reason = cfg["mode"], "as configured"
    if mode == "auto":
        some = viability["viable"] and not opens.where(F.col("action") == "open").isEmpty()
        mode, reason = ("matrix", "the author graph is viable") if some else ("single", viability["reason"] if not viability["viable"] else "no burst of independent authors")
    if mode == "matrix":
        verdicts = opens.withColumn("channel", F.lit(None).cast("string")).withColumn("source", F.lit("matrix"))
    else:
        from .events import single_channel_signals

        verdicts = single_channel_signals(seen, window)
    gaps = fatigue_gap(events, cfg["max_burst_ms"]).select("seq", F.col("gap_ms").alias("symbol_gap_ms"))
    return {"verdicts": verdicts.join(gaps, "seq", "left"), "mode": mode, "mode_reason": reason, "tau": tau, "window_ms": window, "viability": viability, "authors": authors, "influence": influence}


def calibrate(events: DataFrame, candles: DataFrame, horizons: dict[str, list[int]], interval_ms: int = 60_000, samples: int = 8, rows: int = 240) -> dict:
    """Axes from the market itself, measured at a few events of different symbols.

    noise_pct: median move of a candle before the event; stops, trails and profit thresholds are multiples of it, gates
    half a day's deviation either way. coverage: candles that history still holds after the event (lower quartile);
    lives beyond nine tenths of it are dropped. spread_pct: from the candles' ranges. Without candles no axis changes.
    """
    order = Window.partitionBy("symbol").orderBy("ts_ms", "seq")
    picked = events.withColumn("_r", F.row_number().over(order)).orderBy("_r", "ts_ms", "seq").limit(samples)  # eight events
    start = F.col("ts_ms") + F.pmod(interval_ms - F.pmod("ts_ms", F.lit(interval_ms)), F.lit(interval_ms))
    ask = F.broadcast(picked.select("seq", "symbol", start.alias("_at")))
    bars = candles.join(ask, "symbol").persist()
    before = bars.where((F.col("ts_ms") < F.col("_at")) & (F.col("ts_ms") >= F.col("_at") - rows * interval_ms))
    middle = lambda df, c: df.where(F.col(c) > 0).agg(F.percentile(c, 0.5)).first()[0]
    noise = middle(candle_features.noise_pct(before, ["seq"]), "noise_pct")
    spread = candle_features.spread_pct(before, ["seq"]).where(F.col("spread_pct").isNotNull()).agg(F.percentile("spread_pct", 0.5)).first()[0]
    probe = math.ceil(max(horizons["stale"]) * 1.1) + 5
    ahead = bars.where((F.col("ts_ms") >= F.col("_at")) & (F.col("ts_ms") < F.col("_at") + probe * interval_ms)).groupBy("seq").agg(F.count("*").alias("n"))
    counts = sorted(r["n"] or 0 for r in picked.select("seq").join(ahead, "seq", "left").collect())
    bars.unpersist()
    axes: dict[str, list] = {}
    if noise:
        axis = lambda times, low, high: sorted({round(min(max(noise * t, low), high), 2) for t in times})
        axes |= {"hard_stop": axis((20, 40, 80), 0.5, 12), "trailing_take": axis((10, 20, 40), 0.3, 6), "stale_profit": axis((10, 20), 0.3, 4)}
    coverage = counts[len(counts) // 4] if counts else 0
    for name, values in horizons.items():
        if kept := [v for v in values if v <= 0.9 * coverage]:
            axes[name] = kept
    day = noise * math.sqrt(1440) if noise else None
    return {"axes": axes, "gates": [None, *(round(day * g, 2) for g in (-0.5, 0.0, 0.5))] if day else [None], "noise_pct": noise, "spread_pct": spread, "coverage": coverage, "sampled": len(counts)}


@dataclass
class SignalModel:
    """What fitting leaves: the chosen setting, tables of exits and scores as small rows, and its certificate."""

    config: dict
    mode: str
    exits: list[dict]
    tensor: list[dict]
    winner: dict
    certificate: dict
    reliability: dict
    nested_score: float | None
    channel_score: dict[str, dict] = field(default_factory=dict)
    channel_plan: dict[str, str] = field(default_factory=dict)
    risk_reward: dict[str, dict] = field(default_factory=dict)
    pnl: dict[str, dict] = field(default_factory=dict)
    baseline: list[float] = field(default_factory=list)
    outcome: dict | None = None
    policy: dict = field(default_factory=dict)
    interval_ms: int = 60_000
    momentum_window: int = 1440
    trials: int = 0
    inner_trials: int = 0
    fitted_ms: int = 0
    mode_reason: str = ""
    market_symbol: str | None = None
    history_size: int = 0
    labeling: dict = field(default_factory=dict)
    calibration: dict | None = None
    fit_attempts: int = 1
    version: int = VERSION

    def save(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def load(cls, text: str) -> SignalModel:
        data = json.loads(text)
        if data.get("version") != VERSION:
            raise ValueError(f"model version {data.get('version')} is not {VERSION}")
        return cls(**data)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(tensor, exits) as DataFrames."""
        exits = spark.createDataFrame([tuple(e[c] for c in ("exit_id", *replays.EXIT_COLUMNS)) for e in self.exits], f"exit_id int, {replays.EXIT_SCHEMA}")
        tensor = spark.createDataFrame([tuple(t[c] for c in ("level", "channel", "symbol", "direction", "vol_regime", "exit_id")) for t in self.tensor], "level string, channel string, symbol string, direction string, vol_regime string, exit_id int")
        return tensor, exits

    @property
    def deployment(self) -> dict:
        """What the certificate allows: trade, or paper with the reasons."""
        if self.certificate.get("certified"):
            return {"verdict": "trade", "reasons": []}
        return {"verdict": "paper", "reasons": list(self.certificate.get("reasons", []))}

    @property
    def exit(self) -> dict:
        """Parameters of the exit that rules where no finer cell is known."""
        return next(e for e in self.exits if e["exit_id"] == next(t["exit_id"] for t in self.tensor if t["level"] == "global"))

    @property
    def reliable(self) -> bool:
        return self.reliability["reliable"]

    @property
    def confidence(self) -> float:
        return self.reliability["confidence"]

    @property
    def min_clusters(self) -> int:
        return self.config["min_clusters"]

    @property
    def min_shared_events(self) -> int:
        return graph.VIABILITY["min_shared"]

    @property
    def impact_horizon(self) -> int:
        """Candles that the ruling exit may hold."""
        return self.exit["stale"]

    @property
    def lookback(self) -> int:
        """Candles that live planning needs before a signal, for volume and pressure."""
        return max(self.exit["vol_baseline"], self.exit["cascade_window"] or self.exit["stale"]) + 5

    def report(self) -> str:
        c = self.certificate
        lines = [f"mode {self.mode} ({self.mode_reason}), exit {self.winner['exit_id']}, score {self.winner['cv_score']:.6f}", f"certified {c['certified']}" + (f": {', '.join(c['reasons'])}" if c["reasons"] else ""), f"confidence {self.reliability['confidence']:.3f}, trials {self.trials}", f"deployment {self.deployment['verdict']}, channels dropped or inverted {len(self.channel_plan)}"]
        return "\n".join(lines)


def gated(policy: dict, gate: float | None, momentum_window: int) -> dict:
    """A policy that also refuses what the learned gate refused in training; the stricter gate holds."""
    if gate is None:
        return dict(policy)
    asked = policy.get("min_momentum_pct")
    return {**policy, "min_momentum_pct": gate if asked is None else max(asked, gate), "momentum_window": policy.get("momentum_window") or momentum_window}


def can_refit(ledger: list[dict], now_ms: int, least_ms: int = WEEK_MS) -> bool:
    """Whether enough time has passed since the last attempt; repeated fits on one history inflate its best score."""
    return not ledger or now_ms - max(a["ts"] for a in ledger) >= least_ms


def effective_trials(ledger: list[dict], inner: int) -> int:
    return inner + sum(a["inner_trials"] for a in ledger)


def silent(phase: str, done: int, total: int) -> None:
    """Progress callback that says nothing."""


class Progress:
    """Progress callback that tells the share done, the pace, and from it the time left."""

    def __init__(self, write: Callable[[str], object] = print, clock: Callable[[], float] = time.monotonic):
        self.write, self.clock, self.began = write, clock, clock()

    def __call__(self, phase: str, done: int, total: int) -> None:
        if total <= 0:
            return
        if done <= 1:  # a new run; the first step's own time is known by the second
            self.began = self.began if done == 1 else self.clock()
        passed = max(self.clock() - self.began, 1e-9)
        left = passed / done * (total - done) if done else None
        tail = f", {done / passed * 60:.1f} a minute" + (f", {left // 60:.0f} min {left % 60:.0f} s left" if left else "") if done else ""
        self.write(f"{phase}: {done} of {total} ({100 * min(done / total, 1):.0f} %){tail}")


def stdout_progress() -> Progress:
    return Progress(lambda line: print(line, flush=True))


def fit(events: DataFrame, candles: DataFrame, axes: dict | None = None, config: dict | None = None, interval_ms: int = 60_000, ledger: list[dict] | None = None, policy: dict | None = None, min_clusters: tuple[int, ...] = (2, 3), gates: tuple[float | None, ...] | None = None, outer_folds: int = 4, momentum_window: int = 1440, refine_rounds: int | None = None, bootstraps: int = stats.BOOTSTRAPS, progress: Callable[[str, int, int], None] = silent, detectors: dict[str, list] | None = None, market_symbol: str | None = MARKET_SYMBOL) -> SignalModel:
    """Labels all candidate bursts under all exits, scores settings by purged folds, and certifies the choice.

    ``detectors`` has axes of the detector (window_k, jaccard, lag_peak, stationarity_ms); all combinations are tried. The
    default axes are tried where exits aren't given either, else only the configured values.
    Without axes they are calibrated from the candles, with the trading cost that the spread suggests; so are the momentum
    ``gates``, if they aren't given. A gate that wins is part of the model's policy, never weaker than the given one. Refinement
    (``refine_rounds``; by default only then) moves the chosen exit between the grid's steps. With a finite
    ``stationarity_ms`` the author graph is rebuilt for every moment.
    """
    spark = events.sparkSession
    cfg = CONFIG | (config or {})
    if refine_rounds is None:
        refine_rounds = 6 if axes is None else 0
    calibration = None
    if detectors is None:
        detectors = detector_ops.DETECTOR_AXES if axes is None else {}
    if axes is None:
        calibration = calibrate(events, candles, {k: DEFAULT_AXES[k] for k in ("stale", "stale_since")}, interval_ms)
        axes = DEFAULT_AXES | calibration["axes"] | {"round_trip_cost": [refinement.auto_cost(calibration["spread_pct"])]}
    if gates is None:
        gates = tuple(calibration["gates"]) if calibration else (None,)
    found = predict(events, cfg)
    mode, tau = found["mode"], found["tau"]["tau_ms"]
    progress("detect", 1, 5)
    chosen = detector_ops.settings(detectors, cfg, mode)
    if mode == "matrix":
        members = settle(detector_ops.correlated(events, chosen, tau, cfg))
    else:
        members = settle(detector_ops.collapsed(events, [int(min(c["window_k"] * tau, cfg["max_burst_ms"])) for c in chosen]))
        min_clusters = (1,)
    candidates = settle(detector_ops.distinct_bursts(members))
    grid = replays.exit_grid(spark, axes or DEFAULT_AXES)
    distinct = replays.distinct_by_pnl(grid).persist()
    before = settle(policies.pre_candle_features(candidates, candles, "burst_id", interval_ms, momentum_window, momentum_window).select("burst_id", "momentum", "range_pct", "compression", "last_close"))
    momentum = before.select("burst_id", "momentum")

    def labelled(rules: DataFrame) -> DataFrame:
        shape = rules.select("exit_id", (F.col("stale") * interval_ms).cast("long").alias("embargo_ms"), "hard_stop", "stale", "squeeze_policy")
        paths = replays.replay(candidates, candles, rules, interval_ms).where(~F.col("truncated"))
        return paths.join(candidates.select("burst_id", "channel", "ts_ms"), "burst_id").join(momentum, "burst_id", "left").join(F.broadcast(shape), "exit_id")

    labels = settle(labelled(distinct))
    progress("label", 2, 5)
    keys = ["setting", "min_clusters", "gate_id", "exit_id"]
    gate_ids = F.coalesce(*[F.when(F.col("gate").eqNullSafe(F.lit(g)), F.lit(i)) for i, g in enumerate(gates)])
    configured = settle(selection.configurations(detector_ops.with_settings(labels, members), list(min_clusters), list(gates)).withColumn("gate_id", gate_ids))
    shape = distinct.select("exit_id", "hard_stop", "stale", "squeeze_policy")
    scored = settle(selection.board(configured, keys).join(F.broadcast(shape), "exit_id"))
    top = selection.one_standard_error(scored, keys).first()
    if top is None:
        raise ValueError("no candidate could be labelled")
    progress("score", 3, 5)
    if refine_rounds:
        start = grid.where(F.col("exit_id") == top["exit_id"]).first().asDict()
        found_by = detector_ops.with_settings(candidates.join(momentum, "burst_id", "left"), members.where(F.col("setting") == top["setting"]))
        passing = selection.configurations(found_by, [top["min_clusters"]], [gates[top["gate_id"]]])
        better = refinement.refine(passing, candles, start, axes, interval_ms, refine_rounds, start_labels=labels.where(F.col("exit_id") == top["exit_id"]))
        if better["accepted"]:
            new = spark.createDataFrame([(len(grid.collect()), *(better["exit"][c] for c in replays.EXIT_COLUMNS))], f"exit_id int, {replays.EXIT_SCHEMA}")
            grid, distinct = grid.union(new), distinct.union(new)
            labels = settle(labels.unionByName(labelled(new)))
            configured = settle(selection.configurations(detector_ops.with_settings(labels, members), list(min_clusters), list(gates)).withColumn("gate_id", gate_ids))
            shape = distinct.select("exit_id", "hard_stop", "stale", "squeeze_policy")
            scored = settle(selection.board(configured, keys).join(F.broadcast(shape), "exit_id"))
            top = scored.where((F.col("exit_id") == new.first()["exit_id"]) & (F.col("setting") == top["setting"]) & (F.col("min_clusters") == top["min_clusters"]) & (F.col("gate_id") == top["gate_id"])).first()

    def mine(df: DataFrame) -> DataFrame:
        for k in keys:
            df = df.where(F.col(k) == top[k])
        return df

    nested = nested_score(configured, keys, shape, outer_folds)
    won = mine(configured)
    folds = [r.asDict() for r in selection.fold_scores(won, keys).orderBy("fold").collect()]  # four folds
    validated = stats.time_folds(won, keys, selection.FOLDS, "embargo_ms")
    moments = stats.moments(validated, [], "pnl").first()
    inner = scored.count()
    trials = effective_trials(ledger or [], inner)
    ratios = scored.where(F.col("n") >= 2).agg(F.coalesce(F.var_samp("sharpe"), F.lit(0.0))).first()[0]
    certificate = certificate_of(configured, scored, keys, moments, trials, ratios, nested, bootstraps)
    progress("nested", 4, 5)
    sizes, means = [f["size"] for f in folds], [f["mean"] for f in folds]
    reliable = reliability_of(means, sum(sizes), moments)
    winners = detector_ops.with_settings(labels, members.where(F.col("setting") == top["setting"]))
    tuned = settle(selection.configurations(winners, [top["min_clusters"]], [gates[top["gate_id"]]]).drop("setting", "min_clusters", "gate"))
    k = stats.empirical_pool_k(tuned.where(F.col("exit_id") == top["exit_id"]).withColumn("g", F.concat_ws("|", *KEY)), "g", "pnl").first()["k"]
    tensor = [r.asDict() for r in selection.exit_tensor(tuned, k).collect()]  # a row for each cell
    sides = spark.createDataFrame([t for t in tensor if t["level"] == "symbol-dir"] or [Row(level=None, channel=None, symbol=None, direction=None, vol_regime=None, exit_id=None)], "level string, channel string, symbol string, direction string, vol_regime string, exit_id int")
    history = settle(tuned.join(F.broadcast(sides.select(*KEY, "exit_id")), [*KEY, "exit_id"]))
    entered = history.where("entered")
    channel_k = stats.empirical_pool_k(entered, "channel", "pnl").first()["k"]
    rows_by = lambda df, key: {r[key]: {c: v for c, v in r.asDict().items() if c != key} for r in df.collect()}  # noqa: E731  a row for each channel or symbol
    trades = entered.drop("momentum").join(before, "burst_id", "left").join(candidates.select("burst_id", "entry_from", "entry_to"), "burst_id")
    known = prequential_win_rate(trade_evidence(trades, events, candles, tau, cfg["max_burst_ms"], interval_ms, momentum_window, market_symbol), "channel")
    model = fit_outcome_model(known.select((F.col("pnl") > 0).cast("int").alias("y"), "pnl", F.col("ts_ms").alias("ts"), *NUMERIC, *CATEGORICAL).toPandas(), [*NUMERIC, *CATEGORICAL])  # the chosen history
    channels = selection.channel_scores(entered, channel_k).join(algo_signature(events).select("channel", "algo_score"), "channel", "left")
    outcomes = {r["outcome"]: r["count"] for r in replays.label_outcomes(labels, candidates).groupBy("outcome").count().collect()}
    progress("tensor", 5, 5)
    return SignalModel(
        config={k_: (v if v != float("inf") else None) for k_, v in (cfg | chosen[top["setting"]] | {"min_clusters": top["min_clusters"] if mode == "matrix" else cfg["min_clusters"]}).items()}, mode=mode, exits=[r.asDict() for r in grid.collect()], tensor=tensor, winner={**top.asDict(), "gate": gates[top["gate_id"]]},
        certificate=certificate, reliability=reliable, nested_score=nested, channel_score=rows_by(channels, "channel"),
        channel_plan={r["channel"]: r["plan"] for r in selection.channel_triage(entered).collect()}, risk_reward=rows_by(stats.risk_reward(entered, ["symbol"], "pnl", "hard_stop"), "symbol"),
        pnl=rows_by(stats.pnl_stats(entered, ["symbol"], "pnl"), "symbol"), baseline=[r[0] for r in entered.select("pnl").collect()], outcome=model and model.to_json(),
        policy=gated(policy or {}, gates[top["gate_id"]], momentum_window), interval_ms=interval_ms, fit_attempts=len(ledger or []) + 1, momentum_window=momentum_window, trials=trials, inner_trials=inner, fitted_ms=int(time.time() * 1000),
        mode_reason=found["mode_reason"], market_symbol=market_symbol, history_size=sum(outcomes.values()), labeling=outcomes, calibration=calibration,
    )


def nested_score(configured: DataFrame, keys: list[str], shape: DataFrame, outer: int) -> float | None:
    """Mean result out of sample when the choice itself is repeated without each outer block of time.

    Blocks are equal spans of distinct times; training rows closer to the block than the longest life are left out.
    """
    times = stats.even_blocks(configured.select("ts_ms").distinct(), outer, "ts_ms")
    bounds = [r.asDict() for r in times.groupBy("block").agg(F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high")).orderBy("block").collect()]
    reach = configured.agg(F.max("embargo_ms")).first()[0] or 0
    scores = []
    for b in bounds:
        train = configured.where((F.col("ts_ms") < b["low"] - reach) | (F.col("ts_ms") > b["high"] + reach))
        top = selection.one_standard_error(selection.board(train, keys).join(F.broadcast(shape), "exit_id"), keys).first()
        if top is None:
            continue
        test = configured.where(F.col("ts_ms").between(b["low"], b["high"]))
        for k in keys:
            test = test.where(F.col(k) == top[k])
        scores.append(test.agg(stats.shrunk("pnl", selection.SHRINK_K)).first()[0])
    return round(float(np.mean(scores)), 6) if scores else None


def certificate_of(configured: DataFrame, scored: DataFrame, keys: list[str], moments: Row, trials: int, variance: float, nested: float | None, bootstraps: int = stats.BOOTSTRAPS, pool: int = 50, matrix: int = 30) -> dict:
    """Deflated Sharpe ratio, overfitting probability, reality check, track record and nested score of the choice."""
    spark = configured.sparkSession
    if moments["n"] < 2:
        return {"certified": False, "dsr": 0.0, "pbo": None, "spa": 1.0, "min_trl": None, "n": moments["n"], "nested": nested, "reasons": ["deflated-sharpe", "track-record"]}
    one = spark.createDataFrame([moments])
    dsr, needed = one.select(stats.deflated_sharpe(one, trials, variance).alias("d"), stats.min_track_record().alias("t")).first()
    best = scored.orderBy(F.desc("cv_score"), *keys).limit(pool).select(*keys, F.row_number().over(Window.orderBy(F.desc("cv_score"), *keys)).alias("config"))
    rows = configured.join(F.broadcast(best), keys)  # fifty settings
    series = rows.groupBy("config").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "burst_id", "pnl"))).alias("rs")).orderBy("config").collect()
    spa = float(stats.reality_check([np.array([x["pnl"] for x in r["rs"]]) for r in series], bootstraps=bootstraps))
    perf = rows.where(F.col("config") <= matrix).withColumn("fold", F.ntile(8).over(Window.partitionBy("config").orderBy("ts_ms", "burst_id"))).groupBy("config", "fold").agg(F.avg("pnl").alias("value"))
    pbo = stats.overfitting_probability(perf).first()["pbo"]
    passed, reasons = stats.certify(dsr, pbo, spa, moments["n"], needed, nested)
    return {"certified": passed, "dsr": round(dsr, 6), "pbo": None if pbo is None or math.isnan(pbo) else round(pbo, 6), "spa": round(spa, 6), "min_trl": round(needed, 3) if math.isfinite(needed) else None, "n": moments["n"], "nested": nested, "reasons": reasons}


def reliability_of(means: list[float], total: int, moments: Row) -> dict:
    n, mean, std = moments["n"], moments["mean"], moments["std"]
    avg, spread = (float(np.mean(means)), float(np.std(means, ddof=1)) if len(means) > 1 else 0.0) if means else (0.0, 0.0)
    stability = 0.0 if not means else 0.5 if len(means) == 1 else np.mean([m > 0 for m in means]) * (1 - (min(spread / abs(avg), 1) if avg else 1))
    significance = 0.0 if n < 2 or mean <= 0 else 1 - math.exp(-n / 200) if std <= abs(mean) * 1e-9 else 1 - math.exp(-mean / (std / math.sqrt(n)) / 2)
    support = total / (total + 30)
    confidence = round(float(support * stability * significance), 6)
    return {"support": round(support, 6), "stability": round(float(stability), 6), "significance": round(significance, 6), "confidence": confidence, "reliable": confidence >= 0.6 and total >= 40, "total_n": total}


_SIGNAL = ["seq", "symbol", "final_direction", "ts_ms", "action", "rejected_by", "inverted_from", "exit_id", "exit_source", "trailing_take", "hard_stop", "stale_profit", "stale_since", "stale", "vol_regime", "confidence", "independent_clusters", "liquidity_quote", "p_win", "expected_pnl", "risk_share", "channel"]


def _resolved(asks: DataFrame, model: SignalModel, side: str, with_regime: bool) -> DataFrame:
    """Adds the exit of each ask for a direction, with its parameters."""
    tensor, exits = model.tables(asks.sparkSession)
    keyed = asks.withColumns({"_post": F.col("direction"), "_channel": F.col("channel")}).withColumns({"direction": F.col(side), "channel": F.coalesce("channel", F.lit("_matrix"))})
    found = policies.with_exits(keyed, tensor, exits, with_regime)
    return found.withColumns({"direction": F.col("_post"), "channel": F.col("_channel")}).drop("_post", "_channel")


def _asked(verdicts: DataFrame, events: DataFrame | None, model: SignalModel, candles: DataFrame | None, policy: policies.Policy, live: bool) -> DataFrame:
    """Facts of each open verdict for the filter chain, from candles before it only; pressure only in live planning."""
    spark = verdicts.sparkSession
    out = verdicts.where(F.col("action") == "open").drop("action") if "action" in verdicts.columns else verdicts
    if "entry_from" not in out.columns:
        out = out.join(events.select("seq", "entry_from", "entry_to"), "seq")
    facts = [(c, model.channel_plan.get(c), s["score"], s.get("algo_score"), s.get("win_rate")) for c, s in model.channel_score.items()]
    ratios = [(s, float(v.get(policy.rr_metric or "mean", 0.0))) for s, v in model.risk_reward.items()]
    out = out.join(spark.createDataFrame(facts, "channel string, channel_plan string, channel_score double, algo double, channel_win_rate double"), "channel", "left")
    out = out.join(spark.createDataFrame(ratios, "symbol string, risk_reward double"), "symbol", "left")
    turned = F.col("channel").isNotNull() & (F.coalesce("channel_plan", F.lit("")) == "invert")
    out = out.withColumn("side", F.when(turned, F.when(F.col("direction") == "long", "short").otherwise("long")).otherwise(F.col("direction")))
    window = policy.momentum_window or model.momentum_window
    if candles is not None:
        # The exit that a calm market would get says how far back volume and pressure are read.
        calm = _resolved(out.withColumn("vol_regime", F.lit("calm")), model, "side", True)
        probe = calm.select(*out.columns, F.col("vol_baseline").alias("_base"), F.coalesce("cascade_window", "stale").alias("_hor"), F.col("vol_z_threshold").alias("_z"))
        back = max(window, 90, *(max(e["vol_baseline"], e["cascade_window"] or e["stale"]) + 1 for e in model.exits))
        before = policies.pre_candle_features(probe, candles, "seq", model.interval_ms, back, window, "_base", "_hor", "side")
        out = probe.join(before.withColumnRenamed("squeeze_before", "pressure"), "seq", "left").withColumn("vol_regime", F.when(F.col("vol_z").isNotNull(), F.when(F.col("vol_z") >= F.coalesce("_z", F.lit(2.0)), "anomalous").otherwise("calm"))).drop("_base", "_hor", "_z")
    unknown = {"vol_z": "double", "liquidity_quote": "double", "momentum": "double", "pressure": "double", "last_close": "double", "range_pct": "double", "compression": "double", "burst_score": "double", "confirm_span_ms": "double", "symbol_gap_ms": "double", "vol_regime": "string"}
    out = out.withColumns({c: F.lit(None).cast(t) for c, t in unknown.items() if c not in out.columns})
    if not live:
        out = out.withColumn("pressure", F.lit(None).cast("double"))
    outcome = OutcomeModel.from_json(model.outcome) if model.outcome else None
    learned = outcome is not None and "market" in outcome.numeric
    out = with_market(out, candles if learned else None, "seq", model.market_symbol, model.interval_ms, window)
    out = evidence(out).withColumns({"burst": F.col("burst_score"), "fatigue_gap": F.col("symbol_gap_ms")})
    scores = outcome_columns(outcome) if outcome else {c: F.lit(None).cast("double") for c in ("p_win", "expected_pnl", "risk_share")}
    return _resolved(out.withColumns({"has_outcome": F.lit(outcome is not None), **scores}), model, "side", candles is not None)


def _judged(verdicts: DataFrame, events: DataFrame | None, model: SignalModel, candles: DataFrame | None, policy: policies.Policy, live: bool) -> DataFrame:
    """Open verdicts with the filters' decision, and the exit of the direction that is traded in the end."""
    asked = _asked(verdicts, events, model, candles, policy, live)
    judged = policies.explained(policies.filter_chain(asked, policy, model.certificate["certified"], live), policy)
    factor = F.when(F.col("tightened"), F.col("tighten_factor"))
    final = judged.withColumn("_factor", factor).drop("exit_id", "exit_source", *replays.EXIT_COLUMNS)
    return _resolved(final, model, "final_direction", candles is not None).withColumn("trailing_take", F.when(F.col("_factor").isNotNull(), F.round(F.col("trailing_take") * F.col("_factor"), 6)).otherwise(F.col("trailing_take"))).drop("_factor")


def plan(events: DataFrame, model: SignalModel, candles: DataFrame | None = None, requested: policies.Policy | None = None, explain: bool = False) -> DataFrame:
    """Live signals of a model; candles at or after a signal are never looked at.

    explain keeps the rejected ones, with detail and values, and the detector's skips (rejected_by detector).
    """
    policy = policies.intersect(policies.Policy.from_dict(model.policy), requested)
    verdicts = settle(predict(events, {k: v for k, v in model.config.items() if v is not None} | {"mode": model.mode})["verdicts"])
    judged = _judged(verdicts, events, model, candles, policy, live=True)
    if not explain:
        return judged.where(F.col("rejected_by").isNull()).select(*_SIGNAL)
    skips = verdicts.where(F.col("action") == "skip").select("seq", "symbol", F.col("direction").alias("final_direction"), "ts_ms", "confidence", "independent_clusters", "channel", F.lit("detector").alias("rejected_by"), F.lit("no moment of enough independent authors").alias("detail"))
    return judged.select(*_SIGNAL, "detail", "values").unionByName(skips, allowMissingColumns=True)


def backtest(events: DataFrame, model: SignalModel, candles: DataFrame, requested: policies.Policy | None = None, net: bool = False) -> DataFrame:
    """Signals with what their exits earned on the candles ahead; gross of costs unless ``net``.

    Pressure looks ahead here, as in training, which live planning can't. The certificate isn't asked for.
    """
    verdicts = settle(predict(events, {k: v for k, v in model.config.items() if v is not None} | {"mode": model.mode})["verdicts"])
    return _traded(verdicts, events, model, candles, requested, net)


def _traded(verdicts: DataFrame, events: DataFrame | None, model: SignalModel, candles: DataFrame, requested: policies.Policy | None, net: bool) -> DataFrame:
    policy = policies.intersect(policies.Policy.from_dict(model.policy), requested)
    judged = _judged(verdicts, events, model, candles, policy, live=False).where(F.col("rejected_by").isNull())
    chosen = settle(judged.select(F.col("seq").alias("burst_id"), "symbol", F.col("final_direction").alias("direction"), "ts_ms", "entry_from", "entry_to", F.col("exit_id").alias("chosen"), "confidence", "channel"))
    _, exits = model.tables(verdicts.sparkSession)
    used = exits.join(F.broadcast(chosen.select(F.col("chosen").alias("exit_id")).distinct()), "exit_id", "left_semi")
    walked = replays.replay(chosen, candles, used, model.interval_ms)
    results = walked.join(chosen.select("burst_id", "chosen", "ts_ms", "confidence", "channel"), "burst_id").where(F.col("exit_id") == F.col("chosen"))
    return results.drop("chosen") if net else results.drop("chosen").withColumn("pnl", F.col("gross_pnl"))


def _position(spark: SparkSession, symbol: str, direction: str, channel: str | None, ts_ms: int) -> DataFrame:
    row = (0, symbol, direction, "open", ts_ms, 0.5, channel, 1, 1, None, None)
    return spark.createDataFrame([row], "seq long, symbol string, direction string, action string, ts_ms long, confidence double, channel string, independent_clusters long, total_channels long, entry_from double, entry_to double")


def plan_for(model: SignalModel, symbol: str, direction: str, channel: str | None, candles: DataFrame, requested: policies.Policy | None = None, explain: bool = False) -> DataFrame:
    """The live signal of one position that is asked for at the symbol's last candle; no row if a filter refuses it."""
    last = candles.where(F.col("symbol") == symbol).agg(F.max("ts_ms")).first()[0]
    policy = policies.intersect(policies.Policy.from_dict(model.policy), requested)
    judged = _judged(_position(candles.sparkSession, symbol, direction, channel, last or 0), None, model, candles, policy, live=True)
    return judged.select(*_SIGNAL, "detail", "values") if explain else judged.where(F.col("rejected_by").isNull()).select(*_SIGNAL)


def plan_for_at(model: SignalModel, symbol: str, direction: str, channel: str | None, candles: DataFrame, entry_ms: int, requested: policies.Policy | None = None, net: bool = False) -> DataFrame:
    """What one position entered at a time earned; the entry is the first open, as no zone is given."""
    return _traded(_position(candles.sparkSession, symbol, direction, channel, entry_ms), None, model, candles, requested, net)


def walk_forward(events: DataFrame, candles: DataFrame, slices: int = 4, interval_ms: int = 60_000, slots: int | None = None, **fit_options) -> dict:
    """Equal-count blocks; each is traded by a model fitted on what lies before it less the longest life."""
    blocks = stats.even_blocks(events, slices + 1, "ts_ms", "seq").persist()
    reach = max((fit_options.get("axes") or DEFAULT_AXES)["stale"]) * interval_ms
    out, pnls, rows = [], [], []
    for b in range(2, slices + 2):
        test = blocks.where(F.col("block") == b).drop("block")
        start = test.agg(F.min("ts_ms")).first()[0]
        train = blocks.where((F.col("block") < b) & (F.col("ts_ms") < start - reach)).drop("block")
        if train.limit(2).count() < 2:
            train = blocks.where(F.col("block") < b).drop("block")
        try:
            model = fit(train, candles, interval_ms=interval_ms, **fit_options)
        except ValueError as e:
            out.append({"slice": b - 1, "error": str(e), "entered": 0})
            continue
        traded = backtest(test, model, candles).where("entered").orderBy("ts_ms", "burst_id").select("ts_ms", "held", "pnl", F.col("confidence").alias("priority"), "truncated").toPandas()  # a block's signals, one exit each
        pnls += traded["pnl"].tolist()
        rows.append(traded)
        out.append({"slice": b - 1, "certified": model.certificate["certified"], "confidence": model.reliability["confidence"], "entered": len(traded)})
    equity = np.cumsum(pnls) if pnls else np.zeros(0)
    fall = float((np.maximum(np.maximum.accumulate(equity), 0) - equity).max()) if len(equity) else 0.0
    deviation = float(np.std(pnls, ddof=1)) if len(pnls) > 1 else 0.0
    result = {"slices": out, "pnls": pnls, "mean": float(np.mean(pnls)) if pnls else 0.0, "sharpe": float(np.mean(pnls) / deviation) if deviation > 0 else 0.0, "max_drawdown": round(fall, 6)}
    if slots and rows:
        import pandas as pd

        taken = stats.simulate_capital(pd.concat(rows), slots, interval_ms)
        result["capital"] = {"taken": int(taken["taken"].sum()), "skipped": int((~taken["taken"]).sum()), "sum": float(taken.loc[taken["taken"], "pnl"].sum())}
    return result


def assess(events: DataFrame, candles: DataFrame, placebo: bool = True, **options) -> dict:
    """trade, paper or no-edge, with reasons: the walk-forward chain, a placebo feed, and a final fit on everything."""
    real = walk_forward(events, candles, **options)
    control = walk_forward(placebo_shift(events).drop("shift_ms"), candles, **options) if placebo else None
    fitting = {k: v for k, v in options.items() if k not in ("slices", "slots")}
    try:
        model = fit(events, candles, **fitting)
    except ValueError as e:
        return {"verdict": "no-edge", "reasons": [str(e)], "walk_forward": real, "placebo": control, "model": None}
    reasons = []
    if real["mean"] <= 0:
        reasons.append("no gain out of sample")
    if control is not None and control["mean"] >= real["mean"]:
        reasons.append("placebo does as well")
    if not model.certificate["certified"]:
        reasons.append("not certified: " + ", ".join(model.certificate["reasons"]))
    verdict = "trade" if not reasons else "paper" if real["mean"] > 0 and "placebo does as well" not in reasons else "no-edge"
    return {"verdict": verdict, "reasons": reasons, "walk_forward": real, "placebo": control, "model": model}


@query("predict_verdicts")
def _predict(spark, sf_dir):
    found = predict(signals(spark, sf_dir), {"mode": "single"})
    return found["verdicts"].select(*KEY, "ts_ms", "seq", "confidence", F.array_join("ids", ",").alias("ids"), F.col("symbol_gap_ms").cast("double").alias("symbol_gap_ms"))


SMALL_AXES = {"trailing_take": [20.0, 60.0], "hard_stop": [50.0], "stale_profit": [30.0], "stale_since": [4], "stale": [12], "squeeze_policy": ["none", "veto"], "squeeze_threshold": [0.55], "cascade_window": [3]}


@query("fit_and_plan")
def _fit_and_plan(spark, sf_dir):
    events, candles = signals(spark, sf_dir), hourly(spark, sf_dir)
    model = SignalModel.load(fit(events, candles, SMALL_AXES, {"mode": "single"}, interval_ms=replays.HOUR, outer_folds=2, momentum_window=24, bootstraps=50).save())
    return plan(events, model, candles, policies.Policy(acknowledge_uncertified=True), explain=True).drop("values")
