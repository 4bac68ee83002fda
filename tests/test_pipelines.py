import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pipelines, policy

SCHEMA = "symbol string, ts_ms long, open double, high double, low double, close double, volume double"
EVENTS = "seq long, id string, channel string, symbol string, direction string, ts_ms long, entry_from double, entry_to double"
AXES = {"trailing_take": [1.0, 3.0], "hard_stop": [2.0], "stale_profit": [1.0], "stale_since": [20], "stale": [30], "squeeze_policy": ["none"]}


@pytest.fixture(scope="module")
def world(spark):
    """Prices rise after each post of the good channel and fall after each of the bad one."""
    rng, price, bars, posts = random.Random(11), 100.0, [], []
    drift = {}
    for k in range(60):
        at = k * 130 + 5
        good = k % 2 == 0
        posts.append((k, str(k), "good" if good else "bad", "S", "long", at * 60_000, None, None))
        drift |= {m: 0.0015 if good else -0.0015 for m in range(at, at + 25)}
    for m in range(60 * 130 + 60):
        new = price * (1 + drift.get(m, 0) + rng.uniform(-0.0004, 0.0004))
        bars.append(("S", m * 60_000, price, max(price, new) * 1.0002, min(price, new) * 0.9998, new, rng.uniform(5, 15)))
        price = new
    return spark.createDataFrame(posts, EVENTS).persist(), spark.createDataFrame(bars, SCHEMA).persist()


@pytest.fixture(scope="module")
def model(world):
    steps = []
    fitted = pipelines.fit(*world, AXES, {"mode": "single"}, outer_folds=2, momentum_window=30, bootstraps=20, refine_rounds=1, progress=lambda *x: steps.append(x[0]))
    assert steps == ["detect", "label", "score", "nested", "tensor"]
    return pipelines.SignalModel.load(fitted.save())


def test_fit_tells_channels_apart(model):
    assert model.channel_score["good"]["score"] > 0 > model.channel_score["bad"]["score"]
    assert model.channel_plan.get("bad") == "invert" and "good" not in model.channel_plan
    assert model.certificate["n"] > 20 and 0 <= model.reliability["confidence"] <= 1 and model.trials >= 2 and "exit" in model.report()
    with pytest.raises(ValueError):
        pipelines.SignalModel.load(model.save().replace('"version": 3', '"version": 2'))


def test_plans_never_read_the_future(world, model):
    events, candles = world
    early = events.where("seq <= 40")
    last = early.agg(F.max("ts_ms")).first()[0]
    known = candles.where(F.col("ts_ms") < last)
    rows = [pipelines.plan(early, model, c, policy.Policy(acknowledge_uncertified=True), explain=True).orderBy("seq").collect() for c in (known, candles)]
    assert rows[0] == rows[1] and any(r["action"] == "invert" for r in rows[0])
    refused = pipelines.plan(early, model, None, explain=True).select("rejected_by").distinct().collect()
    assert model.certificate["certified"] or [r[0] for r in refused] == ["uncertified-model"]


def test_backtest_is_gross_unless_asked(world, model):
    events, candles = world
    rows = pipelines.backtest(events, model, candles).collect()
    assert len(rows) == 60 and sum(r["pnl"] for r in rows if r["entered"]) > 0 and all(r["pnl"] == r["gross_pnl"] for r in rows)


def test_calibration_follows_the_noise(world):
    events, candles = world
    found = pipelines.calibrate(events, candles, {"stale": [60, 240, 100_000], "stale_since": [60]})
    assert found["noise_pct"] > 0 and found["axes"]["stale"] == [60, 240] and found["gates"][0] is None
    assert pipelines.calibrate(events, candles.limit(0), {"stale": [60], "stale_since": [60]})["axes"] == {}


def test_explanations_and_single_positions(spark, world, model):
    events, candles = world
    assert model.outcome and model.history_size == 60 and model.exit["stale"] == 30 and model.lookback == 35 and model.deployment["verdict"] in ("trade", "paper")
    shown = pipelines.plan(events, model, candles, policy.Policy(acknowledge_uncertified=True, min_p_win=1.0), explain=True).collect()
    refused = [r for r in shown if r["rejected_by"] == "min-pwin"]
    assert refused and all(r["detail"].startswith("chance to win ") and 0 < r["values"]["p_win"] == r["p_win"] < 1 for r in refused)
    assert len({r["p_win"] for r in shown}) > 1 or not model.outcome["informative"]
    last = candles.agg(F.max("ts_ms")).first()[0]
    asked = policy.Policy(acknowledge_uncertified=True)
    one = pipelines.plan_for(model, "S", "long", "good", candles, asked).collect()
    assert [(r["ts_ms"], r["final_direction"], r["channel"]) for r in one] == [(last, "long", "good")]
    turned = pipelines.plan_for(model, "S", "long", "bad", candles, asked, explain=True).first()
    assert turned["action"] == "invert" and turned["final_direction"] == "short"
    past = pipelines.plan_for_at(model, "S", "long", "good", candles, 5 * 60_000).first()
    assert past["entered"] and past["pnl"] == past["gross_pnl"] > 0


def test_detector_settings_are_tried(world):
    events, candles = world
    fitted = pipelines.fit(*world, {**AXES, "trailing_take": [1.0]}, {"mode": "single"}, outer_folds=2, momentum_window=30, bootstraps=20, refine_rounds=0, detectors={"window_k": [1, 3]}, market_symbol="S")
    assert fitted.inner_trials == 2 and fitted.winner["setting"] in (0, 1) and fitted.config["window_k"] == (1, 3)[fitted.winner["setting"]]


def test_a_gate_that_wins_reaches_the_policy(world):
    """Of the good channel's posts only those after a rise gain: the gate is learned and live planning refuses the rest."""
    events, candles = world
    rng, price, bars, posts, drift = random.Random(5), 100.0, [], [], {}
    for k in range(60):
        at, rising = k * 130 + 60, k % 2 == 0
        posts.append((k, str(k), "one", "S", "long", at * 60_000, None, None))
        drift |= {m: 0.0008 if rising else -0.0008 for m in range(at - 30, at)} | {m: 0.0015 if rising else -0.0015 for m in range(at, at + 25)}
    for m in range(60 * 130 + 120):
        new = price * (1 + drift.get(m, 0) + rng.uniform(-0.0004, 0.0004))
        bars.append(("S", m * 60_000, price, max(price, new) * 1.0002, min(price, new) * 0.9998, new, rng.uniform(5, 15)))
        price = new
    spark = events.sparkSession
    events, candles = spark.createDataFrame(posts, EVENTS).persist(), spark.createDataFrame(bars, SCHEMA).persist()
    axes = {**AXES, "trailing_take": [3.0]}
    fitted = pipelines.fit(events, candles, axes, {"mode": "single"}, outer_folds=2, momentum_window=30, bootstraps=20, refine_rounds=0, gates=(None, 1.0), policy={"min_momentum_pct": 0.5})
    assert fitted.winner["gate"] == 1.0 and fitted.policy == {"min_momentum_pct": 1.0, "momentum_window": 30} and fitted.fit_attempts == 1
    shown = pipelines.plan(events, fitted, candles, policy.Policy(acknowledge_uncertified=True), explain=True).collect()
    refused = {r["seq"] for r in shown if r["rejected_by"] == "momentum-gate"}
    assert refused and all(s % 2 for s in refused) and {r["seq"] for r in shown if r["rejected_by"] is None} <= set(range(0, 60, 2))
    traded = {r["burst_id"] for r in pipelines.backtest(events, fitted, candles).collect()}
    assert traded and all(s % 2 == 0 for s in traded)


def test_gates_only_tighten():
    assert pipelines.gated({}, None, 30) == {} and pipelines.gated({"min_momentum_pct": 2.0, "momentum_window": 9}, 1.0, 30) == {"min_momentum_pct": 2.0, "momentum_window": 9}


def test_progress_tells_the_time_left():
    lines, clock = [], iter([0.0, 30.0, 60.0, 150.0])
    told = pipelines.Progress(lines.append, lambda: next(clock))
    for k, phase in enumerate(("detect", "label", "score"), 1):
        told(phase, k, 5)
    assert lines == ["detect: 1 of 5 (20 %), 2.0 a minute, 2 min 0 s left", "label: 2 of 5 (40 %), 2.0 a minute, 1 min 30 s left", "score: 3 of 5 (60 %), 1.2 a minute, 1 min 40 s left"]


@pytest.mark.parametrize("author_graph", ["xcorr", "hawkes"])
def test_a_matrix_fit_by_default_settings(spark, author_graph):
    """All default detector settings, graphs of moving windows, axes and gates from the candles: echoes count as one author."""
    rng, posts, bars = random.Random(4), [], []
    for k in range(30):
        at = k * 240 + 30
        posts += [("lead", at * 60_000), ("echo", at * 60_000 + 90_000 + rng.randint(0, 20_000)), ("own", at * 60_000 + rng.randint(60_000, 200_000))]
        posts += [(c, (at + rng.randint(60, 200)) * 60_000) for c in ("x", "y") if rng.random() < 0.5]
    rows = [(k, str(k), c, "S", "long", t, None, None) for k, (c, t) in enumerate(sorted(posts, key=lambda p: p[1]))]
    price = 100.0
    for m in range(30 * 240 + 900):
        new = price * (1 + rng.uniform(-0.001, 0.00105))
        bars.append(("S", m * 60_000, price, max(price, new) * 1.0002, min(price, new) * 0.9998, new, rng.uniform(5, 15)))
        price = new
    events, candles = spark.createDataFrame(rows, EVENTS).persist(), spark.createDataFrame(bars, SCHEMA).persist()
    small = {"trailing_take": [1.0], "hard_stop": [2.0], "stale_profit": [1.0], "stale_since": [20], "stale": [30]}
    fitted = pipelines.fit(events, candles, small, {"mode": "matrix", "author_graph": author_graph}, detectors=pipelines.detector_ops.DETECTOR_AXES, min_clusters=(1, 2), outer_folds=2, momentum_window=30, bootstraps=10, refine_rounds=0)
    assert fitted.mode == "matrix" and fitted.config["author_graph"] == author_graph and fitted.config["stationarity_ms"] in pipelines.detector_ops.DETECTOR_AXES["stationarity_ms"]
    assert fitted.inner_trials > 48 and fitted.history_size > 0
    shown = pipelines.plan(events, fitted, candles, policy.Policy(acknowledge_uncertified=True), explain=True).collect()
    assert shown and {r["channel"] for r in shown} == {None}
