import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.operators import bursts, graph, outcome, policy, replay, stats
from tidemark.plans.joins import anchored_groups, band_join
from tidemark.sources import candles as candle_source
from tidemark.sources.signals import normalize


def walk(bars, side, zone, rule):
    """One trade, candle by candle: the plain reading that the plan's first triggers must equal."""
    lo, hi = min(zone), max(zone)
    at = next((i for i, b in enumerate(bars) if b["low"] <= hi and b["high"] >= lo), None)
    if at is None:
        return ("no-entry", 0.0, 0)
    e = bars[at]["close"] if lo <= bars[at]["close"] <= hi else min(max((lo + hi) / 2, bars[at]["low"]), bars[at]["high"])
    gain = lambda p: (p - e) / e if side == "long" else (e - p) / e
    peak, since = 0.0, 0
    life = min(rule["stale"], len(bars) - at - 1)
    for k in range(life + 1):
        b = bars[at + k]
        worst, best = sorted((gain(b["low"]), gain(b["high"])))
        if worst <= -rule["hard_stop"] / 100:
            return ("hard-stop", -rule["hard_stop"] / 100, k)
        if best > peak:
            peak, since = best, k
        now = gain(b["close"])
        if now >= 0 and peak > 0 and peak - now >= rule["trailing_take"] / 100:
            return ("trailing-take", now, k)
        if peak >= rule["stale_profit"] / 100 and k - since >= rule["stale_since"]:
            return ("peak-staleness", now, k)
    return ("life-cap", gain(bars[at + life]["close"]), life)


def random_market(seed, n=60):
    rng, price, bars = random.Random(seed), 100.0, []
    for i in range(n):
        nxt = price * (1 + rng.uniform(-0.02, 0.02))
        bars.append({"symbol": f"s{seed}", "ts_ms": i * 60_000, "open": price, "close": nxt, "high": max(price, nxt) * (1 + rng.random() * 0.005), "low": min(price, nxt) * (1 - rng.random() * 0.005), "volume": float(rng.randint(1, 9))})
        price = nxt
    return bars


def test_replay_equals_the_sequential_walk(spark):
    rules = [{"trailing_take": t, "hard_stop": h, "stale_profit": 1.0, "stale_since": 5, "stale": s} for t in (0.5, 2.0) for h in (1.0, 4.0) for s in (10, 20)]
    markets = {f"s{k}": random_market(k) for k in range(12)}
    posts = [(k, f"s{k}", "long" if k % 2 else "short", 60_000 * (k % 5) + 1, *((99.0, 101.0) if k % 3 else (None, None))) for k in range(12)]
    bursts = spark.createDataFrame(posts, "burst_id long, symbol string, direction string, ts_ms long, entry_from double, entry_to double")
    candles = spark.createDataFrame([tuple(b.values()) for m in markets.values() for b in m], "symbol string, ts_ms long, open double, close double, high double, low double, volume double")
    grid = spark.createDataFrame([(i, *[(replay.EXIT_DEFAULTS | r)[c] for c in replay.EXIT_COLUMNS]) for i, r in enumerate(rules)], f"exit_id int, {replay.EXIT_SCHEMA}")
    got = {(r["burst_id"], r["exit_id"]): r for r in replay.replay(bursts, candles, grid).collect()}
    seen = set()
    for k, symbol, side, ts, a, b in posts:
        ahead = [x for x in markets[symbol] if x["ts_ms"] >= ts][:45]
        zone = (a if a is not None else ahead[0]["open"], b if b is not None else ahead[0]["open"])
        for i, rule in enumerate(rules):
            reason, pnl, held = walk(ahead, side, zone, rule)
            row = got[k, i]
            seen.add(reason)
            assert (row["reason"], row["held"]) == (reason, held)
            assert row["pnl"] == pytest.approx(pnl, abs=1e-12)
    assert len(seen) >= 3


def test_costs_lower_each_trade_by_the_same_amount(spark):
    bars = random_market(5)
    candles = spark.createDataFrame([tuple(b.values()) for b in bars], "symbol string, ts_ms long, open double, close double, high double, low double, volume double")
    bursts = spark.createDataFrame([(1, "s5", "long", 0, None, None)], "burst_id long, symbol string, direction string, ts_ms long, entry_from double, entry_to double")
    grid = replay.exit_grid(spark, {"trailing_take": [1.0], "hard_stop": [2.0], "stale_profit": [1.0], "stale_since": [5], "stale": [20], "round_trip_cost": [0.0, 0.3]})
    free, costly = replay.replay(bursts, candles, grid).orderBy("exit_id").collect()
    assert free["pnl"] - costly["pnl"] == pytest.approx(0.003) and free["gross_pnl"] == costly["gross_pnl"]


def test_features_never_see_the_future(spark):
    bars = random_market(3)
    schema = "symbol string, ts_ms long, open double, close double, high double, low double, volume double"
    asks = spark.createDataFrame([(1, "s3", "long", 30 * 60_000)], "seq long, symbol string, direction string, ts_ms long")
    poisoned = [b if b["ts_ms"] < 30 * 60_000 else {**b, "close": 1e9, "volume": 1e9} for b in bars]
    a, b = (policy.pre_candle_features(asks, spark.createDataFrame([tuple(x.values()) for x in m], schema), "seq").collect() for m in (bars, poisoned))
    assert a == b and a[0]["vol_z"] is not None


def test_anchored_groups_compare_with_the_first_row(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 3000), i) for i in range(400)] + [("c", 5, 900), ("c", 5, 901)]
    got = {(r["k"], r["seq"]): (r["anchor_ts"], r["anchor_seq"]) for r in anchored_groups(spark.createDataFrame(rows, "k string, ts_ms long, seq long"), ["k"], 25).collect()}
    for key in "abc":
        anchor = None
        for _, ts, seq in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if anchor is None or ts - anchor[0] > 25:
                anchor = (ts, seq)
            assert got[key, seq] == anchor


@pytest.mark.parametrize("width", [0, 1, 50, 900])
def test_a_key_without_gaps_is_collapsed_in_spans(spark, width):
    rng, rows = random.Random(1), []
    for key, gap in (("a", 3), ("b", 40), ("c", 400), ("d", 0)):
        ts = rng.randint(0, 5000)
        for _ in range(600):
            ts += int(rng.expovariate(1 / gap)) if gap else rng.choice([0, 0, 1])
            rows.append((key, ts, len(rows), rng.randint(0, width)))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, ts_ms long, seq long, own long")
    for column in (False, True):
        found = anchored_groups(frame, ["k"], "own", most=width) if column else anchored_groups(frame, ["k"], width)
        got, want = {(r["k"], r["seq"]): (r["anchor_ts"], r["anchor_seq"]) for r in found.collect()}, {}
        for key in "abcd":
            anchor = None
            for _, ts, seq, own in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
                if anchor is None or ts > anchor[0] + (anchor[2] if column else width):
                    anchor = (ts, seq, own)
                want[key, seq] = anchor[:2]
        assert got == want


def test_sweeps_equal_each_row_with_its_window(spark):
    rng = random.Random(6)
    rows = sorted([(rng.choice("AB"), "long", rng.choice("pqrst"), rng.randint(0, 4000) // 7 * 7) for _ in range(500)], key=lambda r: r[3])
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, symbol string, direction string, channel string, ts_ms long")
    author, weight = dict(zip("pqrst", (0, 0, 1, 2, 2))), dict(zip("pqrs", (0.5, 0.25, 1.0, 0.125)))
    authors = spark.createDataFrame(list(author.items()), "channel string, author_id long")
    influence = spark.createDataFrame(list(weight.items()), "channel string, influence double")
    got = {r["seq"]: r for r in bursts.trailing_slices(events, authors, 70, influence).collect()}
    excited = {r["seq"]: r["excitation"] for r in bursts.hawkes_burst(events, 21.0).collect()}
    assert len(got) == len(excited) == len(rows)
    for i, (symbol, _, _, ts) in enumerate(rows):
        inside = [r[2] for r in rows[: i + 1] if r[0] == symbol and ts - r[3] <= 70]
        per_author = Counter(author[c] for c in inside)
        want = (len(inside), len(per_author), len(set(inside)), len(inside) ** 2 / sum(n * n for n in per_author.values()), sum(weight.get(c, 0.5) for c in set(inside)) / len(set(inside)))
        assert (got[i]["posts"], got[i]["independent_clusters"], got[i]["total_channels"], got[i]["n_eff"], got[i]["leader_share"]) == pytest.approx(want)
        assert excited[i] == pytest.approx(sum(math.exp(-(ts - r[3]) / 21.0) for r in rows[:i] if r[0] == symbol and ts - r[3] <= 420))


def test_band_join_finds_every_pair_once(spark):
    rng = random.Random(2)
    left, right = [[(rng.choice("xy"), rng.randint(-500, 500), i) for i in range(80)] for _ in range(2)]
    l, r = spark.createDataFrame(left, "k string, a long, i long"), spark.createDataFrame(right, "k string, b long, j long")
    for low, high in ((-30, 0), (1, 40), (-25, 25), (0, 0)):
        got = sorted((x["i"], x["j"]) for x in band_join(l, r, ["k"], "a", "b", low, high).collect())
        assert got == sorted((i, j) for k, a, i in left for q, b, j in right if k == q and low <= b - a <= high)


def test_normalize_drops_what_cannot_be_used(spark):
    raw = spark.createDataFrame(
        [(0, "7", "c", "S", "long", 5, 1.0, 2.0), (1, None, None, "S", "long", 5, None, None), (2, "8", "c", "S", "up", 5, None, None), (3, "9", "c", "S", "short", None, None, None), (4, None, "c", "S", "short", 6, float("nan"), 3.0)],
        "seq long, id string, channel string, symbol string, direction string, ts_ms long, entry_from double, entry_to double",
    )
    assert [(r["seq"], r["entry_from"], r["entry_to"]) for r in normalize(raw).orderBy("seq").collect()] == [(0, 1.0, 2.0), (4, None, 3.0)]


def test_candle_times(spark):
    row = spark.range(1).select(candle_source.align(F.lit(125_000), "1m").alias("a"), candle_source.entry_start(F.lit(125_000), "1m").alias("b"), candle_source.entry_start(F.lit(120_000), "1m").alias("c")).first()
    assert tuple(row) == (120_000, 180_000, 120_000)


def test_greedy_matching_is_one_to_one():
    assert graph.greedy_matches([0, 10], [5, 1000], 10) == 1
    assert graph.greedy_matches([0, 100, 200], [1, 101, 201], 5) == 3
    assert graph.greedy_matches([], [1], 5) == 0


def test_screen_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, f"c{rng.randint(0, 5)}", rng.choice(["A", "B"]), "long", rng.randint(0, 4000)) for i in range(160)]
    events = spark.createDataFrame(rows, "seq long, channel string, symbol string, direction string, ts_ms long")
    for threshold in (0.05, 0.3):
        got = {(r["a"], r["b"]): r["jaccard"] for r in graph.jaccard_screen(events, 60, threshold).collect()}
        first = {}
        for _, c, _, _, ts in sorted(rows, key=lambda r: (r[4], r[0])):
            first.setdefault(c, len(first))
        want = {}
        for a in first:
            for b in first:
                if first[a] < first[b]:
                    m = sum(graph.greedy_matches(sorted(r[4] for r in rows if r[1] == a and r[2] == s), sorted(r[4] for r in rows if r[1] == b and r[2] == s), 60) for s in "AB")
                    j = 2 * m / (sum(r[1] == a for r in rows) + sum(r[1] == b for r in rows))
                    if j >= threshold:
                        want[a, b] = j
        assert got == pytest.approx(want)


def test_clusters_are_connected_components(spark):
    channels = spark.createDataFrame([(f"c{i}", i) for i in range(7)], "channel string, rank int")
    edges = spark.createDataFrame([("c5", "c1"), ("c1", "c3"), ("c4", "c6")], "a string, b string")
    got = {r["channel"]: r["author_id"] for r in graph.cluster_authors(channels, edges).collect()}
    assert got == {"c0": 0, "c1": 1, "c3": 1, "c5": 1, "c2": 2, "c4": 3, "c6": 3}


def test_normal_functions(spark):
    assert normal.quantile(0.975) == pytest.approx(1.959964, abs=1e-5) and normal.quantile(0.001) == pytest.approx(-3.090232, abs=1e-5)
    assert normal.quantile(0) == -math.inf and normal.expected_max_sharpe(1.0, 1) == 0
    assert spark.range(1).select(normal.cdf(F.lit(1.96)).alias("p")).first()["p"] == pytest.approx(0.975, abs=1e-4)


def test_generator_and_bootstrap():
    draw = stats.mulberry32(12345, block=7)
    again = stats.mulberry32(12345)
    assert [draw() for _ in range(40)] == [again() for _ in range(40)]
    assert stats.mulberry32(1)() == pytest.approx(0.6270739405881613)
    noise = np.random.default_rng(0).normal(0, 0.01, 120)
    assert stats.reality_check([noise + 0.006], 100) <= 0.05 < stats.reality_check([noise - noise.mean()], 100)
    assert stats.reality_check([]) == 1.0


def test_slots_are_greedy():
    trades = pd.DataFrame({"ts_ms": [0, 0, 60_000, 120_000], "held": [2, 2, 5, 1], "priority": [1.0, 2.0, None, None]})
    out = stats.simulate_capital(trades, 1)
    assert dict(zip(out.index, out["taken"])) == {1: True, 0: False, 2: False, 3: True}


def test_isotonic_blocks_and_informative_model():
    steps = outcome.pool_adjacent([1, 2, 3, 4], [1, 0, 1, 1])
    assert steps.breaks == [2.0, 3.0, 4.0]
    assert steps.values == sorted(steps.values)
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = (x + rng.normal(size=400) * 0.5 > 0).astype(int)
    rows = pd.DataFrame({"y": y, "pnl": np.where(y, 0.02, -0.01), "ts": np.arange(400), "x": x, "junk": rng.normal(size=400)})
    model = outcome.fit_outcome_model(rows, ["x", "junk"])
    assert model.informative and "x" in model.numeric and "junk" not in model.numeric
    assert model.predict({"x": 2.0})["p_win"] > 0.6 > 0.4 > model.predict({"x": -2.0})["p_win"]
    assert outcome.OutcomeModel.from_json(model.to_json()).predict({"x": 1.0}) == model.predict({"x": 1.0})
    assert outcome.fit_outcome_model(rows[:10], ["x"]) is None


def test_policies_only_tighten():
    trained = policy.Policy(allow=("enter", "tighten"), min_channel_score=0.1, max_liquidity_share=0.2)
    asked = policy.Policy(allow=("tighten", "invert"), min_channel_score=0.05, max_liquidity_share=0.5, require_volume_confirm=True)
    both = policy.intersect(trained, asked)
    assert both.allow == ("tighten",) and both.min_channel_score == 0.1 and both.max_liquidity_share == 0.2 and both.require_volume_confirm and both.rr_metric == "mean"


def test_first_refusal_wins(spark):
    base = {"direction": "long", "channel": "c", "channel_plan": None, "risk_reward": 1.0, "channel_score": 0.5, "vol_regime": "calm", "momentum": 1.0, "liquidity_quote": 100.0, "pressure": 0.9, "p_win": 0.5, "expected_pnl": 0.0, "squeeze_policy": "veto", "squeeze_threshold": 0.6, "has_outcome": True}
    kinds = "direction string, channel string, channel_plan string, risk_reward double, channel_score double, vol_regime string, momentum double, liquidity_quote double, pressure double, p_win double, expected_pnl double, squeeze_policy string, squeeze_threshold double, has_outcome boolean"
    def judge(changes, pol=policy.Policy(), certified=True):
        return policy.filter_chain(spark.createDataFrame([tuple((base | changes).values())], kinds), pol, certified, True).first()

    assert judge({})["rejected_by"] == "cascade-veto"
    assert judge({}, certified=False)["rejected_by"] == "uncertified-model"
    assert judge({"channel_plan": "drop"})["rejected_by"] == "channel-plan:drop"
    assert judge({}, policy.Policy(min_risk_reward=2.0, require_volume_confirm=True))["rejected_by"] == "min-risk-reward"
    assert judge({"squeeze_policy": "none"}, policy.Policy(notional_quote=11.0))["rejected_by"] == "capacity"
    flipped = judge({"squeeze_policy": "invert"})
    assert (flipped["rejected_by"], flipped["action"], flipped["final_direction"]) == (None, "invert", "short")
    assert judge({"squeeze_policy": "invert"}, policy.Policy(allow=("enter",)))["rejected_by"] == "invert-not-allowed"
    assert judge({"pressure": None})["action"] == "enter"


def test_capital_queries_take_all_orders(spark, sf_dir):
    assert stats._trades(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
