import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bursts, graph, outcome, policy, refinement, replay, stats, windowed_graph
from tidemark.operators.events import channels_in_order
from tidemark.plans import joins
from tidemark.sources import candles as candle_source, storage
from tidemark.streaming.harvest import harvest

import plain_graph
from test_kernels import random_market

EVENTS = "seq long, id string, channel string, symbol string, direction string, ts_ms long"


def echo_feed(n=40, seed=3):
    """Two channels echo a third within minutes, two post on their own."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        at, symbol = k * 4_000_000 + rng.randint(0, 900_000), rng.choice(["A", "B"])
        rows += [("lead", symbol, at), ("echo1", symbol, at + 150_000 + rng.randint(0, 40_000)), ("echo2", symbol, at + 200_000 + rng.randint(0, 40_000))]
        rows += [(c, rng.choice(["A", "B"]), k * 4_000_000 + rng.randint(0, 4_000_000)) for c in ("x", "y")]
    return [(i, str(i), c, s, "long", t) for i, (c, s, t) in enumerate(sorted(rows, key=lambda r: r[2]))]


def test_graph_on_the_cluster_equals_the_local_one(spark):
    rows = echo_feed()
    events = spark.createDataFrame(rows, EVENTS).persist()
    local = [(f"{s}|{d}", t, c) for _, _, c, s, d, t in rows]
    tau = plain_graph.tune_lag(local)
    assert graph.self_tune_lag(events)["tau_ms"] == pytest.approx(tau, rel=1e-6)
    window = 600_000
    want = {(a, b): (round(j, 9), abs(lag), round(p, 9)) for a, b, j, lag, p in plain_graph.edges_of(local, window, 0.3, 0.5)}
    edges = graph.lag_edges(events, graph.jaccard_screen(events, window, 0.3), 0.5, window)
    got = {(r["a"], r["b"]): (round(r["jaccard"], 9), r["lag_ms"], round(r["peak_share"], 9)) for r in edges.collect()}
    assert got == want and {frozenset(p) for p in want} >= {frozenset(("lead", "echo1")), frozenset(("lead", "echo2"))}
    authors = {r["channel"]: r["author_id"] for r in graph.cluster_authors(channels_in_order(events), edges).collect()}
    assert authors == plain_graph.clusters_of(local, plain_graph.edges_of(local, window, 0.3, 0.5)) and authors["lead"] == authors["echo1"] == authors["echo2"] != authors["x"]


def test_echoes_are_found_by_the_excitation_graph(spark):
    events = spark.createDataFrame(echo_feed(25), EVENTS).persist()
    edges = {(r["leader"], r["follower"]) for r in graph.hawkes_graph(events, 180_000.0).collect()}
    assert ("lead", "echo1") in edges and not edges & {("x", "y"), ("y", "x")}


def plain_windowed(rows, span, setting, author_graph):
    """Bursts by the definition: a graph from nothing for each time that the walk asks for."""
    local = [(f"{s}|{d}", t, c) for _, _, c, s, d, t in rows]

    def context(at):
        seen = [e for e in local if at - span < e[1] <= at]
        tau = plain_graph.tune_lag(seen)
        window = int(min(setting["window_k"] * tau, 3_600_000))
        edges = plain_graph.excited_edges(seen, tau) if author_graph == "hawkes" else plain_graph.edges_of(seen, window, setting["jaccard"], setting["lag_peak"])
        return window, plain_graph.clusters_of(seen, edges)

    contexts = {at: context(at) for at in sorted({t for _, t, _ in local})}
    out = []
    for key in {k for k, _, _ in local}:
        own = [(t, q, i, c) for q, i, c, s, d, t in rows if f"{s}|{d}" == key]
        first = 0
        while first < len(own):
            group = [r for r in own[first:] if r[0] - own[first][0] <= contexts[own[first][0]][0]]
            best = None
            for k, (t, q, _, _) in enumerate(group):
                window, authors = contexts[t]
                inside = [r for r in group[: k + 1] if t - r[0] <= window]
                channels, n = {r[3] for r in inside}, len({authors[r[3]] for r in inside})
                confidence = round(n / len(channels) * min(len(inside) / 4, 1), 6)
                if best is None or (n, confidence) > best[:2]:
                    best = (n, confidence, t, q, len(channels), t - inside[0][0])
            out.append((best[2], best[3], best[0], best[4], best[1], best[5], [r[2] for r in group]))
            first += len(group)
    return sorted(out)


def test_excitation_in_arrays_equals_the_loops():
    rows = [(f"{s}|{d}", t, c) for _, _, c, s, d, t in echo_feed(30)]
    key, channel = pd.factorize(pd.Series([r[0] for r in rows]))[0], pd.factorize(pd.Series([r[2] for r in rows]))
    ts = np.array([r[1] for r in rows])
    pairs = windowed_graph.pairs_within(key, ts, windowed_graph.REACH_MS)
    process = windowed_graph.Excitation(pairs, ts, channel[0], key, len(channel[1]), 2)
    for low, high in ((0, len(rows)), (20, 140), (37, len(rows))):
        got = {(channel[1][i], channel[1][j]) for i, j in process.edges(low, high, 180_000.0)}
        assert got == set(plain_graph.excited_edges(rows[low:high], 180_000.0))
    assert ("lead", "echo1") in got


@pytest.mark.parametrize("author_graph", ["xcorr", "hawkes"])
def test_windowed_bursts_equal_graphs_from_nothing(spark, author_graph):
    rng = random.Random(8)
    rows = echo_feed(22)
    rows += [(len(rows) + k, None if k % 3 == 0 else f"t{k}", rng.choice(["x", "lead", "z"]), "A", "long", rng.choice(rows)[5]) for k in range(12)]  # equal times
    rows.sort(key=lambda r: (r[5], r[0]))
    events = spark.createDataFrame(rows, EVENTS).persist()
    settings = [{"window_k": k, "jaccard": j, "lag_peak": p, "stationarity_ms": span} for span in (3_600_000, 20_000_000, 10**12) for k, j, p in ((3, 0.3, 0.5), (2, 0.1, 0.3))]
    got = {}
    for r in bursts.enumerate_windowed(events, settings, author_graph=author_graph).collect():
        got.setdefault(r["setting"], []).append((r["ts_ms"], r["seq"], r["independent_clusters"], r["total_channels"], r["confidence"], r["confirm_span_ms"], r["ids"]))
    for number, setting in enumerate(settings):
        want = plain_windowed(rows, setting["stationarity_ms"], setting, author_graph)
        assert sorted(got[number]) == [(*w[:6], [i for i in w[6] if i is not None]) for w in want], setting
    assert author_graph == "hawkes" or any(r[2] < r[3] for rs in got.values() for r in rs)  # authors of several channels are found


def test_refinement_only_accepts_what_is_better(spark):
    schema = "symbol string, ts_ms long, open double, close double, high double, low double, volume double"
    candles = spark.createDataFrame([tuple(b.values()) for b in random_market(5, 400)], schema)
    posts = spark.createDataFrame([(k, "s5", "long", k * 600_000, None, None) for k in range(30)], "burst_id long, symbol string, direction string, ts_ms long, entry_from double, entry_to double")
    start = replay.EXIT_DEFAULTS | {"trailing_take": 1.0, "hard_stop": 2.0, "stale_profit": 1.0, "stale_since": 5, "stale": 20, "cascade_window": 5}
    out = refinement.refine(posts, candles, start, {"hard_stop": [1.0, 2.0, 4.0]}, 60_000, rounds=1)
    assert out["tried"] > 5 and out["accepted"] in (0, 1) and out["score"] is not None
    assert refinement.bracket([1, 2, 4], 2) == (1, 4) and refinement.bracket([1, 2], 2) == (1, 3.0)


def test_market_momentum_is_the_benchmarks_own(spark):
    schema = "symbol string, ts_ms long, open double, close double, high double, low double, volume double"
    bars = random_market(1)
    candles = spark.createDataFrame([tuple(b.values()) for b in bars], schema)
    asks = spark.createDataFrame([(1, "other", "long", 30 * 60_000)], "seq long, symbol string, direction string, ts_ms long")
    got = policy.market_momentum(asks, candles, "seq", "s1").first()["market"]
    assert got == pytest.approx((bars[29]["close"] / bars[0]["close"] - 1) * 100)


def test_ledger_and_costs():
    ledger = refinement.Ledger().record(1000, 50, False).record(2000, 70, True)
    assert ledger.effective_trials(10) == 130 and not ledger.can_refit(3000) and ledger.can_refit(2000 + refinement.WEEK_MS)
    assert refinement.auto_cost(0.02) == 0.12 and refinement.auto_cost(0.02, 0.5) == 0.5 and refinement.auto_cost(None) == 0.0


def test_candle_stores(spark, tmp_path):
    rows = [("S", k * 60_000, 1.0, 2.0, 0.5, float(k), 1.0) for k in range(3000)]
    frame = spark.createDataFrame(rows, "symbol string, ts_ms long, open double, high double, low double, close double, volume double")
    candle_source.write_by_day(frame, str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    assert [r["ts_ms"] for r in candle_source.read_range(stored, "S", "1m", limit=3, start_ms=125_000).orderBy("ts_ms").collect()] == [120_000, 180_000, 240_000]
    assert [r["ts_ms"] for r in candle_source.read_range(stored, "S", "1m", limit=2, end_ms=180_000).orderBy("ts_ms").collect()] == [60_000, 120_000]
    days = storage.needed_days(spark.createDataFrame([("S", 100 * 60_000)], "symbol string, ts_ms long"), 60_000, 60_000)
    assert storage.prefetch(stored.withColumn("day", F.col("day").cast("string")), days).count() == 1440
    twice = frame.withColumn("o", F.lit(1)).union(frame.withColumn("o", F.lit(0)).withColumn("close", F.lit(-1.0)))
    assert candle_source.first_of_each(twice, "o").agg(F.min("close"), F.count("*")).first() == (-1.0, 3000)
    assert storage.with_deadline(spark, 60, lambda: stored.count()) == 3000


def test_harvest_takes_each_post_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"id":"%s","channel":"c","symbol":"S","direction":"%s","ts":%d}\n'
    (tmp_path / "in" / "a.json").write_text(line % ("1", "long", 1) + line % ("1", "long", 1) + line % ("2", "neutral", 2) + line % ("3", "short", 3))
    job = harvest(spark, str(tmp_path / "in")).writeStream.outputMode("append").format("memory").queryName("posts").option("checkpointLocation", str(tmp_path / "s")).start()
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    assert sorted(r["id"] for r in spark.table("posts").collect()) == ["1", "3"]


def test_pieces_equal_the_walk(spark):
    rng = random.Random(12)
    rows = [(k, i, rng.randint(0, 40_000) * (1 if k == "a" else 90)) for k in "ab" for i in range(400)]
    got = {(r["k"], r["seq"]): r["_piece"] for r in joins.cut_at_gaps(spark.createDataFrame(rows, "k string, seq long, ts_ms long"), ["k"], 150).collect()}
    for key in "ab":
        last = start = None
        for _, seq, ts in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if last is None or ts - last > 150:
                start = ts
            last = ts
            assert got[key, seq] == start


def test_posts_without_id_are_all_harvested(spark, tmp_path):
    posts = [{"id": None, "channel": "c", "symbol": "S", "direction": "long", "ts": 10**12 + 1_000 * k} for k in range(5)] + [{"id": "7", "channel": "c", "symbol": "S", "direction": "long", "ts": 10**12}] * 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, [*posts, posts[0]])))
    job = harvest(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("harvested").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    assert spark.table("harvested").count() == 6


@pytest.mark.parametrize("n, blocks", [(100, 4), (103, 4), (3, 5), (1, 2), (0, 3)])
def test_blocks_equal_ntile(spark, n, blocks):
    rng = random.Random(n)
    rows = [(i, rng.randint(0, 10) * 50_000_000) for i in range(n)]
    got = {r["seq"]: r["block"] for r in stats.even_blocks(spark.createDataFrame(rows, "seq long, ts_ms long"), blocks, "ts_ms", "seq").collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {seq: k + 1 for k, part in enumerate(map(list, np.array_split([r[0] for r in ordered], blocks))) for seq in part}
    assert got == want


def test_candidates_check_tells_luck_from_gain(spark):
    rng = np.random.default_rng(1)
    flat = [(k, i, float(x)) for k in range(20) for i, x in enumerate(rng.normal(0, 1, 150))]
    frame = lambda rows: spark.createDataFrame(rows, "k int, i int, r double")
    none = stats.candidates_check(frame(flat), "k", "r", "i", bootstraps=300).first()
    some = stats.candidates_check(frame(flat + [(20, i, float(x)) for i, x in enumerate(rng.normal(0.6, 1, 150))]), "k", "r", "i", bootstraps=300)
    assert none["candidates"] == 20 and none["p_value"] > 0.05 and some.first()["p_value"] < 0.02 and some.first() == some.first()
    plain = stats.reality_check([np.array([r for k, _, r in flat if k == j]) for j in range(20)], bootstraps=300)
    assert abs(plain - none["p_value"]) < 0.15


def test_scores_by_columns_equal_the_model(spark):
    rng = np.random.default_rng(2)
    n = 300
    rows = pd.DataFrame({"ts": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "h": rng.choice(["x", "y", "z"], n)})
    rows["y"] = (rows["a"] + (rows["h"] == "x") + rng.normal(size=n) > 0.3).astype(int)
    rows["pnl"] = np.where(rows["y"] == 1, 0.03, -0.02)
    model = outcome.fit_outcome_model(rows, ["a", "b", "h"])
    assert model.informative and "a" in model.numeric and "h" in model.categorical
    asked = [(i, float(a), float(rng.normal()), h) for i, (a, h) in enumerate(zip(rng.normal(size=60) * 2, rng.choice(["x", "y", "z", "new"], 60)))]
    asked += [(100, None, 1.0, "x"), (101, float("nan"), 0.0, None), (102, float("inf"), 0.0, "y"), (103, -float("inf"), None, "z")]
    frame = spark.createDataFrame(asked, "i int, a double, b double, h string")
    got = {r["i"]: (r["p_win"], r["expected_pnl"], r["risk_share"]) for r in frame.withColumns(outcome.outcome_columns(outcome.OutcomeModel.from_json(model.to_json()))).collect()}
    for i, a, b, h in asked:
        want = model.predict({"a": a, "b": b, "h": h})
        assert got[i] == pytest.approx((want["p_win"], want["expected_pnl"], want["risk_share"]), abs=2e-6)


def test_excitation_on_the_cluster_equals_the_loops(spark):
    rows = echo_feed(25)
    events = spark.createDataFrame(rows, EVENTS).persist()
    got = {(r["leader"], r["follower"]) for r in graph.hawkes_graph(events, 180_000.0).collect()}
    assert got == set(plain_graph.excited_edges([(f"{s}|{d}", t, c) for _, _, c, s, d, t in rows], 180_000.0))
    assert graph.hawkes_graph(events.where("channel = 'x'").limit(1), 180_000.0).count() == 0


def test_screen_of_many_channels(spark):
    """400 channels, ten symbols, every third an echo: equal to matching all pairs."""
    rng, rows = random.Random(9), []
    for c in range(400):
        if c % 3 == 2:
            rows += [(f"c{c}", s, t + rng.randint(100_000, 200_000)) for ch, s, t in rows if ch == f"c{c - 1}" and rng.random() < 0.7]
        else:
            rows += [(f"c{c}", f"S{rng.randrange(10)}", rng.randrange(30 * 86_400_000)) for _ in range(rng.randint(2, 100))]
    rows.sort(key=lambda r: r[2])
    events = spark.createDataFrame([(i, None, c, s, "long", t) for i, (c, s, t) in enumerate(rows)], EVENTS).persist()
    got = {(r["a"], r["b"]): round(r["jaccard"], 9) for r in graph.jaccard_screen(events, 600_000, 0.3).collect()}
    times, totals, order = {}, {}, list(dict.fromkeys(c for c, _, _ in rows))
    for c, s, t in rows:
        times.setdefault(c, {}).setdefault(s, []).append(t)
        totals[c] = totals.get(c, 0) + 1
    want = {}
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            m = sum(graph.greedy_matches(times[a][s], times[b][s], 600_000) for s in times[a] if s in times[b])
            if 2 * m / (totals[a] + totals[b]) >= 0.3:
                want[a, b] = round(2 * m / (totals[a] + totals[b]), 9)
    assert got == want and len(want) > 50


@pytest.mark.parametrize("xs", [[0.1, 0.2, -0.3], [-0.3, 0.2, 0.1], [0.7, 0.1, -0.8]])
def test_a_fold_that_sums_to_nothing_is_no_gain_in_any_order(spark, xs):
    rows = spark.createDataFrame([(x,) for x in xs], "r double").coalesce(1)
    assert rows.agg(stats.steady_mean("r")).first()[0] == 0.0
    assert rows.union(rows.limit(1)).agg(stats.steady_mean("r")).first()[0] == pytest.approx(xs[0] / 4)
