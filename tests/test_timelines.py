import random

import pytest

from tidemark.operators import graph, pipelines  # noqa: F401
from tidemark.plans import registry

import plain_graph

EVENTS = "seq long, id string, channel string, symbol string, direction string, ts_ms long"
HOUR = 3_600_000


def crowded(n=400, seed=5, step=60_000, hours=60):
    """Events of four channels and two keys at times that often tie."""
    rng = random.Random(seed)
    return [(i, str(i), f"c{rng.randrange(4)}", rng.choice("AB"), "long", rng.randrange(hours * HOUR // step) * step) for i in range(n)]


@pytest.fixture
def no_pairs(monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("rows are joined pair by pair")

    monkeypatch.setattr(graph, "band_join", refuse)


def plain_lags(rows, a, b):
    lags = []
    for seq, _, channel, symbol, _, ts in rows:
        if channel == a:
            near = [(abs(t - ts), t, s, t - ts) for s, _, c, sym, _, t in rows if c == b and sym == symbol and abs(t - ts) <= graph.HORIZON_MS]
            lags += [min(near)[3]] if near else []
    return sorted(lags)


@pytest.mark.parametrize("step", [1, 600_000])
def test_nearest_lags_are_found_without_pairs_of_rows(spark, no_pairs, step):
    rows = crowded(300, step=step)
    events = spark.createDataFrame(rows, EVENTS)
    pairs = [("c0", "c1"), ("c0", "c2"), ("c1", "c3"), ("c2", "c3")]
    edges = spark.createDataFrame([(*p, 0.5) for p in pairs], "a string, b string, jaccard double")
    want = {}
    for a, b in pairs:
        lags, middle = plain_lags(rows, a, b), None
        middle = lags[len(lags) // 2]
        want[a, b] = (abs(middle), sum(abs(x) <= HOUR for x in lags) / len(lags), a if middle >= 0 else b)
    got = {(r["a"], r["b"]): (r["lag_ms"], r["peak_share"], r["leader"]) for r in graph.lag_edges(events, edges, 0.0, HOUR).collect()}
    bound = lambda n, p=1 / 6: p + 2 * (p * (1 - p) / n) ** 0.5
    assert got == {p: w for p, w in want.items() if w[1] >= bound(len(plain_lags(rows, *p)))} and got
    assert graph.lag_edges(events, edges.where("a = 'none'"), 0.0, HOUR).count() == 0


def plain_gaps(rows):
    """(symbol, gap) of each pair of rows of one key and different channels."""
    return [(s, t - u) for _, _, c, s, _, t in rows for _, _, d, z, _, u in rows if s == z and c != d and 0 < t - u <= graph.HORIZON_MS]


@pytest.mark.parametrize("step", [1, 600_000])
def test_gaps_are_summed_without_pairs_of_rows(spark, no_pairs, step):
    rows = crowded(200, step=step)
    gaps = plain_gaps(rows)
    want = {s: (len(g), sum(g), min(g), max(g)) for s in "AB" if (g := [x for z, x in gaps if z == s])}
    events = spark.createDataFrame(rows, EVENTS)
    assert {r["symbol"]: (r["n"], r["total"], r["least"], r["most"]) for r in graph.lag_sums(events).collect()} == want
    assert graph.lag_sums(events.where("channel = 'c0'")).count() == 0


@pytest.mark.parametrize("step", [1, 600_000])
def test_histogram_counts_without_pairs_of_rows(spark, no_pairs, step):
    import math

    rows = crowded(200, seed=8, step=step)
    logs = [math.log(max(g, 1000)) for _, g in plain_gaps(rows)]
    lo, hi = min(logs), max(logs)
    bins = [min(math.floor((x - lo) / (hi - lo) * 24), 23) for x in logs]
    events = spark.createDataFrame(rows, EVENTS)
    assert {r["bin"]: r["n"] for r in graph.lag_histogram(events).collect()} == {b: bins.count(b) for b in set(bins)}
    assert graph.lag_histogram(events.where("channel = 'c0'")).count() == 0


def test_typical_lag_is_fitted_to_counts_of_gaps(spark, no_pairs):
    rows = crowded(60, step=30_000, hours=12)
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:20])]  # equal times count with their product of numbers
    events = spark.createDataFrame(rows, EVENTS)
    tau = graph.self_tune_lag(events)
    assert tau["n"] == len(plain_gaps(rows))
    assert tau["tau_ms"] == pytest.approx(plain_graph.tune_lag([(f"{s}|long", t, c) for _, _, c, s, _, t in rows]), rel=1e-9)
    assert graph.self_tune_lag(events.where("channel = 'c0'"))["n"] == 0


def test_excitation_is_summed_without_pairs_of_rows(spark, no_pairs):
    rng, rows = random.Random(4), []
    for k in range(60):
        at = k * 3_000_000 + rng.randrange(600) * 1000
        rows += [("lead", at), ("echo", at + rng.choice([0, 60_000, 90_000])), (rng.choice("xy"), rng.randrange(180_000_000))]
    rows = [(i, str(i), c, "A", "long", t) for i, (c, t) in enumerate(sorted(rows, key=lambda r: r[1]))]
    local = [("A|long", t, c) for _, _, c, _, _, t in rows]
    got = {(r["leader"], r["follower"]) for r in graph.hawkes_graph(spark.createDataFrame(rows, EVENTS), 180_000.0).collect()}
    assert got == set(plain_graph.excited_edges(local, 180_000.0)) and ("lead", "echo") in got


@pytest.mark.parametrize("name", ["author_influence", "author_clusters", "viability", "predict_verdicts"])
def test_queries_join_no_pairs_of_rows(spark, sf_dir, no_pairs, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
