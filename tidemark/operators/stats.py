"""Return statistics, multiple-testing corrections, capital and drift, as grouped aggregations."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..plans.joins import first_by
from ..plans.registry import query

MAX_CSCV_FOLDS = 12
BOOTSTRAPS, BLOCK_P, SEED = 1000, 0.1, 12345
#: Slices of equal width that running sums over values are cut into.
SLICES = 1024
CERTIFY = {"dsr": 0.95, "pbo": 0.10, "spa": 0.05}


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: n, mean, std (sample), skew and kurtosis with the sample deviation, Sharpe ratio.

    Degenerate groups: std 0 under two values; skew 0 under three or without spread; kurtosis 3 under four or without
    spread; Sharpe 0 without spread beyond rounding.
    """
    x = F.col(value)
    base = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.skewness(x).alias("sk"), F.kurtosis(x).alias("ku"), F.max(F.abs(x)).alias("top"))
    shrink = (F.col("n") - 1) / F.col("n")
    spread = F.col("std") > 0
    return base.select(
        *keys, "n", F.coalesce("mean", F.lit(0.0)).alias("mean"), "std",
        F.when((F.col("n") >= 3) & spread, F.col("sk") * F.pow(shrink, F.lit(1.5))).otherwise(0.0).alias("skew"),
        F.when((F.col("n") >= 4) & spread, (F.col("ku") + 3) * F.pow(shrink, F.lit(2.0))).otherwise(3.0).alias("kurt"),
        F.when(F.col("std") > F.col("top") * 1e-13, F.try_divide("mean", "std")).otherwise(0.0).alias("sharpe"),
    )


def deflated_sharpe(stats: DataFrame, trials: int, variance: float) -> Column:
    """Probability that the true Sharpe ratio beats what the best of the trials shows by chance."""
    sr0 = normal.expected_max_sharpe(variance, trials)
    sr = F.col("sharpe")
    spread = F.sqrt(F.greatest(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr, F.lit(1e-12)))
    return F.when(F.col("n") < 2, 0.0).otherwise(normal.cdf((sr - sr0) * F.sqrt(F.col("n") - 1) / spread))


def min_track_record(alpha: float = 0.05) -> Column:
    """Trades needed for the Sharpe ratio to be significant; infinite at 0 or below."""
    z = normal.quantile(1 - alpha)
    sr = F.col("sharpe")
    factor = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    return F.when(sr > 0, 1 + factor * F.pow(F.try_divide(F.lit(z), sr), F.lit(2.0))).otherwise(float("inf"))


def shrunk(value: str, k: float = 5.0) -> Column:
    """Mean pulled to 0 as by k more trades that earn nothing."""
    return F.coalesce(F.avg(value) * F.count(value) / (F.count(value) + k), F.lit(0.0))


def win_rate(value: str) -> Column:
    return F.coalesce(F.avg((F.col(value) > 0).cast("double")), F.lit(0.0))


def standard_error(value: str) -> Column:
    return F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))


def steady_mean(value: str) -> Column:
    """The mean; 0 if it is within rounding of its terms, so that its sign doesn't depend on the order they are added in."""
    mean = F.avg(value)
    return F.when(F.abs(mean) <= F.avg(F.abs(value)) * F.count(value) * 2.0**-52, 0.0).otherwise(mean)


def percentiles(value: str, names: dict[str, float], digits: int = 6) -> list[Column]:
    return [F.coalesce(F.round(F.percentile(value, p), digits), F.lit(0.0)).alias(name) for name, p in names.items()]


def pnl_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return clean.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), *percentiles(value, {"median": 0.5, "p5": 0.05, "p95": 0.95, "p99": 0.99}), F.count(value).alias("n"))


def risk_reward(df: DataFrame, keys: list[str], pnl: str, hard_stop: str) -> DataFrame:
    ratio = df.where((F.col(hard_stop) > 0) & F.col(pnl).isNotNull()).select(*keys, (F.col(pnl) / (F.col(hard_stop) / 100)).alias("rr"))
    return ratio.groupBy(*keys).agg(F.round(F.avg("rr"), 6).alias("mean"), *percentiles("rr", {"p95": 0.95, "p99": 0.99}), F.count("rr").alias("n"))


def empirical_pool_k(df: DataFrame, group: str, value: str, fallback: float = 5.0) -> DataFrame:
    """One row: how many trades a group's own mean is worth against the pool, from within and between variance."""
    groups = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where(F.col("n") >= 2)
    whole = groups.agg(F.count("*").alias("g"), F.sum(F.col("v") * F.col("n")).alias("ss"), F.sum(F.col("n") - 1).alias("df"), F.sum(1 / F.col("n")).alias("inv"), F.var_samp("m").alias("vm"))
    sigma2 = F.try_divide("ss", "df")
    tau2 = F.greatest(F.col("vm") - sigma2 * F.col("inv") / F.col("g"), F.lit(0.0))
    k = F.when((F.col("g") < 3) | ~F.coalesce(sigma2 > 0, F.lit(False)), fallback).when(tau2 <= sigma2 * 1e-9, 200.0).otherwise(F.least(F.greatest(F.try_divide(sigma2, tau2), F.lit(0.5)), F.lit(200.0)))
    return whole.select(F.round(k, 6).alias("k"), F.col("g").alias("groups"))


def exit_proposals(labels: DataFrame, least: int = 10) -> DataFrame:
    """Stops and trails that winners suggest: percentiles of their worst drawdown and of what they gave back."""
    winners = labels.where(F.col("entered") & (F.col("pnl") > 0)).select((F.abs(F.least("trough", F.lit(0.0))) * 100).alias("mae"), (F.greatest(F.col("peak") - F.col("pnl"), F.lit(0.0)) * 100).alias("give"))
    mae, give = F.when(F.col("mae") > 0, F.col("mae")), F.when(F.col("give") > 0, F.col("give"))
    facts = winners.agg(F.count("*").alias("winners"), F.count(mae).alias("n_mae"), F.count(give).alias("n_give"), *[F.percentile(c, p).alias(n) for c, p, n in ((mae, 0.9, "s90"), (mae, 0.95, "s95"), (give, 0.75, "t75"), (give, 0.9, "t90"))])
    enough = F.col("winners") >= least
    return facts.select("winners", *[F.when(enough & (F.col(c) >= least), F.round(n, 4)).alias(n) for c, n in (("n_mae", "s90"), ("n_mae", "s95"), ("n_give", "t75"), ("n_give", "t90"))])


def time_folds(df: DataFrame, keys: list[str], folds: int, embargo_ms: str | int, ts: str = "ts_ms", seq: str = "burst_id") -> DataFrame:
    """Rows of the validation folds, with fold from 1: equal counts in time order after a first block that only trains.

    From each fold's front go the rows within the embargo after the last row of the fold before (of the last one that
    kept any). ``embargo_ms`` names a column, constant within a group, or is a number. The chain over a group's folds
    runs over an array of as many times as there are folds.
    """
    order = Window.partitionBy(*keys).orderBy(ts, seq)
    i, n = F.row_number().over(order) - 1, F.count("*").over(Window.partitionBy(*keys))
    size = F.greatest(F.floor(n / (folds + 1)), F.lit(1))
    embargo = F.col(embargo_ms) if isinstance(embargo_ms, str) else F.lit(embargo_ms)
    cut = df.withColumn("_embargo", embargo.cast("long")).withColumn("fold", F.least(F.floor(i / size), F.lit(folds)).cast("int")).where(F.col("fold") >= 1)
    ends = cut.groupBy(*keys, "fold").agg(F.max(ts).alias("end"), F.max("_embargo").alias("e"))
    chains = ends.groupBy(*keys).agg(F.max("e").alias("e"), F.array_sort(F.collect_list(F.struct("fold", "end"))).alias("ends"))
    start = F.struct(F.lit(-(1 << 62)).alias("prev"), F.expr("cast(array() AS array<struct<fold:int,from:bigint>>)").alias("out"))

    def step(state: Column, x: Column) -> Column:
        first = state["prev"] + F.col("e")
        kept = x["end"] >= first
        return F.struct(F.when(kept, x["end"]).otherwise(state["prev"]).alias("prev"), F.concat(state["out"], F.array(F.struct(x["fold"].alias("fold"), first.alias("from")))).alias("out"))

    starts = chains.select(*keys, F.inline(F.aggregate("ends", start, step, lambda s: s["out"])))
    return cut.join(starts, [*keys, "fold"]).where(F.col(ts) >= F.col("from")).drop("from", "_embargo")


def overfitting_probability(perf: DataFrame, config: str = "config", fold: str = "fold", value: str = "value") -> DataFrame:
    """One row: share of the half-and-half splits of folds whose best configuration falls below the others' middle.

    perf: one value per configuration (ordered by ``config``) and fold. At most twelve evenly picked folds; an odd
    number, or fewer than two, gives no estimate (NaN).
    """
    spark = perf.sparkSession
    folds = [r[fold] for r in perf.select(fold).distinct().orderBy(fold).collect()]  # a row for each fold
    if len(folds) > MAX_CSCV_FOLDS:
        folds = [folds[i * len(folds) // MAX_CSCV_FOLDS] for i in range(MAX_CSCV_FOLDS)]
    if len(folds) < 2 or len(folds) % 2:
        return spark.createDataFrame([(float("nan"), 0)], "pbo double, splits long")
    splits = list(combinations(folds, len(folds) // 2))
    rows = [(i, f, f in chosen) for i, chosen in enumerate(splits) for f in folds]
    table = F.broadcast(spark.createDataFrame(rows, f"split int, {fold} {dict(perf.dtypes)[fold]}, inside boolean"))  # 924 splits of 12 at most
    means = perf.join(table, fold).groupBy("split", config).agg(F.avg(F.when(F.col("inside"), F.col(value))).alias("inside"), F.avg(F.when(~F.col("inside"), F.col(value))).alias("outside"))
    best = first_by(means, ["split"], F.desc("inside"), config).select("split", F.col("outside").alias("mine"))
    ranks = means.join(best, "split").groupBy("split").agg(F.count("*").alias("n"), F.sum((F.col("outside") < F.col("mine")).cast("long")).alias("less"), F.sum((F.col("outside") == F.col("mine")).cast("long")).alias("eq"))
    omega = (F.col("less") + (F.col("eq") - 1) / 2 + 0.5) / F.col("n")
    return ranks.agg(F.avg((F.ln(omega / (1 - omega + 1e-12)) < 0).cast("double")).alias("pbo"), F.count("*").alias("splits"))


def mulberry32(seed: int, block: int = 1 << 15):
    """The fixed 32-bit generator behind every bootstrap: a function that returns the next number in [0, 1).

    Its state only counts in fixed steps, so a block of numbers is drawn at once.
    """

    def numbers():
        state = seed & 0xFFFFFFFF
        while True:
            a = (np.uint64(state) + np.arange(1, block + 1, dtype=np.uint64) * np.uint64(0x6D2B79F5)).astype(np.uint32)
            t = (a ^ a >> np.uint32(15)) * (a | np.uint32(1))
            t = (t + (t ^ t >> np.uint32(7)) * (t | np.uint32(61))) ^ t
            yield from ((t ^ t >> np.uint32(14)) / 4294967296).tolist()
            state = (state + block * 0x6D2B79F5) & 0xFFFFFFFF

    return numbers().__next__


def bootstrap_indices(n: int, p: float, draw) -> list[int]:
    """Stationary bootstrap: blocks of geometric length, around the end of the series."""
    at, out = int(draw() * n) if n else 0, []
    for i in range(n):
        if i:
            at = int(draw() * n) if draw() < p else (at + 1) % n
        out.append(at)
    return out


def reality_check(series: list[np.ndarray], bootstraps: int = BOOTSTRAPS, p: float = BLOCK_P, seed: int = SEED) -> float:
    """Chance that the best of worthless strategies does as well, by bootstrap; one random stream through all of them."""
    series = [s for s in series]
    if not series:
        return 1.0
    draw = mulberry32(seed)
    stat = lambda s, m: math.sqrt(len(s)) * ((s.mean() if len(s) else 0.0) - m)
    observed = max(stat(s, 0.0) for s in series)
    means = [s.mean() if len(s) else 0.0 for s in series]
    exceed = sum(max(stat(s[bootstrap_indices(len(s), p, draw)], m) for s, m in zip(series, means)) >= observed for _ in range(bootstraps))
    return (exceed + 1) / (bootstraps + 1)


def candidates_check(df: DataFrame, key: str, value: str, *order: str, bootstraps: int = BOOTSTRAPS, p: float = BLOCK_P, seed: int = SEED) -> DataFrame:
    """One row: the reality check of all series of a table (p_value, candidates), each resampled in its own task.

    Blocks of geometric length around the end of a series, as in ``reality_check``; but every series has a random stream
    of its own, as one stream through all of them would be drawn by one task. A block's sum comes from prefix sums.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, value)))
    series = df.groupBy(key).agg(F.transform(rows, lambda r: r[value].cast("double")).alias("xs"), F.hash(key).alias("mark"))

    def resample(frames):
        for frame in frames:
            best = np.full(bootstraps, -np.inf)
            observed = -np.inf
            for xs, mark in zip(frame["xs"], frame["mark"]):
                x = np.asarray(xs, float)
                n, rng = len(x), np.random.default_rng([seed, int(mark) & 0xFFFFFFFF])
                sums = np.concatenate(([0.0], np.cumsum(np.concatenate((x, x)))))
                left, total = np.full(bootstraps, n), np.zeros(bootstraps)
                while left.any():
                    start, size = rng.integers(0, n, bootstraps), np.minimum(rng.geometric(p, bootstraps), left)
                    total += sums[start + size] - sums[start]
                    left -= size
                observed = max(observed, math.sqrt(n) * x.mean())
                best = np.maximum(best, math.sqrt(n) * (total / n - x.mean()))
            yield pd.DataFrame({"b": np.arange(bootstraps), "best": best, "observed": observed, "n": len(frame)})

    parts = series.mapInPandas(resample, "b int, best double, observed double, n long")
    each = parts.groupBy("b").agg(F.max("best").alias("best"), F.max("observed").alias("observed"), F.sum("n").alias("n"))
    return each.agg(((F.sum((F.col("best") >= F.col("observed")).cast("long")) + 1) / (bootstraps + 1)).alias("p_value"), F.max("n").alias("candidates"))


def certify(dsr: float, pbo: float, spa: float, n: int, needed: float, nested: float | None) -> tuple[bool, list[str]]:
    """Whether all five barriers are passed, and which aren't; an estimate that doesn't exist is not passed."""
    reasons = [
        name for name, bad in (("deflated-sharpe", not dsr >= CERTIFY["dsr"]), ("overfitting", not pbo <= CERTIFY["pbo"]), ("reality-check", not spa <= CERTIFY["spa"]), ("track-record", not n >= needed), ("nested", nested is not None and not nested > 0)) if bad
    ]
    return not reasons, reasons


def drawdown(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """Per group: final equity and the largest fall from a peak, the peak starting at 0."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    equity = df.withColumn("_e", F.sum(value).over(so_far))
    falls = equity.withColumn("_p", F.greatest(F.max("_e").over(so_far), F.lit(0.0)))
    return falls.groupBy(*keys).agg(F.round(F.max(F.col("_p") - F.col("_e")), 6).alias("max_drawdown"), F.round(F.sum(value), 6).alias("equity"))


def running_sums(df: DataFrame, slice_of: Column, order: list[str], values: list[str]) -> DataFrame:
    """Adds ``<value>_upto``: sums over all rows up to each one, in an order that no slice crosses.

    Sums of slices run in one task, rows within their slice.
    """
    sliced = df.withColumn("_slice", slice_of)
    ahead = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("_slice").agg(*[F.sum(v).alias(v) for v in values])
    before = sums.select(F.col("_slice").alias("_slice_of"), *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"_before_{v}") for v in values])
    upto = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = sliced.join(before, F.col("_slice").eqNullSafe(F.col("_slice_of")))
    return joined.withColumns({f"{v}_upto": F.col(f"_before_{v}") + F.sum(v).over(upto) for v in values}).drop("_slice", "_slice_of", *[f"_before_{v}" for v in values])


def even_blocks(df: DataFrame, blocks: int, *order: str, slice_ms: int = 86_400_000) -> DataFrame:
    """Adds block, 1 to ``blocks``: equal counts of rows in order (the first ones have one more), the first of ``order``
    being a time. Rows are numbered within slices of time, so no task sorts them all."""
    n = df.count()
    q, r = divmod(n, blocks)
    numbered = running_sums(df.withColumn("_one", F.lit(1)), F.floor(F.col(order[0]) / slice_ms), list(order), ["_one"])
    i = F.col("_one_upto")
    block = F.when(i <= r * (q + 1), F.ceil(i / (q + 1))).otherwise(r + F.ceil((i - r * (q + 1)) / max(q, 1)))
    return numbered.withColumn("block", block.cast("int")).drop("_one", "_one_upto")


def capital_demand(trades: DataFrame, minute_ms: int = 60_000) -> DataFrame:
    """One row: most positions open at once if every trade is taken; exits come before entries of the same time."""
    opens = trades.select(F.col("ts_ms").alias("t"), F.lit(1).alias("d"))
    closes = trades.select((F.col("ts_ms") + F.greatest("held", F.lit(0)) * minute_ms).alias("t"), F.lit(-1).alias("d"))
    # Summed per time and kind first: the running sum then runs over distinct times, day by day.
    steps = opens.union(closes).groupBy("t", "d").agg(F.sum("d").alias("s"))
    return running_sums(steps, F.floor(F.col("t") / 86_400_000), ["t", "d"], ["s"]).agg(F.greatest(F.max("s_upto"), F.lit(0)).alias("demand_peak"))


def simulate_capital(trades: pd.DataFrame, slots: int, minute_ms: int = 60_000) -> pd.DataFrame:
    """Greedy slots: trades by time, then priority (none last); taken while a slot is free. Adds taken."""
    rows = trades.sort_values(["ts_ms", "priority"], ascending=[True, False], kind="stable", na_position="last")
    busy: list[int] = []
    taken = []
    for ts, held in zip(rows["ts_ms"], rows["held"]):
        busy = [end for end in busy if end > ts]
        taken.append(len(busy) < slots)
        if taken[-1]:
            busy.append(int(ts + max(held, 0) * minute_ms))
    return rows.assign(taken=taken)


def capital_greedy(trades: DataFrame, keys: list[str], slots: int, minute_ms: int = 60_000, seq: str = "id") -> DataFrame:
    """Adds taken per trade; a portfolio (keys) is walked in order by one task, portfolios in parallel. seq settles ties."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in trades.schema)}, taken boolean"
    return trades.groupBy(*keys).applyInPandas(lambda rows: simulate_capital(rows.sort_values(seq), slots, minute_ms), schema)


def ks_two_sample(df: DataFrame, value: str, sample: str) -> DataFrame:
    """One row: largest gap of two distribution functions, and its p-value. ``sample`` is true for the first one."""
    counts = df.groupBy(value).agg(F.sum(F.col(sample).cast("long")).alias("a"), F.sum((~F.col(sample)).cast("long")).alias("b"))
    totals = counts.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    placed = counts.crossJoin(F.broadcast(totals))  # one row
    share = F.try_divide(F.col(value) - F.col("low"), F.col("high") - F.col("low"))
    gaps = running_sums(placed, F.floor(F.coalesce(share, F.lit(0.0)) * SLICES), [value], ["a", "b"])
    facts = gaps.agg(F.max(F.abs(F.try_divide("a_upto", "na") - F.try_divide("b_upto", "nb"))).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    root = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    lam = (root + 0.12 + 0.11 / root) * F.col("d")
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: 2 * F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * lam * lam * j * j))
    p = F.least(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)), F.lit(1.0))
    return facts.withColumn("p", F.round(p, 6)).withColumn("d", F.round("d", 6)).select("d", "p", "na", "nb")


def cusum(df: DataFrame, keys: list[str], value: str, mean: Column, std: Column, *order: str, k: float = 0.5) -> DataFrame:
    """Per group: peak of the one-sided cumulative sum of shortfalls, in deviations beyond k; alarm at 5.

    max(0, s + x) over a series is its prefix sum minus the least prefix sum so far (or 0), so it needs no loop.
    """
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.withColumn("_s", F.sum((mean - F.col(value)) / std - k).over(so_far))
    level = sums.withColumn("_c", F.col("_s") - F.least(F.min("_s").over(so_far), F.lit(0.0)))
    return level.groupBy(*keys).agg(F.round(F.max("_c"), 6).alias("cusum_peak"), (F.round(F.max("_c"), 6) >= 5).alias("alarm"))


def reliability(fold_means: Column, total_n: Column, n: Column, mean: Column, std: Column, support_k: float = 30.0) -> dict[str, Column]:
    """Support, stability and significance of a result, and their product."""
    folds = F.size(fold_means)
    avg = F.aggregate(fold_means, F.lit(0.0), lambda a, x: a + x) / folds
    ss = F.aggregate(fold_means, F.lit(0.0), lambda a, x: a + (x - avg) * (x - avg))
    spread = F.when(folds > 1, F.sqrt(ss / (folds - 1))).otherwise(0.0)
    wins = F.size(F.filter(fold_means, lambda x: x > 0)) / folds
    variation = F.when(avg != 0, F.least(F.try_divide(spread, F.abs(avg)), F.lit(1.0))).otherwise(1.0)
    stability = F.when(folds == 0, 0.0).when(folds == 1, 0.5).otherwise(wins * (1 - variation))
    t = F.try_divide(mean, std / F.sqrt(n))
    significance = F.when((n < 2) | (mean <= 0), 0.0).when(std <= F.abs(mean) * 1e-9, 1 - F.exp(-n / 200.0)).otherwise(1 - F.exp(-t / 2))
    support = total_n / (total_n + support_k)
    return {"support": support, "stability": stability, "significance": significance, "confidence": support * stability * significance}


# Returns of the queries: discount less tax of each supplier's lines.
RETURNS_SQL = "ret AS MATERIALIZED (SELECT l_suppkey AS k, l_orderkey AS o, l_linenumber AS ln, (l_discount - l_tax)::DOUBLE AS r, l_shipdate AS d FROM lineitem)"
MOMENTS_SQL = RETURNS_SQL + """, mo AS MATERIALIZED (SELECT k, n, m AS mean, coalesce(s, 0) AS std, CASE WHEN n >= 3 AND s > 0 THEN m3 / n / (s * s * s) ELSE 0 END AS skew, CASE WHEN n >= 4 AND s > 0 THEN m4 / n / (s * s * s * s) ELSE 3 END AS kurt,
   CASE WHEN s > top * 1e-13 THEN m / s ELSE 0 END AS sharpe
 FROM (SELECT ret.k, count(*) AS n, any_value(g.m) AS m, any_value(g.s) AS s, any_value(top) AS top, sum((r - g.m) ** 3) AS m3, sum((r - g.m) ** 4) AS m4
       FROM ret JOIN (SELECT k, avg(r) AS m, stddev_samp(r) AS s, max(abs(r)) AS top FROM ret GROUP BY k) g ON ret.k = g.k GROUP BY ret.k))"""
TRIALS, VARIANCE = 50, 0.01


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), (F.col("l_discount") - F.col("l_tax")).alias("r"), F.col("l_shipdate").alias("d"))


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("moments_sharpe", f"WITH {MOMENTS_SQL} SELECT k, n, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean', 'std', 'skew', 'kurt', 'sharpe'))} FROM mo")
def _moments(spark, sf_dir):
    return _round(moments(returns(spark, sf_dir), ["k"], "r"), "mean", "std", "skew", "kurt", "sharpe")


_SR0 = normal.expected_max_sharpe(VARIANCE, TRIALS)


@query("deflated_sharpe", f"""WITH {MOMENTS_SQL}, z AS (SELECT k, n, (sharpe - {_SR0!r}::DOUBLE) * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 1e-12)) AS z FROM mo)
  SELECT k, n, round(CASE WHEN n < 2 THEN 0 ELSE {normal.cdf_sql('z')} END, 6) AS dsr FROM z""")
def _dsr(spark, sf_dir):
    stats = moments(returns(spark, sf_dir), ["k"], "r")
    return stats.select("k", "n", F.round(deflated_sharpe(stats, TRIALS, VARIANCE), 6).alias("dsr"))


@query("min_track_record", f"WITH {MOMENTS_SQL} SELECT k, sharpe > 0 AS possible, CASE WHEN sharpe > 0 THEN round(1 + (1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) * ({normal.quantile(0.95)!r}::DOUBLE / sharpe) ** 2, 3) ELSE -1 END AS min_trl FROM mo")
def _min_trl(spark, sf_dir):
    stats = moments(returns(spark, sf_dir), ["k"], "r")
    needed = min_track_record()
    return stats.select("k", (F.col("sharpe") > 0).alias("possible"), F.when(F.col("sharpe") > 0, F.round(needed, 3)).otherwise(-1.0).alias("min_trl"))


@query("pnl_stats", f"WITH {RETURNS_SQL} SELECT k, round(avg(r), 6) AS mean, {', '.join(f'round(quantile_cont(r, {p}), 6) AS {n}' for n, p in (('median', 0.5), ('p5', 0.05), ('p95', 0.95), ('p99', 0.99)))}, count(*) AS n FROM ret GROUP BY k")
def _pnl(spark, sf_dir):
    return pnl_stats(returns(spark, sf_dir), ["k"], "r")


@query("risk_reward", f"WITH {RETURNS_SQL}, x AS (SELECT k, r / ((o % 5)::DOUBLE / 100) AS rr FROM ret WHERE o % 5 > 0) SELECT k, round(avg(rr), 6) AS mean, round(quantile_cont(rr, 0.95), 6) AS p95, round(quantile_cont(rr, 0.99), 6) AS p99, count(*) AS n FROM x GROUP BY k")
def _rr(spark, sf_dir):
    return risk_reward(returns(spark, sf_dir).withColumn("stop", (F.col("o") % 5).cast("double")), ["k"], "r", "stop")


@query("shrunk_expectancy", f"WITH {RETURNS_SQL} SELECT k, round(avg(r) * count(*) / (count(*) + 5.0::DOUBLE), 6) AS expectancy, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS win_rate, round(stddev_samp(r) / sqrt(count(*)), 6) AS standard_error FROM ret GROUP BY k")
def _expectancy(spark, sf_dir):
    return returns(spark, sf_dir).groupBy("k").agg(F.round(shrunk("r"), 6).alias("expectancy"), F.round(win_rate("r"), 6).alias("win_rate"), F.round(standard_error("r"), 6).alias("standard_error"))


@query("pool_k", f"""WITH {RETURNS_SQL}, g AS (SELECT k, count(*) AS n, avg(r) AS m, var_pop(r) AS v FROM ret GROUP BY k HAVING count(*) >= 2),
 w AS (SELECT count(*) AS g, sum(v * n) / sum(n - 1) AS s2, sum(1.0::DOUBLE / n) AS inv, var_samp(m) AS vm FROM g), t AS (SELECT g, s2, greatest(vm - s2 * inv / g, 0) AS t2 FROM w)
 SELECT round(CASE WHEN g < 3 OR NOT s2 > 0 THEN 5.0 WHEN t2 <= s2 * 1e-9 THEN 200.0 ELSE least(greatest(s2 / t2, 0.5), 200) END, 6)::DOUBLE AS k, g AS groups FROM t""")
def _pool_k(spark, sf_dir):
    return empirical_pool_k(returns(spark, sf_dir), "k", "r")


@query("drawdown", f"""WITH {RETURNS_SQL}, e AS (SELECT *, sum(r) OVER (PARTITION BY k ORDER BY d, o, ln ROWS UNBOUNDED PRECEDING) AS e FROM ret),
 p AS (SELECT *, greatest(max(e) OVER (PARTITION BY k ORDER BY d, o, ln ROWS UNBOUNDED PRECEDING), 0) AS p FROM e) SELECT k, round(max(p - e), 6) AS max_drawdown, round(sum(r), 6) AS equity FROM p GROUP BY k""")
def _drawdown(spark, sf_dir):
    return drawdown(returns(spark, sf_dir), ["k"], "r", "d", "o", "ln")


@query("cusum", f"""WITH {RETURNS_SQL}, s AS (SELECT *, sum((0.012::DOUBLE - r) / 0.04::DOUBLE - 0.5) OVER (PARTITION BY k ORDER BY d, o, ln ROWS UNBOUNDED PRECEDING) AS s FROM ret),
 c AS (SELECT *, s - least(min(s) OVER (PARTITION BY k ORDER BY d, o, ln ROWS UNBOUNDED PRECEDING), 0) AS c FROM s) SELECT k, round(max(c), 6) AS cusum_peak, round(max(c), 6) >= 5 AS alarm FROM c GROUP BY k""")
def _cusum(spark, sf_dir):
    return cusum(returns(spark, sf_dir), ["k"], "r", F.lit(0.012), F.lit(0.04), "d", "o", "ln")


@query("ks_two_sample", f"""WITH {RETURNS_SQL}, c AS (SELECT round(r, 4) AS v, count(*) FILTER (k % 2 = 0) AS a, count(*) FILTER (k % 2 <> 0) AS b FROM ret GROUP BY 1),
 g AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)) AS d, max(na)::BIGINT AS na, max(nb)::BIGINT AS nb FROM g),
 l AS (SELECT *, (sqrt(na::DOUBLE * nb / (na + nb)) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(na::DOUBLE * nb / (na + nb))) * d AS lam FROM f)
 SELECT round(d, 6) AS d, round(least(greatest((SELECT sum(2 * CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * lam * lam * j * j)) FROM range(1, 101) t(j)), 0), 1), 6) AS p, na, nb FROM l""")
def _ks(spark, sf_dir):
    return ks_two_sample(returns(spark, sf_dir).select(F.round("r", 4).alias("v"), (F.col("k") % 2 == 0).alias("first")), "v", "first")


_TRADES_SQL = "tr AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS ts_ms, 1440 * (1 + o_orderkey % 7) AS held, o_custkey AS priority FROM orders)"


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of the capital queries: all orders, held for some days."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("id"), F.expr("unix_micros(cast(o_orderdate AS timestamp)) div 1000").alias("ts_ms"), (1440 * (1 + F.col("o_orderkey") % 7)).alias("held"), F.col("o_custkey").cast("double").alias("priority"), F.col("o_totalprice").alias("pnl"))


@query("capital_demand", f"""WITH {_TRADES_SQL}, e AS (SELECT ts_ms AS t, 1 AS d FROM tr UNION ALL SELECT ts_ms + held * 60000, -1 FROM tr), s AS (SELECT t, d, sum(d) AS s FROM e GROUP BY t, d)
 SELECT greatest(max(r), 0)::BIGINT AS demand_peak FROM (SELECT sum(s) OVER (ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS r FROM s)""")
def _demand(spark, sf_dir):
    return capital_demand(_trades(spark, sf_dir))


@query("capital_greedy", f"""WITH RECURSIVE {_TRADES_SQL}, o AS MATERIALIZED (SELECT id, id % 3 AS book, ts_ms, ts_ms + held * 60000 AS until, row_number() OVER (PARTITION BY id % 3 ORDER BY ts_ms, priority DESC, id) AS rn FROM tr),
 w AS (SELECT book, id, rn, [until] AS busy, true AS taken FROM o WHERE rn = 1
   UNION ALL SELECT book, id, rn, CASE WHEN len(free) < 2 THEN list_append(free, until) ELSE free END, len(free) < 2
   FROM (SELECT o.*, list_filter(busy, lambda e: e > o.ts_ms) AS free FROM w JOIN o ON w.book = o.book AND o.rn = w.rn + 1))
 SELECT id, book, taken FROM w""")
def _greedy(spark, sf_dir):
    return capital_greedy(_trades(spark, sf_dir).withColumn("book", F.col("id") % 3), ["book"], 2).select("id", "book", "taken")


_PERF_SQL = RETURNS_SQL + ", pf AS MATERIALIZED (SELECT k AS config, o % 8 AS fold, avg(r) AS value FROM ret GROUP BY ALL)"


@query("pbo", f"""WITH {_PERF_SQL}, sp AS (SELECT row_number() OVER () AS split, m FROM range(256) t(m) WHERE bit_count(m::INT) = 4),
 me AS (SELECT split, config, avg(value) FILTER ((m >> fold::INT) & 1 = 1) AS i, avg(value) FILTER ((m >> fold::INT) & 1 = 0) AS u FROM pf, sp GROUP BY split, config),
 be AS (SELECT split, arg_max(u, (i, -config)) AS mine FROM me GROUP BY split),
 ra AS (SELECT split, (count(*) FILTER (u < mine) + (count(*) FILTER (u = mine) - 1) / 2.0::DOUBLE + 0.5) / count(*) AS w FROM me JOIN be USING (split) GROUP BY split)
 SELECT round(avg(CASE WHEN ln(w / (1 - w + 1e-12)) < 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS pbo, count(*) AS splits FROM ra""")
def _pbo(spark, sf_dir):
    perf = returns(spark, sf_dir).groupBy(F.col("k").alias("config"), (F.col("o") % 8).alias("fold")).agg(F.avg("r").alias("value"))
    return overfitting_probability(perf).withColumn("pbo", F.round("pbo", 6))


@query("reality_check")
def _reality(spark, sf_dir):
    return candidates_check(returns(spark, sf_dir), "k", "r", "d", "o", "ln")


@query("reliability", f"""WITH {RETURNS_SQL}, f AS (SELECT k, o % 4 AS fold, avg(r) AS m, count(*) AS c FROM ret GROUP BY ALL), g AS (SELECT k, avg(m) AS a, coalesce(stddev_samp(m), 0) AS s, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS w, count(*) AS nf FROM f GROUP BY k),
 h AS (SELECT k, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM ret GROUP BY k),
 x AS (SELECT h.k, n, n / (n + 30.0::DOUBLE) AS support, CASE WHEN nf = 1 THEN 0.5 ELSE w * (1 - CASE WHEN a <> 0 THEN least(s / abs(a), 1) ELSE 1 END) END AS stability,
   CASE WHEN n < 2 OR m <= 0 THEN 0 WHEN sd <= abs(m) * 1e-9 THEN 1 - exp(-n / 200.0) ELSE 1 - exp(-(m / (sd / sqrt(n))) / 2) END AS significance FROM h JOIN g USING (k))
 SELECT k, n, round(support, 6) AS support, round(stability, 6) AS stability, round(significance, 6) AS significance, round(support * stability * significance, 6) AS confidence,
   round(support * stability * significance, 6) >= 0.6 AND n >= 40 AS reliable FROM x""")
def _reliability(spark, sf_dir):
    rows = returns(spark, sf_dir)
    folds = rows.groupBy("k", (F.col("o") % 4).alias("fold")).agg(steady_mean("r").alias("m")).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "m"))), lambda x: x["m"]).alias("ms"))
    whole = rows.groupBy("k").agg(F.count("*").alias("n"), steady_mean("r").alias("m"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd"))
    parts = reliability(F.col("ms"), F.col("n"), F.col("n"), F.col("m"), F.col("sd"))
    out = whole.join(folds, "k").select("k", "n", *[F.round(c, 6).alias(name) for name, c in parts.items()])
    return out.withColumn("reliable", (F.col("confidence") >= 0.6) & (F.col("n") >= 40))
