"""Live planning: features from candles before the signal only, and a chain of filters whose first refusal is kept.

A policy can only tighten what the model was trained with; what is requested is intersected with it.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import band_join
from ..plans.registry import query
from ..sources.candles import CANDLES_SQL, hourly
from ..sources.signals import SIGNALS_SQL, signals
from .replay import HOUR
from .selection import resolve_exit

ACTIONS = ("enter", "invert", "tighten")
LARGER = ("min_risk_reward", "min_momentum_pct", "notional_quote", "min_p_win", "min_expected_pnl_pct", "min_channel_score")
LIQUIDITY_ROWS, LIQUIDITY_LEAST, RANGE_LEAST = 60, 5, 40


@dataclass(frozen=True)
class Policy:
    allow: tuple[str, ...] = ACTIONS
    min_risk_reward: float | None = None
    rr_metric: str | None = None
    require_volume_confirm: bool = False
    min_momentum_pct: float | None = None
    momentum_window: int | None = None
    notional_quote: float | None = None
    max_liquidity_share: float | None = None
    min_p_win: float | None = None
    min_expected_pnl_pct: float | None = None
    acknowledge_uncertified: bool = False
    min_channel_score: float | None = None

    @classmethod
    def from_dict(cls, data: dict) -> Policy:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if k == "allow" else v for k, v in data.items() if k in known})


def intersect(trained: Policy, requested: Policy | None) -> Policy:
    """The stricter of both; the metric of risk and reward and the momentum window follow the request."""
    asked = requested or Policy()
    strict = lambda pick, a, b: b if a is None else a if b is None else pick(a, b)
    allow = tuple(dict.fromkeys(a for a in asked.allow if a in trained.allow))
    merged = {name: strict(max, getattr(trained, name), getattr(asked, name)) for name in LARGER}
    return Policy(
        allow=allow, rr_metric=asked.rr_metric or trained.rr_metric or "mean", momentum_window=asked.momentum_window or trained.momentum_window,
        require_volume_confirm=trained.require_volume_confirm or asked.require_volume_confirm, acknowledge_uncertified=trained.acknowledge_uncertified or asked.acknowledge_uncertified,
        max_liquidity_share=strict(min, trained.max_liquidity_share, asked.max_liquidity_share), **merged,
    )


def pre_candle_features(asks: DataFrame, candles: DataFrame, key: str, interval_ms: int = 60_000, lookback: int = 1440, momentum_window: int = 1440, baseline: str | int = 20, horizon: str | int = 60, side: str = "direction") -> DataFrame:
    """Per ask with a candle before it: features of the candles that begin before its first whole candle.

    The last of them stands for the entry, as nothing later may be looked at: its volume is compared with the candles
    before it, and so are pressure and liquidity. baseline and horizon are numbers or columns of asks. Asks of one
    symbol, side and candle read the same candles, so these are met and folded once for all of them.
    """
    value = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    start = F.col("ts_ms") + F.pmod(interval_ms - F.pmod("ts_ms", F.lit(interval_ms)), F.lit(interval_ms))
    left = asks.select(F.col(key).alias("_key"), "symbol", F.col(side).alias("_side"), start.alias("_start"), value(baseline).alias("_base"), value(horizon).alias("_hor"))
    bars = candles.select("symbol", F.col("ts_ms").alias("_bar"), "open", "high", "low", "close", "volume")
    spot = ["symbol", "_side", "_start", "_base", "_hor"]
    near = band_join(left.select(*spot).distinct(), bars, ["symbol"], "_start", "_bar", -lookback * interval_ms, -1)
    lists = near.groupBy(*spot).agg(F.reverse(F.array_sort(F.collect_list(F.struct("_bar", "open", "high", "low", "close", "volume")))).alias("cs"))
    cs, last = F.col("cs"), F.get("cs", F.lit(0))
    before = lambda n: F.slice(cs, F.lit(2), n)  # noqa: E731  from the candle before the last one backwards
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    base = F.transform(before(F.col("_base")), lambda c: c["volume"])
    n = F.size(base)
    mean = total(base) / n
    deviation = F.sqrt(F.aggregate(base, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1))
    bad = lambda c: F.when(F.col("_side") == "long", c["close"] < c["open"]).otherwise(c["close"] > c["open"])
    window = before(F.col("_hor"))
    volume = total(F.transform(window, lambda c: c["volume"]))
    against = total(F.transform(window, lambda c: F.when(bad(c), c["volume"]).otherwise(0.0)))
    recent = F.array_sort(F.transform(before(F.lit(LIQUIDITY_ROWS)), lambda c: c["volume"]))
    moving = F.slice(cs, F.lit(1), F.lit(momentum_window))
    first = F.element_at(moving, -1)["close"]
    width = lambda xs: total(F.transform(xs, lambda c: F.when(c["close"] > 0, (c["high"] - c["low"]) / c["close"]).otherwise(0.0))) / F.size(xs)
    size = F.size(cs)
    early = F.floor(size * 0.75).cast("int")
    old, new = F.slice(cs, size - early + 1, early), F.slice(cs, F.lit(1), size - early)
    enough = size >= RANGE_LEAST
    found = lists.select(
        *[F.col(c).alias(f"_of_{c}") for c in spot], F.when((n >= 2) & (deviation > 0), (last["volume"] - mean) / deviation).otherwise(0.0).alias("vol_z"),
        F.when(volume > 0, against / volume).otherwise(0.0).alias("squeeze_before"),
        F.when(F.size(recent) >= LIQUIDITY_LEAST, F.round(F.get(recent, F.floor(F.size(recent) / 2).cast("int")) * F.get(cs, F.lit(1))["close"], 2)).alias("liquidity_quote"),
        F.when((F.size(moving) >= 2) & (first > 0), (last["close"] / first - 1) * 100).alias("momentum"), last["close"].alias("last_close"),
        F.when(enough, F.round(width(cs) * 100, 6)).alias("range_pct"), F.when(enough & (width(old) > 0), F.round(width(new) / width(old), 6)).alias("compression"),
    )
    same = F.lit(True)
    for c in spot:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return left.join(found, same).select(F.col("_key").alias(key), *[c for c in found.columns if not c.startswith("_of_")])


def market_momentum(asks: DataFrame, candles: DataFrame, key: str, benchmark: str, interval_ms: int = 60_000, window: int = 1440) -> DataFrame:
    """Per ask: (key, market), the benchmark's own momentum before it. Only worth reading if a model has learned it."""
    same = asks.select(key, F.lit(benchmark).alias("symbol"), "direction", "ts_ms")
    found = pre_candle_features(same, candles.where(F.col("symbol") == benchmark), key, interval_ms, window, window)
    return found.select(key, F.col("momentum").alias("market"))


def filter_chain(asks: DataFrame, policy: Policy, certified: bool | None, live: bool) -> DataFrame:
    """Adds rejected_by (null for signals that pass), action, side and final_direction.

    asks brings the facts of each signal, null where unknown: channel, channel_plan, risk_reward, channel_score,
    vol_regime, momentum, liquidity_quote, pressure, p_win, expected_pnl, squeeze_policy, squeeze_threshold, and
    has_outcome. The order of the tests is part of the contract.
    """
    opposite = lambda c: F.when(c == "long", "short").otherwise("long")
    turned = F.col("channel").isNotNull() & (F.coalesce("channel_plan", F.lit("")) == "invert")
    side = F.when(turned, opposite(F.col("direction"))).otherwise(F.col("direction"))
    fires = F.col("pressure").isNotNull() & (F.col("pressure") >= F.coalesce("squeeze_threshold", F.lit(0.6)))
    invert = fires & (F.col("squeeze_policy") == "invert") & ~turned
    tighten = fires & (F.col("squeeze_policy") == "tighten")
    action = F.when(turned | invert, "invert").when(tighten, "tighten").otherwise("enter")
    allowed = lambda name: F.lit(name in policy.allow)
    missing_or_below = lambda c, least: F.col(c).isNull() | (F.col(c) < least)
    never = F.lit(False)
    directed = F.when(side == "long", F.col("momentum")).otherwise(-F.col("momentum"))
    share = policy.max_liquidity_share if policy.max_liquidity_share is not None else 0.1
    single = F.col("channel").isNotNull()
    tests: list[tuple[str, Column]] = [
        ("uncertified-model", F.lit(live and certified is False and not policy.acknowledge_uncertified)),
        ("channel-plan:drop", single & (F.coalesce("channel_plan", F.lit("")) == "drop")),
        ("channel-plan:invert-not-allowed", turned & ~allowed("invert")),
        ("min-risk-reward", missing_or_below("risk_reward", policy.min_risk_reward) if policy.min_risk_reward is not None else never),
        ("min-channel-score", single & missing_or_below("channel_score", policy.min_channel_score) if policy.min_channel_score is not None else never),
        ("capacity", F.col("liquidity_quote").isNull() | (F.lit(policy.notional_quote) > share * F.col("liquidity_quote")) if policy.notional_quote is not None else never),
        ("volume-confirm", F.coalesce("vol_regime", F.lit("")) != "anomalous" if policy.require_volume_confirm else never),
        ("momentum-gate", F.col("momentum").isNull() | (directed < policy.min_momentum_pct) if policy.min_momentum_pct is not None else never),
        ("min-pwin", F.col("has_outcome") & (F.col("p_win") < policy.min_p_win) if policy.min_p_win is not None else never),
        ("min-expected-pnl", F.col("has_outcome") & (F.col("expected_pnl") * 100 < policy.min_expected_pnl_pct) if policy.min_expected_pnl_pct is not None else never),
        ("cascade-veto", fires & (F.col("squeeze_policy") == "veto")),
        ("invert-not-allowed", invert & ~allowed("invert")),
        ("tighten-not-allowed", tighten & ~allowed("tighten")),
        ("enter-not-allowed", (action == "enter") & ~allowed("enter")),
    ]
    verdict = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in tests])
    final = F.when(invert, opposite(side)).otherwise(side)
    return asks.withColumns({"rejected_by": verdict, "action": action, "final_direction": final, "inverted_from": F.when(turned, F.col("direction")).when(invert, side), "tightened": tighten})


#: Facts that an explanation shows, null where unknown.
SHOWN = ("risk_reward", "channel_score", "vol_z", "pressure", "liquidity_quote", "symbol_gap_ms", "momentum", "market", "p_win", "expected_pnl", "risk_share")


def explained(judged: DataFrame, policy: Policy) -> DataFrame:
    """Adds detail, what a refusal rests on, in words and numbers, and values, the facts of the signal as a map."""
    number = lambda c: F.coalesce(F.format_number(c, 4), F.lit("unknown"))
    share = policy.max_liquidity_share if policy.max_liquidity_share is not None else 0.1
    say = {
        "uncertified-model": F.lit("the model has no certificate and the policy doesn't acknowledge that"),
        "channel-plan:drop": F.concat(F.lit("channel "), F.coalesce("channel", F.lit("?")), F.lit(" loses significantly in its history")),
        "channel-plan:invert-not-allowed": F.concat(F.lit("channel "), F.coalesce("channel", F.lit("?")), F.lit(" is traded inverted, which the policy doesn't allow")),
        "min-risk-reward": F.concat(F.lit("risk and reward of the symbol: "), number("risk_reward"), F.lit(f", least {policy.min_risk_reward}")),
        "min-channel-score": F.concat(F.lit("score of the channel: "), number("channel_score"), F.lit(f", least {policy.min_channel_score}")),
        "capacity": F.concat(F.lit(f"size {policy.notional_quote} against {share} of a turnover of "), number("liquidity_quote")),
        "volume-confirm": F.concat(F.lit("volume before the post is "), F.coalesce("vol_regime", F.lit("unknown"))),
        "momentum-gate": F.concat(F.lit("momentum "), number("momentum"), F.lit(f" percent, least {policy.min_momentum_pct} in the direction of the trade")),
        "min-pwin": F.concat(F.lit("chance to win "), number("p_win"), F.lit(f", least {policy.min_p_win}")),
        "min-expected-pnl": F.concat(F.lit("expected result in percent "), number(F.col("expected_pnl") * 100), F.lit(f", least {policy.min_expected_pnl_pct}")),
        "cascade-veto": F.concat(F.lit("pressure against the post "), number("pressure"), F.lit(", from "), number(F.coalesce("squeeze_threshold", F.lit(0.6)))),
        "invert-not-allowed": F.concat(F.lit("pressure "), number("pressure"), F.lit(" asks for an inversion, which the policy doesn't allow")),
        "tighten-not-allowed": F.concat(F.lit("pressure "), number("pressure"), F.lit(" asks for a tighter trail, which the policy doesn't allow")),
        "enter-not-allowed": F.lit("the policy doesn't allow plain entries"),
    }
    detail = F.coalesce(*[F.when(F.col("rejected_by") == code, text) for code, text in say.items()])
    known = [c for c in SHOWN if c in judged.columns]
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in known]), F.array(*[F.col(c).cast("double") for c in known]))
    return judged.withColumns({"detail": detail, "values": values})


def with_exits(asks: DataFrame, tensor: DataFrame, exits: DataFrame, with_regime: bool) -> DataFrame:
    """Adds the exit of each ask's cell, or of the levels above, with its parameters. exits is a bounded grid."""
    columns = [c for c in exits.columns if c != "exit_id"]
    return resolve_exit(asks, tensor, with_regime).join(F.broadcast(exits.select("exit_id", *columns)), "exit_id")


@query("pre_candle_features", f"""WITH {SIGNALS_SQL}, {CANDLES_SQL},
 j AS (SELECT s.seq, s.direction, b.*, row_number() OVER (PARTITION BY s.seq ORDER BY b.ts_ms DESC) - 1 AS r FROM sig s JOIN bars b ON b.symbol = s.symbol
   AND b.ts_ms < s.ts_ms + (3600000 - s.ts_ms % 3600000) % 3600000 AND b.ts_ms >= s.ts_ms + (3600000 - s.ts_ms % 3600000) % 3600000 - 48 * 3600000::BIGINT),
 a AS (SELECT seq, count(*) FILTER (r BETWEEN 1 AND 20) AS n, avg(volume) FILTER (r BETWEEN 1 AND 20) AS m, stddev_samp(volume) FILTER (r BETWEEN 1 AND 20) AS sd, max(volume) FILTER (r = 0) AS v0,
   sum(volume) FILTER (r BETWEEN 1 AND 6) AS tv, coalesce(sum(volume) FILTER (r BETWEEN 1 AND 6 AND CASE WHEN direction = 'long' THEN close < open ELSE close > open END), 0) AS av,
   list_sort(list(volume) FILTER (r BETWEEN 1 AND 60)) AS lv, max(close) FILTER (r = 1) AS c1, max(close) FILTER (r = 0) AS c0, arg_max(close, r) FILTER (r < 24) AS cf, count(*) FILTER (r < 24) AS nm FROM j GROUP BY seq)
 SELECT seq, round(CASE WHEN n >= 2 AND sd > 0 THEN (v0 - m) / sd ELSE 0 END, 6) AS vol_z, round(CASE WHEN tv > 0 THEN av / tv ELSE 0 END, 6) AS squeeze_before,
   CASE WHEN len(lv) >= 5 THEN round(lv[len(lv) // 2 + 1] * c1, 2) END AS liquidity_quote, round(CASE WHEN nm >= 2 AND cf > 0 THEN (c0 / cf - 1) * 100 END, 6) AS momentum, c0 AS last_close FROM a""")
def _pre_features(spark, sf_dir):
    found = pre_candle_features(signals(spark, sf_dir), hourly(spark, sf_dir), "seq", HOUR, 48, 24, 20, 6)
    return found.select("seq", F.round("vol_z", 6).alias("vol_z"), F.round("squeeze_before", 6).alias("squeeze_before"), "liquidity_quote", F.round("momentum", 6).alias("momentum"), "last_close")
