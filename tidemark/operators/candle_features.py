"""Features of a candle series. Windows count rows, not minutes: gaps are invisible.

All features are framed windows over (symbol, ts_ms); a row's "before" never includes the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.candles import CANDLES_SQL, hourly
from ..sources.signals import SIGNALS_SQL, signals

BASELINE, CASCADE, MOMENTUM = 20, 6, 24
#: Corwin and Schultz: 3 - 2 sqrt(2)
SPREAD_DENOMINATOR = 3 - 2 * 2**0.5


def _rows(low: int, high: int):
    return Window.partitionBy("symbol").orderBy("ts_ms").rowsBetween(low, high)


def volume_z(window: int = BASELINE) -> Column:
    """Volume against mean and sample deviation of the preceding rows; 0 with fewer than two, or without spread."""
    w = _rows(-window, -1)
    deviation = F.stddev_samp("volume").over(w)
    usable = (F.count("volume").over(w) >= 2) & (deviation > 0)
    return F.when(usable, (F.col("volume") - F.avg("volume").over(w)) / deviation).otherwise(0.0)


def squeeze(direction: str, low: int, high: int) -> Column:
    """Share of volume, over rows low..high from here, in candles that move against the direction; 0 without volume."""
    against = F.col("close") < F.col("open") if direction == "long" else F.col("close") > F.col("open")
    w = _rows(low, high)
    total = F.sum("volume").over(w)
    return F.when(total > 0, F.sum(F.when(against, F.col("volume")).otherwise(0.0)).over(w) / total).otherwise(0.0)


def squeeze_after(direction: str, horizon: int = CASCADE) -> Column:
    return squeeze(direction, 1, horizon)


def squeeze_before(direction: str, horizon: int = CASCADE) -> Column:
    return squeeze(direction, -horizon, -1)


def momentum_pct(window: int = MOMENTUM) -> Column:
    """Change over the last rows before this one, in percent; null with fewer than two or a first close not above 0."""
    w = _rows(-window, -1)
    first, last = F.first("close").over(w), F.last("close").over(w)
    return F.when((F.count("close").over(w) >= 2) & (first > 0), (last / first - 1) * 100)


def range_features(candles: DataFrame, keys: list[str], order: str = "ts_ms") -> DataFrame:
    """Per group: mean range in percent of close, and the last quarter's range to that of the first three."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    size = F.count("*").over(Window.partitionBy(*keys))
    width = F.when(F.col("close") > 0, (F.col("high") - F.col("low")) / F.col("close")).otherwise(0.0)
    rows = candles.select(*keys, width.alias("r"), (position >= F.floor(size * 0.75)).alias("recent"))
    facts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.avg(F.when(~F.col("recent"), F.col("r"))).alias("base"), F.avg(F.when(F.col("recent"), F.col("r"))).alias("late"))
    return facts.select(
        *keys, "n", F.when(F.col("n") >= 40, F.round(F.col("mean") * 100, 6)).alias("range_pct"),
        F.when((F.col("n") >= 40) & (F.col("base") > 0), F.round(F.try_divide("late", "base"), 6)).alias("compression"),
    )


def zone_offset_pct(entry_from: Column, entry_to: Column, last_close: Column, direction: Column) -> Column:
    """Middle of the posted zone against the last close in percent, signed by the posted direction."""
    raw = ((entry_from + entry_to) / 2 - last_close) / last_close * 100
    return F.when(last_close > 0, F.round(F.when(direction == "long", raw).otherwise(-raw), 6))


def liquidity_quote(window: int = 60, least: int = 5) -> Column:
    """Upper median of volume over the preceding rows, times the last close, to two places; null with fewer than five."""
    w = _rows(-window, -1)
    volumes = F.array_sort(F.collect_list("volume").over(w))
    n = F.size(volumes)
    return F.when(n >= least, F.round(F.get(volumes, F.floor(n / 2).cast("int")) * F.last("close").over(w), 2))


def spread_pct(candles: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """Spread from the ranges of adjacent candles, clipped at 0: upper median in percent, null under 30 pairs."""
    order = Window.partitionBy(*keys).orderBy("ts_ms")
    h0, l0 = F.lag("high").over(order), F.lag("low").over(order)
    usable = (F.col("l0") > 0) & (F.col("low") > 0) & (F.col("h0") >= F.col("l0")) & (F.col("high") >= F.col("low"))
    pairs = candles.withColumns({"h0": h0, "l0": l0}).where(usable)
    square = lambda a, b: F.pow(F.ln(a / b), F.lit(2.0))
    beta = square(F.col("h0"), F.col("l0")) + square(F.col("high"), F.col("low"))
    gamma = square(F.greatest("h0", "high"), F.least("l0", "low"))
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / SPREAD_DENOMINATOR - F.sqrt(gamma / SPREAD_DENOMINATOR)
    value = F.greatest(2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), F.lit(0.0))
    lists = pairs.select(*keys, value.alias("v")).groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("vs"))
    n = F.size("vs")
    return lists.select(*keys, n.cast("long").alias("pairs"), F.when(n >= least, F.round(F.get("vs", F.floor(n / 2).cast("int")) * 100, 6)).alias("spread_pct"))


def noise_pct(candles: DataFrame, keys: list[str]) -> DataFrame:
    """Median absolute change from close to close, in percent."""
    before = F.lag("close").over(Window.partitionBy(*keys).orderBy("ts_ms"))
    moves = candles.withColumn("prev", before).where(F.col("prev") > 0).select(*keys, (F.abs(F.col("close") / F.col("prev") - 1) * 100).alias("m"))
    return moves.groupBy(*keys).agg(F.round(F.percentile("m", 0.5), 6).alias("noise_pct"), F.count("*").alias("moves"))


def check_candles(candles: DataFrame, interval_ms: int) -> DataFrame:
    """Per symbol: candles off the grid, repeated times, gaps, and candles whose prices contradict each other."""
    order = Window.partitionBy("symbol").orderBy("ts_ms")
    step = F.col("ts_ms") - F.lag("ts_ms").over(order)
    broken = (F.col("high") < F.col("low")) | (F.col("open") > F.col("high")) | (F.col("open") < F.col("low")) | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low")) | (F.col("low") <= 0)
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return candles.withColumn("step", step).groupBy("symbol").agg(
        F.count("*").alias("candles"), total(F.pmod("ts_ms", F.lit(interval_ms)) != 0).alias("unaligned"), total(F.col("step") == 0).alias("repeated"),
        total(F.col("step") > interval_ms).alias("gaps"), total(broken).alias("broken"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"),
    )


@query("candles_hourly", f"WITH {CANDLES_SQL} SELECT symbol, ts_ms, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def _candles(spark, sf_dir):
    return hourly(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("open", "high", "low", "close")})


@query("candle_checks", f"""WITH {CANDLES_SQL}, s AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) AS step FROM bars)
SELECT symbol, count(*) AS candles, count(*) FILTER (ts_ms % 3600000 <> 0) AS unaligned, count(*) FILTER (step = 0) AS repeated, count(*) FILTER (step > 3600000) AS gaps,
  count(*) FILTER (high < low OR open > high OR open < low OR close > high OR close < low OR low <= 0) AS broken, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts FROM s GROUP BY symbol""")
def _candle_checks(spark, sf_dir):
    return check_candles(hourly(spark, sf_dir), 3_600_000)


@query("vol_z", f"""WITH {CANDLES_SQL} SELECT symbol, ts_ms, round(z, 6) AS vol_z, CASE WHEN z >= 2 THEN 'anomalous' ELSE 'calm' END AS vol_regime FROM (
  SELECT symbol, ts_ms, CASE WHEN count(volume) OVER w >= 2 AND stddev_samp(volume) OVER w > 0 THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w ELSE 0 END AS z
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""")
def _vol_z(spark, sf_dir):
    z = hourly(spark, sf_dir).select("symbol", "ts_ms", volume_z().alias("z"))
    return z.select("symbol", "ts_ms", F.round("z", 6).alias("vol_z"), F.when(F.col("z") >= 2, "anomalous").otherwise("calm").alias("vol_regime"))


def _squeeze_sql(low: str, high: str) -> str:
    parts = ", ".join(
        f"round(CASE WHEN sum(volume) OVER w > 0 THEN sum(CASE WHEN {test} THEN volume ELSE 0 END) OVER w / sum(volume) OVER w ELSE 0 END, 6) AS squeeze_{side}"
        for side, test in (("long", "close < open"), ("short", "close > open"))
    )
    return f"WITH {CANDLES_SQL} SELECT symbol, ts_ms, {parts} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN {low} AND {high})"


@query("squeeze_after", _squeeze_sql("1 FOLLOWING", "6 FOLLOWING"))
def _squeeze_after(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "ts_ms", *[F.round(squeeze_after(d), 6).alias(f"squeeze_{d}") for d in ("long", "short")])


@query("squeeze_before", _squeeze_sql("6 PRECEDING", "1 PRECEDING"))
def _squeeze_before(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "ts_ms", *[F.round(squeeze_before(d), 6).alias(f"squeeze_{d}") for d in ("long", "short")])


@query("momentum", f"""WITH {CANDLES_SQL} SELECT symbol, ts_ms, round(CASE WHEN count(*) OVER w >= 2 AND first_value(close) OVER w > 0 THEN (last_value(close) OVER w / first_value(close) OVER w - 1) * 100 END, 6) AS momentum_pct
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""")
def _momentum(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "ts_ms", F.round(momentum_pct(), 6).alias("momentum_pct"))


@query("range_compression", f"""WITH {CANDLES_SQL}, p AS (SELECT symbol, CASE WHEN close > 0 THEN (high - low) / close ELSE 0 END AS r,
   row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) - 1 >= floor(count(*) OVER (PARTITION BY symbol) * 0.75) AS recent FROM bars),
 g AS (SELECT symbol, count(*) AS n, avg(r) AS m, avg(r) FILTER (NOT recent) AS b, avg(r) FILTER (recent) AS l FROM p GROUP BY symbol)
 SELECT symbol, n, CASE WHEN n >= 40 THEN round(m * 100, 6) END AS range_pct, CASE WHEN n >= 40 AND b > 0 THEN round(l / b, 6) END AS compression FROM g""")
def _range(spark, sf_dir):
    return range_features(hourly(spark, sf_dir), ["symbol"])


@query("zone_offset", f"""WITH {SIGNALS_SQL}, {CANDLES_SQL}, j AS (SELECT s.seq, s.direction, s.entry_from, s.entry_to, b.close FROM sig s ASOF LEFT JOIN bars b ON s.symbol = b.symbol AND b.ts_ms < s.ts_ms - s.ts_ms % 3600000)
 SELECT seq, round(CASE WHEN close > 0 THEN CASE WHEN direction = 'long' THEN 1 ELSE -1 END * (((entry_from + entry_to) / 2 - close) / close * 100) END, 6) AS zone_offset FROM j""")
def _zone(spark, sf_dir):
    joined = last_candle_before(signals(spark, sf_dir), hourly(spark, sf_dir), 3_600_000)
    return joined.select("seq", zone_offset_pct(F.col("entry_from"), F.col("entry_to"), F.col("last_close"), F.col("direction")).alias("zone_offset"))


def last_candle_before(events: DataFrame, candles: DataFrame, interval_ms: int) -> DataFrame:
    """Adds last_close: close of the latest candle that had ended when the event's own candle began (as-of join).

    Events and candles are merged into one ordered stream per symbol; the last close seen before each event is its
    answer, so nothing is paired up by inequality.
    """
    columns = events.columns
    marks = candles.select("symbol", (F.col("ts_ms") + 1).alias("_t"), F.col("close").alias("_close"), F.lit(0).alias("_side"))
    asks = events.select("*", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(interval_ms))).alias("_t"), F.lit(1).alias("_side"))
    both = asks.unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("last_close", F.last("_close", ignorenulls=True).over(order)).where(F.col("_side") == 1).select(*columns, "last_close")


@query("liquidity", f"""WITH {CANDLES_SQL}, w AS (SELECT symbol, ts_ms, list(volume) OVER w AS v, last_value(close) OVER w AS c
   FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
 SELECT symbol, ts_ms, CASE WHEN len(v) >= 5 THEN round(list_sort(v)[len(v) // 2 + 1] * c, 2) END AS liquidity_quote FROM w""")
def _liquidity(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "ts_ms", liquidity_quote().alias("liquidity_quote"))


@query("corwin_schultz", f"""WITH {CANDLES_SQL}, p AS (SELECT symbol, high, low, lag(high) OVER w AS h0, lag(low) OVER w AS l0 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)),
 q AS (SELECT symbol, pow(ln(h0 / l0), 2) + pow(ln(high / low), 2) AS b, pow(ln(greatest(h0, high) / least(l0, low)), 2) AS g FROM p WHERE l0 > 0 AND low > 0 AND h0 >= l0 AND high >= low),
 a AS (SELECT symbol, (sqrt(2 * b) - sqrt(b)) / (3 - 2 * sqrt(2)) - sqrt(g / (3 - 2 * sqrt(2))) AS a FROM q),
 s AS (SELECT symbol, list_sort(list(greatest(2 * (exp(a) - 1) / (1 + exp(a)), 0))) AS v FROM a GROUP BY symbol)
 SELECT symbol, len(v)::BIGINT AS pairs, CASE WHEN len(v) >= 30 THEN round(v[len(v) // 2 + 1] * 100, 6) END AS spread_pct FROM s""")
def _spread(spark, sf_dir):
    return spread_pct(hourly(spark, sf_dir), ["symbol"])


@query("noise", f"""WITH {CANDLES_SQL}, p AS (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms) AS prev FROM bars)
 SELECT symbol, round(quantile_cont(abs(close / prev - 1) * 100, 0.5), 6) AS noise_pct, count(*) AS moves FROM p WHERE prev > 0 GROUP BY symbol""")
def _noise(spark, sf_dir):
    return noise_pct(hourly(spark, sf_dir), ["symbol"])
