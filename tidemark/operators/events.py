"""Point events: windows, anchored posts, fatigue, placebo shifts, robot signatures and feed reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import anchored_groups
from ..plans.registry import query
from ..sources import candles as candle_source
from ..sources.signals import SIGNALS_SQL, normalize, raw_signals, signals

KEY = ["symbol", "direction"]
MINUTE = 60_000
POST_WINDOW_MS = 45 * MINUTE
MAX_BURST_MS = 3_600_000


def window_events(events: DataFrame, anchor_ms: int, window_ms: float) -> DataFrame:
    """Events after anchor - window (excluded) up to the anchor (included); an infinite window keeps all before it too."""
    if window_ms == float("inf"):
        return events
    return events.where((F.col("ts_ms") > anchor_ms - int(window_ms)) & (F.col("ts_ms") <= anchor_ms))


def channels_in_order(events: DataFrame) -> DataFrame:
    """(channel, rank): distinct channels, ranked by first appearance. The window runs over channels, not events."""
    first = events.groupBy("channel").agg(F.min(F.struct("ts_ms", "seq")).alias("first"))
    return first.select("channel", (F.row_number().over(Window.orderBy("first")) - 1).alias("rank"))


def fatigue_gap(events: DataFrame, max_burst_ms: int = MAX_BURST_MS) -> DataFrame:
    """Adds gap_ms: time since the symbol's latest event at least ``max_burst_ms`` before, in any direction; else null."""
    earlier = Window.partitionBy("symbol").orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -max_burst_ms)
    return events.withColumn("gap_ms", F.col("ts_ms") - F.max("ts_ms").over(earlier))


def collapse_posts(events: DataFrame, window_ms: int) -> DataFrame:
    """One row per anchored group of each key: its first event, with the ids of all, in time order."""
    groups = anchored_groups(events.select(*KEY, "ts_ms", "seq", "id", "channel", "entry_from", "entry_to"), KEY, window_ms)
    member = F.struct("ts_ms", "seq", "id", "channel", "entry_from", "entry_to")
    rows = groups.groupBy(*KEY, "anchor_ts", "anchor_seq").agg(F.array_sort(F.collect_list(member)).alias("_rows"))
    head = F.get("_rows", F.lit(0))
    return rows.select(
        *KEY, F.col("anchor_ts").alias("ts_ms"), F.col("anchor_seq").alias("seq"), head["id"].alias("id"), head["channel"].alias("channel"),
        head["entry_from"].alias("entry_from"), head["entry_to"].alias("entry_to"),
        F.filter(F.transform("_rows", lambda r: r["id"]), lambda i: i.isNotNull()).alias("ids"), F.size("_rows").cast("long").alias("n_posts"),
    )


def single_channel_signals(events: DataFrame, window_ms: int) -> DataFrame:
    """Each collapsed post as an open verdict of the single-channel detector."""
    posts = collapse_posts(events, window_ms)
    return posts.select(
        *KEY, "ts_ms", "seq", F.lit("open").alias("action"), F.lit(0.5).alias("confidence"), F.lit("single").alias("source"), "channel", "id", "ids", "entry_from", "entry_to",
        F.lit(1).cast("long").alias("independent_clusters"), F.lit(1).cast("long").alias("total_channels"),
    )


def algo_signature(events: DataFrame) -> DataFrame:
    """Per channel: how much its posting looks scheduled, by interval regularity and by concentration on an hour (UTC).

    Regularity is 1 minus the relative entropy of log gaps over 12 equal bins (constant gaps: 1; needs 4 positive
    gaps); under 8 posts the score is 0.
    """
    order = Window.partitionBy("channel").orderBy("ts_ms", "seq")
    gaps = events.withColumn("gap", F.col("ts_ms") - F.lag("ts_ms").over(order)).where(F.col("gap") > 0).select("channel", F.ln("gap").alias("l"))
    whole = Window.partitionBy("channel")
    binned = gaps.select("channel", "l", F.min("l").over(whole).alias("lo"), F.max("l").over(whole).alias("hi"), F.count("*").over(whole).alias("m"))
    bins = binned.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("l") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 12), F.lit(11))).otherwise(0))
    shares = bins.groupBy("channel", "m", "lo", "hi", "bin").agg((F.count("*") / F.col("m")).alias("p"))
    entropy = shares.groupBy("channel", "m", "lo", "hi").agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"))
    regular = F.when(F.col("m") < 4, 0.0).when(F.col("hi") - F.col("lo") < 1e-9, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("h") / F.ln(F.least(F.lit(12), F.col("m")))))
    intervals = entropy.select("channel", regular.alias("regular"))
    hours = events.groupBy("channel", F.floor(F.pmod("ts_ms", F.lit(86_400_000)) / 3_600_000).alias("hour")).agg(F.count("*").alias("c"))
    peaks = hours.groupBy("channel").agg(F.sum("c").alias("n"), (F.max("c") / F.sum("c")).alias("modal"))
    enough = F.col("n") >= 8
    regular, modal = F.coalesce("regular", F.lit(0.0)), F.col("modal")
    return peaks.join(intervals, "channel", "left").select(
        "channel", "n",
        F.round(F.when(enough, F.greatest(regular, modal)).otherwise(0.0), 6).alias("algo_score"),
        F.round(F.when(enough, regular).otherwise(0.0), 6).alias("interval_regularity"),
        F.round(F.when(enough, modal).otherwise(0.0), 6).alias("modal_hour_concentration"),
    )


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units; exact in 64-bit arithmetic by splitting the product."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    last = (F.length(digits) / 4).cast("int") - 1
    units = F.transform(F.sequence(F.lit(0), last), lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    start = F.lit(2166136261)

    def step(state: Column, unit: Column) -> Column:
        x = state.bitwiseXOR(unit)
        # x * 16777619 mod 2^32, with 16777619 = 2^24 + 403
        return (F.shiftleft(x.bitwiseAND(255), 24) + x * 403).bitwiseAND(0xFFFFFFFF)

    return F.when(F.length(text) > 0, F.aggregate(units, start, step)).otherwise(start)


def placebo_shift(events: DataFrame) -> DataFrame:
    """Events moved back by 3 to 15 days, to the minute, by a share drawn from the channel's name: a control feed."""
    shifts = events.select("channel").distinct().withColumn("u", fnv1a(F.col("channel")) / F.lit(4294967296.0))
    shifts = shifts.withColumn("shift_ms", (F.round((3 + 12 * F.col("u")) * 1440) * MINUTE).cast("long"))
    return events.join(shifts.select("channel", "shift_ms"), "channel").withColumn("ts_ms", F.col("ts_ms") - F.col("shift_ms"))


def items_report(raw: DataFrame) -> DataFrame:
    """One row on the quality of a feed: totals, invalid rows, exact duplicates, breadth and span."""
    valid = normalize(raw)
    totals = raw.agg(F.count("*").alias("total"))
    facts = valid.agg(
        F.count("*").alias("valid"), F.count_distinct("channel").alias("channels"), F.count_distinct("symbol").alias("symbols"),
        F.round((F.max("ts_ms") - F.min("ts_ms")) / 86_400_000, 6).alias("span_days"),
    )
    copies = valid.groupBy("channel", "symbol", "direction", "ts_ms").agg((F.count("*") - 1).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("duplicates"))
    return totals.crossJoin(facts).crossJoin(copies).select("total", "valid", (F.col("total") - F.col("valid")).alias("invalid"), "duplicates", "channels", "symbols", "span_days")


@query("signals_clean", f"""WITH {SIGNALS_SQL} SELECT seq, id, channel, symbol, direction, ts_ms, round(entry_from, 6) AS entry_from, round(entry_to, 6) AS entry_to
    FROM sig WHERE channel IS NOT NULL AND symbol IS NOT NULL AND ts_ms IS NOT NULL""")
def _signals_clean(spark, sf_dir):
    return signals(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("entry_from", "entry_to")})


@query("items_report", f"""WITH {SIGNALS_SQL} SELECT count(*) AS total, count(*) AS valid, 0::BIGINT AS invalid,
      (SELECT sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM sig GROUP BY channel, symbol, direction, ts_ms)) AS duplicates,
      count(DISTINCT channel) AS channels, count(DISTINCT symbol) AS symbols, round((max(ts_ms) - min(ts_ms)) / 86400000.0::DOUBLE, 6) AS span_days FROM sig""")
def _items_report(spark, sf_dir):
    return items_report(raw_signals(spark, sf_dir))


@query("windowed_events", f"WITH {SIGNALS_SQL} SELECT seq, symbol, direction, ts_ms FROM sig WHERE ts_ms > 1705000000000 - 604800000 AND ts_ms <= 1705000000000")
def _windowed(spark, sf_dir):
    return window_events(signals(spark, sf_dir), 1_705_000_000_000, 7 * 86_400_000).select("seq", *KEY, "ts_ms")


@query("channel_order", f"WITH {SIGNALS_SQL} SELECT channel, row_number() OVER (ORDER BY o) - 1 AS rank FROM (SELECT channel, min((ts_ms, seq)) AS o FROM sig GROUP BY channel)")
def _channel_order(spark, sf_dir):
    return channels_in_order(signals(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("fatigue_gap", f"WITH {SIGNALS_SQL} SELECT seq, symbol, ts_ms, (ts_ms - max(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000 PRECEDING))::DOUBLE AS gap_ms FROM sig")
def _fatigue_gap(spark, sf_dir):
    return fatigue_gap(signals(spark, sf_dir)).select("seq", "symbol", "ts_ms", F.col("gap_ms").cast("double").alias("gap_ms"))


def anchors_sql(windows: list[int], tags: list[str]) -> str:
    """Tables sig, n, and for each window nx, a and p (with its tag): the anchors of the collapse, by recursion."""
    parts = [SIGNALS_SQL, "n AS MATERIALIZED (SELECT symbol, direction, ts_ms, seq, id, row_number() OVER (PARTITION BY symbol, direction ORDER BY ts_ms, seq) AS k FROM sig)"]
    for window, t in zip(windows, tags):
        parts.append(f"""nx{t} AS MATERIALIZED (SELECT symbol, direction, k, k + count(*) OVER (PARTITION BY symbol, direction ORDER BY ts_ms RANGE BETWEEN CURRENT ROW AND {window} FOLLOWING)
         - (count(*) OVER (PARTITION BY symbol, direction, ts_ms ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS nxt FROM n),
a{t} AS (SELECT symbol, direction, 1::BIGINT AS k FROM n WHERE k = 1
      UNION ALL SELECT a.symbol, a.direction, nx.nxt FROM a{t} a JOIN nx{t} nx ON a.symbol = nx.symbol AND a.direction = nx.direction AND a.k = nx.k
      WHERE nx.nxt <= (SELECT max(k) FROM n WHERE n.symbol = a.symbol AND n.direction = a.direction)),
p{t} AS (SELECT n.symbol, n.direction, n.ts_ms, n.seq, n.k, coalesce(lead(n.k) OVER (PARTITION BY n.symbol, n.direction ORDER BY n.k), 1000000000000) - 1 AS last
      FROM n JOIN a{t} a ON n.symbol = a.symbol AND n.direction = a.direction AND n.k = a.k)""")
    return ",\n".join(parts)


_ANCHORS = f"WITH RECURSIVE {anchors_sql([POST_WINDOW_MS], [''])}\n"


@query("posts_collapsed", _ANCHORS + """SELECT symbol, direction, count(*) AS posts, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts FROM p GROUP BY symbol, direction""")
def _posts_collapsed(spark, sf_dir):
    posts = collapse_posts(signals(spark, sf_dir), POST_WINDOW_MS)
    return posts.groupBy(*KEY).agg(F.count("*").alias("posts"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))


@query("single_channel_signals", _ANCHORS + """SELECT p.symbol, p.direction, p.ts_ms, p.seq, 0.5::DOUBLE AS confidence, string_agg(n.id, ',' ORDER BY n.k) AS ids
    FROM p JOIN n ON p.symbol = n.symbol AND p.direction = n.direction AND n.k BETWEEN p.k AND p.last GROUP BY ALL""")
def _single(spark, sf_dir):
    found = single_channel_signals(signals(spark, sf_dir), POST_WINDOW_MS)
    return found.select(*KEY, "ts_ms", "seq", "confidence", F.array_join("ids", ",").alias("ids"))


@query("algo_signature", f"""WITH {SIGNALS_SQL},
g AS (SELECT channel, ln(d) AS l FROM (SELECT channel, ts_ms - lag(ts_ms) OVER (PARTITION BY channel ORDER BY ts_ms, seq) AS d FROM sig) WHERE d > 0),
b AS (SELECT channel, m, lo, hi, CASE WHEN hi > lo THEN least(floor((l - lo) / (hi - lo) * 12), 11) ELSE 0 END AS bin
      FROM (SELECT channel, l, min(l) OVER w AS lo, max(l) OVER w AS hi, count(*) OVER w AS m FROM g WINDOW w AS (PARTITION BY channel))),
e AS (SELECT channel, m, lo, hi, -sum(p * ln(p)) AS h FROM (SELECT channel, m, lo, hi, bin, count(*)::DOUBLE / m AS p FROM b GROUP BY channel, m, lo, hi, bin) GROUP BY channel, m, lo, hi),
r AS (SELECT channel, CASE WHEN m < 4 THEN 0.0 WHEN hi - lo < 1e-9 THEN 1.0 ELSE greatest(0.0, 1 - h / ln(least(12, m))) END AS reg FROM e),
k AS (SELECT channel, sum(c)::BIGINT AS n, max(c)::DOUBLE / sum(c) AS modal FROM (SELECT channel, ts_ms % 86400000 // 3600000 AS hour, count(*) AS c FROM sig GROUP BY ALL) GROUP BY channel)
SELECT k.channel, n, round(CASE WHEN n >= 8 THEN greatest(coalesce(reg, 0), modal) ELSE 0 END, 6) AS algo_score,
       round(CASE WHEN n >= 8 THEN coalesce(reg, 0) ELSE 0 END, 6) AS interval_regularity, round(CASE WHEN n >= 8 THEN modal ELSE 0 END, 6) AS modal_hour_concentration
FROM k LEFT JOIN r ON k.channel = r.channel""")
def _algo(spark, sf_dir):
    return algo_signature(signals(spark, sf_dir))


@query("placebo_shift", f"""WITH RECURSIVE {SIGNALS_SQL}, ch AS (SELECT DISTINCT channel FROM sig),
h AS (SELECT channel, 0 AS i, 2166136261::BIGINT AS x FROM ch
      UNION ALL SELECT channel, i + 1, (xor(x, ascii(channel[i + 1])::BIGINT)::HUGEINT * 16777619 % 4294967296)::BIGINT FROM h WHERE i < length(channel)),
s AS (SELECT channel, (round((3 + 12 * (x / 4294967296.0::DOUBLE)) * 1440) * 60000)::BIGINT AS shift_ms FROM h WHERE i = length(channel))
SELECT seq, sig.channel, ts_ms - shift_ms AS ts_ms, shift_ms FROM sig JOIN s ON sig.channel = s.channel""")
def _placebo(spark, sf_dir):
    return placebo_shift(signals(spark, sf_dir)).select("seq", "channel", "ts_ms", "shift_ms")


@query("candle_alignment", f"""WITH {SIGNALS_SQL} SELECT seq, ts_ms - ts_ms % 60000 AS minute, ts_ms - ts_ms % 900000 AS quarter,
    ts_ms - ts_ms % 60000 + CASE WHEN ts_ms % 60000 = 0 THEN 0 ELSE 60000 END AS entry_minute, ts_ms - ts_ms % 86400000 + CASE WHEN ts_ms % 86400000 = 0 THEN 0 ELSE 86400000 END AS entry_day FROM sig""")
def _alignment(spark, sf_dir):
    ts = F.col("ts_ms")
    return signals(spark, sf_dir).select(
        "seq", candle_source.align(ts, "1m").alias("minute"), candle_source.align(ts, "15m").alias("quarter"),
        candle_source.entry_start(ts, "1m").alias("entry_minute"), candle_source.entry_start(ts, "1d").alias("entry_day"),
    )
