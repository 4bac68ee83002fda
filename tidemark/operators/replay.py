"""Path replay: what a trade on each burst would have earned under each exit rule.

The sequential walk over a path is stated as first triggers. Along a path, only the running best, the running worst
and the place of the best so far matter, and they don't depend on the exit rule; so they are computed once per burst and
direction (paths.py), with the first trigger of each value of an axis (stop, trail, staleness, life). Each rule's exit is
the least (step, priority) among those of its values.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import first_by
from ..plans.registry import query
from ..sources.candles import CANDLES_SQL, hourly
from ..sources.signals import signals
from .events import _ANCHORS, POST_WINDOW_MS, collapse_posts
from .paths import KINDS, STEP, first_triggers

HOUR = 3_600_000
EXIT_SCHEMA = (
    "trailing_take double, hard_stop double, stale_profit double, stale_since int, stale int, vol_baseline int, vol_z_threshold double, squeeze_policy string, "
    "squeeze_threshold double, tighten_factor double, cascade_window int, round_trip_cost double, slippage double"
)
EXIT_DEFAULTS = {"vol_baseline": 20, "vol_z_threshold": 2.0, "squeeze_policy": "none", "squeeze_threshold": 0.6, "tighten_factor": 0.5, "cascade_window": None, "round_trip_cost": 0.0, "slippage": 0.0}
TRUNCATED_BELOW = 0.95
EXIT_COLUMNS = [c.split()[0] for c in EXIT_SCHEMA.split(", ")]


def exit_grid(spark: SparkSession, axes: Mapping[str, Iterable]) -> DataFrame:
    """Every combination of the axes, in order, with defaults for the others: exit_id and the parameters."""
    names = list(axes)
    rows = []
    for i, values in enumerate(product(*axes.values())):
        one = EXIT_DEFAULTS | dict(zip(names, values))
        rows.append((i, *(one[c] for c in EXIT_COLUMNS)))
    return spark.createDataFrame(rows, f"exit_id int, {EXIT_SCHEMA}")


def exit_key(columns: list[str] = EXIT_COLUMNS) -> Column:
    """Canonical text of a rule's parameters."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])


def distinct_by_pnl(exits: DataFrame) -> DataFrame:
    """One exit per result: axes that can't change it are set aside, the first of each group stays.

    Volume regime axes never change it; the squeeze axes only with a policy that acts on pressure.
    """
    acts = F.col("squeeze_policy").isin("veto", "invert", "tighten")
    same = ["trailing_take", "hard_stop", "stale_profit", "stale_since", "stale", "round_trip_cost", "slippage"]
    reduced = exits.withColumns({
        "_policy": F.when(acts, F.col("squeeze_policy")).otherwise("none"), "_threshold": F.when(acts, F.col("squeeze_threshold")),
        "_window": F.when(acts, F.coalesce("cascade_window", "stale")), "_factor": F.when(F.col("squeeze_policy") == "tighten", F.col("tighten_factor")),
    })
    keys = [*same, "_policy", "_threshold", "_window", "_factor"]
    return first_by(reduced, keys, "exit_id").select(exits.columns)


def replay(bursts: DataFrame, candles: DataFrame, exits: DataFrame, interval_ms: int = 60_000) -> DataFrame:
    """One row per burst with candles and exit rule.

    bursts: burst_id, symbol, direction, ts_ms, entry_from, entry_to. Bursts without a candle ahead have no row; a path
    that never touches the zone has reason no-entry. exits is a grid of bounded size: its axes become aggregates over
    each path, and its rules only pick among their results, so the product of paths and rules is never walked.
    """
    rules = [r.asDict() for r in exits.collect()]  # the grid
    axis = lambda values: {v: i for i, v in enumerate(sorted(set(values)))}
    tight = lambda r: r["trailing_take"] * r["tighten_factor"] / 100
    horizon = lambda r: r["stale"] if r["cascade_window"] is None else r["cascade_window"]
    stops, lives = axis(r["hard_stop"] for r in rules), axis(r["stale"] for r in rules)
    trails = axis([r["trailing_take"] / 100 for r in rules] + [tight(r) for r in rules if r["squeeze_policy"] == "tighten"])
    stales = axis((r["stale_profit"], r["stale_since"]) for r in rules)
    horizons, baselines = axis(horizon(r) for r in rules), axis(r["vol_baseline"] for r in rules)
    places = [(r["exit_id"], stops[r["hard_stop"]], trails[r["trailing_take"] / 100], trails.get(tight(r), 0) if r["squeeze_policy"] == "tighten" else 0, stales[r["stale_profit"], r["stale_since"]], lives[r["stale"]], horizons[horizon(r)], baselines[r["vol_baseline"]]) for r in rules]
    spark = bursts.sparkSession
    grid = F.broadcast(exits.join(F.broadcast(spark.createDataFrame(places, "exit_id int, _stop int, _trail int, _tight int, _stale int, _life int, _horizon int, _baseline int")), "exit_id"))
    axes = {"stops": list(stops), "trails": list(trails), "stales": list(stales), "lives": list(lives), "horizons": list(horizons), "baselines": list(baselines)}
    plan = first_triggers(bursts, candles, axes, interval_ms, 2 * max(lives) + 5).crossJoin(grid)  # every burst meets every rule
    plan = plan.withColumns({"squeeze_pressure": F.get("_pressures", F.col("_horizon")), "vol_z": F.get("_zs", F.col("_baseline"))})
    hot = F.col("squeeze_pressure") >= F.col("squeeze_threshold")
    is_in = F.col("entry_i").isNotNull()
    flip = is_in & hot & (F.col("squeeze_policy") == "invert")
    opposite = F.when(F.col("direction") == "long", "short").otherwise("long")
    plan = plan.withColumns({
        "veto": is_in & hot & (F.col("squeeze_policy") == "veto"), "inverted": flip, "side": F.when(flip, opposite).otherwise(F.col("direction")),
        "_take": F.when(hot & (F.col("squeeze_policy") == "tighten"), F.col("_tight")).otherwise(F.col("_trail")), "stop": F.col("hard_stop") / 100, "avail": F.col("n_bars") - F.col("entry_i") - 1,
    })

    def trigger(kind: str, place: str, rule: int) -> Column:
        hit = F.get(F.when(F.col("side") == "long", F.col(f"{kind}_long")).otherwise(F.col(f"{kind}_short")), F.col(place))
        return F.when(hit.isNotNull(), F.struct(F.get(hit, F.lit(0)).cast("int").alias("k"), F.lit(rule).alias("rule"), hit.alias("at")))

    found = [trigger(kind, place, rule) for rule, (kind, place) in enumerate(zip(KINDS, ("_stop", "_take", "_stale", "_life")))]
    # The life's last step is always there, so no later trigger is the least.
    plan = plan.withColumn("out", F.when(is_in & ~F.col("veto"), F.least(*found)))
    in_trade = F.col("out").isNotNull()
    at = lambda field: F.get(F.col("out.at"), F.lit(STEP.index(field)))
    stopped = F.col("out.rule") == 0
    gross = F.when(stopped, -F.col("stop")).otherwise(at("close_pnl"))
    cost = F.col("round_trip_cost") / 100 + F.col("slippage") * (F.col("entry_range") + at("bar_range")) / F.col("entry_price")
    at_side = F.when(F.col("side") == "long", F.col("entry_price") * (1 + gross)).otherwise(F.col("entry_price") * (1 - gross))
    names = F.array(*[F.lit(x) for x in ("hard-stop", "trailing-take", "peak-staleness", "life-cap")])
    zero = lambda c: F.coalesce(F.when(in_trade, c), F.lit(0.0))
    return plan.select(
        "burst_id", "exit_id", "symbol", "direction", in_trade.alias("entered"), zero(gross - cost).alias("pnl"), zero(gross).alias("gross_pnl"),
        zero(F.when(stopped, at("peak_before")).otherwise(at("peak"))).alias("peak"), zero(F.when(stopped, -F.col("stop")).otherwise(at("trough"))).alias("trough"),
        F.when(in_trade, F.element_at(names, F.col("out.rule") + 1)).when(F.col("veto"), "cascade-veto").otherwise("no-entry").alias("reason"),
        F.coalesce("out.k", F.lit(0)).alias("held"), F.coalesce("entry_price", F.lit(0.0)).alias("entry_price"), zero(F.when(F.col("out.rule").isin(0, 3), at_side).otherwise(at("close"))).alias("exit_price"),
        F.when(is_in, F.col("vol_z")).otherwise(0.0).alias("vol_z"), F.when(is_in, F.col("squeeze_pressure")).otherwise(0.0).alias("squeeze_pressure"),
        F.when(is_in & (F.col("vol_z") >= F.col("vol_z_threshold")), "anomalous").otherwise("calm").alias("vol_regime"),
        (F.col("inverted") & in_trade).alias("inverted"), (in_trade & (F.col("avail") < F.col("stale") * TRUNCATED_BELOW)).alias("truncated"),
    )


def label_outcomes(labels: DataFrame, bursts: DataFrame) -> DataFrame:
    """Per burst: ok, no-entry or no-candles, and how many labels are left once truncated trades are dropped."""
    per = labels.groupBy("burst_id").agg(F.max(F.col("entered").cast("int")).alias("any"), F.sum((~F.col("truncated")).cast("long")).alias("n_labels"))
    return bursts.select("burst_id").join(per, "burst_id", "left").select(
        "burst_id", F.when(F.col("any").isNull(), "no-candles").when(F.col("any") == 0, "no-entry").otherwise("ok").alias("outcome"), F.coalesce("n_labels", F.lit(0)).alias("n_labels")
    )


#: Axes of the queries, in hourly bars.
QUERY_AXES = {
    "trailing_take": [20.0, 60.0], "hard_stop": [50.0, 80.0], "stale_profit": [30.0], "stale_since": [4], "stale": [12, 24],
    "squeeze_policy": ["none", "tighten", "veto", "invert"], "squeeze_threshold": [0.55], "cascade_window": [3], "round_trip_cost": [0.1], "slippage": [0.01],
}
_COMBOS = [(i, *c) for i, c in enumerate(product(*QUERY_AXES.values()))]
_GRID_SQL = "xg AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {tt}::DOUBLE, {hs}::DOUBLE, {sp}::DOUBLE, {ss}, {st}, '{po}', {th}::DOUBLE, {cw}, {rc}::DOUBLE, {sl}::DOUBLE)" for i, tt, hs, sp, ss, st, po, th, cw, rc, sl in _COMBOS) + ") t(exit_id, tt, hs, sp, ss, st, po, th, cw, rc, sl))"


def query_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = collapse_posts(signals(spark, sf_dir), POST_WINDOW_MS).withColumnRenamed("seq", "burst_id")
    return replay(posts, hourly(spark, sf_dir), exit_grid(spark, QUERY_AXES), HOUR)


FROM_POSTS_SQL = f""", {CANDLES_SQL}, {_GRID_SQL},
 bu AS (SELECT p.seq AS burst_id, p.symbol, p.direction, s.entry_from, s.entry_to, p.ts_ms + (3600000 - p.ts_ms % 3600000) % 3600000 AS start_ms FROM p JOIN sig s ON s.seq = p.seq),
 pa AS (SELECT bu.*, b.ts_ms AS bar, open, high, low, close, volume, row_number() OVER (PARTITION BY burst_id ORDER BY b.ts_ms) - 1 AS i, count(*) OVER (PARTITION BY burst_id) AS nb
        FROM bu JOIN bars b ON b.symbol = bu.symbol AND b.ts_ms BETWEEN start_ms AND start_ms + 52 * 3600000::BIGINT),
 fo AS (SELECT burst_id, arg_min(open, i) AS o FROM pa GROUP BY burst_id),
 zo AS (SELECT pa.*, least(coalesce(entry_from, o), coalesce(entry_to, o)) AS lo, greatest(coalesce(entry_from, o), coalesce(entry_to, o)) AS hi FROM pa JOIN fo USING (burst_id)),
 en AS (SELECT burst_id, min(i) AS ei FROM zo WHERE low <= hi AND high >= lo GROUP BY burst_id),
 ep AS (SELECT zo.burst_id, ei, CASE WHEN close BETWEEN lo AND hi THEN close ELSE least(greatest((lo + hi) / 2, low), high) END AS e, high - low AS er FROM zo JOIN en ON zo.burst_id = en.burst_id AND zo.i = en.ei),
 wh AS (SELECT zo.burst_id, zo.symbol, zo.direction, zo.nb, ei, e, er FROM zo LEFT JOIN ep USING (burst_id) WHERE i = 0),
 pz AS (SELECT zo.burst_id, CASE WHEN sum(volume) > 0 THEN sum(CASE WHEN (direction = 'long' AND close < open) OR (direction = 'short' AND close > open) THEN volume ELSE 0 END) / sum(volume) ELSE 0 END AS pr
        FROM zo JOIN ep USING (burst_id) WHERE i > ei AND i <= ei + 3 GROUP BY zo.burst_id),
 vz AS (SELECT zo.burst_id, CASE WHEN count(*) FILTER (i < ei) >= 2 AND stddev_samp(volume) FILTER (i < ei) > 0 THEN (max(volume) FILTER (i = ei) - avg(volume) FILTER (i < ei)) / stddev_samp(volume) FILTER (i < ei) ELSE 0 END AS z
        FROM zo JOIN ep USING (burst_id) WHERE i BETWEEN ei - 20 AND ei GROUP BY zo.burst_id),
 sd AS (SELECT 'long' AS side UNION ALL SELECT 'short'),
 s1 AS (SELECT zo.burst_id, side, i - ei AS k, close, high - low AS br, e,
          CASE WHEN side = 'long' THEN (low - e) / e ELSE (e - low) / e END AS pl, CASE WHEN side = 'long' THEN (high - e) / e ELSE (e - high) / e END AS ph,
          CASE WHEN side = 'long' THEN (close - e) / e ELSE (e - close) / e END AS cp FROM zo JOIN ep USING (burst_id), sd WHERE i >= ei),
 s2 AS (SELECT *, least(pl, ph) AS worst, greatest(max(greatest(pl, ph)) OVER w, 0) AS peak, greatest(coalesce(max(greatest(pl, ph)) OVER b, 0), 0) AS pb, least(min(least(pl, ph)) OVER w, 0) AS trough
        FROM s1 WINDOW w AS (PARTITION BY burst_id, side ORDER BY k ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY burst_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s3 AS MATERIALIZED (SELECT *, coalesce(max(CASE WHEN greatest(pl, ph) > pb THEN k END) OVER (PARTITION BY burst_id, side ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS pk FROM s2),
 pn AS MATERIALIZED (SELECT wh.*, xg.*, coalesce(pr, 0) AS pr, coalesce(z, 0) AS z, coalesce(pr, 0) >= th AND ei IS NOT NULL AS hot FROM wh CROSS JOIN xg LEFT JOIN pz ON pz.burst_id = wh.burst_id LEFT JOIN vz ON vz.burst_id = wh.burst_id),
 pm AS MATERIALIZED (SELECT *, hot AND po = 'veto' AS veto, hot AND po = 'invert' AS inv, CASE WHEN hot AND po = 'invert' THEN CASE WHEN direction = 'long' THEN 'short' ELSE 'long' END ELSE direction END AS side,
          tt * CASE WHEN hot AND po = 'tighten' THEN 0.5 ELSE 1 END / 100 AS trail, nb - ei - 1 AS avail FROM pn),
 tr AS (SELECT pm.burst_id, exit_id, pm.side, s3.k, s3.e, er, br, rc, sl, hs, close, cp, peak, pb, trough,
          CASE WHEN worst <= -hs / 100 THEN 0 WHEN cp >= 0 AND peak > 0 AND peak - cp >= trail THEN 1 WHEN peak >= sp / 100 AND k - pk >= ss THEN 2 WHEN k = least(st, avail) THEN 3 END AS rule
        FROM pm JOIN s3 ON pm.burst_id = s3.burst_id AND pm.side = s3.side AND k <= least(st, avail) WHERE NOT veto),
 ou AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY burst_id, exit_id ORDER BY k) AS rn FROM tr WHERE rule IS NOT NULL) WHERE rn = 1),
 og AS (SELECT *, CASE WHEN rule = 0 THEN -hs / 100 ELSE cp END AS gross FROM ou),
 lab AS MATERIALIZED (SELECT pm.burst_id, pm.exit_id, pm.symbol, pm.direction, og.burst_id IS NOT NULL AS entered,
   coalesce(gross - (og.rc / 100 + og.sl * (og.er + br) / og.e), 0) AS pnl, coalesce(gross, 0) AS gross_pnl, coalesce(CASE WHEN rule = 0 THEN pb ELSE peak END, 0) AS peak,
   coalesce(CASE WHEN rule = 0 THEN -og.hs / 100 ELSE trough END, 0) AS trough,
   CASE WHEN og.burst_id IS NOT NULL THEN ['hard-stop', 'trailing-take', 'peak-staleness', 'life-cap'][rule + 1] WHEN veto THEN 'cascade-veto' ELSE 'no-entry' END AS reason,
   coalesce(og.k, 0) AS held, coalesce(pm.e, 0) AS entry_price,
   coalesce(CASE WHEN rule IN (0, 3) THEN og.e * (1 + CASE WHEN og.side = 'long' THEN gross ELSE -gross END) ELSE close END, 0) AS exit_price,
   CASE WHEN ei IS NULL THEN 0 ELSE z END AS vol_z, CASE WHEN ei IS NULL THEN 0 ELSE pr END AS squeeze_pressure, CASE WHEN ei IS NOT NULL AND z >= 2 THEN 'anomalous' ELSE 'calm' END AS vol_regime,
   inv AND og.burst_id IS NOT NULL AS inverted, og.burst_id IS NOT NULL AND avail < st * 0.95 AS truncated
 FROM pm LEFT JOIN og ON pm.burst_id = og.burst_id AND pm.exit_id = og.exit_id)
"""
LABELS_SQL = _ANCHORS + FROM_POSTS_SQL


def market_stops(candles: DataFrame) -> list[float]:
    """A stop for each symbol, in order: the mean range of its candles, rounded; equal ones once."""
    ranges = candles.groupBy("symbol").agg(F.round(F.avg(F.col("high") - F.col("low")), 2).alias("w"))
    return [r["w"] for r in ranges.select("w").distinct().orderBy("w").collect()]  # a value for each symbol at most


_STOPS_SQL = f"{CANDLES_SQL}, hs AS (SELECT DISTINCT round(avg(high - low), 2) AS hs FROM bars GROUP BY symbol)"
_POLICIES = ["none", "ignore", "tighten", "veto", "invert"]


def _values_sql(name: str, values: list) -> str:
    rows = ", ".join(f"({i}, {'NULL' if v is None else repr(v)})" for i, v in enumerate(values))
    return f"(VALUES {rows}) {name}({name}_i, {name})"


def _order_sql(*names: str) -> str:
    return f"(row_number() OVER (ORDER BY {', '.join(names)}) - 1)::INT AS exit_id"


@query("exit_grid", f"""WITH {_STOPS_SQL}
  SELECT {_order_sql("tt_i", "hs", "st_i", "po_i")}, tt::DOUBLE AS trailing_take, hs::DOUBLE AS hard_stop, st AS stale, po AS squeeze_policy
  FROM {_values_sql("tt", [20.0, 60.0])}, hs, {_values_sql("st", [12, 24])}, {_values_sql("po", _POLICIES)}""")
def _exit_grid(spark, sf_dir):
    axes = {"trailing_take": [20.0, 60.0], "hard_stop": market_stops(hourly(spark, sf_dir)), "stale": [12, 24], "squeeze_policy": _POLICIES, "stale_profit": [1.0], "stale_since": [60]}
    return exit_grid(spark, axes).select("exit_id", "trailing_take", "hard_stop", "stale", "squeeze_policy")


_DEDUP_AXES = {"squeeze_policy": _POLICIES, "vol_z_threshold": [1.5, 2.5], "squeeze_threshold": [0.55, 0.7], "tighten_factor": [0.25, 0.5], "cascade_window": [15, 60, None], "trailing_take": [1.0, 2.0]}
_DEDUP_SQL = {"squeeze_policy": "po", "vol_z_threshold": "z", "squeeze_threshold": "th", "tighten_factor": "tf", "cascade_window": "cw", "trailing_take": "tt"}


@query("exit_dedup", f"""WITH {_STOPS_SQL},
 g AS (SELECT {_order_sql(*[f"{n}_i" for n in _DEDUP_SQL.values()], "hs", "st_i")}, po, z, th, tf, cw, tt, hs, st, po IN ('tighten', 'veto', 'invert') AS acts
       FROM {", ".join(_values_sql(n, _DEDUP_AXES[c]) for c, n in _DEDUP_SQL.items())}, hs, {_values_sql("st", [60, 240])})
 SELECT min(exit_id)::INT AS exit_id, arg_min(po, exit_id) AS squeeze_policy, arg_min(z, exit_id)::DOUBLE AS vol_z_threshold, any_value(hs)::DOUBLE AS hard_stop FROM g
 GROUP BY tt, g.hs, st, CASE WHEN acts THEN po ELSE 'none' END, CASE WHEN acts THEN th END, CASE WHEN acts THEN coalesce(cw, st) END, CASE WHEN po = 'tighten' THEN tf END""")
def _exit_dedup(spark, sf_dir):
    axes = {**_DEDUP_AXES, "hard_stop": market_stops(hourly(spark, sf_dir)), "stale": [60, 240], "stale_profit": [1.0], "stale_since": [60]}
    return distinct_by_pnl(exit_grid(spark, axes)).select("exit_id", "squeeze_policy", "vol_z_threshold", "hard_stop")


_ROUNDED = ("pnl", "gross_pnl", "peak", "trough", "entry_price", "exit_price", "vol_z", "squeeze_pressure")


@query("replay_labels", LABELS_SQL + f"SELECT * EXCLUDE ({', '.join(_ROUNDED)}, held), held::INT AS held, {', '.join(f'round({c}, 9)::DOUBLE AS {c}' for c in _ROUNDED)} FROM lab")
def _replay_labels(spark, sf_dir):
    return query_labels(spark, sf_dir).withColumns({c: F.round(c, 9) for c in _ROUNDED})


@query("label_outcomes", LABELS_SQL + """, x AS (SELECT burst_id, max(entered::INT) AS a, count(*) FILTER (NOT truncated) AS n FROM lab GROUP BY burst_id)
SELECT p.seq AS burst_id, CASE WHEN a IS NULL THEN 'no-candles' WHEN a = 0 THEN 'no-entry' ELSE 'ok' END AS outcome, coalesce(n, 0) AS n_labels FROM p LEFT JOIN x ON p.seq = x.burst_id""")
def _label_outcomes(spark, sf_dir):
    posts = collapse_posts(signals(spark, sf_dir), POST_WINDOW_MS).withColumnRenamed("seq", "burst_id")
    return label_outcomes(query_labels(spark, sf_dir), posts)
