"""Scoring detector and exit configurations, choosing one, and the pooled exits of symbols and channels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import first_by
from ..plans.registry import query
from ..sources.signals import signals
from .replay import HOUR, LABELS_SQL, QUERY_AXES, exit_grid, query_labels
from .stats import exit_proposals, moments, pnl_stats, shrunk, time_folds, win_rate

FOLDS, SHRINK_K = 4, 5.0
AGGRESSION = {"ignore": 0, "none": 0, "tighten": 1, "veto": 2, "invert": 3}
TRIAGE_N, TRIAGE_T = 10, 2.0


def configurations(labels: DataFrame, min_clusters: list[int], gates: list[float | None]) -> DataFrame:
    """Labels once for each detector setting they pass: enough authors, and momentum in the trade's direction.

    A missing gate passes all; a missing momentum passes no gate. Labels are computed once, before any gate.
    """
    spark = labels.sparkSession
    axes = F.broadcast(spark.createDataFrame([(c, g) for c in min_clusters for g in gates], "min_clusters int, gate double"))  # the grid's axes
    directed = F.when(F.col("direction") == "long", F.col("momentum")).otherwise(-F.col("momentum"))
    return labels.join(axes, (F.col("independent_clusters") >= F.col("min_clusters")) & (F.col("gate").isNull() | F.coalesce(directed >= F.col("gate"), F.lit(False))))


def fold_scores(configured: DataFrame, keys: list[str], folds: int = FOLDS, embargo_ms: str | int = "embargo_ms") -> DataFrame:
    """Per configuration, exit and validation fold: shrunk mean, mean, win rate, size."""
    rows = time_folds(configured, keys, folds, embargo_ms)
    return rows.groupBy(*keys, "fold").agg(shrunk("pnl", SHRINK_K).alias("score"), F.avg("pnl").alias("mean"), win_rate("pnl").alias("wins"), F.count("*").alias("size"))


def board(configured: DataFrame, keys: list[str], folds: int = FOLDS, embargo_ms: str | int = "embargo_ms") -> DataFrame:
    """One row per configuration and exit: cross-validated score, win rate, support, Sharpe ratio of validated trades."""
    rows = time_folds(configured, keys, folds, embargo_ms)
    scored = rows.groupBy(*keys, "fold").agg(shrunk("pnl", SHRINK_K).alias("score"), win_rate("pnl").alias("wins"), F.count("*").alias("size"))
    summary = scored.groupBy(*keys).agg(
        F.round(F.avg("score"), 6).alias("cv_score"), F.round(F.avg("wins"), 6).alias("cv_winrate"), F.round(F.avg("size"), 2).alias("cv_support"),
        F.coalesce(F.stddev_samp("score") / F.sqrt(F.count("*")), F.lit(0.0)).alias("se"),
    )
    ratios = moments(rows, keys, "pnl").select(*keys, F.col("n"), "sharpe")
    return summary.join(ratios, keys)


def aggression(policy: str = "squeeze_policy") -> Column:
    whens = F.lit(0)
    for name, value in AGGRESSION.items():
        whens = F.when(F.col(policy) == name, value).otherwise(whens)
    return whens


def one_standard_error(scored: DataFrame, order: list[Column | str], multiplier: float = 1.0) -> DataFrame:
    """The most conservative entry within a standard error of the best: tight stop, short life, mild policy, then score.

    scored: cv_score, se and the exit's parameters; ``order`` settles ties like the order of insertion.
    """
    top = F.max_by(F.struct("cv_score", "se"), F.struct("cv_score", *[-F.col(c) for c in order if isinstance(c, str)])).alias("top")
    limit = scored.agg(top).select((F.col("top.cv_score") - multiplier * F.col("top.se")).alias("limit"))
    corridor = scored.crossJoin(F.broadcast(limit)).where(F.col("cv_score") >= F.col("limit"))  # limit is one row
    return corridor.orderBy("hard_stop", "stale", aggression(), F.desc("cv_score"), *order).limit(1).drop("limit")


def exit_scores(labels: DataFrame, keys: list[str], folds: int = FOLDS) -> DataFrame:
    """Mean fold score and count of each exit within each group."""
    group = [*keys, "exit_id"]
    counts = labels.groupBy(*group).agg(F.count("*").alias("n"))
    scores = fold_scores(labels, group, folds).groupBy(*group).agg(F.avg("score").alias("score"))
    return counts.join(scores, group, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def pooled(child: DataFrame, parent: DataFrame, keys: list[str], parent_keys: list[str], k: float) -> DataFrame:
    """Child scores pulled to the parent's by k trades; a child that lacks one of the parent's exits takes its score."""
    groups = child.select(*keys).distinct()
    base = groups.join(parent.select(*parent_keys, "exit_id", F.col("score").alias("above")), parent_keys) if parent_keys else groups.crossJoin(F.broadcast(parent.select("exit_id", F.col("score").alias("above"))))
    both = base.join(child, [*keys, "exit_id"], "left")
    n = F.coalesce("n", F.lit(0))
    return both.select(*keys, "exit_id", n.alias("n"), ((n * F.coalesce("score", F.lit(0.0)) + k * F.col("above")) / (n + k)).alias("score"))


def exit_tensor(labels: DataFrame, k: float, folds: int = FOLDS) -> DataFrame:
    """(level, channel, symbol, direction, regime, exit_id): the best exit overall, per symbol and side, and per cell.

    Scores of a finer level are pooled with those of the level above; the first exit wins ties. Scores are compared to
    twelve places, as the order of a sum decides the last ones.
    """
    even = F.round("score", 12)
    best = lambda df, keys: first_by(df, keys, even.desc(), "exit_id") if keys else df.orderBy(even.desc(), "exit_id").limit(1)
    world = exit_scores(labels.withColumn("_all", F.lit(0)), ["_all"], folds).drop("_all")
    side = ["symbol", "direction"]
    sides = pooled(exit_scores(labels, side, folds), world, side, [], k).persist()
    cell = ["channel", *side, "vol_regime"]
    cells = pooled(exit_scores(labels, cell, folds), sides, cell, side, k)
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    return (
        best(world, []).select(F.lit("global").alias("level"), *none("channel", "symbol", "direction", "vol_regime"), "exit_id")
        .union(best(sides, side).select(F.lit("symbol-dir"), F.lit(None).cast("string"), *side, F.lit(None).cast("string"), "exit_id"))
        .union(best(cells, cell).select(F.lit("cell"), *cell, "exit_id"))
    )


def resolve_exit(asks: DataFrame, tensor: DataFrame, with_regime: bool = True) -> DataFrame:
    """Adds exit_id and exit_source: the finest level of the tensor that knows the ask."""
    out, side, cell = asks, ["symbol", "direction"], ["channel", "symbol", "direction", "vol_regime"]
    if with_regime:
        out = out.join(tensor.where(F.col("level") == "cell").select(*cell, F.col("exit_id").alias("_cell")), cell, "left")
    else:
        out = out.withColumn("_cell", F.lit(None).cast("int"))
    out = out.join(tensor.where(F.col("level") == "symbol-dir").select(*side, F.col("exit_id").alias("_side")), side, "left")
    out = out.crossJoin(F.broadcast(tensor.where(F.col("level") == "global").select(F.col("exit_id").alias("_world"))))
    source = F.when(F.col("_cell").isNotNull(), "cell").when(F.col("_side").isNotNull(), "symbol-dir").otherwise("mode")
    return out.withColumn("exit_id", F.coalesce("_cell", "_side", "_world")).withColumn("exit_source", source).drop("_cell", "_side", "_world")


def channel_scores(history: DataFrame, k: float) -> DataFrame:
    """Per channel, over its entered trades: shrunk mean, median, count, win rate with one win and one loss added."""
    return history.where("entered").groupBy("channel").agg(
        F.round(shrunk("pnl", k), 6).alias("score"), F.round(F.percentile("pnl", 0.5), 6).alias("median"), F.count("*").alias("n"),
        F.round((F.sum((F.col("pnl") > 0).cast("long")) + 1) / (F.count("*") + 2), 6).alias("win_rate"),
    )


def channel_triage(history: DataFrame, round_trip_cost_pct: float = 0.0) -> DataFrame:
    """Channels that lose significantly: invert where the opposite would win significantly after costs, else drop."""
    facts = history.where("entered").groupBy("channel").agg(F.count("*").alias("n"), F.avg("pnl").alias("mean"), (F.coalesce(F.stddev_samp("pnl"), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("se"))
    loses = (F.col("n") >= TRIAGE_N) & (F.col("mean") < 0) & ((F.col("se") < F.abs("mean") * 1e-9) | (F.abs("mean") / F.col("se") >= TRIAGE_T))
    inverse = -F.col("mean") - 2 * round_trip_cost_pct / 100
    wins = (inverse > 0) & ((F.col("se") < inverse * 1e-9) | (inverse / F.col("se") >= TRIAGE_T))
    return facts.where(loses).select("channel", F.when(wins, "invert").otherwise("drop").alias("plan"))


def query_history(spark, sf_dir) -> DataFrame:
    """Labels of the queries with the source row's channel and time, and a spread of author counts."""
    labels = query_labels(spark, sf_dir).where(~F.col("truncated"))
    rows = labels.join(signals(spark, sf_dir).select(F.col("seq").alias("burst_id"), "channel", "ts_ms"), "burst_id")
    lives = exit_grid(spark, QUERY_AXES).select("exit_id", (F.col("stale") * HOUR).cast("long").alias("embargo_ms"))
    return rows.join(F.broadcast(lives), "exit_id").withColumn("independent_clusters", (1 + F.col("burst_id") % 3).cast("int")).withColumn("momentum", F.lit(None).cast("double"))


HISTORY_SQL = LABELS_SQL + """, hi AS MATERIALIZED (SELECT lab.*, s.channel, s.ts_ms, xg.st * 3600000::BIGINT AS emb, xg.hs, xg.st, xg.po, (1 + lab.burst_id % 3)::INT AS ic
  FROM lab JOIN sig s ON s.seq = lab.burst_id JOIN xg ON xg.exit_id = lab.exit_id WHERE NOT truncated)"""


def _folds_sql(source: str, keys: str) -> str:
    """Validation rows vr of the source: with four folds, each start follows from the ends before it."""
    return f"""ti AS (SELECT *, least((row_number() OVER (PARTITION BY {keys} ORDER BY ts_ms, burst_id) - 1) // greatest(count(*) OVER (PARTITION BY {keys}) // 5, 1), 4)::INT AS fold FROM {source}),
 fe AS (SELECT {keys}, max(ts_ms) FILTER (fold = 1) AS e1, max(ts_ms) FILTER (fold = 2) AS e2, max(ts_ms) FILTER (fold = 3) AS e3, max(emb) AS em FROM ti WHERE fold >= 1 GROUP BY {keys}),
 f2 AS (SELECT *, CASE WHEN e2 >= coalesce(e1 + em, e2) THEN e2 ELSE e1 END AS p2 FROM fe), f3 AS (SELECT *, CASE WHEN e3 >= coalesce(p2 + em, e3) THEN e3 ELSE p2 END AS p3 FROM f2),
 vr AS MATERIALIZED (SELECT ti.* FROM ti JOIN f3 USING ({keys}) WHERE fold >= 1 AND (fold = 1 OR ts_ms >= coalesce(CASE fold WHEN 2 THEN e1 WHEN 3 THEN p2 ELSE p3 END + em, ts_ms)))"""


_CONFIG_SQL = HISTORY_SQL + ", cf AS (SELECT hi.*, mc AS min_clusters FROM hi, (VALUES (1), (2), (3)) t(mc) WHERE ic >= mc), " + _folds_sql("cf", "min_clusters, exit_id")
_SCORE = "avg(pnl) * count(*) / (count(*) + 5.0::DOUBLE)"
_BOARD_SQL = _CONFIG_SQL + f""", fs AS (SELECT min_clusters, exit_id, fold, {_SCORE} AS score, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS wins, count(*) AS size FROM vr GROUP BY ALL),
 sh AS (SELECT min_clusters, exit_id, count(*) AS n, CASE WHEN coalesce(stddev_samp(pnl), 0) > max(abs(pnl)) * 1e-13 THEN avg(pnl) / stddev_samp(pnl) ELSE 0 END AS sharpe FROM vr GROUP BY ALL),
 bo AS MATERIALIZED (SELECT fs.min_clusters, fs.exit_id, round(avg(score), 6) AS cv_score, round(avg(wins), 6) AS cv_winrate, round(avg(size), 2) AS cv_support, coalesce(stddev_samp(score) / sqrt(count(*)), 0) AS se FROM fs GROUP BY ALL)"""
_KEYS = ["min_clusters", "exit_id"]


def _configured(spark, sf_dir):
    return configurations(query_history(spark, sf_dir), [1, 2, 3], [None])


@query("fold_scores", _CONFIG_SQL + f"SELECT min_clusters, exit_id, fold, round({_SCORE}, 6) AS score, round(avg(pnl), 6) AS mean, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS wins, count(*) AS size FROM vr GROUP BY ALL")
def _fold_scores(spark, sf_dir):
    return fold_scores(_configured(spark, sf_dir), _KEYS).withColumns({c: F.round(c, 6) for c in ("score", "mean", "wins")})


@query("board", _BOARD_SQL + "SELECT bo.min_clusters, bo.exit_id, cv_score, cv_winrate, cv_support, round(se, 6) AS se, n, round(sharpe, 6) AS sharpe FROM bo JOIN sh USING (min_clusters, exit_id)")
def _board(spark, sf_dir):
    return board(_configured(spark, sf_dir), _KEYS).withColumns({c: F.round(c, 6) for c in ("se", "sharpe")})


@query("one_se_winner", _BOARD_SQL + """, tp AS (SELECT cv_score - se AS lim FROM bo ORDER BY cv_score DESC, min_clusters, exit_id LIMIT 1)
 SELECT min_clusters, bo.exit_id, cv_score, hs AS hard_stop, st AS stale, po AS squeeze_policy FROM bo JOIN xg ON bo.exit_id = xg.exit_id, tp WHERE cv_score >= lim
 ORDER BY hs, st, CASE po WHEN 'tighten' THEN 1 WHEN 'veto' THEN 2 WHEN 'invert' THEN 3 ELSE 0 END, cv_score DESC, min_clusters, bo.exit_id LIMIT 1""")
def _winner(spark, sf_dir):
    scored = board(_configured(spark, sf_dir), _KEYS).join(exit_grid(spark, QUERY_AXES).select("exit_id", "hard_stop", "stale", "squeeze_policy"), "exit_id")
    return one_standard_error(scored, _KEYS).select(*_KEYS, "cv_score", "hard_stop", "stale", "squeeze_policy")


_SIDE_SQL = HISTORY_SQL + ", " + _folds_sql("hi", "symbol, direction, exit_id") + f""", ss AS (SELECT symbol, direction, exit_id, avg(score) AS score FROM (SELECT symbol, direction, exit_id, fold, {_SCORE} AS score FROM vr GROUP BY ALL) GROUP BY ALL),
 sn AS (SELECT symbol, direction, exit_id, count(*) AS n FROM hi GROUP BY ALL)"""


@query("exit_scores", _SIDE_SQL + "SELECT sn.symbol, sn.direction, sn.exit_id, n, round(coalesce(score, 0), 6) AS score FROM sn LEFT JOIN ss ON sn.symbol = ss.symbol AND sn.direction = ss.direction AND sn.exit_id = ss.exit_id")
def _exit_scores(spark, sf_dir):
    return exit_scores(query_history(spark, sf_dir), ["symbol", "direction"]).withColumn("score", F.round("score", 6))


def _scores_sql(keys: str, tag: str) -> str:
    """Table sc<tag>: count and mean fold score of each exit within each group (keys) of hi."""
    folds = re.sub(r"\b(ti|fe|f2|f3|vr)\b", rf"\1{tag}", _folds_sql("hi", f"{keys}exit_id"))
    return f"""{folds}, ss{tag} AS (SELECT {keys}exit_id, avg(score) AS score FROM (SELECT {keys}exit_id, fold, {_SCORE} AS score FROM vr{tag} GROUP BY ALL) GROUP BY ALL),
 sc{tag} AS (SELECT n.*, coalesce(score, 0) AS score FROM (SELECT {keys}exit_id, count(*) AS n FROM hi GROUP BY ALL) n LEFT JOIN ss{tag} USING ({keys}exit_id))"""


def _pooled_sql(tag: str, keys: str, above: str, joined: str) -> str:
    return f"""po{tag} AS (SELECT g.*, x.exit_id, (coalesce(c.n, 0) * coalesce(c.score, 0) + 20.0::DOUBLE * x.score) / (coalesce(c.n, 0) + 20) AS score
   FROM (SELECT DISTINCT {keys} FROM sc{tag}) g JOIN {above} x {joined} LEFT JOIN sc{tag} c ON {" AND ".join(f"c.{k.strip()} = g.{k.strip()}" for k in keys.split(","))} AND c.exit_id = x.exit_id)"""


_BEST_SQL = "arg_max(exit_id, (round(score, 12), -exit_id))"


@query("exit_tensor", f"""{HISTORY_SQL}, {_scores_sql("", "_w")}, {_scores_sql("symbol, direction, ", "_s")}, {_scores_sql("channel, symbol, direction, vol_regime, ", "_c")},
 {_pooled_sql("_s", "symbol, direction", "sc_w", "ON true")}, {_pooled_sql("_c", "channel, symbol, direction, vol_regime", "po_s", "ON x.symbol = g.symbol AND x.direction = g.direction")}
 SELECT 'global' AS level, NULL::VARCHAR AS channel, NULL::VARCHAR AS symbol, NULL::VARCHAR AS direction, NULL::VARCHAR AS vol_regime, {_BEST_SQL} AS exit_id FROM sc_w
 UNION ALL SELECT 'symbol-dir', NULL, symbol, direction, NULL, {_BEST_SQL} FROM po_s GROUP BY symbol, direction
 UNION ALL SELECT 'cell', channel, symbol, direction, vol_regime, {_BEST_SQL} FROM po_c GROUP BY channel, symbol, direction, vol_regime""")
def _exit_tensor(spark, sf_dir):
    return exit_tensor(query_history(spark, sf_dir).persist(), 20.0)


@query("channel_score", HISTORY_SQL + "SELECT channel, round(avg(pnl) * count(*) / (count(*) + 5.0::DOUBLE), 6) AS score, round(median(pnl), 6) AS median, count(*) AS n, round((count(*) FILTER (pnl > 0) + 1) / (count(*) + 2)::DOUBLE, 6) AS win_rate FROM hi WHERE entered AND exit_id = 0 GROUP BY channel")
def _channel_score(spark, sf_dir):
    return channel_scores(query_history(spark, sf_dir).where(F.col("exit_id") == 0), SHRINK_K)


@query("channel_triage", HISTORY_SQL + """, f AS (SELECT channel, count(*) AS n, avg(least(pnl, 0.5)) AS m, coalesce(stddev_samp(least(pnl, 0.5)), 0) / sqrt(count(*)) AS se FROM hi WHERE entered AND exit_id = 3 GROUP BY channel)
 SELECT channel, CASE WHEN -m - 0.24 > 0 AND (se < (-m - 0.24) * 1e-9 OR (-m - 0.24) / se >= 2) THEN 'invert' ELSE 'drop' END AS plan FROM f WHERE n >= 10 AND m < 0 AND (se < abs(m) * 1e-9 OR abs(m) / se >= 2)""")
def _triage(spark, sf_dir):
    # Gains above one half are capped and costs are high, so that channels of this feed lose at all.
    rows = query_history(spark, sf_dir).where(F.col("exit_id") == 3).withColumn("pnl", F.least("pnl", F.lit(0.5)))
    return channel_triage(rows, 12.0)


@query("exit_proposals", HISTORY_SQL + """, w AS (SELECT nullif(abs(least(trough, 0)) * 100, 0) AS mae, nullif(greatest(peak - pnl, 0) * 100, 0) AS give FROM hi WHERE entered AND pnl > 0)
 SELECT count(*) AS winners, round(quantile_cont(mae, 0.9), 4) AS s90, round(quantile_cont(mae, 0.95), 4) AS s95, round(quantile_cont(give, 0.75), 4) AS t75, round(quantile_cont(give, 0.9), 4) AS t90 FROM w""")
def _proposals(spark, sf_dir):
    return exit_proposals(query_history(spark, sf_dir))


@query("symbol_pnl", HISTORY_SQL + f"SELECT symbol, direction, round(avg(pnl), 6) AS mean, {', '.join(f'round(quantile_cont(pnl, {p}), 6) AS {n}' for n, p in (('median', 0.5), ('p5', 0.05), ('p95', 0.95), ('p99', 0.99)))}, count(pnl) AS n FROM hi WHERE entered AND exit_id = 1 GROUP BY symbol, direction")
def _symbol_pnl(spark, sf_dir):
    return pnl_stats(query_history(spark, sf_dir).where(F.col("entered") & (F.col("exit_id") == 1)), ["symbol", "direction"], "pnl")
