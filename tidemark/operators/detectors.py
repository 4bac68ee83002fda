"""Detector settings as rows: every setting's candidate bursts, labelled once, meet the board as one more key."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.candles import hourly
from ..sources.signals import signals
from . import bursts as burst_ops, graph
from .events import KEY, POST_WINDOW_MS, anchors_sql, channels_in_order, collapse_posts
from .replay import FROM_POSTS_SQL, HOUR, QUERY_AXES, exit_grid, replay
from .selection import _SCORE, _folds_sql, board

DAY = 86_400_000
#: Fixed default values of the axes.
DETECTOR_AXES = {"window_k": [2, 3, 5], "jaccard": [0.3, 0.4], "lag_peak": [0.4, 0.5], "stationarity_ms": [7 * DAY, 14 * DAY, 28 * DAY, 56 * DAY]}
#: What a member of a setting is, besides the setting's number.
BURST = ["burst_id", *KEY, "ts_ms", "channel", "entry_from", "entry_to"]


def settings(axes: dict[str, list], config: dict, mode: str) -> list[dict]:
    """The combinations of the axes, in order; axes that aren't given keep the configured value.

    Collapsed posts only depend on the window, so the axes of the author graph keep their first values there.
    """
    names = ["window_k", "jaccard", "lag_peak", "stationarity_ms"]
    values = [list(axes.get(n) or [config[n]]) for n in names]
    if mode == "single":
        values = [values[0], values[1][:1], values[2][:1], [float("inf")]]
    return [dict(zip(names, v)) for v in product(*values)]


def collapsed(events: DataFrame, windows: list[int]) -> DataFrame:
    """Members (setting and BURST) of settings that collapse posts within a window."""
    found = None
    for number, window in enumerate(windows):
        one = collapse_posts(events, window).select(F.lit(number).alias("setting"), F.col("seq").alias("burst_id"), *BURST[1:])
        found = one if found is None else found.union(one)
    return found.withColumns({"independent_clusters": F.lit(1).cast("long"), "confirm_span_ms": F.lit(None).cast("long")})


def correlated(events: DataFrame, chosen: list[dict], tau_ms: float, config: dict) -> DataFrame:
    """Members of settings that correlate channels.

    Settings of moving windows share one pass over the times; the others share the screen of a window and threshold, or
    the graph of the self-exciting process, which has neither.
    """
    channels = channels_in_order(events).persist()
    zones = events.select("seq", "entry_from", "entry_to")
    screens: dict[tuple, DataFrame] = {}
    member = lambda bursts, number: bursts.join(zones, "seq").select(number.cast("int").alias("setting"), F.col("seq").alias("burst_id"), *KEY, "ts_ms", F.lit("_matrix").alias("channel"), "entry_from", "entry_to", "independent_clusters", "confirm_span_ms")
    found = []
    moving = [k for k, s in enumerate(chosen) if s["stationarity_ms"] != float("inf")]
    if moving:
        bursts = burst_ops.enumerate_windowed(events, [chosen[k] for k in moving], config["max_burst_ms"], config["author_graph"])
        numbers = F.array(*[F.lit(k) for k in moving])
        found.append(member(bursts, F.get(numbers, F.col("setting"))))
    for number, s in enumerate(chosen):
        if number in moving:
            continue
        window = int(min(s["window_k"] * tau_ms, config["max_burst_ms"]))
        if config["author_graph"] == "hawkes":
            if ("hawkes",) not in screens:
                screens["hawkes",] = graph.hawkes_graph(events, tau_ms)
            edges = screens["hawkes",]
        else:
            if (window, s["jaccard"]) not in screens:
                screens[window, s["jaccard"]] = graph.jaccard_screen(events, window, s["jaccard"]).persist()
            edges = graph.lag_edges(events, screens[window, s["jaccard"]], s["lag_peak"], window)
        found.append(member(burst_ops.enumerate_bursts(events, graph.cluster_authors(channels, edges), window), F.lit(number)))
    return reduce(DataFrame.union, found)


def distinct_bursts(members: DataFrame) -> DataFrame:
    """The bursts of all settings, each once: what has to be labelled."""
    return members.select(*BURST).dropDuplicates(["burst_id"])


def with_settings(labels: DataFrame, members: DataFrame) -> DataFrame:
    """Labels of bursts once for each setting that found them, with that setting's count of authors."""
    return labels.join(members.select("burst_id", "setting", "independent_clusters", "confirm_span_ms"), "burst_id")


_WINDOWS = [POST_WINDOW_MS, 2 * POST_WINDOW_MS]


@query("detector_board", f"""WITH RECURSIVE {anchors_sql(_WINDOWS, ["_0", "_1"])},
 p AS (SELECT symbol, direction, ts_ms, seq FROM p_0 UNION SELECT symbol, direction, ts_ms, seq FROM p_1){FROM_POSTS_SQL},
 hi AS MATERIALIZED (SELECT lab.*, s.ts_ms, xg.st * 3600000::BIGINT AS emb FROM lab JOIN sig s ON s.seq = lab.burst_id JOIN xg ON xg.exit_id = lab.exit_id WHERE NOT truncated),
 cf AS (SELECT hi.*, setting FROM hi JOIN (SELECT 0 AS setting, seq FROM p_0 UNION ALL SELECT 1, seq FROM p_1) m ON m.seq = hi.burst_id), {_folds_sql("cf", "setting, exit_id")},
 fs AS (SELECT setting, exit_id, fold, {_SCORE} AS score, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS wins, count(*) AS size FROM vr GROUP BY ALL)
 SELECT setting, exit_id, round(avg(score), 6) AS cv_score, round(avg(wins), 6) AS cv_winrate, round(avg(size), 2) AS cv_support, sum(size)::BIGINT AS n FROM fs GROUP BY ALL""")
def _detector_board(spark, sf_dir):
    members = collapsed(signals(spark, sf_dir), _WINDOWS).persist()
    grid = exit_grid(spark, QUERY_AXES)
    lives = F.broadcast(grid.select("exit_id", (F.col("stale") * HOUR).cast("long").alias("embargo_ms")))
    labels = replay(distinct_bursts(members), hourly(spark, sf_dir), grid, HOUR).where(~F.col("truncated")).join(members.select("burst_id", "ts_ms").distinct(), "burst_id").join(lives, "exit_id")
    return board(with_settings(labels, members), ["setting", "exit_id"]).select("setting", "exit_id", "cv_score", "cv_winrate", "cv_support", "n")
