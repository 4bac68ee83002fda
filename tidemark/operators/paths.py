"""First triggers along price paths, from arrays of candles that all bursts of a symbol and slice of time share.

A burst's path is a range of its symbol's candles, so it isn't copied: candles are dealt once by symbol and slice of time
(to the slice that they lie in and to the one before, as a path may reach over), bursts once by the slice in which they
begin. In a slice's task the paths of many bursts are rows of a matrix of places in the arrays, and every running best,
worst and first trigger is one array step for all of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells (bursts times steps) of a matrix.
CELLS = 1 << 18
#: What is told of a trigger's step, in this order.
STEP = ("k", "close_pnl", "peak", "peak_before", "trough", "close", "bar_range")
KINDS = ("stops", "takes", "stales", "lives")
SIDES = ("long", "short")


def schema_of(id_type: str) -> str:
    hits = ", ".join(f"{kind}_{side} array<array<double>>" for side in SIDES for kind in KINDS)
    return f"burst_id {id_type}, symbol string, direction string, entry_i int, entry_price double, entry_range double, n_bars int, _pressures array<double>, _zs array<double>, {hits}"


def _rows(matrix: np.ndarray) -> pa.ListArray:
    """A list of doubles for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def _told(at: np.ndarray, there: np.ndarray, fields: list[np.ndarray]) -> pa.ListArray:
    """For each burst and value of an axis, the fields of the step it triggers at; null where it doesn't."""
    n, m = at.shape
    row = np.repeat(np.arange(n), m)
    flat = np.stack([f[row, at.ravel()] for f in fields], axis=1)
    lengths = np.where(there.ravel(), len(fields), 0)
    bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    values = flat[there.ravel()].ravel()
    steps = pa.ListArray.from_arrays(pa.array(bounds, mask=np.concatenate((~there.ravel(), [False]))), pa.array(values))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), steps)


def _first(hits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([h.argmax(axis=1) for h in hits], axis=1), np.stack([h.any(axis=1) for h in hits], axis=1)


def walked(bars: dict[str, np.ndarray], begins: np.ndarray, lengths: np.ndarray, zone: tuple[np.ndarray, np.ndarray], against_long: np.ndarray, axes: dict[str, list], horizon: int) -> dict[str, pa.Array]:
    """Columns of schema_of from entry_i on, for bursts whose paths are ``lengths`` candles from ``begins``."""
    step = np.arange(horizon)
    last = len(bars["close"]) - 1
    place = np.minimum(begins[:, None] + step, last)
    there = step < lengths[:, None]
    low, high, close = (bars[c][place] for c in ("low", "high", "close"))
    first_open = bars["open"][begins]
    ends = [np.where(np.isnan(z), first_open, z)[:, None] for z in zone]
    lo, hi = np.minimum(*ends), np.maximum(*ends)
    touches = there & (low <= hi) & (high >= lo)
    entry = touches.argmax(axis=1)
    rows = np.arange(len(begins))
    at = np.clip((lo + hi)[:, 0] / 2, low[rows, entry], high[rows, entry])
    here = close[rows, entry]
    price = np.where((here >= lo[:, 0]) & (here <= hi[:, 0]), here, at)
    entered = touches.any(axis=1) & (price > 0)
    reach = (high - low)[rows, entry]

    volume, turned = bars["volume"][place], np.where(against_long[:, None], close < bars["open"][place], close > bars["open"][place])
    k = step - entry[:, None]
    pressures, scores = [], []
    for h in axes["horizons"]:
        ahead = there & (k >= 1) & (k <= h) & entered[:, None]
        total = np.where(ahead, volume, 0.0).sum(axis=1)
        pressures.append(np.where(total > 0, np.where(ahead & turned, volume, 0.0).sum(axis=1) / np.where(total > 0, total, 1.0), 0.0))
    for n in axes["baselines"]:
        before = there & (k >= -n) & (k <= -1) & entered[:, None]
        count = before.sum(axis=1)
        mean = np.where(before, volume, 0.0).sum(axis=1) / np.maximum(count, 1)
        deviation = np.sqrt(np.where(before, (volume - mean[:, None]) ** 2, 0.0).sum(axis=1) / np.maximum(count - 1, 1))
        usable = (count >= 2) & (deviation > 0)
        scores.append(np.where(usable, (volume[rows, entry] - mean) / np.where(usable, deviation, 1.0), 0.0))

    # From here on, columns are steps from the entry.
    left = np.where(entered, lengths - entry, 0)
    place = np.minimum((begins + entry)[:, None] + step, last)
    live = step < left[:, None]
    low, high, close = (bars[c][place] for c in ("low", "high", "close"))
    e = np.where(entered, price, 1.0)[:, None]
    none = ~entered
    out: dict[str, pa.Array] = {
        "entry_i": pa.array(entry.astype(np.int32), mask=none), "entry_price": pa.array(price, mask=none), "entry_range": pa.array(reach, mask=~touches.any(axis=1)),
        "n_bars": pa.array(lengths.astype(np.int32)), "_pressures": _rows(np.stack(pressures, axis=1)), "_zs": _rows(np.stack(scores, axis=1)),
    }
    steps = np.broadcast_to(step, live.shape)
    for side in SIDES:
        of = (lambda p: (p - e) / e) if side == "long" else (lambda p: (e - p) / e)
        one, other, result = of(low), of(high), of(close)
        worst, best = np.where(live, np.minimum(one, other), 0.0), np.where(live, np.maximum(one, other), 0.0)
        peak, trough = np.maximum(np.maximum.accumulate(best, axis=1), 0.0), np.minimum(np.minimum.accumulate(worst, axis=1), 0.0)
        peak_before = np.concatenate((np.zeros((len(e), 1)), peak[:, :-1]), axis=1)
        peak_k = np.maximum.accumulate(np.where(best > peak_before, steps, 0), axis=1)
        fields = [steps.astype(float), result, peak, peak_before, trough, close, high - low]
        hits = {
            "stops": _first([live & (worst <= -s / 100) for s in axes["stops"]]),
            "takes": _first([live & (result >= 0) & (peak > 0) & (peak - result >= t) for t in axes["trails"]]),
            "stales": _first([live & (peak >= profit / 100) & (steps - peak_k >= since) for profit, since in axes["stales"]]),
            "lives": (np.stack([np.maximum(np.minimum(life, left - 1), 0) for life in axes["lives"]], axis=1), np.repeat(entered[:, None], len(axes["lives"]), axis=1)),
        }
        for kind in KINDS:
            out[f"{kind}_{side}"] = _told(*hits[kind], fields)
    return out


def _slice(axes: dict[str, list], interval_ms: int, horizon: int, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(asks: pa.Table, candles: pa.Table) -> pa.Table:
        candles = candles.sort_by("bar_ms")
        bars = {c: candles[c].to_numpy().astype(float) for c in ("open", "high", "low", "close", "volume")}
        times, starts = candles["bar_ms"].to_numpy(), asks["start_ms"].to_numpy()
        begins = np.searchsorted(times, starts, "left")
        lengths = np.searchsorted(times, starts + (horizon - 1) * interval_ms, "right") - begins
        asks = asks.filter(pa.array(lengths > 0))
        begins, lengths = begins[lengths > 0], lengths[lengths > 0]
        zone = [asks[c].fill_null(np.nan).to_numpy() for c in ("entry_from", "entry_to")]
        is_long = np.array([d == "long" for d in asks["direction"].to_pylist()], bool)
        parts = []
        size = max(1, CELLS // horizon)
        for a in range(0, len(begins), size):
            chunk = slice(a, a + size)
            columns = walked(bars, begins[chunk], lengths[chunk], (zone[0][chunk], zone[1][chunk]), is_long[chunk], axes, horizon)
            head = [asks[c].slice(a, size).combine_chunks() for c in ("burst_id", "symbol", "direction")]
            parts.append(pa.table([*head, *columns.values()], names=names))
        return pa.concat_tables(parts) if parts else pa.table({"burst_id": asks["burst_id"]}).slice(0, 0)

    return run


def first_triggers(bursts: DataFrame, candles: DataFrame, axes: dict[str, list], interval_ms: int, horizon: int) -> DataFrame:
    """A row for each burst with a candle ahead: its entry, pressures, volume scores, and for each side and kind of trigger
    the step (STEP) at which each value of the axis triggers first; null where it never does.

    axes: stops and lives, trails (fractions), stales (profit, since), horizons, baselines. A path are the candles that
    begin within ``horizon`` intervals from the first that begins at the burst or after it. A missing bound of the posted
    zone is the path's first open.
    """
    width = horizon * interval_ms
    part = lambda ts: F.floor(ts / F.lit(width)).cast("long")
    start = F.col("ts_ms") + F.pmod(interval_ms - F.pmod("ts_ms", F.lit(interval_ms)), F.lit(interval_ms))
    asks = bursts.select("burst_id", "symbol", "direction", F.col("entry_from").cast("double"), F.col("entry_to").cast("double"), start.alias("start_ms")).withColumn("slice", part(F.col("start_ms")))
    bars = candles.select("symbol", F.col("ts_ms").alias("bar_ms"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    bars = bars.withColumn("slice", F.explode(F.array(part(F.col("bar_ms")) - 1, part(F.col("bar_ms")))))
    schema = schema_of(asks.schema["burst_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    run = _slice(axes, interval_ms, horizon, names)

    def paths(asked: pa.Table, candles_there: pa.Table) -> pa.Table:
        if not asked.num_rows or not candles_there.num_rows:
            return empty(asked)
        found = run(asked, candles_there)
        return found if found.num_rows else empty(asked)

    kinds = {c: pa.list_(pa.list_(pa.float64())) for c in names[9:]} | {"entry_i": pa.int32(), "entry_price": pa.float64(), "entry_range": pa.float64(), "n_bars": pa.int32(), "_pressures": pa.list_(pa.float64()), "_zs": pa.list_(pa.float64())}

    def empty(asked: pa.Table) -> pa.Table:
        types = [asked.schema.field(c).type if c in ("burst_id", "symbol", "direction") else kinds[c] for c in names]
        return pa.table([pa.array([], t) for t in types], names=names)

    return asks.groupBy("symbol", "slice").cogroup(bars.groupBy("symbol", "slice")).applyInArrow(paths, schema)
