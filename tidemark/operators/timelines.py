"""Times of each key, span by span, as arrays: gaps and nearest events are found in them without a row for each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import KEY

#: Horizons to a span; a task holds the times of one key and span, and of the horizon beside it.
SPAN_HORIZONS = 4


def dealt(df: DataFrame, parts: int = 0) -> DataFrame:
    """``df`` by key and span, in as many parts as Spark shuffles into (or ``parts``, if more), be they small: work on timelines
    outweighs their size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, parts), *KEY, "span")


def timelines(events: DataFrame, width: int, back: int = 0, ahead: int = 0, *more: str, parts: int = 0) -> DataFrame:
    """(symbol, direction, span, channels, sizes, times): what a key holds in a span of ``width``, up to ``back`` before it
    and ``ahead`` after it. Times are those of the first channel, then of the next; columns named in ``more`` alike."""
    part = lambda ts: F.floor(ts / F.lit(width)).cast("long")
    spread = events.select(*KEY, "channel", "ts_ms", *more, F.explode(F.sequence(part(F.col("ts_ms") - ahead), part(F.col("ts_ms") + back))).alias("span"))
    row = F.struct("ts_ms", *more) if more else F.col("ts_ms")
    cells = spread.groupBy(*KEY, "span", "channel").agg(F.collect_list(row).alias("rows"))
    lines = dealt(cells, parts).groupBy(*KEY, "span").agg(F.collect_list(F.struct("channel", "rows")).alias("cells"))
    rows = F.flatten(F.transform("cells", lambda c: c["rows"]))
    columns = [rows["ts_ms"].alias("times"), *[rows[c].alias(c) for c in more]] if more else [rows.alias("times")]
    return lines.select(*KEY, "span", F.transform("cells", lambda c: c["channel"]).alias("channels"), F.transform("cells", lambda c: F.size(c["rows"])).alias("sizes"), *columns)


def by_channel(sizes: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """The sorted times of each channel of a timeline."""
    ends = np.cumsum(sizes)
    return [np.sort(times[end - size : end]) for size, end in zip(sizes, ends)]


def gap_sums(lines: DataFrame, width: int, below: list[int]) -> DataFrame:
    """(symbol, direction, n, total, least, most) of each key and span: of the gaps between events of different channels,
    how many are positive and smaller than each of ``below``; sum, least and greatest of those under the last one.

    An event meets no other: counts are differences of places in the sorted times of the key, less those of its channel.
    """

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for symbol, direction, span, sizes, times in zip(*[frame[c] for c in (*KEY, "span", "sizes", "times")]):
                channel = np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(times, kind="stable")
                base = int(times[order[0]])
                ts, channel = times[order] - base, channel[order]
                own = slice(*np.searchsorted(ts, [span * width - base, (span + 1) * width - base]))
                y, of = ts[own], channel[own]
                if not len(y):
                    continue
                # All channels' times one after the other, so that a channel's own are found at once.
                wide = int(ts[-1]) + 2
                line = np.sort(channel * wide + ts)
                at, end = of * wide + y, np.searchsorted(ts, y)
                own_end, own_first = np.searchsorted(line, at), np.searchsorted(line, of * wide)
                from_ = lambda gap: (np.searchsorted(ts, y - gap), np.maximum(np.searchsorted(line, at - gap), own_first))
                n = []
                for edge in below:
                    low, own_low = from_(edge - 1)
                    n.append(int((end - low - own_end + own_low).sum()))
                upto = np.concatenate(([0], np.cumsum(ts)))
                own_upto = np.concatenate(([0], np.cumsum(line % wide)))
                held = end - low - own_end + own_low
                total = int((held * y - (upto[end] - upto[low]) + (own_upto[own_end] - own_upto[own_low])).sum())
                # Runs of one channel: if the event next to a bound is of the same channel, the next one beyond its run isn't.
                turn = np.flatnonzero(channel[1:] != channel[:-1]) + 1
                run = np.searchsorted(turn, np.arange(len(ts)), "right")
                starts, ends = np.concatenate(([0], turn)), np.concatenate((turn, [len(ts)]))
                some = held > 0
                near, far = end[some] - 1, low[some]
                near = np.where(channel[near] == of[some], starts[run[near]] - 1, near)
                far = np.where(channel[far] == of[some], ends[run[far]], far)
                least, most = (int((y[some] - ts[near]).min()), int((y[some] - ts[far]).max())) if some.any() else (None, None)
                out.append((symbol, direction, n, total, least, most))
            yield pd.DataFrame(out, columns=[*KEY, "n", "total", "least", "most"]).astype({"least": "Int64", "most": "Int64"})

    return lines.select(*KEY, "span", "sizes", "times").mapInPandas(sums, "symbol string, direction string, n array<long>, total long, least long, most long")


#: Gaps to a tile of counts, and gaps that are gathered before they are counted.
TILE, GATHERED = 1 << 16, 1 << 22
TILES = "tile int, gaps binary, counts binary, kind string"


class _Gathered:
    """Gaps on their way into an array of counts, added or taken away by the sign; counted a few million at a time."""

    def __init__(self, counts: np.ndarray, sign: int):
        self.counts, self.sign, self.gaps, self.loads, self.size = counts, sign, [], [], 0

    def add(self, gaps: np.ndarray, loads: np.ndarray | None) -> None:
        self.gaps.append(gaps)
        self.loads.append(loads)
        self.size += len(gaps)
        if self.size >= GATHERED:
            self.count()

    def count(self) -> None:
        if self.gaps:
            gaps = np.concatenate(self.gaps)
            loads = None if all(x is None for x in self.loads) else np.concatenate([np.ones(len(g)) if x is None else x for g, x in zip(self.gaps, self.loads)])
            least = int(gaps.min())
            if int(gaps.max()) - least > 8 * len(gaps):
                np.add.at(self.counts, gaps, self.sign if loads is None else self.sign * loads.astype(np.int64))
            else:
                gaps -= least
                found = np.bincount(gaps, loads)
                part = self.counts[least : least + len(found)]
                (np.add if self.sign > 0 else np.subtract)(part, found.astype(np.int64, copy=False), out=part)
        self.gaps, self.loads, self.size = [], [], 0


def _pairs(ts: np.ndarray, low: int, high: int, reach: int, into: _Gathered) -> None:
    """Gathers the gaps from the events of an array in [low, high) of time to those before them.

    Equal times count as one with their product of numbers; one shifted difference per neighbour.
    """
    times, weight = np.unique(ts, return_counts=True)
    first, last = np.searchsorted(times, [low, high])
    if first == last:
        return
    heavy = bool((weight > 1).any())
    for shift in range(1, last):
        at = max(first, shift)
        gaps = times[at:last] - times[at - shift : last - shift]
        loads = weight[at:last] * weight[at - shift : last - shift] if heavy else None
        if gaps.max() > reach:
            near = gaps <= reach
            if not near.any():
                break
            gaps, loads = gaps[near], loads[near] if heavy else None
        into.add(gaps, loads)


def _packed(counts: np.ndarray) -> tuple[bytes, bytes, str] | None:
    """A tile's counts: all of them, or those above 0 with their places; in as few bytes each as they need."""
    places = np.flatnonzero(counts)
    if not len(places):
        return None
    dense = 3 * len(places) > len(counts)
    kept = counts if dense else counts[places]
    kind = next(k for k in ("u1", "u2", "u4", "i8") if k == "i8" or int(kept.max()) < 256 ** int(k[1]))
    return b"" if dense else places.astype("u2").tobytes(), kept.astype(kind).tobytes(), kind


def unpacked(gaps: bytes, counts: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of a tile, without zeros."""
    n = np.frombuffer(counts, kind).astype(np.int64)
    if gaps:
        return np.frombuffer(gaps, "u2").astype(np.int64), n
    places = np.flatnonzero(n)
    return places, n[places]


def gap_counts(lines: DataFrame, width: int, reach: int) -> DataFrame:
    """TILES rows: how often each positive gap up to ``reach`` occurs between events of a key and different channels.

    A task counts all pairs of its timelines in one array; the arrays of all tasks are added tile by tile. Neither depends on
    how many pairs there are.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(-(-(reach + 1) // TILE) * TILE, np.int64)
        more, less = _Gathered(counts, 1), _Gathered(counts, -1)
        for frame in frames:
            for span, sizes, times in zip(*[frame[c] for c in ("span", "sizes", "times")]):
                low, high = span * width, (span + 1) * width
                _pairs(times, low, high, reach, more)
                for own in by_channel(sizes, times):
                    _pairs(own, low, high, reach, less)
        more.count()
        less.count()
        rows = [(k, *packed) for k in range(len(counts) // TILE) if (packed := _packed(counts[k * TILE : (k + 1) * TILE]))]
        yield pd.DataFrame(rows, columns=["tile", "gaps", "counts", "kind"])

    def add(tiles: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(TILE, np.int64)
        for gaps, counts, kind in zip(tiles["gaps"], tiles["counts"], tiles["kind"]):
            places, n = unpacked(gaps, counts, kind)
            total[places] += n
        return pd.DataFrame([(tiles["tile"].iloc[0], *_packed(total))], columns=["tile", "gaps", "counts", "kind"])

    # An array for each task: as many tasks as run at once, twice over.
    tasks = 2 * lines.sparkSession.sparkContext.defaultParallelism
    parts = lines.select("span", "sizes", "times").coalesce(tasks).mapInPandas(count, TILES)
    return parts.groupBy("tile").applyInPandas(add, TILES)


def log_sums(tiles: DataFrame, of, schema: str) -> DataFrame:
    """Rows of ``of(logs, counts)`` for the log gaps (of a second at least) of the tiles of each part of the table."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split()[0] for f in schema.split(",")]
        for frame in frames:
            out = []
            for tile, gaps, counts, kind in zip(*[frame[c] for c in ("tile", "gaps", "counts", "kind")]):
                places, n = unpacked(gaps, counts, kind)
                out += of(np.log(np.maximum(tile * TILE + places, 1000).astype(float)), n)
            yield pd.DataFrame(out, columns=names)

    return tiles.mapInPandas(sums, schema)


def _counted(codes: np.ndarray, weights: list[np.ndarray | None]) -> list[np.ndarray]:
    """The distinct codes, and for each list of weights their sums."""
    distinct, place = np.unique(codes, return_inverse=True)
    return [distinct, *[np.bincount(place, w, len(distinct)).astype(np.int64) for w in weights]]


def nearest_lags(lines: DataFrame, width: int, reach: int, peak: int) -> DataFrame:
    """(a, b, value, n, near): lags from the events of a to the nearest of b (the earlier of two), for the pairs that a
    timeline's ``asks`` (a, b, bin) name. Without a bin, how many lags each bin holds, and of these, how many lie within
    ``peak``; with one, how often each lag of that bin occurs. Lags beyond the reach are left out."""

    def lags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            numbers: dict[tuple[str, str], int] = {}
            out: list[list[np.ndarray]] = []
            for span, channels, sizes, times, asks_a, asks_b, asks_bin in zip(*[frame[c] for c in ("span", "channels", "sizes", "times", "ask_a", "ask_b", "ask_bin")]):
                of = dict(zip(channels, by_channel(sizes, times)))
                own = {a: x[slice(*np.searchsorted(x, [span * width, (span + 1) * width]))] for a, x in of.items()}
                bounded = {b: np.concatenate(([-(1 << 61)], y, [1 << 61])) for b, y in of.items()}
                found = []
                for a, b in zip(asks_a, asks_b):
                    x, y = own[a], bounded[b]
                    after = y.searchsorted(x)
                    ahead = y[after] - x
                    back = x - y[after - 1]
                    # An event at the very time is the nearest, whichever side it is on.
                    found.append(np.where((back <= ahead) & (ahead > 0), -back, ahead))
                place = np.repeat(np.arange(len(found)), [len(x) for x in found])
                lag = np.concatenate(found)
                value = np.sign(lag) * np.cbrt(np.abs(lag)).astype(np.int64)
                held = np.abs(lag) <= reach
                bins = np.array([np.nan if x is None else x for x in asks_bin], float)
                if not np.isnan(bins).all():
                    held &= value == bins[place]
                    value = lag
                number = np.array([numbers.setdefault(pair, len(numbers)) for pair in zip(asks_a, asks_b)])
                out.append(_counted(number[place[held]] * (1 << 32) + (value[held] + (1 << 31)), [None, np.abs(lag[held]) <= peak]))
            if out:
                codes, n, near = map(np.concatenate, zip(*out))
                codes, n, near = _counted(codes, [n, near])
                names = pd.DataFrame(list(numbers), columns=["a", "b"]).iloc[codes >> 32].reset_index(drop=True)
                yield names.assign(value=(codes & ((1 << 32) - 1)) - (1 << 31), n=n, near=near)

    return lines.select("span", "channels", "sizes", "times", "ask_a", "ask_b", "ask_bin").mapInPandas(lags, "a string, b string, value long, n long, near long")


def parent_pulls(lines: DataFrame, width: int, horizon: int, tau_ms: float) -> DataFrame:
    """(k, channels, pulls) for each timeline (with seq) and channel k: a matrix, a row for each event of k in the span and a
    column for each of the channels, of what the channel's earlier events within the horizon bring: a sum of exponentials.

    A channel's sum over a stretch of time is a difference of two running sums of exp(time / lag).
    """
    beta = 1 / max(tau_ms, 1)

    def pulls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for span, channels, sizes, times, seq in zip(*[frame[c] for c in ("span", "channels", "sizes", "times", "seq")]):
                of = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((seq, times))
                ts, of = times[order], of[order]
                first, end = np.searchsorted(ts, [span * width, (span + 1) * width])
                if first == end:
                    continue
                own, since = np.arange(first, end), np.searchsorted(ts, ts[first:end] - horizon)
                grown = np.exp(beta * (ts - ts[0]))
                decay = beta * np.exp(-beta * (ts[first:end] - ts[0]))
                table = np.empty((end - first, len(sizes)))
                for p in range(len(sizes)):
                    places = np.flatnonzero(of == p)
                    upto = np.concatenate(([0.0], np.cumsum(grown[places])))
                    table[:, p] = (upto[np.searchsorted(places, own)] - upto[np.searchsorted(places, since)]) * decay
                out = [(channels[k], list(channels), table[of[first:end] == k].tobytes()) for k in range(len(sizes)) if (of[first:end] == k).any()]
                yield pd.DataFrame(out, columns=["k", "channels", "pulls"])

    return lines.select("span", "channels", "sizes", "times", "seq").mapInPandas(pulls, "k string, channels array<string>, pulls binary")


def shared_mass(pulls: DataFrame) -> DataFrame:
    """(p, k, m): the mass of k's events that falls to parents of channel p, by the shares that mu and alphas (those of ps; all
    0.2 at first) give; p is null for the background's. Summed within each part of the table."""

    def share(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str | None, str], float] = {}
        for frame in frames:
            for k, channels, table, mu, ps, alphas in zip(*[frame[c] for c in ("k", "channels", "pulls", "mu", "ps", "alphas")]):
                g = np.frombuffer(table).reshape(-1, len(channels))
                known = None if ps is None else dict(zip(ps, alphas))
                alpha = np.full(len(channels), 0.2) if known is None else np.array([known.get(p, 0.0) for p in channels])
                part = 1 / (mu + g @ alpha)
                for p, m in zip([*channels, None], [*(alpha * (part @ g)).tolist(), float(mu * part.sum())]):
                    sums[p, k] = sums.get((p, k), 0.0) + m
        yield pd.DataFrame([(p, k, m) for (p, k), m in sums.items()], columns=["p", "k", "m"])

    return pulls.select("k", "channels", "pulls", "mu", "ps", "alphas").mapInPandas(share, "p string, k string, m double")
