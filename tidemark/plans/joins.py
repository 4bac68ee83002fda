"""Plan builders for joins that Catalyst would run as nested loops, and for ordered choices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, low: int, high: int, how: str = "inner") -> DataFrame:
    """Pairs with equal ``on`` and low <= right_ts - left_ts <= high, by an equi-join on time buckets.

    A bucket is as wide as the band, so each left row meets two buckets at most; the right side isn't duplicated. The
    bucket number spreads a hot key over as many groups as it has buckets. Columns named in ``on`` come from the left.
    """
    width = max(1, high - low)
    bucket = lambda ts: F.floor(ts / F.lit(width)).cast("long")
    spread = left.withColumn("_b", F.explode(F.sequence(bucket(F.col(left_ts) + low), bucket(F.col(left_ts) + high))))
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns]).withColumn("_rb", bucket(F.col(right_ts)))
    same = F.col("_b") == F.col("_rb")
    for c in on:
        same = same & (F.col(c) == F.col(f"_r_{c}"))
    gap = F.col(right_ts) - F.col(left_ts)
    return spread.join(other, same & gap.between(low, high), how).drop("_b", "_rb", *[f"_r_{c}" for c in on])


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group in an explicit order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") == 1).drop("_rank")


def cut_at_gaps(df: DataFrame, keys: list[str], width: int, ts: str = "ts_ms", seq: str = "seq") -> DataFrame:
    """Adds _piece, the time of the row that begins the row's piece: pieces of a key lie more than ``width`` apart.

    Keys are cut into spans of time first, so that a hot key is sorted span by span; only a row for each span (its first
    and last time and its last beginning of a piece) is ordered over a whole key.
    """
    spanned = df.withColumn("_span", F.floor(F.col(ts) / F.lit(256 * max(width, 1))).cast("long"))
    over_spans = Window.partitionBy(*keys).orderBy("_span")
    ends = spanned.groupBy(*keys, "_span").agg(F.max(ts).alias("_end")).withColumn("_before", F.lag("_end").over(over_spans))
    inside = Window.partitionBy(*keys, "_span").orderBy(ts, seq)
    rows = spanned.join(ends.drop("_end"), [*keys, "_span"])
    gap = F.col(ts) - F.coalesce(F.lag(ts).over(inside), F.col("_before"))
    marked = rows.withColumn("_begins", F.when(F.coalesce(gap > width, F.lit(True)), F.col(ts)))
    carried = marked.groupBy(*keys, "_span").agg(F.max("_begins").alias("_last")).withColumn("_carried", F.max("_last").over(over_spans.rowsBetween(Window.unboundedPreceding, -1)))
    begun = F.max("_begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    found = marked.withColumn("_piece", begun).join(carried.drop("_last"), [*keys, "_span"])
    return found.select(*df.columns, F.coalesce("_piece", "_carried").alias("_piece"))


def whole_groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, from frames that are sorted by group and may cut one."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        if held and any(held[0][c].iloc[0] != frame[c].iloc[0] for c in by):
            yield pd.concat(held, ignore_index=True)
            held = []
        same = np.logical_and.reduce([(frame[c] == frame[c].iloc[-1]).to_numpy() for c in by])
        cut = 0 if same.all() else len(frame) - int(same[::-1].argmin())
        if cut:
            yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
            held = []
        held.append(frame.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(frame: pd.DataFrame, by: list[str]) -> list[int]:
    """Where the groups of a sorted frame begin, and its end."""
    new = np.logical_or.reduce([(frame[c] != frame[c].shift()).to_numpy() for c in by])
    return [*np.flatnonzero(new).tolist(), len(frame)]


#: Windows to a span of an anchored collapse.
SPAN = 16


def exits(times: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """For each row of a span, the last anchor of the walk that begins there: jumps doubled until none leads further."""
    after = np.searchsorted(times, times + width, side="right")
    last = np.where(after < len(times), after, np.arange(len(times)))
    while not np.array_equal(further := last[last], last):
        last = further
    return last


def _jump_tables(keys: list[str], most: int, ts: str, seq: str):
    """(keys, _span, upto, bound, a_ts, a_seq): walks that enter a span at a row of time ``upto`` at most (and above the
    run before) leave it with the group of this anchor, which ends at ``bound``."""

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = [*keys, "_span"]
        for rows in whole_groups(frames, by):
            starts, found = group_bounds(rows, by), []
            times, seqs, spans, widths = (rows[c].to_numpy() for c in (ts, seq, "_span", "_width"))
            for first, end in zip(starts, starts[1:]):
                own, wide = times[first:end], widths[first:end]
                # A walk comes from a group that ends within a window of the span's start, so it enters before or next after.
                edge = int(np.searchsorted(own, spans[first] * SPAN * max(most, 1) + most, side="left"))
                entries = np.unique(own[: edge + 1], return_index=True)[1]
                last = exits(own, wide)[entries]
                runs = np.flatnonzero(np.concatenate((last[1:] != last[:-1], [True])))
                anchors = last[runs]
                found.append(pd.DataFrame({**{c: rows[c].iloc[first] for c in by}, "upto": own[entries[runs]], "bound": own[anchors] + wide[anchors], "a_ts": own[anchors], "a_seq": seqs[first + anchors]}))
            yield pd.concat(found, ignore_index=True)

    return tables


def _entered(keys: list[str]):
    """(keys, _span, e_bound, e_ts, e_seq): the group that is open where each span begins; null in a key's first span."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, span, moved = None, None, None, False
        columns = [*keys, "_span", "upto", "bound", "a_ts", "a_seq"]
        for frame in frames:
            out = []
            for row in zip(*[frame[c].tolist() for c in columns]):
                here, number, (upto, *group) = row[: len(keys)], row[len(keys)], row[len(keys) + 1 :]
                if here != key:
                    key, state, span = here, None, None
                if number != span:
                    span, moved = number, False
                    out.append((*here, number, *(state or (None, None, None))))
                if not moved and (state is None or upto > state[0]):
                    state, moved = tuple(group), True
            yield pd.DataFrame(out, columns=[*keys, "_span", "e_bound", "e_ts", "e_seq"]).astype({c: "Int64" for c in ("e_bound", "e_ts", "e_seq")})

    return walk


def anchored_groups(df: DataFrame, keys: list[str], width: int | str, ts: str = "ts_ms", seq: str = "seq", most: int | None = None) -> DataFrame:
    """Greedy collapse: a row joins the open group while it lies within ``width`` of the group's first row.

    Not a session window, which compares with the last row. Adds anchor_ts and anchor_seq, the group's first row. A key
    is cut into spans of ``SPAN`` windows, whether it has gaps or not. Each span tells for every row at which a walk from
    anchor to anchor may enter it with which anchor the walk leaves (walks soon meet, so these are a few runs); the runs
    are followed from span to span; then all spans are filled in parallel, each from the group that is open at its start.
    The width may be a column, the group's being that of its first row, if ``most`` tells the greatest.
    """
    columns, most = df.columns, max(0, width if most is None else most)
    long = lambda c: T.StructField(c, T.LongType())
    wide = F.col(width) if isinstance(width, str) else F.lit(max(width, 0))
    spanned = df.withColumn("_width", wide.cast("long")).withColumn("_span", F.floor(F.col(ts) / F.lit(SPAN * max(most, 1))).cast("long"))
    by = [*keys, "_span"]
    key_fields = [f for f in df.schema.fields if f.name in keys]
    key_fields.sort(key=lambda f: keys.index(f.name))
    narrow = spanned.select(*by, ts, seq, "_width").repartition(*by).sortWithinPartitions(*by, ts, seq)
    tables = narrow.mapInPandas(_jump_tables(keys, most, ts, seq), T.StructType([*key_fields, *[long(c) for c in ("_span", "upto", "bound", "a_ts", "a_seq")]]))
    entered = tables.repartition(*keys).sortWithinPartitions(*by, "upto").mapInPandas(_entered(keys), T.StructType([*key_fields, *[long(c) for c in ("_span", "e_bound", "e_ts", "e_seq")]]))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, group = None, None  # the span that the last frame ended in, and its open group (bound, anchor time, anchor seq)
        for rows in frames:
            if rows.empty:
                continue
            times, seqs, widths = (rows[c].to_numpy() for c in (ts, seq, "_width"))
            starts = group_bounds(rows, by)
            heads = rows.iloc[starts[:-1]]
            names = list(zip(*[heads[c] for c in by]))
            carried = list(zip(*[heads[c] for c in ("e_bound", "e_ts", "e_seq")]))
            anchor_ts, anchor_seq = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
            for k, (first, last) in enumerate(zip(starts, starts[1:])):
                if names[k] != name:
                    name, group = names[k], None if pd.isna(carried[k][0]) else tuple(int(x) for x in carried[k])
                at = first
                while at < last:
                    if group is None or times[at] > group[0]:
                        group = (int(times[at] + widths[at]), times[at], seqs[at])
                    end = at + int(np.searchsorted(times[at:last], group[0], side="right"))
                    anchor_ts[at:end], anchor_seq[at:end] = group[1:]
                    at = end
            yield rows[columns].assign(anchor_ts=anchor_ts, anchor_seq=anchor_seq)

    schema = T.StructType([*df.schema.fields, long("anchor_ts"), long("anchor_seq")])
    return spanned.join(entered, by).sortWithinPartitions(*by, ts, seq).mapInPandas(fill, schema)
