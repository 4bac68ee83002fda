"""An archive of posts as a stream: each post once, its counters only when they change, and where a crawl may end.

A crawl lists a feed from new to old. ``changes`` keeps one snapshot of counters per post as state, with an expiry, and
emits a row when a post is first seen or its counters differ from the last ones; equal sightings emit nothing. ``unread``
tells, by the archive so far, up to which place a feed need be read: a run of known posts means that the rest is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Known posts in a row after which a feed's tail is taken as known (fixed value).
KNOWN_STREAK = 48
COUNTERS = ("likes", "comments", "views")
SIGHTING = "id string, seen_ms long, likes long, comments long, views long"
CHANGE = "id string, seen_ms long, first_seen_ms long, is_new boolean, likes long, comments long, views long"
_STATE = "first_seen_ms long, last_seen_ms long, likes long, comments long, views long"


class _Counters(StatefulProcessor):
    """The last counters of one post; sightings of a batch are taken in order of time, late ones are not."""

    def __init__(self, expiry: timedelta):
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE, int(self.expiry.total_seconds() * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values("seen_ms", kind="stable")
        known = self.last.get() if self.last.exists() else None
        out = []
        for row in seen[["seen_ms", *COUNTERS]].astype(object).where(seen[["seen_ms", *COUNTERS]].notna(), None).itertuples(index=False, name=None):
            at, counters = int(row[0]), tuple(None if c is None else int(c) for c in row[1:])
            if known is not None and at < known[1]:
                continue  # a sighting older than the last one says nothing new
            first = at if known is None else known[0]
            if known is None or counters != tuple(known[2:]):
                out.append((key[0], at, first, known is None, *counters))
            known = (first, at, *counters)
        if known is not None:
            self.last.update(tuple(known))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGE.split(", ")]).astype({c: "Int64" for c in COUNTERS})

    def close(self) -> None:
        pass


def changes(sightings: DataFrame, expiry: timedelta = timedelta(days=90)) -> DataFrame:
    """sightings: SIGHTING (a stream). CHANGE rows, in append mode; a post not seen for the expiry counts as new again.

    Needs the RocksDB state store. As posts expire by the clock, the stream never runs out of work: stop it, or run it batch by
    batch (trigger once). Sightings without an id are left out.
    """
    named = sightings.where(F.col("id").isNotNull() & F.col("seen_ms").isNotNull()).select(*[c.split()[0] for c in SIGHTING.split(", ")])
    return named.groupBy("id").transformWithStateInPandas(_Counters(expiry), CHANGE, "append", "processingTime")


def unread(crawl: DataFrame, archive: DataFrame, streak: int = KNOWN_STREAK) -> DataFrame:
    """The rows of a crawl (feed, place, id: from new to old) that a reader takes before it may end, with is_known.

    It ends with the ``streak``-th known post in a row. Feeds are cut by windows over (feed, place); archive has id.
    """
    known = archive.select(F.col("id").alias("_known")).distinct()
    marked = crawl.join(known, F.col("id") == F.col("_known"), "left").withColumn("is_known", F.col("_known").isNotNull()).drop("_known")
    order = Window.partitionBy("feed").orderBy("place")
    ranked = marked.withColumn("_rank", F.row_number().over(order))
    run = F.col("_rank") - F.coalesce(F.max(F.when(~F.col("is_known"), F.col("_rank"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    ended = ranked.withColumn("_run", run)
    ended = ended.withColumn("_end", F.min(F.when(F.col("_run") >= streak, F.col("_rank"))).over(Window.partitionBy("feed"))).drop("_run")
    return ended.where(F.col("_end").isNull() | (F.col("_rank") <= F.col("_end"))).drop("_rank", "_end")
