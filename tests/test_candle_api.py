"""The paged candle source: overlaps, short and empty pages, failures, eviction, and which pages filters ask for."""

import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.sources.candle_api import PageCache, chunked, read_candles

MINUTE = 60_000


def bar(ts, tag=0.0):
    return (ts, 1.0, 2.0, 0.5, 1.5, tag)


def service(times, asked, most=10**9, overlap=0):
    """Candles at these minutes; at most so many a page, with some before the asked start again."""

    def fetch(symbol, interval, limit, since):
        asked.append((since // MINUTE, limit))
        later = [m for m in times if m * MINUTE >= since][: min(limit, most)]
        earlier = [m for m in times if m * MINUTE < since][-overlap:] if overlap else []
        return [bar(m * MINUTE, len(asked)) for m in reversed(earlier + later)]

    return fetch


def minutes(rows):
    return [r[0] // MINUTE for r in rows]


def test_pages_follow_the_last_candle():
    asked = []
    assert minutes(chunked(service(range(100), asked), "S", "1m", 25, 30_000, page=10)) == list(range(25)) and asked == [(0, 10), (10, 10), (20, 5)]
    asked = []
    assert minutes(chunked(service(range(100), asked, most=4), "S", "1m", 10, 0, page=10)) == list(range(10)) and asked == [(0, 10), (4, 6), (8, 2)]
    asked = []
    assert minutes(chunked(service([0, 1, 2, 50, 51], asked), "S", "1m", 20, 0, page=3)) == [0, 1, 2, 50, 51] and asked[-1] == (52, 3)  # an empty page ends it


def test_the_first_candle_of_a_time_stays():
    rows = chunked(service(range(8), [], most=4, overlap=1), "S", "1m", 30, 0, page=5)
    assert minutes(rows) == list(range(8)) and [r[5] for r in rows][:4] == [1.0] * 4


def test_cache_keeps_open_reads_only():
    asked, cache = [], PageCache(2)
    fetch = service(range(30), asked)
    for _ in range(2):
        assert minutes(chunked(fetch, "S", "1m", 20, 0, page=10, cache=cache)) == list(range(20))
    assert len(asked) == 2
    chunked(fetch, "S", "1m", 10, 20 * MINUTE, page=10, cache=cache)  # the oldest page leaves
    chunked(fetch, "S", "1m", 10, 0, page=10, cache=cache)
    assert len(asked) == 4
    for _ in range(2):
        chunked(fetch, "S", "1m", 10, 0, page=10, until_ms=5 * MINUTE, cache=cache)
    assert len(asked) == 6
    broken = iter([RuntimeError("down"), [bar(0)]])

    def flaky(*request):
        answer = next(broken)
        if isinstance(answer, Exception):
            raise answer
        return answer

    with pytest.raises(RuntimeError):
        chunked(flaky, "T", "1m", 1, 0, cache=cache)
    assert minutes(chunked(flaky, "T", "1m", 1, 0, cache=cache)) == [0]


def test_filters_choose_the_pages(spark, tmp_path):
    folder = str(tmp_path)

    def fetch(symbol, interval, limit, since):
        open(f"{folder}/{symbol}-{since // 60_000}-{uuid.uuid4().hex}", "w").close()
        first = -(-since // 60_000)
        return [(m * 60_000, 1.0, 2.0, 0.5, 1.5, float(m)) for m in range(first, first + limit) if m % 7]

    candles = read_candles(spark, fetch, ["A", "B", "C"], 0, 100 * MINUTE, page=20)
    assert candles.rdd.getNumPartitions() == 15
    got = candles.where((F.col("symbol") == "B") & (F.col("ts_ms") >= 45 * MINUTE) & (F.col("ts_ms") < 60 * MINUTE)).orderBy("ts_ms").collect()
    assert [r["ts_ms"] // MINUTE for r in got] == [m for m in range(45, 60) if m % 7] and {r["symbol"] for r in got} == {"B"}
    assert {os.path.basename(p).split("-")[0] for p in glob.glob(f"{folder}/*")} == {"B"} and min(int(os.path.basename(p).split("-")[1]) for p in glob.glob(f"{folder}/*")) == 40
    every = read_candles(spark, fetch, ["A", "B"], 0, 100 * MINUTE, page=20).groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("ts_ms").alias("d")).collect()
    assert {(r["symbol"], r["n"], r["d"]) for r in every} == {(s, 85, 85) for s in "AB"}
    limited = read_candles(spark, fetch, ["A"], 30 * MINUTE, limit=30, page=20).collect()
    assert len(limited) == 29 and min(r["ts_ms"] for r in limited) == 30 * MINUTE  # the last page asks for minute 63 alone, which is empty
    with pytest.raises(Exception, match="either end_ms or limit"):
        read_candles(spark, fetch, ["A"], 0).collect()
