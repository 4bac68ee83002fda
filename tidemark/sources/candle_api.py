"""Candles of a paged service as a Spark data source: pages are partitions, filters choose them, open reads are cached.

The service is a function ``fetch(symbol, interval, limit, since_ms)`` that returns up to ``limit`` candles (ts_ms, open,
high, low, close, volume) from ``since_ms`` on, in any order. It runs in the tasks. A read with an end is closed: its span
is cut into windows of ``page`` candles, each a partition, and filters on symbol and time leave out windows before anything
is asked for. A read without an end is open: ``limit`` candles per symbol, page after page, as each page tells where the
next one begins; only these pages are kept in the worker's cache.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .candles import step_ms

Candle = tuple[int, float, float, float, float, float]
Fetch = Callable[[str, str, int, int], Iterable[Candle]]
SCHEMA = "symbol string, ts_ms long, open double, high double, low double, close double, volume double"
#: Candles of a request, and pages that a worker keeps (fixed values).
PAGE, CAPACITY = 500, 512


class PageCache:
    """Pages by request, the oldest leaving first. What fails is not kept, nor are requests with an end."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.pages = capacity, OrderedDict()

    def get(self, key: tuple, ask: Callable[[], Iterable[Candle]], closed: bool) -> list[Candle]:
        if closed:
            return list(ask())
        if key not in self.pages:
            page = list(ask())
            while len(self.pages) >= self.capacity:
                self.pages.popitem(last=False)
            self.pages[key] = page
        return self.pages[key]


_CACHE = PageCache()


def chunked(fetch: Fetch, symbol: str, interval: str, limit: int, since_ms: int, page: int = PAGE, until_ms: int | None = None, cache: PageCache | None = None) -> list[Candle]:
    """Up to ``limit`` candles from the aligned start on, in order, the first of each time; before ``until_ms`` if given.

    A page that is short moves on from its last candle, so nothing between pages is lost; an empty one is the end.
    """
    step = step_ms(interval)
    at, found = since_ms - since_ms % step, {}
    left = limit
    while left > 0 and (until_ms is None or at < until_ms):
        asked, start = min(left, page), at
        ask = lambda asked=asked, start=start: fetch(symbol, interval, asked, start)
        rows = (cache or PageCache(0)).get((symbol, interval, asked, start), ask, cache is None or until_ms is not None)
        if not rows:
            break
        for row in rows:
            if until_ms is None or row[0] < until_ms:
                found.setdefault(row[0], row)
        left -= len(rows)
        at = max(at, *(r[0] for r in rows)) + step
    return [found[t] for t in sorted(found)]


@dataclass
class Page(InputPartition):
    symbol: str
    since_ms: int
    limit: int
    until_ms: int | None


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, options: dict[str, str]):
        self.fetch, self.interval = fetch, options.get("interval", "1m")
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]
        self.start, self.page = int(options["start_ms"]), int(options.get("page", PAGE))
        self.end = int(options["end_ms"]) if "end_ms" in options else None
        self.limit = int(options["limit"]) if "limit" in options else None
        if (self.end is None) == (self.limit is None):
            raise ValueError("a read has either end_ms or limit")
        self.low, self.high = self.start, self.end

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Symbols and bounds of time choose what is asked for; Spark still checks all but those on the symbol."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = [s for s in self.symbols if s in wanted]
                continue
            if f.attribute == ("ts_ms",) and self.end is not None if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)) else False:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            yield f

    def partitions(self) -> list[Page]:
        step = step_ms(self.interval)
        if self.end is None:
            return [Page(s, self.start, self.limit, None) for s in self.symbols]
        width, first = self.page * step, self.start - self.start % step
        # Windows keep their places whatever the filters, so that equal pages are equal requests.
        numbers = range(max(0, (self.low - first) // width), max(0, -(-(self.high - first) // width)))
        return [Page(s, first + k * width, self.page, min(first + (k + 1) * width, self.end)) for s in self.symbols for k in numbers]

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in chunked(self.fetch, partition.symbol, self.interval, partition.limit, partition.since_ms, self.page, partition.until_ms, _CACHE):
            yield (partition.symbol, *row)


def candle_source(fetch: Fetch, name: str = "candle_api") -> type[DataSource]:
    """A data source class around a service, to be registered under its name."""

    class CandleApi(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, dict(self.options))

    return CandleApi


def read_candles(spark: SparkSession, fetch: Fetch, symbols: list[str], start_ms: int, end_ms: int | None = None, limit: int | None = None, interval: str = "1m", page: int = PAGE) -> DataFrame:
    """Candles of the service: all between start and end (excluded), or ``limit`` of each symbol from the start on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(candle_source(fetch))
    reader = spark.read.format("candle_api").option("symbols", ",".join(symbols)).option("start_ms", str(start_ms)).option("interval", interval).option("page", str(page))
    for key, value in (("end_ms", end_ms), ("limit", limit)):
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load()
