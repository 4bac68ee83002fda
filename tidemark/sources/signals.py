"""Posted signals: normalisation of raw rows, and the adapter over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNAL_COLUMNS = ("seq", "id", "channel", "symbol", "direction", "ts_ms", "entry_from", "entry_to")

#: The adapter in SQL, shared by all comparisons: WITH {SIGNALS_SQL} SELECT ... FROM sig.
SIGNALS_SQL = """sig AS MATERIALIZED (
  SELECT event_id AS seq, event_id::VARCHAR AS id, 'ch' || (user_id % 12) AS channel, event_type AS symbol,
         CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction, epoch_us(ts) // 1000 AS ts_ms,
         CASE WHEN event_id % 3 = 0 THEN value * 0.98::DOUBLE END AS entry_from,
         CASE WHEN event_id % 3 = 0 THEN value * 1.02::DOUBLE END AS entry_to
  FROM events)"""

#: The same feed with echoes: four channels are repeated by others a minute or two later. WITH {ECHOES_SQL} ... FROM sig.
ECHOED = ("ch0", "ch1", "ch2", "ch3")
ECHOES_SQL = SIGNALS_SQL.replace("sig AS", "sig0 AS", 1) + f""",
sig AS MATERIALIZED (SELECT * FROM sig0 UNION ALL
  SELECT seq + 10000000000, 'e' || id, 'x' || channel, symbol, direction, ts_ms + 60000 + seq % 5 * 20000, entry_from, entry_to FROM sig0 WHERE channel IN {ECHOED})"""


def raw_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows as a feed would bring them, seen through the events table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    zone = F.col("event_id") % 3 == 0
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("ch"), (F.col("user_id") % 12).cast("string")).alias("channel"),
        F.col("event_type").alias("symbol"),
        F.when(F.col("event_id") % 2 == 0, "long").otherwise("short").alias("direction"),
        F.expr("unix_micros(cast(ts AS timestamp)) div 1000").alias("ts_ms"),
        F.when(zone, F.col("value") * F.lit(0.98)).alias("entry_from"),
        F.when(zone, F.col("value") * F.lit(1.02)).alias("entry_to"),
    )


def normalize(raw: DataFrame) -> DataFrame:
    """Rows with channel, symbol, a known direction and a time; ids as text; prices that aren't numbers become null.

    ``seq`` is the order of ingestion and breaks ties of time everywhere. Other columns are left out.
    """
    price = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c))
    return raw.where(
        F.col("channel").isNotNull() & F.col("symbol").isNotNull() & F.col("direction").isin("long", "short") & F.col("ts_ms").isNotNull()
    ).select(
        "seq", F.col("id").cast("string").alias("id"), "channel", "symbol", "direction", F.col("ts_ms").cast("long").alias("ts_ms"),
        price("entry_from").alias("entry_from"), price("entry_to").alias("entry_to"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(raw_signals(spark, sf_dir))


def echoed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter's feed and, for what is learned from echoes, channels that repeat some of its channels."""
    rows = signals(spark, sf_dir)
    echo = rows.where(F.col("channel").isin(*ECHOED)).withColumns({
        "id": F.concat(F.lit("e"), "id"), "channel": F.concat(F.lit("x"), "channel"), "ts_ms": F.col("ts_ms") + 60_000 + F.col("seq") % 5 * 20_000, "seq": F.col("seq") + 10_000_000_000,
    })
    return rows.union(echo.select(rows.columns))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines feed with the raw columns; rows of a file keep their order through the file position."""
    schema = "id string, channel string, symbol string, direction string, ts long, entryFromPrice double, entryToPrice double"
    feed = spark.read.schema(schema).json(path)
    return feed.select(
        F.monotonically_increasing_id().alias("seq"), "id", "channel", "symbol", "direction", F.col("ts").alias("ts_ms"),
        F.col("entryFromPrice").alias("entry_from"), F.col("entryToPrice").alias("entry_to"),
    )


def exchange_symbol(column: str, quote: str = "USDT") -> F.Column:
    """The traded pair that a posted symbol means: without exchange prefix and suffixes, quoted in ``quote``; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(F.col(column)), r"^[A-Z0-9_]+:", ""), r"\.P$|PERP$", "")
    base = F.regexp_extract(bare, r"^([A-Z0-9]+?)(?:USDT|USDC|USD|BUSD)$", 1)
    fiat = ["EUR", "GBP", "JPY", "AUD", "CAD", "CHF", "NZD", "TRY", "BRL"]
    return F.when((base != "") & ~base.isin(fiat), F.concat(base, F.lit(quote)))
