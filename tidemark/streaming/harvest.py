"""A feed folder as a stream: new JSON-lines files, each post once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, channel string, symbol string, direction string, ts long, entryFromPrice double, entryToPrice double"


def harvest(spark: SparkSession, path: str, delay: str = "2 days") -> DataFrame:
    """Valid posts of the folder's files, without repeats that come within the delay.

    Repeats have one id; posts without an id are told apart by channel, symbol, direction and time.
    """
    posts = spark.readStream.schema(SCHEMA).json(path).where(F.col("direction").isin("long", "short") & F.col("channel").isNotNull() & F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    return posts.withColumn("at", F.timestamp_millis("ts")).withColumn("_post", F.coalesce(F.concat(F.lit("id:"), "id"), F.to_json(F.struct("channel", "symbol", "direction", "ts")))).withWatermark("at", delay).dropDuplicatesWithinWatermark(["_post"]).drop("_post")
