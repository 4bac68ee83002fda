import json

from tidemark.streaming import archive
from tidemark.streaming.drift import drift_stream


def test_stream_alarm_equals_the_recurrence(spark, tmp_path):
    folder, level, peak = tmp_path / "in", 0.0, 0.0
    rows = [("m", f"2024-01-01 00:{i:02d}:00", 0.5 if i < 10 else -3.0) for i in range(20)]
    spark.createDataFrame(rows, "model string, ts string, pnl double").selectExpr("model", "to_timestamp(ts) AS ts", "pnl").coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema("model string, ts timestamp, pnl double").parquet(str(folder))
    job = drift_stream(stream, 0.0, 1.0).writeStream.outputMode("update").format("memory").queryName("drift").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    for _, _, pnl in rows:
        level = max(0.0, level - pnl - 0.5)
        peak = max(peak, level)
    row = spark.table("drift").first()
    assert (row["trades"], row["peak"], row["alarm"]) == (20, peak, True)


def test_archive_tells_changes_only(spark, tmp_path):
    """Late, changed and repeated sightings: a row when a post is new or its counters differ, none else."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        feed = tmp_path / "feed"
        feed.mkdir()
        batches = [
            [("a", 10, 1, 0, 5), ("b", 10, 0, 0, None), ("a", 12, 1, 0, 5), (None, 11, 1, 1, 1)],
            [("a", 20, 2, 0, 5), ("a", 15, 9, 9, 9), ("b", 20, 0, 0, None), ("c", 3, 0, 0, 1)],  # the second sighting of a comes after the first in the file only
            [("a", 18, 7, 7, 7), ("c", 30, 0, 0, 2), ("c", 31, 0, 0, 1)],  # a's is older than what is known
        ]
        found = archive.changes(spark.readStream.schema(archive.SIGHTING).json(str(feed)))
        for k, rows in enumerate(batches):
            (feed / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("id", "seen_ms", "likes", "comments", "views"), r))) for r in rows))
            found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination(60)
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: (r[0], r[1]))
        assert got == [
            ("a", 10, 10, True, 1, 0, 5), ("a", 15, 10, False, 9, 9, 9), ("a", 20, 10, False, 2, 0, 5), ("b", 10, 10, True, 0, 0, None),
            ("c", 3, 3, True, 0, 0, 1), ("c", 30, 3, False, 0, 0, 2), ("c", 31, 3, False, 0, 0, 1),
        ]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_crawl_ends_after_a_run_of_known_posts(spark):
    feeds = {"s": [1, 2, 900, 3, 4, 5, 901, 6], "t": [902, 903], "u": [1, 2, 3, 4]}
    crawl = spark.createDataFrame([(f, k, str(i)) for f, ids in feeds.items() for k, i in enumerate(ids)], "feed string, place int, id string")
    known = spark.createDataFrame([(str(i),) for i in range(100)] * 2, "id string")
    got = {}
    for r in archive.unread(crawl, known, 3).orderBy("feed", "place").collect():
        got.setdefault(r["feed"], []).append((int(r["id"]), r["is_known"]))
    assert got == {"s": [(i, i < 100) for i in feeds["s"][:6]], "t": [(902, False), (903, False)], "u": [(1, True), (2, True), (3, True)]}
