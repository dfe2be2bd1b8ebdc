"""Limits and idempotent consumption, as streams over files."""

import json

from pyspark.sql import functions as F

from auditloom.streaming import limits


def test_window_edge(spark):
    rows = [("k", i, ms) for i, ms in enumerate((0, 10, 60_000, 60_001, 60_002))]
    df = spark.createDataFrame(rows, "key string, id int, ms bigint").withColumn("ts", F.timestamp_millis("ms"))
    got = {r.ident: (r["count"], r.allowed) for r in limits.rate_limit(df, 2, "key", "ts", "id").collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (3, False), 3: (1, True), 4: (2, True)}


def test_null_key_and_empty(spark):
    df = spark.createDataFrame([(None, 1, 0), (None, 2, 5)], "key string, id int, ms bigint").withColumn("ts", F.timestamp_millis("ms"))
    assert sorted(r["count"] for r in limits.rate_limit(df, 1, "key", "ts", "id").collect()) == [1, 2]
    assert limits.rate_limit(df.limit(0), 1, "key", "ts", "id").count() == 0


def test_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"session": s, "ts": "2024-01-01T00:00:00Z"}) for s in ("x", "y", "x")))
    events = spark.readStream.schema("session string, ts timestamp").json(str(source))
    query = limits.once(events, "session", "ts").writeStream.format("memory").queryName("taken").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert sorted(r.session for r in spark.table("taken").collect()) == ["x", "y"]


def test_reminders(spark):
    df = spark.createDataFrame([("a", "needs_url", "2024-01-01 00:00:00", False), ("b", "needs_url", "2024-01-01 00:05:01", False), ("c", "ready", "2024-01-01 00:00:00", False), ("d", "needs_url", "2024-01-01 00:00:00", True)], "id string, status string, created_at string, reminded boolean")
    df = df.withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert [r.id for r in limits.reminders(df, F.lit("2024-01-01 00:10:01").cast("timestamp")).collect()] == ["a"]
