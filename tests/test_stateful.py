"""Streams with state and timers, stopped and started again, and tables that streams update."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.streaming import change_log, limits, stateful


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stateful.ROCKSDB)
    yield
    spark.conf.set(name, before)


def put(folder, number, rows):
    """A file of JSON rows, later than those before it."""
    folder.mkdir(exist_ok=True)
    path = folder / f"{number:03}.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def run(spark, folder, schema, made, out, checkpoint, once=False):
    """Takes what is there, a file a batch (or all in one), and stops."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 9 if once else 1).json(str(folder))
    query = made(source).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(**({"once": True} if once else {"availableNow": True})).start()
    assert query.awaitTermination(90)
    assert query.exception() is None
    return spark.read.parquet(str(out))


def test_rate_limit_stopped_and_restarted(spark, tmp_path, rocksdb):
    r = np.random.default_rng(0)
    times = np.sort(r.integers(0, 600_000, 400))
    rows = [{"user": f"u{r.integers(0, 4)}", "ts": int(t), "id": i} for i, t in enumerate(times)]
    schema = "user string, ts bigint, id bigint"

    def made(events):
        return stateful.rate_limit_stream(events.withColumn("ts", F.timestamp_millis("ts")), 5, "user", "ts", "id")

    paths = tmp_path / "in", schema, made, tmp_path / "out", tmp_path / "cp"
    for n in range(2):
        put(tmp_path / "in", n, rows[100 * n : 100 * (n + 1)])
    assert run(spark, *paths).count() == 200
    for n in range(2, 4):  # the third file begins within windows that the second one opened
        put(tmp_path / "in", n, rows[100 * n : 100 * (n + 1)])
    got = run(spark, *paths)
    batch = limits.rate_limit(spark.createDataFrame([(x["user"], x["ts"], x["id"]) for x in rows], schema).withColumn("ts", F.timestamp_millis("ts")), 5, "user", "ts", "id")
    assert sorted(map(tuple, got.select("key", "ident", "count", "allowed").collect())) == sorted(map(tuple, batch.collect()))


def test_a_reminder_fires_once(spark, tmp_path, rocksdb):
    minute, begin = 60_000, 1_700_000_000_000
    schema = "id string, status string, reminded boolean, at bigint"

    def order(ident, status, minutes, reminded=False):
        return {"id": ident, "status": status, "reminded": reminded, "at": begin + minutes * minute}

    def made(orders):
        return stateful.reminders_stream(orders.withColumn("at", F.timestamp_millis("at")), 10, days=1)

    paths = tmp_path / "in", schema, made, tmp_path / "out", tmp_path / "cp"
    put(tmp_path / "in", 0, [order("waits", "needs_url", 0), order("told", "needs_url", 0), order("ready", "ready", 0), order("done", "needs_url", 0, True)])
    put(tmp_path / "in", 1, [order("told", "processing", 5), order("late", "needs_url", 9)])
    assert run(spark, *paths).count() == 0
    put(tmp_path / "in", 2, [order("other", "ready", 14)])  # the watermark passes the first order's ten minutes
    put(tmp_path / "in", 3, [order("other", "ready", 15)])
    assert {r.id for r in run(spark, *paths).collect()} == {"waits"}
    put(tmp_path / "in", 4, [order("waits", "needs_url", 16), order("late", "ready", 17)])
    put(tmp_path / "in", 5, [order("other", "ready", 60)])
    put(tmp_path / "in", 6, [order("other", "ready", 61)])
    got = run(spark, *paths).collect()
    assert [(r.id, r.since_ms, r.due_ms) for r in got] == [("waits", begin, begin + 10 * minute + 1)]


def test_first_only(spark, tmp_path, rocksdb):
    """Time to live is the machine's time, for which a stream goes on without data; so each run is one batch."""
    paths = tmp_path / "in", "session string, n bigint", lambda e: stateful.first_only(e, "session"), tmp_path / "out", tmp_path / "cp"
    put(tmp_path / "in", 0, [{"session": s, "n": n} for n, s in enumerate("xyxx")])
    run(spark, *paths, once=True)
    put(tmp_path / "in", 1, [{"session": s, "n": 9} for s in "xzz"])
    assert sorted(r.session for r in run(spark, *paths, once=True).collect()) == ["x", "y", "z"]


CHANGES = "id string, ord int, is_insert boolean, email string, report string, error string"


def log_of(spark, tmp_path):
    schema = spark.createDataFrame([], CHANGES).schema
    return change_log.ChangeLog(spark, f"file://{tmp_path}/table", schema, "id", "ord", ["email", "report"], ["error"])


def test_batches_that_are_replayed(spark, tmp_path):
    log = log_of(spark, tmp_path)
    assert log.rows().count() == 0
    one = [("a", 1, True, "a@a.com", None, "e"), ("b", 2, True, "b@b.com", None, None), ("x", 3, False, None, "no such lead", None), ("a", 4, True, "again@a.com", "r0", None)]
    two = [("a", 1, False, None, "r1", None), ("x", 2, True, "x@x.com", None, None), ("b", 3, False, None, None, "late")]
    frames = [spark.createDataFrame(rows, CHANGES) for rows in (one, two)]
    assert log.append(frames[0], 0) and not log.append(frames[1], 0)
    assert log.append(frames[1], 1)

    def now(from_log):
        return {r.id: (r.email, r.report, r.error) for r in from_log.rows().collect()}

    expected = {"a": ("a@a.com", "r1", None), "b": ("b@b.com", None, "late"), "x": ("x@x.com", None, None)}
    assert now(log) == expected
    log.compact()
    log.compact()
    assert now(log) == expected and not log.append(frames[0], 1)
    log.drop_old()
    assert now(log) == expected and log._complete("log") == [] and not log.append(frames[0], 0)
    assert log.append(spark.createDataFrame([("a", 1, False, None, "r2", "e2")], CHANGES), 2)
    assert now(log) == expected | {"a": ("a@a.com", "r2", "e2")}


def test_a_write_that_was_cut_off_is_replaced(spark, tmp_path):
    log = log_of(spark, tmp_path)
    log.append(spark.createDataFrame([("a", 1, True, "half", None, None)], CHANGES), 0)
    os.remove(tmp_path / "table/log/batch=0/_SUCCESS")
    assert log.rows().count() == 0
    assert log.append(spark.createDataFrame([("a", 1, True, "whole", None, None)], CHANGES), 0)
    assert [r.email for r in log.rows().collect()] == ["whole"]


def test_stream_into_the_log(spark, tmp_path):
    """A stream whose last batch runs again, as after a failure between writing and committing it."""
    log = log_of(spark, tmp_path)

    def go():
        source = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        log.writer(source, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)

    for n in range(3):
        put(tmp_path / "in", n, [{"id": "a", "ord": 1, "is_insert": n == 0, "report": f"r{n}"}])
    go()
    before = sorted(map(tuple, log.rows().collect()))
    os.remove(tmp_path / "cp/commits/2")
    (tmp_path / "cp/commits/.2.crc").unlink(missing_ok=True)
    go()
    assert before == sorted(map(tuple, log.rows().collect())) == [("a", None, "r2", None)] and log._complete("log") == [0, 1, 2]


def test_form_jobs(spark):
    bodies = ['{"id":"1","form_name":"kit-x","a":1}', '{"id":"2","form_name":""}', '{"id":"3","form_name":null}', '{"id":""}', "[1]", "{bad", None, '{"form_name":"y"}']
    got = {r.id: r for r in change_log.form_jobs(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()}
    assert {i: r.kit_type for i, r in got.items()} == {"1": "kit-x", "2": "amazon-visibility-kit", "3": "amazon-visibility-kit"}
    assert got["1"].payload == bodies[0] and got["1"].status == "received"
