"""Rate windows of keys that lie in many blocks, against a plain scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.streaming import limits, windows


def plainly(rows, length):
    """(key, ident) -> the request's number in its window."""
    out, state = {}, {}
    for key, ms, ident in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1], r[2])):
        ends, n = state.get(key, (None, 0))
        ends, n = (ms + length, 1) if ends is None or ms > ends else (ends, n + 1)
        state[key], out[key, ident] = (ends, n), n
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, ms bigint, id bigint").withColumn("ts", F.timestamp_millis("ms"))


@pytest.mark.parametrize(("block", "length"), [(7, 40), (64, 5), (50, 100_000), (33, 0), (1 << 17, 90)])
def test_blocks_by_plain_scan(spark, block, length):
    r = np.random.default_rng(block)
    sizes = {"busy": 1500, None: 130, "b": 40, "c": 1, "z": 300, **{f"k{i}": 3 for i in range(40)}}
    times = {k: np.sort(r.integers(0, 20 * n if k != "z" else 30, n)) for k, n in sizes.items()}  # z: many at one time
    rows = [(k, int(t), i) for k, ts in times.items() for i, t in enumerate(ts)]
    r.shuffle(rows)
    got = windows.anchored_counts(frame(spark, rows), "key", "ts", "id", length, block).collect()
    assert {(g.key, g.ident): g["count"] for g in got} == plainly(rows, length) and len(got) == len(rows)


def test_jumps_and_counts():
    ms = np.array([0, 1, 5, 6, 7, 20, 21, 40])
    following, last = windows.jumps(ms, 5)
    assert following.tolist() == [3, 4, 5, 5, 5, 7, 7, 8] and set(last.tolist()) == {7}
    assert windows.counted(ms, 5).tolist() == [1, 2, 3, 1, 2, 1, 2, 1]
    assert windows.counted(ms, 5, ends=5, before=10).tolist() == [11, 12, 13, 1, 2, 1, 2, 1]


def test_one_busy_key(spark):
    """A million requests of one key: all tasks take part, no group holds more than a few blocks."""
    n, length = 1_000_000, 60_000
    df = spark.range(n, numPartitions=8).select(F.lit("k").alias("key"), (F.col("id") * 37 + F.pmod(F.xxhash64("id"), F.lit(30))).alias("ms"), "id").withColumn("ts", F.timestamp_millis("ms"))
    got = windows.anchored_counts(df, "key", "ts", "id", length, 1 << 14).toPandas().sort_values("ident")
    ms = df.orderBy("id").toPandas()["ms"].to_numpy()
    order = np.lexsort((np.arange(n), ms))
    expected, ends, count = np.empty(n, np.int64), -1, 0
    for i in order.tolist():
        if ends < 0 or ms[i] > ends:
            ends, count = ms[i] + length, 0
        count += 1
        expected[i] = count
    assert (got["count"].to_numpy() == expected).all()


def test_rate_limit_of_repeated_rows_and_no_times(spark):
    rows = [("a", 5, 1)] * 4 + [("a", 6, 2)]
    df = frame(spark, rows).withColumn("when", F.lit("x")).unionByName(frame(spark, [("a", 0, 9)]).withColumn("ts", F.lit(None).cast("timestamp")).withColumn("when", F.lit("x")))
    got = limits.rate_limit(df, 3, "key", "ts", "id").collect()
    assert sorted(r["count"] for r in got) == [1, 2, 3, 4, 5] and sum(r.allowed for r in got) == 3
