"""What several operators share: tables written in the shared folder, and components."""

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and the master is local, as in tests, an own one that goes at
    exit. On a cluster the setting must be there: no folder of one machine would do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="auditloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


#: What lasting() has to remove.
_written: ContextVar[list | None] = ContextVar("written", default=None)
#: A run's shuffle files go when it ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting while jobs are started inside; its own one comes back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Stash:
    """A DataFrame written once as Parquet in the shared folder, so that lost executors lose none of it
    and later steps don't compute it again."""

    def __init__(self, df: DataFrame, label: str, partition_by: str | None = None):
        self.spark = df.sparkSession
        app = self.spark.sparkContext.applicationId
        self.path = f"{shared_dir(self.spark)}/auditloom/{app}/{label}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        if (made := _written.get()) is not None:
            made.append(self)
        with setting(self.spark, SHUFFLES_GO, "true"):
            writer.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; only for tables that no lazy result reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, label: str) -> DataFrame:
    return Stash(df, label).df


def lasting(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make()'s result, written; all tables that make() has written go."""
    scope = _written.set(made := [])
    try:
        result = make()
        _written.reset(scope)
        scope = None
        return stash(result, label)
    finally:
        if scope:
            _written.reset(scope)
        for done in made:
            done.drop()


@contextmanager
def freed_memory() -> Iterator[None]:
    """For a task's Python: what has been freed goes back to the machine, at its beginning (what earlier tasks of the same worker left) and at its
    end, for its worker stays beside later stages."""
    _give_back()
    try:
        yield
    finally:
        _give_back()


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside hand Python at most so many rows at a time, for rows that carry long arrays."""
    before = int(spark.conf.get(BATCH_ROWS))
    with setting(spark, BATCH_ROWS, str(rows if before <= 0 else min(rows, before))):
        yield


#: A key of over one in so many rows is hot; so there are fewer hot keys than that.
HOT_SHARE = 1000


def matched(rows: DataFrame, keyed: DataFrame, on: list[str], count_col: str, hashed: bool = False) -> DataFrame:
    """rows joined with keyed, which has one row for each key and in count_col the number of rows with it (or more).

    Rows with hot keys stay where they are and get the hot part of keyed, which has fewer than HOT_SHARE rows whatever
    the data, so no task gets all rows of such a key. The others are shuffled. rows should be a written table: it is read twice.
    hashed: a task holds its part of keyed, which is even, as a hash table in place of sorting both."""
    least = rows.count() / HOT_SHARE
    hot = keyed.where(F.col(count_col) > least)
    if hashed:
        keyed = keyed.hint("shuffle_hash")
    if hot.isEmpty():
        return rows.join(keyed, on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(count_col) <= least), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


#: Bytes of a block of bits.
BLOCK = 1 << 13


class Bits:
    """A set of numbers as bits, by their last `bits` bits: exact for numbers that have no more, else with false positives."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.mask = np.uint64((1 << bits) - 1)
        self.packed = np.zeros(1 << max(bits - 3, 0), np.uint8)
        for block, part in blocks.items():
            self.packed[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(part, np.uint8)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers.astype(np.uint64, copy=False) & self.mask
        return (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bits_of(numbers: DataFrame, col: str, most_bits: int, each: int = 8) -> Bits:
    """`each` bits or more for each number, up to 2 ** most_bits, which bounds what goes to the driver and every task."""
    n = numbers.count()
    bits = min(max(int(np.ceil(np.log2(each * n + 1))), 16), most_bits)
    at = F.col(col).cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))
    places = numbers.select(F.shiftright(at, 16).cast("int").alias("block"), at.bitwiseAND(F.lit(BLOCK * 8 - 1)).cast("int").alias("place")).distinct()

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(BLOCK * 8, np.uint8)
        flags[pdf["place"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "packed": [np.packbits(flags, bitorder="little").tobytes()]})

    packed = places.groupBy("block").applyInPandas(pack, "block int, packed binary").collect()  # a group has 65,536 rows at most
    return Bits(bits, {r["block"]: bytes(r["packed"]) for r in packed})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that links reach.

    Alternating large and small stars: each round links a node's larger neighbours, then its smaller ones,
    to the smallest of them, until every link goes to a node that links to none; the rounds grow with the logarithm of the nodes. A hub's
    minimum is aggregated before the shuffle and comes back by a join, which adaptive execution splits when
    it is skewed. Rounds are written in the shared folder. Null ends and a = b are no links; a pair may repeat.
    """

    def star(links: DataFrame, smallest: DataFrame) -> DataFrame:
        return links.join(smallest, "a")

    def tidy(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    def settled(links: DataFrame) -> bool:
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down > 0 and up > 0").isEmpty()

    now = Stash(tidy(edges.select("a", "b")), "links")
    while not settled(now.df):
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = star(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # as many rows as links, repeats included
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = star(large, low).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.select("a", F.col("m").alias("b"))
        after = Stash(tidy(small.unionByName(own)), "links")
        now.drop()
        now = after
    # now each link goes from a node to the smallest node of its component
    tops = now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
