"""Exact deduplication: Grace hash partitioning with open-addressing tables on complete texts."""

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import Stash

TABLE_BYTES = 48 << 20


class ContentTable:
    """Open addressing with linear probing. Slots hold entry numbers; a hash only says where to look,
    equality is decided on the whole content."""

    def __init__(self, byte_limit: int):
        self.byte_limit = byte_limit
        self.clear()

    def clear(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.mask = 1023
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.used_bytes = 0

    def entry(self, h: int, text: bytes, may_add: bool = True) -> tuple[int, bool]:
        """(entry number, whether it is new); number -1 if the text is absent and there's no room for it.
        One text always fits, whatever its length, so that every level gets on."""
        at = h & self.mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.texts[e] == text:
                return e, False
            at = (at + 1) & self.mask
        size = len(text) + 160
        if not may_add or (self.texts and self.used_bytes + size > self.byte_limit):
            return -1, False
        self.slots[at] = e = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.used_bytes += size
        if 2 * len(self.texts) > self.mask:
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.mask = 4 * (self.mask + 1) - 1
        self.slots = array("q", [-1]) * (self.mask + 1)
        for e, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = e


def _better(a: tuple, b: tuple) -> bool:
    """Of (id, row): the larger id wins, null is the least; then the smaller row."""
    if a[0] == b[0]:
        return a[1] < b[1]
    return b[0] is None or (a[0] is not None and a[0] > b[0])


def _collapse(schema: pa.Schema, byte_limit: int):
    """Map side: equal texts that one task reads become one representative, so a text that fills a third of
    the table reaches its bucket once per full map-side table and not once per row."""

    def reps(table: ContentTable, first: list, best: list, count: list) -> pa.RecordBatch:
        n = len(table.texts)
        cols = {"_rep": first, "_h": table.hashes, "_text": table.texts, "_best_id": [b[0] for b in best], "_best_row": [b[1] for b in best], "_n": count}
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(byte_limit)
        first, best, count = [], [], []
        for batch in batches:
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            belongs = []
            for row, key, h, text in zip(get["_row"].to_pylist(), get["_id"].to_pylist(), get["_h"].to_pylist(), get["_text"], strict=True):
                text = text.as_buffer().to_pybytes()
                e, new = table.entry(h, text)
                if e < 0:
                    yield reps(table, first, best, count)
                    table.clear()
                    first, best, count = [], [], []
                    e, new = table.entry(h, text)
                if new:
                    first.append(row)
                    best.append((key, row))
                    count.append(1)
                else:
                    count[e] += 1
                    if _better((key, row), best[e]):
                        best[e] = (key, row)
                belongs.append(first[e])
            own = {"_row": get["_row"], "_payload": get["_payload"], "_null": get["_null"], "_rep": pa.array(belongs, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(len(belongs), f.type) for f in schema], schema=schema)
        if table.texts:
            yield reps(table, first, best, count)

    return run


def _bucket(schema: pa.Schema, byte_limit: int):
    """One bucket: what the table has room for is grouped; the rest is spilled for the next level. A text is
    either in the table from its first record on, or all of its records are spilled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(byte_limit)
        members, best, count = [], [], []
        full = False
        for batch in batches:
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            spilled = []
            for i, (rep, key, row, n, h, text) in enumerate(zip(*(get[c].to_pylist() for c in ("_rep", "_best_id", "_best_row", "_n", "_h")), get["_text"], strict=True)):
                e, new = table.entry(h, text.as_buffer().to_pybytes(), not full)
                if e < 0:
                    full = True
                    spilled.append(i)
                elif new:
                    members.append([rep])
                    best.append((key, row))
                    count.append(n)
                else:
                    members[e].append(rep)
                    count[e] += n
                    if _better((key, row), best[e]):
                        best[e] = (key, row)
            if spilled:
                left = batch.take(pa.array(spilled, pa.int64()))
                got = {name: left.column(i) for i, name in enumerate(left.schema.names)} | {"_spilled": pa.array([True] * len(spilled))}
                yield pa.RecordBatch.from_arrays([got[f.name].cast(f.type) if f.name in got else pa.nulls(len(spilled), f.type) for f in schema], schema=schema)
        for lo in range(0, len(members), 8192):
            out = {f.name: [] for f in schema}
            for e in range(lo, min(lo + 8192, len(members))):
                sha = hashlib.sha256(table.texts[e]).hexdigest()
                for rep in members[e]:
                    for name, v in (("_rep", rep), ("_keep_id", best[e][0]), ("_keep_row", best[e][1]), ("_size", count[e]), ("_sha", sha), ("_spilled", False)):
                        out[name].append(v)
            n = len(out["_rep"])
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if out[f.name] else pa.nulls(n, f.type) for f in schema], schema=schema)

    return run


def _grace(docs: DataFrame, id_col: str, text_col: str, table_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, representatives' texts, groups), all read from tables in the shared folder."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*rest).alias("_payload"),
        F.col(id_col).alias("_id"),
        F.col(text_col).isNull().alias("_null"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    ).withColumn("_h", F.xxhash64("_text"))
    rep = [T.StructField("_rep", T.LongType()), T.StructField("_h", T.LongType()), T.StructField("_text", T.StringType()), T.StructField("_best_id", kind), T.StructField("_best_row", T.LongType()), T.StructField("_n", T.LongType())]
    level0 = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_payload", rows.schema["_payload"].dataType), T.StructField("_null", T.BooleanType()), *rep])
    collapsed = Stash(rows.mapInArrow(_collapse(to_arrow_schema(level0), table_bytes), level0), "grace0").df
    members = collapsed.where("_row is not null").select("_row", "_payload", "_null", "_rep")
    texts = collapsed.where("_row is null").select(*(f.name for f in rep))
    out = T.StructType([*rep, T.StructField("_keep_id", kind), T.StructField("_keep_row", T.LongType()), T.StructField("_size", T.LongType()), T.StructField("_sha", T.StringType()), T.StructField("_spilled", T.BooleanType())])
    todo, groups, level = texts, [], 0
    while True:
        size = todo.agg(F.sum(F.octet_length("_text") + F.lit(160)), F.max("_h")).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * size // table_bytes))
        dealt = todo.repartition(parts, F.xxhash64(F.col("_h"), F.lit(level)))
        done = Stash(dealt.mapInArrow(_bucket(to_arrow_schema(out), table_bytes), out), "grace", "_spilled").df
        groups.append(done.where("not _spilled").select("_rep", "_keep_id", "_keep_row", "_size", "_sha"))
        todo, level = done.where("_spilled").select(*(f.name for f in rep)), level + 1
        if todo.isEmpty():
            break
    all_groups = groups[0]
    for more in groups[1:]:
        all_groups = all_groups.unionByName(more)
    return members, texts, all_groups


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Every row of docs with all its columns but the text, and keep_id, group_size, kept, text_sha256.

    Rows whose texts are identical form a group; the row with the largest id stays (null ids are the least;
    rows with the same largest id: one of them stays). A null text counts as empty. Repeated rows are members
    like any other; an empty table gives an empty result. Columns of docs that clash with the four added
    ones are replaced by them.

    Grace hash: each map task collapses the copies that it reads; the representatives, with their complete
    texts, are dealt into buckets by hash; a bucket's task fills an open-addressing table of at most
    table_bytes and spills the texts that found no room to a table in the shared folder, which the next level
    deals out by another hash, until nothing is spilled.
    """
    members, _, groups = _grace(docs, id_col, text_col, table_bytes)
    added = ("keep_id", "group_size", "kept", "text_sha256")
    plain = [F.col(f"_payload.`{c}`").alias(c) for c in docs.columns if c != text_col and c not in added]
    return members.join(groups, "_rep").select(
        *plain,
        F.col("_keep_id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_keep_row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that group_copies() keeps, with the columns of docs."""
    members, texts, groups = _grace(docs, id_col, text_col, table_bytes)
    kept = members.join(groups.select("_rep", "_keep_row"), "_rep").where("_row = _keep_row")
    text = F.when(~F.col("_null"), F.col("_text")).alias(text_col)
    return kept.join(texts.select("_rep", "_text"), "_rep").select(*(text if c == text_col else F.col(f"_payload.`{c}`").alias(c) for c in docs.columns))
