"""Exact dedup against grouping in Python, with tables so small that levels of spilling are needed."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from auditloom.llm import queries
from auditloom.llm.exact_dedup import ContentTable, drop_copies, group_copies

SCHEMA = "doc_id long, text string, lang string, keep_id string"


def expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    return {text: (max((i for i in ids if i is not None), default=None), len(ids)) for text, ids in groups.items()}


def test_table_compares_content():
    table = ContentTable(1 << 20)
    a, new = table.entry(5, b"x")
    assert new and table.entry(5, b"y") == (1, True) and table.entry(5, b"x") == (a, False)
    for i in range(5000):
        table.entry(7, str(i).encode())
    assert table.entry(7, b"4321")[1] is False


def test_grace_levels(spark):
    random.seed(3)
    rows = [(i if i % 50 else None, random.choice(["", None, "hot " * 20, f"text {random.randrange(60)} " * random.randrange(1, 9)]), "en", "clash") for i in range(400)] + [(7, "same", "a", "b"), (7, "same", "c", "d")]
    want = expected(rows)
    got = group_copies(spark.createDataFrame(rows, SCHEMA), table_bytes=600).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    kept = {}
    for r in got:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(want)


def test_drop_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "en", "k"), (2, "a", "en", "k"), (3, "a", "de", "l"), (None, "a", None, None)], SCHEMA)
    out = drop_copies(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, None, "en", "k"), (3, "a", "de", "l")]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert group_copies(df).count() == 0 and drop_copies(df).count() == 0


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.op10_exact_dedup(spark, sf_dir)
    rel = con.sql(queries.OP10_SQL)
    assert sorted(tuple(r) for r in got.collect()) == sorted(rel.fetchall()) and got.columns == rel.columns


def test_very_long_text(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long "), 300_000).alias("text"))
    assert [r.group_size for r in group_copies(df, table_bytes=1000).collect()] == [3, 3, 3]
