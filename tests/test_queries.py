"""Every registered query of the core runs; those with a SQL twin give the same rows as DuckDB."""

import decimal

import duckdb
import pytest

from auditloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", registry.queries())
def test_query(name, spark, sf_dir, duck):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bundle_walks_structured_data_once(spark, sf_dir, monkeypatch):
    """The rows about persons come from the nodes that the facts have; before, the pages were walked again."""
    from auditloom.operators import jsonld

    walked, with_nodes = [], jsonld.with_nodes
    monkeypatch.setattr(jsonld, "with_nodes", lambda pages: walked.append(1) or with_nodes(pages))
    assert registry.queries()["bundle_issues"](spark, sf_dir).where("rule = 'person_schema_thin'").count() > 0
    assert len(walked) == 1


def test_bio_without_words(spark, tmp_path):
    """A text without a word has an empty bio, a null text none; before, both were null."""
    texts = [None, "", " ", "\t\n ", "\u00a0\ufeff", "\u200b", "\x00", " one\ttwo ", "w " * 60, "a" * 399 + " b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.queries()["clean_bio"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.oracle_sql()["clean_bio"]).fetchall())
    assert [bio for _, bio in got[:5]] == [None, "", "", "", ""]
