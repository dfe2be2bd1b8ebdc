"""Fill-in-the-middle: the query against its SQL, the contract by plain Python, round trips and odd inputs."""

import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.llm import fill_middle, queries


def plainly(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the contract."""
    text, digest = text or "", hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = queries.op13_fill_in_middle(spark, sf_dir)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.OP13_SQL})").fetchall()
    assert len(expected) == 1000 and sorted(map(tuple, df.collect())) == sorted(expected)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(st.sampled_from("<>PSMab\né\U0001f600\x00 "), max_size=30), min_size=60, max_size=120))
def test_by_plain_python(spark, texts):
    rows = list(enumerate([*texts, None, "", "<P", "P>", "<" * 5, "a<M>b"]))
    df = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in df.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(i, text) and r.back == (text or "")


def test_other_units(spark):
    rows = [(i, "one two\tthree \n" * (i % 7) + "x" * (i % 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for units, sep in ((fill_middle.WORDS, " \t\n"), (fill_middle.LINES, "\n")):
        out = fill_middle.fill_in_middle(docs, units=units, plain_percent=0, spm_percent=0)
        for r in out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect():
            text = dict(rows)[r.doc_id]
            assert r.back == text and r.form == ("psm" if text else "plain")
            if r.form == "psm":
                cut = text[: r.prefix_chars]
                assert cut in ("", text) or (cut[-1] == "\n" if sep == "\n" else text[len(cut)] in sep + "otx")
    uncovered = fill_middle.fill_in_middle(docs, units="[a-z]+", plain_percent=0).where("text <> ''")
    assert {r.form for r in uncovered.where("text like '% %'").collect()} == {"plain"}


def test_shares_of_forms(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    n = {r.form: r["count"] for r in fill_middle.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] - 500) < 80 and abs(n["spm"] - 900) < 120


def test_odd_inputs(spark):
    """Nulls, clashing columns, repeated rows, a long text, an empty table; no Python worker and no shuffle in the plan."""
    schema = "doc_id long, text string, n string, output int, `a.b` int"
    rows = [(None, "abc", "x", 1, 2), (1, None, "x", 1, 2), (2, "ab", "x", 1, 2), (2, "ab", "x", 1, 2), (3, "é" * 1_000_000, "x", 1, 2)]
    df = fill_middle.fill_in_middle(spark.createDataFrame(rows, schema))
    assert df.columns == ["doc_id", "text", "a.b", "n", "form", "output", "prefix_chars", "middle_chars"]
    got = df.collect()
    assert sorted(r.n for r in got) == [0, 2, 2, 3, 1_000_000] and len({r.output for r in got if r.doc_id == 2}) == 1
    assert fill_middle.fill_in_middle(spark.createDataFrame([], schema)).count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
