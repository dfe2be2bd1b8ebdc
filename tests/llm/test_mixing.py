"""Source mixing: targets against a loop of resharing, budgets, and stable reruns."""

import re

import pytest

from auditloom.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, target int"


def targets(sizes, weights=(5, 2, 1), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not over:
            return fixed | {s: w[s] * level for s in open_}
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]
        open_ -= over
    return fixed


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(got, rows):
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    want, taken, largest = targets(sizes), {}, {}
    source_of = {r[0]: r[2] for r in rows}
    for r in got:
        s = source_of[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and r.taken <= 3 * r.size
        taken[s], largest[s] = taken.get(s, 0) + r.taken, max(largest.get(s, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op7_mix_sources(spark, sf_dir).collect()
    assert len(got) == len(rows) and {r.doc_id: r.size for r in got} == {i: words(t) for i, t, _ in rows}
    check(got, rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op7_mix_sources(spark, sf_dir).collect()))


def test_caps_and_nulls(spark):
    rows = [(i, "w " * (1 + i % 3), "a" if i < 3 else None if i < 60 else "b" if i < 200 else "c", 0) for i in range(260)] + [(999, None, "empty", 0)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 261
    check(got, rows)


def test_no_words_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, 0), (2, "", "s", 0)], SCHEMA)
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mix_sources(df).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.apply_mix(df.limit(0)).count() == 0
    assert mixing.apply_mix(df).count() == 2


def test_repeated_rows_and_columns(spark):
    rows = [(5, "same text", "s", 1)] * 9 + [(6, "other words here", "t", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    told = mixing.mix_sources(df)
    assert sum(r.taken for r in told.collect()) == sum(words(r.text) for r in out.collect())


def test_heavier_quality_is_taken_first(spark):
    rows = [(i, "abcdef " * 10 if i % 2 else "123456 " * 10, "s" if i < 400 else "t", 0) for i in range(800)]
    got = {r.doc_id: r.taken for r in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), weights=(1, 3)).collect()}
    light, heavy = (sum(got[i] for i in range(p, 400, 2)) for p in (0, 1))
    assert heavy > light
