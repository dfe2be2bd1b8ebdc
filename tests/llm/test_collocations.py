"""Phrases: the query against its SQL, counts against brute force, slices, shards and odd inputs."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from auditloom.llm import collocations, queries


def brute_counts(rows, most, at_least):
    """(lang, phrase, words) -> count, by going over all words."""
    found, totals = Counter(), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang or "und"] += len(words)
            for m in range(1, most + 1):
                found.update((lang or "und", " ".join(words[i : i + m]), m) for i in range(len(words) - m + 1))
    return {k: n for k, n in found.items() if n >= at_least} | {(lang, None, 0): n for lang, n in totals.items()}


def texts(n, seed=0):
    r = np.random.default_rng(seed)
    words = np.array(["a", "B", "the", "der", "É", "xx", " ", "c\x0bd", "e.f", "g,", "h!i?"])
    return [("".join(w + sep for w, sep in zip(r.choice(words, size), r.choice([" ", "\t", "  ", "\n"], size, p=[0.7, 0.1, 0.1, 0.1]), strict=True)), (None, "de", "und", "en")[i % 4]) for i, size in enumerate(r.integers(0, 60, n))]


@pytest.mark.parametrize("most", [2, 3, 5])
def test_counts_by_brute_force(spark, most, monkeypatch):
    rows = texts(300)
    got = collocations.phrase_counts(spark.createDataFrame(rows, "text string, lang string").repartition(5), most, 4).collect()
    assert {(r.lang, r.phrase, r.words): r.n for r in got} == brute_counts(rows, most, 4)


def test_false_positives_of_the_bits_change_nothing(spark):
    rows = texts(200, 3)
    got = collocations.phrase_counts(spark.createDataFrame(rows, "text string, lang string"), 3, 10, most_bits=16).collect()
    assert {(r.lang, r.phrase, r.words): r.n for r in got} == brute_counts(rows, 3, 10)


def test_long_texts_in_slices_and_shards(monkeypatch):
    """Words are whole and phrases over the ends of slices and shards count once."""
    monkeypatch.setattr(collocations, "SLICE", 40)
    monkeypatch.setattr(collocations, "SHARD", 30)
    rows = [("one two three, four " * 50 + "w" * 300 + " end " + "one two " * 20, "en"), ("", "en"), ("five " * 90, "de"), ("x", "en"), ("two", "en")]
    assert all(b"".join(collocations.slices(t.encode())) == t.encode() for t, _ in rows)
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t, _ in rows]), pa.array([lang for _, lang in rows])], ["text", "lang"])
    found, shards = Counter(), 0
    for lang, suffixes in collocations._shards(iter([batch]), 3):
        shards += 1
        found[lang, None, 0] += suffixes.limit
        for m, at, counts in suffixes.intervals(3):
            for phrase, n in zip(suffixes.phrases(at, m).to_pylist(), counts.tolist(), strict=True):
                found[lang, phrase, m] += n
    assert shards > 5 and found == brute_counts(rows, 3, 1)


def test_suffixes_are_sorted():
    r = np.random.default_rng(5)
    ids, begins = r.integers(0, 4, 400), r.random(400) < 0.1
    begins[0] = True
    suffixes = collocations.Suffixes(ids, begins, pa.array([b"a", b"b", b"c", b"d"]), 5, 400)
    order, rank = suffixes.sorted_to(5)
    heads = [tuple(ids[i : i + suffixes.depth[i]]) for i in range(400)]
    assert [heads[i] for i in order] == sorted(heads) and all((rank[i] < rank[j]) == (heads[i] < heads[j]) for i in range(0, 400, 7) for j in range(400))


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = queries.op11_collocations(spark, sf_dir)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.OP11_SQL})").fetchall()
    assert len(expected) > 1000 and sorted(map(tuple, df.collect())) == sorted(expected)


def test_scores_pass_64_bits(spark, monkeypatch):
    """Counts of ten digits, ties by count and byte order, cuts and covered phrases."""
    n = 5_000_000_000
    rows = [("en", "a b", 2, n), ("en", "b c", 2, n // 2), ("en", "a b c", 3, n // 2), ("en", "é z", 2, n // 4), ("en", "z z", 2, n // 4), ("en", "q z", 2, 10)]
    ones = [("en", w, 1, c) for w, c in {"a": n, "b": 2 * n, "c": n, "é": n, "z": n, "q": 10}.items()]
    made = spark.createDataFrame([*rows, *ones, ("en", None, 0, 9 * n)], "lang string, phrase string, words int, n bigint")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a, **k: made)
    got = {r.phrase: r for r in collocations.top_phrases(spark.createDataFrame([], "text string, lang string")).collect()}
    assert set(got) == {"a b c", "é z", "z z", "q z"}  # "a b" and "b c" lie in a phrase of half their count or more
    cut = min((10**6 * (n // 2) ** 2 // (n * (n // 2)), 1, n, n // 2), (10**6 * (n // 2) ** 2 // (n * n), 2, n, n))
    assert (got["a b c"].score, got["a b c"].l, got["a b c"].r) == (cut[0], *cut[2:])
    assert got["z z"].score == got["é z"].score and got["z z"]["rank"] + 1 == got["é z"]["rank"] and all(r.n == 9 * n for r in got.values())


def test_odd_inputs(spark):
    schema = "id int, lang string, n int, text string, phrase string"
    empty = spark.createDataFrame([], schema)
    assert collocations.top_phrases(empty).count() == 0
    rows = [(1, None, 1, None, "x"), (2, "en", 1, "", "x"), (3, "en", 1, "ab cd " * 200_000, "x")] + [(4, "de", 1, "Ja nein.", "x")] * 12
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n) for r in collocations.top_phrases(spark.createDataFrame(rows, schema)).collect()}
    assert got[("de", "ja nein")] == (12, 12, 12, 24) and {lang for lang, _ in got} == {"de", "en"}
