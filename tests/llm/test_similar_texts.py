"""The near-duplicate stage against all pairs' Jaccard similarity of five-word shingles."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from auditloom.llm import common, simhash
from pyspark.sql import functions as F


def shingles(text, width=5):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def kept(docs, least=0.8):
    """The smallest id of each component."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= least):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i for i in ids if top(i) == i}


def edited(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def texts():
    """Copies with 0 to 9 of 300 words edited (similarity from under 0.75 to 1), in small families and a large one."""
    rng = random.Random(5)
    rows = []
    for family in range(40):
        words = [f"w{family}x{rng.randrange(10**6)}" for _ in range(300)]
        rows += [" ".join(words)] + [edited(rng, words, rng.randrange(10)) for _ in range(90 if family == 0 else 3)]
    rows += [None, "", " \t", "one", "ONE", "a b c d", "a b  c d", "word " * 3000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("crowded", [2, 16])
def test_against_all_pairs(spark, crowded):
    rows = texts()
    out = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"), crowded=crowded)
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept(rows))


def test_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stage = corpus_pipeline.STAGES[2][1]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in stage(spark, docs, sf_dir).collect()} == kept(rows)


def test_columns_and_nulls(spark):
    rows = [(2, "a b c d", "x"), (1, "a b c d", "y"), (None, "a b c d", "z"), (9, "quite another text here", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _node string")
    out = simhash.drop_similar(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 9]
    assert simhash.drop_similar(df.limit(0)).count() == 0


def test_batch_setting_comes_back(spark):
    before = spark.conf.get(common.BATCH_ROWS)
    with pytest.raises(ZeroDivisionError), common.small_batches(spark, 7):
        assert spark.conf.get(common.BATCH_ROWS) == "7"
        1 / 0
    assert spark.conf.get(common.BATCH_ROWS) == before


def pairs_of_sets(rng, n, own, common):
    """Pairs of sets of hashes with so many elements of their own and in common."""
    for _ in range(n):
        some = rng.integers(0, 1 << 64, common + 2 * own, np.uint64)
        yield np.sort(some[: common + own]), np.sort(some[own:])


def test_parity_sketches_lose_no_pair():
    rng = np.random.default_rng(1)
    for own, common in ((0, 50), (3, 20), (22, 178), (300, 2000)):
        for a, b in pairs_of_sets(rng, 50, own, common):
            apart = int(np.bitwise_count((simhash.odd_sketch(a) ^ simhash.odd_sketch(b)).view(np.uint64)).sum())
            assert apart <= 2 * own and apart % 2 == 0
            assert own > 30 or apart >= 2 * own - 16


@pytest.mark.parametrize(("bits", "least"), [(24, 0.98), (26, 0.98), (32, 0.98)])
def test_wide_segments_meet(bits, least):
    """Pairs of similarity 0.8 share a bucket at every width, and others hardly do."""
    a, b = map(list, zip(*pairs_of_sets(np.random.default_rng(bits), 300, 22, 178), strict=True))
    n = simhash.SEGMENTS[bits]
    (x, near_x), (y, near_y) = simhash.wide_prints(a, bits), simhash.wide_prints(b, bits)
    own = [simhash.probe_keys(z, near, bits, 0, n) for z, near in ((x, near_x), (y, near_y))]
    values = [z.view("<u4")[:, :n].astype(np.int64) & ((1 << bits) - 1) for z in (x, y)]
    keys = [simhash._keys(v, np.arange(n)[None, :]) for v in values]
    met = [bool(set(keys[0][i]) & {*keys[1][i], *own[1][i]} or set(keys[1][i]) & set(own[0][i])) for i in range(len(a))]
    assert sum(met) >= least * len(met)
    assert sum(bool(set(keys[0][i]) & {*keys[1][i - 1], *own[1][i - 1]}) for i in range(len(a))) <= 2


def test_own_keys_are_those_that_probes_ask_for(spark):
    lanes = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, (5, 44), np.int64)
    for bits in (24, 27, 32):
        n = simhash.SEGMENTS[bits]
        df = spark.createDataFrame([(list(map(int, x[: n // 2])),) for x in lanes], "l array<bigint>")
        got = [r.k for r in df.select(simhash.own_keys(F.col("l"), bits).alias("k")).collect()]
        values = np.ascontiguousarray(lanes[:, : n // 2]).view("<u4").astype(np.int64) & ((1 << bits) - 1)
        assert got == simhash._keys(values, np.arange(n)[None, :]).tolist()


def test_segments_widen_with_the_table():
    """So many random texts share a bucket with a given one, at every size."""
    sizes = [40_000, 200_000, 1_000_000, 12_000_000]
    met = [n * simhash.SEGMENTS[b] * simhash.PROBES / 2**b for n in sizes for b in [simhash.segment_bits(n)]]
    assert [simhash.segment_bits(n) for n in sizes] == [24, 26, 28, 32] and max(met) < 5 and met[-1] < 5 * met[0]


def test_a_set_of_bits_for_some_segments(spark, monkeypatch):
    monkeypatch.setattr(simhash, "KEYS", 2000)
    rows = texts()
    out = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept(rows))


def near_copies(n):
    """One text and copies of it with 1 to 7 words edited: most pairs are near 0.8 and below it."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    return [(0, " ".join(words))] + [(i, edited(rng, words, 1 + rng.randrange(7))) for i in range(1, n)]


def test_a_large_group_is_not_compared_in_pairs(spark, monkeypatch):
    """Only pairs that can be similar leave the join; before, most of a group's pairs did."""
    asked = []
    similar = simhash._Texts.similar
    monkeypatch.setattr(simhash._Texts, "similar", lambda self, pairs: asked.append(pairs.count()) or similar(self, pairs))
    rows = near_copies(300)
    out = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept(rows))
    assert asked[-1] < 3 * 300


def test_a_node_of_a_large_group_is_compared_with_one_at_a_time(spark, monkeypatch):
    """Before the buckets are compared, every round asks for one pair a node at most, however many buckets it shares; before, for one a bucket."""
    asked = []
    similar = simhash._Texts.similar
    monkeypatch.setattr(simhash._Texts, "similar", lambda self, pairs: asked.append(pairs.count()) or similar(self, pairs))
    rows = near_copies(300)
    out = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept(rows))
    assert len(asked) > 1 and max(asked[:-1]) <= 300
