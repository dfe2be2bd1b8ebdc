"""Shared passages against a direct comparison of all runs of 50 words."""

import random

import pytest
from auditloom.llm import passages, queries, suffix_dedup


def expected(texts, least=50):
    seen, words = {}, [t.split() for t in texts]
    for n, w in enumerate(words):
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), []).append((n, i))
    cover = [set() for _ in texts]
    for places in seen.values():
        if len({n for n, _ in places}) > 1:
            for n, i in places:
                cover[n].update(range(i, i + least))
    return [len(c) for c in cover]


def words(r, n):
    return [r.choice("abcdefgh") + str(r.randrange(300)) for _ in range(n)]


def test_passages_below_400_bytes_are_told(spark):
    r = random.Random(1)
    some, long, line = words(r, 52), words(r, 300), words(r, 49)
    texts = [words(r, 80) + some + words(r, 9), some + words(r, 3), words(r, 70) + some[:49], some[2:], words(r, 200), long, long[20:90] + words(r, 5) + long[85:240], line + words(r, 40), words(r, 8) + line]
    texts += [["a"] * 90, ["a"] * 60 + ["b"], ["c", "d"] * 80, ["e"] * 300, long[:100] + ["x"] + long[:100], words(r, 50), [], ["one"]]
    texts = [" ".join(t) for t in texts] + ["\n \t".join(some), None, " ".join(long), " ".join(line), " ".join(line)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(df).collect()}
    want = expected([(t or "").encode() for t in texts])
    assert [got[i].n_shared_words for i in range(len(texts))] == want
    assert want[0] == 52 and got[0].n_removed == 0 and want[2] == want[4] == 0


def test_query_tells_passages(spark, sf_dir):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r.n_shared_words for r in queries.op8_suffix_array_dedup(spark, sf_dir).collect()}
    assert [got[i] for i, _ in rows] == expected([t for _, t in rows])


def test_words_do_not_depend_on_pieces_and_neighbours(monkeypatch):
    r = random.Random(2)
    texts = [" ".join(words(r, n)).encode() for n in (0, 400, 1, 60)] + [b"x" * 5000 + b" y\t\x0bz", b" \n ", "é ü".encode()]
    whole, bounds = passages.word_hashes(texts)
    assert bounds.tolist()[-1] == len(whole) == sum(len(t.split()) for t in texts)
    monkeypatch.setattr(passages, "PIECE", 700)
    assert passages.word_hashes(texts)[0].tolist() == whole.tolist()
    assert [passages.word_hashes([t])[0].tolist() for t in texts] == [whole[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_least_is_bounded(spark):
    with pytest.raises(ValueError):
        passages.shared_words(spark.createDataFrame([], "row long, packed binary"), 20)
