"""Repeated byte strings against a direct search of all starts."""

import hashlib
import random

import pyarrow as pa
import pytest
import zstandard

from auditloom.llm import common, queries, suffix_dedup


def expected(texts, length):
    seen = {}
    for n, text in enumerate(texts):
        for i in range(len(text) - length + 1):
            seen.setdefault(text[i : i + length], []).append((n, i))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for n, i in places:
                cover[n][i : i + length] = b"\1" * length
    out = []
    for text, c in zip(texts, cover, strict=True):
        runs = sum(1 for i in range(len(c)) if c[i] and not (i and c[i - 1]))
        out.append((len(text), sum(c), runs, hashlib.sha256(bytes(b for b, k in zip(text, c, strict=True) if not k)).hexdigest()))
    return out


def run(spark, texts, length=400):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length).collect()}
    return [got[i] for i in range(len(texts))]


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_planted(spark):
    r = random.Random(5)
    passage, near = words(r, 140), words(r, 200)
    texts = [words(r, 150) + passage + words(r, 20), passage[37:700] + words(r, 80), near, near[:600] + "X" + near[601:], words(r, 40) + near[300:1000], words(r, 60), "", None, passage[:399], passage[:400]]
    texts += ["é" + words(r, 100)] * 3 + [None, words(r, 90) + passage[100:520] + words(r, 4) + passage[100:520]]
    assert run(spark, texts) == expected([(t or "").encode() for t in texts], 400)


def test_periodic(spark):
    r = random.Random(6)
    texts = ["a" * 1500, words(r, 10) + "a" * 401, "ab" * 300, "line of junk\n" * 80, words(r, 100), "x" * 399, "abc" * 133 + "a"]
    assert run(spark, texts) == expected([t.encode() for t in texts], 400)


def test_many_variants(spark):
    r = random.Random(7)
    base = words(r, 120)
    texts = []
    for _ in range(25):
        t = list(base)
        for _ in range(r.randrange(0, 3)):
            t[r.randrange(len(t))] = "#"
        lo = r.randrange(0, 100)
        texts.append("".join(t)[lo : len(t) - r.randrange(0, 100)])
    assert run(spark, texts) == expected([t.encode() for t in texts], 400)


def test_query(spark, sf_dir):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = dict(zip((i for i, _ in rows), expected([t for _, t in rows], 400), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_suffix_array_dedup(spark, sf_dir).collect()}
    assert got == want


def test_empty_and_bounds(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_starts(spark.createDataFrame([], "row long, packed binary"), 200)


def test_anchors_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(8)
    text = words(r, 3000).encode()
    whole = suffix_dedup.anchors([text])[0].tolist()
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert suffix_dedup.anchors([text])[0].tolist() == whole


def test_anchors_of_texts_do_not_depend_on_neighbours():
    r = random.Random(9)
    texts = [words(r, n).encode() for n in (0, 3, 40, 500, 25, 26, 27, 90)] + [b"", b"a" * 900, b"a" * 142, b"a" * 143]
    assert [a.tolist() for a in suffix_dedup.anchors(texts)] == [suffix_dedup.anchors([t])[0].tolist() for t in texts]
    for text, found in zip(texts, suffix_dedup.anchors(texts), strict=True):
        assert len(text) < 143 or len(found)


def test_hot_keys_match_as_others_do(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    r = random.Random(10)
    base = words(r, 120)
    texts = [base[r.randrange(60) : len(base) - r.randrange(60)] for _ in range(12)] + [base] * 3 + ["a" * 900]
    assert run(spark, texts) == expected([t.encode() for t in texts], 400)


def test_kept_text(spark):
    r = random.Random(11)
    passage = words(r, 120)
    df = spark.createDataFrame([(1, "é" + passage + " one"), (2, "two " + passage), (3, None)], "doc_id long, text string")
    got = {x.doc_id: x.kept_text for x in suffix_dedup.remove_repeats(df).collect()}
    assert got == {1: "é one", 2: "two ", 3: ""}


def test_each_start_is_judged_at_one_anchor():
    r = random.Random(12)
    text = words(r, 700).encode()
    at = suffix_dedup.anchors([text])[0].tolist()
    packed = pa.RecordBatch.from_pydict({"row": [3], "packed": [zstandard.compress(text)], "listed": [at]})
    for size, before in ((16, 128), (1, 4)):
        around = pa.concat_tables([pa.Table.from_batches([b]) for b in suffix_dedup._contexts(400)[0](iter([packed]))])
        los = pa.array([list(range(0, 128, before))] * len(at), pa.list_(pa.int32()))
        ranks = pa.array([[0] * (128 // before)] * len(at), pa.list_(pa.int64()))
        opened = around.append_column("los", los).append_column("ranks", ranks).combine_chunks().to_batches()
        nodes = [n for b in suffix_dedup._nodes(400, size)[0](iter(opened)) for n in b.to_pylist()]
        starts = sorted(n["at"] - n["lo"] - k for n in nodes for k in range(size))
        assert set(starts) >= set(range(len(text) - 399))
        assert len(starts) < 1.4 * len(text) if size > 1 else starts == list(range(len(text) - 399))


def test_structured(spark):
    r = random.Random(13)
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    texts = [morse[:1024], morse[1024:], morse[300:800], "ab" * 256 + morse[:512], "".join(r.choice("ab") for _ in range(900))]
    for _ in range(6):
        t = list(("abcdefg" * 90)[: r.randrange(500, 620)])
        t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    assert run(spark, texts) == expected([t.encode() for t in texts], 400)
