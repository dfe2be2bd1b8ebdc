"""N-best segmentation against all paths of the lattice, and exact round trips."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import queries
from auditloom.llm.sentencepiece_nbest import NONE, Encoder, Trie, Vocabulary, decode_ids, decoder, encode, first, read_model, search

MODEL = read_model(queries.PIECES)
TEXTS = ["Hello  world\n x\tñ 你▁a \ue000b", "a", "  ", "\n\n x", "", "▁", "\ue000\ue001\ue002", "emoji 😀 and tabs\t\t", "³²·½ café", "x" * 300, " lead", "trail ", "a▁ b", "word.word,word"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(MODEL)


def ids(raw):
    return np.frombuffer(raw, np.int32).tolist()


def all_paths(vocabulary, text):
    """Every segmentation of the whole text, without cutting it into chunks."""
    marked = vocabulary.mark(text)
    paths = {0: [(0, ())]}
    for end in range(1, len(marked) + 1):
        found = []
        for start in range(end):
            piece = marked[start:end]
            if piece in vocabulary.ids:
                part = (vocabulary.ids[piece],)
                more = vocabulary.scores[part[0]]
            elif len(piece) == 1:
                part = tuple(vocabulary.byte_ids[b] for b in piece.replace("▁", " ").encode())
                more = vocabulary.byte_score * len(part)
            else:
                continue
            found += [(score + more, path + part) for score, path in paths[start]]
        paths[end] = found
    return paths[len(marked)]


@pytest.mark.parametrize("n", [1, 3, 6])
def test_against_all_paths(vocabulary, n):
    r = random.Random(n)
    for _ in range(150):
        text = "".join(r.choice("abe the  in\nñ,0") for _ in range(r.randrange(1, 12)))
        every = all_paths(vocabulary, text)
        got = Encoder(vocabulary, n).encode(text)
        assert [s for s, _ in got] == sorted((s for s, _ in every), reverse=True)[:n]
        assert {tuple(ids(raw)) for _, raw in got} <= {p for _, p in every} and len({raw for _, raw in got}) == len(got)
        assert all(decode_ids(vocabulary, ids(raw)) == text for _, raw in got)


def test_first_is_the_search_s_first(vocabulary):
    r = random.Random(9)
    for _ in range(500):
        chunk = "".join(r.choice("aeinst▁hñ你") for _ in range(r.randrange(1, 14)))
        found = list(search(vocabulary, chunk, 2))
        score, pieces, loss = first(vocabulary, chunk)
        assert (score, pieces) == found[0] and loss == (found[0][0] - found[1][0] if len(found) > 1 else NONE)


def test_many_at_once(vocabulary):
    r = random.Random(10)
    trie = Trie(vocabulary)
    chunks = ["".join(r.choice("aeinst▁hñ你é😀 x9") for _ in range(r.randrange(1, 16))) for _ in range(2000)]
    got = trie.first(chunks)
    for chunk, told in zip(chunks, got, strict=True):
        score, pieces, loss = first(vocabulary, chunk)
        assert told is None or told == (score, pieces.tobytes(), loss)
    assert sum(told is not None for told in got) > 500


def test_long_runs_take_time_in_proportion(vocabulary):
    r = random.Random(3)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    began = time.process_time()
    found = Encoder(vocabulary, 3).encode(text)
    assert time.process_time() - began < 20
    assert len(found) == 3 and all(decode_ids(vocabulary, ids(raw)) == text for _, raw in found)


def test_round_trips(vocabulary):
    encoder = Encoder(vocabulary, 4)
    for text in TEXTS:
        for _, raw in encoder.encode(text):
            assert decode_ids(vocabulary, ids(raw)) == text


def test_cache_bound(vocabulary, monkeypatch):
    monkeypatch.setattr("auditloom.llm.sentencepiece_nbest.CACHED_CHUNKS", 3)
    small, large = Encoder(vocabulary, 3), Encoder(vocabulary, 3)
    text = "one two three four five one two six seven one"
    assert small.encode(text) == small.encode(text) == large.encode(text) and len(small.cache) <= 3


def test_operator(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (100, None)], "doc_id long, text string").withColumn("nbest", F.lit("clash"))
    out = encode(df, MODEL, 3)
    assert out.columns == ["doc_id", "text", "nbest"]
    back = out.withColumn("back", decoder(spark, MODEL)(F.col("nbest")[0]["ids"])).collect()
    for r in back:
        assert (r.nbest is None) == (r.text is None) and r.back == r.text
        assert r.text is None or [b.score for b in r.nbest] == sorted((b.score for b in r.nbest), reverse=True)
    assert encode(df.limit(0), MODEL, 3).count() == 0


def test_query(spark, sf_dir):
    got = queries.op2_sentencepiece_nbest(spark, sf_dir).collect()
    assert all(r.round_trip and r.n_pieces > 0 and r.margin >= 0 for r in got)


def test_unknown_ids(vocabulary):
    assert decode_ids(vocabulary, [10**9, -1]) == "��"


def test_a_part_of_new_chunks_is_searched_at_once(vocabulary, monkeypatch):
    """4,000 chunks of one range of lengths take one search (before: two), and each gets what the single search says."""
    asked = []
    search_all = Trie.first
    monkeypatch.setattr(Trie, "first", lambda self, chunks: asked.append(len(chunks)) or search_all(self, chunks))
    r = random.Random(3)
    chunks = {"▁" + "".join(r.choice("abcdeinst") for _ in range(7)) for _ in range(4200)}
    chunks = sorted(chunks)[:4000]
    encoder = Encoder(vocabulary, 3)
    encoder.prepare(chunks)
    assert asked == [4000]
    for chunk in chunks[::50]:
        score, found, loss = first(vocabulary, chunk)
        assert encoder.cache[chunk] == (score, found.tobytes(), loss)
