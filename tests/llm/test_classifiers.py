"""Toxicity and quality: held-out accuracy, the label model, exact neighbour votes, and odd inputs."""

import numpy as np
import pytest

from auditloom.llm import quality, queries, toxicity
from auditloom.llm.labelled import labelled_sample


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def judged(spark, larger, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = query(spark, larger).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    return [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]


def test_toxicity_held_out(spark):
    """On ten thousand documents; about four in ten toxic ones there have none of the words that tell toxic texts apart surely."""
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    pairs = [(labels[r.doc_id], r.predicted) for r in queries.op1_toxicity(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    hits, toxic, said = sum(y and p for y, p in pairs), sum(y for y, _ in pairs), sum(p for _, p in pairs)
    assert toxic > 100 and hits / toxic >= 0.85 and hits / said >= 0.95


def test_quality_held_out(spark, larger):
    pairs = judged(spark, larger, queries.op6_quality_classifier, "quality")
    assert sum(y == p for y, p in pairs) / len(pairs) >= 0.97


def test_label_model():
    r = np.random.default_rng(0)
    y = (r.random(3000) < 0.3).astype(float)
    accurate = np.where(y == 1, r.random(3000) < 0.8, r.random(3000) < 0.02)
    noise = r.random(3000) < 0.3
    votes = np.stack([accurate, accurate, accurate, noise], axis=1).astype(np.uint8)
    given = np.where(r.random(3000) < 0.9, y, 1 - y)
    model = toxicity.LabelModel()
    posterior = model.fit(votes, given)
    assert ((posterior >= 0.5) == y).mean() > max((given == y).mean(), 0.91)  # 0.926 is the best that can be told from these votes
    assert np.allclose(model.given, [0.1, 0.9], atol=0.04) and abs(model.prior - 0.3) < 0.04
    root = next(j for j in range(3) if model.parent[j] < 0)
    assert model.fires[1, 0, root] > 0.7 and model.fires[0, 0, root] < 0.1 and model.parent[3] < 0
    copies = [j for j in range(3) if j != root]  # they add nothing to what they go with
    assert all(0 <= model.parent[j] < 3 and model.fires[1, 1, j] > 0.9 and model.fires[1, 0, j] < 0.1 for j in copies)


def test_label_model_of_unlike_voters():
    r = np.random.default_rng(2)
    y = (r.random(4000) < 0.4).astype(float)
    votes = np.stack([np.where(y == 1, r.random(4000) < a, r.random(4000) < b) for a, b in ((0.7, 0.1), (0.5, 0.2), (0.6, 0.05))], axis=1).astype(np.uint8)
    given = np.where(r.random(4000) < 0.85, y, 1 - y)
    model = toxicity.LabelModel(rounds=40)
    model.fit(votes, given)
    for fired in (0, 1):  # what another voter says changes little
        assert np.allclose(model.fires[1, fired], [0.7, 0.5, 0.6], atol=0.12) and np.allclose(model.fires[0, fired], [0.1, 0.2, 0.05], atol=0.12)
    assert np.allclose(model.given, [0.15, 0.85], atol=0.06)


def test_neighbours_are_exact():
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(97, 123, 200).astype(np.uint8)) for _ in range(30)] + [b"ABC !!! " * k for k in range(3, 20)]
    x = quality.features(texts)
    axes = np.eye(quality.WIDTH, 40, dtype=np.float32)
    model = quality.Model(np.ones(quality.WIDTH, np.float32), axes, np.zeros((0, 40)), np.zeros(0), 5)
    z = model.project(x)
    model.vectors, model.labels = z, (np.arange(len(z)) % 2).astype(float)
    got = model.score(texts)
    for i, v in enumerate(z):
        cos = z @ v
        near = sorted(range(len(z)), key=lambda j: -cos[j])[:5]
        weight = np.clip(cos[near], 1e-6, 1).astype(float) ** 8
        if cos[near[-1]] - sorted(cos, reverse=True)[5] > 1e-6:
            assert got[i] == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), abs=1e-5)


def test_gram_counts_do_not_depend_on_pieces(monkeypatch):
    text = b"some words, 12 and MORE of them " * 40
    whole = quality.gram_counts([text, b"", b"ab"])
    monkeypatch.setattr(quality, "PIECE", 100)
    parts = quality.gram_counts([text, b"", b"ab"])
    assert np.abs(whole - parts).sum() <= 4 * 7 * (len(text) // 100 + 1) and (whole[1:] == parts[1:]).all()


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 1), (4, None), (None, 1)], "doc_id long, quality int")
    import zlib

    rows = labelled_sample(docs, labels, "quality", 5, 0, 10).collect()
    assert len(rows) == 10 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


@pytest.mark.parametrize("empty_labels", [True, False])
def test_odd_inputs(spark, empty_labels):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "Plain words here.", 0.5), (3, "Plain words here.", 0.5), (4, "y" * 3_000_000, 0.5), (None, "idiot", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([] if empty_labels else [(3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for module, name in ((quality, "score_quality"), (toxicity, "score_toxicity")):
        out = getattr(module, name)(docs, module.fit(docs, labels)).collect()
        assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
        assert getattr(module, name)(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0


def test_words_of_long_texts(monkeypatch):
    text = "Alpha beta gamma " * 200
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert toxicity._words(text) == {"alpha", "beta", "gamma"}


def test_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", 1000, 999, 3).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 3 and all(r.y == r.doc_id % 2 and int(r.text[5:]) % 4 == r.doc_id for r in rows)
