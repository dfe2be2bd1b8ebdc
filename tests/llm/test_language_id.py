"""Language: gradients by differences, windows over whole texts, held-out accuracy, and odd inputs."""

import numpy as np
import pytest

from auditloom.llm import language_id, queries


def test_gradients_by_differences():
    net = language_id.Net(3, seed=1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    r = np.random.default_rng(0)
    windows, y = r.integers(97, 123, (6, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    _, grads = net.gradients(windows, y)
    for name, grad in grads.items():
        flat = net.params[name].reshape(-1)
        some = np.argsort(-np.abs(grad.reshape(-1)))[:8]
        for i in some:
            before = flat[i]
            flat[i] = before + 1e-5
            up = net.gradients(windows, y)[0]
            flat[i] = before - 1e-5
            down = net.gradients(windows, y)[0]
            flat[i] = before
            assert (up - down) / 2e-5 == pytest.approx(grad.reshape(-1)[i], abs=2e-4)


def test_convolution_by_loops():
    net = language_id.Net(2, seed=2)
    window = np.frombuffer(b"some bytes of a window, once each".ljust(language_id.WINDOW, b"\0"), np.uint8)[None]
    p = net.params
    vectors = np.concatenate([p["vectors"][window[0]], np.repeat(p["vectors"][:1], 4, 0)])
    hidden = []
    for f in range(p["filters"].shape[1]):
        width = language_id.WIDTHS[f // language_id.FILTERS]
        kernel = p["filters"][: width * language_id.VECTOR, f].reshape(width, -1)
        assert not p["filters"][width * language_id.VECTOR :, f].any()
        hidden.append(max(max((vectors[i : i + width] * kernel).sum() for i in range(language_id.WINDOW)) + p["bias"][f], 0))
    z = np.array(hidden) @ p["out"] + p["out_bias"]
    assert net.probabilities(window)[0] == pytest.approx(np.exp(z) / np.exp(z).sum(), abs=1e-5)


def test_every_window_counts(monkeypatch):
    """The mean over all windows, however texts are batched."""
    monkeypatch.setattr(language_id, "BLOCK", 3)
    model = language_id.Model(["a", "b"], language_id.Net(2, seed=3))
    r = np.random.default_rng(4)
    texts = [bytes(r.integers(65, 123, n).astype(np.uint8)) for n in (0, 1, 127, 128, 129, 1500, 40)]
    got = model.shares(texts)
    for text, share in zip(texts, got, strict=True):
        assert share == pytest.approx(model.net.probabilities(language_id.windows_of(text)).mean(0), abs=1e-6)
    assert (language_id.windows_of(b"AbC" * 50) == language_id.windows_of(b"aBc" * 50)).all() and len(language_id.windows_of(b"x" * 300)) == 3


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op12_language_id(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 150 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) >= 0.99


def test_fold_and_bounds(spark, monkeypatch):
    """Held-out rows teach nothing; repeated ids count once; languages get equal shares; reruns agree."""
    seen = []
    monkeypatch.setattr(language_id.Net, "train", lambda self, x, y, epochs: seen.append((x, y)))
    import zlib

    rows = [(i, ("train " if zlib.crc32(str(i).encode()) % 5 else "secret ") + "x" * (i % 9), "en" if i % 10 else "de") for i in range(2000)] + [(6, "again and again", "en")] * 300
    docs = spark.createDataFrame([*rows, (None, "no id", "fr"), (7001, "no lang", None), (7003, "123", "xx")], "doc_id long, text string, lang string")
    for d in (docs, docs.repartition(3)):
        model = language_id.fit(d, bound=100, windows=1)
        assert model.langs == ["de", "en"]
    (x, y), (x2, y2) = seen
    assert (x == x2).all() and (y == y2).all()
    assert 40 <= (y == 0).sum() <= 50 and 40 <= (y == 1).sum() <= 50
    texts = [bytes(w).rstrip(b"\0") for w in x]
    assert not any(b"secret" in t for t in texts) and sum(b"again" in t for t in texts) <= 1


def test_odd_inputs(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("hello there friends", "en"), ("guten tag freunde", "de")] * 40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), epochs=2)
    schema = "doc_id long, text string, score string, lang_pred int"
    odd = [(1, None, "x", 1), (2, "", "x", 1), (3, "12 %%% 3", "x", 1), (4, "hello there friends", "x", 1), (4, "hello there friends", "x", 1), (None, "日本" * 200_000, "x", 1)]
    got = language_id.identify(spark.createDataFrame(odd, schema), model)
    rows = got.collect()
    assert sorted(got.columns) == ["doc_id", "lang_pred", "score", "text"]
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred in ("en", "de") and 0 < r.score <= 1 for r in rows if r.doc_id in (4, None)) and len({r.score for r in rows if r.doc_id == 4}) == 1
    assert language_id.identify(spark.createDataFrame([], schema), model).count() == 0
    none = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(odd, schema), none).collect()} == {("und", 0.0)}
