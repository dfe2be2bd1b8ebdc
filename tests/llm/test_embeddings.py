"""Vectors against all pairs, and recall of the hashing."""

import numpy as np
import pytest

from auditloom.llm import embedding_dedup as e
from auditloom.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.98):
    good = []
    for k, (_, v, label, *_) in enumerate(rows):
        ok = label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        good.append(ok)
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    comp = {}
    for k in range(len(rows)):
        todo, seen = [k], {k}
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        comp[k] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return [(rows[k][0], len(links[k]), comp[k]) for k in range(len(rows))]


def test_hadamard():
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(e.hadamard(e.hadamard(x)), x) and np.allclose(np.linalg.norm(e.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("block", [1024, 8])
def test_against_all_pairs(spark, block):
    r = np.random.default_rng(2)
    rows, k = [], 0
    for _ in range(12):
        centre = r.standard_normal(24)
        for _ in range(r.integers(1, 9)):
            rows.append((k, (centre + 0.02 * r.standard_normal(24)).tolist(), int(r.integers(0, 2)), "x"))
            k += 1
    same = r.standard_normal(24).tolist()
    rows += [(k + i, same, 1, "x") for i in range(20)] + [(900, (np.array(same) * 3).tolist(), 1, "x"), (901, same, None, "x")]
    rows += [(902, None, 1, "x"), (903, [], 1, "x"), (904, [0.0] * 24, 1, "x"), (905, [float("nan")] * 24, 1, "x"), (906, [float("inf")] + [1.0] * 23, 1, "x"), (907, [None] + [1.0] * 23, 1, "x"), (908, [1.0, 2.0], 1, "x"), (909, [1.0, 2.0], 1, "x")]
    got = {r.vec_id: r for r in e.link_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    assert len(got) == len(rows)
    for vec_id, n, comp in brute(rows):
        assert (got[vec_id].n_links, got[vec_id].component_id, got[vec_id].kept) == (n, comp, vec_id == comp), vec_id


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op5_embedding_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (n, c) for i, n, c in brute(rows)}


def test_recall_at_the_threshold():
    """Pairs at cosine 0.98 exactly: how many meet in a table."""
    r = np.random.default_rng(4)
    a = e.unit(r.standard_normal((2000, 64)))
    other = r.standard_normal((2000, 64))
    other = e.unit(other - (other * a).sum(1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * other
    keys = [np.stack([e.bucket_keys(x, t, 2, 1) for t in range(8)], axis=1) for x in (a, b)]
    met = ((keys[0] == keys[1][:, :, :1]).any(2) | (keys[1] == keys[0][:, :, :1]).any(2)).any(1)
    assert met.mean() > 0.995


def test_ties_and_empty(spark):
    rows = [(5, [1.0, 0.0], 1, ""), (5, [1.0, 0.0], 1, ""), (None, [1.0, 0.001], 1, ""), (None, [0.0, 1.0], 2, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in e.link_vectors(df).collect())
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (-1, 2, 5, False), (-1, 0, None, False)])
    assert e.link_vectors(df.limit(0)).count() == 0
