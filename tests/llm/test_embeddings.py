"""Embeddings against brute force: counts, components in a dense group, recall at two sizes and for longer prefixes."""

import numpy as np
import pytest

from lectern.llm import embeddings


def _brute(rows):
    ids, x, labels = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float32).astype(float), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    least = np.array(ids)
    while True:
        new = np.array([min([least[i], *least[near[i]]]) for i in range(len(ids))])
        if (new == least).all():
            return dict(zip(ids, near.sum(1))), dict(zip(ids, least)), near.sum()
        least = new


def _rows(n, seed, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        centre = rng.normal(size=dim)
        for _ in range(int(rng.choice([1, 1, 2, 5]))):
            out.append((len(out), (centre + rng.normal(size=dim) * rng.uniform(0.01, 0.11)).tolist(), int(rng.integers(0, 2))))
    return out[:n]


@pytest.mark.parametrize("n, prefix", [(300, 12), (3000, 12), (3000, 1)])
def test_recall_at_two_sizes(spark, n, prefix, monkeypatch):
    monkeypatch.setattr(embeddings, "PREFIX", prefix)  # 1: the prefix is lengthened with the label's size
    rows = _rows(n, n)
    schema = "vec_id long, embedding array<float>, label int, raw int, bits int, node string"
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)).collect()}
    links, least, total = _brute(rows)
    assert all(got[i].n_links <= links[i] for i in links)
    assert sum(r.n_links for r in got.values()) >= 0.97 * total and total > n / 4
    assert sum(got[i].component_id == least[i] for i in least) >= 0.99 * n
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_dense_group_has_one_component(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.04).tolist(), 1) for i in range(600)] + [(700 + i, rng.normal(size=16).tolist(), 1) for i in range(50)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links, least, total = _brute([(i, np.array(v, dtype=np.float64), y) for i, v, y in rows])
    assert sum(r.n_links for r in got.values()) >= 0.97 * total
    assert {i: r.component_id for i, r in got.items()} == least
