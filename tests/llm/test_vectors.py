import numpy as np
import pytest

from kithgraph.llm import vectors
from kithgraph.llm.components import connected


def find(links, n):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200 + k, 201 + k) for k in range(40)] + [(300, x) for x in range(301, 330)] + [(5, 5)]
    want = find(edges, 400)
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want[x] for x in {y for a, b in edges if a != b for y in (a, b)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("common", [4096, 3])
def test_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "COMMON", common)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 64))
    group = base[0] + 0.2 * rng.standard_normal((70, 64))
    near = base + rng.uniform(0.2, 0.45, (60, 1)) * rng.standard_normal((60, 64))
    rows = [v.tolist() for v in np.concatenate([base, group, near])] + [base[3].tolist()] * 3
    bad = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0]]
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(rows + bad)], "vec_id long, embedding array<double>, n_links int")
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    comp = find(list(zip(*np.nonzero(link), strict=True)), len(rows))
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(bad)
    # A pair that shares no filter is missed, so counts may fall a little short, never above.
    n = np.array([got[k].n_links for k in range(len(rows))])
    assert (n <= link.sum(axis=1)).all() and n.sum() >= 0.97 * link.sum()
    assert np.mean([got[k].component_id == comp[k] for k in range(len(rows))]) > 0.97
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(len(rows), len(rows) + len(bad)))
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dimension,words", [(8, 8), (64, 8), (64, 30), (64, 60), (384, 30)])
def test_recall_at_the_threshold(dimension, words):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * z
    codes = [vectors.ProductCode(dimension, words, 0.9, seed=20 + k) for k in range(vectors.CODES)]
    a, b = [c.decode(x) for c in codes], [c.decode(y) for c in codes]
    recall = np.mean([any(np.intersect1d(p[k], q[k]).size for p, q in zip(a, b, strict=True)) for k in range(len(x))])
    assert recall > 0.93, (recall, np.mean([sum(len(p[k]) for p in a) for k in range(len(x))]))
