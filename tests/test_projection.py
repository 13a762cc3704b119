"""The neighbour map against the principal axes on planted clusters, at two sizes; weights and bandwidths."""

import numpy as np
import pytest

from linkloom.operators import graph as g
from linkloom.operators import projection


def trust(x, y, k=10):
    """Trustworthiness: how few of the k nearest in the map are not near in the vectors."""
    n = len(x)
    d = lambda z: ((z[:, None] - z[None]) ** 2).sum(axis=2)
    rank = np.argsort(np.argsort(d(x), axis=1), axis=1)
    near = np.argsort(d(y), axis=1)[:, 1 : k + 1]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(0, np.take_along_axis(rank, near, 1) - k).sum()


@pytest.mark.parametrize(("n", "group"), [(240, 2048), (600, 200)])
def test_nearer_than_the_principal_axes(spark, monkeypatch, n, group):
    monkeypatch.setattr(projection, "GROUP", group)
    draw = np.random.default_rng(n)
    centres = 4 * draw.normal(size=(12, 10))
    x = centres[draw.integers(0, 12, n)] + draw.normal(size=(n, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v long, vec array<double>")
    at = lambda rows: np.array([(r.x, r.y) for r in sorted(rows, key=lambda r: r[0])])
    first = at(projection.neighbour_map(df, rounds=4, seed=1).collect())
    assert trust(x, first) > trust(x, at(g.project(df.selectExpr("v AS idx", "vec AS vector")).select("idx", "x", "y").collect())) + 0.02
    if n == 240:
        assert (at(projection.neighbour_map(df, rounds=4, seed=1).collect()) == first).all()  # seeded
        links = {(r.v, r.u): r.w for r in projection.neighbour_links(df, 5).collect()}
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        nearest = {(i, j) for i in range(n) for j in np.argsort(d[i])[1:6].tolist()}
        assert links.keys() == nearest | {(j, i) for i, j in nearest}
        assert all(0 < w <= 1 + 1e-9 and links[j, i] == w for (i, j), w in links.items())
        assert all(max(links[i, j] for j in range(n) if (i, j) in links) > 1 - 1e-9 for i in range(20))


def test_few(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "v long, vec array<double>")
    assert [tuple(r) for r in projection.neighbour_map(df).collect()] == [(1, 0.0, 0.0)]
    assert projection.neighbour_map(df.limit(0)).count() == 0
