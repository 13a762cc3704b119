"""Threshold pairs by the cover tree against all pairs, with small blocks so that every level is used."""

import numpy as np
import pytest

from linkloom.llm import cover_tree


def plain(rows, cosine):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            good[k] = np.asarray(v, np.float64) / np.linalg.norm(v)
    label, links = {k: k for k in good}, dict.fromkeys(good, 0)

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for x in good:
        for y in good:
            if x < y and len(good[x]) == len(good[y]) and good[x] @ good[y] >= cosine:
                links[x] += 1
                links[y] += 1
                label[root(x)] = root(y)
    least = {}
    for k in good:
        least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        c = least[root(k)] if k in good else i
        out.append((i, links.get(k, 0), c, k not in good or c == i))
    return sorted(out, key=str)


def near_copies(draw, n, dim, spread):
    centre = draw.normal(size=dim)
    centre /= np.linalg.norm(centre)
    return [centre + spread * draw.normal(size=dim) / np.sqrt(dim) for _ in range(n)]


@pytest.mark.parametrize(("seed", "unit", "cosine"), [(1, 24, 0.95), (3, 24, 0.8), (4, 60, 0.995)])
def test_against_all_pairs(spark, monkeypatch, seed, unit, cosine):
    monkeypatch.setattr(cover_tree, "MOST_UNIT", unit)
    monkeypatch.setattr(cover_tree, "LEAST_UNIT", unit)
    monkeypatch.setattr(cover_tree, "LEAF_ROWS", 3)
    monkeypatch.setattr(cover_tree, "TAKEN", 50)
    monkeypatch.setattr(cover_tree, "EDGES", 200)
    draw = np.random.default_rng(seed)
    vecs = [v for spread in (0.01, 0.1, 0.2, 0.3, 0.5) for v in near_copies(draw, 70, 8, spread)] + [*draw.normal(size=(120, 8))]
    vecs += [vecs[0]] * 90 + [vecs[5] * 3] * 4
    order = draw.permutation(len(vecs))
    rows = [(int(k), vecs[at].astype(np.float32).tolist()) for k, at in enumerate(order)]
    rows += [(9000, None), (9001, [0.0] * 8), (9002, [1.0, None] * 4), (9003, [float("nan")] * 8), (9004, [float("inf")] * 8), (9005, []), (None, rows[0][1]), (9006, rows[0][1][:3]), (9007, rows[0][1][:3]), rows[3], (3, rows[9][1])]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, embedding array<float>, node int, cls string")
    got = [tuple(r) for r in cover_tree.threshold_components(df, cosine).collect()]
    assert sorted(got, key=str) == plain(rows, cosine)


def test_upper_levels_and_blocks_are_used(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "MOST_UNIT", 30)
    monkeypatch.setattr(cover_tree, "LEAST_UNIT", 30)
    draw = np.random.default_rng(7)
    rows = [(k, v.tolist()) for k, v in enumerate(near_copies(draw, 300, 8, 0.02) + near_copies(draw, 300, 8, 0.3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    classes = df.selectExpr("vec_id as cls", "1L as copies", "vec_id as rep", "embedding as vec").mapInArrow(cover_tree.as_bytes("<f8"), "cls long, copies long, rep long, dim int, vec binary")
    levels = cover_tree.Levels(classes.drop("rep"), "<f8", cover_tree.reach(0.95), cover_tree.Scratch(spark, "levels"))
    pairs, linked = levels.traverse()
    assert levels.depth > 2 and linked.count() > 0
    assert levels.placed.count() == 600 and levels.nodes.where("leaf").agg({"rows": "sum"}).first()[0] == 600
    got = [tuple(r) for r in cover_tree.threshold_components(df).collect()]
    assert sorted(got, key=str) == plain(rows, 0.95)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cover_tree.threshold_components(df).count() == 0
    one = spark.createDataFrame([(4, [1.0])], df.schema)
    assert [tuple(r) for r in cover_tree.threshold_components(one).collect()] == [(4, 0, 4, True)]
