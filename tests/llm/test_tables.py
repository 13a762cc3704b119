"""Mixing, nearest neighbours and the pipeline on small tables."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import mixing, nearest

from ..conftest import DATA


def targets(sizes, weights=(5, 2, 1), most=3):
    """The rule as written: shares by weight, excess over the cap reshared until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
        free -= over
    return out


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" * r.randint(1, 60)), r.choice(["hot"] * 8 + ["a", "b", "c", None, "z"]), "x") for i in range(1500)]
    rows = [(i, " ".join(["w"] * r.randint(1, 60)), s, x) for i, _, s, x in rows] + [(9000, None, "a", "x"), (9001, "", "hot", "x"), (9002, None, "empty", "x"), (9002, None, "empty", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").split())
    by = defaultdict(int)
    for _, t, s, _ in rows:
        by[s] += size(t)
    want, source = targets(dict(by)), {i: s for i, _, s, _ in rows}
    taken = defaultdict(int)
    for x in out:
        s = source[x.doc_id]
        assert x.target == pytest.approx(want[s]) and x.source_size == by[s] and 0 <= x.taken <= 3 * x.size
        taken[s] += x.taken
    assert all(abs(taken[s] - want[s]) <= 64 for s in by)
    assert sorted(map(str, mixing.mix_sources(df).collect())) == sorted(map(str, out))
    assert mixing.mix_sources(df.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [4096, 300])
def test_nearest(spark, monkeypatch, hot):
    """Recall on a small table with copies and a dense cluster; large groups whole, and dealt out in blocks."""
    monkeypatch.setattr(nearest, "HOT_ROWS", hot)
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(600, 16)), np.repeat(r.normal(size=(1, 16)), 80, 0), r.normal(size=(1, 16)) + 0.05 * r.normal(size=(200, 16))]).astype("f4")
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] + [1.0] * 15, 0), (1060, [None] + [1.0] * 15, 0), (1080, [1.0], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for n in nearest.nearest_neighbours(df, "vec_id % 20 = 0", 20).orderBy("query_id", "rank").collect():
        got[n.query_id].append((n.vec_id, n.score))
    d, hit, n = x.astype("f8"), 0, 0
    assert set(got) == {i for i in range(len(x)) if i % 20 == 0}
    for q, found in got.items():
        s = d @ d[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(d)), -s))[:20]
        hit, n = hit + len({v for v, _ in found} & set(best.tolist())), n + 20
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and all(abs(d[v] @ d[q] - c) < 1e-9 for v, c in found)
    assert hit >= 0.97 * n
    assert nearest.nearest_neighbours(df.limit(0), "true").collect() == []
    two = nearest.nearest_neighbours(df.where("vec_id in (0, 1)"), "vec_id = 0").collect()
    assert [(t.query_id, t.vec_id) for t in two] == [(0, 1)]


def test_nearest_in_doubles_and_blocks(spark, monkeypatch):
    """Scores of vectors of doubles are exact, in few queries at a time; extra columns clash with names used inside."""
    monkeypatch.setattr(nearest, "QUERY_BYTES", 2000)
    x = np.random.default_rng(4).normal(size=(120, 6)) * (1 + 1e-12)
    rows = [(i, v.tolist(), "n", 1.0, i, i) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, q double, w long, ids long")
    out = nearest.nearest_neighbours(df, "vec_id % 20 = 0", 3).collect()
    for q in range(0, 120, 20):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(120), -s)) if i != q][:3]
        got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [v for _, v, _ in got] == best and all(abs(c - s[v]) < 1e-14 * 100 for _, v, c in got)


def test_recall_on_the_larger_table(spark):
    """At least 0.9 of the true nearest of 200 queries over a whole table."""
    df = spark.read.parquet(f"{DATA[: -len('sf0.001')]}sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    x, ids = np.stack(rows.embedding).astype("f8"), rows.vec_id.to_numpy()
    got = defaultdict(set)
    for r in nearest.nearest_neighbours(df, "vec_id % 20 = 0", 20).collect():
        got[r.query_id].add(r.vec_id)
    hit = n = 0
    for q in sorted(got)[:200]:
        at = np.flatnonzero(ids == q)[0]
        s = x @ x[at]
        s[at] = -np.inf
        hit, n = hit + len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist())), n + 20
    assert len(got) == sum(i % 20 == 0 for i in ids) and hit >= 0.9 * n


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids and ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) == out.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
        assert empty.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and out.agg(F.sum("taken")).first()[0] > 0


def test_stages_against_plain_versions(spark):
    """On a whole small table each stage's rows are those of a plain version of it, worked out from its input."""
    from .test_text_operators import components

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    repeated = docs.unionByName(docs.where("doc_id % 7 = 0")).unionByName(docs.where("doc_id % 11 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    rows = {(r.doc_id, r.text) for r in repeated.collect()}
    groups = components(sorted(rows, key=str), 5, 80, 100)
    want = sorted([i for i, n, c in groups if n and i == c])
    empty = repeated.where("trim(coalesce(text, '')) = ''").count()
    kept = corpus_pipeline.near_duplicate_stage(spark, repeated, DATA).collect()
    assert len(kept) == len(want) + empty and sorted({r.doc_id for r in kept}) == sorted(set(want) | {r.doc_id for r in kept if not (r.text or "").strip()})
    # decontamination: no item stands unchanged in what is kept, and what goes holds words of an item
    items = [" ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    plain = lambda t: " ".join((t or "").lower().split())
    left = {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, DATA).select("doc_id").collect()}
    for r in docs.collect():
        if any(i and i in plain(r.text) for i in items):
            assert r.doc_id not in left
    # PII: one row each, texts without digits, @ or titles unchanged
    out = {r.doc_id: r.text for r in corpus_pipeline.pii_stage(spark, docs, DATA).collect()}
    assert len(out) == docs.count() and all(out[r.doc_id] == r.text for r in docs.collect() if r.text and not any(c.isdigit() or c == "@" for c in r.text) and not any(x in r.text for x in (". ", "Mr", "Frau", "Herr", "Dr", "Prof")))
