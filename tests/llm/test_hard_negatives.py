"""Hard negatives against a plain search, with digits and blocks made small."""

import math
import random

import pytest

from linkloom.llm import hard_negatives


def plain(rows, anchor, positives, negatives):
    use = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = (label, [math.floor(256 * x) for x in v])
        use[i] = min(use.get(i, q), q)
    out = []
    for a, (al, av) in use.items():
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(av, v, strict=True)) for i, (_, v) in use.items() if i != a and len(v) == len(av)}
        for p in sorted((i for i in score if use[i][0] == al), key=lambda i: (-score[i], i))[:positives]:
            ok = [i for i in score if use[i][0] != al and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r, n, score[p], score[n]) for r, n in enumerate(sorted(ok, key=lambda i: (-score[i], i))[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("digit", [9, 3])
def test_against_plain_search(spark, monkeypatch, digit):
    monkeypatch.setattr(hard_negatives, "DIGIT_BITS", digit)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 30 * 8 * 4)
    draw = random.Random(digit)
    kinds = [[draw.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)] for _ in range(6)]
    rows = []
    for i in range(240):
        v = list(draw.choice(kinds)) if i % 3 else [draw.gauss(0, 1) for _ in range(4)]
        rows.append((i, v, draw.choice([0, 1, 1, 2])))
    rows += [(500, [1.0, None, 1.0, 1.0], 1), (501, None, 1), (502, [1.0] * 4, None), (503, [float("nan")] * 4, 1), (504, [float("inf")] * 4, 1), (None, [1.0] * 4, 1), (505, [1.0, 2.0], 1), (506, [], 1), (510, [1.0, 2.0], 2), (507, [0.0] * 4, 2), rows[10], (10, [9.0] * 4, 2)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, id string")
    rows = [(i, None if v is None else [None if x is None else float(__import__("numpy").float32(x)) for x in v], k) for i, v, k in rows]
    got = hard_negatives.hard_negatives(df, "vec_id % 10 = 0", positives=4, negatives=3)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda a: a % 10 == 0, 4, 3)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(df).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], df.schema)
    assert hard_negatives.hard_negatives(one).count() == 0


def test_too_large(spark):
    df = spark.createDataFrame([(0, [1e12], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.hard_negatives(df)


def test_rows_stay_where_they_are(spark, monkeypatch):
    """Every pass dealt all rows and all anchors out again, in rows of 8 MB that a task sorted; now only counts go."""
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 2 * 8 * 3)
    plans, real = [], hard_negatives.Selection.meet
    monkeypatch.setattr(hard_negatives.Selection, "meet", lambda self, *a: plans.append(real(self, *a)) or plans[-1])
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hard_negatives.hard_negatives(df, "vec_id % 10 = 0")
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda a: a % 10 == 0, 5, 3)
    assert len(plans) > 10 and not any("Exchange" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
