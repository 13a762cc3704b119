"""Quantiles by sketched brackets against numpy, with brackets of few values so that all rounds are taken."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import quantiles, spatial


@pytest.mark.parametrize(("most", "error"), [(20_000, 0.005), (12, 0.05), (12, 0.0001)])
def test_against_numpy(spark, monkeypatch, most, error):
    monkeypatch.setattr(quantiles, "MOST_VALUES", most)
    monkeypatch.setattr(quantiles, "ERROR", error)  # too small a one is found out and widened
    monkeypatch.setattr(quantiles, "SKETCH_K", 16 if error < 0.01 and most < 100 else 800)
    draw = random.Random(most)
    rows = [(draw.choice(["a", "b", None]), draw.choice([draw.gauss(0, 100), 7.0, float(draw.randrange(5))])) for _ in range(4000)]
    rows += [("one", 3.5), ("none", None), ("nan", float("nan")), *[("same", 2.0)] * 300]
    df = spark.createDataFrame(rows, "kind string, x double")
    wanted = {"low": ("x", 0.0), "mid": ("x", 0.5), "q": ("x", 0.973), "top": ("x", 1.0)}
    got = {(r.kind, r.name): r.quantile for r in quantiles.quantile_table(df, wanted, ["kind"]).collect()}
    want = {}
    for kind in ("a", "b", None, "one", "same"):
        xs = [x for k, x in rows if k == kind and x is not None and not math.isnan(x)]
        want |= {(kind, n): float(np.quantile(xs, q)) for n, (_, q) in wanted.items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    one = quantiles.quantiles(df, {"m": ("x", 0.5)}).first()
    assert math.isclose(one.m, float(np.quantile([x for _, x in rows if x is not None and not math.isnan(x)], 0.5)), abs_tol=1e-9)


def test_joined_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), ("c", None)], "kind string, x double")
    out = quantiles.with_quantile(df.groupBy("kind").agg(F.count("*").alias("n")), df, ["kind"], "x", 0.5, "mid")
    assert {(r.kind, r.n, r.mid) for r in out.collect()} == {("a", 2, 1.5), (None, 1, 5.0), ("c", 1, None)}
    assert quantiles.quantiles(df.limit(0), {"m": ("x", 0.5)}).first().m is None
    with pytest.raises(ValueError, match="quantile"):
        quantiles.quantiles(df, {"m": ("x", 2.0)})


def test_pixels_of_a_segment_count_once_and_are_not_shuffled(spark):
    segs = spark.createDataFrame([(1, 2, -9.0, 0.0, 9.0, 0.0), (3, 4, 0.0, 0.0, 0.0, 0.0)], "src long, tgt long, x0 double, y0 double, x1 double, y1 double")
    out = spatial.raster_lines(segs, 10.0, 20)
    got = {(r.px, r.py): r["count"] for r in out.collect()}
    assert sum(got.values()) == len(got) + 1 and max(got.values()) == 2
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 1
