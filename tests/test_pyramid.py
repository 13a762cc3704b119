"""The pyramid's tiers against each tier from the nodes, and what a view reads."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import pyramid, spatial

from .conftest import files_read


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    draw = random.Random(6)
    nodes = [(i, draw.randrange(100), draw.randrange(100), draw.randrange(9)) for i in range(3000)]
    links = list({(draw.randrange(3100), draw.randrange(3000)) for _ in range(9000)})
    cells, edges = spark.createDataFrame(nodes, "idx long, cx long, cy long, degree long"), spark.createDataFrame(links, "src long, tgt long")
    path = str(tmp_path_factory.mktemp("pyramid"))
    pyramid.build(cells, edges, path)
    return path, cells.cache(), edges.cache()


@pytest.mark.parametrize("tier", pyramid.TIERS)
def test_every_tier(spark, stored, tier):
    path, cells, edges = stored
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(pyramid.cells_at(spark, path, tier).select("cx", "cy", "idx", "n")) == rows(spatial.representatives(cells, tier))
    assert rows(pyramid.bundles_at(spark, path, tier)) == rows(spatial.bundled(edges, cells, tier))
    box = (2, 1, 2 + 40 // tier, 1 + 30 // tier)
    within = F.col("cx").between(box[0], box[2]) & F.col("cy").between(box[1], box[3])
    assert rows(pyramid.cells_at(spark, path, tier, box)) == rows(pyramid.cells_at(spark, path, tier).where(within))


def test_order_and_ranges(spark):
    got = spark.range(1).select(pyramid.z_order(F.lit(5), F.lit(9)).alias("a"), pyramid.z_order(F.lit(2**23 + 1), F.lit(2**24 - 1)).alias("b")).first()
    assert (got.a, got.b) == (pyramid.z_number(5, 9), pyramid.z_number(2**23 + 1, 2**24 - 1))
    for box in ((0, 0, 0, 0), (3, 2, 9, 30), (17, 17, 18, 18), (0, 0, 63, 63)):
        spans = pyramid.z_ranges(*box)
        assert len(spans) <= pyramid.MOST_RANGES
        assert all(any(lo <= pyramid.z_number(x, y) <= hi for lo, hi in spans) for x in range(box[0], box[2] + 1) for y in range(box[1], box[3] + 1))
    assert pyramid.z_ranges(0, 0, 63, 63) == [(0, 4095)]


def test_tiers_come_from_finer_ones():
    assert {t: pyramid.below(t, (1, 2, 4, 10, 25)) for t in (2, 4, 10, 25)} == {2: 1, 4: 2, 10: 2, 25: 1}


def test_a_view_reads_few_bytes(spark, stored):
    path, _, _ = stored
    view = pyramid.cells_at(spark, path, 1, (3, 3, 6, 6))
    assert "PartitionFilters" in view._jdf.queryExecution().executedPlan().toString() and files_read(view) <= files_read(pyramid.cells_at(spark, path, 1))
    assert files_read(pyramid.cells_at(spark, path, 25)) < files_read(spark.read.parquet(f"{path}/cells"))


def test_empty(spark, tmp_path):
    pyramid.build(spark.createDataFrame([], "idx long, cx long, cy long, degree long"), spark.createDataFrame([], "src long, tgt long"), str(tmp_path / "p"))
    assert pyramid.cells_at(spark, str(tmp_path / "p"), 4).count() == 0 and pyramid.bundles_at(spark, str(tmp_path / "p"), 10).count() == 0
