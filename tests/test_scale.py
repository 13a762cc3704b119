"""What showed only on larger tables: each failed, or gave other rows, before it was mended."""

import math
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from linkloom.functions import maths
from linkloom.operators import graph as g
from linkloom.operators import search, spatial
from linkloom.plans import fixtures, graph_queries

from .conftest import DATA


def test_hash_of_large_numbers(spark):
    v = 19_999 * 1_000_003 + 19_998  # times 1103515245 this is beyond 64 bits
    m = 0x7FFFFFFF
    h = (v * 1103515245 + 12345 + 42 * 97531) & m
    h = ((h ^ h >> 15) * 1103515245 + 12345) & m
    h = ((h ^ h >> 13) * 69069 + 1) & m
    a = (v * 1103515245 + 12345) & m
    row = spark.range(1).select(maths.unit_hash(F.lit(v), 42).alias("u"), *maths.hash_jitter(F.lit(v))).first()
    assert tuple(row) == ((h + 0.5) / 2147483648.0, a % 100000 / 100000.0, a // 100000 / 21475.0)


def test_spiral_of_large_numbers(spark):
    con = duckdb.connect()
    at = "round(5.0 * sqrt(p) * cos(p * 2.399963229728653), 4), round(5.0 * sqrt(p) * sin(p * 2.399963229728653), 4)"
    want = con.sql(f"select {at} from (select unnest(range(1190000, 1200000)) p) order by p").fetchall()
    x, y = maths.spiral(F.col("id"), exact=True)
    assert [tuple(r) for r in spark.range(1190000, 1200000, 1, 1).select(F.round(x, 4), F.round(y, 4)).collect()] == want


def placed(spark, tmp_path):
    """Nodes in a file that is small beside the rows it holds."""
    x, y = maths.spiral(F.col("id"))
    spark.range(5000).select(F.col("id").alias("idx"), x.alias("x"), y.alias("y")).write.parquet(f"{tmp_path}/nodes")
    return spark.read.parquet(f"{tmp_path}/nodes")


def test_near_nodes_are_not_broadcast(spark, tmp_path):
    n = placed(spark, tmp_path)
    points = n.select(F.col("idx").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    for df in (spatial.near_pairs(n, 10.0), spatial.near_points(n, points, 10.0)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_costs_over_few_links(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(8)] + [(0, 3, 9.0)], "src long, tgt long, c double")
    got = {r.idx: r.cost for r in g.cheapest_costs(chain, 0, F.col("c"), max_links=2).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0, 3: 9.0, 4: 10.0}
    third = {r.idx: r.cost for r in g.cheapest_costs(chain, 0, F.col("c") / 3, max_links=2, places=3).collect()}
    assert third[2] == 0.666 and third[4] == 3.333


def test_links_of_cells(spark):
    links = spark.createDataFrame([(0, 1), (0, 2), (2, 1), (2, 9)], "src long, tgt long")
    cells = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 5, 1)], "idx long, cx long, cy long")
    df = spatial.links_per_cell(links, cells)
    assert {(r.cx, r.cy): r.n for r in df.collect()} == {(0, 0): 3, (5, 1): 3}


def test_partitions_follow_the_tables(spark, monkeypatch):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(fixtures, "ROWS_A_PARTITION", 100)
    try:
        fixtures.roomy(spark, DATA)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_long_segments_take_few_samples():
    """Against all samples, on segments far longer than the grid; a sample off it counts at the edge."""
    r = np.random.default_rng(5)
    x0, y0, x1, y1 = (np.concatenate([r.uniform(-w, w, 300) for w in (10, 300, 9000)]) for _ in range(4))
    x1[::7], y1[::11] = x0[::7], y0[::11]
    want = Counter()
    for a, b, c, d in zip(x0, y0, x1, y1):
        n = max(math.ceil(max(abs((c - a) * (100 / 480.0)), abs((d - b) * (100 / 480.0)))), 1)
        cell = lambda v: min(max(math.floor((v + 240.0) / 480.0 * 100), 0), 99)
        want.update({cell(b + (d - b) * t / n) * 100 + cell(a + (c - a) * t / n) for t in range(n + 1)})
    got = Counter()
    for p in spatial._crossed(x0, y0, x1, y1, 240.0, 100):
        got.update(p.tolist())
    assert got == want


def test_driver_search_asks_once(spark, monkeypatch):
    """A walk and a descent of hundreds of steps, each of which asked Spark for the next node's links; same routes."""
    n = 300
    e = spark.createDataFrame([(i, j) for i in range(n) for j in (i + 1, max(0, i - 1))], "src long, tgt long").where("tgt < 300")
    asked = []
    monkeypatch.setattr(g, "HELD_LINKS", 0)
    slow = g.DriverSearch(e.where("src < 12"), lookahead=1)
    want = slow.depth_first(0, 9), slow.random_walk(0, 6, 3)
    monkeypatch.setattr(g, "HELD_LINKS", 2_000_000)
    few = g.DriverSearch(e.where("src < 12"))
    assert (few.depth_first(0, 9), few.random_walk(0, 6, 3)) == want
    s = g.DriverSearch(e)
    real = type(s.links).collect
    monkeypatch.setattr(type(s.links), "collect", lambda df: asked.append(1) or real(df))
    assert s.depth_first(0, n - 1) == list(range(n)) and s.random_walk(0, 20, 1)[-1] == 20
    assert not asked


def test_neighbours_are_read_in_place(spark, monkeypatch):
    """Links beyond those that are held were looked up by a job for a step of a walk or some nodes of a descent; same routes."""
    n = 300
    rows = [(i, j) for i in range(n) for j in (i + 1, max(0, i - 1)) if j < n] + [(40, j) for j in range(100, 160)]
    e = spark.createDataFrame(rows + rows[:9] + [(-7, 1 << 40), (1 << 40, -9)], "src long, tgt long")
    held = g.DriverSearch(e)
    monkeypatch.setattr(g, "HELD_LINKS", 0)
    s, asked = g.DriverSearch(e, lookahead=7, max_held=20), []
    real = type(s.links).collect
    monkeypatch.setattr(type(s.links), "collect", lambda df: asked.append(1) or real(df))
    for v in [*range(-9, n + 3), 1 << 40]:
        assert s.out(v) == held.out(v) == sorted({b for a, b in [*rows, (-7, 1 << 40), (1 << 40, -9)] if a == v})
    assert s.depth_first(0, n - 1) == held.depth_first(0, n - 1) != [] and s.depth_first(9, n) == []
    assert s.random_walk(0, 20, 1) == held.random_walk(0, 20, 1) and s.random_walk(-7, 0) == []
    assert not asked
    none = g.DriverSearch(e.where("src > 1 << 41"))
    assert none.out(3) == [] == none.depth_first(0, 1) and none.random_walk(2, 2) == [2]


def test_gateways_hold_no_key_of_all_labels(spark):
    """Labels were joined to the nodes by gateway, of which there are three, so that one task took a third or more."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = graph_queries.Q["g13_inherit_category"](spark, DATA)
        assert "hashpartitioning(gateway" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_inherited(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 3, 0), (4, 9, 1)], "idx long, gateway long, hop long")
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "idx long, kind string")
    assert sorted(map(tuple, g.inherited(labels, nodes, "kind").collect())) == [(1, "a"), (2, "a"), (3, None)]


def test_large_levels_are_not_broadcast(spark, monkeypatch):
    """Levels whose files look small were broadcast, however many rows they hold; same labels."""
    r = np.random.default_rng(3)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(0, 400, (900, 2))], "src long, tgt long")
    starts = spark.createDataFrame([(3,), (50,), (399,)], "idx long")
    want = {tuple(x) for x in g.propagate_labels(links, starts).collect()}
    plans, real = [], g.reliable
    monkeypatch.setattr(g, "reliable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    monkeypatch.setattr(g, "BROADCAST_ROWS", 0)
    assert {tuple(x) for x in g.propagate_labels(links, starts).collect()} == want and len(want) > 350
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p]


def test_places_of_a_search_are_not_broadcast(spark, tmp_path, monkeypatch):
    """The nodes went to every task, and links with places were told apart once more; repeats of either change nothing."""
    n = placed(spark, tmp_path)
    n = n.union(n.where("idx < 20"))
    chain = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("tgt"))
    plans, real = [], g.reliable
    monkeypatch.setattr(g, "reliable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    for method in ("astar", "greedy"):
        got = search.shortest_path(chain.union(chain), 0, 30, method, n)
        assert [r.idx for r in got.orderBy("pos").collect()] == list(range(31))
    assert len(plans) == 2 and not [p for p in plans if "Broadcast" in p]
    assert g.DriverSearch(real(chain.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})), at=("x", "y")).links.count() == 40


def test_scans_are_dealt_in_small_pieces(spark):
    """A task read 128 MB of lines and held all of them at once where they went to over 200 partitions."""
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    fixtures.roomy(spark, DATA)
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").removesuffix("b")) <= 16 << 20
