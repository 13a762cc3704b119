"""Rounds over blocks of a graph against plain loops, with blocks and parts made small; links are not dealt out again."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import maths
from linkloom.operators import blocks
from linkloom.operators import graph as g


@pytest.fixture
def few(monkeypatch):
    for name, v in (("LEAST_BLOCKS", 3), ("LINKS_AT_ONCE", 7), ("ROWS", 5)):
        monkeypatch.setattr(blocks, name, v)
    monkeypatch.setattr(g, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(g, "DIMS_AT_ONCE", 3)


def graph(spark):
    """Repeated links, links both ways, self-loops, links to no node, and a node without links."""
    r = random.Random(3)
    links = [(r.randrange(20), r.randrange(20)) for _ in range(60)] + [(1, 2), (2, 1), (1, 2), (4, 4), (5, 77), (5, 77), (77, 6)]
    nodes = [(i * 1.0, r.uniform(-90, 90), r.uniform(-90, 90)) for i in range(22)]
    return {(a, b) for s, t in links for a, b in ((s, t), (t, s)) if a != b}, [(int(i), x, y) for i, x, y in nodes], spark.createDataFrame(links, "src long, tgt long")


def test_force_rounds(spark, few):
    arcs, rows, links = graph(spark)
    at, deg = {i: (x, y) for i, x, y in rows}, {i: sum(a == i for a, _ in arcs) for i, *_ in rows}
    for t in range(2):
        cells, new = {}, {}
        for i, (x, y) in at.items():
            cells.setdefault((math.floor(x / 40), math.floor(y / 40)), []).append((x, y))
        for i, (x, y) in at.items():
            fx, fy = -0.02 * x, -0.02 * y
            for a, b in arcs:
                if a == i and b in at:
                    dx, dy = at[b][0] - x, at[b][1] - y
                    r = max(math.hypot(dx, dy), 1e-6)
                    f = (r - 10) / r / min(deg[a], deg[b]) * 0.5 * deg[b] / (deg[a] + deg[b])
                    fx, fy = fx + dx * f, fy + dy * f
            for (cx, cy), m in cells.items():
                if abs(cx - math.floor(x / 40)) <= 1 and abs(cy - math.floor(y / 40)) <= 1:
                    ex, ey = x - sum(p[0] for p in m) / len(m), y - sum(p[1] for p in m) / len(m)
                    q = 400 * len(m) / (ex * ex + ey * ey + 10) / math.sqrt(ex * ex + ey * ey + 1)
                    fx, fy = fx + ex * q, fy + ey * q
            fx, fy = fx * (1 - 0.95 * t / 2), fy * (1 - 0.95 * t / 2)
            slow = 0.0 if i == 3 else min(1.0, 50 / max(math.hypot(fx, fy), 1e-9))
            new[i] = x + fx * slow, y + fy * slow
        at = new
    nodes = spark.createDataFrame(rows, "idx long, x double, y double")
    got = {p.idx: (p.x, p.y) for p in g.force_layout(nodes, links, 2, length=10.0, pinned=nodes.where("idx = 3")).collect()}
    assert got.keys() == at.keys()
    for i, p in at.items():
        assert got[i] == pytest.approx(p, abs=1e-8)


def test_embedding_moves_no_links(spark, few, monkeypatch):
    plans, real = [], blocks.Blocks.summed
    monkeypatch.setattr(blocks.Blocks, "summed", lambda self, *a: plans.append(real(self, *a)) or plans[-1])
    arcs, _, links = graph(spark)
    ids = sorted({a for a, _ in arcs})
    drawn = spark.createDataFrame([(i,) for i in ids], "idx long").select("idx", F.array(*[maths.normal_hash(F.col("idx") * 7 + j, 11) for j in range(7)]).alias("v"))
    now = {r.idx: np.array(r.v) for r in drawn.collect()}
    total = dict(now)
    for w in (1.0, 0.8, 0.6):
        now = {i: np.mean([now[i], *[now[b] for a, b in sorted(arcs) if a == i]], axis=0) for i in ids}
        total = {i: total[i] + now[i] * w for i in ids}
    mean = np.mean(list(total.values()), axis=0)
    got = {r.idx: r.vector for r in g.embed(links, 7).collect()}
    assert sorted(got) == ids
    for i in ids:
        assert got[i] == pytest.approx((total[i] - mean) / np.linalg.norm(total[i] - mean), abs=1e-9)
    shown = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(shown) == 9 and all(p.count("Exchange hashpartitioning") == p.count("Exchange hashpartitioning(_i") == 2 for p in shown)


def plain_louvain(pairs, parity, levels, rounds):
    both, placed = {}, {}
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)):
            both[x, y] = both.get((x, y), 0.0) + w
            placed[x] = x
    two_m = sum(both.values())
    for _ in range(levels):
        k = {}
        for (a, _), w in both.items():
            k[a] = k.get(a, 0.0) + w
        com = {v: v for v in k}
        for r in range(rounds):
            tot, new = {}, dict(com)
            for v, c in com.items():
                tot[c] = tot.get(c, 0.0) + k[v]
            for v in [v for v in k if parity[v] == r % 2]:
                kin = {com[v]: 0.0}
                for (a, b), w in both.items():
                    if a == v != b:
                        kin[com[b]] = kin.get(com[b], 0.0) + w
                new[v] = max(kin, key=lambda c: (round(kin[c] - (tot[c] - k[v] * (c == com[v])) * k[v] / two_m, 9), c == com[v], -c))  # noqa: B023
            com = new
        placed, merged = {v: com[c] for v, c in placed.items()}, {}
        for (a, b), w in both.items():
            merged[com[a], com[b]] = merged.get((com[a], com[b]), 0.0) + w
        both = merged
    return {v: min(u for u in placed if placed[u] == placed[v]) for v in placed}


def test_communities_move_no_links(spark, few, monkeypatch):
    plans, real = [], blocks.Blocks.summed
    monkeypatch.setattr(blocks.Blocks, "summed", lambda self, *a: plans.append(real(self, *a)) or plans[-1])
    r = random.Random(5)
    pairs = [(r.randrange(30), r.randrange(30), float(r.randrange(1, 4))) for _ in range(70)] + [(1, 2, 2.0), (2, 1, 1.0), (1, 2, 1.0), (4, 4, 3.0), (90, 91, 1.0), (1 << 61, 95, 1.0), (-5, 1 << 61, 1.0)]
    links = spark.createDataFrame(pairs, "src long, tgt long, w double")
    ids = links.select(F.explode(F.array("src", "tgt")).alias("v")).distinct()
    parity = {p.v: p.p for p in ids.select("v", F.pmod(F.xxhash64("v"), F.lit(2)).alias("p")).collect()}
    with pytest.warns(UserWarning, match="communities still merge"):
        got = {p.idx: p.label for p in g.louvain(links, 2, 3).collect()}
    assert got == plain_louvain(pairs, parity, 2, 3)
    shown = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(shown) == 8 and all(p.count("Exchange hashpartitioning") == p.count("Exchange hashpartitioning(_i") == 2 for p in shown)


def test_rows_and_gathered_links_are_bounded(spark, few, monkeypatch):
    """A task got all nodes' vectors of 16 dimensions, and gathered all weighted links of an eighth of the nodes, whatever
    their number; same communities and vectors from small parts."""
    r = random.Random(8)
    pairs = [(a, b, float(r.randrange(1, 4))) for a, b in {(min(p), max(p)) for p in ((r.randrange(40), r.randrange(40)) for _ in range(150))} if a != b]
    links = spark.createDataFrame(pairs, "src long, tgt long, w double")
    graph, cells, sent = blocks.Blocks, [], []
    reals, diffused = graph.summed, blocks.diffused

    def summed(self, mine, to, *rest):
        cells.append(self)
        return reals(self, mine, to, *rest)

    with pytest.warns(UserWarning):
        want = {p.idx: p.label for p in g.louvain(links, 1, 4).collect()}
    vectors = {p.idx: p.vector for p in g.embed(links, 5).collect()}
    monkeypatch.setattr(graph, "summed", summed)
    monkeypatch.setattr(blocks, "diffused", lambda graph, first, some, *rest: sent.append(some) or diffused(graph, first, some, *rest))
    for name, v in (("ROW_LINKS", 8), ("WEIGHED_LINKS", 20), ("PART_LINKS", 12)):
        monkeypatch.setattr(blocks, name, v)
    monkeypatch.setattr(g, "SENT_BYTES", 8 * 40 * 2)
    with pytest.warns(UserWarning):
        assert {p.idx: p.label for p in g.louvain(links, 1, 4).collect()} == want
    weighed = cells[0].n
    cells.clear()
    got = {p.idx: p.vector for p in g.embed(links, 5).collect()}
    assert got.keys() == vectors.keys() and all(got[i] == pytest.approx(vectors[i], abs=1e-9) for i in got)
    assert sent == [2, 2, 1] and weighed > 3


def test_simulation_moves_no_links(spark, few, monkeypatch):
    from linkloom.operators import layout

    plans, real = [], blocks.Blocks.summed
    monkeypatch.setattr(blocks.Blocks, "summed", lambda self, *a: plans.append(real(self, *a)) or plans[-1])
    monkeypatch.setattr(blocks, "TILE", 2)
    monkeypatch.setattr(blocks, "MEET_AT_ONCE", 3)
    arcs, rows, links = graph(spark)
    deg = {i: sum(a == i for a, _ in arcs) for i, *_ in rows}
    nodes = spark.createDataFrame([(i, x / 2, y / 2, 10 * i) for i, x, y in rows], "idx long, x double, y double, views long")
    hashed = {(p.idx, t): p[f"h{t}"] for p in nodes.select("idx", *[F.xxhash64("idx", F.lit(t)).alias(f"h{t}") for t in range(2)]).collect() for t in range(2)}
    size = {i: min(max((10 * i / 210 * 1000) ** 0.25, 2.0), 5.0) / 2 for i, *_ in rows}
    at = {i: (x / 2, y / 2, 0.0, 0.0) for i, x, y in rows}
    capped = False
    for t in range(2):
        alpha, cells, new = 1 - 0.95 * t / 2, {}, {}
        for i, (x, y, *_) in at.items():
            cells.setdefault((math.floor(x / 20), math.floor(y / 20)), []).append(i)
        act = {o for c in cells.values() for o in sorted(c, key=lambda i: hashed[i, t])[:2]}  # noqa: B023
        capped |= len(act) < len(at)
        for i, (x, y, vx, vy) in at.items():
            fx = fy = 0.0
            for a, b in arcs:
                if a == i and b in at:
                    dx, dy = at[b][0] + at[b][2] - x - vx, at[b][1] + at[b][3] - y - vy
                    r = max(math.hypot(dx, dy), 1e-6)
                    f = (r - 30) / r * alpha * 0.15 / min(deg[a], deg[b]) * deg[b] / (deg[a] + deg[b])
                    fx, fy = fx + dx * f, fy + dy * f
            for o in act - {i}:
                ox, oy, ovx, ovy = at[o]
                if math.hypot(ox - x, oy - y) < 20:
                    nudge = [1e-6 * (float(blocks.unit(np.int64(i * 31 + o), s)) - 0.5) for s in (51, 52, 53, 54)]
                    dx, dy = ox - x + nudge[0], oy - y + nudge[1]
                    r2 = dx * dx + dy * dy
                    f = -30 * alpha / max(math.sqrt(r2) if r2 < 1 else r2, 1e-6)
                    ax, ay = x + vx - ox - ovx + nudge[2], y + vy - oy - ovy + nudge[3]
                    apart, least = math.hypot(ax, ay), size[i] + size[o]
                    share = (least - apart) / apart * size[o] ** 2 / (size[i] ** 2 + size[o] ** 2) if apart < least else 0.0
                    fx, fy = fx + dx * f + ax * share, fy + dy * f + ay * share
            vx, vy = (vx + fx) * 0.6, (vy + fy) * 0.6
            slow = min(1.0, 50 / max(math.hypot(vx, vy), 1e-9))
            vx, vy = vx * slow - x * 0.005 * 0.05 * alpha, vy * slow - y * 0.005 * 0.05 * alpha
            new[i] = x + vx, y + vy, vx, vy
        at = new
    assert capped
    mx, my = (sum(p[k] for p in at.values()) / len(at) for k in (0, 1))
    got = {p.idx: (p.x, p.y) for p in layout.simulate(nodes, links, 2, per_cell=2).collect()}
    assert got.keys() == at.keys()
    for i, (x, y, *_) in at.items():
        assert got[i] == pytest.approx((x - mx, y - my), abs=1e-8)
    shown = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(shown) == 2 and all("dealt_" in p and p.count("SortMergeJoin") <= 1 for p in shown)
