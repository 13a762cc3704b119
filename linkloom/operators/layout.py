"""Layouts: starts by formula, and a simulation of springs, charges and collisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import maths
from linkloom.operators.graph import by_shuffle, drop, reliable

#: Springs and gravities of the grid of layouts.
SPRINGS, GRAVITIES = (0.05, 0.15, 0.30), (0.01, 0.05, 0.15)


def seed_layout(nodes: DataFrame, kind: str = "spiral") -> DataFrame:
    """(idx, x, y) by a formula on idx: spiral, galactic, nebula, or communities (nodes with category: a spiral around
    each one's centre, the largest innermost)."""
    v = F.col("idx")
    if kind == "spiral":
        x, y = maths.spiral(v)
    elif kind == "galactic":
        x, y = maths.galactic(v)
    elif kind == "nebula":
        x, y = maths.nebula(v, nodes.count())
    elif kind == "communities":
        rank = F.row_number().over(Window.orderBy(F.desc("n"), "category")) - 1  # one row a category
        centres = nodes.groupBy("category").agg(F.count("*").alias("n")).withColumn("r", rank)
        cx, cy = maths.spiral(F.col("r") + 2, 40.0)
        a, r = maths.hash_jitter(v)
        own = nodes.join(centres.select("category", cx.alias("cx"), cy.alias("cy"), F.sqrt("n").alias("wide")), "category")
        return own.select("idx", (F.col("cx") + F.col("wide") * r * F.cos(a * 6.283185307179586)).alias("x"), (F.col("cy") + F.col("wide") * r * F.sin(a * 6.283185307179586)).alias("y"))
    else:
        raise ValueError(f"no layout {kind!r}")
    return nodes.select("idx", x.alias("x"), y.alias("y"))


def start_positions(nodes: DataFrame, placed: DataFrame, gateways: DataFrame) -> DataFrame:
    """Where a layout begins: nodes (idx) that are placed (idx, x, y) stay; one with a gateway (idx, gateway) that is
    placed begins 6 to 45 from it, by a hash; all others on a thin ring 2.2 times as far out as the placed ones' root
    mean square. Rows (idx, x, y)."""
    wide = placed.agg((2.2 * F.sqrt(F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y")))).alias("wide"))  # one row
    at = placed.select("idx", F.col("x").alias("px"), F.col("y").alias("py"))
    near = gateways.select("idx", F.col("gateway")).join(placed.select(F.col("idx").alias("gateway"), F.col("x").alias("gx"), F.col("y").alias("gy")), "gateway").select("idx", "gx", "gy")
    rows = nodes.select("idx").join(at, "idx", "left").join(near, "idx", "left").crossJoin(F.broadcast(wide))
    v, turn = F.col("idx"), 6.283185307179586
    off, ring = 6 + 39 * maths.unit_hash(v, 61), F.col("wide") * (1 + 0.15 * maths.unit_hash(v, 63))
    place = lambda f, p, gate: F.when(F.col(p).isNotNull(), F.col(p)).when(F.col(gate).isNotNull(), F.col(gate) + off * f(turn * maths.unit_hash(v, 62))).otherwise(ring * f(turn * maths.unit_hash(v, 64)))
    return rows.select("idx", place(F.cos, "px", "gx").alias("x"), place(F.sin, "py", "gy").alias("y"))


def spring_force(dx: Column, dy: Column, length: float, strength: Column, alpha: float) -> tuple[Column, Column]:
    """Along a link, in proportion to what it is longer than its rest length."""
    r = F.greatest(F.hypot(dx, dy), F.lit(1e-6))
    f = (r - length) / r * alpha * strength
    return dx * f, dy * f


def charge_force(dx: Column, dy: Column, charge: float, alpha: float) -> tuple[Column, Column]:
    """By the square of the distance; by the distance itself within 1."""
    r2 = dx * dx + dy * dy
    f = charge * alpha / F.greatest(F.when(r2 < 1, F.sqrt(r2)).otherwise(r2), F.lit(1e-6))
    return dx * f, dy * f


def simulate(
    nodes: DataFrame, links: DataFrame, iterations: int = 80, spring: float = 0.15, gravity: float = 0.05, length: float = 30.0, charge: float = -30.0, collision: float = 20.0,
    reach: float = 20.0, per_cell: int = 100, damping: float = 0.6, most_speed: float = 50.0,
) -> DataFrame:
    """nodes: (idx, x, y, views). Velocities gather springs (shared by degree), charges and collisions of nodes within
    reach, are damped and limited, and gravity draws to the centre; the whole is centred again. Springs are added up in blocks
    of nodes (see blocks). Near nodes meet in tiles of cells, of each of which at most per_cell nodes, by a hash that
    changes each time, act on others: so a crowded cell costs in proportion to its nodes. Rows (idx, x, y)."""
    from linkloom.operators import blocks as b

    top = nodes.agg(F.greatest(F.max("views"), F.lit(1)).alias("top"))  # one row
    size = maths.radius_by_power(F.col("views") / F.col("top") * 1000) * collision / 20 / 2
    graph = b.Blocks(links, nodes.select("idx"))
    rows = nodes.crossJoin(F.broadcast(top)).select(graph.block(F.col("idx")).alias("block"), "idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), size.alias("r"))
    start = b.packed(rows, {"idx": np.int64} | {c: np.float64 for c in ("x", "y", "vx", "vy", "r")})
    state = reliable(start.join(by_shuffle(graph.degrees()), "block").select("*", F.col("x").alias("ax"), F.col("y").alias("ay")))
    for turn in range(iterations):
        alpha = 1 - 0.95 * turn / max(1, iterations)
        pushed = b.met(state, turn, reach, per_cell, charge, alpha)
        last, state = state, reliable(b.collision_round(graph, state, pushed, alpha, length, spring, gravity, damping, most_speed))
        drop(last)
    now = b.unpacked(state, {"idx": "bigint", "x": "double", "y": "double"})
    centre = now.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))  # one row
    return now.crossJoin(F.broadcast(centre)).select("idx", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))


def layout_grid(nodes: DataFrame, links: DataFrame, iterations: int = 80, start: str = "nebula") -> Iterator[tuple[str, DataFrame]]:
    """One layout for each spring and gravity, each from the same start: (name, (idx, x, y))."""
    placed = reliable(seed_layout(nodes, start).join(nodes.select("idx", "views"), "idx"))
    for i, spring in enumerate(SPRINGS):
        for j, gravity in enumerate(GRAVITIES):
            yield f"k{i}_g{j}", simulate(placed, links, iterations, spring, gravity)
