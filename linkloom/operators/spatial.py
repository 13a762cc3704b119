"""Grid, viewport, level-of-detail and raster operators over nodes (idx, x, y, ...)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import maths
from linkloom.operators.graph import by_shuffle, small
from linkloom.operators.quantiles import quantiles


def clamped_cell(v: Column, bound: Column | float, cells: int) -> Column:
    return F.least(F.greatest(F.floor((v + bound) / (2 * bound) * cells), F.lit(0)), F.lit(cells - 1)).cast("long")


def grid_cells(nodes: DataFrame, cells: int = 384, bound: float | None = None) -> DataFrame:
    """nodes with their cell cx, cy; the grid spans 1.02 times the greatest coordinate where no bound is given."""
    if bound is not None:
        return nodes.withColumns({"cx": clamped_cell(F.col("x"), F.lit(bound), cells), "cy": clamped_cell(F.col("y"), F.lit(bound), cells)})
    most = nodes.agg((1.02 * F.greatest(F.max(F.abs("x")), F.max(F.abs("y")))).alias("_b"))
    on = nodes.crossJoin(F.broadcast(most))  # one row
    return on.withColumns({"cx": clamped_cell(F.col("x"), F.col("_b"), cells), "cy": clamped_cell(F.col("y"), F.col("_b"), cells)}).drop("_b")


def in_box(box: tuple[float, float, float, float], pad: float = 0.0) -> Column:
    x0, y0, x1, y1 = box
    return F.col("x").between(x0 - pad, x1 + pad) & F.col("y").between(y0 - pad, y1 + pad)


def viewport(nodes: DataFrame, box, pad: float = 200.0, min_views: int = 0, min_in_degree: int = 0, category: int | None = None, text: str | None = None) -> DataFrame:
    out = nodes.where(in_box(box, pad) & (F.col("views") >= min_views) & (F.col("in_degree") >= min_in_degree))
    out = out if category is None else out.where(F.col("category") == category)
    return out if text is None else out.where(F.lower("title").contains(text.lower()))


def segments(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, tgt with the coordinates of both ends; links with an unknown end are dropped."""
    p = nodes.select("idx", "x", "y")
    return links.select("src", "tgt").join(p.toDF("src", "x0", "y0"), "src").join(p.toDF("tgt", "x1", "y1"), "tgt").select("src", "tgt", "x0", "y0", "x1", "y1")


def segment_in_box(box) -> Column:
    x0, y0, x1, y1 = box
    return (F.greatest("x0", "x1") >= x0) & (F.least("x0", "x1") <= x1) & (F.greatest("y0", "y1") >= y0) & (F.least("y0", "y1") <= y1)


def representatives(cells: DataFrame, coarse: int = 1) -> DataFrame:
    """cells: (idx, cx, cy, degree). The node of highest degree in each coarse cell, ties to the smaller idx."""
    by = [F.floor(F.col("cx") / coarse).alias("cx"), F.floor(F.col("cy") / coarse).alias("cy")]
    return cells.groupBy(*by).agg(F.max_by("idx", F.struct("degree", -F.col("idx"))).alias("idx"), F.count("*").alias("n"))


def bundled(links: DataFrame, cells: DataFrame, coarse: int) -> DataFrame:
    """Links between coarse cells as unordered pairs of their representatives, with how many they stand for."""
    at = cells.select("idx", F.floor(F.col("cx") / coarse).alias("bx"), F.floor(F.col("cy") / coarse).alias("by"))
    rep = representatives(cells, coarse).select(F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("idx").alias("rep"))
    own = at.join(rep, ["bx", "by"]).select("idx", "rep")
    e = links.join(own.toDF("src", "a"), "src").join(own.toDF("tgt", "b"), "tgt").where("a <> b")
    return e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("links"))


def links_per_cell(links: DataFrame, cells: DataFrame) -> DataFrame:
    """links: each pair once; cells: (idx, cx, cy). Links with an end in a cell, once where both are: (cx, cy, n). A link
    is told once or twice in its own row, so only counts of cells are shuffled after the joins."""
    at = cells.select("idx", F.struct("cx", "cy").alias("c"))
    both = links.select("src", "tgt").join(by_shuffle(at.toDF("src", "a")), "src", "left").join(by_shuffle(at.toDF("tgt", "b")), "tgt", "left")
    return both.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("c")).where("c is not null").groupBy("c.cx", "c.cy").agg(F.count("*").alias("n"))


def near_points(nodes: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """points: (pid, px, py). The nearest node strictly within the radius, ties to the smaller idx: cells of the radius'
    size and the eight around."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = points.select("pid", "px", "py", around.alias("o")).select("pid", "px", "py", (F.floor(F.col("px") / radius) + F.col("o.i")).alias("cx"), (F.floor(F.col("py") / radius) + F.col("o.j")).alias("cy"))
    own = nodes.select("idx", "x", "y", F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    hits = asked.join(by_shuffle(own), ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") < radius * radius)
    return hits.groupBy("pid").agg(F.min_by("idx", F.struct("d2", "idx")).alias("idx"))


def near_pairs(nodes: DataFrame, radius: float) -> DataFrame:
    """Pairs (a, b), a < b, strictly nearer than the radius, with the squared distance."""
    own = nodes.select("idx", "x", "y", F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    sent = own.select(F.col("idx").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", around.alias("o")).select("a", "ax", "ay", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    d2 = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
    return sent.join(by_shuffle(own), ["cx", "cy"]).where(F.col("idx") > F.col("a")).withColumn("d2", d2).where(F.col("d2") < radius * radius).select("a", F.col("idx").alias("b"), "d2")


def cell_budget(cells: DataFrame, budget: int, hidden: tuple[int, ...] = ()) -> DataFrame:
    """cells: (idx, cx, cy, category). About budget nodes, as many from each populated cell, by idx; hidden categories
    use up their share and are not shown."""
    populated = cells.select("cx", "cy").distinct().agg(F.count("*").alias("_m"))
    rank = F.row_number().over(Window.partitionBy("cx", "cy").orderBy("idx"))
    out = cells.withColumn("rank", rank).crossJoin(F.broadcast(populated))  # one row
    out = out.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(budget / F.col("_m")))).drop("_m", "rank")
    return out.where(~F.col("category").isin(*hidden)) if hidden else out


def cell_budget_exact(cells: DataFrame, budget: int, hidden: tuple[int, ...] = ()) -> DataFrame:
    """The accumulating form: populated cells in order of row and column; each adds budget / cells to what is saved up
    (at most 1.5 times that, or 5), gives as many nodes as it has up to the whole part, and the total stops at budget.
    The recurrence runs in one task over cells (as many as the grid has at most), not over nodes."""
    size = cells.groupBy("cy", "cx").agg(F.count("*").alias("n"))
    size = size.withColumn("m", F.count("*").over(Window.partitionBy())).sortWithinPartitions("cy", "cx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        saved, used = 0.0, 0
        for b in batches:
            takes = []
            for n, m in zip(b.column("n").to_pylist(), b.column("m").to_pylist(), strict=True):
                step = budget / m
                saved = min(saved + step, max(1.5 * step, 5.0))
                take = min(n, int(saved), budget - used)
                saved, used = saved - take, used + take
                takes.append(take)
            yield pa.RecordBatch.from_arrays([b.column("cy"), b.column("cx"), pa.array(takes, pa.int64())], ["cy", "cx", "take"])

    shares = size.select(F.col("cy").cast("long").alias("cy"), F.col("cx").cast("long").alias("cx"), "n", "m").mapInArrow(run, "cy long, cx long, take long")
    rank = F.row_number().over(Window.partitionBy("cx", "cy").orderBy("idx"))
    out = cells.withColumn("rank", rank).join(shares, ["cy", "cx"]).where(F.col("rank") <= F.col("take")).select(*cells.columns)
    return out.where(~F.col("category").isin(*hidden)) if hidden else out


def view_cells(cells: DataFrame, box, bound: float, n: int, margin: float = 1.4) -> DataFrame:
    """Populated cells that a view, widened by a margin about its centre, covers."""
    x0, y0, x1, y1 = box
    wide = lambda lo, hi: ((lo + hi) / 2 - (hi - lo) / 2 * margin, (lo + hi) / 2 + (hi - lo) / 2 * margin)
    cell = lambda v: min(max(math.floor((v + bound) / (2 * bound) * n), 0), n - 1)
    (xa, xb), (ya, yb) = wide(x0, x1), wide(y0, y1)
    return cells.where(F.col("cx").between(cell(xa), cell(xb)) & F.col("cy").between(cell(ya), cell(yb))).select("cx", "cy").distinct()


def over(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Rasters (px, py, r, g, b, a) of values 0 to 1 laid one over the other; pixels of either."""
    names = ("r", "g", "b", "a")
    both = top.select("px", "py", *[F.col(c).alias(f"t{c}") for c in names]).join(bottom.select("px", "py", *[F.col(c).alias(f"b{c}") for c in names]), ["px", "py"], "full").na.fill(0.0)
    alpha = F.col("ta") + F.col("ba") * (1 - F.col("ta"))
    mixed = lambda c: F.when(alpha > 0, (F.col(f"t{c}") * F.col("ta") + F.col(f"b{c}") * F.col("ba") * (1 - F.col("ta"))) / alpha).otherwise(0.0)
    return both.select("px", "py", *[mixed(c).alias(c) for c in "rgb"], alpha.alias("a"))


def raster_points(nodes: DataFrame, bound: float, size: int) -> DataFrame:
    """px, py, count."""
    return grid_cells(nodes, size, bound).groupBy(F.col("cx").alias("px"), F.col("cy").alias("py")).agg(F.count("*").alias("count"))


#: Samples of segments that are held at a time.
SAMPLES_AT_ONCE = 1 << 19


def _crossed(x0, y0, x1, y1, bound: float, size: int) -> Iterator[np.ndarray]:
    """The pixels (py * size + px) of each segment's samples, each once a segment, some segments at a time.

    Samples off the grid count for the pixel at its edge. Both coordinates are monotone along a segment, so a pixel's
    samples stand together, and where both are off the grid the pixel does not change: only the samples with one on it
    are taken, two more on either side, and the two ends."""
    n = np.maximum(np.ceil(np.maximum(np.abs((x1 - x0) * (size / (2 * bound))), np.abs((y1 - y0) * (size / (2 * bound))))), 1)

    def on_grid(a, b):
        d = b - a
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.sort(np.stack([(-bound - a) / d * n, (bound - a) / d * n]), axis=0)
        lo, hi = np.maximum(np.floor(t[0]) - 2, 0), np.minimum(np.ceil(t[1]) + 2, n)
        flat = d == 0
        return np.where(flat, np.where(np.abs(a) <= bound, 0, n + 1), lo), np.where(flat, np.where(np.abs(a) <= bound, n, 0), hi)

    (xa, xb), (ya, yb) = on_grid(x0, x1), on_grid(y0, y1)
    first = xa <= ya
    a, b, c, d = np.where(first, xa, ya), np.where(first, xb, yb), np.where(first, ya, xa), np.where(first, yb, xb)
    begin = np.stack([np.zeros_like(n), a, np.maximum(c, np.where(a <= b, b + 1, c)), n], axis=1)
    count = np.maximum(np.stack([np.zeros_like(n), b, d, n], axis=1) - begin + 1, 0).astype(np.int64)
    upto = np.cumsum(count.sum(axis=1))
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SAMPLES_AT_ONCE, "right")))
        k, g = count[at:to].ravel(), begin[at:to].ravel()
        row = np.repeat(np.arange(at, to), count[at:to].sum(axis=1))
        t = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(g, k)
        cell = lambda v0, v1: np.clip(np.floor((v0[row] + (v1[row] - v0[row]) * t / n[row] + bound) / (2 * bound) * size), 0, size - 1).astype(np.int64)  # noqa: E731,B023
        pixel = cell(y0, y1) * size + cell(x0, x1)
        new = np.ones(len(row), bool)
        new[1:] = (pixel[1:] != pixel[:-1]) | (row[1:] != row[:-1])
        yield pixel[new]
        at = to


def raster_lines(segs: DataFrame, bound: float, size: int) -> DataFrame:
    """Pixels that segments cross, one sample a pixel of the longer side; px, py, count. Each task counts pixels of its
    segments, so only counts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [b.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")]
            got = [np.unique(p, return_counts=True) for p in _crossed(*ends, float(bound), size)]
            if got:
                pixel, where = np.unique(np.concatenate([p for p, _ in got]), return_inverse=True)
                n = np.bincount(where, np.concatenate([c for _, c in got])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pixel % size), pa.array(pixel // size), pa.array(n)], ["px", "py", "n"])

    known = segs.select(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).dropna()
    return known.mapInArrow(run, "px long, py long, n long").groupBy("px", "py").agg(F.sum("n").alias("count"))


def dilated(raster: DataFrame, k: int = 3) -> DataFrame:
    """Maximum filter of k by k pixels."""
    h = k // 2
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-h, h + 1) for j in range(-h, h + 1)]))
    return raster.select("count", "px", "py", around.alias("o")).groupBy((F.col("px") + F.col("o.i")).alias("px"), (F.col("py") + F.col("o.j")).alias("py")).agg(F.max("count").alias("count"))


def winner_take_all(nodes: DataFrame, bound: float, size: int) -> DataFrame:
    """Per pixel the category of most nodes, ties to the smaller."""
    n = grid_cells(nodes, size, bound).groupBy(F.col("cx").alias("px"), F.col("cy").alias("py"), "category").agg(F.count("*").alias("n"))
    return n.groupBy("px", "py").agg(F.max_by("category", F.struct("n", -F.col("category"))).alias("category"), F.max("n").alias("n"))


def equalised(raster: DataFrame, floor: float = 0.15, gamma: float = 0.8) -> DataFrame:
    """Intensity from the rank of a pixel's count, ties by place. Ranks come from counts of each value: one row a
    distinct count goes through the global window, and the places within one are ranked among themselves."""
    value = raster.groupBy("count").agg(F.count("*").alias("_n"))
    below = Window.orderBy("count").rowsBetween(Window.unboundedPreceding, -1)
    value = value.select("count", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    own = F.row_number().over(Window.partitionBy("count").orderBy("px", "py")) - 1
    out = raster.withColumn("_own", own).join(small(value), "count")
    share = (F.col("_below") + F.col("_own")) / F.greatest(F.col("_total") - 1, F.lit(1))
    return out.select("px", "py", "count", (floor + (1 - floor) * F.pow(share, gamma)).alias("intensity"))


def orphan_ring(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """Nodes (idx, x, y) that are not placed, on a ring just outside all but the outermost of those that are: (idx, r, a)."""
    edge = nodes.join(placed, "idx", "left_semi").select(F.hypot("x", "y").alias("r"))
    edge = quantiles(edge, {"e": ("r", 0.97)})  # one row
    out = nodes.join(placed, "idx", "left_anti").crossJoin(F.broadcast(edge))
    return out.select("idx", (F.col("e") * (1 + 0.15 * maths.unit_hash(F.col("idx"), 6))).alias("r"), (2 * math.pi * maths.unit_hash(F.col("idx"), 7)).alias("a"))
