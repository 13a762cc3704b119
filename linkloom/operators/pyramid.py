"""One stored pyramid of grid cells for all zoom tiers.

The finest tier is built from nodes and links once; every coarser tier is rolled up from a finer one whose cells it holds
whole (10 from 2, 25 from 1), so its cost is that of the finer tier's cells. A cell keeps its count, its node of highest
degree (representative) and its degree; a pair of cells keeps how many links it stands for. Cells are stored by tier in
the order of a Z-order key of their place, in files of ranges of it, so that a view reads the files that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import graph as g

#: Cells of a tier, in cells of the finest.
TIERS = (1, 2, 4, 10, 25)
CELLS = "tier int, z long, cx long, cy long, n long, idx long, degree long"
PAIRS = "tier int, z long, ax long, ay long, bx long, by long, links long"
#: Ranges of the Z-order key that a look-up asks for.
MOST_RANGES = 16


def z_order(x: Column, y: Column) -> Column:
    """The bits of two numbers below 2**24, one from each in turn."""
    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def z_number(x: int, y: int) -> int:
    return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(24))


def below(tier: int, tiers: tuple[int, ...]) -> int:
    """The tier that another is rolled up from: the coarsest finer one whose cells it holds whole."""
    return max(t for t in tiers if t < tier and tier % t == 0)


def rolled_cells(cells: DataFrame, step: int) -> DataFrame:
    """cells: (cx, cy, n, idx, degree) in cells of `step` times the size. Of equal degrees the smaller idx."""
    best = F.max(F.struct("degree", (-F.col("idx")).alias("i"))).alias("best")
    out = cells.groupBy(F.floor(F.col("cx") / step).alias("cx"), F.floor(F.col("cy") / step).alias("cy")).agg(F.sum("n").alias("n"), best)
    return out.select("cx", "cy", "n", (-F.col("best.i")).alias("idx"), F.col("best.degree").alias("degree"))


def rolled_pairs(pairs: DataFrame, step: int) -> DataFrame:
    """pairs: (ax, ay, bx, by, links), unordered; those within one cell are left out."""
    at = lambda c: F.floor(F.col(c) / step)
    lo, hi = F.least(F.struct(at("ax"), at("ay")), F.struct(at("bx"), at("by"))), F.greatest(F.struct(at("ax"), at("ay")), F.struct(at("bx"), at("by")))
    out = pairs.select(lo.alias("a"), hi.alias("b"), "links").where("a <> b").groupBy("a", "b").agg(F.sum("links").alias("links"))
    return out.select(F.col("a.col1").alias("ax"), F.col("a.col2").alias("ay"), F.col("b.col1").alias("bx"), F.col("b.col2").alias("by"), "links")


def _write(rows: DataFrame, tier: int, path: str) -> DataFrame:
    """Rows of a tier (cx, cy or ax, ay first) in files by ranges of the Z-order key; returns them as stored."""
    x, y = rows.columns[:2]
    keyed = rows.withColumn("z", z_order(F.col(x), F.col(y)))
    keyed.repartitionByRange("z").sortWithinPartitions("z").write.mode("overwrite").parquet(f"{path}/tier={tier}")
    return rows.sparkSession.read.schema(keyed.schema).parquet(f"{path}/tier={tier}").drop("z")


def build(cells: DataFrame, links: DataFrame, path: str, tiers: tuple[int, ...] = TIERS) -> None:
    """cells: (idx, cx, cy, degree) of each node on the finest grid; links: (src, tgt). Writes all tiers. A cell of the
    finest tier with very many nodes is summed before it shuffles, as are a pair's links; ends of links that are no nodes
    are left out."""
    at = cells.select("idx", "cx", "cy")
    finest = cells.select("cx", "cy", F.lit(1).cast("long").alias("n"), "idx", F.col("degree").cast("long").alias("degree"))
    ends = links.select("src", "tgt").join(at.toDF("src", "ax", "ay"), "src").join(at.toDF("tgt", "bx", "by"), "tgt").select("ax", "ay", "bx", "by", F.lit(1).cast("long").alias("links"))
    made: dict[int, tuple[DataFrame, DataFrame]] = {}
    for tier in sorted(tiers):
        source, step = ((finest, ends), tier) if not made else (made[below(tier, tuple(made))], tier // below(tier, tuple(made)))
        made[tier] = _write(rolled_cells(source[0], step), tier, f"{path}/cells"), _write(rolled_pairs(source[1], step), tier, f"{path}/pairs")


def z_ranges(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Few ranges of the key that cover a box of cells: quarters of ever smaller squares, until they are many."""
    side = 1
    while side <= max(x1, y1):
        side *= 2
    todo, out = [(0, 0, side)], []
    while todo:
        if len(todo) + len(out) >= MOST_RANGES:
            out += todo
            break
        x, y, s = todo.pop(0)
        if x > x1 or y > y1 or x + s <= x0 or y + s <= y0:
            continue
        if s == 1 or (x >= x0 and y >= y0 and x + s - 1 <= x1 and y + s - 1 <= y1):
            out.append((x, y, s))
        else:
            h = s // 2
            todo += [(x, y, h), (x + h, y, h), (x, y + h, h), (x + h, y + h, h)]
    spans = sorted((z_number(x, y), z_number(x, y) + s * s - 1) for x, y, s in out if not (x > x1 or y > y1 or x + s <= x0 or y + s <= y0))
    merged: list[tuple[int, int]] = []
    for lo, hi in spans:
        if merged and lo == merged[-1][1] + 1:
            merged[-1] = merged[-1][0], hi
        else:
            merged.append((lo, hi))
    return merged


def _stored(spark: SparkSession, path: str, what: str, schema: str, tier: int, box) -> DataFrame:
    rows = spark.read.schema(schema).parquet(f"{path}/{what}").where(F.col("tier") == tier)
    if box is not None:
        x0, y0, x1, y1 = (max(0, v) for v in box)
        within = F.lit(False)
        for lo, hi in z_ranges(x0, y0, x1, y1):
            within = within | F.col("z").between(lo, hi)
        names = ("cx", "cy") if what == "cells" else ("ax", "ay")
        rows = rows.where(within & F.col(names[0]).between(x0, x1) & F.col(names[1]).between(y0, y1))
    return rows.drop("tier", "z")


def cells_at(spark: SparkSession, path: str, tier: int, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(cx, cy, n, idx, degree) of a tier's cells: counts and representatives; box: of these cells (x0, y0, x1, y1) only."""
    return _stored(spark, path, "cells", CELLS, tier, box)


def bundles_at(spark: SparkSession, path: str, tier: int, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(a, b, links): links between a tier's cells as unordered pairs of their representatives; box: pairs whose first
    cell, by column and row, lies in it."""
    reps = cells_at(spark, path, tier).select("cx", "cy", "idx")
    pairs = _stored(spark, path, "pairs", PAIRS, tier, box)
    out = pairs.join(g.small(reps.toDF("ax", "ay", "p")), ["ax", "ay"]).join(g.small(reps.toDF("bx", "by", "q")), ["bx", "by"])
    return out.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "links")
