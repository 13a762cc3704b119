"""Two-dimensional maps of vectors that keep neighbours together.

Neighbours come from groups of vectors on the same side of random hyperplanes, several divisions of them, and are exact
within a group; few vectors are one group. Distances to them become weights by a bandwidth of each vector's own, found
by bisection, and the weights of the two directions are put together by their probabilistic sum. Positions start from the
two principal axes. A round takes the vectors of each group, with their links and the positions of the other ends, to one
task, which moves its own vectors through some epochs: links, drawn by their weights, pull; other vectors, drawn at
random, push. Other groups' vectors stay where they were until the next round. Draws depend on seed, round and group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import graph as g

#: Vectors of a group at most; divisions; bits that divide at most.
GROUP, TREES, MOST_BITS = 2048, 6, 24
#: Rounds, epochs of a round, vectors that push for each link that pulls, vectors of other groups that push.
ROUNDS, EPOCHS, PUSHED, FAR = 10, 20, 5, 512
#: The curve 1 / (1 + A d ** (2 B)) of closeness in the map, for a least distance of 0.1.
A, B = 1.577, 0.895


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal keys."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not len(t):
            continue
        keys = t.column(key).to_numpy()
        cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        for lo, hi in zip(cut, cut[1:], strict=False):
            yield t.slice(lo, hi - lo)
        held = t.slice(cut[-1])
    if held is not None and len(held):
        yield held


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sides(mean: np.ndarray, bits: int, trees: int, seed: int):
    """(v, vec, tree, side): on which sides of each division's hyperplanes through the mean a vector lies."""
    planes = np.random.default_rng(seed).normal(size=(trees, max(bits, 1), len(mean)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec")) - mean
            for k in range(trees):
                code = ((x @ planes[k].T > 0) << np.arange(planes.shape[1])).sum(axis=1) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([b.column("v"), b.column("vec"), pa.array(np.full(len(x), k, np.int32)), pa.array(code.astype(np.int64))], ["v", "vec", "tree", "side"])

    return run


def nearest_within(k: int):
    """Rows sorted by group: (v, u, d) of each vector's k nearest of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "grp"):
            v, x = t.column("v").to_numpy(), _matrix(t.column("vec"))
            n, norm = min(k, len(v) - 1), (x * x).sum(axis=1)
            if n < 1:
                continue
            for lo in range(0, len(v), 512):
                d = norm[lo : lo + 512, None] + norm[None] - 2 * x[lo : lo + 512] @ x.T
                d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
                best = np.argpartition(d, n - 1, axis=1)[:, :n]
                far = np.sqrt(np.maximum(0, np.take_along_axis(d, best, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(v[lo : lo + 512], n)), pa.array(v[best].ravel()), pa.array(far.ravel())], ["v", "u", "d"])

    return run


def bandwidths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, us, ds ascending) to (v, u, w): exp(-(d - nearest) / s), s such that the weights of a vector sum to log2 of
    their number."""
    for b in batches:
        n = b.column("ds").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(n):
            continue
        d = np.full((len(n), n.max()), np.inf)
        there = np.arange(n.max())[None] < n[:, None]
        d[there] = b.column("ds").flatten().to_numpy()
        off = d - d[:, :1]
        lo, hi, want = np.zeros(len(n)), np.full(len(n), np.inf), np.log2(np.maximum(n, 2))
        s = np.maximum(np.where(there, off, 0).sum(axis=1) / n, 1e-3)
        for _ in range(64):
            total = np.exp(-off / s[:, None]).sum(axis=1)
            over = total > want
            hi, lo = np.where(over, s, hi), np.where(over, lo, s)
            s = np.where(np.isinf(hi), s * 2, (lo + hi) / 2)
        s = np.maximum(s, 1e-3 * np.where(there, d, 0).sum(axis=1) / n + 1e-12)
        w = np.exp(-off / s[:, None])[there]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("v").to_numpy(), n)), b.column("us").flatten(), pa.array(w)], ["v", "u", "w"])


def neighbour_links(vectors: DataFrame, k: int = 15, seed: int = 0) -> DataFrame:
    """vectors: (v long, vec array<double>), saved. (v, u, w) in both directions: each vector's k nearest found, and those
    whose it is, with weights 0 to 1."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = vectors.count()
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(n, 1) / GROUP))))
    mean = [r.m for r in vectors.select(F.posexplode("vec")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()]  # one number a dimension
    divided = vectors.mapInArrow(sides(np.array(mean), bits, TREES if bits else 1, seed), "v long, vec array<double>, tree int, side long")
    size = divided.groupBy("tree", "side").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))
    dealt = divided.join(g.small(size), ["tree", "side"]).withColumn("grp", F.xxhash64("tree", "side", F.pmod(F.xxhash64("v", "tree"), F.col("blocks"))))
    near = dealt.select("grp", "v", "vec").repartition(parts, "grp").sortWithinPartitions("grp", "v").mapInArrow(nearest_within(k), "v long, u long, d double")
    best = near.groupBy("v", "u").agg(F.min("d").alias("d")).groupBy("v").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "u"))), 1, k).alias("x"))
    weighed = best.select("v", F.col("x.u").alias("us"), F.col("x.d").alias("ds")).mapInArrow(bandwidths, "v long, u long, w double")
    pair = weighed.groupBy(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).agg(F.sum("w").alias("s"), F.max("w").alias("m"))
    union = F.col("s") - F.col("m") * (F.col("s") - F.col("m"))  # of the one or two weights p and q: p + q - p q
    both = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u"))))
    return pair.select(union.alias("w"), both.alias("e")).select("e.v", "e.u", "w")


def moved(far: list[tuple[float, float]], round_: int, rounds: int, seed: int):
    """Rows (grp, v, x, y, links: array of (u, w, ux, uy)) sorted by group and v: (v, x, y) after a round."""
    outside = np.array(far, np.float64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "grp"):
            t = t.combine_chunks()
            v, at = t.column("v").to_numpy(), np.stack([t.column("x").to_numpy(), t.column("y").to_numpy()], axis=1).copy()
            links = t.column("links").combine_chunks()
            n = links.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, head = links.flatten(), np.repeat(np.arange(len(v)), n)
            u, w = flat.field("u").to_numpy(), flat.field("w").to_numpy()
            order = np.argsort(v)
            place = order[np.minimum(np.searchsorted(v[order], u), len(v) - 1)]
            mine = v[place] == u
            there = np.stack([flat.field("ux").to_numpy(), flat.field("uy").to_numpy()], axis=1)
            draw = np.random.default_rng([seed, round_, int(t.column("grp")[0].as_py()) & (1 << 62) - 1])
            for epoch in range(EPOCHS):
                rate = 1.0 - (round_ * EPOCHS + epoch) / (rounds * EPOCHS)
                e = np.flatnonzero(draw.random(len(w)) < w)
                other = np.where(mine[e, None], at[place[e]], there[e])
                step = at[head[e]] - other
                d2 = (step * step).sum(axis=1)
                pull = np.where(d2 > 0, -2 * A * B * d2 ** (B - 1) / (1 + A * d2**B), 0.0) if len(e) else d2
                push_i = np.repeat(head[e], PUSHED)
                pool = np.concatenate((at, outside))
                chosen = draw.integers(0, len(pool), len(push_i))
                away = at[push_i] - pool[chosen]
                a2 = (away * away).sum(axis=1)
                push = np.where(chosen == push_i, 0.0, 2 * B / ((1e-3 + a2) * (1 + A * a2**B)))
                move = np.zeros_like(at)
                np.add.at(move, head[e], np.clip(pull[:, None] * step, -4, 4))
                np.add.at(move, push_i, np.clip(push[:, None] * away, -4, 4))
                at += rate * np.clip(move, -8, 8) * 0.25
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(at[:, 0]), pa.array(at[:, 1])], ["v", "x", "y"])

    return run


def neighbour_map(vectors: DataFrame, k: int = 15, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """vectors: (v long, vec array<double>) of one length. (v, x, y): a map in which vectors' nearest lie near.

    Null vectors are left out; ids are distinct. Vectors that are equal come to lie together. No vectors: no rows."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = g.reliable(vectors.where("vec is not null and v is not null").select(F.col("v").cast("long").alias("v"), F.col("vec").cast("array<double>").alias("vec")))
    n = vectors.count()
    if n < 3:
        return vectors.select("v", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    links = g.reliable(neighbour_links(vectors, k, seed))
    start = g.project(vectors.select(F.col("v").alias("idx"), F.col("vec").alias("vector")))
    wide = start.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y"))).alias("m")).first().m or 1.0
    # the last digits of the axes depend on the order of sums; the map shall not
    at = g.reliable(start.select(F.col("idx").alias("v"), F.round(F.col("x") * (10 / wide), 4).alias("x"), F.round(F.col("y") * (10 / wide), 4).alias("y")))
    for r in range(rounds):
        # groups by place: quarters of the map that hold few enough, in blocks by hash where they still hold many
        side = 2 ** max(0, math.ceil(math.log2(max(1.0, n / GROUP)) / 2))
        span = at.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
        cell = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / max(hi - lo, 1e-9) * side), F.lit(side - 1))  # noqa: B023, E731
        placed = at.withColumn("cell", cell("x", span.x0, span.x1) * side + cell("y", span.y0, span.y1))
        size = placed.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))
        placed = placed.join(g.small(size), "cell").withColumn("grp", F.xxhash64("cell", F.pmod(F.xxhash64("v"), F.col("blocks"))))
        ends = links.join(at.select(F.col("v").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u")
        ends = ends.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("u", "w", "ux", "uy"))).alias("links"))
        rows = placed.join(ends, "v", "left").select("grp", "v", "x", "y", F.coalesce("links", F.array().cast("array<struct<u:bigint,w:double,ux:double,uy:double>>")).alias("links"))
        far = [(q.x, q.y) for q in at.orderBy(F.xxhash64("v", F.lit(seed * 1000 + r))).limit(FAR).collect()]
        new = g.reliable(rows.repartition(parts, "grp").sortWithinPartitions("grp", "v").mapInArrow(moved(far, r, rounds, seed), "v long, x double, y double"))
        g.drop(at)
        at = new
    g.drop(links)
    return at
