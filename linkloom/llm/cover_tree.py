"""Exact cosine threshold pairs of embeddings by a dual traversal of a cover tree.

On unit vectors a cosine of c is a distance of e = sqrt(2 - 2 c). A tree of nested levels with halving radii holds the
vectors: every node has one of them as its centre, its children's centres (its own among them) are farther apart than
half its level's radius, and it knows the largest distance of a vector below it from its centre. Two nodes whose centres
are farther apart than both these radii and e have no pair. Two whose centres are nearer than e less both radii are
linked throughout: their sizes are added to each other's counts, and no pair is written down. All others are replaced by
their children. So a group of thousands of near copies costs as many steps as it has nodes near e, not its pairs.

The upper levels are tables: centres are elected in a bounded sample of each node that is too large for one task, its
vectors go to the nearest within the level's radius, and those that no centre reaches stay with the node's own. What
still is too large in the end is dealt out in blocks by hash. Pairs of nodes are followed down these levels by joins. A
block's own tree goes on below in one task, and a meeting of two blocks is a traversal of their trees in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .nearest import bounds, whole_groups
from .shared import Scratch, binary_column, bounded, mix64

#: Bytes of a block's vectors, and rows at most and at least.
UNIT_BYTES, MOST_UNIT, LEAST_UNIT = 1 << 20, 8192, 256
#: Sampled vectors of a node for each block that it would fill; in all at least and at most; those that a centre must
#: cover to stand.
SAMPLE_RATIO, LEAST_SAMPLE, MOST_SAMPLE, LEAST_COVERED = 8, 256, 2048, 2
#: Rows of a block's node that is not divided further if its radius is within e, and the radius of one that need not be.
LEAF_ROWS, TINY = 16, 1e-6
#: Distances from products in double precision are right to this.
SLACK = 1e-6
#: Products of one matrix that are held at a time, pairs of nodes taken at a time, edges kept before they are thinned.
PRODUCTS, TAKEN, EDGES = 1 << 20, 1 << 14, 1 << 20
#: Bytes of centres that may be broadcast; more are joined.
BROADCAST_BYTES = 16 << 20


def reach(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def distance(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * dot))


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def net(u: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres farther apart than r such that every row lies within r of one, the first row being the first; for each row
    the nearest centre (its place among them), and the product with it."""
    near, n = 1 - r * r / 2, len(u)
    best, owner, centres, left = np.full(n, -2.0), np.zeros(n, np.int64), [], np.arange(n)
    while len(left):
        some = left[:128]
        close = u[some] @ u[some].T >= near
        free, chosen = np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                chosen.append(i)
                free &= ~close[i]
        new = some[chosen]
        for lo in range(0, n, PRODUCTS // 128):
            dots = u[new] @ u[lo : lo + PRODUCTS // 128].T
            top = dots.argmax(axis=0)
            value = np.take_along_axis(dots, top[None], 0)[0]
            better = value > best[lo : lo + len(value)]
            owner[lo : lo + len(value)][better] = top[better] + len(centres)
            best[lo : lo + len(value)][better] = value[better]
        owner[new], best[new] = np.arange(len(centres), len(centres) + len(new)), 1.0
        centres += new.tolist()
        left = left[(best[left] < near)]
    return np.array(centres, np.int64), owner, best


class Tree:
    """A cover tree of one block. Rows stand in an order in which every node's are next to each other, its centre first;
    a node's children are next to each other too."""

    FIELDS = ("start", "end", "radius", "child", "children")

    def __init__(self, u: np.ndarray, **fields):
        self.u = u
        for c in self.FIELDS:
            setattr(self, c, fields[c])

    @classmethod
    def grow(cls, u: np.ndarray, eps: float) -> tuple[Tree, np.ndarray]:
        """The tree, and the rows in its order."""
        n, order = len(u), np.arange(len(u))
        start, end, child, children = [0], [n], [0], [0]
        radius = [float(distance((u @ u[0]).min()))]
        at = 0
        while at < len(start):
            a, b = start[at], end[at]
            if b - a > 1 and radius[at] > (TINY if b - a > LEAF_ROWS else eps):
                r = 2.0 ** math.ceil(math.log2(radius[at])) / 2
                rows = order[a:b]
                centres, owner, best = net(u[rows], r)
                if len(centres) > 1:
                    first = np.ones(b - a, bool)
                    first[centres] = False
                    by = np.lexsort((first, owner))
                    order[a:b] = rows[by]
                    cut = np.searchsorted(owner[by], np.arange(len(centres) + 1))
                    child[at], children[at] = len(start), len(centres)
                    start += (a + cut[:-1]).tolist()
                    end += (a + cut[1:]).tolist()
                    radius += distance(np.minimum.reduceat(best[by], cut[:-1])).tolist()
                    child += [0] * len(centres)
                    children += [0] * len(centres)
            at += 1
        ints = {c: np.array(v, np.int64) for c, v in (("start", start), ("end", end), ("child", child), ("children", children))}
        return cls(u[order], radius=np.array(radius), **ints), order


class Meeting:
    """Two blocks: for each of their rows the weight of the others' linked rows, and edges that span what is linked."""

    def __init__(self, a: Tree, b: Tree | None, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float):
        """b None: the block meets itself, every row being linked with itself too."""
        self.alone, self.cosine, self.reach = b is None, cosine, reach(cosine)
        self.t, self.w = (a, a if b is None else b), (weight_a, weight_b)
        self.upto = [np.concatenate(([0], np.cumsum(w))) for w in self.w]
        self.change = [np.zeros(len(t.u) + 1, np.int64) for t in self.t]
        self.links = [np.zeros(len(t.u), np.int64) for t in self.t]
        self.shift = 0 if b is None else len(a.u)
        self.label = np.arange(len(a.u) + (0 if b is None else len(b.u)))
        self.ends: list[np.ndarray] = []
        self.held = 0
        stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
        if not len(a.u) or not len(self.t[1].u):
            stack = []
        else:
            stack = [self.sift(0, stack[0][0], np.zeros(1, np.int64))]
        while stack:
            i, j = stack.pop()
            if len(i) > TAKEN:
                stack.append((i[TAKEN:], j[TAKEN:]))
                i, j = i[:TAKEN], j[:TAKEN]
            p, q = self.t
            leaf = (p.children[i] == 0) & (q.children[j] == 0)
            self.leaves(i[leaf], j[leaf])
            i, j = i[~leaf], j[~leaf]
            second = (q.children[j] > 0) & ((p.children[i] == 0) | (q.radius[j] >= p.radius[i]))
            for side, x, y in ((1, i[second], j[second]), (0, j[~second], i[~second])):
                # y is replaced by its children
                order = np.argsort(y, kind="stable")
                x, y = x[order], y[order]
                cut = bounds([y])
                for lo, hi in zip(cut, cut[1:], strict=False):
                    if hi > lo:
                        t = self.t[side]
                        kids = np.arange(t.child[y[lo]], t.child[y[lo]] + t.children[y[lo]])
                        step = max(1, PRODUCTS // len(kids))
                        for k in range(lo, hi, step):
                            left = self.sift(side, x[k : min(hi, k + step)], kids)
                            if len(left[0]):
                                stack.append(left if side else left[::-1])
        for k in (0, 1):
            self.links[k] += np.cumsum(self.change[k])[:-1]
        self.thin()

    def sift(self, side: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes x of the other side against all of y of this side: the pairs that are neither too far nor linked
        throughout. side 1: y of the second tree."""
        s, t = self.t[1 - side], self.t[side]
        d = distance(s.u[s.start[x]] @ t.u[t.start[y]].T)
        both = s.radius[x][:, None] + t.radius[y][None, :]
        i, j = np.nonzero(d <= both + (self.reach + SLACK))
        whole = d[i, j] + both[i, j] <= self.reach - SLACK
        i, j = x[i], y[j]
        if whole.any():
            self.whole(*((i[whole], j[whole]) if side else (j[whole], i[whole])))
        return i[~whole], j[~whole]

    def whole(self, i: np.ndarray, j: np.ndarray) -> None:
        """All rows of nodes i are linked with all of nodes j."""
        p, q = self.t
        for k, (t, x, w, y) in enumerate(((p, i, self.upto[1], (q.start[j], q.end[j])), (q, j, self.upto[0], (p.start[i], p.end[i])))):
            if k and self.alone:
                break
            n = w[y[1]] - w[y[0]]
            np.add.at(self.change[k], t.start[x], n)
            np.add.at(self.change[k], t.end[x], -n)
        self.join(p.start[i], q.start[j])
        for k, (t, x) in enumerate(((p, i), (q, j))):
            x = np.unique(x)
            n = t.end[x] - t.start[x]
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(t.start[x], n)
            self.join(*(np.repeat(t.start[x], n), rows), both=k)

    def leaves(self, i: np.ndarray, j: np.ndarray) -> None:
        """Rows of nodes i against rows of nodes j."""
        p, q = self.t
        n, m = p.end[i] - p.start[i], q.end[j] - q.start[j]
        few = n * m <= LEAF_ROWS**2
        upto = np.cumsum(n[few] * m[few])
        step = max(1, PRODUCTS // (8 * p.u.shape[1]))
        lo = 0
        while lo < len(upto):  # pairs of small nodes, row by row
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + step, "right")))
            a, b = i[few][lo:hi], j[few][lo:hi]
            width = q.end[b] - q.start[b]
            count = (p.end[a] - p.start[a]) * width
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            width = np.repeat(width, count)
            x, y = np.repeat(p.start[a], count) + k // width, np.repeat(q.start[b], count) + k % width
            hit = np.einsum("ij,ij->i", p.u[x], q.u[y]) >= self.cosine
            if self.alone:
                hit |= x == y
            x, y = x[hit], y[hit]
            np.add.at(self.links[0], x, self.w[1][y])
            if not self.alone:
                np.add.at(self.links[1], y, self.w[0][x])
            self.join(x, y)
            lo = hi
        i, j = i[~few], j[~few]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        cut = bounds([i])
        for lo, hi in zip(cut, cut[1:], strict=False):
            if hi == lo:
                continue
            own = np.arange(p.start[i[lo]], p.end[i[lo]])
            n = q.end[j[lo:hi]] - q.start[j[lo:hi]]
            others = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(q.start[j[lo:hi]], n)
            step = max(1, PRODUCTS // len(own))
            for k in range(0, len(others), step):
                some = others[k : k + step]
                hit = p.u[own] @ q.u[some].T >= self.cosine
                if self.alone:
                    hit |= own[:, None] == some[None, :]
                self.links[0][own] += hit @ self.w[1][some]
                if not self.alone:
                    self.links[1][some] += self.w[0][own] @ hit
                x, y = np.nonzero(hit)
                self.join(own[x], some[y])

    def join(self, x: np.ndarray, y: np.ndarray, both: int | None = None) -> None:
        """Edges from rows x to rows y; both: both of this side's rows."""
        a, b = (0, self.shift) if both is None else (both * self.shift,) * 2
        self.ends.append(np.stack((x + a, y + b)))
        self.held += len(x)
        if self.held > EDGES:
            self.thin()

    def thin(self) -> None:
        """Edges kept so far become labels: of rows that they join the smallest."""
        if self.ends:
            x, y = np.concatenate(self.ends, axis=1)
            self.ends, self.held = [], 0
            while True:
                low = np.minimum(self.label[x], self.label[y])
                new = self.label.copy()
                for at in (x, y, self.label[x], self.label[y]):
                    np.minimum.at(new, at, low)
                new = new[new]
                if (new == self.label).all():
                    break
                self.label = new


def blob(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *[a.tobytes() for a in arrays]])


def unblob(data: pa.Buffer, kinds: list[str]) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def pack(kind: str, eps: float):
    """Rows sorted by (node, block) to one row for each: its classes, copies and vectors in the order of its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["node", "block"]):
            cut = bounds([t.column("node").to_numpy(), t.column("block").to_numpy()])
            for a, b in zip(cut, cut[1:], strict=False):
                one = t.slice(int(a), int(b - a)).combine_chunks()
                x = matrix(one.column("vec"), kind)
                tree, order = Tree.grow(unit_vectors(x), eps)
                data = blob(one.column("cls").to_numpy()[order], one.column("copies").to_numpy()[order], x[order].ravel(), *[getattr(tree, c) for c in Tree.FIELDS])
                yield pa.RecordBatch.from_arrays([one.column("node").combine_chunks()[:1], one.column("block").combine_chunks()[:1], pa.array([data], pa.binary())], ["node", "block", "data"])

    return run


def matrix(column, kind: str) -> np.ndarray:
    offsets, data = binary_column(column)
    return np.ascontiguousarray(data).view(kind).reshape(len(offsets) - 1, -1)


def load(data: pa.Buffer, kind: str) -> tuple[np.ndarray, np.ndarray, Tree]:
    cls, copies, x, *fields = unblob(data, ["<i8", "<i8", kind, *["<f8" if c == "radius" else "<i8" for c in Tree.FIELDS]])
    return cls, copies, Tree(unit_vectors(x.reshape(len(cls), -1)), **dict(zip(Tree.FIELDS, fields, strict=True)))


def meetings(cosine: float, kind: str):
    """Pairs of blocks (x, y; y null: x with itself): (a, b, links), classes that are linked with any, one of theirs that
    they reach by links of this meeting, and the weight of those that they link with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                cls_a, w_a, a = load(x.as_buffer(), kind)
                cls_b, w_b, b = load(y.as_buffer(), kind) if y.is_valid else (cls_a[:0], w_a, None)
                m = Meeting(a, b, w_a, w_b, cosine)
                links = m.links[0] if b is None else np.concatenate(m.links)
                every, at = np.concatenate((cls_a, cls_b)), np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(every[at]), pa.array(every[m.label[at]]), pa.array(links[at])], ["a", "b", "links"])

    return run


def elect(r: float, kind: str):
    """Sampled rows sorted by node, with the node's centre: centres farther apart than r that cover enough of the
    sample: (node, child, cls, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["node"]):
            node = t.column("node").to_numpy()
            cut = bounds([node])
            for a, b in zip(cut, cut[1:], strict=False):
                one = t.slice(int(a), int(b - a)).combine_chunks()
                own = one.column("centre").combine_chunks()[:1]
                vecs = pa.concat_arrays([own, one.column("vec").combine_chunks()])
                cls = np.concatenate((one.column("centre_cls").to_numpy()[:1], one.column("cls").to_numpy()))
                centres, owner, _ = net(unit_vectors(matrix(vecs, kind)), r)
                keep = centres[np.bincount(owner, minlength=len(centres)) >= LEAST_COVERED]
                child = mix64(cls[keep].view(np.uint64) ^ mix64(np.full(len(keep), node[a]).view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), node[a])), pa.array(child), pa.array(cls[keep]), vecs.take(pa.array(keep))], ["node", "child", "cls", "vec"])

    return run


def assign(r: float, kind: str):
    """Rows with the centres of their node's children: each one's child and distance from its centre, or the node's rest
    and the distance from the node's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy()
            child, far, u = mix64(~node.view(np.uint64)).view(np.int64), np.zeros(len(b)), unit_vectors(matrix(b.column("vec"), kind)) if len(b) else None
            for n in np.unique(node):
                at = np.flatnonzero(node == n)
                own = unit_vectors(matrix(b.column("centre").slice(int(at[0]), 1), kind))
                far[at] = distance(u[at] @ own[0])
                kids = b.column("kids")[int(at[0])]
                if kids.is_valid and len(kids.values):
                    c = unit_vectors(matrix(kids.values.field("vec"), kind))
                    ids = kids.values.field("child").to_numpy()
                    for lo in range(0, len(at), max(1, PRODUCTS // len(c))):
                        some = at[lo : lo + max(1, PRODUCTS // len(c))]
                        dots = u[some] @ c.T
                        best = dots.argmax(axis=1)
                        d = distance(dots[np.arange(len(some)), best])
                        ok = d <= r
                        child[some[ok]], far[some[ok]] = ids[best[ok]], d[ok]
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("copies"), b.column("vec"), b.column("node"), pa.array(child), pa.array(far)], ["cls", "copies", "vec", "parent", "node", "far"])

    return run


def as_bytes(kind: str):
    """Vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column("vec")
            n = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            data = vec.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = (np.concatenate(([0], np.cumsum(n))) * data.itemsize).astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("copies"), b.column("rep"), pa.array(n.astype(np.int32)), out], ["cls", "copies", "rep", "dim", "vec"])

    return run


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


class Levels:
    """The upper levels as tables. nodes: (node, parent, centre_cls, centre, radius, rows, weight, leaf); placed: (cls,
    copies, vec, node) of every vector, node being a leaf."""

    def __init__(self, classes: DataFrame, kind: str, eps: float, scratch: Scratch):
        self.scratch, self.kind, self.eps = scratch, kind, eps
        parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        width = np.dtype(kind).itemsize
        root = F.xxhash64(F.lit("root"), "dim")
        placed = scratch.save(classes.select("cls", "copies", "vec", root.alias("node"), "dim"))
        nodes = placed.groupBy("node", "dim").agg(F.min("cls").alias("centre_cls"), F.min_by("vec", "cls").alias("centre"), F.count("*").alias("rows"), F.sum("copies").alias("weight"))
        most = F.greatest(F.lit(LEAST_UNIT), F.least(F.lit(MOST_UNIT), (UNIT_BYTES / (width * F.greatest("dim", F.lit(1)))).cast("long")))
        nodes = scratch.save(nodes.select("node", F.lit(None).cast("long").alias("parent"), "centre_cls", "centre", F.lit(2.0).alias("radius"), "rows", "weight", most.alias("unit")))
        placed, every, r, self.depth = placed.drop("dim"), nodes, 1.0, 1
        settled = None
        while r > eps / 4:
            large = nodes.where((F.col("rows") > F.col("unit")) & (2 * F.col("radius") > eps - SLACK))
            large = scratch.save(large)
            if large.isEmpty():
                break
            wanted = F.least(F.lit(MOST_SAMPLE), F.greatest(F.lit(LEAST_SAMPLE), SAMPLE_RATIO * F.col("rows") / F.col("unit")))
            of = large.select("node", "centre_cls", "centre", (wanted / F.col("rows")).alias("share"))
            few = large.agg(F.sum(F.length("centre"))).first()[0] <= BROADCAST_BYTES
            mine = placed.join(F.broadcast(of) if few else of, "node")
            draw = F.pmod(F.xxhash64("cls", F.lit(r)), F.lit(1 << 30)) / float(1 << 30)
            sample = bounded(mine).where(draw < F.col("share")).select("node", "cls", "vec", "centre_cls", "centre").repartition(parts, "node").sortWithinPartitions("node", "cls")
            kids = scratch.save(sample.mapInArrow(elect(r, kind), "node long, child long, cls long, vec binary"))
            told = of.join(kids.groupBy("node").agg(F.collect_list(F.struct("child", "vec")).alias("kids")), "node", "left").select("node", "centre", "kids")
            few = few and (kids.agg(F.coalesce(F.sum(F.length("vec")), F.lit(0))).first()[0] <= BROADCAST_BYTES)
            moved = bounded(placed.join(F.broadcast(told) if few else told, "node")).select("cls", "copies", "vec", "node", "centre", "kids")
            moved = scratch.save(moved.mapInArrow(assign(r, kind), "cls long, copies long, vec binary, parent long, node long, far double"))
            stays = placed.join(F.broadcast(large.select("node")) if few else large.select("node"), "node", "left_anti")
            settled = scratch.save(stays) if settled is None else settled.unionByName(scratch.save(stays))
            stats = moved.groupBy("node", "parent").agg(F.max("far").alias("radius"), F.count("*").alias("rows"), F.sum("copies").alias("weight"))
            elected = kids.select(F.col("child").alias("node"), F.col("cls").alias("kid_cls"), F.col("vec").alias("kid"))
            above = large.select(F.col("node").alias("parent"), "centre_cls", "centre", "unit")
            new = stats.join(elected, "node", "left").join(above, "parent")
            nodes = scratch.save(new.select("node", "parent", F.coalesce("kid_cls", "centre_cls").alias("centre_cls"), F.coalesce("kid", "centre").alias("centre"), "radius", "rows", "weight", "unit"))
            every, placed = every.unionByName(nodes), moved.select("cls", "copies", "vec", "node")
            self.depth, r = self.depth + 1, r / 2
        self.placed = placed if settled is None else settled.unionByName(placed)
        inner = every.where("parent is not null").select(F.col("parent").alias("node")).distinct()
        self.nodes = scratch.save(every.join(inner.withColumn("inner", F.lit(True)), "node", "left").withColumn("leaf", F.col("inner").isNull()).drop("inner"))

    def packed(self) -> DataFrame:
        """(node, block, data) of the leaves, large ones in blocks by hash."""
        parts = int(self.placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        leaves = self.nodes.where("leaf").select("node", F.ceil(F.col("rows") / F.col("unit")).cast("int").alias("blocks"))
        dealt = self.placed.join(leaves, "node").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        return bounded(dealt).select("node", "block", "cls", "copies", "vec").repartition(parts, "node", "block").sortWithinPartitions("node", "block", "cls").mapInArrow(pack(self.kind, self.eps), "node long, block int, data binary")

    def traverse(self) -> tuple[DataFrame, DataFrame]:
        """(a, b) of leaves that may have pairs, and of nodes that are linked throughout; a node may meet itself."""
        unit = {"f": "<f4", "d": "<f8"}[np.dtype(self.kind).char]

        def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [unit_vectors(np.frombuffer(x.as_buffer(), unit)[None])[0] for x in b.column("centre")]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("up", "node", "radius")], pa.array(rows, pa.list_(pa.float64())), b.column("leaf")], ["up", "node", "radius", "at", "leaf"])

        below = self.nodes.where("parent is not null").select(F.col("parent").alias("up"), "node", "radius", "centre", "leaf")
        same = self.nodes.where("leaf").select(F.col("node").alias("up"), "node", "radius", "centre", "leaf")
        kids = self.scratch.save(below.unionByName(same).mapInArrow(decoded, "up long, node long, radius double, at array<double>, leaf boolean"))
        side = lambda s: kids.select(*[F.col(c).alias(f"{c}_{s}") for c in ("up", "node", "radius", "at", "leaf")])
        roots = self.nodes.where("parent is null").select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(False).alias("whole"))
        pairs, linked = self.scratch.save(roots), None
        for _ in range(self.depth):
            met = pairs.join(side("a"), F.col("a") == F.col("up_a")).join(side("b"), F.col("b") == F.col("up_b")).where("a <> b or node_a <= node_b")
            dot = F.aggregate(F.zip_with("at_a", "at_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            d = F.when(F.col("node_a") == F.col("node_b"), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)))
            both = F.col("radius_a") + F.col("radius_b")
            met = met.withColumn("d", d).where(F.col("d") <= both + (self.eps + SLACK))
            met = self.scratch.save(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), (F.col("d") + both <= self.eps - SLACK).alias("whole")))
            done = met.where("whole").select("a", "b")
            linked = done if linked is None else linked.unionByName(done)
            pairs = met.where("not whole")
        return pairs.select("a", "b"), linked


def threshold_components(rows: DataFrame, cosine: float = 0.95) -> DataFrame:
    """rows: (vec_id long, embedding array of float or double). One row per row: vec_id, n_links (other rows at a cosine
    of `cosine` or more, between 0 and 1), component_id (smallest vec_id reachable by links, itself included), kept
    (vec_id is component_id).

    Vectors that are null, zero or empty, or hold null or non-finite components, and rows with a null vec_id, link with
    nothing: n_links 0, their own component, kept. Vectors of different dimension link with nothing of each other. Equal
    vectors are one class (told by a 64-bit hash) that is compared once; repeated rows count each. No rows: no rows. Extra
    columns are ignored."""
    spark = rows.sparkSession
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    scratch = Scratch(spark, "cover")
    good = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").select("vec_id", "embedding", F.when(good, F.xxhash64("embedding")).alias("cls"))
    ids = own.select("vec_id", "cls")
    grouped = own.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"), F.any_value("embedding").alias("vec"))
    classes = scratch.save(bounded(grouped).mapInArrow(as_bytes(kind), "cls long, copies long, rep long, dim int, vec binary"))
    levels = Levels(classes.drop("rep"), kind, reach(cosine), scratch)
    pairs, linked = levels.traverse()
    linked = scratch.save(linked)
    packed, parts = scratch.save(levels.packed()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = lambda x: packed.select(F.col("node").alias(x), F.col("block").alias(f"block_{x}"), F.col("data").alias({"a": "x", "b": "y"}[x]))
    jobs = pairs.join(block("a"), "a").join(block("b"), "b").where("a <> b or block_a <= block_b")
    # meetings are work, not bytes: they are dealt out by their number
    jobs = jobs.repartition(parts, F.xxhash64("a", "block_a", "b", "block_b")).select("x", F.when((F.col("a") != F.col("b")) | (F.col("block_a") != F.col("block_b")), F.col("y")).alias("y"))
    found = scratch.save(bounded(jobs).mapInArrow(meetings(cosine, kind), "a long, b long, links long"))
    # nodes that are linked throughout: every vector below gets the other's weight and an edge to its node's centre
    of = levels.nodes.select("node", "weight", "centre_cls")
    gains = linked.join(of.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "weight").unionByName(
        linked.where("a <> b").join(of.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "weight")
    )
    gains = gains.groupBy("node").agg(F.sum("weight").alias("links"))
    up = levels.nodes.select(F.col("node").alias("above"), "parent")
    line = levels.nodes.where("leaf").select(F.col("node").alias("leaf"), F.col("node").alias("above"))
    lines = line
    for _ in range(levels.depth - 1):
        line = line.join(up, "above").where("parent is not null").select("leaf", F.col("parent").alias("above"))
        lines = lines.unionByName(line)
    gained = scratch.save(lines.join(gains, F.col("above") == F.col("node")).drop("node").join(of.select(F.col("node").alias("above"), F.col("centre_cls").alias("b")), "above").select(F.col("leaf").alias("node"), "b", "links"))
    stars = levels.placed.select(F.col("cls").alias("a"), "node").join(gained, "node").select("a", "b", "links")
    found = found.unionByName(scratch.save(stars))
    centres = linked.join(of.select(F.col("node").alias("a"), F.col("centre_cls").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("centre_cls").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    comps = connected_components(scratch, found.select("a", "b").unionByName(centres))
    totals = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    each = classes.select("cls", "rep").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    named = each.join(each.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").join(totals, "cls").select("cls", (F.col("links") - 1).alias("n_links"), "component_id")
    named = scratch.save(named)
    scratch.keep(named)
    alone = F.col("cls").isNull()
    return ids.join(named, "cls", "left").select(
        "vec_id", F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("vec_id") == F.col("component_id"))).alias("kept"),
    )
