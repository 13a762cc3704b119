"""Undirected graphs in blocks of nodes, for rounds in which every link reads both its ends.

The links are stored once, packed by the blocks of their two ends and in buckets of the first. A round sends each block's
values to every block, as one row, and adds up what the links give where they are stored: it moves nodes times blocks and
never a row for a link. Columns of a block are bytes of numpy arrays, in order of idx."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.operators import graph as g

#: Links of a pair of blocks that become a row of bytes at a time, about; of weighted links those of a pair of blocks, as a
#: row of them is sorted at once, and those of a part of a block's nodes, which are gathered before they are weighed.
ROW_LINKS, WEIGHED_LINKS, PART_LINKS = 1_000_000, 1_000_000, 2_000_000
#: Blocks at least; links of a pair of blocks, and links that are worked on at a time, about; rows of an unpacked batch,
#: bytes of a batch that goes to Python if it holds more than a row.
LEAST_BLOCKS, CELL_LINKS, LINKS_AT_ONCE, ROWS, ARROW_BYTES = 8, 6_000_000, 1 << 19, 1 << 14, 8 << 20
#: Cells to a side of a tile in which near nodes meet, and nodes that meet others at a time.
TILE, MEET_AT_ONCE = 32, 1 << 12


def array(b: pa.RecordBatch | pa.Table, c: str, kind: type, r: int = 0) -> np.ndarray:
    return np.frombuffer(b.column(c)[r].as_buffer(), kind)


def packed(rows: DataFrame, kinds: dict[str, type]) -> DataFrame:
    """rows: (block, idx, ...). (block, columns of kinds) with a row for each block."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("idx").to_numpy(), kind="stable")
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32())} | {c: pa.array([t.column(c).to_numpy()[order].astype(k).tobytes()], pa.binary()) for c, k in kinds.items()})

    return rows.select("block", "idx", *[c for c in kinds if c != "idx"]).groupBy("block").applyInArrow(run, "block int" + "".join(f", {c} binary" for c in kinds))


def unpacked(blocks: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of packed blocks; columns: Spark's type, bigint or double, of each."""
    kinds = {"bigint": np.int64, "double": np.float64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                all_ = [array(b, c, kinds[k], r) for c, k in columns.items()]
                for lo in range(0, len(all_[0]), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + ROWS]) for v in all_], list(columns))

    return blocks.select(*columns).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in columns.items()))


def _cell(links: pa.Table, ids: pa.Table, parts: int) -> pa.Table:
    """The links of a pair of blocks, or of some of its sources, each once, by places in their blocks and in so many rows by
    source; w: their weights summed, if they have some; deg: each source's links, also to no node."""
    weighted = "w" in links.column_names
    names = ["i", "p", "j", "s", "t", "deg"] + ["w"] * weighted
    of = {w: array(ids, "ids", np.int64, r) for r, w in enumerate(ids.column("which").to_pylist())}
    if len(of) < 2:
        return pa.table([pa.array([], k) for k in [pa.int32()] * 3 + [pa.binary()] * (len(names) - 3)], names)
    src, tgt = (links.column(c).to_numpy() for c in ("src", "tgt"))
    s = np.minimum(np.searchsorted(of[0], src), len(of[0]) - 1)
    there = of[0][s] == src
    s, tgt = s[there], tgt[there]
    t = np.minimum(np.searchsorted(of[1], tgt), len(of[1]) - 1)
    hit = of[1][t] == tgt
    out = np.unique(np.stack([s[~hit], tgt[~hit]]), axis=1)[0]
    key, w = s[hit] * len(of[1]) + t[hit], links.column("w").to_numpy()[there][hit] if weighted else None
    if weighted:
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        first = heads(key)
        one, w = key[first], np.add.reduceat(w, first) if len(first) else w
    else:
        one = np.unique(key)
    s, t = np.divmod(one, len(of[1]))
    deg = np.bincount(s, minlength=len(of[0])) + np.bincount(out, minlength=len(of[0]))
    i, p, j = (ids.column(c)[0].as_py() for c in ("i", "p", "j"))
    ends = np.searchsorted(s, [len(of[0]) * r // parts for r in range(parts + 1)]).tolist()
    rows = [(i, p + r, j, *[v[lo:hi].astype(np.int32).tobytes() for v in (s, t)], (deg if r == 0 else deg[:0]).astype(np.int32).tobytes(), *([w[lo:hi].tobytes()] if weighted else [])) for r, (lo, hi) in enumerate(zip(ends, ends[1:]))]
    return pa.table([pa.array(c, pa.int32() if k < 3 else pa.binary()) for k, c in enumerate(zip(*rows))], names)


class Blocks:
    """links: (src, tgt), either way and any number of times; self-loops and links to what is no node are left out, but
    the latter count in degrees. With a column w (double), weights of a link add up. nodes: (idx), each once."""

    def __init__(self, links: DataFrame, nodes: DataFrame):
        spark = links.sparkSession
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        self.w = w = ["w"] if "w" in links.columns else []
        ends = g.reliable(links.select("src", "tgt", *w).where("src <> tgt"))
        arcs = 2 * ends.count()
        n = max(LEAST_BLOCKS, math.ceil(math.sqrt(arcs / (WEIGHED_LINKS if w else CELL_LINKS))))
        self.n = n = n | 1 if w else n  # odd: nodes of a block have hashes of either parity
        some, parts = (1, -(-arcs // (n * PART_LINKS)) or 1) if w else (-(-arcs // (n * n * ROW_LINKS)) or 1, 1)
        self.ids = g.reliable(packed(nodes.select(self.block(F.col("idx")).alias("block"), "idx"), {"idx": np.int64}))
        both = ends.select(F.explode(F.array(F.struct("src", "tgt", *w), F.struct(F.col("tgt").alias("src"), F.col("src").alias("tgt"), *w))).alias("e")).select("e.*")
        both = both.select(self.block(F.col("src")).alias("i"), F.pmod(F.shiftright(F.xxhash64("src"), 32), F.lit(some)).cast("int").alias("p"), self.block(F.col("tgt")).alias("j"), "src", "tgt", *w)
        each = lambda c, most: F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias(c)
        ids = lambda mine, other, which: self.ids.select(F.col("block").alias(mine), each(other, n), F.lit(which).alias("which"), F.col("idx").alias("ids")).select("i", each("p", some), "j", "which", "ids")
        key = ("i", "p", "j")
        cells = both.groupBy(*key).cogroup(ids("i", "j", 0).unionByName(ids("j", "i", 1)).groupBy(*key)).applyInArrow(lambda a, b: _cell(a, b, parts), "i int, p int, j int, s binary, t binary, deg binary" + ", w binary" * len(w))
        # a block meets itself first, with its own columns; weighted links come part by part, others block by block
        cells = cells.withColumnRenamed("p", "_p").withColumn("_k", F.pmod(F.col("j") - F.col("i"), F.lit(n)))
        self.cells = g.dealt(cells, "i", *(("_p", "_k") if w else ("_k", "_p")), few_rows=True)
        g.drop(ends)

    def block(self, idx: Column) -> Column:
        return F.pmod(F.xxhash64(idx.cast("long")), F.lit(self.n)).cast("int")

    def degrees(self) -> DataFrame:
        """(block, d): links of each node."""

        def run(t: pa.Table) -> pa.Table:
            d = sum(v.astype(np.int64) for r in range(len(t)) if len(v := array(t, "deg", np.int32, r)))
            return pa.table({"block": pa.array([t.column("i")[0].as_py()], pa.int32()), "d": pa.array([d.astype(np.int32).tobytes()], pa.binary())})

        return self.cells.select("i", "deg").groupBy("i").applyInArrow(run, "block int, d binary")

    def summed(self, mine: DataFrame, sent: DataFrame, start: Callable, add: Callable, end: Callable, schema: str, part: Callable | None = None) -> DataFrame:
        """mine, sent: (block, packed columns), of a block itself and of the ends of its links. Of each block, start(i, row)
        makes sums, add(sums, row, s, t) adds some links' share, for places s and t of their ends (and their weights w, if
        they have some), and end(sums) gives batches; row(c) and row(c, kind) are a packed column, of sent by the name t_c.
        part(sums) gives batches when all weighted links of a part of the block's nodes were added."""
        cells, weights = self.cells.select("i", "_p", "_k", "j", "s", "t", *self.w), self.w
        to = sent.select(F.col("block").alias("_j"), *[F.col(c).alias(f"t_{c}") for c in sent.columns if c != "block"], F.explode(F.sequence(F.lit(0), F.lit(self.n - 1))).alias("_i"))
        # j by a condition that is no key of the join, so that the buckets of i serve; a block's own columns come once
        met = cells.join(g.by_shuffle(to, "shuffle_hash"), (F.col("i") == F.col("_i")) & (F.col("j") - F.col("_j") == 0)).drop("_i", "_j", "j")
        first = (F.col("i") == F.col("_i")) & (F.col("_p") + F.col("_k") == 0)
        rows = met.join(g.by_shuffle(mine.withColumnRenamed("block", "_i"), "shuffle_hash"), first, "left").drop("_i", "_k")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, done, sums = None, set(), None
            for b in batches:
                for r in range(len(b)):
                    row = lambda c, kind=np.float64: array(b, c, kind, r)  # noqa: B023, E731
                    i, p, links = b.column("i")[r].as_py(), b.column("_p")[r].as_py(), [row("s", np.int32), row("t", np.int32), *[row(c) for c in weights]]
                    if now and now != (i, p) and part:
                        yield from part(sums)
                    if now is None or now[0] != i:
                        if now:
                            done.add(now[0])
                            yield from end(sums)
                        if i in done:
                            raise RuntimeError(f"rows of block {i} are apart")
                        sums = start(i, lambda c, kind=np.float64: row(c, kind).copy())  # noqa: B023
                    now = i, p
                    for lo in range(0, len(links[0]), LINKS_AT_ONCE):
                        add(sums, row, *[v[lo : lo + LINKS_AT_ONCE] for v in links])
            if now:
                if part:
                    yield from part(sums)
                yield from end(sums)

        return rows.mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    """A block's row: its number and bytes of arrays."""
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) if c == "block" else pa.array([v.tobytes()], pa.binary()) for c, v in columns.items()], list(columns))


# ------------------------------------------------------------------------------------------ forces


def cell_masses(state: DataFrame, cell: float) -> DataFrame:
    """(cx, cy, mx, my, n): centre of mass and nodes of each square of the plane. state: (block, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                x, y = array(b, "x", np.float64, r), array(b, "y", np.float64, r)
                at, of = np.unique(np.stack([np.floor(x / cell), np.floor(y / cell)]), axis=1, return_inverse=True)
                of = of.ravel()
                yield pa.RecordBatch.from_arrays([*[pa.array(v.astype(np.int64)) for v in at], pa.array(np.bincount(of, x)), pa.array(np.bincount(of, y)), pa.array(np.bincount(of))], ["cx", "cy", "sx", "sy", "n"])

    sums = state.select("x", "y").mapInArrow(run, "cx long, cy long, sx double, sy double, n long").groupBy("cx", "cy").agg(F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.sum("n").alias("n"))
    return sums.select("cx", "cy", (F.col("sx") / F.col("n")).alias("mx"), (F.col("sy") / F.col("n")).alias("my"), "n")


def pushed(state: DataFrame, blocks: int, cell: float, length: float, repulsion: float) -> DataFrame:
    """state with px, py: the push of the masses in the nine squares around each node. Squares go in parts of so many as
    may be broadcast; a single part is, of more each goes to every block."""
    kinds = {"cx": np.int64, "cy": np.int64, "mx": np.float64, "my": np.float64, "n": np.int64}
    mass = g.reliable(cell_masses(state, cell))
    parts = max(1, -(-mass.count() // g.BROADCAST_ROWS))
    rows = packed(mass.withColumn("idx", F.xxhash64("cx", "cy")).withColumn("block", F.pmod("idx", F.lit(parts)).cast("int")), kinds).select(*[F.col(c).alias(f"m_{c}") for c in kinds])
    if parts == 1:
        met = state.crossJoin(F.broadcast(rows))
    else:
        met = state.join(g.by_shuffle(rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))), F.col("block") == F.col("_i")).drop("_i")

    names = [c for c in state.columns if c != "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in batches:
            for r in range(len(b)):
                block, own = b.column("block")[r].as_py(), {c: array(b, c, np.float64, r) for c in ("x", "y")}
                if block not in sums:
                    sums[block] = [b.column(c)[r].as_py() for c in names], np.zeros(len(own["x"])), np.zeros(len(own["x"]))
                _, px, py = sums[block]
                m = {c: array(b, f"m_{c}", k, r) for c, k in kinds.items()}
                low, high = m["cy"].min() - 1, m["cy"].max() + 2
                keys = m["cx"] * (high - low) + m["cy"] - low
                order = np.argsort(keys)
                m, keys = {c: v[order] for c, v in m.items()}, keys[order]
                for lo in range(0, len(px), LINKS_AT_ONCE):
                    x, y = (own[c][lo : lo + LINKS_AT_ONCE] for c in ("x", "y"))
                    cx, cy = np.floor(x / cell).astype(np.int64), np.floor(y / cell).astype(np.int64)
                    for i, j in [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                        want = (cx + i) * (high - low) + cy + j - low
                        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                        hit = np.flatnonzero((keys[at] == want) & (m["cy"][at] == cy + j))
                        ex, ey, n = x[hit] - m["mx"][at[hit]], y[hit] - m["my"][at[hit]], m["n"][at[hit]]
                        r2 = ex * ex + ey * ey
                        q = repulsion * n / (r2 + length) / np.sqrt(r2 + 1)
                        px[lo + hit] += ex * q
                        py[lo + hit] += ey * q
        for block, (rest, px, py) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([v], pa.binary()) for v in (*rest, px.tobytes(), py.tobytes())]], ["block", *names, "px", "py"])

    return met.mapInArrow(run, "block int" + "".join(f", {c} binary" for c in (*names, "px", "py")))


def force_round(graph: Blocks, state: DataFrame, alpha: float, length: float, repulsion: float, gravity: float) -> DataFrame:
    """state: (block, x, y, d, fixed) after one round of springs, pushes and gravity."""

    def start(i, row):
        own = {c: row(c) for c in ("x", "y", "px", "py")} | {"d": row("d", np.int32), "fixed": row("fixed", np.bool_)}
        return i, own, np.zeros(len(own["x"])), np.zeros(len(own["x"]))

    def add(sums, row, s, t):
        _, own, sx, sy = sums
        dx, dy, ad, bd = row("t_x")[t] - own["x"][s], row("t_y")[t] - own["y"][s], own["d"][s].astype(np.float64), row("t_d", np.int32)[t].astype(np.float64)
        r = np.maximum(np.hypot(dx, dy), 1e-6)
        f = (r - length) / r / np.minimum(ad, bd) * 0.5 * bd / (ad + bd)
        sx += np.bincount(s, dx * f, len(sx))
        sy += np.bincount(s, dy * f, len(sy))

    def end(sums):
        i, own, sx, sy = sums
        x, y = own["x"], own["y"]
        vx, vy = (sx + own["px"] - gravity * x) * alpha, (sy + own["py"] - gravity * y) * alpha
        slow = np.where(own["fixed"], 0.0, np.minimum(1.0, 50.0 / np.maximum(np.hypot(vx, vy), 1e-9)))
        yield batch(block=i, x=x + vx * slow, y=y + vy * slow, d=own["d"], fixed=own["fixed"])

    mine = pushed(state, graph.n, 4 * length, length, repulsion)
    return graph.summed(mine, state.select("block", "x", "y", "d"), start, add, end, "block int, x binary, y binary, d binary, fixed binary")


# ------------------------------------------------------------------------------------------ collisions


def acting(rows: DataFrame, turn: int, reach: float, per_cell: int) -> DataFrame:
    """(tx, ty, packed columns o_...): of each tile, and of the cells around it, the nodes that act on others: per_cell of a
    cell at most, by a hash that changes with turn. So a tile's row is bounded. rows: (idx, x, y, vx, vy, r)."""
    kinds = {"cx": np.int64, "cy": np.int64, "idx": np.int64} | {c: np.float64 for c in ("x", "y", "vx", "vy", "r")}
    cells = rows.withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)})
    rank = F.row_number().over(Window.partitionBy("cx", "cy").orderBy(F.xxhash64("idx", F.lit(turn))))
    tile = lambda c, i: F.floor((F.col(c) + i) / TILE)
    tiles = F.array_distinct(F.array(*[F.struct(tile("cx", i).alias("tx"), tile("cy", j).alias("ty")) for i in (-1, 1) for j in (-1, 1)]))
    near = cells.withColumn("k", rank).where(F.col("k") <= per_cell).withColumn("t", F.explode(tiles)).select("t.*", *kinds)

    def run(t: pa.Table) -> pa.Table:
        return pa.table({c: t.column(c).slice(0, 1).cast(pa.int64()) for c in ("tx", "ty")} | {f"o_{c}": pa.array([t.column(c).to_numpy().astype(k).tobytes()], pa.binary()) for c, k in kinds.items()})

    return near.groupBy("tx", "ty").applyInArrow(run, "tx long, ty long" + "".join(f", o_{c} binary" for c in kinds))


def tiled(state: DataFrame, reach: float) -> DataFrame:
    """(tx, ty, block, place, idx, x, y, vx, vy, r): the nodes of each block by tile, in parts of ROWS."""
    columns = ["idx", "x", "y", "vx", "vy", "r"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                own = {c: array(b, c, np.int64 if c == "idx" else np.float64, r) for c in columns}
                tx, ty = (np.floor(np.floor(own[c] / reach) / TILE).astype(np.int64) for c in ("x", "y"))
                order = np.lexsort((ty, tx)).astype(np.int32)
                first = heads(tx[order], ty[order]).tolist() if len(order) else []
                for lo, hi in zip(first, [*first[1:], len(order)]):
                    for at in (order[a : min(hi, a + ROWS)] for a in range(lo, hi, ROWS)):
                        part = [pa.array([v.tobytes()], pa.binary()) for v in (at, *[own[c][at] for c in columns])]
                        yield pa.RecordBatch.from_arrays([pa.array([tx[at[0]]]), pa.array([ty[at[0]]]), b.column("block").slice(r, 1), *part], ["tx", "ty", "block", "place", *columns])

    return state.select("block", *columns).mapInArrow(run, "tx long, ty long, block int, place binary" + "".join(f", {c} binary" for c in columns))


def _meet(own: dict, o: dict, keys: np.ndarray, low: int, high: int, reach: float, charge: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Charges and collisions of some nodes with those that act, in order of keys."""
    cx, cy = (np.floor(own[c] / reach).astype(np.int64) for c in ("x", "y"))
    fx, fy = np.zeros(len(cx)), np.zeros(len(cx))
    for i, j in [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
        want = (cx + i) * (high - low) + cy + j - low
        begin, n = np.searchsorted(keys, want, "left"), np.searchsorted(keys, want, "right")
        n = np.where((cy + j >= low) & (cy + j < high), n - begin, 0)
        a = np.repeat(np.arange(len(n)), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        near = (own["idx"][a] != o["idx"][b]) & (np.hypot(o["x"][b] - own["x"][a], o["y"][b] - own["y"][a]) < reach)
        a, b = a[near], b[near]
        me, other = {c: v[a] for c, v in own.items()}, {c: v[b] for c, v in o.items()}
        nudge = lambda salt: 1e-6 * (unit(me["idx"] * 31 + other["idx"], salt) - 0.5)  # noqa: B023, E731
        dx, dy = other["x"] - me["x"] + nudge(51), other["y"] - me["y"] + nudge(52)
        r2 = dx * dx + dy * dy
        f = charge * alpha / np.maximum(np.where(r2 < 1, np.sqrt(r2), r2), 1e-6)
        ax, ay = me["x"] + me["vx"] - other["x"] - other["vx"] + nudge(53), me["y"] + me["vy"] - other["y"] - other["vy"] + nudge(54)
        apart, least = np.hypot(ax, ay), me["r"] + other["r"]
        share = np.where(apart < least, (least - apart) / apart * other["r"] ** 2 / (me["r"] ** 2 + other["r"] ** 2), 0.0)
        fx += np.bincount(a, dx * f + ax * share, len(fx))
        fy += np.bincount(a, dy * f + ay * share, len(fy))
    return fx, fy


def met(state: DataFrame, turn: int, reach: float, per_cell: int, charge: float, alpha: float) -> DataFrame:
    """state: (block, idx, x, y, vx, vy, r, d, ...) with px, py: the charges and collisions of nodes within reach."""
    state = state.select("block", "idx", "x", "y", "vx", "vy", "r", "d")
    acts = acting(unpacked(state, {"idx": "bigint", "x": "double", "y": "double", "vx": "double", "vy": "double", "r": "double"}), turn, reach, per_cell)
    whole = {"cx", "cy", "idx"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                own, o = ({c: array(b, head + c, np.int64 if c in whole else np.float64, r) for c in columns} for head, columns in (("", ("idx", "x", "y", "vx", "vy", "r")), ("o_", ("cx", "cy", "idx", "x", "y", "vx", "vy", "r"))))
                low, high = int(o["cy"].min()), int(o["cy"].max()) + 1
                keys = o["cx"] * (high - low) + o["cy"] - low
                order = np.argsort(keys, kind="stable")
                o, keys = {c: v[order] for c, v in o.items()}, keys[order]
                some = [_meet({c: v[lo : lo + MEET_AT_ONCE] for c, v in own.items()}, o, keys, low, high, reach, charge, alpha) for lo in range(0, len(own["idx"]), MEET_AT_ONCE)]
                yield pa.RecordBatch.from_arrays([b.column("block").slice(r, 1), b.column("place").slice(r, 1), *[pa.array([np.concatenate(v).tobytes()], pa.binary()) for v in zip(*some)]], ["block", "place", "fx", "fy"])

    def put(rows: pa.Table, forces: pa.Table) -> pa.Table:
        p = np.zeros((2, len(array(rows, "idx", np.int64))))
        for r in range(len(forces)):
            p[:, array(forces, "place", np.int32, r)] = [array(forces, c, np.float64, r) for c in ("fx", "fy")]
        for c, v in zip(("px", "py"), p):
            rows = rows.append_column(c, pa.array([v.tobytes()], pa.binary()))
        return rows

    forces = tiled(state, reach).join(g.by_shuffle(acts), ["tx", "ty"]).drop("tx", "ty").mapInArrow(run, "block int, place binary, fx binary, fy binary")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema) + ", px binary, py binary"
    return state.groupBy("block").cogroup(forces.groupBy("block")).applyInArrow(put, schema)


def collision_round(graph: Blocks, state: DataFrame, pushed: DataFrame, alpha: float, length: float, spring: float, gravity: float, damping: float, most_speed: float) -> DataFrame:
    """state: (block, idx, x, y, vx, vy, r, d, ax, ay), a being where a node would go by its velocity; pushed: that
    of met(). state after one round of springs, pushes and gravity."""
    columns = ["x", "y", "vx", "vy", "r", "px", "py"]

    def start(i, row):
        own = {c: row(c) for c in columns} | {"idx": row("idx", np.int64), "d": row("d", np.int32)}
        own |= {"ax": own["x"] + own["vx"], "ay": own["y"] + own["vy"]}
        return i, own, np.zeros(len(own["x"])), np.zeros(len(own["x"]))

    def add(sums, row, s, t):
        _, own, sx, sy = sums
        dx, dy, ad, bd = row("t_ax")[t] - own["ax"][s], row("t_ay")[t] - own["ay"][s], own["d"][s].astype(np.float64), row("t_d", np.int32)[t].astype(np.float64)
        r = np.maximum(np.hypot(dx, dy), 1e-6)
        f = (r - length) / r * alpha * spring / np.minimum(ad, bd) * bd / (ad + bd)
        sx += np.bincount(s, dx * f, len(sx))
        sy += np.bincount(s, dy * f, len(sy))

    def end(sums):
        i, own, sx, sy = sums
        vx, vy = (own["vx"] + sx + own["px"]) * damping, (own["vy"] + sy + own["py"]) * damping
        slow = np.minimum(1.0, most_speed / np.maximum(np.hypot(vx, vy), 1e-9))
        vx, vy = vx * slow - own["x"] * (0.005 * gravity * alpha), vy * slow - own["y"] * (0.005 * gravity * alpha)
        x, y = own["x"] + vx, own["y"] + vy
        yield batch(block=i, idx=own["idx"], x=x, y=y, vx=vx, vy=vy, r=own["r"], d=own["d"], ax=x + vx, ay=y + vy)

    return graph.summed(pushed, state.select("block", "ax", "ay", "d"), start, add, end, "block int" + "".join(f", {c} binary" for c in ("idx", "x", "y", "vx", "vy", "r", "d", "ax", "ay")))


# ------------------------------------------------------------------------------------------ vectors


def unit(v: np.ndarray, salt: int) -> np.ndarray:
    """maths.unit_hash of whole numbers."""
    low = np.int64(0x7FFFFFFF)
    h = ((v & low) * 1103515245 + (12345 + salt * 97531)) & low
    h = ((h ^ h >> 15) * 1103515245 + 12345) & low
    return (((h ^ h >> 13) * 69069 + 1 & low) + 0.5) / 2147483648.0


def normal(v: np.ndarray, salt: int) -> np.ndarray:
    """maths.normal_hash of whole numbers."""
    return np.sqrt(-2 * np.log(unit(v, salt))) * np.cos(2 * math.pi * unit(v, salt + 1))


def diffused(graph: Blocks, first: int, some: int, dims: int, weights: tuple[float, ...], seed: int) -> DataFrame:
    """(block, part, first, idx, v): so many dimensions from `first` on of sum of w_k P^k R, in parts of ROWS nodes. R is
    drawn where it is needed; every further power sends a block's vectors to all blocks."""
    drawn = lambda idx: normal(idx[:, None] * dims + np.arange(first, first + some), 11 + 2 * seed)
    state = graph.ids.select("block", "idx")
    for k, w in enumerate(weights[1:]):
        last = k == len(weights) - 2

        def start(i, row, k=k):
            idx = row("idx", np.int64)
            now = drawn(idx) if k == 0 else row("v").reshape(-1, some)
            total = now * weights[0] if k == 0 else row("total").reshape(-1, some)
            return {"i": i, "idx": idx, "sum": now.copy(), "n": np.ones(len(idx)), "total": total}

        def add(sums, row, s, t, k=k):
            key = row("t_idx" if k == 0 else "t_v", np.int64)
            if "key" not in sums or not np.array_equal(sums["key"], key):
                sums["key"], sums["sent"] = key, drawn(key) if k == 0 else row("t_v").reshape(-1, some)
            sums["n"] += np.bincount(s, minlength=len(sums["n"]))
            for c in range(some):
                sums["sum"][:, c] += np.bincount(s, sums["sent"][t, c], len(sums["n"]))

        def end(sums, w=w, last=last):
            now = sums["sum"] / sums["n"][:, None]
            total = sums["total"] + now * w
            if not last:
                yield batch(block=sums["i"], idx=sums["idx"], v=now, total=total)
            for lo in range(0, len(total) if last else 0, ROWS):
                b = batch(block=sums["i"], idx=sums["idx"][lo : lo + ROWS], v=total[lo : lo + ROWS])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lo // ROWS], pa.int32()), pa.array([first], pa.int32()), *b.columns[1:]], ["block", "part", "first", "idx", "v"])

        schema = "block int, part int, first int, idx binary, v binary" if last else "block int, idx binary, v binary, total binary"
        before, state = state, g.reliable(graph.summed(state, state.select("block", "idx" if k == 0 else "v"), start, add, end, schema))
        if k:
            g.drop(before)
    return state


def assembled(groups: DataFrame) -> DataFrame:
    """(idx, vector) of diffused() for all dimensions."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("first").to_numpy())
        idx = array(t, "idx", np.int64, 0)
        v = np.hstack([array(t, "v", np.float64, r).reshape(len(idx), -1) for r in order.tolist()])
        return pa.table({"idx": pa.array(idx), "vector": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))})

    return groups.groupBy("block", "part").applyInArrow(run, "idx long, vector array<double>")


# ------------------------------------------------------------------------------------------ communities


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins, in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def by_both(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """An order by a, then b; a: from 0 up to size."""
    low, high = int(b.min()), int(b.max())
    if size * (high - low + 1) < 1 << 62:
        return np.argsort(a * (high - low + 1) + (b - low))
    return np.lexsort((b, a))


def moved_round(graph: Blocks, state: DataFrame, parity: int, two_m: float) -> DataFrame:
    """state: (block, idx, k, com, turn, tot): nodes, their weight, community, parity of the rounds they move in, and
    their community's weight. (block, idx, k, com, turn, moved) after each node of the parity took the neighbouring
    community of greatest gain; ties to its own, then to the smallest."""

    def start(i, row):
        own = {c: row(c, k) for c, k in (("idx", np.int64), ("k", np.float64), ("com", np.int64), ("turn", np.int8), ("tot", np.float64))}
        return i, own, own["com"].copy(), []

    def add(sums, row, s, t, w):
        on = sums[1]["turn"][s] == parity
        t = t[on]
        sums[3].append((s[on], row("t_com", np.int64)[t], w[on], row("t_tot")[t]))

    def part(sums):
        _, own, com, links = sums
        if not links:
            return
        at = np.unique(np.concatenate([s for s, *_ in links]))
        links.append((at, own["com"][at], np.zeros(len(at)), own["tot"][at]))
        s, c, w, tot = (np.concatenate(v) for v in zip(*links, strict=True))
        links.clear()
        if not len(s):
            return
        order = by_both(s.astype(np.int64) - int(at[0]), c, int(at[-1] - at[0]) + 1)
        s, c, w, tot = s[order], c[order], w[order], tot[order]
        first = heads(s, c)
        s, c, tot, kin = s[first], c[first], tot[first], np.add.reduceat(w, first)
        other, k = c != own["com"][s], own["k"][s]
        gain = np.round(kin - (tot - np.where(other, 0.0, k)) * k / two_m, 9)
        begin = heads(s)
        top = gain == np.repeat(np.maximum.reduceat(gain, begin), np.diff(begin, append=len(s)))
        stay, best = s[top & ~other], np.flatnonzero(top)
        best = best[heads(s[best])]
        com[s[best]] = c[best]
        com[stay] = own["com"][stay]
        yield from ()

    def end(sums):
        i, own, com, _ = sums
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (own["idx"], own["k"], com, own["turn"])], pa.array([int((com != own["com"]).sum())])], ["block", "idx", "k", "com", "turn", "moved"])

    return graph.summed(state, state.select("block", "com", "tot"), start, add, end, "block int, idx binary, k binary, com binary, turn binary, moved long", part)


def merged_links(graph: Blocks, state: DataFrame) -> DataFrame:
    """(src, tgt, w): the links between communities, src < tgt, summed as far as a part of a block goes."""
    start = lambda i, row: (row("com", np.int64), [])

    def add(sums, row, s, t, w):
        a, b = sums[0][s], row("t_com", np.int64)[t]
        up = a < b
        sums[1].append((a[up], b[up], w[up]))

    def part(sums):
        if not sums[1]:
            return
        a, b, w = (np.concatenate(v) for v in zip(*sums[1], strict=True))
        sums[1].clear()
        if not len(a):
            return
        order = by_both(a - a.min(), b, int(a.max() - a.min()) + 1)
        a, b, w = a[order], b[order], w[order]
        first = heads(a, b)
        a, b, w = a[first], b[first], np.add.reduceat(w, first)
        for lo in range(0, len(a), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + ROWS]) for v in (a, b, w)], ["src", "tgt", "w"])

    return graph.summed(state.select("block", "com"), state.select("block", "com"), start, add, lambda sums: iter(()), "src long, tgt long, w double", part)
