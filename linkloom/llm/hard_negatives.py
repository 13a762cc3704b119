"""Hard negatives by distributed radix selection on integer scores.

A window asks for the first k rows among those whose score against its anchor lies in [lo, hi] and whose label is, or
is not, the anchor's. Anchors go in blocks, one after another; a block and its windows are sent to every task, which
multiplies them with the rows as it reads them, batch by batch: rows stay where they are stored. No pass sends scores
on: it counts them in a histogram of each window over the next digit of hi - score, and sums of these counts tell in
which bucket the kth score lies, which the next pass refines. Of a task's histogram only the first buckets up to k rows
are sent, since the kth of all lies in none after them. When all digits are known a last pass gathers the rows whose
scores reach the kth: those above it are fewer than k, and of those equal to it a task gives the k smallest ids at most,
so that neither very many copies of one row nor very many ties gather anywhere."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, bounded

#: Bits of a digit; rows of a stored file at least, and bytes of a block of anchors about.
DIGIT_BITS, LEAST_ROWS, BLOCK_BYTES = 9, 512, 8 << 20
#: Scores of one matrix product that are held at a time.
SCORES_AT_ONCE = 1 << 20
#: Beyond the first, sums in double precision may not be whole numbers any more; beyond the second, a hundred times a
#: score does not fit 64 bits.
EXACT_DOUBLE, EXACT_LONG = 1 << 53, (1 << 63) // 100
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))


def whole(vector: Column) -> Column:
    """Whether a vector is there with no null and no non-finite component."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))), F.lit(True))


WINDOW = ["anchor", "slot", "lo", "hi", "base", "seen"]


def by_dimension(b: pa.RecordBatch | pa.Table, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, ids, labels, vectors) of rows (id, label, vec)."""
    dims = np.asarray(pc.list_value_length(b.column("vec")))
    for dim in np.unique(dims).tolist():
        t = b.filter(pa.array(dims == dim))
        vec = t.column("vec")
        flat = (vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec).flatten()
        yield dim, np.asarray(t.column("id")), np.asarray(t.column("label")), np.asarray(flat).astype(kind, copy=False).reshape(len(t), dim)


class Asked:
    """A block of anchors and their windows, as tasks get it; at: each window's anchor in its dimension's rows."""

    def __init__(self, anchors: pa.Table, windows: pa.Table, kind: type):
        win, self.dims = {c: windows.column(c).to_numpy() for c in WINDOW}, {}
        for dim, ids, labels, a in by_dimension(anchors, kind):
            order = np.argsort(ids, kind="stable")
            near = order[np.minimum(np.searchsorted(ids[order], win["anchor"]), len(ids) - 1)]
            mine = ids[near] == win["anchor"]
            self.dims[dim] = labels, a, near[mine], {c: v[mine] for c, v in win.items()}, np.flatnonzero(mine)
        self.anchor, self.slot, self.seen = win["anchor"], win["slot"], win["seen"]


class Meeting:
    """A block of anchors' windows of one dimension against a batch of rows."""

    def __init__(self, asked: Asked, dim: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool):
        self.same, self.ids, self.labels, self.x = same, ids, labels, x
        self.a_labels, self.a, self.at, self.win, self.place = asked.dims[dim]

    @staticmethod
    def all(batches: Iterator[pa.RecordBatch], asked: Asked, same: bool, kind: type) -> Iterator[Meeting]:
        for b in batches:
            for dim, ids, labels, x in by_dimension(b, kind):
                if dim in asked.dims:
                    yield Meeting(asked, dim, ids, labels, x, same)

    def runs(self) -> Iterator[tuple[np.ndarray, dict, np.ndarray, np.ndarray]]:
        """Places of some windows, these, how far under their hi all rows' scores lie, and which of the rows are asked for."""
        step = max(1, SCORES_AT_ONCE // max(1, len(self.ids)))
        by = np.argsort(self.at, kind="stable")
        for lo in range(0, len(by), step):
            w = by[lo : lo + step]
            anchors, which = np.unique(self.at[w], return_inverse=True)
            win = {c: v[w] for c, v in self.win.items()}
            off = win["hi"][:, None] - (self.a[anchors] @ self.x.T).astype(np.int64)[which]
            ok = ((self.a_labels[anchors][:, None] == self.labels[None, :]) == self.same)[which]
            ok &= win["anchor"][:, None] != self.ids[None, :]
            ok &= (off >= 0) & (off <= (win["hi"] - win["lo"])[:, None])
            yield self.place[w], win, off, ok


def table_of(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in columns], names)


def histograms(asked: Broadcast, k: int, same: bool, shift: int, kind: type):
    """Counts of the digit at `shift` of those scores that lie in a window's bucket, base <= hi - score < base +
    2 ** (shift + DIGIT_BITS): of a window's first digits, up to the rows that it still lacks. A task sends its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, of = np.zeros(0, np.int64), np.zeros(0, np.int64), asked.value
        for m in Meeting.all(batches, of, same, kind):
            keys, counts = [key], [n]
            for place, win, off, ok in m.runs():
                digit = (off - win["base"][:, None]) >> shift
                ok &= (digit >= 0) & (digit < 1 << DIGIT_BITS)
                i, j = np.nonzero(ok)
                new, c = np.unique((place[i] << DIGIT_BITS) + digit[i, j], return_counts=True)
                need = within(new, c, k, of.seen)
                keys.append(new[need])
                counts.append(c[need])
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, back, np.concatenate(counts))
            need = within(key, n, k, of.seen)
            key, n = key[need], n[need]
        i = key >> DIGIT_BITS
        yield table_of([[of.anchor[i]], [of.slot[i]], [key & ((1 << DIGIT_BITS) - 1)], [n]], ["anchor", "slot", "digit", "n"])

    return run


def within(key: np.ndarray, n: np.ndarray, k: int, seen: np.ndarray) -> np.ndarray:
    """Of sorted buckets, those of each window that fewer rows than it lacks come before."""
    i = key >> DIGIT_BITS
    before = np.cumsum(n) - n
    before -= before[np.searchsorted(i, i)]
    return before < k - seen[i]


def gather(asked: Broadcast, k: int, same: bool, kind: type):
    """The rows of each window whose hi - score is base or less; the first k of a task by score and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = asked.value
        held = [np.zeros(0, np.int64)] * 4  # window, hi - score, id, score
        for m in Meeting.all(batches, of, same, kind):
            parts = [held]
            for place, win, off, ok in m.runs():
                ok &= off <= win["base"][:, None]
                i, j = np.nonzero(ok)
                parts.append(leading([place[i], off[i, j], m.ids[j], win["hi"][i] - off[i, j]], k))
            held = leading([np.concatenate(c) for c in zip(*parts, strict=True)], k)
        yield table_of([[of.anchor[held[0]]], [of.slot[held[0]]], [held[2]], [held[3]]], ["anchor", "slot", "id", "score"])

    return run


def leading(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (window, hi - score, id, score) each window's first k."""
    order = np.lexsort(rows[2::-1])
    rows = [c[order] for c in rows]
    take = np.arange(len(order)) - np.searchsorted(rows[0], rows[0]) < k
    return [c[take] for c in rows]


class Selection:
    """Rows and blocks of anchors, for windows that select from the rows."""

    def __init__(self, rows: DataFrame, is_anchor: Column, scratch: Scratch):
        """rows: a stored table (id, label, vec), ids distinct."""
        self.scratch, self.all, self.sent = scratch, bounded(rows).select("id", "label", "vec"), None
        length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
        most = rows.select(F.count_if(is_anchor).alias("asked"), F.max(F.size("vec")).alias("dim"), F.max(length).alias("top")).first()
        self.top, row_bytes = int(most.top or 0), 8 * max(1, most.dim or 0)
        if self.top >= EXACT_LONG:
            raise ValueError(f"scores up to {self.top} do not fit 64 bits a hundred times")
        self.kind = np.float64 if self.top < EXACT_DOUBLE else np.int64
        self.blocks = -(-most.asked // max(1, BLOCK_BYTES // row_bytes))
        self.block = F.pmod(F.xxhash64("id"), F.lit(max(1, self.blocks))).cast("int")
        self.asked = rows.where(is_anchor).select("id", "label", "vec")

    def take(self, block: int) -> DataFrame:
        """The ids of a block of anchors, whose windows are selected until the next is taken: the block goes to all tasks."""
        of = self.asked.where(self.block == block)
        self.anchors = of.toArrow()
        return of.select("id")

    def meet(self, windows: DataFrame, run, schema: str, *args) -> DataFrame:
        """windows: (anchor, slot, lo, hi, base, seen) of the block taken. They go with its anchors to each task, which
        reads its rows where they are stored: no row is sent. What an earlier meeting gave must have been stored."""
        self.release()
        self.sent = self.all.sparkSession.sparkContext.broadcast(Asked(self.anchors, windows.select(*WINDOW).toArrow(), self.kind))
        return self.all.mapInArrow(run(self.sent, *args, self.kind), schema)

    def release(self) -> None:
        if self.sent is not None:
            self.sent.destroy()
            self.sent = None

    def first(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """windows: (anchor, slot, lo, hi). (anchor, slot, id, score, rank): of the rows of the anchor's label (same), or
        of other labels, with lo <= score <= hi the first k by score, ties by smaller id."""
        scratch = self.scratch
        # base: the least that hi less the kth score can be; seen: rows before that bucket
        state = scratch.save(windows.where("lo <= hi").select("anchor", "slot", "lo", "hi", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("seen")))
        digits = -(-(2 * self.top + 1).bit_length() // DIGIT_BITS)
        few = None
        for d in range(digits - 1, -1, -1):
            counts = self.meet(state, histograms, "anchor long, slot long, digit long, n long", k, same, d * DIGIT_BITS).groupBy("anchor", "slot", "digit").agg(F.sum("n").alias("n"))
            upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("anchor", "slot").orderBy("digit")))
            kth = upto.join(state.select("anchor", "slot", "seen"), ["anchor", "slot"]).where(F.col("seen") + F.col("upto") >= k).groupBy("anchor", "slot").agg(F.min(F.struct("digit", (F.col("seen") + F.col("upto") - F.col("n")).alias("seen"))).alias("at"))
            known = scratch.save(state.drop("seen").join(kth, ["anchor", "slot"], "left").select("anchor", "slot", "lo", "hi", "base", "at.digit", "at.seen"))
            if few is None:  # windows of fewer than k rows are found out by the first digit: they take all
                few = known.where("digit is null").select("anchor", "slot", "lo", "hi", (F.col("hi") - F.col("lo")).alias("base"), F.lit(k).cast("long").alias("seen"))
            state = known.where("digit is not null").select("anchor", "slot", "lo", "hi", (F.col("base") + F.col("digit") * (1 << d * DIGIT_BITS)).alias("base"), "seen")
        got = self.meet(state.unionByName(few), gather, "anchor long, slot long, id long, score long", k, same)
        by = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
        return got.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: str = "vec_id % 50 = 0", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """rows: (vec_id, embedding, label). anchors: SQL over vec_id; label: SQL over vec_id and label. For each anchor, its
    first `positives` other rows of the same label, by inner product of floor(scale * x); for each of these the first
    `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Returns
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null vec_id, label, vector or component, or a non-finite one, take no part; empty vectors score 0. Rows
    of one vec_id count once, as that of the smallest label, then of the smallest vector. Vectors of different dimension
    are not compared. Ties go to the smaller id. No rows, or an anchor without positives or without rows in a window: no
    rows. Extra columns are ignored. An error where a hundred times a score would not fit 64 bits."""
    scratch = Scratch(rows.sparkSession, "negatives")
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    part = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole(F.col("embedding")))
    part = part.select(F.col("vec_id").alias("id"), F.struct(F.expr(label).cast("long").alias("label"), quantised(F.col("embedding"), scale).alias("vec")).alias("v"))
    parts = max(1, min(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // LEAST_ROWS)))
    part = scratch.save(part.groupBy("id").agg(F.min("v").alias("v")).select("id", "v.label", "v.vec").repartition(parts, "id"))
    s = Selection(part, F.expr(anchors.replace("vec_id", "id")), scratch)
    p, done = "positive_score", []
    for block in range(s.blocks):
        wide = s.take(block).select(F.col("id").alias("anchor"), F.lit(0).cast("long").alias("slot"), F.lit(-s.top).cast("long").alias("lo"), F.lit(s.top).cast("long").alias("hi"))
        best = scratch.save(s.first(wide, positives, True).select("anchor", F.col("rank").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias(p)))
        windows = best.where(F.col(p) >= 0).select("anchor", "slot", F.expr(f"({low} * {p} + 99) div 100").alias("lo"), F.expr(f"{high} * {p} div 100").alias("hi"))
        found = s.first(windows, negatives, False)
        done.append(scratch.save(found.join(best, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), p, F.col("score").alias("negative_score"))))
        scratch.keep(part, *done)
    s.release()
    scratch.keep(*done)
    return functools.reduce(DataFrame.unionByName, done) if done else rows.sparkSession.createDataFrame([], RESULT)
