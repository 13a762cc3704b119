"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

The index is a graph of each distinct vector's best neighbours. It starts from groups of vectors on the same side of
random hyperplanes and is improved by joins: every vector is sent to some of its neighbours, where all that have met
are compared, so that neighbours of neighbours become candidates; only pairs with one that is new there are compared,
and rounds end when few lists change. For inner products of vectors of any length the graph is built on vectors with one
more component that makes all of them equally long.

A search keeps a query's best vectors found, and in every round looks up the neighbours, in both directions, of the
best ones not yet looked up, by joins of all queries' requests with the graph and with the vectors; it ends when all it
keeps are looked up. Scores of a search are inner products of the original vectors in double precision."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, binary_column, bounded, mix64

#: Neighbours in the graph, random partitions it starts from, vectors of a group that are compared at once.
DEGREE, TREES, GROUP = 32, 6, 256
#: Neighbours that a vector is sent to in a round, candidates that a meeting gives each, rounds at most, and the share
#: of changed entries that ends them.
SENT, GIVEN, ROUNDS, STILL = 16, 12, 6, 0.01
#: Vectors that a search keeps, looks up in a round, and neighbours in the other direction that a vector has at most.
KEPT, LOOKED_UP, BACKWARD, MOST_HOPS = 320, 80, 32, 12
#: Bytes of queries that are searched at a time: their ids and vectors in double precision are broadcast.
QUERY_BYTES = 32 << 20
#: Rows of one group that one task takes; larger groups are dealt out in blocks of about as many, of which GROUP are
#: compared at once in any case. Counts of such groups that are broadcast; more are joined.
HOT_ROWS, BROADCAST_GROUPS = 4096, 50_000


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not len(t):
            continue
        cut = bounds([t.column(k).to_numpy() for k in keys])
        held = t.slice(cut[-2])
        if cut[-2]:
            yield t.slice(0, cut[-2])
    if held is not None and len(held):
        yield held


def bounds(keys: list[np.ndarray]) -> np.ndarray:
    change = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(keys[0])]))


def matrix(column, kind) -> np.ndarray:
    offsets, data = binary_column(column)
    n = len(offsets) - 1
    return np.ascontiguousarray(data).view(kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, kind))


def meet(key: list[str], given: int) -> Callable:
    """Compares the vectors that meet in a group; rows (v, ids, scores) of each one's best others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, key):
            ids, new = t.column("v").to_numpy(), t.column("fresh").to_numpy(zero_copy_only=False)
            x = matrix(t.column("vec"), np.float16).astype(np.float32)
            out_v, out_n, out_i, out_s = [], [], [], []
            cut = bounds([t.column(k).to_numpy() for k in key])
            for a, b in zip(cut, cut[1:], strict=False):
                for lo in range(a, b, GROUP):
                    hi = min(lo + GROUP, b)
                    if hi - lo < 2 or not new[lo:hi].any():
                        continue
                    s = x[lo:hi] @ x[lo:hi].T
                    s[~(new[lo:hi, None] | new[None, lo:hi])] = -np.inf
                    s[ids[lo:hi, None] == ids[None, lo:hi]] = -np.inf
                    k = min(given, hi - lo - 1)
                    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    score = np.take_along_axis(s, best, 1)
                    ok = score > -np.inf
                    out_v.append(ids[lo:hi])
                    out_n.append(ok.sum(axis=1))
                    out_i.append(ids[lo:hi][best][ok])
                    out_s.append(score[ok])
            if out_v:
                n = np.concatenate(out_n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_v)), lists(np.concatenate(out_i), n, pa.int64()), lists(np.concatenate(out_s), n, pa.float32())], ["v", "ids", "scores"])

    return run


def keep_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by v: its state (with vec) and candidates. The new state: the DEGREE best, flagged where new."""
    for t in whole_groups(batches, ["v"]):
        t = t.combine_chunks()
        v = t.column("v").to_numpy()
        cut = bounds([v])
        group = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        flat = lambda c: (t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)).flatten()  # noqa: B023, E731
        counts = t.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        owner, ids, scores = np.repeat(group, counts), flat("ids").to_numpy(), flat("scores").to_numpy()
        has = t.column("vec").is_valid().to_numpy(zero_copy_only=False)
        mine = np.repeat(has, counts)
        fresh = np.ones(len(ids), bool)
        fresh[mine] = flat("fresh").to_numpy(zero_copy_only=False)
        order = np.lexsort((~mine, ids, owner))
        owner, ids, scores, fresh, mine = (a[order] for a in (owner, ids, scores, fresh, mine))
        one = np.concatenate((np.ones(min(1, len(ids)), bool), (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])))
        owner, ids, scores, fresh, mine = (a[one] for a in (owner, ids, scores, fresh, mine))
        order = np.lexsort((ids, -scores, owner))
        owner, ids, scores, fresh, mine = (a[order] for a in (owner, ids, scores, fresh, mine))
        first = np.searchsorted(owner, np.arange(len(cut) - 1))
        take = np.arange(len(owner)) - first[owner] < DEGREE
        n = np.bincount(owner[take], minlength=len(cut) - 1)
        changed = np.bincount(owner[take & ~mine], minlength=len(cut) - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v[cut[:-1]]), t.column("vec").combine_chunks().filter(pa.array(has)), lists(ids[take], n, pa.int64()), lists(scores[take], n, pa.float32()), lists(fresh[take], n, pa.bool_()), pa.array(changed)],
            ["v", "vec", "ids", "scores", "fresh", "changed"],
        )


def send(turn: int) -> Callable:
    """A state's messages to neighbours, new ones first, and the state with what was sent no longer new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fresh = b.column("ids"), b.column("fresh").flatten().to_numpy(zero_copy_only=False)
            n = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner, to = np.repeat(np.arange(len(n)), n), ids.flatten().to_numpy()
            draw = mix64(to.astype(np.uint64) * np.uint64(31) + b.column("v").to_numpy().astype(np.uint64)[owner] + np.uint64(turn << 40)) >> np.uint64(12)
            order = np.lexsort((draw, ~fresh, owner))
            first = np.cumsum(n) - n
            take = order[np.arange(len(order)) - first[owner[order]] < SENT]
            who = pa.array(owner[take])
            yield pa.RecordBatch.from_arrays([pa.array(to[take]), b.column("v").take(who), b.column("vec").take(who), pa.array(fresh[take])], ["u", "v", "vec", "fresh"])

    return run


def sent(turn: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fresh = b.column("ids"), b.column("fresh").flatten().to_numpy(zero_copy_only=False).copy()
            n = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner, to = np.repeat(np.arange(len(n)), n), ids.flatten().to_numpy()
            draw = mix64(to.astype(np.uint64) * np.uint64(31) + b.column("v").to_numpy().astype(np.uint64)[owner] + np.uint64(turn << 40)) >> np.uint64(12)
            order = np.lexsort((draw, ~fresh, owner))
            first = np.cumsum(n) - n
            fresh[order[np.arange(len(order)) - first[owner[order]] < SENT]] = False
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("vec"), ids, b.column("scores"), lists(fresh, n, pa.bool_())], ["v", "vec", "ids", "scores", "fresh"])

    return run


def in_blocks(rows: DataFrame, keys: list[str], sizes: DataFrame, parts: int, turn: int) -> DataFrame:
    """rows dealt to tasks by keys and, for groups that sizes (keys, n) counts as large, by block; sorted at random
    within each."""
    hot = sizes.where(F.col("n") > HOT_ROWS).select(*keys, F.ceil(F.col("n") / HOT_ROWS).alias("blocks"))
    hot = F.broadcast(hot) if hot.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else hot
    draw = F.xxhash64("v", F.lit(turn))
    dealt = rows.join(hot, keys, "left").withColumn("block", F.pmod(draw, F.coalesce("blocks", F.lit(1)))).drop("blocks")
    return dealt.repartition(parts, *keys, "block").sortWithinPartitions(*keys, "block", draw)


def lengthen(longest: float, kind: str) -> Callable:
    """Vectors in half precision, with the component that makes them equally long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vec"), kind).astype(np.float64)
            more = np.sqrt(np.maximum(0, longest**2 - (x * x).sum(axis=1)))
            out = (np.concatenate((x, more[:, None]), axis=1) / longest).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("v"), rows_of(out)], ["v", "vec"])

    return run


def rows_of(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def planes(trees: int, bits: int) -> Callable:
    """The side of each tree's random hyperplanes that a vector lies on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vec"), np.float16).astype(np.float32)
            for k in range(trees):
                w = np.random.default_rng(100 + k).standard_normal((x.shape[1], max(1, bits))).astype(np.float32)
                side = ((x @ w) > 0) @ (1 << np.arange(max(1, bits))) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(side.astype(np.int64)), b.column("v"), b.column("vec"), pa.array(np.ones(len(x), bool))], ["tree", "side", "v", "vec", "fresh"])

    return run


def build_graph(nodes: DataFrame, n: int, longest: float, kind: str, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """nodes: (v long, vec binary of numbers of a kind). Returns (v, ids, scores): the neighbour lists."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state_type = "v long, vec binary, ids array<long>, scores array<float>, fresh array<boolean>"
    met_type = "v long, ids array<long>, scores array<float>"
    half = scratch.save(nodes.mapInArrow(lengthen(longest, kind), "v long, vec binary"))
    bits = max(0, round(math.log2(max(1, n / (GROUP * 0.75)))))
    dealt = half.mapInArrow(planes(TREES, bits), "tree int, side long, v long, vec binary, fresh boolean")
    sizes = dealt.groupBy("tree", "side").agg(F.count("*").alias("n"))
    found = in_blocks(dealt, ["tree", "side"], sizes, parts, -1).mapInArrow(meet(["tree", "side", "block"], DEGREE), met_type)
    none = lambda kind: F.array().cast(kind)
    state = half.select("v", "vec", none("array<long>").alias("ids"), none("array<float>").alias("scores"), none("array<boolean>").alias("fresh"))

    def merged(state: DataFrame, found: DataFrame) -> DataFrame:
        rows = state.unionByName(found, allowMissingColumns=True).repartition(parts, "v").sortWithinPartitions("v")
        return scratch.save(rows.mapInArrow(keep_best, state_type + ", changed long"))

    now = merged(state, found)
    for turn in range(rounds):
        messages = now.mapInArrow(send(turn), "u long, v long, vec binary, fresh boolean")
        sizes = now.select(F.explode("ids").alias("u")).groupBy("u").agg(F.count("*").alias("n"))
        found = in_blocks(messages, ["u"], sizes, parts, turn).mapInArrow(meet(["u", "block"], GIVEN), met_type)
        new = merged(now.drop("changed").mapInArrow(sent(turn), state_type), found)
        scratch.drop(now)
        now = new
        if (now.agg(F.sum("changed")).first()[0] or 0) < STILL * n * DEGREE:
            break
    scratch.drop(half)
    return now.select("v", "ids", "scores")


def both_ways(graph: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, ids): a vector's neighbours and the BACKWARD best of those that have it as one."""
    edges = graph.select("v", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("v", F.col("e.ids").alias("w"), F.col("e.scores").alias("s"))
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("s"), "v"))
    back = edges.withColumn("r", rank).where(F.col("r") <= BACKWARD).select(F.col("w").alias("v"), F.col("v").alias("w"))
    return scratch.save(edges.select("v", "w").unionByName(back).groupBy("v").agg(F.collect_set("w").alias("ids")))


def score_pairs(shared, kind: str) -> Callable:
    """(q, w, vec) to (q, w, score), by the broadcast queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for b in batches:
            if len(b):
                q = x[np.searchsorted(ids, b.column("q").to_numpy())]
                s = np.einsum("ij,ij->i", q, matrix(b.column("vec"), kind).astype(np.float64))
                yield pa.RecordBatch.from_arrays([b.column("q"), b.column("w"), pa.array(s)], ["q", "w", "s"])

    return run


def keep_found(kept: int) -> Callable:
    """Rows (q, w, s, done) sorted by q: its best, each once; done where it was looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["q"]):
            q, w, s = (t.column(c).to_numpy() for c in "qws")
            done = t.column("done").to_numpy(zero_copy_only=False)
            order = np.lexsort((~done, w, q))
            q, w, s, done = (a[order] for a in (q, w, s, done))
            one = np.concatenate(([True], (q[1:] != q[:-1]) | (w[1:] != w[:-1])))
            q, w, s, done = (a[one] for a in (q, w, s, done))
            order = np.lexsort((w, -s, q))
            q, w, s, done = (a[order] for a in (q, w, s, done))
            take = np.arange(len(q)) - np.searchsorted(q, q) < kept
            q, w, s, done = (a[take] for a in (q, w, s, done))
            # of those not looked up, the best are next
            todo = np.cumsum(~done)
            before = (todo - ~done)[np.searchsorted(q, q)]
            turn = ~done & (todo - before <= LOOKED_UP)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (q, w, s, done | turn, turn))], ["q", "w", "s", "done", "turn"])

    return run


def search_graph(queries: DataFrame, graph: DataFrame, nodes: DataFrame, kind: str, scratch: Scratch) -> DataFrame:
    """queries: (q, vec), q being a node of the graph; graph: (v, ids); nodes: (v, vec). Returns (q, w, s)."""
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = queries.toArrow()
    ids = got.column("q").to_numpy()
    order = np.argsort(ids)
    shared = spark.sparkContext.broadcast((ids[order], matrix(got.column("vec"), kind)[order].astype(np.float64)))
    del got
    vectors = nodes.withColumnRenamed("v", "w")
    entry = vectors.orderBy(F.xxhash64("w")).limit(4).select("w")  # others than the query's own place
    asked = queries.select("q", F.col("q").alias("w")).unionByName(queries.select("q", F.explode(F.array(*[F.lit(r.w).cast("long") for r in entry.collect()])).alias("w")))
    type_ = "q long, w long, s double, done boolean, turn boolean"
    state = None
    for _ in range(MOST_HOPS + 1):
        scored = asked.join(vectors, "w").select("q", "w", "vec").mapInArrow(score_pairs(shared, kind), "q long, w long, s double").withColumn("done", F.lit(False))
        rows = scored if state is None else scored.unionByName(state.select("q", "w", "s", "done"))
        new = scratch.save(rows.repartition(parts, "q").sortWithinPartitions("q").mapInArrow(keep_found(KEPT), type_))
        if state is not None:
            scratch.drop(state)
        state = new
        turn = state.where("turn")
        if turn.isEmpty():
            break
        asked = turn.select("q", F.col("w").alias("v")).join(graph, "v").select("q", F.explode("ids").alias("w")).distinct().join(state.select("q", "w"), ["q", "w"], "left_anti")
    return state.select("q", "w", "s")


def nearest_neighbours(vectors: DataFrame, is_query: str, k: int = 20) -> DataFrame:
    """vectors: (vec_id, embedding array of numbers); is_query: a SQL condition on vec_id. Returns query_id, rank,
    vec_id, score: the k nearest of each query's row among all other rows, by inner product, ties to the smaller vec_id.

    Rows with a null id, or whose vector is null, zero, of another length than most, or holds null or non-finite
    components take no part. Equal vectors are one node of the graph, whatever their number; of its rows the k + 1
    smallest ids are kept, more of which no result can hold. Of repeated ids the first by content counts. With fewer
    candidates than k all are returned if found (a table of up to DEGREE vectors always finds all). No rows: no rows.
    Vectors of doubles are kept so, all others as floats. Queries are taken in blocks of QUERY_BYTES."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    x = F.col("x")
    double = vectors.schema["embedding"].dataType.elementType.simpleString() in ("double", "bigint", "int") or "decimal" in vectors.schema["embedding"].dataType.simpleString()
    kind = "float64" if double else "float32"
    clean = bounded(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("x")).where("vec_id is not null and x is not null")
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    clean = clean.where(fine).groupBy("vec_id").agg(F.min("x").alias("x"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = clean.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return empty
    clean = clean.where(F.size("x") == sizes.d)
    bucket = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    some = clean.groupBy("x", bucket.alias("b")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    classes = some.groupBy("x").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("members"))
    packed = classes.select(F.element_at("members", 1).alias("v"), "members", "x")
    nodes = scratch.save(packed.mapInArrow(pack(kind), "v long, members array<long>, vec binary, length double"))
    n, longest = nodes.agg(F.count("*"), F.max("length")).first()
    # every query row and its node
    of = clean.where(is_query).select(F.col("vec_id").alias("query_id"), "x").join(packed.select("v", "x"), "x").select("query_id", F.col("v").alias("q"))
    of = scratch.save(of)
    graph = both_ways(build_graph(nodes.select("v", "vec"), n, longest, kind, scratch), scratch)
    asked = of.select("q").distinct()
    m = asked.count()
    blocks = max(1, -(-m * 8 * (sizes.d + 1) // QUERY_BYTES))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).join(nodes.select(F.col("v").alias("q"), "vec"), "q")
        got = search_graph(part, graph, nodes.select("v", "vec"), kind, scratch)
        found = got if found is None else found.unionByName(got)
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "w"))).where(F.col("r") <= k + 1)
    rows = best.join(nodes.select(F.col("v").alias("w"), "members"), "w").select("q", "s", F.explode("members").alias("vec_id"))
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "vec_id"))).where(F.col("r") <= k + 1)
    own = of.join(few.drop("r"), "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))
    return own.select("query_id", rank.alias("rank"), "vec_id", F.col("s").alias("score")).where(F.col("rank") <= k)


def pack(kind: str) -> Callable:
    """Vectors as rows of bytes, with their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().astype(kind).reshape(len(b), -1) if len(b) else np.zeros((0, 1), kind)
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("members"), rows_of(x), pa.array(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)))], ["v", "members", "vec", "length"])

    return run
