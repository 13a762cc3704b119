"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes slide over the text in steps of two; a filter is a table of learned weights for each byte at each
place, so its response is a sum of table look-ups. Responses are max-pooled over overlapping chunks that cover the whole
text (blocks of BLOCK bytes, each chunk two neighbouring blocks), rectified, and a text's greatest and mean chunk
responses go through one hidden layer into a probability. Training runs on the driver over the whole texts of a bounded
sample of labelled rows; gradients reach the tables at the places where the maxima stand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import binary_column, bounded, release, slices

WIDTH, STEP, BLOCK, FILTERS, HIDDEN = 6, 2, 512, 16, 16
#: Labelled rows that are trained on at most, and bytes of their whole texts: by hash of doc_id, those that still fit.
MOST_LABELLED, MOST_BYTES = 4000, 24 << 20
EPOCHS, LEAST_STEPS, BATCH, RATE = 14, 900, 32, 0.01
#: Blocks that numpy takes at a time.
GROUP = 2048


def layout(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(padded bytes, number of blocks of each text): texts padded with zeros to whole blocks, at least one."""
    n = np.diff(offsets)
    blocks = np.maximum(1, -(-n // BLOCK))
    start = (np.cumsum(blocks) - blocks) * BLOCK
    out = np.zeros(int(blocks.sum()) * BLOCK + WIDTH, np.uint8)
    if len(data):
        out[np.repeat(start - offsets[:-1], n) + np.arange(offsets[0], offsets[-1])] = data
    return out, blocks


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "table": (0.3 * r.standard_normal((WIDTH, 256, FILTERS))).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": (r.standard_normal((2 * FILTERS, HIDDEN)) / 6).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": (r.standard_normal(HIDDEN) / 4).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.pairs = None

    def compile(self) -> None:
        """Tables over pairs of bytes, for half as many look-ups."""
        t = self.p["table"]
        self.pairs = [np.ascontiguousarray((t[w][:, None, :] + t[w + 1][None, :, :]).reshape(65536, FILTERS)) for w in range(0, WIDTH, 2)]

    def blocks(self, padded: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Greatest response of each filter in each block, and its place in the block; windows run on into the next."""
        n = (len(padded) - WIDTH) // BLOCK
        per = BLOCK // STEP
        best = np.empty((n, FILTERS), np.float32)
        at = np.empty((n, FILTERS), np.int64) if places else None
        for lo in range(0, n, GROUP):
            hi = min(lo + GROUP, n)
            part = padded[lo * BLOCK : hi * BLOCK + WIDTH]
            if self.pairs is not None:
                two = part[:-1:2].astype(np.intp) << 8 | part[1::2]
                count = (hi - lo) * per
                z = self.pairs[0].take(two[:count], axis=0)
                for k in range(1, WIDTH // 2):
                    z += self.pairs[k].take(two[k : k + count], axis=0)
            else:
                count = (hi - lo) * per
                z = sum(self.p["table"][w].take(part[w : w + 2 * count : 2], axis=0) for w in range(WIDTH))
            z = z.reshape(hi - lo, per, FILTERS)
            if places:
                at[lo:hi] = z.argmax(axis=1)
                best[lo:hi] = np.take_along_axis(z, at[lo:hi, None, :], 1)[:, 0]
            else:
                best[lo:hi] = z.max(axis=1)
        return best, at

    def pool(self, best: np.ndarray, blocks: np.ndarray):
        """Chunk responses (two neighbouring blocks of a text; its only block) and each text's features."""
        first = np.cumsum(blocks) - blocks
        chunks = np.maximum(1, blocks - 1)
        owner = np.repeat(np.arange(len(blocks)), chunks)
        start = np.cumsum(chunks) - chunks
        a = first[owner] + np.arange(len(owner)) - start[owner]
        b = np.where(blocks[owner] > 1, a + 1, a)
        right = best[b] > best[a]
        value = np.where(right, best[b], best[a]) + self.p["bias"]
        live = np.maximum(value, 0)
        top = np.maximum.reduceat(live, start, axis=0)
        mean = np.add.reduceat(live, start, axis=0) / chunks[:, None].astype(np.float32)
        return owner, start, chunks, a, b, right, value, live, np.concatenate((top, mean), axis=1)

    def head(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p["w1"] + self.p["b1"])
        z = h @ self.p["w2"] + self.p["b2"]
        return h, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        padded, blocks = layout(offsets, data)
        best, _ = self.blocks(padded)
        return self.head(self.pool(best, blocks)[-1])[1].astype(np.float64)

    def gradients(self, offsets: np.ndarray, data: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        padded, blocks = layout(offsets, data)
        best, at = self.blocks(padded, places=True)
        owner, start, chunks, a, b, right, value, live, x = self.pool(best, blocks)
        h, p = self.head(x)
        d = ((p - y) / len(y)).astype(np.float32)
        g = {"w2": h.T @ d, "b2": d.sum(keepdims=True)}
        dh = d[:, None] * self.p["w2"] * (1 - h * h)
        g |= {"w1": x.T @ dh, "b1": dh.sum(axis=0)}
        dx = dh @ self.p["w1"].T
        top = live == np.repeat(x[:, :FILTERS], chunks, axis=0)
        ties = np.add.reduceat(top.astype(np.float32), start, axis=0)
        dv = dx[owner, :FILTERS] * top / ties[owner] + dx[owner, FILTERS:] / chunks[owner, None].astype(np.float32)
        dv *= value > 0
        g["bias"] = dv.sum(axis=0)
        source = np.where(right, b[:, None], a[:, None])
        place = source * BLOCK + at[source, np.arange(FILTERS)] * STEP
        table = np.zeros_like(self.p["table"])
        use = dv != 0
        f = np.broadcast_to(np.arange(FILTERS), dv.shape)[use]
        for w in range(WIDTH):
            np.add.at(table[w], (padded[place[use] + w], f), dv[use])
        g["table"] = table
        return g

    def train(self, texts: list[bytes], y: np.ndarray, seed: int = 11) -> Network:
        """Adam over mini-batches; every row weighs the same, so that scores are probabilities."""
        r = np.random.default_rng(seed)
        y = np.asarray(y, np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        n = 0
        epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(texts))) if texts else 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            rate = RATE * (1 - epoch / epochs) + RATE / 20
            for lo in range(0, len(order), BATCH):
                pick = order[lo : lo + BATCH]
                offsets = np.concatenate(([0], np.cumsum([len(texts[i]) for i in pick])))
                data = np.frombuffer(b"".join(texts[i] for i in pick), np.uint8)
                n += 1
                for k, g in self.gradients(offsets, data, y[pick]).items():
                    g = g + (1e-4 * self.p[k] if k in ("w1", "w2", "table") else 0)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
        return self


def learn(docs: DataFrame, labels: DataFrame, label: str, held_out: Column) -> Network:
    """A network trained on labelled rows that are not held out: of rows with a label 0 or 1, at most MOST_LABELLED, and
    of these in order as many whole texts as make MOST_BYTES; of a doc_id with several texts one is taken."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & ~F.coalesce(held_out, F.lit(True))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.orderBy(*order).limit(MOST_LABELLED)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("same", F.xxhash64("text"))
    sizes = texts.select("doc_id", "same", F.octet_length("text").alias("n")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("same", "n")).alias("t"))
    chosen, left = [], MOST_BYTES
    for r in sizes.orderBy(*order).collect():  # at most MOST_LABELLED
        if r.t.n <= left:
            chosen.append((r.doc_id, r.t.same, r.y))
            left -= r.t.n
    mine = spark.createDataFrame(chosen, "doc_id long, same long, y double")
    rows = texts.join(F.broadcast(mine), ["doc_id", "same"]).dropDuplicates(["doc_id"]).select("doc_id", F.encode("text", "utf-8").alias("text"), "y").collect()
    rows.sort(key=lambda r: r.doc_id)
    trained = Network().train([bytes(r.text) for r in rows], np.array([r.y for r in rows]))
    del rows
    release(spark)
    return trained


def score_scan(shared, threshold: float, keep_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network()
        net.p = shared.value
        net.compile()
        for b in batches:
            offsets, data = binary_column(b.column("text"))
            score = np.empty(len(b))
            for lo, hi in slices(offsets):
                score[lo:hi] = net.scores(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
            if keep_only:
                yield b.filter(pa.array(score >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, held_out: str, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """docs: (doc_id, text); labels: (doc_id, label 0 or 1); held_out: a boolean SQL expression over doc_id. Returns
    doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold), one row per row of docs.

    Only texts are read by the network. Null and empty texts have the score of one block of padding. Rows whose label
    is null or another number, or whose doc_id is null, are not learned from; a doc_id labelled twice counts once, as
    the greater. Without labelled rows the network is untrained and its scores say nothing. Repeated rows get a row
    each; other columns are ignored. The network is some 100 kB; texts are scored whole, in groups of bounded size."""
    net = learn(docs, labels, label, F.expr(held_out))
    shared = docs.sparkSession.sparkContext.broadcast(net.p)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = bounded(docs).select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score_scan(shared, threshold, False), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, held_out: str, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """The rows of docs with a score of threshold or more, with all their columns."""
    net = learn(docs, labels, label, F.expr(held_out))
    return bounded(docs).mapInArrow(score_scan(docs.sparkSession.sparkContext.broadcast(net.p), threshold, True), docs.schema)
