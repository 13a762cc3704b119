"""Language-model scoring with a log-frequency Bloom filter.

Counts of the training part's n-grams are quantised on a log scale: a count c has level 1 + floor(log2 c), and an
n-gram of level q is entered q times, once for each level up to q. A count is read back by probing level after level
until one is missing. The filter is blocked: an n-gram's bits all lie in one segment, so that segments are built by
independent tasks, each as long as its n-grams need, and the filter is their concatenation.

Probabilities are interpolated: with f the count that the probes give, p(w | v) = (1 - lambda) p(w) + lambda f(v w) /
max(F(v), f(v w)), where F(v) is the upper end of v's level and f(v w) the lower end of the pair's (so that they do not
sum above 1). p(w) is a word's estimated count, the middle of its level, and 0.5, over the sum of these over all known
words and an unknown one. A pair is probed only if both its words are known.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end token a text, which also stands before the first
word. Words are compared by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, bounded, mix64, scan_words

END = mix64(np.array([0x454E44], np.uint64))[0]
_EVEN = ~np.uint64(1)
END &= _EVEN
_PAIR = np.uint64(0x9FB21C651E98DF25)
#: Bits for each n-gram and level, and probes for each.
BITS, PROBES = 14, 9
#: n-grams for each segment of the filter, about; at least LEAST_SEGMENTS.
SEGMENT_GRAMS, LEAST_SEGMENTS = 200_000, 2048
#: The filter is broadcast whole up to this size; a larger one in turn, in blocks of segments up to this size, or up to
#: LEAST_BLOCK where that is more. The driver takes in GATHER_BYTES of it at a time.
BROADCAST_BYTES, LEAST_BLOCK, GATHER_BYTES = 256 << 20, 8 << 20, 32 << 20
#: n-grams that a task holds before it counts them and sends them on.
RUN_GRAMS = 4_000_000
#: Most frequent words whose exact counts are broadcast (16 bytes each); counts of all others are joined.
HEAD_WORDS = 1 << 20
#: Weight of the pairs in the interpolation.
LAMBDA = 0.1


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of (first row, end row, row of each token, token hash); each text's end token is its last."""
    for lo, hi, rows, h in scan_words(column):
        n = np.bincount(rows, minlength=hi - lo)
        at = np.arange(len(rows)) + rows
        out = np.full(len(rows) + hi - lo, END, np.uint64)
        out[at] = h & _EVEN
        yield lo, hi, np.repeat(np.arange(hi - lo), n + 1), out


def pairs_of(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history, pair hash) of each token."""
    before = np.empty_like(h)
    before[:1] = END
    before[1:] = h[:-1]  # the token before a text's first is the end token of the text before it
    before[np.flatnonzero(np.diff(rows, prepend=-1))] = END
    return before, mix64(before * _PAIR + h) | np.uint64(1)


def count_grams(segments: int):
    """Partial counts (segment, n-gram, n) of words and pairs; the lowest bit of a pair's hash is 1, of a word's 0."""

    def counted(grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(grams), return_counts=True)
        seg = segment_of(h, segments).astype(np.int32)
        for at in range(0, len(h), 100_000):
            to = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(seg[to]), pa.array(h[to].view(np.int64)), pa.array(n[to].astype(np.int32))], ["seg", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = [], 0
        for b in batches:
            for _, _, rows, h in tokens(b.column("text")):
                grams += [h, pairs_of(rows, h)[1]]
                held += 2 * len(h)
                if held >= RUN_GRAMS:
                    yield from counted(grams)
                    grams, held = [], 0
        if held:
            yield from counted(grams)

    return run


def level(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def positions(h: np.ndarray, q: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """For each probe: a function from the rows still looked at to their bits, in segments of so many bits."""
    a = mix64(h + np.uint64(0x2545F4914F6CDD1D * q & (1 << 64) - 1))
    b = mix64(a) | np.uint64(1)
    for k in range(PROBES):
        yield lambda at, k=k: ((a[at] + b[at] * np.uint64(k)) >> np.uint64(11)) % bits[at]


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (mix64(h ^ _PAIR) >> np.uint64(33)) * np.uint64(segments) >> np.uint64(31)


def build_segment(key: tuple, t: pa.Table) -> pa.Table:
    """A segment's bits, and the exact counts of its words."""
    h, n = t.column("h").to_numpy().view(np.uint64), t.column("n").to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    h, n = h[first], np.add.reduceat(n, first)
    q = level(n)
    bits = int(max(64, -(-BITS * int(q.sum()) // 64) * 64))
    filled = np.zeros(bits, bool)
    for k in range(1, int(q.max()) + 1):
        take = h[q >= k]
        for at in positions(take, k, np.full(len(take), bits, np.uint64)):
            filled[at(slice(None)).astype(np.int64)] = True
    word = (h & np.uint64(1)) == 0
    one = lambda x, kind: pa.array([x], kind)
    return pa.table({"seg": one(key[0].as_py(), pa.int32()), "bits": one(np.packbits(filled, bitorder="little").tobytes(), pa.binary()), "h": one(h[word].view(np.int64), pa.list_(pa.int64())), "n": one(n[word], pa.list_(pa.int64()))})


class Filter:
    """Consecutive segments on a worker, from `first` on: the bytes of each, and all their bytes in order, which are not
    copied; of `segments` in all."""

    def __init__(self, size: np.ndarray, data: np.ndarray, first: int = 0, segments: int | None = None):
        self.first, self.segments = first, len(size) if segments is None else segments
        self.start = (np.cumsum(size) - size).astype(np.uint64)
        self.bits = (size * 8).astype(np.uint64)
        self.data = data

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if it is missing: probes of rising level until one fails."""
        seg = segment_of(h, self.segments).astype(np.int64) - self.first
        here = (seg >= 0) & (seg < len(self.bits))
        seg = np.where(here, seg, 0)
        bits, start = np.where(here, self.bits[seg], np.uint64(0)), self.start[seg]
        out = np.zeros(len(h), np.int64)
        live = np.flatnonzero(bits)
        q = 0
        while len(live):
            q += 1
            left = np.arange(len(live))
            for at in positions(h[live], q, bits[live]):
                x = at(left)
                byte = self.data[(start[live[left]] + (x >> np.uint64(3))).astype(np.int64)]
                left = left[((byte >> (x & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
            live = live[left]
            out[live] = q
        return out


def middle(q: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level, 0 for level 0."""
    return np.where(q > 0, 1.5 * np.exp2(q - 1.0) - 0.5, 0.0)


def log_probability(word: np.ndarray, history: np.ndarray, pair: np.ndarray, mass: float) -> np.ndarray:
    """log10 p(word | history) from levels; mass: the sum over which p(word) is taken."""
    p = (middle(word) + 0.5) / mass
    f = np.where(pair > 0, np.exp2(pair - 1.0), 0.0)
    return np.log10((1 - LAMBDA) * p + LAMBDA * f / np.maximum(np.where(history > 0, np.exp2(history) - 1.0, 1.0), f))


def score_scan(shared, total: int, distinct: int, mass: float):
    """Scores with the filter, base scores over words of the head; words of the tail are listed with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *held, head_h, head_n = shared.value
        model = Filter(*held)
        floor, over = np.log10(0.5 / (total + 0.5 * (distinct + 1))), total + 0.5 * (distinct + 1)
        head_log = np.log10((head_n + 0.5) / over)
        for b in batches:
            for lo, hi, rows, h in tokens(b.column("text")):
                n = hi - lo
                words, back = np.unique(h, return_inverse=True)
                word_level = model.levels(words)[back]
                before, pair = pairs_of(rows, h)
                history = np.empty_like(word_level)
                history[1:] = word_level[:-1]
                ends = np.flatnonzero(np.diff(rows, prepend=-1))
                history[ends] = word_level[np.searchsorted(rows, 0, "right") - 1]
                pair_level = np.zeros_like(word_level)
                known = np.flatnonzero((word_level > 0) & (history > 0))  # a pair is in only if both its words are
                pair_level[known] = model.levels(pair[known])
                logs = log_probability(word_level, history, pair_level, mass)
                at = np.searchsorted(head_h, words) if len(head_h) else np.zeros(len(words), np.int64)
                at = np.minimum(at, max(len(head_h) - 1, 0))
                in_head = head_h[at] == words if len(head_h) else np.zeros(len(words), bool)
                base = np.where(in_head, head_log[at] if len(head_h) else 0.0, floor)
                # words that may be in the tail: as unknown so far
                tail = ~in_head[back]
                key = np.sort(rows[tail].astype(np.uint64) << np.uint64(44) | back[tail].astype(np.uint64))
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
                times = np.diff(np.append(first, len(key)))
                owner = (key[first] >> np.uint64(44)).astype(np.int64)
                offs = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offs), pa.StructArray.from_arrays([pa.array(words[(key[first] & np.uint64((1 << 44) - 1)).astype(np.int64)].view(np.int64)), pa.array(times.astype(np.int64))], ["h", "n"]))
                sums = lambda x: np.bincount(rows, x, minlength=n)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [b.column("rid").slice(lo, n), b.column("doc_id").slice(lo, n), b.column("held_out").slice(lo, n), pa.array(np.bincount(rows, minlength=n)), pa.array(sums(in_head[back]).astype(np.int64)), pa.array(sums(base[back])), pa.array(sums(logs)), listed],
                    ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"],
                )

    return run


def level_scan(shared):
    """For each text the levels of its words and of its pairs that a block of the filter's segments holds, a byte a
    token; 0 for n-grams of other segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Filter(*shared.value)
        for b in batches:
            for lo, hi, rows, h in tokens(b.column("text")):
                offs = pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=hi - lo)))).astype(np.int32)).buffers()[1]
                packed = lambda x: pa.Array.from_buffers(pa.binary(), hi - lo, [None, offs, pa.py_buffer(x.astype(np.uint8).tobytes())])  # noqa: B023, E731
                words, back = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays([b.column("rid").slice(lo, hi - lo), packed(model.levels(words)[back]), packed(model.levels(pairs_of(rows, h)[1]))], ["rid", "w", "p"])

    return run


def combine_levels(blocks: int, mass: float):
    """Scores of texts from the levels of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, n = b.column("parts").flatten(), b.num_rows
            if n == 0:
                continue

            def highest(name: str) -> np.ndarray:
                out = None
                for k in range(blocks):
                    x = parts.field(name).take(pa.array(np.arange(n) * blocks + k))  # noqa: B023
                    at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + n + 1]  # noqa: B023
                    x = np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]]
                    out = x if out is None else np.maximum(out, x)
                return out.astype(np.int64)

            lengths = pc.binary_length(parts.field("w").take(pa.array(np.arange(n) * blocks))).to_numpy()
            rows, word = np.repeat(np.arange(n), lengths), highest("w")
            history = np.empty_like(word)
            history[1:] = word[:-1]
            history[np.cumsum(lengths) - lengths] = word[lengths[0] - 1]  # the end token
            pair = np.where((word > 0) & (history > 0), highest("p"), 0)
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(np.bincount(rows, log_probability(word, history, pair, mass), minlength=n))], ["rid", "score"])

    return run


def score_language_model(docs: DataFrame, training: str, broadcast_bytes: int = BROADCAST_BYTES, head_words: int = HEAD_WORDS) -> DataFrame:
    """docs: (doc_id, text); training: a boolean SQL expression over docs; rows where it is not true are held out.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row of docs.

    Null and empty texts are one end token. With no training rows N and V are 0: every word has the probability of an
    unknown one. Repeated rows each get their row; repeated ids too. Other columns are ignored. Counts cover all
    training rows. base_score and n_known use exact counts: the most frequent words by broadcast (16 MB at most), all
    others by a join. score reads the filter at every size: where that is larger than broadcast_bytes (and LEAST_BLOCK)
    its segments are broadcast in blocks, one pass over the texts each, and the levels found are put together by text
    (2 bytes a token and block before compression), which gives the same scores."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held = ~F.coalesce(F.expr(training), F.lit(False))
    texts = bounded(docs).select("doc_id", "text", held.alias("held_out"))
    train = texts.where("not held_out").select("text")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(LEAST_SEGMENTS, size // 3 // SEGMENT_GRAMS)
    partial = train.mapInArrow(count_grams(segments), "seg int, h long, n int")
    built = scratch.save(partial.groupBy("seg").applyInArrow(build_segment, "seg int, bits binary, h array<long>, n array<long>"))
    words = built.select(F.explode(F.arrays_zip("h", "n")).alias("w")).select("w.h", "w.n")
    level_of = F.floor(F.log2("n")).cast("int") + 1
    total, distinct, mass = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(1.5 * F.pow(F.lit(2.0), level_of - 1)), F.lit(0.0)) + 0.5).first()
    filter_bytes = built.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    # the head: words above a count that at most head_words reach
    levels = words.groupBy(F.floor(F.log2("n") * 8).alias("b")).agg(F.count("*").alias("d")).orderBy(F.desc("b")).collect()
    reach, least = 0, None
    for r in levels:
        if reach + r.d > head_words:
            break
        reach, least = reach + r.d, r.b
    is_head = F.floor(F.log2("n") * 8) >= least if least is not None else F.lit(False)
    head = words.where(is_head).select("h", "n").toArrow()
    head_h, head_n = head.column("h").to_numpy().view(np.uint64), head.column("n").to_numpy().astype(np.float64)
    order = np.argsort(head_h)
    numbered = texts.withColumn("rid", F.monotonically_increasing_id())
    most = max(broadcast_bytes, LEAST_BLOCK)
    fits = filter_bytes <= most
    # segments are about equal, as n-grams are dealt out by hash: so many make a block
    per = segments if fits else max(1, segments * most // filter_bytes)

    def held_segments(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Sizes and bytes of a range of segments, gathered piece by piece into one array; where it begins, of how many."""
        of = lambda a, b: built.where((F.col("seg") >= a) & (F.col("seg") < b))
        size, sizes = np.zeros(hi - lo, np.int64), of(lo, hi).select("seg", F.octet_length("bits").alias("b")).toArrow()
        size[sizes.column("seg").to_numpy() - lo] = sizes.column("b").to_numpy()
        ends = np.cumsum(size)
        start, data, a = ends - size, np.zeros(max(1, int(size.sum())), np.uint8), 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(ends, start[a] + GATHER_BYTES, "right")))
            got = of(lo + a, lo + b).select("seg", "bits").toArrow()
            for seg, bits in zip(got.column("seg").to_pylist(), got.column("bits"), strict=True):
                data[start[seg - lo] : start[seg - lo] + size[seg - lo]] = np.frombuffer(bits.as_buffer(), np.uint8)
            del got
            a = b
        return size, data, lo, segments

    if not fits:  # the texts are read once a block: their numbers must stay
        numbered = scratch.save(numbered)
    model = held_segments(0, segments) if fits else (np.zeros(1, np.int64), np.zeros(1, np.uint8), 0, segments)
    shared = spark.sparkContext.broadcast((*model, head_h[order], head_n[order]))
    del model
    scored = scratch.save(numbered.select("rid", "doc_id", "held_out", "text").mapInArrow(score_scan(shared, total, distinct, mass), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<struct<h:long,n:long>>"))
    shared.unpersist()
    tail = words.where(~is_head).select("h", F.col("n").alias("c"))
    floor = F.log10(F.lit(0.5))
    fixed = (
        scored.select("rid", F.explode("tail").alias("t")).select("rid", "t.h", "t.n").join(tail, "h")
        .groupBy("rid").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * (F.log10(F.col("c") + 0.5) - floor)).alias("more_base"))
    )
    out = scored.drop("tail").join(fixed, "rid", "left")
    score = F.col("score")
    if not fits:
        passes = []
        for lo in range(0, segments, per):
            block = spark.sparkContext.broadcast(held_segments(lo, min(segments, lo + per)))
            passes.append(scratch.save(numbered.select("rid", "text").mapInArrow(level_scan(block), "rid long, w binary, p binary")))
            block.destroy()
        levels = reduce(DataFrame.unionByName, passes).groupBy("rid").agg(F.collect_list(F.struct("w", "p")).alias("parts"))
        found = levels.mapInArrow(combine_levels(len(passes), mass), "rid long, score double")
        out = out.drop("score").join(found, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), score.alias("score"),
    )
