"""Exact Jaccard self-join of documents on word shingles, by partition of the universe and pigeonhole.

Two sets of sizes a and b with Jaccard similarity t or more differ in at most (a + b) (1 - t) / (1 + t) elements; H is
that bound for two of the largest size u in a band of sizes. The universe is hashed into segments, of which some are compared exactly
(worth 1) and some up to one differing element (worth 2). A segment is indexed by a hash of its subset and, where one
element may differ, by the hashes of all its subsets less one element. The segments that a pair fails on are worth H at
most, so with a worth of H + 1 + 2 K in all, those that agree are worth 1 + 2 K or more, and each set may leave out
segments worth K, and a set of size a by (u - a) (1 - t) / (1 + t) more, as its pairs differ in so many fewer: it leaves
out those with the fewest elements, above all the empty ones, by which unrelated sets would meet. One segment that both
have signed is left. Every set signs in its own band and in each band above that a similar
larger set may lie in, so sets of very different size never meet.

Each band's allocation (segments, how many allow one differing element, K) has the least modelled cost: signatures
written, plus rows expected to share a segment by chance. Candidates of a segment pass an exact filter (the parity
sketches of two sets, of a length that goes by the set's size, differ in no more bits than the sets differ in elements),
a spanning forest of what passes is verified on the sets themselves, and what then still lies in different components is
verified pair by pair. Thus a group of thousands of near copies costs a forest, not all its pairs, and no link that
joins two components is missed."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, binary_column, bounded, mix64, release, scan_words

#: Bits of a parity sketch for each element in which a pair may differ, as the next power of two, for the forests and for
#: the pairs that are left; at least; at most. Beyond the most, sketches let more pairs through to be verified.
SKETCH_RATIO, CLOSE_RATIO, LEAST_SKETCH_BITS, MOST_SKETCH_BITS = 4, 16, 64, 8192
#: Ratio of the bounds of one size band to the next.
BAND_RATIO = 1.5
#: Rows of one segment that are compared in one task; more are dealt out as pairs of blocks of this many.
BLOCK_ROWS = 4096
#: Classes that were compared with more than so many others have these pairs taken out after the comparison, not before.
MOST_AGAIN = 1024
#: What a row that shares a signature costs, in signatures.
MEETING = 4.0
#: Documents whose ids may be broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Classes of more than one document in so many get their component by broadcast.
HEAVY = 1024

#: Signatures of one range, which one task sorts, about; ranges at least, as a power of two; bits of a signature beyond
#: those that tell all apart (one in 2**SPARE_BITS meets another by chance, and is found out by the filter).
RANGE_SIGNATURES, LEAST_RANGE_BITS, SPARE_BITS = 1_000_000, 9, 13
#: Signatures that a task holds before it sends them on.
RUN_SIGNATURES = 400_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MASK = (1 << 64) - 1
_LOW48 = np.uint64((1 << 48) - 1)


def step(k: int) -> np.uint64:
    return np.uint64(k * int(_A) & _MASK)


def allowance(sizes, num: int, den: int):
    """Most elements in which two sets with so many elements together may differ at similarity num / den."""
    return (den - num) * sizes // (den + num)


def bands(most: int, num: int, den: int) -> list[int]:
    """Lower bounds of the size bands, by the larger set of a pair; the first holds the smallest that may differ."""
    out = [1]
    while allowance(2 * out[0] - 1, num, den) < 1:
        out[0] += 1
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


def _excess(mean: float, k: int) -> float:
    """Expected number beyond k of a Poisson variable."""
    if mean > 100 or k > 200:
        z = (k - mean) / max(1e-9, math.sqrt(mean))
        return math.sqrt(mean) * (math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - z * 0.5 * math.erfc(z / math.sqrt(2)))
    total, p = mean - k, math.exp(-mean)
    for x in range(k):
        total += (k - x) * p
        p *= mean / (x + 1)
    return max(0.0, total)


@lru_cache(maxsize=4096)
def allocate(low: int, high: int, num: int, den: int, docs: float) -> tuple[int, int, int]:
    """(segments, how many of them allow one differing element, worth that every set leaves out) of least cost for sets
    of sizes low to high.

    A signature costs 1, a row met by chance MEETING. Unrelated sets meet in a segment that is empty in both, or for a
    loose one nearly so; the number of elements in a segment is about Poisson, and those left out are the emptiest."""
    best, need = (math.inf, 0, 0, 0), allowance(2 * high, num, den) + 1
    sizes = sorted({low, (2 * low + high) // 3, (low + 2 * high) // 3, high})
    for loose in sorted({0, 1, need // 8, need // 4, need // 2, (need + 1) // 2}):
        for out in sorted({0, 1, 2, 3, *(need // x for x in (64, 32, 16, 12, 8, 6, 5, 4, 3, 2))}):
            exact = max(0, need + 2 * out - 2 * loose)
            m, cost = exact + loose, 0.0
            for size in sizes:
                each = size / m
                empty, near = math.exp(-each), math.exp(-each) * (1 + each)
                gone = out + allowance(high - size, num, den)
                left = _excess(exact * empty, gone) * empty + _excess(loose * near, max(0, int(gone - exact * empty) // 2)) * near
                cost += (max(0, exact - gone) + loose * (1 + each) + MEETING * docs * left) / size
            best = min(best, (cost, m, loose, out))
    return best[1:]


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: (first row, end row, row of each element, 48-bit element), rows and elements ascending and
    distinct. Fewer words than a shingle has make one element; none make none."""
    for lo, hi, rows, h in scan_words(column):
        if not len(h):
            yield lo, hi, np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        n = np.bincount(rows, minlength=hi - lo)
        first = np.cumsum(n) - n
        left = n[rows] - (np.arange(len(rows)) - first[rows])
        starts = np.flatnonzero((left >= words) | ((n[rows] < words) & (left == n[rows])))
        sums = np.zeros(len(starts), np.uint64)
        for k in range(words):
            use = starts + k
            ok = left[starts] > k
            use = np.where(ok, use, 0)
            sums += np.where(ok, mix64(h[use] + step(k + 1)), np.uint64(0))
            sums *= _B
        keys = np.sort((rows[starts].astype(np.uint64) << np.uint64(48)) | (mix64(sums) & _LOW48))
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        yield lo, hi, (keys >> np.uint64(48)).astype(np.int64), keys & _LOW48


def signatures(rows: np.ndarray, elements: np.ndarray, sizes: np.ndarray, num: int, den: int, docs: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the segments that each set signs, of exact ones and of those that allow one deletion, in its
    band and in every band above that holds sets similar to it."""
    edges = np.array(bands(int(sizes.max(initial=1)), num, den))
    while edges[-1] * num <= int(sizes.max(initial=1)) * den:  # larger partners may lie in bands above all sizes here
        edges = np.append(edges, max(edges[-1] + 1, int(edges[-1] * BAND_RATIO)))
    band = np.searchsorted(edges, sizes, "right") - 1
    out_rows, out_sigs = [], []
    values = mix64(elements + _C)
    place = mix64(elements ^ _B)
    for k in range(len(edges) - 1):
        take = (sizes > 0) & (band <= k) & ((band == k) | (sizes * den >= num * edges[k]))
        if not take.any():
            continue
        high = int(edges[k + 1]) - 1
        m, loose, out = allocate(max(1, -(-int(edges[k]) * num // den)), high, num, den, docs)
        slot = np.cumsum(take) - 1
        mine = take[rows]
        segment = ((place[mine] >> np.uint64(33)) * np.uint64(m) >> np.uint64(31)).astype(np.int64)
        at = slot[rows[mine]] * m + segment
        n = int(take.sum())
        total = np.zeros(n * m, np.uint64)
        np.add.at(total, at, values[mine])
        salt = mix64(np.arange(m, dtype=np.uint64) + step(k * 1_000_003 + 17))
        signs = np.ones(n * m, bool)
        spare = out + allowance(high - sizes[take], num, den)
        if spare.any():
            worth = (np.arange(m) < loose) + 1
            filled = np.bincount(at, minlength=n * m).reshape(n, m) - (worth - 1)
            order = np.argsort(filled, axis=1, kind="stable")
            gone = np.cumsum(worth[order], axis=1) <= spare[:, None]
            np.put_along_axis(signs.reshape(n, m), order, ~gone, axis=1)
        owners = np.repeat(np.flatnonzero(take), m)
        out_rows.append(owners[signs])
        out_sigs.append(mix64(total + np.tile(salt, n))[signs])
        if loose:
            lost = (segment < loose) & signs[at]
            out_rows.append(rows[mine][lost])
            out_sigs.append(mix64(total[at[lost]] - values[mine][lost] + salt[segment[lost]]))
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r, s = np.concatenate(out_rows), np.concatenate(out_sigs)
    order = np.argsort(r, kind="stable")
    return r[order], s[order]


def sketch_words(sizes: np.ndarray, num: int, den: int, ratio: int) -> np.ndarray:
    """Length in 64-bit words, a power of two, of the sketch of a set with so many elements."""
    want = np.clip(ratio * allowance(2 * sizes, num, den), LEAST_SKETCH_BITS, MOST_SKETCH_BITS * max(1, ratio // SKETCH_RATIO))
    return (1 << np.ceil(np.log2(want)).astype(np.int64)) // 64


def sketches(rows: np.ndarray, elements: np.ndarray, sizes: np.ndarray, num: int, den: int, ratio: int = SKETCH_RATIO) -> pa.Array:
    """Parity of the number of elements that hash to each bit. Halves of a sketch, put one upon the other by exclusive
    or, give the sketch of half its length."""
    words = sketch_words(sizes, num, den, ratio)
    start = np.concatenate(([0], np.cumsum(words)))
    bit = (mix64(elements + _A) & (words[rows] * 64 - 1).astype(np.uint64)).astype(np.int64)
    out = np.zeros(start[-1], np.uint64)
    np.bitwise_xor.at(out, start[rows] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((start * 8).astype(np.int32)), pa.py_buffer(out)])


def folded(data: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray, to: int) -> np.ndarray:
    """Rows of sketches of different lengths, all brought to `to` words."""
    out = np.empty((len(at), to), np.uint64)
    for w in np.unique(length[at]).tolist():
        some = np.flatnonzero(length[at] == w)
        x = data[start[at[some], None] + np.arange(w)]
        out[some] = np.bitwise_xor.reduce(x.reshape(len(some), w // to, to), axis=1)
    return out


def scan_classes(words: int, num: int, den: int):
    """doc_id, same (a hash of the text), n_shingles, cls (a hash of the set) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, rows, elements in shingle_sets(b.column("text"), words):
                n = hi - lo
                sizes = np.bincount(rows, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, n), b.column("same").slice(lo, n), pa.array(sizes, pa.int64()), pa.array(class_hashes(rows, elements, sizes).view(np.int64)), sketches(rows, elements, sizes, num, den)],
                    ["doc_id", "same", "n_shingles", "cls", "sketch"],
                )

    return run


def class_hashes(rows: np.ndarray, elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(sizes), np.uint64)
    np.add.at(total, rows, mix64(elements * _A + _C))
    return mix64(total + sizes.astype(np.uint64))


def _planes(x: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte by byte of all of them, so that the high bytes compress away."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(len(d), d.itemsize).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def pack_signatures(sigs: np.ndarray, docs: np.ndarray) -> bytes:
    """Ascending signatures and the document of each, in about 5 bytes a pair."""
    ids, at = np.unique(docs, return_inverse=True)
    kind = np.uint16 if len(ids) < 65536 else np.uint32
    index = np.ascontiguousarray(at.astype(kind).view(np.uint8).reshape(len(at), -1).T).tobytes()
    raw = np.array([len(sigs), len(ids), np.dtype(kind).itemsize], "<u4").tobytes() + _planes(sigs) + _planes(ids.view(np.uint64)) + index
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_signatures(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(blob[4:], int(np.frombuffer(blob, "<u4", 1)[0]), codec="zstd", asbytes=True)
    n, m, size = (int(x) for x in np.frombuffer(raw, "<u4", 3))
    a, b = 12 + 8 * n, 12 + 8 * n + 8 * m
    index = np.ascontiguousarray(np.frombuffer(raw[b:], np.uint8).reshape(size, n).T).view(np.uint16 if size == 2 else np.uint32).ravel()
    return _unplanes(raw[12:a], np.uint64), _unplanes(raw[a:b], np.uint64).view(np.int64)[index]


def scan_signatures(words: int, num: int, den: int, docs: float, bits: int, range_bits: int):
    """Signatures cut to `bits` bits, in packed runs by their highest bits: (range, blob)."""

    def packed(all_sigs: list, all_ids: list) -> pa.RecordBatch:
        sigs, owners = np.concatenate(all_sigs), np.concatenate(all_ids)
        order = np.argsort(sigs, kind="stable")
        sigs, owners = sigs[order], owners[order]
        cut = np.searchsorted(sigs, np.arange((1 << range_bits) + 1, dtype=np.uint64) << np.uint64(bits - range_bits))
        full = np.flatnonzero(np.diff(cut))
        blobs = [pack_signatures(sigs[cut[r] : cut[r + 1]], owners[cut[r] : cut[r + 1]]) for r in full]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["range", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_sigs, all_ids, held = [], [], 0
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for lo, hi, rows, elements in shingle_sets(b.column("text"), words):
                n = hi - lo
                sizes = np.bincount(rows, minlength=n)
                # copies within a slice are one class already: the first of them signs
                _, once = np.unique(class_hashes(rows, elements, sizes), return_index=True)
                signs = np.zeros(n, bool)
                signs[once] = True
                owner, sigs = signatures(rows[signs[rows]], elements[signs[rows]], np.where(signs, sizes, 0), num, den, docs)
                all_sigs.append(sigs >> np.uint64(64 - bits))
                all_ids.append(ids[lo:hi][owner])
                held += len(sigs)
                if held >= RUN_SIGNATURES:
                    yield packed(all_sigs, all_ids)
                    all_sigs, all_ids, held = [], [], 0
        if held:
            yield packed(all_sigs, all_ids)

    return run


def shared_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range: (sig, doc_id) of signatures that two documents have."""

    def met(blobs: list[bytes]) -> pa.RecordBatch:
        parts = [unpack_signatures(x) for x in blobs]
        sigs, docs = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        order = np.lexsort((docs, sigs))
        sigs, docs = sigs[order], docs[order]
        one = np.concatenate(([True], (sigs[1:] != sigs[:-1]) | (docs[1:] != docs[:-1])))
        sigs, docs = sigs[one], docs[one]
        same = sigs[1:] == sigs[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        return pa.RecordBatch.from_arrays([pa.array(sigs[keep].view(np.int64)), pa.array(docs[keep])], ["sig", "doc_id"])

    now, blobs = None, []
    for b in batches:
        for r, blob in zip(b.column("range").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if r != now and blobs:
                yield met(blobs)
                blobs = []
            now = r
            blobs.append(blob)
    if blobs:
        yield met(blobs)


def sets_of(words: int):
    """(cls, elements) of every text, 6 bytes an element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, rows, elements in shingle_sets(b.column("text"), words):
                sizes = np.bincount(rows, minlength=hi - lo)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32) * 6
                data = np.ascontiguousarray(elements.view(np.uint8).reshape(-1, 8)[:, :6])
                yield pa.RecordBatch.from_arrays([pa.array(class_hashes(rows, elements, sizes).view(np.int64)), pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(data)])], ["cls", "elements"])

    return run


def unpacked(x: pa.Buffer) -> np.ndarray:
    """Elements of a set from 6 bytes each."""
    out = np.zeros((x.size // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def close_sketches(words: int, num: int, den: int):
    """(cls, sketch) of every text, with long sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, rows, elements in shingle_sets(b.column("text"), words):
                sizes = np.bincount(rows, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(class_hashes(rows, elements, sizes).view(np.int64)), sketches(rows, elements, sizes, num, den, CLOSE_RATIO)], ["cls", "sketch"])

    return run


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a.view(np.uint64)) * _A + b.view(np.uint64))


class _Rows:
    """Classes of a run of signatures: the exact filter on pairs of them, and the pairs that a group of them gives."""

    def __init__(self, t: pa.Table, num: int, den: int):
        self.num, self.den = num, den
        self.cls, self.n, self.comp = (t.column(c).to_numpy() for c in ("cls", "n_shingles", "comp"))
        offsets, data = binary_column(t.column("sketch"))
        self.start, self.length, self.data = offsets[:-1] // 8, np.diff(offsets) // 8, data.view(np.uint64)
        self.again = None
        if "again" in t.column_names:  # classes that each was compared with before
            again = t.column("again").combine_chunks() if isinstance(t.column("again"), pa.ChunkedArray) else t.column("again")
            count = again.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            self.again = np.unique(pair_hashes(np.repeat(self.cls, count), again.flatten().to_numpy()))

    def passes(self, i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> np.ndarray:
        a, b = self.n[i], self.n[j]
        ok = np.maximum(a, b) * self.num <= np.minimum(a, b) * self.den
        ok &= (self.comp[i] != self.comp[j]) & (bits <= allowance(a + b, self.num, self.den))
        if self.again is not None and len(self.again):
            at = np.flatnonzero(ok)
            pair = pair_hashes(self.cls[i[at]], self.cls[j[at]])
            ok[at] = self.again[np.minimum(np.searchsorted(self.again, pair), len(self.again) - 1)] != pair
        return ok

    def near_pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs pass the filter."""
        short, out = np.minimum(self.length[i], self.length[j]), np.zeros(len(i), bool)
        for w in np.unique(short).tolist():
            for at in np.array_split(np.flatnonzero(short == w), max(1, len(i) * w // 2_000_000)):
                x, y = (folded(self.data, self.start, self.length, k[at], w) for k in (i, j))
                out[at] = self.passes(i[at], j[at], np.bitwise_count(x ^ y).sum(axis=1))
        return out

    def group(self, lo: int, hi: int, all_pairs: bool) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a spanning forest of the filter's graph over rows lo to hi; or all pairs that pass the filter."""
        _, once = np.unique(self.cls[lo:hi], return_index=True)
        at = once + lo
        width = int(self.length[at].min())
        if all_pairs:  # rows of one component stand together and are passed over
            at = at[np.argsort(self.comp[at], kind="stable")]
        sketch = folded(self.data, self.start, self.length, at, width)

        def near(i: int, others: np.ndarray) -> np.ndarray:
            bits = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1)
            return others[self.passes(np.full(len(others), at[i]), at[others], bits)]

        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if all_pairs:
            ends = np.searchsorted(self.comp[at], self.comp[at], "right")
            for i in range(len(at) - 1):
                if ends[i] < len(at):
                    hits = near(i, np.arange(ends[i], len(at)))
                    a.append(np.full(len(hits), i))
                    b.append(hits)
        else:
            left = np.ones(len(at), bool)
            for root in range(len(at)):
                if not left[root]:
                    continue
                left[root] = False
                queue = [root]
                while queue:
                    i = queue.pop()
                    hits = near(i, np.flatnonzero(left))
                    left[hits] = False
                    a.append(np.full(len(hits), i))
                    b.append(hits)
                    queue += hits.tolist()
        a, b = np.concatenate(a), np.concatenate(b)
        if not all_pairs:  # one edge between two components is enough for now
            x, y = self.comp[at[a]], self.comp[at[b]]
            _, first = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1, return_index=True)
            a, b = a[first], b[first]
        return at[a], at[b]


def segment_pairs(num: int, den: int, all_pairs: bool):
    """Over rows sorted by (sig, block): the candidate pairs (a < b) of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, held = ["sig", "block", "cls", "n_shingles", "sketch", "comp", *(["again"] if all_pairs else [])], None

        def pairs(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
            rows, size = _Rows(t, num, den), np.diff(bounds)
            two = bounds[:-1][size == 2]
            two = two[rows.near_pairs(two, two + 1)]
            i, j = [two], [two + 1]
            for k in np.flatnonzero(size > 2).tolist():
                x, y = rows.group(int(bounds[k]), int(bounds[k + 1]), all_pairs)
                i.append(x)
                j.append(y)
            x, y = rows.cls[np.concatenate(i)], rows.cls[np.concatenate(j)]
            # a pair that met in many segments goes on once
            both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch]).select(cols)
            t = t if held is None else pa.concat_tables([held, t])
            if not len(t):
                continue
            t = t.combine_chunks()
            sig, block = t.column("sig").to_numpy(), t.column("block").to_numpy()
            cut = np.flatnonzero((sig[1:] != sig[:-1]) | (block[1:] != block[:-1])) + 1
            # the last group may go on in the next batch
            bounds = np.concatenate(([0], cut))
            held = t.slice(int(bounds[-1]))
            if len(bounds) > 1:
                yield pairs(t.slice(0, int(bounds[-1])), bounds)
        if held is not None and len(held) > 1:
            yield pairs(held.combine_chunks(), np.array([0, len(held)]))

    return run


def verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                both = np.sort(np.concatenate((x, y)))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = common * den >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep)], ["a", "b", "linked"])

    return run


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """docs: (doc_id long, text). Returns one row per row of docs: doc_id, n_shingles, component_id, and two hashes: same,
    of the text, and component_key, which tells components apart that have their smallest doc_id in common because it
    is repeated (null without a set; of rows with a null doc_id that of their set).

    Two documents link when den * |A & B| >= num * |A | B| for their sets of distinct shingles of so many lower-cased
    words; a text of fewer words is one shingle. Null, empty and blank texts have no set: n_shingles 0, linked with
    nothing, their own component. component_id is the smallest doc_id reachable by links. Rows with a null doc_id have
    their size and a null component, and link nothing. Repeated doc_ids are rows of one node each by content; exact
    copies are one class before any comparison. Other columns are ignored. Sets are compared by 48-bit shingle hashes,
    classes by 64-bit set hashes.

    docs is read twice for sets' hashes and signatures, and again for the sets of those whose sketches came near
    another's. Signatures are shuffled in packed runs of about 5 bytes each; classes of very many copies (HEAVY of them
    at most) get their component by broadcast, all others by a join."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("same"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = scratch.save(texts.mapInArrow(scan_classes(words, num, den), "doc_id long, same long, n_shingles long, cls long, sketch binary"))
    filled = one.where("n_shingles > 0 and doc_id is not null")
    every = scratch.save(filled.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch")))
    n_classes, n_docs, volume = every.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    # exact copies need not sign: one document of each class does, unless the others' ids are too many to broadcast
    signing = texts.drop("same").where("doc_id is not null")
    if n_docs - n_classes <= BROADCAST_IDS:
        reps = every.select(F.col("rep").alias("doc_id"))
        others = filled.select("doc_id").join(reps, "doc_id", "left_anti").distinct()
        signing = signing.join(F.broadcast(others), "doc_id", "left_anti")
    about = max(1, int(2 * volume * (den - num) / num))
    range_bits = max(LEAST_RANGE_BITS, (about // RANGE_SIGNATURES).bit_length())
    bits = min(63, max(range_bits + 1, about.bit_length() + SPARE_BITS))
    packed = signing.mapInArrow(scan_signatures(words, num, den, n_docs / 12, bits, range_bits), "range int, blob binary")
    shared = packed.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(shared_signatures, "sig long, doc_id long")
    met = scratch.save(shared.join(filled.select("doc_id", "cls", F.col("n_shingles").cast("int").alias("n")), "doc_id").groupBy("sig", "cls").agg(F.min("n").alias("n")))
    many = met.groupBy("sig").agg(F.count("*").alias("rows")).where("rows > 1")
    met = scratch.save(met.join(many, "sig"))
    classes = scratch.save(every.join(met.select("cls").distinct(), "cls", "left_semi").drop("copies"))

    def blocks(of: DataFrame, cross: bool) -> DataFrame:
        count = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
        drawn = lambda n: F.pmod(F.xxhash64("cls"), F.greatest(n, F.lit(1))).cast("int")
        if not cross:
            return of.withColumn("block", drawn(count(F.col("rows"))))
        # few rows are one block; of many, rows of a signature's largest component come first: those of two of its blocks
        # need not meet; of all other blocks i meets j for i <= j
        sizes = of.groupBy("sig", "comp").agg(F.count("*").alias("n")).groupBy("sig").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
        sizes = sizes.select("sig", "all", F.col("top.comp").alias("top"), count(F.col("top.n")).alias("first"), count(F.col("all") - F.col("top.n")).alias("more"))
        of = of.join(sizes, "sig")
        own = F.when(F.col("comp") == F.col("top"), drawn(F.col("first"))).otherwise(F.col("first") + drawn(F.col("more")))
        own = F.when(F.col("all") <= BLOCK_ROWS, 0).otherwise(own)
        n = F.col("first") + F.col("more")
        others = F.when(F.col("own") < F.col("first"), F.sequence(F.col("first"), n - 1)).otherwise(F.sequence(F.lit(0), n - 1))
        pairs = F.when(F.col("all") <= BLOCK_ROWS, F.array(F.lit(0))).otherwise(F.transform(others, lambda j: F.least(F.col("own"), j) * n + F.greatest(F.col("own"), j)))
        return of.where("more > 0").withColumn("own", own).withColumn("block", F.explode(pairs)).drop("own", "all", "top", "first", "more")

    def texts_of(some: DataFrame) -> DataFrame:
        """Of each class the text of one document."""
        needed = some.join(classes.select("cls", "rep"), "cls").select(F.col("rep").alias("doc_id")).distinct()
        needed = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
        return texts.join(needed, "doc_id", "left_semi").select("text")

    def verified(pairs: DataFrame) -> DataFrame:
        of = texts_of(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct())
        sets = scratch.save(of.mapInArrow(sets_of(words), "cls long, elements binary").dropDuplicates(["cls"]))
        left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("x")), "a")
        both = left.join(sets.select(F.col("cls").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y")
        out = scratch.save(both.mapInArrow(verify(num, den), "a long, b long, linked boolean"))
        scratch.drop(sets)
        return out

    def meet(of: DataFrame, cross: bool) -> DataFrame:
        dealt = blocks(of, cross).select("sig", "block", "cls", "n_shingles", "sketch", "comp", *(["again"] if cross else []))
        return dealt.repartition(parts, "sig", "block").sortWithinPartitions("sig", "block").mapInArrow(segment_pairs(num, den, cross), "a long, b long").distinct()

    def some_of(much: int) -> DataFrame:
        """For each class some signatures, two to four for each of `much`; of two classes those of the larger one are
        among the smaller one's."""
        share = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1), F.col("n") * (2 * (den - num) / (den + num) / much))))).cast("long")
        return met.where(F.pmod(F.xxhash64("sig"), share) == 0)

    # a forest over some of the signatures, so that most documents that belong together are joined by few edges; a forest
    # over all that still lie in different components; then all pairs of those that still do and were not compared yet,
    # over some signatures first, in groups where an edge of a forest was no link or that were dealt out in blocks (in
    # all others no more pairs pass the filter)
    tried = links = comps = None
    for of, cross in ((some_of(1), False), (met, False), (some_of(1), True), (met, True)):
        release(spark)
        if comps is None:
            placed = of.withColumn("comp", F.col("cls"))
        else:
            # signatures of classes that do not all lie in one component
            where = of.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
            split = where.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
            if cross:
                failed = tried.where("not linked")
                failed = failed.select(F.col("a").alias("cls")).unionByName(failed.select(F.col("b").alias("cls"))).distinct()
                open_groups = met.join(failed, "cls").select("sig").unionByName(met.where(F.col("rows") > BLOCK_ROWS).select("sig")).distinct()
                split = split.join(open_groups, "sig")
            placed = where.join(split, "sig")
        if cross:
            placed = scratch.save(placed)
            close = texts_of(placed.select("cls").distinct()).mapInArrow(close_sketches(words, num, den), "cls long, sketch binary")
            before = tried.select(F.col("a").alias("cls"), "b").unionByName(tried.select(F.col("b").alias("cls"), F.col("a").alias("b")))
            few = before.groupBy("cls").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_AGAIN).select("cls")
            before = before.join(few, "cls").groupBy("cls").agg(F.collect_set("b").alias("again"))
            placed = placed.join(scratch.save(close.dropDuplicates(["cls"]).join(before, "cls", "left")), "cls")
        else:
            placed = placed.join(classes.select("cls", "sketch"), "cls")
        pairs = meet(placed.withColumnRenamed("n", "n_shingles"), cross)
        pairs = scratch.save(pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        if pairs.isEmpty() and links is not None:
            continue
        seen = verified(pairs)
        new = seen.where("linked").select("a", "b")
        tried = seen if tried is None else tried.unionByName(seen)
        links = new if links is None else links.unionByName(new)
        if comps is None or not new.isEmpty():
            if comps is not None:
                scratch.drop(comps)
            comps = connected_components(scratch, links)
    named = comps.join(classes.select(F.col("cls").alias("node"), "rep"), "node").groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = comps.join(named, "comp").select(F.col("node").alias("cls"), "component_id", "comp")
    ids = every.select("cls", "copies", "rep").join(named, "cls", "left")
    ids = scratch.save(ids.select("cls", "copies", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("comp", "cls").alias("component_key")))
    scratch.drop(met, classes)
    # classes of many copies by broadcast, the others by a join; rows without a set need neither
    rows, is_heavy = one.drop("sketch"), F.col("copies") > n_docs / HEAVY
    known, heavy = rows.where("n_shingles > 0"), F.broadcast(ids.where(is_heavy).drop("copies"))
    placed = known.join(heavy, "cls").unionByName(known.join(heavy.select("cls"), "cls", "left_anti").join(ids.where(~is_heavy).drop("copies"), "cls", "left"))
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return placed.withColumn("component_key", F.coalesce("component_key", "cls")).unionByName(alone, allowMissingColumns=True).select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "component_key", "same"
    )


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs but for those of a group that links join (see jaccard_components): of a group the row of the
    smallest doc_id stays, of several texts under it that of the smallest hash, of repeated rows any one. Rows with a
    null doc_id are in a group with texts of the same shingles only, and stay if no other is there. Rows without words
    are no group and all stay. Columns are those of docs.

    Rows that go are told by broadcast if there are few enough, else by a join."""
    scratch = Scratch(docs.sparkSession, "groups")
    groups = scratch.save(jaccard_components(docs, words, num, den).where("n_shingles > 0").groupBy("component_key", "doc_id", "same").agg(F.count("*").alias("rows")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "same")
    first = groups.groupBy("component_key").agg(F.min(order).alias("first")).select("component_key", F.col("first.doc_id").alias("first_id"), F.col("first.same").alias("first_same"))
    told = scratch.save(
        groups.join(first, "component_key").select("doc_id", "same", "rows", (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("same") == F.col("first_same"))).alias("stays"))
        .where("not stays or rows > 1")
    )
    few = told.count() <= BROADCAST_IDS
    hint = F.broadcast if few else lambda x: x
    own = uuid.uuid4().hex  # names that no column of docs has
    id_, same = f"id_{own}", f"same_{own}"
    mine = docs.withColumns({id_: F.col("doc_id").cast("long"), same: F.xxhash64("text")})
    on = lambda t: mine[id_].eqNullSafe(t["doc_id"]) & (mine[same] == t["same"])
    rest = mine.join(hint(told), on(told), "left_anti")
    once = told.where("stays")
    repeated = mine.join(hint(once), on(once), "left_semi").dropDuplicates([id_, same])
    return rest.unionByName(repeated).select(*docs.columns)
