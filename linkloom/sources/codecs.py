"""Binary assets of the graph viewer: layouts, compact layouts, titles, adjacency, links; bytes in, rows out.

Writers take collected, ordered columns (assets are for one machine's viewer); readers are bytes functions that run on
the driver or, through binary_rows, for many files on the executors."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def write_layout(columns: list[np.ndarray]) -> bytes:
    """u32 N, then N rows of k float32."""
    m = np.stack([np.asarray(c, "<f4") for c in columns], axis=1)
    return np.uint32(len(m)).tobytes() + m.astype("<f4").tobytes()


def read_layout(data: bytes) -> np.ndarray:
    """The rows; k is the number of floats over N."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    values = np.frombuffer(data, "<f4", offset=4)
    if n and len(values) % n:
        raise ValueError(f"{len(values)} floats are no rows of {n}")
    return values.reshape(n, -1) if n else values.reshape(0, 0)


def write_adjacency(sizes: np.ndarray, neighbours: np.ndarray) -> bytes:
    """u32 N, u32 E, offsets, neighbours."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    if offsets[-1] != len(neighbours):
        raise ValueError("offsets do not end at the number of links")
    if max(len(sizes), offsets[-1]) > 0xFFFFFFFF:
        raise ValueError("too many nodes or links for offsets of 32 bits")
    return np.array([len(sizes), len(neighbours)], "<u4").tobytes() + offsets.astype("<u4").tobytes() + np.asarray(neighbours, "<u4").tobytes()


def read_adjacency(data: bytes) -> Callable[[int], np.ndarray]:
    """A look-up of a node's neighbours; none out of range."""
    n, e = (int(x) for x in np.frombuffer(data, "<u4", 2))
    offsets = np.frombuffer(data, "<u4", n + 1, 8)
    nbrs = np.frombuffer(data, "<u4", e, 8 + 4 * (n + 1))
    return lambda i: nbrs[offsets[i] : offsets[i + 1]] if 0 <= i < n else nbrs[:0]


def write_titles(titles: list[str]) -> bytes:
    """u32 N, N + 1 offsets, UTF-8 bytes."""
    raw = [t.encode() for t in titles]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype("<u4")
    return np.uint32(len(raw)).tobytes() + offsets.tobytes() + b"".join(raw)


def read_titles(data: bytes) -> list[str]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    o = np.frombuffer(data, "<u4", n + 1, 4)
    body = data[4 + 4 * (n + 1) :]
    return [body[a:b].decode() for a, b in zip(o, o[1:], strict=False)]


def indexed_titles(rows: list[tuple[int, str | None]]) -> list[str]:
    """Titles in order of their ids, which must be 0, 1, 2, ... without a gap; null titles are empty."""
    out = []
    for i, title in sorted(rows, key=lambda r: r[0]):
        if i != len(out):
            raise ValueError(f"gap or repeat: id {len(out)} expected, {i} found")
        out.append(title or "")
    return out


def write_compact_titles(titles: list[str]) -> bytes:
    """Magic, N, one byte of length a title, UTF-8 bytes."""
    raw = [t.encode() for t in titles]
    if long := [r for r in raw if len(r) > 255]:
        raise ValueError(f"a title of {len(long[0])} bytes; 255 fit")
    return b"WGT2" + np.uint32(len(raw)).tobytes() + bytes(map(len, raw)) + b"".join(raw)


def read_compact_titles(data: bytes) -> list[str]:
    if data[:4] != b"WGT2":
        raise ValueError("not a file of compact titles")
    n = int(np.frombuffer(data, "<u4", 1, 4)[0])
    ends = np.cumsum(np.frombuffer(data, "u1", n, 8).astype(np.int64)) + 8 + n
    return [data[a:b].decode() for a, b in zip([8 + n, *ends[:-1].tolist()], ends.tolist(), strict=False)] if n else []


def write_links(src: np.ndarray, tgt: np.ndarray) -> bytes:
    """u64 count, sources, targets."""
    return np.uint64(len(src)).tobytes() + np.asarray(src, "<u4").tobytes() + np.asarray(tgt, "<u4").tobytes()


def read_links(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    return np.frombuffer(data, "<u4", n, 8), np.frombuffer(data, "<u4", n, 8 + 4 * n)


#: The magics of the compact formats are WGV2, WGT2 and WGE2.


def write_compact(x: np.ndarray, y: np.ndarray, degree: np.ndarray, category: np.ndarray) -> bytes:
    """Magic, N, palette length, low end and scale padded to 24 bytes; palette, 16-bit x, y, palette index, 8-bit kind."""
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("a coordinate is no number")
    lo, hi = (float(min(x.min(), y.min())), float(max(x.max(), y.max()))) if len(x) else (0.0, 0.0)
    pad = 1e-4 * (hi - lo) or 1e-4  # all nodes in one place: a range of its own
    lo, scale = lo - pad, 65535 / (hi - lo + 2 * pad)
    palette, index = np.unique(degree.astype("<f4"), return_inverse=True)
    if len(palette) > 65536:
        raise ValueError("too many distinct degrees for 16 bits")
    q = lambda v: np.rint((v - lo) * scale).astype("<u2").tobytes()
    head = b"WGV2" + np.array([len(x), len(palette)], "<u4").tobytes() + np.array([lo, scale], "<f4").tobytes()
    return head.ljust(24, b"\0") + palette.tobytes() + q(x) + q(y) + index.astype("<u2").tobytes() + category.astype("u1").tobytes()


def read_compact(data: bytes) -> dict[str, np.ndarray]:
    if data[:4] != b"WGV2":
        raise ValueError("not a compact layout")
    n, p = (int(v) for v in np.frombuffer(data, "<u4", 2, 4))
    lo, scale = (float(v) for v in np.frombuffer(data, "<f4", 2, 12))
    palette, at = np.frombuffer(data, "<f4", p, 24), 24 + 4 * p
    x, y, k = (np.frombuffer(data, "<u2", n, at + 2 * n * i) for i in range(3))
    return {"x": x / scale + lo, "y": y / scale + lo, "degree": palette[k], "category": np.frombuffer(data, "u1", n, at + 6 * n)}


def write_mask(present: np.ndarray, x: np.ndarray, y: np.ndarray) -> bytes:
    """Strongest neighbours: N, a bit for each node with one (highest bit first), and the 16-bit pairs of those."""
    pairs = np.stack([x[present], y[present]], axis=1).astype("<u2")
    return b"WGE2" + np.uint32(len(present)).tobytes() + np.packbits(present).tobytes() + pairs.tobytes()


def read_mask(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if data[:4] != b"WGE2":
        raise ValueError("not a neighbour file")
    n = int(np.frombuffer(data, "<u4", 1, 4)[0])
    size = -(-n // 8)
    present = np.unpackbits(np.frombuffer(data, "u1", size, 8), count=n).astype(bool)
    return present, np.frombuffer(data, "<u2", offset=8 + size).reshape(-1, 2)


def packed(data: bytes, level: int = 9) -> bytes:
    return gzip.compress(data, level, mtime=0)


def binary_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Layout files as rows (path, idx, columns...), each file read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                m = read_layout(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(m)), pa.array(np.arange(len(m))), *[pa.array(m[:, k].astype(np.float64)) for k in range(len(columns))]], ["path", "idx", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, idx long, " + ", ".join(f"{c} double" for c in columns))
