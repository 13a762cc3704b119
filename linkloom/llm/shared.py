"""What the training-data operators share: table access, scratch tables in the cluster's shared folder, and a
columnar word scanner that works on Arrow buffers without a Python loop over rows."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Separators of words: space and the controls 0x09 to 0x0D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that the scanner takes into numpy at a time; one longer document makes a longer slice.
SLICE_BYTES = 1 << 19


#: Bytes of a batch that goes to Python, however long its texts.
ARROW_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, after a session setting: batches for Python hold ARROW_BYTES or a row in place of 64 MB, of which a task would
    need several times as much beside its heap."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one is set on one machine (tests); on a cluster
    that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext.getCheckpointDir()
    return found


class Scratch:
    """Tables written once into the shared folder, so that no lineage is kept on executors. They go when dropped, or
    when the driver ends; results that still read them stay valid until then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.there: set[str] = set()
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        self.there.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._linkloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._linkloom_path)
            self.there.discard(t._linkloom_path)

    def keep(self, *tables: DataFrame) -> None:
        """Drops all but these: what the result still reads."""
        for path in self.there - {t._linkloom_path for t in tables}:
            self._delete(path)
            self.there.discard(path)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets go of what ran before: plans, broadcasts and shuffle files of earlier jobs stay on the driver and on the
    executors' disks until the driver's garbage is collected, which may take as long as its heap has room. What numpy and
    Arrow have freed on the driver goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (multiply and shift rounds)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]
_PRIME = np.uint64(0x5851F42D4C957F2D)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1024)
        steps = np.full(size, _PRIME, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def binary_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


def slices(offsets: np.ndarray, most_rows: int = 60_000, most_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), at + most_rows, n)
        yield at, to
        at = to


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word `[^\\x20\\x09-\\x0D]+`; offsets start at 0."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SEP[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    first[-1] = True
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    begin = np.cumsum(lens) - lens
    rel = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(begin, lens)
    inside = rel + np.repeat(starts, lens)
    vals = _BYTE[data[inside]]
    vals *= powers(int(lens.max()))[rel]
    return mix64(np.add.reduceat(vals, begin) + lens.astype(np.uint64))


def scan_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: (first row, end row, row of each word within the slice, its hash). Rows come in order."""
    offsets, data = binary_column(column)
    for lo, hi in slices(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, rows = word_bounds(own, part)
        yield lo, hi, rows, word_hashes(starts, ends, part)
