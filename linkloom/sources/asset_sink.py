"""A sink for the viewer's binary assets: files that partitions write in parts and the commit joins.

df.write.format("graph_asset").option("asset", kind).mode("append").save(path) writes one file of rows sorted by id, ids
being 0, 1, 2, ... Kinds and their columns: adjacency (idx, nbrs array<int>), layout (idx, then numbers), titles (idx, title),
blobs (idx, data binary), which are put one after the other. `write_asset` deals rows to ranges of ids first, so each
partition's rows are a run of the file.

A task writes its rows to files of its own attempt in a staging folder and reports its first and last id and its sizes.
The commit sees only the reports of the attempts that count: it checks that the runs follow each other without a gap or
a repeat, turns local offsets into those of the file by adding what lies before, copies the parts in blocks of bounded
size into one file and renames it. An abort, or a failing check, removes the staging folder and leaves an older file as it
is. The bytes are those of the writers in codecs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that the commit copies at a time.
BLOCK = 8 << 20
KINDS = ("adjacency", "layout", "titles", "blobs")
MOST_U32 = (1 << 32) - 1


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: a run of ids, and how many bytes or entries its sizes and its data have."""

    name: str
    first: int
    last: int
    entries: int


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def encoded(kind: str, batch: pa.RecordBatch) -> tuple[np.ndarray | None, bytes, int]:
    """(sizes of rows, where the file has offsets; data; entries of data)."""
    if kind == "layout":
        m = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype("<f4") for c in range(1, batch.num_columns)], axis=1)
        return None, m.tobytes(), len(m)
    column = batch.column(1)
    if kind == "adjacency":
        column = column.cast(pa.list_(pa.int64()))
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and (flat.min() < 0 or flat.max() > MOST_U32):
            raise ValueError("a neighbour's id does not fit 32 bits")
        return lengths(column), flat.astype("<u4").tobytes(), len(flat)
    raw = column.cast(pa.large_binary()).fill_null(b"")
    sizes = pa.compute.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    data = b"".join(raw.to_pylist())
    return sizes if kind == "titles" else None, data, len(data)


class AssetWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema):
        self.path, self.kind = options["path"], options.get("asset", "")
        if self.kind not in KINDS:
            raise ValueError(f"asset is one of {', '.join(KINDS)}, not {self.kind!r}")
        self.width = len(schema.fields) - 1
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, staging = store(self.staging)
        fs.create_dir(staging, recursive=True)
        name, first, last, entries = uuid.uuid4().hex, 0, -1, 0
        with fs.open_output_stream(f"{staging}/{name}.sizes") as s, fs.open_output_stream(f"{staging}/{name}.data") as d:
            for b in iterator:
                if not len(b):
                    continue
                ids = b.column(0).to_numpy(zero_copy_only=False)
                if last < 0:
                    first, last = int(ids[0]), int(ids[0]) - 1
                if b.column(0).null_count or (ids != np.arange(last + 1, last + 1 + len(ids))).any():
                    raise ValueError(f"gap or repeat of ids after {last}")
                last = int(ids[-1])
                sizes, data, n = encoded(self.kind, b)
                if sizes is not None:
                    s.write(sizes.tobytes())
                d.write(data)
                entries += n
        return Part(name, first, last, entries)

    def commit(self, messages: list[Part | None]) -> None:
        try:
            self.join(sorted((m for m in messages if m is not None and m.last >= m.first), key=lambda m: m.first))
        finally:
            self.clean()

    def join(self, parts: list[Part]) -> None:
        n = 0
        for p in parts:
            if p.first != n:
                raise ValueError(f"gap or repeat of ids: {n} expected, {p.first} found")
            n = p.last + 1
        total = sum(p.entries for p in parts)
        if self.kind in ("adjacency", "titles") and max(n, total) > MOST_U32:
            raise ValueError(f"{n} rows and {total} entries do not fit offsets of 32 bits")
        (fs, staging), (_, path) = store(self.staging), store(self.path)
        fs.create_dir(staging, recursive=True)
        whole = f"{staging}/{uuid.uuid4().hex}.whole"
        with fs.open_output_stream(whole) as out:
            if self.kind != "blobs":
                out.write(np.array([n, total] if self.kind == "adjacency" else [n], "<u4").tobytes())
            if self.kind in ("adjacency", "titles"):
                out.write(np.zeros(1, "<u4").tobytes())
                before = 0
                for p in parts:
                    for raw in self.blocks(fs, f"{staging}/{p.name}.sizes"):
                        upto = before + np.cumsum(np.frombuffer(raw, np.int64))
                        out.write(upto.astype("<u4").tobytes())
                        before = int(upto[-1])
            for p in parts:
                for raw in self.blocks(fs, f"{staging}/{p.name}.data"):
                    out.write(raw)
        fs.move(whole, path)

    @staticmethod
    def blocks(fs, path: str) -> Iterator[bytes]:
        with fs.open_input_stream(path) as f:
            while raw := f.read(BLOCK):
                yield raw

    def clean(self) -> None:
        fs, staging = store(self.staging)
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)

    def abort(self, messages: list[Part | None]) -> None:
        self.clean()


class AssetSink(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "graph_asset"

    def writer(self, schema, overwrite: bool) -> AssetWriter:
        return AssetWriter(dict(self.options), schema)


def write_asset(rows: DataFrame, kind: str, path: str, parts: int | None = None) -> None:
    """rows: the kind's columns, the first of them the id. The file at path is replaced by one of these rows."""
    spark, key = rows.sparkSession, rows.columns[0]
    spark.dataSource.register(AssetSink)
    dealt = rows.repartitionByRange(parts, key) if parts else rows.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.format("graph_asset").option("asset", kind).mode("append").save(path)


def write_graph(nodes: DataFrame, links: DataFrame, folder: str) -> None:
    """nodes: (idx, title, x, y), links: (src, tgt): adjacency.bin, layout.bin and titles.bin in a folder."""
    from linkloom.operators import graph as g

    near = nodes.select("idx").join(g.adjacency(links), "idx", "left").select("idx", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))
    write_asset(near, "adjacency", f"{folder}/adjacency.bin")
    write_asset(nodes.select("idx", "x", "y"), "layout", f"{folder}/layout.bin")
    write_asset(nodes.select("idx", "title"), "titles", f"{folder}/titles.bin")


def read_adjacency_rows(spark, path: str, rows_at_a_time: int = 1 << 20) -> DataFrame:
    """(idx, nbrs) of an adjacency file, read by ranges of ids: each task reads its offsets and its neighbours only."""
    fs, at = store(path)
    with fs.open_input_file(at) as f:
        n = int(np.frombuffer(f.read_at(4, 0), "<u4")[0]) if f.size() else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fs, at = store(path)
            with fs.open_input_file(at) as f:
                for lo in (b.column("id").to_numpy() * rows_at_a_time).tolist():
                    hi = min(n, lo + rows_at_a_time)
                    ends = np.frombuffer(f.read_at(4 * (hi - lo + 1), 8 + 4 * lo), "<u4").astype(np.int64)
                    raw = np.frombuffer(f.read_at(4 * int(ends[-1] - ends[0]), 8 + 4 * (n + 1) + 4 * int(ends[0])), "<u4").astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.LargeListArray.from_arrays(pa.array(ends - ends[0]), pa.array(raw)).cast(pa.list_(pa.int64()))], ["idx", "nbrs"])

    return spark.range(0, -(-n // rows_at_a_time)).mapInArrow(run, "idx long, nbrs array<bigint>")
