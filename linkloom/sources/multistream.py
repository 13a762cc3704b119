"""A source for dumps of many bzip2 streams in one file: each partition reads the streams that begin in its range of bytes.

spark.read.format("multistream").load(path) gives (title, ns, text) of every page; `split_bytes` sets how many bytes of
the file a partition takes. A stream begins with the bytes of bzip2's header and of its first block, which a reader
looks for from the start of its range, so nothing scans the file beforehand and one large file is many tasks. A page
belongs to the partition in whose streams its start tag begins; it is read on into later streams if it ends there.

With an index of the file (lines of offset:id:title) the streams of chosen pages are read alone, by `read_streams`."""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

#: Begin of a stream: its header and the magic number of its first block.
MAGIC = re.compile(rb"BZh[1-9]1AY&SY")
MAGIC_BYTES = 10
#: Bytes read at a time; bytes of a partition; bytes of a page at most.
CHUNK, SPLIT_BYTES, MOST_PAGE = 1 << 20, 64 << 20, 256 << 20
SCHEMA = "title string, ns string, text string"
_OPEN, _CLOSE = b"<page>", b"</page>"


def open_input(path: str):
    """A file of any store that Arrow reads, for reading at places, and its size."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at), fs.get_file_info(at).size


def first_stream(f, start: int, end: int) -> int | None:
    """The first place from start on and before end where a stream begins."""
    at, tail = start, b""
    while at - len(tail) < end:
        raw = f.read_at(CHUNK, at)
        if not raw:
            return None
        if m := MAGIC.search(tail + raw):
            found = at - len(tail) + m.start()
            return found if found < end else None
        at += len(raw)
        tail = (tail + raw)[-(MAGIC_BYTES - 1) :]
    return None


def inflated(f, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """Text from the stream at start on, to the end of the file; with each piece whether its stream begins before end."""
    at, unpack, owned, seen = start, bz2.BZ2Decompressor(), True, False
    while raw := f.read_at(CHUNK, at):
        at += len(raw)
        while raw:
            seen = True
            if out := unpack.decompress(raw):
                yield out, owned
            raw = unpack.unused_data if unpack.eof else b""
            if unpack.eof:
                seen = False
                unpack, owned = bz2.BZ2Decompressor(), at - len(raw) < end
                if not owned:
                    yield b"", False  # nothing more is owned: the last page may end here
    if at > start and not unpack.eof and seen:
        raise EOFError("the file ends within a stream")


def pages_between(f, start: int, end: int) -> Iterator[bytes]:
    """Every <page> element that begins in the streams that begin from start on and before end."""
    begin = first_stream(f, start, end)
    if begin is None:
        return
    held, searched, ours = b"", 0, True
    for piece, owned in inflated(f, begin, end):
        if not owned and ours:
            # what is held without a start tag is not the beginning of a page, unless it is cut within the tag
            ours = False
            at = held.find(_OPEN)
            if at < 0:
                held = next((held[-n:] for n in range(len(_OPEN) - 1, 0, -1) if held.endswith(_OPEN[:n])), b"")
                if not held:
                    return
                searched = 0
        held += piece
        while True:
            at = held.find(_OPEN)
            if at < 0:
                if not ours and not any(_OPEN.startswith(held[-n:]) and len(held) == n for n in range(1, len(_OPEN))):
                    return
                keep = len(_OPEN) - 1
                held, searched = held[-keep:], 0
                break
            to = held.find(_CLOSE, max(at, searched))
            if to < 0:
                if len(held) - at > MOST_PAGE:
                    raise ValueError(f"a page of more than {MOST_PAGE} bytes, or one without an end")
                held, searched = held[at:], max(0, len(held) - at - len(_CLOSE))
                break
            yield held[at : to + len(_CLOSE)]
            held, searched = held[to + len(_CLOSE) :], 0
            if not ours:
                return


def parsed(pages: Iterator[bytes], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """(title, ns, text) of pages, as they stand there."""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["title", "ns", "text"])

    size = 0
    for raw in pages:
        page = ElementTree.fromstring(raw)
        out.append((page.findtext("title"), page.findtext("ns"), page.findtext("revision/text")))
        size += len(raw)
        if len(out) >= rows or size > 8 << 20:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class MultistreamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        f, size = open_input(self.path)
        f.close()
        return [Range(self.path, k, min(k + self.split, size)) for k in range(0, max(size, 1), self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        f, _ = open_input(partition.path)
        with f:
            yield from parsed(pages_between(f, partition.start, partition.end))


class MultistreamSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "multistream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MultistreamReader:
        return MultistreamReader(dict(self.options))


def read_pages(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(MultistreamSource)
    return spark.read.format("multistream").option("split_bytes", str(split_bytes)).load(path)


def read_dump(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Title and text of main-namespace pages that are no redirects: the rows of articles.read_dump, by many tasks."""
    from linkloom.sources.articles import main_articles

    return main_articles(read_pages(spark, path, split_bytes), F.col("text"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(offset, end, page_id, title) of an index of lines offset:id:title; end is where the next stream begins, null for
    the last."""
    parts = F.regexp_extract("value", r"^(\d+):(\d+):(.*)$", 1), F.regexp_extract("value", r"^(\d+):(\d+):(.*)$", 2), F.regexp_extract("value", r"^(\d+):(\d+):(.*)$", 3)
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\d+:\d+:")).select(parts[0].cast("long").alias("offset"), parts[1].cast("long").alias("page_id"), parts[2].alias("title"))
    # streams by ranges of their offsets; the first of the next range is one row a range
    starts = rows.select("offset").distinct().repartitionByRange("offset").withColumn("part", F.spark_partition_id())
    firsts = starts.groupBy("part").agg(F.min("offset").alias("first"))
    after = firsts.select((F.dense_rank().over(Window.orderBy("part")) - 1).alias("k"), "first", "part")
    following = after.select((F.col("k") - 1).alias("k"), F.col("first").alias("after")).join(after.select("k", "part"), "k").select("part", "after")
    ends = starts.withColumn("end", F.lead("offset").over(Window.partitionBy("part").orderBy("offset"))).join(following, "part", "left")
    return rows.join(ends.select("offset", F.coalesce("end", "after").alias("end")), "offset").select("offset", "end", "page_id", "title")


def read_streams(streams: DataFrame, path: str) -> DataFrame:
    """streams: (offset). (title, ns, text) of the pages that begin in these streams of the file, and of no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, _ = open_input(path)
        with f:
            for b in batches:
                for offset in b.column("offset").to_pylist():
                    yield from parsed(pages_between(f, offset, offset + 1))

    return streams.select("offset").distinct().mapInArrow(run, SCHEMA)


def compressed(streams: DataFrame) -> DataFrame:
    """streams: (idx, text). (idx, data): each text as one bzip2 stream, for a sink that puts them one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("idx"), pa.array([bz2.compress((x or "").encode()) for x in b.column("text").to_pylist()], pa.binary())], ["idx", "data"])

    return streams.select(F.col("idx").cast("long").alias("idx"), "text").mapInArrow(run, "idx long, data binary")


def write_dump(rows: list[tuple[str, str, str]], path: str, pages_a_stream: int = 100) -> list[tuple[int, int, str]]:
    """A small dump of (title, ns, text), for fixtures; returns its index."""
    from xml.sax.saxutils import escape

    index, at = [], 0
    with open(path, "wb") as f:
        def put(text: str) -> None:
            nonlocal at
            at += f.write(bz2.compress(text.encode()))

        put("<mediawiki>\n")
        for lo in range(0, len(rows), pages_a_stream):
            some = rows[lo : lo + pages_a_stream]
            index += [(at, lo + k + 1, title) for k, (title, _, _) in enumerate(some)]
            put("".join(f"<page><title>{escape(t)}</title><ns>{ns}</ns><revision><text>{escape(x)}</text></revision></page>\n" for t, ns, x in some))
        put("</mediawiki>\n")
    return index
