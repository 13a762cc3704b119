"""Sources behind a network, with the fetching given by the caller: nothing here opens a connection."""

from __future__ import annotations

import bz2
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as t

_PAGE = re.compile(r"<page>(.*?)</page>", re.DOTALL)


def decompressed(chunks: Iterable[bytes]) -> Iterator[str]:
    """Text of a file of several bz2 streams, as its bytes come in; a character that a chunk splits is put together."""
    import codecs

    unpack, decode = bz2.BZ2Decompressor(), codecs.getincrementaldecoder("utf-8")("ignore")
    for raw in chunks:
        while raw:
            if out := decode.decode(unpack.decompress(raw)):
                yield out
            raw = unpack.unused_data if unpack.eof else b""
            if unpack.eof:
                unpack = bz2.BZ2Decompressor()


def split_pages(chunks: Iterable[str], most: int = 64 << 20) -> Iterator[str]:
    """The inside of each <page> element of a stream of text. A page of more than `most` characters, or one that is not
    ended within them, is an error; text between pages is let go."""
    held = ""
    for chunk in chunks:
        held += chunk
        end = 0
        for m in _PAGE.finditer(held):
            yield m[1]
            end = m.end()
        held = held[end:]
        begin = held.find("<page>")
        held = held[begin:] if begin >= 0 else held[-5:]
        if len(held) > most:
            raise ValueError(f"a page of more than {most} characters, or one without an end")


def top_titles(reply: dict) -> list[tuple[str, int]]:
    """(title, views) of a reply of the most viewed pages, without those that are no articles."""
    rows = ((a["article"].replace("_", " "), a["views"]) for item in reply.get("items", [])[:1] for a in item.get("articles", []))
    return [(title, views) for title, views in rows if title.strip() and not title.startswith(t.META_CRAWL)]


def paged_links(fetch: Callable[[dict], dict], title: str) -> list[str]:
    """Titles that a page links to, reply by reply until none says that there is more; each once, in order."""
    out, more = {}, {}
    while True:
        reply = fetch({"titles": title, "prop": "links", **more})
        for page in reply.get("query", {}).get("pages", {}).values():
            out |= {x["title"]: None for x in page.get("links", []) if not x["title"].startswith(t.META_CRAWL)}
        go_on = reply.get("continue", {}).get("plcontinue")
        if not go_on:
            return list(out)
        more = {"plcontinue": go_on}


def fetched_links(titles: DataFrame, fetch: Callable[[dict], dict]) -> DataFrame:
    """titles: (title). Rows (title, links, error), fetched on the executors; a page whose fetching fails has its error in
    place of links, so that it can be asked again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, links, errors = b.column("title").to_pylist(), [], []
            for name in names:
                try:
                    links.append(paged_links(fetch, name))
                    errors.append(None)
                except Exception as e:  # the network's, of any kind
                    links.append(None)
                    errors.append(str(e)[:500])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(links, pa.list_(pa.string())), pa.array(errors, pa.string())], ["title", "links", "error"])

    return titles.select(F.col("title").cast("string").alias("title")).mapInArrow(run, "title string, links array<string>, error string")


def first_version(read: Callable[[str], bytes], versions: list[list[str]]) -> tuple[int, dict[str, bytes]]:
    """(which, files): the first version of which all files can be read; a version with one missing is not used at all."""
    errors = []
    for k, names in enumerate(versions):
        try:
            return k, {n: read(n) for n in names}
        except OSError as e:
            errors.append(str(e))
    raise FileNotFoundError("; ".join(errors))


def write_clustered(rows: DataFrame, path: str, by: list[str], files: int | None = None) -> None:
    """Rows sorted over all files by columns, so that a range of them is read from few row groups."""
    spread = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    spread.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
