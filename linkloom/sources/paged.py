"""A stream of article details from a paged network source: continuation tokens as progress, one rate budget for all tasks.

spark.readStream.format(name) after `register(spark, fetch, titles, folder)`. Titles are dealt out to shards, each a
partition of its own. A micro-batch is a round, its number the stream's offset: every shard asks for a few pages, going
on from the token that its last round ended with. What a round got is written to the shared folder before it is handed
on, under the shard's and the round's name, by a rename; a round that is run again after a failure or a restart reads
that and asks for nothing. So no page is asked for twice, whatever is lost in between. `per_second` is shared out evenly
among the shards.

The fetcher is the caller's: a function from request parameters to the reply, as nested dictionaries. Nothing here opens
a connection."""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from linkloom.functions import text as t
from linkloom.sources.asset_sink import store

SCHEMA = "title string, page int, snippet string, categories array<string>, views long, links array<string>, last boolean, missing boolean, error string"
PROPS = "extracts|categories|pageviews|links"


def details(reply: dict) -> dict:
    """Extract, categories, views of the last days and links of a reply's page; what the reply lacks is null, or empty
    for lists. A page that does not exist is missing. Links to pages that are no articles are left out."""
    out = {"snippet": None, "categories": [], "views": None, "links": [], "missing": False}
    for number, page in reply.get("query", {}).get("pages", {}).items():
        out["missing"] |= str(number) == "-1" or "missing" in page
        if page.get("extract") is not None:
            out["snippet"] = page["extract"]
        out["categories"] += [c["title"] for c in page.get("categories", [])]
        if (views := page.get("pageviews")) is not None:
            out["views"] = (out["views"] or 0) + sum(v for v in views.values() if v is not None)
        out["links"] += [x["title"] for x in page.get("links", []) if not x["title"].startswith(t.META_CRAWL)]
    return out


class Shard(InputPartition):
    def __init__(self, shard: int, start: int, end: int):
        super().__init__((shard, start, end))
        self.shard, self.start, self.end = shard, start, end


class PagedReader(DataSourceStreamReader):
    def __init__(self, fetch: Callable[[dict], dict], titles: list[str], folder: str, shards: int, pages: int, per_second: float, pause: Callable[[float], None]):
        self.fetch, self.folder, self.pages, self.wait, self.pause = fetch, folder, pages, shards / per_second, pause
        self.mine = [[x for x in titles if zlib.crc32(x.encode()) % shards == k] for k in range(shards)]

    # ---- progress

    def _read(self, name: str) -> dict | None:
        fs, at = store(f"{self.folder}/{name}")
        if fs.get_file_info(at).type != pafs.FileType.File:
            return None
        with fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def _put(self, name: str, what: dict) -> None:
        fs, at = store(f"{self.folder}/{name}")
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        temp = f"{at}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temp) as f:
            f.write(json.dumps(what).encode())
        fs.move(temp, at)

    def _state(self, shard: int, round_: int) -> dict:
        """Where a shard stands after a round: the place of its title, the token, the page of the title."""
        if round_ == 0:
            return {"at": 0, "token": None, "page": 0}
        kept = self._read(f"shard-{shard}/round-{round_}.json")
        if kept is None:
            raise FileNotFoundError(f"round {round_} of shard {shard} is not in {self.folder}")
        return kept["state"]

    # ---- the stream

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        """One round more than all shards have done, unless that ended every shard."""
        done = 0
        while all(self._read(f"shard-{k}/round-{done + 1}.json") is not None for k in range(len(self.mine))):
            done += 1
        ended = all(self._state(k, done)["at"] >= len(self.mine[k]) for k in range(len(self.mine)))
        return {"round": done if ended else done + 1}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(k, start["round"], end["round"]) for k in range(len(self.mine))]

    def read(self, partition: Shard) -> Iterator[tuple]:
        for round_ in range(partition.start + 1, partition.end + 1):
            name = f"shard-{partition.shard}/round-{round_}.json"
            kept = self._read(name)
            if kept is None:
                kept = self._round(partition.shard, self._state(partition.shard, round_ - 1))
                self._put(name, kept)
            yield from (tuple(r) for r in kept["rows"])

    def _round(self, shard: int, state: dict) -> dict:
        rows, mine = [], self.mine[shard]
        state = dict(state)
        while len(rows) < self.pages and state["at"] < len(mine):
            title = mine[state["at"]]
            self.pause(self.wait)
            try:
                reply = self.fetch({"titles": title, "prop": PROPS, **(state["token"] or {})})
                d, token, error = details(reply), reply.get("continue"), None
            except Exception as e:  # the network's, of any kind: the title is given up, with its error
                d, token, error = {"snippet": None, "categories": [], "views": None, "links": [], "missing": False}, None, str(e)[:500]
            rows.append((title, state["page"], d["snippet"], d["categories"], d["views"], d["links"], token is None, d["missing"], error))
            state = {"at": state["at"], "token": token, "page": state["page"] + 1} if token else {"at": state["at"] + 1, "token": None, "page": 0}
        return {"rows": rows, "state": state}

    def commit(self, end: dict) -> None:
        """Rounds before the last committed one are not read again; their pages can go."""
        fs, _ = store(self.folder)
        for k in range(len(self.mine)):
            kept = self._read(f"shard-{k}/round-{end['round'] - 1}.json") if end["round"] > 1 else None
            if kept and kept["rows"]:
                self._put(f"shard-{k}/round-{end['round'] - 1}.json", {"rows": [], "state": kept["state"]})


def register(spark: SparkSession, fetch: Callable[[dict], dict], titles: list[str], folder: str, name: str = "article_pages", shards: int = 4, pages: int = 20, per_second: float = 10.0, pause: Callable[[float], None] = time.sleep) -> None:
    """Makes the source known to a session. folder: a place that driver and executors share; a later session that gives
    the same titles and folder goes on where this one stops."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> PagedReader:
            return PagedReader(fetch, titles, folder, shards, pages, per_second, pause)

    spark.dataSource.register(Paged)


def articles_of(pages):
    """pages: rows of the stream, read back as a table. One row a title with all its pages put together: title, snippet,
    categories, views, links; titles that are missing, or of which a page failed, are left out."""
    from pyspark.sql import functions as F

    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = pages.groupBy("title").agg(F.max("snippet").alias("snippet"), joined("categories").alias("categories"), F.sum("views").alias("views"), joined("links").alias("links"), F.max("missing").alias("missing"), F.max("error").alias("error"), F.max("last").alias("last"))
    return out.where("not missing and error is null and last").select("title", F.coalesce("snippet", F.lit("")).alias("snippet"), "categories", F.coalesce("views", F.lit(0)).alias("views"), "links")
