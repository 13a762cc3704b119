"""Readers, codecs and streams: round trips through files."""

import bz2
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as t
from linkloom.sources import articles, codecs, store
from linkloom.streaming import events

from .conftest import DATA

PAGE = "<page><title>{}</title><ns>{}</ns><revision><text>{}</text></revision></page>"


@pytest.mark.parametrize("pack", [None, bz2.compress])
def test_dump(spark, tmp_path, pack):
    body = "<mediawiki>" + "".join(PAGE.format(*x) for x in [("A", 0, "Text [[b#c|d]] and [[File:x]]. [[Category:K|s]]"), ("B", 1, "no"), ("C", 0, "  #redirect [[A]]"), ("D", 0, "")]) + "</mediawiki>"
    path = tmp_path / ("d.xml" + (".bz2" if pack else ""))
    path.write_bytes(pack(body.encode()) if pack else body.encode())
    got = articles.parsed_articles(articles.read_dump(spark, str(path))).collect()
    assert [(r.title, r.links, r.categories) for r in got] == [("A", ["B"], ["Category:K"])]


def test_pageviews_and_edges(spark, tmp_path):
    (tmp_path / "v.txt").write_text("en A_b 3 0\nen A_b 5 0\nen C x 0\nde A_b 9 0\nen.wikipedia A_b 2 0\n")
    read = lambda how: {r.title: r.views for r in articles.read_pageviews(spark, str(tmp_path / "v.txt"), how).collect()}
    assert read("max") == {"A b": 5} and read("sum") == {"A b": 10}
    e = spark.createDataFrame([(1, 2, 0.3125), (2, 3, 1.0)], "source int, target int, weight double")
    articles.write_weighted_edges(e, str(tmp_path / "e"))
    assert sorted((r.source, r.target, round(r.weight, 3)) for r in articles.read_weighted_edges(spark, str(tmp_path / "e")).collect()) == [(1, 2, 0.312), (2, 3, 1.0)]


def test_codecs(spark, tmp_path):
    r = np.random.default_rng(1)
    x, y, d, c = r.normal(size=50), r.normal(size=50), r.integers(0, 9, 50), r.integers(0, 7, 50)
    m = codecs.read_layout(codecs.write_layout([x, y, d]))
    assert m.shape == (50, 3) and np.allclose(m[:, 0], x, atol=1e-6)
    k = codecs.read_compact(codecs.write_compact(x, y, d, c))
    assert np.abs(k["x"] - x).max() < 1e-3 and (k["degree"] == d).all() and (k["category"] == c).all()
    with pytest.raises(ValueError):
        codecs.read_compact(b"xxxx" + bytes(30))
    nbrs = codecs.read_adjacency(codecs.write_adjacency(np.array([2, 0, 1]), np.array([1, 2, 0])))
    assert nbrs(0).tolist() == [1, 2] and nbrs(1).tolist() == [] and nbrs(9).tolist() == []
    assert codecs.read_titles(codecs.write_titles(["a", "", "éß"])) == ["a", "", "éß"]
    assert [v.tolist() for v in codecs.read_links(codecs.write_links(np.array([1, 2]), np.array([3, 4])))] == [[1, 2], [3, 4]]
    has = np.array([True, False, True] * 5)
    present, pairs = codecs.read_mask(codecs.write_mask(has, np.arange(15), np.arange(15) + 1))
    assert (present == has).all() and pairs[1].tolist() == [2, 3]
    (tmp_path / "l.bin.gz").write_bytes(gzip.compress(codecs.write_layout([x, y])))
    assert codecs.binary_rows(spark, str(tmp_path / "l.bin.gz"), ["x", "y"]).count() == 50


def test_contexts_come_from_the_right_sentence(spark):
    df = spark.createDataFrame([("A", "She is an Indian-American writer. She visited [[India|Indian]] cities often.")], "title string, text string")
    assert [(r.target, r.context) for r in t.link_contexts(df).collect()] == [("India", "She visited Indian cities often.")]


def test_streams(spark, tmp_path):
    src = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), 1)
    q = stream.writeStream.foreachBatch(events.upsert_sink(str(tmp_path / "out"), "user_id", "event_id")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_id: r.event_id for r in store.MergedTable(spark, str(tmp_path / "out"), "user_id", "event_id").read().collect()}
    assert got == {r.user_id: r.e for r in src.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}
    q = events.windowed(events.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == src.count()


def test_evictions_within_any_span(spark):
    df = spark.sql("SELECT id AS event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 60) AS ts, 1L AS user_id, 'a' AS event_type, 1.0D AS value FROM range(4)")
    of = lambda span: [r.evicted for r in events.evictions(df, span).orderBy("event_id").collect()]
    assert of("30 seconds") == [False] * 4 and of("60 seconds") == of("1 hour") == [True, True, True, False]


def test_crawl(spark):
    web = {"a": ["b", "c"], "b": ["c", "d"], "c": [], "d": ["a"]}
    seen = []
    fetch = lambda batch: spark.createDataFrame([(r.title, web[r.title]) for r in batch.collect()], "title string, links array<string>")
    rounds = events.crawl(spark, fetch, spark.createDataFrame([("a",)], "title string"), lambda got: seen.extend(r.title for r in got.collect()), 10, 2)
    assert sorted(seen) == ["a", "b", "c", "d"] and rounds < 10


def test_resumed_and_fetched(spark, tmp_path):
    pages = spark.createDataFrame([("a",), ("b",), ("c",)], "title string")
    assert sorted(r.title for r in articles.not_yet(pages, pages.where("title = 'b'")).collect()) == ["a", "c"]
    asked = {}

    def fetch(url):  # busy twice, then there
        asked[url] = asked.get(url, 0) + 1
        return (429, None) if asked[url] < 3 else (200 if url != "gone" else 404, f"body of {url}")

    got = {r.url: (r.status, r.body) for r in articles.fetched(spark.createDataFrame([("x",), ("gone",)], "url string").coalesce(1), fetch, wait=lambda s: None).collect()}
    assert got == {"x": (200, "body of x"), "gone": (404, "body of gone")}
    (tmp_path / "m.csv").write_text("id,views,category_id\n2,5,1\n0,7,6\n")
    assert [tuple(r) for r in articles.read_metadata(spark, str(tmp_path / "m.csv")).collect()] == [(0, 7, 6), (2, 5, 1)]
    spark.range(3).write.parquet(str(tmp_path / "there"))
    assert articles.first_that_reads(spark, [str(tmp_path / "missing"), str(tmp_path / "there")]).count() == 3
    with pytest.raises(FileNotFoundError):
        articles.first_that_reads(spark, [str(tmp_path / "missing")])
