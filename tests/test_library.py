"""Search, layouts, connectors, compact titles and the progress log on small cases."""

import bz2
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from linkloom.functions import maths, topics
from linkloom.operators import graph as g
from linkloom.operators import layout, search
from linkloom.sources import articles as src
from linkloom.sources import codecs, connectors
from linkloom.streaming import events

CLIQUES = [(a + o, b + o) for o in (0, 6) for a, b in itertools.combinations(range(6), 2)] + [(0, 6)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, tgt long")


def test_search(spark):
    nodes = spark.createDataFrame([(1, "Sand dune"), (2, "sea"), (3, "Seal"), (4, "big Sea lion")], "idx long, title string")
    of = lambda df: [r.idx for r in df.collect()]
    assert of(search.lookup_nodes(nodes, ["sea"], [4])) == [2, 4] and of(search.lookup_nodes(nodes)) == []
    assert of(search.prefix_search(nodes, "SE")) == [2, 3] and of(search.cased_prefix_search(nodes, "se")) == [3, 2]
    assert of(search.token_search(nodes, "se li")) == [4] and of(search.token_search(nodes, "se")) == [2, 3, 4]
    assert [(r.kind, r.nbr) for r in search.connections(frame(spark, [(1, 2), (1, 3), (4, 1)]), 1, 1).collect()] == [("out", 2), ("in", 4)]
    arts = spark.createDataFrame([(1, True, "s", "[]", None), (2, True, "s", '["a"]', "x"), (3, False, None, None, None), (4, True, " ", '["a"]', None)], "id long, crawled boolean, snippet string, categories string, link_contexts string")
    assert [r.id for r in search.incomplete_articles(arts).collect()] == [1, 4] and [r.id for r in search.repair_set(arts, 1).collect()] == [1]


def test_routes_by_every_method(spark):
    e = frame(spark, [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (9, 4)])
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "idx long, x double, y double")
    links = {(r.src, r.tgt) for r in e.collect()}
    for method in ("bfs", "bidirectional", "undirected", "weighted", "dfs", "astar", "greedy", "walk"):
        p = [r.idx for r in search.shortest_path(e, 0, 4, method, nodes, seed=3).orderBy("pos").collect()]
        assert p[0] == 0 and p[-1] == 4 and all((a, b) in links for a, b in zip(p, p[1:])), method
        assert method == "undirected" or search.shortest_path(e, 0, 9, method, nodes).collect() == []
    with pytest.raises(ValueError, match="no method"):
        search.shortest_path(e, 0, 4, "guess")


def test_simulation(spark):
    r = random.Random(1)
    nodes = spark.createDataFrame([(i, r.uniform(-50, 50), r.uniform(-50, 50), i) for i in range(12)], "idx long, x double, y double, views long")
    at = {p.idx: (p.x, p.y) for p in layout.simulate(nodes, frame(spark, CLIQUES), 20, spring=1.0, length=5.0, charge=-5.0, collision=2.0, per_cell=5).collect()}
    far = lambda a, b: ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5
    assert all(abs(v) < 1e4 for p in at.values() for v in p)
    linked = [far(a, b) for a, b in CLIQUES]
    apart = [far(a, b) for a in range(6) for b in range(6, 12) if (a, b) != (0, 6)]
    assert sum(linked) / len(linked) < sum(apart) / len(apart)
    for kind in ("spiral", "galactic", "nebula", "communities"):
        out = layout.seed_layout(nodes.withColumn("category", F.col("idx") % 3), kind).collect()
        assert len({(round(p.x, 9), round(p.y, 9)) for p in out}) == 12
    assert [n for n, _ in itertools.islice(layout.layout_grid(nodes, frame(spark, CLIQUES), 0), 9)] == [f"k{i}_g{j}" for i in range(3) for j in range(3)]


def test_projection_keeps_communities(spark):
    at = {p.idx: (p.x, p.y) for p in g.project(g.embed(frame(spark, CLIQUES), 32)).collect()}
    mean = lambda ids: [sum(at[i][k] for i in ids) / 6 for k in (0, 1)]
    a, b = mean(range(6)), mean(range(6, 12))
    near = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2
    assert all(near(at[i], a) < near(at[i], b) for i in range(1, 6)) and all(near(at[i], b) < near(at[i], a) for i in range(7, 12))


def test_core_numbers_against_peeling(spark):
    r = random.Random(5)
    edges = [(a, b) for a, b in itertools.combinations(range(40), 2) if r.random() < (0.5 if a < 12 and b < 12 else 0.08)] + [(99, i) for i in range(40)]
    near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in {x for e in edges for x in e}}
    want, k = {}, 0
    while near:
        v = min(near, key=lambda v: len(near[v]))
        k = max(k, len(near[v]))
        want[v] = k
        for w in near.pop(v):
            near[w].discard(v)
    assert {x.idx: x.core for x in g.core_numbers(frame(spark, edges)).collect()} == want
    with pytest.raises(RuntimeError, match="rounds"):
        g.core_numbers(frame(spark, edges), 1)


def test_connectors(spark):
    dump = "<x><page>a é</page> <page>b\nc</page><page>open"
    raw = b"".join(bz2.compress(part) for part in (dump.encode()[:12], dump.encode()[12:]))
    chunks = [raw[i : i + 7] for i in range(0, len(raw), 7)]
    assert list(connectors.split_pages(connectors.decompressed(chunks))) == ["a é", "b\nc"]
    reply = {"items": [{"articles": [{"article": "Big_cat", "views": 5}, {"article": "Special:Search", "views": 9}, {"article": "Main_Page", "views": 9}, {"article": "_", "views": 1}]}]}
    assert connectors.top_titles(reply) == [("Big cat", 5)] and connectors.top_titles({}) == []

    def fetch(ask):
        if ask["titles"] == "gone":
            raise OSError("no network")
        first = {"query": {"pages": {"1": {"links": [{"title": "A"}, {"title": "Help:x"}]}}}, "continue": {"plcontinue": "p2"}}
        return first if "plcontinue" not in ask else {"query": {"pages": {"1": {"links": [{"title": "B"}, {"title": "A"}]}}}}

    got = {r.title: (r.links, r.error) for r in connectors.fetched_links(spark.createDataFrame([("t",), ("gone",)], "title string"), fetch).collect()}
    assert got == {"t": (["A", "B"], None), "gone": (None, "no network")}
    files = {"a2": b"1", "a1": b"2", "b1": b"3"}

    def read(name):
        if name not in files:
            raise FileNotFoundError(name)
        return files[name]

    assert connectors.first_version(read, [["a2", "b2"], ["a1", "b1"]]) == (1, {"a1": b"2", "b1": b"3"})
    with pytest.raises(FileNotFoundError):
        connectors.first_version(read, [["a2", "b2"]])


def test_clustered_table(spark, tmp_path):
    connectors.write_clustered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), str(tmp_path / "t"), ["k"], 4)
    spans = spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name().alias("f")).agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("a").collect()
    assert len(spans) == 4 and all(x.b < y.a for x, y in zip(spans, spans[1:]))


def test_titles():
    titles = ["", "a", "é" * 100, "x"]
    assert codecs.read_compact_titles(codecs.write_compact_titles(titles)) == titles and codecs.read_compact_titles(codecs.write_compact_titles([])) == []
    with pytest.raises(ValueError, match="255"):
        codecs.write_compact_titles(["é" * 200])
    assert codecs.indexed_titles([(1, "b"), (0, None)]) == ["", "b"]
    for rows in ([(0, "a"), (2, "c")], [(0, "a"), (0, "b")]):
        with pytest.raises(ValueError, match="gap"):
            codecs.indexed_titles(rows)


def test_collated_places(spark):
    df = spark.createDataFrame([(x,) for x in ["f", "é", "B", "c", "a"]], "t string")
    assert [r.t for r in src.numbered(df, F.collate("t", "UNICODE"), "k").orderBy("k").collect()] == ["a", "B", "c", "é", "f"]


def test_topic_rules(spark):
    rows = [("Ada", ["1815 births", "mathematics"], None), ("Web", ["founder", "website"], None), ("X", ["physics physics", "art"], None), ("Y", [], "Galaxy"), ("Z", ["art"], "thing"), (None, None, None), ("dot-com", ["towns"], None)]
    df = spark.createDataFrame(rows, "title string, cats array<string>, kind string")
    got = [r.t for r in df.select(topics.classify(F.col("title"), F.col("cats"), F.col("kind")).alias("t")).collect()]
    assert got == ["Biography & People", "Other & General", "Science & Technology", "Science & Technology", "Art & Culture", "Other & General", "Other & General"]
    assert [r.i for r in df.select(topics.topic_id(F.col("title"), F.col("cats"), topics.SHORT).alias("i")).collect()] == [0, 6, 1, 6, 3, 6, 5]
    assert df.select(maths.views_text(F.lit(1234)).alias("a"), maths.views_text(F.lit(2_500_000)).alias("b"), maths.views_text(F.lit(7)).alias("c")).first()[:] == ("1.2K", "2.5M", "7")


def test_progress_log(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    lines = []
    log = events.progress_log(spark, lines.append)
    q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    for _ in range(50):
        if any(x["event"] == "ended" for x in lines):
            break
        time.sleep(0.2)
    spark.streams.removeListener(log)
    assert {x["event"] for x in lines} == {"started", "batch", "ended"} and sum(x.get("rows", 0) for x in lines) == 5


def test_assets_that_do_not_fit(spark):
    import numpy as np

    zero = np.zeros(3)
    same = codecs.read_compact(codecs.write_compact(zero + 5, zero + 5, zero, zero))
    assert np.abs(same["x"] - 5).max() < 1e-3
    with pytest.raises(ValueError, match="no number"):
        codecs.write_compact(np.array([0.0, np.nan]), zero[:2], zero[:2], zero[:2])
    with pytest.raises(ValueError, match="without an end"):
        list(connectors.split_pages(["<page>" + "x" * 50, "y" * 60], most=100))
    assert list(connectors.split_pages(["x" * 500 + "<pa", "ge>a</page>" + "z" * 500, "<page>b</page>"], most=100)) == ["a", "b"]


def test_near_duplicate_pairs(spark):
    from linkloom.functions import text as t

    names = ["Rose", "roses", "Prose", "a", "Rosess", "garden of Roses", "rose garden", "rosa", "", "ss", "Ros"]
    df = spark.createDataFrame([(n, "x") for n in names] + [("rose", "y"), (None, "x"), ("Rose", "x")], "n string, g string")
    low = lambda a: a.lower()
    want = {(a, b) for a in names for b in names if a < b and (low(a) in low(b) or low(b) in low(a) or low(a).rstrip("s") == low(b).rstrip("s"))}
    assert {tuple(r) for r in t.near_duplicate_pairs(df, "n", ["g"]).collect()} == want


def test_classifier_on_rows_that_it_did_not_learn_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "text", "lang AS label").where("length(text) > 200")
    out = src.train_topic_classifier(docs, rounds=8, learn="id % 3 <> 0").where("id % 3 = 0").collect()
    assert sum(r.label == r.predicted for r in out) > 0.9 * len(out) and all(0.25 <= r.probability <= 1 for r in out)


def test_classifier_cuts_texts_into_words_once(spark, monkeypatch):
    written, real = [], g.reliable
    monkeypatch.setattr(g, "reliable", lambda df: written.append(df.columns) or real(df))
    docs = spark.createDataFrame([(i, ("red apple fruit", "steel iron metal")[i % 2], "fm"[i % 2]) for i in range(12)] + [(12, None, "f")], "id long, text string, label string")
    out = src.train_topic_classifier(docs, rounds=3, learn="id < 9")
    shown = out._jdf.queryExecution().executedPlan().toString()
    assert written == [["id", "label", "learnt", "x"]] and "text#" not in shown and "/graph-" in shown
    assert {(r.id, r.predicted) for r in out.collect()} == {(i, "fm"[i % 2]) for i in range(12)}
