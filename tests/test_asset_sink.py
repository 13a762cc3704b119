"""The binary sink: bytes of the plain writers, whatever the partitions; gaps, failed attempts, older files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.sources import asset_sink, codecs


def graph(spark, n=500, seed=2):
    draw = np.random.default_rng(seed)
    nbrs = [sorted(set(draw.integers(0, n, draw.integers(0, 9)).tolist())) for _ in range(n)]
    rows = [(k, f"Title é {k}" if k % 7 else "", float(draw.normal()), float(draw.normal()), nbrs[k]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "idx long, title string, x double, y double, nbrs array<bigint>")


@pytest.mark.parametrize("parts", [1, 7])
def test_bytes_of_the_plain_writers(spark, tmp_path, parts):
    rows, df = graph(spark)
    df = df.repartition(5)
    for kind, cols in (("adjacency", ["idx", "nbrs"]), ("layout", ["idx", "x", "y"]), ("titles", ["idx", "title"]), ("blobs", ["idx", "title"])):
        asset_sink.write_asset(df.select(*cols), kind, str(tmp_path / kind), parts)
    read = lambda name: (tmp_path / name).read_bytes()
    assert read("adjacency") == codecs.write_adjacency(np.array([len(r[4]) for r in rows]), np.array([t for r in rows for t in r[4]]))
    assert read("layout") == codecs.write_layout([np.array([r[2] for r in rows]), np.array([r[3] for r in rows])])
    assert read("titles") == codecs.write_titles([r[1] for r in rows])
    assert read("blobs") == "".join(r[1] for r in rows).encode()
    assert sorted(os.listdir(tmp_path)) == ["adjacency", "blobs", "layout", "titles"]
    got = asset_sink.read_adjacency_rows(spark, str(tmp_path / "adjacency"), 64)
    assert sorted((r.idx, r.nbrs) for r in got.collect()) == [(r[0], r[4]) for r in rows]


def test_whole_graph(spark, tmp_path):
    nodes = spark.createDataFrame([(k, f"t{k}", 0.0, 1.0) for k in range(4)], "idx long, title string, x double, y double")
    links = spark.createDataFrame([(0, 1), (0, 3), (0, 1), (2, 0)], "src long, tgt long")
    asset_sink.write_graph(nodes, links, str(tmp_path))
    near = codecs.read_adjacency((tmp_path / "adjacency.bin").read_bytes())
    assert [near(k).tolist() for k in range(4)] == [[1, 3], [], [0], []]
    assert codecs.read_titles((tmp_path / "titles.bin").read_bytes()) == ["t0", "t1", "t2", "t3"]


@pytest.mark.parametrize("bad", ["idx <> 250", "idx <> 0", "idx < 500 or idx = 600"])
def test_a_gap_is_an_error_and_the_older_file_stays(spark, tmp_path, bad):
    _, df = graph(spark, 500)
    df = df.unionByName(df.where("idx = 7").withColumn("idx", F.lit(600).cast("long")))
    (tmp_path / "a").write_bytes(b"older")
    with pytest.raises(Exception, match="gap or repeat"):
        asset_sink.write_asset(df.select("idx", "nbrs").where(bad), "adjacency", str(tmp_path / "a"), 4)
    with pytest.raises(Exception, match="gap or repeat"):
        asset_sink.write_asset(df.where("idx < 9").unionByName(df.where("idx = 8")).select("idx", "nbrs"), "adjacency", str(tmp_path / "a"), 4)
    assert os.listdir(tmp_path) == ["a"] and (tmp_path / "a").read_bytes() == b"older"


def test_only_reported_attempts_count(tmp_path):
    import pyarrow as pa

    class Schema:
        fields = (1, 2)

    w = asset_sink.AssetWriter({"path": str(tmp_path / "t"), "asset": "titles"}, Schema)
    batch = lambda ids: pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f"n{i}" for i in ids])], ["idx", "title"])
    w.write(iter([batch([0, 1])]))  # an attempt that was lost, or ran twice
    kept = [w.write(iter([batch([2, 3])])), w.write(iter([])), w.write(iter([batch([0]), batch([1])])), None]
    w.commit(kept)
    assert codecs.read_titles((tmp_path / "t").read_bytes()) == ["n0", "n1", "n2", "n3"] and os.listdir(tmp_path) == ["t"]
    w.write(iter([batch([0])]))
    w.abort([])
    assert os.listdir(tmp_path) == ["t"]


def test_limits(spark, tmp_path):
    df = spark.createDataFrame([(0, [-1])], "idx long, nbrs array<bigint>")
    with pytest.raises(Exception, match="32 bits"):
        asset_sink.write_asset(df, "adjacency", str(tmp_path / "a"))
    with pytest.raises(Exception, match="asset is one of"):
        asset_sink.write_asset(df, "what", str(tmp_path / "a"))
    asset_sink.write_asset(df.limit(0), "adjacency", str(tmp_path / "none"))
    assert (tmp_path / "none").read_bytes() == codecs.write_adjacency(np.zeros(0, int), np.zeros(0, int))
