"""The merge-on-read table: replays, crashes, compaction beside writers and readers, files that a look-up reads."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.sources import store
from linkloom.streaming import events

from .conftest import DATA, files_read

SCHEMA = "k long, seq long, v string"


@pytest.fixture(params=[100_000, 3])
def table(spark, tmp_path, request, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_ROWS", request.param)  # with few delta rows by broadcast, with many by an aggregate
    return store.MergedTable(spark, str(tmp_path / "t"), "k", "seq", buckets=4)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_wins(spark, table):
    draw, want = random.Random(5), {}
    for batch in range(6):
        data = [(draw.randrange(40), draw.randrange(100), f"{batch}.{i}") for i in range(30)]
        data = list({(k, s): (k, s, v) for k, s, v in data}.values())
        for k, s, v in data:
            if k not in want or s >= want[k][0]:
                want[k] = (s, v)
        table.upsert(spark.createDataFrame(data, SCHEMA))
        if batch in (1, 3):
            table.compact()
        assert rows(table.read()) == sorted((k, s, v) for k, (s, v) in want.items())
    assert rows(table.read(keys=[1, 7])) == sorted((k, *want[k]) for k in (1, 7) if k in want)


def test_replay_crash_and_conflict(spark, table, monkeypatch):
    one, two = spark.createDataFrame([(1, 1, "a")], SCHEMA), spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], SCHEMA)
    table.upsert(one, "s", 0)
    put = table._put

    def crash(manifest):
        raise OSError("down")

    monkeypatch.setattr(table, "_put", crash)
    with pytest.raises(OSError, match="down"):
        table.upsert(two, "s", 1)
    assert rows(table.read()) == [(1, 1, "a")]
    raced = []

    def race(manifest):  # another writer puts the version first, once
        if not raced:
            raced.append(put({**table.manifest(), "version": manifest["version"], "done": {"other": 9}}))
        put(manifest)

    monkeypatch.setattr(table, "_put", race)
    table.upsert(two, "s", 1)
    monkeypatch.setattr(table, "_put", put)
    table.upsert(spark.createDataFrame([(1, 9, "again")], SCHEMA), "s", 1)  # done before: nothing changes
    assert rows(table.read()) == [(1, 2, "b"), (2, 1, "c")] and table.manifest()["done"] == {"other": 9, "s": 1}
    with pytest.raises(Exception, match="null key"):
        table.upsert(spark.createDataFrame([(None, 1, "x")], SCHEMA))
    gone = table.vacuum(keep=1, orphans=True)
    assert gone and rows(table.read()) == [(1, 2, "b"), (2, 1, "c")]


def test_compaction_beside_others(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([(k, 1, "old") for k in range(8)], SCHEMA))
    table.upsert(spark.createDataFrame([(3, 2, "new")], SCHEMA))
    reader = table.read()  # planned before, run during and after
    write = table._write

    def beside(df, name):
        write(df, name)
        monkeypatch.setattr(table, "_write", write)
        assert (3, 2, "new") in rows(reader)
        table.upsert(spark.createDataFrame([(4, 2, "late"), (9, 1, "late")], SCHEMA))

    monkeypatch.setattr(table, "_write", beside)
    m = table.compact()
    assert m["base"] and len(m["deltas"]) == 1
    assert rows(table.read()) == sorted([(k, 1, "old") for k in range(8) if k not in (3, 4)] + [(3, 2, "new"), (4, 2, "late"), (9, 1, "late")])
    assert len(rows(reader)) == 8
    table.vacuum(keep=1)
    assert len(rows(table.read())) == 9


def test_empty_and_pruned(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    table.upsert(spark.createDataFrame([], SCHEMA))
    assert rows(table.read()) == []
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("seq"), F.lit("x").alias("v")))
    table.compact()
    found = table.read(keys=[17])
    assert rows(found) == [(17, 1, "x")]
    every = files_read(table.read())
    assert files_read(table.read(keys=[17])) == 1 < every


def test_stream_with_restart(spark, tmp_path):
    src = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    table = store.MergedTable(spark, str(tmp_path / "t"), "user_id", "event_id", buckets=4)
    sink, failed = table.sink("events"), []

    def once_down(batch, n):
        sink(batch, n)
        if n == 1 and not failed:  # after the manifest, before the stream's own log: the batch is run again
            failed.append(n)
            raise OSError("down")

    for _ in range(2):
        q = events.read_events(spark, str(tmp_path / "in"), 1).writeStream.foreachBatch(once_down).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            assert failed
    assert table.manifest()["done"] == {"events": 3} and len(table.manifest()["deltas"]) == 4
    got = {r.user_id: r.event_id for r in table.read().collect()}
    assert got == {r.user_id: r.e for r in src.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}
