"""Eviction over a stream equals eviction over the table, row by row, also after a restart and out of order."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.streaming import events, queue

from .conftest import DATA


def test_staircase_against_plain():
    draw = random.Random(2)
    for _ in range(200):
        span = draw.choice([3, 10])
        held = {i: [draw.randrange(20), draw.choice(["a", "b", None]), draw.choice([None, *map(float, range(5))]), False] for i in range(draw.randrange(15))}
        want = {i for i, (t, g, v, _) in held.items() if any(t < u <= t + span and (h == g or (v is not None and w is not None and w > v)) for u, h, w, _ in held.values())}
        assert set(queue.Queue(span).evicted(held)) == want


def test_stream_equals_table(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    src = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = src.withColumn("user_id", F.col("user_id") % 3)
    last = src.agg(F.max("ts")).first()[0]
    # neighbours in time change places, and a request far in the future closes the watermark
    parts = src.withColumn("part", F.ntile(4).over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy("ts")))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), (F.lit(last) + F.expr("interval 10 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    for k in range(4):
        parts.where(F.col("part") == k + 1).drop("part").orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        def run():
            stream = queue.streamed_evictions(events.read_events(spark, str(tmp_path / "in"), 1), "1 hour", "400 days")
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()

        run()
        end.withColumn("ts", F.col("ts") + F.expr("interval 1000 days")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()  # restarted from its checkpoint: the state and timers are still there
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.event_id, r.evicted) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.event_id >= 0)
    assert got == sorted((r.event_id, r.evicted) for r in events.evictions(src).collect())
