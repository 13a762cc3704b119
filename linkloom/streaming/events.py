"""Streams: the crawl frontier, request eviction, event ingest and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def crawl_step(frontier: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """What a step of the crawl discovers: targets of the frontier (idx) that are not known yet."""
    out = links.join(frontier.select(F.col("idx").alias("src")), "src", "left_semi").select(F.col("tgt").alias("idx")).distinct()
    return out.join(known.select("idx"), "idx", "left_anti")


def crawl(spark: SparkSession, fetch: Callable[[DataFrame], DataFrame], seeds: DataFrame, store: Callable[[DataFrame], None], rounds: int, at_a_time: int = 20) -> int:
    """fetch: (title) to (title, links); store takes each batch. Frontier by order of discovery; returns the rounds."""
    from linkloom.operators.graph import reliable

    known = reliable(seeds.select("title").distinct().withColumn("round", F.lit(0)))
    done = known.limit(0).select("title")
    for r in range(1, rounds + 1):
        batch = reliable(known.join(done, "title", "left_anti").orderBy("round", "title").limit(at_a_time).select("title"))
        if batch.isEmpty():
            return r - 1
        got = reliable(fetch(batch))
        store(got)
        done = reliable(done.union(batch))
        new = got.select(F.explode("links").alias("title")).distinct().join(known, "title", "left_anti").withColumn("round", F.lit(r))
        known = reliable(known.unionByName(new))
    return rounds


#: Microseconds of a unit of time.
UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def micros_of(span: str) -> int:
    """Microseconds of a span such as '90 seconds' or '1 hour'."""
    n, unit = span.split()
    return int(n) * UNITS[unit.rstrip("s")]


def evictions(requests: DataFrame, within: str = "1 hour") -> DataFrame:
    """requests: (event_id, ts, user_id, event_type, value). A request is evicted if in the time `within` after it its user
    makes another of the same type, or one of higher value. Windows over a user's time line, no self-join."""
    from pyspark.sql.window import Window

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = micros_of(within)
    later = Window.partitionBy("user_id").orderBy("_t").rangeBetween(1, span)
    same = Window.partitionBy("user_id", "event_type").orderBy("_t").rangeBetween(1, span)
    out = requests.withColumn("_t", micros)
    return out.select("event_id", ((F.count("event_id").over(same) > 0) | F.coalesce(F.max("value").over(later) > F.col("value"), F.lit(False))).alias("evicted"))


def latency_stats(requests: DataFrame, log: int = 500) -> tuple[DataFrame, DataFrame]:
    """requests: (event_id, ts, user_id, event_type, value), the type being the priority and value the time taken. By
    priority: how many, how many evicted, and total, greatest and median time of the others; and the last `log` of all."""
    from linkloom.operators.quantiles import with_quantile

    gone = evictions(requests)
    kept = F.when(~F.col("evicted"), F.col("value"))
    by = requests.join(gone, "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("evicted").alias("evicted"), F.sum(kept).alias("total"), F.max(kept).alias("most"))
    by = with_quantile(by, requests.join(gone, "event_id").select("event_type", kept.alias("kept")), ["event_type"], "kept", 0.5, "mid")
    return by, requests.orderBy(F.desc("ts"), F.desc("event_id")).limit(log)


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


def read_events(spark: SparkSession, path: str, files_at_a_time: int = 10) -> DataFrame:
    """A stream of the event files in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_a_time).parquet(path)


def windowed(events: DataFrame, window: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts and sums by window and type; windows close once the watermark has passed."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_of_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_sink(path: str, key: str, seq: str, stream: str = "events", compact_every: int = 50) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch becomes a delta of a merge-on-read table (sources.store), its rows the last of each
    key; a batch that is run again changes nothing. From time to time the deltas are merged into the base."""
    from linkloom.sources.store import MergedTable

    def put(batch: DataFrame, batch_id: int) -> None:
        table = MergedTable(batch.sparkSession, path, key, seq)
        if len(table.upsert(batch, stream, batch_id)["deltas"]) >= compact_every:
            table.compact()
            table.vacuum()

    return put


def progress_log(spark: SparkSession, write: Callable[[dict], None]):
    """A listener that hands on a line of figures for each batch of every stream, and for its start and end; returns it,
    for spark.streams.removeListener."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Log(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            write({"event": "started", "id": str(event.id), "name": event.name})

        def onQueryProgress(self, event) -> None:
            p = event.progress
            write({"event": "batch", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "ms": p.batchDuration})

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            write({"event": "ended", "id": str(event.id), "error": event.exception})

    log = Log()
    spark.streams.addListener(log)
    return log
