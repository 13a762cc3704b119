"""A table with a key that is upserted batch by batch without being rewritten: merge on read.

A version of the table is a small manifest that names a base and the deltas after it, all of them Parquet folders. An
upsert writes its rows, the last of each key, as one more delta and then the next manifest; nothing else is touched. A
manifest comes to be by a rename that fails where the name is taken, so of two writers one goes on from the other's
version, a crash before it leaves a folder that no version names, and readers see whole versions only. Reading puts the
last row of each key on top of the base: with few delta rows by broadcast, without an exchange of the base. Compaction
writes that as a new base, and `vacuum` takes away what no kept version names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.graph import BROADCAST_ROWS
from linkloom.sources.articles import upsert

#: Tries to put a manifest where other writers do so too.
MOST_TRIES = 100


class Conflict(RuntimeError):
    """Another writer took the version."""


class MergedTable:
    """A table in a folder; rows of one `key` are ordered by `seq`, of equal ones the later upsert's row counts."""

    def __init__(self, spark: SparkSession, path: str, key: str, seq: str, buckets: int = 32):
        self.spark, self.path, self.key, self.seq, self.buckets = spark, path.rstrip("/"), key, seq, buckets
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ---- files and versions

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self.conf)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(x.getPath().getName() for x in self._fs().listStatus(at)) if self._fs().exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """What a version, or the last one, is made of."""
        if version is None:
            have = self.versions()
            if not have:
                return {"version": 0, "base": None, "deltas": [], "done": {}, "schema": None}
            version = have[-1]
        stream = self._fs().open(self._at(f"versions/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        """The next version; Conflict if it is there already."""
        fs, name = self._fs(), f"versions/{manifest['version']:012d}.json"
        temp = self._at(f"versions/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(self._at(name)) or not self._renamed(temp, self._at(name)):
            fs.delete(temp, False)
            raise Conflict(name)

    def _renamed(self, temp, to) -> bool:
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.conf).rename(temp, to, none)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def _next(self, change: Callable[[dict], dict | None]) -> dict:
        """The last version changed and put, again from the newer one where another writer was faster. change gives None
        where nothing is left to do."""
        for _ in range(MOST_TRIES):
            now = self.manifest()
            new = change(now)
            if new is None:
                return now
            try:
                self._put(new | {"version": now["version"] + 1})
                return new | {"version": now["version"] + 1}
            except Conflict:
                continue
        raise Conflict(f"{MOST_TRIES} versions were taken by others")

    # ---- writing

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, name: str) -> None:
        """Rows in folders by the hash of their key, dealt out by it, so that a look-up of a key reads one of them."""
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket", self.key).write.mode("errorifexists").partitionBy("_bucket").parquet(f"{self.path}/{name}")

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> dict:
        """The last row of each key becomes part of the table. A batch of a stream that is done already, because it is
        run again after a restart, changes nothing. Rows with a null key are an error, as they could not be found."""
        def is_done(m: dict) -> bool:
            return stream is not None and m["done"].get(stream, -1) >= batch

        if is_done(now := self.manifest()):
            return now
        last = upsert(rows.withColumn("_seq", F.col(self.seq)), self.key, "_seq").drop("_seq").select(*rows.columns)
        name = f"delta-{uuid.uuid4().hex}"
        self._write(last.withColumn(self.key, F.when(F.col(self.key).isNull(), F.raise_error(F.lit("null key"))).otherwise(F.col(self.key))), name)
        n = self.spark.read.parquet(f"{self.path}/{name}").count() if self._has_rows(name) else 0

        def change(m: dict) -> dict | None:
            if is_done(m):
                return None
            done = m["done"] if stream is None else m["done"] | {stream: batch}
            deltas = m["deltas"] + ([{"name": name, "rows": n, "at": m["version"] + 1}] if n else [])
            return m | {"deltas": deltas, "done": done, "schema": m["schema"] or rows.schema.json()}

        return self._next(change)

    def _has_rows(self, name: str) -> bool:
        return any(n.startswith("_bucket=") for n in self._names(name))

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each batch one upsert, once."""
        return lambda rows, batch: self.upsert(rows, stream, batch) and None

    # ---- reading

    def _part(self, names: list[str], schema) -> DataFrame:
        from pyspark.sql.types import IntegerType, StructType

        paths = [f"{self.path}/{n}" for n in names]
        wide = StructType(list(schema.fields)).add("_bucket", IntegerType())
        if not paths:
            return self.spark.createDataFrame([], wide)
        reads = [self.spark.read.schema(wide).option("basePath", p).parquet(p) for p in paths]
        out = reads[0]
        for r in reads[1:]:
            out = out.unionByName(r)
        return out

    def read(self, version: int | None = None, keys: list | None = None) -> DataFrame:
        """The table at a version, or the last one; keys: only their rows, from their buckets' files alone."""
        from pyspark.sql.types import StructType

        m = self.manifest(version)
        if m["schema"] is None:
            raise FileNotFoundError(f"no table in {self.path}")
        schema = StructType.fromJson(json.loads(m["schema"]))
        kind, cols = schema[self.key].dataType, schema.names
        base = self._part([m["base"]] if m["base"] else [], schema)
        delta = None
        for d in m["deltas"]:
            one = self._part([d["name"]], schema).withColumn("_at", F.lit(d["at"]))
            delta = one if delta is None else delta.unionByName(one)
        if keys is not None:
            wanted = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[F.lit(k).cast(kind) for k in keys])).alias(self.key)).select(self._bucket()).distinct().collect()]
            within = lambda df: df.where(F.col("_bucket").isin(wanted) & F.col(self.key).isin(keys))
            base, delta = within(base), delta if delta is None else within(delta)
        if delta is None:
            return base.select(*cols)
        order = F.struct(F.col(self.seq), F.col("_at"))
        rest = [c for c in cols if c != self.key]
        latest = lambda df: df.groupBy(self.key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(self.key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*cols)
        if not m["base"]:
            return latest(delta)
        if sum(d["rows"] for d in m["deltas"]) > BROADCAST_ROWS:
            return latest(base.withColumn("_at", F.lit(0)).unionByName(delta))
        top = latest(delta)
        mark = F.broadcast(top.select(F.col(self.key).alias("_k"), F.col(self.seq).alias("_s")))
        met = F.col(self.key) == F.col("_k")
        # a base row stays where no delta has its key or only older rows; then the delta's row goes
        newer = F.coalesce(F.col(self.seq) > F.col("_s"), F.col(self.seq).isNotNull() & F.col("_s").isNull())
        under = base.join(mark, met, "left").where(F.col("_k").isNull() | newer).select(*cols)
        beaten = base.join(mark, met).where(newer).select(F.col(self.key))
        return under.unionByName(top.join(F.broadcast(beaten), self.key, "left_anti").select(*cols))

    # ---- upkeep

    def compact(self) -> dict:
        """The last version's rows as a new base. Upserts that come meanwhile stay deltas on top of it."""
        seen = self.manifest()
        if seen["schema"] is None or not seen["deltas"]:
            return seen
        name = f"base-{uuid.uuid4().hex}"
        self._write(self.read(seen["version"]), name)
        gone = {d["name"] for d in seen["deltas"]}

        def change(m: dict) -> dict | None:
            if m["base"] != seen["base"]:
                return None  # another compaction was faster
            return m | {"base": name, "deltas": [d for d in m["deltas"] if d["name"] not in gone]}

        return self._next(change)

    def vacuum(self, keep: int = 2, orphans: bool = False) -> list[str]:
        """Takes away versions but the last `keep` and the folders that only they name; returns those. orphans: also
        folders that no version ever named, which crashed writers leave - and running ones have for a while."""
        have = self.versions()
        kept, old = have[-keep:], have[:-keep]
        named = lambda vs: {n for v in vs for m in [self.manifest(v)] for n in [m["base"], *[d["name"] for d in m["deltas"]]] if n}
        live, dead = named(kept), named(old)
        gone = [n for n in self._names("") if n.startswith(("base-", "delta-")) and n not in live and (orphans or n in dead)]
        for n in gone:
            self._fs().delete(self._at(n), True)
        for v in old:
            self._fs().delete(self._at(f"versions/{v:012d}.json"), False)
        return gone
