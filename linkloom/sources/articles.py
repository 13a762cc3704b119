"""Sources and sinks of the article pipeline: dumps, page views, HTML, binary assets, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import maths, text
from linkloom.operators import graph as g

DUMP_SCHEMA = "title string, ns string, revision struct<text: string>"
ARTICLES = "title string, snippet string, views bigint, categories array<string>, links array<string>, link_contexts map<string,string>, wikidata_id string, wikidata_type string, crawled int, last_updated timestamp"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Articles of an XML dump (plain, gzip or bzip2): title and text of main-namespace pages that are no redirects."""
    return main_articles(spark.read.format("xml").option("rowTag", "page").schema(DUMP_SCHEMA).load(path), F.col("revision.text"))


def main_articles(pages: DataFrame, body: Column) -> DataFrame:
    """pages: (title, ns, ...). Title and text of main-namespace pages that are no redirects."""
    return pages.where((F.col("ns") == "0") & (F.col("title") != "") & (body != "") & ~text.is_redirect(body)).select("title", body.alias("text"))


def parsed_articles(pages: DataFrame) -> DataFrame:
    clean = text.clean_wikitext(F.col("text"))
    return pages.select("title", text.snippet(clean).alias("snippet"), text.categories_of(F.col("text")).alias("categories"), text.link_targets(F.col("text")).alias("links"))


def page_head(pages: DataFrame) -> DataFrame:
    """pages: (page_id, html). Title and heading as they stand there, without character references; empty if missing."""
    inner = lambda tag: text.unescape_xml(F.regexp_extract("html", rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    return pages.select("page_id", inner("title").alias("title"), inner("h1").alias("h1"))


def not_yet(pages: DataFrame, stored: DataFrame, key: str = "title") -> DataFrame:
    """What a resumed run still has to read."""
    return pages.join(stored.select(key), key, "left_anti")


def pageviews(lines: DataFrame, how: str = "max") -> DataFrame:
    """lines: (value) of 'project title count ...'. Titles of the English project with their greatest count ('max'), or
    of both its names with their sum ('sum'); counts that are no number are left out."""
    w = F.split("value", r"\s+")
    rows = lines.select(w[0].alias("project"), F.replace(w[1], F.lit("_"), F.lit(" ")).alias("title"), F.expr("try_cast(split(value, '\\\\s+')[2] as bigint)").alias("n")).where("n is not null")
    rows = rows.where(F.col("project").isin(*(["en"] if how == "max" else ["en", "en.wikipedia"])))
    return rows.groupBy("title").agg((F.max if how == "max" else F.sum)("n").alias("views"))


def read_pageviews(spark: SparkSession, path: str, how: str = "max") -> DataFrame:
    return pageviews(spark.read.text(path), how)


def read_weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """A (compressed) CSV of source, target, weight; compressed files are one task each, so rows are dealt out after, by
    both ends, so that a hub's links are not one task's."""
    return spark.read.csv(path, header=True, schema="source int, target int, weight float").repartition("source", "target")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="id int, views bigint, category_id int").orderBy("id")


def type_labels(rows: DataFrame, types: DataFrame, labels: DataFrame) -> DataFrame:
    """rows: (id, key), types: (key, type), labels: (type, label): each id's label, 'Other' where a step finds none."""
    return rows.join(types, "key", "left").join(labels, "type", "left").select("id", F.coalesce("label", F.lit("Other")).alias("label"))


def fetched(urls: DataFrame, fetch, retries: int = 5, wait=None) -> DataFrame:
    """urls: (url). Bodies by a fetcher given by the caller (url -> status, body), with exponential waits on 429."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for b in batches:
            out = []
            for u in b.column("url").to_pylist():
                status, body = 0, None
                for k in range(retries):
                    status, body = fetch(u)
                    if status != 429:
                        break
                    (wait or time.sleep)(10 * 2**k)
                out.append((u, status, body))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], ["url", "status", "body"])

    return urls.select("url").mapInArrow(run, "url string, status int, body string")


def first_that_reads(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """The first of the paths that exists, by Spark's own file systems."""
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
            return spark.read.format(fmt).load(p)
    raise FileNotFoundError(", ".join(paths))


def synthetic_links(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Random links by hashes of node and place: 5 to 50 a node, targets by a power law, no self-links."""
    base = spark.range(1, n + 1).select(F.col("id").alias("src"), (5 + F.floor(maths.unit_hash(F.col("id"), seed) * 46)).cast("int").alias("k"))
    rows = base.select("src", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i"))
    drawn = maths.unit_hash(F.col("src") * 64 + F.col("i"), seed + 1)
    return rows.withColumn("tgt", F.floor(drawn * drawn * drawn * n).cast("long") + 1).where("src <> tgt").select("src", "tgt")


# ---- sinks


def upsert(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key; a partial aggregate, so a key with many rows is no hot key."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def insert_ignore(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return base.unionByName(new.dropDuplicates([key]).join(base.select(key), key, "left_anti"))


def update_views(base: DataFrame, new: DataFrame) -> DataFrame:
    """New views where they are positive; else the old."""
    v = new.select("title", F.col("views").alias("_v"))
    return base.join(v, "title", "left").withColumn("views", F.when(F.col("_v") > 0, F.col("_v")).otherwise(F.col("views"))).select(*base.columns)


def filled_metadata(spark: SparkSession, n: int, meta: DataFrame) -> DataFrame:
    return spark.range(n).join(meta, "id", "left").select("id", F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("category", F.lit(6)).alias("category"))


def weighted_lines(edges: DataFrame) -> DataFrame:
    """(source, target, weight) with the weight as text of three places."""
    return edges.select("source", "target", F.format_string("%.3f", F.bround("weight", 3)).alias("weight"))


def write_weighted_edges(edges: DataFrame, path: str) -> None:
    weighted_lines(edges).write.csv(path, header=True, compression="gzip")


def sized_json(words: DataFrame, most_bytes: int, few: int) -> DataFrame:
    """(topic, json): the distinct words of a topic; where all together are too large, the first few of each."""
    lists = words.groupBy("topic").agg(F.array_sort(F.collect_set("word")).alias("words"))
    total = lists.agg(F.sum(F.octet_length(F.to_json("words"))).alias("bytes"))
    return lists.crossJoin(F.broadcast(total)).select("topic", F.to_json(F.when(F.col("bytes") > most_bytes, F.slice("words", 1, few)).otherwise(F.col("words"))).alias("json"))


def resolve_title(nodes: DataFrame, title: str) -> DataFrame:
    """The node of exactly this title, else the first that differs in case only."""
    return nodes.where(F.lower("title") == title.lower()).orderBy((F.col("title") != title).cast("int"), "idx").limit(1).select("idx")


def numbered(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """rows with their place by an order, from 0, as a new column: sorted by ranges, one row a range through the only
    global window. Rows of equal order come in any order."""
    parts = g.reliable(rows.withColumn("_order", order).repartitionByRange("_order").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    placed = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy("_order"))).join(F.broadcast(base), "_part")
    return placed.select(*rows.columns, (F.col("_base") + F.col("_k") - 1).cast("long").alias(name))


def resolve_marked(marked: DataFrame) -> DataFrame:
    """marked: (title, text). Links between known titles as (src, tgt) by dense place among titles."""
    raw = marked.select(F.col("title").alias("source"), F.explode(text.link_targets(F.col("text"), ())).alias("target")).distinct()
    known = raw.select(F.col("source").alias("title")).union(raw.where(F.length("target") > 3).select("target")).distinct()
    return g.resolved(raw, numbered(known, F.col("title"), "idx"))


def train_topic_classifier(rows: DataFrame, features: int = 4096, rounds: int = 20, learn: str = "true") -> DataFrame:
    """rows: (id, text, label). Words and word pairs hashed into counts, logistic regression over the rows for which learn
    (SQL) is true; (id, label, predicted, probability) of all, the probability being that of what is predicted."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.feature import HashingTF, IndexToString, NGram, SQLTransformer, StringIndexer, Tokenizer

    hashed = Pipeline(stages=[
        Tokenizer(inputCol="text", outputCol="words"), NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
        HashingTF(numFeatures=features, inputCol="grams", outputCol="x"),
    ])
    texts = rows.where("text is not null").withColumn("learnt", F.expr(learn))
    counted = g.reliable(hashed.fit(texts).transform(texts).select("id", "label", "learnt", "x"))  # texts are cut into words once
    stages = [StringIndexer(inputCol="label", outputCol="y", handleInvalid="skip"), LogisticRegression(featuresCol="x", labelCol="y", maxIter=rounds, regParam=0.01)]
    model = Pipeline(stages=stages).fit(counted.where("learnt"))
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=model.stages[0].labels)
    return back.transform(model.transform(counted)).select("id", "label", "predicted", F.array_max(vector_to_array("probability")).alias("probability"))
