"""The driver's tables as a link graph: parts are nodes, consecutive lines of an order are links."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import maths

_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of the longest table for which a query gets one more partition of its shuffles, bytes that Spark may join
#: partitions up to again, and bytes of a file that a task reads: it sorts them all in memory for over 200 partitions.
ROWS_A_PARTITION, JOINED_BYTES, SCANNED_BYTES = 500_000, 16 << 20, 16 << 20


@functools.cache
def _rows(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "lineitem").count()


def roomy(spark: SparkSession, sf_dir: str) -> None:
    """Session settings by the size of the tables: a task's share of a shuffle stays as large as it is when they grow."""
    n, size = -(-_rows(spark, sf_dir) // ROWS_A_PARTITION), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    scan = "spark.sql.files.maxPartitionBytes"
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
    if spark.conf.get(size) in ("64MB", f"{64 << 20}b"):  # as Spark sets it
        spark.conf.set(size, f"{JOINED_BYTES}b")
    if spark.conf.get(scan) in ("128MB", f"{128 << 20}b"):
        spark.conf.set(scan, f"{SCANNED_BYTES}b")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, tgt of every traversal, repeats kept."""
    roomy(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", *_KEY)
    by = Window.partitionBy("l_orderkey").orderBy(*_KEY)
    return line.select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(by).alias("tgt")).where("tgt is not null")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, tgt, cnt, first_order; no self-loops."""
    return pairs(spark, sf_dir).where("src <> tgt").groupBy("src", "tgt").agg(F.count("*").alias("cnt"), F.min("l_orderkey").alias("first_order"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges with context (null, empty or text) and pos, the place among a node's links from 0."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("first_order"), "o_orderpriority")
    rest = F.col("first_order") % 10
    context = F.when(rest == 1, "").when(rest != 0, F.concat("o_orderpriority", F.lit(" order "), F.col("first_order")))
    pos = F.row_number().over(Window.partitionBy("src").orderBy("first_order", "tgt")) - 1
    return edges(spark, sf_dir).join(o, "first_order").select("src", "tgt", "cnt", "first_order", context.alias("context"), pos.cast("long").alias("pos"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, title, category (0..5), views, x, y (golden spiral)."""
    part = table(spark, sf_dir, "part")
    kinds = part.select("p_type").distinct().withColumn("category", (F.row_number().over(Window.orderBy("p_type")) - 1).cast("long"))
    views = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("views"))
    x, y = maths.spiral(F.col("idx"), exact=True)
    base = part.join(F.broadcast(kinds), "p_type").join(views, "p_partkey", "left")
    base = base.select(F.col("p_partkey").alias("idx"), F.concat("p_name", F.lit(" #"), "p_partkey").alias("title"), "category", F.coalesce("views", F.lit(0)).cast("long").alias("views"))
    return base.withColumns({"x": F.round(x, 4), "y": F.round(y, 4)})


#: The same in DuckDB's SQL, as the head of a query.
PAIRS_SQL = f"""pairs AS (SELECT l_orderkey, src, tgt FROM (SELECT l_orderkey, l_partkey AS src,
 lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_KEY)}) AS tgt FROM lineitem) WHERE tgt IS NOT NULL)"""
EDGES_SQL = PAIRS_SQL + """, edges AS (SELECT src, tgt, count(*) AS cnt, min(l_orderkey) AS first_order FROM pairs WHERE src <> tgt GROUP BY 1, 2)"""
LINKS_SQL = EDGES_SQL + """, links AS (SELECT src, tgt, cnt, first_order, CASE first_order % 10 WHEN 1 THEN '' WHEN 0 THEN NULL ELSE o_orderpriority || ' order ' || first_order END AS context,
 row_number() OVER (PARTITION BY src ORDER BY first_order, tgt) - 1 AS pos FROM edges JOIN orders ON o_orderkey = first_order)"""
NODES_SQL = """nodes AS (SELECT p_partkey AS idx, p_name || ' #' || p_partkey AS title, dense_rank() OVER (ORDER BY p_type) - 1 AS category, coalesce(v.views, 0) AS views,
 round(5.0 * sqrt(p_partkey) * cos(p_partkey * 2.399963229728653), 4) AS x, round(5.0 * sqrt(p_partkey) * sin(p_partkey * 2.399963229728653), 4) AS y
 FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS views FROM lineitem GROUP BY 1) v ON v.l_partkey = p_partkey)"""
GRAPH_SQL = LINKS_SQL + ", " + NODES_SQL
DEGREES_SQL = """deg AS (SELECT idx, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree FROM nodes
 LEFT JOIN (SELECT tgt, count(*) AS n FROM edges GROUP BY 1) i ON i.tgt = idx LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON o.src = idx)"""


def with_graph(sql: str) -> str:
    return f"WITH {GRAPH_SQL}, {DEGREES_SQL}, {sql}" if sql.lstrip().lower().startswith("q_") else f"WITH {GRAPH_SQL}, {DEGREES_SQL} {sql}"


def sql_unit(v: str, salt: int) -> str:
    """maths.unit_hash in SQL."""
    h = f"(({v} * 1103515245 + {12345 + salt * 97531}) & 2147483647)"
    h = f"((xor({h}, {h} >> 15) * 1103515245 + 12345) & 2147483647)"
    return f"((((xor({h}, {h} >> 13) * 69069 + 1) & 2147483647) + 0.5) / 2147483648.0::DOUBLE)"


def sql_normal(v: str, salt: int) -> str:
    """maths.normal_hash in SQL."""
    return f"(sqrt(-2 * ln({sql_unit(v, salt)})) * cos(2 * pi() * {sql_unit(v, salt + 1)}))"
