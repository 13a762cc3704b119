"""Queries of filters, joins, aggregations, orderings and graph operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import maths
from linkloom.operators import graph as g
from linkloom.operators import layout, projection, quantiles, search, spatial
from linkloom.sources import asset_sink

from .fixtures import DEGREES_SQL, GRAPH_SQL, edges, links, nodes, pairs, sql_unit, table

Q, SQL = {}, {}
HEAD = f"WITH RECURSIVE {GRAPH_SQL}, {DEGREES_SQL}"


def query(name: str, sql: str | None = None, head: bool = True):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = f"{HEAD}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if head else sql
        return f

    return put


def N(s, d):
    return nodes(s, d)


def E(s, d):
    return edges(s, d)


def D(s, d):
    return g.degrees(nodes(s, d), edges(s, d))


def ids(s, *v):
    return s.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in v])).alias("idx"))


# ---- scans, filters
query("s1_edge_scan", "SELECT src, tgt FROM links")(lambda s, d: links(s, d).select("src", "tgt"))
query("s16_neighbours_of", "SELECT DISTINCT tgt AS nbr FROM edges WHERE src = 7")(lambda s, d: E(s, d).where("src = 7").select(F.col("tgt").alias("nbr")).distinct())
query("s17_top_links", "SELECT src, tgt, cnt FROM links ORDER BY cnt DESC, src, tgt LIMIT 100")(lambda s, d: links(s, d).orderBy(F.desc("cnt"), "src", "tgt").limit(100).select("src", "tgt", "cnt"))
query("f1_title_lookup", "SELECT idx, title, category, views FROM nodes WHERE title = (SELECT title FROM nodes WHERE idx = 42)")(
    lambda s, d: N(s, d).join(g.small(N(s, d).where("idx = 42").select("title"), 1), "title", "left_semi").select("idx", "title", "category", "views"))
query("f2_rowid_lookup", "SELECT idx, title, views FROM nodes WHERE idx = 17")(lambda s, d: N(s, d).where("idx = 17").select("idx", "title", "views"))
query("f3_in_list", "SELECT idx, title, category FROM nodes WHERE idx IN (SELECT tgt FROM edges WHERE src = 7)")(
    lambda s, d: N(s, d).join(E(s, d).where("src = 7").select(F.col("tgt").alias("idx")), "idx", "left_semi").select("idx", "title", "category"))
query("f4_context_present", "SELECT src, tgt, context FROM links WHERE context IS NOT NULL AND context <> ''")(lambda s, d: links(s, d).where("context is not null and context <> ''").select("src", "tgt", "context"))
query("f5_range_mask", "SELECT src, tgt, count(*) AS n FROM pairs WHERE src <> tgt AND src < (SELECT count(*) FROM part) AND tgt < (SELECT count(*) FROM part) GROUP BY 1, 2")(
    lambda s, d: (lambda n: pairs(s, d).where((F.col("src") != F.col("tgt")) & (F.col("src") < n) & (F.col("tgt") < n)).groupBy("src", "tgt").agg(F.count("*").alias("n")))(N(s, d).count()))
query("f6_viewport", "SELECT n.idx, n.title, n.views FROM nodes n JOIN deg USING (idx) WHERE x BETWEEN -100 AND 100 AND y BETWEEN -80 AND 80 AND views >= 10 AND in_degree >= 2 AND lower(title) LIKE '%a%'")(
    lambda s, d: spatial.viewport(D(s, d), (-80, -60, 80, 60), 20.0, 10, 2, None, "A").select("idx", "title", "views"))
query("f18_drop_nan", "SELECT idx, x FROM nodes WHERE idx % 5 <> 0")(lambda s, d: N(s, d).select("idx", F.when(F.col("idx") % 5 == 0, float("nan")).otherwise(F.col("x")).alias("x")).where(~F.isnan("x")))
query("f17_hidden_categories", "SELECT idx, category FROM nodes WHERE category NOT IN (1, 4)")(lambda s, d: N(s, d).where(~F.col("category").isin(1, 4)).select("idx", "category"))
query("f20_orphans", "SELECT idx FROM nodes WHERE idx NOT IN (SELECT tgt FROM edges WHERE cnt > 1)")(lambda s, d: N(s, d).select("idx").join(E(s, d).where("cnt > 1").select(F.col("tgt").alias("idx")), "idx", "left_anti"))

# ---- joins
query("j2_out_neighbours", "SELECT e.src, e.tgt, n.title FROM edges e JOIN nodes n ON n.idx = e.tgt")(lambda s, d: E(s, d).join(N(s, d), F.col("tgt") == F.col("idx")).select("src", "tgt", "title"))
query("j3_in_neighbours", "SELECT e.src, e.tgt, n.title FROM edges e JOIN nodes n ON n.idx = e.src")(lambda s, d: E(s, d).join(N(s, d), F.col("src") == F.col("idx")).select("src", "tgt", "title"))
query("j4_context_of_titles", "SELECT context FROM links WHERE src = (SELECT idx FROM nodes ORDER BY title, idx LIMIT 1)")(
    lambda s, d: links(s, d).join(g.small(N(s, d).orderBy("title", "idx").limit(1).select(F.col("idx").alias("src")), 1), "src", "left_semi").select("context"))
BOX = (-60.0, -60.0, 60.0, 60.0)
query("j5_viewport_links", "SELECT e.src, e.tgt FROM edges e JOIN nodes a ON a.idx = e.src JOIN nodes b ON b.idx = e.tgt WHERE a.x BETWEEN -60 AND 60 AND a.y BETWEEN -60 AND 60 AND b.x BETWEEN -60 AND 60 AND b.y BETWEEN -60 AND 60")(
    lambda s, d: g.induced(E(s, d), N(s, d).where(spatial.in_box(BOX)).select("idx")).select("src", "tgt"))
TOPV = "(SELECT idx FROM nodes ORDER BY views DESC, idx LIMIT 200)"


def topv(s, d):
    return N(s, d).orderBy(F.desc("views"), "idx").limit(200).select("idx")


query("j6_induced", f"SELECT src, tgt, cnt FROM edges WHERE src IN {TOPV} AND tgt IN {TOPV}")(lambda s, d: g.induced(E(s, d), topv(s, d)).select("src", "tgt", "cnt"))
query("j7_touching_outside", f"SELECT src, tgt, cnt FROM edges WHERE NOT (src IN {TOPV} AND tgt IN {TOPV})")(lambda s, d: g.touching_outside(E(s, d), topv(s, d)).select("src", "tgt", "cnt"))
query("j8_incident", "SELECT DISTINCT least(src, tgt) AS lo, greatest(src, tgt) AS hi FROM edges WHERE src IN (1, 2, 3) OR tgt IN (1, 2, 3)")(lambda s, d: g.incident(E(s, d), ids(s, 1, 2, 3)))
query("j9_segments", "SELECT e.src, e.tgt, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM edges e JOIN nodes a ON a.idx = e.src JOIN nodes b ON b.idx = e.tgt")(lambda s, d: spatial.segments(E(s, d), N(s, d)))


@query("j10_merge_contexts", """SELECT l.src, l.tgt, CASE WHEN m.c IS NOT NULL THEN m.c ELSE l.context END AS context FROM links l LEFT JOIN
 (SELECT src, tgt, min_by(context, ctx_id) AS c FROM (SELECT src, tgt, 'new ' || k AS context, first_order * 10 + k AS ctx_id FROM links, (VALUES (1), (2)) v(k) WHERE first_order % 3 = 0) GROUP BY 1, 2) m ON m.src = l.src AND m.tgt = l.tgt""")
def j10(s, d):
    base = links(s, d)
    new = base.where("first_order % 3 = 0").select("src", "tgt", "first_order", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).withColumn("ctx_id", F.col("first_order") * 10 + F.col("k"))
    ctx = new.select("ctx_id", F.concat(F.lit("new "), "k").alias("context")).dropDuplicates(["ctx_id"])
    return g.merged_contexts(base.select("src", "tgt", "context"), new.select("src", "tgt", "ctx_id"), ctx)


query("j11_semi_join", "SELECT e.src, e.tgt FROM edges e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.idx = e.src AND n.category = 2)")(lambda s, d: E(s, d).join(N(s, d).where("category = 2").select(F.col("idx").alias("src")), "src", "left_semi").select("src", "tgt"))
query("j12_left_fill", "SELECT n.idx, coalesce(c.cnt, -1) AS cnt FROM nodes n LEFT JOIN (SELECT src, max(cnt) AS cnt FROM edges GROUP BY 1) c ON c.src = n.idx")(
    lambda s, d: N(s, d).select("idx").join(E(s, d).groupBy(F.col("src").alias("idx")).agg(F.max("cnt").alias("cnt")), "idx", "left").select("idx", F.coalesce("cnt", F.lit(-1)).cast("long").alias("cnt")))
query("j13_gateway_position", "SELECT n.idx, b.x AS gx, b.y AS gy FROM nodes n LEFT JOIN nodes b ON b.idx = n.idx - n.idx % 10 AND b.idx > 0")(
    lambda s, d: N(s, d).select("idx", (F.col("idx") - F.col("idx") % 10).alias("gw")).join(N(s, d).where("idx > 0").select(F.col("idx").alias("gw"), F.col("x").alias("gx"), F.col("y").alias("gy")), "gw", "left").select("idx", "gx", "gy"))
query("j14_label_update", "SELECT n.idx, coalesce(u.l, n.category) AS label FROM nodes n LEFT JOIN (SELECT tgt, min(src) AS l FROM edges GROUP BY 1) u ON u.tgt = n.idx")(
    lambda s, d: N(s, d).join(E(s, d).groupBy(F.col("tgt").alias("idx")).agg(F.min("src").alias("l")), "idx", "left").select("idx", F.coalesce("l", "category").alias("label")))
query("j15_size_back", "SELECT idx, count(*) OVER (PARTITION BY category) AS size FROM nodes")(lambda s, d: N(s, d).join(N(s, d).groupBy("category").agg(F.count("*").alias("size")), "category").select("idx", "size"))
query("j16_views_default", "SELECT p_partkey AS idx, coalesce((SELECT CAST(sum(l_quantity) AS BIGINT) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R'), 0) AS views FROM part", False)(
    lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("idx")).join(table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("idx")).agg(F.sum("l_quantity").cast("long").alias("v")), "idx", "left").select("idx", F.coalesce("v", F.lit(0)).cast("long").alias("views")))
query("j17_nearest_node", "SELECT c.idx AS pid, min_by(n.idx, (n.x - c.x - 1) * (n.x - c.x - 1) + (n.y - c.y) * (n.y - c.y) + n.idx * 1e-9) AS idx FROM nodes c JOIN nodes n ON (n.x - c.x - 1) * (n.x - c.x - 1) + (n.y - c.y) * (n.y - c.y) < 144 GROUP BY 1")(
    lambda s, d: spatial.near_points(N(s, d), N(s, d).select(F.col("idx").alias("pid"), (F.col("x") + 1).alias("px"), F.col("y").alias("py")), 12.0))
query("j18_near_pairs", "SELECT a.idx AS a, b.idx AS b, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 6) AS d2 FROM nodes a JOIN nodes b ON b.idx > a.idx AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 100")(
    lambda s, d: spatial.near_pairs(N(s, d), 10.0).withColumn("d2", F.round("d2", 6)))
CENTRES = [(k, 100.0 * (k % 3 - 1), 100.0 * (k // 3 - 1)) for k in range(7)]
query("j19_nearest_centre", "SELECT idx, min_by(k, (x - cx) * (x - cx) + (y - cy) * (y - cy) + k * 1e-9) AS centre FROM nodes, (VALUES " + ", ".join(f"({k}, {x}, {y})" for k, x, y in CENTRES) + ") c(k, cx, cy) GROUP BY 1")(
    lambda s, d: N(s, d).select("idx", F.array_min(F.array(*[F.struct(((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)).alias("d"), F.lit(k).alias("k")) for k, x, y in CENTRES]))["k"].alias("centre")))
query("j20_edge_context", "SELECT p.a, p.b, coalesce(f.context, r.context) AS context FROM (SELECT tgt AS a, src AS b FROM edges) p LEFT JOIN links f ON f.src = p.a AND f.tgt = p.b LEFT JOIN links r ON r.src = p.b AND r.tgt = p.a")(
    lambda s, d: g.edge_contexts(links(s, d), E(s, d).select(F.col("tgt").alias("a"), F.col("src").alias("b"))))
query("j21_expand", "SELECT DISTINCT e.tgt AS idx FROM edges e WHERE e.src IN (1, 5, 9)")(lambda s, d: ids(s, 1, 5, 9).withColumnRenamed("idx", "src").join(E(s, d), "src").select(F.col("tgt").alias("idx")).distinct())

# ---- aggregations
query("a1_degrees", "SELECT idx, in_degree, out_degree FROM deg")(lambda s, d: D(s, d).select("idx", "in_degree", "out_degree"))
query("a2_total_degree", "SELECT n.idx, count(p.v) AS degree FROM nodes n LEFT JOIN (SELECT src AS v FROM pairs WHERE src <> tgt UNION ALL SELECT tgt FROM pairs WHERE src <> tgt) p ON p.v = n.idx GROUP BY 1")(
    lambda s, d: g.degrees(N(s, d).select("idx"), pairs(s, d).where("src <> tgt")).select("idx", "degree"))
query("a3_undirected_degree", "SELECT v AS idx, count(*) AS degree FROM (SELECT src AS v, tgt AS w FROM edges UNION SELECT tgt, src FROM edges) GROUP BY 1")(lambda s, d: g.symmetric(E(s, d)).groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("degree")))
query("a4_subset_degree", "SELECT src AS idx, count(*) AS n FROM edges WHERE tgt <= 100 GROUP BY 1")(lambda s, d: E(s, d).where("tgt <= 100").groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("n")))
query("a5_adjacency", "SELECT src AS idx, string_agg(CAST(tgt AS VARCHAR), ',' ORDER BY tgt) AS nbrs FROM edges GROUP BY 1")(lambda s, d: g.adjacency(E(s, d)).select("idx", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs")))
query("a5b_csr_stats", "SELECT max(n) AS max_degree, round(CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM nodes), 9) AS avg_degree FROM (SELECT count(*) AS n FROM edges GROUP BY src)")(
    lambda s, d: g.offsets(N(s, d), E(s, d)).agg(F.max("size").alias("max_degree"), F.round(F.sum("size") / F.count("*"), 9).alias("avg_degree")))


def stored_graph(s, d):
    """The graph's binary files, written by the sink and its adjacency read again."""
    path = g.scratch_path(s, "assets")
    asset_sink.write_graph(N(s, d), E(s, d), path)
    return asset_sink.read_adjacency_rows(s, f"{path}/adjacency.bin", 1000)


query("k7b_stored_adjacency", "SELECT idx, coalesce(string_agg(CAST(tgt AS VARCHAR), ',' ORDER BY tgt), '') AS nbrs FROM nodes LEFT JOIN edges ON src = idx GROUP BY 1")(
    lambda s, d: stored_graph(s, d).select("idx", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs")))
query("o15_offsets", "SELECT idx, coalesce(n, 0) AS size, CAST(sum(coalesce(n, 0)) OVER (ORDER BY idx) - coalesce(n, 0) AS BIGINT) AS start FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) ON src = idx")(lambda s, d: g.offsets(N(s, d), E(s, d)))
query("a6_top_sources", "SELECT src AS idx, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, idx LIMIT 25")(lambda s, d: E(s, d).groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "idx").limit(25))
query("a7_global_stats", "SELECT count(*) AS n, max(views) AS max_views, (SELECT count(*) FROM edges) AS links FROM nodes")(
    lambda s, d: N(s, d).agg(F.count("*").alias("n"), F.max("views").alias("max_views")).crossJoin(E(s, d).agg(F.count("*").alias("links"))))
query("a8_top_hub", "SELECT idx, in_degree FROM deg ORDER BY in_degree DESC, idx LIMIT 1")(lambda s, d: D(s, d).select("idx", "in_degree").orderBy(F.desc("in_degree"), "idx").limit(1))
query("a9_strongest_neighbour", "SELECT v AS idx, max_by(w, degree * 10000000 + w) AS nbr FROM (SELECT src AS v, tgt AS w FROM edges UNION SELECT tgt, src FROM edges) JOIN deg ON deg.idx = w GROUP BY 1")(lambda s, d: g.strongest_neighbour(D(s, d), E(s, d)))
query("a12_community_sizes", "SELECT category, count(*) AS n FROM nodes GROUP BY 1")(lambda s, d: N(s, d).groupBy("category").agg(F.count("*").alias("n")))
query("a13_min_gateway", "SELECT tgt AS idx, min(src) AS gateway FROM edges GROUP BY 1")(lambda s, d: E(s, d).groupBy(F.col("tgt").alias("idx")).agg(F.min("src").alias("gateway")))
query("a14_two_hop", "SELECT b.tgt AS idx, count(*) AS ways FROM edges a JOIN edges b ON b.src = a.tgt WHERE a.src = 7 AND b.tgt <> 7 AND b.tgt NOT IN (SELECT tgt FROM edges WHERE src = 7) GROUP BY 1 ORDER BY ways DESC, idx LIMIT 600")(lambda s, d: g.two_hop(E(s, d), 7))
query("a20_quantiles", "SELECT round(quantile_cont(views, 0.995), 6) AS q995, round(quantile_cont(views, 0.95), 6) AS q95, round(quantile_cont(hypot, 0.97), 6) AS r97 FROM (SELECT views, sqrt(x * x + y * y) AS hypot FROM nodes)")(
    lambda s, d: quantiles.quantiles(N(s, d).select("views", F.hypot("x", "y").alias("hypot")), {"q995": ("views", 0.995), "q95": ("views", 0.95), "r97": ("hypot", 0.97)}).select(*[F.round(c, 6).alias(c) for c in ("q995", "q95", "r97")]))
query("a21_extents", "SELECT category, min(x) AS x0, max(x) AS x1, round(stddev_pop(x), 6) AS sx, round(stddev_samp(y), 6) AS sy, round(avg(x), 6) AS mx FROM nodes GROUP BY 1")(
    lambda s, d: N(s, d).groupBy("category").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.round(F.stddev_pop("x"), 6).alias("sx"), F.round(F.stddev_samp("y"), 6).alias("sy"), F.round(F.avg("x"), 6).alias("mx")))
query("a21b_normalised", "SELECT idx, round(x / m * 1800, 5) AS x FROM nodes, (SELECT max(greatest(abs(x), abs(y))) AS m FROM nodes)")(
    lambda s, d: N(s, d).crossJoin(F.broadcast(N(s, d).agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")))).select("idx", F.round(F.col("x") / F.col("m") * 1800, 5).alias("x")))


@query("a22_degree_palette", "SELECT idx, dense_rank() OVER (ORDER BY degree) - 1 AS slot FROM deg")
def a22(s, d):
    deg = D(s, d).select("idx", "degree")
    palette = deg.select("degree").distinct().withColumn("slot", (F.row_number().over(Window.orderBy("degree")) - 1).cast("long"))
    return deg.join(palette, "degree").select("idx", "slot")


query("a24_latency_stats", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most, round(median(value), 6) AS mid FROM events GROUP BY 1", False)(
    lambda s, d: quantiles.with_quantile(table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most")), table(s, d, "events"), ["event_type"], "value", 0.5, "mid").withColumn("mid", F.round("mid", 6)))
query("a25_modularity", """+ und AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, CAST(sum(cnt) AS DOUBLE) AS w FROM edges GROUP BY 1, 2),
 lab AS (SELECT u.w, x.category AS la, y.category AS lb FROM und u JOIN nodes x ON x.idx = a JOIN nodes y ON y.idx = b), m AS (SELECT sum(w) AS m, sum(CASE WHEN la = lb THEN w ELSE 0 END) AS i FROM lab),
 k AS (SELECT l, sum(w) AS k FROM (SELECT la AS l, w FROM lab UNION ALL SELECT lb, w FROM lab) GROUP BY 1)
 SELECT round(any_value(i) / any_value(m) - sum(k * k) / (4 * any_value(m) * any_value(m)), 9) AS modularity, count(*) AS communities FROM k, m""")(
    lambda s, d: g.modularity(und(s, d), N(s, d).select("idx", F.col("category").alias("label"))).select(F.round("modularity", 9).alias("modularity"), "communities"))


def und(s, d):
    return E(s, d).groupBy(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).agg(F.sum("cnt").cast("double").alias("w")).select("src", "tgt", "w")


# ---- orderings, sets
@query("o1_dense_index", "SELECT title, row_number() OVER (ORDER BY title) - 1 AS idx FROM nodes")
def o1(s, d):
    """Dense places by title without one task for all: ranges of titles are counted, then numbered within."""
    parts = N(s, d).select("title").repartitionByRange(16, "title").sortWithinPartitions("title").withColumn("p", F.spark_partition_id())
    parts = g.reliable(parts)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return parts.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("title"))).join(F.broadcast(base), "p").select("title", (F.col("base") + F.col("k") - 1).cast("long").alias("idx"))


query("o2_frontier", "SELECT idx, views FROM nodes WHERE idx % 3 = 1 ORDER BY views DESC, idx LIMIT 20")(lambda s, d: N(s, d).where("idx % 3 = 1").select("idx", "views").orderBy(F.desc("views"), "idx").limit(20))
query("o3_top_views", "SELECT idx, views FROM nodes ORDER BY views DESC, idx LIMIT 100")(lambda s, d: N(s, d).select("idx", "views").orderBy(F.desc("views"), "idx").limit(100))
query("o4_top_neighbours", "SELECT idx, nbr, degree, rank FROM (SELECT v AS idx, w AS nbr, degree, row_number() OVER (PARTITION BY v ORDER BY degree DESC, w) AS rank FROM (SELECT src AS v, tgt AS w FROM edges UNION SELECT tgt, src FROM edges) JOIN deg ON deg.idx = w) WHERE rank <= 10")(lambda s, d: g.top_neighbours(D(s, d), E(s, d), 10))
query("o5_connections", "(SELECT 'out' AS kind, tgt AS nbr FROM edges WHERE src = 7 ORDER BY tgt LIMIT 20) UNION ALL (SELECT 'in', src FROM edges WHERE tgt = 7 ORDER BY src LIMIT 20)")(lambda s, d: search.connections(E(s, d), 7))
query("o6_union_limit", "SELECT * FROM (SELECT 'out' AS kind, tgt AS nbr FROM edges WHERE src = 7 UNION ALL SELECT 'in', src FROM edges WHERE tgt = 7) ORDER BY kind DESC, nbr LIMIT 15")(
    lambda s, d: g.neighbours(E(s, d), ids(s, 7)).select("kind", "nbr").orderBy(F.desc("kind"), "nbr").limit(15))
query("o9_union_minus_seen", "SELECT idx FROM nodes WHERE category = 1 AND idx NOT IN (SELECT tgt FROM edges WHERE src = 7) UNION SELECT tgt FROM edges WHERE src = 7")(
    lambda s, d: N(s, d).where("category = 1").select("idx").join(E(s, d).where("src = 7").select(F.col("tgt").alias("idx")), "idx", "left_anti").union(E(s, d).where("src = 7").select("tgt")).distinct())
query("o10_symmetrised", "SELECT src, tgt FROM edges UNION SELECT tgt, src FROM edges")(lambda s, d: g.symmetric(E(s, d)))
query("o11_hash_sample", f"SELECT src, tgt, cnt FROM edges WHERE {sql_unit('(src * 1000003 + tgt)', 42)} < 0.03")(lambda s, d: E(s, d).where(maths.unit_hash(F.col("src") * 1000003 + F.col("tgt"), 42) < 0.03).select("src", "tgt", "cnt"))
query("o12_random_nodes", f"SELECT idx, title FROM nodes ORDER BY {sql_unit('idx', 43)}, idx LIMIT 10")(lambda s, d: N(s, d).select("idx", "title").orderBy(maths.unit_hash(F.col("idx"), 43), "idx").limit(10))
query("o13_first_seen", "SELECT tgt, min_by(src, first_order * 1000000 + src) AS src FROM edges GROUP BY 1")(lambda s, d: E(s, d).groupBy("tgt").agg(F.min_by("src", F.struct("first_order", "src")).alias("src")))
query("o16_consecutive", "SELECT conv_id, turn, next FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL", False)(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next")).where("next is not null"))

# ---- weights and costs over links
query("m1_order_weight", "SELECT src, tgt, round(greatest(0.1, 1 / (1 + 0.05 * pos)), 9) AS w FROM links")(lambda s, d: links(s, d).select("src", "tgt", F.round(maths.order_weight(F.col("pos")), 9).alias("w")))
query("m2_three_places", "SELECT src, tgt, round_even(greatest(0.1, 1 / (1 + 0.05 * CAST(pos AS DOUBLE))), 3) AS w FROM links")(lambda s, d: links(s, d).select("src", "tgt", maths.three_places(maths.order_weight(F.col("pos"))).alias("w")))
query("m3_squeezed", "SELECT src, tgt, round(least(greatest(ln(1 + cnt), 0), 2), 9) AS w FROM edges")(lambda s, d: E(s, d).select("src", "tgt", F.round(maths.squeezed_weight(F.col("cnt")), 9).alias("w")))


@query("m4_hub_damped", "SELECT src, tgt, round(cnt / ln(greatest(a.degree, b.degree, 2.718281828459045)), 9) AS w FROM edges JOIN deg a ON a.idx = src JOIN deg b ON b.idx = tgt")
def m4(s, d):
    deg = D(s, d).select("idx", "degree")
    e = E(s, d).join(deg.toDF("src", "a"), "src").join(deg.toDF("tgt", "b"), "tgt")
    return e.select("src", "tgt", F.round(maths.hub_damped(F.col("cnt"), F.col("a"), F.col("b")), 9).alias("w"))


query("m5_hop_cost", "SELECT idx, round(1 + 0.5 * ln(1 + degree), 9) AS cost FROM deg")(lambda s, d: D(s, d).select("idx", F.round(maths.hop_cost(F.col("degree")), 9).alias("cost")))
query("m6_radius", "SELECT d.idx, round(0.35 + 0.19 * ln(1 + degree), 9) AS by_degree, round(2 * ln(1 + views) + 1, 9) AS by_views, round(0.4 * ln(1 + views) + 1.2, 9) AS small, round(least(greatest(pow(views, 0.25), 2), 5), 9) AS by_power FROM deg d JOIN nodes n ON n.idx = d.idx")(
    lambda s, d: D(s, d).select("idx", F.round(maths.radius_by_degree(F.col("degree")), 9).alias("by_degree"), F.round(maths.radius_by_views(F.col("views")), 9).alias("by_views"), F.round(maths.radius_by_views(F.col("views"), 0.4, 1.2), 9).alias("small"), F.round(maths.radius_by_power(F.col("views")), 9).alias("by_power")))

# ---- graph algorithms
query("g1_neighbours", "SELECT src AS idx, tgt AS nbr, 'out' AS kind FROM edges WHERE src IN (7, 8) UNION ALL SELECT tgt, src, 'in' FROM edges WHERE tgt IN (7, 8) AND src <> tgt")(lambda s, d: g.neighbours(E(s, d), ids(s, 7, 8)))
BFS = """+ lv AS (SELECT CAST(1 AS BIGINT) AS idx, 0 AS depth UNION SELECT e.tgt, lv.depth + 1 FROM lv JOIN edges e ON e.src = lv.idx WHERE lv.depth < 3),
 best AS (SELECT idx, min(depth) AS depth FROM lv GROUP BY 1) """
query("g3_bfs_levels", BFS + """SELECT b.idx, CAST(b.depth AS BIGINT) AS depth, min(p.idx) AS pred FROM best b LEFT JOIN edges e ON e.tgt = b.idx LEFT JOIN best p ON p.idx = e.src AND p.depth = b.depth - 1 GROUP BY 1, 2""")(lambda s, d: g.bfs_levels(E(s, d), ids(s, 1), 3))
query("g3_bfs_hops", BFS.replace("depth < 3", "depth < 6") + "SELECT CAST(depth + 1 AS BIGINT) AS nodes_on_path FROM best WHERE idx = 150")(lambda s, d: g.bfs_path(E(s, d), 1, 150).agg(F.count("*").alias("nodes_on_path")))
query("g5_bidirectional_hops", BFS.replace("depth < 3", "depth < 6") + "SELECT CAST(depth + 1 AS BIGINT) AS nodes_on_path FROM best WHERE idx = 150")(lambda s, d: g.bidirectional_path(E(s, d), 1, 150).agg(F.count("*").alias("nodes_on_path")))
query("g6_bidirectional_bounded", BFS.replace("depth < 3", "depth < 6") + "SELECT CAST(depth + 1 AS BIGINT) AS nodes_on_path FROM best WHERE idx = 120")(lambda s, d: g.bidirectional_path(E(s, d), 1, 120, 6).agg(F.count("*").alias("nodes_on_path")))
query("g7_undirected_hops", """+ sym AS (SELECT src, tgt FROM edges UNION SELECT tgt, src FROM edges), lv AS (SELECT CAST(1 AS BIGINT) AS idx, 0 AS depth UNION SELECT e.tgt, lv.depth + 1 FROM lv JOIN sym e ON e.src = lv.idx WHERE lv.depth < 4)
 SELECT CAST(min(depth) + 1 AS BIGINT) AS nodes_on_path FROM lv WHERE idx = 150""")(lambda s, d: g.bidirectional_path(E(s, d), 1, 150, 6, True).agg(F.count("*").alias("nodes_on_path")))


def weighted(s, d):
    deg = D(s, d).select(F.col("idx").alias("tgt"), "degree")
    return E(s, d).join(deg, "tgt")


query("g8_weighted_cost", """+ c AS (SELECT CAST(1 AS BIGINT) AS idx, CAST(0 AS DOUBLE) AS cost, 0 AS n UNION SELECT e.tgt, round(min(c.cost + 1 + 0.5 * ln(1 + degree)), 9), c.n + 1 FROM c JOIN edges e ON e.src = c.idx JOIN deg ON deg.idx = e.tgt WHERE c.n < 5 GROUP BY 1, 3)
 SELECT idx, round(min(cost), 6) AS cost FROM c GROUP BY 1""")(lambda s, d: g.cheapest_costs(weighted(s, d), 1, maths.hop_cost(F.col("degree")), max_links=5, places=9).select("idx", F.round("cost", 6).alias("cost")))
query("g8c_weighted_path")(lambda s, d: g.cheapest_path(weighted(s, d), 1, 150, maths.hop_cost(F.col("degree"))))
for _name, _method in (("g4_depth_first", "dfs"), ("g8a_astar", "astar"), ("g8b_greedy", "greedy"), ("g9b_random_walk", "walk")):
    query(_name)(lambda s, d, method=_method: search.shortest_path(E(s, d), 1, 150, method, N(s, d)))
query("g9_random_walks")(lambda s, d: g.random_walks(E(s, d), ids(s, 1, 2, 3, 4), 10, 7))
query("g10_louvain")(lambda s, d: g.louvain(und(s, d)))
query("g11_core_numbers")(lambda s, d: g.core_numbers(E(s, d)))
query("g11b_backbone")(lambda s, d: g.backbone(g.core_numbers(E(s, d))))
LABELS = "+ sym AS (SELECT src, tgt FROM edges UNION SELECT tgt, src FROM edges), h0 AS (SELECT idx, idx AS gateway, 0 AS hop FROM nodes WHERE idx IN (3, 50, 90))" + "".join(
    f", h{k} AS (SELECT * FROM h{k - 1} UNION ALL SELECT tgt, min(gateway), {k} FROM h{k - 1} JOIN sym ON src = idx WHERE hop = {k - 1} AND tgt NOT IN (SELECT idx FROM h{k - 1}) GROUP BY 1)" for k in range(1, 11)
) + " "
query("g12_label_hops", LABELS + "SELECT idx, gateway, CAST(hop AS BIGINT) AS hop FROM h10")(lambda s, d: g.propagate_labels(E(s, d), ids(s, 3, 50, 90)))
query("g13_inherit_category", LABELS + "SELECT h10.idx, n.category FROM h10 JOIN nodes n ON n.idx = h10.gateway")(
    lambda s, d: g.inherited(g.propagate_labels(E(s, d), ids(s, 3, 50, 90)), N(s, d), "category"))
query("g14_force_layout")(lambda s, d: g.force_layout(N(s, d), E(s, d)))
query("g15_pinned_layout")(lambda s, d: g.force_layout(N(s, d), E(s, d), 2, pinned=N(s, d).where("idx <= 20")))
query("g18_embedding")(lambda s, d: g.embed(E(s, d)))
query("g20_simulation")(lambda s, d: layout.simulate(N(s, d), E(s, d), 10))
query("g19b_neighbour_map")(lambda s, d: projection.neighbour_map(table(s, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("vec"))).select(F.col("v").alias("vec_id"), "x", "y"))
query("g19_projection")(lambda s, d: g.project(g.embed(E(s, d), 32)))


def new_graph(s, d):
    """Every third node's neighbour by number with other views, and links from each to nodes half of which are none."""
    n = table(s, d, "part").count()
    nodes = N(s, d).where("idx % 3 = 0").select((F.col("idx") + 1).alias("idx"), F.when(F.col("idx") % 2 == 0, F.col("views") + 1).alias("views"), F.lit("x").alias("note"))
    links = N(s, d).select(F.col("idx").alias("src"), (F.col("idx") * 2 - F.col("idx") % 2).alias("tgt"))
    return n, nodes, links


_NEW = "new AS (SELECT idx + 1 AS idx, CASE WHEN idx % 2 = 0 THEN views + 1 END AS views, 'x' AS note FROM nodes WHERE idx % 3 = 0), fresh AS (SELECT idx AS src, idx * 2 - idx % 2 AS tgt FROM nodes)"
query("g2_loaded_links", f"+ {_NEW} SELECT src, tgt FROM fresh WHERE tgt IN (SELECT idx FROM nodes)")(lambda s, d: g.load_graph(N(s, d), new_graph(s, d)[2])[1].select("src", "tgt"))
query("g2_merged_nodes", f"+ {_NEW} SELECT idx, coalesce(new.views, nodes.views) AS views, note FROM (SELECT idx FROM nodes UNION SELECT idx FROM new UNION SELECT src FROM fresh UNION SELECT tgt FROM fresh) LEFT JOIN nodes USING (idx) LEFT JOIN new USING (idx)")(
    lambda s, d: g.add_to_graph(N(s, d).select("idx", "views"), E(s, d).select("src", "tgt"), *new_graph(s, d)[1:])[0].select("idx", "views", "note"))
query("g2_merged_links", f"+ {_NEW} SELECT src, tgt FROM edges UNION SELECT src, tgt FROM fresh")(lambda s, d: g.add_to_graph(N(s, d).select("idx", "views"), E(s, d).select("src", "tgt"), *new_graph(s, d)[1:])[1].select("src", "tgt"))
