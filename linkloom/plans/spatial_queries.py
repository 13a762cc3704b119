"""Queries of grids, viewports, rasters, formulas and the interactive side, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import maths as m
from linkloom.functions import text as t
from linkloom.operators import graph as g
from linkloom.operators import layout, pyramid, quantiles
from linkloom.operators import spatial as sp
from linkloom.streaming import events as ev

from .fixtures import sql_normal, sql_unit, table
from .graph_queries import HEAD, D, E, N, ids

Q, SQL = {}, {}
#: Cells of a grid over -bound..bound.
CELL = "least(greatest(CAST(floor(({v} + {b}) / (2 * {b}) * {n}) AS BIGINT), 0), {n} - 1)"


def cells_sql(name, n, b):
    return f"{name} AS (SELECT n.idx, n.x, n.y, n.category, d.degree, {CELL.format(v='x', b=b, n=n)} AS cx, {CELL.format(v='y', b=b, n=n)} AS cy FROM nodes n JOIN deg d ON d.idx = n.idx)"


G64, G25 = cells_sql("c", 64, 240.0), cells_sql("c", 25, 240.0)


def query(name, sql=None, head=True):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = f"{HEAD}{',' if sql.startswith('+') else ''} {sql.removeprefix('+')}" if head else sql
        return f

    return put


def C(s, d, n=64, b=240.0):
    return sp.grid_cells(D(s, d), n, b)


query("v1_grid", f"+{G64} SELECT idx, cx, cy FROM c")(lambda s, d: C(s, d).select("idx", "cx", "cy"))
query("v1b_fitted_grid", "+b AS (SELECT 1.02 * max(greatest(abs(x), abs(y))) AS b FROM nodes) SELECT idx, least(greatest(CAST(floor((x + b) / (2 * b) * 384) AS BIGINT), 0), 383) AS cx, least(greatest(CAST(floor((y + b) / (2 * b) * 384) AS BIGINT), 0), 383) AS cy FROM nodes, b")(lambda s, d: sp.grid_cells(N(s, d), 384).select("idx", "cx", "cy"))


@query("v2_cell_index", f"+{G64}, k AS (SELECT cy * 64 + cx AS cell, count(*) AS n FROM c GROUP BY 1) SELECT cell, n, CAST(sum(n) OVER (ORDER BY cell) - n AS BIGINT) AS start FROM k")
def v2(s, d):
    k = C(s, d).groupBy((F.col("cy") * 64 + F.col("cx")).alias("cell")).agg(F.count("*").alias("n"))
    return k.select("cell", "n", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).cast("long").alias("start"))


query("v3_view_cells", f"+{G64} SELECT DISTINCT cx, cy FROM c WHERE cx BETWEEN 20 AND 43 AND cy BETWEEN 23 AND 44")(lambda s, d: sp.view_cells(C(s, d).select("cx", "cy"), (-60.0, -40.0, 60.0, 74.0), 240.0, 64))
query("v4_cell_budget", f"+{G64} SELECT idx FROM (SELECT idx, category, row_number() OVER (PARTITION BY cx, cy ORDER BY idx) AS r FROM c) WHERE r <= greatest(1, floor(150.0 / (SELECT count(*) FROM (SELECT DISTINCT cx, cy FROM c)))) AND category NOT IN (2)")(lambda s, d: sp.cell_budget(C(s, d), 150, (2,)).select("idx"))
query("v4b_exact_budget", f"""+{cells_sql('c', 16, 240.0)}, sz AS (SELECT cy, cx, n, count(*) OVER () AS m, row_number() OVER (ORDER BY cy, cx) AS k FROM (SELECT cy, cx, count(*) AS n FROM c GROUP BY 1, 2)),
 r AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS saved, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS take, CAST(NULL AS BIGINT) AS cy, CAST(NULL AS BIGINT) AS cx UNION ALL
  SELECT k, now - t, used + t, t, cy, cx FROM (SELECT *, CAST(least(n, floor(now), 90 - used) AS BIGINT) AS t FROM (SELECT sz.k, sz.n, r.used, sz.cy, sz.cx, least(r.saved + 90.0::DOUBLE / sz.m, greatest(1.5 * 90.0::DOUBLE / sz.m, 5)) AS now FROM r JOIN sz ON sz.k = r.k + 1)))
 SELECT idx FROM (SELECT idx, category, cx, cy, row_number() OVER (PARTITION BY cx, cy ORDER BY idx) AS rank FROM c) c JOIN r USING (cx, cy) WHERE rank <= take AND category NOT IN (2)""")(lambda s, d: sp.cell_budget_exact(C(s, d, 16), 90, (2,)).select("idx"))
query("v5_must_include", f"+{G64} SELECT idx FROM c WHERE cx < 30 UNION SELECT idx FROM nodes WHERE idx IN (1, 2, 150)")(lambda s, d: C(s, d).where("cx < 30").select("idx").union(N(s, d).join(ids(s, 1, 2, 150), "idx", "left_semi").select("idx")).distinct())
query("v6_hairlines", f"+{G64}, st AS (SELECT v AS idx, max_by(w, degree * 10000000 + w) AS nbr FROM (SELECT src AS v, tgt AS w FROM edges UNION SELECT tgt, src FROM edges) JOIN deg ON deg.idx = w GROUP BY 1) SELECT st.idx, st.nbr FROM st JOIN c ON c.idx = st.idx")(
    lambda s, d: g.strongest_neighbour(D(s, d), E(s, d)).join(C(s, d).select("idx"), "idx", "left_semi"))
query("v7_visible_links", "+v AS (SELECT idx FROM nodes WHERE x BETWEEN -30 AND 30 AND y BETWEEN -30 AND 30 ORDER BY idx LIMIT 80) SELECT DISTINCT least(src, tgt) AS lo, greatest(src, tgt) AS hi FROM edges WHERE src IN (SELECT idx FROM v) OR tgt IN (SELECT idx FROM v)")(
    lambda s, d: g.incident(E(s, d), N(s, d).where(sp.in_box((-30, -30, 30, 30))).orderBy("idx").limit(80).select("idx")))
query("v8_wide_grid", f"+{cells_sql('c', 500, 2000.0)} SELECT idx, cx, cy FROM c")(lambda s, d: C(s, d, 500, 2000.0).select("idx", "cx", "cy"))
query("v9_visible_ids", "SELECT idx FROM nodes WHERE x BETWEEN -50 AND 50 AND y BETWEEN -50 AND 50 ORDER BY idx LIMIT 300")(lambda s, d: N(s, d).where(sp.in_box((-50, -50, 50, 50))).orderBy("idx").limit(300).select("idx"))
query("v10_nearest_pick", "SELECT CAST(1 AS BIGINT) AS pid, idx FROM nodes WHERE (x - 10) * (x - 10) + (y - 5) * (y - 5) < 900 ORDER BY (x - 10) * (x - 10) + (y - 5) * (y - 5), idx LIMIT 1")(
    lambda s, d: sp.near_points(N(s, d), s.range(1).select(F.lit(1).cast("long").alias("pid"), F.lit(10.0).alias("px"), F.lit(5.0).alias("py")), 30.0))
query("v11_segment_culling", "SELECT src, tgt FROM edges JOIN nodes a ON a.idx = src JOIN nodes b ON b.idx = tgt WHERE greatest(a.x, b.x) >= 10 AND least(a.x, b.x) <= 20 AND greatest(a.y, b.y) >= 10 AND least(a.y, b.y) <= 20")(lambda s, d: sp.segments(E(s, d), N(s, d)).where(sp.segment_in_box((10, 10, 20, 20))).select("src", "tgt"))
query("v12_bundles", f"+{G64}, o AS (SELECT idx, max_by(idx, degree * 10000000 - idx) OVER (PARTITION BY cx // 4, cy // 4) AS rep FROM c) SELECT least(a.rep, b.rep) AS a, greatest(a.rep, b.rep) AS b, count(*) AS links FROM edges JOIN o a ON a.idx = src JOIN o b ON b.idx = tgt WHERE a.rep <> b.rep GROUP BY 1, 2")(lambda s, d: sp.bundled(E(s, d), C(s, d), 4))


def stored_pyramid(s, d):
    """All tiers of a grid of 100 by 100 cells, written once."""
    path = g.scratch_path(s, "pyramid")
    pyramid.build(C(s, d, 100), E(s, d), path)
    return path


G100 = cells_sql("c", 100, 240.0)
query("v1c_pyramid_cells", f"+{G100} SELECT tier, cx // tier AS cx, cy // tier AS cy, max_by(idx, degree * 10000000 - idx) AS idx, count(*) AS n FROM c, (VALUES (1), (2), (4), (10), (25)) t(tier) GROUP BY 1, 2, 3")(
    lambda s, d: s.read.schema(pyramid.CELLS).parquet(f"{stored_pyramid(s, d)}/cells").select("tier", "cx", "cy", "idx", "n"))
query("v4c_pyramid_view", f"+{G100} SELECT bx AS cx, by_ AS cy, max_by(idx, degree * 10000000 - idx) AS idx, count(*) AS n FROM (SELECT cx // 4 AS bx, cy // 4 AS by_, idx, degree FROM c) WHERE bx BETWEEN 8 AND 15 AND by_ BETWEEN 9 AND 14 GROUP BY 1, 2")(
    lambda s, d: pyramid.cells_at(s, stored_pyramid(s, d), 4, (8, 9, 15, 14)).select("cx", "cy", "idx", "n"))
for _tier in pyramid.TIERS:
    query(f"v12_pyramid_bundles_{_tier}", f"+{G100}, o AS (SELECT idx, max_by(idx, degree * 10000000 - idx) OVER (PARTITION BY cx // {_tier}, cy // {_tier}) AS rep FROM c) SELECT least(a.rep, b.rep) AS a, greatest(a.rep, b.rep) AS b, count(*) AS links FROM edges JOIN o a ON a.idx = src JOIN o b ON b.idx = tgt WHERE a.rep <> b.rep GROUP BY 1, 2")(
        lambda s, d, tier=_tier: pyramid.bundles_at(s, stored_pyramid(s, d), tier))


@query("v13_view_tiers", "+q AS (SELECT quantile_cont(views, 0.95) AS a, quantile_cont(views, 0.995) AS b FROM nodes) SELECT idx, CASE WHEN views >= b THEN 'supernova' WHEN views >= a THEN 'stars' ELSE 'dust' END AS tier FROM nodes, q")
def v13(s, d):
    q = quantiles.quantiles(N(s, d).select("views"), {"a": ("views", 0.95), "b": ("views", 0.995)})
    return N(s, d).crossJoin(F.broadcast(q)).select("idx", F.when(F.col("views") >= F.col("b"), "supernova").when(F.col("views") >= F.col("a"), "stars").otherwise("dust").alias("tier"))


query("v14_canvas_range", "SELECT round(min(x) - 0.01 * (max(x) - min(x)), 6) AS x0, round(max(x) + 0.01 * (max(x) - min(x)), 6) AS x1 FROM nodes")(
    lambda s, d: N(s, d).agg(F.round(F.min("x") - 0.01 * (F.max("x") - F.min("x")), 6).alias("x0"), F.round(F.max("x") + 0.01 * (F.max("x") - F.min("x")), 6).alias("x1")))
query("v16_offscreen", "SELECT idx, (x * 4 + 400 < 0 OR x * 4 + 400 > 800) AS hidden FROM nodes")(lambda s, d: N(s, d).select("idx", (~m.to_screen(F.col("x"), 0.0, 2.0, 800).between(0, 800)).alias("hidden")))
query("a10_representatives", f"+{G25} SELECT cx, cy, max_by(idx, degree * 10000000 - idx) AS idx, count(*) AS n FROM c GROUP BY 1, 2")(lambda s, d: sp.representatives(C(s, d, 25)))
query("a11_links_per_cell", f"+{G25} SELECT cx, cy, count(DISTINCT src * 100000000 + tgt) AS n FROM (SELECT src, tgt, cx, cy FROM edges JOIN c ON c.idx = src UNION ALL SELECT src, tgt, cx, cy FROM edges JOIN c ON c.idx = tgt) GROUP BY 1, 2")(
    lambda s, d: sp.links_per_cell(E(s, d), C(s, d, 25)))
query("a15_density", f"+{G25} SELECT cx AS px, cy AS py, count(*) AS count FROM c GROUP BY 1, 2")(lambda s, d: sp.raster_points(D(s, d), 240.0, 25))
query("a16_line_raster", """+ g AS (SELECT src, tgt, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM edges JOIN nodes a ON a.idx = src JOIN nodes b ON b.idx = tgt),
 n AS (SELECT *, CAST(greatest(ceil(greatest(abs((x1 - x0) * (100 / 480.0::DOUBLE)), abs((y1 - y0) * (100 / 480.0::DOUBLE)))), 1) AS BIGINT) AS n FROM g), p AS (SELECT *, unnest(range(n + 1)) AS t FROM n),
 q AS (SELECT DISTINCT src, tgt, least(greatest(CAST(floor((x0 + (x1 - x0) * t / n + 240.0::DOUBLE) / 480.0::DOUBLE * 100) AS BIGINT), 0), 99) AS px, least(greatest(CAST(floor((y0 + (y1 - y0) * t / n + 240.0::DOUBLE) / 480.0::DOUBLE * 100) AS BIGINT), 0), 99) AS py FROM p)
 SELECT px, py, count(*) AS count FROM q GROUP BY 1, 2""")(lambda s, d: sp.raster_lines(sp.segments(E(s, d), N(s, d)), 240.0, 100))
query("v15_over", f"""+{G25}, k AS (SELECT cx AS px, cy AS py, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT px, py, (n % 5) / 5.0::DOUBLE AS v, 0.5::DOUBLE AS a FROM k WHERE px % 3 <> 0), b AS (SELECT px, py, (n % 7) / 7.0::DOUBLE AS v, 0.8::DOUBLE AS a FROM k WHERE py % 3 <> 0),
 m AS (SELECT coalesce(t.px, b.px) AS px, coalesce(t.py, b.py) AS py, coalesce(t.v, 0) AS tv, coalesce(t.a, 0) AS ta, coalesce(b.v, 0) AS bv, coalesce(b.a, 0) AS ba FROM t FULL JOIN b ON t.px = b.px AND t.py = b.py)
 SELECT px, py, round((tv * ta + bv * ba * (1 - ta)) / (ta + ba * (1 - ta)), 9) AS r, round((1 - tv) * CASE WHEN ta > 0 THEN ta ELSE 0 END / (ta + ba * (1 - ta)) + (1 - bv) * ba * (1 - ta) / (ta + ba * (1 - ta)), 9) AS g, round(ta + ba * (1 - ta), 9) AS a FROM m""")(
    lambda s, d: (lambda k: sp.over(*[k.where(keep).select("px", "py", (F.col("count") % n / float(n)).alias("r"), (1 - F.col("count") % n / float(n)).alias("g"), F.lit(0.25).alias("b"), F.lit(a).alias("a")) for keep, n, a in (("px % 3 <> 0", 5, 0.5), ("py % 3 <> 0", 7, 0.8))]))(sp.raster_points(D(s, d), 240.0, 25)).select("px", "py", *[F.round(c, 9).alias(c) for c in "rga"]))
query("a17_winner", f"+{G25}, k AS (SELECT cx AS px, cy AS py, category, count(*) AS n FROM c GROUP BY 1, 2, 3) SELECT px, py, max_by(category, n * 100 - category) AS category, max(n) AS n FROM k GROUP BY 1, 2")(lambda s, d: sp.winner_take_all(D(s, d), 240.0, 25))
query("a18_dilated", f"+{G25}, k AS (SELECT cx AS px, cy AS py, count(*) AS count FROM c GROUP BY 1, 2) SELECT px + i AS px, py + j AS py, max(count) AS count FROM k, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) GROUP BY 1, 2")(lambda s, d: sp.dilated(sp.raster_points(D(s, d), 240.0, 25)))
query("a19_equalised", f"+{G25}, k AS (SELECT cx AS px, cy AS py, count(*) AS count FROM c GROUP BY 1, 2) SELECT px, py, count, round(0.15 + 0.85 * pow((row_number() OVER (ORDER BY count, px, py) - 1) / greatest(count(*) OVER () - 1, 1), 0.8), 9) AS intensity FROM k")(
    lambda s, d: sp.equalised(sp.raster_points(D(s, d), 240.0, 25)).withColumn("intensity", F.round("intensity", 9)))
query("m7_geometry", "SELECT idx, round(sqrt(x * x + y * y), 6) AS r, round(atan2(y, x), 6) AS a FROM nodes")(lambda s, d: N(s, d).select("idx", *[F.round(c, 6).alias(n) for c, n in zip(m.polar(F.col("x"), F.col("y")), "ra", strict=True)]))
query("m8_spiral", "SELECT idx, round(5 * sqrt(idx) * cos(idx * 2.399963229728653::DOUBLE), 6) AS x, round(0.618 * sqrt(idx) * sin(idx * 2.399963229728653::DOUBLE), 6) AS y FROM nodes")(lambda s, d: N(s, d).select("idx", F.round(m.spiral(F.col("idx"))[0], 6).alias("x"), F.round(m.spiral(F.col("idx"), 0.618)[1], 6).alias("y")))
_GAL = "850 * {f}(2 * pi() * (idx % 7) / 7) + 220 * {f}(2 * pi() * ((idx // 7) % 12) / 12) + (r + jr * {f}(ja)) * {f}(2 * pi() * 0.618033988749895::DOUBLE * k)"
query("m9_galactic_layout", f"+ h AS (SELECT idx, idx // 7 // 12 AS k, 0.39::DOUBLE * sqrt(idx // 7 // 12) AS r, {sql_unit('idx', 1)} AS a, {sql_unit('idx', 2)} * 2 * pi() AS ja FROM nodes), j AS (SELECT *, a * (1.8::DOUBLE + 0.12::DOUBLE * r) AS jr FROM h) SELECT idx, round({_GAL.format(f='cos')}, 5) AS x, round({_GAL.format(f='sin')}, 5) AS y FROM j")(
    lambda s, d: N(s, d).select("idx", *[F.round(c, 5).alias(n) for c, n in zip(m.galactic(F.col("idx")), "xy", strict=True)]))
_NEB = f"""+ h AS (SELECT idx, (CASE idx % 7 {' '.join(f"WHEN {i} THEN {v}" for i, v in enumerate(m.DIRECTIONS))} END)::DOUBLE * pi() / 180 + ((idx // 7) % 3 - 1) * 0.18::DOUBLE + {sql_normal('idx', 3)} * (0.08::DOUBLE + 0.05::DOUBLE * (idx / (SELECT count(*) FROM nodes))) AS a,
 1.05::DOUBLE * pow(idx::DOUBLE, 0.45::DOUBLE) * (0.7::DOUBLE + 0.6::DOUBLE * {sql_unit('idx', 5)}) AS r FROM nodes) SELECT idx, round(r * cos(a) * cos(pi() / 12) - r * sin(a) * sin(pi() / 12), 5) AS x, round(350 + (r * cos(a) * sin(pi() / 12) + r * sin(a) * cos(pi() / 12)), 5) AS y FROM h"""
query("m10_nebula_layout", _NEB)(lambda s, d: (lambda n: n.select("idx", *[F.round(c, 5).alias(k) for c, k in zip(m.nebula(F.col("idx"), n.count()), "xy", strict=True)]))(N(s, d)))
query("m11_hash_jitter", "SELECT idx, round((h % 100000) / 100000.0, 9) AS a, round((h // 100000) / 21475.0, 9) AS r FROM (SELECT idx, (idx * 1103515245 + 12345) & 2147483647 AS h FROM nodes)")(lambda s, d: N(s, d).select("idx", *[F.round(c, 9).alias(n) for c, n in zip(m.hash_jitter(F.col("idx")), "ar", strict=True)]))


@query("m12_centre_spiral", "SELECT category, round(40 * sqrt(r + 2) * cos(r * 2.399963229728653), 6) AS x, round(40 * sqrt(r + 2) * sin(r * 2.399963229728653), 6) AS y FROM (SELECT category, row_number() OVER (ORDER BY count(*) DESC, category) - 1 AS r FROM nodes GROUP BY 1)")
def m12(s, d):
    r = F.row_number().over(Window.orderBy(F.desc("n"), "category")) - 1
    k = N(s, d).groupBy("category").agg(F.count("*").alias("n")).withColumn("r", r)
    return k.select("category", F.round(40 * F.sqrt(F.col("r") + 2) * F.cos(F.col("r") * 2.399963229728653), 6).alias("x"), F.round(40 * F.sqrt(F.col("r") + 2) * F.sin(F.col("r") * 2.399963229728653), 6).alias("y"))


LIMITS = "lim AS (SELECT lo - 0.0001::DOUBLE * (hi - lo) AS lo, 65535.0::DOUBLE / (hi - lo + 2 * 0.0001::DOUBLE * (hi - lo)) AS scale FROM (SELECT least(min(x), min(y)) AS lo, greatest(max(x), max(y)) AS hi FROM nodes))"


def limits(s, d):
    n = N(s, d)
    ends = n.agg(F.least(F.min("x"), F.min("y")).alias("a"), F.greatest(F.max("x"), F.max("y")).alias("b"))  # one row
    lo, scale = m.quantiser(F.col("a"), F.col("b"))
    return n.crossJoin(F.broadcast(ends.select(lo.alias("lo"), scale.alias("scale"))))


query("m13_quantised", f"+{LIMITS} SELECT idx, CAST(least(greatest(round_even((x - lo) * scale, 0), 0), 65535) AS BIGINT) AS qx FROM nodes, lim")(lambda s, d: limits(s, d).select("idx", m.quantised(F.col("x"), F.col("lo"), F.col("scale")).alias("qx")))
query("m14_round_trip", f"+{LIMITS} SELECT idx, round(round_even((x - lo) * scale, 0) / scale + lo, 6) AS restored, abs(round_even((x - lo) * scale, 0) / scale + lo - x) <= 0.5000001 / scale AS close FROM nodes, lim")(
    lambda s, d: limits(s, d).withColumn("r", m.dequantised(m.quantised(F.col("x"), F.col("lo"), F.col("scale")), F.col("lo"), F.col("scale"))).select("idx", F.round("r", 6).alias("restored"), (F.abs(F.col("r") - F.col("x")) <= 0.5000001 / F.col("scale")).alias("close")))
query("m15_packed_bits", "SELECT idx // 8 AS byte, CAST(sum(CASE WHEN category = 1 THEN 1 << (7 - idx % 8) ELSE 0 END) AS BIGINT) AS value FROM nodes GROUP BY 1")(
    lambda s, d: N(s, d).groupBy(F.floor(F.col("idx") / 8).alias("byte")).agg(F.sum(F.when(F.col("category") == 1, F.expr("shiftleft(1, cast(7 - idx % 8 as int))")).otherwise(0)).alias("value")))
query("m16_title_offsets", "SELECT idx, strlen(title) AS n, CAST(sum(strlen(title)) OVER (ORDER BY idx) - strlen(title) AS BIGINT) AS start FROM nodes")(
    lambda s, d: N(s, d).withColumns({"n": F.octet_length("title").cast("long"), "r": F.floor(F.col("idx") / 4096)}).transform(prefix_sums))


def prefix_sums(rows):
    """Prefix sums by ranges of ids: a window over ranges' totals and one within each range."""
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("r").agg(F.sum("n").alias("t")).select("r", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("r").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(g.small(base), "r").select("idx", "n", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).cast("long").alias("start"))


query("m17_blend", "SELECT a.idx, round(0.25 * 0.4::DOUBLE * a.x + 0.75 * 0.4::DOUBLE * b.x + 0.25 * 0.6::DOUBLE * a.y + 0.75 * 0.6::DOUBLE * b.y, 6) AS x FROM nodes a JOIN nodes b ON b.idx = a.idx + 1")(
    lambda s, d: N(s, d).select("idx", "x", "y").join(N(s, d).select((F.col("idx") - 1).alias("idx"), F.col("x").alias("bx"), F.col("y").alias("by")), "idx").select("idx", F.round(m.blended(tuple(map(F.col, ("x", "bx", "y", "by"))), 0.75, 0.6), 6).alias("x")))
query("m18_bezier", """SELECT src, tgt, t, round((1 - t) * (1 - t) * x0 + 2 * (1 - t) * t * ((x0 + x1) / 2 - (y1 - y0) * 0.2 * sg) + t * t * x1, 9) AS bx FROM (SELECT src, tgt, a.x AS x0, b.x AS x1, a.y AS y0, b.y AS y1,
 CASE WHEN (a.x + b.x) / 2 * -(b.y - a.y) + (a.y + b.y) / 2 * (b.x - a.x) >= 0 THEN 1 ELSE -1 END AS sg FROM edges JOIN nodes a ON a.idx = src JOIN nodes b ON b.idx = tgt), (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) v(t)""")(
    lambda s, d: sp.segments(E(s, d), N(s, d)).withColumn("t", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))).select("src", "tgt", "t", F.round(m.bezier(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("t"), 0.2)[0], 9).alias("bx")))
query("m19_palette", "SELECT idx, round(idx * 0.6180339887498949::DOUBLE - floor(idx * 0.6180339887498949::DOUBLE), 9) AS hue, printf('#%02x%02x%02x', CAST(floor((idx % 256) * 0.5) AS BIGINT), CAST(floor((idx * 3 % 256) * 0.5) AS BIGINT), CAST(floor((idx * 7 % 256) * 0.5) AS BIGINT)) AS dim FROM nodes")(
    lambda s, d: N(s, d).select("idx", F.round(m.golden_hue(F.col("idx")), 9).alias("hue"), m.dimmed(F.format_string("#%02x%02x%02x", F.col("idx") % 256, F.col("idx") * 3 % 256, F.col("idx") * 7 % 256), 0.5).alias("dim")))
query("m20_screen", "SELECT idx, round((x - 10) * 8 + 300, 6) AS sx FROM nodes")(lambda s, d: N(s, d).select("idx", F.round(m.to_screen(F.col("x"), 10.0, 3.0, 600), 6).alias("sx")))
query("m21_unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS moment FROM embeddings", False)(
    lambda s, d: table(s, d, "embeddings").select("vec_id", m.unit(F.col("embedding").cast("array<double>")).alias("u")).select("vec_id", F.round(F.aggregate(F.transform("u", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("moment")))
query("m22_rgba", "SELECT idx, (idx % 256) | ((idx * 3 % 256) << 8) | ((idx * 7 % 256) << 16) | (CAST(255 AS BIGINT) << 24) AS c FROM nodes")(lambda s, d: N(s, d).select("idx", m.rgba(F.col("idx") % 256, F.col("idx") * 3 % 256, F.col("idx") * 7 % 256, F.lit(255)).alias("c")))


@query("j22_similarity", "SELECT b.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0", False)
def j22(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    topic = v.where("vec_id = 0").select(F.col("v").alias("q")).limit(1)
    return v.where("vec_id <> 0").crossJoin(F.broadcast(topic)).select("vec_id", F.round(m.dot(F.col("v"), F.col("q")), 6).alias("s"))


def band(s, d):
    r = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("s"), "vec_id"))
    return j22(s, d).orderBy(F.desc("s"), "vec_id").limit(60).withColumn("r", r).where("r > 2").select("vec_id", F.col("r").cast("long").alias("r"))


query("o8_similarity_band", "SELECT vec_id, r FROM (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM (SELECT b.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0)) WHERE r > 2 AND r <= 60", False)(band)


@query("g24_decoys", """+ h AS (SELECT b.tgt AS idx, count(*) AS ways FROM edges a JOIN edges b ON b.src = a.tgt WHERE a.src = 7 AND b.tgt <> 7 AND b.tgt NOT IN (SELECT tgt FROM edges WHERE src = 7) GROUP BY 1 ORDER BY ways DESC, idx LIMIT 600),
 c AS (SELECT h.idx, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS s FROM h JOIN nodes n ON n.idx = h.idx JOIN embeddings e ON e.vec_id = h.idx, embeddings q WHERE q.vec_id = 7 AND length(n.title) <= 24),
 r AS (SELECT idx, row_number() OVER (ORDER BY s DESC, idx) AS r, count(*) OVER () AS n FROM c) SELECT idx FROM r WHERE (r > 2 AND r <= 60) OR n < 20 ORDER BY r LIMIT 18""")
def g24(s, d):
    """Nodes two links from a topic with a fitting title, by similarity, the nearest two left out."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("v"))
    q = v.where("idx = 7").select(F.col("v").alias("q")).limit(1)
    c = g.two_hop(E(s, d), 7).join(N(s, d).where(F.length("title") <= 24).select("idx"), "idx").join(v, "idx").crossJoin(F.broadcast(q)).select("idx", F.round(m.dot(F.col("v"), F.col("q")), 6).alias("s"))
    r = F.row_number().over(Window.orderBy(F.desc("s"), "idx"))  # at most 600 rows
    ranked = c.withColumns({"r": r, "n": F.count("*").over(Window.partitionBy())})
    return ranked.where("(r > 2 and r <= 60) or n < 20").orderBy("r").limit(18).select("idx")


_PLACED = "CASE WHEN n.idx % 10 = 0 THEN n.{v} WHEN b.x IS NOT NULL THEN b.{v} + (6 + 39 * {u61}) * {f}(6.283185307179586::DOUBLE * {u62}) ELSE wide * (1 + 0.15::DOUBLE * {u63}) * {f}(6.283185307179586::DOUBLE * {u64}) END"
_START = {v: _PLACED.format(v=v, f=f, **{f"u{k}": sql_unit("n.idx", k) for k in (61, 62, 63, 64)}) for v, f in (("x", "cos"), ("y", "sin"))}


@query("g16_start_positions", f"+ w AS (SELECT 2.2::DOUBLE * sqrt(avg(x * x + y * y)) AS wide FROM nodes WHERE idx % 10 = 0) SELECT n.idx, round({_START['x']}, 5) AS x, round({_START['y']}, 5) AS y FROM nodes n CROSS JOIN w LEFT JOIN nodes b ON b.idx = n.idx - n.idx % 10 AND n.idx % 10 < 7")
def g16(s, d):
    """Every tenth node is placed; the six behind it have it as their gateway, the last three none."""
    n = N(s, d).select("idx", "x", "y")
    gateways = n.where("idx % 10 between 1 and 6").select("idx", (F.col("idx") - F.col("idx") % 10).alias("gateway"))
    return layout.start_positions(n, n.where("idx % 10 = 0"), gateways).select("idx", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


query("g17_orphan_ring", f"+ o AS (SELECT idx FROM nodes WHERE idx NOT IN (SELECT tgt FROM edges WHERE cnt > 1)), e AS (SELECT quantile_cont(sqrt(x * x + y * y), 0.97) AS e FROM nodes WHERE idx IN (SELECT tgt FROM edges WHERE cnt > 1)) SELECT idx, round(e * (1 + 0.15::DOUBLE * {sql_unit('idx', 6)}), 5) AS r, round(2 * pi() * {sql_unit('idx', 7)}, 7) AS a FROM o, e")(
    lambda s, d: sp.orphan_ring(N(s, d).select("idx", "x", "y"), E(s, d).where("cnt > 1").select(F.col("tgt").alias("idx")).distinct()).select("idx", F.round("r", 5).alias("r"), F.round("a", 7).alias("a")))
query("g23_ring_pull", f"SELECT idx, round(CASE WHEN r > 0.94::DOUBLE * 240 THEN 0.62::DOUBLE * 240 - ln({sql_unit('idx', 9)}) * 12 ELSE r END, 6) AS r FROM (SELECT idx, sqrt(x * x + y * y) AS r FROM nodes)")(lambda s, d: N(s, d).select("idx", F.round(m.ring_pull(F.hypot("x", "y"), F.col("idx"), 240.0), 6).alias("r")))
query("r1_crawl_step", "SELECT DISTINCT tgt AS idx FROM edges WHERE src IN (SELECT idx FROM nodes WHERE views > 0 ORDER BY views DESC, idx LIMIT 20) AND tgt NOT IN (SELECT idx FROM nodes ORDER BY views DESC, idx LIMIT 40)")(
    lambda s, d: ev.crawl_step(N(s, d).where("views > 0").orderBy(F.desc("views"), "idx").limit(20).select("idx"), E(s, d), N(s, d).orderBy(F.desc("views"), "idx").limit(40).select("idx")))
query("r4_evictions", """SELECT event_id, EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR AND (b.event_type = a.event_type OR b.value > a.value)) AS evicted FROM events a""", False)(lambda s, d: ev.evictions(table(s, d, "events")))
_GONE = "EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR AND (b.event_type = a.event_type OR b.value > a.value))"
query("a24b_latency_by_priority", f"SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS evicted, round(sum(value) FILTER (NOT gone), 4) AS total, max(value) FILTER (NOT gone) AS most, round(median(value) FILTER (NOT gone), 6) AS mid FROM (SELECT *, {_GONE} AS gone FROM events a) GROUP BY 1", False)(
    lambda s, d: ev.latency_stats(table(s, d, "events"))[0].withColumns({"total": F.round("total", 4), "mid": F.round("mid", 6)}))
query("a24c_request_log", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500", False)(lambda s, d: ev.latency_stats(table(s, d, "events"))[1].select("event_id", "value"))
query("r8_event_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2", False)(lambda s, d: ev.daily_counts(table(s, d, "events")))
query("t22_title_forms", "SELECT idx, length(title) AS n, lower(title) AS low, regexp_matches(title, '[0-9]') AS digits FROM nodes")(lambda s, d: N(s, d).select("idx", F.length("title").alias("n"), F.lower("title").alias("low"), F.col("title").rlike("[0-9]").alias("digits")))
query("t3_capitalised", "SELECT idx, upper(substr(title, 1, 1)) || substr(title, 2) AS t FROM nodes")(lambda s, d: N(s, d).select("idx", t.capitalised(F.col("title")).alias("t")))
