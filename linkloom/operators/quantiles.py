"""Exact quantiles of columns of any length, by group, with bounded buffers.

A mergeable sketch (KLL) of the values brackets each quantile; one pass counts what lies below and inside the bracket and
sketches the inside again, so that every pass leaves about a hundredth, until the bracket holds few distinct values. Only
those are then sorted, with their counts, and the quantile read off. A sketch that erred is found out by the counts, and
its bracket is made wider; so the result never depends on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.operators import graph as g

#: Distinct values of a bracket that are sorted; items that a sketch keeps about; its error of rank, first taken; steps of
#: rank at which it is asked.
MOST_VALUES, SKETCH_K, ERROR, GRID = 20_000, 800, 0.005, 256


def _sketch(v: Column) -> Column:
    return F.kll_sketch_agg_double(v, F.lit(SKETCH_K))


def quantile_table(rows: DataFrame, wanted: dict[str, tuple[str, float]], by: list[str]) -> DataFrame:
    """rows: (by..., columns). (by..., name, quantile) for each group and each name of wanted, which gives a column and a
    q in 0 to 1; between two values the quantile is linear. Nulls and NaN do not count; a group without values is left
    out. Values are doubles; groups may be null."""
    for c, q in wanted.values():
        if not 0 <= q <= 1:
            raise ValueError(f"quantile {q} of {c}")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q"), F.col(c).cast("double").alias("v")) for n, (c, q) in wanted.items()]))
    long = rows.select(F.struct(*by, F.lit(0).alias("_")).alias("grp"), each.alias("x")).select(F.struct("grp", "x.name").alias("k"), "x.q", "x.v").where("v is not null and not isnan(v)")
    at = F.col("q") * (F.col("n") - 1)
    state = long.groupBy("k", "q").agg(_sketch(F.col("v")).alias("s"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.approx_count_distinct("v").alias("distinct"))
    state = g.reliable(state.select("k", "s", "lo", "hi", "distinct", at.alias("at"), F.col("n").alias("inside"), F.lit(0).cast("long").alias("below"), F.lit(ERROR).alias("error")))
    rank = lambda r, to: (r - F.col("below")) / F.col("inside") + to * F.col("error")
    while True:
        is_open = (F.col("distinct") > MOST_VALUES) & (F.col("lo") < F.col("hi"))
        todo = state.where(is_open)
        if todo.isEmpty():
            break
        r0, r1 = rank(F.floor("at"), -1), rank(F.ceil("at") + 1, 1)
        of = lambda place: F.get("grid", place.cast("int"))
        tried = todo.withColumn("grid", F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])))
        tried = tried.withColumn("to_lo", F.when(r0 <= 0, F.col("lo")).otherwise(of(F.floor(r0 * GRID)))).withColumn("to_hi", F.when(r1 >= 1, F.col("hi")).otherwise(of(F.ceil(r1 * GRID))))
        inner = F.col("v").between(F.col("to_lo"), F.col("to_hi"))
        met = long.drop("q").join(g.small(tried.select("k", "lo", "hi", "to_lo", "to_hi")), "k").where("v between lo and hi")
        found = met.groupBy("k").agg(F.count_if(F.col("v") < F.col("to_lo")).alias("less"), F.count_if(inner).alias("in"), _sketch(F.when(inner, F.col("v"))).alias("s2"), F.approx_count_distinct(F.when(inner, F.col("v"))).alias("d2"))
        both = tried.join(found, "k")
        right = (F.col("below") + F.col("less") <= F.floor("at")) & (F.ceil("at") < F.col("below") + F.col("less") + F.col("in"))
        pick = lambda yes, no: F.when(right, yes).otherwise(no)
        new = both.select(
            "k", pick(F.col("s2"), F.col("s")).alias("s"), pick(F.col("to_lo"), F.col("lo")).alias("lo"), pick(F.col("to_hi"), F.col("hi")).alias("hi"), pick(F.col("d2"), F.col("distinct")).alias("distinct"), "at",
            pick(F.col("in"), F.col("inside")).alias("inside"), (F.col("below") + pick(F.col("less"), F.lit(0))).alias("below"), pick(F.lit(ERROR), F.col("error") * 4).alias("error"),
        )
        new = g.reliable(state.where(~is_open).unionByName(new))
        g.drop(state)
        state = new
    left = long.drop("q").join(g.small(state.select("k", "lo", "hi", "at", "below")), "k").where("v between lo and hi")
    counts = left.groupBy("k", "at", "below", "v").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("k").orderBy("v")))
    value = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    ends = upto.groupBy("k", "at").agg(value(F.floor("at")).alias("a"), value(F.ceil("at")).alias("b"))
    between = F.col("a") + F.when(F.col("a") == F.col("b"), 0.0).otherwise((F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    return ends.select(*[F.col(f"k.grp.{c}").alias(c) for c in by], F.col("k.name").alias("name"), between.alias("quantile"))


def quantiles(rows: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a column for each name of wanted (see quantile_table); null where a column has no values."""
    found = quantile_table(rows, wanted, [])
    return found.agg(*[F.max(F.when(F.col("name") == n, F.col("quantile"))).alias(n) for n in wanted])


def with_quantile(groups: DataFrame, rows: DataFrame, by: list[str], column: str, q: float, name: str) -> DataFrame:
    """groups (by..., ...) with one more column: the quantile of a column of rows in each group, null without values."""
    found = quantile_table(rows, {name: (column, q)}, by).select(F.struct(*by).alias("_k"), F.col("quantile").alias(name))
    return groups.withColumn("_k", F.struct(*by)).join(found, "_k", "left").drop("_k")
