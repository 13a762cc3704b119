"""Mixing sources to target weights by entropy balancing.

The rates r of documents minimise sum size * (r log r - r) subject to one token constraint a source, sum size * r =
target. Their dual is convex and smooth, with one variable a source, and the solution is an exponential tilt,
r = exp(lambda[source]). Newton's step on the dual needs the gradient and Hessian, which are sums over documents; every
iteration takes them from a table of partial sums by source and salt, aggregated once, so a source with a third of all
rows is summed by all tasks. Rates are then rounded into copies: everyone takes the whole part, and a document takes
one copy more if its hash lies under its source's threshold, which two histograms of hashes set so that the words taken
stay just under the target; ever shorter documents above it fill the rest by further thresholds, found alike. What then is left goes to the one
document with room whose size is nearest to it, if that comes nearer to the target. Only DataFrame expressions run on the
executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch

#: Weights of sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: Most times that a document is taken.
MOST_COPIES = 3
#: Partial sums of one source are dealt out to so many rows.
SALTS = 32
#: Newton's iteration ends when every constraint holds to this relative error, or after so many steps.
TOLERANCE, MOST_STEPS = 1e-12, 60
#: Documents of at most so many words fill what the thresholds before have left.
FILLERS = (2048, 256, 32)
#: Bins of the hash histograms; two rounds tell 2**24 thresholds apart.
BINS = 4096


def words_in(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes: (source, source_size). Returns source, source_size, target.

    Weights follow the sources' code-point order, null last. A target of weight * t is cut at most * size, t being such
    that all targets sum to all sizes: sources sorted by most * size / weight are cut up to the first that stays under
    the level left to it. That level rises while sources are cut and falls after, so t is the largest."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    one = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(most))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    one = (
        one.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.col("left") / F.col("weights"))
        .withColumn("t", F.max("level").over(everything))
    )
    return one.select("source", "source_size", F.least("cap", F.col("weight") * F.col("t")).alias("target"))


def balance(sums: DataFrame, scratch: Scratch) -> DataFrame:
    """sums: (source, salt, size, target). Returns source, rate: Newton's iteration on the dual by aggregates over the
    partial sums. A source without words has rate 1; one whose target is 0, 0."""
    state = scratch.save(sums.groupBy("source").agg(F.lit(0.0).alias("tilt")))
    for _ in range(MOST_STEPS):
        moments = (
            sums.join(state.select(F.col("source").alias("s"), "tilt"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source", "tilt", "target").agg(F.sum(F.col("size") * F.exp("tilt")).alias("hessian"))
            .withColumn("gradient", F.col("target") - F.col("hessian"))
        )
        # a step of the Newton direction, cut to stay where the quadratic model holds
        step = F.when((F.col("hessian") > 0) & (F.col("target") > 0), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("gradient") / F.col("hessian")))).otherwise(0.0)
        new = scratch.save(moments.select("source", (F.col("tilt") + step).alias("tilt"), F.when((F.col("hessian") > 0) & (F.col("target") > 0), F.abs("gradient") / F.col("target")).otherwise(0.0).alias("error")))
        scratch.drop(state)
        off = new.agg(F.max("error")).first()[0]
        state = new.drop("error")
        state._linkloom_path = new._linkloom_path
        if off is None or off < TOLERANCE:
            break
    else:
        raise ArithmeticError(f"constraints are still off by {off} after {MOST_STEPS} steps")
    empty = sums.groupBy("source").agg((F.max("target") <= 0).alias("none"), F.sum("size").alias("size"))
    return (
        empty.join(state.select(F.col("source").alias("s"), "tilt"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", F.when(F.col("size") == 0, 1.0).when(F.col("none"), 0.0).otherwise(F.exp("tilt")).alias("rate"))
    )


def threshold(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """docs: (source, size, u) with u in [0, BINS**2); targets: (source, need). Returns source, cut, left: those under
    cut sum to need - left, the most that does not pass the need.

    One histogram finds the bin in which the sum passes the need, a second the place within it."""
    pre = Window.partitionBy("source").orderBy("bin")

    def crossing(hist: DataFrame, need: DataFrame) -> DataFrame:
        run = hist.withColumn("upto", F.sum("size").over(pre)).withColumn("under", F.col("upto") - F.col("size"))
        with_need = run.join(need.select(F.col("source").alias("s"), "need"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        return with_need.where("under <= need and upto > need")

    coarse = docs.groupBy("source", F.floor(F.col("u") / BINS).alias("bin")).agg(F.sum("size").alias("size"))
    first = crossing(coarse, targets).select("source", F.col("bin").alias("coarse"), (F.col("need") - F.col("under")).alias("need"))
    inside = docs.join(first.select(F.col("source").alias("s"), "coarse"), F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("u") / BINS) == F.col("coarse")))
    fine = inside.groupBy("source", F.col("u").alias("bin")).agg(F.sum("size").alias("size"))
    last = crossing(fine, first).select("source", F.col("bin").alias("cut"), (F.col("need") - F.col("under")).alias("left"))
    # a need that all together do not pass takes all, and what they lack is left
    total = coarse.groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("total"))
    got = targets.select("source", F.col("need").alias("all_need")).join(total, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").join(last.select(F.col("source").alias("s"), "cut", "left"), F.col("source").eqNullSafe(F.col("s")), "left")
    everyone = F.when(F.col("all_need") > 0, F.lit(BINS * BINS)).otherwise(F.lit(0))
    return got.select("source", F.coalesce("cut", everyone).alias("cut"), F.coalesce("left", F.greatest(F.col("all_need") - F.coalesce("total", F.lit(0)), F.lit(0.0))).alias("left"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs: (doc_id, text, source). Returns doc_id, size, source_size, target, rate, copies, taken, and the columns in
    keep, one row per row of docs.

    Null text has size 0; such documents, having no words, get copies by the same rule and take 0 words. Null is a
    source of its own, last in order. Repeated rows hash alike and are taken alike. No rows: no rows. A column in keep that is
    named like a result is an error. taken = copies *
    size, and copies is at most `most`. Hashes depend on doc_id and source alone, so reruns agree. The tables of
    sources are as long as there are sources; rows that carry them to the documents are joined, not collected."""
    if clash := {"doc_id", "size", "source_size", "target", "taken", "rate", "copies"} & {c.lower() for c in keep}:
        raise ValueError(f"results have columns of these names already: {', '.join(sorted(clash))}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    hashed = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "source"), F.lit(BINS * BINS))
    sized = scratch.save(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), hashed.alias("u")))
    partial = scratch.save(sized.groupBy("source", (F.col("u") % SALTS).alias("salt")).agg(F.sum("size").alias("size")))
    targets = scratch.save(source_targets(partial.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    of = targets.select(F.col("source").alias("s"), "target", "source_size")
    same = F.col("source").eqNullSafe(F.col("s"))
    rates = scratch.save(balance(partial.join(of, same).drop("s", "source_size"), scratch))
    # the last bits of a rate that is a whole number are rounding
    exact = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate"))
    whole = targets.join(rates.select(F.col("source").alias("s"), exact.alias("rate")), same).drop("s").withColumn("whole", F.least(F.floor("rate"), F.lit(most)))
    need = whole.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"))
    cuts = scratch.save(threshold(sized.select("source", "size", "u"), need))
    plan = whole.join(cuts.select(F.col("source").alias("s"), F.col("cut").alias("c0")), same).drop("s")
    more = F.col("u") < F.col("c0")
    for k, filler in enumerate(FILLERS, 1):
        above = sized.where(F.col("size").between(1, filler)).join(cuts.select(F.col("source").alias("s"), "cut"), same & (F.col("u") > F.col("cut")))
        fills = threshold(above.select("source", "size", "u"), cuts.select("source", F.col("left").alias("need")))
        # where nothing was left, the threshold stays where it was
        held = cuts.select(F.col("source").alias("s"), F.col("cut").alias("was"))
        cuts = scratch.save(fills.join(held, same).select("source", F.greatest("cut", "was").alias("cut"), "left"))
        plan = plan.join(cuts.select(F.col("source").alias("s"), F.col("cut").alias(f"c{k}")), same).drop("s")
        more = more | ((F.col("u") > F.col(f"c{k - 1}")) & (F.col("u") < F.col(f"c{k}")) & F.col("size").between(1, filler))
    plan = plan.join(cuts.select(F.col("source").alias("s"), F.col("left")), same).drop("s")
    plan = scratch.save(plan.withColumnRenamed("source", "s"))
    copies = F.least(F.col("whole") + F.when(more, 1).otherwise(0), F.lit(most))
    # one more document of each source, if that is nearer: repeated rows, which hash alike, count together
    room = sized.join(plan, same).where((copies < most) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("left")))
    nearest = room.groupBy("source", "left").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), copies.alias("copies"), "u", "size")).alias("at"))
    last = nearest.select(F.col("source").alias("s"), "left", F.col("at.u").alias("last_u"), F.col("at.size").alias("last_size"))
    of_last = (F.col("u") == F.col("last_u")) & (F.col("size") == F.col("last_size"))
    together = sized.join(last, same & of_last).groupBy("source", "left", "last_u", "last_size").agg(F.sum("size").alias("all"))
    together = together.where(F.abs(F.col("all") - F.col("left")) < F.col("left")).select(F.col("source").alias("last_s"), "last_u", "last_size")
    plan = scratch.save(plan.join(together, F.col("s").eqNullSafe(F.col("last_s")), "left").drop("last_s", "left"))
    copies = F.least(copies + F.when(of_last, 1).otherwise(0), F.lit(most))
    base = sized if not keep else docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), hashed.alias("u"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    return (
        base.join(plan, same).withColumn("copies", copies.cast("int"))
        .select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rate", "copies", *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])
    )
