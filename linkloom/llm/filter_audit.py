"""How filters interact: survivors, removals and fair shares for every order in which the filters may be applied.

A document's failures are a mask of filters. For one part of the corpus, let x_i in [0, 1] say how far filter i is
applied; the number removed is the multilinear polynomial R(x) = sum over masks of count * (1 - prod over the mask of
(1 - x_i)). At a corner, where the filters of a set are applied and the others are not, R is the number that the set
removes, so corners give survivors for every order. The mean of filter i's removals over all orders, its Shapley value,
is the integral over t from 0 to 1 of dR/dx_i at x = (t, ..., t). Coefficients are whole numbers, integrals exact
rationals; times the number of orders they are whole again.

Documents are read once, to a mask and a hash of the text; what goes on is a table of mask counts, at most
2 ** filters * 4 rows a part."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def standard_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter, each of the text alone: A too few words, B too few distinct words, C too many
    capitals, D holds markup signs."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    n = F.size(words)
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)) * 100 < n * 80,
        "C": capitals * 100 > F.length(text) * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, bit k for the k-th filter, the last bit for a
    text that a smaller doc_id has too.

    Filters see the text (null: empty); `part` is a column of docs (null: empty). A document is good or toxic if any row
    of labels with its doc_id says so; rows of labels without documents count nowhere. Repeated rows count each; a null
    doc_id is smaller than none and larger than every other. Texts are told apart by SHA-256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    filters = standard_filters(text) if filters is None else filters
    bits = F.lit(0)
    for k, failed in enumerate(filters.values()):
        bits = bits + F.when(failed, 1 << k).otherwise(0)
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("same"))
    judged = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    kind = ["same", "part", "mask", "good", "toxic"]
    # rows of one doc_id lie together after the join, so this count takes no exchange of its own
    once = seen.join(judged, "doc_id", "left").fillna(0, ["good", "toxic"]).groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    least = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n")
    texts = once.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(least).alias("least"))
    first = F.min(F.struct("least.last", "least.doc_id"))
    group = F.struct("part", "mask", "good", "toxic", "n", "least")
    # all of one text share its mask: at most a few kinds of rows each, one for each part and judgement
    each = texts.groupBy("same").agg(F.collect_list(group).alias("groups"), first.alias("first"))
    rows = each.select("first", F.explode("groups").alias("g")).select(
        "g.*", F.when((F.col("g.least.last") == F.col("first.last")) & F.col("g.least.doc_id").eqNullSafe(F.col("first.doc_id")), F.col("g.least.n")).otherwise(0).alias("firsts")
    )
    top = 1 << len(filters)
    dealt = rows.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + top).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))).alias("x"))
    n = F.col("x.n")
    return dealt.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


class Removal:
    """The removal polynomial of mask counts: coef[s] of the product of x_i over the filters in s."""

    def __init__(self, counts: np.ndarray):
        """1 - prod (1 - x_i) = sum over non-empty s within the mask of (-1) ** (|s| + 1) prod x_i: sums over supersets."""
        self.k = len(counts).bit_length() - 1
        above = [int(c) for c in counts]
        for i in range(self.k):
            for s in range(len(above)):
                if not s >> i & 1:
                    above[s] += above[s | 1 << i]
        self.coef = [0] + [above[s] * (1 if s.bit_count() % 2 else -1) for s in range(1, len(above))]

    def corner(self, applied: int) -> int:
        """Documents that the filters in applied remove."""
        return sum(c for s, c in enumerate(self.coef) if s & ~applied == 0)

    def shares(self) -> list[int]:
        """For each filter k! times its Shapley value: the partial derivative along the diagonal has coef[s] t ** (|s| - 1)
        for each s with the filter, of integral coef[s] / |s|."""
        whole = [Fraction(factorial(self.k)) * sum((Fraction(c, s.bit_count()) for s, c in enumerate(self.coef) if s >> i & 1), Fraction(0)) for i in range(self.k)]
        if any(x.denominator != 1 for x in whole):
            raise ArithmeticError("a share is no multiple of 1 / k!")
        return [int(x) for x in whole]


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def orders_of(letters: str):
    """Over one row a part with its counts by mask (arrays n, good, toxic): a row for each order and step."""
    k = len(letters)
    orders = list(permutations(range(k)))
    names = ["".join(letters[i] for i in o) for o in orders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                counts = {c: np.zeros(1 << k, np.int64) for c in ("n", "good", "toxic")}
                for x in row["masks"]:
                    for c in counts:
                        counts[c][x["mask"]] = x[c]
                poly = {c: Removal(v) for c, v in counts.items()}
                gone = {c: [p.corner(s) for s in range(1 << k)] for c, p in poly.items()}
                fails = [gone["n"][1 << i] for i in range(k)]
                alone = [int(counts["n"][1 << i]) for i in range(k)]
                shares, total = poly["n"].shares(), int(counts["n"].sum())
                out = {c: [] for c in ("step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
                for o in orders:
                    before = 0
                    for at, i in enumerate(o):
                        now = before | 1 << i
                        removed = gone["n"][now] - gone["n"][before]
                        for c, v in (("step", at + 1), ("kept", total - gone["n"][now]), ("removed", removed), ("redundant", fails[i] - removed), ("unique_fails", alone[i]), ("good_lost", gone["good"][now] - gone["good"][before]), ("toxic_lost", gone["toxic"][now] - gone["toxic"][before]), ("shapley", shares[i])):
                            out[c].append(v)
                        before = now
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(out["step"]), pa.string()), pa.array([n for n in names for _ in range(k)], pa.string()), *[pa.array(v, pa.int32() if c == "step" else pa.int64()) for c, v in out.items()]],
                    ["part", "filter_order", *out],
                )

    return run


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeats: str = "E", part: str = "lang") -> DataFrame:
    """docs: (doc_id, text, part column); labels: (doc_id, quality, toxic). For each part, order of the filters and step:
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, and shapley, the step's filter's removals over all
    orders.

    filters: failure conditions by letter over the column text, with nulls read as empty; the filter `repeats` is added,
    failed by texts that a smaller doc_id has too, wherever that is. Null and empty texts are equal; null and empty
    parts are one; see mask_counts for ties. Extra columns are ignored. No documents: no rows. Filters may be any whose
    orders are few (up to 7)."""
    letters = "".join(filters or standard_filters(F.col("text"))) + repeats
    if len(letters) > 7:
        raise ValueError(f"{len(letters)} filters have {factorial(len(letters))} orders; 7 at most")
    by_part = mask_counts(docs, labels, filters, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return by_part.mapInArrow(orders_of(letters), OUT)
