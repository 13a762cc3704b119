"""Look-ups over articles: by title, by number, by prefix, by words, by link; what is incomplete; routes by method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import maths
from linkloom.functions import text as t
from linkloom.operators import graph as g


def lookup_nodes(nodes: DataFrame, titles: list[str] | None = None, idxs: list[int] | None = None) -> DataFrame:
    """Nodes of any of the titles or numbers."""
    wanted = F.lit(False)
    if titles:
        wanted = wanted | F.col("title").isin(*titles)
    if idxs:
        wanted = wanted | F.col("idx").isin(*idxs)
    return nodes.where(wanted)


def prefix_search(nodes: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """Nodes whose title begins so in any case, in order of title."""
    return nodes.where(F.lower("title").startswith(prefix.lower())).orderBy(F.lower("title"), "idx").limit(limit)


def cased_prefix_search(nodes: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """Titles between a prefix and its end in lower and in upper case: two ranges that a sorted table can prune."""
    def between(p: str) -> DataFrame:
        return nodes.where((F.col("title") >= p) & (F.col("title") < p[:-1] + chr(ord(p[-1]) + 1))).orderBy("title").limit(limit)

    low, high = prefix[:1].lower() + prefix[1:], prefix[:1].upper() + prefix[1:]
    return between(low).union(between(high)).distinct().orderBy("title").limit(limit)


def token_search(nodes: DataFrame, query: str, limit: int = 10, title: str = "title") -> DataFrame:
    """Nodes with, for each word of the query, a word of the title that begins with it."""
    begins = lambda word: F.exists(t.tokens(F.col(title)), lambda x: x.startswith(word))
    out = nodes
    for word in query.lower().split():
        out = out.where(begins(word))
    return out.orderBy("idx").limit(limit)


def connections(links: DataFrame, idx: int, per_side: int = 20) -> DataFrame:
    """(kind, nbr): the first out- and in-links of a node."""
    out = links.where(F.col("src") == idx).orderBy("tgt").limit(per_side).select(F.lit("out").alias("kind"), F.col("tgt").alias("nbr"))
    return out.unionAll(links.where(F.col("tgt") == idx).orderBy("src").limit(per_side).select(F.lit("in").alias("kind"), F.col("src").alias("nbr")))


def is_missing(c: Column) -> Column:
    return c.isNull() | F.trim(c).isin("", "[]", "{}")


def incomplete_articles(articles: DataFrame, fields: tuple[str, ...] = ("snippet", "categories")) -> DataFrame:
    """Crawled articles that lack a snippet or categories (null, empty or an empty list)."""
    lacking = F.lit(False)
    for c in fields:
        lacking = lacking | is_missing(F.col(c))
    return articles.where(F.col("crawled") & lacking)


def repair_set(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """Crawled articles without link contexts; the first so many by id."""
    out = articles.where(F.col("crawled") & F.col("link_contexts").isNull())
    return out if limit is None else out.orderBy("id").limit(limit)


def shortest_path(links: DataFrame, src: int, dst: int, method: str = "bidirectional", nodes: DataFrame | None = None, max_depth: int = 100, seed: int = 0) -> DataFrame:
    """(pos, idx) of a route from src to dst, no rows where there is none. Methods: bfs, bidirectional, undirected,
    weighted (a hop costs more at nodes of many links), dfs, astar and greedy (by distance; nodes with x and y), walk."""
    spark = links.sparkSession
    if method == "bfs":
        return g.bfs_path(links, src, dst)
    if method in ("bidirectional", "undirected"):
        return g.bidirectional_path(links, src, dst, max_depth, method == "undirected")
    if method == "weighted":
        ends = links.select("src", "tgt").distinct()
        degree = ends.select(F.explode(F.array("src", "tgt")).alias("tgt")).groupBy("tgt").agg(F.count("*").alias("degree"))
        return g.cheapest_path(ends.join(degree, "tgt"), src, dst, maths.hop_cost(F.col("degree")))
    if method == "dfs":
        return g.path_frame(spark, g.DriverSearch(links).depth_first(src, dst))
    if method == "walk":
        return g.path_frame(spark, g.DriverSearch(links).random_walk(src, dst, seed))
    if method in ("astar", "greedy"):
        goal = nodes.where(F.col("idx") == dst).select("x", "y").first()
        if goal is None:
            return g.path_frame(spark, [])
        ends, places = links.select("src", "tgt").distinct(), nodes.select(F.col("idx").alias("tgt"), "x", "y").distinct()
        search = g.DriverSearch(ends.join(g.by_shuffle(places, "shuffle_hash"), "tgt"), at=("x", "y"))
        step = 1.0 if method == "astar" else 0.0
        return g.path_frame(spark, search.best_first(src, dst, lambda a, b: step, search.distance_to(goal.x, goal.y)))
    raise ValueError(f"no method {method!r}")
