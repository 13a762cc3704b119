"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.operators import graph

from . import fixtures, graph_queries, spatial_queries, text_queries

_MODULES = (graph_queries, text_queries, spatial_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = fixtures.nodes(spark, sf_dir), fixtures.edges(spark, sf_dir)
    deg = graph.degrees(nodes, links)
    return deg.join(graph.strongest_neighbour(deg, links), "idx", "left").join(graph.adjacency(links), "idx", "left")
