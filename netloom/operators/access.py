"""Scans, projections, point reads and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.model import Graph
from netloom.plans.ordering import with_rank


def vertex_count(graph: Graph) -> DataFrame:
    return graph.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("vertex_count"))


def edge_count(graph: Graph) -> DataFrame:
    """Every graph has a row, also without edges."""
    counts = graph.canonical.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return graph.vertices.select("graph_id").distinct().join(counts, "graph_id", "left").select("graph_id", F.coalesce("edge_count", F.lit(0)).cast("long").alias("edge_count"))


def at(graph: Graph, index: int) -> DataFrame:
    """The payload of one vertex of each graph; no row if the index is out of range."""
    return graph.vertices.where(F.col("id") == index)


def adjacency(graph: Graph) -> DataFrame:
    """graph_id, id, adj: neighbours by adj_pos if the edges have it, else by index."""
    order = "adj_pos" if "adj_pos" in graph.edges.columns else "dst"
    lists = graph.edges.groupBy("graph_id", "src").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("p"), F.col("dst").alias("d")))), lambda x: x["d"]).alias("adj"))
    return lists.withColumnRenamed("src", "id")


def containers(graph: Graph) -> DataFrame:
    """Every vertex with its adjacency list (empty if isolated)."""
    return graph.vertices.join(adjacency(graph), ["graph_id", "id"], "left").withColumn("adj", F.coalesce("adj", F.array().cast("array<bigint>")))


def container(graph: Graph, index: int) -> DataFrame:
    """One vertex with its adjacency; the filter reaches both sides before the lists are built."""
    part = Graph(graph.vertices.where(F.col("id") == index), graph.edges.where(F.col("src") == index))
    return containers(part)


def neighbors(graph: Graph, index: int) -> DataFrame:
    return graph.edges.where(F.col("src") == index).select("graph_id", "dst")


def raw_edges(graph: Graph, index: int) -> DataFrame:
    """Half-edges of one vertex with all their columns."""
    return graph.edges.where(F.col("src") == index)


def neighbor_vertices(graph: Graph, index: int) -> DataFrame:
    """The neighbours of one vertex as vertices."""
    return graph.vertices.join(neighbors(graph, index).withColumnRenamed("dst", "id"), ["graph_id", "id"], "left_semi")


def payloads(graph: Graph) -> DataFrame:
    return graph.vertices.select("graph_id", "payload.*")


def adj_first(graph: Graph) -> DataFrame:
    """The first entry of each non-empty adjacency list."""
    order = "adj_pos" if "adj_pos" in graph.edges.columns else "dst"
    return graph.edges.groupBy("graph_id", F.col("src").alias("id")).agg(F.min_by("dst", order).alias("first"))


def is_adjacent(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(graph_id, src, dst) with a flag."""
    there = graph.topology().withColumn("_t", F.lit(True))
    return pairs.join(there, ["graph_id", "src", "dst"], "left").select("graph_id", "src", "dst", F.coalesce("_t", F.lit(False)).alias("is_adjacent"))


def degrees(graph: Graph) -> DataFrame:
    """graph_id, id, degree of every vertex, zeros kept. Counting before the join shuffles one row a vertex."""
    counts = graph.edges.groupBy("graph_id", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_d"))
    return graph.vertices.select("graph_id", "id").join(counts, ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("_d", F.lit(0)).cast("long").alias("degree"))


def degree(graph: Graph, index: int) -> DataFrame:
    part = Graph(graph.vertices.where(F.col("id") == index), graph.edges.where(F.col("src") == index))
    return degrees(part)


def sw_count_root(edges: DataFrame) -> DataFrame:
    """Root half-edges at each vertex that has an edge."""
    return edges.groupBy("graph_id", F.col("src").alias("id")).agg(F.count_if(F.col("orig_dst").isNotNull()).alias("roots"))


def sw_edge_predicates(edges: DataFrame) -> DataFrame:
    """is_root, is_at_root and is_long_ranging of every half-edge."""
    return edges.select(
        "graph_id", "src", "dst", F.col("orig_dst").isNotNull().alias("is_root"), F.col("orig_dst").eqNullSafe(F.col("dst")).alias("is_at_root"), F.coalesce(F.col("orig_dst") != F.col("dst"), F.lit(False)).alias("is_long_ranging")
    )


def nth(frame: DataFrame, n: int, *order: str) -> DataFrame:
    """The n-th row (from 0) of each graph's rows in an order; negative n counts from the end."""
    cols = [F.col(c).desc() if n < 0 else F.col(c) for c in order]
    return with_rank(frame, *cols, out="_k").where(F.col("_k") == (-n - 1 if n < 0 else n)).drop("_k")
