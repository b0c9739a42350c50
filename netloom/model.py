"""The graph data model: vertices and symmetric edges, keyed by graph_id.

vertices: graph_id BIGINT, id BIGINT (dense from 0), payload STRUCT, further columns
edges:    graph_id BIGINT, src BIGINT, dst BIGINT, further columns; both directions are stored,
          so that every expansion is one equi-join on (graph_id, src)

Graphs are undirected and simple. A Graph is immutable; mutations return a new one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.session import materialize


class GraphError(ValueError):
    """An argument that no graph operation can accept."""


class EdgeExists(GraphError):
    pass


class EdgeDoesNotExist(GraphError):
    pass


def symmetric(canonical: DataFrame) -> DataFrame:
    """Both directions of rows that hold one direction, other columns kept."""
    flipped = canonical.withColumnsRenamed({"src": "_s"}).withColumnRenamed("dst", "src").withColumnRenamed("_s", "dst")
    return canonical.unionByName(flipped)


@dataclass(frozen=True)
class Graph:
    """One graph or many, told apart by graph_id."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def of(spark: SparkSession, n: int, pairs, graph_id: int = 0, payload: Column | None = None) -> Graph:
        """From a vertex count and (i, j) pairs; duplicates and self loops are refused."""
        seen = set()
        for i, j in pairs:
            if not (0 <= i < n and 0 <= j < n):
                raise IndexError(f"edge {i}-{j} outside 0..{n - 1}")
            if i == j:
                raise GraphError(f"self loop at {i}")
            key = (min(i, j), max(i, j))
            if key in seen:
                raise EdgeExists(f"edge {i}-{j}")
            seen.add(key)
        v = spark.range(n).select(F.lit(graph_id).cast("long").alias("graph_id"), "id")
        if payload is not None:
            v = v.withColumn("payload", payload)
        rows = [(graph_id, i, j, k) for k, (i, j) in enumerate(pairs)]
        e = spark.createDataFrame(rows, "graph_id long, src long, dst long, adj_pos long")
        return Graph(v, symmetric(e))

    @property
    def canonical(self) -> DataFrame:
        """One row for each undirected edge, src < dst."""
        return self.edges.where("src < dst")

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def with_vertices(self, vertices: DataFrame) -> Graph:
        return replace(self, vertices=vertices)

    def materialized(self) -> Graph:
        """Both tables written to the shared folder, for graphs that several measures read."""
        return Graph(materialize(self.vertices), materialize(self.edges))

    def topology(self) -> DataFrame:
        return self.edges.select("graph_id", "src", "dst")

    def __getattr__(self, name: str):
        """Every operator that takes a graph first is also a method."""
        from netloom import api

        if name.startswith("_") or name not in api.METHODS:
            raise AttributeError(name)
        f = api.METHODS[name]
        return lambda *args, **kwargs: f(self, *args, **kwargs)
