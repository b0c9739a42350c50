"""Graph-to-graph transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.model import Graph, symmetric
from netloom.operators.measures import labels
from netloom.plans.ordering import with_rank
from netloom.session import materialize


def clone_topology(graph: Graph, payload: Column) -> Graph:
    """The same edges; payload mapped by an expression over graph_id, id and payload."""
    return Graph(graph.vertices.select("graph_id", "id", payload.alias("payload")), graph.topology())


def cloned_subgraph(graph: Graph, ids: DataFrame) -> Graph | None:
    """The subgraph that (graph_id, id) rows induce, re-indexed by rank; None if there is no row or one is out of range."""
    want = ids.select("graph_id", "id").distinct()
    if not want.limit(1).count() or want.join(graph.vertices, ["graph_id", "id"], "left_anti").limit(1).count():
        return None
    index = materialize(with_rank(want, "id", out="new"))
    v = graph.vertices.join(index, ["graph_id", "id"]).drop("id").withColumnRenamed("new", "id")
    ends = lambda c: index.select("graph_id", F.col("id").alias(c), F.col("new").alias(f"{c}_new"))
    e = graph.topology().join(ends("src"), ["graph_id", "src"]).join(ends("dst"), ["graph_id", "dst"])
    return Graph(v, e.select("graph_id", F.col("src_new").alias("src"), F.col("dst_new").alias("dst")))


def chain_components(graph: Graph, in_tasks: bool = False) -> DataFrame:
    """(graph_id, src, dst): an edge from the least vertex of each component to that of the next."""
    firsts = with_rank(labels(graph, in_tasks).where("id = label").select("graph_id", "id"), "id")
    later = firsts.select("graph_id", (F.col("rank") - 1).alias("rank"), F.col("id").alias("dst"))
    return firsts.withColumnRenamed("id", "src").join(later, ["graph_id", "rank"]).select("graph_id", "src", "dst")


def make_connected(graph: Graph) -> Graph:
    return graph.with_edges(graph.edges.unionByName(symmetric(chain_components(graph)), allowMissingColumns=True))
