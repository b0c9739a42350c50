"""Traversals: level-synchronous breadth-first search over tables, and stack orders inside a group.

A search keeps (graph_id, source, id) of every level for every source at once.
Each round joins only the newest level with the edges. Edges go both ways, so
what a level reaches lies in the level before it, in itself or in the next one:
an anti-join against two levels is enough, and a round costs as much as its
level. Levels are tables in one folder of the shared ones, read back as one.

A search from all vertices runs in tasks that share out the sources (see
``searches``): its pairs are too many to be carried from round to round.

``in_tasks`` runs one task for each graph instead (see ``small``): the same
rows, and faster for many small graphs, but a graph has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.model import Graph
from netloom.operators import searches, small
from netloom.plans.ordering import with_rank
from netloom.session import Levels

VISIT = ["graph_id", "source", "id"]


def multi_source_bfs(graph: Graph, sources: DataFrame, limit: int | None = None, in_tasks: bool = False) -> DataFrame:
    """graph_id, source, id, depth of everything that each (graph_id, source) reaches; unknown sources give nothing."""
    if in_tasks:
        found = small.from_sources(graph, sources)
        return found if limit is None else found.where(F.col("depth") <= limit)
    edges = graph.topology()
    known = graph.vertices.select("graph_id", F.col("id").alias("source"))
    levels = Levels(graph.vertices.sparkSession, "depth")
    level = levels.write(sources.select("graph_id", "source").distinct().join(known, ["graph_id", "source"], "left_semi").select("graph_id", "source", F.col("source").alias("id")), 0)
    before, depth = level, 0
    while limit is None or depth < limit:
        depth += 1
        reached = level.join(edges.select("graph_id", F.col("src").alias("id"), "dst"), ["graph_id", "id"]).select("graph_id", "source", F.col("dst").alias("id")).distinct()
        fresh = reached.join(level if depth == 1 else level.unionByName(before), VISIT, "left_anti")
        before, level = level, levels.write(fresh, depth)
        if not level.limit(1).count():
            break
    return levels.read()


def bfs(graph: Graph, index: int, in_tasks: bool = False) -> DataFrame:
    """graph_id, id, depth of the vertices reachable from one index in each graph."""
    if in_tasks:
        return small.distances(graph, index).drop("source")
    sources = graph.vertices.select("graph_id").distinct().withColumn("source", F.lit(index).cast("long"))
    return multi_source_bfs(graph, sources).drop("source")


def all_sources(graph: Graph, in_tasks: bool = False) -> DataFrame:
    """graph_id, source, id, depth of every pair of a component: as many rows as pairs, by definition."""
    if in_tasks:
        return small.distances(graph, None)
    return searches.pairs(graph)


def filtered(graph: Graph, keep: Column) -> Graph:
    """The part of a graph that a search through vertices with ``keep`` can see."""
    v = graph.vertices.where(keep)
    ids = v.select("graph_id", "id")
    e = graph.edges.join(ids.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_semi")
    return Graph(v, e)


def bfs_filtered(graph: Graph, index: int, keep: Column) -> DataFrame:
    """Breadth-first through the vertices that ``keep`` accepts; no row if it refuses the start."""
    return bfs(filtered(graph, keep), index)


def is_handled(graph: Graph, index: int, keep: Column) -> DataFrame:
    """graph_id, id, handled: queued by the search, or refused by the filter."""
    seen = bfs_filtered(graph, index, keep).select("graph_id", "id", F.lit(True).alias("_seen"))
    return graph.vertices.withColumn("_no", ~F.coalesce(keep, F.lit(False))).join(seen, ["graph_id", "id"], "left").select("graph_id", "id", (F.col("_no") | F.coalesce("_seen", F.lit(False))).alias("handled"))


def bfs_mut(graph: Graph, index: int, payload: Column) -> Graph:
    """``graph`` with a new payload at every vertex that a search from ``index`` reaches: an expression over id,
    payload, ``depth`` and ``visit_pos``, the position of the vertex in the search (by depth, then by index)."""
    order = with_rank(bfs(graph, index).select("graph_id", "id", "depth"), "depth", "id", out="visit_pos")
    return _rewritten(graph, order, payload)


def dfs_mut(graph: Graph, index: int, payload: Column) -> Graph:
    """``graph`` with a new payload at every vertex that a stack search from ``index`` reaches: an expression over id, payload and ``visit_pos``."""
    return _rewritten(graph, dfs(graph, index), payload)


def _rewritten(graph: Graph, order: DataFrame, payload: Column) -> Graph:
    columns = graph.vertices.columns
    seen = graph.vertices.join(order.withColumn("_seen", F.lit(True)), ["graph_id", "id"], "left")
    return graph.with_vertices(seen.withColumn("payload", F.when(F.col("_seen"), payload).otherwise(F.col("payload"))).select(columns))


def dfs(graph: Graph, index: int) -> DataFrame:
    """graph_id, visit_pos, id in the order of an explicit stack whose vertices are marked when pushed.

    The order is sequential by definition: one group for each graph.
    """
    import pyarrow as pa

    from netloom.operators import kernels

    def run(key, t):
        n = max(t.column("id").to_pylist()) + 1
        g = kernels.Adjacency.of(n, [(a, b) for a, b in zip(t.column("id").to_pylist(), t.column("adj").to_pylist(), strict=True)])
        order = kernels.dfs_order(g, index)
        return pa.table({"graph_id": pa.array([key[0].as_py()] * len(order), pa.int64()), "visit_pos": pa.array(range(len(order)), pa.int64()), "id": pa.array(order, pa.int64())})

    from netloom.operators.access import containers

    return containers(graph).select("graph_id", "id", "adj").groupBy("graph_id").applyInArrow(run, "graph_id long, visit_pos long, id long")
