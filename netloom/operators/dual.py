"""Two-layer graphs on one unified vertex numbering.

Layer 1 keeps its ids; layer 2's ids follow (``offset`` = vertices of layer 1),
so that every traversal and measure of single graphs runs unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.model import EdgeExists, Graph, symmetric
from netloom.operators import measures, traverse
from netloom.operators.access import degrees


@dataclass(frozen=True)
class DualGraph:
    """``cross``: graph_id, id1, id2. ``single``: at most one partner on each side."""

    one: Graph
    two: Graph
    cross: DataFrame
    single: bool = False

    def sizes(self) -> DataFrame:
        """graph_id, n1, n2."""
        n = lambda g, c: g.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias(c))
        return n(self.one, "n1").join(n(self.two, "n2"), "graph_id", "full").select("graph_id", F.coalesce("n1", F.lit(0)).cast("long").alias("n1"), F.coalesce("n2", F.lit(0)).cast("long").alias("n2"))

    def unified(self) -> Graph:
        shift = self.sizes().select("graph_id", "n1")
        v2 = self.two.vertices.join(shift, "graph_id").select("graph_id", (F.col("id") + F.col("n1")).alias("id"), F.lit(2).alias("layer"), F.col("id").alias("own_id"))
        v1 = self.one.vertices.select("graph_id", "id", F.lit(1).alias("layer"), F.col("id").alias("own_id"))
        e2 = self.two.topology().join(shift, "graph_id").select("graph_id", (F.col("src") + F.col("n1")).alias("src"), (F.col("dst") + F.col("n1")).alias("dst"))
        x = self.cross.join(shift, "graph_id").select("graph_id", F.col("id1").alias("src"), (F.col("id2") + F.col("n1")).alias("dst"))
        return Graph(v1.unionByName(v2), self.one.topology().unionByName(e2).unionByName(symmetric(x)))


def add_edge(dual: DualGraph, i: int, j: int, graph_id: int = 0) -> DualGraph:
    """A cross edge; IndexError out of range, EdgeExists if it is there or (single) either end has a partner."""
    n = dual.sizes().where(F.col("graph_id") == graph_id).first()
    if n is None or not (0 <= i < n["n1"] and 0 <= j < n["n2"]):
        raise IndexError(f"cross edge {i}-{j} out of range")
    mine = dual.cross.where(F.col("graph_id") == graph_id)
    taken = (F.col("id1") == i) | (F.col("id2") == j) if dual.single else (F.col("id1") == i) & (F.col("id2") == j)
    if mine.where(taken).limit(1).count():
        raise EdgeExists(f"cross edge {i}-{j}")
    new = dual.cross.sparkSession.createDataFrame([(graph_id, i, j)], "graph_id long, id1 long, id2 long")
    return DualGraph(dual.one, dual.two, dual.cross.unionByName(new), dual.single)


def violations(dual: DualGraph) -> DataFrame:
    """graph_id, layer, id, partners of vertices with more than one partner: what a single-partner graph must not have."""
    parts = [dual.cross.groupBy("graph_id", F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("partners")).where("partners > 1").select("graph_id", F.lit(k).alias("layer"), "id", "partners") for k, c in ((1, "id1"), (2, "id2"))]
    return parts[0].unionByName(parts[1])


def total_vertices(dual: DualGraph) -> DataFrame:
    return dual.sizes().select("graph_id", "n1", "n2", (F.col("n1") + F.col("n2")).alias("total_vertices"))


def tagged(frame: DataFrame, dual: DualGraph) -> DataFrame:
    """``frame`` (graph_id, id, ...) with layer and own_id in place of the unified id."""
    return frame.join(dual.unified().vertices, ["graph_id", "id"]).drop("id").withColumnRenamed("own_id", "id")


def dual_degree(dual: DualGraph) -> DataFrame:
    """graph_id, layer, id, degree: own layer and cross edges together."""
    return tagged(degrees(dual.unified()), dual).select("graph_id", "layer", "id", "degree")


def _unified_id(dual: DualGraph, layer: int, index: int) -> DataFrame:
    at = F.lit(index) if layer == 1 else F.col("n1") + index
    size = "n1" if layer == 1 else "n2"
    return dual.sizes().where(F.col(size) > index).select("graph_id", at.cast("long").alias("source"))


def dual_bfs(dual: DualGraph, layer: int, index: int) -> DataFrame:
    """graph_id, layer, id, depth over both layers."""
    found = traverse.multi_source_bfs(dual.unified(), _unified_id(dual, layer, index)).drop("source")
    return tagged(found, dual).select("graph_id", "layer", "id", "depth")


def dual_dfs(dual: DualGraph, layer: int, index: int, graph_id: int = 0) -> DataFrame:
    """graph_id, visit_pos, layer, id in stack order over both layers of one graph."""
    at = _unified_id(dual, layer, index).where(F.col("graph_id") == graph_id).first()
    u = dual.unified()
    g = Graph(u.vertices.where(F.col("graph_id") == graph_id), u.edges.where(F.col("graph_id") == graph_id))
    found = traverse.dfs(g, at["source"] if at else -1)
    return tagged(found, dual).select("graph_id", "visit_pos", "layer", "id")


def dual_dfs_contained(dual: DualGraph, layer: int, index: int, graph_id: int = 0) -> DataFrame:
    """graph_id, visit_pos, layer, id, payload in stack order: ``dual_dfs`` with what the vertices hold.

    The payloads of the two layers may differ in type, so each has its own column, null for the other layer.
    """
    found = dual_dfs(dual, layer, index, graph_id)
    held = lambda g, k: g.vertices.select("graph_id", F.lit(k).alias("layer"), "id", F.col("payload").alias(f"payload_{k}"))
    keys = ["graph_id", "layer", "id"]
    return found.join(held(dual.one, 1), keys, "left").join(held(dual.two, 2), keys, "left")


def dual_is_connected(dual: DualGraph) -> DataFrame:
    """True for one component over both layers, and for two empty graphs."""
    return measures.is_connected(dual.unified())


def dual_diameter(dual: DualGraph) -> DataFrame:
    return measures.diameter(dual.unified())


def dual_neighbors(dual: DualGraph, layer: int, index: int) -> DataFrame:
    """graph_id, src_kind (0 own layer, 1 the other), layer, id of one vertex's neighbours."""
    own, other = (dual.one, dual.two) if layer == 1 else (dual.two, dual.one)
    mine, theirs = ("id1", "id2") if layer == 1 else ("id2", "id1")
    inside = own.edges.where(F.col("src") == index).select("graph_id", F.lit(0).alias("src_kind"), F.lit(layer).alias("layer"), F.col("dst").alias("id"))
    across = dual.cross.where(F.col(mine) == index).select("graph_id", F.lit(1).alias("src_kind"), F.lit(3 - layer).alias("layer"), F.col(theirs).alias("id"))
    return inside.unionByName(across)


def partners(dual: DualGraph, layer: int) -> DataFrame:
    """graph_id, id, partner: the other layer's vertices seen from one layer."""
    mine, theirs = ("id1", "id2") if layer == 1 else ("id2", "id1")
    return dual.cross.select("graph_id", F.col(mine).alias("id"), F.col(theirs).alias("partner"))
