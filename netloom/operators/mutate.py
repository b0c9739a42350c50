"""Mutations of edges and payload; each returns a new Graph or table.

Errors of arguments raise; outcomes of single rows come back as a status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.functions.rng import uniform
from netloom.model import EdgeDoesNotExist, EdgeExists, Graph, GraphError, symmetric

KEYS = ["graph_id", "src", "dst"]


def _canonical(pairs: DataFrame) -> DataFrame:
    return pairs.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def edge_status(graph: Graph, pairs: DataFrame) -> DataFrame:
    """What adding each (graph_id, src, dst) would meet: ok, exists, self_loop or out_of_range."""
    n = graph.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    there = graph.edges.select(*KEYS).withColumn("_there", F.lit(True))
    status = (
        F.when(F.col("_n").isNull() | (F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= F.col("_n")), "out_of_range")
        .when(F.col("src") == F.col("dst"), "self_loop")
        .when(F.col("_there"), "exists")
        .otherwise("ok")
    )
    return pairs.join(n, "graph_id", "left").join(there, KEYS, "left").select(*KEYS, status.alias("status"))


def add_edges(graph: Graph, pairs: DataFrame, strict: bool = False) -> Graph:
    """Insert undirected edges; those that exist are skipped, or raise EdgeExists if ``strict``."""
    judged = edge_status(graph, pairs)
    if strict:
        bad = judged.where("status <> 'ok'").limit(1).collect()
        if bad:
            kind = {"exists": EdgeExists, "out_of_range": IndexError}.get(bad[0]["status"], GraphError)
            raise kind(f"edge {bad[0]['src']}-{bad[0]['dst']}: {bad[0]['status']}")
    new = _canonical(judged.where("status = 'ok'")).distinct()
    return graph.with_edges(graph.edges.unionByName(symmetric(new), allowMissingColumns=True))


def add_edge(graph: Graph, i: int, j: int, graph_id: int = 0) -> Graph:
    spark = graph.edges.sparkSession
    return add_edges(graph, spark.createDataFrame([(graph_id, i, j)], "graph_id long, src long, dst long"), strict=True)


def remove_edges(graph: Graph, pairs: DataFrame, strict: bool = False) -> Graph:
    """Delete undirected edges; missing ones are ignored, or raise EdgeDoesNotExist if ``strict``."""
    both = symmetric(_canonical(pairs).distinct())
    if strict and (missing := both.join(graph.edges, KEYS, "left_anti").limit(1).collect()):
        raise EdgeDoesNotExist(f"edge {missing[0]['src']}-{missing[0]['dst']}")
    return graph.with_edges(graph.edges.join(both, KEYS, "left_anti"))


def remove_edge(graph: Graph, i: int, j: int, graph_id: int = 0) -> Graph:
    spark = graph.edges.sparkSession
    return remove_edges(graph, spark.createDataFrame([(graph_id, i, j)], "graph_id long, src long, dst long"), strict=True)


def clear_edges(graph: Graph, graph_id: int | None = None) -> Graph:
    """No edges in all graphs, or in one."""
    return graph.with_edges(graph.edges.where(F.lit(False) if graph_id is None else F.col("graph_id") != graph_id))


def sort_adj(graph: Graph) -> Graph:
    """adj_pos of every neighbour by its index."""
    order = Window.partitionBy("graph_id", "src").orderBy("dst")
    return graph.with_edges(graph.edges.drop("adj_pos").withColumn("adj_pos", (F.row_number().over(order) - 1).cast("long")))


def shuffle_adjs(graph: Graph, seed: int, vertex: int | None = None) -> Graph:
    """adj_pos in random order for all vertices, or for one (the others sorted)."""
    u = uniform(seed, "adj", "src", "dst")
    key = u if vertex is None else F.when(F.col("src") == vertex, u)
    order = Window.partitionBy("graph_id", "src").orderBy(key, "dst")
    return graph.with_edges(graph.edges.drop("adj_pos").withColumn("adj_pos", (F.row_number().over(order) - 1).cast("long")))


def payload_update(graph: Graph, where: Column, payload: Column) -> Graph:
    """A new payload for the vertices that ``where`` picks."""
    return graph.with_vertices(graph.vertices.withColumn("payload", F.when(where, payload).otherwise(F.col("payload"))))


def sw_push_root(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Small-world half-edges with those of new (graph_id, src, dst) pairs; src keeps the root."""
    from netloom.sources.constructors import push_roots

    new = pairs.join(edges.select(*KEYS), KEYS, "left_anti")
    return edges.unionByName(push_roots(new))


def sw_change(edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One root edge of each graph moved: (graph_id, i, old, new) rows ask for (i, old) to become (i, new).

    Returns the new half-edges and (graph_id, i, old, new, status): nothing if
    old is new, blocked if i and new are adjacent or equal, invalid if (i, old)
    is not a root edge, else changed.
    """
    root = edges.where("orig_dst is not null").select("graph_id", F.col("src").alias("i"), F.col("dst").alias("old"), F.lit(True).alias("_root"))
    near = edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("new"), F.lit(True).alias("_near"))
    status = F.when(F.col("_root").isNull(), "invalid").when(F.col("old") == F.col("new"), "nothing").when(F.col("_near") | (F.col("i") == F.col("new")), "blocked").otherwise("changed")
    judged = wanted.join(root, ["graph_id", "i", "old"], "left").join(near, ["graph_id", "i", "new"], "left").select("graph_id", "i", "old", "new", status.alias("status"))
    moved = judged.where("status = 'changed'").select("graph_id", "i", "old", "new")
    gone = moved.select("graph_id", F.col("i").alias("src"), F.col("old").alias("dst")).unionByName(moved.select("graph_id", F.col("old").alias("src"), F.col("i").alias("dst")))
    kept = edges.join(gone, KEYS, "left_anti")
    old = edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("old"), "orig_dst").where("orig_dst is not null").join(moved, ["graph_id", "i", "old"]).select("graph_id", "i", "new", "orig_dst")
    halves = old.select("graph_id", F.col("i").alias("src"), F.col("new").alias("dst"), "orig_dst").unionByName(
        old.select("graph_id", F.col("new").alias("src"), F.col("i").alias("dst"), F.lit(None).cast("long").alias("orig_dst"))
    )
    return kept.unionByName(halves), judged


def sw_rewire_edge(edges: DataFrame, i: int, old: int, new: int, graph_id: int = 0) -> tuple[DataFrame, DataFrame]:
    wanted = edges.sparkSession.createDataFrame([(graph_id, i, old, new)], "graph_id long, i long, old long, new long")
    return sw_change(edges, wanted)


def sw_reset_edge(edges: DataFrame, i: int, old: int, graph_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """The root edge (i, old) back to its original target."""
    wanted = edges.where((F.col("graph_id") == graph_id) & (F.col("src") == i) & (F.col("dst") == old) & F.col("orig_dst").isNotNull())
    return sw_change(edges, wanted.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("old"), F.col("orig_dst").alias("new")))


def ws_push(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Watts-Strogatz half-edges of new pairs: both carry the original edge and are at their origin."""
    new = pairs.join(edges.select(*KEYS), KEYS, "left_anti")
    origin = lambda a, b: new.select("graph_id", F.col(a).alias("src"), F.col(b).alias("dst"), F.col("src").alias("orig_src"), F.col("dst").alias("orig_dst"), F.lit(True).alias("at_origin"))
    return edges.unionByName(origin("src", "dst")).unionByName(origin("dst", "src"))


def ws_remove(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return edges.join(symmetric(_canonical(pairs).distinct()), KEYS, "left_anti")
