"""Graph constructors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.model import EdgeExists, Graph, GraphError, symmetric
from netloom.plans.ordering import with_position

EDGES = "graph_id long, src long, dst long"


def _vertices(spark: SparkSession, n: int, graph_id: int, payload: Column | None) -> DataFrame:
    v = spark.range(n).select(F.lit(graph_id).cast("long").alias("graph_id"), "id")
    return v.withColumn("payload", payload if payload is not None else F.struct(F.col("id").alias("index")))


def graph_new(spark: SparkSession, n: int, graph_id: int = 0, payload: Column | None = None) -> Graph:
    """``n`` vertices without edges; ``payload`` is an expression over id (default: the index)."""
    return Graph(_vertices(spark, n, graph_id, payload), spark.createDataFrame([], EDGES))


def graph_from_vec(rows: DataFrame, *order: str, graph_id: int = 0) -> Graph:
    """One vertex for each row, numbered in the given order, the row as its payload."""
    v = with_position(rows, *order, out="_id")
    return Graph(v.select(F.lit(graph_id).cast("long").alias("graph_id"), F.col("_id").alias("id"), F.struct(*rows.columns).alias("payload")), rows.sparkSession.createDataFrame([], EDGES))


def graph_from_iter(spark: SparkSession, items, schema: str, graph_id: int = 0) -> Graph:
    """From local items of the given schema, in their order."""
    rows = [(graph_id, i, x if isinstance(x, tuple) else (x,)) for i, x in enumerate(items)]
    v = spark.createDataFrame(rows, f"graph_id long, id long, payload struct<{', '.join(':'.join(f.split()) for f in schema.split(','))}>")
    return Graph(v, spark.createDataFrame([], EDGES))


def complete_graph(spark: SparkSession, n: int, graph_id: int = 0) -> Graph:
    """K_n. Each vertex generates its own partners, so there is no join."""
    e = spark.range(n).select(F.lit(graph_id).cast("long").alias("graph_id"), F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst")).where("src <> dst")
    return Graph(_vertices(spark, n, graph_id, None), e)


def ring_edges(ids: DataFrame, n: Column, distance: int) -> DataFrame:
    """(graph_id, src, dst) with dst 1..distance steps after src; ``ids`` has graph_id and id."""
    step = F.explode(F.sequence(F.lit(1), F.lit(distance))).alias("_k")
    return ids.select("graph_id", F.col("id").alias("src"), n.alias("_n"), step).select("graph_id", "src", F.pmod(F.col("src") + F.col("_k"), F.col("_n")).cast("long").alias("dst"))


def init_ring(graph: Graph, distance: int, n: int | None = None) -> Graph:
    """Edges replaced by a ring in which each vertex meets its next ``distance`` ones."""
    if distance < 1:
        raise GraphError("the distance must be at least 1")
    sizes = graph.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    if n is None:
        least = sizes.agg(F.min("n")).first()[0]
    else:
        least = n
    if least is not None and least < 2 * distance + 1:
        raise EdgeExists(f"a ring of distance {distance} needs {2 * distance + 1} vertices")
    ids = graph.vertices.select("graph_id", "id").join(sizes, "graph_id")
    return graph.with_edges(symmetric(ring_edges(ids, F.col("n"), distance)))


def init_ring_2(graph: Graph) -> Graph:
    """The small-world ring of distance 2: the half that starts an edge is its root and keeps its original target."""
    sizes = graph.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    ring = ring_edges(graph.vertices.select("graph_id", "id").join(sizes, "graph_id"), F.col("n"), 2)
    return graph.with_edges(push_roots(ring))


def push_roots(directed: DataFrame) -> DataFrame:
    """Small-world half-edges of directed pairs: the root half has orig_dst, the loose half has none."""
    root = directed.select("graph_id", "src", "dst", F.col("dst").alias("orig_dst"))
    loose = directed.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(None).cast("long").alias("orig_dst"))
    return root.unionByName(loose)


def graph_from_generic(graph: Graph) -> Graph:
    """The plain graph of any graph: edge annotations dropped, payload kept."""
    return Graph(graph.vertices.select([c for c in ("graph_id", "id", "payload") if c in graph.vertices.columns]), graph.topology())


def reset_from_graph(graph: Graph, other: Graph) -> Graph:
    """``graph`` with the edges of a smaller one on its first vertices."""
    return graph.with_edges(other.topology())
