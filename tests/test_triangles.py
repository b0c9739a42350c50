"""Transitivity by lists of neighbours."""

import pytest
from pyspark.sql import functions as F
from test_searches import shuffled_rows

from netloom.model import Graph, symmetric
from netloom.operators import measures
from netloom.sources import constructors


def test_wedges_are_not_shuffled(spark):
    """120 vertices that are all adjacent: 7,140 edges and 280,840 oriented wedges."""
    g = constructors.complete_graph(spark, 120).materialized()
    assert measures.transitivity(g).first()["transitivity"] == 1.0
    assert shuffled_rows(spark, lambda: measures.transitivity(g).collect()) < 100_000


def test_hub(spark):
    """A wheel: its hub is dealt to several tasks, every spoke and the rim make a triangle each."""
    n = 3000
    ring = constructors.init_ring(constructors.graph_new(spark, n), 1)
    spokes = spark.range(n).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("src"), F.lit(n).cast("long").alias("dst"))
    g = Graph(spark.range(n + 1).select(F.lit(0).cast("long").alias("graph_id"), "id"), ring.edges.select("graph_id", "src", "dst").unionByName(symmetric(spokes)))
    assert measures.transitivity(g).first()["transitivity"] == pytest.approx(6 * n / (6 * n + n * (n - 1)))


def test_ids_beyond_an_int(spark):
    top = 1 << 33
    g = Graph(spark.createDataFrame([(0, top + i) for i in range(4)], "graph_id long, id long"), symmetric(spark.createDataFrame([(0, top + i, top + j) for i, j in [(0, 1), (1, 2), (0, 2), (2, 3)]], "graph_id long, src long, dst long")))
    assert measures.transitivity(g).first()["transitivity"] == pytest.approx(6 / 10)
