"""Biconnected components in tasks, over tables, and some of each."""

import pytest

from netloom.model import Graph
from netloom.operators import ensembles, measures
from netloom.sources import constructors


@pytest.mark.parametrize("few", [0, 8, 1 << 18])
def test_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr(measures, "FEW_EDGES", few)
    g = ensembles.er_c(spark, 60, 2.2, 3, samples=8).materialized()
    by = lambda f: sorted((r["graph_id"], r["rank"], r["size"]) for r in f.collect())
    assert by(measures.vertex_biconnected_components(g)) == by(measures.vertex_biconnected_components(g, in_tasks=True))


def test_small_components_take_no_rounds_of_their_depth(spark, monkeypatch):
    """A ring of 40 is 20 levels deep; nothing loops over them."""
    monkeypatch.setattr(measures, "_biconnected_over_tables", None)
    monkeypatch.setattr(measures, "_search_tree", None)
    g = constructors.init_ring(constructors.graph_new(spark, 40), 1)
    assert [r["size"] for r in measures.vertex_biconnected_components(g).collect()] == [40]


def test_no_edges(spark):
    assert measures.vertex_biconnected_components(Graph.of(spark, 3, [(0, 1)]).with_edges(spark.createDataFrame([], "graph_id long, src long, dst long"))).count() == 0
