"""Graphs from pairs of keys."""

import pytest

from netloom.sources import tables


@pytest.mark.parametrize("keys", [list(range(-70, 200, 3)), [-(2**40), -1, 0, 63, 64, 127, 2**40, 2**62], list(range(1000, 1200))])
def test_ids_are_ranks_of_keys(spark, keys):
    pairs = sorted({(a, b) for i, a in enumerate(keys) for b in keys[i + 1 : i + 4]})
    g = tables.from_pairs(spark.createDataFrame(pairs, "a long, b long"), 7)
    rank = {k: i for i, k in enumerate(keys)}
    assert sorted((r["graph_id"], r["id"], r["payload"]["key"]) for r in g.vertices.collect()) == [(7, i, k) for i, k in enumerate(keys)]
    want = sorted((7, *e) for a, b in pairs for e in ((rank[a], rank[b]), (rank[b], rank[a])))
    assert sorted(map(tuple, g.edges.select("graph_id", "src", "dst").collect())) == want


def test_no_pairs(spark):
    g = tables.from_pairs(spark.createDataFrame([], "a long, b long"))
    assert g.vertices.count() == 0 and g.edges.count() == 0


def test_pairs_are_not_shuffled_again(spark):
    """Re-indexing 20,000 pairs of 400 dense keys shuffles blocks of keys only."""
    from test_searches import shuffled_rows

    pairs = spark.range(20_000).selectExpr("id % 200 as a", "200 + id div 200 as b").where("a < b")
    assert shuffled_rows(spark, lambda: tables.from_pairs(pairs)) < 2_000
