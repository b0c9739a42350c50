"""Searches from all vertices: in parts, and without shuffling pairs."""

import random

import numpy as np
import pytest

from netloom.operators import ensembles, kernels, measures, searches, traverse
from netloom.operators.searches import Component


@pytest.fixture
def tiny(monkeypatch):
    """Many parts a component, and every block of a few rows."""
    for name, value in {"FEW_SOURCES": 7, "BLOCK": 16, "CELLS": 400, "LISTED": 5}.items():
        monkeypatch.setattr(searches, name, value)


@pytest.fixture(scope="module")
def sparse(spark):
    return ensembles.er_c(spark, 60, 2.2, 3, samples=4).materialized()


@pytest.fixture(scope="module")
def wide(spark):
    """One graph of 400 vertices: 160,000 pairs, and far fewer edges."""
    return ensembles.er_c(spark, 400, 6.0, 5).materialized()


def rows(frame, digits=7):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in frame.select(sorted(frame.columns)).collect())


def shuffled_rows(spark, run) -> int:
    """Rows that the stages of ``run`` wrote to the shuffle."""
    store, seen = spark._jsc.sc().statusStore(), []
    for _ in range(2):
        stages = store.stageList(spark._jvm.java.util.ArrayList(), False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        seen.append({stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())})
        if len(seen) == 1:
            run()
            spark._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for s, n in seen[1].items() if s not in seen[0])


def test_levels_of_components():
    """Both ways to expand a level, over blocks, against the sequential search."""
    rng, n = random.Random(1), 90
    edges = sorted({(min(a, b), max(a, b)) for a, b in [(i, rng.randrange(max(1, i))) for i in range(1, n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(60)] if a != b})
    g, ids, order = kernels.Adjacency.of_edges(n, edges), np.arange(n) * 3 + 5, rng.sample(range(n), n)
    larger = [[ids[b] for a, b in edges if a == v] for v in order]
    c = Component(ids[order], np.array([len(x) for x in larger]), np.array([w for x in larger for w in x]))
    for first, last in searches._words(0, n):
        got = {(first + int(s), int(v)): depth for depth, at, bits in c.levels(first, last) for vs, ss in searches._members(at, bits) for v, s in zip(vs, ss, strict=True)}
        assert got == {(s, v): d for s in range(first, last) for v, d in kernels.distances(g, s).items()}


def test_closeness_in_parts(sparse, tiny):
    assert rows(measures.closeness_centrality(sparse)) == rows(measures.closeness_centrality(sparse, in_tasks=True))


def test_closeness_shuffles_no_pairs(spark, wide):
    assert shuffled_rows(spark, lambda: measures.closeness_centrality(wide).collect()) < 160_000 / 2


def test_all_sources_in_parts(sparse, tiny):
    assert rows(traverse.all_sources(sparse)) == rows(traverse.all_sources(sparse, in_tasks=True))


def test_all_sources_shuffles_no_pairs(spark, wide):
    assert shuffled_rows(spark, lambda: traverse.all_sources(wide).collect()) < 160_000 / 2


@pytest.mark.parametrize("endpoints", [False, True])
def test_load_in_parts(sparse, tiny, endpoints):
    assert rows(measures.vertex_load(sparse, endpoints)) == rows(measures.vertex_load(sparse, endpoints, in_tasks=True))


@pytest.mark.parametrize("endpoints", [False, True])
def test_load_shuffles_no_pairs(spark, wide, endpoints):
    assert shuffled_rows(spark, lambda: measures.vertex_load(wide, endpoints).collect()) < 160_000 / 2
