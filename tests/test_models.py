"""Invariants of the random models, their steps and the chains."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.functions.rng import Rng
from netloom.operators import dual, ensembles, kernels
from netloom.operators.kernels import build
from netloom.sources import constructors

PARAMS = {"er_c": {"n": 30, "c": 4.0}, "er_m": {"n": 20, "m": 70}, "sw": {"n": 30, "r": 0.15}, "config": {"degrees": [3, 3, 2, 2, 2, 2, 1, 1]}, "spatial": {"n": 30, "f": 1.5, "alpha": 2.5}}


@pytest.mark.parametrize("model", PARAMS)
@settings(max_examples=15, deadline=None)
@given(seed=st.integers(0, 10**6), k=st.integers(0, 200))
def test_undo_returns_to_the_start(model, seed, k):
    m = build(model, seed, PARAMS[model])
    before = m.g.edges()
    m.undo_steps(m.m_steps(k))
    assert m.g.edges() == before


def test_small_world_invariants():
    for seed in range(30):
        m = build("sw", seed, PARAMS["sw"])
        m.m_steps(100)
        assert m.g.m == 60 and min(m.g.degree(v) for v in range(30)) >= 2
        assert all(len(r) == 2 for r in m.root)


def test_er_limits():
    assert build("er_c", 1, {"n": 20, "c": 19}).g.m == 190
    assert build("er_c", 1, {"n": 100, "c": 0}).g.m <= 1
    with pytest.raises(ValueError):
        build("er_m", 1, {"n": 5, "m": 3000})
    with pytest.raises(ValueError):
        build("er_c", 1, {"n": 1, "c": 1.0})


def test_ws_keeps_edges_and_rewires_with_two_chances():
    moved = total = 0
    for seed in range(30):
        m = build("ws", seed, {"n": 100, "distance": 2, "p": 0.1})
        assert m.g.m == 200
        moved += sum(not v for v in m.at_origin.values())
        total += 200
    assert moved / total == pytest.approx(1 - 0.9**2, abs=0.02)


def test_config_and_attachment():
    assert not kernels.valid_degrees([1, 2, 3]) and kernels.valid_degrees([1, 2, 3, 1, 2, 3])
    m = build("config", 3, {"degrees": [1, 2, 3, 1, 2, 3]})
    m.m_steps(50)
    assert [m.g.degree(v) for v in range(6)] == [1, 2, 3, 1, 2, 3]
    assert build("ba", 3, {"n": 100, "m": 1}).g.m == 99
    with pytest.raises(ValueError):
        build("ba", 3, {"n": 100, "m": 5})


def test_metropolis_resumes():
    def energies(parts):
        m = build("er_c", 7, {"n": 30, "c": 6.0})
        while not kernels.connected(m.g):
            m.randomize()
        out, at, e = [], 0, None
        for p in parts:
            for k, e, ok in kernels.metropolis(m, p, 5, -10.0, kernels.MEASURES["diameter"], at, e):
                out.append((k, e, ok))
            at += p
        return out

    assert energies([40]) == energies([20, 20])


def test_dog_terminates():
    m = kernels.Dog(Rng(1, "dog"), 30, 10.0, 0.5, 2.0)
    assert m.g.m > 0
    with pytest.raises(ValueError):
        kernels.Dog(Rng(1, "dog"), 30, 10.0, 0.5, 0)


def test_relational_er_m_is_exact_and_spread(spark):
    g = ensembles.er_m(spark, 40, 30, 5, samples=4)
    assert {r["graph_id"]: r["count"] for r in g.canonical.groupBy("graph_id").count().collect()} == dict.fromkeys(range(4), 30)
    v = ensembles.sample_vertices(spark, 7, 2)
    assert ensembles.all_pairs(v, 7).count() == 42 and ensembles.all_pairs(ensembles.sample_vertices(spark, 8), 8).distinct().count() == 28


def test_dual_graph(spark):
    ring = lambda n, d: constructors.init_ring(constructors.graph_new(spark, n), d)
    d = dual.DualGraph(ring(6, 1), ring(6, 1), spark.createDataFrame([(0, 0, 0)], "graph_id long, id1 long, id2 long"), single=True)
    assert dual.dual_diameter(d).first()["diameter"] == 7
    assert max(r["depth"] for r in dual.dual_bfs(d, 1, 3).collect()) == 7 - 1 + 1
    with pytest.raises(Exception, match="cross edge"):
        dual.add_edge(d, 1, 0)
    assert dual.add_edge(d, 1, 1).cross.count() == 2
    assert dual.dual_is_connected(d).first()["is_connected"]


def test_wang_landau_finds_the_binomial_shape():
    m = build("er_c", 3, {"n": 6, "c": 2.5})
    while not 4 <= m.g.m <= 11:
        m.randomize()
    out = kernels.wang_landau(m, 4, 11, lambda g: g.m, 20_000)
    assert max(out, key=out.get) in (6, 7, 8, 9)


def test_validity_of_a_degree_vector_against_the_inequalities():
    import random

    def plain(d):
        n, d = len(d), sorted(d, reverse=True)
        return n > 1 and d[0] < n - 1 and sum(d) % 2 == 0 and all(sum(d[:k]) <= k * (k - 1) + sum(min(x, k) for x in d[k:]) for k in range(1, n + 1))

    r = random.Random(3)
    seen = set()
    for _ in range(4000):
        n = r.randint(1, 9)
        d = [r.randint(0, r.randint(1, 7)) for _ in range(n)]
        assert kernels.valid_degrees(d) == plain(d), d
        seen.add((sum(d) % 2, plain(d)))
    assert (0, True) in seen and (0, False) in seen


def test_config_model_keeps_every_vertex(spark, monkeypatch):
    from pyspark.sql import functions as F

    from netloom import registry
    from netloom.model import Graph, symmetric

    n = 100_002  # pairs, two of them linked: the degree is 1, but 2 at n - 4 and n - 2
    v = spark.range(n).select(F.lit(0).cast("long").alias("graph_id"), "id", F.struct("id").alias("payload"))
    pairs = spark.range(0, n, 2).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    more = spark.createDataFrame([(0, n - 4, n - 2)], "graph_id long, src long, dst long")
    monkeypatch.setattr(registry, "derived", lambda *_: Graph(v, symmetric(pairs.unionByName(more))))
    got = registry.queries()["config_model"](spark, "").groupBy("graph_id").agg(F.count("id"), F.sum("degree"), F.max(F.when(F.col("degree") == 2, F.col("id"))), F.count_if(F.col("degree") == 2)).collect()
    assert sorted(map(tuple, got)) == [(g, n, n + 2, n - 2, 2) for g in range(3)]


def test_flat_histograms_find_the_density_of_all_graphs_of_four_vertices():
    """Both estimates against the exact shares: C(6, k) graphs of k edges, each pair an edge with probability p."""
    from math import comb, log

    p = 1.5 / 3
    exact = {k: log(comb(6, k)) + k * log(p) + (6 - k) * log(1 - p) for k in range(7)}
    m = build("er_c", 5, {"n": 4, "c": 1.5})
    first = kernels.wang_landau(m, 0, 6, lambda g: g.m, 60_000)
    hits, second = kernels.entropic(m, first, lambda g: g.m, 40_000)
    assert min(hits.values()) > 40_000 / 7 / 2
    for found, off in ((first, 0.35), (second, 0.15)):
        shift = found[3] - exact[3]
        assert all(abs(found[k] - shift - exact[k]) < off for k in exact)


def test_users_measures_stop_and_observe(spark):
    drawn = ensembles.samples_frame(spark, "er_c", {"n": 30, "c": 4.0}, 1, 6)
    triangles = lambda g: sum(len(g.adj[a].keys() & g.adj[b].keys()) for a, b in g.edges()) // 3
    rows = ensembles.metropolis(drawn, 50, 5, 2.0, triangles, stop=lambda k, e: k >= 3 and e <= 6, observe={"edges": "edges", "half": lambda g: g.m / 2}).collect()
    chains = {}
    for r in rows:
        assert r["half"] * 2 == r["edges"]
        chains.setdefault(r["graph_id"], []).append((r["counter"], r["energy"]))
    for c in chains.values():
        ended = [k for k, e in sorted(c) if k >= 3 and e <= 6]
        assert max(k for k, _ in c) == (ended[0] if ended else 50)
    sampled = ensembles.simple_sample(drawn, {"t": triangles, "edges": "edges"}).collect()
    assert len(sampled) == 6 and all(r["t"] >= 0 for r in sampled)
    with pytest.raises(ValueError, match="unknown measure"):
        ensembles.simple_sample(drawn, ["no such"])


@pytest.mark.parametrize("model", [*PARAMS, "ws", "ba"])
def test_states_resume(model):
    import json

    params = PARAMS | {"ws": {"n": 30, "distance": 2, "p": 0.2}, "ba": {"n": 30, "m": 2}}
    m = build(model, 9, params[model])
    plain = lambda x: json.loads(json.dumps(x.state()))
    n = kernels.resume(plain(m))
    assert plain(n) == plain(m)
    if model in PARAMS:
        m.m_steps(40)
        n.m_steps(40)
    else:
        m.randomize()
        n.randomize()
    assert plain(n) == plain(m)


def test_states_of_a_graph(spark):
    from netloom.model import Graph

    g = Graph.of(spark, 6, [(0, 1), (1, 2), (3, 4)])
    r = ensembles.resume(ensembles.states_of(g, 1, 2.0), 0, ["edges", "components"]).first()
    assert (r["edges"], r["components"]) == (3.0, 3.0)
    assert ensembles.resume(ensembles.states_of(g, 1, 2.0), 100).count() == 1


def test_parameters_can_change():
    m = build("er_c", 2, {"n": 20, "c": 2.0})
    m.set_params(c=19)
    m.randomize()
    assert m.g.m == 190
    with pytest.raises(ValueError, match="no such"):
        m.set_params(r=1)
    s = build("sw", 2, {"n": 20, "r": 0.0})
    s.set_params(r=1.0)
    i, k = s.draw_edge()
    assert 0 <= i < 20 and 0 <= k < 2


def test_configuration_of_broad_degrees():
    """Degrees for which matching stubs with restarts would never end."""
    degrees = [40, 40, 38, 30, *[3] * 80, *[1] * 60]
    degrees[-1] += sum(degrees) % 2
    m = build("config", 4, {"degrees": degrees})
    assert [m.g.degree(v) for v in range(len(degrees))] == degrees
    other = build("config", 5, {"degrees": degrees})
    assert len(set(m.g.edges()) & set(other.g.edges())) < 0.6 * m.g.m


def test_er_c_by_skipping_has_the_right_mean_and_ends(spark):
    counts = {r["graph_id"]: r["count"] for r in ensembles.er_c(spark, 60, 6.0, 1, samples=200).canonical.groupBy("graph_id").count().collect()}
    assert sum(counts.values()) / 200 == pytest.approx(180, abs=4)
    assert ensembles.er_c(spark, 20, 19.0, 1).canonical.count() == 190 and ensembles.er_c(spark, 20, 0.0, 1).canonical.count() == 0


def test_spatial_by_cells_has_every_pair_at_its_probability(spark):
    """Three levels of cells: the number of edges, all and long ones, against the sums of the probabilities."""
    import math

    n, f, alpha = 600, 0.9, 1.2
    g = ensembles.spatial(spark, n, f, alpha, 5, samples=2).materialized()
    at = {}
    for r in g.vertices.collect():
        at.setdefault(r["graph_id"], {})[r["id"]] = (r["x"], r["y"])
    edges = [(r["graph_id"], r["src"], r["dst"]) for r in g.canonical.collect()]
    assert len(edges) == len(set(edges))
    for least in (0.0, 0.3, 0.6):
        mean = var = 0.0
        for points in at.values():
            for i in range(n):
                for j in range(i):
                    d = math.dist(points[i], points[j])
                    if d >= least:
                        p = f * (1 + math.sqrt(n * math.pi) * d / alpha) ** -alpha
                        mean, var = mean + p, var + p * (1 - p)
        found = sum(math.dist(at[k][a], at[k][b]) >= least for k, a, b in edges)
        assert abs(found - mean) < 4.5 * math.sqrt(var)
