"""Hand-made graphs with known values."""

import math

import pytest
from pyspark.sql import functions as F

from netloom.model import EdgeDoesNotExist, EdgeExists, Graph, GraphError
from netloom.operators import access, kernels, measures, mutate, transform, traverse
from netloom.sources import constructors, dot

K = lambda n: [(i, j) for i in range(n) for j in range(i + 1, n)]
RING = lambda n: [(i, (i + 1) % n) for i in range(n)]
MIXED20 = [(0, 1), (0, 2), (1, 2), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), *[(11 + i, 11 + j) for i, j in K(4)]]
LOAD8 = [(0, 1), (0, 2), (2, 1), (5, 1), (2, 3), (2, 4), (4, 3), (5, 3), (4, 5), (4, 7), (4, 6), (5, 7), (5, 6), (6, 7)]
TRANS6 = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (4, 1), (3, 5)]
FIXTURES = {0: (20, MIXED20), 1: (20, []), 2: (20, K(20)), 3: (5, [(i, i + 1) for i in range(4)]), 4: (4, RING(4)), 5: (8, LOAD8), 6: (6, TRANS6), 7: (6, [(0, 1), (1, 2), (2, 0), (3, 4), (5, 4)]), 8: (5, [(0, 1), (1, 2), (2, 0), (2, 3), (4, 3), (4, 0)]), 9: (1, [])}


@pytest.fixture(scope="module")
def many(spark):
    """All fixtures in one Graph, told apart by graph_id: one plan measures them together."""
    v = [(g, i) for g, (n, _) in FIXTURES.items() for i in range(n)]
    e = [(g, a, b) for g, (_, pairs) in FIXTURES.items() for i, j in pairs for a, b in ((i, j), (j, i))]
    return Graph(spark.createDataFrame(v, "graph_id long, id long"), spark.createDataFrame(e, "graph_id long, src long, dst long")).materialized()


@pytest.fixture(params=["tables", "tasks"])
def how(request):
    """Every measure twice: by loops over tables, and as one task for each graph."""
    return {"in_tasks": request.param == "tasks"}


def by_graph(frame, column):
    return {r["graph_id"]: r[column] for r in frame.collect()}


def test_components(many, how):
    assert by_graph(measures.is_connected(many, **how), "is_connected") == {0: False, 1: False, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False, 8: True, 9: True}
    sizes = {}
    for r in measures.connected_components(many, **how).orderBy("graph_id", "rank").collect():
        sizes.setdefault(r["graph_id"], []).append(r["size"])
    assert sizes[0] == [6, 4, 3] + [1] * 7 and sizes[1] == [1] * 20 and sizes[2] == [20]
    ids = {(r["graph_id"], r["id"]): r["component"] for r in measures.connected_components_ids(many, **how).collect()}
    assert [ids[0, i] for i in range(7)] == [0, 0, 0, 1, 2, 3, 3]


def test_degrees(many):
    assert by_graph(measures.leaf_count(many), "leaf_count")[0] == 2
    assert by_graph(measures.average_degree(many), "average_degree")[2] == 19.0
    bins = {(r["graph_id"], r["degree"]): r["n"] for r in measures.degree_histogram(many).collect()}
    assert bins[9, 0] == 1 and bins[4, 2] == 4 and bins[0, 0] == 7


def test_q_core(many, how):
    two, three, four = (by_graph(measures.q_core(many, q, **how), "q_core") for q in (2, 3, 4))
    assert (two[0], three[0], four[0]) == (4, 4, 0)
    assert two[2] == three[2] == four[2] == 20 and two[9] == 0
    assert set(by_graph(measures.q_core(many, 1, **how), "q_core").values()) == {None}


def test_diameter(many, how):
    d = by_graph(measures.diameter(many, **how), "diameter")
    assert (d[0], d[2], d[3], d[4], d[9]) == (None, 1, 4, 2, 0)


def test_transitivity(many):
    t = by_graph(measures.transitivity(many), "transitivity")
    assert math.isnan(t[1]) and t[2] == 1.0 and t[6] == pytest.approx(3 / 11) and t[3] == 0.0


def test_load(many, how):
    g = Graph(many.vertices.where("graph_id in (5, 4)"), many.edges.where("graph_id in (5, 4)"))
    load = {(r["graph_id"], r["id"]): r["load"] for r in measures.vertex_load(g, **how).collect()}
    assert [load[5, i] for i in range(8)] == pytest.approx([0, 14 / 3, 8, 2 / 3, 26 / 3, 10, 0, 0])
    k4 = kernels.Adjacency.of_edges(4, K(4))
    assert kernels.vertex_load(k4, True) == [3.0] * 4 and kernels.vertex_load(k4, False) == [0.0] * 4


def test_biconnected(many, how):
    sizes = {}
    for r in measures.vertex_biconnected_components(many, **how).orderBy("graph_id", "rank").collect():
        sizes.setdefault(r["graph_id"], []).append(r["size"])
    assert sizes[7] == [3, 2, 2] and sizes[8] == [5] and sizes[2] == [20] and 1 not in sizes
    short = [r["size"] for r in measures.vertex_biconnected_components(many, skip_bridges=True, **how).where("graph_id = 7").collect()]
    assert short == [3]


def test_biconnected_of_random_graphs(spark):
    """Tables against the sequential search, on sparse graphs with many components, cycles and bridges."""
    from netloom.operators import ensembles

    g = ensembles.er_c(spark, 60, 2.2, 3, samples=8).materialized()
    by = lambda f: sorted((r["graph_id"], r["rank"], r["size"]) for r in f.collect())
    assert by(measures.vertex_biconnected_components(g)) == by(measures.vertex_biconnected_components(g, in_tasks=True))


def test_kernels_agree_with_tables(many, how):
    from netloom.operators.ensembles import measure_grouped

    rows = {r["graph_id"]: r for r in measure_grouped(many, ["edges", "components", "diameter", "q_core_3", "transitivity"]).collect()}
    d, q, t = by_graph(measures.diameter(many, **how), "diameter"), by_graph(measures.q_core(many, 3, **how), "q_core"), by_graph(measures.transitivity(many), "transitivity")
    for g, r in rows.items():
        assert r["diameter"] == d[g] and r["q_core_3"] == q[g] and (r["transitivity"] == pytest.approx(t[g]) or math.isnan(t[g]))


def test_closeness(many, how):
    c = {(r["graph_id"], r["id"]): r["closeness"] for r in measures.closeness_centrality(many, **how).collect()}
    assert c[3, 0] == pytest.approx(0.4) and c[3, 2] == pytest.approx(4 / 6) and math.isinf(c[1, 0])


def test_edges_in_and_out(spark):
    g = Graph.of(spark, 5, [(0, 1), (1, 2)])
    assert mutate.add_edge(g, 3, 4).canonical.count() == 3
    with pytest.raises(EdgeExists):
        mutate.add_edge(g, 1, 0)
    with pytest.raises(IndexError):
        mutate.add_edge(g, 1, 5)
    with pytest.raises(GraphError):
        mutate.add_edge(g, 1, 1)
    with pytest.raises(EdgeDoesNotExist):
        mutate.remove_edge(g, 0, 4)
    assert mutate.remove_edge(g, 1, 0).canonical.count() == 1
    with pytest.raises(EdgeExists):
        Graph.of(spark, 3, [(0, 1), (1, 0)])


def test_subgraph(spark):
    g = Graph.of(spark, 7, [(0, 3), (0, 1), (2, 3), (0, 5)])
    pick = lambda *ids: spark.createDataFrame([(0, i) for i in ids], "graph_id long, id long")
    s = transform.cloned_subgraph(g, pick(0, 1, 3, 1))
    assert sorted((r["src"], r["dst"]) for r in s.canonical.collect()) == [(0, 1), (0, 2)] and s.vertices.count() == 3
    assert transform.cloned_subgraph(g, pick(0, 9)) is None
    assert transform.cloned_subgraph(g, spark.createDataFrame([], "graph_id long, id long")) is None


def test_ring_needs_room(spark):
    with pytest.raises(EdgeExists):
        constructors.init_ring(constructors.graph_new(spark, 4), 2)


def test_search_order_and_range(spark):
    g = Graph.of(spark, 6, [(0, 1), (0, 2), (1, 3), (2, 4)])
    order = [r["id"] for r in traverse.dfs(g, 0).orderBy("visit_pos").collect()]
    assert order == [0, 2, 4, 1, 3]
    assert traverse.dfs(g, 9).count() == 0 and traverse.bfs(g, 9).count() == 0
    for tasks in (False, True):
        assert {r["id"]: r["depth"] for r in traverse.bfs(g, 0, in_tasks=tasks).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}
        sources = spark.createDataFrame([(0, 3), (0, 5), (0, 77)], "graph_id long, source long")
        assert {(r["source"], r["id"]): r["depth"] for r in traverse.multi_source_bfs(g, sources, limit=2, in_tasks=tasks).collect()} == {(3, 3): 0, (3, 1): 1, (3, 0): 2, (5, 5): 0}
    assert traverse.bfs_filtered(g, 0, F.col("id") != 0).count() == 0


def test_make_connected(spark):
    g = transform.make_connected(Graph.of(spark, 6, [(0, 1), (3, 4)]))
    assert measures.is_connected(g).first()["is_connected"]


def test_dot_text(spark):
    g = Graph.of(spark, 4, RING(4))
    text = dot.dot_string(g, F.concat(F.lit("Hey "), "id", F.lit("!"))).first()["dot"]
    assert text == 'graph G{\n\t\n\t0 1 2 3 ;\n\t"0" [label="Hey 0!"];\n\t"1" [label="Hey 1!"];\n\t"2" [label="Hey 2!"];\n\t"3" [label="Hey 3!"];\n\t0 -- 1\n\t0 -- 3\n\t1 -- 2\n\t2 -- 3\n}'
    assert dot.to_dot(g).first()["dot"].startswith("graph{\n\t0 1 2 3 \n\t0 -- 1")


def test_json_round_trip(spark, tmp_path):
    g = Graph.of(spark, 5, [(0, 1), (1, 2), (3, 4)])
    dot.save_json(g, f"{tmp_path}/g")
    back = dot.load_json(spark, f"{tmp_path}/g")
    assert back.vertices.count() == 5 and back.canonical.count() == 3


def test_methods(spark):
    g = Graph.of(spark, 5, [(0, 1), (1, 2)])
    assert g.q_core(2).first()["q_core"] == 0
    with pytest.raises(AttributeError):
        g.no_such_measure
    assert access.vertex_count(g).first()["vertex_count"] == 5
