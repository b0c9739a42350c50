"""Queries over the graph operators, with the SQL that states their results.

Names are the operator ids of the survey. Graphs come from the test tables
(netloom.sources.tables) or from the generators.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.rng import uniform_sql
from netloom.model import Graph, symmetric
from netloom.operators import access, dual, ensembles, measures, mutate, transform, traverse
from netloom.session import materialize, shared_dir, table
from netloom.sources import constructors, dot
from netloom.sources.tables import derived, graph_sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir, "g_supp")
    return measures.average_degree(g).join(measures.leaf_count(g), "graph_id").join(measures.transitivity(g), "graph_id")


def on(graph: str, body: str) -> str:
    """SQL over v(id, key), ce(src, dst) and e(src, dst) of a derived graph."""
    return f"WITH RECURSIVE {graph_sql(graph)}{body if body.startswith(',') else ' ' + body}"


REACH = """,
reach(s, id) AS (SELECT id, id FROM v UNION SELECT r.s, e.dst FROM reach r JOIN e ON e.src = r.id),
lab AS (SELECT s AS id, min(id) AS label FROM reach GROUP BY s)
"""
DIST = """,
walk(s, id, d) AS (SELECT id, id, 0 FROM v UNION SELECT w.s, e.dst, w.d + 1 FROM walk w JOIN e ON e.src = w.id WHERE w.d < 30),
dist AS MATERIALIZED (SELECT s, id, min(d) AS d FROM walk GROUP BY s, id)
"""
DEG = "deg AS (SELECT v.id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)"
RING = "(SELECT i AS src, (i + k) % {n} AS dst FROM range({n}) r(i), range(1, {d} + 1) s(k))"

# ------------------------------------------------------------ 2.1 constructors


@query("graph_new", "SELECT CAST(0 AS BIGINT) AS graph_id, i AS id, i AS index FROM range(1000) r(i)")
def _(spark, sf_dir):
    return constructors.graph_new(spark, 1000).vertices.select("graph_id", "id", "payload.index")


@query("graph_from_vec", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS id, s_suppkey, s_name FROM supplier")
def _(spark, sf_dir):
    g = constructors.graph_from_vec(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return g.vertices.select("id", "payload.s_suppkey", "payload.s_name")


@query("graph_from_iter", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 0.0::DOUBLE), (1, 0.5), (2, 1.0), (3, 1.5)) t(id, phase)")
def _(spark, sf_dir):
    return constructors.graph_from_iter(spark, [0.0, 0.5, 1.0, 1.5], "phase double").vertices.select("id", "payload.phase")


@query("complete_graph", "SELECT CAST(0 AS BIGINT) AS graph_id, a.i AS src, b.i AS dst FROM range(40) a(i), range(40) b(i) WHERE a.i <> b.i")
def _(spark, sf_dir):
    return constructors.complete_graph(spark, 40).edges


@query("init_ring", f"WITH r AS {RING.format(n=300, d=3)} SELECT src, dst FROM r UNION ALL SELECT dst, src FROM r")
def _(spark, sf_dir):
    return constructors.init_ring(constructors.graph_new(spark, 300), 3).edges.select("src", "dst")


@query("init_ring_2", f"WITH r AS {RING.format(n=300, d=2)} SELECT src, dst, dst AS orig_dst FROM r UNION ALL SELECT dst, src, NULL FROM r")
def _(spark, sf_dir):
    return constructors.init_ring_2(constructors.graph_new(spark, 300)).edges.select("src", "dst", "orig_dst")


@query("graph_from_generic", f"WITH r AS {RING.format(n=300, d=2)} SELECT src, dst FROM r UNION ALL SELECT dst, src FROM r")
def _(spark, sf_dir):
    return constructors.graph_from_generic(constructors.init_ring_2(constructors.graph_new(spark, 300))).edges.select("src", "dst")


@query("reset_from_graph", on("g_supp", "SELECT v.id, count(e.dst) AS degree FROM (SELECT i AS id FROM range(2000) r(i)) v LEFT JOIN e ON e.src = v.id GROUP BY v.id"))
def _(spark, sf_dir):
    g = constructors.reset_from_graph(constructors.graph_new(spark, 2000), derived(spark, sf_dir, "g_supp"))
    return access.degrees(g).select("id", "degree")


@query("load_json", on("g_mid", "SELECT src, dst FROM e"))
def _(spark, sf_dir):
    path = f"{shared_dir(spark)}/netloom-json-{uuid.uuid4().hex}"
    dot.save_json(derived(spark, sf_dir, "g_mid"), path, prob=F.lit(0.016), c_target=F.lit(2.0))
    return dot.load_json(spark, path).edges.select("src", "dst")


# ------------------------------------------------------------ 2.2 mutations


def _some_pairs(spark):
    return spark.range(8).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


@query("add_edge", on("g_supp", "SELECT src, dst FROM e UNION SELECT i, i + 1 FROM range(8) r(i) UNION SELECT i + 1, i FROM range(8) r(i)"))
def _(spark, sf_dir):
    return mutate.add_edges(derived(spark, sf_dir, "g_supp"), _some_pairs(spark)).edges.select("src", "dst")


@query("add_edge_status", on("g_supp", "SELECT i AS src, i + 1 AS dst, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.src = i AND e.dst = i + 1) THEN 'exists' ELSE 'ok' END AS status FROM range(8) r(i)"))
def _(spark, sf_dir):
    return mutate.edge_status(derived(spark, sf_dir, "g_supp"), _some_pairs(spark)).select("src", "dst", "status")


@query("remove_edge", on("g_supp", "SELECT src, dst FROM e WHERE NOT (least(src, dst) < 8 AND abs(src - dst) = 1)"))
def _(spark, sf_dir):
    return mutate.remove_edges(derived(spark, sf_dir, "g_supp"), _some_pairs(spark)).edges.select("src", "dst")


@query("clear_edges", on("g_supp", "SELECT id, CAST(0 AS BIGINT) AS degree FROM v"))
def _(spark, sf_dir):
    return access.degrees(mutate.clear_edges(derived(spark, sf_dir, "g_supp"))).select("id", "degree")


@query("sort_adj", on("g_supp", "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS adj_pos FROM e"))
def _(spark, sf_dir):
    return mutate.sort_adj(derived(spark, sf_dir, "g_supp")).edges.select("src", "dst", "adj_pos")


@query("shuffle_adjs", on("g_supp", f"SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {uniform_sql(42, 'adj', 'src', 'dst')}, dst) - 1 AS adj_pos FROM e"))
def _(spark, sf_dir):
    return mutate.shuffle_adjs(derived(spark, sf_dir, "g_supp"), 42).edges.select("src", "dst", "adj_pos")


@query("shuffle_adj", on("g_supp", f"SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN src = 3 THEN {uniform_sql(42, 'adj', 'src', 'dst')} END, dst) - 1 AS adj_pos FROM e"))
def _(spark, sf_dir):
    return mutate.shuffle_adjs(derived(spark, sf_dir, "g_supp"), 42, vertex=3).edges.select("src", "dst", "adj_pos")


@query("payload_update", on("g_supp", "SELECT id, CASE WHEN id = 3 THEN -1 ELSE key END AS key FROM v"))
def _(spark, sf_dir):
    g = mutate.payload_update(derived(spark, sf_dir, "g_supp"), F.col("id") == 3, F.struct(F.lit(-1).cast("long").alias("key")))
    return g.vertices.select("id", "payload.key")


SW_SQL = f"WITH r AS {RING.format(n=10, d=2)}, h AS (SELECT src, dst, dst AS orig_dst FROM r UNION ALL SELECT dst, src, NULL FROM r) "


def _sw10(spark):
    return constructors.init_ring_2(constructors.graph_new(spark, 10))


@query("sw_push_root", SW_SQL + "SELECT src, dst, orig_dst FROM h UNION ALL VALUES (CAST(0 AS BIGINT), CAST(5 AS BIGINT), CAST(5 AS BIGINT)), (5, 0, NULL)")
def _(spark, sf_dir):
    new = spark.createDataFrame([(0, 0, 5), (0, 0, 1)], "graph_id long, src long, dst long")
    return mutate.sw_push_root(_sw10(spark).edges, new).select("src", "dst", "orig_dst")


REWIRED = "SELECT src, dst, orig_dst FROM h WHERE NOT ((src = 0 AND dst = 1) OR (src = 1 AND dst = 0)) UNION ALL VALUES (CAST(0 AS BIGINT), CAST(5 AS BIGINT), CAST(1 AS BIGINT)), (5, 0, NULL)"


@query("sw_rewire_edge", SW_SQL + REWIRED)
def _(spark, sf_dir):
    return mutate.sw_rewire_edge(_sw10(spark).edges, 0, 1, 5)[0].select("src", "dst", "orig_dst")


@query("sw_rewire_status", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(5 AS BIGINT), 'changed'), (0, 2, 2, 'nothing'), (3, 4, 2, 'blocked'), (4, 3, 9, 'invalid')) t(i, old, new, status)")
def _(spark, sf_dir):
    wanted = [(0, 0, 1, 5), (0, 0, 2, 2), (0, 3, 4, 2), (0, 4, 3, 9)]
    return mutate.sw_change(_sw10(spark).edges, spark.createDataFrame(wanted, "graph_id long, i long, old long, new long"))[1].select("i", "old", "new", "status")


@query("sw_reset_edge", SW_SQL + "SELECT src, dst, orig_dst FROM h")
def _(spark, sf_dir):
    moved = materialize(mutate.sw_rewire_edge(_sw10(spark).edges, 0, 1, 5)[0])
    return mutate.sw_reset_edge(moved, 0, 5)[0].select("src", "dst", "orig_dst")


def _ws20(spark):
    ring = constructors.ring_edges(constructors.graph_new(spark, 20).vertices, F.lit(20), 2)
    empty = ring.limit(0).select("graph_id", "src", "dst", F.col("src").alias("orig_src"), F.col("dst").alias("orig_dst"), F.lit(True).alias("at_origin"))
    return mutate.ws_push(empty, ring)


WS_SQL = f"WITH r AS {RING.format(n=20, d=2)}, h AS (SELECT src, dst, src AS orig_src, dst AS orig_dst, true AS at_origin FROM r UNION ALL SELECT dst, src, src, dst, true FROM r) "


@query("ws_push", WS_SQL + "SELECT * FROM h")
def _(spark, sf_dir):
    return _ws20(spark).drop("graph_id")


@query("ws_remove", WS_SQL + "SELECT * FROM h WHERE NOT (least(src, dst) < 8 AND abs(src - dst) = 1)")
def _(spark, sf_dir):
    return mutate.ws_remove(_ws20(spark), _some_pairs(spark)).drop("graph_id")


# ------------------------------------------------------------ 2.3 access


@query("vertex_count", on("g_all", "SELECT count(*) AS vertex_count FROM v"))
def _(spark, sf_dir):
    return access.vertex_count(derived(spark, sf_dir, "g_all")).select("vertex_count")


@query("edge_count", on("g_all", "SELECT count(*) AS edge_count FROM ce"))
def _(spark, sf_dir):
    return access.edge_count(derived(spark, sf_dir, "g_all")).select("edge_count")


@query("at", on("g_supp", "SELECT id, key FROM v WHERE id = 3"))
def _(spark, sf_dir):
    return access.at(derived(spark, sf_dir, "g_supp"), 3).select("id", "payload.key")


@query("container", on("g_supp", "SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS adj FROM e WHERE src = 3 GROUP BY src"))
def _(spark, sf_dir):
    return access.container(derived(spark, sf_dir, "g_supp"), 3).select("id", F.array_join(F.col("adj").cast("array<string>"), ",").alias("adj"))


@query("get_vertices", on("g_part", "SELECT v.id, v.key, coalesce(string_agg(e.dst::VARCHAR, ',' ORDER BY e.dst), '') AS adj FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id, v.key"))
def _(spark, sf_dir):
    return access.containers(derived(spark, sf_dir, "g_part")).select("id", "payload.key", F.array_join(F.col("adj").cast("array<string>"), ",").alias("adj"))


@query("container_iter_neighbors", on("g_supp", "SELECT v.id, v.key, (SELECT count(*) FROM e x WHERE x.src = v.id) AS degree FROM v JOIN e ON e.dst = v.id WHERE e.src = 3"))
def _(spark, sf_dir):
    g = derived(spark, sf_dir, "g_supp")
    near = access.neighbor_vertices(g, 3)
    return near.join(access.degrees(g), ["graph_id", "id"]).select("id", "payload.key", "degree")


@query("contained_iter", on("g_supp", "SELECT key FROM v"))
def _(spark, sf_dir):
    return access.payloads(derived(spark, sf_dir, "g_supp")).select("key")


@query("contained_iter_neighbors", on("g_supp", "SELECT v.key FROM e JOIN v ON v.id = e.dst WHERE e.src = 3"))
def _(spark, sf_dir):
    return access.neighbor_vertices(derived(spark, sf_dir, "g_supp"), 3).select("payload.key")


@query("contained_iter_neighbors_with_index", on("g_supp", "SELECT v.id, v.key FROM e JOIN v ON v.id = e.dst WHERE e.src = 3"))
def _(spark, sf_dir):
    return access.neighbor_vertices(derived(spark, sf_dir, "g_supp"), 3).select("id", "payload.key")


@query("neighbors", on("g_supp", "SELECT dst FROM e WHERE src = 3"))
def _(spark, sf_dir):
    return access.neighbors(derived(spark, sf_dir, "g_supp"), 3).select("dst")


@query("edges", on("g_supp", "SELECT src, dst FROM e WHERE src = 3"))
def _(spark, sf_dir):
    return access.raw_edges(derived(spark, sf_dir, "g_supp"), 3).select("src", "dst")


@query("get_adj_first", on("g_supp", "SELECT src AS id, min(dst) AS first FROM e GROUP BY src"))
def _(spark, sf_dir):
    return access.adj_first(derived(spark, sf_dir, "g_supp")).select("id", "first")


@query("is_adjacent", on("g_supp", "SELECT i AS src, i + 1 AS dst, EXISTS (SELECT 1 FROM e WHERE e.src = i AND e.dst = i + 1) AS is_adjacent FROM range(8) r(i)"))
def _(spark, sf_dir):
    return access.is_adjacent(derived(spark, sf_dir, "g_supp"), _some_pairs(spark)).select("src", "dst", "is_adjacent")


@query("degree", on("g_supp", f", {DEG} SELECT id, degree FROM deg WHERE id = 3"))
def _(spark, sf_dir):
    return access.degree(derived(spark, sf_dir, "g_supp"), 3).select("id", "degree")


@query("degree_vec", on("g_all", f", {DEG} SELECT id, degree FROM deg"))
def _(spark, sf_dir):
    return access.degrees(derived(spark, sf_dir, "g_all")).select("id", "degree")


@query("sw_count_root", "SELECT i AS id, CAST(2 AS BIGINT) AS roots FROM range(10) r(i)")
def _(spark, sf_dir):
    return access.sw_count_root(_sw10(spark).edges).select("id", "roots")


@query("sw_iter_raw_edges", SW_SQL + "SELECT src, dst, orig_dst FROM h WHERE src = 4")
def _(spark, sf_dir):
    return access.raw_edges(_sw10(spark), 4).select("src", "dst", "orig_dst")


@query("sw_edge_predicates", SW_SQL + f", m AS ({REWIRED}) SELECT src, dst, orig_dst IS NOT NULL AS is_root, orig_dst IS NOT DISTINCT FROM dst AS is_at_root, coalesce(orig_dst <> dst, false) AS is_long_ranging FROM m")
def _(spark, sf_dir):
    return access.sw_edge_predicates(mutate.sw_rewire_edge(_sw10(spark).edges, 0, 1, 5)[0]).drop("graph_id")


@query("iterator_adaptors", on("g_supp", "(SELECT 'nth' AS what, id, key FROM v ORDER BY id LIMIT 1 OFFSET 4) UNION ALL (SELECT 'next_back', id, key FROM v ORDER BY id DESC LIMIT 1)"))
def _(spark, sf_dir):
    v = derived(spark, sf_dir, "g_supp").vertices
    first, last = access.nth(v, 4, "id"), access.nth(v, -1, "id")
    return first.select(F.lit("nth").alias("what"), "id", "payload.key").unionByName(last.select(F.lit("next_back").alias("what"), "id", "payload.key"))


# ------------------------------------------------------------ 2.4 traversals


@query("bfs_index_depth", on("g_mid", DIST + "SELECT d.id, v.key, CAST(d.d AS BIGINT) AS depth FROM dist d JOIN v ON v.id = d.id WHERE s = 0"))
def _(spark, sf_dir):
    g = derived(spark, sf_dir, "g_mid")
    return traverse.bfs(g, 0).join(g.vertices, ["graph_id", "id"]).select("id", "payload.key", "depth")


FILTERED = """, fv AS (SELECT id FROM v WHERE id % 5 <> 1), fe AS (SELECT e.* FROM e JOIN fv a ON a.id = e.src JOIN fv b ON b.id = e.dst),
walk(id, d) AS (SELECT id, 0 FROM fv WHERE id = 0 UNION SELECT fe.dst, w.d + 1 FROM walk w JOIN fe ON fe.src = w.id WHERE w.d < 40) """


@query("bfs_filtered", on("g_mid", FILTERED + "SELECT id, CAST(min(d) AS BIGINT) AS depth FROM walk GROUP BY id"))
def _(spark, sf_dir):
    return traverse.bfs_filtered(derived(spark, sf_dir, "g_mid"), 0, F.col("id") % 5 != 1).select("id", "depth")


@query("bfs_filtered_is_handled", on("g_mid", FILTERED + "SELECT v.id, v.id % 5 = 1 OR v.id IN (SELECT id FROM walk) AS handled FROM v"))
def _(spark, sf_dir):
    return traverse.is_handled(derived(spark, sf_dir, "g_mid"), 0, F.col("id") % 5 != 1).select("id", "handled")


@query("bfs_filtered_reuse", on("g_mid", FILTERED.replace("id % 5 <> 1", "id % 7 <> 2").replace("WHERE id = 0", "WHERE id = 1") + "SELECT id, CAST(min(d) AS BIGINT) AS depth FROM walk GROUP BY id"))
def _(spark, sf_dir):
    return traverse.bfs_filtered(derived(spark, sf_dir, "g_mid"), 1, F.col("id") % 7 != 2).select("id", "depth")


@query("bfs_reuse", on("g_supp", DIST + "SELECT s AS source, id, CAST(d AS BIGINT) AS depth FROM dist"))
def _(spark, sf_dir):
    return traverse.all_sources(derived(spark, sf_dir, "g_supp")).select("source", "id", "depth")


@query("dfs", on("g_mid", ", r(id) AS (SELECT CAST(0 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT id FROM r"))
def _(spark, sf_dir):
    return traverse.dfs(derived(spark, sf_dir, "g_mid"), 0).select("id")


@query("dfs_with_index", on("g_mid", ", r(id) AS (SELECT CAST(0 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT v.id, v.key FROM r JOIN v ON v.id = r.id"))
def _(spark, sf_dir):
    g = derived(spark, sf_dir, "g_mid")
    return traverse.dfs(g, 0).join(g.vertices, ["graph_id", "id"]).select("id", "payload.key")


DFS = """, near AS (SELECT src, list(dst ORDER BY dst) AS ids FROM e GROUP BY src),
walk(pos, id, stack, seen) AS (
  SELECT CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), [CAST(0 AS BIGINT)], [CAST(0 AS BIGINT)]
  UNION ALL
  SELECT pos + 1, top, rest || new, seen || new FROM (
    SELECT pos, seen, stack[len(stack)] AS top, stack[1:len(stack) - 1] AS rest, list_filter(coalesce(near.ids, []), lambda x: NOT list_contains(seen, x)) AS new
    FROM walk LEFT JOIN near ON near.src = stack[len(stack)] WHERE len(stack) > 0)
)
"""


@query("dfs_order", on("g_mid", DFS + "SELECT pos AS visit_pos, id FROM walk WHERE pos >= 0"))
def _(spark, sf_dir):
    return traverse.dfs(derived(spark, sf_dir, "g_mid"), 0).select("visit_pos", "id")


@query("dfs_mut", on("g_mid", DFS + "SELECT v.id, CASE WHEN walk.pos >= 0 THEN 1000 * walk.pos + v.key ELSE v.key END AS key FROM v LEFT JOIN walk ON walk.id = v.id"))
def _(spark, sf_dir):
    g = traverse.dfs_mut(derived(spark, sf_dir, "g_mid"), 0, F.struct((1000 * F.col("visit_pos") + F.col("payload.key")).alias("key")))
    return g.vertices.select("id", "payload.key")


@query("bfs_index_depth_mut", on("g_mid", DIST + ", o AS (SELECT id, d, row_number() OVER (ORDER BY d, id) - 1 AS pos FROM dist WHERE s = 0) SELECT v.id, CASE WHEN pos IS NOT NULL THEN CAST(d * 1000 + pos AS BIGINT) ELSE v.key END AS key FROM v LEFT JOIN o ON o.id = v.id"))
def _(spark, sf_dir):
    g = traverse.bfs_mut(derived(spark, sf_dir, "g_mid"), 0, F.struct((1000 * F.col("depth") + F.col("visit_pos")).alias("key")))
    return g.vertices.select("id", "payload.key")


# ------------------------------------------------------------ 2.5 measures


@query("average_degree", on("g_all", "SELECT CAST(CAST(2 * (SELECT count(*) FROM ce) AS FLOAT) / (SELECT count(*) FROM v) AS FLOAT) AS average_degree"))
def _(spark, sf_dir):
    return measures.average_degree(derived(spark, sf_dir, "g_all")).select("average_degree")


@query("degree_histogram", on("g_all", f", {DEG}, b AS (SELECT unnest(range((SELECT min(degree) FROM deg), (SELECT max(degree) FROM deg) + 1)) AS degree) SELECT b.degree, count(deg.id) AS n FROM b LEFT JOIN deg ON deg.degree = b.degree GROUP BY b.degree"))
def _(spark, sf_dir):
    return measures.degree_histogram(derived(spark, sf_dir, "g_all")).select("degree", "n")


@query("leaf_count", on("g_all", f", {DEG} SELECT count(*) AS leaf_count FROM deg WHERE degree = 1"))
def _(spark, sf_dir):
    return measures.leaf_count(derived(spark, sf_dir, "g_all")).select("leaf_count")


@query("is_connected", on("g_part", REACH + "SELECT count(*) = 1 AS is_connected FROM lab WHERE id = label"))
def _(spark, sf_dir):
    return measures.is_connected(derived(spark, sf_dir, "g_part")).select("is_connected")


@query("connected_components_ids", on("g_part", REACH + "SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS component FROM lab"))
def _(spark, sf_dir):
    return measures.connected_components_ids(derived(spark, sf_dir, "g_part")).select("id", "component")


@query("connected_components", on("g_part", REACH + ", c AS (SELECT label, count(*) AS size FROM lab GROUP BY label) SELECT row_number() OVER (ORDER BY size DESC, label) - 1 AS rank, size FROM c"))
def _(spark, sf_dir):
    return measures.connected_components(derived(spark, sf_dir, "g_part")).select("rank", "size")


@query("suggest_connections", on("g_part", REACH + "SELECT id FROM lab WHERE id = label"))
def _(spark, sf_dir):
    return measures.suggest_connections(derived(spark, sf_dir, "g_part")).select("id")


def _core_sql(q: int, rounds: int = 14) -> str:
    parts = ["k0 AS MATERIALIZED (SELECT id FROM v)"]
    parts += [f"k{i + 1} AS MATERIALIZED (SELECT a.id FROM k{i} a JOIN e ON e.src = a.id JOIN k{i} b ON b.id = e.dst GROUP BY a.id HAVING count(*) >= {q})" for i in range(rounds)]
    last = f"k{rounds}"
    parts.append(f"r(s, id) AS (SELECT id, id FROM {last} UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.id JOIN {last} k ON k.id = e.dst)")
    return ", " + ",\n".join(parts) + " SELECT coalesce(max(n), 0) AS q_core FROM (SELECT s, count(*) AS n FROM r GROUP BY s)"


for _q in (2, 3):

    @query(f"q_core_{_q}" if _q != 3 else "q_core", on("g_mid", _core_sql(_q)))
    def _(spark, sf_dir, q=_q):
        return measures.q_core(derived(spark, sf_dir, "g_mid"), q).select("q_core")


@query("diameter", on("g_mid", DIST + "SELECT CASE WHEN (SELECT count(*) FROM dist) = (SELECT count(*) * count(*) FROM v) THEN CAST(max(d) AS BIGINT) END AS diameter FROM dist"))
def _(spark, sf_dir):
    return measures.diameter(derived(spark, sf_dir, "g_mid")).select("diameter")


@query("longest_shortest_path_from_index", on("g_mid", DIST + "SELECT CAST(max(d) AS BIGINT) AS longest FROM dist WHERE s = 5"))
def _(spark, sf_dir):
    return measures.longest_shortest_path(derived(spark, sf_dir, "g_mid"), 5).select("longest")


TRANS = "SELECT round((SELECT count(*) FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE b.dst <> a.src) / (SELECT sum(d * (d - 1)) FROM (SELECT count(*) AS d FROM e GROUP BY src))::DOUBLE, 9) AS transitivity"


for _n, _g in (("transitivity", "g_all"), ("transitivity_dense", "g_user")):

    @query(_n, on(_g, TRANS))
    def _(spark, sf_dir, g=_g):
        return measures.transitivity(derived(spark, sf_dir, g)).select(F.round("transitivity", 9).alias("transitivity"))


# Two edges of a vertex x are in one component if their other ends are connected without x.
BLOCKS = """,
r(x, s, id) AS (SELECT src, dst, dst FROM e UNION SELECT r.x, r.s, e.dst FROM r JOIN e ON e.src = r.id WHERE e.dst <> r.x),
num AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS k FROM ce),
half AS (SELECT src, dst, k FROM num UNION ALL SELECT dst, src, k FROM num),
near AS (SELECT DISTINCT a.k AS k1, b.k AS k2 FROM r JOIN half a ON a.src = r.x AND a.dst = r.s JOIN half b ON b.src = r.x AND b.dst = r.id),
blk(k0, k) AS (SELECT k, k FROM num UNION SELECT blk.k0, near.k2 FROM blk JOIN near ON near.k1 = blk.k),
lab AS (SELECT k, min(k0) AS block FROM blk GROUP BY k),
sized AS (SELECT block, count(DISTINCT half.src) AS size FROM lab JOIN half ON half.k = lab.k GROUP BY block)
"""


@query("vertex_biconnected_components", on("g_mid", BLOCKS + "SELECT row_number() OVER (ORDER BY size DESC) - 1 AS rank, size FROM sized"))
def _(spark, sf_dir):
    return measures.vertex_biconnected_components(derived(spark, sf_dir, "g_mid")).select("rank", "size")


@query("biconnected_forest", on("g_part", "SELECT count(*) AS components, CAST(sum(2) AS BIGINT) AS vertices FROM ce"))
def _(spark, sf_dir):
    """g_part is a forest at the tested scales: every edge is a component of two."""
    sizes = measures.vertex_biconnected_components(derived(spark, sf_dir, "g_part"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("vertices"))


def _sw_moved(spark):
    return Graph(constructors.graph_new(spark, 10).vertices, mutate.sw_rewire_edge(_sw10(spark).edges, 0, 1, 5)[0])


@query("sw_count_nodes_long_ranging", "SELECT CAST(2 AS BIGINT) AS nodes, 0.2::DOUBLE AS frac_nodes")
def _(spark, sf_dir):
    return measures.sw_long_ranging(_sw_moved(spark)).select("nodes", "frac_nodes")


@query("sw_count_long_ranging_edges", "SELECT CAST(1 AS BIGINT) AS edges, 0.05::DOUBLE AS frac_edges")
def _(spark, sf_dir):
    return measures.sw_long_ranging(_sw_moved(spark)).select("edges", "frac_edges")


# ------------------------------------------------------------ 2.6 centralities


def _load_sql(include: bool, levels: int = 13) -> str:
    parts = ["pr AS MATERIALIZED (SELECT x.s, x.id AS v, e.dst AS p, x.d, 1.0::DOUBLE / count(*) OVER (PARTITION BY x.s, x.id) AS part FROM dist x JOIN e ON e.src = x.id JOIN dist y ON y.s = x.s AND y.id = e.dst AND y.d = x.d - 1)"]
    parts.append(f"c{levels + 1} AS (SELECT 0 AS s, 0 AS v, 0.0::DOUBLE AS got WHERE false)")
    parts += [f"c{d} AS MATERIALIZED (SELECT pr.s, pr.p AS v, sum(part * (1 + coalesce(got, 0))) AS got FROM pr LEFT JOIN c{d + 1} c ON c.s = pr.s AND c.v = pr.v WHERE d = {d} GROUP BY pr.s, pr.p)" for d in range(levels, 1, -1)]
    union = " UNION ALL ".join(f"SELECT v, got FROM c{d}" for d in range(levels, 1, -1))
    if include:
        union += " UNION ALL SELECT id, 1.0 FROM dist WHERE s <> id"
    return DIST + ", " + ",\n".join(parts) + f" SELECT v.id, round(coalesce(sum(x.got), 0.0), 6) AS load FROM v LEFT JOIN ({union}) x ON x.v = v.id GROUP BY v.id"


for _i in (False, True):

    @query("vertex_load_endpoints" if _i else "vertex_load", on("g_mid", _load_sql(_i)))
    def _(spark, sf_dir, include=_i):
        return measures.vertex_load(derived(spark, sf_dir, "g_mid"), include).select("id", F.round("load", 6).alias("load"))


@query("closeness_centrality", on("g_supp", DIST + "SELECT id, round(((SELECT count(*) FROM v) - 1) / sum(d)::DOUBLE, 9) AS closeness FROM dist GROUP BY id"))
def _(spark, sf_dir):
    return measures.closeness_centrality(derived(spark, sf_dir, "g_supp")).select("id", F.round("closeness", 9).alias("closeness"))


# ------------------------------------------------------------ 2.7 transforms


@query("clone_topology", on("g_supp", "SELECT id, key * 2 AS twice FROM v"))
def _(spark, sf_dir):
    return transform.clone_topology(derived(spark, sf_dir, "g_supp"), F.struct((F.col("payload.key") * 2).alias("twice"))).vertices.select("id", "payload.twice")


@query("cloned_subgraph", on("g_supp", ", w AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM v WHERE id % 3 = 0) SELECT a.n AS src, b.n AS dst FROM e JOIN w a ON a.id = e.src JOIN w b ON b.id = e.dst"))
def _(spark, sf_dir):
    g = derived(spark, sf_dir, "g_supp")
    return transform.cloned_subgraph(g, g.vertices.where("id % 3 = 0")).edges.select("src", "dst")


CHAIN = "SELECT * FROM (SELECT id AS src, lead(id) OVER (ORDER BY id) AS dst FROM lab WHERE id = label) WHERE dst IS NOT NULL"


@query("erc_make_connected", on("g_part", REACH + CHAIN))
def _(spark, sf_dir):
    return transform.chain_components(derived(spark, sf_dir, "g_part")).select("src", "dst")


# ------------------------------------------------------------ 2.8 ensembles with exact SQL

PAIRS = "SELECT a.i AS src, b.i AS dst FROM range({n}) a(i), range({n}) b(i) WHERE a.i < b.i"


def _er_c_sql(n: int, c: float, samples: int) -> str:
    """Geometric gaps from each vertex to its next partner above it."""
    return f"""WITH RECURSIVE d(graph_id, src, k, dst) AS (
  SELECT g.i, v.i, CAST(0 AS BIGINT), v.i FROM range({samples}) g(i), range({n}) v(i)
  UNION ALL
  SELECT graph_id, src, k + 1, dst + 1 + CAST(floor(ln(1 - {uniform_sql(42, 'er_c', 'graph_id', 'src', 'k + 1')}) / ln(1 - {c} / {n - 1}.0)) AS BIGINT) FROM d WHERE dst < {n}
), ce AS (SELECT graph_id, src, dst FROM d WHERE k > 0 AND dst < {n})"""


@query("er_c", _er_c_sql(300, 4.0, 3) + " SELECT graph_id, src, dst FROM ce")
def _(spark, sf_dir):
    return ensembles.er_c(spark, 300, 4.0, 42, 3).canonical


@query("er_m_dense", f"SELECT graph_id, src, dst FROM (SELECT g.i AS graph_id, src, dst, row_number() OVER (PARTITION BY g.i ORDER BY {uniform_sql(42, 'er_m', 'g.i', 'src', 'dst')}, src, dst) AS k FROM range(3) g(i), ({PAIRS.format(n=40)})) WHERE k <= 600")
def _(spark, sf_dir):
    return ensembles.er_m(spark, 40, 600, 42, 3).canonical


@query("er_m", f"""WITH drawn AS (SELECT g.i AS graph_id, k.i AS k, CAST(floor({uniform_sql(42, 'er_m_a', 'g.i', 'k.i')} * 300) AS BIGINT) AS a, CAST(floor({uniform_sql(42, 'er_m_b', 'g.i', 'k.i')} * 299) AS BIGINT) AS b FROM range(3) g(i), range(1264) k(i)),
firsts AS (SELECT graph_id, least(a, b + (b >= a)::BIGINT) AS src, greatest(a, b + (b >= a)::BIGINT) AS dst, min(k) AS k FROM drawn GROUP BY ALL)
SELECT graph_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY k) AS r FROM firsts) WHERE r <= 600""")
def _(spark, sf_dir):
    return ensembles.er_m(spark, 300, 600, 42, 3).canonical


AT = f"pos AS (SELECT i AS id, {uniform_sql(42, 'x', '0', 'i')} AS x, {uniform_sql(42, 'y', '0', 'i')} AS y FROM range(200) r(i))"
D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
SP = f"1.5 * pow(1 + {math.sqrt(200 * math.pi)!r} * {D} / 2.5, -2.5)"


def _distance_sql(points: str, p: str, stream: str) -> str:
    """The edges of 200 points: their finest grid has 4 x 4 cells, so every pair of cells is a pair of blocks of level 2.

    ``points``: CTEs up to pos(id, x, y); ``p``: the probability at a distance D.
    """
    z = "(cx % 2) + 2 * (cy % 2) + 4 * (cx // 2) + 8 * (cy // 2)"
    return f"""WITH RECURSIVE {points},
cell AS (SELECT id, x, y, least(floor(x * 4), 3)::BIGINT AS cx, least(floor(y * 4), 3)::BIGINT AS cy FROM pos),
spot AS (SELECT *, {z} AS z, row_number() OVER (ORDER BY {z}, id) - 1 AS p FROM cell),
blk AS (SELECT z, cx, cy, min(p) AS s, count(*) AS n FROM spot GROUP BY z, cx, cy),
met AS (SELECT a.z AS za, b.z AS zb, a.s AS sa, b.s AS sb, a.n AS na, b.n AS nb,
  sqrt(pow(greatest(abs(a.cx - b.cx) - 1, 0), 2) + pow(greatest(abs(a.cy - b.cy) - 1, 0), 2)) / 4.0 AS d FROM blk a JOIN blk b ON b.z >= a.z),
bound AS (SELECT *, least(1.0, {p.replace('D', 'd')}) AS top FROM met),
draw(za, zb, sa, sb, na, nb, top, k, t) AS (
  SELECT za, zb, sa, sb, na, nb, top, CAST(0 AS BIGINT), CAST(-1 AS BIGINT) FROM bound
  UNION ALL
  SELECT za, zb, sa, sb, na, nb, top, k + 1, t + 1 + CASE WHEN top < 1 THEN CAST(floor(ln(1 - {uniform_sql(42, stream + '_gap', '0', '2', 'za', 'zb', 'k + 1')}) / ln(1 - top)) AS BIGINT) ELSE 0 END FROM draw WHERE t < na * nb
),
cand AS (SELECT sa + t // nb AS a, sb + t % nb AS b, top FROM draw WHERE k > 0 AND t < na * nb),
pair AS (SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, top, {D} AS d FROM cand JOIN spot a ON a.p = cand.a JOIN spot b ON b.p = cand.b WHERE cand.a < cand.b)
SELECT src, dst FROM pair WHERE {uniform_sql(42, stream, '0', 'src', 'dst')} * top <= {p.replace('D', 'd')}"""


@query("spatial", _distance_sql(AT, SP.replace(D, "D"), "spatial"))
def _(spark, sf_dir):
    return ensembles.spatial(spark, 200, 1.5, 2.5, 42).canonical.select("src", "dst")


def _near_pairs(spark, n):
    return spark.range(n - 1).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


@query("spatial_distance", f"WITH {AT} SELECT a.id AS src, b.id AS dst, round({D}, 9) AS distance FROM pos a JOIN pos b ON b.id = a.id + 1")
def _(spark, sf_dir):
    return ensembles.spatial_distance(ensembles.positions(spark, 200, 42), _near_pairs(spark, 200)).select("src", "dst", F.round("distance", 9).alias("distance"))


@query("spatial_edge_probability", f"WITH {AT} SELECT a.id AS src, b.id AS dst, round(least(1.0, greatest(0.0, {SP})), 9) AS probability FROM pos a JOIN pos b ON b.id = a.id + 1")
def _(spark, sf_dir):
    return ensembles.spatial_edge_probability(ensembles.positions(spark, 200, 42), _near_pairs(spark, 200), 200, 1.5, 2.5).select("src", "dst", F.round("probability", 9).alias("probability"))


LHS = f"lhs AS (SELECT i AS id, row_number() OVER (ORDER BY {uniform_sql(42, 'lhs_x', '0', 'i')}, i) - 1 AS x, row_number() OVER (ORDER BY {uniform_sql(42, 'lhs_y', '0', 'i')}, i) - 1 AS y FROM range(200) r(i))"


@query("latin_hypercube_2d", f"WITH {LHS} SELECT id, x, y FROM lhs")
def _(spark, sf_dir):
    return ensembles.latin_hypercube_2d(spark, 200, 42).select("id", "x", "y")


@query("dog", _distance_sql(f"{LHS}, pos AS (SELECT id, x / 200.0::DOUBLE AS x, y / 200.0::DOUBLE AS y FROM lhs)", "(1 - pow(exp(-D * 12.0) - 1, 2))", "dog"))
def _(spark, sf_dir):
    return ensembles.dog_base(spark, 200, 12.0, 42).canonical.select("src", "dst")


@query("degree_vec_is_valid", on("g_all", f", {DEG} SELECT count(*) > 1 AND max(degree) < count(*) - 1 AND sum(degree) % 2 = 0 AS valid FROM deg"))
def _(spark, sf_dir):
    return ensembles.degree_vec_is_valid(access.degrees(derived(spark, sf_dir, "g_all"))).select("valid")


# ------------------------------------------------------------ 2.8 - 2.10 sequential models: invariants that SQL predicts


def _sampled(name, model, params, measures_, sql, samples=20):
    @query(name, sql)
    def _(spark, sf_dir):
        return ensembles.simple_sample(ensembles.samples_frame(spark, model, params, 42, samples), measures_)


_sampled("sw", "sw", {"n": 60, "r": 0.15}, ["edges", "leaves"], "SELECT i AS graph_id, 120.0::DOUBLE AS edges, 0.0::DOUBLE AS leaves FROM range(20) r(i)")
_sampled("sw_with_distance", "sw", {"n": 60, "r": 0.15, "distance": 3}, ["edges"], "SELECT i AS graph_id, 180.0::DOUBLE AS edges FROM range(20) r(i)")
_sampled("ws", "ws", {"n": 60, "distance": 2, "p": 0.2}, ["edges"], "SELECT i AS graph_id, 120.0::DOUBLE AS edges FROM range(20) r(i)")
_sampled("ba", "ba", {"n": 80, "m": 2}, ["edges", "components"], "SELECT i AS graph_id, 157.0::DOUBLE AS edges, 1.0::DOUBLE AS components FROM range(20) r(i)")
_sampled("ba_from_graph", "ba", {"n": 60, "m": 3, "seed_n": 4, "seed_edges": [[0, 1], [0, 2], [0, 3], [1, 2], [1, 3], [2, 3]]}, ["edges", "components"], "SELECT i AS graph_id, 174.0::DOUBLE AS edges, 1.0::DOUBLE AS components FROM range(20) r(i)")
_sampled("config_from_const", "config", {"degrees": [3] * 40}, ["edges", "min_degree"], "SELECT i AS graph_id, 60.0::DOUBLE AS edges, 3.0::DOUBLE AS min_degree FROM range(20) r(i)")
_sampled("dog_extra", "dog", {"n": 60, "kappa": 12.0, "tau": 0.5, "lam": 2.0}, ["edges", "components"], None)


def _hub_share(g):
    """A measure that a user would write: the share of vertices with more than five neighbours."""
    return sum(g.degree(v) > 5 for v in range(g.n)) / g.n


# The sequential model asks its generator for one number a pair, in the order of the pairs.
DRAWN = """WITH pr AS (SELECT a.i AS src, b.i AS dst, row_number() OVER (ORDER BY a.i, b.i) AS k FROM range(50) a(i), range(50) b(i) WHERE a.i < b.i),
ce AS (SELECT g.i AS g, src, dst FROM range(20) g(i), pr WHERE ('0x' || substr(md5(concat_ws(':', '42.' || g.i, 'er_c', k)), 1, 13))::BIGINT / 4503599627370496.0 <= 4.0 / 49),
e AS (SELECT g, src, dst FROM ce UNION ALL SELECT g, dst, src FROM ce),
deg AS (SELECT g.i AS g, v.i AS id, count(e.dst) AS d FROM range(20) g(i) CROSS JOIN range(50) v(i) LEFT JOIN e ON e.g = g.i AND e.src = v.i GROUP BY g.i, v.i),
closed AS (SELECT a.g, count(*) AS t FROM e a JOIN e b ON b.g = a.g AND b.src = a.dst JOIN e c ON c.g = a.g AND c.src = a.src AND c.dst = b.dst WHERE b.dst <> a.src GROUP BY a.g)
SELECT deg.g AS graph_id, sum(d) / 2.0 AS edges, CAST(count(*) FILTER (WHERE d = 1) AS DOUBLE) AS leaves, round(coalesce(any_value(t), 0) / sum(d * (d - 1))::DOUBLE, 9) AS transitivity, round(count(*) FILTER (WHERE d > 5) / 50.0, 9)::DOUBLE AS hubs
FROM deg LEFT JOIN closed ON closed.g = deg.g GROUP BY deg.g"""


@query("simple_sample", DRAWN.replace("sum(d) / 2.0 AS edges", "CAST(sum(d) / 2 AS DOUBLE) AS edges"))
def _(spark, sf_dir):
    """Named measures and one of the user's."""
    found = ensembles.simple_sample(ensembles.samples_frame(spark, "er_c", {"n": 50, "c": 4.0}, 42, 20), {"edges": "edges", "leaves": "leaves", "transitivity": "transitivity", "hubs": _hub_share})
    return found.select("graph_id", "edges", "leaves", F.round("transitivity", 9).alias("transitivity"), F.round("hubs", 9).alias("hubs"))


_sampled("simple_sample_measures", "er_c", {"n": 50, "c": 4.0}, ["edges", "q_core_3", "transitivity", "diameter"], None)


@query("simple_sample_vec", _er_c_sql(50, 4.0, 20) + " SELECT graph_id, CAST(count(*) AS DOUBLE) AS edges FROM ce GROUP BY graph_id")
def _(spark, sf_dir):
    return ensembles.measure_grouped(ensembles.er_c(spark, 50, 4.0, 42, 20), ["edges"])


@query("config_model", on("g_mid", f", {DEG} SELECT g.i AS graph_id, deg.id, degree FROM deg, range(3) g(i)"))
def _(spark, sf_dir):
    g = derived(spark, sf_dir, "g_mid")
    return access.degrees(ensembles.config_from_degrees(access.degrees(g).select("id", "degree"), 42, 3)).select("graph_id", "id", "degree")


# Each step asks for three numbers, after one for each of the 1225 pairs of the start. An edge i-j is 50 i + j.
STEP_SQL = """WITH RECURSIVE pr AS (SELECT a.i * 50 + b.i AS code, row_number() OVER (ORDER BY a.i, b.i) AS k FROM range(50) a(i), range(50) b(i) WHERE a.i < b.i),
start AS (SELECT gs.i AS g, list(code) FILTER (WHERE ('0x' || substr(md5(concat_ws(':', '42.' || gs.i, 'er_c', k)), 1, 13))::BIGINT / 4503599627370496.0 <= 4.0 / 49) AS es FROM range(10) gs(i), pr GROUP BY gs.i),
walk(g, t, es, kind, a, b) AS (
  SELECT g, CAST(0 AS BIGINT), es, '', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM start
  UNION ALL
  SELECT g, t + 1, CASE kind WHEN 'add' THEN list_append(es, code) WHEN 'remove' THEN list_filter(es, lambda x: x <> code) ELSE es END, kind, i, j2
  FROM (SELECT *, CASE WHEN grow = list_contains(es, code) THEN 'nothing' WHEN grow THEN 'add' ELSE 'remove' END AS kind
        FROM (SELECT g, t, es, i, grow, j + (j >= i)::BIGINT AS j2, least(i, j + (j >= i)::BIGINT) * 50 + greatest(i, j + (j >= i)::BIGINT) AS code
              FROM (SELECT g, t, es, CAST(floor(U1 * 50) AS BIGINT) AS i, CAST(floor(U2 * 49) AS BIGINT) AS j, U3 <= 4.0 / 49 AS grow FROM walk WHERE t < 100))))
SELECT g AS graph_id, t AS step_no, kind, a, b FROM walk WHERE t > 0"""
for _k in (1, 2, 3):
    STEP_SQL = STEP_SQL.replace(f"U{_k}", f"(('0x' || substr(md5(concat_ws(':', '42.' || g, 'er_c', 1225 + 3 * t + {_k})), 1, 13))::BIGINT / 4503599627370496.0)")
STEPS = {"er_c": {"n": 50, "c": 4.0}, "er_m": {"n": 50, "m": 100}, "sw": {"n": 50, "r": 0.3}, "config": {"degrees": [3] * 40}, "spatial": {"n": 50, "f": 1.5, "alpha": 2.5}}
for _m, _p in STEPS.items():

    @query(f"undo_{_m}", "SELECT i AS graph_id, CAST(0 AS BIGINT) AS differing FROM range(10) r(i)")
    def _(spark, sf_dir, m=_m, p=_p):
        """Edges that differ between the start and the state after 100 steps and their undoing."""
        rows = ensembles.steps_and_undo(ensembles.samples_frame(spark, m, p, 42, 10), 100).where("stage <> 'after'")
        both = rows.groupBy("graph_id", "src", "dst").agg(F.count_distinct("stage").alias("k"))
        return both.groupBy("graph_id").agg(F.count_if(F.col("k") < 2).alias("differing"))

    @query(f"m_step_{_m}", STEP_SQL if _m == "er_c" else "SELECT i AS graph_id, CAST(100 AS BIGINT) AS steps FROM range(10) r(i)")
    def _(spark, sf_dir, m=_m, p=_p):
        """The records of 100 steps; of models whose start SQL can't follow, how many there are."""
        if m == "er_c":
            return ensembles.step_log(ensembles.samples_frame(spark, m, p, 42, 10), 100).select("graph_id", "step_no", "kind", "a", "b")
        return ensembles.step_log(ensembles.samples_frame(spark, m, p, 42, 10), 100).groupBy("graph_id").agg(F.count("kind").alias("steps"))


@query("reject_chain", "SELECT i AS graph_id, true AS kept FROM range(10) r(i)")
def _(spark, sf_dir):
    return ensembles.reject_chain(ensembles.samples_frame(spark, "sw", {"n": 40, "r": 0.3}, 42, 10), 100, "largest", 38).select("graph_id", (F.col("value") >= 38).alias("kept"))


def _u(counter: str) -> str:
    """The sequential generator's number of a counter, for sample g of seed 42."""
    return f"(('0x' || substr(md5(concat_ws(':', '42.' || g, 'er_c', {counter})), 1, 13))::BIGINT / 4503599627370496.0)"


# The chain with the same numbers: 10 Markov steps a proposal, three numbers a step, one for the verdict. An edge i-j is 60 i + j.
CHAIN_SQL = f"""WITH RECURSIVE pr AS (SELECT a.i * 60 + b.i AS code, row_number() OVER (ORDER BY a.i, b.i) AS k FROM range(60) a(i), range(60) b(i) WHERE a.i < b.i),
start AS (SELECT g.i AS g, list(code) AS es FROM range(8) g(i), pr WHERE {_u('k').replace("'42.' || g,", "'42.' || g.i,")} <= 6.0 / 59 GROUP BY g.i),
walk(g, t, ctr, es, old, ok) AS (
  SELECT g, 0, 1770, es, es, true FROM start
  UNION ALL
  SELECT g, t + 1, CASE WHEN (t + 1) % 10 = 0 THEN ctr + 4 ELSE ctr + 3 END,
         CASE WHEN (t + 1) % 10 = 0 AND NOT acc THEN old ELSE nxt END,
         CASE WHEN (t + 1) % 10 = 0 AND acc THEN nxt ELSE old END,
         acc
  FROM (
    SELECT *, {_u('ctr + 4')} <= exp(least(0.0, -(len(nxt) - len(old)) / 5.0)) AS acc FROM (
      SELECT *, CASE WHEN grow AND NOT list_contains(es, code) THEN list_append(es, code) WHEN NOT grow THEN list_filter(es, lambda x: x <> code) ELSE es END AS nxt FROM (
        SELECT *, least(i, j + (j >= i)::BIGINT) * 60 + greatest(i, j + (j >= i)::BIGINT) AS code FROM (
          SELECT *, CAST(floor({_u('ctr + 1')} * 60) AS BIGINT) AS i, CAST(floor({_u('ctr + 2')} * 59) AS BIGINT) AS j, {_u('ctr + 3')} <= 6.0 / 59 AS grow FROM walk WHERE t < 200
        ))))
), chain AS (SELECT g AS graph_id, CAST(t // 10 AS BIGINT) AS counter, CAST(len(es) AS DOUBLE) AS energy, ok AS accepted FROM walk WHERE t % 10 = 0 AND t > 0)
"""


def _chain(spark, **more):
    return ensembles.metropolis(ensembles.samples_frame(spark, "er_c", {"n": 60, "c": 6.0}, 42, 8), 20, 10, 5.0, "edges", **more)


@query("metropolis", CHAIN_SQL + "SELECT graph_id, counter, energy, accepted FROM chain")
def _(spark, sf_dir):
    return _chain(spark)


@query("metropolis_while", CHAIN_SQL + "SELECT graph_id, counter, energy, accepted, energy AS seen FROM chain c WHERE NOT EXISTS (SELECT 1 FROM chain b WHERE b.graph_id = c.graph_id AND b.counter < c.counter AND b.energy <= 160)")
def _(spark, sf_dir):
    """A stop condition and an observed measure of the user's."""
    return _chain(spark, stop=lambda counter, energy: energy <= 160, observe={"seen": lambda g: g.m})


@query("metropolis_energy")
def _(spark, sf_dir):
    return ensembles.metropolis(ensembles.samples_frame(spark, "er_c", {"n": 60, "c": 6.0}, 42, 8), 20, 10, -10.0, "diameter", connected=True)


@query("entropic")
def _(spark, sf_dir):
    return ensembles.entropic(ensembles.samples_frame(spark, "er_c", {"n": 12, "c": 2.0}, 42, 4), 6, 18, "edges", 2000, 2000)


@query("resume", "SELECT i AS graph_id, CAST(0 AS BIGINT) AS differing FROM range(5) r(i)")
def _(spark, sf_dir):
    """States of 60 steps at once against those of 25, saved, and 35 more; differing ones."""
    drawn = ensembles.samples_frame(spark, "sw", {"n": 40, "r": 0.3}, 42, 5)
    whole, halves = ensembles.states(drawn, 60), ensembles.resume(ensembles.states(drawn, 25), 35)
    return whole.join(halves.withColumnRenamed("state", "again"), "graph_id").select("graph_id", F.when(F.col("state") == F.col("again"), 0).otherwise(1).cast("long").alias("differing"))


@query("wang_landau")
def _(spark, sf_dir):
    return ensembles.wang_landau(ensembles.samples_frame(spark, "er_c", {"n": 12, "c": 2.0}, 42, 4), 6, 18, "edges", 2000)


@query("sw_make_connected", "SELECT i AS graph_id, 1.0::DOUBLE AS components FROM range(10) r(i)")
def _(spark, sf_dir):
    import json

    import pyarrow as pa

    from netloom.operators import kernels

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                m = kernels.build(r["model"], r["seed"], json.loads(r["params"]))
                m.make_connected()
                yield pa.RecordBatch.from_arrays([pa.array([r["graph_id"]], pa.int64()), pa.array([kernels.MEASURES["components"](m.g)], pa.float64())], names=["graph_id", "components"])

    return ensembles.samples_frame(spark, "sw", {"n": 40, "r": 0.9}, 42, 10).mapInArrow(run, "graph_id long, components double")


@query("histogram", on("g_supp", f", {DEG} SELECT b.i AS bin, count(deg.id) AS hits FROM range(10, 31) b(i) LEFT JOIN deg ON deg.degree = b.i GROUP BY b.i"))
def _(spark, sf_dir):
    return measures.histogram(access.degrees(derived(spark, sf_dir, "g_supp")), "degree", 10, 30).select("bin", "hits")


# ------------------------------------------------------------ 2.11 dual graphs


def _dual(spark, sf_dir):
    one, two = derived(spark, sf_dir, "g_supp"), derived(spark, sf_dir, "g_part")
    key = lambda g, c: g.vertices.select("graph_id", F.col("id").alias(f"id{c}"), F.col("payload.key").alias(f"k{c}"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity <= 2").select(F.col("l_suppkey").cast("long").alias("k1"), F.col("l_partkey").cast("long").alias("k2")).distinct()
    cross = lines.join(key(one, 1), "k1").join(key(two, 2).drop("graph_id"), "k2").select("graph_id", "id1", "id2")
    return dual.DualGraph(one, two, cross)


def on_dual(body: str) -> str:
    one = graph_sql("g_supp").replace("raw AS", "raw1 AS").replace("FROM raw ", "FROM raw1 ").replace("p AS (SELECT DISTINCT", "p1 AS (SELECT DISTINCT").replace("FROM p UNION", "FROM p1 UNION").replace("SELECT b FROM p)", "SELECT b FROM p1)").replace("FROM p JOIN", "FROM p1 p JOIN").replace("v AS (", "v1 AS (").replace("JOIN v s", "JOIN v1 s").replace("JOIN v d", "JOIN v1 d").replace("ce AS (", "ce1 AS (").replace("e AS (SELECT src", "e1 AS (SELECT src").replace("FROM ce", "FROM ce1")
    two = graph_sql("g_part").replace("raw AS", "raw2 AS").replace("FROM raw ", "FROM raw2 ").replace("p AS (SELECT DISTINCT", "p2 AS (SELECT DISTINCT").replace("FROM p UNION", "FROM p2 UNION").replace("SELECT b FROM p)", "SELECT b FROM p2)").replace("FROM p JOIN", "FROM p2 p JOIN").replace("v AS (", "v2 AS (").replace("JOIN v s", "JOIN v2 s").replace("JOIN v d", "JOIN v2 d").replace("ce AS (", "ce2 AS (").replace("e AS (SELECT src", "e2 AS (SELECT src").replace("FROM ce", "FROM ce2")
    return f"""WITH RECURSIVE {one},
{two},
n1 AS (SELECT count(*) AS n FROM v1),
x AS (SELECT DISTINCT v1.id AS id1, v2.id AS id2 FROM lineitem JOIN v1 ON v1.key = l_suppkey JOIN v2 ON v2.key = l_partkey WHERE l_quantity <= 2),
v AS (SELECT id, 1 AS layer, id AS own FROM v1 UNION ALL SELECT id + n, 2, id FROM v2, n1),
e AS (SELECT src, dst FROM e1 UNION ALL SELECT src + n, dst + n FROM e2, n1 UNION ALL SELECT id1, id2 + n FROM x, n1 UNION ALL SELECT id2 + n, id1 FROM x, n1){body if body.startswith(',') else ' ' + body}"""


@query("dual_new", on_dual("SELECT count(*) AS edges FROM e"))
def _(spark, sf_dir):
    return _dual(spark, sf_dir).unified().edges.agg(F.count(F.lit(1)).alias("edges"))


@query("dual_add_edge", on_dual("SELECT id1, id2 FROM x UNION SELECT (SELECT max(id) FROM v1), (SELECT max(id) FROM v2)"))
def _(spark, sf_dir):
    d = _dual(spark, sf_dir)
    n = d.sizes().first()
    at = (n["n1"] - 1, n["n2"] - 1)
    if d.cross.where((F.col("id1") == at[0]) & (F.col("id2") == at[1])).limit(1).count():
        return d.cross.select("id1", "id2")
    return dual.add_edge(d, *at).cross.select("id1", "id2")


@query("dual_accessors", on_dual("SELECT (SELECT count(*) FROM v1) AS n1, (SELECT count(*) FROM v2) AS n2, (SELECT count(*) FROM v) AS total_vertices"))
def _(spark, sf_dir):
    return dual.total_vertices(_dual(spark, sf_dir)).drop("graph_id")


@query("dual_degree", on_dual("SELECT v.layer, v.own AS id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.layer, v.own"))
def _(spark, sf_dir):
    return dual.dual_degree(_dual(spark, sf_dir)).select("layer", "id", "degree")


@query("dual_dfs_index", on_dual(", r(id) AS (SELECT CAST(0 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT v.layer, v.own AS id FROM r JOIN v ON v.id = r.id"))
def _(spark, sf_dir):
    return dual.dual_dfs(_dual(spark, sf_dir), 1, 0).select("layer", "id")


@query("dual_dfs_contained", on_dual(", r(id) AS (SELECT CAST(0 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT v.layer, v.own AS id, v1.key AS key_1, v2.key AS key_2 FROM r JOIN v ON v.id = r.id LEFT JOIN v1 ON v.layer = 1 AND v1.id = v.own LEFT JOIN v2 ON v.layer = 2 AND v2.id = v.own"))
def _(spark, sf_dir):
    return dual.dual_dfs_contained(_dual(spark, sf_dir), 1, 0).select("layer", "id", F.col("payload_1.key").alias("key_1"), F.col("payload_2.key").alias("key_2"))


@query("dual_bfs_index", on_dual(", walk(id, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, w.d + 1 FROM walk w JOIN e ON e.src = w.id WHERE w.d < 30) SELECT v.layer, v.own AS id, CAST(min(d) AS BIGINT) AS depth FROM walk JOIN v ON v.id = walk.id GROUP BY v.layer, v.own"))
def _(spark, sf_dir):
    return dual.dual_bfs(_dual(spark, sf_dir), 1, 0).select("layer", "id", "depth")


@query("dual_is_connected", on_dual(", r(id) AS (SELECT CAST(0 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT (SELECT count(*) FROM r) = (SELECT count(*) FROM v) AS is_connected"))
def _(spark, sf_dir):
    return dual.dual_is_connected(_dual(spark, sf_dir)).select("is_connected")


def _dual_rings(spark):
    ring = lambda: constructors.init_ring(constructors.graph_new(spark, 6), 1)
    return dual.DualGraph(ring(), ring(), spark.createDataFrame([(0, 0, 0)], "graph_id long, id1 long, id2 long"))


@query("dual_diameter", "SELECT CAST(7 AS BIGINT) AS diameter")
def _(spark, sf_dir):
    return dual.dual_diameter(_dual_rings(spark)).select("diameter")


@query("dual_neighbors", on_dual("SELECT 0 AS src_kind, 1 AS layer, dst AS id FROM e1 WHERE src = 3 UNION ALL SELECT 1, 2, id2 FROM x WHERE id1 = 3"))
def _(spark, sf_dir):
    return dual.dual_neighbors(_dual(spark, sf_dir), 1, 3).select("src_kind", "layer", "id")


@query("dual_single_iters", on_dual("SELECT id1 AS id, id2 AS partner FROM x"))
def _(spark, sf_dir):
    return dual.partners(_dual(spark, sf_dir), 1).select("id", "partner")


@query("adj_trait", on_dual("SELECT 1 AS layer, id1 AS id, count(*) AS partners FROM x GROUP BY id1 HAVING count(*) > 1 UNION ALL SELECT 2, id2, count(*) FROM x GROUP BY id2 HAVING count(*) > 1"))
def _(spark, sf_dir):
    return dual.violations(_dual(spark, sf_dir)).select("layer", "id", "partners")


# ------------------------------------------------------------ 2.12 sinks

DOT_HEAD = "(SELECT 0 AS part, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, 'graph G{{' AS line UNION ALL SELECT 0, 1, 0, chr(9) || '{o}' UNION ALL SELECT 0, 2, 0, chr(9) || string_agg(id::VARCHAR, ' ' ORDER BY id) || ' ;' FROM v)"
DOT_TAIL = " UNION ALL SELECT 3, src, dst, chr(9) || src || ' -- ' || dst FROM ce UNION ALL SELECT 4, 0, 0, '}'"


def _dot(name: str, label_sql: str, label, options: str = ""):
    @query(name, on("g_part", f", {DEG} SELECT * FROM {DOT_HEAD.format(o=options)} UNION ALL SELECT 2, v.id, 0, chr(9) || '\"' || v.id || '\" [label=\"' || {label_sql} || '\"];' FROM v JOIN deg ON deg.id = v.id{DOT_TAIL}"))
    def _(spark, sf_dir):
        return dot.dot_lines(derived(spark, sf_dir, "g_part"), label(), options).select("part", "a", "b", "line")


_dot("dot", "''", lambda: None)
_dot("dot_with_indices", "v.id", lambda: F.col("id").cast("string"), "splines=true;")
_dot("dot_from_indices", "'vertex ' || v.id", lambda: F.concat(F.lit("vertex "), "id"))
_dot("dot_from_contained", "'key ' || v.key", lambda: F.concat(F.lit("key "), F.col("payload.key")))
_dot("dot_from_container", "'degree ' || deg.degree", lambda: F.concat(F.lit("degree "), F.size("adj")))


@query("to_dot", on("g_part", "SELECT 0 AS part, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, 'graph{' AS line UNION ALL SELECT 0, 1, 0, chr(9) || string_agg(id::VARCHAR, ' ' ORDER BY id) || ' ' FROM v" + DOT_TAIL))
def _(spark, sf_dir):
    return dot.dot_lines(derived(spark, sf_dir, "g_part"), legacy=True).select("part", "a", "b", "line")


@query("spatial_dot", f"""WITH {AT} SELECT chr(9) || '"' || id || '" [label="' || id || '" pos="' || format('{{:.2f}}', x * 100.0) || ',' || format('{{:.2f}}', y * 100.0) || '!"];' AS line FROM pos""")
def _(spark, sf_dir):
    g = Graph(ensembles.positions(spark, 200, 42), spark.createDataFrame([], constructors.EDGES))
    return dot.dot_lines(g, F.col("id").cast("string"), positions=True).where("part = 2").select("line")


@query("to_dot_with_labels", on("g_part", f"SELECT string_agg(line, chr(10) ORDER BY part, a, b) AS dot FROM (SELECT * FROM {DOT_HEAD.format(o='splines=true;')} UNION ALL SELECT 2, v.id, 0, chr(9) || '\"' || v.id || '\" [label=\"key ' || v.key || '\"];' FROM v{DOT_TAIL})"))
def _(spark, sf_dir):
    return dot.to_dot_with_labels(derived(spark, sf_dir, "g_part"), "splines=true;", F.concat(F.lit("key "), F.col("payload.key"))).select("dot")


@query("dog_dot", f"""WITH {LHS} SELECT chr(9) || '"' || id || '" [label="' || id || '" pos="' || format('{{:.2f}}', x / 200.0 * 100.0) || ',' || format('{{:.2f}}', y / 200.0 * 100.0) || '!"];' AS line FROM lhs""")
def _(spark, sf_dir):
    return dot.dog_dot(ensembles.dog_base(spark, 200, 12.0, 42)).where("part = 2").select("line")


@query("load_fields", "SELECT CAST(0 AS BIGINT) AS graph_id, 0.016::DOUBLE AS prob, 2.0::DOUBLE AS c_target, '1' AS rng_state, '2' AS rng_increment")
def _(spark, sf_dir):
    path = f"{shared_dir(spark)}/netloom-json-{uuid.uuid4().hex}"
    dot.save_json(derived(spark, sf_dir, "g_mid"), path, prob=F.lit(0.016).cast("double"), c_target=F.lit(2.0), rng=F.struct(F.lit("1").alias("state"), F.lit("2").alias("increment")))
    return dot.load_fields(spark, path).select("graph_id", "prob", "c_target", F.col("rng.state").alias("rng_state"), F.col("rng.increment").alias("rng_increment"))


@query("save_json", on("g_mid", "SELECT v.id, coalesce(string_agg(e.dst::VARCHAR, ',' ORDER BY e.dst), '') AS adj FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id"))
def _(spark, sf_dir):
    state = dot.json_state(derived(spark, sf_dir, "g_mid")).select(F.from_json("json", dot.STATE).alias("s"))
    return state.select(F.explode("s.graph.vertices").alias("v")).select("v.id", F.array_join(F.col("v.adj").cast("array<string>"), ",").alias("adj"))
