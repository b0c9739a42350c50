"""The same measures with one task for each graph: one job instead of one for every round.

For ensembles of many graphs that are small each; the caller asks for it
(``in_tasks``), the loops over tables are the default at every size.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.model import Graph
from netloom.operators import kernels

MARK = -1


def per_graph(graph: Graph, schema: str, f: Callable[..., dict[str, list]], marked: DataFrame | None = None) -> DataFrame:
    """``f(adjacency, ids)`` of every graph as one group; ids[k] is the id of index k, and f's lists become columns.

    ``marked`` (graph_id, id) rows go to the groups too; f then gets their indices as a third argument.
    """
    rows = graph.vertices.select("graph_id", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")).unionByName(graph.topology().where("src < dst"))
    if marked is not None:
        rows = rows.unionByName(marked.select("graph_id", F.col("id").alias("src"), F.lit(MARK).cast("long").alias("dst")))
    plain = marked is None  # the closure must not hold a DataFrame
    fields = [x.split() for x in schema.split(",")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(key, t):
        pairs = list(zip(t.column("src").to_pylist(), t.column("dst").to_pylist(), strict=True))
        ids = sorted({a for a, b in pairs if b is None})
        index = {v: k for k, v in enumerate(ids)}
        g = kernels.Adjacency.of_edges(len(ids), [(index[a], index[b]) for a, b in pairs if b is not None and b != MARK])
        out = f(g, ids) if plain else f(g, ids, sorted({index[a] for a, b in pairs if b == MARK and a in index}))
        n = len(next(iter(out.values())))
        return pa.table({"graph_id": pa.array([key[0].as_py()] * n, pa.int64()), **{name: pa.array(out[name], kinds[kind]) for name, kind in fields}})

    return rows.groupBy("graph_id").applyInArrow(run, f"graph_id long, {schema}")


def labels(graph: Graph) -> DataFrame:
    def f(g, ids):
        label = [-1] * g.n
        for v in range(g.n):
            if label[v] < 0:
                for w in kernels.distances(g, v):
                    label[w] = v
        return {"id": ids, "label": [ids[k] for k in label]}

    return per_graph(graph, "id long, label long", f)


def q_core(graph: Graph, q: int) -> DataFrame:
    return per_graph(graph, "q_core long", lambda g, ids: {"q_core": [kernels.q_core(g, q)]})


def diameter(graph: Graph) -> DataFrame:
    return per_graph(graph, "diameter long", lambda g, ids: {"diameter": [kernels.diameter(g)]})


def vertex_load(graph: Graph, include_endpoints: bool) -> DataFrame:
    return per_graph(graph, "id long, load double", lambda g, ids: {"id": ids, "load": kernels.vertex_load(g, include_endpoints)})


def distances(graph: Graph, index: int | None) -> DataFrame:
    """graph_id, source, id, depth from one index, or from every vertex."""

    def f(g, ids):
        starts = range(g.n) if index is None else [k for k, v in enumerate(ids) if v == index]
        rows = [(ids[s], ids[v], d) for s in starts for v, d in kernels.distances(g, s).items()]
        return {"source": [r[0] for r in rows], "id": [r[1] for r in rows], "depth": [r[2] for r in rows]}

    return per_graph(graph, "source long, id long, depth long", f)


def from_sources(graph: Graph, sources: DataFrame) -> DataFrame:
    """graph_id, source, id, depth of what each (graph_id, source) reaches."""

    def f(g, ids, starts):
        rows = [(ids[s], ids[v], d) for s in starts for v, d in kernels.distances(g, s).items()]
        return {"source": [r[0] for r in rows], "id": [r[1] for r in rows], "depth": [r[2] for r in rows]}

    return per_graph(graph, "source long, id long, depth long", f, sources.select("graph_id", F.col("source").alias("id")))


def closeness(graph: Graph) -> DataFrame:
    def f(g, ids):
        sums = [sum(kernels.distances(g, v).values()) for v in range(g.n)]
        return {"id": ids, "closeness": [(g.n - 1) / s if s else float("inf") for s in sums]}

    return per_graph(graph, "id long, closeness double", f)


def biconnected(graph: Graph) -> DataFrame:
    """graph_id, label, size of every biconnected component; labels tell equal sizes apart."""

    def f(g, ids):
        sizes = kernels.biconnected_sizes(g.edges())
        return {"label": list(range(len(sizes))), "size": sizes}

    return per_graph(graph, "label long, size long", f)


def biconnected_of_components(edges: DataFrame) -> DataFrame:
    """graph_id, label, size of every biconnected component, from the edges (bin, graph_id, label, src, dst) of whole components, one task for each bin."""

    def run(t):
        of: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for g, label, a, b in zip(*(t.column(c).to_pylist() for c in ("graph_id", "label", "src", "dst")), strict=True):
            of.setdefault((g, label), []).append((a, b))
        rows = [(g, label, n) for (g, label), part in of.items() for n in kernels.biconnected_sizes(part)]
        return pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("graph_id", "label", "size"))})

    return edges.groupBy("bin").applyInArrow(run, "graph_id long, label long, size long")
