"""Measures of whole graphs and of vertices.

Relational where one plan expresses the measure; loops over tables in the
shared folder where the number of rounds depends on the data; one group for
each graph only where the algorithm is sequential, or where the caller asks for
it (``in_tasks``, for many small graphs; same results).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.model import Graph, symmetric
from netloom.operators import searches, small
from netloom.operators.access import degrees, edge_count, vertex_count
from netloom.operators.traverse import bfs, filtered, multi_source_bfs
from netloom.plans.fixpoint import iterate
from netloom.plans.ordering import with_rank
from netloom.plans.skew import hot_keys, spread_join
from netloom.session import Levels, discard, materialize

#: Edges of a connected component that is searched in a task, and of all that one task takes at once.
FEW_EDGES = 1 << 18


def average_degree(graph: Graph) -> DataFrame:
    """2E/V in single precision."""
    both = vertex_count(graph).join(edge_count(graph), "graph_id")
    return both.select("graph_id", ((2 * F.col("edge_count")).cast("float") / F.col("vertex_count")).cast("float").alias("average_degree"))


def degree_histogram(graph: Graph) -> DataFrame:
    """graph_id, degree, n for every degree from the least to the greatest, empty bins included."""
    counts = degrees(graph).groupBy("graph_id", "degree").agg(F.count(F.lit(1)).alias("n"))
    bins = counts.groupBy("graph_id").agg(F.min("degree").alias("lo"), F.max("degree").alias("hi")).select("graph_id", F.explode(F.sequence("lo", "hi")).alias("degree"))
    return bins.join(counts, ["graph_id", "degree"], "left").select("graph_id", "degree", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def leaf_count(graph: Graph) -> DataFrame:
    return degrees(graph).groupBy("graph_id").agg(F.count_if(F.col("degree") == 1).alias("leaf_count"))


def labels(graph: Graph, in_tasks: bool = False) -> DataFrame:
    """graph_id, id, label: the least index of the component.

    Each round a vertex takes the least label among its own, its neighbours'
    and its label's label; the jump makes long paths take logarithmically many rounds.
    """
    if in_tasks:
        return small.labels(graph)
    edges = graph.topology()
    least = edges.groupBy("graph_id", F.col("src").alias("id")).agg(F.min("dst").alias("m"))
    start = graph.vertices.select("graph_id", "id").join(least, ["graph_id", "id"], "left").select("graph_id", "id", F.least("id", "m").alias("label"), F.lit(True).alias("changed"))
    at = F.struct("graph_id", "dst").alias("at")
    hubs = hot_keys(edges.groupBy(at).agg(F.count(F.lit(1)).alias("n")), "at")

    def step(state: DataFrame, _: int) -> DataFrame:
        now = state.select("graph_id", "id", "label")
        reached = spread_join(edges.select("src", at), now.select(F.struct("graph_id", F.col("id").alias("dst")).alias("at"), "label"), "at", hubs, "src")
        near = reached.groupBy("at.graph_id", F.col("src").alias("id")).agg(F.min("label").alias("near"))
        of = F.struct("graph_id", "label").alias("of")
        shared = hot_keys(now.groupBy(of).agg(F.count(F.lit(1)).alias("n")), "of")
        jump = now.select(F.struct("graph_id", F.col("id").alias("label")).alias("of"), F.col("label").alias("jump"))
        new = F.least("label", "near", "jump")
        both = spread_join(now.withColumn("of", of), jump, "of", shared, "id", "left").drop("of").join(near, ["graph_id", "id"], "left")
        return both.select("graph_id", "id", new.alias("new"), (new < F.col("label")).alias("changed")).withColumnRenamed("new", "label")

    return iterate(start, step)


def connected_components_ids(graph: Graph, in_tasks: bool = False) -> DataFrame:
    """graph_id, id, component: components numbered by their least member, from 0."""
    found = labels(graph, in_tasks)
    roots = with_rank(found.where("id = label").select("graph_id", "label"), "label", out="component")
    return found.join(roots, ["graph_id", "label"]).select("graph_id", "id", "component")


def connected_components(graph: Graph, in_tasks: bool = False) -> DataFrame:
    """graph_id, rank, size: component sizes, descending."""
    sizes = labels(graph, in_tasks).groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("size"))
    return with_rank(sizes, F.desc("size"), "label").select("graph_id", "rank", "size")


def suggest_connections(graph: Graph, in_tasks: bool = False) -> DataFrame:
    """graph_id, id: the least vertex of each component."""
    return labels(graph, in_tasks).where("id = label").select("graph_id", "id")


def is_connected(graph: Graph, in_tasks: bool = False) -> DataFrame:
    return labels(graph, in_tasks).groupBy("graph_id").agg((F.count_if(F.col("id") == F.col("label")) == 1).alias("is_connected"))


def core(graph: Graph, q: int) -> Graph:
    """The q-core: vertices of degree under q removed until none is left. All of a round go at once, and
    rounds carry only the degrees of vertices that lost a neighbour: as many rounds as the longest cascade."""
    edges = graph.topology()
    gone = Levels(graph.vertices.sparkSession, "round")
    weak = gone.write(degrees(graph).where(F.col("degree") < q).select("graph_id", "id"), 0)
    state, k = materialize(degrees(graph).where(F.col("degree") >= q)), 0
    while weak.limit(1).count():
        k += 1
        lost = weak.join(edges.select("graph_id", F.col("src").alias("id"), "dst"), ["graph_id", "id"]).groupBy("graph_id", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("lost"))
        after = materialize(state.join(lost, ["graph_id", "id"], "left").select("graph_id", "id", (F.col("degree") - F.coalesce("lost", F.lit(0))).alias("degree")))
        discard(state)
        weak = gone.write(after.where(F.col("degree") < q).select("graph_id", "id"), k)
        state = after.where(F.col("degree") >= q)
        state._netloom_path = after._netloom_path
    return filtered(Graph(graph.vertices.join(state.select("graph_id", "id"), ["graph_id", "id"], "left_semi"), edges), F.lit(True))


def q_core(graph: Graph, q: int, in_tasks: bool = False) -> DataFrame:
    """graph_id, q_core: size of the largest component of the q-core, 0 if it is empty; null if q < 2."""
    ids = graph.vertices.select("graph_id").distinct()
    if q < 2:
        return ids.withColumn("q_core", F.lit(None).cast("long"))
    if in_tasks:
        return small.q_core(graph, q)
    sizes = labels(core(graph, q).materialized()).groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("graph_id").agg(F.max("n").alias("n"))
    return ids.join(sizes, "graph_id", "left").select("graph_id", F.coalesce("n", F.lit(0)).cast("long").alias("q_core"))


def diameter(graph: Graph, in_tasks: bool = False) -> DataFrame:
    """graph_id, diameter; null for a disconnected graph, whose all-source search is not run."""
    if in_tasks:
        return small.diameter(graph)
    found = materialize(labels(graph))
    whole = materialize(found.groupBy("graph_id").agg((F.count_if(F.col("id") == F.col("label")) == 1).alias("is_connected")))
    ok = whole.where("is_connected").select("graph_id")
    part = Graph(graph.vertices.join(ok, "graph_id", "left_semi"), graph.edges.join(ok, "graph_id", "left_semi"))
    far = searches.deepest(part, found.join(ok, "graph_id", "left_semi")).groupBy("graph_id").agg(F.max("depth").alias("diameter"))
    return whole.select("graph_id").join(far, "graph_id", "left")


def longest_shortest_path(graph: Graph, index: int, in_tasks: bool = False) -> DataFrame:
    """The eccentricity of one vertex inside its component."""
    return bfs(graph, index, in_tasks).groupBy("graph_id").agg(F.max("depth").alias("longest"))


def transitivity(graph: Graph) -> DataFrame:
    """Closed two-paths over two-paths; NaN without a two-path.

    Edges point from the lower to the higher degree, so that the wedges of a
    hub are not listed: each triangle is found once, at its lowest vertex. To
    every neighbour a vertex sends those that follow it in this order, one list
    an edge in place of a row a wedge; a neighbour counts what it shares of it.
    """
    d = materialize(degrees(graph))
    paths = d.groupBy("graph_id").agg(F.sum(F.col("degree") * (F.col("degree") - 1)).alias("paths"))
    kind = "int" if (d.agg(F.max("id")).first()[0] or 0) < 1 << 31 else "long"
    end = lambda c: d.select("graph_id", F.col("id").alias(c), F.struct("degree", F.col("id").cast(kind).alias("id")).alias(f"{c}_at")).hint("shuffle_hash")
    e = graph.canonical.select("graph_id", "src", "dst").join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"])
    up = e.select("graph_id", F.least("src_at", "dst_at")["id"].alias("low"), F.greatest("src_at", "dst_at").alias("high")).repartition("graph_id", "low")
    of = F.struct("graph_id", F.col("low").alias("id")).alias("of")
    lists = materialize(up.groupBy("graph_id", "low").agg(F.transform(F.sort_array(F.collect_list("high")), lambda x: x["id"]).alias("above")).select(of, "above"))
    each = lists.select(F.col("of.graph_id").alias("graph_id"), F.col("of.id").alias("low"), "above", F.posexplode("above").alias("k", "id")).where(F.col("k") < F.size("above") - 1)
    sent = each.select(F.struct("graph_id", "id").alias("of"), "low", F.slice("above", F.col("k") + 2, F.size("above")).alias("rest"))
    hubs = hot_keys(d.select(F.struct("graph_id", F.col("id").cast(kind).alias("id")).alias("of"), F.col("degree").alias("n")), "of")
    both = spread_join(sent, lists.hint("shuffle_hash"), "of", hubs, "low")
    triangles = both.groupBy("of.graph_id").agg(F.sum(F.size(F.array_intersect("rest", "above"))).alias("t"))
    both = paths.join(triangles, "graph_id", "left")
    return both.select("graph_id", F.when(F.col("paths") == 0, F.lit(float("nan"))).otherwise(6.0 * F.coalesce("t", F.lit(0)) / F.when(F.col("paths") != 0, F.col("paths"))).alias("transitivity"))


def _search_tree(graph: Graph) -> tuple[DataFrame, int]:
    """graph_id, id, depth, parent of a breadth-first forest from the least vertex of each component, and its depth."""
    roots = labels(graph).where("id = label").select("graph_id", F.col("id").alias("source"))
    seen = multi_source_bfs(graph, roots).select("graph_id", "id", "depth")
    ends = lambda c: seen.select("graph_id", F.col("id").alias(c), F.col("depth").alias(f"{c}_depth"))
    up = graph.topology().join(ends("src"), ["graph_id", "src"]).join(ends("dst"), ["graph_id", "dst"]).where("dst_depth = src_depth - 1")
    parent = up.groupBy("graph_id", F.col("src").alias("id")).agg(F.min("dst").alias("parent"))
    tree = materialize(seen.join(parent, ["graph_id", "id"], "left").select("graph_id", "id", "depth", "parent"))
    return tree, tree.agg(F.max("depth")).first()[0] or 0


def _upwards(rows: DataFrame, deepest: int, own: dict, merge: dict) -> DataFrame:
    """``rows`` with the columns of ``own`` merged with those of all vertices below, level by level from the deepest one.

    own: name -> expression of a vertex's own value; merge: name -> (aggregate over children, combination of two columns).
    """
    levels, below = Levels(rows.sparkSession, "level"), None
    for d in range(deepest, -1, -1):
        here = rows.where(F.col("depth") == d).withColumns(own)
        if below is not None:
            here = here.join(below, ["graph_id", "id"], "left").withColumns({k: both(F.col(k), F.col(f"{k}_below")) for k, (_, both) in merge.items()}).drop(*(f"{k}_below" for k in merge))
        here = levels.write(here, d)
        below = here.groupBy("graph_id", F.col("parent").alias("id")).agg(*(of(k).alias(f"{k}_below") for k, (of, _) in merge.items()))
    return levels.read().drop("level")


def _biconnected_over_tables(graph: Graph) -> DataFrame:
    """graph_id, label, size of every biconnected component.

    By a breadth-first forest (after Tarjan and Vishkin 1985, and
    Dong et al. 2023): vertices are numbered in preorder, so a subtree is an
    interval; low and high are the least and greatest number that a subtree's
    other edges lead to. A tree edge whose lower end leads nowhere outside the
    subtree of its upper end separates; without such edges the components that
    are left, each with the parent of its top, are the biconnected ones. Other
    edges never join a vertex to its ancestor, since the forest is breadth-first.
    """
    tree, deepest = _search_tree(graph)
    sized = _upwards(tree, deepest, {"size": F.lit(1).cast("long")}, {"size": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))})
    left = F.sum("size").over(Window.partitionBy("graph_id", "parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    sized = materialize(sized.withColumn("offset", F.when(F.col("depth") > 0, 1 + F.coalesce(left, F.lit(0))).otherwise(F.lit(0)).cast("long")))
    levels = Levels(graph.vertices.sparkSession, "level")
    above = levels.write(sized.where("depth = 0").withColumn("number", F.lit(0).cast("long")), 0)
    for d in range(1, deepest + 1):
        upper = above.select("graph_id", F.col("id").alias("parent"), F.col("number").alias("upper"))
        above = levels.write(sized.where(F.col("depth") == d).join(upper, ["graph_id", "parent"]).select(*sized.columns, (F.col("upper") + F.col("offset")).alias("number")), d)
    numbered = levels.read().select("graph_id", "id", "depth", "parent", "size", "number")
    ends = lambda c: numbered.select("graph_id", F.col("id").alias(c), F.coalesce("parent", F.lit(-1)).alias(f"{c}_parent"), F.col("number").alias(f"{c}_number"))
    cross = materialize(graph.topology().join(ends("src"), ["graph_id", "src"]).join(ends("dst"), ["graph_id", "dst"]).where("src <> dst_parent and dst <> src_parent"))
    reach = cross.groupBy("graph_id", F.col("src").alias("id")).agg(F.min("dst_number").alias("least"), F.max("dst_number").alias("most"))
    rows = materialize(numbered.join(reach, ["graph_id", "id"], "left"))
    spanned = _upwards(rows, deepest, {"low": F.least("number", "least"), "high": F.greatest("number", "most")}, {"low": (F.min, F.least), "high": (F.max, F.greatest)})
    upper = numbered.select("graph_id", F.col("id").alias("parent"), F.col("number").alias("first"), (F.col("number") + F.col("size") - 1).alias("last"))
    kept = spanned.join(upper, ["graph_id", "parent"]).where("low < first or high > last").select("graph_id", F.col("id").alias("src"), F.col("parent").alias("dst"))
    skeleton = Graph(graph.vertices.select("graph_id", "id"), materialize(symmetric(kept).unionByName(cross.select("graph_id", "src", "dst"))))
    found = labels(skeleton).join(numbered.select("graph_id", "id", "depth"), ["graph_id", "id"]).groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("top"))
    return found.where("top > 0").select("graph_id", "label", (F.col("n") + 1).alias("size"))


def vertex_biconnected_components(graph: Graph, skip_bridges: bool = False, in_tasks: bool = False) -> DataFrame:
    """graph_id, rank, size: sizes of biconnected components, descending; bridges have size 2.

    Connected components of up to ``FEW_EDGES`` edges are dealt to tasks, as many to each as have that many edges together,
    and searched there after Hopcroft and Tarjan; larger ones go over tables, where rounds follow the depth of a forest.

    ``in_tasks`` runs Hopcroft and Tarjan's sequential search, one task for each graph.
    """
    if in_tasks:
        sizes = small.biconnected(graph)
    else:
        found = labels(graph).select("graph_id", F.col("id").alias("src"), "label")
        edges = materialize(graph.canonical.select("graph_id", "src", "dst").join(found, ["graph_id", "src"]))
        counts = edges.groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("n"))
        large = materialize(counts.where(F.col("n") > FEW_EDGES).select("graph_id", "label"))
        of = ["graph_id", "label"]
        bins = -(-edges.count() // max(1, FEW_EDGES))
        sizes = small.biconnected_of_components(edges.join(large, of, "left_anti").withColumn("bin", F.pmod(F.xxhash64(*of), F.lit(max(1, bins)))))
        if large.limit(1).count():
            part = edges.join(large, of, "left_semi").select("graph_id", "src", "dst")
            ids = part.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
            sizes = sizes.unionByName(_biconnected_over_tables(Graph(ids, symmetric(part)).materialized()))
    if skip_bridges:
        sizes = sizes.where("size > 2")
    return with_rank(sizes, F.desc("size"), "label").select("graph_id", "rank", "size")


def vertex_load(graph: Graph, include_endpoints: bool = False, in_tasks: bool = False) -> DataFrame:
    """graph_id, id, load: each shortest path is shared equally among the predecessors of every vertex on it."""
    if in_tasks:
        return small.vertex_load(graph, include_endpoints)
    load = searches.loads(graph, include_endpoints).groupBy("graph_id", "id").agg(F.sum("load").alias("load"))
    return graph.vertices.select("graph_id", "id").join(load, ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("load", F.lit(0.0)).alias("load"))


def closeness_centrality(graph: Graph, in_tasks: bool = False) -> DataFrame:
    """(V-1) over the sum of distances; unreachable vertices add nothing, isolated vertices are infinite."""
    if in_tasks:
        return small.closeness(graph)
    return searches.distance_sums(graph).join(vertex_count(graph), "graph_id").select("graph_id", "id", F.when(F.col("s") == 0, F.lit(float("inf"))).otherwise((F.col("vertex_count") - 1) / F.when(F.col("s") != 0, F.col("s"))).alias("closeness"))


def sw_long_ranging(graph: Graph) -> DataFrame:
    """Counts and shares of rewired root edges, and of the vertices that they touch."""
    far = graph.edges.where("orig_dst is not null and orig_dst <> dst")
    edges = far.groupBy("graph_id").agg(F.count(F.lit(1)).alias("e"))
    nodes = far.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("v"))
    base = vertex_count(graph).join(edge_count_any(graph), "graph_id").join(edges, "graph_id", "left").join(nodes, "graph_id", "left")
    e, v = F.coalesce("e", F.lit(0)), F.coalesce("v", F.lit(0))
    return base.select(
        "graph_id", v.cast("long").alias("nodes"), e.cast("long").alias("edges"), (v / F.col("vertex_count")).alias("frac_nodes"), F.when(F.col("half") > 0, e / (F.when(F.col("half") > 0, F.col("half")) / 2)).alias("frac_edges")
    )


def edge_count_any(graph: Graph) -> DataFrame:
    """Half-edges of each graph."""
    return graph.vertices.select("graph_id").distinct().join(graph.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("half")), "graph_id", "left").select("graph_id", F.coalesce("half", F.lit(0)).alias("half"))


def histogram(values: DataFrame, column: str, lo: int, hi: int) -> DataFrame:
    """graph_id, bin, hits: integer bins lo..hi inclusive, values outside not counted."""
    hits = values.where(F.col(column).between(lo, hi)).groupBy("graph_id", F.col(column).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("hits"))
    bins = values.select("graph_id").distinct().select("graph_id", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))).alias("bin"))
    return bins.join(hits, ["graph_id", "bin"], "left").select("graph_id", "bin", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
