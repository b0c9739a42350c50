"""Graphviz text and JSON state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.model import Graph
from netloom.operators.access import containers

# Option strings of the text format.
SPLINES = "splines=true;"
TRANSPARENT_BG = 'bgcolor="transparent";'
NO_OVERLAP = "overlap=false;"
SIZE_A4 = 'size="8.3,11.7!";'
RATIO_FILL = 'ratio="fill";'
MARGIN_0 = "margin=0;"
EXAMPLE_DOT_OPTIONS = 'bgcolor="transparent";\n\tfontsize=50;\n\tnode [shape=ellipse, penwidth=1, fontname="Courier", pin=true ];\n\tsplines=true;'


def dot_options(*options: str) -> str:
    return "\n\t".join(options)


def dot_lines(graph: Graph, label: Column | None = None, options: str = "", positions: bool = False, legacy: bool = False) -> DataFrame:
    """graph_id, part, a, b, line: the text as rows; sorted by (part, a, b) they are the file.

    ``label`` is an expression over the columns of vertices and ``adj``;
    without one labels are empty. ``positions`` pins vertices at x and y, times
    100 with two decimals. ``legacy`` writes the old form without labels.
    The list of ids is one line by the format's definition.
    """
    v = containers(graph)
    listed = v.groupBy("graph_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: i.cast("string")), " ").alias("ids"))
    listed = listed.withColumn("ids", F.when(F.col("ids") == "", "").otherwise(F.concat("ids", F.lit(" "))))
    zero = F.lit(0).cast("long")
    order = "adj_pos" if "adj_pos" in graph.edges.columns else "dst"
    edges = graph.edges.where("src < dst").select("graph_id", F.lit(3).alias("part"), F.col("src").alias("a"), F.col(order).cast("long").alias("b"), F.concat(F.lit("\t"), "src", F.lit(" -- "), "dst").alias("line"))
    end = listed.select("graph_id", F.lit(4).alias("part"), zero.alias("a"), zero.alias("b"), F.lit("}").alias("line"))
    if legacy:
        head = listed.select("graph_id", F.lit(0).alias("part"), zero.alias("a"), zero.alias("b"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("graph{").alias("line")), F.struct(F.lit(1).alias("k"), F.concat(F.lit("\t"), "ids").alias("line")))).alias("h"))
        return head.select("graph_id", "part", F.col("h.k").cast("long").alias("a"), "b", F.col("h.line").alias("line")).unionByName(edges).unionByName(end)
    lines = F.array(F.lit("graph G{"), F.concat(F.lit("\t"), F.lit(options)), F.concat(F.lit("\t"), "ids", F.lit(";")))
    head = listed.select("graph_id", F.lit(0).alias("part"), F.posexplode(lines).alias("a", "line")).select("graph_id", "part", F.col("a").cast("long").alias("a"), zero.alias("b"), "line")
    text = label if label is not None else F.lit("")
    if positions:
        text = F.concat(text, F.format_string('" pos="%.2f,%.2f!', F.col("x") * 100.0, F.col("y") * 100.0))
    named = v.select("graph_id", F.lit(2).alias("part"), F.col("id").alias("a"), zero.alias("b"), F.concat(F.lit('\t"'), "id", F.lit('" [label="'), text, F.lit('"];')).alias("line"))
    return head.unionByName(named).unionByName(edges).unionByName(end)


def dot_from_indices(graph: Graph, label: Column, options: str = "") -> DataFrame:
    return dot_lines(graph, label, options)


def dot_with_indices(graph: Graph, options: str = "") -> DataFrame:
    return dot_lines(graph, F.col("id").cast("string"), options)


def dog_dot(graph: Graph, options: str = "") -> DataFrame:
    """The text of a spatial or distance-dependent graph as rows, vertices labelled by their index and pinned at x and y."""
    return dot_lines(graph, F.col("id").cast("string"), options, positions=True)


def dot_string(graph: Graph, label: Column | None = None, options: str = "", **kwargs) -> DataFrame:
    """graph_id, dot: the whole text of each graph in one row, which holds at most 2 GB; ``dot_lines`` has no such limit."""
    lines = dot_lines(graph, label, options, **kwargs)
    rows = F.sort_array(F.collect_list(F.struct("part", "a", "b", "line")))
    return lines.groupBy("graph_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("dot"))


def to_dot(graph: Graph) -> DataFrame:
    """The old form: header ``graph{`` and no labels."""
    return dot_string(graph, legacy=True)


def to_dot_with_labels(graph: Graph, options: str, label: Column) -> DataFrame:
    """The old name of ``dot_string`` with a label: an expression over a vertex's payload, or its adjacency (``adj``)."""
    return dot_string(graph, label, options)


def write_dot(graph: Graph, path: str, label: Column | None = None, options: str = "") -> None:
    """Text files below ``path``, a folder for each graph; lines of a graph stay in order in one file."""
    lines = dot_lines(graph, label, options)
    lines.repartition(F.col("graph_id")).sortWithinPartitions("graph_id", "part", "a", "b").select("graph_id", "line").write.partitionBy("graph_id").text(path)


# ---------------------------------------------------------------- JSON

STATE = "graph struct<next_id: bigint, edge_count: bigint, vertices: array<struct<id: bigint, adj: array<bigint>>>, phantom: string>, prob double, c_target double, rng struct<state: string, increment: string>"


def json_state(graph: Graph, **fields: Column) -> DataFrame:
    """graph_id, json: the whole state of each graph as one JSON object, at most 2 GB; ``fields`` are added beside it."""
    v = containers(graph)
    state = F.struct(
        F.count(F.lit(1)).alias("next_id"),
        F.floor(F.sum(F.size("adj")) / 2).alias("edge_count"),
        F.sort_array(F.collect_list(F.struct("id", "adj"))).alias("vertices"),
    )
    rows = v.groupBy("graph_id").agg(state.alias("graph"))
    return rows.select("graph_id", F.to_json(F.struct("graph", *(c.alias(k) for k, c in fields.items()))).alias("json"))


def save_json(graph: Graph, path: str, **fields: Column) -> None:
    """One JSON object a line, one folder a graph."""
    json_state(graph, **fields).write.partitionBy("graph_id").text(path)


def load_fields(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """graph_id, prob, c_target, rng of saved states: what ``load_json`` leaves out. Generator states are too long for numbers and stay strings."""
    frame = spark.read.schema(STATE + ", graph_id long").option("primitivesAsString", "false").json(path, multiLine=multi_line)
    return frame.select(F.coalesce("graph_id", F.lit(0)).cast("long").alias("graph_id"), "prob", "c_target", "rng")


def load_json(spark: SparkSession, path: str, multi_line: bool = False) -> Graph:
    """A saved graph; the order of adjacency lists is kept as adj_pos. Long generator states stay strings."""
    frame = spark.read.schema(STATE + ", graph_id long").option("primitivesAsString", "false").json(path, multiLine=multi_line)
    vertices = frame.select(F.coalesce("graph_id", F.lit(0)).cast("long").alias("graph_id"), F.explode("graph.vertices").alias("v"))
    v = vertices.select("graph_id", "v.id")
    e = vertices.select("graph_id", F.col("v.id").alias("src"), F.posexplode("v.adj").alias("adj_pos", "dst"))
    return Graph(v, e.select("graph_id", "src", "dst", F.col("adj_pos").cast("long").alias("adj_pos")))
