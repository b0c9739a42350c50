"""Graphs derived from the relational test tables.

Each is the set of pairs of keys on consecutive rows; keys are re-indexed to
dense ids in key order and kept in the payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.model import Graph, symmetric
from netloom.plans.ordering import with_offset, with_position
from netloom.session import discard, materialize, table

#: name -> (key column, filter)
LINE_GRAPHS = {
    "g_all": ("l_partkey", "true"),
    "g_part": ("l_partkey", "l_returnflag = 'R' AND year(l_shipdate) = 1995"),
    "g_supp": ("l_suppkey", "l_quantity <= 5"),
    "g_mid": ("l_suppkey", "l_quantity <= 2"),
}
_built: dict[tuple[str, str, str], Graph] = {}


def pairs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(a, b) with a < b, distinct."""
    if name == "g_user":
        # consecutive purchases over all time: a global lead, through positions instead of one sorted task
        events = with_position(table(spark, sf_dir, "events").where("event_type = 'purchase'").select("ts", "event_id", F.col("user_id").alias("x")), "ts", "event_id", out="p")
        follows = events.select((F.col("p") - 1).alias("p"), F.col("x").alias("y"))
        both = events.select("p", "x").join(follows, "p")
    else:
        key, keep = LINE_GRAPHS[name]
        lines = table(spark, sf_dir, "lineitem").where(keep)
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        both = lines.select(F.col(key).alias("x"), F.lead(key).over(order).alias("y"))
    return both.where("y is not null and x <> y").select(F.least("x", "y").cast("long").alias("a"), F.greatest("x", "y").cast("long").alias("b")).distinct()


def from_pairs(p: DataFrame, graph_id: int = 0) -> Graph:
    """Re-index the integer keys of distinct (a, b) pairs to dense ids, both tables written to the shared folder.

    A key's id is its rank. Ranks are kept for blocks of 64 consecutive keys, a bit for each key that occurs and the rank
    of the first, so that an index of dense keys is small enough to go to every task, and pairs are not shuffled for it.
    One direction of the edges is written, the other one made as they are read.
    """
    p = materialize(p)
    bit = "cast({0} & 63 as int)"
    keys = p.select(F.explode(F.array("a", "b")).alias("key"))
    blocks = keys.groupBy(F.shiftright("key", 6).alias("block")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit.format('key')})")).alias("mask"))
    index = materialize(with_offset(blocks, F.bit_count("mask"), "block", out="first"))
    rank = "{1}.first + bit_count({1}.mask & ~shiftleft(-1L, {0}))"
    of = F.lit(graph_id).cast("long").alias("graph_id")
    there = index.select("*", F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(mask, i) & 1 = 1)")).alias("i")).alias("x")
    v = materialize(there.select(of, F.expr(rank.format("i", "x")).alias("id"), F.struct(F.expr("shiftleft(block, 6) + i").alias("key")).alias("payload")))
    e = p.join(index.alias("s"), F.shiftright("a", 6) == F.col("s.block")).join(index.alias("d"), F.shiftright("b", 6) == F.col("d.block"))
    half = materialize(e.select(of, F.expr(rank.format(bit.format("a"), "s")).alias("src"), F.expr(rank.format(bit.format("b"), "d")).alias("dst")))
    discard(p, index)
    edges = symmetric(half)
    edges._netloom_path = half._netloom_path
    return Graph(v, edges)


def derived(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """The named graph, built once for each session and folder."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _built:
        _built[at] = from_pairs(pairs(spark, sf_dir, name))
    return _built[at]


def forget() -> None:
    """Delete the graphs built so far; the next query on one builds it anew."""
    for g in _built.values():
        discard(g.vertices, g.edges)
    _built.clear()


def graph_sql(name: str) -> str:
    """CTEs v(id, key), ce(src < dst) and e (both directions) of the named graph, for DuckDB."""
    if name == "g_user":
        raw = "SELECT user_id AS x, lead(user_id) OVER (ORDER BY ts, event_id) AS y FROM events WHERE event_type = 'purchase'"
    else:
        key, keep = LINE_GRAPHS[name]
        raw = f"SELECT {key} AS x, lead({key}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS y FROM lineitem WHERE {keep}"
    return f"""raw AS ({raw}),
p AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM raw WHERE y IS NOT NULL AND x <> y),
v AS (SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS id, CAST(key AS BIGINT) AS key FROM (SELECT a AS key FROM p UNION SELECT b FROM p)),
ce AS (SELECT s.id AS src, d.id AS dst FROM p JOIN v s ON s.key = p.a JOIN v d ON d.key = p.b),
e AS (SELECT src, dst FROM ce UNION ALL SELECT dst, src FROM ce)"""
