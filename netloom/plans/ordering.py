"""Global positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.session import materialize


def with_position(df: DataFrame, *order: str, out: str = "id") -> DataFrame:
    """``df`` and the dense global position (from 0) of each row in the given order.

    A range-partitioned sort numbers the rows of each partition; the totals of
    the partitions, one row each, give the offsets. Ties should be broken by
    the order columns.
    """
    placed = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    starts, total = [], 0
    for r in sorted(placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["_p"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _s long")
    return placed.join(F.broadcast(offsets), "_p").withColumn(out, F.col("_s") + F.col("_i")).drop("_p", "_i", "_m", "_s")


def with_offset(df: DataFrame, weight: Column, *order: str, out: str) -> DataFrame:
    """``df`` and the sum of ``weight`` over all rows before each row in the given order, without ties.

    Like ``with_position``: running sums within the partitions of a range-partitioned sort, and their totals.
    """
    placed = materialize(df.orderBy(*order).withColumns({"_w": weight.cast("long"), "_p": F.spark_partition_id()}))
    starts, total = [], 0
    for r in sorted(placed.groupBy("_p").agg(F.sum("_w").alias("n")).collect()):
        starts.append((r["_p"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_p int, _s long")
    before = F.sum("_w").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_b", F.coalesce(before, F.lit(0))).join(F.broadcast(offsets), "_p").withColumn(out, F.col("_s") + F.col("_b")).drop("_p", "_w", "_s", "_b")


def with_rank(df: DataFrame, *order, out: str = "rank", by: str = "graph_id") -> DataFrame:
    """``df`` and the dense position (from 0) of each row among those of its graph, in the given order.

    Like ``with_position``, so that one large graph is spread over all
    partitions. The first row of a graph in a partition and the rows of the
    graph in the partitions before fix the positions there: one row for each
    graph in each partition that holds some of it.
    """
    placed = materialize(df.orderBy(by, *order).withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    parts = placed.groupBy(by, "_p").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(by, "_p", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_s"))
    return placed.join(starts, [by, "_p"]).withColumn(out, F.col("_s") + F.col("_i")).drop("_p", "_i", "_m", "_s")
