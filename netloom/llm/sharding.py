"""Sharding by global byte-size prefix sums.

Rows are sorted by doc_id over range partitions; each partition's totals (one
row each) give the bytes and rows before it, and running sums inside the
partition give the global prefix sum of every row. Cutting the prefix sums at
equal targets makes contiguous shards whose sizes differ by about one document.

Only (doc_id, size, checksum) is sorted, never the text. What reaches the
driver is one row of totals a partition. The sums inside a partition run as an
Arrow map over the sorted rows in constant memory.

Defined cases: a null text has no bytes; null doc_ids sort first; equal
doc_ids are ordered by size, checksum and a hash of the text, so equal rows are
interchangeable; an empty table gives no rows; a document larger than a shard's
target has a shard to itself, and shards may then be empty; texts of any length
count whole. Extra columns don't matter, and ``write`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.llm.common import fresh
from netloom.session import materialize

SHARDS = 8


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``, and a ``digest`` of id and text if asked for."""
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(F.col(key).cast("string"), body).alias("digest"))
    placed = materialize(sized.orderBy("doc_id", "size", "text_crc32", "digest").withColumn("m", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.shiftright("m", 33).alias("p")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    before, total_bytes, total_rows = {}, 0, 0
    for r in sorted(parts, key=lambda r: r["p"]):
        before[r["p"]] = (total_bytes, total_rows)
        total_bytes += r["bytes"]
        total_rows += r["rows"]

    # The rows of a partition come back together and in order: one file each, and sorted again for certainty.
    split = placed.withColumn("p", F.shiftright("m", 33))
    spread = split.repartition(max(1, len(before)), "p").sortWithinPartitions("p", "m") if before else split

    def run(batches):
        p_now, done_bytes = None, 0
        for b in batches:
            p, size, m = (b.column(i).to_numpy() for i in (5, 1, 4))
            lead = np.empty(len(p), np.int64)  # bytes before each row
            for lo, hi in _runs(p):
                if p[lo] != p_now:
                    p_now, done_bytes = int(p[lo]), before[int(p[lo])][0]
                sums = np.cumsum(size[lo:hi])
                lead[lo:hi] = done_bytes + sums - size[lo:hi]
                done_bytes += int(sums[-1])
            row = np.array([before[int(x)][1] for x in p], np.int64) + (m & ((1 << 33) - 1))
            shard = np.minimum(shards - 1, ((2 * lead + size).astype(object) * shards // (2 * total_bytes)).astype(np.int64))  # where the row's middle lies
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(shard.astype(np.int32)), pa.array(row)], names=["doc_id", "size", "text_crc32", "digest", "shard", "row"])

    cut = materialize(spread.select("doc_id", "size", "text_crc32", "digest", "m", "p").mapInArrow(run, "doc_id long, size long, text_crc32 long, digest long, shard int, row long"))
    starts = cut.groupBy("shard").agg(F.min("row").alias("start"))
    # one row a shard
    return cut.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["digest"] if digest else [])
    )


def _runs(p: np.ndarray):
    cuts = np.flatnonzero(np.diff(p)) + 1
    edges = [0, *cuts.tolist(), len(p)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def write(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """Write ``docs`` as one Parquet folder a shard (``shard=0`` ...), rows in slot order.

    Rows of equal id and text are numbered, so that each takes one of their slots.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    names = fresh(docs, "_id", "_text", "_k", "_slot", "shard")
    keyed = docs.withColumns({names[0]: F.coalesce(F.col(key).cast("string"), F.lit("")), names[1]: F.xxhash64(F.col(key).cast("string"), body)})
    keyed = keyed.withColumn(names[2], F.row_number().over(Window.partitionBy(names[0], names[1]).orderBy(F.lit(0))))
    places = assign(docs, shards, key, digest=True)
    places = places.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(names[0]), F.col("digest").alias(names[1]), F.col("shard").alias(names[4]), F.col("slot").alias(names[3]))
    places = places.withColumn(names[2], F.row_number().over(Window.partitionBy(names[0], names[1]).orderBy(names[4], names[3])))
    joined = keyed.join(places, names[:3]).drop(*names[:3])
    sorted_ = joined.repartitionByRange(F.col(names[4]), F.col(names[3])).sortWithinPartitions(names[4], names[3])
    sorted_.drop(names[3]).write.partitionBy(names[4]).parquet(path)
