"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound on the labelled rows that a classifier of this subpackage is fitted on.
LABELLED_SAMPLE = 4000
#: Labelled texts of more bytes are scored like all others but not learnt from, so that a sample is bounded in bytes too.
SAMPLE_TEXT_BYTES = 65_536


#: Rows of an Arrow batch, where the session has not chosen its own number.
ARROW_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are short: rows hold whole texts, and Spark's default of 10,000 of them fills memory on both sides."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(ARROW_ROWS))
    return df


def slices(batches, rows: int):
    """Arrow batches cut into shorter ones; at the end of a task a worker gives back the memory that it doesn't use."""
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Catalyst inlines a column into every reference, also into lambdas that run
    once per element; a lambda variable is computed once.
    """
    return F.transform(F.array(value), body)[0]


def with_fields(df: DataFrame, **types: str) -> T.StructType:
    """The schema of ``df`` and further fields (``df.schema`` is shared, so it is not added to in place)."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in types.items())])


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels must not be learnt: crc32 of the decimal id, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def sample_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the texts that a sample may hold; null counts as empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = LABELLED_SAMPLE) -> list[tuple[str, int]]:
    """At most ``limit`` (text, label) pairs of the training fold.

    The sample is the rows with the smallest hash of the id, so it does not
    depend on file order or partitioning; the ids are chosen before any text
    is read, and a broadcast of at most ``limit`` ids picks the texts.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    rows = sample_texts(docs).join(F.broadcast(ids), "doc_id")
    return [(r["text"], r["y"]) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(limit).collect()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has none of (compared as Spark does, whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
