"""Document fingerprints by one-permutation MinHash.

Every 5-word shingle (lower case, letters and digits) is hashed once; the top
7 bits choose one of 128 bins and the least hash of a bin represents it. The
array of hashes is sorted once, so that a bin's least is where the bin changes.
An empty bin is filled by optimal densification: it copies a filled bin chosen
by a hash of both bins' numbers, independently for each empty bin. The low 8
bits of each value are packed into a hexadecimal string. Two unrelated values
agree in 8 bits with probability 1/256, which ``likeness`` corrects for.

Only built-in expressions run. The fingerprint needs no shuffle. ``neighbours``
cuts the order of documents into chunks of consecutive ones and shuffles each
text once, to its chunk. A document that opens a chunk also goes to the end of
the chunk before (the first one to the end of the last), so that every document
meets the next one in its own chunk. Which documents open one is drawn by a
hash, the likelier the longer the text, so that chunks are of like bytes
whatever the ids; of the ids alone a small table is made for that.

Defined cases: null counts as empty; a text without words has the fingerprint
of dashes, which is like itself (1.0) and unlike anything else (0.0); a text of
one to four words has a single shingle, all of them; extra columns don't
matter; null doc_ids come before all others in the order of documents, as
Spark sorts them; of rows with one doc_id those of smaller hash of the text come
first; exact repeats of a row are one document in that order, and each is
returned.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import let
from netloom.session import discard, materialize

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
EMPTY = "--" * BINS
#: Mean bytes of a chunk of consecutive documents, as far as that makes no more than so many chunks; what a row counts besides its text.
CHUNK_BYTES = 32_768
CHUNKS = 16_384
ROW_BYTES = 64
#: Exact repeats of a row travel and become one row in its chunk; if any row has more, they become one before they travel.
REPEATS = 100


def shingle_hashes(text: Column) -> Column:
    """array<bigint>, one hash for each run of five words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def runs(h: Column) -> Column:
        n = F.size(h)
        whole = F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WORDS))))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(whole)

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text that is not null."""

    def least(h: Column) -> Column:
        return F.filter(h, lambda x, i: F.coalesce(_bin(x) != _bin(F.get(h, i - 1)), F.lit(True)))

    def packed(mins: Column) -> Column:
        def value(filled: Column) -> Column:
            def of_bin(b: Column) -> Column:
                donor = F.array_min(F.transform(mins, lambda x: F.struct(F.hash(b, _bin(x)).alias("rank"), x.alias("x"))))["x"]
                own = F.array_position(filled, b)
                return F.coalesce(F.get(mins, (own - 1).cast("int")), donor)

            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), of_bin)

        low = (1 << LOW_BITS) - 1
        filled = F.transform(mins, lambda x: _bin(x))
        return F.array_join(F.transform(let(filled, value), lambda x: F.substring(F.hex(x.bitwiseAND(low) + (low + 1)), 2, 2)), "")

    def whole(h: Column) -> Column:
        return F.when(F.size(h) == 0, F.lit(EMPTY)).otherwise(F.lower(let(let(h, least), packed)))

    return let(F.array_sort(shingle_hashes(text)), whole)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    size = LOW_BITS // 4
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda n, i: n + (F.substring(a, i * size + 1, F.lit(size)) == F.substring(b, i * size + 1, F.lit(size))).cast("int"))
    chance = 2.0**-LOW_BITS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))


def openings(ids: DataFrame, *key: str) -> list[Row]:
    """The sorted keys that open a chunk: the least one, and of all others a sample by ``size`` (texts longer than a chunk always)."""
    whole = ids.agg(F.sum("size").alias("size"), F.min(F.struct(*key)).alias("least")).first()
    if whole["least"] is None:
        return []
    chunk_bytes = max(CHUNK_BYTES, whole["size"] // CHUNKS)
    drawn = ids.where(F.pmod(F.xxhash64(*key), F.lit(chunk_bytes)) < F.col("size")).select(*key).collect()
    return sorted({whole["least"], *drawn})


def places(key: Column, opening: list[Row], form: T.StructType) -> Column:
    """array<(chunk, guest)>, where a document goes: to its chunk and, if it opens that, as a guest to the one before.

    The chunk is found by bisection in the opening keys, a constant array.
    """
    starts = F.from_json(F.lit(json.dumps([r.asDict() for r in opening])), T.ArrayType(form))
    hops = [F.lit(1 << b) for b in reversed(range(max(len(opening), 1).bit_length()))]

    def among(starts: Column) -> Column:
        def found(chunk: Column) -> Column:
            own = F.struct(chunk.alias("chunk"), F.lit(False).alias("guest"))
            before = F.struct((F.when(chunk == 0, F.lit(len(opening))).otherwise(chunk) - 1).alias("chunk"), F.lit(True).alias("guest"))
            return F.when(F.get(starts, chunk) == key, F.array(own, before)).otherwise(F.array(own))

        return let(F.aggregate(F.array(*hops), F.lit(0), lambda at, hop: F.when(F.get(starts, at + hop) <= key, at + hop).otherwise(at)), found)

    return let(starts, among)


def neighbours(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its text with the last quarter replaced by the
    beginning of the next document, and the likeness to that edited text and to the next document."""
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    key = ["known", "id", "h"]  # a null id equals itself here
    base = docs.select(doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    ids = materialize(base.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text").cast("long") + ROW_BYTES).alias("size")))
    repeats = ids.agg(F.max("rows")).first()[0] or 0

    def merged(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.first("text").alias("text"), F.count(F.lit(1)).cast("int").alias("rows"))

    spots = places(F.struct(*key), openings(ids, *key), ids.select(*key).schema)
    discard(ids)
    dealt = (merged(base, *key) if repeats > REPEATS else base).select("*", F.inline_outer(spots)).repartition("chunk")
    dealt = (merged(dealt, "chunk", "guest", *key) if 1 < repeats <= REPEATS else dealt).withColumn("fingerprint", fingerprint(F.col("text")))
    order = Window.partitionBy("chunk").orderBy("guest", *key)
    joined = dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "fingerprint"))).where(~F.col("guest")).withColumn("quarter", F.floor(F.length("text") / 4).cast("int"))
    edited = F.expr("concat(substring(text, 1, length(text) - quarter), substring(next_text, 1, quarter))")
    rows, copies = (["rows"], [F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")]) if repeats > 1 else ([], [])
    out = joined.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint", *rows)
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint", *rows)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), *copies).drop("copy")
