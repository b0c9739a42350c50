"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. toxicity: documents scored 0.5 or more go (netloom.llm.toxicity, fitted on the labels of the training fold).
2. near_duplicates: one document of each group linked at Jaccard 0.8 stays, that of smallest doc_id.
3. decontamination: documents that contain a benchmark item go.
4. pii: spans of personal data and secrets are replaced by their kind; n_chars follows.
5. byte_bpe: the ids of the final texts, their number, and a check that they decode to the text.

Each of the first four returns the columns of documents, whatever further ones
there are: working columns take names that the table has none of, and so do the
three columns that the last stage adds (``token_ids``, ``n_tokens``, ``decodes``,
followed by underscores where a name is taken).

Defined cases: stages judge rows, not ids, so rows with null or repeated ids are
documents like all others. Null and empty texts pass stages 1, 3, 4 and 5 (no
ids); in stage 2 they are equal to each other. Repeated rows pass or go together
in stages 1, 3, 4 and 5 and leave one row in stage 2; of a group whose rows share
the smallest id one stays, chosen by the text's hash. Texts of any length are
read whole. An empty table, of documents, labels or items, is no error: without
labels stage 1 keeps all, without items stage 3 does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bpe, decontam, jaccard_join, pii, toxicity
from netloom.llm.common import fresh
from netloom.session import discard, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_tables(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "toxicity")
    return toxicity.score(docs, model, out=score, hits=None, weight=None).where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids, count, decodes, decoded = fresh(docs, "token_ids", "n_tokens", "decodes", "decoded")
    back = bpe.decode(bpe.encode(docs, vocabulary, pattern, ids=ids, count=count), vocabulary, pattern, ids=ids, out=decoded)
    return back.withColumn(decodes, F.coalesce(F.col("text"), F.lit("")) == F.col(decoded)).drop(decoded)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", redact_pii), ("byte_bpe", encode)]

#: The stages learn, match approximately and tokenize, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            discard(before)
    return docs
