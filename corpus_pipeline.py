"""The text corpus pipeline: every stage is a text operator, written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir), work on all documents their predecessor kept, and return the columns of
``documents``; the last one returns token ids. SQL cannot express the first stage, so there is no SQL for the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelfill.llm import decontaminate, lexicon_bpe, line_crf, order_minhash, pii
from panelfill.llm.common import table
from panelfill.sources.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, unchanged."""
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.with_score(docs, model).where(line_crf.predicted() == 1).select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, unchanged."""
    return order_minhash.without_near_duplicates(docs).select(*COLUMNS)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate, unchanged."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def documents_without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` of changed texts is their new length."""
    before = docs.withColumn("_size", F.length("text"))
    after = pii.redacted(before).withColumn("n_chars", F.when(F.length("text") == F.col("_size"), F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return after.select(*COLUMNS)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit numbers) and digests of the
    ids and of the text decoded from them."""
    coded = lexicon_bpe.with_ids(docs, decode=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", good_documents), ("near-duplicate removal", distinct_documents),
          ("benchmark decontamination", uncontaminated_documents), ("personal data", documents_without_personal_data),
          ("byte-pair encoding", encoded_documents)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
