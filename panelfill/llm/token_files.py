"""Token ids as Parquet list columns whose pages can be read selectively.

A token table holds one row per document in ascending ``doc_id`` order: ``doc_id``, ``part`` (number of the file's
partition), ``first`` (ids of all documents before it in that partition), ``n_tokens`` and ``ids``. Ids are
dictionary-encoded (a vocabulary fits a page's dictionary, so an id takes its bit width), the sorted counters are
delta-encoded, row groups and pages are small enough for the page index to skip what a reader does not ask for.

Defined cases: a null text is an empty one and holds the end id only; a null ``doc_id`` comes first; rows of equal
``doc_id`` are ordered by their text; an empty table gives an empty token table. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelfill.llm.pretokens import encoder, release

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
ROW_GROUP = 16 << 20
PAGE = 256 << 10
PARTITION = 32 << 20
SMALL = 4_000_000
SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """``part``, ``first``, ``n_tokens`` and ``ids`` of documents whose partitions are sorted already."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = encoder(vocabulary, spaced=False), 0
        for batch in batches:
            at = 0
            for sizes, ids in own.encode(batch.column("text")):
                n, ends = len(sizes), np.cumsum(sizes)
                closed = np.insert(ids, ends, end_id).astype(np.int32)
                bounds = np.concatenate([[0], ends + np.arange(1, n + 1)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), batch.column("part").slice(at, n), pa.array(before + bounds[:-1]),
                     pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(closed))],
                    ["doc_id", "part", "first", "n_tokens", "ids"])
                before, at = before + int(bounds[-1]), at + n

    return docs.select("doc_id", F.spark_partition_id().alias("part"), "text").mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID,
                 partition_bytes: int = PARTITION, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Encode the documents and write them in ascending ``doc_id`` order, one file for each range of ids."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = docs.repartitionByRange(max(1, -(-total // partition_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    (encoded(ordered, vocabulary, end_id).write
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.block.size", row_group).option("parquet.page.size", page)
     .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#first", "false")
     .option("parquet.enable.dictionary#n_tokens", "false").option("parquet.dictionary.page.size", 1 << 20)
     .option("parquet.page.row.count.limit", 2000)
     .parquet(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``part``, ``n_tokens`` and ``start`` (ids of all documents before it); reads no token page."""
    files = spark.read.schema(SCHEMA).parquet(path)
    return _with_start(files.select("doc_id", "part", "first", "n_tokens"), files)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All columns and ``start``. Filters on ``doc_id`` reach the files, their row groups and pages."""
    files = spark.read.schema(SCHEMA).parquet(path)
    return _with_start(files, files)


def _with_start(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Offsets of whole partitions come from one row per partition; documents never meet in one task. That table is
    broadcast while it has at most ``SMALL`` rows, which stands for 128 TB of text; beyond, Spark picks the join."""
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    if files.select("part").distinct().count() <= SMALL:  # one row per partition: a few bytes each
        offsets = F.broadcast(offsets)
    joined = rows.join(offsets, F.col("part") == F.col("_part"), "left")
    return joined.withColumn("start", F.col("first") + F.col("_offset")).drop("_part", "_offset", "first")


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            column = batch.column("ids")
            bounds = np.asarray(column.offsets)
            raw = memoryview(np.asarray(column.values).astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
