"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their word features.

A 256-byte table lower-cases A-Z and blanks every separator in the UTF-8 bytes of a text, ``bytes.split`` yields its
words, and the features are all runs of 1 to ``n`` consecutive words, joined by a blank: the crc32 of a run is the seed
of the run that is one word longer, so no run is ever put together. A feature's bucket is its crc32 modulo ``buckets``.
Counters of buckets are reduced by Spark; what reaches the driver and the tasks is one number per bucket.

The gain of a bucket is ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))`` from its counts s in the
documents and t in the target and the totals S and T; a document's weight is the sum over its features. The score adds
Gumbel noise drawn from ``doc_id``, so that the highest scores are a sample without replacement by weight.

Defined cases: a null text has no features and weight 0; a null ``doc_id`` draws as the empty text and stands before all
others on ties; rows equal in score and ``doc_id`` rank in order of features and weight; an empty target or an empty table of documents
counts 0 everywhere; columns named like added ones are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelfill.llm.common import as_bytes, text_slices
from panelfill.sources.storage import stored

BUCKETS = 10_000
SEED = 2024
SHARE = 10       # percent of the documents that can be drawn
LEAST_WORDS = 20
PIECE = 1 << 18  # bytes of a text that are words at once
BLOCK = 4 << 20  # bytes of texts that are Python objects at once
WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
CLEAN = bytes(c if c in WORD_BYTES else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def features(raw: bytes, n: int) -> Iterator[np.ndarray]:
    """crc32 of every run of 1 to n words, piece after piece of the text."""
    clean = raw.translate(CLEAN)
    before: list[bytes] = []
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        new = clean[at:end].split()
        at = end
        words = before + new
        chained = [b" " + w for w in words] if n > 1 else words
        seeds = list(map(zlib.crc32, words))
        for size in range(1, n + 1):
            if size > 1:
                seeds = list(map(zlib.crc32, chained[size - 1:], seeds))
            # Runs that end in the words of earlier pieces were seen there.
            yield np.array(seeds[max(0, len(before) - size + 1):], np.int64)
        before = words[len(words) - n + 1:] if n > 1 else []


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    column = batch.column("_text")
    for lo, hi in text_slices(column, BLOCK):
        for raw in as_bytes(column.slice(lo, hi - lo)):
            yield raw or b""


def bucket_counts(docs: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n`` of the features of all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for raw in _texts(batch):
                for found in features(raw, n):
                    total.update((found % buckets).tolist())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    texts = docs.select(F.col("text").cast("string").alias("_text"))
    return texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; as many numbers as there are buckets."""
    raw, aim = (np.zeros(buckets, np.int64) for _ in range(2))
    both = bucket_counts(docs, n, buckets).withColumn("_aim", F.lit(False)).unionByName(
        bucket_counts(target, n, buckets).withColumn("_aim", F.lit(True)))
    for r in both.collect():
        (aim if r["_aim"] else raw)[r["bucket"]] = r["n"]
    s_all, t_all = int(raw.sum()), int(aim.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all + buckets)) / (float(s + 1) * float(t_all + buckets))))
                     for s, t in zip(raw.tolist(), aim.tolist())], np.int64)


def noise(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """``floor(-1000 ln(-ln((h + 0.5) / 2^32)))``, h being the first 8 hex digits of a digest of the number."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


ADDED = ("n_features", "weight", "score")


def with_score(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The documents with ``n_features``, ``weight`` and ``score``."""
    fields = [f for f in docs.schema.fields if f.name not in (*ADDED, "rank", "_text")]
    names = [f.name for f in fields]
    gain = gains(docs, target, n, buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights = [], []
            for raw in _texts(batch):
                size = weight = 0
                for found in features(raw, n):
                    size += len(found)
                    weight += int(gain[found % buckets].sum())
                sizes.append(size)
                weights.append(weight)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())],
                                             names=names + ["n_features", "weight"])

    read = docs.select(*[f"`{c}`" for c in names], F.col("text").cast("string").alias("_text"))
    weighed = read.mapInArrow(weigh, T.StructType(fields + [T.StructField(c, T.LongType()) for c in ADDED[:2]]))
    return weighed.withColumn("score", F.col("weight") + noise(seed=seed))


def with_rank(scored: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank``: 1, 2, 3, ... for the ``floor(share * N / 100)`` highest scores of the N documents with at least
    ``least`` features, ties to the smaller ``doc_id``; null for all others.

    Rows are dealt out by ranges of score and sorted inside them; what is added up over ranges is one number each.
    """
    partitions = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scored.drop("rank").withColumn("_able", F.col("n_features") >= least)
    order = [F.col("_able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")]
    # Written out: a row's place must not be worked out twice.
    placed = stored(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
                    .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = sorted(placed.where("_able").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, n_able = [], 0
    for r in sizes:
        starts.append((r["part"], n_able))
        n_able += r["n"]
    before = scored.sparkSession.createDataFrame(starts, "_part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return (placed.withColumn("_part", part).join(before, "_part", "left")
            .withColumn("rank", F.when(F.col("_able") & (place <= share * n_able // 100), place))
            .drop("_part", "_before", "_at", "_able"))


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE,
              least: int = LEAST_WORDS) -> DataFrame:
    """The drawn documents, with ``n_features``, ``weight``, ``score`` and ``rank``.

    Ranks are found without the texts first; only texts that reach the lowest drawn score are moved.
    """
    scored = with_score(docs, target, n, buckets, seed)
    keys = with_rank(scored.select("doc_id", *ADDED), share, least).where("rank IS NOT NULL")
    lowest, drawn = keys.agg(F.min("score"), F.count(F.lit(1))).first()
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long")).limit(0)
    reach = scored.where((F.col("score") >= lowest) & (F.col("n_features") >= least))
    return with_rank(reach, 100, least).where(F.col("rank") <= drawn)
