"""Removal of repeated word windows: Rabin-Karp hashes of every window, counted in Spark, merged into maximal intervals.

A window is 13 consecutive words of one document. It is repeated if its word sequence also starts in a document with a
smaller ``doc_id``; every word that a repeated window covers goes.

1. Each task hashes all windows of its documents with a rolling polynomial over word hashes. Of the windows that several
   of its documents hold it sends the smallest document's only; the windows of the others are known to be repeated and
   leave the task as merged intervals of words. So a window sends at most one document per task, however many hold it.
2. Spark brings equal hashes together and takes the smallest document of each. Windows of larger documents are repeated.
3. What was found goes back to its document, where repeated windows merge into maximal intervals.

No text and no list of a group's members is ever gathered: the largest unit is one task's share of hashes (bounded by
``CHUNK``; a longer document stands alone), and per document the hashes of its own windows.

Windows count as equal if their 64-bit hashes are. Defined cases: a null text has no words; a null ``doc_id`` counts as
larger than any other; rows of equal ``doc_id`` do not take words from each other; texts below 13 words lose nothing; an
empty table gives an empty table; columns named like added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from panelfill.llm.common import SpanHasher, byte_values, covered, mixed, runs, slices, text_slices

WINDOW = 13
CHUNK = 16 << 20  # bytes of text whose windows a task compares at once
BLOCK = 2 << 20   # bytes of text that are hashed at once
SENT = "bucket int, hash array<long>, _d array<long>, _own array<int>, span array<long>"
LAST = np.iinfo(np.int64).max
SEPARATORS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BASE = 0xD6E8FEB86659FD93  # of the polynomial over words, modulo 2^64
BACK = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


class Words:
    """Words of a column of texts: their places in one block of bytes, and the text each belongs to."""

    def __init__(self, texts: pa.Array):
        raw = pc.fill_null(pc.cast(texts, pa.large_binary()), b"")
        parts = raw.to_pylist()
        self.raw = b" ".join(parts) + b" "
        block = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.starts, self.ends = runs(~SEPARATORS[block])
        self.text = np.searchsorted(np.cumsum(sizes), self.starts, "right")
        self.first = np.searchsorted(self.text, np.arange(len(parts) + 1))
        self.block = block

    def windows(self, hasher: SpanHasher, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first word and hash of every window of n words that lies in one text."""
        hasher.load(self.block, values)
        words = hasher.of(self.starts, self.ends)
        if len(words) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(BASE, len(words) - 1), dtype=np.uint64)])
        at = np.flatnonzero(self.text[n - 1:] == self.text[:len(words) - n + 1])
        return at, mixed((sums[at + n] - sums[at]) * powers(BACK, len(words) - 1)[at])


def _keyed(docs: DataFrame) -> DataFrame:
    """``_d``: the document's number in the order of documents; ``_own``: a hash of its text, so that rows of one
    number are told apart and a number with very many rows is no single key."""
    return docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_own": F.hash("text")})


def _sent(n: int, chunk: int, buckets: int):
    """Per chunk and bucket of hashes: arrays of (hash, document) of windows that no smaller document of the chunk holds,
    span 0; and, for windows that one does, the intervals of words they cover as span = first word << 32 | number of words.
    An array per bucket costs the exchange little more than the hashes themselves."""
    def judged(docs: list, owns: list, texts: list, places: list, hashes: list) -> Iterator[pa.RecordBatch]:
        doc, own, text, at, hash_ = (np.concatenate(x) for x in (docs, owns, texts, places, hashes))
        for x in (docs, owns, texts, places, hashes):
            x.clear()
        order = np.lexsort((doc[text], hash_))
        ranked, by = hash_[order], doc[text[order]]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        late, again = np.empty(len(hash_), bool), np.empty(len(hash_), bool)
        late[order] = by > by[np.flatnonzero(new)][np.cumsum(new) - 1]
        again[order] = ~new & np.concatenate([[False], (text[order][1:] == text[order][:-1])])
        del order, ranked, by, new
        i, send = np.flatnonzero(late), np.flatnonzero(~late & ~again)
        # Late windows of one text that touch each other are one interval.
        head = np.flatnonzero(np.concatenate([[True], (text[i][1:] != text[i][:-1]) | (at[i][1:] > at[i][:-1] + n)])) if len(i) else i
        first, last = i[head], i[np.append(head[1:], len(i)) - 1] if len(i) else i
        spans = at[first].astype(np.int64) << 32 | (at[last] - at[first] + n)
        hash_ = np.concatenate([hash_[send], mixed(hash_[first] ^ mixed(doc[text[first]].view(np.uint64)))])
        text, spans = np.concatenate([text[send], text[first]]), np.concatenate([np.zeros(len(send), np.int64), spans])
        bucket = (hash_ >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")  # in the order of documents: neighbours look alike to the compressor
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        filled = np.flatnonzero(np.diff(bounds))
        for lo, hi in slices(np.diff(bounds)[filled], 1 << 18):
            b = filled[lo:hi]
            rows = order[bounds[b[0]]:bounds[b[-1] + 1]]
            ends = pa.array(np.append(bounds[b], bounds[b[-1] + 1]) - bounds[b[0]], pa.int32())
            values = (pa.array(hash_[rows].view(np.int64)), pa.array(doc[text[rows]]), pa.array(own[text[rows]]), pa.array(spans[rows]))
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32())] + [pa.ListArray.from_arrays(ends, v) for v in values],
                                             names=["bucket", "hash", "_d", "_own", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, values = SpanHasher(), byte_values(13)
        kept: tuple[list, ...] = ([], [], [], [], [])
        held = seen = 0
        for batch in batches:
            column = batch.column("_text")
            numbers, owns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_d", "_own"))
            for lo, hi in text_slices(column, BLOCK):
                words = Words(column.slice(lo, hi - lo))
                if held and held + len(words.raw) > chunk:
                    yield from judged(*kept)
                    held = seen = 0
                at, hash_ = words.windows(hasher, values, n)
                text = words.text[at]
                for out, x in zip(kept, (numbers[lo:hi], owns[lo:hi], (seen + text).astype(np.int32), (at - words.first[text]).astype(np.int32), hash_)):
                    out.append(x)
                held += len(words.raw)
                seen += hi - lo
        if held:
            yield from judged(*kept)
    return run


def repeated(docs: DataFrame, n: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """``_d``, ``_own``, ``hashes`` (repeated windows) and ``spans`` (intervals) of every document that has any."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One bucket a partition: many windows of a document then stand side by side, so that its number costs next to nothing.
    sent = (_keyed(docs).select("_d", "_own", F.col("text").cast("string").alias("_text")).mapInArrow(_sent(n, chunk, partitions), SENT)
            .repartitionById(partitions, "bucket").select("bucket", F.inline(F.arrays_zip("hash", "_d", "_own", "span"))))
    least = F.min(F.when(F.col("span") == 0, F.col("_d"))).over(W.partitionBy("bucket", "hash"))
    late = sent.withColumn("_least", least).where((F.col("span") != 0) | (F.col("_least") < F.col("_d")))
    return late.groupBy("_d", "_own").agg(
        F.collect_list(F.when(F.col("span") == 0, F.col("hash"))).alias("hashes"),
        F.collect_list(F.when(F.col("span") != 0, F.col("span"))).alias("spans"))


ADDED = [T.StructField("n_words", T.LongType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.IntegerType()))),
         T.StructField("kept", T.StringType())]


def without_repeats(docs: DataFrame, n: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """The documents with ``n_words``, ``removed`` (maximal intervals of removed words: first, end) and ``kept``, the
    remaining words joined by one space."""
    fields = [f for f in docs.schema.fields if f.name not in ("n_words", "removed", "kept", "_d", "_own", "_text", "hashes", "spans")]
    names = [f.name for f in fields]
    own = _keyed(docs.select(*[f"`{c}`" for c in names]))
    # The text moves once; what is cast from it is worked out behind the join.
    joined = own.join(repeated(docs, n, chunk), ["_d", "_own"], "left").select(*[f"`{c}`" for c in names], "hashes", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, values = SpanHasher(), byte_values(13)
        for batch in batches:
            column = pc.cast(batch.column("text"), pa.string())
            late, spans = batch.column("hashes"), batch.column("spans")
            for lo, hi in text_slices(column, BLOCK):
                words = Words(column.slice(lo, hi - lo))
                at, hash_ = words.windows(hasher, values, n)
                bounds = np.searchsorted(at, words.first)
                sizes, removed, kept = [], [], []
                for i in range(hi - lo):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    gone = np.zeros(b - a, bool)
                    if late[lo + i].is_valid:
                        own_at = at[bounds[i]:bounds[i + 1]]
                        known = late[lo + i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                        gone |= covered(own_at[np.isin(hash_[bounds[i]:bounds[i + 1]], known)] - a, n, b - a)
                        cut = spans[lo + i].values.to_numpy(zero_copy_only=False)
                        gone |= covered(cut >> 32, cut & 0xFFFFFFFF, b - a)
                    sizes.append(b - a)
                    removed.append(np.stack(runs(gone), axis=1).tolist())
                    left = np.flatnonzero(~gone) + a
                    kept.append(b" ".join([words.raw[s:e] for s, e in zip(words.starts[left].tolist(), words.ends[left].tolist())]).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in names]
                    + [pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.string())],
                    names=names + ["n_words", "removed", "kept"])

    return joined.mapInArrow(run, T.StructType(fields + ADDED))
