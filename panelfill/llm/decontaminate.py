"""Removal of benchmark passages: a broadcast set of hashed item windows, scanned over every document and verified.

A word is a run of lower-case letters a-z, digits and non-ASCII characters after A-Z are lower-cased. A window is
``n`` consecutive words of an item; an item of fewer words, but not none, is one window.

Defined cases: a null or empty text has no words and is never contaminated; a null item text has no window; an item
without an id contaminates, but is not listed; repeated rows are judged each on its own; an empty benchmark leaves
everything clean; an empty table gives an empty table. Only the columns asked for are read, all others are carried.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from panelfill.llm.common import SpanHasher, as_bytes, byte_values, covered, names_apart, runs, slices, windows_of
from panelfill.sources.storage import stored

N = 13
BLOCK = 1 << 21
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
TAKEN = ["n_words", "n_hit", "spans", "items", "_hit", "_items", "_words", "_spans"]
FILTER_BITS = 22
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("_hit", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType())),
                      T.StructField("_words", T.LongType()), T.StructField("_spans", SPANS)])


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes.lower() changes A-Z only


def item_windows(items: list[tuple], n: int) -> dict[bytes, set[str]]:
    """Window, as its words joined by blanks, to the ids of the items that hold it."""
    out: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of((text or "").encode())
        for i in range(max(0, len(words) - n) + 1 if words else 0):
            out[b" ".join(words[i:i + n])] |= {str(item)} - {"None"}
    return dict(out)


class Scanner:
    """Finds the windows in blocks of texts."""

    def __init__(self, windows: dict[bytes, set[str]]):
        self.windows, self.values, self.hasher = windows, byte_values(13), SpanHasher()
        self.sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[np.ndarray]] = defaultdict(list)
        for window in windows:
            hashes, _, _ = self._words(np.frombuffer(window, np.uint8))
            by_size[len(hashes)].append(windows_of(hashes, len(hashes)))
        for size, found in by_size.items():
            known = np.unique(np.concatenate(found))
            maybe = np.zeros(1 << FILTER_BITS, bool)
            maybe[known & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.sets[size] = known, maybe

    def _words(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends = runs(IS_WORD[block])
        self.hasher.load(block, self.values)
        return self.hasher.of(starts, ends), starts, ends

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, set[str]]]:
        """For each text: words, starts and ends of its words in bytes, which of them are hit, items found."""
        for lo, hi in slices(np.array([len(t) + 1 for t in texts]), BLOCK):
            block = LOWER[np.frombuffer(b"\0".join(texts[lo:hi]) + b"\0", np.uint8)]
            bounds = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
            hashes, starts, ends = self._words(block)
            first = np.searchsorted(starts, bounds)
            raw, hits = block.tobytes(), defaultdict(list)
            items: dict[int, set[str]] = defaultdict(set)
            for size, (known, maybe) in self.sets.items():
                found = windows_of(hashes, size)
                at = np.flatnonzero(maybe[found & np.uint64((1 << FILTER_BITS) - 1)])
                at = at[np.isin(found[at], known)]
                docs = np.searchsorted(first, at, "right") - 1
                inside = at + size <= first[docs + 1]
                for i, doc in zip(at[inside].tolist(), docs[inside].tolist()):
                    window = b" ".join(raw[s:e] for s, e in zip(starts[i:i + size], ends[i:i + size]))
                    if window in self.windows:
                        hits[doc].append((i - first[doc], size))
                        items[doc] |= self.windows[window]
            for doc in range(hi - lo):
                a, b = first[doc], first[doc + 1]
                hit = np.zeros(b - a, bool)
                if doc in hits:
                    at, size = np.array(hits[doc]).T
                    hit = covered(at, size, b - a)
                yield b - a, starts[a:b] - bounds[doc], ends[a:b] - bounds[doc], hit, items.get(doc, set())


def _part_count(benchmark: DataFrame, n: int, max_bytes: int) -> int:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total * n // max_bytes))


def _part(benchmark: DataFrame, n: int, part: int, parts: int) -> dict[bytes, set[str]]:
    """Windows of one part of the items; the size of a part is bounded by the number of parts."""
    own = benchmark.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
    return item_windows([(r[0], r[1]) for r in own.select("item_id", "text").toLocalIterator()], n)


@names_apart(*TAKEN)
def find_passages(docs: DataFrame, benchmark: DataFrame, n: int = N, max_bytes: int = 256 << 20) -> DataFrame:
    """The documents with what the benchmark left in them.

    Adds ``n_words``, ``n_hit`` (words in any occurring window), ``spans`` (maximal hit runs as byte offsets,
    end exclusive) and ``items`` (ids of items that occur, sorted as strings). The window set is broadcast while it
    stays below ``max_bytes``; a larger benchmark is scanned part after part, the found words kept between the scans.
    """
    kept, spark = docs.columns, docs.sparkSession
    state = docs.withColumns({"_hit": F.array().cast("array<int>"), "_items": F.array().cast("array<string>")})
    parts = _part_count(benchmark, n, max_bytes)
    for part in range(parts):
        state = _scanned(state, spark.sparkContext.broadcast(_part(benchmark, n, part, parts)))
        if part + 1 < parts:
            state = stored(state, "benchmark-part")
    return state.select(*[F.col(f"`{c}`") for c in kept], F.col("_words").alias("n_words"),
                        F.size("_hit").cast("long").alias("n_hit"), F.col("_spans").alias("spans"),
                        F.array_sort("_items").alias("items"))



def _scanned(docs: DataFrame, shared) -> DataFrame:
    extra = {"_words", "_spans", "_hit", "_items"}
    schema = T.StructType([f for f in docs.schema.fields if f.name not in extra] + FOUND.fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            before_hit, before_items = batch.column("_hit").to_pylist(), batch.column("_items").to_pylist()
            counts, spans, hits, items = [], [], [], []
            for i, (words, starts, ends, hit, found) in enumerate(scanner.scan(texts)):
                if len(before_hit[i]):
                    hit[before_hit[i]] = True
                a, b = runs(hit) if hit.any() else ((), ())
                counts.append(int(words))
                spans.append([{"start": int(starts[x]), "end": int(ends[y - 1])} for x, y in zip(a, b)])
                hits.append(np.flatnonzero(hit).tolist())
                items.append(sorted(found.union(before_items[i])))
            carried = [c for c in batch.schema.names if c not in extra]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried]
                + [pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(counts, pa.int64()),
                   pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                [*carried, "_hit", "_items", "_words", "_spans"])

    return docs.mapInArrow(scan, schema)


def contaminated() -> F.Column:
    """At least a twentieth of the words lie in benchmark windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


@names_apart(*TAKEN)
def without_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that are not contaminated, unchanged."""
    return find_passages(docs, benchmark, **options).where(~contaminated()).select(*[f"`{c}`" for c in docs.columns])


@names_apart(*TAKEN)
def without_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All documents, the hit spans cut out of their texts."""
    found = find_passages(docs, benchmark, **options)
    raw = F.encode("text", "utf-8")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    starts = F.concat(F.col("spans.start"), F.array(F.octet_length("text").cast("long")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")),
                         lambda p: F.decode(F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), "utf-8"))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.array_join(pieces, ""))
    return found.withColumn("text", text).select(*[f"`{c}`" for c in docs.columns])
