"""Helpers shared by the text operators: tables, Arrow batches, byte blocks and hashes."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names_apart(*taken: str) -> Callable:
    """For operators that use the column names ``taken``: input columns of these names go under others meanwhile. They
    come back where the operator makes no column of that name, and give way to it where it does."""
    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            inside = {f"_input_{c}": c for c in docs.columns if c in taken}
            if not inside:
                return operator(docs, *args, **options)
            out = operator(docs.withColumnsRenamed({c: n for n, c in inside.items()}), *args, **options)
            back = {c: inside[c] for c in out.columns if c in inside and inside[c] not in out.columns}
            gone = set(inside) - set(back)
            return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns if c not in gone])
        return run
    return wrap


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8."""
    return pc.cast(column, pa.large_binary()).to_pylist()


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items of at most ``limit`` units together; an item above the limit stands alone."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)


def text_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most ``limit`` bytes together, so that few of them are Python objects at once."""
    yield from slices(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False) + 1, limit)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class SpanHasher:
    """64-bit hashes of any spans of a byte block, from prefix sums of a polynomial modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15 | 1
    BACK = pow(BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (
                np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64), dtype=np.uint64)])
                for b in (self.BASE, self.BACK))

    def load(self, block: np.ndarray, values: np.ndarray) -> None:
        """``values`` maps each byte to its number."""
        self._reach(len(block) + 1)
        self.sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(values[block] * self.up[:len(block)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte value."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


def windows_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j:len(hashes) - n + 1 + j]
    return mixed(out)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def covered(starts: np.ndarray, length: int | np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in any range [start, start + length)."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + length, size), -1)
    return np.cumsum(marks[:-1]) > 0
