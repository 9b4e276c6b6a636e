"""Seeded draws that depend on the cell's key only, so a re-run or a lost task gives the same result."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def draw_key(seed: int, *cols: str) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])


def draw_hash(seed: int, *cols: str) -> Column:
    return F.md5(draw_key(seed, *cols))


def hash_number(h: Column) -> Column:
    """First 8 hex digits of the hash as a whole number in [0, 2^32)."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, *cols: str) -> Column:
    return hash_number(draw_hash(seed, *cols)) / F.lit(4294967296.0)
