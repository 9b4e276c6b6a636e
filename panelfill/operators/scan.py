"""Ordered scans over long series, split by time so that no series lands in one task.

A plain window over (Station, Feature) would sort a whole series in one task.
Here the window only spans one time chunk of a series; a small table with one
row per (series, chunk) carries counts and edge values from chunk to chunk.
The shuffle key of the cells is therefore (series, chunk), however long the series is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelfill.functions.calendar import span_chunk
from panelfill.functions.keys import CELL, SERIES

SPAN_DAYS = 366
BEFORE = (W.unboundedPreceding, -1)
UP_TO = (W.unboundedPreceding, W.currentRow)


def led(df: DataFrame, *cols: str) -> DataFrame:
    """Add the hash of a key as column _lead, to stand first in partition and join keys.

    Spark's sorts compare rows by the first 8 bytes of the first key before anything else. Station names
    that start alike all fall through to the slow comparison; their hash does not. Rows still only match on the full key.
    """
    return df.withColumn("_lead", F.xxhash64(*cols))


def cell_join(a: DataFrame, b: DataFrame, how: str = "inner", keys: list[str] = CELL) -> DataFrame:
    """Equi-join on whole cell keys, sorted by their hash.

    Both sides grow with the panel. A stored panel is a few bytes a row in its files, so Spark would take millions of
    rows for a small table and gather them on the driver; the hint keeps them in the shuffle.
    """
    return led(a, *keys).join(led(b, *keys).hint("merge"), ["_lead", *keys], how).drop("_lead")


def keyed(df: DataFrame, keys: list[str], part: Column) -> DataFrame:
    """The key and its part (say, the time chunk) as one column _key in place of the key's columns, its hash as _lead.

    The struct itself is never null, and null equals null inside it. So windows, groups and plain joins take cells without
    a key alike, and a join with a table of one row per key and part stays in the partitions of the windows.
    """
    rest = [c for c in df.columns if c not in keys]
    return led(df.select(F.struct(*keys, part.alias("_part")).alias("_key"), *rest), "_key")


def unkeyed(columns: list[str], keys: list[str]) -> list[Column]:
    """The columns as they were before ``keyed``, to be selected."""
    return [F.col("_key")[c].alias(c) if c in keys else F.col(c) for c in columns]


def ordinal(df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column,
            out: str = "_pos", total: str | None = None) -> DataFrame:
    """Exact 1-based row number per key.

    ``bucket`` must rise with ``order``: rows are numbered inside (key, bucket)
    and shifted by the number of rows in the key's earlier buckets.
    """
    rows = keyed(df, keys, bucket)
    per_bucket = rows.groupBy("_lead", "_key").agg(F.count(F.lit(1)).alias("_n")).select("*", "_key.*")
    w_keys = W.partitionBy(*keys)
    shift = per_bucket.select(
        "_lead", "_key",
        F.coalesce(F.sum("_n").over(w_keys.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0)).alias("_shift"),
        *([F.sum("_n").over(w_keys).alias(total)] if total else []))
    local = F.row_number().over(W.partitionBy("_lead", "_key").orderBy(*order))
    placed = rows.withColumn(out, local).join(shift.hint("merge"), ["_lead", "_key"])
    return placed.select(*unkeyed([c for c in df.columns if c != out], keys), (F.col(out) + F.col("_shift")).cast("bigint").alias(out), *([total] if total else []))


def date_ordinal(df: DataFrame, keys: list[str], out: str = "_pos", total: str | None = None,
                 span_days: int = SPAN_DAYS) -> DataFrame:
    return ordinal(df, keys, ["Date"], span_chunk(F.col("Date"), span_days), out, total)


def observed_neighbours(df: DataFrame, value: str = "Value", keys: list[str] = SERIES,
                        span_days: int = SPAN_DAYS) -> DataFrame:
    """Add, per cell: its row position, the nearest observed value at or before it and at or after it
    (with their positions) and the series mean.

    A cell whose key or date is null belongs to no series: it stays, without neighbours and mean.

    Added columns: _pos, _prev, _prev_pos, _next, _next_pos, _mean.
    """
    v = F.col(value)
    cells = keyed(df, keys, span_chunk(F.col("Date"), span_days))
    chunk = W.partitionBy("_lead", "_key")
    forward = chunk.orderBy("Date")
    upto = forward.rowsBetween(*UP_TO)
    onwards = chunk.orderBy(F.col("Date").desc()).rowsBetween(*UP_TO)

    numbered = cells.withColumn("_rn", F.row_number().over(forward))
    numbered = numbered.withColumn("_at", F.when(v.isNotNull(), F.col("_rn")))
    rn_seen = F.col("_at")

    edges = (numbered.groupBy("_lead", "_key").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(v).alias("_n_seen"), F.sum(v).alias("_sum"),
        F.min(rn_seen).alias("_first_rn"), F.min_by(v, rn_seen).alias("_first"),
        F.max(rn_seen).alias("_last_rn"), F.max_by(v, rn_seen).alias("_last")).select("*", "_key.*"))
    series = W.partitionBy(*keys)
    earlier = series.orderBy("_part").rowsBetween(*BEFORE)
    later = series.orderBy(F.col("_part").desc()).rowsBetween(*BEFORE)
    carried = (edges
               .withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
               .withColumn("_first_rn", F.col("_first_rn") + F.col("_shift"))
               .withColumn("_last_rn", F.col("_last_rn") + F.col("_shift"))
               .select("_lead", "_key", "_shift",
                       F.last("_last", True).over(earlier).alias("_in"),
                       F.last("_last_rn", True).over(earlier).alias("_in_pos"),
                       F.last("_first", True).over(later).alias("_out"),
                       F.last("_first_rn", True).over(later).alias("_out_pos"),
                       (F.sum("_sum").over(series) / F.nullif(F.sum("_n_seen").over(series), F.lit(0)))
                       .alias("_mean")))

    behind = numbered.select("*", F.last(v, True).over(upto).alias("_prev"), F.last("_at", True).over(upto).alias("_prev_pos"))
    local = behind.select("*", F.last(v, True).over(onwards).alias("_next"), F.last("_at", True).over(onwards).alias("_next_pos"))
    shift = F.col("_shift")
    known = F.col("Date").isNotNull()
    for k in keys:
        known = known & F.col("_key")[k].isNotNull()
    found = {"_prev": F.coalesce("_prev", "_in"), "_prev_pos": F.coalesce(F.col("_prev_pos") + shift, "_in_pos"),
             "_next": F.coalesce("_next", "_out"), "_next_pos": F.coalesce(F.col("_next_pos") + shift, "_out_pos"), "_mean": F.col("_mean")}
    return local.join(carried.hint("merge"), ["_lead", "_key"]).select(
        *unkeyed(df.columns, keys), *[F.when(known, c).alias(n) for n, c in found.items()], (F.col("_rn") + shift).alias("_pos"))
