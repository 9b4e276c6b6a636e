"""Hiding known values on purpose, and the samples and splits used for tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelfill.functions.draws import draw_hash, hash_number, uniform
from panelfill.functions.keys import CELL, SERIES
from panelfill.operators.pattern import apply_mask
from panelfill.operators.scan import cell_join, date_ordinal, ordinal

HASH_BUCKETS = 4096  # rows of one series are ranked in this many independent slices


def _hide(p: DataFrame, hit: Column) -> DataFrame:
    """Hide observed cells only; cells without a value are not part of the experiment."""
    return apply_mask(p.withColumn("missing", F.col("Value").isNotNull() & hit))


def mask_mcar(p: DataFrame, rate: float = 0.2, seed: int = 42) -> DataFrame:
    return _hide(p, uniform(seed, *SERIES, "Date") < rate)


def mask_per_series(p: DataFrame, frac: float = 0.1, seed: int = 42) -> DataFrame:
    """Hide max(1, floor(frac * n)) of the n observed cells of every series: those with the lowest draws.

    Ranks are exact. They are taken inside slices of the draw and shifted by the slices before,
    so that even one huge series is ranked by many tasks.
    """
    h = draw_hash(seed, *SERIES, "Date")
    seen = p.where(F.col("Value").isNotNull()).select(*CELL, h.alias("_h"))
    bucket = F.floor(hash_number(F.col("_h")) / (4294967296 // HASH_BUCKETS))
    ranked = ordinal(seen, SERIES, ["_h", "Date"], bucket, "_rank", "_total")
    quota = F.greatest(F.lit(1), F.floor(F.col("_total") * frac))
    hidden = ranked.where(F.col("_rank") <= quota).select(*CELL, F.lit(True).alias("_hit"))
    return _hide(cell_join(p, hidden, "left"), F.coalesce("_hit", F.lit(False))).drop("_hit")


def block_length(n_steps: Column, block: int = 10) -> Column:
    """Short series (under 250 steps) use blocks of 2."""
    return F.when(n_steps < 250, F.lit(2)).otherwise(F.lit(block))


def mask_blocks(p: DataFrame, rates=(0.05, 0.1, 0.2, 0.4, 0.6, 0.8), block: int = 10, seed: int = 42) -> DataFrame:
    """Hide whole blocks of consecutive steps. One output copy of the panel per rate (column ``rate``)."""
    placed = date_ordinal(p, SERIES, total="_total")
    blocks = placed.withColumn("_block", F.floor((F.col("_pos") - 1) / block_length(F.col("_total"), block)))
    drawn = blocks.withColumn("_u", uniform(seed, *SERIES, "_block"))
    swept = drawn.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    return _hide(swept, F.col("_u") < F.col("rate")).drop("_pos", "_total", "_block", "_u")


def indicating_mask(masked: DataFrame, orig: DataFrame) -> DataFrame:
    """True where exactly one of the two panels has a value."""
    a = masked.select(*CELL, F.col("Value").isNull().alias("_a"))
    b = orig.select(*CELL, F.col("Value").isNull().alias("_b"))
    return cell_join(a, b).select(*CELL, (F.col("_a") != F.col("_b")).alias("indicating"))


def masked_mae(m: DataFrame, truth: DataFrame, mask: DataFrame, keys=()) -> DataFrame:
    """sum(|fill - truth| * mask) / sum(mask); unknown truth counts as 0, as in the training check."""
    # The masked cells come first: they are few, the fills are the panel times the methods.
    hidden = mask.where(F.col("indicating")).select(*CELL)
    known = cell_join(truth.select(*CELL, F.col("Value").alias("_truth")), hidden)
    joined = cell_join(m.withColumnRenamed("Value", "_fill"), known)
    err = F.abs(F.coalesce("_fill", F.lit(0.0)) - F.coalesce("_truth", F.lit(0.0)))
    return joined.groupBy(*keys).agg(F.avg(err).alias("masked_mae"))


def head_rows(p: DataFrame, n: int, dates: DataFrame | None = None) -> DataFrame:
    """All cells of the first n dates: the tuning sample. Only the distinct dates are sorted.

    ``dates`` are the dates of the panel where they are known without it (``clean.grid_dates``); else the panel is read for them.
    """
    first = (p if dates is None else dates).select("Date").distinct().orderBy("Date").limit(n)
    return p.join(first, "Date", "left_semi")


def last_points(p: DataFrame, freq: str = "1d", resampled: bool = True, dates: DataFrame | None = None) -> DataFrame:
    """All cells of the last 365 (daily), 52 (weekly) or 720 (hourly) dates; ``dates`` as in ``head_rows``."""
    f = freq.lower()
    n = 365 if resampled and "d" in f else 52 if resampled and "w" in f else 30 * 24
    last = (p if dates is None else dates).select("Date").distinct().orderBy(F.col("Date").desc()).limit(n)
    return p.join(last, "Date", "left_semi")


def every_kth(p: DataFrame, k: int = 24) -> DataFrame:
    """Rows 1, k+1, 2k+1, ... of every series."""
    placed = date_ordinal(p, SERIES)
    return placed.where(F.pmod(F.col("_pos") - 1, F.lit(k)) == 0).drop("_pos")


def pick_series(rates: DataFrame, lo: float = 0.05, hi: float = 0.40) -> DataFrame:
    """Per feature the series with the highest missing rate in [lo, hi]; the first station on ties."""
    inside = rates.where(F.col("missing_rate").between(lo, hi))
    best = inside.groupBy("Feature").agg(F.max("missing_rate").alias("missing_rate"))
    return (inside.join(best, ["Feature", "missing_rate"])
            .groupBy("Feature", "missing_rate").agg(F.min("Station").alias("Station")))


def tuning_target(p: DataFrame, value: str = "Value_missing") -> DataFrame:
    """First series (by name) with a gap, else the first series."""
    per = p.groupBy(*SERIES).agg(F.count_if(F.col(value).isNull()).alias("_gaps"))
    key = F.struct(*SERIES)
    return per.agg(F.coalesce(F.min(F.when(F.col("_gaps") > 0, key)), F.min(key)).alias("s")).select("s.*")


def sample_split(rows: DataFrame, n: int, frac: float = 0.8, seed: int = 42, key=("Date",)) -> DataFrame:
    """Draw n rows without replacement, then mark ``frac`` of them as training rows (column is_train)."""
    drawn = rows.withColumn("_h", draw_hash(seed, *key)).orderBy("_h").limit(n)
    # At most n rows are left, so one window may order them all.
    again = W.orderBy("_h2")
    ranked = (drawn.withColumn("_h2", draw_hash(seed + 1, *key))
              .withColumn("_rank", F.row_number().over(again))
              .withColumn("_n", F.count(F.lit(1)).over(W.partitionBy())))
    held_out = F.ceil(F.round(F.col("_n") * (1 - frac), 9))
    return (ranked.withColumn("is_train", F.col("_rank") <= F.col("_n") - held_out)
            .drop("_h", "_h2", "_rank", "_n"))
