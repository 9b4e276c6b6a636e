"""Filling along the time axis and description of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelfill.functions.calendar import span_chunk
from panelfill.functions.keys import SERIES
from panelfill.operators.scan import BEFORE, SPAN_DAYS, date_ordinal, observed_neighbours

HELPERS = ["_pos", "_prev", "_prev_pos", "_next", "_next_pos", "_mean"]


def blend(value: Column) -> Column:
    """Straight line between the neighbours, by row position; null outside the observed range."""
    run = F.col("_next_pos") - F.col("_prev_pos")
    slope = (F.col("_next") - F.col("_prev")) / F.nullif(run, F.lit(0))
    return F.coalesce(value, F.col("_prev") + slope * (F.col("_pos") - F.col("_prev_pos")))


def nearest_past_then_future(value: Column) -> Column:
    return F.coalesce(value, F.col("_prev"), F.col("_next"))


def blend_flat_ends(value: Column) -> Column:
    return F.coalesce(blend(value), F.col("_prev"), F.col("_next"))


def ffill_bfill(p: DataFrame, value: str = "Value", span_days: int = SPAN_DAYS) -> DataFrame:
    q = observed_neighbours(p, value, span_days=span_days)
    return q.withColumn(value, nearest_past_then_future(F.col(value))).select(*p.columns)


def interpolate_interior(p: DataFrame, value: str = "Value", span_days: int = SPAN_DAYS) -> DataFrame:
    """Linear inside the observed range of each series; the ends stay null."""
    q = observed_neighbours(p, value, span_days=span_days)
    return q.withColumn(value, blend(F.col(value))).select(*p.columns)


def interpolate_both(p: DataFrame, value: str = "Value", span_days: int = SPAN_DAYS) -> DataFrame:
    """Linear inside the observed range, flat beyond it."""
    q = observed_neighbours(p, value, span_days=span_days)
    return q.withColumn(value, blend_flat_ends(F.col(value))).select(*p.columns)


def gap_blocks(p: DataFrame, span_days: int = SPAN_DAYS) -> DataFrame:
    """One row per interior run of nulls: first and last missing Date and the number of nulls.

    Only observed cells are scanned: a gap is the distance to the previous observed position.
    """
    placed = date_ordinal(p.select("Date", *SERIES, "Value"), SERIES, span_days=span_days)
    seen = placed.where(F.col("Value").isNotNull()).withColumn("_chunk", span_chunk(F.col("Date"), span_days))
    near = W.partitionBy(*SERIES, "_chunk").orderBy("_pos")
    ends = seen.groupBy(*SERIES, "_chunk").agg(F.max("_pos").alias("_end"), F.max("Date").alias("_end_date"))
    carried = ends.select(
        *SERIES, "_chunk",
        F.max("_end").over(W.partitionBy(*SERIES).orderBy("_chunk").rowsBetween(*BEFORE)).alias("_in"),
        F.max("_end_date").over(W.partitionBy(*SERIES).orderBy("_chunk").rowsBetween(*BEFORE)).alias("_in_date"))
    with_prev = (seen.withColumn("_before", F.lag("_pos").over(near))
                 .withColumn("_before_date", F.lag("Date").over(near))
                 .join(carried, [*SERIES, "_chunk"])
                 .withColumn("_before", F.coalesce("_before", "_in"))
                 .withColumn("_before_date", F.coalesce("_before_date", "_in_date")))
    size = F.col("_pos") - F.col("_before") - 1
    return with_prev.where(size > 0).select(
        *SERIES, F.col("_before_date").alias("after"), F.col("Date").alias("before"),
        size.cast("bigint").alias("block_size"))


def gap_report(p: DataFrame, span_days: int = SPAN_DAYS) -> DataFrame:
    """Per series: nulls, interior blocks and their sizes as ``array<struct<size, blocks>>`` in size order.

    Equal sizes share one entry, so the array stays short however many gaps a series has;
    ``gap_blocks`` lists every gap.
    """
    totals = null_counts(p)
    per_size = gap_blocks(p, span_days).groupBy(*SERIES, "block_size").agg(F.count(F.lit(1)).alias("_n"))
    blocks = per_size.groupBy(*SERIES).agg(
        F.sum("_n").alias("missing_blocks"), F.max("block_size").alias("longest_block"),
        F.sum(F.col("block_size") * F.col("_n")).alias("missing_in_blocks"),
        F.sort_array(F.collect_list(F.struct(F.col("block_size").alias("size"), F.col("_n").alias("blocks"))))
        .alias("block_sizes"))
    return (totals.join(blocks, SERIES, "left")
            .na.fill(0, ["missing_blocks", "longest_block", "missing_in_blocks"]))


def missing_rate(p: DataFrame, missing: str = "missing") -> DataFrame:
    """Masked cells, all cells and their ratio per series. A null mask counts as a cell, not as masked."""
    n = F.count_if(F.col(missing))
    total = F.count(F.lit(1))
    return p.groupBy(*SERIES).agg(
        n.alias("n_missing_values"), total.alias("n_total_values"), (n / total).alias("missing_rate"))


def null_counts(p: DataFrame, value: str = "Value") -> DataFrame:
    return p.groupBy(*SERIES).agg(F.count_if(F.col(value).isNull()).alias("missing_values"))


def valid_span(p: DataFrame, value: str = "Value") -> DataFrame:
    stamp = F.when(F.col(value).isNotNull(), F.col("Date"))
    return p.groupBy(*SERIES).agg(F.min(stamp).alias("first_valid"), F.max(stamp).alias("last_valid"))


def distinct_keys(p: DataFrame) -> DataFrame:
    return p.select(*SERIES).distinct()


def key_counts(p: DataFrame) -> DataFrame:
    """Number of stations, features and series, counted on the short list of series."""
    return distinct_keys(p).agg(
        F.countDistinct("Station").alias("n_stations"), F.countDistinct("Feature").alias("n_features"),
        F.count(F.lit(1)).alias("n_series"))


def date_range(p: DataFrame) -> DataFrame:
    return p.agg(F.min("Date").alias("min_date"), F.max("Date").alias("max_date"))


def describe_dates(p: DataFrame, span_days: int = SPAN_DAYS) -> DataFrame:
    """Count, nulls, range and exact quartiles (nearest rank) of Date.

    Works on the row count per distinct Date; running counts are taken per time chunk and then shifted.
    """
    per_date = p.groupBy("Date").agg(F.count(F.lit(1)).alias("_n"))
    dated = per_date.where(F.col("Date").isNotNull()).withColumn("_chunk", span_chunk(F.col("Date"), span_days))
    per_chunk = dated.groupBy("_chunk").agg(F.sum("_n").alias("_m"))
    shift = per_chunk.select("_chunk", F.coalesce(F.sum("_m").over(
        W.orderBy("_chunk").rowsBetween(*BEFORE)), F.lit(0)).alias("_shift"))
    upto = (dated.join(shift, "_chunk")
            .withColumn("_last", F.col("_shift") + F.sum("_n").over(W.partitionBy("_chunk").orderBy("Date")))
            .withColumn("_first", F.col("_last") - F.col("_n") + 1))
    total = dated.select(F.sum("_n").alias("t")).scalar()

    def quartile(q):
        rank = F.floor((F.col("_t") - 1) * q + 0.5) + 1
        return F.min(F.when(rank.between(F.col("_first"), F.col("_last")), F.col("Date")))

    quartiles = upto.withColumn("_t", total).agg(
        quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"),
        F.min("Date").alias("min_date"), F.max("Date").alias("max_date"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    nulls = p.select(F.count_if(F.col("Date").isNull()).alias("x")).scalar()
    return quartiles.withColumn("n_null", nulls)
