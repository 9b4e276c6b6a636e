"""Scores per (method, station, feature), taken on the hidden cells only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelfill.functions.keys import CELL, METRICS, SCORE_COLUMNS, SERIES
from panelfill.operators.gaps import missing_rate
from panelfill.operators.scale import unscale
from panelfill.operators.scan import cell_join
from panelfill.operators.similarity import dtw, ssim

NOT_A_METHOD = ["mask"]


def align_to_truth(truth: DataFrame, m: DataFrame) -> DataFrame:
    """Every truth cell once per method: rows beyond the truth are dropped, absent fills become null.

    Only the list of method names is gathered, never cells.
    """
    methods = m.select(F.collect_set("method").alias("x")).scalar()
    index = truth.select(*CELL, F.col("Value").alias("truth")).withColumn("method", F.explode(methods))
    return cell_join(index, m.select("method", *CELL, F.col("Value").alias("fill")), "left", ["method", *CELL])


def score_cells(truth: DataFrame, m: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Hidden cells with a truth and a fill: (method, Date, Station, Feature, truth, fill).

    ``truth`` may carry the mask itself (column missing), which saves a join. Joins are on the whole
    cell key, where no key repeats. Fills may say themselves that the truth was hidden (``run_methods`` with
    ``mark_hidden``, of the same panel): the others, most of them, then don't go to the join.
    """
    base = truth.select(*CELL, F.col("Value").alias("truth"), *(["missing"] if mask is None else []))
    if mask is not None:
        base = cell_join(base, mask.select(*CELL, "missing"))
    hidden = base.where(F.col("missing") & F.col("truth").isNotNull()).drop("missing")
    fills = m.where(~F.col("method").isin(NOT_A_METHOD) & F.col("Value").isNotNull())
    if mask is None and "hidden" in m.columns:
        fills = fills.where("hidden")
    return cell_join(fills.select("method", *CELL, F.col("Value").alias("fill")), hidden)


def unmatched_series(truth: DataFrame, m: DataFrame, mask: DataFrame) -> DataFrame:
    """Series that cannot be scored, with the table they are lacking from."""
    series = truth.select(*SERIES).distinct()
    methods = m.select(F.collect_set("method").alias("x")).scalar()
    filled = m.select("method", *SERIES).distinct()
    no_fill = series.withColumn("method", F.explode(methods)).join(filled, ["method", *SERIES], "left_anti")
    no_mask = series.join(mask.select(*SERIES).distinct(), SERIES, "left_anti")
    return no_fill.select("method", *SERIES, F.lit("imputed").alias("lacking_from")).unionByName(
        no_mask.select(F.lit(None).cast("string").alias("method"), *SERIES, F.lit("mask").alias("lacking_from")))


def score_series(cells: DataFrame) -> DataFrame:
    """RMSE, MAE, MAPE, R2 and cosine similarity in one aggregate.

    The total sum of squares comes from the merged variance, which stays accurate for large offsets.
    """
    t, f = F.col("truth"), F.col("fill")
    err = f - t
    n = F.count(F.lit(1))
    total_squares = F.var_pop(t) * n
    norm = F.sqrt(F.sum(t * t)) * F.sqrt(F.sum(f * f))
    return cells.groupBy("method", *SERIES).agg(
        F.sqrt(F.avg(err * err)).alias("RMSE"),
        F.avg(F.abs(err)).alias("MAE"),
        (F.avg(F.abs(err) / F.greatest(F.abs(t), F.lit(1e-8))) * 100).alias("MAPE"),
        (1 - F.sum(err * err) / F.nullif(total_squares, F.lit(0.0))).alias("R2"),
        F.coalesce(F.sum(t * f) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)).alias("cosine_similarity"))


def with_run_metadata(s: DataFrame, run: int, partition_method: str = "wide", scaling: bool = False,
                      resample: bool = False, resample_freq: str | None = None) -> DataFrame:
    return s.withColumns({
        "run": F.lit(run).cast("int"), "partition_method": F.lit(partition_method),
        "scaling": F.lit(scaling), "resample": F.lit(resample),
        "resample_freq": F.lit(resample_freq if resample else None).cast("string")})


def evaluate(truth: DataFrame, m: DataFrame, mask: DataFrame | None = None, scaler: DataFrame | None = None,
             run: int = 1, band: int | None = 10, with_dtw: bool = True, with_ssim: bool = True, **meta) -> DataFrame:
    """The full score table. Fills are brought back to the original units first when a scaler is given.

    Whatever partitioning was used to fill, scores are always per feature and station.
    """
    if scaler is not None:
        m = unscale(m, scaler)
    m = m.where(~F.col("method").isin(NOT_A_METHOD))
    cells = score_cells(truth, m, mask)
    scores = score_series(cells)
    rates = missing_rate(truth if mask is None else mask)
    scores = scores.join(rates, SERIES)
    if with_dtw:
        scores = scores.join(dtw(cells, band), ["method", *SERIES], "left")
    else:
        scores = scores.withColumn("dtw_distance", F.lit(None).cast("double"))
    if with_ssim:
        scores = scores.join(ssim(truth, m), ["method", "Feature"], "left")
    else:
        scores = scores.withColumn("SSIM", F.lit(None).cast("double"))
    named = (scores.withColumnRenamed("method", "imputation_method")
             .withColumnRenamed("Station", "station").withColumnRenamed("Feature", "feature"))
    return with_run_metadata(named, run, **meta).select(*SCORE_COLUMNS)
