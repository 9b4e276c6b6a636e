"""Low-rank completion by Spark's alternating least squares."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, functions as F

from panelfill.functions.keys import CELL, SERIES
from panelfill.operators.scale import fit_scaler, scale
from panelfill.operators.scan import cell_join, date_ordinal, ordinal


def impute_als(p: DataFrame, value: str = "Value_missing", rank: int = 5, reg: float = 0.1, max_iter: int = 10,
               seed: int = 42) -> DataFrame:
    """Low-rank completion of the Date x series matrix of z-scores; what stays unknown takes the series mean."""
    scaler = fit_scaler(p, "standard", value)
    slim = scale(p.select(*CELL, value), scaler, value)
    # Dense ids: one row per date and one row per series are numbered, never cells.
    dates = date_ordinal(p.select("Date").distinct(), [], out="date_id").select("Date", F.col("date_id").cast("int").alias("date_id"))
    series = p.select(*SERIES).distinct()
    series = ordinal(series, [], ["Station", "Feature"], F.substring("Station", 1, 6), "series_id") \
        .select(*SERIES, F.col("series_id").cast("int").alias("series_id"))
    coded = slim.join(dates, "Date").join(series, SERIES)
    model = ALS(userCol="date_id", itemCol="series_id", ratingCol=value, rank=rank, regParam=reg, maxIter=max_iter,
                seed=seed, coldStartStrategy="nan").fit(coded.where(F.col(value).isNotNull()))
    gaps = coded.where(F.col(value).isNull()).drop(value)
    guess = model.transform(gaps).join(scaler, SERIES)
    back = F.col("prediction").cast("double") * F.col("scale") + F.col("mean")
    fills = guess.select(*CELL, F.coalesce(F.when(~F.isnan("prediction"), back), F.col("mean")).alias("_fill"))
    return (cell_join(p, fills, "left").withColumn(value, F.coalesce(F.col(value), F.col("_fill"))).select(*p.columns))
