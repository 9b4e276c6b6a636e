"""Column names and schemas shared by every operator.

The panel is always long: one row per cell, keyed by (Date, Station, Feature).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SERIES = ["Station", "Feature"]
CELL = ["Date", "Station", "Feature"]
CALENDAR = ["Year", "Month", "Day", "Hour"]

PANEL_SCHEMA = T.StructType([
    T.StructField("Date", T.TimestampNTZType()),
    T.StructField("Feature", T.StringType()),
    T.StructField("Station", T.StringType()),
    T.StructField("Value", T.DoubleType()),
])

PREPARED_SCHEMA = T.StructType(PANEL_SCHEMA.fields + [
    T.StructField("missing", T.BooleanType()),
    T.StructField("Value_missing", T.DoubleType()),
])

# The score table's columns, in their published order.
SCORE_COLUMNS = [
    "run", "imputation_method", "partition_method", "station", "feature",
    "RMSE", "MAE", "MAPE", "R2", "SSIM", "dtw_distance", "cosine_similarity",
    "missing_rate", "n_missing_values", "n_total_values",
    "scaling", "resample", "resample_freq",
]
METRICS = ["RMSE", "MAE", "MAPE", "R2", "SSIM", "dtw_distance", "cosine_similarity"]
LOWER_IS_BETTER = ["RMSE", "MAE", "MAPE", "dtw_distance"]

SCORE_SCHEMA = T.StructType([
    T.StructField("run", T.IntegerType()),
    T.StructField("imputation_method", T.StringType()),
    T.StructField("partition_method", T.StringType()),
    T.StructField("station", T.StringType()),
    T.StructField("feature", T.StringType()),
    *[T.StructField(m, T.DoubleType()) for m in METRICS],
    T.StructField("missing_rate", T.DoubleType()),
    T.StructField("n_missing_values", T.LongType()),
    T.StructField("n_total_values", T.LongType()),
    T.StructField("scaling", T.BooleanType()),
    T.StructField("resample", T.BooleanType()),
    T.StructField("resample_freq", T.StringType()),
])


def nan_to_null(c: Column) -> Column:
    """Spark keeps NaN and NULL apart; the panel only ever uses NULL."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """+-inf and NaN become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def unique_keys(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Collapse to one row per key; a repeated key fails the job."""
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in rest], F.count(F.lit(1)).alias("_n"))
    message = F.concat(F.lit(f"duplicate {what}: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    guard = F.when(F.col("_n") > 1, F.raise_error(message).cast("string")).otherwise(F.col(keys[-1]))
    return counted.withColumn(keys[-1], guard).select(*df.columns)
