"""Scaling per series. The scaler is a table with one row per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelfill.functions.keys import CALENDAR, SERIES
from panelfill.operators.clean import add_calendar


def fit_scaler(p: DataFrame, kind: str = "standard", value: str = "Value") -> DataFrame:
    """(Station, Feature, mean, scale), fitted on the truth. A constant series gets scale 1."""
    v = F.col(value)
    if kind in ("standard", "z_score"):
        shift, spread = F.avg(v), F.stddev_pop(v)
    elif kind in ("minmax", "min_max"):
        shift, spread = F.min(v), F.max(v) - F.min(v)
    else:
        raise ValueError(f"unknown scaler {kind!r}")
    fitted = p.groupBy(*SERIES).agg(shift.alias("mean"), spread.alias("scale"))
    return fitted.withColumn("scale", F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale")))


def scale(p: DataFrame, scaler: DataFrame, col: str = "Value_missing") -> DataFrame:
    """Scale one column; the truth next to it stays as it is.

    The join carries no hint: Spark broadcasts the scaler when its measured size allows it, and
    otherwise splits an oversized series in the sort-merge join (adaptive skew join).
    """
    return (p.join(scaler, SERIES, "left")
            .withColumn(col, (F.col(col) - F.col("mean")) / F.col("scale"))
            .select(*p.columns))


def unscale(m: DataFrame, scaler: DataFrame, col: str = "Value", skip_methods=("original", "mask")) -> DataFrame:
    """Undo ``scale``, matched on the series key. Rows of never-scaled methods are left alone."""
    back = F.col(col) * F.col("scale") + F.col("mean")
    if "method" in m.columns:
        back = F.when(F.col("method").isin(list(skip_methods)), F.col(col)).otherwise(back)
    return m.join(scaler, SERIES, "left").withColumn(col, back).select(*m.columns)


def scale_calendar(p: DataFrame, resampled: bool = False) -> DataFrame:
    """Calendar fields in [0, 1] over the panel's dates; a constant field becomes 0."""
    q = add_calendar(p, resampled)
    bounds = q.select(F.struct(
        *[F.min(c).alias(f"lo_{c}") for c in CALENDAR], *[F.max(c).alias(f"hi_{c}") for c in CALENDAR]
    ).alias("b")).scalar()
    q = q.withColumn("_b", bounds)

    def scaled(c):
        lo, hi = F.col(f"_b.lo_{c}"), F.col(f"_b.hi_{c}")
        return F.coalesce((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0)), F.lit(0.0))

    return q.withColumns({c: scaled(c) for c in CALENDAR}).drop("_b")


def normalise(p: DataFrame, kind: str = "z_score", value: str = "Value") -> DataFrame:
    """Fit and apply in one go, on the column itself."""
    return scale(p, fit_scaler(p, kind, value), value)
