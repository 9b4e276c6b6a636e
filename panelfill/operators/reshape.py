"""Long <-> wide and partition keys. The stored form is always long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelfill.functions.keys import SERIES

BY = ("Station", "Feature", "Wide")


def to_long(df: DataFrame, id_cols=("Date",), name: str = "Station", value: str = "Value",
            columns: list[str] | None = None) -> DataFrame:
    """Melt every non-id column into (name, value) rows."""
    columns = columns or [c for c in df.columns if c not in id_cols]
    return df.unpivot(list(id_cols), [F.col(f"`{c}`").cast("double").alias(c) for c in columns], name, value)


def series_name(sep: str = ":") -> Column:
    return F.concat_ws(sep, *SERIES)


def to_wide(p: DataFrame, by: str = "Wide", value: str = "Value", columns: list[str] | None = None) -> DataFrame:
    """One column per station ('Feature' partitions), per feature ('Station') or per 'station:feature' ('Wide').

    Without ``columns`` the names are looked up first. Spark refuses more than spark.sql.pivotMaxValues of them:
    past that width the panel should stay long.
    """
    if by == "Feature":
        grouped, name = p.groupBy("Feature", "Date"), "Station"
    elif by == "Station":
        grouped, name = p.groupBy("Station", "Date"), "Feature"
    elif by == "Wide":
        grouped, name = p.withColumn("_name", series_name()).groupBy("Date"), "_name"
    else:
        raise ValueError(f"by must be one of {BY}, got {by!r}")
    return grouped.pivot(name, columns).agg(F.first(value, ignorenulls=True))


def with_partition(p: DataFrame, by: str = "Wide") -> DataFrame:
    if by not in BY:
        raise ValueError(f"by must be one of {BY}, got {by!r}")
    return p.withColumn("part", F.lit("Wide") if by == "Wide" else F.col(by))


def parse_series_name(df: DataFrame, col: str, default_station: str = "wide") -> DataFrame:
    """'station:feature' or '{"station","feature"}' -> Station, Feature. Only the first colon splits."""
    braced = F.col(col).startswith('{"')
    plain = F.when(braced, F.regexp_replace(F.regexp_replace(col, r'^\{"|"\}$', ""), '","', ":")).otherwise(F.col(col))
    pieces = F.split(plain, ":", 2)
    has_station = F.size(pieces) == 2
    return df.withColumns({
        "Station": F.when(has_station, pieces[0]).otherwise(F.lit(default_station)),
        "Feature": F.when(has_station, F.get(pieces, F.lit(1))).otherwise(plain),
    })


def swap_keys(s: DataFrame, a: str = "station", b: str = "feature") -> DataFrame:
    names = {a: b, b: a}
    return s.select(*[F.col(names.get(c, c)).alias(c) for c in s.columns])


def series_slice(m: DataFrame, feature: str, station: str, start: str, end: str) -> DataFrame:
    """One series and a closed date range, split into what was observed, what was hidden and what was filled.

    ``m`` has Value (truth), missing and Value_imputed; the filters reach the scan.
    """
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    rows = m.where((F.col("Feature") == feature) & (F.col("Station") == station) & F.col("Date").between(lo, hi))
    hidden = F.coalesce(F.col("missing"), F.lit(False))
    return rows.select(
        *[c for c in m.columns if c not in ("Value", "Value_missing", "missing", "Value_imputed")],
        F.when(~hidden, F.col("Value")).alias("observed"),
        F.when(hidden, F.col("Value")).alias("hidden_truth"),
        F.when(hidden, F.col("Value_imputed")).alias("imputed"))
