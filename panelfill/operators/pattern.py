"""Copy the missing-data pattern of one panel onto another one whose values are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from panelfill.functions.keys import CELL, SERIES
from panelfill.operators.clean import clip_to_range, drop_stations
from panelfill.operators.gaps import interpolate_interior
from panelfill.operators.scan import cell_join
from panelfill.sources.storage import stored


def missing_mask(p: DataFrame) -> DataFrame:
    return p.withColumn("missing", F.col("Value").isNull())


def gapped(value: Column, missing: Column) -> Column:
    """The value where it is known not to be missing; an unknown mask hides the value too."""
    return F.when(~missing, value)


def apply_mask(p: DataFrame) -> DataFrame:
    return p.withColumn("Value_missing", gapped(F.col("Value"), F.col("missing")))


def attach_mask(ref: DataFrame, mask: DataFrame) -> DataFrame:
    """Left equi-join on the whole cell key: no key repeats, so no task can become hot."""
    return cell_join(ref, mask.select(*CELL, "missing"), "left")


def align_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on every shared column."""
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b, shared, "full_outer")


def _rate(name: str) -> Column:
    return F.avg(F.col("missing").cast("double")).alias(name)


def feature_pattern(mask: DataFrame, exclude_stations=()) -> DataFrame:
    """Share of stations missing, per Date and Feature."""
    return drop_stations(mask, exclude_stations).groupBy("Date", "Feature").agg(_rate("feat_missing"))


def station_pattern(mask: DataFrame) -> DataFrame:
    """Share of features missing, per Date and Station."""
    return mask.groupBy("Date", "Station").agg(_rate("stat_missing"))


def absent_combos(p: DataFrame) -> DataFrame:
    """(Station, Feature) pairs without a single row. Only the list of features is held in one place."""
    series = p.select(*SERIES).distinct()
    every_feature = series.select(F.sort_array(F.collect_set("Feature")).alias("f")).scalar()
    present = series.groupBy("Station").agg(F.collect_set("Feature").alias("_have"))
    return present.select("Station", F.explode(F.array_except(every_feature, F.col("_have"))).alias("Feature"))


def complete_pattern(mask: DataFrame, exclude_stations=()) -> DataFrame:
    """Add the absent combos. Their mask is the mean of the feature's and the station's missing rate,
    rounded half to even; a rate that is not known on a Date is left out of the mean."""
    absent = stored(absent_combos(mask), "absent-combos")
    # Only stations that lack a feature are asked for their rates.
    lacking = mask.join(absent.select("Station").distinct(), "Station", "left_semi")
    by_feature = absent.join(feature_pattern(mask, exclude_stations), "Feature") \
        .select(*CELL, F.col("feat_missing").alias("_rate"))
    by_station = absent.join(station_pattern(lacking), "Station") \
        .select(*CELL, F.col("stat_missing").alias("_rate"))
    guessed = by_feature.unionByName(by_station).groupBy(*CELL).agg(
        F.rint(F.avg("_rate")).cast("boolean").alias("missing"))
    return mask.select(*CELL, "missing").unionByName(guessed)


def _ranked(stations: DataFrame, name: str) -> DataFrame:
    """Stations in name order. One row per station goes through this window, never cells."""
    return stations.distinct().select(
        F.col("Station").alias(name), F.row_number().over(W.orderBy("Station")).alias("_rank"))


def station_mapping(org: DataFrame, ref: DataFrame) -> DataFrame:
    """Pair the stations of both panels by name order; the shorter list decides."""
    return _ranked(org.select("Station"), "Station").join(
        _ranked(ref.select("Station"), "Station_ref"), "_rank").drop("_rank")


def map_stations(mask: DataFrame, mapping: DataFrame | dict | None = None, ref: DataFrame | None = None) -> DataFrame:
    """Rename org stations to ref stations; unmatched ones get a null name."""
    if isinstance(mapping, dict):
        spark: SparkSession = mask.sparkSession
        mapping = spark.createDataFrame(sorted(mapping.items()), "Station string, Station_ref string")
    elif mapping is None:
        mapping = station_mapping(mask, ref)
    columns = mask.columns
    return (mask.join(mapping, "Station", "left").drop("Station")
            .withColumnRenamed("Station_ref", "Station").select(*columns))


def flag_org_gaps(ref: DataFrame, org: DataFrame) -> DataFrame:
    """Left join on (Date, Station) only: each ref row meets the station's rows of every org feature."""
    flags = org.select("Date", "Station", F.col("Value").alias("Value_org"),
                       F.col("Value").isNull().alias("is_missing"))
    return ref.join(flags, ["Date", "Station"], "left")


def transfer_pattern(org: DataFrame, ref: DataFrame, clip: str = "default", drop_org=(), drop_ref=(),
                     exclude_stations=(), mapping: DataFrame | dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Give ``ref`` the gaps of ``org``. Returns (mask under ref's station names, prepared ref panel)."""
    org, ref = drop_stations(org, drop_org), drop_stations(ref, drop_ref)
    org, ref = clip_to_range(org, ref, clip)
    mask = complete_pattern(missing_mask(org), exclude_stations)
    if mapping is None:
        mapping = station_mapping(org, ref)
    mask = map_stations(mask, mapping)
    truth = interpolate_interior(ref)
    return mask, apply_mask(attach_mask(truth, mask))
