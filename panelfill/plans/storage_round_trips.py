"""Queries: what was written and read back must be what was there."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelfill.functions.keys import CELL
from panelfill.operators import fill, reshape
from panelfill.plans import testbed as tb
from panelfill.plans.catalog import query, r, rounded
from panelfill.plans.scoring import _SCORES, table_of_scores
from panelfill.sources import panel_io
from panelfill.sources.storage import scratch_path

V, VM = r("Value"), r("Value_missing")


@query("feature_files_read", f"SELECT Date, Station, Feature, {V} FROM group_daily")
def feature_files_read(spark, sf):
    """One wide CSV per sensor, read back as one long panel."""
    folder = scratch_path(spark, "feature-csv")
    p = tb.group_daily(spark, sf).withColumn("Station", F.concat("Station", F.lit(" some place")))
    names = [r["Station"] for r in p.select("Station").distinct().orderBy("Station").collect()]
    for sensor in tb.FEATURES.values():
        wide = reshape.to_wide(p.where(F.col("Feature") == sensor), "Feature", columns=names).drop("Feature")
        wide.write.option("header", True).csv(f"{folder}/{sensor}.csv")
    return rounded(panel_io.read_feature_csvs(spark, folder))


@query("panel_round_trip", f"SELECT Date, Station, Feature, {V} FROM weekly")
def panel_round_trip(spark, sf):
    path = scratch_path(spark, "panel")
    panel_io.write_panel(tb.weekly(spark, sf).select("Date", "Feature", "Station", "Value"), path)
    return rounded(panel_io.read_panel(spark, path))


@query("panel_round_trip_csv", f"SELECT Date, Station, Feature, {V}, missing, {VM} FROM prepared")
def panel_round_trip_csv(spark, sf):
    path = scratch_path(spark, "panel-csv")
    panel_io.write_panel(tb.prepared(spark, sf).select("Date", "Feature", "Station", "Value", "missing", "Value_missing"), path, "csv")
    return rounded(panel_io.read_panel(spark, path, "csv", prepared=True))


@query("working_set_round_trip", f"SELECT Date, Station, Feature, {V}, missing, {VM}, Feature AS part FROM prepared")
def working_set_round_trip(spark, sf):
    path = scratch_path(spark, "working-set")
    panel_io.write_working_set(reshape.with_partition(tb.prepared(spark, sf), "Feature"), path)
    return rounded(panel_io.read_working_set(spark, path))


def _imputed(spark, sf):
    path = scratch_path(spark, "imputed")
    panel_io.write_imputed(fill.run_methods(tb.working_set(spark, sf), with_truth=True), path)
    return path


@query("imputed_round_trip", f"SELECT method, Date, Station, Feature, {V} FROM methods")
def imputed_round_trip(spark, sf):
    return rounded(panel_io.read_imputed(spark, _imputed(spark, sf))[0])


@query("methods_discovered", "SELECT unnest(['ffill', 'interpolation', 'mask', 'mean', 'original']) AS method, "
       "unnest(['method', 'method', 'mask', 'method', 'truth']) AS role")
def methods_discovered(spark, sf):
    return panel_io.discover_methods(spark, _imputed(spark, sf))


@query("scores_appended", f"SELECT {_SCORES} FROM scores UNION ALL SELECT 2 AS run, * EXCLUDE (run) FROM (SELECT {_SCORES} FROM scores)")
def scores_appended(spark, sf):
    """Two evaluations of the same fills get run ids 1 and 2."""
    path = scratch_path(spark, "scores")
    scores = table_of_scores(spark, sf).withColumn("dtw_distance", F.lit(None).cast("double"))
    panel_io.append_scores(scores, path)
    panel_io.append_scores(panel_io.read_scores(spark, path), path)
    return rounded(panel_io.read_scores(spark, path).drop("dtw_distance"))
