"""Panels that are asked for twice are built once, and masks meet the truth before the fills."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points  # conftest puts the root on the path
from helpers import panel
from panelfill.operators import clean, fill, masks
from panelfill.plans import testbed as tb

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grids(df):
    return plan(df).count("Generate explode(sequence(_at")


@tables
@pytest.mark.parametrize("name", ["last_points", "first_rows"])
def test_dates_of_the_grid_need_no_second_grid(spark, name):
    assert grids(tb.daily(spark, SF)) == 1
    assert grids(entry_points.queries()[name](spark, SF)) == 1


@tables
@pytest.mark.parametrize("name", ["masked_mae", "filled_all_methods", "filled_by_plug_in", "share_masked_per_series", "imputed_round_trip"])
def test_panels_that_are_read_twice_are_written_once(spark, name):
    assert grids(entry_points.queries()[name](spark, SF)) == 0


def stamps(spark, *texts):
    return spark.createDataFrame([(t, "s1", "f", 1.0) for t in texts], "d string, Station string, Feature string, Value double").select(
        F.col("d").cast("timestamp_ntz").alias("Date"), "Station", "Feature", "Value")


@pytest.mark.parametrize("texts", [
    ("2000-01-01", "2000-01-04", "2000-01-09"),
    ("2000-01-01", "2000-01-02 05:00:00", "2000-01-03 12:00:00", None),  # off the grid, past its last step, no date
    ("1969-12-30 00:00:00.5", "1970-01-02 00:00:00.25"), ("2000-01-01",), (None,), ()])
def test_grid_dates_are_those_of_the_grid(spark, texts):
    p = stamps(spark, *texts)
    expected = sorted(r[0] for r in clean.regularise(p, "1d", per_feature=False).select("Date").distinct().collect())
    assert sorted(r[0] for r in clean.grid_dates(p, "1d").collect()) == expected


def test_last_points_by_given_dates(spark):
    p = clean.regularise(panel(spark, {("s1", "f"): [1.0] * 400, ("s2", "f"): [None] * 400}), "1d", per_feature=False)
    by_panel, by_dates = masks.last_points(p, "1d"), masks.last_points(p, "1d", dates=clean.grid_dates(p, "1d"))
    assert by_panel.count() == by_dates.count() == 730
    assert by_panel.exceptAll(by_dates).count() == 0


def test_masked_mae_with_repeated_and_absent_keys(spark):
    p = panel(spark, {("s1", "f"): [1.0, 2.0, None, 4.0], ("s2", "f"): [5.0, 6.0, 7.0, None], (None, "f"): [9.0, 9.0, 9.0, 9.0]})
    m = p.withColumn("method", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn(
        "Value", F.when(F.col("method") == "a", F.col("Value") + 3).otherwise(F.lit(None)))
    m = m.unionByName(m.where("method = 'a' AND Station = 's1'").withColumn("Value", F.lit(0.0)))
    mask = masks.indicating_mask(p.withColumn("Value", F.when(F.dayofmonth("Date") % 2 == 1, F.col("Value"))), p)
    cells = {(r[0], r[1]): r[2] for r in p.where("Station IS NOT NULL").select("Date", "Station", "Value").collect()}
    hidden = {(r["Date"], r["Station"]) for r in mask.where("indicating").collect()}
    errors = {"a": [], "b": []}
    for r in m.where("Station IS NOT NULL").collect():
        if (r["Date"], r["Station"]) in hidden:
            errors[r["method"]].append(abs((r["Value"] or 0.0) - (cells[r["Date"], r["Station"]] or 0.0)))
    got = {r["method"]: r["masked_mae"] for r in masks.masked_mae(m, p, mask, keys=["method"]).collect()}
    assert got == pytest.approx({k: sum(v) / len(v) for k, v in errors.items()})


def test_masked_cells_meet_the_truth_before_the_fills(spark):
    p = panel(spark, {("s1", "f"): [1.0, None, 3.0], ("s2", "f"): [4.0, 5.0, 6.0]})
    m = fill.run_methods(p, ["mean"], value="Value")
    mask = masks.indicating_mask(p.withColumn("Value", F.lit(None).cast("double")), p)
    lines = masks.masked_mae(m, p, mask, keys=["method"])._jdf.queryExecution().optimizedPlan().toString().split("\n")
    fills, joins = next(i for i, x in enumerate(lines) if "Generate explode" in x or "mean AS method" in x), [i for i, x in enumerate(lines) if "Join Inner" in x]
    # The first join in the plan has the fills on its left; no other join lies between.
    assert joins[0] < fills and not any(joins[0] < i < fills for i in joins[1:])
