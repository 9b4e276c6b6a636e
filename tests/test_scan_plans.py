"""How often cells are moved and read, and that the results stay right with absent keys."""

import os

import pytest

import __spark_entry__ as entry_points  # conftest puts the root on the path
from helpers import START, panel, values
from panelfill.operators import pattern, scan, windows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def two_series(spark):
    return panel(spark, {("s1", "f"): [1, None, 3, None, 5], (None, "f"): [7, None, 9, None, 11]})


def test_neighbours_join_in_the_partitions_of_the_windows(spark, shuffled_joins):
    found = scan.observed_neighbours(two_series(spark), span_days=2)
    # Twice the cells, once the edges by series and once by series and chunk.
    assert plan(found).count("Exchange hashpartitioning") == 4
    assert values(found, "_prev") == {("s1", "f"): [1, 1, 3, 3, 5], (None, "f"): [None] * 5}
    assert values(found, "_pos") == {("s1", "f"): [1, 2, 3, 4, 5], (None, "f"): [1, 2, 3, 4, 5]}


def test_row_numbers_join_in_the_partitions_of_the_windows(spark, shuffled_joins):
    placed = scan.date_ordinal(two_series(spark), scan.SERIES, total="_total", span_days=2)
    assert plan(placed).count("Exchange hashpartitioning") == 4
    assert placed.columns == ["Date", "Station", "Feature", "Value", "_pos", "_total"]
    assert values(placed, "_pos") == {("s1", "f"): [1, 2, 3, 4, 5], (None, "f"): [1, 2, 3, 4, 5]}
    assert {r["_total"] for r in placed.collect()} == {5}


def test_padding_reads_the_cells_once(spark):
    padded = windows.windowed(two_series(spark), n_steps=4, tail="pad")
    assert "Union" not in plan(padded)
    assert padded.columns == ["Date", "Station", "Feature", "Value", "window_id", "step", "is_pad"]
    rows = sorted((r["Station"] or "", r["window_id"], r["step"], r["Date"] is None, r["Value"], r["is_pad"]) for r in padded.where("window_id = 1").collect())
    assert [r[:4] + r[5:] for r in rows] == [(s, 1, k, k > 0, k > 0) for s in ("", "s1") for k in range(4)]
    assert [r[4] for r in rows] == [11, None, None, None, 5, None, None, None]
    assert padded.count() == 16


def test_rates_of_stations_that_lack_nothing_are_not_asked_for(spark):
    p = panel(spark, {("s1", "f"): [1, None], ("s1", "g"): [None, 2], ("s2", "f"): [None, 3], ("s3", "g"): [None, None]})
    whole = pattern.complete_pattern(pattern.missing_mask(p))
    assert "LeftSemi" in plan(whole)
    guessed = {(r["Station"], r["Feature"], (r["Date"] - START).days): r["missing"] for r in whole.collect()}
    # s2 has no g: the feature lacks in all and half of its stations, the station lacks, then not.
    assert len(guessed) == 12
    assert (guessed["s2", "g", 0], guessed["s2", "g", 1]) == (True, False)
    assert (guessed["s3", "f", 0], guessed["s3", "f", 1]) == (True, True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_alignment_reads_written_fills(spark):
    assert "Window" not in plan(entry_points.queries()["aligned_to_truth"](spark, SF))
