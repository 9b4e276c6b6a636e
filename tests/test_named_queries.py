"""Named queries against their SQL. CHECK_ALL=1 runs every query, otherwise a few from each group."""

import os

import pytest

import __spark_entry__ as entry_points  # conftest puts the root on the path
from compare import check, duck

SF = "/root/testdata/sf0.001"
FEW = ["units_fixed", "regular_hours", "resampled_weeks", "wide_by_station", "scaled_gaps", "transferred_pattern", "filled_linear",
       "filled_knn", "gap_report", "windows_padded", "share_masked_per_series", "structural_similarity", "method_ranking",
       "faulty_table_validated", "imputed_round_trip"]


def test_every_check_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry_points.queries()) if os.environ.get("CHECK_ALL") else FEW)
def test_query(spark, name):
    sql = entry_points.oracle_sql().get(name)
    *_, diff = check(spark, duck(SF), name, entry_points.queries()[name], sql, SF)
    assert diff is None, diff


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
