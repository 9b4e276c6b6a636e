"""Work that must not land on the driver, in wide shuffles or in one job per step, however a panel grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import matrix_of, matrix_panel, panel, random_matrix, values
from panelfill.operators import boosted, centroid, chained, fill, masks, neighbours, reshape, scan, score
from panelfill.sources.storage import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def all_look_small(spark):
    """Stored panels take few bytes a row, so that millions of rows are below the threshold."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_cells_are_never_gathered_on_the_driver(spark, all_look_small):
    truth = stored(panel(spark, {("s1", "f"): [1, None, 3], (None, "f"): [7, None, 9]}))
    masked = stored(panel(spark, {("s1", "f"): [None, None, 3], (None, "f"): [None, None, 9]}))
    mask = masks.indicating_mask(masked, truth)
    mae = masks.masked_mae(truth.withColumn("Value", truth["Value"] + 2), truth, mask)
    for df in (mask, mae, scan.observed_neighbours(truth), scan.date_ordinal(truth, scan.SERIES)):
        assert "Broadcast" not in plan(df)
    assert values(mask, "indicating") == {("s1", "f"): [True, False, False]}
    assert [r["masked_mae"] for r in mae.collect()] == [2.0]


def test_rows_of_a_part_are_never_gathered(spark, all_look_small):
    p = reshape.with_partition(stored(panel(spark, {("s1", "f"): [1, None, 3], ("s2", "f"): [4, 5, None]})), "Feature")
    rows = neighbours.row_vectors(p, "Value")
    assert "BuildLeft" not in plan(rows)
    assert sorted(r["x"] for r in rows.where("x[0] is not null").collect()) == [[1, 4], [3, None]]


def test_centroids_of_a_whole_part_are_those_of_its_blocks(spark):
    x = random_matrix(30, 8, 0.3, 3)
    x[:, 5] = np.nan
    p = matrix_panel(spark, x).unionByName(panel(spark, {("a", "g"): [1, None, 3, 4], ("b", "g"): [2, 5, None, 7]}))
    by_rounds, whole = (values(centroid.impute_centroid(p, "Value", rank=2, max_iter=4, block_cells=40, whole_cells=n)) for n in (0, 240))
    assert by_rounds.keys() == whole.keys()
    for k, vs in whole.items():
        assert np.allclose(np.array(vs, float), np.array(by_rounds[k], float), equal_nan=True)
    assert whole[("s05", "f")] == [None] * 30


@pytest.mark.parametrize("subsample, colsample", [(1.0, 1.0), (0.7, 0.5)])
def test_trees_of_a_whole_part_are_those_grown_by_level(spark, monkeypatch, subsample, colsample):
    x = random_matrix(40, 7, 0.4, 5)
    x[:, 6] = np.nan
    p = matrix_panel(spark, x).unionByName(panel(spark, {("a", "g"): [1, None, 3, 4], ("b", "g"): [2, 5, None, 7]}))
    held = F.pmod(F.xxhash64("Date"), F.lit(5)) == 0
    how, trees, fills = (3, 3, 0.3, 0.5, subsample, colsample, 42), [], []
    for n in (0, 1 << 20):
        monkeypatch.setitem(boosted.Boosted.__init__.__kwdefaults__, "whole_cells", n)
        monkeypatch.setattr(boosted, "LANE_CELLS", 500)
        grown = boosted.Boosted(p, "Value", "Feature", None, held).grown(*how)
        trees.append({(r["part"], r["target"], r["round"], r["level"]): r for r in grown.collect()})
        fills.append(matrix_of(boosted.impute_gbt(p.where("Feature = 'f'"), "Value", "Feature", *how[:4], subsample, colsample)))
    assert trees[0].keys() == trees[1].keys()
    for k, a in trees[0].items():
        b = trees[1][k]
        assert np.allclose(np.frombuffer(a["splits"]), np.frombuffer(b["splits"])) and (a["n"], a["n_held"]) == (b["n"], b["n_held"])
        assert np.allclose((a["loss"], a["held_loss"]), (b["loss"], b["held_loss"]))
    assert np.allclose(*fills, equal_nan=True) and np.isnan(fills[1][:, 6]).all()


@pytest.mark.parametrize("penalty", [None, 1.0])
def test_parts_with_few_dates_are_chained_in_one_task(spark, penalty):
    x = random_matrix(12, 15, 0.3, 7)
    x[:, 4] = np.nan
    p = matrix_panel(spark, x).unionByName(panel(spark, {("a", "g"): [1, None, 3, 4], ("b", "g"): [2, 5, None, 7]}))
    how = {"value": "Value", "max_iter": 3, "penalty": penalty, "block_cells": 60}
    staged, folded, whole = (values(chained.impute_chained(p, **how, **size)) for size in (
        {"whole_cells": 0}, {"whole_cells": 0, "budget": 1 << 10}, {"whole_cells": 180}))
    for k, vs in whole.items():
        assert np.allclose(np.array(vs, float), np.array(staged[k], float), equal_nan=True)
    assert whole.keys() == staged.keys() == folded.keys() and whole[("s04", "f")] == [None] * 12


def test_only_fills_of_hidden_cells_go_to_the_scores(spark):
    p = panel(spark, {("s1", "f"): [1, 2, 3, None], ("s2", "f"): [5, 6, None, 8], (None, "f"): [7, 8, 9, 9]})
    p = masks.mask_mcar(p, 0.5, 3)
    marked = fill.run_methods(p, ["mean", "knn"], with_truth=True, mark_hidden=True)
    plain = marked.drop("hidden")
    key = lambda r: (r["method"], r["Date"], r["Station"], r["Feature"], r["truth"], r["fill"])
    moved, all_moved = score.score_cells(p, marked), score.score_cells(p, plain)
    assert sorted(map(key, moved.collect())) == sorted(map(key, all_moved.collect())) and moved.count() > 0
    assert {r["method"] for r in marked.where("hidden").select("method").distinct().collect()} == {"mean", "knn", "original", "mask"}
    assert marked.where("hidden").count() == 4 * p.where("missing").count() < marked.count()
    # A mask of its own decides alone.
    other = p.select("Date", "Station", "Feature", (~F.col("missing")).alias("missing"))
    assert sorted(map(key, score.score_cells(p, marked, other).collect())) == sorted(map(key, score.score_cells(p, plain, other).collect()))
