import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import panelfill
from helpers import (START, dtw_reference, knn_reference, matrix_of, matrix_panel, panel, random_matrix, ridge_reference,
                     ssim_reference, values)
from panelfill.functions.keys import CELL, SERIES
from panelfill.operators import boosted, centroid, chained, clean, fill, gaps, masks, neighbours, pattern, quality, rank, reshape, scale, score, similarity, windows
from panelfill.sources import panel_io

N = None


def test_linear_by_position_with_flat_ends(spark):
    p = panel(spark, {("a", "f"): [N, 1, N, N, 4, N], ("b", "f"): [N] * 6})
    assert values(gaps.interpolate_both(p))[("a", "f")] == [1, 1, 2, 3, 4, 4]
    assert values(gaps.interpolate_both(p))[("b", "f")] == [N] * 6
    assert values(gaps.interpolate_interior(p))[("a", "f")] == [N, 1, 2, 3, 4, N]


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_fills_do_not_depend_on_the_chunks(spark, span):
    rng = np.random.default_rng(5)
    vs = [N if rng.random() < 0.7 else round(float(rng.normal()), 3) for _ in range(60)]
    p = panel(spark, {("a", "f"): vs})
    x = np.array([np.nan if v is N else v for v in vs])
    seen = np.flatnonzero(~np.isnan(x))
    want = np.interp(np.arange(60), seen, x[seen])
    assert np.allclose(values(gaps.interpolate_both(p, span_days=span))[("a", "f")], want)
    last, back = [], [v for v in vs if v is not N][0]
    for v in vs:
        back = back if v is N else v
        last.append(back)
    assert values(gaps.ffill_bfill(p, span_days=span))[("a", "f")] == last
    blocks = sorted(r["block_size"] for r in gaps.gap_blocks(p, span).collect())
    assert blocks == sorted(int(d) - 1 for d in np.diff(seen) if d > 1)


def test_grid_drops_off_grid_rows_and_refuses_repeats(spark):
    rows = [(START, "a", "f", 1.0), (START + dt.timedelta(minutes=30), "a", "f", 9.0), (START + dt.timedelta(hours=2), "a", "f", 3.0)]
    schema = "Date timestamp_ntz, Station string, Feature string, Value double"
    assert values(clean.regularise(spark.createDataFrame(rows, schema))) == {("a", "f"): [1, N, 3]}
    with pytest.raises(Exception, match="repeated time stamp"):
        clean.regularise(spark.createDataFrame(rows + rows[:1], schema)).collect()


def test_grid_steps_are_written_after_the_last_shuffle(spark):
    """Only readings are shuffled; a gap longer than a block, a late start and a null station come out whole."""
    steps = clean.GRID_STEPS_PER_ROW * 2 + 5
    ends = [START - dt.timedelta(hours=7), START + dt.timedelta(hours=steps)]
    rows = [(ends[0], "a", "f", 1.0), (ends[1], "a", "f", 2.0), (START, "b", "f", 3.0), (START, None, "f", 4.0),
            (START + dt.timedelta(microseconds=1), "b", "f", 9.0), (None, "b", "f", 9.0)]
    p = spark.createDataFrame(rows, "Date timestamp_ntz, Station string, Feature string, Value double")
    grid = clean.regularise(p)
    above = grid._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert "Generate explode(sequence(" in above
    got = grid.groupBy("Station").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("Date").alias("dates"), F.min("Date").alias("lo"), F.max("Date").alias("hi"),
        F.collect_list(F.struct("Date", "Value")).alias("all")).collect()
    assert {r["Station"]: (r["n"], r["dates"], r["lo"], r["hi"]) for r in got} == {s: (steps + 8, steps + 8, *ends) for s in ("a", "b", None)}
    seen = {r["Station"]: [(c["Date"], c["Value"]) for c in r["all"] if c["Value"] is not None] for r in got}
    assert {s: sorted(v) for s, v in seen.items()} == {"a": [(ends[0], 1.0), (ends[1], 2.0)], "b": [(START, 3.0)], None: [(START, 4.0)]}


def test_offsets_become_utc(spark):
    df = spark.createDataFrame([("2020-01-02T00:00:00+02:00",), ("2020-01-02 00:00:00",), ("junk",)], "Date string")
    got = [r["Date"] for r in clean.to_naive_utc(df).collect()]
    assert got == [dt.datetime(2020, 1, 1, 22), dt.datetime(2020, 1, 2), None]


def test_wide_names_are_parsed(spark):
    names = ["5904_WIEN-HOHE WARTE:Wind_speed", '{"5925","Air_temperature"}', "plain"]
    got = reshape.parse_series_name(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()
    assert [(r["Station"], r["Feature"]) for r in got] == [
        ("5904_WIEN-HOHE WARTE", "Wind_speed"), ("5925", "Air_temperature"), ("wide", "plain")]


def test_pattern_of_an_absent_sensor_rounds_half_to_even(spark):
    org = panel(spark, {("a", "f"): [N, 1], ("a", "g"): [N, 1], ("b", "f"): [1, 1]})
    got = {(r["Station"], r["Feature"], r["Date"].day): r["missing"] for r in pattern.complete_pattern(pattern.missing_mask(org)).collect()}
    # feature g: all missing on day 1, station b: nothing missing -> mean 0.5 -> 0
    assert got[("b", "g", 1)] is False and got[("b", "g", 2)] is False


def test_transfer_gives_ref_the_gaps_of_org(spark):
    org = panel(spark, {("x", "f"): [1, N, N, 4], ("y", "f"): [N, 2, 3, 4]})
    ref = panel(spark, {("a", "f"): [10, N, 30, 40], ("b", "f"): [1, 2, 3, 4]})
    mask, out = pattern.transfer_pattern(org, ref)
    assert values(out)[("a", "f")] == [10, 20, 30, 40]
    assert values(out, "Value_missing") == {("a", "f"): [10, N, N, 40], ("b", "f"): [N, 2, 3, 4]}


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_knn_equals_brute_force(spark, weights):
    x = np.round(random_matrix(90, 5, 0.35, 1), 1)
    x[7] = np.nan
    got = matrix_of(neighbours.impute_knn(matrix_panel(spark, x), "Value", k=4, weights=weights, tile_rows=20))
    assert np.allclose(got, knn_reference(x, 4, weights))


def test_knn_ships_only_tiles_that_may_hold_a_nearer_donor(spark, monkeypatch):
    """A slow wave: dates far apart in level cannot be neighbours. Same donors as brute force, fewer pairs of tiles."""
    rng = np.random.default_rng(4)
    x = np.linspace(0, 30, 300)[:, None] + rng.normal(size=(300, 4)) * 0.3
    x[rng.random(x.shape) < 0.1] = np.nan
    shipped = []
    search = neighbours._searched
    monkeypatch.setattr(neighbours, "_searched", lambda a, b, pairs, k: shipped.append(pairs.count()) or search(a, b, pairs, k))
    got = matrix_of(neighbours.impute_knn(matrix_panel(spark, x), "Value", k=3, tile_rows=20))
    assert np.allclose(got, knn_reference(x, 3, "uniform"))
    assert shipped[0] == 15 and sum(shipped) < 0.4 * 15 * 15


def test_knn_rank_handles_ties():
    d = np.array([[1.0, 0.0, 1.0, 1.0], [2.0, 2.0, 2.0, 1.0]])
    assert neighbours.nearest_columns(d, 2).tolist() == [[1, 0], [3, 0]]


@pytest.mark.parametrize("rows, cols, budget, block_cells, open_steps", [
    (80, 4, 1 << 21, 1 << 17, 1024),  # a round in one stage
    (80, 4, 60, 50, 2),               # a regression or two a stage, many blocks, blocks written out again
    (300, 3, 40, 90, 1024),           # rows folded into triangular factors
    (12, 18, 1 << 21, 1 << 17, 1024)])  # fewer rows than series
def test_chained_rounds_equal_plain_regressions(spark, monkeypatch, rows, cols, budget, block_cells, open_steps):
    monkeypatch.setattr(chained, "OPEN_STEPS", open_steps)
    x = random_matrix(rows, cols, 0.2, 2)
    got = matrix_of(chained.impute_chained(matrix_panel(spark, x), "Value", max_iter=3, budget=budget, block_cells=block_cells))
    assert np.allclose(got, ridge_reference(x, 3), atol=1e-6)


def test_chained_rounds_end_early_and_keep_what_no_series_tells(spark):
    x = random_matrix(60, 4, 0.2, 2)
    want = ridge_reference(x, 10)
    assert np.allclose(matrix_of(chained.impute_chained(matrix_panel(spark, x), "Value")), want, atol=1e-6)
    empty = np.concatenate([x, np.full((60, 1), np.nan)], axis=1)
    got = matrix_of(chained.impute_chained(matrix_panel(spark, empty), "Value"))
    assert np.allclose(got[:, :4], want, atol=1e-6) and np.isnan(got[:, 4]).all()
    alone = panel(spark, {("a", "f"): [1, None, 3], ("b", "g"): [None, None, None]})
    assert values(chained.impute_chained(alone, "Value")) == {("a", "f"): [1, 2, 3], ("b", "g"): [None, None, None]}
    assert chained.impute_chained(alone.limit(0), "Value").count() == 0


def centroid_reference(x: np.ndarray, rank: int, tol: float) -> np.ndarray:
    """On whole matrices: every centroid by turning one sign at a time, taken out of the rows themselves."""
    gaps, cols = np.isnan(x), np.arange(len(x))
    mean, spread = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    cur = np.array([np.interp(cols, cols[~np.isnan(c)], c[~np.isnan(c)]) for c in x.T]).T
    cur = (cur - mean) / spread
    while True:
        left, fresh = cur.copy(), np.zeros_like(cur)
        for _ in range(rank):
            z = np.ones(x.shape[1])
            while True:
                turned = [((left @ np.where(np.arange(len(z)) == i, -z, z)) ** 2).sum() for i in range(len(z))]
                if max(turned) <= ((left @ z) ** 2).sum() * (1 + 1e-9):
                    break
                z[int(np.argmax(turned))] *= -1
            c = left @ z
            c /= np.sqrt(c @ c)
            share = np.outer(c, left.T @ c)
            fresh, left = fresh + share, left - share
        moved = np.sqrt(((fresh - cur)[gaps] ** 2).mean())
        cur[gaps] = fresh[gaps]
        if moved < tol:
            return np.where(gaps, cur * spread + mean, x)


@pytest.mark.parametrize("block_cells", [1 << 17, 60])
def test_centroid_completion_equals_whole_matrices(spark, block_cells):
    x = random_matrix(60, 6, 0.15, 9)
    got = matrix_of(centroid.impute_centroid(matrix_panel(spark, x), "Value", rank=2, tol=1e-2, block_cells=block_cells))
    assert np.allclose(got, centroid_reference(x, 2, 1e-2), atol=1e-6)


def test_boosted_cells_go_without_the_list_of_names(spark, monkeypatch):
    plans = {}
    kept = boosted.stored
    monkeypatch.setattr(boosted, "stored", lambda df, name: plans.setdefault(name, df) and kept(df, name))
    x = random_matrix(30, 3, 0.2, 5)
    columns = boosted.Boosted(matrix_panel(spark, x), "Value", "Feature").columns.first()["columns"]
    assert [(c["Station"], c["Feature"], c["wanted"]) for c in columns] == [(f"s{j:02d}", "f", True) for j in range(3)]
    lines = plans["boosted-columns"]._jdf.queryExecution().executedPlan().toString().splitlines()
    per_cell = [line for line in lines if "percentile_approx" in line or "posexplode(c#" in line]
    assert per_cell and not any("names" in line for line in per_cell)


def test_centroids_of_wide_parts_need_no_gram_matrix(monkeypatch):
    """A task with fewer rows than series sends its rows; centroids on rows equal those on their Gram matrix."""
    x = np.random.default_rng(3).normal(size=(20, 60))
    block = pa.RecordBatch.from_pylist([{
        "part": "p", "columns": [{"mean": 0.0, "spread": 1.0}] * 60, "cells": [{"x": list(v), "s": list(v)} for v in x], "rounds": None}])
    sent = next(centroid._send([block]))
    assert sent.column("gram")[0].as_py() is None and len(sent.column("rows")[0].as_py()) == 8 * x.size
    monkeypatch.setattr(centroid, "GRAM_CELLS", 0)
    found = centroid._found([], x, 3)
    assert np.allclose(found, centroid.centroids(x.T @ x, 3), atol=1e-9) and found.shape == (3, 2, 60)


def test_centroid_completion_of_nothing(spark):
    p = panel(spark, {("a", "f"): [1, None, 3], ("b", "f"): [None, None, None], ("c", "f"): [2, 2, None]})
    assert values(centroid.impute_centroid(p, "Value"))[("b", "f")] == [None, None, None]
    assert centroid.impute_centroid(p.limit(0), "Value").count() == 0


def test_best_split_equals_brute_force():
    rng = np.random.default_rng(8)
    for penalty in (0.0, 1.0, 5.0):
        bins, g = rng.integers(0, boosted.BINS + 1, size=(60, 3)), rng.normal(size=60)
        sums = np.zeros((2, 1, 3, boosted.BINS + 1))
        for row, grad in zip(bins, g):
            for j, b in enumerate(row):
                sums[:, 0, j, b] += grad, 1
        best = (0, None)
        for j in range(3):
            for cut in range(boosted.BINS):
                for null_left in (False, True):
                    left = np.where(bins[:, j] == boosted.BINS, null_left, bins[:, j] <= cut)
                    if left.any() and not left.all():
                        part = lambda m: g[m].sum() ** 2 / (m.sum() + penalty)
                        best = max(best, (part(left) + part(~left) - part(np.ones(60, bool)), (left.tobytes(), -g[left].sum() / (left.sum() + penalty))))
        node, j, cut, null_left, weight, _ = boosted.best_splits(sums, penalty)[0]
        left = np.where(bins[:, int(j)] == boosted.BINS, null_left > 0, bins[:, int(j)] <= cut)
        assert left.tobytes() == best[1][0] and np.isclose(weight, best[1][1])


def boosted_reference(x: np.ndarray, rounds: int, depth: int, rate: float, penalty: float) -> np.ndarray:
    """Trees grown one by one on exhaustive splits between bins, nulls either way."""
    out = x.copy()
    shares = np.arange(1, boosted.BINS) / boosted.BINS
    cuts = [np.unique(np.sort(c[~np.isnan(c)])[np.maximum(np.ceil(shares * (~np.isnan(c)).sum()).astype(int) - 1, 0)]) for c in x.T]
    bins = np.array([np.where(np.isnan(c), -1, np.searchsorted(u, c, "left")) for c, u in zip(x.T, cuts)]).T

    def grow(rows, fit, grad, level, j):
        w = -grad[fit].sum() / (fit.sum() + penalty)
        best = (1e-12, None)
        if level < depth:
            for f in (f for f in range(x.shape[1]) if f != j):
                for null_left in (False, True):
                    for cut in range(boosted.BINS):
                        left = np.where(bins[:, f] < 0, null_left, bins[:, f] <= cut)
                        a, b = fit & left, fit & ~left
                        if a.any() and b.any():
                            score = lambda m: grad[m].sum() ** 2 / (m.sum() + penalty)
                            gain = score(a) + score(b) - score(fit)
                            if gain > best[0] + 1e-9:
                                best = (gain, left)
        if best[1] is None:
            return np.where(rows, w, 0.0)
        return grow(rows & best[1], fit & best[1], grad, level + 1, j) + grow(rows & ~best[1], fit & ~best[1], grad, level + 1, j)

    every = np.ones(len(x), bool)
    for j in range(x.shape[1]):
        known = ~np.isnan(x[:, j])
        fit = np.full(len(x), x[known, j].mean())
        for _ in range(rounds):
            fit = fit + rate * grow(every, known, np.where(known, fit - np.where(known, x[:, j], 0), 0.0), 0, j)
        out[~known, j] = fit[~known]
    return out


@pytest.mark.parametrize("block_cells", [1 << 17, 60])
def test_boosted_trees_equal_trees_grown_one_by_one(spark, monkeypatch, block_cells):
    monkeypatch.setattr(boosted.Boosted.__init__, "__defaults__", (None, None, block_cells))
    x = random_matrix(70, 4, 0.25, 5)
    got = matrix_of(boosted.impute_gbt(matrix_panel(spark, x), "Value", max_iter=3, max_depth=2, step_size=0.3, reg_lambda=0.5))
    assert np.allclose(got, boosted_reference(x, 3, 2, 0.3, 0.5), atol=1e-6)


def test_boosted_trees_learn_and_tune(spark):
    p = matrix_panel(spark, random_matrix(120, 5, 0.2, 6))
    losses = [r.mse for r in boosted.training_losses(p, "Value", max_iter=4).orderBy("round").collect()]
    assert len(losses) == 5 and all(b < a for a, b in zip(losses, losses[1:]))
    tuned = boosted.tune_gbt(p, "Value", grid={"maxDepth": [1, 3], "maxIter": [2, 4]}).collect()
    by = {(r.maxDepth, r.maxIter): r for r in tuned}
    assert len(by) == 4 and by[3, 4].train_rmse < by[1, 2].train_rmse and all(r.held_out_rmse > 0 for r in tuned)
    one = boosted.impute_gbt(p, "Value", max_iter=2, subsample=0.7, colsample=0.5)
    assert one.where("Value IS NULL").count() == 0 and one.subtract(boosted.impute_gbt(p, "Value", max_iter=2, subsample=0.7, colsample=0.5)).count() == 0


def test_warping_distance_over_many_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=70).cumsum(), rng.normal(size=70).cumsum()
    rows = [("m", START + dt.timedelta(days=i), "s", "f", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    cells = spark.createDataFrame(rows, "method string, Date timestamp_ntz, Station string, Feature string, truth double, fill double")
    want = dtw_reference(x, y, 5)
    assert similarity.banded_distance(x, y, 5) == pytest.approx(want)
    monkeypatch.setattr(similarity, "STEPS_PER_CHUNK", 16)
    monkeypatch.setattr(similarity, "CHUNKS_PER_FOLD", 2)
    assert similarity.dtw(cells, 5).first()["dtw_distance"] == pytest.approx(want)


@pytest.mark.parametrize("tile", [1024, 16, 7])
def test_warping_distance_without_a_band(spark, tile):
    rng = np.random.default_rng(5)
    pairs = {s: (rng.normal(size=n).cumsum(), rng.normal(size=n).cumsum()) for s, n in (("a", 50), ("b", 16), ("c", 1), ("d", 33))}
    rows = [("m", START + dt.timedelta(days=i), s, "f", float(u), float(v)) for s, (x, y) in pairs.items() for i, (u, v) in enumerate(zip(x, y))]
    cells = spark.createDataFrame(rows, "method string, Date timestamp_ntz, Station string, Feature string, truth double, fill double")
    got = {r.Station: r.dtw_distance for r in similarity.dtw_unbanded(cells, tile=tile).collect()}
    assert got.keys() == pairs.keys()
    assert all(np.isclose(got[s], dtw_reference(x, y, len(x))) for s, (x, y) in pairs.items())


def test_similarity_over_many_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 12))
    y = x + 0.3 * rng.normal(size=x.shape)
    m = matrix_panel(spark, y).withColumn("method", F.lit("m"))
    monkeypatch.setattr(similarity, "TILE", 10)
    got = similarity.ssim(matrix_panel(spark, x), m).first()["SSIM"]
    assert got == pytest.approx(ssim_reference(x, y))


def test_scores_of_the_truth_are_perfect(spark):
    x = random_matrix(120, 8, 0.0, 6)
    p = masks.mask_mcar(matrix_panel(spark, x), 0.3, 1)
    s = score.evaluate(p, fill.run_methods(p, with_truth=True))
    rows = {(r["imputation_method"], r["station"]): r for r in s.collect()}
    best = rows[("original", "s00")]
    assert best["RMSE"] == 0 and best["R2"] == 1 and best["dtw_distance"] == 0 and best["SSIM"] == pytest.approx(1)
    assert rows[("mean", "s00")]["RMSE"] > 0 and rows[("mean", "s00")]["n_total_values"] == 120
    ranked = [r["imputation_method"] for r in rank.rank_methods(s).collect()]
    assert sorted(ranked) == ["ffill", "interpolation", "mean"]  # the truth takes no rank


def test_observed_cells_never_change(spark):
    x = random_matrix(60, 4, 0.0, 7)
    p = masks.mask_mcar(matrix_panel(spark, x), 0.3, 2)
    for name in ("mean", "ffill", "interpolation", "knn", "iterative", "low_rank"):
        q = panelfill.run_methods(p, [name]).join(p.select(*CELL, "Value_missing"), CELL)
        assert q.where("Value_missing IS NOT NULL AND Value <> Value_missing").count() == 0, name
        assert q.where("Value IS NULL").count() == 0, name


def test_scaling_back_is_the_identity(spark):
    p = panel(spark, {("a", "f"): [1, 2, N, 4], ("b", "f"): [5, 5, 5, 5]})
    scaler = scale.fit_scaler(p)
    q = scale.unscale(scale.scale(p, scaler, "Value"), scaler)
    assert values(q) == {("a", "f"): [1, 2, N, 4], ("b", "f"): [5, 5, 5, 5]}


def test_average_rank_of_ties_and_nulls(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None)], "m string, v double")
    assert {r["m"]: r["v_rank"] for r in rank.average_rank(s, "v").collect()} == {"a": 1, "b": 2.5, "c": 2.5, "d": None}


def test_windows_pad_and_split(spark):
    p = panel(spark, {("a", "f"): list(range(25))})
    assert windows.windowed(p, 10).count() == 20
    padded = windows.windowed(p, 10, "pad")
    assert padded.count() == 30 and windows.drop_padding(padded).count() == 25


def test_quality_findings_and_gate(spark):
    df = spark.createDataFrame([(1.0, N, "7"), (float("inf"), N, "8")], "a double, b double, c string")
    found = {(r["check"], r["column"], r["level"]) for r in quality.validate(df, "t").collect()}
    assert {("row_count", N, "error"), ("empty_column", "b", "error"), ("infinite_values", "a", "error"),
            ("numeric_text", "c", "warning")} <= found
    names = quality.schema_findings(["x", "x", "Unnamed: 0", " "], 4, quality.DEFAULTS)
    assert {("duplicate_column", "error"), ("column_name", "warning")} <= {(c, level) for c, _, level, *_ in names}
    assert quality.gate(quality.validate(df, "t")) is False
    with pytest.raises(quality.InvalidInput):
        quality.gate(quality.validate(df, "t"), stage="fill")


def test_folder_checks(spark, tmp_path):
    (tmp_path / "f.csv").write_text("time,a,a\n2020-01-01,1,2\n")
    levels = {(r["check"], r["level"]) for r in panel_io.validate_folder(spark, str(tmp_path)).collect()}
    assert ("duplicate_column", "error") in levels
    missing = panel_io.validate_folder(spark, str(tmp_path / "none")).collect()
    assert [(r["check"], r["level"]) for r in missing] == [("folder", "error")]


def test_folder_checks_equal_those_of_each_file(spark, tmp_path):
    rows = [f"2020-01-{1 + i % 28:02d},{i % 7},{i / 3},{'' if i % 9 else i},x{i}" for i in range(300)]
    (tmp_path / "a.csv").write_text("timestamp,small,third,rare,name\n" + "\n".join(rows + ["2020-02-01,900,,,"]) + "\n")
    (tmp_path / "b.csv").write_text('key,"with, comma",,text\n1,"1,5",7,3\n2,"say ""x""",Inf,4\n2,,8,5\n\n')
    (tmp_path / "c.csv").write_text("stamp time,v\nsoon,1\n2020-01-01,\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "mixed.csv").write_text("k,v\n" + "".join(f"{i},{i}\n" for i in range(20)) + "21,oops\n")
    found = panel_io.validate_folder(spark, str(tmp_path)).collect()
    got = {f: set() for f in "abc"}
    for r in found:
        name = r["dataset"].rsplit("/", 1)[-1]
        if name[0] in got and r["check"] != "file_size_mb":
            got[name[0]].add((r["check"], r["column"], r["level"], r["observed"], r["threshold"]))
    for f in got:
        df = spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(str(tmp_path / f"{f}.csv"))
        df = df.toDF(*["Unnamed: 2" if c.startswith("_c") else c for c in df.columns])
        df = df.withColumn(df.columns[0], df[df.columns[0]].cast("string"))
        want = {(r["check"], r["column"], r["level"], r["observed"], r["threshold"]) for r in quality.validate(df, f, df.columns[0]).collect()}
        assert got[f] == want, f
    others = {(r["dataset"].rsplit("/", 1)[-1], r["check"], r["level"], r["observed"]) for r in found}
    assert ("empty.csv", "read", "error", None) in others and ("mixed.csv", "unparsed_cells", "warning", 1.0) in others
    assert sum(r["check"] == "read" for r in found) == 1


def test_feature_files(spark, tmp_path):
    (tmp_path / "Air_temperature.csv").write_text("t,5904_W HOHE,12\n2020-01-01 00:00:00+00:00,1.5,\n2020-01-01 01:00:00+00:00,,2\n")
    got = values(panel_io.read_feature_csvs(spark, str(tmp_path)))
    assert got == {("5904_W", "Air_temperature"): [1.5, N], ("12", "Air_temperature"): [N, 2.0]}
    (tmp_path / "x.csv").write_text("t,a b,a c\n2020-01-01,1,2\n")
    with pytest.raises(ValueError, match="collide"):
        panel_io.read_feature_csvs(spark, str(tmp_path))


def test_two_writers_at_once_get_two_runs(spark, tmp_path):
    p = masks.mask_mcar(matrix_panel(spark, random_matrix(40, 3, 0.0, 6)), 0.3, 1)
    s = score.evaluate(p, fill.run_methods(p, ["mean"]), with_dtw=False, with_ssim=False).cache()
    path = str(tmp_path / "scores")
    with ThreadPoolExecutor(3) as pool:
        runs = sorted(pool.map(lambda _: panel_io.append_scores(s, path), range(3)))
    assert runs == [1, 2, 3]
    assert {(r["run"], r["n"]) for r in panel_io.read_scores(spark, path).groupBy("run").agg(F.count("*").alias("n")).collect()} == {(r, 3) for r in runs}
    before = sorted(map(str, panel_io.read_scores(spark, path).collect()))
    backups = [panel_io.rewrite_run_metadata(spark, path, resample_freq=f) for f in ("1d", "1w")]
    assert sorted(map(str, panel_io.read_scores(spark, backups[0]).collect())) == before
    assert [r[0] for r in panel_io.read_scores(spark, backups[1]).select("resample_freq").distinct().collect()] == ["1d"]
    assert [tuple(r) for r in panel_io.read_scores(spark, path).select("scaling", "resample", "resample_freq").distinct().collect()] == [(False, True, "1w")]
    assert panel_io.append_scores(s, path) == 4


def test_runs_are_numbered(spark, tmp_path):
    p = masks.mask_mcar(matrix_panel(spark, random_matrix(40, 2, 0.0, 8)), 0.3, 1)
    s = score.evaluate(p, fill.run_methods(p), with_dtw=False, with_ssim=False)
    path = str(tmp_path / "scores")
    assert [panel_io.append_scores(s, path), panel_io.append_scores(s, path)] == [1, 2]


def test_cells_without_a_key_stay(spark):
    import helpers as h
    rows = [(h.START, "a", "f", 1.0), (h.START + h.dt.timedelta(1), "a", "f", None), (h.START, None, "f", None),
            (h.START, None, "f", 5.0), (None, "a", "f", None), (h.START, "a", None, None)]
    p = spark.createDataFrame(rows, "Date timestamp_ntz, Station string, Feature string, Value_missing double")
    from panelfill.operators import fill
    for method in (fill.impute_mean, fill.impute_ffill, fill.impute_linear, neighbours.impute_knn, chained.impute_chained, centroid.impute_centroid, lambda p: boosted.impute_gbt(p, max_iter=1)):
        out = method(p).collect()
        keyed = [r for r in out if r["Date"] and r["Station"] and r["Feature"]]
        assert len(out) == len(rows) and [r["Value_missing"] for r in keyed] == [1.0, 1.0]
        assert sorted(r["Value_missing"] or 0 for r in out if not (r["Station"] and r["Feature"])) == [0, 0, 5.0]
