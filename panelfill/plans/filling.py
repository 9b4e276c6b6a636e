"""Queries: every imputer over masked panels."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

import panelfill
from panelfill.functions.keys import CELL, SERIES
from panelfill.operators import boosted, centroid, chained, fill, learned, neighbours, rank, scan
from panelfill.plans import testbed as tb
from panelfill.plans.catalog import query, r, rounded
from panelfill.sources.storage import scratch_path, stored

VM = r("Value_missing")


def _filled(expr: str) -> str:
    return f"SELECT Date, Station, Feature, round(Value, 6) + 0.0 AS Value, missing, round({expr}, 6) + 0.0 AS Value_missing FROM near"


@query("filled_mean", _filled("coalesce(Value_missing, series_mean)"))
def filled_mean(spark, sf):
    return rounded(fill.impute_mean(tb.prepared(spark, sf)))


@query("filled_forward_backward", _filled("coalesce(Value_missing, prev, nxt)"))
def filled_forward_backward(spark, sf):
    return rounded(fill.impute_ffill(tb.prepared(spark, sf)))


@query("filled_linear", _filled(f"coalesce({tb.blend_sql('Value_missing')}, prev, nxt)"))
def filled_linear(spark, sf):
    return rounded(fill.impute_linear(tb.prepared(spark, sf)))


@query("filled_all_methods", f"SELECT method, Date, Station, Feature, {r('Value')} FROM methods UNION ALL "
       "SELECT 'mask', Date, Station, Feature, missing::INT::DOUBLE FROM prepared")
def filled_all_methods(spark, sf):
    return rounded(fill.run_methods(tb.working_set(spark, sf), with_truth=True))


def _knn_sql(source: str, k: int, weights: str) -> dict[str, str]:
    """Brute force: all pairs of dates of a feature, distance over shared stations, k best donors per gap."""
    mean = {"uniform": "avg(value)",
            "distance": "CASE WHEN min(dist) = 0 THEN avg(value) FILTER (dist = 0) ELSE sum(value / dist) / sum(1 / dist) END"}[weights]
    return {
        "seen": f"SELECT Date, Station, Feature, Value_missing AS v FROM {source} WHERE Value_missing IS NOT NULL",
        "holes": f"SELECT DISTINCT Date, Feature FROM {source} WHERE Value_missing IS NULL",
        "width": f"SELECT Feature, count(DISTINCT Station) AS w FROM {source} GROUP BY Feature",
        "pairs": "SELECT a.Feature, a.Date, b.Date AS donor, sqrt(sum((a.v - b.v) ** 2) * (max(w.w) / count(*))) AS dist FROM seen a "
                 "JOIN holes h ON h.Date = a.Date AND h.Feature = a.Feature JOIN seen b ON b.Feature = a.Feature AND b.Station = a.Station "
                 "JOIN width w ON w.Feature = a.Feature GROUP BY a.Feature, a.Date, b.Date",
        "ranked": f"SELECT g.Date, g.Station, g.Feature, p.dist, s.v AS value, row_number() OVER (PARTITION BY g.Date, g.Station, g.Feature "
                  f"ORDER BY p.dist, p.donor) AS k FROM {source} g JOIN pairs p ON p.Feature = g.Feature AND p.Date = g.Date "
                  "JOIN seen s ON s.Date = p.donor AND s.Station = g.Station AND s.Feature = g.Feature WHERE g.Value_missing IS NULL",
        "guess": f"SELECT Date, Station, Feature, {mean} AS fill FROM ranked WHERE k <= {k} GROUP BY Date, Station, Feature",
        "filled": f"SELECT p.*, coalesce(p.Value_missing, g.fill, avg(p.Value_missing) OVER (PARTITION BY p.Station, p.Feature), 0) AS v FROM {source} p "
                  "LEFT JOIN guess g ON g.Date = p.Date AND g.Station = p.Station AND g.Feature = p.Feature",
    }


_KNN = "SELECT Date, Station, Feature, round(Value, 6) + 0.0 AS Value, missing, round(v, 6) + 0.0 AS Value_missing FROM filled"


@query("filled_knn", _KNN, **_knn_sql("prepared", 10, "uniform"))
def filled_knn(spark, sf):
    return rounded(neighbours.impute_knn(tb.working_set(spark, sf)))


@query("filled_knn_weighted", _KNN, **_knn_sql("group_prepared", 5, "distance"))
def filled_knn_weighted(spark, sf):
    return rounded(neighbours.impute_knn(tb.group_working_set(spark, sf), k=5, weights="distance", tile_rows=100))


@query("nearest_dates", "SELECT Date, Station, Feature, count(*) AS n, round(min(dist), 6) + 0.0 AS nearest, round(max(dist), 6) + 0.0 AS furthest "
       "FROM ranked WHERE k <= 10 GROUP BY Date, Station, Feature", **_knn_sql("group_prepared", 10, "uniform"))
def nearest_dates(spark, sf):
    n = neighbours.nearest(tb.group_working_set(spark, sf), k=10)
    return rounded(n.select(*CELL, F.size("near").cast("bigint").alias("n"), F.col("near")[0]["dist"].alias("nearest"),
                            F.element_at("near", -1)["dist"].alias("furthest")))


def _tune_sql() -> dict[str, str]:
    base = _knn_sql("hidden", 10, "uniform")
    hidden = tb.hidden_sql(
        "(SELECT Date, Station, Feature, Value_missing AS Value, row_number() OVER (PARTITION BY Station, Feature ORDER BY Value_missing IS NULL, "
        "md5(concat_ws('|', '42', Station, Feature, Date::VARCHAR))) AS rk, count(Value_missing) OVER (PARTITION BY Station, Feature) AS n FROM group_prepared "
        "WHERE Date IN (SELECT DISTINCT Date FROM group_prepared))", "rk <= greatest(1, floor(0.1 * n))")
    grid = {"tried": "SELECT n_neighbors, Date, Station, Feature, avg(value) AS uniform, CASE WHEN min(dist) = 0 THEN avg(value) FILTER (dist = 0) "
                     "ELSE sum(value / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) END AS distance FROM ranked JOIN (SELECT unnest([3, 5, 7, 10]) AS n_neighbors) "
                     "ON k <= n_neighbors GROUP BY n_neighbors, Date, Station, Feature",
            "level": "SELECT Station, Feature, coalesce(avg(Value_missing), 0) AS m FROM hidden GROUP BY Station, Feature"}
    return {"hidden": hidden, **base, **grid}


@query("knn_grid", "SELECT n_neighbors::INT AS n_neighbors, weights, round(avg((fill - truth) ** 2), 6) + 0.0 AS mse, count(*) AS n_cells FROM ("
       "SELECT c.n_neighbors, w.weights, h.Value AS truth, coalesce(CASE w.weights WHEN 'uniform' THEN t.uniform ELSE t.distance END, l.m) AS fill "
       "FROM (SELECT * FROM hidden WHERE missing) h CROSS JOIN (SELECT unnest([3, 5, 7, 10]) AS n_neighbors) c CROSS JOIN (SELECT unnest(['uniform', 'distance']) AS weights) w "
       "JOIN level l ON l.Station = h.Station AND l.Feature = h.Feature LEFT JOIN tried t ON t.n_neighbors = c.n_neighbors AND t.Date = h.Date "
       "AND t.Station = h.Station AND t.Feature = h.Feature) GROUP BY n_neighbors, weights", **_tune_sql())
def knn_grid(spark, sf):
    return rounded(neighbours.tune_knn(tb.group_working_set(spark, sf)))



@query("filled_chained")
def filled_chained(spark, sf):
    return rounded(chained.impute_chained(tb.working_set(spark, sf), by="Station"))


@query("filled_chained_by_feature")
def filled_chained_by_feature(spark, sf):
    """As many series a regression as there are stations."""
    return rounded(chained.impute_chained(tb.working_set(spark, sf)))


def _round_sql() -> dict[str, str]:
    """One round over the (up to) three series of a station, fewest gaps first; normal equations of two predictors, penalty 1."""
    def step(k: int) -> str:
        a, b = [i for i in (1, 2, 3) if i != k]
        s = {f"s{x}{y}": f"(count(*) * covar_pop(z{x}, z{y}))" for x, y in ((a, a), (b, b), (a, b), (a, k), (b, k))}
        det = f"(({s[f's{a}{a}']} + 1) * ({s[f's{b}{b}']} + 1) - {s[f's{a}{b}']} ** 2)"
        wa = f"(({s[f's{b}{b}']} + 1) * {s[f's{a}{k}']} - {s[f's{a}{b}']} * {s[f's{b}{k}']}) / {det}"
        wb = f"(({s[f's{a}{a}']} + 1) * {s[f's{b}{k}']} - {s[f's{a}{b}']} * {s[f's{a}{k}']}) / {det}"
        kept = ", ".join(f"z{i}, v{i}" for i in (1, 2, 3) if i != k)
        return (f"SELECT c.Station, Date, {kept}, v{k}, CASE WHEN v{k} IS NULL AND w.Station IS NOT NULL THEN my + wa * (z{a} - ma) + wb * (z{b} - mb) ELSE z{k} END AS z{k} "
                f"FROM chain_{k - 1} c LEFT JOIN (SELECT Station, avg(z{k}) AS my, avg(z{a}) AS ma, avg(z{b}) AS mb, {wa} AS wa, {wb} AS wb "
                f"FROM chain_{k - 1} WHERE v{k} IS NOT NULL GROUP BY Station) w ON w.Station = c.Station")
    series = ("SELECT Station, Feature, avg(Value_missing) AS mean, row_number() OVER (PARTITION BY Station ORDER BY count(*) - count(Value_missing), Feature) AS k "
              "FROM prepared GROUP BY Station, Feature")
    placed = ", ".join(f"max(p.Value_missing - s.mean) FILTER (s.k = {i}) AS v{i}" for i in (1, 2, 3))
    wide = f"SELECT p.Station, p.Date, {placed} FROM prepared p JOIN chain_series s ON s.Station = p.Station AND s.Feature = p.Feature GROUP BY p.Station, p.Date"
    start = "SELECT *, " + ", ".join(f"coalesce(v{i}, 0) AS z{i}" for i in (1, 2, 3)) + " FROM chain_wide"
    return {"chain_series": series, "chain_wide": wide, "chain_0": start, **{f"chain_{k}": step(k) for k in (1, 2, 3)}}


@query("chained_round", "SELECT p.Date, p.Station, p.Feature, round(p.Value, 6) + 0.0 AS Value, missing, "
       "round(coalesce(p.Value_missing, s.mean + CASE s.k WHEN 1 THEN z1 WHEN 2 THEN z2 ELSE z3 END), 6) + 0.0 AS Value_missing FROM prepared p "
       "JOIN chain_series s ON s.Station = p.Station AND s.Feature = p.Feature JOIN chain_3 c ON c.Station = p.Station AND c.Date = p.Date", **_round_sql())
def chained_round(spark, sf):
    """A single round with a fixed penalty has a closed form."""
    return rounded(chained.impute_chained(tb.working_set(spark, sf), by="Station", max_iter=1, penalty=1.0))


@query("filled_boosted_trees")
def filled_boosted_trees(spark, sf):
    return rounded(boosted.impute_gbt(tb.working_set(spark, sf)))


@query("boosted_trees_learn", "SELECT Feature AS part, true AS falls, count(DISTINCT Station) AS n_series FROM prepared GROUP BY Feature")
def boosted_trees_learn(spark, sf):
    """Whether the loss over the known cells of all series falls in every round."""
    p = tb.working_set(spark, sf)
    before = W.partitionBy("part").orderBy("round")
    losses = boosted.training_losses(p, max_iter=5).withColumn("_was", F.lag("mse").over(before))
    fell = losses.groupBy("part").agg(F.every(F.coalesce(F.col("mse") < F.col("_was"), F.lit(True))).alias("falls"))
    return fell.join(p.groupBy(F.col("Feature").alias("part")).agg(F.countDistinct("Station").alias("n_series")), "part")


@query("boosted_trees_grid")
def boosted_trees_grid(spark, sf):
    return rounded(boosted.tune_gbt(tb.working_set(spark, sf), by="Feature"))


@query("filled_low_rank")
def filled_low_rank(spark, sf):
    return rounded(learned.impute_als(tb.working_set(spark, sf), rank=3, max_iter=5))


@query("filled_centroid")
def filled_centroid(spark, sf):
    return rounded(centroid.impute_centroid(tb.working_set(spark, sf)))


TRAINED = ["iterative", "low_rank", "centroid"]


@query("trained_fills_checked", "SELECT m.method, count(*) AS n_cells, count(*) FILTER (Value_missing IS NULL) AS n_gaps, 0::BIGINT AS n_left, 0::BIGINT AS n_changed "
       f"FROM prepared CROSS JOIN (SELECT unnest({TRAINED}) AS method) m GROUP BY m.method")
def trained_fills_checked(spark, sf):
    """Every gap is filled and no observed cell moves, for the methods that SQL cannot follow."""
    p = tb.working_set(spark, sf)
    fills = fill.run_methods(p, TRAINED).withColumnRenamed("Value", "_fill")
    gap, observed = F.col("Value_missing").isNull(), F.col("Value_missing")
    return scan.cell_join(fills, p.select(*CELL, "Value_missing")).groupBy("method").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(gap).alias("n_gaps"), F.count_if(F.col("_fill").isNull()).alias("n_left"),
        F.count_if(~gap & ~observed.eqNullSafe(F.col("_fill"))).alias("n_changed"))


KEYED = ["mean", "ffill", "interpolation", "knn", "iterative"]


@query("null_keys_kept", "SELECT m.method, count(*) AS n_cells, count(*) FILTER (missing AND Feature = 'Wind_direction') AS n_without_key, 0::BIGINT AS n_filled "
       f"FROM prepared CROSS JOIN (SELECT unnest({KEYED}) AS method) m GROUP BY m.method")
def null_keys_kept(spark, sf):
    """Cells that lost their station come out of every imputer, unfilled."""
    lost = F.col("missing") & (F.col("Feature") == "Wind_direction")
    p = stored(tb.prepared(spark, sf).withColumn("Station", F.when(~lost, F.col("Station"))), "lost-keys")
    return fill.run_methods(p, KEYED).groupBy("method").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("Station").isNull()).alias("n_without_key"),
        F.count_if(F.col("Station").isNull() & F.col("Value").isNotNull()).alias("n_filled"))


@query("runs_measured", "SELECT imputation_method, count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_left, true AS timed FROM ("
       "SELECT 'mean' AS imputation_method, coalesce(Value_missing, series_mean) AS v FROM near UNION ALL "
       "SELECT 'ffill', coalesce(Value_missing, prev, nxt) FROM near UNION ALL SELECT 'interpolation', coalesce(Value_missing, prev, nxt) FROM near UNION ALL "
       "SELECT 'knn', 0 FROM near UNION ALL SELECT 'iterative', coalesce(Value_missing, series_mean) FROM near) GROUP BY imputation_method")
def runs_measured(spark, sf):
    """Rows, gaps left and run time of each method, as its own write recorded them."""
    runs = fill.run_measured(tb.working_set(spark, sf), scratch_path(spark, "measured"), KEYED)
    timed = rank.with_runtime(runs.select("imputation_method", "n_rows", "n_left"), runs.select("imputation_method", "ms"))
    return timed.select("imputation_method", "n_rows", "n_left", ((F.col("RUNTIME") >= 1) & (F.col("RUNTIME_LOG") >= 0)).alias("timed"))


@query("filled_by_plug_in", "SELECT Date, Station, Feature, round(Value, 6) + 0.0 AS Value, missing, "
       "round(coalesce(Value_missing, median(Value_missing) OVER (PARTITION BY Station, Feature)), 6) + 0.0 AS Value_missing FROM prepared")
def filled_by_plug_in(spark, sf):
    """A user's own pandas function, run per station."""
    return rounded(fill.impute_grouped(tb.working_set(spark, sf), "Station", lambda wide: wide.fillna(wide.median())))
