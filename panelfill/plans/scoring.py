"""Queries: scores of the fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelfill.functions.keys import SERIES
from panelfill.operators import fill, reshape, score, similarity
from panelfill.plans import testbed as tb
from panelfill.plans.catalog import ORACLES, off_the_edge, query, r, rounded
from panelfill.plans.testbed import with_ctes
from panelfill.sources.storage import stored


def _inputs(spark, sf):
    """The prepared panel and its fills, written out between the steps: scoring reads both several times."""
    p = tb.working_set(spark, sf)
    return p, stored(fill.run_methods(p, with_truth=True, mark_hidden=True), "fills")


@query("series_scores", f"SELECT method, Station, Feature, {r('RMSE')}, {r('MAE')}, {r('MAPE')}, {r('R2')}, {r('cosine_similarity')} FROM series_scores")
def series_scores(spark, sf):
    p, m = _inputs(spark, sf)
    return rounded(score.score_series(score.score_cells(p, m)))


@query("structural_similarity", f"SELECT method, Feature, {r('SSIM')} FROM similarity")
def structural_similarity(spark, sf):
    p, m = _inputs(spark, sf)
    return rounded(similarity.ssim(p, m.where("method <> 'mask'")))


BAND = 10
# The walk over the rows of each series, one recursion step per row for all series at once; the state is the band.
DTW = {
    "ordered": "SELECT method, Station, Feature, row_number() OVER (PARTITION BY method, Station, Feature ORDER BY Date) AS i, truth, fill, "
               "count(*) OVER (PARTITION BY method, Station, Feature) AS n FROM cells",
    "lists": "SELECT method, Station, Feature, any_value(n) AS n, list(truth ORDER BY i) AS x, list(fill ORDER BY i) AS y FROM ordered GROUP BY ALL",
}
_INF = "'infinity'::DOUBLE"


def _walk(band: int) -> str:
    width = 2 * band + 1
    j = f"(i + 1 - {band} + e[1]::BIGINT)"
    cell = (f"CASE WHEN {j} < 1 OR {j} > n THEN {_INF} ELSE abs(x[i + 1] - y[{j}]) + least(d[e[1]::BIGINT + 1], "
            f"coalesce(d[e[1]::BIGINT + 2], {_INF}), coalesce(acc[e[1]::BIGINT], {_INF})) END")
    return (f", walk AS (SELECT method, Station, Feature, n, x, y, 0::BIGINT AS i, "
            f"list_transform(range(0, {width}), lambda o: CASE WHEN o = {band} THEN 0::DOUBLE ELSE {_INF} END) AS d FROM lists UNION ALL "
            f"SELECT method, Station, Feature, n, x, y, i + 1, list_reduce(list_transform(range(0, {width}), lambda o: [o::DOUBLE]), "
            f"lambda acc, e: list_append(acc, {cell}), []::DOUBLE[]) FROM walk WHERE i < n)")


def _recursive(tail: str, sources: str, band: int = BAND) -> str:
    """The common table expressions the sources need, the recursive one, then the statement itself."""
    head = with_ctes(sources, DTW)[len("WITH"):-len(sources)].rstrip()
    return off_the_edge(f"WITH RECURSIVE{head}{_walk(band)} {tail}")


_DISTANCE = f"round(d[{BAND + 1}], 6) + 0.0 AS dtw_distance"
ORACLES["warping_distance"] = _recursive(
    f"SELECT method, Station, Feature, {_DISTANCE} FROM walk WHERE i = n", "SELECT * FROM lists")


@query("warping_distance")
def warping_distance(spark, sf):
    p, m = _inputs(spark, sf)
    return rounded(similarity.dtw(score.score_cells(p, m), BAND))


# No series of the test tables hides as many cells, so a band of this width leaves no alignment out.
WIDE = 80
ORACLES["warping_distance_unbanded"] = _recursive(
    f"SELECT method, Station, Feature, round(d[{WIDE + 1}], 6) + 0.0 AS dtw_distance FROM walk WHERE i = n", "SELECT * FROM lists", WIDE)


@query("warping_distance_unbanded")
def warping_distance_unbanded(spark, sf):
    p, m = _inputs(spark, sf)
    return rounded(similarity.dtw(score.score_cells(p, m), band=None))


_SCORES = ", ".join(["run", "imputation_method", "partition_method", "station", "feature", r("RMSE"), r("MAE"), r("MAPE"), r("R2"), r("SSIM"),
                     r("cosine_similarity"), r("missing_rate"), "n_missing_values", "n_total_values",
                     "false AS scaling", "true AS resample", "'1w' AS resample_freq"])


def table_of_scores(spark, sf):
    p, m = _inputs(spark, sf)
    return score.evaluate(p, m, with_dtw=False, resample=True, resample_freq="1w").drop("dtw_distance")


@query("score_table", f"SELECT {_SCORES} FROM scores")
def score_table(spark, sf):
    return rounded(table_of_scores(spark, sf))


_WITH_WARPING = ", ".join(["run", "imputation_method", "partition_method", "station", "s.feature AS feature", r("RMSE"), r("MAE"), r("MAPE"), r("R2"),
                           r("SSIM"), r("cosine_similarity"), r("missing_rate"), "n_missing_values", "n_total_values",
                           "false AS scaling", "false AS resample", "NULL::VARCHAR AS resample_freq"])
ORACLES["score_table_with_warping"] = _recursive(
    f"SELECT {_WITH_WARPING}, {_DISTANCE} FROM (SELECT run, imputation_method, partition_method, station AS st, station, feature, RMSE, MAE, MAPE, R2, SSIM, "
    "cosine_similarity, missing_rate, n_missing_values, n_total_values FROM scores) s LEFT JOIN "
    "(SELECT method, Station AS ws, Feature AS wf, d FROM walk WHERE i = n) w ON w.method = s.imputation_method AND w.ws = s.st AND w.wf = s.feature",
    "SELECT * FROM lists JOIN scores ON true")


@query("score_table_with_warping")
def score_table_with_warping(spark, sf):
    p, m = _inputs(spark, sf)
    return rounded(score.evaluate(p, m))


@query("series_sliced", "SELECT n.Date, n.Station, n.Feature, round(CASE WHEN NOT missing THEN Value END, 6) + 0.0 AS observed, "
       "round(CASE WHEN missing THEN Value END, 6) + 0.0 AS hidden_truth, round(CASE WHEN missing THEN coalesce("
       + tb.blend_sql("Value_missing") + ", prev, nxt) END, 6) + 0.0 AS imputed FROM near n "
       "WHERE Station = 'S000000003' AND Feature = 'Wind_direction' AND Date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2000-12-31'")
def series_sliced(spark, sf):
    p = tb.prepared(spark, sf)
    m = fill.impute_linear(p.withColumn("Value_imputed", F.col("Value_missing")), "Value_imputed")
    return rounded(reshape.series_slice(m, "Wind_direction", "S000000003", "1997-01-01", "2000-12-31"))
