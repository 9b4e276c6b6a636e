"""Panels derived from the given tables, as DataFrames and as SQL for the check engine.

Stations are suppliers and users, so the panels grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelfill.functions.calendar import hour_start, midnight, monday
from panelfill.functions.keys import CELL
from panelfill.operators.clean import grid_dates, regularise
from panelfill.operators.masks import mask_mcar
from panelfill.sources.storage import stored

# Return flags stand for sensors whose names trigger the unit rules.
FEATURES = {"A": "Air_temperature", "N": "Wind_direction", "R": "Relative_humidity"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _station(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 9, "0"))


def _feature() -> Column:
    f = F.lit(None).cast("string")
    for flag, name in FEATURES.items():
        f = F.when(F.col("l_returnflag") == flag, name).otherwise(f)
    return f


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular, repeated readings: one per line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("Date"), _station("S", F.col("l_suppkey")).alias("Station"), _feature().alias("Feature"),
        F.col("l_quantity").alias("Value"), "l_suppkey", "l_linestatus", "l_quantity")


def _means(rows: DataFrame, stamp: Column) -> DataFrame:
    return rows.groupBy(stamp.alias("Date"), "Station", "Feature").agg(F.avg("Value").alias("Value"))


def weekly(spark, sf_dir) -> DataFrame:
    """Week x supplier x sensor; a bit more than half of the cells are empty at every scale."""
    return regularise(_means(readings(spark, sf_dir), monday(F.col("Date"))), "7d", per_feature=False)


def daily(spark, sf_dir) -> DataFrame:
    """Day x supplier x sensor: sparse."""
    return regularise(_means(readings(spark, sf_dir), midnight(F.col("Date"))), "1d", per_feature=False)


def daily_dates(spark, sf_dir) -> DataFrame:
    """The dates of the daily panel."""
    return grid_dates(readings(spark, sf_dir).select(midnight(F.col("Date")).alias("Date")), "1d")


def weekly_org(spark, sf_dir) -> DataFrame:
    """The panel with the real gaps: part of the readings, and one supplier without a humidity sensor."""
    some = readings(spark, sf_dir).where((F.col("l_linestatus") == "O") & (F.col("l_quantity") <= 25))
    some = some.where(~((F.col("l_suppkey") == 3) & (F.col("Feature") == "Relative_humidity")))
    return regularise(_means(some, monday(F.col("Date"))), "7d", per_feature=False)


def group_weekly(spark, sf_dir) -> DataFrame:
    """Week x supplier group x sensor: ten dense stations."""
    rows = readings(spark, sf_dir).withColumn("Station", F.concat(F.lit("G"), F.lpad((F.col("l_suppkey") % 10).cast("string"), 2, "0")))
    return regularise(_means(rows, monday(F.col("Date"))), "7d", per_feature=False)


def group_daily(spark, sf_dir) -> DataFrame:
    """Day x supplier group x sensor."""
    rows = readings(spark, sf_dir).withColumn("Station", F.concat(F.lit("G"), F.lpad((F.col("l_suppkey") % 10).cast("string"), 2, "0")))
    return regularise(_means(rows, midnight(F.col("Date"))), "1d", per_feature=False)


def hourly_raw(spark, sf_dir) -> DataFrame:
    """Hour x user x event type, only the hours that have events."""
    ev = table(spark, sf_dir, "events").select(
        F.col("ts").alias("Date"), _station("U", F.col("user_id")).alias("Station"),
        F.col("event_type").alias("Feature"), F.col("value").alias("Value"))
    return _means(ev, hour_start(F.col("Date")))


def hourly(spark, sf_dir) -> DataFrame:
    return regularise(hourly_raw(spark, sf_dir), "1h")


def prepared(spark, sf_dir) -> DataFrame:
    return mask_mcar(weekly(spark, sf_dir), 0.2, 42)


def group_prepared(spark, sf_dir) -> DataFrame:
    return mask_mcar(group_weekly(spark, sf_dir), 0.2, 42)


def working_set(spark, sf_dir) -> DataFrame:
    """The prepared panel as a written table: the hand-over point to methods that read it several times."""
    return stored(prepared(spark, sf_dir), "working-set")


def as_table(panel) -> DataFrame:
    """A panel written out once, for operators that scan it more than once."""
    return stored(panel, "panel")


def daily_table(spark, sf_dir) -> DataFrame:
    return as_table(daily(spark, sf_dir))


def group_working_set(spark, sf_dir) -> DataFrame:
    return stored(group_prepared(spark, sf_dir), "working-set")


# ---------------------------------------------------------------------------------------------------
# The same panels in SQL. Each name is a common table expression; the ones a query mentions are put
# in front of it.

_FEATURE_SQL = "CASE l_returnflag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURES.items()) + " END"


def _grid_sql(raw: str, step: str) -> str:
    return (f"SELECT d.Date, s.Station, s.Feature, r.Value FROM (SELECT DISTINCT Station, Feature FROM {raw}) s "
            f"CROSS JOIN (SELECT unnest(generate_series(min(Date), max(Date), INTERVAL {step})) AS Date FROM {raw}) d "
            f"LEFT JOIN {raw} r ON r.Date = d.Date AND r.Station = s.Station AND r.Feature = s.Feature")


def draw_sql(seed: int, *cols: str) -> str:
    key = ", ".join(f"({c})::VARCHAR" for c in cols)
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {key})), 1, 8))::BIGINT / 4294967296.0)"


def hidden_sql(source: str, hit: str) -> str:
    return (f"SELECT *, CASE WHEN NOT missing THEN Value END AS Value_missing FROM "
            f"(SELECT *, Value IS NOT NULL AND ({hit}) AS missing FROM {source})")


def neighbours_sql(source: str, v: str) -> str:
    """Position, nearest observed value on either side and series mean of every cell."""
    w = "PARTITION BY Station, Feature ORDER BY Date"
    back, ahead = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return (f"SELECT *, last_value({v} IGNORE NULLS) OVER ({w} {back}) AS prev, "
            f"last_value(seen_pos IGNORE NULLS) OVER ({w} {back}) AS prev_pos, "
            f"first_value({v} IGNORE NULLS) OVER ({w} {ahead}) AS nxt, "
            f"first_value(seen_pos IGNORE NULLS) OVER ({w} {ahead}) AS nxt_pos, "
            f"avg({v}) OVER (PARTITION BY Station, Feature) AS series_mean "
            f"FROM (SELECT *, CASE WHEN {v} IS NOT NULL THEN pos END AS seen_pos FROM "
            f"(SELECT *, row_number() OVER ({w}) AS pos FROM {source}))")


def blend_sql(v: str) -> str:
    return (f"coalesce({v}, prev + (nxt - prev) / nullif(nxt_pos - prev_pos, 0) * (pos - prev_pos))")


_RAW = ("SELECT date_trunc('{unit}', l_shipdate)::TIMESTAMP AS Date, {station} AS Station, "
        f"{_FEATURE_SQL} AS Feature, avg(l_quantity) AS Value FROM lineitem {{where}} GROUP BY ALL")
_SUPPLIER = "'S' || lpad(l_suppkey::VARCHAR, 9, '0')"
_GROUP = "'G' || lpad((l_suppkey % 10)::VARCHAR, 2, '0')"
_ORG = "WHERE l_linestatus = 'O' AND l_quantity <= 25 AND NOT (l_suppkey = 3 AND l_returnflag = 'R')"

CTES = {
    "readings": f"SELECT l_shipdate AS Date, {_SUPPLIER} AS Station, {_FEATURE_SQL} AS Feature, l_quantity AS Value FROM lineitem",
    "weekly_raw": _RAW.format(unit="week", station=_SUPPLIER, where=""),
    "weekly": _grid_sql("weekly_raw", "7 DAY"),
    "daily_raw": _RAW.format(unit="day", station=_SUPPLIER, where=""),
    "daily": _grid_sql("daily_raw", "1 DAY"),
    "org_raw": _RAW.format(unit="week", station=_SUPPLIER, where=_ORG),
    "weekly_org": _grid_sql("org_raw", "7 DAY"),
    "group_raw": _RAW.format(unit="week", station=_GROUP, where=""),
    "group_weekly": _grid_sql("group_raw", "7 DAY"),
    "group_day_raw": _RAW.format(unit="day", station=_GROUP, where=""),
    "group_daily": _grid_sql("group_day_raw", "1 DAY"),
    "hourly_raw": ("SELECT date_trunc('hour', ts)::TIMESTAMP AS Date, 'U' || lpad(user_id::VARCHAR, 9, '0') AS Station, "
                   "event_type AS Feature, avg(value) AS Value FROM events GROUP BY ALL"),
    "hourly_range": "SELECT Feature, min(Date) AS lo, max(Date) AS hi FROM hourly_raw GROUP BY Feature",
    "hourly_steps": "SELECT Feature, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS Date FROM hourly_range",
    "hourly": ("SELECT d.Date, s.Station, s.Feature, r.Value FROM (SELECT DISTINCT Station, Feature FROM hourly_raw) s "
               "JOIN hourly_steps d ON d.Feature = s.Feature LEFT JOIN hourly_raw r "
               "ON r.Date = d.Date AND r.Station = s.Station AND r.Feature = s.Feature"),
    "prepared": hidden_sql("weekly", f"{draw_sql(42, 'Station', 'Feature', 'Date')} < 0.2"),
    "group_prepared": hidden_sql("group_weekly", f"{draw_sql(42, 'Station', 'Feature', 'Date')} < 0.2"),
    "near": neighbours_sql("prepared", "Value_missing"),
    "fills": ("SELECT 'mean' AS method, Date, Station, Feature, coalesce(Value_missing, series_mean) AS Value FROM near "
              "UNION ALL SELECT 'ffill', Date, Station, Feature, coalesce(Value_missing, prev, nxt) FROM near "
              f"UNION ALL SELECT 'interpolation', Date, Station, Feature, coalesce({blend_sql('Value_missing')}, prev, nxt) FROM near"),
    "methods": ("SELECT * FROM fills UNION ALL SELECT 'original', Date, Station, Feature, Value FROM prepared"),
    "cells": ("SELECT m.method, m.Date, m.Station, m.Feature, p.Value AS truth, m.Value AS fill FROM methods m "
              "JOIN prepared p ON p.Date = m.Date AND p.Station = m.Station AND p.Feature = m.Feature "
              "WHERE p.missing AND p.Value IS NOT NULL AND m.Value IS NOT NULL"),
    "series_scores": (
        "SELECT method, Station, Feature, sqrt(avg((fill - truth) ** 2)) AS RMSE, avg(abs(fill - truth)) AS MAE, "
        "avg(abs(fill - truth) / greatest(abs(truth), 1e-8)) * 100 AS MAPE, "
        "1 - sum((fill - truth) ** 2) / nullif(sum((truth - m) ** 2), 0) AS R2, "
        "coalesce(sum(truth * fill) / nullif(sqrt(sum(truth * truth)) * sqrt(sum(fill * fill)), 0), 0) AS cosine_similarity "
        "FROM (SELECT *, avg(truth) OVER (PARTITION BY method, Station, Feature) AS m FROM cells) GROUP BY method, Station, Feature"),
    "rates": ("SELECT Station, Feature, count(*) FILTER (missing) AS n_missing_values, count(*) AS n_total_values, "
              "count(*) FILTER (missing) / count(*) AS missing_rate FROM prepared GROUP BY Station, Feature"),
    # structural similarity: matrices, their moments, 7 x 7 sums in one frame clause per axis
    "sim_cells": ("SELECT m.method, p.Date, p.Station, p.Feature, coalesce(p.Value, 0) AS x, coalesce(m.Value, 0) AS y, "
                  "row_number() OVER (PARTITION BY m.method, p.Feature, p.Station ORDER BY p.Date) AS t, "
                  "row_number() OVER (PARTITION BY m.method, p.Feature, p.Date ORDER BY p.Station) AS s, "
                  "count(*) OVER (PARTITION BY m.method, p.Feature, p.Station) AS nt, "
                  "count(*) OVER (PARTITION BY m.method, p.Feature, p.Date) AS ns "
                  "FROM methods m JOIN prepared p ON p.Date = m.Date AND p.Station = m.Station AND p.Feature = m.Feature"),
    "sim_range": "SELECT method, Feature, greatest(max(x), max(y)) - least(min(x), min(y)) AS r FROM sim_cells GROUP BY method, Feature",
    "sim_time": ("SELECT method, Feature, Date, Station, t, s, nt, ns, " + ", ".join(
        f"sum({e}) OVER w AS {n}" for n, e in (("x", "x"), ("y", "y"), ("xx", "x * x"), ("yy", "y * y"), ("xy", "x * y")))
        + " FROM sim_cells WINDOW w AS (PARTITION BY method, Feature, Station ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"),
    "sim_both": ("SELECT method, Feature, t, s, nt, ns, " + ", ".join(f"sum({n}) OVER w / 49 AS {n}" for n in ("x", "y", "xx", "yy", "xy"))
                 + " FROM sim_time WINDOW w AS (PARTITION BY method, Feature, Date ORDER BY s ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"),
    "similarity": (
        "SELECT b.method, b.Feature, avg(((2*x*y + c1) * (2*(xy - x*y)*49/48 + c2)) / "
        "((x*x + y*y + c1) * ((xx - x*x)*49/48 + (yy - y*y)*49/48 + c2))) AS SSIM "
        "FROM sim_both b JOIN (SELECT *, (r*0.01)**2 AS c1, (r*0.03)**2 AS c2 FROM sim_range WHERE r > 0) g "
        "ON g.method = b.method AND g.Feature = b.Feature "
        "WHERE t > 3 AND t <= nt - 3 AND s > 3 AND s <= ns - 3 AND nt > 7 AND ns > 7 GROUP BY b.method, b.Feature"),
    "scores": (
        "SELECT 1 AS run, q.method AS imputation_method, 'wide' AS partition_method, q.Station AS station, q.Feature AS feature, "
        "q.RMSE, q.MAE, q.MAPE, q.R2, z.SSIM, q.cosine_similarity, r.missing_rate, r.n_missing_values, r.n_total_values "
        "FROM series_scores q JOIN rates r ON r.Station = q.Station AND r.Feature = q.Feature "
        "LEFT JOIN similarity z ON z.method = q.method AND z.Feature = q.Feature"),
}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Put every common table expression the text mentions, directly or not, in front of it."""
    known = {**CTES, **(extra or {})}
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in known:
            if name not in needed and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(known[name])
    order = [n for n in known if n in needed]
    if not order:
        return body
    heads = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" if n in ("methods", "near", "prepared") else f"{n} AS ({known[n]})" for n in order)
    return f"WITH {heads}\n{body}"
