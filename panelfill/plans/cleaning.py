"""Queries: raw readings to regular panels, units, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelfill.functions.keys import CELL, SERIES
from panelfill.operators import clean, reshape, scale
from panelfill.plans import testbed as tb
from panelfill.plans.catalog import query, r, rounded

V = r("Value")


@query("station_names", "SELECT split_part(s_name, '#', 1) AS head, split_part(replace(s_name, '#', ' '), ' ', 1) AS Station, "
       "s_suppkey FROM supplier")
def station_names(spark, sf):
    t = tb.table(spark, sf, "supplier").select(
        "s_suppkey", F.split("s_name", "#")[0].alias("head"), F.replace("s_name", F.lit("#"), F.lit(" ")).alias("Station"))
    return clean.normalise_station(t)


@query("parsed_dates", "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS Date FROM orders")
def parsed_dates(spark, sf):
    """Text stamps, some of them no dates at all."""
    text = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderpriority")).otherwise(F.col("o_orderdate").cast("string"))
    return clean.parse_date(tb.table(spark, sf, "orders").select("o_orderkey", text.alias("Date")))


@query("naive_utc", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP - (CASE event_type WHEN 'click' THEN INTERVAL 2 HOUR "
       "WHEN 'view' THEN INTERVAL '-330 MINUTE' ELSE INTERVAL 0 HOUR END) AS Date FROM events")
def naive_utc(spark, sf):
    offset = F.when(F.col("event_type") == "click", "+02:00").when(F.col("event_type") == "view", "-05:30").otherwise("Z")
    text = F.concat(F.substring(F.col("ts").cast("string"), 1, 19), offset)
    return clean.to_naive_utc(tb.table(spark, sf, "events").select("event_id", text.alias("Date")))


@query("units_fixed", f"SELECT Date, Station, Feature, round(CASE WHEN Feature ILIKE '%temperature%' THEN Value * 20 - 100 + 273.15 "
       "WHEN Value IS NULL THEN NULL WHEN Feature ILIKE '%direction%' THEN least(greatest(Value * 20 - 100, 0), 360) "
       "ELSE least(greatest(Value * 20 - 100, 0), 100) END, 6) + 0.0 AS Value FROM weekly")
def units_fixed(spark, sf):
    p = tb.weekly(spark, sf).withColumn("Value", F.col("Value") * 20 - 100)
    return rounded(clean.fix_units(p))


@query("dropped_stations", f"SELECT Date, Station, Feature, {V} FROM weekly WHERE Station <> 'S000000001'")
def dropped_stations(spark, sf):
    return rounded(clean.drop_stations(tb.weekly(spark, sf), ["S000000001"]))


@query("clipped_range", f"SELECT Date, Station, Feature, {V} FROM weekly WHERE Date >= (SELECT min(Date) FROM weekly_org) "
       "AND Date <= (SELECT max(Date) FROM weekly_org)")
def clipped_range(spark, sf):
    return rounded(clean.clip_to_range(tb.weekly(spark, sf), tb.weekly_org(spark, sf))[0])


@query("calendar_columns", f"SELECT Date, Station, Feature, {V}, year(Date)::INT AS Year, month(Date)::INT AS Month, "
       "day(Date)::INT AS Day, hour(Date)::INT AS Hour FROM hourly_raw")
def calendar_columns(spark, sf):
    return rounded(clean.add_calendar(tb.hourly_raw(spark, sf)))


@query("calendar_excluded", f"SELECT Date, Station, Feature, {V} FROM (SELECT * FROM weekly UNION ALL "
       "SELECT Date, Station, 'Month', month(Date)::DOUBLE FROM weekly) WHERE Feature NOT IN ('Date', 'Year', 'Month', 'Day', 'Hour')")
def calendar_excluded(spark, sf):
    p = tb.weekly(spark, sf)
    extra = p.withColumn("Feature", F.lit("Month")).withColumn("Value", F.month("Date").cast("double"))
    return rounded(clean.drop_calendar(p.unionByName(extra)))


@query("calendar_scaled", "SELECT Date, " + ", ".join(
    f"round(coalesce((x{c} - min(x{c}) OVER ()) / nullif(max(x{c}) OVER () - min(x{c}) OVER (), 0), 0), 6) + 0.0 AS {c}"
    for c in ("Year", "Month", "Day", "Hour")) + " FROM (SELECT Date, year(Date)::DOUBLE AS xYear, month(Date)::DOUBLE AS xMonth, "
    "day(Date)::DOUBLE AS xDay, hour(Date)::DOUBLE AS xHour FROM hourly_raw)")
def calendar_scaled(spark, sf):
    return rounded(scale.scale_calendar(tb.hourly_raw(spark, sf)).select("Date", "Year", "Month", "Day", "Hour"))


@query("series_names_parsed", "SELECT DISTINCT Station || ':' || Feature || ':x' AS name, Station, Feature || ':x' AS Feature FROM weekly "
       "UNION ALL SELECT DISTINCT '{\"' || Station || '\",\"' || Feature || '\"}', Station, Feature FROM weekly")
def series_names_parsed(spark, sf):
    s = tb.weekly(spark, sf).select(*SERIES).distinct()
    plain = F.concat_ws(":", "Station", "Feature", F.lit("x"))
    braced = F.concat(F.lit('{"'), "Station", F.lit('","'), "Feature", F.lit('"}'))
    return reshape.parse_series_name(s.select(F.explode(F.array(plain, braced)).alias("name")), "name")


@query("regular_hours", f"SELECT Date, Station, Feature, {V} FROM hourly")
def regular_hours(spark, sf):
    return rounded(tb.hourly(spark, sf))


@query("regular_weeks", f"SELECT Date, Station, Feature, {V} FROM weekly")
def regular_weeks(spark, sf):
    return rounded(tb.weekly(spark, sf))


@query("off_grid_dropped", f"SELECT d.Date, s.Station, s.Feature, round(x.Value, 6) + 0.0 AS Value "
       "FROM (SELECT DISTINCT Station, Feature FROM firsts) s JOIN (SELECT Feature, unnest(generate_series(min(Date), max(Date), INTERVAL 6 HOUR)) AS Date "
       "FROM firsts GROUP BY Feature) d ON d.Feature = s.Feature LEFT JOIN firsts x ON x.Date = d.Date AND x.Station = s.Station AND x.Feature = s.Feature",
       firsts="SELECT date_trunc('minute', ts)::TIMESTAMP AS Date, 'U' || lpad(user_id::VARCHAR, 9, '0') AS Station, "
              "event_type AS Feature, avg(value) AS Value FROM events GROUP BY ALL")
def off_grid_dropped(spark, sf):
    """Minute stamps on a six-hour grid: most readings are off the grid."""
    ev = tb.table(spark, sf, "events")
    minute = F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz")
    p = ev.groupBy(minute.alias("Date"), F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("Station"),
                   F.col("event_type").alias("Feature")).agg(F.avg("value").alias("Value"))
    return rounded(clean.regularise(p, "6h"))


@query("resampled_days", f"SELECT date_trunc('day', Date)::TIMESTAMP AS Date, Station, Feature, {r('avg(Value)', 'Value')} FROM hourly GROUP BY ALL")
def resampled_days(spark, sf):
    return rounded(clean.resample(tb.hourly(spark, sf), "1d"))


@query("resampled_weeks", f"SELECT date_trunc('week', Date)::TIMESTAMP + INTERVAL 6 DAY AS Date, Station, Feature, {r('avg(Value)', 'Value')} "
       "FROM hourly GROUP BY ALL")
def resampled_weeks(spark, sf):
    return rounded(clean.resample(tb.hourly(spark, sf), "1w"))


@query("resampled_five_days", f"SELECT o + INTERVAL 1 DAY * (5 * (date_diff('day', o, Date) // 5)) AS Date, Station, Feature, {r('avg(Value)', 'Value')} "
       "FROM (SELECT *, date_trunc('day', min(Date) OVER (PARTITION BY Feature))::TIMESTAMP AS o FROM hourly) GROUP BY ALL")
def resampled_five_days(spark, sf):
    return rounded(clean.resample(tb.hourly(spark, sf), "5d"))


@query("resampled_with_names", f"SELECT date_trunc('day', Date)::TIMESTAMP AS Date, {r('avg(Value)', 'Value')}, "
       "count(DISTINCT Station) AS n_stations, count(DISTINCT Feature) AS n_features, count(*) AS n_rows, min(Station) AS first_station, "
       "max(Feature) AS last_feature FROM hourly_raw GROUP BY ALL")
def resampled_with_names(spark, sf):
    c = clean.resample_collect(tb.hourly_raw(spark, sf), "1d")
    return rounded(c.select(
        "Date", "Value", F.size("Stations").cast("bigint").alias("n_stations"), F.size("Features").cast("bigint").alias("n_features"),
        F.aggregate("Stations", F.lit(0).cast("bigint"), lambda a, s: a + s["n"]).alias("n_rows"),
        F.col("Stations")[0]["name"].alias("first_station"), F.element_at("Features", -1)["name"].alias("last_feature")))


@query("wide_to_long", "SELECT l_orderkey, l_linenumber, Feature, round(Value, 6) + 0.0 AS Value FROM (SELECT l_orderkey, l_linenumber, "
       "l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT INCLUDE NULLS (Value FOR Feature IN "
       "(l_quantity, l_extendedprice, l_discount, l_tax))")
def wide_to_long(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    t = tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    return rounded(reshape.to_long(t, ("l_orderkey", "l_linenumber"), "Feature", "Value", cols))


GROUPS = [f"G{i:02d}" for i in range(10)]
SENSORS = sorted(tb.FEATURES.values())


def _pivot_sql(keys: str, column: str, names: list[str]) -> str:
    cols = ", ".join(f"round(max(Value) FILTER ({column} = '{n}'), 6) + 0.0 AS \"{n}\"" for n in names)
    return f"SELECT {keys}, {cols} FROM group_daily GROUP BY {keys}"


@query("wide_by_feature", _pivot_sql("Feature, Date", "Station", GROUPS))
def wide_by_feature(spark, sf):
    return rounded(reshape.to_wide(tb.group_daily(spark, sf), "Feature", columns=GROUPS))


@query("wide_by_station", f"SELECT Station, Date, " + ", ".join(
    f"round(max(Value) FILTER (Feature = '{n}'), 6) + 0.0 AS \"{n}\"" for n in SENSORS) + " FROM weekly GROUP BY Station, Date")
def wide_by_station(spark, sf):
    return rounded(reshape.to_wide(tb.weekly(spark, sf), "Station", columns=SENSORS))


WIDE = [f"{g}:{s}" for g in GROUPS for s in SENSORS]


@query("wide_over_all", _pivot_sql("Date", "Station || ':' || Feature", WIDE))
def wide_over_all(spark, sf):
    return rounded(reshape.to_wide(tb.group_daily(spark, sf), "Wide", columns=WIDE))


@query("partition_keys", "SELECT 'Wide' AS part, count(*) AS n FROM weekly UNION ALL SELECT Station, count(*) FROM weekly GROUP BY Station "
       "UNION ALL SELECT Feature, count(*) FROM weekly GROUP BY Feature")
def partition_keys(spark, sf):
    p = tb.weekly(spark, sf)
    out = [reshape.with_partition(p, by).groupBy("part").agg(F.count(F.lit(1)).alias("n")) for by in reshape.BY]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("scaler_fit", f"SELECT Station, Feature, {r('avg(Value)', 'mean')}, "
       "round(CASE WHEN stddev_pop(Value) = 0 THEN 1 ELSE stddev_pop(Value) END, 6) + 0.0 AS scale FROM weekly GROUP BY Station, Feature")
def scaler_fit(spark, sf):
    return rounded(scale.fit_scaler(tb.weekly(spark, sf)))


_SCALER = ("SELECT Station, Feature, avg(Value) AS m, CASE WHEN stddev_pop(Value) = 0 THEN 1 ELSE stddev_pop(Value) END AS s "
           "FROM prepared GROUP BY Station, Feature")


@query("scaled_gaps", f"SELECT Date, p.Station, p.Feature, {V}, missing, round((Value_missing - m) / s, 6) + 0.0 AS Value_missing "
       "FROM prepared p JOIN scaler c ON c.Station = p.Station AND c.Feature = p.Feature", scaler=_SCALER)
def scaled_gaps(spark, sf):
    p = tb.prepared(spark, sf)
    return rounded(scale.scale(p, scale.fit_scaler(p)))


@query("unscaled_fills", f"SELECT method, Date, Station, Feature, {V} FROM methods")
def unscaled_fills(spark, sf):
    """Scale, fill in scaled units, scale back: the fills in original units."""
    from panelfill.operators.fill import run_methods
    p = tb.working_set(spark, sf)
    scaler = scale.fit_scaler(p)
    m = run_methods(scale.scale(p, scaler), with_truth=True).where("method <> 'mask'")
    return rounded(scale.unscale(m, scaler))


@query("min_max_panel", "SELECT Date, Station, Feature, round((Value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) + 0.0 AS Value "
       "FROM (SELECT *, min(Value) OVER w AS lo, max(Value) OVER w AS hi FROM weekly WINDOW w AS (PARTITION BY Station, Feature))")
def min_max_panel(spark, sf):
    return rounded(scale.normalise(tb.weekly(spark, sf), "min_max"))


@query("z_score_panel", "SELECT Date, Station, Feature, round((Value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS Value "
       "FROM (SELECT *, avg(Value) OVER w AS m, stddev_pop(Value) OVER w AS s FROM weekly WINDOW w AS (PARTITION BY Station, Feature))")
def z_score_panel(spark, sf):
    return rounded(scale.normalise(tb.weekly(spark, sf), "z_score"))


@query("keys_swapped", "SELECT DISTINCT Feature AS station, Station AS feature FROM weekly")
def keys_swapped(spark, sf):
    s = tb.weekly(spark, sf).select(F.col("Station").alias("station"), F.col("Feature").alias("feature")).distinct()
    return reshape.swap_keys(s)
