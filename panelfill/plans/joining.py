"""Queries: joins, unions and the transfer of a missing-data pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelfill.functions.keys import CELL, SERIES
from panelfill.operators import fill, gaps, pattern, score
from panelfill.plans import testbed as tb
from panelfill.plans.catalog import query, r, rounded
from panelfill.sources.storage import stored

V = r("Value")
MASK = {"org_mask": "SELECT Date, Station, Feature, Value IS NULL AS missing FROM weekly_org"}
ABSENT = {"absent": "SELECT s.Station, f.Feature FROM (SELECT DISTINCT Station FROM weekly_org) s CROSS JOIN (SELECT DISTINCT Feature FROM weekly_org) f "
                    "WHERE NOT EXISTS (SELECT 1 FROM org_raw o WHERE o.Station = s.Station AND o.Feature = f.Feature)"}
RATES = {"feat": "SELECT Date, Feature, avg(missing::INT) AS x FROM org_mask GROUP BY Date, Feature",
         "stat": "SELECT Date, Station, avg(missing::INT) AS x FROM org_mask GROUP BY Date, Station"}
FULL = {"full_mask": "SELECT Date, Station, Feature, missing FROM org_mask UNION ALL "
                     "SELECT Date, Station, Feature, round_even(avg(x), 0) = 1 AS missing FROM ("
                     "SELECT f.Date, a.Station, a.Feature, f.x FROM absent a JOIN feat f ON f.Feature = a.Feature UNION ALL "
                     "SELECT s.Date, a.Station, a.Feature, s.x FROM absent a JOIN stat s ON s.Station = a.Station) GROUP BY Date, Station, Feature"}
ALL = {**MASK, **ABSENT, **RATES, **FULL}


@query("missing_mask", f"SELECT Date, Station, Feature, {V}, Value IS NULL AS missing FROM weekly_org")
def missing_mask(spark, sf):
    return rounded(pattern.missing_mask(tb.weekly_org(spark, sf)))


@query("mask_joined", f"SELECT w.Date, w.Station, w.Feature, round(w.Value, 6) + 0.0 AS Value, m.missing FROM weekly w LEFT JOIN org_mask m "
       "ON m.Date = w.Date AND m.Station = w.Station AND m.Feature = w.Feature", **MASK)
def mask_joined(spark, sf):
    return rounded(pattern.attach_mask(tb.weekly(spark, sf), pattern.missing_mask(tb.weekly_org(spark, sf))))


@query("mask_applied", "SELECT w.Date, w.Station, w.Feature, round(w.Value, 6) + 0.0 AS Value, m.missing, "
       "round(CASE WHEN NOT m.missing THEN w.Value END, 6) + 0.0 AS Value_missing FROM weekly w LEFT JOIN org_mask m "
       "ON m.Date = w.Date AND m.Station = w.Station AND m.Feature = w.Feature", **MASK)
def mask_applied(spark, sf):
    joined = pattern.attach_mask(tb.weekly(spark, sf), pattern.missing_mask(tb.weekly_org(spark, sf)))
    return rounded(pattern.apply_mask(joined))


@query("feature_pattern", f"SELECT Date, Feature, {r('avg(missing::INT)', 'feat_missing')} FROM org_mask WHERE Station <> 'S000000002' "
       "GROUP BY Date, Feature", **MASK)
def feature_pattern(spark, sf):
    return rounded(pattern.feature_pattern(pattern.missing_mask(tb.weekly_org(spark, sf)), ["S000000002"]))


@query("station_pattern", f"SELECT Date, Station, {r('avg(missing::INT)', 'stat_missing')} FROM org_mask GROUP BY Date, Station", **MASK)
def station_pattern(spark, sf):
    return rounded(pattern.station_pattern(pattern.missing_mask(tb.weekly_org(spark, sf))))


@query("absent_combos", "SELECT Station, Feature FROM absent", **ABSENT)
def absent_combos(spark, sf):
    return pattern.absent_combos(tb.weekly_org(spark, sf))


@query("complete_pattern", "SELECT Date, Station, Feature, missing FROM full_mask", **ALL)
def complete_pattern(spark, sf):
    return pattern.complete_pattern(pattern.missing_mask(tb.as_table(tb.weekly_org(spark, sf))))


_MAP = {"mapping": "SELECT o.Station, n.Station AS Station_ref FROM "
                   "(SELECT Station, row_number() OVER (ORDER BY Station) AS i FROM (SELECT DISTINCT Station FROM weekly)) o JOIN "
                   "(SELECT Station, row_number() OVER (ORDER BY Station) AS i FROM (SELECT DISTINCT Station FROM hourly_raw)) n ON n.i = o.i"}


@query("station_mapping", "SELECT Station, Station_ref FROM mapping", **_MAP)
def station_mapping(spark, sf):
    return pattern.station_mapping(tb.weekly(spark, sf), tb.hourly_raw(spark, sf))


@query("mapped_mask", "SELECT o.Date, m.Station_ref AS Station, o.Feature, o.missing FROM org_mask o LEFT JOIN mapping m ON m.Station = o.Station "
       "WHERE o.missing", **MASK, mapping="SELECT Station, CASE WHEN Station > 'S000000004' THEN 'T' || substr(Station, 2) END AS Station_ref "
                                          "FROM (SELECT DISTINCT Station FROM weekly_org)")
def mapped_mask(spark, sf):
    """Explicit mapping table; stations without an entry lose their name."""
    mask = pattern.missing_mask(tb.weekly_org(spark, sf)).where("missing").drop("Value")
    mapping = mask.select("Station").distinct().where(F.col("Station") > "S000000004").withColumn(
        "Station_ref", F.concat(F.lit("T"), F.substring("Station", 2, 9)))
    return pattern.map_stations(mask, mapping)


@query("org_gaps_flagged", f"SELECT h.Date, h.Station, h.Feature, round(h.Value, 6) + 0.0 AS Value, o.Value IS NULL AND o.Date IS NOT NULL AS is_missing, "
       "o.Date IS NOT NULL AS has_org, round(o.Value, 6) + 0.0 AS Value_org FROM weekly h LEFT JOIN weekly_org o ON o.Date = h.Date AND o.Station = h.Station "
       "WHERE h.Feature = 'Air_temperature'")
def org_gaps_flagged(spark, sf):
    ref = tb.weekly(spark, sf).where("Feature = 'Air_temperature'")
    out = pattern.flag_org_gaps(ref, tb.weekly_org(spark, sf))
    return rounded(out.withColumn("has_org", F.col("is_missing").isNotNull()).withColumn("is_missing", F.coalesce("is_missing", F.lit(False))))


@query("aligned_union", "SELECT coalesce(a.Date, b.Date) AS Date, coalesce(a.Station, b.Station) AS Station, coalesce(a.Feature, b.Feature) AS Feature, "
       "round(a.Value, 6) + 0.0 AS Value, round(b.Other, 6) + 0.0 AS Other FROM weekly_raw a FULL JOIN (SELECT Date, Station, Feature, Value AS Other FROM org_raw) b "
       "ON a.Date = b.Date AND a.Station = b.Station AND a.Feature = b.Feature")
def aligned_union(spark, sf):
    a = tb.weekly(spark, sf).where(F.col("Value").isNotNull())
    b = tb.weekly_org(spark, sf).where(F.col("Value").isNotNull()).withColumnRenamed("Value", "Other")
    return rounded(pattern.align_union(a, b))


@query("transferred_pattern", "SELECT f.Date, f.Station, f.Feature, round(f.v, 6) + 0.0 AS Value, m.missing, "
       "round(CASE WHEN NOT m.missing THEN f.v END, 6) + 0.0 AS Value_missing FROM (SELECT *, " + tb.blend_sql("Value") + " AS v FROM near_ref) f "
       "LEFT JOIN full_mask m ON m.Date = f.Date AND m.Station = f.Station AND m.Feature = f.Feature",
       near_ref=tb.neighbours_sql("weekly", "Value"), **ALL)
def transferred_pattern(spark, sf):
    """The panel with known values takes over the other panel's gaps, absent sensors included."""
    org, ref = tb.as_table(tb.weekly_org(spark, sf)), tb.as_table(tb.weekly(spark, sf))
    return rounded(pattern.transfer_pattern(org, ref)[1])


@query("transferred_mask", "SELECT Date, Station, Feature, missing FROM full_mask", **ALL)
def transferred_mask(spark, sf):
    org, ref = tb.as_table(tb.weekly_org(spark, sf)), tb.as_table(tb.weekly(spark, sf))
    return pattern.transfer_pattern(org, ref)[0]


@query("aligned_to_truth", "SELECT k.method, p.Date, p.Station, p.Feature, round(p.Value, 6) + 0.0 AS truth, round(m.Value, 6) + 0.0 AS fill FROM prepared p "
       "CROSS JOIN (SELECT DISTINCT method FROM fills) k LEFT JOIN (SELECT * FROM fills WHERE Date < TIMESTAMP '2000-01-01') m "
       "ON m.method = k.method AND m.Date = p.Date AND m.Station = p.Station AND m.Feature = p.Feature")
def aligned_to_truth(spark, sf):
    p = tb.working_set(spark, sf)
    m = stored(fill.run_methods(p).where("Date < '2000-01-01'"), "fills")
    return rounded(score.align_to_truth(p, m))


@query("hidden_cells_joined", f"SELECT method, Date, Station, Feature, {r('truth')}, {r('fill')} FROM cells")
def hidden_cells_joined(spark, sf):
    p = tb.working_set(spark, sf)
    return rounded(score.score_cells(p, fill.run_methods(p, with_truth=True, mark_hidden=True)))


@query("unmatched_series", "SELECT method, s.Station, s.Feature, 'imputed' AS lacking_from FROM (SELECT DISTINCT Station, Feature FROM weekly) s "
       "CROSS JOIN (SELECT unnest(['a', 'b']) AS method) k WHERE NOT EXISTS (SELECT 1 FROM org_raw o WHERE o.Station = s.Station AND o.Feature = s.Feature "
       "AND (method = 'a' OR o.Feature <> 'Wind_direction')) UNION ALL "
       "SELECT NULL, Station, Feature, 'mask' FROM (SELECT DISTINCT Station, Feature FROM weekly) s WHERE NOT EXISTS "
       "(SELECT 1 FROM org_raw o WHERE o.Station = s.Station AND o.Feature = s.Feature)")
def unmatched_series(spark, sf):
    org = tb.weekly_org(spark, sf)
    m = org.withColumn("method", F.explode(F.array(F.lit("a"), F.lit("b"))))
    m = m.where((F.col("method") == "a") | (F.col("Feature") != "Wind_direction"))
    return score.unmatched_series(tb.weekly(spark, sf), m, org)


@query("panels_united", f"SELECT Date, Station, Feature, {V} FROM weekly UNION ALL SELECT Date, Station, Feature, {V} FROM hourly_raw")
def panels_united(spark, sf):
    return rounded(fill.union_panels(tb.weekly(spark, sf), tb.hourly_raw(spark, sf)))


@query("distinct_series", "SELECT DISTINCT Station, Feature FROM weekly_org")
def distinct_series(spark, sf):
    return gaps.distinct_keys(tb.weekly_org(spark, sf))


@query("key_counts", "SELECT count(DISTINCT Station) AS n_stations, count(DISTINCT Feature) AS n_features, "
       "count(DISTINCT Station || ':' || Feature) AS n_series FROM hourly_raw")
def key_counts(spark, sf):
    return gaps.key_counts(tb.hourly_raw(spark, sf))


@query("date_range", "SELECT min(Date) AS min_date, max(Date) AS max_date FROM weekly")
def date_range(spark, sf):
    return gaps.date_range(tb.weekly(spark, sf))


@query("dates_described", "SELECT x[1 + floor((n - 1) * 0.25 + 0.5)::BIGINT] AS q25, x[1 + floor((n - 1) * 0.5 + 0.5)::BIGINT] AS q50, "
       "x[1 + floor((n - 1) * 0.75 + 0.5)::BIGINT] AS q75, x[1] AS min_date, x[n] AS max_date, n, 0::BIGINT AS n_null "
       "FROM (SELECT list(l_shipdate ORDER BY l_shipdate) AS x, count(*) AS n FROM lineitem)")
def dates_described(spark, sf):
    return gaps.describe_dates(tb.readings(spark, sf), span_days=100)
