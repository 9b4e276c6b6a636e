"""Queries: gaps, fixed windows, deliberate masks, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelfill.functions.keys import CELL, SERIES
from panelfill.operators import gaps, masks, windows
from panelfill.plans import testbed as tb
from panelfill.plans.catalog import query, r, rounded

V = r("Value")
VM = r("Value_missing")
ORDER = "PARTITION BY Station, Feature ORDER BY Date"


@query("interior_interpolated", f"SELECT Date, Station, Feature, round({tb.blend_sql('Value')}, 6) + 0.0 AS Value FROM n",
       n=tb.neighbours_sql("weekly", "Value"))
def interior_interpolated(spark, sf):
    return rounded(gaps.interpolate_interior(tb.weekly(spark, sf)))


BLOCKS = {"blocks": "SELECT Station, Feature, pd AS after, Date AS before, pos - pp - 1 AS block_size FROM ("
                    f"SELECT *, lag(pos) OVER ({ORDER}) AS pp, lag(Date) OVER ({ORDER}) AS pd FROM ("
                    f"SELECT *, row_number() OVER ({ORDER}) AS pos FROM daily) WHERE Value IS NOT NULL) WHERE pos - pp > 1"}


@query("gap_blocks", "SELECT Station, Feature, after, before, block_size FROM blocks", **BLOCKS)
def gap_blocks(spark, sf):
    return gaps.gap_blocks(tb.daily_table(spark, sf))


@query("gap_report", "SELECT s.Station, s.Feature, s.missing_values, coalesce(b.missing_blocks, 0) AS missing_blocks, "
       "coalesce(b.longest_block, 0) AS longest_block, coalesce(b.missing_in_blocks, 0) AS missing_in_blocks, coalesce(b.n_sizes, 0) AS n_sizes "
       "FROM (SELECT Station, Feature, count(*) FILTER (Value IS NULL) AS missing_values FROM daily GROUP BY ALL) s LEFT JOIN "
       "(SELECT Station, Feature, count(*) AS missing_blocks, max(block_size) AS longest_block, sum(block_size)::BIGINT AS missing_in_blocks, "
       "count(DISTINCT block_size) AS n_sizes FROM blocks GROUP BY ALL) b ON b.Station = s.Station AND b.Feature = s.Feature", **BLOCKS)
def gap_report(spark, sf):
    rep = gaps.gap_report(tb.daily_table(spark, sf))
    return rep.withColumn("n_sizes", F.coalesce(F.size("block_sizes"), F.lit(0)).cast("bigint")).drop("block_sizes")


@query("missing_rates", f"SELECT Station, Feature, n_missing_values, n_total_values, {r('missing_rate')} FROM rates")
def missing_rates(spark, sf):
    return rounded(gaps.missing_rate(tb.prepared(spark, sf)))


@query("null_counts", "SELECT Station, Feature, count(*) FILTER (Value IS NULL) AS missing_values FROM weekly GROUP BY ALL")
def null_counts(spark, sf):
    return gaps.null_counts(tb.weekly(spark, sf))


@query("valid_span", "SELECT Station, Feature, min(Date) FILTER (Value IS NOT NULL) AS first_valid, max(Date) FILTER (Value IS NOT NULL) AS last_valid "
       "FROM weekly_org GROUP BY ALL")
def valid_span(spark, sf):
    return gaps.valid_span(tb.weekly_org(spark, sf))


NUMBERED = {"numbered": f"SELECT *, row_number() OVER ({ORDER}) - 1 AS i, count(*) OVER (PARTITION BY Station, Feature) AS n FROM daily"}


@query("windows_full", f"SELECT Date, Station, Feature, {V}, i // 96 AS window_id, (i % 96)::INT AS step FROM numbered WHERE i // 96 < n // 96", **NUMBERED)
def windows_full(spark, sf):
    return rounded(windows.windowed(tb.daily_table(spark, sf)))


PADDED = {"padded": "SELECT Date, Station, Feature, Value, i // 96 AS window_id, (i % 96)::INT AS step, false AS is_pad FROM numbered UNION ALL "
                    "SELECT NULL, Station, Feature, NULL, n // 96, unnest(range(n % 96, 96))::INT, true FROM "
                    "(SELECT DISTINCT Station, Feature, n FROM numbered) WHERE n % 96 <> 0"}


@query("windows_padded", f"SELECT Date, Station, Feature, {V}, window_id, step, is_pad FROM padded", **NUMBERED, **PADDED)
def windows_padded(spark, sf):
    return rounded(windows.windowed(tb.daily_table(spark, sf), tail="pad"))


@query("padding_removed", f"SELECT Date, Station, Feature, {V}, i // 96 AS window_id, (i % 96)::INT AS step FROM numbered", **NUMBERED)
def padding_removed(spark, sf):
    return rounded(windows.drop_padding(windows.windowed(tb.daily_table(spark, sf), tail="pad")))


@query("windows_packed", "SELECT Station, Feature, i // 96 AS window_id, count(*) AS n_steps, count(Value) AS n_seen, round(first(Value ORDER BY i), 6) + 0.0 AS first_value, "
       "round(last(Value ORDER BY i), 6) + 0.0 AS last_value FROM numbered WHERE i // 96 < n // 96 GROUP BY ALL", **NUMBERED)
def windows_packed(spark, sf):
    w = windows.pack_windows(windows.windowed(tb.daily_table(spark, sf)))
    return rounded(w.select(*SERIES, "window_id", F.size("values").cast("bigint").alias("n_steps"),
                            F.size(F.array_compact("values")).cast("bigint").alias("n_seen"),
                            F.col("values")[0].alias("first_value"), F.element_at("values", -1).alias("last_value")))


@query("window_tensor", "SELECT i // 96 AS window_id, 96::BIGINT AS n_steps, count(*) // 96 AS n_series, count(Value) AS n_seen FROM numbered "
       "WHERE i // 96 < n // 96 GROUP BY ALL", **NUMBERED)
def window_tensor(spark, sf):
    t = windows.pack_tensor(windows.windowed(tb.daily_table(spark, sf)))
    return t.select("window_id", F.size("X").cast("bigint").alias("n_steps"), F.size(F.col("X")[0]).cast("bigint").alias("n_series"),
                    F.size(F.array_compact(F.flatten("X"))).cast("bigint").alias("n_seen"))


@query("windows_split", "SELECT window_id, CASE WHEN window_id < floor(m * 0.7) THEN 'train' WHEN window_id < floor(m * 0.85) THEN 'val' ELSE 'test' END AS split, "
       "count(*) AS cells FROM (SELECT *, i // 96 AS window_id, n // 96 AS m FROM numbered WHERE i // 96 < n // 96) GROUP BY ALL", **NUMBERED)
def windows_split(spark, sf):
    w = windows.chrono_split(windows.windowed(tb.daily_table(spark, sf)))
    return w.groupBy("window_id", "split").agg(F.count(F.lit(1)).alias("cells"))


@query("last_points", f"SELECT Date, Station, Feature, {V} FROM daily WHERE Date IN (SELECT DISTINCT Date FROM daily ORDER BY Date DESC LIMIT 365)")
def last_points(spark, sf):
    return rounded(masks.last_points(tb.daily(spark, sf), "1d", dates=tb.daily_dates(spark, sf)))


@query("first_rows", f"SELECT Date, Station, Feature, {V} FROM daily WHERE Date IN (SELECT DISTINCT Date FROM daily ORDER BY Date LIMIT 1000)")
def first_rows(spark, sf):
    return rounded(masks.head_rows(tb.daily(spark, sf), 1000, tb.daily_dates(spark, sf)))


@query("every_24th", f"SELECT Date, Station, Feature, {V} FROM (SELECT *, row_number() OVER ({ORDER}) AS i FROM hourly) WHERE i % 24 = 1")
def every_24th(spark, sf):
    return rounded(masks.every_kth(tb.hourly(spark, sf), 24))


@query("picked_series", f"SELECT Feature, Station, {r('missing_rate')} FROM (SELECT *, row_number() OVER (PARTITION BY Feature ORDER BY missing_rate DESC, Station) AS k "
       "FROM rates WHERE missing_rate BETWEEN 0.05 AND 0.4) WHERE k = 1")
def picked_series(spark, sf):
    return rounded(masks.pick_series(gaps.missing_rate(tb.prepared(spark, sf))))


@query("tuning_target", "SELECT Station, Feature FROM prepared GROUP BY ALL ORDER BY count(*) FILTER (Value_missing IS NULL) = 0, Station, Feature LIMIT 1")
def tuning_target(spark, sf):
    return masks.tuning_target(tb.prepared(spark, sf))


@query("sample_split", "SELECT l_orderkey, l_linenumber, k <= n - ceil(round(n * 0.2, 9)) AS is_train FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '43', "
       "l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR))) AS k, count(*) OVER () AS n FROM (SELECT * FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) ORDER BY "
       "md5(concat_ws('|', '42', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR)) LIMIT 5000))")
def sample_split(spark, sf):
    rows = tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return masks.sample_split(rows, 5000, 0.8, 42, key=("l_orderkey", "l_linenumber", "l_partkey")).drop("l_partkey")


@query("points_masked", f"SELECT Date, Station, Feature, {V}, missing, {VM} FROM prepared")
def points_masked(spark, sf):
    return rounded(tb.prepared(spark, sf))


@query("share_masked_per_series", f"SELECT Date, Station, Feature, {V}, missing, {VM} FROM hidden",
       hidden=tb.hidden_sql("(SELECT *, row_number() OVER (PARTITION BY Station, Feature ORDER BY Value IS NULL, md5(concat_ws('|', '42', Station, Feature, Date::VARCHAR))) AS k, "
                            "count(Value) OVER (PARTITION BY Station, Feature) AS n FROM weekly)", "k <= greatest(1, floor(0.1 * n))"))
def share_masked_per_series(spark, sf):
    return rounded(masks.mask_per_series(tb.as_table(tb.weekly(spark, sf)), 0.1, 42))


@query("blocks_masked", f"SELECT rate, Date, Station, Feature, {V}, missing, {VM} FROM hidden",
       hidden=tb.hidden_sql("(SELECT w.*, k.rate, " + tb.draw_sql(42, "Station", "Feature", "block") + " AS u FROM (SELECT *, (row_number() OVER "
                            f"({ORDER}) - 1) // CASE WHEN count(*) OVER (PARTITION BY Station, Feature) < 250 THEN 2 ELSE 10 END AS block FROM weekly) w "
                            "CROSS JOIN (SELECT unnest([0.05, 0.1, 0.2, 0.4, 0.6, 0.8])::DOUBLE AS rate) k)", "u < rate"))
def blocks_masked(spark, sf):
    return rounded(masks.mask_blocks(tb.weekly(spark, sf)))


@query("indicating_mask", "SELECT Date, Station, Feature, (Value_missing IS NULL) <> (Value IS NULL) AS indicating FROM prepared")
def indicating_mask(spark, sf):
    p = tb.prepared(spark, sf)
    return masks.indicating_mask(p.select(*CELL, F.col("Value_missing").alias("Value")), p)


@query("masked_mae", f"SELECT f.method, {r('avg(abs(coalesce(f.Value, 0) - coalesce(p.Value, 0)))', 'masked_mae')} FROM fills f JOIN prepared p ON p.Date = f.Date "
       "AND p.Station = f.Station AND p.Feature = f.Feature WHERE (p.Value_missing IS NULL) <> (p.Value IS NULL) GROUP BY f.method")
def masked_mae(spark, sf):
    from panelfill.operators.fill import run_methods
    p = tb.working_set(spark, sf)
    mask = masks.indicating_mask(p.select(*CELL, F.col("Value_missing").alias("Value")), p)
    return rounded(masks.masked_mae(run_methods(p), p, mask, keys=["method"]))
