"""Queries: data-quality checks on the given tables and derived panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelfill.operators import quality
from panelfill.plans import testbed as tb
from panelfill.plans.catalog import query, r, rounded
from panelfill.sources import panel_io
from panelfill.sources.storage import scratch_path

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"]
NUM = LINE[:8]


def _column_sql(table: str, column: str, numeric: bool, position: int, text: bool = False) -> str:
    if numeric:
        return (f"SELECT {position}::INT AS position, '{column}' AS \"column\", true AS is_numeric, false AS is_text, count(*) AS n_rows, count(*) - count({column}) AS n_missing, "
                f"count(*) FILTER (isinf({column}::DOUBLE)) AS n_inf, NULL::BIGINT AS n_numeric_text, "
                f"(SELECT count(*) FROM {table}, (SELECT avg({column}) AS a, stddev_samp({column}) AS s FROM {table}) WHERE abs({column} - a) > 5 * s) AS n_outliers, "
                f"count({column}) AS n_valid, round(min({column})::DOUBLE, 6) + 0.0 AS min, round(max({column})::DOUBLE, 6) + 0.0 AS max FROM {table}")
    numbers = f"count(*) FILTER (TRY_CAST({column} AS DOUBLE) IS NOT NULL)" if text else "NULL::BIGINT"
    return (f"SELECT {position}::INT, '{column}', false, {str(text).lower()}, count(*), count(*) - count({column}), NULL::BIGINT, {numbers}, NULL::BIGINT, "
            f"count({column}), NULL::DOUBLE, NULL::DOUBLE FROM {table}")


@query("column_statistics", " UNION ALL ".join(
    _column_sql("lineitem", c, c in NUM, i, c in ("l_returnflag", "l_linestatus")) for i, c in enumerate(LINE)))
def column_statistics(spark, sf):
    return rounded(quality.column_stats(tb.table(spark, sf, "lineitem").select(*LINE)))


def _finding(check: str, column: str, level: str, observed: str, threshold: str = "NULL") -> str:
    name = f"'{column}'" if column else "NULL"
    observed = observed if "(" in observed and not observed.startswith("round(") or "count" in observed else f"max({observed})"
    return (f"SELECT '{check}' AS \"check\", {name} AS \"column\", '{level}' AS level, round(({observed})::DOUBLE, 6) + 0.0 AS observed, "
            f"({threshold})::DOUBLE AS threshold FROM t")


_PANEL_CHECKS = " UNION ALL ".join([
    _finding("column_count", "", "summary", "3"),
    _finding("numeric_ratio", "", "summary", "round(1 / 3, 3)"),
    _finding("numeric_ratio", "", "warning", "1 / 3", "0.8"),
    _finding("row_count", "", "summary", "count(*)"),
    _finding("missing_cells", "", "summary", "count(*) - count(Value)"),
    _finding("missing_percentage", "", "summary", "round((count(*) - count(Value)) / (count(*) * 3) * 100, 2)"),
    _finding("max_column_missing_pct", "", "summary", "round((count(*) - count(Value)) / count(*) * 100, 2)"),
    _finding("min", "Value", "summary", "min(Value)"),
    _finding("max", "Value", "summary", "max(Value)"),
    _finding("range", "Value", "summary", "max(Value) - min(Value)"),
    _finding("duplicate_index", "Date", "summary", "count(*) - count(DISTINCT Date)"),
    _finding("duplicate_index", "Date", "warning", "count(*) - count(DISTINCT Date)", "0"),
    _finding("mostly_empty_column", "Value", "warning", "round((count(*) - count(Value)) / count(*) * 100, 2)", "90") + " HAVING count(*) - count(Value) > count(*) * 0.9",
    _finding("outliers", "Value", "warning", "count(*) FILTER (abs(Value - a) > 5 * s)", "5") + ", (SELECT avg(Value) AS a, stddev_samp(Value) AS s FROM t) "
    "HAVING count(*) FILTER (abs(Value - a) > 5 * s) > 0",
])


@query("panel_validated", f"SELECT 'hourly' AS dataset, * FROM ({_PANEL_CHECKS})", t="SELECT * FROM hourly")
def panel_validated(spark, sf):
    return rounded(quality.validate(tb.as_table(tb.hourly(spark, sf)), "hourly", index="Date").drop("message"))


_EVENT_CHECKS = " UNION ALL ".join([
    _finding("column_count", "", "summary", "4"),
    _finding("numeric_ratio", "", "summary", "round(2 / 4, 3)"),
    _finding("numeric_ratio", "", "warning", "2 / 4", "0.8"),
    _finding("row_count", "", "summary", "count(*)"),
    _finding("missing_cells", "", "summary", "count(*) - count(gone)"),
    _finding("missing_percentage", "", "summary", "round((count(*) - count(gone)) / (count(*) * 4) * 100, 2)"),
    _finding("max_column_missing_pct", "", "summary", "round((count(*) - count(gone)) / count(*) * 100, 2)"),
    _finding("empty_column", "gone", "error", "count(*)"),
    _finding("mostly_empty_column", "gone", "warning", "100", "90"),
    _finding("infinite_values", "ratio", "error", "count(*) FILTER (isinf(ratio))", "0"),
    _finding("numeric_text", "text_id", "warning", "count(text_id)"),
    _finding("min", "value", "summary", "min(value)"),
    _finding("max", "value", "summary", "max(value)"),
    _finding("range", "value", "summary", "max(value) - min(value)"),
    _finding("outliers", "value", "warning", "count(*) FILTER (abs(value - a) > 5 * s)", "5") + ", (SELECT avg(value) AS a, stddev_samp(value) AS s FROM t) "
    "HAVING count(*) FILTER (abs(value - a) > 5 * s) > 0",
    _finding("min", "ratio", "summary", "min(ratio)"),
    _finding("max", "ratio", "summary", "max(ratio)"),
    _finding("range", "ratio", "summary", "max(ratio) - min(ratio)"),
    _finding("duplicate_index", "time_text", "summary", "count(*) - count(DISTINCT time_text)"),
    _finding("duplicate_index", "time_text", "warning", "count(*) - count(DISTINCT time_text)", "0") + " HAVING count(*) > count(DISTINCT time_text)",
    _finding("timestamp_parseable", "time_text", "summary", "0"),
    _finding("timestamp_parseable", "time_text", "warning", "count(*) FILTER (time_text = 'no date')", "0"),
])


@query("faulty_table_validated", f"SELECT 'faulty' AS dataset, * FROM ({_EVENT_CHECKS})",
       t="SELECT value, CASE WHEN event_type = 'click' THEN 'infinity'::DOUBLE ELSE value END AS ratio, event_id::VARCHAR AS text_id, NULL::VARCHAR AS gone, "
         "CASE WHEN event_type = 'view' THEN 'no date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time_text FROM events")
def faulty_table_validated(spark, sf):
    """Events with faults put in: infinities, an empty column, numbers as text, stamps that are none."""
    ev = tb.table(spark, sf, "events")
    t = ev.select(
        "value", F.when(F.col("event_type") == "click", F.lit(float("inf"))).otherwise(F.col("value")).alias("ratio"),
        F.col("event_id").cast("string").alias("text_id"), F.lit(None).cast("string").alias("gone"),
        F.when(F.col("event_type") == "view", "no date").otherwise(F.substring(F.col("ts").cast("string"), 1, 19)).alias("time_text"))
    return rounded(quality.validate(t, "faulty", index="time_text").drop("message"))


@query("duplicate_keys", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem)) AS n_duplicates FROM lineitem")
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(tb.table(spark, sf, "lineitem"), ["l_orderkey"])


def _all_results(spark, sf):
    tables = {"weekly": tb.as_table(tb.weekly(spark, sf)), "weekly_org": tb.as_table(tb.weekly_org(spark, sf)),
              "region": tb.table(spark, sf, "region"), "supplier": tb.table(spark, sf, "supplier")}
    return quality.validate_all(tables, index="Date")


_REPORT = (
    "SELECT 'weekly' AS dataset, 1::BIGINT AS n_datasets, 1::BIGINT AS n_valid, 0::BIGINT AS n_errors, (SELECT 2 + (n_out > 0)::INT + (rate > 0.9)::INT FROM f WHERE d = 'weekly')::BIGINT AS n_warnings, true AS is_valid "
    "UNION ALL SELECT 'weekly_org', 1, 1, 0, (SELECT 2 + (n_out > 0)::INT + (rate > 0.9)::INT FROM f WHERE d = 'weekly_org'), true "
    "UNION ALL SELECT 'region', 1, (count(*) >= 10)::INT, (count(*) < 10)::INT, 1, count(*) >= 10 FROM region "
    "UNION ALL SELECT 'supplier', 1, 1, 0, 1 + (SELECT (count(*) > 0)::INT FROM supplier, (SELECT avg(s_acctbal) AS a, stddev_samp(s_acctbal) AS s FROM supplier) WHERE abs(s_acctbal - a) > 5 * s), true")


@query("validation_report", "SELECT * FROM report UNION ALL SELECT NULL, sum(n_datasets), sum(n_valid), sum(n_errors), sum(n_warnings), sum(n_errors) = 0 FROM report",
       f="SELECT 'weekly' AS d, count(*) FILTER (abs(Value - a) > 5 * s) AS n_out, 1 - count(Value) / count(*) AS rate FROM weekly, (SELECT avg(Value) AS a, stddev_samp(Value) AS s FROM weekly) "
         "UNION ALL SELECT 'weekly_org', count(*) FILTER (abs(Value - a) > 5 * s), 1 - count(Value) / count(*) FROM weekly_org, (SELECT avg(Value) AS a, stddev_samp(Value) AS s FROM weekly_org)",
       report=_REPORT)
def validation_report(spark, sf):
    return quality.validation_report(_all_results(spark, sf))


@query("stage_gate", "SELECT 'supplier' AS dataset, true AS may_run UNION ALL SELECT 'region', count(*) >= 10 FROM region")
def stage_gate(spark, sf):
    rows = [(n, quality.gate(quality.validate(tb.table(spark, sf, n), n))) for n in ("supplier", "region")]
    return spark.createDataFrame(rows, "dataset string, may_run boolean")


def _columns_of(table: str, key: str, columns: dict[str, bool]) -> str:
    """What the folder checks find in a written table: its shape, its key, and the range of each numeric column."""
    share = f"{sum(columns.values())} / {len(columns)}"
    one = lambda check, column, level, observed, threshold="NULL": (
        f"SELECT '{check}' AS \"check\", {column} AS \"column\", '{level}' AS level, round(({observed})::DOUBLE, 6) + 0.0 AS observed, ({threshold})::DOUBLE AS threshold FROM {table}")
    found = [one("column_count", "NULL", "summary", f"max({len(columns)})"), one("numeric_ratio", "NULL", "summary", f"max(round({share}, 3))"),
             one("row_count", "NULL", "summary", "count(*)"), one("duplicate_index", f"'{key}'", "summary", f"count(*) - count(DISTINCT {key})"),
             *[one(c, "NULL", "summary", "max(0)") for c in ("missing_cells", "missing_percentage", "max_column_missing_pct")]]
    if sum(columns.values()) < 0.8 * len(columns):
        found.append(one("numeric_ratio", "NULL", "warning", f"max({share})", "0.8"))
    for c, numeric in columns.items():
        if numeric:
            found += [one("min", f"'{c}'", "summary", f"min({c})"), one("max", f"'{c}'", "summary", f"max({c})"), one("range", f"'{c}'", "summary", f"max({c}) - min({c})")]
    return " UNION ALL ".join(found)


@query("folder_validated", " UNION ALL ".join([
    _columns_of("supplier", "s_suppkey", {"s_name": False, "s_nationkey": True, "s_acctbal": True}),
    _columns_of("customer", "c_custkey", {"c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False}),
    _columns_of("part", "p_partkey", {"p_name": False, "p_brand": False, "p_type": False, "p_size": True, "p_retailprice": True})]))
def folder_validated(spark, sf):
    """Three tables written as files of one folder and checked together."""
    folder = scratch_path(spark, "checked-files")
    for name in ("supplier", "customer", "part"):
        tb.table(spark, sf, name).coalesce(1).write.mode("append").option("header", True).csv(folder)
    found = panel_io.validate_folder(spark, folder)
    return rounded(found.where("`check` <> 'file_size_mb'").select("check", "column", "level", "observed", "threshold"))
