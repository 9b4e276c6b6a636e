"""Data-quality checks. All column statistics of a table come from one aggregate (two with outliers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Default thresholds.
DEFAULTS = {
    "max_missing_percentage": 95.0,
    "high_missing_percentage": 50.0,
    "mostly_missing_ratio": 0.9,
    "min_valid_samples": 10,
    "max_file_size_mb": 500,
    "required_numeric_ratio": 0.8,
    "outlier_std_threshold": 5.0,
    "min_features": 1,
    "max_features": 100,
    "timestamp_formats": ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy"],
}

RESULT = ("dataset string, `check` string, `column` string, level string, "
          "observed double, threshold double, message string")


def _is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _empty(c: Column, t: T.DataType) -> Column:
    return c.isNull() | F.isnan(c) if isinstance(t, (T.DoubleType, T.FloatType)) else c.isNull()


def _is_inf(c: Column, t: T.DataType) -> Column:
    return F.abs(c) == float("inf") if isinstance(t, (T.DoubleType, T.FloatType)) else F.lit(False)


def _parses_as_time(c: Column, formats) -> Column:
    return F.coalesce(c.try_cast("timestamp"), *[F.try_to_timestamp(c, F.lit(f)) for f in formats]).isNotNull()


def column_stats(df: DataFrame, config: dict | None = None, outliers: bool = True) -> DataFrame:
    """One row per column: is_numeric, is_text, n_rows, n_missing, n_inf, n_numeric_text, n_outliers, n_valid, min, max.

    Every column of the table goes into the same scan. Outliers need mean and deviation first and take a second one.
    """
    cfg = {**DEFAULTS, **(config or {})}
    fields = [(f.name, f.dataType) for f in df.schema.fields]
    numeric = [n for n, t in fields if _is_numeric(t)]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, (name, t) in enumerate(fields):
        c = F.col(f"`{name}`")
        empty = _empty(c, t)
        aggs.append(F.count_if(empty).alias(f"miss_{i}"))
        if _is_numeric(t):
            d = F.when(~empty, c.cast("double"))
            fin = F.when(~_is_inf(c, t), d)
            aggs += [F.count_if(_is_inf(c, t)).alias(f"inf_{i}"), F.min(d).alias(f"min_{i}"), F.max(d).alias(f"max_{i}")]
            if outliers:
                # An infinite value leaves mean and deviation undefined, so nothing counts as an outlier then.
                has_inf = F.max(F.coalesce(_is_inf(c, t), F.lit(False)))
                aggs += [F.when(~has_inf, F.avg(fin)).alias(f"avg_{i}"), F.when(~has_inf, F.stddev_samp(fin)).alias(f"std_{i}")]
        elif isinstance(t, T.StringType):
            aggs.append(F.count_if(c.try_cast("double").isNotNull()).alias(f"num_{i}"))
    stats = df.agg(*aggs)
    if outliers and numeric:
        # The one-row statistics go back to the rows as a scalar, not as a join.
        packed = stats.select(F.struct(*[c for c in stats.columns if c.startswith(("avg_", "std_"))]).alias("s")).scalar()
        found = df.withColumn("_s", packed).agg(*[
            F.count_if(F.abs(F.col(f"`{n}`").cast("double") - F.col(f"_s.avg_{i}"))
                       > F.col(f"_s.std_{i}") * cfg["outlier_std_threshold"]).alias(f"out_{i}")
            for i, (n, t) in enumerate(fields) if _is_numeric(t)])
        stats = stats.withColumn("_o", found.select(F.struct("*").alias("o")).scalar()).select("*", "_o.*").drop("_o")
    have = set(stats.columns)

    def pick(prefix, i, kind):
        return F.col(f"{prefix}_{i}").cast(kind) if f"{prefix}_{i}" in have else F.lit(None).cast(kind)

    rows = [F.struct(
        F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(_is_numeric(t)).alias("is_numeric"),
        F.lit(isinstance(t, T.StringType)).alias("is_text"), F.col("n_rows"),
        pick("miss", i, "bigint").alias("n_missing"), pick("inf", i, "bigint").alias("n_inf"),
        pick("num", i, "bigint").alias("n_numeric_text"), pick("out", i, "bigint").alias("n_outliers"),
        (F.col("n_rows") - pick("miss", i, "bigint")).alias("n_valid"),
        pick("min", i, "double").alias("min"), pick("max", i, "double").alias("max"))
        for i, (name, t) in enumerate(fields)]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*") if rows else stats.limit(0)


def schema_findings(columns: list[str], numeric: int, config: dict) -> list[tuple]:
    """Checks that need only the schema: (check, column, level, observed, threshold, message)."""
    n = len(columns)
    out = [("column_count", None, "summary", float(n), None, f"{n} columns")]
    if n < config["min_features"]:
        out.append(("column_count", None, "error", float(n), float(config["min_features"]), f"too few features: {n}"))
    if n > config["max_features"]:
        out.append(("column_count", None, "warning", float(n), float(config["max_features"]), f"many features: {n}"))
    for c in columns:
        if not c.strip():
            out.append(("column_name", c, "warning", None, None, "empty column name"))
        elif c.startswith("Unnamed:"):
            out.append(("column_name", c, "warning", None, None, f"unnamed column: {c}"))
    for c in sorted({c for c in columns if columns.count(c) > 1}):
        out.append(("duplicate_column", c, "error", float(columns.count(c)), 1.0, f"duplicate column name: {c}"))
    ratio = numeric / n if n else 0.0
    out.append(("numeric_ratio", None, "summary", round(ratio, 3), None, f"{numeric} of {n} columns are numeric"))
    if ratio < config["required_numeric_ratio"]:
        out.append(("numeric_ratio", None, "warning", ratio, float(config["required_numeric_ratio"]),
                    f"low numeric ratio: {ratio:.1%}"))
    if not numeric:
        out.append(("numeric_columns", None, "warning", 0.0, None, "no numeric columns found for quality analysis"))
    return out


def _finding(check, column, level, observed, threshold, message) -> Column:
    return F.struct(F.lit(check).alias("check"), column.cast("string").alias("column"), F.lit(level).alias("level"),
                    observed.cast("double").alias("observed"), F.lit(threshold).cast("double").alias("threshold"),
                    message.alias("message"))


def _findings(rules: list[tuple]) -> Column:
    """Rows (condition, finding) -> array of the findings whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, f) for cond, f in rules]))


def validate(df: DataFrame, name: str, index: str | None = None, config: dict | None = None) -> DataFrame:
    """Long result (dataset, check, column, level, observed, threshold, message).

    ``index`` names the key column that is checked for repeats and, if its name mentions time, for being parseable;
    like a frame's index it does not count as a data column. Levels are 'error', 'warning' and 'summary'.
    """
    cfg = {**DEFAULTS, **(config or {})}
    columns = [c for c in df.columns if c != index]
    spark = df.sparkSession
    fixed = schema_findings(columns, sum(_is_numeric(f.dataType) for f in df.schema.fields if f.name != index), cfg)
    parts = [spark.createDataFrame([(name, *f) for f in fixed], RESULT)]
    if len(set(columns)) == len(columns) and columns:
        parts.append(_data_findings(df.select(*[F.col(f"`{c}`") for c in columns]), name, cfg))
    if index:
        parts.append(_index_findings(df, name, index, cfg))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _data_findings(df: DataFrame, name: str, cfg: dict) -> DataFrame:
    return column_findings(column_stats(df, cfg).withColumn("dataset", F.lit(name)), cfg)


def column_findings(stats: DataFrame, cfg: dict) -> DataFrame:
    """Findings of any number of data sets from their column statistics."""
    n, miss = F.col("n_rows"), F.col("n_missing")
    col = F.col("column")
    pct = miss / n * 100
    outlier_pct = F.round(F.try_divide(F.col("n_outliers"), F.col("n_valid")) * 100, 2)
    per_column = _findings([
        ((n > 0) & (miss == n), _finding("empty_column", col, "error", miss, None, F.concat(F.lit("completely empty column: "), col))),
        ((n > 0) & (miss > n * cfg["mostly_missing_ratio"]), _finding(
            "mostly_empty_column", col, "warning", F.round(pct, 2), 100 * cfg["mostly_missing_ratio"],
            F.concat(F.lit("mostly empty column: "), col))),
        (F.col("n_inf") > 0, _finding("infinite_values", col, "error", F.col("n_inf"), 0.0, F.concat(F.lit("infinite values in "), col))),
        (F.col("n_outliers") > 0, _finding("outliers", col, "warning", F.col("n_outliers"), cfg["outlier_std_threshold"],
                                          F.format_string("potential outliers in %s: %s%%", col, outlier_pct.cast("string")))),
        (F.col("is_text") & (F.col("n_valid") > 0) & (F.col("n_numeric_text") == F.col("n_valid")), _finding(
            "numeric_text", col, "warning", F.col("n_numeric_text"), None, F.concat(col, F.lit(" is text but holds only numbers")))),
        (F.col("min").isNotNull(), _finding("min", col, "summary", F.col("min"), None, F.lit("smallest value"))),
        (F.col("max").isNotNull(), _finding("max", col, "summary", F.col("max"), None, F.lit("largest value"))),
        (F.col("max").isNotNull(), _finding("range", col, "summary", F.col("max") - F.col("min"), None, F.lit("largest minus smallest value"))),
    ])
    # A few rows per column from here on.
    whole = stats.groupBy("dataset").agg(
        F.max("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"),
        (F.sum("n_missing") / F.nullif(F.sum("n_rows"), F.lit(0)) * 100).alias("pct"),
        F.max(F.try_divide(miss, n) * 100).alias("worst"))
    none = F.lit(None)
    share = F.coalesce("pct", F.lit(0.0))
    overall = _findings([
        (F.lit(True), _finding("row_count", none, "summary", F.col("n_rows"), None, F.lit("rows"))),
        (F.col("n_rows") < cfg["min_valid_samples"], _finding(
            "row_count", none, "error", F.col("n_rows"), cfg["min_valid_samples"], F.lit("too few samples"))),
        (F.lit(True), _finding("missing_cells", none, "summary", F.col("n_missing"), None, F.lit("missing cells"))),
        (F.lit(True), _finding("missing_percentage", none, "summary", F.round(share, 2), None, F.lit("missing cells in percent"))),
        (share > cfg["max_missing_percentage"], _finding(
            "missing_percentage", none, "error", F.round(share, 2), cfg["max_missing_percentage"], F.lit("too much missing data"))),
        ((share <= cfg["max_missing_percentage"]) & (share > cfg["high_missing_percentage"]), _finding(
            "missing_percentage", none, "warning", F.round(share, 2), cfg["high_missing_percentage"], F.lit("high missing data"))),
        (F.lit(True), _finding("max_column_missing_pct", none, "summary", F.round(F.coalesce("worst", F.lit(0.0)), 2), None,
                               F.lit("missing cells of the emptiest column in percent"))),
    ])
    found = stats.select("dataset", F.explode(per_column).alias("f")).unionByName(whole.select("dataset", F.explode(overall).alias("f")))
    return found.select("dataset", "f.*")


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Rows beyond the first of each key (null is a key too), without a distinct count in one task."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def _index_findings(df: DataFrame, name: str, index: str, cfg: dict) -> DataFrame:
    none = F.lit(index)
    dup = duplicate_keys(df, [index])
    rules = [
        (F.lit(True), _finding("duplicate_index", none, "summary", F.col("n_duplicates"), None, F.lit("repeated index values"))),
        (F.col("n_duplicates") > 0, _finding("duplicate_index", none, "warning", F.col("n_duplicates"), 0.0, F.lit("repeated index values")))]
    found = dup.select(F.explode(_findings(rules)).alias("f"))
    if "time" in index.lower() and isinstance(df.schema[index].dataType, T.StringType):
        bad = df.agg(F.count_if(F.col(index).isNotNull() & ~_parses_as_time(F.col(index), cfg["timestamp_formats"])).alias("bad"))
        found = found.unionByName(bad.select(F.explode(_findings([
            (F.lit(True), _finding("timestamp_parseable", none, "summary", F.col("bad") == 0, None, F.lit("1 if every index value is a time stamp"))),
            (F.col("bad") > 0, _finding("timestamp_parseable", none, "warning", F.col("bad"), 0.0, F.lit("index values that are no time stamps"))),
        ])).alias("f")))
    return found.select(F.lit(name).alias("dataset"), "f.*")


def validate_all(tables: dict[str, DataFrame], index: str | None = None, config: dict | None = None) -> DataFrame:
    out = None
    for name, df in tables.items():
        r = validate(df, name, index if index in df.columns else None, config)
        out = r if out is None else out.unionByName(r)
    return out


def validation_report(results: DataFrame) -> DataFrame:
    """Per dataset: errors, warnings and validity; plus the total row (dataset null)."""
    n_err, n_warn = F.count_if(F.col("level") == "error"), F.count_if(F.col("level") == "warning")
    per = results.groupBy("dataset").agg(n_err.alias("n_errors"), n_warn.alias("n_warnings"))
    per = per.withColumn("is_valid", F.col("n_errors") == 0)
    total = per.agg(F.count(F.lit(1)).alias("n_datasets"), F.count_if("is_valid").alias("n_valid"),
                    F.sum("n_errors").alias("n_errors"), F.sum("n_warnings").alias("n_warnings"))
    rows = per.select("dataset", F.lit(1).cast("bigint").alias("n_datasets"), F.col("is_valid").cast("bigint").alias("n_valid"),
                      "n_errors", "n_warnings", "is_valid")
    return rows.unionByName(total.select(
        F.lit(None).cast("string").alias("dataset"), "n_datasets", "n_valid", "n_errors", "n_warnings",
        (F.col("n_errors") == 0).alias("is_valid")))


class InvalidInput(ValueError):
    """A stage's input did not pass its checks."""


def gate(results: DataFrame, stage: str | None = None) -> bool:
    """True if no error was found; with a stage name, an error stops the run instead."""
    errors = results.where(F.col("level") == "error")
    if errors.isEmpty():
        return True
    if stage is None:
        return False
    first = [f"{r['dataset']}: {r['message']}" for r in errors.orderBy("dataset", "check").take(3)]
    raise InvalidInput(f"stage {stage} must not run: " + "; ".join(first))
