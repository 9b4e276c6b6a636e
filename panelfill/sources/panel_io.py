"""Reading and writing panels, working sets, fills and scores."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelfill.functions.keys import (
    CALENDAR, CELL, PANEL_SCHEMA, PREPARED_SCHEMA, SCORE_COLUMNS, SCORE_SCHEMA, nan_to_null, unique_keys)
from panelfill.operators.clean import normalise_station, to_naive_utc
from panelfill.operators.rank import next_run_id
from panelfill.operators.reshape import to_long


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[tuple[str, int]]:
    """(path, bytes) of the files in a folder, on any file system Spark can reach; None if there is no folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(path)]
    return sorted((p, n) for p, n in found if p.endswith(suffix))


def read_feature_csvs(spark: SparkSession, folder: str) -> DataFrame:
    """One wide CSV per feature (file name = feature, first column = time stamp, one column per station) -> long panel.

    Only the header is looked at up front. A file without station columns adds no rows. Two headers with the same first word fail instead of mixing.
    """
    files = list_files(spark, folder)
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")
    panel = None
    for path, _ in files:
        feature = path.rsplit("/", 1)[-1][: -len(".csv")]
        wide = spark.read.option("header", True).csv(path)
        stations = wide.columns[1:]
        if not stations:
            continue
        short = [c.split(" ")[0] for c in stations]
        if len(set(short)) != len(short):
            raise ValueError(f"{path}: station names collide after the first blank")
        wide = wide.toDF("Date", *[f"s{i}" for i in range(len(stations))])
        values = [F.col(f"s{i}").try_cast("double").alias(c) for i, c in enumerate(stations)]
        long = wide.select("Date", *values).unpivot(["Date"], [f"`{c}`" for c in stations], "Station", "Value")
        long = normalise_station(to_naive_utc(long))
        long = long.select("Date", F.lit(feature).alias("Feature"), "Station", nan_to_null(F.col("Value")).alias("Value"))
        panel = long if panel is None else panel.unionByName(long)
    if panel is None:
        return spark.createDataFrame([], "Date timestamp_ntz, Feature string, Station string, Value double")
    return panel


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet", prepared: bool = False) -> DataFrame:
    """Long panel with a fixed schema; NaN is read as null."""
    schema = PREPARED_SCHEMA if prepared else PANEL_SCHEMA
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return df.withColumns({c: nan_to_null(F.col(c)) for c in ("Value", "Value_missing") if c in df.columns})


def write_panel(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_working_set(p: DataFrame, path: str, mode: str = "error") -> None:
    """Truth, gapped value and mask side by side, one folder per partition key (column part)."""
    p.write.mode(mode).partitionBy("part").parquet(path)


def read_working_set(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if part is None else df.where(F.col("part") == part)


def write_imputed(m: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per method; calendar fields do not go along. Adaptive execution sizes the files."""
    m.drop(*CALENDAR).select(*CELL, "Value", "method").write.mode(mode).partitionBy("method").parquet(path)


def read_imputed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(methods incl. 'original', truth, mask). The method filter prunes folders."""
    every = spark.read.schema("Date timestamp_ntz, Station string, Feature string, Value double, method string").parquet(path)
    truth = every.where(F.col("method") == "original").drop("method")
    mask = every.where(F.col("method") == "mask").select(*CELL, (F.col("Value") == 1).alias("missing"))
    return every.where(F.col("method") != "mask"), truth, mask


def discover_methods(spark: SparkSession, path: str) -> DataFrame:
    """Method folders with their role."""
    folders = spark.read.parquet(path).select(F.col("method").cast("string").alias("method")).distinct()
    role = F.when(F.col("method") == "original", "truth").when(F.col("method") == "mask", "mask").otherwise("method")
    return folders.withColumn("role", role)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    if list_files(spark, path, "") is None:
        return spark.createDataFrame([], SCORE_SCHEMA)
    return spark.read.schema(SCORE_SCHEMA).option("recursiveFileLookup", True).parquet(path)


def _claimed(spark: SparkSession, folder: str, first: int) -> int:
    """The first number from ``first`` on that nobody has claimed in the folder: its file is created, or fails to be if it
    is there. Cluster file systems do that in one step; for local folders Java's own call does."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    n = first
    while True:
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")
        if fs.getUri().getScheme() == "file":
            if jvm.java.io.File(target.toUri().getPath()).createNewFile():
                return n
        else:
            try:
                fs.create(target, False).close()
                return n
            except Py4JJavaError as e:
                if "AlreadyExists" not in str(e.java_exception):
                    raise
        n += 1


def append_scores(scores: DataFrame, path: str) -> int:
    """Add scores under the next free run id and return it. Writers at the same time get different ids, and each writes a
    folder of its own, so that no commit sweeps away another's files; a run that fails leaves its id unused."""
    spark = scores.sparkSession
    run = _claimed(spark, f"{path.rstrip('/')}_runs", next_run_id(read_scores(spark, path)))
    scores.withColumn("run", F.lit(run).cast("int")).select(*SCORE_COLUMNS).write.parquet(f"{path.rstrip('/')}/run-{run}")
    return run


def rewrite_run_metadata(spark: SparkSession, path: str, **metadata) -> str:
    """Set the metadata columns of a stored score table. The table as it was stays as a numbered backup, whose path is
    returned; it is complete before anything changes, and the new table is made from it."""
    backup = f"{path.rstrip('/')}_backup-{_claimed(spark, path.rstrip('/') + '_backups', 1)}"
    read_scores(spark, path).write.parquet(backup)
    backfill_run_metadata(read_scores(spark, backup), **metadata).select(*SCORE_COLUMNS).write.mode("overwrite").parquet(path)
    return backup


def backfill_run_metadata(s: DataFrame, scaling: bool = False, resample: bool = True, resample_freq: str = "1d") -> DataFrame:
    """Set the three metadata columns on every stored score. The caller writes to a new path, so the old table stays as backup."""
    return s.withColumns({"scaling": F.lit(scaling), "resample": F.lit(resample), "resample_freq": F.lit(resample_freq)})


def file_findings(spark: SparkSession, folder: str, suffix: str = ".csv", max_mb: float = 500) -> DataFrame:
    """Missing folder, no matching file, oversized files; in the result form of the quality checks."""
    from panelfill.operators.quality import RESULT
    files = list_files(spark, folder, suffix)
    rows = []
    if files is None:
        rows.append((folder, "folder", None, "error", None, None, f"folder does not exist: {folder}"))
    elif not files:
        rows.append((folder, "folder", None, "error", 0.0, 1.0, f"no files ending in {suffix}"))
    for path, size in files or []:
        mb = size / (1024 * 1024)
        rows.append((path, "file_size_mb", None, "summary", round(mb, 2), None, "file size in MB"))
        if mb > max_mb:
            rows.append((path, "file_size_mb", None, "warning", round(mb, 2), float(max_mb), "large file"))
    return spark.createDataFrame(rows, RESULT)


# A comma outside of quotes.
COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _csv_lines(spark: SparkSession, folder: str, suffix: str) -> tuple[DataFrame, DataFrame]:
    """(dataset, fields) of all data lines of a folder's files, and (dataset, names) of the headers: one text scan for
    all files, of any number and size. Quotes may hold commas, but no line breaks."""
    text = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder).where("trim(value) <> ''")
    lines = text.select(F.col("_metadata.file_path").alias("dataset"), F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_at"), "value")
    fields = F.transform(F.split("value", COMMA, -1), lambda f: F.regexp_replace(F.regexp_replace(f, '^\\s*"|"\\s*$', ""), '""', '"'))
    # A file's first line lies in its first block, at the smallest place there.
    heads = lines.where("_block = 0").groupBy("dataset").agg(F.min("_at").alias("_first"), F.min_by(fields, "_at").alias("names"))
    data = lines.join(heads.select("dataset", "_first"), "dataset").where(F.col("_at") != F.col("_first"))
    return data.select("dataset", fields.alias("fields")), heads.select("dataset", "names")


def _folder_stats(cells: DataFrame, threshold: float) -> DataFrame:
    """The column statistics of the table checks for every column of every file, from its cells in long form."""
    number = F.col("cell").try_cast("double")
    infinite = F.abs("_v") == float("inf")
    read = cells.withColumn("_v", F.when(~F.isnan(number), number))
    level = read.groupBy("dataset", "pos").agg(
        F.first("name").alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count("cell").alias("n_valid"), F.count("_v").alias("n_parsed"),
        F.count_if(infinite).alias("n_inf"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.avg("_v").alias("avg"), F.stddev_samp("_v").alias("std"))
    # A column is numeric if every value in it is a number, as readers infer it; an empty one is, too.
    level = level.withColumn("is_numeric", F.col("n_parsed") == F.col("n_valid"))
    far = (F.abs(F.col("_v") - F.col("avg")) > F.col("std") * threshold) & F.col("is_numeric") & (F.col("n_inf") == 0)
    outside = read.join(level.select("dataset", "pos", "avg", "std", "is_numeric", "n_inf"), ["dataset", "pos"]).groupBy("dataset", "pos").agg(
        F.count_if(far).alias("n_outliers"))
    own = lambda c: F.when(F.col("is_numeric"), F.col(c)).alias(c)
    return level.join(outside, ["dataset", "pos"]).select(
        "dataset", "column", "is_numeric", (~F.col("is_numeric")).alias("is_text"), "n_rows", (F.col("n_rows") - F.col("n_valid")).alias("n_missing"),
        own("n_inf"), F.when(~F.col("is_numeric"), F.col("n_parsed")).alias("n_numeric_text"), own("n_outliers"), "n_valid", own("min"), own("max"))


def validate_folder(spark: SparkSession, folder: str, suffix: str = ".csv", config: dict | None = None) -> DataFrame:
    """File checks plus the table checks of every CSV in a folder; the first column is the index.

    All files go through the same scans and aggregates, so the number of jobs does not depend on the number of files.
    Cells that are no numbers in a column that mostly holds numbers are counted.
    """
    from panelfill.operators.quality import DEFAULTS, RESULT, _finding, _findings, _parses_as_time, column_findings
    cfg = {**DEFAULTS, **(config or {})}
    out = file_findings(spark, folder, suffix, cfg["max_file_size_mb"])
    files = list_files(spark, folder, suffix)
    if not files:
        return out
    lines, heads = _csv_lines(spark, folder, suffix)
    named = heads.withColumn("names", F.transform("names", lambda n, i: F.when(n == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(n)))
    columns = F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0)))
    twice = F.array_distinct(F.filter("names", lambda n: F.size(F.filter("names", lambda m: m == n)) > 1))
    none, some = F.lit(None), lambda level, observed, threshold, message, check, column: _finding(check, column, level, observed, threshold, F.lit(message))
    unread = named.where(F.size(twice) > 0).select("dataset", F.explode(twice).alias("c"), "names").select(
        "dataset", _finding("duplicate_column", F.col("c"), "error", F.size(F.filter("names", lambda m: m == F.col("c"))), 1.0,
                            F.concat(F.lit("duplicate column name: "), F.col("c"))).alias("f"))
    empty = (spark.createDataFrame([(p,) for p, _ in files], "path string")
             .join(heads.select(F.col("dataset").alias("path")), "path", "left_anti")
             .select(F.col("path").alias("dataset"), some("error", none, None, "failed to read: no header", "read", none).alias("f")))
    sound = named.where(F.size(twice) == 0).select("dataset", F.col("names")[0].alias("index"), columns.alias("columns"))
    cell = lambda at: F.nullif(F.trim(F.get("fields", at)), F.lit(""))
    rows = lines.join(sound, "dataset")
    cells = rows.select("dataset", "fields", F.posexplode("columns").alias("pos", "name")).select("dataset", "pos", "name", cell(F.col("pos") + 1).alias("cell"))
    stats = _folder_stats(cells, cfg["outlier_std_threshold"])
    numeric = stats.groupBy("dataset").agg(F.count_if("is_numeric").alias("numeric"))
    n = F.size("columns")
    ratio = F.when(n > 0, F.coalesce("numeric", F.lit(0)) / n).otherwise(F.lit(0.0))
    schema = sound.join(numeric, "dataset", "left").select("dataset", F.explode(F.concat(_findings([
        (F.lit(True), some("summary", n, None, "columns", "column_count", none)),
        (n < cfg["min_features"], some("error", n, cfg["min_features"], "too few features", "column_count", none)),
        (n > cfg["max_features"], some("warning", n, cfg["max_features"], "many features", "column_count", none)),
        (F.lit(True), some("summary", F.round(ratio, 3), None, "share of numeric columns", "numeric_ratio", none)),
        (ratio < cfg["required_numeric_ratio"], some("warning", ratio, cfg["required_numeric_ratio"], "low numeric ratio", "numeric_ratio", none)),
        (F.coalesce("numeric", F.lit(0)) == 0, some("warning", F.lit(0.0), None, "no numeric columns found for quality analysis", "numeric_columns", none)),
    ]), F.transform(F.filter("columns", lambda c: c.startswith("Unnamed:")), lambda c: _finding(
        "column_name", c, "warning", none, None, F.concat(F.lit("unnamed column: "), c))))).alias("f"))
    parsed, valid = F.col("n_numeric_text"), F.col("n_valid")
    unparsed = stats.where(F.col("is_text") & (2 * parsed > valid) & (parsed < valid)).select("dataset", _finding(
        "unparsed_cells", F.col("column"), "warning", valid - parsed, 0.0, F.concat(F.lit("cells that are no numbers in "), F.col("column"))).alias("f"))
    key = rows.select("dataset", "index", cell(F.lit(0)).alias("key"))
    per_key = key.groupBy("dataset", "index", "key").agg(F.count(F.lit(1)).alias("n"))
    bad = F.sum(F.when(F.lower("index").contains("time") & F.col("key").isNotNull() & ~_parses_as_time(F.col("key"), cfg["timestamp_formats"]), F.col("n")).otherwise(0))
    keys = per_key.groupBy("dataset", "index").agg(F.sum(F.col("n") - 1).alias("again"), bad.alias("bad"))
    index = keys.select("dataset", F.explode(_findings([
        (F.lit(True), some("summary", F.col("again"), None, "repeated index values", "duplicate_index", F.col("index"))),
        (F.col("again") > 0, some("warning", F.col("again"), 0.0, "repeated index values", "duplicate_index", F.col("index"))),
        (F.lower("index").contains("time"), some("summary", F.col("bad") == 0, None, "1 if every index value is a time stamp", "timestamp_parseable", F.col("index"))),
        (F.col("bad") > 0, some("warning", F.col("bad"), 0.0, "index values that are no time stamps", "timestamp_parseable", F.col("index"))),
    ])).alias("f"))
    found = unread.unionByName(empty).unionByName(schema).unionByName(unparsed).unionByName(index).select("dataset", "f.*")
    names = [c.split()[0].strip("`") for c in RESULT.split(", ")]
    return out.unionByName(found.select(*names)).unionByName(column_findings(stats, cfg).select(*names))
