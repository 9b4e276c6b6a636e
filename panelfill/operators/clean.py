"""Raw readings -> regular panel: station names, time stamps, grid, resampling, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelfill.functions.calendar import (
    DAY, add_seconds, epoch_micros, epoch_seconds, freq_seconds, hour_start, midnight,
    parse_freq, sunday)
from panelfill.functions.keys import CALENDAR, CELL, SERIES, nan_to_null
from panelfill.operators.scan import led

GRID_STEPS_PER_ROW = 8192

# Fixed values: (name pattern, offset, lower bound, upper bound).
DEFAULT_RULES = [
    ("temperature", 273.15, None, None),
    ("direction", 0.0, 0.0, 360.0),
    ("humidity", 0.0, 0.0, 100.0),
]


def normalise_station(p: DataFrame, col: str = "Station") -> DataFrame:
    """Keep the header up to the first blank."""
    return p.withColumn(col, F.split(col, " ")[0])


def parse_date(p: DataFrame, col: str = "Date", fmt: str | None = None) -> DataFrame:
    """Text to naive time stamp; text that is no time stamp becomes null."""
    text = F.col(col)
    parsed = F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz") if fmt \
        else text.try_cast("timestamp_ntz")
    return p.withColumn(col, parsed)


def to_naive_utc(p: DataFrame, col: str = "Date") -> DataFrame:
    """Text with an optional offset ('...+02:00', '...+02', '...Z', '...z') to a naive UTC stamp; none means UTC already.
    Any other ending makes the stamp null."""
    text = F.trim(F.col(col))
    offset = F.regexp_extract(text, r"([+-])(\d{2})(:?\d{2})?$", 0)
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(offset, "[+:-]", "")
    seconds = F.when(offset != "", sign * (
        F.substring(digits, 1, 2).try_cast("int") * 3600 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60)
    ).otherwise(0)
    has_time = text.rlike(r"\d:\d{2}")
    local = F.when(has_time, F.regexp_replace(text, r"\s*([+-]\d{2}(:?\d{2})?|[Zz])$", "")).otherwise(text)
    stamp = local.try_cast("timestamp_ntz")
    return p.withColumn(col, F.when(has_time, add_seconds(stamp, -seconds)).otherwise(stamp))


def fix_units(p: DataFrame, rules=DEFAULT_RULES, value: str = "Value") -> DataFrame:
    """Per feature-name pattern: add an offset, then clip to bounds. Nulls stay null."""
    v = F.col(value)
    for pattern, offset, lo, hi in rules:
        hit = F.contains(F.lower("Feature"), F.lit(pattern)) & v.isNotNull()
        fixed = v + offset if offset else v
        if lo is not None:
            fixed = F.greatest(fixed, F.lit(lo))
        if hi is not None:
            fixed = F.least(fixed, F.lit(hi))
        v = F.when(hit, fixed).otherwise(v)
    return p.withColumn(value, v)


def drop_stations(p: DataFrame, names) -> DataFrame:
    return p.where(~F.col("Station").isin(list(names))) if names else p


def clip_to_range(org: DataFrame, ref: DataFrame, method: str = "default") -> tuple[DataFrame, DataFrame]:
    """Keep the rows inside ref's first..last Date. Only 'default' clips."""
    if method not in ("default", "moderate", "aggressive", "False"):
        raise ValueError(f"unknown clip method {method!r}")
    if method != "default":
        return org, ref
    lo = ref.select(F.min("Date").alias("lo")).scalar()
    hi = ref.select(F.max("Date").alias("hi")).scalar()
    inside = org.where(F.col("Date").between(lo, hi))
    return inside, ref.where(F.col("Date").isNotNull())


def _whole(a: Column, b: int) -> Column:
    """Integer quotient of two whole numbers; no double in between."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def regularise(p: DataFrame, step: str = "1h", per_feature: bool = True) -> DataFrame:
    """Regular grid from the first stamp in whole steps to the last one.

    Off-grid rows are dropped, absent steps become rows with a null value, a repeated stamp fails the job.
    The range is taken per feature (all its stations share it) or, with ``per_feature=False``, over everything.
    Only readings are shuffled, by series and block of time: each one writes its own step and the empty ones up to the
    next reading of its block. A head row per block writes the empty steps before the first one.
    """
    micros_a_step = freq_seconds(step) * 1_000_000
    micros_a_block = micros_a_step * GRID_STEPS_PER_ROW
    readings = p.where(F.col("Date").isNotNull()).select(*CELL, nan_to_null(F.col("Value")).alias("Value"))
    # One row per series first; the ranges are then derived from these few rows.
    series = readings.groupBy(*SERIES).agg(F.min("Date").alias("_lo"), F.max("Date").alias("_hi"))
    if per_feature:
        scope = W.partitionBy("Feature")
        series = series.withColumn("_lo", F.min("_lo").over(scope)).withColumn("_hi", F.max("_hi").over(scope))
    else:
        lo = readings.select(F.min("Date").alias("lo")).scalar()
        hi = readings.select(F.max("Date").alias("hi")).scalar()
        series = series.select(*SERIES, lo.alias("_lo"), hi.alias("_hi"))

    def block(micros: Column) -> Column:
        return micros - F.pmod(micros, F.lit(micros_a_block).cast("bigint"))

    head = F.struct("_lo", epoch_micros(F.col("_lo")).alias("first"), epoch_micros(F.col("_hi")).alias("last"))
    heads = series.withColumn("_head", head).select(
        *SERIES, F.explode(F.sequence(block(F.col("_head.first")), block(F.col("_head.last")), F.lit(micros_a_block).cast("bigint"))).alias("_block"),
        "_head", F.lit(None).cast("bigint").alias("_micros"), F.lit(None).cast("double").alias("Value"))
    stamped = readings.withColumn("_micros", epoch_micros(F.col("Date"))).select(
        *SERIES, block(F.col("_micros")).alias("_block"), F.lit(None).cast(heads.schema["_head"].dataType).alias("_head"), "_micros", "Value")
    rows = led(heads.unionByName(stamped), *SERIES, "_block")
    # The head has no stamp and so comes first.
    order = W.partitionBy("_lead", *SERIES, "_block").orderBy("_micros")
    known = rows.withColumn("_head", F.first("_head").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    first, end = F.col("_head.first"), F.col("_block") + micros_a_block
    since = F.col("_micros") - first
    at = F.coalesce(_whole(since, micros_a_step), _whole(F.greatest(F.col("_block") - first, F.lit(0)) + (micros_a_step - 1), micros_a_step))
    on_grid = known.where(F.col("_micros").isNull() | (F.pmod(since, F.lit(micros_a_step).cast("bigint")) == 0)).withColumn("_at", at)
    after_last = _whole(F.least(F.col("_head.last"), end - 1) - first, micros_a_step) + 1
    until = on_grid.withColumns({
        "_until": F.coalesce(F.lead("_at").over(order), after_last),
        "_again": F.col("_micros") == F.lag("_micros").over(order)})
    steps = until.where(F.col("_until") > F.col("_at")).select(
        *SERIES, "_head", "_micros", "_at", "_again", "Value", F.explode(F.sequence("_at", F.col("_until") - 1)).alias("_i"))
    date = add_seconds(F.col("_head._lo"), F.col("_i") * freq_seconds(step))
    stamp = F.concat_ws("/", date.cast("string"), "Station", "Feature")
    own = F.col("_micros").isNotNull() & (F.col("_i") == F.col("_at"))
    checked = F.when(own & F.col("_again"), F.raise_error(F.concat(F.lit("repeated time stamp: "), stamp)).cast("double")) \
        .when(own, F.col("Value"))
    return steps.select(date.alias("Date"), *SERIES, checked.alias("Value"))


def grid_dates(p: DataFrame, step: str = "1h") -> DataFrame:
    """The dates of ``regularise(p, step, per_feature=False)``, from the range of the readings alone."""
    ends = p.agg(F.min("Date").alias("_lo"), epoch_micros(F.max("Date")).alias("_hi"))
    micros_a_step = freq_seconds(step) * 1_000_000
    n = _whole(F.col("_hi") - epoch_micros(F.col("_lo")), micros_a_step)
    steps = ends.where(F.col("_lo").isNotNull()).select("_lo", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("_i"))
    return steps.select(add_seconds(F.col("_lo"), F.col("_i") * freq_seconds(step)).alias("Date"))


def bucket_label(p: DataFrame, freq: str, date: str = "Date") -> Column:
    """Label of the resampling bucket. Weeks run Monday..Sunday and carry the Sunday.

    Multiples ('6h', '3d') count from midnight of the feature's first day.
    """
    n, unit = parse_freq(freq)
    c = F.col(date)
    if unit == "w":
        if n != 1:
            raise ValueError("weeks can only be resampled one at a time")
        return sunday(c)
    if n == 1 and unit == "d":
        return midnight(c)
    if n == 1 and unit == "h":
        return hour_start(c)
    step = freq_seconds(freq)
    if DAY % step == 0:
        since_midnight = epoch_seconds(c) - epoch_seconds(midnight(c))
        return add_seconds(midnight(c), F.floor(since_midnight / step) * step)
    if "_origin" not in p.columns:
        raise ValueError(f"{freq} needs the column _origin")
    elapsed = epoch_seconds(c) - epoch_seconds(F.col("_origin"))
    return add_seconds(F.col("_origin"), F.floor(elapsed / step) * step)


def _with_origin(p: DataFrame, freq: str) -> DataFrame:
    n, unit = parse_freq(freq)
    if unit == "w" or DAY % freq_seconds(freq) == 0:
        return p
    origin = p.groupBy("Feature").agg(midnight(F.min("Date")).alias("_origin"))
    return p.join(origin, "Feature")


def resample(p: DataFrame, freq: str = "1d") -> DataFrame:
    """Mean of the non-null values per bucket; a bucket without values stays as a null row."""
    q = _with_origin(p, freq)
    return (q.groupBy(bucket_label(q, freq).alias("Date"), *SERIES)
            .agg(F.avg("Value").alias("Value")))


def resample_collect(p: DataFrame, freq: str = "1d") -> DataFrame:
    """Mean over all series per bucket, with the bucket's stations and features.

    Each name is listed once with its row count (``array<struct<name, n>>``) instead of once per row,
    so that the lists stay as small as the set of names.
    """
    q = _with_origin(p, freq)
    counted = q.groupBy(bucket_label(q, freq).alias("Date"), *SERIES).agg(
        F.sum("Value").alias("_sum"), F.count("Value").alias("_seen"), F.count(F.lit(1)).alias("_n"))

    def names(col):
        per_name = counted.groupBy("Date", col).agg(
            F.sum("_n").alias("n"), F.sum("_sum").alias("_sum"), F.sum("_seen").alias("_seen"))
        return per_name.groupBy("Date").agg(
            F.sort_array(F.collect_list(F.struct(F.col(col).alias("name"), "n"))).alias(f"{col}s"),
            (F.sum("_sum") / F.nullif(F.sum("_seen"), F.lit(0))).alias("Value"))

    return names("Station").join(names("Feature").drop("Value"), "Date").select(
        "Date", "Value", "Stations", "Features")


def add_calendar(p: DataFrame, resampled: bool = False) -> DataFrame:
    d = F.col("Date")
    return p.withColumns({
        "Year": F.year(d), "Month": F.month(d), "Day": F.dayofmonth(d),
        "Hour": F.lit(0) if resampled else F.hour(d)})


def drop_calendar(p: DataFrame) -> DataFrame:
    """Calendar fields are neither filled nor scored: neither as columns nor as features."""
    names = [*CALENDAR, "Date"]
    slim = p.drop(*CALENDAR)
    return slim.where(~F.col("Feature").isin(names) & ~F.col("Station").isin(names))
