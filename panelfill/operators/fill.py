"""Single-series imputers and the run of several imputers over one panel.

An imputer takes a panel and the name of its gapped column and returns the panel with that column
filled. Every other column passes through, observed cells never change.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F

from panelfill.functions.keys import CELL, SERIES
from panelfill.operators.gaps import (
    blend_flat_ends, ffill_bfill, interpolate_both, nearest_past_then_future)
from panelfill.operators.reshape import with_partition
from panelfill.operators.scan import cell_join, observed_neighbours


def impute_mean(p: DataFrame, value: str = "Value_missing") -> DataFrame:
    """Series mean; a series without any value stays null, and so does a cell without a key."""
    means = p.groupBy(*SERIES).agg(F.avg(value).alias("_mean"))
    return p.join(means, SERIES, "left").withColumn(value, F.coalesce(value, "_mean")).select(*p.columns)


def impute_ffill(p: DataFrame, value: str = "Value_missing") -> DataFrame:
    return ffill_bfill(p, value)


def impute_linear(p: DataFrame, value: str = "Value_missing") -> DataFrame:
    return interpolate_both(p, value)


# Method names as they appear in result tables.
SINGLE_SCAN = {
    "mean": lambda v: F.coalesce(v, F.col("_mean")),
    "ffill": nearest_past_then_future,
    "interpolation": blend_flat_ends,
}

_REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "mean": impute_mean, "ffill": impute_ffill, "interpolation": impute_linear}


def register_imputer(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a method: ``fn(panel, value=..., **params) -> panel`` with the value column filled."""
    if name in ("original", "mask"):
        raise ValueError(f"{name!r} is reserved for the truth and the mask")
    _REGISTRY[name] = fn


def imputer(name: str) -> Callable[..., DataFrame]:
    if name not in _REGISTRY:
        raise KeyError(f"unknown imputer {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def imputers() -> list[str]:
    return sorted(_REGISTRY)


def impute_grouped(p: DataFrame, by: str, pandas_fn, value: str = "Value_missing") -> DataFrame:
    """Run a user's pandas function on each partition's wide frame (index Date, one column per series).

    The function sees a whole partition, so this fits partitions that one task can hold
    (one station, say); the built-in imputers have no such limit.
    """
    q = with_partition(p.select(*CELL, value), by)

    def run(pdf):
        wide = pdf.pivot(index="Date", columns=SERIES, values=value).sort_index()
        filled = pandas_fn(wide.copy()).reindex(index=wide.index, columns=wide.columns)
        filled = wide.where(wide.notna(), filled)
        long = filled.stack(SERIES, future_stack=True).rename("_filled").reset_index()
        return long[["Date", *SERIES, "_filled"]]

    filled = q.groupBy("part").applyInPandas(
        run, "Date timestamp_ntz, Station string, Feature string, _filled double")
    return (cell_join(p, filled, "left")
            .withColumn(value, F.coalesce(F.col(value), F.when(~F.isnan("_filled"), F.col("_filled"))))
            .select(*p.columns))


def _as_method(df: DataFrame, name: str, value: str, *also: str) -> DataFrame:
    return df.select(F.lit(name).alias("method"), *CELL, F.col(value).alias("Value"), *also)


def union_panels(*panels: DataFrame) -> DataFrame:
    out = panels[0]
    for p in panels[1:]:
        out = out.unionByName(p)
    return out


union_methods = union_panels


def run_methods(p: DataFrame, methods=("mean", "ffill", "interpolation"), params: dict | None = None,
                value: str = "Value_missing", with_truth: bool = False, mark_hidden: bool = False) -> DataFrame:
    """Fill one prepared panel with several methods -> (method, Date, Station, Feature, Value).

    The methods that only look along their own series share one ordered scan and come out of it as rows
    of one explode; the others are added by union. ``with_truth`` adds 'original' and 'mask'. ``mark_hidden`` adds the column
    hidden: whether the cell's truth was hidden. Scores then need not move the other fills; no cell of ``p`` may come twice.
    """
    params = params or {}
    also = ["hidden"] if mark_hidden else []
    if mark_hidden:
        p = p.withColumn("hidden", F.col("missing") & F.col("Value").isNotNull())
    parts = []
    shared = [m for m in methods if m in SINGLE_SCAN and _REGISTRY[m] in (impute_mean, impute_ffill, impute_linear)]
    if shared:
        scanned = observed_neighbours(p.select(*CELL, value, *also), value)
        options = F.array(*[F.struct(F.lit(m).alias("method"), SINGLE_SCAN[m](F.col(value)).alias("Value")) for m in shared])
        parts.append(scanned.select(*CELL, *also, F.explode(options).alias("_o")).select(
            F.col("_o.method").alias("method"), *CELL, F.col("_o.Value").alias("Value"), *also))
    for m in methods:
        if m not in shared:
            parts.append(_as_method(imputer(m)(p, value=value, **params.get(m, {})), m, value, *also))
    if with_truth:
        parts.append(_as_method(p, "original", "Value", *also))
        parts.append(_as_method(p.withColumn("_m", F.col("missing").cast("double")), "mask", "_m", *also))
    return union_methods(*parts)


RUNS = "imputation_method string, n_rows long, n_left long, ms double"


def run_measured(p: DataFrame, path: str, methods=("mean", "ffill", "interpolation"), params: dict | None = None,
                 value: str = "Value_missing") -> DataFrame:
    """Fill the panel with each method into its own folder ``method=...`` below ``path`` and return what the runs
    themselves recorded: rows, gaps left and milliseconds from the first step to the committed write.

    Rows and gaps are counted by the write on its way, so nothing is read again for them.
    """
    runs = []
    for m in methods:
        seen = Observation(f"run-{m}")
        begun = time.perf_counter()
        filled = imputer(m)(p, value=value, **(params or {}).get(m, {})).select(*CELL, F.col(value).alias("Value"))
        counted = filled.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("Value").isNull()).alias("n_left"))
        counted.write.mode("overwrite").parquet(f"{path}/method={m}")
        ms = (time.perf_counter() - begun) * 1000
        runs.append((m, seen.get["n_rows"], seen.get["n_left"], ms))
    return p.sparkSession.createDataFrame(runs, RUNS)
