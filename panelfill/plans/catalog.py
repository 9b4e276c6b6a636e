"""Registry of named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelfill.plans.testbed import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **ctes: str):
    """Register a query. Without ``sql`` only its rows are checked; unit tests then cover the values."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = off_the_edge(with_ctes(sql, ctes))
        return fn
    return add


# Both engines round after this shift, so that a sum that ends in ...5 up to the last bit rounds the same way in both.
SHIFT = 1e-9


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to the digits both engines agree on."""
    return df.withColumns({
        f.name: F.round(F.col(f"`{f.name}`") + F.lit(SHIFT), digits)
        for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})


def off_the_edge(sql: str) -> str:
    """The same shift for every ``round(x, 6) + 0.0`` of a statement."""
    end, out, at = ", 6) + 0.0", [], 0
    while (hit := sql.find("round(", at)) >= 0:
        depth, i = 1, hit + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[hit + len("round("):i - 1]
        if sql[i - len(", 6)"):].startswith(end):
            out.append(f"{sql[at:hit]}round(({off_the_edge(inner[:-len(', 6')])}) + {SHIFT:.9f}, 6)")
            at = i + len(" + 0.0")
        else:
            out.append(sql[at:hit + len("round(")])
            at = hit + len("round(")
    return "".join(out) + sql[at:]


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def load() -> None:
    """Import every module that registers queries."""
    from panelfill.plans import (  # noqa: F401
        cleaning, filling, joining, quality_checks, scoring, storage_round_trips, summaries, windows_and_masks)
