"""Connected components of a graph of links, with nothing of it on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelfill.sources.storage import stored

ROWS = 250_000  # of a table of links or keys in one partition
BLOCK = 200_000  # links that a task joins at once


def packed(df: DataFrame, name: str, rows: int = ROWS) -> DataFrame:
    """The table, written and read again from as few files as ``rows`` each allow. Joins and groups over tables of one
    partition need no exchange, so rounds over few rows cost few tasks; larger tables are exchanged as usual."""
    out = stored(df, name)
    parts = max(1, -(-out.count() // rows))
    if len(out.inputFiles()) > 4 * parts:
        out = stored(out.coalesce(parts), name)
    return out.coalesce(parts)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from each node to the smallest node of its component, as far as the links of a block tell."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def links() -> pa.RecordBatch:
        found = [(x, top(x)) for x in up]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found if p[0] != p[1]], pa.binary()) for i in range(2)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
            if len(up) >= BLOCK:
                yield links()
    yield links()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``class`` (the smallest node it is linked to) for each node of the links ``a``-``b``, binary columns.

    Each task first replaces its links by those to the smallest node it can reach. Then in every round each node takes the
    smallest class next to it and then that class's own class, so long chains halve from round to round. Each round is
    written to the shared folder, which cuts the lineage.
    """
    near = edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a binary, b binary")
    both = packed(near.union(near.select("b", "a")).distinct(), "links")
    labels = packed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                    .select("node", F.least("node", "b").alias("class")), "classes")
    while True:
        heard = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "class", F.lit(None).cast("binary").alias("own"))
        told = labels.select("node", "class", F.col("class").alias("own"))
        nearer = packed(heard.union(told).groupBy("node").agg(F.min("class").alias("class"), F.max("own").alias("own")), "classes")
        if not nearer.where(F.col("class") != F.col("own")).limit(1).count():
            return nearer.select("node", "class")
        jump = nearer.select(F.col("node").alias("_to"), F.col("class").alias("_far"))
        labels = packed(nearer.join(jump, nearer["class"] == jump["_to"], "left")
                        .select("node", F.least("class", F.coalesce("_far", "class")).alias("class")), "classes")
