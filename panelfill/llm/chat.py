"""Chat formatting: logged snapshots of growing conversations collapse into the longest ones, which are then rendered.

A conversation that was logged after each turn appears as many conversations, each a prefix of the next. Every turn gets
a hash of its place, role and text; sums of these are rolling hashes of all prefixes. A conversation whose full hash is
a proper prefix of another is dropped by an anti-join, of equal ones the smallest ``conv_id`` stays. Only DataFrame
functions are used.

Turns of one conversation are spread over blocks of ``BLOCK`` turns; what is carried from block to block is one row per
block, and rendering writes one part per block, so that no conversation has to fit a task.

Defined cases: turns are ordered by ``turn``, then role and text, nulls first; equal rows count once; a null role or
text is empty, but differs from an empty one in the hash; turns without ``conv_id`` belong to no conversation and are
left out; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelfill.sources.storage import stored

BLOCK = 1024


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(20,0)")


def placed(conversations: DataFrame) -> DataFrame:
    """Distinct turns with ``place``, their number in the conversation from 1 on, and ``block``."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    sizes = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    return (turns.withColumn("place", F.row_number().over(inner)).join(sizes, ["conv_id", "block"])
            .withColumn("place", F.col("place") + F.col("before")).drop("before"))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``n`` and two rolling hashes ``h1``, ``h2`` of the first n turns, and ``size`` of the conversation."""
    wrap = F.lit(str(1 << 64)).cast("decimal(38,0)")
    hashed = turns.select("conv_id", "block", "place", _hash(1).alias("a"), _hash(2).alias("b"))
    blocks = hashed.groupBy("conv_id", "block").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    blocks = blocks.select("conv_id", "block", F.sum("n").over(whole).alias("size"),
                           *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ab"])
    inner = Window.partitionBy("conv_id", "block").orderBy("place")
    sums = hashed.select("conv_id", "block", F.col("place").alias("n"), F.sum("a").over(inner).alias("a"), F.sum("b").over(inner).alias("b"))
    total = lambda c: F.pmod((F.col(c) + F.col(f"{c}0")).cast("decimal(38,0)"), wrap).cast("decimal(20,0)")
    return sums.join(blocks, ["conv_id", "block"]).select("conv_id", "n", "size", total("a").alias("h1"), total("b").alias("h2"))


def maximal(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id`` and ``size`` of the conversations that no other one continues, and the placed turns of all."""
    turns = stored(placed(conversations), "turns")
    rolled = prefixes(turns)
    key = ["n", "h1", "h2"]
    full = rolled.where(F.col("n") == F.col("size")).groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    proper = rolled.where(F.col("n") < F.col("size")).select(*key).distinct()
    return full.join(proper, key, "left_anti").select("conv_id", F.col("n").alias("size")), turns


def rendered(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``part`` (from 0) and ``text`` of each maximal conversation, one part per block of turns.

    A turn is rendered as ``<|role|>``, a newline, its text and a newline.
    """
    kept, turns = maximal(conversations)
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    parts = (turns.join(kept, "conv_id").select("conv_id", "size", "place", line.alias("line"))
             .groupBy("conv_id", F.col("size").alias("n_turns"), F.floor((F.col("place") - 1) / BLOCK).alias("part"))
             .agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines")))
    return parts.select("conv_id", "n_turns", "part", F.array_join("lines.line", "").alias("text"))
