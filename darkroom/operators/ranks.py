"""Whole-table ranks without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.operators.selection import exact_percentile, exact_percentiles, exact_quantiles
from darkroom.session import cut_lineage

__all__ = ["exact_percentile", "exact_percentiles", "exact_quantiles", "ordinal_rank", "rank_gaps", "spearman"]


def ordinal_rank(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """0-based position of every row in ``order``.

    One range shuffle spreads the rows evenly, ties included, when a tie-breaker is part of the
    range key; rows equal in all of ``order`` take neighbouring positions. Each sorted slice numbers its own rows as it is written; afterwards a
    slice only needs to know how many rows lie in the slices before it, one number per slice.
    """
    # A generated id is its slice number times 2^33 plus the row's place in the slice.
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__id", F.monotonically_increasing_id())
    )
    offsets = _before(placed.groupBy(F.shiftright("__id", 33).alias("__slice")).agg(F.count(F.lit(1)).alias("__n")))
    # The broadcast side has one row per range slice: at most spark.sql.shuffle.partitions rows.
    return (
        placed.withColumn("__slice", F.shiftright("__id", 33))
        .join(F.broadcast(offsets), "__slice")
        .withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__slice", "__id", "__before")
    )


def _before(sizes: DataFrame) -> DataFrame:
    """``__slice, __before``: the rows in all slices before each, from one row per slice."""
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))


def rank_gaps(df: DataFrame, order: Sequence[str], rank: str, by: str, name: str) -> DataFrame:
    """``by, name``: sum of squared gaps between ``rank`` and the 0-based position in ``order``.

    Positions are not written: a sorted slice adds up its rows' gaps by their place in the slice, and
    their square follows once the slice's own start is known. Sums are exact whole numbers.
    """
    place = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(by, rank, place.alias("__id"))
    gap = (F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) - F.col(rank)).cast("decimal(18,0)")
    # read twice below, so it is written: one row per slice and group in it
    sums = cut_lineage(
        placed.groupBy(F.shiftright("__id", 33).alias("__slice"), by)
        .agg(F.count(F.lit(1)).alias("__n"), F.sum(gap).alias("__s"), F.sum(gap * gap).alias("__q"))
    )
    offsets = _before(sums.groupBy("__slice").agg(F.sum("__n").alias("__n")))
    start = F.col("__before").cast("decimal(18,0)")
    moved = F.col("__q") + 2 * start * F.col("__s") + start * start * F.col("__n")
    return sums.join(F.broadcast(offsets), "__slice").groupBy(by).agg(F.sum(moved).cast("double").alias(name))


def spearman(df: DataFrame, x: str, y: str, tie: Sequence[str], name: str = "rho") -> DataFrame:
    """Rank correlation with ordinal ranks: ties keep ``tie`` order and are not averaged.

    Both rankings are permutations of 0..n-1, so rho follows from the squared rank gaps.
    Under three rows the answer is 0.0.
    """
    pairs = df.select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.struct(*tie).alias("__tie"))
    pairs = ordinal_rank(pairs, ["__x", "__tie"], "__rx")
    pairs = ordinal_rank(pairs, ["__y", "__tie"], "__ry")
    gap = (F.col("__rx") - F.col("__ry")).cast("double")
    n = F.col("n").cast("double")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(gap * gap).alias("__d2")).select(
        "n",
        F.when(F.col("n") < 3, F.lit(0.0))
        .otherwise(1.0 - 6.0 * F.col("__d2") / (n * (n * n - 1.0)))
        .alias(name),
    )
