"""Candidates per group: best-first cuts, margins, hit curves and even samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import fixed
from darkroom.operators.ordered import top_per_key
from darkroom.operators.selection import exact_percentile


def top_candidates(
    detections: DataFrame, key: str, index: Sequence[str], k: int = fixed.CANDIDATES,
    gate: float = fixed.MIN_BOX_SCORE,
) -> DataFrame:
    """Best ``k`` per group above ``gate`` with clipped boxes; ties keep the lower index.

    Empty boxes are dropped after the cut, so fewer than ``k`` may remain. Needs cx, cy, w, h,
    score.
    """
    cut = top_per_key(detections, [key], [F.col("score").desc(), *index], max(k, 1))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    boxed = cut.where(F.col("score") >= gate).withColumns(
        {
            "x0": clip(F.col("cx") - F.col("w") / 2), "y0": clip(F.col("cy") - F.col("h") / 2),
            "x1": clip(F.col("cx") + F.col("w") / 2), "y1": clip(F.col("cy") + F.col("h") / 2),
        }
    )
    return boxed.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def top2_margin(
    candidates: DataFrame, key: str, gate: float = fixed.AMBIGUITY_MARGIN, lone: float = 1.0,
    serving: bool = True,
) -> DataFrame:
    """How far the best candidate beat the runner-up, and whether to ask.

    ``lone`` is the margin of a single candidate: 1.0 when serving, 0.0 in reports. Serving
    margins are clamped to [0, 1]; the flag uses the raw one. Needs rank and score.
    """
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    tops = candidates.groupBy(key).agg(
        F.count(F.lit(1)).alias("candidates"), first.alias("__1"), second.alias("__2")
    )
    raw = F.when(F.col("__2").isNotNull(), F.col("__1") - F.col("__2")).otherwise(F.lit(lone))
    margin = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)) if serving else raw
    return tops.select(
        key, "candidates", margin.alias("margin"),
        (F.col("__2").isNotNull() & (raw < gate)).alias("ambiguous"),
    )


def samples_from(candidates: DataFrame, key: str, k: int = fixed.CANDIDATES) -> DataFrame:
    """One row per sample: candidates, margin, top1_correct, first hit rank, best IoU at 1..k."""
    iou, rank = F.col("iou"), F.col("rank")
    score = lambda r: F.max(F.when(rank == r, F.col("score")))
    return candidates.groupBy(key).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.coalesce(score(1) - score(2), F.lit(0.0)).alias("margin"),
        F.coalesce(F.max(F.when(rank == 1, iou >= fixed.HIT_IOU)), F.lit(False)).alias("top1_correct"),
        F.min(F.when(iou >= fixed.HIT_IOU, rank)).alias("first_hit"),
        *[F.coalesce(F.max(F.when(rank <= r, iou)), F.lit(0.0)).alias(f"best_{r}")
          for r in range(1, k + 1)],
    )


def hit_curve(candidates: DataFrame, key: str, k: int = fixed.CANDIDATES) -> DataFrame:
    """k, hit_rate and mean best IoU when a perfect picker sees the first k candidates.

    A sample with fewer than k candidates keeps its best, so no ranks need filling in.
    """
    rows = [
        F.struct(
            F.lit(r).alias("k"),
            F.avg(F.coalesce(F.col("first_hit") <= r, F.lit(False)).cast("double")).alias("hit_rate"),
            F.avg(f"best_{r}").alias("miou"),
        )
        for r in range(1, k + 1)
    ]
    one = samples_from(candidates, key, k).agg(F.array(*rows).alias("rows"))
    return one.select(F.inline("rows"))


def margin_signal(
    samples: DataFrame, cuts: Sequence[float] = fixed.MARGIN_CUTS
) -> DataFrame:
    """Per cut: share asked, top-1 hit rate on each side. Cuts with an empty side are left out.

    All cuts come out of one pass. Needs margin and top1_correct.
    """
    hit = F.col("top1_correct").cast("double")
    rows = []
    for cut in cuts:
        narrow = F.col("margin") < cut
        rows.append(
            F.struct(
                F.lit(cut).alias("margin_below"),
                F.avg(narrow.cast("double")).alias("share_asked"),
                F.avg(F.when(narrow, hit)).alias("hit_narrow"),
                F.avg(F.when(~narrow, hit)).alias("hit_wide"),
            )
        )
    one = samples.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return one.where(F.col("hit_narrow").isNotNull() & F.col("hit_wide").isNotNull())


def ambiguity_report(candidates: DataFrame, key: str, k: int = fixed.CANDIDATES) -> DataFrame:
    """One row: samples, gain in hit rate and IoU of picking from k over taking the first."""
    samples = samples_from(candidates, key, k)
    hit = lambda r: F.avg(F.coalesce(F.col("first_hit") <= r, F.lit(False)).cast("double"))
    gains = samples.agg(
        F.count(F.lit(1)).alias("n"), (hit(k) - hit(1)).alias("gain_from_picking"),
        (F.avg(f"best_{k}") - F.avg("best_1")).alias("miou_gain"),
    )
    half = exact_percentile(samples, [], "candidates", "median_candidates")
    one = F.lit(1).alias("__one")
    return gains.select("*", one).join(half.select("*", one), "__one").drop("__one")


def natural_top(names: DataFrame, name: str, n: int, *tie: str) -> DataFrame:
    """First ``n`` names by length, then alphabet, so that 2 sorts before 10."""
    return names.orderBy(F.length(name), name, *tie).limit(n)


def cap_per_group(parents: DataFrame, items: Column, n: int, name: str = "item") -> DataFrame:
    """At most the first ``n`` items of each parent's array, with their 0-based place."""
    return parents.select("*", F.posexplode(F.slice(items, 1, n)).alias("place", name))


def even_sample(groups: DataFrame, total: str, n: int) -> DataFrame:
    """``n`` evenly spaced indices per group, ends left out; halves round to even."""
    steps = F.sequence(F.lit(1), F.lit(n))
    indices = F.transform(
        steps, lambda i: F.bround(F.col(total) * i / F.lit(float(n + 1)), 0).cast("bigint")
    )
    return groups.where(F.col(total) > 0).select("*", F.explode(indices).alias("frame"))


def grid_thin(points: DataFrame, key: str, cell: int = fixed.PROBE_SPACING) -> DataFrame:
    """The first point of each grid cell, row by row."""
    cells = points.withColumns(
        {"cell_x": F.floor(F.col("x") / cell), "cell_y": F.floor(F.col("y") / cell)}
    )
    return top_per_key(cells, [key, "cell_x", "cell_y"], ["y", "x"], 1).drop("rank")
