"""The content-addressed store: what is referenced, what may go, and what was spent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import fixed, policy


def referenced_digests(images: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every digest some row names, once."""
    return images.select("sha256").union(artifacts.select("sha256")).distinct()


def orphans(objects: DataFrame, referenced: DataFrame) -> DataFrame:
    """Objects nothing refers to, whatever their age."""
    return objects.join(referenced, objects["digest"] == referenced["sha256"], "left_anti")


def classify_objects(
    objects: DataFrame,
    images: DataFrame | None,
    artifacts: DataFrame | None,
    now: Column,
    grace_hours: float = 24.0,
    retention_days: int = 0,
) -> DataFrame:
    """Objects with ``referenced``, ``age_hours`` and ``verdict`` (null keeps the object).

    Without the tables that name digests every object would look unreferenced, so that is an
    error rather than an empty join.
    """
    if images is None or artifacts is None:
        raise ValueError("a sweep needs the tables that say which objects are referenced")
    named = referenced_digests(images, artifacts).select(
        F.col("sha256").alias("digest"), F.lit(True).alias("referenced")
    )
    micros = F.unix_micros(now) - F.unix_micros(F.col("modified_at"))
    return (
        objects.join(named, "digest", "left")
        .withColumn("referenced", F.coalesce("referenced", F.lit(False)))
        .withColumn("age_hours", micros / F.lit(3_600_000_000.0))
        .withColumn(
            "verdict",
            policy.object_verdict(
                F.col("referenced"), F.col("age_hours"), grace_hours, retention_days
            ),
        )
    )


def sweep_report(classified: DataFrame, dry_run: bool = True) -> DataFrame:
    """One row: scanned, orphans, expired, deleted, bytes_freed, dry_run."""
    goes = F.col("verdict").isNotNull()
    return classified.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("verdict") == "orphan").alias("orphans"),
        F.count_if(F.col("verdict") == "expired").alias("expired"),
        F.count_if(goes).alias("deleted"),
        F.coalesce(F.sum(F.when(goes, F.col("size"))), F.lit(0)).alias("bytes_freed"),
    ).withColumn("dry_run", F.lit(dry_run))


def spend_since(
    ledger: DataFrame, since: Column | None = None, by: Sequence[str] = ("user_id",)
) -> DataFrame:
    """Calls and cents per owner from ``since`` on; an owner with none in range gets zeros."""
    counted = F.lit(True) if since is None else F.col("at") >= since
    return ledger.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(counted, F.col("units"))), F.lit(0)).alias("calls"),
        F.coalesce(F.sum(F.when(counted, F.col("cents"))), F.lit(0.0)).alias("cents"),
    )


def megapixels_by_user(images: DataFrame) -> DataFrame:
    pixels = F.col("width").cast("double") * F.col("height")
    return images.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("images"), F.sum(pixels / 1e6).alias("megapixels")
    )


def peak_usage(samples: DataFrame, run: str, value: str) -> DataFrame:
    return samples.groupBy(run).agg(
        F.count(F.lit(1)).alias("samples"), F.max(value).alias("peak")
    )


def stale_items(items: DataFrame, now: Column, days: int = fixed.STALE_DAYS) -> DataFrame:
    """Items untouched for more than ``days``."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("modified_at"))) / F.lit(86_400_000_000.0)
    return items.withColumn("age_days", age).where(F.col("age_days") > days)


def pair_assets(
    images: DataFrame, truths: DataFrame, masks: DataFrame, baselines: DataFrame, key: str = "id"
) -> DataFrame:
    """Images with their truth and mask; the baseline is optional."""
    return images.join(truths, key).join(masks, key).join(baselines, key, "left")
