"""Writers: reports and content-addressed objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def write_report(df: DataFrame, path: str, form: str = "json", mode: str = "errorifexists") -> None:
    df.write.mode(mode).format(form).save(path)


def stored_objects(spark: SparkSession, root: str) -> DataFrame:
    """digest, size and content of objects put so far."""
    return spark.read.schema("digest string, size bigint, content binary, prefix string").parquet(root)


def put_objects(blobs: DataFrame, root: str, known: DataFrame | None = None) -> DataFrame:
    """Store each distinct content once under the first two characters of its digest.

    Returns what was new: digest, size, prefix. ``known`` lists digests already there. Each task
    sends at most one copy of a content on, however many it holds; the rebalance keeps one
    prefix in few files and splits a prefix that is too large for one.
    """
    fresh = blobs.select(
        F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("bigint").alias("size"),
        "content",
    )
    if known is not None:
        fresh = fresh.join(known.select("digest"), "digest", "left_anti")
    once = fresh.groupBy("digest").agg(
        F.first("size").alias("size"), F.first("content").alias("content")
    ).withColumn("prefix", F.substring("digest", 1, 2))
    once.hint("rebalance", "prefix").write.mode("append").partitionBy("prefix").parquet(root)
    return once.select("digest", "size", "prefix")
