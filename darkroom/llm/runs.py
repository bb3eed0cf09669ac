"""Exact copies of step details, by merging sorted digest runs up a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.session import cut_lineage

DIGEST = ["digest", "size", "witness"]


def exact_copies(
    steps: DataFrame, id: str = "id", detail: str = "detail", runs: int = 4096, fan: int = 64
) -> DataFrame:
    """Which steps say exactly the same, and which one of them stays.

    Returns one row per input row: ``id, keep_id, group_size, kept, detail_sha256``. Of equal
    details the row with the largest id stays. Two details are equal when SHA-256, byte length and
    an independent 64-bit hash all agree; a digest whose witnesses differ is never merged.

    Every partition is one run of (digest, surviving row, count), sorted by digest. In each round
    ``fan`` neighbouring runs are merged into one, spread over the tasks by digest, until one
    logical run is left; then the answers go down the same tree. A key meets at most ``fan`` rows in a round,
    however many copies there are, and the rows themselves only meet the summary of their own run.

    Null details count as empty. A null id is smaller than any other. Rows that agree in id and
    detail are told apart by their place in the input: exactly one row of a group is kept, all of
    them carry its id. An empty table gives no rows.
    """
    text = F.coalesce(F.col(detail).cast("string"), F.lit(""))
    rows = cut_lineage(
        steps.select(F.col(id).alias("id"), text.alias("text")).select(
            "id",
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
            F.octet_length("text").alias("size"),
            F.xxhash64("text").alias("witness"),
            F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    levels = [_merge(rows.select("run", *DIGEST, F.struct("id", "row").alias("best"), F.lit(1).cast("long").alias("n")))]
    width = runs
    while width > 1:
        width = -(-width // fan)
        levels.append(_merge(levels[-1].withColumn("run", F.floor(F.col("run") / fan))))
    found = levels.pop()
    for below in reversed(levels):
        found = below.select("run", *DIGEST, F.floor(F.col("run") / fan).alias("up")).join(
            found.withColumnRenamed("run", "up"), ["up", *DIGEST]
        ).drop("up")
    return rows.join(found, ["run", *DIGEST]).select(
        "id",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("detail_sha256"),
    )


def _merge(run: DataFrame) -> DataFrame:
    """One row per run and digest; a largest struct makes Spark merge sorted rows, not hash them."""
    return run.groupBy("run", *DIGEST).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
