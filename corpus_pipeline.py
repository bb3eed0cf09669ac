"""The training-corpus pipeline over ``documents``: five stages, each a Spark job on what the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm import credentials, packing, runs, severity, similar
from darkroom.session import scratch_dir


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows named by ``id`` and ``row_hash`` (nulls match nulls).

    Sides are told apart by alias, so ``docs`` may have columns of any name.
    """
    named = gone.select("id", "row_hash").distinct().alias("gone")
    same = F.col("docs.doc_id").eqNullSafe(F.col("gone.id")) & (F.xxhash64(F.col("docs.text")) == F.col("gone.row_hash"))
    return docs.alias("docs").join(named, same, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a toxic grade reaches one half go.

    Null and empty texts hold no words and stay; of repeated rows all go or none; very long texts
    are read whole. Columns of any further name pass through. Without labels of both kinds, or
    without rows, nothing goes.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("instruction"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = severity.fit_severity(rows, labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("grade")))
    return _without(docs, severity.severity(rows, model).where("harmful"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows equal in both, one.

    A null text counts as empty and a null doc_id as the smallest. Which of the rows equal in both
    stays is left open where they differ in other columns. No rows give none.
    """
    found = runs.exact_copies(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("detail")))
    rows = found.groupBy("id", "detail_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marks = rows.where(~F.col("kept") | (F.col("n") > 1)).select("id", "detail_sha256", F.col("kept").alias("again"))
    digest = F.sha2(F.coalesce(F.col("docs.text"), F.lit("")).cast("binary"), 256)
    same = F.col("docs.doc_id").eqNullSafe(F.col("marks.id")) & (digest == F.col("marks.detail_sha256"))
    marked = docs.alias("docs").join(marks.alias("marks"), same, "left")
    whole = F.struct("docs.*").alias("row")
    once = marked.where(F.col("marks.again")).select(whole, F.col("marks.id").alias("id"), F.col("marks.detail_sha256").alias("sha"))
    once = once.dropDuplicates(["id", "sha"]).select("row.*")
    return marked.where(F.col("marks.again").isNull()).select("docs.*").unionByName(once)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by five-word shingles at a similarity of 0.8 the smallest doc_id stays.

    Null and wordless texts are linked with nothing and stay. A row without doc_id stays only where
    its group has no other. Repeated rows stay or go together. No rows give none.
    """
    found = similar.similar_instructions(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("instruction")))
    return _without(docs, found.where(~F.col("kept")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; n_chars follows the text. No document goes.

    Null and empty texts stay as they are, and so does a null n_chars. Texts are read whole.
    """
    shown = credentials.hide_secrets(docs, id="doc_id", detail="text")
    return shown.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts, placed in sequences of at most 2048 ids.

    A null or empty text is its end id alone. Null and repeated ids are packed each. No rows give none.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    out = packing.pack_prompts(rows, public_tokenizers.path("byte_bpe_50k.json"), room=2048, end=0)
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing),
]
#: The learned stages have no SQL form; tests hold the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
