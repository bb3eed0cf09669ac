"""The shared tables read as the service's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf: str, name: str, stream: bool = False) -> DataFrame:
    """One parquet table; zoneless timestamps become session-zone ones. With ``stream``, read as one."""
    path = f"{sf}/{name}.parquet"
    df = spark.read.parquet(path)
    if stream:
        # as a pattern, because a stream reads single files by pattern only
        df = spark.readStream.schema(df.schema).parquet(f"{sf}/{name}[.]parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


STATE_OF = {
    "signup": "queued", "view": "planning", "click": "running", "purchase": "done",
    "error": "failed",
}


def steps(spark: SparkSession, sf: str, stream: bool = False) -> DataFrame:
    """Events as job steps; a job is what one user did on one day."""
    states = F.create_map(*[F.lit(p) for pair in STATE_OF.items() for p in pair])
    return table(spark, sf, "events", stream).select(
        F.col("event_id").alias("id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("job_id"),
        F.col("user_id"),
        states[F.col("event_type")].alias("state"),
        F.col("props").alias("detail"),
        F.when(F.col("event_type") != "click", F.round(F.col("value") / 500, 4)).alias("progress"),
        F.col("ts").alias("at"),
    )


STEPS_SQL = """steps as (select event_id as id,
  cast(user_id as varchar) || '-' || strftime(ts, '%Y%m%d') as job_id, user_id,
  case event_type when 'signup' then 'queued' when 'view' then 'planning'
    when 'click' then 'running' when 'purchase' then 'done' else 'failed' end as state,
  props as detail,
  case when event_type <> 'click' then round(value / 500, 4) end as progress, ts as "at"
  from events)"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """One job per user and day: created with its first step, in its last state."""
    rows = steps(spark, sf)
    return rows.groupBy("job_id", "user_id").agg(
        F.min("at").alias("created_at"),
        F.max_by("state", "id").alias("state"),
        F.max_by(F.when(F.col("progress").isNotNull(), F.col("detail")), F.col("id")).alias("error"),
        F.max_by(F.when(F.col("progress") > 0.05, F.col("detail")), F.col("id")).alias("result_sha256"),
    ).withColumnRenamed("job_id", "id")


JOBS_SQL = STEPS_SQL + """, jobs as (select job_id as id, user_id, min("at") as created_at,
  arg_max(state, id) as state,
  (array_agg(case when progress is not null then detail end order by id desc))[1] as error,
  (array_agg(case when progress > 0.05 then detail end order by id desc))[1] as result_sha256
  from steps group by job_id, user_id)"""


def objects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("digest"),
        F.floor("o_totalprice").alias("size"),
        F.col("o_orderdate").alias("modified_at"),
    )


def references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(images, artifacts) naming digests: the open and the filled order lines."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("sha256"), "l_linestatus"
    )
    return lines.where("l_linestatus = 'O'"), lines.where("l_linestatus = 'F'")
