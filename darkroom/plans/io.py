"""Round trips: what is written from the shared tables and read back equals what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkroom.plans.registry import Registry
from darkroom.plans.specs import SPECS, spec_rows
from darkroom.plans.tables import STEPS_SQL, jobs, steps, table
from darkroom.session import scratch_dir
from darkroom.sources import readers, writers

plans = Registry()


@plans.add("ss1_read_nested_parquet", """select vec_id, label, embedding[1] as first from embeddings""")
def _(spark, sf):
    first = F.col("embedding")[0].alias("first")
    return readers.read_nested_parquet(spark, f"{sf}/embeddings.parquet", ["vec_id", "label", first])


@plans.add("ss1_nested_fields", """select conv_id, turn, role, length(text) as chars from conversations""")
def _(spark, sf):
    """Conversations written with a nested record list, then read for two of its fields only."""
    path = scratch_dir(spark, "nested")
    table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.array(F.struct("role", F.length("text").cast("bigint").alias("chars"), "text")).alias("ref_list"),
    ).write.parquet(path)
    rows = readers.read_nested_parquet(
        spark, path, ["conv_id", "turn", F.col("ref_list.role").alias("r"), F.col("ref_list.chars").alias("c")]
    )
    return rows.select("conv_id", "turn", F.col("r")[0].alias("role"), F.col("c")[0].alias("chars"))


@plans.add("ss2_read_labelled_jsonl", f"""with {SPECS} select op || ' #' || id as instruction, op, target, content, colour,
  case when p_size > 25 then 'authored' else 'holdout' end as split from sp""")
def _(spark, sf):
    """Labelled instructions as JSON Lines with blank lines between and keys left out when null."""
    path = scratch_dir(spark, "jsonl")
    rows = spec_rows(spark, sf).select(
        F.concat("op", F.lit(" #"), "id").alias("instruction"), "op", "target", "content", "colour",
        F.when(F.col("p_size") > 25, "authored").alias("split"),
    )
    rows.select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value")).write.text(path)
    return readers.read_labelled_jsonl(spark, path).drop("why")


@plans.add("ss3_read_report", f"""with {SPECS} select cast(id as varchar) as id, op, p_retailprice as cost from sp
  where op not in ('add', 'replace') union all select id || '-b', op, p_retailprice / 2 from sp where op not in ('add', 'replace')""")
def _(spark, sf):
    """Reports of three results each, one JSON array per line; the last repeats the first one's id."""
    path = scratch_dir(spark, "report")
    ident = F.col("id").cast("string")
    pair = F.array(
        F.struct(ident.alias("id"), "op", F.lit(-1.0).alias("cost")),
        F.struct(F.concat(ident, F.lit("-b")).alias("id"), "op", (F.col("p_retailprice") / 2).alias("cost")),
        F.struct(ident.alias("id"), "op", F.col("p_retailprice").alias("cost")),
    )
    spec_rows(spark, sf).select(F.to_json(pair).alias("value")).write.text(path)
    return readers.read_report(spark, path, one_line=True).select("id", "op", "cost")


MODELS = {"Brand#1": "encoder", "Brand#2": "eraser", "Brand#3": "detector", "Brand#4": "upscaler"}
PIPELINES = {"Brand#5": "whole edit", "Brand#6": "remote", "Brand#7": "from text"}


@plans.add("ss4_collate_results", """with r as (select p_brand as run, p_size * 30.0::double as peak, p_retailprice as warm from part)
  select case when run in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') then 'model' else 'pipeline' end as kind, run,
    case run when 'Brand#1' then 'encoder' when 'Brand#2' then 'eraser' when 'Brand#3' then 'detector'
      when 'Brand#4' then 'upscaler' when 'Brand#5' then 'whole edit' when 'Brand#6' then 'remote' else 'from text' end as label,
    peak as peak_rss_mb, warm as warm_p50_s, case when run = 'Brand#6' then 'n/a (remote)'
      when run not in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') then '—' when peak <= 1200 then 'fits' else 'OVER' end as verdict
  from r where run in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7')""")
def _(spark, sf):
    """Parts as run results, filed in one folder per run (brand); unknown runs are not reported."""
    path = scratch_dir(spark, "runs")
    table(spark, sf, "part").select(
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("run"),
        (F.col("p_size") * 30.0).alias("peak_rss_mb"), F.lit("1.5").alias("cold_load_s"),
        F.col("p_retailprice").alias("warm_p50_s"),
    ).write.partitionBy("run").json(path)
    safe = lambda names: {k.replace("#", "_"): v for k, v in names.items()}
    runs = readers.collate_results(
        spark, path, safe(MODELS), safe(PIPELINES), remote="Brand_6", one_line=True
    )
    return runs.drop("cold_load_s").withColumn("run", F.replace("run", F.lit("_"), F.lit("#")))


@plans.add("ss5_scan_objects", """select sha256(text) as digest, max(octet_length(encode(text)))::bigint as size,
    true as dated from documents group by sha256(text)""")
def _(spark, sf):
    """Every document stored by content, then listed."""
    root = scratch_dir(spark, "scanned")
    writers.put_objects(table(spark, sf, "documents").select(F.encode("text", "UTF-8").alias("content")), root)
    listed = readers.scan_objects(spark, root, packed=True)
    return listed.select("digest", "size", F.col("modified_at").isNotNull().alias("dated"))


@plans.add("ss6_put_objects", """select sha256(text) as digest, max(octet_length(encode(text)))::bigint as size,
    substr(sha256(text), 1, 2) as prefix from documents group by sha256(text)""")
def _(spark, sf):
    """Every document stored by content, twice; copies and the second round add nothing."""
    root = scratch_dir(spark, "objects")
    blobs = table(spark, sf, "documents").select(F.encode("text", "UTF-8").alias("content"))
    writers.put_objects(blobs, root)
    writers.put_objects(blobs, root, known=writers.stored_objects(spark, root))
    return writers.stored_objects(spark, root).select("digest", "size", "prefix")


@plans.add("ss7_load_store", f"""with {STEPS_SQL}
  select 'users' as name, count(distinct user_id) as n from events
  union all select 'images', count(*) from part union all select 'jobs', count(distinct job_id) from steps
  union all select 'job_steps', count(*) from steps union all select 'artifacts', count(*) from orders
  union all select 'cost_ledger', count(*) from events""")
def _(spark, sf):
    """The six tables written from the shared ones and loaded under their fixed schemas."""
    root = scratch_dir(spark, "store")
    events, part, orders = (table(spark, sf, n) for n in ("events", "part", "orders"))
    text, now = (lambda c: F.col(c).cast("string")), F.lit("2024-02-01").cast("timestamp")
    made = {
        "users": events.groupBy(text("user_id").alias("id")).agg(F.min("ts").alias("created_at"))
        .withColumn("external_id", F.concat(F.lit("x"), F.col("id"))),
        "images": part.select(
            F.sha2(text("p_partkey").cast("binary"), 256).alias("sha256"), F.col("p_brand").alias("user_id"),
            F.col("p_size").alias("width"), F.col("p_size").alias("height"),
            F.lit("image/png").alias("content_type"), F.col("p_partkey").alias("byte_size"), now.alias("created_at"),
        ),
        "jobs": jobs(spark, sf).select(
            "id", text("user_id").alias("user_id"), "state", F.lit("{}").alias("spec"),
            F.lit(None).cast("string").alias("idempotency_key"), "result_sha256", "error", "created_at",
            F.col("created_at").alias("updated_at"),
        ),
        "job_steps": steps(spark, sf).drop("user_id"),
        "artifacts": orders.select(
            text("o_orderkey").alias("id"), text("o_custkey").alias("job_id"),
            F.sha2(text("o_orderkey").cast("binary"), 256).alias("sha256"), F.lit("result").alias("kind"),
            F.col("o_orderdate").alias("created_at"),
        ),
        "cost_ledger": events.select(
            F.col("event_id").alias("id"), text("user_id").alias("user_id"),
            F.lit(None).cast("string").alias("job_id"), F.lit("p").alias("provider"),
            F.col("event_type").alias("operation"), F.lit(1).alias("units"), F.col("value").alias("cents"),
            F.col("ts").alias("at"),
        ),
    }
    for name, df in made.items():
        df.write.parquet(f"{root}/{name}")
    counts = [
        df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        for name, df in readers.load_store(spark, root).items()
    ]
    out, *rest = counts
    for df in rest:
        out = out.unionByName(df)
    return out


@plans.add("ss8_progress_source", """select event_id as seq, cast(user_id as varchar) as job_id, event_type as state,
  value as progress from events""")
def _(spark, sf):
    """Events written as JSON text files, followed as a stream to the end, and landed in parquet."""
    from darkroom.functions import payloads
    from darkroom.streaming import progress

    source, landed = scratch_dir(spark, "live"), scratch_dir(spark, "landed")
    sent = payloads.event_to_json(
        F.col("user_id"), F.col("event_type"), F.col("value"), F.col("event_id").cast("string"),
        F.col("event_type") == "purchase",
    )
    table(spark, sf, "events").select(sent.alias("value")).write.text(source)
    events, _ = progress.decode_events(progress.progress_source(spark, source))
    query = (
        events.writeStream.format("parquet").option("path", landed)
        .option("checkpointLocation", scratch_dir(spark, "offsets"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(events.schema).parquet(landed).select(
        F.col("detail").cast("bigint").alias("seq"), "job_id", "state", "progress"
    )


@plans.add("ss9_write_report", """select l_returnflag as name, count(*) as n, round(avg(l_quantity), 6) as mean
  from lineitem group by 1""")
def _(spark, sf):
    path = scratch_dir(spark, "summary")
    summary = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean")
    )
    writers.write_report(summary, path)
    return spark.read.schema("name string, n bigint, mean double").json(path)
