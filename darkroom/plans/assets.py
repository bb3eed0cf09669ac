"""Asset store and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkroom.functions import policy
from darkroom.operators import assets
from darkroom.plans.registry import Registry
from darkroom.plans.tables import objects, references, table

plans = Registry()

NOW = "2001-08-02 00:00:00"
RETENTION = 1500


def _now():
    return F.lit(NOW).cast("timestamp")


def _classified(spark, sf, retention=RETENTION):
    images, artifacts = references(spark, sf)
    return assets.classify_objects(objects(spark, sf), images, artifacts, _now(), 24.0, retention)


CLASSIFIED = f"""classified as (
  select cast(o_orderkey as varchar) as digest, cast(floor(o_totalprice) as bigint) as size,
    r.k is not null as referenced,
    (epoch_us(timestamp '{NOW}') - epoch_us(o_orderdate)) / 3600000000.0 as age_hours,
    case when r.k is null and epoch_us(timestamp '{NOW}') - epoch_us(o_orderdate) >= 24 * 3600000000
           then 'orphan'
         when r.k is not null and epoch_us(timestamp '{NOW}') - epoch_us(o_orderdate)
           >= {RETENTION} * 24 * 3600000000 then 'expired' end as verdict
  from orders left join (select distinct l_orderkey as k from lineitem) r on r.k = o_orderkey)"""


@plans.add("su1_referenced_digests", "select distinct cast(l_orderkey as varchar) as sha256 from lineitem")
def _(spark, sf):
    return assets.referenced_digests(*references(spark, sf))


@plans.add("jn2_classify_objects",
           f"with {CLASSIFIED} select digest, size, referenced, age_hours, verdict from classified")
def _(spark, sf):
    return _classified(spark, sf).drop("modified_at")


@plans.add("jn3_orphans", """select cast(o_orderkey as varchar) as digest,
  cast(floor(o_totalprice) as bigint) as size from orders
  where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def _(spark, sf):
    found = assets.referenced_digests(*references(spark, sf))
    return assets.orphans(objects(spark, sf), found).select("digest", "size")


@plans.add("sc14_object_verdict", f"""select cast(l_orderkey as varchar) as digest, l_linenumber as line,
  case when l_linestatus <> 'O' and epoch_us(timestamp '{NOW}') - epoch_us(l_shipdate) >= 24 * 3600000000
         then 'orphan'
       when l_linestatus = 'O' and epoch_us(timestamp '{NOW}') - epoch_us(l_shipdate)
         >= 30 * 24 * 3600000000 then 'expired' end as verdict from lineitem""")
def _(spark, sf):
    age = (F.unix_micros(_now()) - F.unix_micros("l_shipdate")) / F.lit(3_600_000_000.0)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("digest"),
        F.col("l_linenumber").alias("line"),
        policy.object_verdict(F.col("l_linestatus") == "O", age, 24.0, 30).alias("verdict"),
    )


@plans.add("ag3_sweep_report", f"""with {CLASSIFIED} select count(*) as scanned,
  count(*) filter (verdict = 'orphan') as orphans, count(*) filter (verdict = 'expired') as expired,
  count(verdict) as deleted,
  cast(coalesce(sum(size) filter (verdict is not null), 0) as bigint) as bytes_freed,
  true as dry_run from classified""")
def _(spark, sf):
    return assets.sweep_report(_classified(spark, sf))


def ledger(spark, sf):
    return table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("operation"), F.lit(1).cast("bigint").alias("units"),
        F.col("value").alias("cents"), F.col("ts").alias("at"), F.col("event_id").alias("id"),
    )


SINCE = "2024-01-15 00:00:00"


@plans.add("ag1_spend_since", f"""select user_id,
  cast(coalesce(sum(1) filter (ts >= timestamp '{SINCE}'), 0) as bigint) as calls,
  round(coalesce(sum(value) filter (ts >= timestamp '{SINCE}'), 0.0), 2) as cents
  from events group by user_id""")
def _(spark, sf):
    spent = assets.spend_since(ledger(spark, sf), F.lit(SINCE).cast("timestamp"))
    return spent.withColumn("cents", F.round("cents", 2))


@plans.add("ag1_spend_by_operation", """select user_id, event_type as operation, count(*) as calls,
  round(sum(value), 2) as cents from events group by user_id, event_type""")
def _(spark, sf):
    spent = assets.spend_since(ledger(spark, sf), by=["user_id", "operation"])
    return spent.withColumn("cents", F.round("cents", 2))


@plans.add("ag2_megapixels_by_user", """select p_brand as user_id, count(*) as images,
  round(sum(p_size::double * p_retailprice / 1e6), 6) as megapixels from part group by p_brand""")
def _(spark, sf):
    images = table(spark, sf, "part").select(
        F.col("p_brand").alias("user_id"), F.col("p_size").alias("width"),
        F.col("p_retailprice").alias("height"),
    )
    return assets.megapixels_by_user(images).withColumn("megapixels", F.round("megapixels", 6))


@plans.add("ag22_peak_usage", """select user_id, count(*) as samples, max(value) as peak
  from events group by user_id""")
def _(spark, sf):
    return assets.peak_usage(table(spark, sf, "events"), "user_id", "value")


@plans.add("ag27_stale_items", f"""select o_orderkey as path,
  (epoch_us(timestamp '{NOW}') - epoch_us(o_orderdate)) / 86400000000.0 as age_days from orders
  where (epoch_us(timestamp '{NOW}') - epoch_us(o_orderdate)) / 86400000000.0 > 30""")
def _(spark, sf):
    items = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("modified_at")
    )
    return assets.stale_items(items, _now()).select("path", "age_days")


@plans.add("jn4_pair_assets", """with s as (select l_orderkey as id, max(case when l_returnflag = 'A' then l_extendedprice end) as truth,
    max(case when l_returnflag = 'R' then l_extendedprice end) as mask, max(case when l_returnflag = 'N' then l_extendedprice end) as baseline
    from lineitem group by l_orderkey)
  select id, o_totalprice as image, truth, mask, baseline from s join orders on o_orderkey = id
  where truth is not null and mask is not null""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")

    def best(flag, name):
        return lines.where(F.col("l_returnflag") == flag).groupBy(
            F.col("l_orderkey").alias("id")
        ).agg(F.max("l_extendedprice").alias(name))

    images = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("image")
    )
    return assets.pair_assets(images, best("A", "truth"), best("R", "mask"), best("N", "baseline"))
