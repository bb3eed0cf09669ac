"""Job store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkroom.functions import specs
from darkroom.operators import jobs as ops
from darkroom.plans.registry import Registry
from darkroom.plans.tables import JOBS_SQL, STEPS_SQL, jobs, steps, table

plans = Registry()


@plans.add("wn1_dedupe_idempotent", """with j as (select event_id as id, user_id,
    case when event_type <> 'view' then props end as idempotency_key, ts as created_at from events),
  r as (select *, row_number() over (partition by user_id, idempotency_key order by created_at, id) as rn
    from j)
  select id, user_id, idempotency_key from r where idempotency_key is null or rn = 1""")
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "user_id",
        F.when(F.col("event_type") != "view", F.col("props")).alias("idempotency_key"),
        F.col("ts").alias("created_at"),
    )
    return ops.dedupe_idempotent(rows).drop("created_at")


@plans.add("wn2_dedupe_images", """select l_orderkey || '-' || l_linenumber as sha256, l_partkey as width,
    l_suppkey as height, l_shipdate::varchar as at from (select *, row_number() over (
    partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey) as rn from lineitem)
  where rn = 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sha256"),
        F.col("l_partkey").alias("width"), F.col("l_suppkey").alias("height"),
        F.col("l_shipdate").cast("string").alias("at"), "l_shipdate",
    )
    return ops.dedupe_images(rows, ["l_shipdate", "width", "height"]).drop("l_shipdate")


# Every job that has steps, and one without any per customer.
KNOWN_SQL = """known as (select distinct job_id as id, user_id from steps
  union all select cast(c_custkey as varchar) || '-none', c_custkey from customer)"""


def _known(spark, sf):
    idle = table(spark, sf, "customer").select(
        F.concat(F.col("c_custkey").cast("string"), F.lit("-none")).alias("id"), F.col("c_custkey").alias("user_id")
    )
    started = steps(spark, sf).select(F.col("job_id").alias("id"), "user_id").distinct()
    return started.unionByName(idle)


@plans.add("wn3_current_state", f"""with {STEPS_SQL}, {KNOWN_SQL}
  select k.id as job_id, coalesce(arg_max(state, s.id), 'queued') as state,
    coalesce((array_agg(progress order by s.id desc))[1], 0.0) as progress
  from known k left join steps s on s.job_id = k.id group by k.id""")
def _(spark, sf):
    return ops.current_state(_known(spark, sf).select("id"), steps(spark, sf))


@plans.add("wn4_fill_progress", f"""with {STEPS_SQL} select job_id, id, state, coalesce(
    last_value(progress ignore nulls) over (partition by job_id order by id
      rows between unbounded preceding and current row), 0.0) as progress from steps""")
def _(spark, sf):
    return ops.fill_progress(steps(spark, sf)).select("job_id", "id", "state", "progress")


@plans.add("wn5_artifacts_for", """select user_id as job_id, event_id as id,
    row_number() over (partition by user_id order by ts, event_id) as position from events""")
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at")
    )
    return ops.artifacts_in_order(rows).select("job_id", "id", "position")


@plans.add("pf4_owner_scoped", """select l_orderkey as job_id, l_suppkey as user_id, l_linenumber as line,
    o_orderstatus as state from lineitem join orders on o_orderkey = l_orderkey and o_custkey = l_suppkey""")
def _(spark, sf):
    asked = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("user_id"),
        F.col("l_linenumber").alias("line"),
    )
    held = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("state"),
    )
    return ops.owner_lookup(asked, held)


@plans.add("jn1_jobs_with_steps", f"""with {STEPS_SQL}, {KNOWN_SQL}
  select k.id as job_id, k.user_id as user_id, s.id as step_id, s.state as step_state,
    s.progress as step_progress,
    case when s.id is not null then row_number() over (partition by k.id order by s.id) end as step_no
  from known k left join steps s on s.job_id = k.id""")
def _(spark, sf):
    return ops.jobs_with_steps(_known(spark, sf), steps(spark, sf).drop("user_id")).drop("step_detail", "step_at")


LEGAL = """(values ('queued','planning'),('queued','cancelled'),('queued','failed'),
  ('planning','running'),('planning','cancelled'),('planning','failed'),
  ('running','review'),('running','cancelled'),('running','failed'),
  ('review','running'),('review','done'),('review','cancelled'),('review','failed')) e(a, b)"""


@plans.add("jn11_illegal_transitions", f"""with {STEPS_SQL}, p as (select job_id, id, state as to_state,
    lag(state) over (partition by job_id order by id) as from_state from steps)
  select job_id, id, from_state, to_state from p where from_state is not null
    and not exists (select 1 from {LEGAL} where a = from_state and b = to_state)
    and not (from_state in ('done','failed','cancelled') and to_state = 'cancelled')""")
def _(spark, sf):
    return ops.illegal_transitions(steps(spark, sf))


@plans.add("jn12_provision_users", """with u as (select 'u' || c_custkey as id,
    cast(c_custkey as varchar) as external_id from customer where c_mktsegment = 'BUILDING'),
  n as (select distinct cast(o_custkey as varchar) as e from orders)
  select id, external_id, false as is_new from u union all
  select substr(sha256(e),1,8)||'-'||substr(sha256(e),9,4)||'-'||substr(sha256(e),13,4)||'-'||
    substr(sha256(e),17,4)||'-'||substr(sha256(e),21,12), e, true from n
  where e not in (select external_id from u)""")
def _(spark, sf):
    users = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("u"), F.col("c_custkey")).alias("id"),
        F.col("c_custkey").cast("string").alias("external_id"),
    )
    seen = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("external_id"))
    return ops.provision_users(seen, users)


@plans.add("wn15_upsert_jobs", """with inc as (select l_orderkey as id,
    case when l_quantity > 40 then o_custkey + 1 else o_custkey end as user_id, l_returnflag as state,
    epoch_us(l_shipdate) * 64 + l_linenumber as seq, l_partkey, l_suppkey
    from lineitem join orders on o_orderkey = l_orderkey),
  s as (select id, user_id, state, (seq, l_partkey, l_suppkey) as seq from inc),
  cur as (select o_orderkey as id, o_custkey as user_id, o_orderstatus as state from orders
    where o_orderstatus <> 'P'),
  own as (select s.id, coalesce(any_value(cur.user_id), arg_min(s.user_id, s.seq)) as owner
    from s left join cur on cur.id = s.id group by s.id),
  sv as (select s.id, arg_max(s.user_id, s.seq) as user_id, arg_max(s.state, s.seq) as state
    from s join own on own.id = s.id where s.user_id = own.owner group by s.id)
  select coalesce(cur.id, sv.id) as id, coalesce(sv.user_id, cur.user_id) as user_id,
    coalesce(sv.state, cur.state) as state, 'kept' as outcome from cur full join sv on cur.id = sv.id
  union all select s.id, s.user_id, s.state, 'rejected' from s join own on own.id = s.id
    where s.user_id <> own.owner""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    seq = F.struct(
        (F.unix_micros("l_shipdate") * 64 + F.col("l_linenumber")).alias("a"), "l_partkey", "l_suppkey"
    )
    incoming = table(spark, sf, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        F.col("l_orderkey").alias("id"),
        F.when(F.col("l_quantity") > 40, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("user_id"),
        F.col("l_returnflag").alias("state"), seq.alias("seq"),
    )
    current = orders.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("state"),
    )
    saved, rejected = ops.upsert_jobs(current, incoming, "seq")
    return saved.withColumn("outcome", F.lit("kept")).unionByName(
        rejected.drop("seq").withColumn("outcome", F.lit("rejected"))
    )


@plans.add("pv5_check_outcomes", f"""with {JOBS_SQL}, c as (select id, state, case
    when state = 'failed' and coalesce(error, '') = '' then 'failed without a reason'
    when state = 'done' and coalesce(result_sha256, '') = '' then 'done without a result' else '' end
    as violations from jobs) select id, state, violations, violations = '' as valid from c""")
def _(spark, sf):
    checked = specs.check_outcomes(jobs(spark, sf))
    return checked.select("id", "state", F.array_join("violations", "; ").alias("violations"), "valid")


@plans.add("ag21_job_wait", f"""with {JOBS_SQL}, e as (select job_id, arg_min(state, ("at", id)) as st,
    min("at") as ended from steps where state in ('done','failed','cancelled') group by job_id),
  w as (select case when s <= 21600 then st else 'still waiting' end as outcome,
      case when s <= 21600 then s else 21600.0 end as seconds
    from (select st, (epoch_us(e.ended) - epoch_us(created_at)) / 1000000.0 as s
      from jobs left join e on e.job_id = jobs.id))
  select outcome, count(*) as jobs, round(quantile_cont(seconds, 0.5), 6) as p50,
    round(quantile_cont(seconds, 0.9), 6) as p90 from w group by outcome""")
def _(spark, sf):
    waits = ops.job_wait(jobs(spark, sf), steps(spark, sf), 21600.0)
    return waits.withColumns({"p50": F.round("p50", 6), "p90": F.round("p90", 6)})


@plans.add("ag23_provider_health", """with c as (select user_id as provider, event_id as id,
    event_type <> 'error' as ok, props from events),
  l as (select provider, max(id) filter (ok) as last_ok from c group by provider)
  select c.provider, count(*) as calls, count(*) filter (not ok) as failures,
    count(*) filter (not ok and (last_ok is null or id > last_ok)) as consecutive_failures,
    coalesce(arg_max(props, id) filter (not ok), '') as last_error
  from c join l on l.provider = c.provider group by c.provider""")
def _(spark, sf):
    calls = table(spark, sf, "events").select(
        F.col("user_id").alias("provider"), F.col("event_id").alias("id"), F.col("ts").alias("at"),
        (F.col("event_type") != "error").alias("ok"), F.col("props").alias("error"),
    )
    return ops.provider_health(calls)
