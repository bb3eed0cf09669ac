"""Stream questions over the event table, asked of the finished table."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkroom.functions import payloads
from darkroom.operators import folds
from darkroom.plans.registry import Registry
from darkroom.plans.tables import STEPS_SQL, steps, table
from darkroom.streaming import progress as ops
from darkroom.streaming import sequential
from darkroom.streaming.landing import land

plans = Registry()


def events(spark, sf, stream=False):
    return steps(spark, sf, stream).select("job_id", F.col("id").alias("seq"), "state", "at")


EVENTS = STEPS_SQL + """, ev as (select job_id, id as seq, state, "at" as t from steps)"""
NOW = "2024-01-30 20:00:00"


@plans.add("st1_replay_then_follow", f"""with {EVENTS}, p as (select * from ev where hour(t) < 16),
  l as (select * from ev where hour(t) >= 8)
  select job_id, seq, state, 'replay' as origin from p union all
  select job_id, seq, state, 'live' from l where not exists (select 1 from p where p.job_id = l.job_id and p.seq = l.seq)
    and job_id not in (select job_id from p where state in ('done', 'failed', 'cancelled'))""")
def _(spark, sf):
    every = events(spark, sf)
    recorded, live = every.where(F.hour("at") < 16), every.where(F.hour("at") >= 8)
    return ops.replay_then_follow(recorded, live.unionByName(live)).select("job_id", "seq", "state", "origin")


@plans.add("st2_latest_event", f"""with {EVENTS}, m as (select job_id, max(seq) as seq from ev group by job_id)
  select ev.job_id, ev.seq, ev.state from ev join m on m.job_id = ev.job_id and m.seq = ev.seq
  where epoch_us(timestamp '{NOW}') - epoch_us(t) <= 86400000000""")
def _(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    return ops.latest_event(events(spark, sf), now, 86400.0).select("job_id", "seq", "state")


def payload_rows(spark, sf):
    """Events as sent; view events are cut short and error events lack their state."""
    kind = F.col("event_type")
    whole = payloads.event_to_json(F.col("user_id"), kind, F.col("value"), F.col("props"), kind == "purchase")
    sent = (
        F.when(kind == "view", F.expr("left(payload, length(payload) - 5)"))
        .when(kind == "error", F.replace(F.col("payload"), F.lit('"state"'), F.lit('"status"')))
        .otherwise(F.col("payload"))
    )
    rows = table(spark, sf, "events").withColumn("payload", whole).withColumn("payload", sent)
    return rows.select("event_id", "payload")


@plans.add("st3_decode_events", """select event_id, cast(user_id as varchar) as job_id, event_type as state, value as progress,
  props as detail, event_type = 'purchase' as terminal from events where event_type not in ('view', 'error')""")
def _(spark, sf):
    return ops.decode_events(payload_rows(spark, sf))[0]


@plans.add("st3_rejected_events", "select event_id from events where event_type in ('view', 'error')")
def _(spark, sf):
    return ops.decode_events(payload_rows(spark, sf))[1].select("event_id")


@plans.add("st4_until_terminal", f"""with {EVENTS}, e as (select job_id, min(seq) as s from ev
    where state in ('done', 'failed', 'cancelled') group by job_id)
  select ev.job_id, ev.seq, ev.state from ev left join e on e.job_id = ev.job_id where s is null or ev.seq <= s""")
def _(spark, sf):
    return ops.until_terminal(events(spark, sf)).select("job_id", "seq", "state")


@plans.add("st4_until_terminal_stream", plans.oracles["st4_until_terminal"])
def _(spark, sf):
    return land(ops.until_terminal_stream(events(spark, sf, stream=True)).select("job_id", "seq", "state"))


@plans.add("st5_stalled_jobs", f"""with {EVENTS}, m as (select job_id, max(seq) as seq from ev group by job_id)
  select ev.job_id, ev.seq, ev.state, (epoch_us(timestamp '{NOW}') - epoch_us(t)) / 1000000.0 as idle_seconds
  from ev join m on m.job_id = ev.job_id and m.seq = ev.seq where state not in ('done', 'failed', 'cancelled')
    and (epoch_us(timestamp '{NOW}') - epoch_us(t)) / 1000000.0 >= 3600""")
def _(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    return ops.stalled_jobs(events(spark, sf), now, 3600.0).drop("at")


@plans.add("st6_rate_limit", """with recursive e as (select user_id as u, event_id as id, epoch_us(ts) as t,
    row_number() over (partition by user_id order by ts, event_id) as rn from events),
  f(u, id, t, rn, stop, used) as (
    select u, id, t, rn, t + 86400000000, 1 from e where rn = 1
    union all select e.u, e.id, e.t, e.rn, case when e.t >= f.stop then e.t + 86400000000 else f.stop end,
      case when e.t >= f.stop then 1 else f.used + 1 end from f join e on e.u = f.u and e.rn = f.rn + 1)
  select u as identity, id, used::bigint as used, used <= 3 as allowed,
    case when used <= 3 then 3 - used else 0 end::bigint as remaining,
    case when used <= 3 then 0 else greatest((((stop - t) // 1000) + 500) // 1000, 1) end::bigint as retry_after from f""")
def _(spark, sf):
    return folds.rate_limit(requests(spark, sf), 3, 86400.0).drop("at")


def requests(spark, sf, stream=False):
    return table(spark, sf, "events", stream).select(
        F.col("user_id").alias("identity"), F.col("event_id").alias("id"), F.col("ts").alias("at")
    )


@plans.add("st6_rate_limit_stream", plans.oracles["st6_rate_limit"])
def _(spark, sf):
    return land(sequential.rate_limit_stream(requests(spark, sf, stream=True), 3, 86400.0).drop("at"))


@plans.add("st7_breaker_state", """with recursive e as (select user_id as u, event_id as id, epoch_us(ts) as t,
    event_type in ('purchase', 'signup') as ok, row_number() over (partition by user_id order by ts, event_id) as rn from events),
  f(u, id, t, rn, op, c, skipped, opened, n) as (
    select u, id, t, rn, null::bigint, case when ok then 0 else 1 end, false, false, case when ok then 0 else 1 end from e where rn = 1
    union all select e.u, e.id, e.t, e.rn,
      case when f.op is not null and e.t - f.op < 86400000000 then f.op
        when not e.ok and (case when f.op is not null then 0 else f.c end) + 1 >= 3 then e.t end,
      case when f.op is not null and e.t - f.op < 86400000000 then 3
        when e.ok then 0 else (case when f.op is not null then 0 else f.c end) + 1 end,
      f.op is not null and e.t - f.op < 86400000000,
      not (f.op is not null and e.t - f.op < 86400000000) and not e.ok
        and (case when f.op is not null then 0 else f.c end) + 1 >= 3,
      case when f.op is not null and e.t - f.op < 86400000000 then 3
        when e.ok then 0 else (case when f.op is not null then 0 else f.c end) + 1 end
    from f join e on e.u = f.u and e.rn = f.rn + 1)
  select u as provider, id, skipped, opened, n::bigint as failures_in_a_row from f""")
def _(spark, sf):
    return folds.breaker_state(calls(spark, sf), 3, 86400.0).drop("at", "ok")


def calls(spark, sf, stream=False):
    return table(spark, sf, "events", stream).select(
        F.col("user_id").alias("provider"), F.col("event_id").alias("id"), F.col("ts").alias("at"),
        F.col("event_type").isin("purchase", "signup").alias("ok"),
    )


@plans.add("st7_breaker_stream", plans.oracles["st7_breaker_state"])
def _(spark, sf):
    return land(sequential.breaker_stream(calls(spark, sf, stream=True), 3, 86400.0).drop("at", "ok"))


LEGAL = """(values ('queued','planning'),('queued','cancelled'),('queued','failed'),
  ('planning','running'),('planning','cancelled'),('planning','failed'),
  ('running','review'),('running','cancelled'),('running','failed'),
  ('review','running'),('review','done'),('review','cancelled'),('review','failed')) e(a, b)"""


@plans.add("st8_guard_transitions", f"""with recursive {STEPS_SQL}, legal as (select a, b from {LEGAL}),
  n as (select *, row_number() over (partition by job_id order by "at", id) as rn from steps),
  f(job_id, id, rn, state, held, after) as (
    select job_id, id, rn, state, null::varchar, state from n where rn = 1
    union all select n.job_id, n.id, n.rn, n.state, f.after,
      case when exists (select 1 from legal where a = f.after and b = n.state) then n.state else f.after end
    from f join n on n.job_id = f.job_id and n.rn = f.rn + 1)
  select job_id, id, state, held, case when held is null or after <> held then 'accepted'
    when held = 'cancelled' then 'after cancel' when held in ('done', 'failed') then 'redelivered' else 'illegal' end as verdict from f""")
def _(spark, sf):
    return folds.guard_transitions(steps(spark, sf).select("job_id", "id", "at", "state")).drop("at")
