"""Evaluation report queries over order lines read as scored edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkroom.functions import policy
from darkroom.operators import evaluation as ops
from darkroom.operators.ranks import spearman
from darkroom.operators.tuning import chooser_report
from darkroom.plans.registry import Registry
from darkroom.plans.tables import table

plans = Registry()

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def rounded(df, digits=6, skip=()):
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double" and f.name not in skip]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def grounding(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.round(F.col("l_quantity") / 50, 4).alias("iou"),
        F.round(F.col("l_extendedprice") / 10000, 2).alias("seconds"),
        F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("words"),
    )


GROUNDING = """g as (select round(l_quantity / 50, 4) as iou, round(l_extendedprice / 10000, 2) as seconds,
  l_returnflag as source, l_linenumber as words from lineitem)"""


@plans.add("ag4_iou_summary", f"""with {GROUNDING} select count(*) as n, round(avg(iou), 6) as miou,
  round(avg((iou >= 0.5)::int), 6) as precision_50, round(avg((iou >= 0.7)::int), 6) as precision_70,
  round(avg((iou < 0.1)::int), 6) as failures_10, round(quantile_cont(iou, 0.5), 6) as median_iou,
  round(quantile_cont(seconds, 0.5), 6) as median_seconds from g""")
def _(spark, sf):
    return rounded(ops.iou_summary(grounding(spark, sf)))


@plans.add("ag5_iou_by_source", f"""with {GROUNDING} select source, count(*) as n, round(avg(iou), 6) as miou
  from g group by source""")
def _(spark, sf):
    return rounded(ops.iou_by(grounding(spark, sf), F.col("source"), "source"))


@plans.add("ag5_iou_by_length", f"""with {GROUNDING} select
  case when words <= 5 then '<= 5 words' else '> 5 words' end as length, count(*) as n,
  round(avg(iou), 6) as miou from g group by 1""")
def _(spark, sf):
    return rounded(ops.iou_by(grounding(spark, sf), ops.by_phrase_length(F.col("words")), "length"))


def paired(spark, sf):
    a, b = F.col("l_quantity") / 50, F.col("l_extendedprice") / 105000
    routed = F.when(F.col("l_linestatus") == "O", a).otherwise(b)
    return table(spark, sf, "lineitem").select(
        *LINE, F.col("l_returnflag").alias("dataset"), a.alias("arm_a"), b.alias("arm_b"),
        routed.alias("routed"),
        F.when(F.col("l_linestatus") == "F", F.abs("l_discount") * 10).alias("baseline"),
        (F.col("l_extendedprice") / 1000).alias("cost_a"), (F.col("l_quantity") * 2).alias("cost_b"),
        (F.abs("l_tax") * 10).alias("semantic_a"), (F.abs("l_discount") * 10).alias("semantic_b"),
        F.col("l_quantity").alias("psnr"), (F.col("l_quantity") / 10).alias("seconds"),
        (F.abs(routed - F.greatest(a, b)) < 1e-6).alias("matched"),
    )


PAIRED = """p0 as (select *, l_quantity / 50 as arm_a, l_extendedprice / 105000 as arm_b from lineitem),
paired as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag as dataset, arm_a, arm_b,
  case when l_linestatus = 'O' then arm_a else arm_b end as routed,
  case when l_linestatus = 'F' then abs(l_discount) * 10 end as baseline,
  l_extendedprice / 1000 as cost_a, l_quantity * 2 as cost_b, abs(l_tax) * 10 as semantic_a,
  abs(l_discount) * 10 as semantic_b, l_quantity as psnr, l_quantity / 10 as seconds,
  abs(case when l_linestatus = 'O' then arm_a else arm_b end - greatest(arm_a, arm_b)) < 1e-6 as matched
  from p0)"""


@plans.add("ag6_paired_summary", f"""with {PAIRED} select dataset, count(*) as n, round(avg(arm_a), 6) as mean_a,
  round(avg(arm_b), 6) as mean_b, round(avg(routed), 6) as mean_routed,
  round(avg(greatest(arm_a, arm_b)), 6) as mean_oracle, round(avg(baseline), 6) as mean_baseline,
  round(avg(psnr), 6) as psnr_routed, count(*) filter (arm_a >= arm_b) as wins_a,
  count(*) filter (arm_a < arm_b) as wins_b, round(avg(matched::int), 6) as router_picked_the_winner,
  round(quantile_cont(seconds, 0.5), 6) as median_seconds from paired group by dataset""")
def _(spark, sf):
    return rounded(ops.paired_summary(paired(spark, sf)))


@plans.add("ag7_proxy_report", f"""with {PAIRED}, fills as (
    select dataset, 0 as arm, l_orderkey, l_linenumber, l_partkey, l_suppkey, arm_a as outcome,
      cost_a as cost, semantic_a as semantic from paired union all
    select dataset, 1, l_orderkey, l_linenumber, l_partkey, l_suppkey, arm_b, cost_b, semantic_b from paired),
  r as (select dataset,
    row_number() over (partition by dataset order by outcome, arm, l_orderkey, l_linenumber, l_partkey, l_suppkey) as ro,
    row_number() over (partition by dataset order by cost, arm, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rc,
    row_number() over (partition by dataset order by semantic, arm, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rs
    from fills),
  s as (select dataset, count(*) as n_fills, round(corr(ro, rc), 6) as spearman_cost,
    round(corr(ro, rs), 6) as spearman_semantic from r group by dataset),
  k as (select dataset, count(*) filter (arm_a < arm_b) * 2 >= count(*) as second,
    avg(((cost_a <= cost_b) = (arm_a >= arm_b))::int) as cp,
    avg(((semantic_a >= semantic_b) = (arm_a >= arm_b))::int) as sp, avg((arm_a >= arm_b)::int) as ash,
    avg(greatest(arm_a, arm_b)) as o, avg(arm_a) as a, avg(arm_b) as b from paired group by dataset)
  select s.*, round(cp, 6) as cost_picks, round(sp, 6) as semantic_picks,
    round(case when second then 1 - ash else ash end, 6) as majority_picks,
    case when second then 'b' else 'a' end as majority,
    round(o - case when second then b else a end, 6) as oracle_gain from s join k on k.dataset = s.dataset""")
def _(spark, sf):
    return rounded(ops.proxy_report(paired(spark, sf), LINE))


@plans.add("ag8_spearman", """with r as (select
    row_number() over (order by l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rx,
    row_number() over (order by l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) as ry
    from lineitem) select count(*) as n, round(corr(rx, ry), 6) as rho from r""")
def _(spark, sf):
    return rounded(spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", LINE))


@plans.add("ag20_head_to_head", f"""with {PAIRED} select case when cost_a < cost_b then 'cost_a' else 'cost_b' end
  as winner, count(*) as wins from paired group by 1""")
def _(spark, sf):
    judged = ops.head_to_head(paired(spark, sf), "cost_a", "cost_b", lower_wins=True)
    return ops.win_counts(judged)


@plans.add("ag17_chooser_report", f"""with {PAIRED}, c as (select *, (arm_a < arm_b)::int as label,
    (cost_a > cost_b)::int as predicted from paired),
  s as (select count(*) as n, avg(label) as bs, avg(arm_a) as a, avg(arm_b) as b, avg(matched::int) as ra,
    avg(routed) as orr, avg((predicted = label)::int) as la,
    avg(case when predicted = 1 then arm_b else arm_a end) as ol,
    avg(case when label = 1 then arm_b else arm_a end) as oo from c)
  select n, round(ra, 6) as router_accuracy, round(orr, 6) as outcome_router, round(la, 6) as learned_accuracy,
    round(ol, 6) as outcome_learned, round(oo, 6) as outcome_oracle,
    round(case when bs > 0.5 then bs else 1 - bs end, 6) as majority_accuracy,
    round(case when bs > 0.5 then b else a end, 6) as outcome_majority,
    case when n < 20 then 'refuse: too few labelled rows'
      when ol - case when bs > 0.5 then b else a end > 0.005 then 'adopt'
      when la - case when bs > 0.5 then bs else 1 - bs end > 0.05
        then 'reject: accurate only where the choice barely matters'
      else 'reject: no better than the majority' end as verdict from s""")
def _(spark, sf):
    judged = paired(spark, sf).withColumns(
        {
            "label": (F.col("arm_a") < F.col("arm_b")).cast("int"),
            "predicted": (F.col("cost_a") > F.col("cost_b")).cast("int"),
        }
    )
    return rounded(chooser_report(judged))


@plans.add("sc8_fill_cost", """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(l_quantity + abs(l_tax) + 12 * abs(ln(greatest(abs(l_discount), 1e-3))), 6) as cost from lineitem""")
def _(spark, sf):
    cost = policy.fill_cost(F.col("l_quantity"), F.abs("l_tax"), F.abs("l_discount"))
    return table(spark, sf, "lineitem").select(*LINE, F.round(cost, 6).alias("cost"))


@plans.add("sc9_compare_cost", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity + 25 *
  greatest(l_suppkey - l_partkey, 0)::double / greatest(l_partkey, 1)) - l_extendedprice / 1000 as delta
  from lineitem""")
def _(spark, sf):
    delta = policy.compare_cost(
        F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_partkey"), F.col("l_suppkey")
    )
    return table(spark, sf, "lineitem").select(*LINE, delta.alias("delta"))


def planned(spark, sf):
    return table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "rule").when(F.col("o_orderstatus") == "O", "model")
        .otherwise("ask").alias("route"),
        F.when(F.col("o_orderpriority") != "5-LOW", "remove").alias("expected_op"),
        (F.col("o_totalprice") > 250000).alias("correct"),
        F.when(F.col("o_custkey") > 500, "holdout").otherwise("authored").alias("split"),
        (F.col("o_totalprice") / 40000).alias("seconds"), F.col("o_custkey").alias("tokens"),
        (F.col("o_orderpriority") == "3-MEDIUM").alias("unmeasured"),
    )


@plans.add("ag9_planner_summary", """with r as (select case o_orderstatus when 'F' then 'rule' when 'O' then 'model'
    else 'ask' end as route, case when o_orderpriority <> '5-LOW' then 'remove' end as expected_op,
    (o_totalprice > 250000)::int as correct, case when o_custkey > 500 then 'holdout' else 'authored' end as split,
    o_totalprice / 40000 as seconds, o_custkey as tokens, o_orderpriority = '3-MEDIUM' as un from orders),
  m as (select * from r where not un), l as (
  select 'counts' as section, 'n' as name, count(*)::double as value from m
  union all select 'counts', 'unmeasured', count(*)::double from r where un
  union all select 'accuracy', 'overall', coalesce(avg(correct), 0) from m
  union all select 'accuracy', 'rule', coalesce(avg(correct), 0) from m where route = 'rule'
  union all select 'accuracy', 'model', coalesce(avg(correct), 0) from m where route = 'model'
  union all select 'accuracy', 'on_edits', coalesce(avg(correct), 0) from m where expected_op is not null
  union all select 'accuracy', 'on_refusals', coalesce(avg(correct), 0) from m where expected_op is null
  union all select 'seconds', 'model_max', coalesce(max(seconds), 0) from m where route = 'model'
  union all select 'seconds', 'over_deadline', count(*)::double from m where route = 'model' and seconds > 10
  union all select 'tokens', 'total', sum(tokens)::double from m
  union all select 'tokens', 'per_model_call', avg(tokens) from m where route = 'model'
  union all select 'coverage', route, count(*)::double / (select count(*) from m) from m group by route
  union all select 'by_split', split, avg(correct) from m group by split
  union all select 'seconds', route || '_median', quantile_cont(seconds, 0.5) from m
    where route in ('rule', 'model') group by route)
  select section, name, round(value, 6) as value from l""")
def _(spark, sf):
    return rounded(ops.planner_summary(planned(spark, sf)))


SPLIT_DAY = "1998-04-15 00:00:00"


def runs_of_orders(spark, sf):
    """(baseline, current): each customer's orders before and from one day."""
    orders = table(spark, sf, "orders")

    def side(rows):
        last = F.max_by(F.struct("o_orderstatus", "o_orderpriority"), "o_orderkey")
        return rows.groupBy("o_custkey").agg(
            last.alias("l"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo")
        ).select(
            F.col("o_custkey").cast("string").alias("id"),
            F.when(F.col("l.o_orderstatus") == "F", "ok").when(F.col("l.o_orderstatus") == "O", "failed")
            .otherwise("skipped").alias("status"),
            (F.col("hi") / 10000).alias("cost"), (F.col("lo") / 500000).alias("bbox_iou"),
            F.substring(F.sha2(F.floor("lo").cast("string").cast("binary"), 256), 1, 16).alias("signature"),
            F.col("l.o_orderpriority").alias("passes"),
        )

    day = F.lit(SPLIT_DAY).cast("timestamp")
    return side(orders.where(F.col("o_orderdate") < day)), side(orders.where(F.col("o_orderdate") >= day))


def _side(name, test):
    return f"""{name} as (select cast(o_custkey as varchar) as id,
    case arg_max(o_orderstatus, o_orderkey) when 'F' then 'ok' when 'O' then 'failed' else 'skipped' end as status,
    max(o_totalprice) / 10000 as cost, min(o_totalprice) / 500000 as iou,
    substr(sha256(cast(cast(floor(min(o_totalprice)) as bigint) as varchar)), 1, 16) as sig,
    arg_max(o_orderpriority, o_orderkey) as passes from orders where o_orderdate {test} timestamp '{SPLIT_DAY}'
    group by o_custkey)"""


FINDINGS = f"""{_side('b', '<')}, {_side('c', '>=')},
  j as (select b.id, b.status as s0, c.status as s1, b.cost as c0, c.cost as c1, b.iou as i0, c.iou as i1,
    b.passes as p0, c.passes as p1, (c.cost - b.cost) / b.cost as ch,
    list_max([abs(('0x' || substr(b.sig, 2*i+1, 2))::int - ('0x' || substr(c.sig, 2*i+1, 2))::int)
      for i in range(8)])::double / 255.0 as mv from b join c on c.id = b.id),
  f as (
  select id as "case", 'missing' as kind, 'in the baseline but not in this run' as detail, true as blocking, 0 as seq
    from b where id not in (select id from c)
  union all select id, 'new', 'not in the baseline; record it if intended', false, 1 from c
    where id not in (select id from b)
  union all select id, 'status', s0 || ' -> ' || s1, s0 = 'ok', 2 from j where s0 <> s1
  union all select id, 'cost', format('{{:.1f}} -> {{:.1f}} (', c0, c1) || case when ch >= 0 then '+' else '-' end
    || format('{{:.0f}}', abs(ch) * 100) || '%)', false, 3 from j where abs(ch) > 0.05
  union all select id, 'grounding', format('IoU {{:.3f}} -> {{:.3f}}', i0, i1), true, 4 from j where i0 - i1 > 0.05
  union all select id, 'image', format('the result changed (distance {{:.3f}})', mv), false, 5 from j where mv > 0.02
  union all select id, 'route', p0 || ' -> ' || p1, false, 6 from j where p0 <> p1)"""


@plans.add("jn6_baseline_diff", f"""with {FINDINGS} select "case", kind, detail, blocking, seq from f""")
def _(spark, sf):
    return ops.baseline_diff(*runs_of_orders(spark, sf))


@plans.add("so1_order_findings", f"""with {FINDINGS} select "case", kind, blocking, seq,
  row_number() over (order by blocking desc, "case", seq) as place from f""")
def _(spark, sf):
    from darkroom.operators.ranks import ordinal_rank

    found = ops.baseline_diff(*runs_of_orders(spark, sf)).select("case", "kind", "blocking", "seq")
    placed = ordinal_rank(found, [F.col("blocking").desc(), "case", "seq"], "place")
    return placed.withColumn("place", F.col("place") + 1)


@plans.add("su2_missing_and_new", f"""with {_side('b', '<')}, {_side('c', '>=')}
  select id, 'missing' as kind from b where id not in (select id from c) union all
  select id, 'new' from c where id not in (select id from b)""")
def _(spark, sf):
    return ops.missing_and_new(*runs_of_orders(spark, sf), "id")


@plans.add("sc10_signature_distance", """select o_orderkey, list_max([abs(('0x' || substr(a, 2*i+1, 2))::int
    - ('0x' || substr(b, 2*i+1, 2))::int) for i in range(32)])::double / 255.0 as distance
  from (select o_orderkey, sha256(cast(o_orderkey as varchar)) as a, sha256(cast(o_custkey as varchar)) as b
    from orders)""")
def _(spark, sf):
    digest = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        policy.signature_distance(digest("o_orderkey"), digest("o_custkey")).alias("distance"),
    )


@plans.add("pf3_exclude_remote", """select p_partkey as id, case when p_type = 'ECONOMY' then 'add' when p_type = 'SMALL'
    then 'replace' when p_type = 'LARGE' then null else 'remove' end as op from part
  where p_type not in ('ECONOMY', 'SMALL')""")
def _(spark, sf):
    op = F.when(F.col("p_type") == "ECONOMY", "add").when(F.col("p_type") == "SMALL", "replace").when(
        F.col("p_type") != "LARGE", "remove"
    )
    return ops_exclude(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), op.alias("op")))


def ops_exclude(df):
    from darkroom.functions.specs import exclude_remote

    return exclude_remote(df)


@plans.add("su4_tagged_union", """select l_returnflag as dataset, l_orderkey as id, l_quantity as score from lineitem""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("score"), "l_returnflag"
    )
    frames = {f: lines.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in ("A", "N", "R")}
    return ops.tagged_union(frames)


PASS_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def passes(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", *PASS_ORDER, (F.col("l_discount") - F.col("l_tax")).alias("delta"),
        F.col("l_extendedprice").alias("cost"), F.lit(200000.0).alias("start_cost"),
        F.when(F.col("l_returnflag") == "A", "fast").when(F.col("l_returnflag") == "R", "escalate")
        .otherwise("residual").alias("strategy"),
        (F.col("l_quantity") > 10).alias("attempted"),
    )


CARRIED = """carried as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount - l_tax < 0 as kept,
    coalesce(last_value(case when l_discount - l_tax < 0 then l_extendedprice end ignore nulls) over (
      partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey
      rows between unbounded preceding and current row), 200000.0) as cost_after,
    case l_returnflag when 'A' then 'fast' when 'R' then 'escalate' else 'residual' end as strategy,
    l_quantity > 10 as attempted from lineitem)"""


@plans.add("wn16_carry_incumbent", f"""with {CARRIED} select l_orderkey, l_linenumber, l_partkey, l_suppkey, kept,
  cost_after from carried""")
def _(spark, sf):
    carried = ops.carry_incumbent(passes(spark, sf), "l_orderkey", PASS_ORDER)
    return carried.select("l_orderkey", *PASS_ORDER, "kept", "cost_after")


@plans.add("ag18_pass_summary", f"""with {CARRIED} select l_orderkey, count(*) as passes, count(*) filter (kept) as kept,
  count(*) filter (attempted and not kept) as rolled_back, count(*) filter (not attempted) as not_applicable,
  arg_max(cost_after, (l_linenumber, l_partkey, l_suppkey)) as cost,
  string_agg(strategy || case when kept then '' when attempted then ' (rolled back)' else ' (n/a)' end, ' -> '
    order by l_linenumber, l_partkey, l_suppkey) as route from carried group by l_orderkey""")
def _(spark, sf):
    carried = ops.carry_incumbent(passes(spark, sf), "l_orderkey", PASS_ORDER)
    return ops.pass_summary(carried, "l_orderkey", PASS_ORDER)


@plans.add("ag19_review_summary", """with r as (select conv_id as job_id, turn, case role when 'user' then 'widen'
    when 'assistant' then 'accept' else 'stop' end as action from conversations),
  s as (select job_id, count(*) as reviews, count(*) filter (action = 'widen') as retries,
    arg_max(action, turn) as action from r group by job_id)
  select *, case when retries > 0 and action = 'accept' then
      'checked, widened the selection ' || retries || 'x, and accepted the result'
    when action = 'stop' then 'checked; out of budget, returning the best attempt'
    else 'checked the result' end as sentence from s""")
def _(spark, sf):
    action = F.when(F.col("role") == "user", "widen").when(F.col("role") == "assistant", "accept").otherwise("stop")
    return ops.review_summary(
        table(spark, sf, "conversations").select(
            F.col("conv_id").alias("job_id"), F.col("turn").alias("attempt"), action.alias("action")
        )
    )


@plans.add("wn18_rank_variants", """select l_orderkey as "case", l_discount + 0.0 as iou, l_quantity as cost, l_linenumber as line,
  rank() over (partition by l_orderkey order by l_discount desc, l_quantity) as rank from lineitem""")
def _(spark, sf):
    tried = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case"), (F.col("l_discount") + 0.0).alias("iou"),
        F.col("l_quantity").alias("cost"), F.col("l_linenumber").alias("line"),
    )
    return ops.rank_variants(tried, "case")


@plans.add("pf7_changed_fraction", """with a as (select l_partkey as k, floor(avg(l_quantity)) as c1, max(l_linenumber) * 3 as c2
    from lineitem group by l_partkey)
  select p_brand, count(*) as compared, round(avg((greatest(abs(p_size - c1), abs(p_size - c2)) > 8)::int), 6) as changed
  from part join a on a.k = p_partkey group by p_brand""")
def _(spark, sf):
    before = table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), "p_brand", F.col("p_size").alias("c1"), F.col("p_size").alias("c2")
    )
    after = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(
        F.floor(F.avg("l_quantity")).alias("c1"), (F.max("l_linenumber") * 3).alias("c2")
    )
    return rounded(ops.changed_fraction(before, after, ["k"], ["c1", "c2"], by=["p_brand"]))


@plans.add("sc21_blank_fill", """select l_orderkey as region_id,
  round((avg(l_quantity * 1.01) + avg(abs(l_discount) * 97) + avg(abs(l_tax) * 100)) / 3, 6) as mean,
  round(greatest(stddev_pop(l_quantity * 1.01), stddev_pop(abs(l_discount) * 97), stddev_pop(abs(l_tax) * 100)), 6) as spread,
  (avg(l_quantity * 1.01) + avg(abs(l_discount) * 97) + avg(abs(l_tax) * 100)) / 3 < 16 and
  greatest(stddev_pop(l_quantity * 1.01), stddev_pop(abs(l_discount) * 97), stddev_pop(abs(l_tax) * 100)) < 8 as blank
  from lineitem group by l_orderkey""")
def _(spark, sf):
    pixels = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("region_id"), (F.col("l_quantity") * 1.01).alias("r"),
        (F.abs("l_discount") * 97).alias("g"), (F.abs("l_tax") * 100).alias("b"),
    )
    return rounded(ops.blank_regions(pixels, ["r", "g", "b"]))
