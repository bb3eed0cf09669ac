"""Gate fitting queries: labelled documents read as observations scored under both branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkroom.functions import policy
from darkroom.operators import tuning as ops
from darkroom.plans.evaluation import rounded
from darkroom.plans.registry import Registry
from darkroom.plans.tables import table

plans = Registry()


def observations(spark, sf):
    """Confidence from length; outcomes from the labels and the length."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels")
    size = F.least(F.col("n_chars") / 7919, F.lit(1.0))
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), size.alias("confidence"),
        (0.2 + 0.5 * F.col("quality") * size + 0.3 * F.col("toxic")).alias("above"),
        (0.7 - 0.6 * size).alias("below"),
        (1 - size * 0.9).alias("box_score"),
        ops.hash_split(F.col("doc_id")).alias("split"),
    )


OBS = """o0 as (select d.doc_id as id, least(n_chars::double / 7919, 1.0::double) as size, quality, toxic from documents d
    join labels l on l.doc_id = d.doc_id),
  obs as (select id, size as confidence, 0.2 + 0.5 * quality * size + 0.3 * toxic as above,
    0.7 - 0.6 * size as below, 1 - size * 0.9 as box_score,
    case when ('0x' || substr(sha256(cast(id as varchar)), 1, 8))::ubigint % 100 < 50 then 'holdout' else 'fit' end as split
    from o0)"""
GATES = "g as (select (i / 100)::double as gate from range(101) t(i))"
CURVE = """curve as (select gate, format('{:.4f}', avg(case when confidence >= gate then above else below end))::double as score
    from obs, g where split = 'fit' group by gate)"""


@plans.add("wn11_hash_split", """select doc_id, case when ('0x' || substr(sha256(cast(doc_id as varchar)), 1, 8))::ubigint % 100 < 50
  then 'holdout' else 'fit' end as split from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ops.hash_split(F.col("doc_id")).alias("split"))


@plans.add("wn11_group_split", """select doc_id, source, case when ('0x' || substr(sha256(source), 1, 8))::ubigint % 100 < 50
  then 'holdout' else 'fit' end as split from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", "source", ops.hash_split(F.col("source")).alias("split")
    )


@plans.add("jn13_gate_cross", f"with {OBS} select id, confidence, gate from obs, (select unnest([0.0, 0.5, 0.7, 0.8, 0.85]::double[]) as gate)")
def _(spark, sf):
    crossed = ops.gate_cross(observations(spark, sf), [0.0, 0.5, 0.7, 0.8, 0.85])
    return crossed.select("id", "confidence", "gate")


@plans.add("ag13_gate_sweep", f"with {OBS}, {GATES}, {CURVE} select gate, score from curve")
def _(spark, sf):
    return ops.gate_sweep(observations(spark, sf).where("split = 'fit'"))


@plans.add("ag14_best_gate", f"with {OBS}, {GATES}, {CURVE} select gate, score from curve order by score desc, gate limit 1")
def _(spark, sf):
    return ops.best_gate(ops.gate_sweep(observations(spark, sf).where("split = 'fit'")))


@plans.add("ag15_abstention_curve", f"""with {OBS}, bg as (select round(i * 0.05, 2)::double as gate from range(15) t(i)),
  c as (select *, case when confidence >= 0.3 then above else below end as v from obs where split = 'holdout')
  select gate, round(1 - count(*) filter (box_score >= gate) / count(*)::double, 6) as abstained,
    round(coalesce(sum(v) filter (box_score >= gate), 0) / count(*), 6) as miou_overall,
    round(coalesce(avg(v) filter (box_score >= gate), 0), 6) as miou_answered,
    round(coalesce(avg((v >= 0.5)::int) filter (box_score >= gate), 0), 6) as precision_50_answered
  from c, bg group by gate""")
def _(spark, sf):
    held = observations(spark, sf).where("split = 'holdout'")
    return rounded(ops.abstention_curve(held, F.lit(0.3)))


@plans.add("ag16_adopt_if_better", f"""with {OBS}, {GATES}, {CURVE},
  b as (select gate as best_gate, score as best_fit from curve order by score desc, gate limit 1),
  h as (select avg(case when confidence >= best_gate then above else below end) as hb,
    avg(case when confidence >= 0.85 then above else below end) as hd from obs, b where split = 'holdout'),
  n as (select count(*) as n, count(*) filter (split = 'fit') as fit, count(*) filter (split = 'holdout') as holdout from obs)
  select n, fit, holdout, best_gate, best_fit, round(hb, 6) as holdout_at_best, round(hd, 6) as holdout_at_default,
    n >= 40 and hb > hd as adopted, case when n >= 40 and hb > hd then best_gate else 0.85 end as gate from n, b, h""")
def _(spark, sf):
    return rounded(ops.adopt_if_better(observations(spark, sf)))


@plans.add("sc13_pick_arm", f"with {OBS} select id, case when confidence >= 0.85 then above else below end as chosen from obs")
def _(spark, sf):
    chosen = policy.pick_arm(F.col("confidence"), F.col("above"), F.col("below"), F.lit(0.85))
    return observations(spark, sf).select("id", chosen.alias("chosen"))


@plans.add("sc11_verdict_reasons", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('; ',
    case when abs(l_discount) < 0.05 then 'the edit changed almost nothing' end,
    case when l_quantity > 25 then 'the fill does not agree with what surrounds it' end,
    case when l_linestatus = 'O' and l_extendedprice / 100000 >= 0.25
      then 'what you asked to remove is still in the picture' end) as reasons from lineitem""")
def _(spark, sf):
    still = F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice") / 100000)
    reasons = policy.verdict_reasons(F.abs("l_discount"), F.col("l_quantity"), still)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.array_join(reasons, "; ").alias("reasons"),
    )


@plans.add("sc12_decide_action", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case
    when l_returnflag = 'A' then 'accept' when l_linenumber > 2 or l_quantity * 2 >= 60 then 'stop'
    when l_linestatus = 'O' then 'widen' else 'ask' end as action from lineitem""")
def _(spark, sf):
    action = policy.decide_action(
        F.col("l_returnflag") == "A", F.col("l_linenumber"), F.col("l_quantity") * 2,
        F.col("l_linestatus") == "O", F.lit(2), F.lit(60.0),
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", action.alias("action")
    )
