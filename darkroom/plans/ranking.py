"""Ranking queries: order lines read as the candidate detections of one image (the order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkroom.operators import masks, ranking as ops
from darkroom.plans.evaluation import rounded
from darkroom.plans.registry import Registry
from darkroom.plans.tables import table

plans = Registry()

INDEX = ["l_linenumber", "l_partkey", "l_suppkey"]


def detections(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), *INDEX,
        (F.abs("l_discount") * 10).alias("score"), (F.col("l_quantity") / 50).alias("cx"),
        (F.abs("l_tax") * 12.5).alias("cy"), F.lit(0.25).alias("w"),
        (F.col("l_extendedprice") / 500000 - 0.1).alias("h"),
        (F.abs("l_tax") * 12.5).alias("iou"),
    )


DETS = """d as (select l_orderkey as image_id, l_linenumber, l_partkey, l_suppkey, abs(l_discount) * 10 as score,
    l_quantity / 50 as cx, abs(l_tax) * 12.5 as cy, 0.25::double as w, l_extendedprice / 500000 - 0.1 as h,
    abs(l_tax) * 12.5 as iou,
    row_number() over (partition by l_orderkey order by abs(l_discount) * 10 desc, l_linenumber, l_partkey,
      l_suppkey) as rank from lineitem)"""

CUT = DETS + """, cut as (select *, greatest(least(cx - w / 2, 1), 0) as x0, greatest(least(cy - h / 2, 1), 0) as y0,
    greatest(least(cx + w / 2, 1), 0) as x1, greatest(least(cy + h / 2, 1), 0) as y1 from d
    where rank <= 5 and score >= 0.25),
  kept as (select * from cut where x1 > x0 and y1 > y0)"""


@plans.add("wn6_top_candidates", f"""with {CUT} select image_id, l_linenumber, l_partkey, l_suppkey, rank, score,
  x0, y0, x1, y1 from kept""")
def _(spark, sf):
    cut = ops.top_candidates(detections(spark, sf), "image_id", INDEX)
    return cut.withColumn("rank", F.col("rank").cast("bigint")).select(
        "image_id", *INDEX, "rank", "score", "x0", "y0", "x1", "y1"
    )


def candidates(spark, sf):
    """The ungated best five of each image, with their outcome."""
    from darkroom.operators.ordered import top_per_key

    dets = detections(spark, sf)
    return top_per_key(dets, ["image_id"], [F.col("score").desc(), *INDEX], 5)


@plans.add("wn7_top2_margin", f"""with {DETS}, t as (select image_id, count(*) as candidates,
    max(score) filter (rank = 1) as a, max(score) filter (rank = 2) as b from d where rank <= 5 group by image_id)
  select image_id, candidates, round(least(greatest(coalesce(a - b, 1.0), 0), 1), 6) as margin,
    b is not null and a - b < 0.15 as ambiguous from t""")
def _(spark, sf):
    return rounded(ops.top2_margin(candidates(spark, sf), "image_id"))


@plans.add("wn7_top2_margin_report", f"""with {DETS}, t as (select image_id, count(*) as candidates,
    max(score) filter (rank = 1) as a, max(score) filter (rank = 2) as b from d where rank <= 5 group by image_id)
  select image_id, candidates, round(coalesce(a - b, 0.0), 6) as margin,
    b is not null and a - b < 0.15 as ambiguous from t""")
def _(spark, sf):
    return rounded(ops.top2_margin(candidates(spark, sf), "image_id", lone=0.0, serving=False))


SAMPLES = DETS + """, c as (select * from d where rank <= 5), s as (select image_id, count(*) as n,
    coalesce(max(score) filter (rank = 1) - max(score) filter (rank = 2), 0.0) as margin,
    coalesce(bool_or(iou >= 0.5) filter (rank = 1), false) as top1, min(rank) filter (iou >= 0.5) as fh,
    max(iou) filter (rank <= 1) as b1, max(iou) filter (rank <= 2) as b2, max(iou) filter (rank <= 3) as b3,
    max(iou) filter (rank <= 4) as b4, max(iou) filter (rank <= 5) as b5 from c group by image_id)"""


@plans.add("ag10_hit_curve", f"""with {SAMPLES} select k, round(avg(coalesce(fh <= k, false)::int), 6) as hit_rate,
  round(avg(case k when 1 then b1 when 2 then b2 when 3 then b3 when 4 then b4 else b5 end), 6) as miou
  from s, (select unnest([1, 2, 3, 4, 5]) as k) group by k""")
def _(spark, sf):
    return rounded(ops.hit_curve(candidates(spark, sf), "image_id"))


@plans.add("ag11_margin_signal", f"""with {SAMPLES} select cut as margin_below, round(avg((margin < cut)::int), 6) as share_asked,
  round(avg(top1::int) filter (margin < cut), 6) as hit_narrow, round(avg(top1::int) filter (margin >= cut), 6) as hit_wide
  from s, (select unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5]::double[]) as cut) group by cut
  having count(*) filter (margin < cut) > 0 and count(*) filter (margin >= cut) > 0""")
def _(spark, sf):
    return rounded(ops.margin_signal(ops.samples_from(candidates(spark, sf), "image_id")))


@plans.add("ag12_ambiguity_report", f"""with {SAMPLES} select count(*) as n,
  round(avg(coalesce(fh <= 5, false)::int) - avg(coalesce(fh <= 1, false)::int), 6) as gain_from_picking,
  round(avg(b5) - avg(b1), 6) as miou_gain, quantile_cont(n::double, 0.5) as median_candidates from s""")
def _(spark, sf):
    return rounded(ops.ambiguity_report(candidates(spark, sf), "image_id"))


@plans.add("jn8_surviving_score", f"""with {DETS}, r as (select o_orderkey as image_id, 0.0 as rx0, 0.0 as ry0,
    (o_custkey % 7) / 7.0 as rx1, (o_custkey % 11) / 11.0 as ry1 from orders),
  b as (select d.image_id, score, cx - w / 2 as x0, cx + w / 2 as x1, cy - abs(h) as y0, cy + abs(h) as y1 from d
    where rank <= 5 and score >= 0.25),
  f as (select b.image_id, max(score) as s from b join r on r.image_id = b.image_id
    where greatest(0, least(x1, rx1) - greatest(x0, rx0)) * greatest(0, least(y1, ry1) - greatest(y0, ry0))
      / greatest((x1 - x0) * (y1 - y0), 1e-6) >= 0.3 group by b.image_id)
  select r.image_id, coalesce(s, 0.0) as still_there from r left join f on f.image_id = r.image_id""")
def _(spark, sf):
    dets = detections(spark, sf).withColumns(
        {
            "x0": F.col("cx") - F.col("w") / 2, "x1": F.col("cx") + F.col("w") / 2,
            "y0": F.col("cy") - F.abs("h"), "y1": F.col("cy") + F.abs("h"),
        }
    )
    regions = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.lit(0.0).alias("rx0"), F.lit(0.0).alias("ry0"),
        (F.col("o_custkey") % 7 / 7.0).alias("rx1"), (F.col("o_custkey") % 11 / 11.0).alias("ry1"),
    )
    return masks.surviving_score(dets, regions, INDEX)


@plans.add("wn8_natural_top", "select p_name as name, p_partkey as id from part order by length(p_name), p_name, p_partkey limit 50")
def _(spark, sf):
    names = table(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.col("p_partkey").alias("id")
    )
    return ops.natural_top(names, "name", 50, "id")


@plans.add("wn9_cap_per_group", """select vec_id, unnest([0, 1, 2, 3])::integer as place,
    unnest(embedding[1:4]) as item from embeddings""")
def _(spark, sf):
    capped = ops.cap_per_group(table(spark, sf, "embeddings"), F.col("embedding"), 4)
    return capped.select("vec_id", "place", "item")


@plans.add("wn10_even_sample", """with t as (select l_orderkey as clip, count(*) as total from lineitem group by 1)
  select clip, total, round_even(total * i / 4.0, 0)::bigint as frame from t, (select unnest([1, 2, 3]) as i)""")
def _(spark, sf):
    clips = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("clip")).agg(
        F.count(F.lit(1)).alias("total")
    )
    return ops.even_sample(clips, "total", 3)


@plans.add("wn17_grid_thin", """with p as (select l_suppkey as mask_id, l_partkey % 100 as x, l_quantity::bigint as y,
    row_number() over (partition by l_suppkey, (l_partkey % 100) // 8, l_quantity::bigint // 8
      order by l_quantity, l_partkey % 100) as rn from lineitem)
  select mask_id, x, y from p where rn = 1""")
def _(spark, sf):
    points = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("mask_id"), (F.col("l_partkey") % 100).alias("x"),
        F.col("l_quantity").cast("bigint").alias("y"),
    )
    return ops.grid_thin(points, "mask_id").select("mask_id", "x", "y")
