"""Mask queries: the sign pattern of each 64-value vector read as an 8 by 8 mask."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkroom.functions import specs
from darkroom.operators import masks as ops
from darkroom.plans.evaluation import rounded
from darkroom.plans.registry import Registry
from darkroom.plans.tables import table

plans = Registry()

SIDE = 8


def sizes(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("mask_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height")
    )


def pixels(spark, sf, level=0.0):
    each = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return each.select(
        F.col("vec_id").alias("mask_id"), F.floor(F.col("i") / SIDE).alias("x"),
        (F.col("i") % SIDE).cast("bigint").alias("y"),
        (F.col("e").cast("double") > level).cast("int").alias("v"),
    )


def runs(spark, sf, level=0.0):
    return ops.rle_encode(pixels(spark, sf, level), sizes(spark, sf))


def _px(name, level="0.0"):
    return f"""{name} as (select vec_id as mask_id, i, (embedding[i + 1]::double > {level})::int as v from embeddings,
    (select unnest(range(64)) as i))"""


RUNS = _px("px") + """, tn as (select *, (v <> coalesce(lag(v) over (partition by mask_id order by i), 0))::int as t from px),
  nr as (select *, sum(t) over (partition by mask_id order by i rows unbounded preceding) as rn from tn),
  r0 as (select mask_id, rn::bigint as run_no, min(i)::bigint as start, count(*) as len from nr group by mask_id, rn),
  runs as (select * from r0 union all select mask_id, 0, 0, 0 from r0 where start = 0 and run_no = 1)"""


@plans.add("wn13_rle_encode", f"with {RUNS} select mask_id, run_no, start, len from runs")
def _(spark, sf):
    return runs(spark, sf)


@plans.add("wn13_packed_counts", f"""with {RUNS} select mask_id, string_agg(len, ',' order by run_no) as counts
  from runs group by mask_id""")
def _(spark, sf):
    packed = ops.pack_runs(runs(spark, sf))
    return packed.select("mask_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@plans.add("wn14_rle_decode", f"""with {_px('px')} select mask_id, (i // 8)::bigint as x, (i % 8)::bigint as y, v from px""")
def _(spark, sf):
    masks = sizes(spark, sf)
    packed = ops.pack_runs(runs(spark, sf))
    return ops.rle_decode(ops.runs_of(packed), masks, chunk=16)


@plans.add("jn7_mask_iou", f"""with {_px('p')}, {_px('q', '0.05')} select p.mask_id as pair_id,
  round(case when sum(greatest(p.v, q.v)) > 0 then sum(p.v * q.v) / sum(greatest(p.v, q.v)) else 0.0 end, 6) as iou,
  round(case when sum(p.v) > 0 then sum(p.v * q.v) / sum(p.v) else 0.0 end, 6) as precision,
  round(case when sum(q.v) > 0 then sum(p.v * q.v) / sum(q.v) else 0.0 end, 6) as recall
  from p join q on q.mask_id = p.mask_id and q.i = p.i group by p.mask_id""")
def _(spark, sf):
    named = lambda level: ops.set_runs(runs(spark, sf, level)).withColumnRenamed("mask_id", "pair_id")
    pairs = sizes(spark, sf).select(F.col("mask_id").alias("pair_id"))
    return rounded(ops.mask_iou(pairs, named(0.0), named(0.05), bucket=16))


GEO = """geo as (select mask_id, sum(v) as area, min(i // 8) filter (v = 1) as min_x, max(i // 8) filter (v = 1) as max_x,
    min(i % 8) filter (v = 1) as min_y, max(i % 8) filter (v = 1) as max_y from px group by mask_id)"""


@plans.add("ag25_mask_geometry", f"""with {_px('px', '0.15')}, {GEO} select mask_id, area::bigint as area, area / 64.0 as coverage,
  min_x::bigint as min_x, min_y::bigint as min_y, max_x::bigint as max_x, max_y::bigint as max_y,
  round(coalesce(area / ((max_x - min_x + 1) * (max_y - min_y + 1)), 0.0), 6) as solidity,
  round(coalesce(greatest(max_x - min_x + 1, max_y - min_y + 1) / greatest(least(max_x - min_x + 1, max_y - min_y + 1), 1), 1.0), 6) as aspect,
  coalesce(greatest(max_x - min_x + 1, max_y - min_y + 1) / 8.0, 0.0) as relative_scale,
  min_x / 8.0 as x0, min_y / 8.0 as y0, (max_x + 1) / 8.0 as x1, (max_y + 1) / 8.0 as y1 from geo""")
def _(spark, sf):
    return rounded(ops.mask_geometry(ops.set_runs(runs(spark, sf, 0.15)), sizes(spark, sf)))


@plans.add("ag26_box_metrics", f"""with {_px('px', '0.15')}, {GEO},
  bx as (select vec_id as mask_id, round_even(0.1 * 8, 0)::int as rx0, round_even((0.4 + label / 20.0) * 8, 0)::int as rx1,
    round_even(0.2 * 8, 0)::int as ry0, round_even(0.9 * 8, 0)::int as ry1 from embeddings),
  ins as (select px.mask_id, sum(v) as n from px join bx on bx.mask_id = px.mask_id
    where v = 1 and i // 8 >= rx0 and i // 8 < rx1 and i % 8 >= ry0 and i % 8 < ry1 group by px.mask_id),
  m as (select geo.*, bx.*, coalesce(ins.n, 0) as n,
    greatest(0, least(max_x, rx1) - greatest(min_x, rx0)) * greatest(0, least(max_y, ry1) - greatest(min_y, ry0)) as it
    from geo join bx on bx.mask_id = geo.mask_id left join ins on ins.mask_id = geo.mask_id),
  f as (select mask_id, case when area > 0 then n / area else 0.0 end as inside_frac,
    case when area > 0 then n / greatest((rx1 - rx0) * (ry1 - ry0), 1) else 0.0 end as box_recall,
    case when area > 0 and (max_x - min_x) * (max_y - min_y) + (rx1 - rx0) * (ry1 - ry0) - it > 0
      then it / ((max_x - min_x) * (max_y - min_y) + (rx1 - rx0) * (ry1 - ry0) - it) else 0.0 end as bbox_iou from m)
  select mask_id, round(inside_frac, 6) as inside_frac, round(box_recall, 6) as box_recall,
    round(bbox_iou, 6) as bbox_iou, inside_frac > 0.6 and bbox_iou > 0.5 as hit from f""")
def _(spark, sf):
    boxes = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("mask_id"), F.lit(0.1).alias("x0"), F.lit(0.2).alias("y0"),
        (0.4 + F.col("label") / 20.0).alias("x1"), F.lit(0.9).alias("y1"),
    )
    return rounded(ops.box_metrics(ops.set_runs(runs(spark, sf, 0.15)), sizes(spark, sf), boxes))


@plans.add("ag24_region_consistency", """with e as (select label, embedding[1] > 0 as ins, i, embedding[i]::double as v
    from embeddings, (select unnest(range(1, 65)) as i)),
  d as (select label, i, avg(v) filter (ins) as a, avg(v) filter (not ins) as b, count(*) filter (ins) as na,
    count(*) filter (not ins) as nb from e group by label, i)
  select label, round(case when max(na) >= 4 and max(nb) >= 4 and sqrt(sum(a * a)) * sqrt(sum(b * b)) > 0
    then sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) else 0.0 end, 6) as consistency from d group by label""")
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumn("inside", F.col("embedding")[0] > 0)
    return rounded(ops.region_consistency(vectors, "label", "embedding", "inside"))


@plans.add("pv3_validate_masks", """with m as (select vec_id as mask_id, label, [floor(abs(e) * 100)::bigint for e in embedding] as counts
    from embeddings), s as (select *, list_sum(counts)::bigint as total from m),
  t as (select *, 1 as width, (total + (label >= 7)::int) as height, 10 as iw,
    (total + (label >= 7)::int) * 10 + label * 3 as ih from s)
  select mask_id, concat_ws('; ', case when total <> height then 'counts do not fill the mask' end,
    case when abs(width * ih - height * iw) > iw + ih then 'not the shape of the image' end) as violations from t""")
def _(spark, sf):
    counts = F.transform("embedding", lambda e: F.floor(F.abs(e) * 100))
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n)
    masks = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("mask_id"), "label", counts.alias("counts")
    ).withColumn("height", total + (F.col("label") >= 7).cast("int")).withColumns(
        {
            "width": F.lit(1), "image_width": F.lit(10),
            "image_height": F.col("height") * 10 + F.col("label") * 3,
        }
    )
    checked = specs.validate_masks(masks)
    return checked.select("mask_id", F.array_join("violations", "; ").alias("violations"))
