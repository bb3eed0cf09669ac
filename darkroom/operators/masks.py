"""Binary masks as relations: runs of set pixels, their geometry and their overlap.

Pixels are numbered column by column, ``x * height + y``. A run is a half-open range of that
index, so most questions about a mask are arithmetic on its runs and never list a pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import fixed
from darkroom.operators.ordered import by_sequence, scan, top_per_key
from darkroom.session import cut_lineage

RUN_BUCKET = 1 << 16
CHUNK = 1 << 16


def rle_encode(pixels: DataFrame, masks: DataFrame, block_rows: int = 1 << 20) -> DataFrame:
    """mask_id, run_no, start, len. Even runs are clear and odd ones set.

    ``pixels`` lists every pixel (mask_id, x, y, v) and ``masks`` the sizes. A mask whose first
    pixel is set opens with an empty clear run.

    Pixels become words of 64 bits, which every task builds of the pixels it has and which merge by
    a bitwise or; runs are read off a word by its turns, and only words meet at their ends.
    """
    i = F.col("x").cast("bigint") * F.col("height") + F.col("y")
    flat = pixels.join(masks.select("mask_id", "height"), "mask_id").select("mask_id", i.alias("i"), (F.col("v") != 0).alias("on"))
    words = flat.groupBy("mask_id", F.shiftright("i", 6).alias("word")).agg(
        F.bit_or(F.when(F.col("on"), F.expr("shiftleft(1L, cast(i & 63 as int))")).otherwise(F.lit(0).cast("bigint"))).alias("bits")
    )
    block = by_sequence("word", block_rows)
    seen = scan(words, ["mask_id"], ["word"], block, previous={"was": F.col("bits") < 0}, heavy_rows=block_rows)
    # bit j is set in turns where pixel j differs from the one before it; the first pixel always opens a run
    before = F.expr("shiftleft(bits, 1)").bitwiseOR(F.coalesce("was", F.lit(False)).cast("bigint"))
    opens = F.when(F.col("was").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    size = masks.select("mask_id", (F.col("width").cast("bigint") * F.col("height")).alias("all"))
    turning = seen.join(size, "mask_id").select("mask_id", "word", "all", "bits", F.col("bits").bitwiseXOR(before).bitwiseOR(opens).alias("turns"))
    at = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.col("word") * 64 + j),
        lambda k: (F.expr("turns").bitwiseAND(_bit(k)) != 0) & (k < F.col("all")),
    )
    turned = turning.where("turns <> 0").select("mask_id", "word", "all", "bits", at.alias("starts")).where(F.size("starts") > 0)
    # the opening turn of a clear first pixel counts no run before it: it is run 0 itself
    first_clear = (F.get("starts", 0) == 0) & (F.col("bits").bitwiseAND(F.lit(1).cast("bigint")) == 0)
    turned = turned.withColumn("count", F.size("starts").cast("bigint") - F.when(first_clear, F.lit(1)).otherwise(F.lit(0)))
    paired = scan(
        turned, ["mask_id"], ["word"], block, following={"next": F.get("starts", 0)}, running_sum={"upto": F.col("count")},
        heavy_rows=block_rows,
    )
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.col("next"), F.col("all"))
    number = lambda k: F.col("upto") - F.size("starts") + k + 1
    runs = paired.select("mask_id", F.inline(F.transform("starts", lambda s, k: F.struct(
        number(k).cast("bigint").alias("run_no"), s.alias("start"), (end(k) - s).alias("len")
    ))))
    none = F.lit(0).cast("bigint")
    opening = words.where((F.col("word") == 0) & (F.col("bits").bitwiseAND(F.lit(1).cast("bigint")) == 1)).select(
        "mask_id", none.alias("run_no"), none.alias("start"), none.alias("len")
    )
    return runs.unionByName(opening)


def _bit(index: Column) -> Column:
    """The bit of a pixel's number within its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), index.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def pack_runs(runs: DataFrame) -> DataFrame:
    """Runs back to one ``counts`` array per mask. A mask's array is one value by definition."""
    ordered = F.array_sort(F.collect_list(F.struct("run_no", "len")))
    return runs.groupBy("mask_id").agg(F.transform(ordered, lambda r: r["len"]).alias("counts"))


def runs_of(masks: DataFrame, block_rows: int = 1 << 16) -> DataFrame:
    """mask_id, run_no, start, len from ``counts`` arrays."""
    each = masks.select("mask_id", F.posexplode("counts").alias("run_no", "len")).select(
        "mask_id", F.col("run_no").cast("bigint").alias("run_no"), F.col("len").cast("bigint").alias("len")
    )
    ends = scan(each, ["mask_id"], ["run_no"], by_sequence("run_no", block_rows),
                running_sum={"end": F.col("len")}, heavy_rows=block_rows)
    return ends.select("mask_id", "run_no", (F.col("end") - F.col("len")).alias("start"), "len")


def set_runs(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("run_no") % 2 == 1) & (F.col("len") > 0)).select("mask_id", "start", "len")


def rle_decode(runs: DataFrame, masks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Runs to pixel rows. Long runs open in chunks, so no array holds a whole run."""
    sized = runs.where("len > 0").join(masks.select("mask_id", "height"), "mask_id")
    end = F.col("start") + F.col("len")
    pieces = sized.select(
        "mask_id", "height", (F.col("run_no") % 2).cast("int").alias("v"), end.alias("end"),
        F.explode(F.sequence("start", end - 1, F.lit(chunk).cast("bigint"))).alias("at"),
    )
    last = F.least(F.col("at") + chunk, F.col("end")) - 1
    return pieces.select("mask_id", "height", "v", F.explode(F.sequence("at", last)).alias("i")).select(
        "mask_id", F.floor(F.col("i") / F.col("height")).alias("x"),
        (F.col("i") % F.col("height")).alias("y"), "v",
    )


def mask_iou(
    pairs: DataFrame, predicted: DataFrame, truth: DataFrame, bucket: int = RUN_BUCKET
) -> DataFrame:
    """IoU, precision and recall per pair from set runs keyed by ``pair_id``.

    Runs meet only inside a shared (pair, bucket), so one huge mask spreads over its buckets; an
    overlap that spans buckets counts in the bucket where it begins.
    """
    end = F.col("start") + F.col("len")

    def bucketed(runs: DataFrame, side: str) -> DataFrame:
        touched = F.sequence(F.floor(F.col("start") / bucket), F.floor((end - 1) / bucket))
        return runs.where("len > 0").select(
            "pair_id", F.col("start").alias(f"{side}_start"), end.alias(f"{side}_end"),
            F.explode(touched).alias("bucket"),
        )

    begins = F.greatest("p_start", "t_start")
    overlap = F.least("p_end", "t_end") - begins
    shared = (
        bucketed(predicted, "p").join(bucketed(truth, "t"), ["pair_id", "bucket"])
        .where((overlap > 0) & (F.floor(begins / bucket) == F.col("bucket")))
        .groupBy("pair_id").agg(F.sum(overlap).alias("__i"))
    )
    area = lambda runs, name: runs.groupBy("pair_id").agg(F.sum("len").alias(name))
    wide = (
        pairs.select("pair_id").join(area(predicted, "__p"), "pair_id", "left")
        .join(area(truth, "__t"), "pair_id", "left").join(shared, "pair_id", "left")
        .fillna(0, ["__p", "__t", "__i"])
    )
    i, p, t = F.col("__i"), F.col("__p"), F.col("__t")
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return wide.select(
        "pair_id", ratio(i, p + t - i).alias("iou"), ratio(i, p).alias("precision"),
        ratio(i, t).alias("recall"),
    )


def _extents(runs: DataFrame, masks: DataFrame) -> DataFrame:
    """Area and inclusive pixel bounds per mask, empty masks included."""
    h = F.col("height")
    first, last = F.col("start"), F.col("start") + F.col("len") - 1
    column = lambda i: F.floor(i / h)
    wraps = column(first) != column(last)
    boxes = runs.join(masks.select("mask_id", "height"), "mask_id").groupBy("mask_id").agg(
        F.sum("len").alias("area"),
        F.min(column(first)).alias("min_x"), F.max(column(last)).alias("max_x"),
        F.min(F.when(wraps, F.lit(0)).otherwise(first % h)).alias("min_y"),
        F.max(F.when(wraps, h - 1).otherwise(last % h)).alias("max_y"),
    )
    return masks.select("mask_id", "width", "height").join(boxes, "mask_id", "left").fillna(0, ["area"])


def mask_geometry(runs: DataFrame, masks: DataFrame) -> DataFrame:
    """Area, coverage, box, solidity, aspect, relative scale and fractional bounds per mask."""
    box_w = (F.col("max_x") - F.col("min_x") + 1).cast("double")
    box_h = (F.col("max_y") - F.col("min_y") + 1).cast("double")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    return _extents(runs, masks).select(
        "mask_id", "area", (F.col("area") / (w * h)).alias("coverage"),
        "min_x", "min_y", "max_x", "max_y",
        or_zero(F.col("area") / (box_w * box_h)).alias("solidity"),
        F.coalesce(
            F.greatest(box_w, box_h) / F.greatest(F.least(box_w, box_h), F.lit(1.0)), F.lit(1.0)
        ).alias("aspect"),
        or_zero(F.greatest(box_w, box_h) / F.greatest(w, h)).alias("relative_scale"),
        (F.col("min_x") / w).alias("x0"), (F.col("min_y") / h).alias("y0"),
        ((F.col("max_x") + 1) / w).alias("x1"), ((F.col("max_y") + 1) / h).alias("y1"),
    )


def box_metrics(runs: DataFrame, masks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Agreement of each mask with its reference box (x0, y0, x1, y1 in fractions).

    The part of a run inside the box is a difference of two prefix counts, so there is no
    range join and no pixel list.
    """
    pixel = lambda c, side: F.bround(F.col(c) * F.col(side), 0).cast("bigint")
    sized = masks.select("mask_id", "width", "height").join(boxes, "mask_id").select(
        "mask_id", "height", pixel("x0", "width").alias("rx0"), pixel("x1", "width").alias("rx1"),
        pixel("y0", "height").alias("ry0"), pixel("y1", "height").alias("ry1"),
    )
    clamp = lambda c, top: F.greatest(F.lit(0), F.least(c, top))
    wide, tall = F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0")

    def before(i: Column) -> Column:
        """Box pixels with an index under ``i``."""
        x, y = F.floor(i / F.col("height")), i % F.col("height")
        partial = F.when((x >= F.col("rx0")) & (x < F.col("rx1")), clamp(y - F.col("ry0"), tall))
        return clamp(x - F.col("rx0"), wide) * tall + F.coalesce(partial, F.lit(0))

    inside = (
        runs.join(sized, "mask_id").groupBy("mask_id")
        .agg(F.sum(before(F.col("start") + F.col("len")) - before(F.col("start"))).alias("__in"))
    )
    joined = _extents(runs, masks).drop("height", "width").join(sized, "mask_id").join(
        inside, "mask_id", "left"
    )
    zero = F.lit(0)
    meet = lambda lo, hi, rlo, rhi: F.greatest(
        zero, F.least(F.col(hi), F.col(rhi)) - F.greatest(F.col(lo), F.col(rlo))
    )
    inter = meet("min_x", "max_x", "rx0", "rx1") * meet("min_y", "max_y", "ry0", "ry1")
    own = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    union = own + wide * tall - inter
    any_set = F.col("area") > 0
    frac = F.when(any_set, F.col("__in") / F.col("area")).otherwise(F.lit(0.0))
    recall = F.when(any_set, F.col("__in") / F.greatest(wide * tall, F.lit(1))).otherwise(F.lit(0.0))
    iou = F.when(any_set & (union > 0), inter / union).otherwise(F.lit(0.0))
    return joined.select(
        "mask_id", frac.alias("inside_frac"), recall.alias("box_recall"), iou.alias("bbox_iou")
    ).withColumn("hit", (F.col("inside_frac") > 0.6) & (F.col("bbox_iou") > 0.5))


def surviving_score(
    detections: DataFrame, regions: DataFrame, index: list[str],
    overlap: float = fixed.OVERLAP, gate: float = fixed.MIN_BOX_SCORE, k: int = fixed.CANDIDATES,
) -> DataFrame:
    """Best score of a detection lying at least ``overlap`` inside its image's edited region.

    Detections (image_id, x0, y0, x1, y1, score) are cut to the best ``k`` over the gate before
    they meet the one region row of their image (image_id, rx0, ry0, rx1, ry1).
    """
    best = top_per_key(detections, ["image_id"], [F.col("score").desc(), *index], k).where(
        F.col("score") >= gate
    )
    met = best.join(regions, "image_id")
    side = lambda a, b, ra, rb: F.greatest(
        F.lit(0.0), F.least(F.col(b), F.col(rb)) - F.greatest(F.col(a), F.col(ra))
    )
    area = F.greatest(
        (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1e-6)
    )
    inside = side("x0", "x1", "rx0", "rx1") * side("y0", "y1", "ry0", "ry1") / area
    found = met.where(inside >= overlap).groupBy("image_id").agg(F.max("score").alias("__s"))
    return regions.select("image_id").join(found, "image_id", "left").select(
        "image_id", F.coalesce("__s", F.lit(0.0)).alias("still_there")
    )


def region_consistency(
    vectors: DataFrame, key: str, vector: str, inside: str, least: int = fixed.MIN_PATCHES
) -> DataFrame:
    """Cosine of the mean vector inside against outside; 0.0 when either side cannot say."""
    each = vectors.select(key, F.col(inside).alias("__in"), F.posexplode(vector).alias("d", "v"))
    mean = lambda test: F.avg(F.when(test, F.col("v").cast("double")))
    dims = each.groupBy(key, "d").agg(
        mean(F.col("__in")).alias("i"), mean(~F.col("__in")).alias("o"),
        F.count_if(F.col("__in")).alias("ni"), F.count_if(~F.col("__in")).alias("no"),
    )
    sums = dims.groupBy(key).agg(
        F.sum(F.col("i") * F.col("o")).alias("dot"), F.sum(F.col("i") * F.col("i")).alias("ii"),
        F.sum(F.col("o") * F.col("o")).alias("oo"), F.max("ni").alias("ni"), F.max("no").alias("no"),
    )
    norm = F.sqrt("ii") * F.sqrt("oo")
    sure = (F.col("ni") >= least) & (F.col("no") >= least) & (norm > 0)
    return sums.select(key, F.when(sure, F.col("dot") / norm).otherwise(F.lit(0.0)).alias("consistency"))
