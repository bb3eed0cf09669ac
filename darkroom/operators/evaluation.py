"""Reports over evaluation results: means, medians, paired arms, passes and baseline diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions import fixed, policy
from darkroom.operators.ordered import BLOCK_ROWS, by_sequence, join_null_safe, scan
from darkroom.operators.ranks import ordinal_rank, rank_gaps
from darkroom.operators.selection import exact_percentile, exact_percentiles


def share(test: Column) -> Column:
    """Share of rows where ``test`` holds; 0.0 over no rows."""
    return F.coalesce(F.avg(test.cast("double")), F.lit(0.0))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Put single-row frames side by side."""
    wide, *rest = [f.withColumn("__one", F.lit(1)) for f in frames]
    for frame in rest:
        wide = wide.join(frame, "__one", "left")
    return wide.drop("__one")


def iou_summary(results: DataFrame) -> DataFrame:
    """n, mean and median IoU, share over two cut-offs and under one, median seconds."""
    iou = F.col("iou")
    means = results.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(iou), F.lit(0.0)).alias("miou"),
        share(iou >= 0.5).alias("precision_50"),
        share(iou >= 0.7).alias("precision_70"),
        share(iou < 0.1).alias("failures_10"),
    )
    medians = exact_percentiles(results, {"median_iou": "iou", "median_seconds": "seconds"})
    return _one_row(means, medians).fillna(0.0, ["median_iou", "median_seconds"])


def iou_by(results: DataFrame, key: Column, name: str) -> DataFrame:
    return results.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("n"), F.avg("iou").alias("miou")
    )


def by_phrase_length(words: Column) -> Column:
    return F.when(words <= 5, F.lit("<= 5 words")).otherwise(F.lit("> 5 words"))


def head_to_head(results: DataFrame, a: str, b: str, lower_wins: bool = False) -> DataFrame:
    """``winner`` per case. Higher-is-better ties go to ``a``; cost ties go to ``b``."""
    first = F.col(a) < F.col(b) if lower_wins else F.col(a) >= F.col(b)
    return results.withColumn("winner", F.when(first, F.lit(a)).otherwise(F.lit(b)))


def win_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("winner").agg(F.count(F.lit(1)).alias("wins"))


def paired_summary(results: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Per-arm means, the best-of-both mean, wins and how often routing found the winner.

    Needs arm_a, arm_b, routed, baseline (nullable), psnr, matched, seconds.
    """
    a, b = F.col("arm_a"), F.col("arm_b")
    means = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg("routed").alias("mean_routed"),
        F.avg(F.greatest(a, b)).alias("mean_oracle"), F.avg("baseline").alias("mean_baseline"),
        F.avg("psnr").alias("psnr_routed"),
        F.count_if(a >= b).alias("wins_a"), F.count_if(a < b).alias("wins_b"),
        share(F.col("matched")).alias("router_picked_the_winner"),
    )
    half = exact_percentile(results, list(by), "seconds", "median_seconds")
    return join_null_safe(means, half, list(by), "left")


def proxy_report(results: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Per dataset: how well cost and semantic scores order fills against the outcome.

    Each row gives two fills, one per arm. Needs dataset, arm_a, arm_b, cost_a, cost_b,
    semantic_a, semantic_b. ``tie`` fixes the input order of rows; ranks keep it on ties. A
    group's ranks are its positions in one global order per score, less a shared offset that
    cancels in rank gaps.
    """
    fills = results.select(
        "dataset", *tie,
        F.inline(F.array(
            F.struct(F.lit(0).alias("arm"), F.col("arm_a").alias("outcome"),
                     F.col("cost_a").alias("cost"), F.col("semantic_a").alias("semantic")),
            F.struct(F.lit(1).alias("arm"), F.col("arm_b").alias("outcome"),
                     F.col("cost_b").alias("cost"), F.col("semantic_b").alias("semantic")),
        )),
    )
    ties = ["arm", *tie]
    placed = ordinal_rank(fills, ["dataset", "outcome", *ties], "rank_outcome").drop("outcome")
    gaps = {
        score: rank_gaps(
            placed.select("dataset", score, *ties, "rank_outcome"), ["dataset", score, *ties], "rank_outcome", "dataset", f"d2_{score}"
        )
        for score in ("cost", "semantic")
    }
    n = F.col("n_fills").cast("double")

    def rho(score: str) -> Column:
        return F.when(F.col("n_fills") < 3, F.lit(0.0)).otherwise(
            1.0 - 6.0 * F.col(f"d2_{score}") / (n * (n * n - 1.0))
        )

    counted = placed.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_fills"))
    ranks = counted.join(gaps["cost"], "dataset").join(gaps["semantic"], "dataset").select(
        "dataset", "n_fills", rho("cost").alias("spearman_cost"), rho("semantic").alias("spearman_semantic")
    )

    a, b = F.col("arm_a"), F.col("arm_b")
    a_won = a >= b
    picks = results.groupBy("dataset").agg(
        share((F.col("cost_a") <= F.col("cost_b")) == a_won).alias("cost_picks"),
        share((F.col("semantic_a") >= F.col("semantic_b")) == a_won).alias("semantic_picks"),
        share(a_won).alias("__a_share"), F.count_if(~a_won).alias("__b_wins"),
        F.count(F.lit(1)).alias("__n"),
        F.avg(F.greatest(a, b)).alias("__oracle"), F.avg(a).alias("__a"), F.avg(b).alias("__b"),
    )
    second = F.col("__b_wins") * 2 >= F.col("__n")
    return ranks.join(picks, "dataset").select(
        "dataset", "n_fills", "spearman_cost", "spearman_semantic", "cost_picks", "semantic_picks",
        F.when(second, 1.0 - F.col("__a_share")).otherwise(F.col("__a_share")).alias("majority_picks"),
        F.when(second, F.lit("b")).otherwise(F.lit("a")).alias("majority"),
        (F.col("__oracle") - F.when(second, F.col("__b")).otherwise(F.col("__a"))).alias("oracle_gain"),
    )


def planner_summary(results: DataFrame) -> DataFrame:
    """Long form (section, name, value) over the rows that were answered.

    Unmeasured rows are counted and left out of every denominator.
    """
    # One small cube answers everything but the medians; its branches share one shuffle.
    correct, seconds = F.col("correct").cast("double"), F.col("seconds")
    cube = results.groupBy(
        "route", "split", "unmeasured", F.col("expected_op").isNotNull().alias("edit")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum(correct).alias("right"), F.sum("tokens").alias("tokens"),
        F.max(seconds).alias("slowest"), F.count_if(seconds > fixed.DEADLINE_SECONDS).alias("late"),
    )
    asked = ~F.col("unmeasured")
    rule, model = asked & (F.col("route") == "rule"), asked & (F.col("route") == "model")
    over = lambda test, c: F.sum(F.when(test, F.col(c)))
    ratio = lambda a, b: F.coalesce(a / b, F.lit(0.0))
    accuracy = lambda test: ratio(over(test, "right"), over(test, "n"))
    whole = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    values = [
        ("counts", "n", whole(over(asked, "n"))),
        ("counts", "unmeasured", whole(over(~asked, "n"))),
        ("accuracy", "overall", accuracy(asked)),
        ("accuracy", "rule", accuracy(rule)),
        ("accuracy", "model", accuracy(model)),
        ("accuracy", "on_edits", accuracy(asked & F.col("edit"))),
        ("accuracy", "on_refusals", accuracy(asked & ~F.col("edit"))),
        ("seconds", "model_max", whole(F.max(F.when(model, F.col("slowest"))))),
        ("seconds", "over_deadline", whole(over(model, "late"))),
        ("tokens", "total", whole(over(asked, "tokens"))),
        ("tokens", "per_model_call", ratio(over(model, "tokens"), over(model, "n"))),
    ]
    rows = F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), value.alias("value"))
        for section, name, value in values
    ])
    long = cube.agg(rows.alias("rows")).select(F.inline("rows"))
    total = cube.where(asked).agg(F.sum("n").alias("__n"), F.lit(1).alias("__one"))
    routes = (
        cube.where(asked).groupBy(F.col("route").alias("name")).agg(F.sum("n").alias("c"), F.lit(1).alias("__one"))
        .join(total, "__one")
        .select(F.lit("coverage").alias("section"), "name", (F.col("c") / F.col("__n")).alias("value"))
    )
    splits = cube.where(asked).groupBy(F.col("split").alias("name")).agg(
        (F.sum("right") / F.sum("n")).alias("value")
    ).select(F.lit("by_split").alias("section"), "name", "value")
    medians = exact_percentile(results.where(rule | model), ["route"], "seconds", "value").select(F.lit("seconds").alias("section"), F.concat("route", F.lit("_median")).alias("name"), "value")
    return long.unionByName(routes).unionByName(splits).unionByName(medians)


def baseline_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Every difference worth reporting: case, kind, detail, blocking, seq.

    Both sides need id, status, cost, bbox_iou, signature, passes. A case may have several.
    """
    fields = ("status", "cost", "bbox_iou", "signature", "passes")
    side = lambda df, tag: df.select(
        "id", F.lit(True).alias(f"__{tag}"), *[F.col(f).alias(f"{tag}_{f}") for f in fields]
    )
    both = side(baseline, "was").join(side(current, "now"), "id", "full_outer")
    was, now = (lambda f: F.col(f"was_{f}")), (lambda f: F.col(f"now_{f}"))
    paired = F.col("__was") & F.col("__now")
    change = (now("cost") - was("cost")) / was("cost")
    moved = policy.signature_distance(was("signature"), now("signature"))
    shown = lambda c: F.coalesce(c, F.lit("None"))
    # format_number rounds the stored binary value half-even; format_string rounds half-up.
    fixed_point = lambda c, pattern: F.call_function("format_number", c, F.lit(pattern))
    signed = F.concat(
        F.when(change >= 0, F.lit("+")).otherwise(F.lit("-")),
        fixed_point(F.abs(change) * 100, "0"), F.lit("%"),
    )
    arrow = lambda a, b, pattern: F.concat(
        fixed_point(a, pattern), F.lit(" -> "), fixed_point(b, pattern)
    )
    no, yes = F.lit(False), F.lit(True)
    found = [
        ("missing", F.col("__now").isNull(), F.lit(fixed.MISSING_CASE), yes),
        ("new", F.col("__was").isNull(), F.lit(fixed.NEW_CASE), no),
        ("status", paired & ~was("status").eqNullSafe(now("status")),
         F.concat(shown(was("status")), F.lit(" -> "), shown(now("status"))),
         was("status").eqNullSafe("ok")),
        ("cost", paired & (was("cost") > 0) & (now("cost") != 0) & (F.abs(change) > fixed.COST_TOLERANCE),
         F.concat(arrow(was("cost"), now("cost"), "0.0"), F.lit(" ("), signed, F.lit(")")), no),
        ("grounding", paired & (was("bbox_iou") - now("bbox_iou") > fixed.IOU_TOLERANCE),
         F.concat(F.lit("IoU "), arrow(was("bbox_iou"), now("bbox_iou"), "0.000")), yes),
        ("image", paired & (was("signature") != "") & (now("signature") != "")
         & (moved > fixed.SIGNATURE_TOLERANCE),
         F.replace(F.lit(fixed.IMAGE_CHANGED), F.lit("{moved}"), fixed_point(moved, "0.000")), no),
        ("route", paired & ~was("passes").eqNullSafe(now("passes")),
         F.concat(shown(was("passes")), F.lit(" -> "), shown(now("passes"))), no),
    ]
    findings = F.array(*[
        F.when(test, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"),
                              blocking.alias("blocking"), F.lit(seq).alias("seq")))
        for seq, (kind, test, detail, blocking) in enumerate(found)
    ])
    return both.select(
        F.col("id").alias("case"), F.inline(F.filter(findings, lambda f: f.isNotNull()))
    )


def order_findings(findings: DataFrame) -> DataFrame:
    """Blocking first, then by case; one case's findings keep the order they were found in."""
    return findings.orderBy(F.col("blocking").desc(), "case", "seq")


def missing_and_new(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Ids on one side only."""
    a, b = baseline.select(key), current.select(key)
    return a.join(b, key, "left_anti").withColumn("kind", F.lit("missing")).unionByName(
        b.join(a, key, "left_anti").withColumn("kind", F.lit("new"))
    )


def tagged_union(frames: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """Frames of one shape stacked under their names."""
    named = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    stacked, *rest = named
    for df in rest:
        stacked = stacked.unionByName(df)
    return stacked


def carry_incumbent(
    passes: DataFrame, key: str, order: Sequence[str], heavy_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``kept`` where the pass improved, and the cost standing after each pass.

    Needs delta, cost (of the candidate) and start_cost (before the first pass).
    """
    kept = passes.withColumn("kept", F.col("delta") < 0)
    carried = scan(
        kept, [key], list(order), heavy_rows=heavy_rows,
        last_value={"__cost": F.when(F.col("kept"), F.col("cost"))},
    )
    return carried.withColumn("cost_after", F.coalesce("__cost", F.col("start_cost"))).drop("__cost")


def pass_summary(passes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Per edit: passes tried, kept, rolled back, not applicable, final cost and the route.

    The route is one text per edit, so an edit's labels do meet in one row.
    """
    kept, ran = F.col("kept"), F.col("attempted")
    label = (
        F.when(kept, F.col("strategy"))
        .when(ran, F.concat("strategy", F.lit(" (rolled back)")))
        .otherwise(F.concat("strategy", F.lit(" (n/a)")))
    )
    at = F.struct(*[F.col(c) for c in order])
    steps = F.array_sort(F.collect_list(F.struct(at.alias("at"), label.alias("label"))))
    return passes.groupBy(key).agg(
        F.count(F.lit(1)).alias("passes"),
        F.count_if(kept).alias("kept"),
        F.count_if(ran & ~kept).alias("rolled_back"),
        F.count_if(~ran).alias("not_applicable"),
        F.max_by("cost_after", at).alias("cost"),
        F.array_join(F.transform(steps, lambda s: s["label"]), " -> ").alias("route"),
    )


def review_summary(reviews: DataFrame) -> DataFrame:
    """Per job: reviews, retries, last action and the sentence a user reads."""
    counted = reviews.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(F.col("action") == "widen").alias("retries"),
        F.max_by("action", "attempt").alias("action"),
    )
    sentence = (
        F.when(
            (F.col("retries") > 0) & (F.col("action") == "accept"),
            F.replace(F.lit(fixed.WIDENED), F.lit("{retries}"), F.col("retries").cast("string")),
        )
        .when(F.col("action") == "stop", F.lit(fixed.STOPPED))
        .otherwise(F.lit(fixed.CHECKED))
    )
    return counted.withColumn("sentence", sentence)


def rank_variants(results: DataFrame, case: str, heavy_rows: int = BLOCK_ROWS) -> DataFrame:
    """Position of each variant: best IoU first, cheaper first on ties, shared when equal.

    A missing IoU counts as 0. Null cases and costs are values like others. A case of more than
    ``heavy_rows`` variants is put in order over the whole cluster, equal variants included, and the
    first position of equal ones is carried along it.
    """
    scored = results.withColumns({"__worse": -F.coalesce("iou", F.lit(0.0)), "__h": F.xxhash64(case)})
    heavy = scored.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > heavy_rows)
    within = F.rank().over(Window.partitionBy(case).orderBy("__worse", "cost")).cast("bigint")
    if heavy.isEmpty():
        return scored.withColumn("rank", within).drop("__worse", "__h")
    marked = scored.join(heavy.select("__h", F.lit(True).alias("__heavy")), "__h", "left").drop("__h")
    light = marked.where("__heavy IS NULL").withColumn("rank", within).drop("__heavy")
    # equal variants differ in their tie-breaker, so a range shuffle can part them
    large = marked.where("__heavy").drop("__heavy").withColumn("__tie", F.monotonically_increasing_id())
    placed = ordinal_rank(large, [case, "__worse", "cost", "__tie"], "__at")
    block, one = by_sequence("__at", heavy_rows), F.lit(1).cast("bigint")
    pair = F.struct("__worse", "cost")
    numbered = scan(placed, [case], ["__at"], block, previous={"__was": pair}, running_sum={"__place": one}, heavy_rows=heavy_rows)
    opens = F.when(~F.col("__was").eqNullSafe(pair), F.col("__place"))
    ranked = scan(numbered, [case], ["__at"], block, last_value={"rank": opens}, heavy_rows=heavy_rows)
    return light.unionByName(ranked.select(*light.columns)).drop("__worse")


def changed_fraction(
    before: DataFrame, after: DataFrame, keys: Sequence[str], channels: Sequence[str],
    tolerance: float = fixed.CHANGED_LEVELS, by: Sequence[str] = (),
) -> DataFrame:
    """Share of compared items whose largest channel difference exceeds the tolerance."""
    after = after.select(*keys, *[F.col(c).alias(f"__{c}") for c in channels])
    gaps = [F.abs(F.col(c) - F.col(f"__{c}")) for c in channels]
    gap = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return before.join(after, list(keys)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("compared"), share(gap > tolerance).alias("changed")
    )


def blank_regions(pixels: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Mean level and widest channel spread per region, and whether it is blank.

    Levels are compared at nine places: what lies exactly on a limit is not pushed under it by the
    order in which its pixels were added.
    """
    total = sum((F.avg(c) for c in channels), F.lit(0.0))
    return pixels.groupBy("region_id").agg(
        (total / len(channels)).alias("mean"),
        F.greatest(*[F.stddev_pop(c) for c in channels]).alias("spread"),
    ).withColumn("blank", policy.blank_fill(F.round("mean", 9), F.round("spread", 9)))
