"""Gates fitted on one split and judged on the other, without scoring rows once per gate.

A gate sweep asks, for each of a hundred gates, for the mean of one value above the gate and
another below it. Each row is counted once, in the slot between the two gates its confidence
falls between; every gate's answer is then a running total over at most gates + 1 slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions import fixed, policy

GATES = tuple(round(i / 100, 2) for i in range(101))
BOX_GATES = tuple(round(i * 0.05, 2) for i in range(15))


def hash_split(key: Column) -> Column:
    """``fit`` or ``holdout`` from the content of an id (or of a group, to keep it whole)."""
    digest = F.sha2(key.cast("string").cast("binary"), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.when(number % 100 < fixed.HOLDOUT_PERCENT, F.lit("holdout")).otherwise(F.lit("fit"))


def rounded_half_even(value: Column, digits: int) -> Column:
    """``value`` to ``digits`` places by the stored binary value; ``bround`` goes by its shortest text."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits)).cast("double")


def slot(value: Column, gates: Sequence[float]) -> Column:
    """How many of the ascending ``gates`` are at most ``value``, by binary search."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= gates[middle], search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(gates))


def gate_cross(observations: DataFrame, gates: Sequence[float]) -> DataFrame:
    """Every observation under every gate, for callers that want the rows themselves."""
    return observations.select("*", F.explode(F.array(*[F.lit(float(g)) for g in gates])).alias("gate"))


def _every_slot(observations: DataFrame, gates: Sequence[float]) -> DataFrame:
    """One row per slot number, also where the observations have none."""
    spark = observations.sparkSession
    return spark.range(0, len(gates) + 1, 1, 1).select(F.col("id").cast("int").alias("slot"))


def _gate_of(gates: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(g)) for g in gates])[F.col("slot") - 1]


def _counted(observations: DataFrame, gates: Sequence[float], *by: str) -> DataFrame:
    """Rows and sums per slot: the only pass over the observations."""
    return observations.groupBy(*by, slot(F.col("confidence"), gates).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("above").alias("a"), F.sum("below").alias("b")
    )


def _curve(counted: DataFrame, gates: Sequence[float], digits: int | None) -> DataFrame:
    """gate, score from slot counts; at most gates + 1 rows."""
    rows = _every_slot(counted, gates).join(counted.drop("split"), "slot", "left").fillna(0)
    order = Window.orderBy("slot")
    under = order.rowsBetween(Window.unboundedPreceding, -1)
    over = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("a").over(over) + F.coalesce(F.sum("b").over(under), F.lit(0.0))
    n = F.sum("n").over(whole)
    mean = total / n if digits is None else rounded_half_even(total / n, digits)
    score = F.when(n > 0, mean).otherwise(F.lit(0.0))
    return rows.select("slot", score.alias("score")).where("slot > 0").select(
        _gate_of(gates).alias("gate"), "score"
    )


def gate_sweep(
    observations: DataFrame, gates: Sequence[float] = GATES, digits: int | None = 4
) -> DataFrame:
    """gate, score: mean outcome when ``above`` is used at or over the gate, else ``below``.

    Needs confidence, above, below. Scores are rounded to ``digits`` places before they are
    compared. No observations score 0.0.
    """
    return _curve(_counted(observations, gates), gates, digits)


def best_gate(curve: DataFrame) -> DataFrame:
    """The first maximum: highest score, then lowest gate."""
    return curve.orderBy(F.col("score").desc(), "gate").limit(1)


def abstention_curve(
    observations: DataFrame, arm_gate: Column, gates: Sequence[float] = BOX_GATES
) -> DataFrame:
    """What refusing to answer under each gate costs and buys.

    Needs box_score besides the gate sweep's columns.
    """
    chosen = policy.pick_arm(F.col("confidence"), F.col("above"), F.col("below"), arm_gate)
    counted = observations.select(
        slot(F.col("box_score"), gates).alias("slot"), chosen.alias("__v")
    ).groupBy("slot").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__v").alias("s"),
        F.count_if(F.col("__v") >= fixed.HIT_IOU).alias("h"),
    )
    rows = _every_slot(observations, gates).join(counted, "slot", "left").fillna(0)
    order = Window.orderBy("slot")
    over = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    answered, n = F.sum("n").over(over), F.greatest(F.sum("n").over(whole), F.lit(1))
    s, h = F.sum("s").over(over), F.sum("h").over(over)
    mean = lambda total: F.when(answered > 0, total / answered).otherwise(F.lit(0.0))
    return rows.select(
        "slot", (1 - answered / n).alias("abstained"), (s / n).alias("miou_overall"),
        mean(s).alias("miou_answered"), mean(h).alias("precision_50_answered"),
    ).where("slot > 0").select(_gate_of(gates).alias("gate"), "*").drop("slot")


def adopt_if_better(
    observations: DataFrame, default: float = fixed.MIN_REGION_IOU,
    gates: Sequence[float] = GATES, least: int = fixed.MIN_OBSERVATIONS,
) -> DataFrame:
    """One row: the gate fitted on one split, both gates' held-out scores, and the one to use.

    The fitted gate is used only when it beats the default on the held-out split. Needs split.
    Under ``least`` observations nothing is fitted.
    """
    every = sorted({float(g) for g in (*gates, default)})
    counted = _counted(observations, every, "split")
    # both curves are read off one small table of slots, in one window and one aggregate
    pairs = _every_slot(observations, every).select("slot", F.explode(F.array(F.lit("fit"), F.lit("holdout"))).alias("split"))
    rows = pairs.join(counted, ["slot", "split"], "full_outer").fillna(0, ["n", "a", "b"])
    order = Window.partitionBy("split").orderBy("slot")
    under = order.rowsBetween(Window.unboundedPreceding, -1)
    over = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("a").over(over) + F.coalesce(F.sum("b").over(under), F.lit(0.0))
    mean = total / F.nullif(F.sum("n").over(Window.partitionBy("split")), F.lit(0))
    curve = rows.select(
        "split", "n", F.get(F.array(*[F.lit(g) for g in every]), F.col("slot") - 1).alias("gate"), mean.alias("mean")
    )
    raw = F.coalesce("mean", F.lit(0.0))
    score = F.coalesce(rounded_half_even(F.col("mean"), 4), F.lit(0.0))
    tried = (F.col("split") == "fit") & F.col("gate").isin([float(g) for g in gates])
    size = lambda name: F.coalesce(F.sum(F.when(F.col("split") == name, F.col("n"))), F.lit(0))
    held = F.when((F.col("split") == "holdout") & F.col("gate").isNotNull(), F.struct("gate", raw.alias("mean")))
    row = curve.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), size("fit").alias("fit"), size("holdout").alias("holdout"),
        F.max_by(F.struct("gate", score.alias("score")), F.when(tried, F.struct(score, -F.col("gate")))).alias("__best"),
        F.map_from_entries(F.collect_list(held)).alias("__held"),
    ).select(
        "n", "fit", "holdout", F.col("__best.gate").alias("best_gate"), F.col("__best.score").alias("best_fit"),
        F.try_element_at("__held", F.col("__best.gate")).alias("holdout_at_best"),
        F.try_element_at("__held", F.lit(float(default))).alias("holdout_at_default"),
    )
    better = (F.col("n") >= least) & (F.col("holdout_at_best") > F.col("holdout_at_default"))
    return row.withColumn("adopted", F.coalesce(better, F.lit(False))).withColumn(
        "gate", F.when(F.col("adopted"), F.col("best_gate")).otherwise(F.lit(default))
    )


def chooser_report(predictions: DataFrame) -> DataFrame:
    """One row: accuracy and mean outcome of four choosers, and whether to adopt the learned one.

    Needs label (1 when ``b`` won), predicted, routed, matched, arm_a, arm_b. The outcome
    decides; accuracy alone does not.
    """
    label, guess = F.col("label"), F.col("predicted")
    a, b = F.col("arm_a"), F.col("arm_b")
    one = predictions.agg(
        F.count(F.lit(1)).alias("n"), F.avg(label.cast("double")).alias("__b_share"),
        F.avg(a).alias("__a"), F.avg(b).alias("__b"),
        F.avg(F.col("matched").cast("double")).alias("router_accuracy"),
        F.avg("routed").alias("outcome_router"),
        F.avg((guess == label).cast("double")).alias("learned_accuracy"),
        F.avg(F.when(guess == 1, b).otherwise(a)).alias("outcome_learned"),
        F.avg(F.when(label == 1, b).otherwise(a)).alias("outcome_oracle"),
    )
    second = F.col("__b_share") > 0.5
    row = one.withColumns(
        {
            "majority_accuracy": F.when(second, F.col("__b_share")).otherwise(1 - F.col("__b_share")),
            "outcome_majority": F.when(second, F.col("__b")).otherwise(F.col("__a")),
        }
    ).drop("__b_share", "__a", "__b")
    gain = F.col("outcome_learned") - F.col("outcome_majority")
    accuracy = F.col("learned_accuracy") - F.col("majority_accuracy")
    verdict = (
        F.when(F.col("n") < fixed.MIN_LABELLED, F.lit("refuse: too few labelled rows"))
        .when(gain > fixed.OUTCOME_GAIN, F.lit("adopt"))
        .when(accuracy > fixed.ACCURACY_GAIN,
              F.lit("reject: accurate only where the choice barely matters"))
        .otherwise(F.lit("reject: no better than the majority"))
    )
    return row.withColumn("verdict", verdict)
