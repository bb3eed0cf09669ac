"""Learning queries: the shape of a document against its quality label."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from darkroom.operators import learning as ops
from darkroom.operators.tuning import chooser_report
from darkroom.plans.evaluation import rounded
from darkroom.plans.registry import Registry
from darkroom.plans.tables import table

plans = Registry()

COLUMNS = ("chars", "words", "lines", "word_length", "letter_share", "distinct_share")
FOLDS = 5


def features(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("id"), *[
        c.alias(n) for n, c in ops.text_features(F.coalesce("text", F.lit(""))).items()
    ])


def winners(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "b").otherwise("a").alias("winner")
    )


def labelled(spark, sf):
    return ops.label_features(features(spark, sf), winners(spark, sf), "b")


def folded(spark, sf):
    """Labelled documents with their fold. Folds are dealt over all labels, before texts are looked up."""
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return features(spark, sf).join(ops.stratified_folds(rows, "id", "label", FOLDS), "id")


@plans.add("jn5_label_features", """select d.doc_id as id, n_chars::double as chars, quality as label
  from documents d join labels l on l.doc_id = d.doc_id""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("chars")
    )
    return ops.label_features(docs, winners(spark, sf), "b").select("id", "chars", "label")


FOLDED = f"""folded as (select doc_id as id, quality as label,
    ((row_number() over (partition by quality order by sha256('0:' || doc_id), doc_id) - 1) % {FOLDS})::int as fold
    from labels)"""


@plans.add("wn12_stratified_folds", f"with {FOLDED} select id, label, fold from folded")
def _(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return ops.stratified_folds(rows, "id", "label", FOLDS)


@plans.add("su5_train_complement", f"with {FOLDED} select id, label, fold from folded where fold <> 0")
def _(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return ops.train_complement(ops.stratified_folds(rows, "id", "label", FOLDS), 0)


@plans.add("ml3_task_features", """with w as (select d.doc_id as id, quality as label, text, string_split(text, ' ') as ws
    from documents d join labels l on l.doc_id = d.doc_id)
  select id, label, length(text)::double as chars, len(ws)::double as words,
    len(string_split(text, chr(10)))::double as lines, round(length(text) / len(ws), 6) as word_length,
    round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(text), 1), 6) as letter_share,
    round(len(list_distinct(ws)) / len(ws), 6) as distinct_share from w""")
def _(spark, sf):
    ready = ops.task_features(labelled(spark, sf), COLUMNS).withColumn("v", vector_to_array("features"))
    return rounded(ready.select("id", "label", *[F.col("v")[i].alias(c) for i, c in enumerate(COLUMNS)]))


@plans.add("ml1_fit_chooser")
def _(spark, sf):
    """Weights of the model fitted on every labelled document, the intercept last."""
    fitted = ops.fit_chooser(labelled(spark, sf), COLUMNS)
    rows = [(name, float(w)) for name, w in fitted.weights.items()] + [("intercept", fitted.bias)]
    return rounded(spark.createDataFrame(rows, "feature string, weight double"), 4)


@plans.add("ml1_settled", f"select unnest({[*COLUMNS, 'intercept']}) as feature, true as settled")
def _(spark, sf):
    """Whether the penalised loss is level at the fitted weights: its slope along each, from all rows."""
    rows = labelled(spark, sf)
    fitted = ops.fit_chooser(rows, COLUMNS)
    error = F.col("probability_1") - F.col("label")
    parts = zip(COLUMNS, fitted.mean, fitted.scale, strict=True)
    slopes = [F.avg(error * (F.col(c) - F.lit(m)) / F.lit(s)) + F.lit(fitted.weights[c]) / F.count(F.lit(1)) for c, m, s in parts]
    names = [F.lit(n) for n in [*COLUMNS, "intercept"]]
    flat = [(F.abs(e) < 1e-6).alias("settled") for e in [*slopes, F.avg(error)]]
    one = fitted.predict(rows).agg(F.array(*[F.struct(n.alias("feature"), e) for n, e in zip(names, flat, strict=True)]).alias("rows"))
    return one.select(F.inline("rows"))


@plans.add("ml1_predictions")
def _(spark, sf):
    """Every document scored by that model."""
    fitted = ops.fit_chooser(labelled(spark, sf), COLUMNS)
    return rounded(fitted.predict(features(spark, sf)).select("id", "probability_1", "predicted"), 4)


@plans.add("ml2_cross_validate")
def _(spark, sf):
    scored = ops.cross_validate(folded(spark, sf), COLUMNS, FOLDS)
    return rounded(scored.select("id", "label", "fold", "probability_1", "predicted"), 4)


@plans.add("ml2_out_of_fold", f"""with {FOLDED} select f.id, f.label, f.fold, true as sound from folded f
  join documents d on d.doc_id = f.id""")
def _(spark, sf):
    """Every labelled document once, with its fold, and whether its prediction follows from its chance.

    The chance of a document far from the gate rounds to 0 or 1, so both ends count; no number does not.
    """
    scored = ops.cross_validate(folded(spark, sf), COLUMNS, FOLDS)
    p = F.col("probability_1")
    return scored.select("id", "label", "fold", (p.between(0, 1) & (F.col("predicted") == (p >= 0.5).cast("int"))).alias("sound"))


@plans.add("ag17_learned_chooser")
def _(spark, sf):
    """The chooser report over out-of-fold predictions."""
    scored = ops.cross_validate(folded(spark, sf), COLUMNS, FOLDS)
    arms = scored.withColumns(
        {
            "arm_a": F.when(F.col("label") == 0, 0.9).otherwise(0.6),
            "arm_b": F.when(F.col("label") == 1, 0.9).otherwise(0.6),
            "matched": F.col("lines") > 5,
        }
    ).withColumn("routed", F.when(F.col("matched"), 0.9).otherwise(0.6))
    return rounded(chooser_report(arms), 4)


@plans.add("so2_strongest_features", """select source as feature, round(avg(quality) - 0.85, 9) as weight from documents d
  join labels l on l.doc_id = d.doc_id group by source order by abs(round(avg(quality) - 0.85, 9)) desc, source limit 5""")
def _(spark, sf):
    weights = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy(
        F.col("source").alias("feature")
    ).agg(F.round(F.avg("quality") - 0.85, 9).alias("weight"))
    return ops.strongest_features(weights)
