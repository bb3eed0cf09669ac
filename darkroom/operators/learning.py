"""A learned chooser: features, folds, a penalised logistic fit and its strongest inputs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.operators.ranks import ordinal_rank
from darkroom.session import cut_lineage


def label_features(features: DataFrame, winners: DataFrame, second: str) -> DataFrame:
    """Features joined to their outcome by id; label 1 where ``second`` won. Unmatched rows drop."""
    named = winners.select("id", (F.col("winner") == second).cast("int").alias("label"))
    return features.join(named, "id")


def stratified_folds(
    df: DataFrame, key: str, label: str, folds: int, seed: int = 0, name: str = "fold"
) -> DataFrame:
    """Deal each label's rows round-robin in hashed id order: sizes per label differ by one at most.

    Positions come from one whole-table ranking with the label first, so a label holding most
    rows is still spread over all tasks; each label's own start is subtracted.
    """
    shuffled = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"), 256)
    ranked = ordinal_rank(df.withColumn("__h", shuffled), [label, "__h", key], "__pos").drop("__h")
    starts = ranked.groupBy(label).agg(F.min("__pos").alias("__start"))
    dealt = ranked.join(starts, label)
    return dealt.withColumn(name, ((F.col("__pos") - F.col("__start")) % folds).cast("int")).drop(
        "__pos", "__start"
    )


def train_complement(df: DataFrame, fold: int, name: str = "fold") -> DataFrame:
    """Every row outside one fold."""
    return df.where(F.col(name) != fold)


def task_features(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """One numeric vector per row. Only the named columns go in, so a label cannot leak."""
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


@dataclass(frozen=True)
class Chooser:
    """A fitted model with the scaling of its own training rows."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    model: LogisticRegressionModel

    @property
    def weights(self) -> dict[str, float]:
        return dict(zip(self.columns, (float(w) for w in self.model.coefficients), strict=True))

    @property
    def bias(self) -> float:
        return float(self.model.intercept)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``probability_1`` and ``predicted``."""
        scored = self.model.transform(task_features(_scaled(df, self), _names(self.columns), "__x"))
        return scored.select(
            *df.columns,
            vector_to_array(F.col("__p"))[1].alias("probability_1"),
            (vector_to_array(F.col("__p"))[1] >= 0.5).cast("int").alias("predicted"),
        )


def _names(columns: Sequence[str]) -> list[str]:
    return [f"__z_{c}" for c in columns]


def _scaled(df: DataFrame, chooser: Chooser) -> DataFrame:
    parts = zip(chooser.columns, chooser.mean, chooser.scale, strict=True)
    return df.withColumns({f"__z_{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in parts})


def fit_chooser(df: DataFrame, columns: Sequence[str], label: str = "label", l2: float = 1.0) -> Chooser:
    """Logistic regression on inputs scaled by population deviation, intercept unpenalised.

    The objective is mean log-loss plus l2 / (2 n) times the squared weights. Only 2 numbers per
    column and the weights reach the driver.
    """
    stats = [F.avg(c).alias(f"m_{c}") for c in columns] + [F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), *stats).first()
    mean = tuple(float(row[f"m_{c}"]) for c in columns)
    scale = tuple(s if (s := float(row[f"s_{c}"])) >= 1e-9 else 1.0 for c in columns)
    bare = Chooser(tuple(columns), mean, scale, None)
    ready = task_features(_scaled(df, bare), _names(columns), "__x").select(
        "__x", F.col(label).cast("double").alias("__y")
    )
    model = LogisticRegression(
        featuresCol="__x", labelCol="__y", probabilityCol="__p", regParam=l2 / row["n"],
        elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10,
    ).fit(ready)
    return Chooser(tuple(columns), mean, scale, model)


def cross_validate(
    df: DataFrame, columns: Sequence[str], folds: int, label: str = "label", name: str = "fold",
    l2: float = 1.0,
) -> DataFrame:
    """Out-of-fold predictions: each fold is scored by a model fitted on the others.

    Scaling is fitted with the model. Where the training rows have one class, the whole table's
    majority is predicted; a tie counts as class 0. All models are fitted together: a Newton step
    is one pass in which every row adds its gradient and curvature to each model that may see it.
    """
    rows = cut_lineage(df)
    columns = list(columns)
    stats = [e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]
    per = {r[name]: r for r in rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones"), *stats).collect()}
    n, ones = sum(r["n"] for r in per.values()), sum(r["ones"] for r in per.values())
    majority = float(ones * 2 > n)
    mean, scale, size = np.zeros((folds, len(columns))), np.ones((folds, len(columns))), np.zeros(folds)
    fitted = []
    for fold in range(folds):
        seen = [r for f, r in per.items() if f != fold]
        size[fold], mine = sum(r["n"] for r in seen), sum(r["ones"] for r in seen)
        if 0 < mine < size[fold]:
            fitted.append(fold)
            share = np.array([r["n"] for r in seen]) / size[fold]
            means, spreads = (np.array([[r[f"{k}_{c}"] for c in columns] for r in seen]) for k in "mv")
            mean[fold] = share @ means
            spread = np.sqrt(share @ (spreads + (means - mean[fold]) ** 2))
            scale[fold] = np.where(spread >= 1e-9, spread, 1.0)
    weights = _fit_together(rows, columns, label, name, fitted, mean, scale, size, l2) if fitted else {}

    # each model in terms of the columns as they are, so that a fold's rows are scored by one expression
    plain = {f: np.append(w[:-1] / scale[f], w[-1] - (w[:-1] * mean[f] / scale[f]).sum()) for f, w in weights.items()}
    of = lambda i: F.get(F.array(*[F.lit(float(plain[f][i])) if f in plain else F.lit(None).cast("double") for f in range(folds)]), F.col(name).cast("int"))
    score = sum((of(i) * F.col(c) for i, c in enumerate(columns)), of(len(columns)))
    chance = F.coalesce(1.0 / (1.0 + F.exp(-score)), F.lit(majority))
    held = rows.where((F.col(name) >= 0) & (F.col(name) < folds))
    return held.withColumn("probability_1", chance).withColumn(
        "predicted", F.when(of(0).isNull(), F.lit(int(majority))).otherwise((F.col("probability_1") >= 0.5).cast("int"))
    )


def _fit_together(
    rows: DataFrame, columns: list[str], label: str, name: str, folds: list[int], mean: np.ndarray, scale: np.ndarray,
    size: np.ndarray, l2: float, steps: int = 50, close: float = 1e-10,
) -> dict[int, np.ndarray]:
    """Weights and intercept of every fold's model: mean log-loss plus l2 / (2 n) times the squared weights."""
    width = len(columns) + 1
    ready = rows.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("double").alias("y"), F.col(name).cast("long").alias("f"))

    def sums(w: np.ndarray) -> np.ndarray:
        """Per model: loss, gradient and curvature over its training rows, added up by Spark."""
        def part(batches):
            import pyarrow as pa

            total = np.zeros((len(folds), 1 + width + width * width))
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width - 1)
                y, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "f"))
                for i, fold in enumerate(folds):
                    use = f != fold
                    z = np.column_stack([(x[use] - mean[fold]) / scale[fold], np.ones(use.sum())])
                    raw = z @ w[i]
                    p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
                    total[i, 0] += (np.logaddexp(0, raw) - y[use] * raw).sum()
                    total[i, 1:1 + width] += z.T @ (p - y[use])
                    total[i, 1 + width:] += ((z * (p * (1 - p))[:, None]).T @ z).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "v"])

        added = ready.mapInArrow(part, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros((len(folds), 1 + width + width * width))
        for r in added:
            out.flat[r["at"]] = r["v"]
        return out

    n = size[folds]
    shrink = np.append(np.full(width - 1, l2), 0.0)
    w = np.zeros((len(folds), width))
    last, step = np.full(len(folds), np.inf), np.zeros((len(folds), width))
    for _ in range(steps):
        found = sums(w)
        moved = False
        for i in range(len(folds)):
            loss = (found[i, 0] + (shrink * w[i] ** 2).sum() / 2) / n[i]
            if loss > last[i] + 1e-12:  # the step was too long
                step[i] /= 2
                w[i] += step[i]
                moved = True
                continue
            slope = (found[i, 1:1 + width] + shrink * w[i]) / n[i]
            last[i] = loss
            if np.abs(slope).max() <= close:
                continue
            bend = found[i, 1 + width:].reshape(width, width) / n[i] + np.diag(shrink / n[i] + 1e-12)
            step[i] = np.linalg.solve(bend, slope)
            w[i] -= step[i]
            moved = True
        if not moved:
            break
    return {fold: w[i] for i, fold in enumerate(folds)}


def strongest_features(weights: DataFrame, n: int = 5, name: str = "feature") -> DataFrame:
    """The ``n`` largest weights by size; ties by name."""
    return weights.orderBy(F.abs("weight").desc(), name).limit(n)


def text_features(text: Column) -> dict[str, Column]:
    """Shape of a document as numbers."""
    words = F.split(text, " ")
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    chars = F.greatest(F.length(text), F.lit(1))
    return {
        "chars": F.length(text).cast("double"),
        "words": F.size(words).cast("double"),
        "lines": F.size(F.split(text, "\n")).cast("double"),
        "word_length": F.length(text) / F.size(words),
        "letter_share": letters / chars,
        "distinct_share": F.size(F.array_distinct(words)) / F.size(words),
    }
