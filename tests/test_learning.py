"""Models of all folds fitted together equal models fitted one by one."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from darkroom.operators import learning


def test_folds_together_equal_folds_apart(spark):
    r = random.Random(6)
    rows = [(i, r.gauss(5, 3), r.gauss(0, 1), 4.0, i % 4) for i in range(600)]
    rows = [(*x, int(0.4 * x[1] - x[2] + r.gauss(0, 1.5) > 2)) for x in rows]
    df = spark.createDataFrame(rows, "id int, a double, b double, same double, fold int, label int")
    columns = ["a", "b", "same"]
    got = {x.id: (x.probability_1, x.predicted) for x in learning.cross_validate(df, columns, 4).collect()}
    assert len(got) == 600
    for fold in range(4):
        model = learning.fit_chooser(learning.train_complement(df, fold), columns)
        for x in model.predict(df.where(F.col("fold") == fold)).collect():
            assert abs(x.probability_1 - got[x.id][0]) < 1e-6 and x.predicted == got[x.id][1]


def test_folds_that_part_the_classes(spark):
    """Training rows that one column parts entirely: the penalty keeps the weights finite."""
    df = spark.createDataFrame([(i, float(i), i % 3, int(i >= 30)) for i in range(60)], "id int, a double, fold int, label int")
    got = learning.cross_validate(df, ["a"], 3).collect()
    assert sum(x.predicted == x.label for x in got) >= 56
    only = learning.cross_validate(df.withColumn("label", F.lit(1)), ["a"], 3).collect()
    assert {(x.probability_1, x.predicted) for x in only} == {(1.0, 1)}


def test_out_of_fold_equals_its_sql(spark, tmp_path):
    """A text so long that its chance rounds to 1, a null text, and a label without a document."""
    import duckdb

    from darkroom.plans import ORACLES, QUERIES

    docs = [(i, " ".join(["ab"] * (10 + i)) + "\n" * (i % 3)) for i in range(80)]
    docs[79], docs[3] = (79, "ab " * 200_000), (3, None)
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i >= 40)) for i in range(83)]
    spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["ml2_out_of_fold"](spark, str(tmp_path)).select("id", "label", "fold", "sound")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLES["ml2_out_of_fold"]).fetchall())
    chances = {r.id: r.probability_1 for r in QUERIES["ml2_cross_validate"](spark, str(tmp_path)).collect()}
    assert chances[79] == 1.0 and len(chances) == 80
