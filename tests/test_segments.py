"""One key that holds most rows: ordered operators cut it by counted position, with the same answers."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.operators import evaluation, jobs, masks
from darkroom.operators.ordered import scan


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hash") + plan.count("Exchange range")


@pytest.mark.parametrize("heavy", [3, 50, 1 << 20])
def test_incumbent_of_one_long_edit(spark, heavy):
    r = random.Random(heavy)
    rows = [("long" if i % 4 else r.choice(["a", None]), i // 7, r.randrange(9), r.uniform(-1, 1), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "edit string, n int, m int, delta double, cost double").withColumn("start_cost", F.lit(9.5)).repartition(4)
    df = df.dropDuplicates(["edit", "n", "m"]).cache()
    got = {(x.edit, x.n, x.m): x.cost_after for x in evaluation.carry_incumbent(df, "edit", ["n", "m"], heavy).collect()}
    kept = sorted([tuple(x)[:5] for x in df.collect()], key=lambda x: x[1:3])
    standing = {}
    assert len(got) == len(kept)
    for edit, n, m, delta, cost in kept:
        if delta < 0:
            standing[edit] = cost
        assert got[edit, n, m] == standing.get(edit, 9.5)


@pytest.mark.parametrize("heavy", [2, 30, 1 << 20])
def test_variants_of_one_large_case_share_ranks(spark, heavy):
    r = random.Random(heavy)
    rows = [("c" if i % 3 else r.choice([None, "d"]), r.choice([0.25, 0.5, None, 0.0]), r.choice([1.0, 2.0, None]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "case string, iou double, cost double, line int").repartition(5)
    got = {x.line: x["rank"] for x in evaluation.rank_variants(df, "case", heavy).collect()}
    key = lambda x: (-(x[1] or 0.0), x[2] is not None, x[2] or 0.0)
    for x in rows:
        assert got[x[3]] == 1 + sum(key(y) < key(x) for y in rows if y[0] == x[0])


@pytest.mark.parametrize("heavy", [4, 1 << 20])
def test_artifacts_of_one_busy_second(spark, heavy):
    rows = [("busy" if i % 5 else None, i, 1_700_000_000 + i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "job_id string, id long, s long").select("job_id", "id", F.timestamp_seconds("s").alias("created_at"))
    got = {x.id: x.position for x in jobs.artifacts_in_order(df.repartition(3), heavy).collect()}
    for job in ("busy", None):
        mine = sorted((s, i) for j, i, s in rows if j == job)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))


def test_neighbours_of_null_values(spark):
    rows = [("k", i, None if i % 3 else i) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for heavy in (2, 1 << 20):
        got = scan(df, ["k"], ["i"], previous={"p": F.col("v")}, following={"f": F.col("v")}, heavy_rows=heavy).orderBy("i").collect()
        values = [v for _, _, v in rows]
        assert [x.p for x in got] == [None, *values[:-1]] and [x.f for x in got] == [*values[1:], None]


@pytest.mark.parametrize("block", [2, 1 << 20])
def test_runs_over_words(spark, block):
    r = np.random.default_rng(block)
    shapes = [(5, 40), (1, 64), (64, 1), (13, 29), (1, 1), (1, 65), (16, 16)]
    drawn = {k: np.repeat(r.random((w, h)) < 0.5, 1, axis=0).astype(int) * r.integers(1, 4, (w, h)) for k, (w, h) in enumerate(shapes)}
    drawn[0][:] = 0
    drawn[6][:] = 7
    drawn[3][2:9] = 1
    pixels = spark.createDataFrame([(k, x, y, int(m[x, y])) for k, m in drawn.items() for x in range(m.shape[0]) for y in range(m.shape[1])], "mask_id int, x int, y int, v int").repartition(6)
    sizes = spark.createDataFrame([(k, *s) for k, s in enumerate(shapes)], "mask_id int, width int, height int")
    packed = {x.mask_id: x.counts for x in masks.pack_runs(masks.rle_encode(pixels, sizes, block_rows=block)).collect()}
    for k, m in drawn.items():
        flat = (m.reshape(-1) != 0).astype(int)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(flat)) + 1, [len(flat)]])
        assert packed[k] == ([0] if flat[0] else []) + np.diff(edges).tolist()


def test_short_keys_cost_one_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    assert exchanges(scan(df, ["k"], ["id"], previous={"p": F.col("id")}, running_sum={"s": F.col("id")})) == 1
    tried = df.select(F.col("k").alias("case"), F.col("id").cast("double").alias("iou"), F.lit(1.0).alias("cost"))
    assert exchanges(evaluation.rank_variants(tried, "case")) == 1
