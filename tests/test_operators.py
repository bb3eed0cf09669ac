"""Closed-form cases: empties, nulls, ties and the rules that are easy to get wrong."""

from __future__ import annotations

import hashlib
import json
import random
import math
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from darkroom.functions import fixed, payloads, policy, routing, specs, text
from darkroom.operators import assets, documents, evaluation, jobs, learning, masks, ranking, tuning
from darkroom.session import scratch_dir
from darkroom.sources import readers, writers

NOW = datetime(2026, 1, 31)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def said(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


# Assets


@pytest.mark.parametrize(
    ("referenced", "hours", "retention", "verdict"),
    [(False, 24, 0, "orphan"), (False, 23.9, 0, None), (True, 99999, 0, None), (True, 720, 30, "expired"),
     (True, 719, 30, None), (False, 5, 30, None), (False, 900, 30, "orphan")],
)
def test_object_verdict(spark, referenced, hours, retention, verdict):
    got = one(spark, policy.object_verdict(F.lit(referenced), F.lit(float(hours)), 24.0, retention))
    assert got == verdict


def test_sweep_counts_artifact_only_references_and_refuses_without_tables(spark):
    old = NOW - timedelta(days=3)
    objects = spark.createDataFrame([("a", 5, old), ("b", 7, old), ("c", 11, NOW)], "digest string, size bigint, modified_at timestamp")
    images = spark.createDataFrame([], "sha256 string")
    artifacts = spark.createDataFrame([("a",), ("a",)], "sha256 string")
    swept = assets.sweep_report(assets.classify_objects(objects, images, artifacts, F.lit(NOW))).first()
    assert (swept.scanned, swept.orphans, swept.expired, swept.deleted, swept.bytes_freed, swept.dry_run) == (3, 1, 0, 1, 7, True)
    with pytest.raises(ValueError, match="referenced"):
        assets.classify_objects(objects, None, None, F.lit(NOW))


def test_free_calls_are_calls_and_nobody_is_missing(spark):
    rows = [("u", 1, 0.0, NOW), ("u", 1, 2.5, NOW - timedelta(days=9)), ("w", 1, 1.0, NOW - timedelta(days=9))]
    ledger = spark.createDataFrame(rows, "user_id string, units int, cents double, at timestamp")
    got = {r.user_id: (r.calls, r.cents) for r in assets.spend_since(ledger, F.lit(NOW)).collect()}
    assert got == {"u": (1, 0.0), "w": (0, 0.0)}


# Jobs


def test_null_keys_never_collide(spark):
    rows = [(1, "u", "k", 2), (2, "u", "k", 1), (3, "w", "k", 1), (4, "u", None, 1), (5, "u", None, 1)]
    df = spark.createDataFrame(rows, "id int, user_id string, idempotency_key string, created_at int")
    assert sorted(r.id for r in jobs.dedupe_idempotent(df).collect()) == [2, 3, 4, 5]


@pytest.mark.parametrize("was", fixed.STATES)
def test_every_move(spark, was):
    df = spark.createDataFrame([(s,) for s in fixed.STATES], "s string")
    got = {r.s for r in df.where(jobs.legal_move(F.lit(was), F.col("s"))).collect()}
    assert got == set(fixed.TRANSITIONS[was])


def test_cancelling_a_finished_job_is_no_violation(spark):
    rows = [(1, "a", "done"), (2, "a", "cancelled"), (3, "b", "running"), (4, "b", "running")]
    bad = jobs.illegal_transitions(spark.createDataFrame(rows, "id bigint, job_id string, state string"))
    assert [tuple(r) for r in bad.collect()] == [("b", 4, "running", "running")]


def test_upsert_rejects_other_owners_and_keeps_the_last_save(spark):
    current = spark.createDataFrame([("j", "u", "queued")], "id string, user_id string, state string")
    rows = [("j", "u", "running", 1), ("j", "w", "failed", 2), ("j", "u", "done", 3), ("n", "w", "queued", 1), ("n", "u", "done", 2)]
    saved, rejected = jobs.upsert_jobs(
        current, spark.createDataFrame(rows, "id string, user_id string, state string, seq int"), "seq"
    )
    assert sorted(tuple(r) for r in saved.collect()) == [("j", "u", "done"), ("n", "w", "queued")]
    assert sorted((r.id, r.user_id, r.seq) for r in rejected.collect()) == [("j", "w", 2), ("n", "u", 2)]
    kept = jobs.replace_steps(
        spark.createDataFrame([("j", 1), ("k", 2)], "job_id string, id int"),
        spark.createDataFrame([("j", 9)], "job_id string, id int"),
    )
    assert sorted(tuple(r) for r in kept.collect()) == [("j", 9), ("k", 2)]


def test_one_row_per_new_subject(spark):
    users = spark.createDataFrame([("1", "x")], "id string, external_id string")
    seen = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "external_id string")
    got = jobs.provision_users(seen, users).collect()
    assert sorted((r.external_id, r.is_new) for r in got) == [("x", False), ("y", True)]


# Specs, payloads and text


def test_spec_rules(spark):
    rows = [("add", "whole", None, "", None, False), ("background", "whole", None, None, "#ffffff", False),
            ("remove", "brush", None, None, None, True), ("replace", "text", None, "x", None, False), ("fly", "whole", None, None, None, False)]
    df = spark.createDataFrame(rows, "op string, mask_source string, target string, content string, colour string, has_mask boolean")
    assert [r.violations for r in specs.validate_specs(df).collect()] == [
        ["needs content"], [], [], ["text needs target"], ["unknown op"]]
    assert specs.validate_specs(df, intents=True).where("op = 'remove'").first().violations == ["needs target"]


def test_upload_checks_come_in_order(spark):
    rows = [(26 * 2**20, "GIF", 0, 0), (0, "GIF", 0, 0), (5, None, 0, 0), (5, "PNG", 0, 9), (5, "PNG", 9000, 9000), (5, "PNG", 8, 8)]
    df = spark.createDataFrame(rows, "byte_size bigint, format string, width int, height int")
    assert [r.reason for r in specs.admit_uploads(df).collect()] == [
        "too large", "empty", "format not supported", "bad size", "too many megapixels", None]


def test_mask_shape_tolerance(spark):
    rows = [([0, 4], 2, 2, 20, 20), ([3], 2, 2, 20, 20), ([0, 4], 2, 2, 20, 60)]
    df = spark.createDataFrame(rows, "counts array<int>, width int, height int, image_width int, image_height int")
    assert [len(r.violations) for r in specs.validate_masks(df).collect()] == [0, 1, 0]
    far = df.where("image_height = 60").withColumn("image_height", F.lit(900))
    assert specs.validate_masks(far).first().violations == ["not the shape of the image"]


def test_redaction_by_name_at_every_level(spark):
    record = {"API_Key": "a", "n": 1.5, "s": "1", "none": None, "list": [1, {"cookie": 2, "ok": "x"}], "tokens": [1, 2],
              "a": {"b": {"c": {"d": 1}}}, "quote": 'he said "token"'}
    got = json.loads(said(spark, payloads.redact, json.dumps(record))[0])
    hidden = fixed.REDACTED
    assert got == {**record, "API_Key": hidden, "tokens": hidden, "list": [1, {"cookie": hidden, "ok": "x"}]}


@pytest.mark.parametrize("levels", [3, 24])
def test_redaction_in_the_jvm_equals_the_helper(spark, levels):
    r = random.Random(8)

    def made(depth):
        if depth == 0:
            return r.choice([1, 2.5, None, True, 'a " [token] {', "back\\slash]", ""])
        if r.random() < 0.4:
            return [made(r.randrange(depth)) for _ in range(r.randrange(3))]
        return {r.choice(["a", "b}", "Key", "x_token", '"q"']): made(depth - 1) for _ in range(r.randrange(1, 4))}

    texts = [json.dumps(made(d % 9)) for d in range(60)] + ["{broken", None, '{"a":1,"a":2}', "null", '"token"', "[]", "{}", "7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, fields string")
    want = dict(enumerate(said(spark, payloads.redact, *texts)))
    assert {x.i: x.fields for x in payloads.redact_records(df, "fields", levels).collect()} == want


def test_redaction_keeps_harmless_values_at_any_depth(spark):
    def plain(v):
        if isinstance(v, dict):
            return {k: fixed.REDACTED if any(m in k.lower() for m in ("token", "key")) else plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    records = []
    for levels in [*range(1, 13), 200]:
        held = {"e": 1, "Api_K\u0065y": {"x": [1, {"y": 2}]}, "t": 'a "token": [{,}] \\', "n": None}
        for k in range(levels - 1):
            held = {"ab"[k % 2]: held, "token": [held], "z": []} if k % 3 < 2 and levels < 20 else {"l": [held, {}, 1.5, True], "q\\\"key": "k"}
        records.append(held)
    got = said(spark, payloads.redact_all, *[json.dumps(r) for r in records], "{broken", None, '{"a":1,"a":2}', "null", '"token"', "[]")
    assert [json.loads(g) for g in got[:len(records)]] == [plain(r) for r in records]
    hidden = json.dumps(fixed.REDACTED)
    assert got[len(records):] == [hidden, None, hidden, "null", '"token"', "[]"]


def test_both_redaction_queries_follow_any_depth(spark, monkeypatch):
    from darkroom.plans import specs as bound

    deep = '{"a":{"b":{"c":{"d":{"e":1,"token":2}}}}}'
    monkeypatch.setattr(bound, "table", lambda *_: spark.createDataFrame([(1, deep)], "event_id long, props string"))
    got = bound.plans.queries["pv6_redact_props"](spark, "").collect()
    assert got[0]["fields"] == '{"a":{"b":{"c":{"d":{"e":1,"token":"[redacted]"}}}}}'


def test_context_precedence(spark):
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    got = one(spark, payloads.merge_context(m(a="outer", b="outer"), m(a="inner", c="inner"), m(b="own", error_detail="e" * 900)))
    assert got == {"a": "outer", "b": "own", "c": "inner", "error_detail": "e" * 500}


def test_phrases_of_every_shape(spark):
    shapes = ['{"sentences": " a "}', '{"captions": ["x", {"raw": "y", "sent": "z"}, {"sent": "w"}, " "]}', '{"other": 1}']
    assert said(spark, payloads.flatten_sentences, *shapes) == [["a"], ["x", "y", "w"], []]


def test_text_rules(spark):
    assert said(spark, text.normalise_subject, "The  Red Car.", "the my cat", None, "a the x") == ["red car", "cat", "", "the x"]
    assert said(spark, text.normalise_phrase, " A Cat.. ", " . ", "dog") == ["a cat.", "", "dog."]
    assert said(spark, text.word_count, " one  two ", "", " ") == [2, 0, 0]
    assert said(spark, text.line_count, "a\nb\n", "", "a\r\n\r\nb", "a") == [2, 0, 3, 1]


# Labelled instructions with what they ask for; the instruction file's own authored rows.
LABELLED = [
    ("remove the car", "remove", "car", None, None),
    ("erase the person on the left", "remove", "person on the left", None, None),
    ("please remove the bin", "remove", "bin", None, None),
    ("get rid of the wires in the photo", "remove", "wires", None, None),
    ("replace the sky with a sunset", "replace", "sky", "a sunset", None),
    ("put a modern sofa where the armchair is", "replace", "armchair", "a modern sofa", None),
    ("add a moustache", "add", None, "moustache", None),
    ("change the background to teal please", "background", None, None, "#008080"),
    ("set background to #A1B2C3", "background", None, None, "#a1b2c3"),
    ("make the background a sunset", "background", None, "sunset", None),
    ("upscale", "upscale", None, None, None),
    ("make it sharper", "upscale", None, None, None),
    ("erase whatever that grey box is at the bottom", None, None, None, None),
    ("what is this?", None, None, None, None),
    ("", None, None, None, None),
]


def test_routing(spark):
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(LABELLED)], "i int, instruction string")
    got = routing.route_instructions(df).orderBy("i").collect()
    assert [(r.op, r.target, r.content, r.colour) for r in got] == [row[1:] for row in LABELLED]
    assert [r.route for r in got] == ["rule" if row[1] else "ask" for row in LABELLED]
    refused = routing.route_instructions(df.where("i = 6"), available=["remove"]).first()
    assert refused.route == "ask" and refused.question.startswith("add is not implemented")


# Evaluation


def test_diff_kinds(spark):
    schema = "id string, status string, cost double, bbox_iou double, signature string, passes string"
    was = [("gone", "ok", 1.0, None, None, "p"), ("a", "ok", 100.0, 0.9, "00ff", "p"), ("b", "failed", 0.0, None, None, None)]
    now = [("fresh", "ok", 1.0, None, None, "p"), ("a", "failed", 110.0, 0.8, "10ff", "q"), ("b", "ok", 5.0, 0.2, "00", None)]
    found = evaluation.baseline_diff(spark.createDataFrame(was, schema), spark.createDataFrame(now, schema))
    got = [(r.case, r.kind, r.detail, r.blocking) for r in evaluation.order_findings(found).collect()]
    assert got == [
        ("a", "status", "ok -> failed", True), ("a", "grounding", "IoU 0.900 -> 0.800", True),
        ("gone", "missing", "in the baseline but not in this run", True),
        ("a", "cost", "100.0 -> 110.0 (+10%)", False), ("a", "image", "the result changed (distance 0.063)", False),
        ("a", "route", "p -> q", False), ("b", "status", "failed -> ok", False),
        ("fresh", "new", "not in the baseline; record it if intended", False),
    ]


@pytest.mark.parametrize(("a", "b", "d"), [("00", "ff", 1.0), ("00", "0000", 1.0), ("10" * 20, "10" * 19 + "13", 3 / 255), ("ab", "ab", 0.0)])
def test_signature_distance(spark, a, b, d):
    assert one(spark, policy.signature_distance(F.lit(a), F.lit(b))) == pytest.approx(d)


def test_empty_reports_are_zero(spark):
    row = evaluation.iou_summary(spark.createDataFrame([], "iou double, seconds double")).first()
    assert row.n == 0 and all(v == 0 for v in row)


def test_pass_route_and_standing_cost(spark):
    rows = [("e", 1, -1.0, 8.0, 9.0, "fast", True), ("e", 2, 2.0, 5.0, 9.0, "escalate", True), ("e", 3, 0.0, 0.0, 9.0, "residual", False)]
    df = spark.createDataFrame(rows, "id string, n int, delta double, cost double, start_cost double, strategy string, attempted boolean")
    row = evaluation.pass_summary(evaluation.carry_incumbent(df, "id", ["n"]), "id", ["n"]).first()
    assert (row.cost, row.kept, row.rolled_back, row.not_applicable) == (8.0, 1, 1, 1)
    assert row.route == "fast -> escalate (rolled back) -> residual (n/a)"


@pytest.mark.parametrize(
    ("ok", "attempt", "seconds", "widen", "action"),
    [(True, 9, 99.0, False, "accept"), (False, 3, 1.0, True, "stop"), (False, 2, 60.0, True, "stop"), (False, 2, 59.0, True, "widen"), (False, 1, 1.0, False, "ask")],
)
def test_decide(spark, ok, attempt, seconds, widen, action):
    values = [F.lit(v) for v in (ok, attempt, seconds, widen, 2, 60.0)]
    assert one(spark, policy.decide_action(*values)) == action


# Ranking


def test_candidates_cut_then_drop_empty_boxes(spark):
    rows = [("g", i, s, 0.5, 0.5, w, 0.2) for i, (s, w) in enumerate([(0.9, 0.0), (0.9, 0.4), (0.3, 0.4), (0.2, 0.4)])]
    df = spark.createDataFrame(rows, "g string, i int, score double, cx double, cy double, w double, h double")
    got = ranking.top_candidates(df, "g", ["i"], k=2).collect()
    assert [(r.i, r["rank"]) for r in got] == [(1, 2)]
    lone = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.5), ("b", 2, 0.4)], "g string, rank int, score double")
    serve = {r.g: (round(r.margin, 3), r.ambiguous) for r in ranking.top2_margin(lone, "g").collect()}
    assert serve == {"a": (1.0, False), "b": (0.1, True)}
    report = ranking.top2_margin(lone, "g", lone=0.0, serving=False).where("g = 'a'").first()
    assert (report.margin, report.ambiguous) == (0.0, False)


def test_short_samples_keep_their_best(spark):
    rows = [("a", 1, 0.9, 0.2), ("a", 2, 0.8, 0.6), ("b", 1, 0.7, 0.1)]
    df = spark.createDataFrame(rows, "g string, rank int, score double, iou double")
    got = {r.k: (r.hit_rate, round(r.miou, 3)) for r in ranking.hit_curve(df, "g", 3).collect()}
    assert got == {1: (0.0, 0.15), 2: (0.5, 0.35), 3: (0.5, 0.35)}


def test_even_sample_and_natural_order(spark):
    clip = spark.createDataFrame([("c", 10), ("z", 0)], "clip string, total int")
    assert [r.frame for r in ranking.even_sample(clip, "total", 3).collect()] == [round(10 * (i + 1) / 4) for i in range(3)]
    names = spark.createDataFrame([("10.png",), ("2.png",), ("1.png",)], "n string")
    assert [r.n for r in ranking.natural_top(names, "n", 2).collect()] == ["1.png", "2.png"]


# Tuning


def test_split_is_pythons(spark):
    ids = [str(i) for i in range(300)]
    want = ["holdout" if int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) % 100 < 50 else "fit" for i in ids]
    assert said(spark, tuning.hash_split, *ids) == want


def test_sweep_equals_scoring_every_gate(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(float(v) for v in rng.random(4).round(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "confidence double, above double, below double, box_score double")
    curve = {r.gate: r.score for r in tuning.gate_sweep(df).collect()}
    for gate in tuning.GATES:
        assert curve[gate] == pytest.approx(np.mean([a if c >= gate else b for c, a, b, _ in rows]), abs=1e-4)
    best = tuning.best_gate(tuning.gate_sweep(df)).first()
    assert best.gate == min(g for g, s in curve.items() if s == max(curve.values()))
    for r in tuning.abstention_curve(df, F.lit(0.5)).collect():
        kept = [(a if c >= 0.5 else b) for c, a, b, s in rows if s >= r.gate]
        assert r.abstained == pytest.approx(1 - len(kept) / 200)
        assert r.miou_answered == pytest.approx(np.mean(kept) if kept else 0.0)
    assert {r.score for r in tuning.gate_sweep(df.limit(0)).collect()} == {0.0}


def test_small_sets_adopt_nothing(spark):
    rows = [("fit" if i % 2 else "holdout", 0.5, 1.0, 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "split string, confidence double, above double, below double")
    few, many = tuning.adopt_if_better(df).first(), tuning.adopt_if_better(df.union(df)).first()
    assert (few.adopted, few.gate) == (False, 0.85)
    assert (many.adopted, many.gate, many.holdout_at_default) == (True, 0.0, 0.0)


# Masks


def _mask_rows(spark, grid, name=0):
    pixels = [(name, x, y, int(grid[y][x])) for y in range(len(grid)) for x in range(len(grid[0]))]
    return (
        spark.createDataFrame(pixels, "mask_id int, x int, y int, v int"),
        spark.createDataFrame([(name, len(grid[0]), len(grid))], "mask_id int, width int, height int"),
    )


def _counts(grid):
    flat = (np.asarray(grid).reshape(-1, order="F") > 0).astype(int)
    edges = np.concatenate(([-1], np.flatnonzero(np.diff(flat)), [flat.size - 1]))
    return ([0] if flat[0] else []) + np.diff(edges).tolist()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(grid=st.integers(1, 4).flatmap(lambda w: st.lists(st.lists(st.sampled_from([0, 1, 255]), min_size=w, max_size=w), min_size=1, max_size=5)))
def test_masks_survive_encoding(spark, grid):
    pixels, sizes = _mask_rows(spark, grid)
    packed = masks.pack_runs(masks.rle_encode(pixels, sizes, block_rows=3))
    assert packed.first()["counts"] == _counts(grid)
    back = masks.rle_decode(masks.runs_of(packed, block_rows=2), sizes, chunk=2).collect()
    assert {(r.x, r.y): r.v for r in back} == {(x, y): int(grid[y][x] > 0) for y in range(len(grid)) for x in range(len(grid[0]))}


def test_iou_of_known_pairs(spark):
    schema = "pair_id string, start bigint, len bigint"
    pred = spark.createDataFrame([("same", 5, 90), ("half", 0, 20), ("apart", 0, 5)], schema)
    true = spark.createDataFrame([("same", 5, 90), ("half", 10, 20), ("apart", 50, 5), ("none", 0, 3)], schema)
    pairs = spark.createDataFrame([(p,) for p in ("same", "half", "apart", "none", "void")], "pair_id string")
    got = {r.pair_id: (r.iou, r.precision, r.recall) for r in masks.mask_iou(pairs, pred, true, bucket=8).collect()}
    assert got == {"same": (1, 1, 1), "half": (pytest.approx(1 / 3), 0.5, 0.5), "apart": (0, 0, 0), "none": (0, 0, 0), "void": (0, 0, 0)}


def test_geometry_and_box_of_an_empty_and_a_wrapping_mask(spark):
    sizes = spark.createDataFrame([(1, 4, 5), (2, 4, 5)], "mask_id int, width int, height int")
    runs = spark.createDataFrame([(1, 8, 4)], "mask_id int, start bigint, len bigint")  # (1,3) (1,4) (2,0) (2,1)
    geo = {r.mask_id: r for r in masks.mask_geometry(runs, sizes).collect()}
    assert (geo[1].min_x, geo[1].max_x, geo[1].min_y, geo[1].max_y, geo[1].area) == (1, 2, 0, 4, 4)
    assert (geo[1].solidity, geo[1].aspect, geo[1].x0, geo[1].x1) == (0.4, 2.5, 0.25, 0.75)
    assert (geo[2].area, geo[2].solidity, geo[2].aspect, geo[2].x0) == (0, 0.0, 1.0, None)
    boxes = spark.createDataFrame([(1, 0.25, 0.0, 0.75, 1.0), (2, 0.0, 0.0, 1.0, 1.0)], "mask_id int, x0 double, y0 double, x1 double, y1 double")
    box = {r.mask_id: (r.inside_frac, r.box_recall, r.bbox_iou, r.hit) for r in masks.box_metrics(runs, sizes, boxes).collect()}
    assert box[1] == (1.0, 0.4, 0.4, False) and box[2] == (0.0, 0.0, 0.0, False)


def test_survivors_need_score_rank_and_overlap(spark):
    rows = [("i", 0, 0.0, 0.0, 0.1, 0.1, 0.9), ("i", 1, 0.8, 0.8, 1.0, 1.0, 0.95), ("i", 2, 0.0, 0.0, 0.1, 0.1, 0.2)]
    dets = spark.createDataFrame(rows, "image_id string, n int, x0 double, y0 double, x1 double, y1 double, score double")
    regions = spark.createDataFrame([("i", 0.0, 0.0, 0.5, 0.5), ("j", 0.0, 0.0, 1.0, 1.0)], "image_id string, rx0 double, ry0 double, rx1 double, ry1 double")
    got = {r.image_id: r.still_there for r in masks.surviving_score(dets, regions, ["n"]).collect()}
    assert got == {"i": 0.9, "j": 0.0}


def test_consistency_needs_four_on_each_side(spark):
    rows = [("k", [1.0, 0.0], True)] * 4 + [("k", [1.0, 1.0], False)] * 4 + [("few", [1.0, 0.0], True)] * 9
    df = spark.createDataFrame(rows, "k string, v array<double>, inside boolean")
    got = {r.k: r.consistency for r in masks.region_consistency(df, "k", "v", "inside").collect()}
    assert got == {"k": pytest.approx(math.sqrt(0.5)), "few": 0.0}


# Documents


def test_document_checks(spark):
    secret = "sk-" + "a1B2" * 6
    docs = spark.createDataFrame(
        [("a", "see [x](y.md) [z](gone.md) [w](https://e.org) [v](#top)\n"), ("b", f"key {secret}\n**Solves:** it")], "path string, text string"
    )
    have = spark.createDataFrame([("y.md",)], "target string")
    assert [(r.path, r.target) for r in documents.broken_links(docs, have).collect()] == [("a", "gone.md")]
    nested = spark.createDataFrame(
        [("docs/in/a.md", "[u](../b.md) [h](./c.md) [t](/etc/x) [r](../../) [f](../in/) [g](../gone.md) [g](../gone.md)"),
         ("/x/y.md", "[u](../../../z.md) [w](w.md)"), (None, "[n](b.md) [m](docs//./b.md)")], "path string, text string")
    have = spark.createDataFrame([("docs/b.md",), ("docs/in/c.md",), ("docs/in",), ("/z.md",), (None,)], "target string")
    found = documents.broken_links(nested, have).collect()
    assert sorted((r.path or "", r.target, r.mentions) for r in found) == [
        ("", "b.md", 1), ("/x/y.md", "w.md", 1), ("docs/in/a.md", "../gone.md", 2), ("docs/in/a.md", "/etc/x", 1)]
    assert [r.path for r in documents.secret_scan(docs).collect()] == ["b"]
    assert sorted((r.path, r.field) for r in documents.required_headers(docs).where("path = 'b'").collect()) == [
        ("b", "**Authority:**"), ("b", "**Read when:**")]
    assert [(r.path, r.lines) for r in documents.doc_size_limits(docs, 1).collect()] == [("b", 2)]


# Learning


def _gradient_descent(x, y, l2=1.0, steps=20_000):
    mean, std = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(std < 1e-9, 1.0, std)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - 0.5 * (z.T @ err / len(y) + l2 * w / len(y)), b - 0.5 * err.mean()
    return w, b


def test_fit_matches_plain_descent_and_folds_partition(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=(80, 2)), np.full(80, 3.0)])
    y = (x[:, 0] + 0.3 * rng.normal(size=80) > 0).astype(int)
    rows = [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label int")
    fitted = learning.fit_chooser(df, ["a", "b", "c"])
    weights, bias = _gradient_descent(x, y)
    assert list(fitted.weights.values()) == pytest.approx(weights.tolist(), abs=1e-4)
    assert fitted.bias == pytest.approx(bias, abs=1e-4)

    folded = learning.stratified_folds(df, "id", "label", 4, seed=5)
    sizes = {}
    for r in folded.groupBy("label", "fold").count().collect():
        sizes.setdefault(r.label, []).append(r["count"])
    assert sum(map(sum, sizes.values())) == 80 and all(max(s) - min(s) <= 1 for s in sizes.values())
    again = learning.stratified_folds(df.repartition(9), "id", "label", 4, seed=5)
    assert sorted(folded.select("id", "fold").collect()) == sorted(again.select("id", "fold").collect())
    scored = learning.cross_validate(folded, ["a", "b", "c"], 4)
    assert scored.count() == 80 and scored.where("predicted = label").count() > 60


def test_one_class_training_predicts_the_majority(spark):
    rows = [(i, float(i), 0, i % 2) for i in range(6)] + [(9, 9.0, 1, 0)]
    df = spark.createDataFrame(rows, "id int, a double, label int, fold int")
    got = {r.fold: r.predicted for r in learning.cross_validate(df, ["a"], 2).where("fold = 0").collect()}
    assert got == {0: 0}


# Sources and sinks


def test_readers(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"instruction": "remove it", "op": "remove", "split": "authored"}\n\n{"instruction": "hm"}\n')
    got = readers.read_labelled_jsonl(spark, str(tmp_path / "rows.jsonl")).collect()
    assert sorted((r.instruction, r.op, r.split) for r in got) == [("hm", None, "holdout"), ("remove it", "remove", "authored")]

    reports = tmp_path / "reports"
    reports.mkdir()
    (reports / "r.json").write_text(json.dumps([{"id": "a", "op": "remove", "cost": 1.0}, {"id": "b", "op": "add"}], indent=1))
    assert [r.id for r in readers.read_report(spark, str(reports)).collect()] == ["a"]
    (reports / "r.json").write_text(json.dumps([
        {"id": "a", "op": "remove", "cost": 1.0}, {"id": "c", "op": "remove", "cost": 9.0},
        {"id": "a", "op": "remove", "cost": 2.0}, {"id": "a", "op": "add", "cost": 3.0}, {"op": "upscale", "cost": 4.0}]))
    last = readers.read_report(spark, str(reports)).collect()
    assert sorted((r.id or "", r.cost) for r in last) == [("", 4.0), ("a", 2.0), ("c", 9.0)]

    runs = tmp_path / "runs"
    runs.mkdir()
    for name, peak in (("small", 900), ("large", 1300), ("whole", 5000), ("other", 1)):
        (runs / f"{name}.json").write_text(json.dumps({"peak_rss_mb": peak, "warm_p50_s": 1.0}, indent=1))
    table = readers.collate_results(spark, str(runs), {"small": "S", "large": "L"}, {"whole": "W"})
    assert {r.run: (r.label, r.verdict) for r in table.collect()} == {"small": ("S", "fits"), "large": ("L", "OVER"), "whole": ("W", "—")}


def test_scan_lists_digests_only(spark, tmp_path):
    digest = hashlib.sha256(b"x").hexdigest()
    folder = Path(tmp_path, digest[:2])
    folder.mkdir()
    (folder / digest).write_bytes(b"12345")
    (folder / f"{digest}.partial").write_bytes(b"1")
    df = readers.scan_objects(spark, str(tmp_path))
    assert [(r.digest, r.size) for r in df.collect()] == [(digest, 5)]
    assert "content" not in df._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_same_bytes_are_stored_once(spark):
    root = scratch_dir(spark, "put")
    blobs = spark.createDataFrame([(b"a",), (b"a",), (b"bb",)], "content binary")
    writers.put_objects(blobs, root)
    writers.put_objects(blobs, root, known=writers.stored_objects(spark, root))
    got = sorted((r.size, r.digest, r.prefix) for r in writers.stored_objects(spark, root).collect())
    assert got == [(n, d, d[:2]) for n, d in sorted((len(b), hashlib.sha256(b).hexdigest()) for b in (b"a", b"bb"))]


def test_owner_filter_reaches_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_custkey", "user_id")
    plan = specs.owner_scoped(orders, F.lit(7)).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan


def test_a_region_on_the_limit_is_not_blank_in_any_order(spark):
    """The levels average to 16; added as doubles, some orders give 15.999999999999998."""
    from itertools import permutations

    pixels = [(q * 1.01, d * 97, t * 100) for q, d, t in [(41.0, 0.09, 0.03), (50.0, 0.08, 0.08), (29.0, 0.04, 0.06), (31.0, 0.07, 0.0), (39.0, 0.02, 0.02)]]
    rows = [(i, *pixel) for i, order in enumerate(permutations(pixels)) for pixel in order]
    df = spark.createDataFrame(rows, "region_id int, r double, g double, b double").coalesce(1)
    got = evaluation.blank_regions(df, ["r", "g", "b"]).collect()
    assert len(got) == 120 and not any(r.blank for r in got)


def test_proxy_report_writes_its_fills_once(spark, monkeypatch):
    """Gaps equal those of plain ranks, with small groups beside a large one; only one ranking is written whole."""
    from darkroom.operators import ranks

    r = random.Random(4)
    rows = [("abc"[min(i % 50, 2)], i, *[r.randrange(40) / 8 for _ in range(6)]) for i in range(3000)]
    schema = "dataset string, id int, arm_a double, arm_b double, cost_a double, cost_b double, semantic_a double, semantic_b double"
    written = []
    cut = ranks.cut_lineage
    monkeypatch.setattr(ranks, "cut_lineage", lambda df: (kept := cut(df), written.append(kept.count()))[0])
    got = {x.dataset: x for x in evaluation.proxy_report(spark.createDataFrame(rows, schema), ["id"]).collect()}
    for name in "abc":
        mine = [x for x in rows if x[0] == name]
        scores = [[*[x[a] for x in mine], *[x[a + 1] for x in mine]] for a in (2, 4, 6)]
        places = [np.argsort(np.argsort(s, kind="stable")) for s in scores]
        want = [round(float(np.corrcoef(places[0], p)[0, 1]), 9) for p in places[1:]]
        assert [round(got[name].spearman_cost, 9), round(got[name].spearman_semantic, 9)] == want
        assert got[name].n_fills == 2 * len(mine)
    assert sorted(written)[-1] == 6000 and sum(written) < 7000
