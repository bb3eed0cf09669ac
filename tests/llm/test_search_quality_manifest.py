"""Ranked search, prompt quality and the step manifest on small awkward tables, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm import balltree, boosting, manifest, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = ("text", "n", "terms", "asked", "g", "pos", "row", "digest", "found", "at", "bit", "score", "good", "gid", "x", "rank")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def terms(text):
    return TERM.findall(lower(text or ""))


def plain_search(steps, phrases, best):
    """Every phrase against every step, straight from the formula."""
    docs = [(i, Counter(terms(t))) for i, t in steps]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, length = len(docs), sum(n for _, _, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for p, text in phrases:
        scored = []
        for i, c, n in docs:
            m = 100 - 50 + (50 * n * total) // length
            score = sum(balltree.weight(total, df[w]) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                scored.append((score, i))
        scored.sort(key=lambda s: (-s[0], s[1] is not None, s[1] or 0))
        out += [(p, r, i, s) for r, (s, i) in enumerate(scored[:best], 1)]
    return sorted(out, key=str)


def step_rows(n=400, seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß漢0") for _ in range(r.randint(1, 5))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocab[: r.choice((10, 60, 300))]) for _ in range(k))
    rows = [(i, say(r.randint(1, 60))) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # equal scores
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[7][1]), (None, None), (2000, None), (2001, ""), (2002, " \n-_!\x00 ")]
    rows += [(2003, say(20_000)), (2004, "x" * 9000), (2005, "Erase;THE-Café_sign\x7Fnow"), (-5, rows[3][1].upper())]
    return rows, say


@pytest.fixture(scope="module")
def steps(spark):
    rows, _ = step_rows()
    return spark.createDataFrame(rows, "id long, detail string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)


@pytest.mark.parametrize("best,together,leaf,groups", [(50, 256, 64, 4096), (5, 3, 4, 7)])
def test_search_equals_scoring_everything(spark, steps, monkeypatch, best, together, leaf, groups):
    monkeypatch.setattr(balltree, "LEAF", leaf)
    monkeypatch.setattr(balltree, "GROUPS", groups)
    rows, say = step_rows()
    phrases = [(f"case-{i}", say(6)) for i in range(9)] + [("case-1", "abc"), ("dull", None), ("blank", " - "), (None, rows[3][1]), ("odd", "THE café x" + "x" * 8999)]
    asked = spark.createDataFrame(phrases, "id string, phrase string").withColumns({c: F.lit("z") for c in ("asked", "terms", "text", "phrase_id")})
    got = balltree.search_steps(steps, asked, best=best, together=together).collect()
    assert sorted([(r.phrase_id, r["rank"], r.step_id, r.score) for r in got], key=str) == plain_search(rows, phrases, best)


def test_search_of_text_ids_and_empty_tables(spark):
    results = spark.createDataFrame([("b", "remove the lamp"), ("a", "remove the lamp"), (None, "remove the lamp"), ("c", "add a cat")], "id string, prompt string")
    phrases = spark.createDataFrame([("p", "lamp")], "id string, phrase string")
    got = balltree.search_steps(results, phrases, detail="prompt").orderBy("rank").collect()
    assert [(r["rank"], r.step_id) for r in got] == [(1, None), (2, "a"), (3, "b")]
    for s, p in ((results.limit(0), phrases), (results, phrases.limit(0)), (results, phrases.withColumn("phrase", F.lit("zebra")))):
        assert balltree.search_steps(s, p, detail="prompt").collect() == []


def test_no_row_exceeds_its_bounds():
    r = np.random.default_rng(3)
    width, n = 50, 300
    dense = (r.random((n, width)) < 0.2) * r.integers(1, 10**6, (n, width))
    dense[dense.sum(1) == 0, 0] = 1
    row, col = np.nonzero(dense)
    tree = balltree.BallTree(np.concatenate([[0], np.cumsum(np.bincount(row))]), col, dense[row, col], width)
    for k in range(20):
        names = np.sort(r.choice(width, 8, replace=False))
        asked = balltree.Asked(k, names, r.integers(1, 12_000, 8), width)
        bounds, scores = tree.bounds(asked), dense[:, names] @ asked.weights
        assert sorted(tree.order) == list(range(n))
        for node, (low, high) in enumerate(tree.ranges):
            assert scores[tree.order[low:high]].max() <= bounds[node]


def test_search_leaves_subtrees_out():
    r = np.random.default_rng(4)
    rows = [(np.arange(10) + 10 * (i % 40), r.integers(10**5, 10**6, 10)) for i in range(4000)]  # forty separate topics
    tree = balltree.BallTree(np.arange(0, 40_001, 10), np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]), 400)
    asked, dense, best = balltree.Asked(0, np.arange(5), np.full(5, 1000), 400), np.zeros(400, np.int64), balltree.Best(10)
    dense[:5], best.ids = 1000, range(4000)
    assert tree.search(asked, dense, best) < 2000  # fewer than half
    want = sorted((-int(1000 * v[:5].sum()), i) for i, (c, v) in enumerate(rows) if i % 40 == 0)[:10]
    assert [(-s, i) for s, i in best.rows] == want


# Quality of prompts


def evaluated(n=900):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 80))]
        good = i % 4 != 0
        rows.append((f"case-{i}", (". ".join(words) if good else " | ".join(w + r.choice(["###", ""]) for w in words)), "ok" if good else "failed"))
    return rows


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(evaluated(), "id string, prompt string, status string")


def by_stretch(text):
    """The statistics of a short text, one by one."""
    raw, words, lines = text.encode(), text.encode().split(), [x for x in text.split("\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:]))
    seen, share = Counter(words), lambda a, b: a / max(b, 1)
    p = [n / len(raw) for n in Counter(raw).values()] if raw else []
    count = lambda s: sum(c in s for c in text)
    upper, small = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("abcdefghijklmnopqrstuvwxyz")
    return [
        np.log1p(len(text)), np.log1p(len(words)), share(len(text) - count(" \t\n\x0b\x0c\r"), len(words)), np.log1p(max(map(len, words), default=0)),
        share(upper, upper + small), share(count("0123456789"), len(text)), share(count("#*$%&|<>"), len(text)), share(count(".!?"), len(words)),
        share(count(",;:"), len(words)), share(count("\"'()[]{}/\\@^_`~+=-"), len(text)), share(sum(ord(c) > 127 for c in text), len(text)),
        share(count("\n"), len(words)), -sum(x * np.log2(x) for x in p), max(p, default=0), share(len(seen), len(words)),
        share(max(seen.values(), default=0), len(words)), share(sum(n for w, n in seen.items() if len(w) < 4), len(words)),
        share(len(grams) - len(set(grams)), len(grams)), share(len(lines) - len(set(lines)), len(lines)), share(len(words), len(lines)),
    ]


def test_statistics_one_by_one(monkeypatch):
    texts = ["", " \n", "Ünïcode ﬁ 漢字 \U0001F600 end.", "a b c a b c a b c\na b c\na b c", "A|B #1 <x>; (y)", "z" * 3000]
    assert np.allclose(boosting.text_statistics([t.encode() for t in texts]), [by_stretch(t) for t in texts])
    assert np.allclose(boosting.text_statistics([None]), boosting.text_statistics([b""])) and not boosting.text_statistics([b""]).any()
    monkeypatch.setattr(boosting, "STRETCH", 50)
    long = " ".join(f"w{i}" for i in range(200)).encode()
    assert b"".join(boosting.stretches(long)) == long and len(list(boosting.stretches(long))) > 10
    assert boosting.text_statistics([long])[0, :3].tolist() == by_stretch(long.decode())[:3]
    assert list(boosting.stretches(b"z" * 500)) == [b"z" * 500]


def test_flat_trees_equal_walking_them():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] ** 2 + 0.1 * r.normal(size=400) > 0.7).astype(float)
    model = boosting.fit_trees(x, y, np.ones(400), trees=20, depth=3)

    def walk(row):
        raw = model.base
        for f, b, leaf in zip(model.feature, model.border, model.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > b[at] else 1)
            raw += leaf[at - len(f)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(model.scores(x), [walk(v) for v in x])
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    # one split of one tree against every split tried by hand
    one = boosting.fit_trees(x, y, np.ones(400), trees=1, depth=1, bins=16)
    p = y.mean()
    g, h = p - y, np.full(400, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    tried = [(gain(x[:, f] <= b), f, b) for f in range(5) for b in np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1]) if 8 <= (x[:, f] <= b).sum() <= 392]
    assert max(tried)[1:] == (one.feature[0, 0], one.border[0, 0])


def test_prompt_quality_on_rows_held_out(spark, results):
    verdicts = results.select("id", (F.col("status") == "ok").alias("good"))
    learned = verdicts.where(F.crc32(F.col("id").cast("binary")) % 5 != 0)
    extra = learned.unionByName(learned.limit(1)).unionByName(spark.createDataFrame([(None, True), ("case-1", None)], "id string, good boolean"))
    model = boosting.fit_prompt_quality(results, extra, rows=100)
    got = {r.id: r.score for r in boosting.score_prompts(results, model).collect()}
    held = [(i, s == "ok") for i, _, s in evaluated() if zlib.crc32(i.encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([(got[i] >= 0.5) == ok for i, ok in held]) > 0.98
    again = boosting.fit_prompt_quality(results.repartition(7), extra, rows=100)
    assert np.array_equal(model.leaf, again.leaf) and np.array_equal(model.border, again.border)


def test_prompts_of_any_kind_are_scored(spark, results):
    verdicts = results.select("id", (F.col("status") == "ok").alias("good"))
    model = boosting.fit_prompt_quality(results, verdicts)
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "long " * 400_000), (5, "\x00 漢字")]
    odd = spark.createDataFrame(rows, "id int, prompt string").withColumns({c: F.lit(1) for c in CLASH})
    got = boosting.score_prompts(odd, model).collect()
    assert sorted([r.id for r in got], key=str) == sorted([i for i, _ in rows], key=str)
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.id == 3} | {r.score for r in got if r.id is None}) == 1
    assert len({r.score for r in got if r.id in (1, 2)}) == 1
    assert boosting.score_prompts(odd.limit(0), model).collect() == []
    assert boosting.fit_prompt_quality(results, verdicts.where("good")) is None
    assert boosting.fit_prompt_quality(results.limit(0), verdicts) is None
    assert {r.score for r in boosting.score_prompts(odd, None).collect()} == {0.5}


# The step manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows, changed):
    """(id, state, leaf, subroot, root, proof, folded, verified) per row of (id, job, state, detail)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]])
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            node, proof = leaf(changed(r)), []
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    low = at // 8 * 8
                    left, right = level[low:at], level[at + 1:low + 8]
                    proof += left + right
                    node, at = H(*left, node, *right), at // 8
            out.append((r[0], s, i, leaf(r), trees[s][-1][0], top[-1][0], H(*proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows():
    r = random.Random(9)
    rows = [(r.randint(-10**6, 10**6), f"j{i % 7}", r.choice(["queued", "running", "done", "Done"]), f"Step {i}") for i in range(700)]
    rows = list({x[0]: x for x in rows}.values())
    rows += [(3 * 10**15 + 7 * i, "j", "running", f"late {i}") for i in range(200)] + [(i, "j", "dense", "D" * i) for i in range(600)]
    rows += [(None, "j", "queued", "Lost"), (None, "j", "queued", "Lost"), (None, None, None, None), (None, "a", "queued", "other"), (5, "j", None, "")]
    rows += [(64, "Two", "dense", "b"), (64, "Two", "dense", "b"), (65, None, "dense", "Zz"), (9, "j", "alone", "L"), (-(1 << 63), "j", "queued", "first"), ((1 << 63) - 1, "j", "ünder", "last\x00")]
    return rows


@pytest.mark.parametrize("fields", [2, 4])
def test_manifest_equals_plain_trees(spark, monkeypatch, fields):
    if fields == 2:  # arrays of 64 leaves, so that small trees have several rounds
        monkeypatch.setattr(manifest, "HEIGHT", 2)
        monkeypatch.setattr(manifest, "SLOTS", 64)
        monkeypatch.setattr(manifest, "SLOT_BITS", 6)
    rows = manifest_rows()
    steps = spark.createDataFrame(rows, "id long, job_id string, state string, detail string").withColumns({c: F.lit(1) for c in (*CLASH, "position", "leaf", "c", "bits", "before")}).repartition(4)
    seen = F.when(F.col("job_id") == "j1", F.lower("detail")).otherwise(F.col("detail"))
    got = manifest.step_manifest(steps, found=[F.col("id"), F.col("job_id"), F.col("state"), seen])
    want = plain_manifest(rows, lambda r: (*r[:3], r[3].lower() if r[1] == "j1" else r[3]))
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_few_or_no_steps(spark):
    schema = "id int, job_id string, state string, detail string"
    one = manifest.step_manifest(spark.createDataFrame([(4, "j", "done", "x")], schema)).collect()
    alone = leaf((4, "j", "done", "x"))
    assert [tuple(r) for r in one] == [(4, "done", 0, alone, alone, alone, H(), alone, True)]
    assert manifest.step_manifest(spark.createDataFrame([], schema)).collect() == []


def test_manifest_of_many_states(spark):
    rows = [(i, "j", f"state{i}", None) for i in range(600)]
    got = manifest.step_manifest(spark.createDataFrame(rows, "id long, job_id string, state string, detail string"))
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_manifest(rows, lambda r: r)


def test_queries_of_search_and_manifest_equal_plain_results(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.QUERIES["op11_ranked_search"](spark, sf).collect()
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], key=str) == plain_search([(d[0], d[4]) for d in docs], items, 50)
    flagged = {r.doc_id: r for r in queries.QUERIES["op12_quality_classifier"](spark, sf).collect()}
    assert {i: r.held_out for i, r in flagged.items()} == {d[0]: zlib.crc32(str(d[0]).encode()) % 5 == 0 for d in docs}
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    assert np.mean([flagged[i].predicted == q for i, q in labels]) > 0.9
    assert all(r.predicted == (r.score >= 0.3) for r in flagged.values())
