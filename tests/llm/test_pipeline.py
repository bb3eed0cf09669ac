"""The pipeline's stages on the smallest shared tables, each against a plain version of its rule."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from darkroom.llm import credentials, severity
from darkroom.session import cut_lineage

CLASH = ("again", "gone_id", "gone_hash", "gone", "id", "row_hash", "row", "kept", "n", "marks", "docs", "sha", "detail_sha256", "instruction", "prompt", "ids")


def shingles(text):
    words = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def components(docs):
    """Smallest doc_id of every group, all pairs compared."""
    sets = {i: shingles(t) for i, t in docs.items()}
    top = {i: i for i in docs}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    names = sorted(docs)
    for k, a in enumerate(names):
        for b in names[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in docs}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    planted = [(9000 + k, text, "en", "s", len(text)) for k, text in enumerate((
        "the lamp token=abc123def456 stays", "first AKIA" + "Z9" * 10 + ", then " + "0f" * 14 + " and api_key: 'k3y-k3y-k3y'", "nothing here"))]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    at = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = at[name] = cut_lineage(stage(spark, docs, sf))
    rows = {k: {r.doc_id: r for r in v.collect()} for k, v in at.items() if k != "best_fit_packing"}
    for name in ("toxicity", "exact_dedup", "near_dedup", "secret_scan"):
        assert at[name].columns == at["start"].columns

    # toxicity: the same model, one document and one feature at a time
    first = at["start"].select(F.col("doc_id").alias("id"), F.col("text").alias("instruction"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("toxic").alias("grade"))
    model = severity.fit_severity(first, labels)
    harmful = set()
    for i, r in rows["start"].items():
        hits = defaultdict(int)
        for w in severity.words_of(r.text):
            for f in severity.features(w):
                hits[f] += 1
        score = sum(model.weights.get(f, 0.0) * n ** 0.5 for f, n in hits.items())
        if hits and 1 / (1 + np.exp(model.cuts[0] - score)) >= 0.5:
            harmful.add(i)
    assert harmful and rows["toxicity"].keys() == rows["start"].keys() - harmful

    by_text = {}
    for r in rows["toxicity"].values():
        by_text[r.text] = max(by_text.get(r.text, -1), r.doc_id)
    assert sorted(rows["exact_dedup"]) == sorted(by_text.values()) and len(rows["exact_dedup"]) < len(rows["toxicity"])

    groups = components({i: r.text for i, r in rows["exact_dedup"].items()})
    assert sorted(rows["near_dedup"]) == sorted(i for i, g in groups.items() if i == g)

    learned = credentials.fit_formats(at["near_dedup"], "doc_id", "text")
    assert rows["secret_scan"].keys() == rows["near_dedup"].keys()
    changed = 0
    for i, r in rows["near_dedup"].items():
        gone = set()
        for _, a, b, _s in credentials.all_spans(r.text, learned):
            gone |= set(range(a, b))
        want = "".join("\0" if k in gone and k - 1 not in gone else "" if k in gone else c for k, c in enumerate(r.text))
        shown = rows["secret_scan"][i]
        # neighbouring spans have a mark each; they are one here
        assert shown.text.replace("[secret][secret]", "[secret]") == want.replace("\0", "[secret]") and shown.n_chars == len(shown.text)
        changed += bool(gone)
    assert changed == 2

    vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed, sequences = defaultdict(list), defaultdict(list)
    for r in at["best_fit_packing"].collect():
        packed[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert packed.keys() == rows["secret_scan"].keys()
    for i, mine in packed.items():
        mine.sort(key=lambda r: r.piece)
        ids = [x for r in mine for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == vocabulary.encode(rows["secret_scan"][i].text or "", add_special_tokens=False).ids + [0]
        assert [r.start for r in mine] == [sum(r.length for r in mine[:k]) for k in range(len(mine))]
    total = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
        total += end
    assert len(sequences) <= -(-total // 2048) + 1


def test_awkward_rows(spark, sf):
    rows = [(1, "same text", "en", "s", 9), (2, "same text", "en", "s", 9), (2, "same text", "de", "t", 9), (None, None, None, None, None), (3, "", "en", "s", 0), (4, "w " * 300_000, "en", "s", 600_000)]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in CLASH})
    for _, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs.columns, cut_lineage(stage(spark, docs, sf))
        assert docs.columns == before
    got = [(r.doc_id, (r.text or "")[:9]) for r in docs.collect()]
    assert sorted(got, key=str) == [(2, "same text"), (3, ""), (4, "w w w w w")]
    packed = corpus_pipeline.best_fit_packing(spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {2, 3, 4} and sum(r.length for r in packed if r.doc_id == 3) == 1
    assert len(corpus_pipeline.best_fit_packing(spark, spark.createDataFrame([(None, None), (5, "a"), (5, "a")], "doc_id long, text string"), sf).collect()) == 3


def test_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf))
        assert docs.collect() == []
