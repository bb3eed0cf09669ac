"""The corpus operators on small awkward tables, against plain Python."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from darkroom.llm import archive, credentials, packing, passages, pieces, quality, runs, severity, similar, tokens, vocab
from darkroom.llm.vocab import Encoder
from darkroom.llm.words import Words
from darkroom.session import scratch_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")
SP = public_tokenizers.path("piece_bpe_32k.model")
rng = random.Random(7)
VOCAB = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def awkward():
    base = prose(300, 1)
    words = base.split()
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "  \n\t "), (None, base), (None, None), (6, "ab"), (7, "A b C"), (8, "a B c")]
    for k in range(12):  # a chain of near copies
        words = list(words)
        words[20 * k + 5] = f"new{k}"
        rows.append((10 + k, " ".join(words)))
    passage = prose(60, 2)
    rows += [(30 + k, prose(40, 50 + k) + " " + passage + "\n" + prose(40, 90 + k)) for k in range(8)]
    rows += [(40, ("x y " * 60).strip()), (41, "long " + "z" * 5000), (42, prose(6000, 3)), (43, "Ünïcode text ﬁ 漢字 \U0001F600 \x00 ▁ end "), (42, "other text")]
    return rows


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame(awkward(), "id long, detail string").withColumns({c: F.lit(1) for c in ("keep_id", "run", "n", "text", "key", "size", "digest", "start")}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "id long, detail string, lang string, source string")


def test_exact_copies(steps, empty):
    got = runs.exact_copies(steps).collect()
    want = defaultdict(list)
    for i, t in awkward():
        want[t or ""].append(i)
    assert len(got) == len(awkward())
    assert sum(r.kept for r in got) == len(want)
    for r in got:
        group = next(v for k, v in want.items() if hashlib.sha256(k.encode()).hexdigest() == r.detail_sha256)
        assert (r.group_size, r.keep_id) == (len(group), max((x for x in group if x is not None), default=None))
        assert not r.kept or r.id == r.keep_id
    assert runs.exact_copies(empty).collect() == []
    few = {tuple(r) for r in runs.exact_copies(steps, runs=8, fan=2).drop("kept").collect()}
    assert few == {tuple(r) for r in runs.exact_copies(steps).drop("kept").collect()}


def plain_passages(rows, width):
    """Words that stay, by row: first places by (id, word number), nulls first."""
    first = {}
    order = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            key, at = tuple(w[k:k + width]), (order(i), k)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < (order(i), k):
                gone[k:k + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("crowded", "shard"), [(5000, 400_000), (1, 400_000), (1, 50)])
def test_repeated_passages(steps, empty, monkeypatch, crowded, shard):
    monkeypatch.setattr(passages, "CROWDED", crowded)
    monkeypatch.setattr(passages, "SHARD", shard)
    got = passages.repeated_passages(steps).drop("row_hash").collect()
    assert sorted(map(tuple, got), key=str) == plain_passages(awkward(), 20)
    if crowded == 1:
        assert passages.repeated_passages(empty).collect() == []


def thue_morse(n, flip=0):
    """Words that sums of powers modulo 2^64 cannot tell from their complements."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_that_fool_running_sums_differ(spark):
    one, two = thue_morse(1024), thue_morse(1024, 1)
    around = prose(19, 77).split()
    rows = [(1, " ".join([one, *around])), (2, " ".join([two, *around])), (3, " ".join([one, *around])), (4, one), (5, two), (6, two.upper())]
    df = spark.createDataFrame(rows, "id long, detail string")
    assert {r.id: r.n_removed for r in passages.repeated_passages(df).collect()} == {1: 0, 2: 0, 3: 20, 4: 0, 5: 0, 6: 0}
    got = similar.similar_instructions(df, instruction="detail", words=3, share=(90, 100)).collect()
    assert {r.id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5}
    w = Words(["a" * 511, "a" * 512, "a" * 513, "b" * 513, "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "b" + "a" * 513])
    assert len(set(w.hash.tolist())) == 8


def test_backward_search_counts_patterns():
    r = np.random.default_rng(3)
    text = np.append(r.integers(1, 6, 400), 0)
    index = passages.FMIndex(text, 6, 8)
    for n in (1, 3, 8):
        for at in range(0, 390, 13):
            lo, hi = np.array([0]), np.array([len(text)])
            for c in text[at:at + n][::-1]:
                lo, hi = index.extend(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == sum((text[k:k + n] == text[at:at + n]).all() for k in range(len(text) - n + 1))


def test_secret_spans(spark, empty):
    fixed = "key: pass" + "word='abc.def' and " + "AKIA" + "Q" * 16 + " tail " + "0f" * 12 + " passwd=ab"
    r = random.Random(5)
    rows = [(k, "the pass" + "word=" + "".join(r.choice("0123456789abcdef") for _ in range(18)) + " here") for k in range(60)]
    rows += [(100, fixed), (101, None), (102, ""), (103, "see " + "".join(r.choice("0123456789abcdef") for _ in range(18)) + " alone"), (104, "mail8.example.com 4041894974608795 " + "w" * 30)]
    df = spark.createDataFrame(rows, "id long, detail string")
    got = {r.id: [(s.kind, s.start, s.end) for s in r.spans] for r in credentials.secret_spans(df).collect()}
    assert len(got) == len(rows)
    assert [(k, fixed[a:b]) for k, a, b in got[100]] == [
        ("assign", "password='abc.def"), ("access", "AKIA" + "Q" * 16), ("hex", "0f" * 12)]
    assert got[101] == got[102] == got[104] == []
    assert [k for k, *_ in got[103]] == ["learned"]
    hidden = {r.id: r.detail for r in credentials.hide_secrets(df).collect()}
    assert hidden[100] == "key: [secret]' and [secret] tail [secret] passwd=ab" and hidden[101] is None and hidden[104] == rows[-1][1]
    assert credentials.secret_spans(empty).collect() == []


def plain_base(text):
    """The fixed rules, written anew: (kind, start, end)."""
    name = r"[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"(" + name + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


def test_spans_equal_a_plain_search(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000, None), (1001, ""), (1002, "token=" + "ab1" * 9 + " AKIA" + "Z9" * 10 + " " + "0f" * 14), (1003, "api_KEY : 'x1y2z3' passwd=short")]
    df = spark.createDataFrame(rows, "id long, detail string")
    learned = credentials.fit_formats(df)
    got = {r.id: [(s.kind, s.start, s.end) for s in r.spans] for r in credentials.secret_spans(df, formats=learned).collect()}
    for i, text in rows:
        base = plain_base(text or "")
        more = []
        for m in credentials.CANDIDATE.finditer(text or ""):
            a, b = m.span()
            shaped = credentials.shape(m[0])
            mixed = "d" in shaped and set(shaped) & set("xlU")
            if mixed and not any(a < y and x < b for _, x, y in base) and any(f.score(shaped) >= f.least for f in learned):
                more.append(("learned", a, b))
        assert sorted(got[i]) == sorted(base + more)


def test_many_spans_are_walked_once():
    digests = " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(40_000))
    assert len(credentials.all_spans(digests, [])) == 40_000  # square work would not end


def test_automaton_prefers_its_language():
    a = credentials.infer(["xd" * k for k in range(3, 9) for _ in range(20)])
    assert len(a.moves) < 18 and a.score("xdxdxdxd") > -1 and a.score("xx") == -np.inf


def test_token_files(spark, steps, empty):
    path = scratch_dir(spark, "test-tokens")
    tokens.write_token_files(steps, path, BPE, prompt="detail", shard_ids=2000)
    got, model = tokens.read_token_files(spark, path).orderBy("start").collect(), fresh()
    plain = lambda t: model.encode(t or "", add_special_tokens=False).ids + [2]
    rows = sorted(awkward(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    at = 0
    for r, (i, t) in zip(got, rows, strict=True):
        assert (r.id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (i, at, plain(t))
        at += len(plain(t))
    again = scratch_dir(spark, "test-tokens")
    tokens.write_token_files(empty, again, BPE, prompt="detail")
    assert tokens.read_token_files(spark, again).collect() == []


def test_token_file_random_access():
    r = np.random.default_rng(1)
    docs = [r.integers(0, 9, n) for n in (0, 1, 700, 3, 2500)]
    ids, n = np.concatenate(docs), np.array([len(d) for d in docs])
    body = tokens.TokenFile.pack([4, None, 6, 7, 8], ids, n, 10, rounds=5, batch=4, least=2)
    file = tokens.TokenFile(body)
    assert len(file.rules) and len(file.symbols) < len(ids)
    assert [(i, d.tolist()) for i, d in file.documents()] == list(zip([4, None, 6, 7, 8], [d.tolist() for d in docs], strict=True))
    for a, b in ((0, 5), (333, 420), (699, 2000), (2000, None)):
        assert file.read(2, a, b).tolist() == docs[2][a:b].tolist() and file.read(4, a, b).tolist() == docs[4][a:b].tolist()


def fresh():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_encoder_equals_library(monkeypatch):
    enc, model = Encoder(BPE), fresh()
    texts = [t for _, t in awkward()] + ["a  b", " lead", "trail ", "a \n b", "it's  I'll", "x　 y", "<|endoftext|> z", "tab\t x", "new\nline two", "a <|endoftext|> z", "a <|endoftext|>"]
    for remembered, passage in ((2_000_000, 1_000_000), (50, 100), (0, 7)):
        monkeypatch.setattr(vocab, "REMEMBERED", remembered)
        monkeypatch.setattr(vocab, "PASSAGE", passage)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 50256 in np.frombuffer(enc.encode(["a <|endoftext|> z"])[0], "<u4")


def test_encoder_on_parts_in_any_order():
    """Parts kept beside whole stretches never answer for a stretch that looks like one."""
    enc, model, r = Encoder(BPE), fresh(), random.Random(9)
    some = [*"abzAZéßñœɏɐ漢²½ª059.,;:!?'-_/$\t\x00\x01\x1c\x85\xa0Ġ", *["\n"] * 4, *[" "] * 14, "the", "'s", ".\n", "\n\n", "  "]
    for _ in range(8):
        texts = ["".join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(60)] + ["x a.\nb \n\nc \nb \n. .\n", "a.\nb\n\nc"]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]


class Asked:
    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, texts, **how):
        self.seen += texts
        return self.inner.encode_batch_fast(texts, **how)


def test_known_parts_are_not_asked_again():
    enc, seen = Encoder(BPE), []
    for name in {"model", "merges"} & set(vars(enc)):
        setattr(enc, name, Asked(getattr(enc, name), seen))
    enc.encode(["x lamp red, für new.\nlamp red"])
    assert seen
    seen.clear()
    text = "x red. für, lamp.\nlamp, new,\nlamp."
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == fresh().encode(text, add_special_tokens=False).ids
    assert set(seen) <= {"x"}


def test_remembered_parts_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    enc, letters = Encoder(BPE), "bcdfghklmnprstvz"
    words = ["".join(letters[i >> s & 15] for s in (0, 4, 8, 12)) for i in range(60_000)]
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        for i in range(0, len(words), 10_000):
            enc.encode([" ".join(words[i:i + 10_000])])
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert held < 100 * len(words)


def test_line_ends_and_marks_part_as_the_library_does():
    enc, model, r = Encoder(BPE), fresh(), random.Random(5)
    some = ["a", "word", "don't", " ", "  ", "\n", "\n\n", "\t", "'", "'s ", "\n'", " '", ",", ".", "12", "é", "日本", "\u00a0", "\r", "\x1c", "\x85", "\x01", "À"]
    for _ in range(30):
        texts = ["".join(r.choice(some) for _ in range(r.randrange(14))) for _ in range(60)]
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_records_named_by_text(spark):
    """Evaluation results, phrases and artifacts of the project have text ids."""
    rows = [("case-2", "remove the red lamp"), ("case-1", "add a <|endoftext|> cat"), (None, None), ("case-3", "")]
    results = spark.createDataFrame(rows, "id string, prompt string").repartition(2)
    model = fresh()
    ids = {i: model.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    path = scratch_dir(spark, "test-tokens")
    tokens.write_token_files(results, path, BPE)
    got = tokens.read_token_files(spark, path, "string").orderBy("start").collect()
    assert [(r.id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == [(i, ids[i] + [2]) for i in (None, "case-1", "case-2", "case-3")]
    packed = packing.pack_prompts(results, BPE, room=8).collect()
    assert {i: sum((np.frombuffer(r.ids, "<u4").tolist() for r in sorted(packed, key=lambda r: r.piece) if r.id == i), []) for i in ids} == {i: x + [0] for i, x in ids.items()}
    assert {r.id for r in pieces.encode_phrases(results, SP, phrase="prompt").collect()} == set(ids)
    stored = "<html>" + prose(200, 3)
    artifacts = [("a", "0.png", stored), ("b", None, stored), (None, "x", stored), ("c", "y", "small"), ("c", "y", "small")]
    df = spark.createDataFrame(artifacts, "id string, location string, body string").withColumns({c: F.lit(1) for c in ("row", "size", "digest", "witness", "part", "kid")})
    where = scratch_dir(spark, "test-warc")
    read = archive.read_archives(spark, where, archive.write_archives(df, where)).collect()
    assert sorted([(r.id, r.record_type, r.refers_to) for r in read], key=str) == sorted(
        [("a", "revisit", "b"), ("b", "response", None), (None, "revisit", "b"), ("c", "response", None), ("c", "response", None)], key=str)


def test_pack_prompts(steps, empty):
    got = packing.pack_prompts(steps, BPE, room=128, prompt="detail", window=6).collect()
    enc = Encoder(BPE)
    want = Counter()
    for i, t in awkward():
        ids = enc.model.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = sorted({0, *range(len(ids) % 128, len(ids), 128), len(ids)})
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= -(-sum(r.length for r in got) // 128) + 1
    assert packing.pack_prompts(empty, BPE, prompt="detail").collect() == []


def test_fullest_bin_against_all_combinations():
    r = random.Random(2)
    for _ in range(60):
        items = [r.randint(1, 30) for _ in range(9)]
        room = r.randint(30, 60)
        picked = packing.fullest(Counter(items), sorted(set(items)), room)
        assert not Counter(picked) - Counter(items)
        lead = max(items)
        rest = list(items)
        rest.remove(lead)
        best = max(s for m in range(1 << 8) if (s := lead + sum(x for k, x in enumerate(rest) if m >> k & 1)) <= room)
        assert sum(picked) == best


def test_pieces(spark, steps, empty):
    got = pieces.encode_phrases(steps, SP, phrase="detail").collect()
    model = pieces.pieces(SP).library
    want = Counter((i, tuple(model.encode(t or "")), model.decode(model.encode(t or ""))) for i, t in awkward())
    assert Counter((r.id, tuple(r.ids), r.decoded) for r in got) == want
    assert pieces.encode_phrases(empty, SP, phrase="detail").collect() == []


def plain_groups(rows, k, num, den):
    sets = []
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    for _, t in rows:
        w = (t or "").encode().translate(low).split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    tops = defaultdict(list)
    for g, (i, _) in zip(group, rows, strict=True):
        tops[g].append(i)
    return Counter((i, len(s), min((x for x in tops[g] if x is not None), default=None)) for (i, _), s, g in zip(rows, sets, group, strict=True))


@pytest.mark.parametrize(("k", "share", "block"), [(3, (90, 100), 4000), (5, (80, 100), 2)])
def test_similar(steps, empty, monkeypatch, k, share, block):
    monkeypatch.setattr(similar, "PER_BLOCK", block)
    got = similar.similar_instructions(steps, words=k, share=share, instruction="detail").collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == plain_groups(awkward(), k, *share)
    groups = Counter(r.component_id for r in got if r.n_shingles)
    assert sum(r.kept for r in got if r.n_shingles) == len(groups) + 1  # two different texts share id 42
    if block == 2:
        assert similar.similar_instructions(empty, instruction="detail").collect() == []


def test_a_shingle_of_many_texts_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "PER_LIST", 20)
    shared = "extraordinarily longworded introductory passages everywhere"
    rows = [(k, shared + " " + prose(20 + k % 60, 7000 + k)) for k in range(150)]
    rows += [(1000 + k, shared + " " + prose(60, 8000 + k % 7) + (" tail%d" % k)) for k in range(70)]
    df = spark.createDataFrame(rows, "id long, detail string")
    sets = [(k, len(t.split()) - 4, 1) for k, t in rows]
    placed = similar._cut(spark.createDataFrame(sets, "s long, n int, tok long"), (80, 100))
    alone = [r.n for r in similar._alone(placed).groupBy("list").agg(F.count("s").alias("n")).collect()]
    assert sum(alone) == 220 and max(alone) <= 50
    met = defaultdict(list)
    for r in similar._paired(placed).collect():
        met[r.list].append(r)
    together = Counter((a.s, b.s) for m in met.values() for a in m for b in m if a.s < b.s and (a.side != b.side or a.side == similar.ITSELF))
    assert set(together.values()) == {1} and max(len(m) for m in met.values()) <= 100
    for a, n, _ in sets:
        for b, m, _ in sets:
            assert not (a < b and 100 * min(n, m) >= 80 * max(n, m)) or (a, b) in together
    got = similar.similar_instructions(df, instruction="detail").collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == plain_groups(rows, 5, 80, 100)


def test_groups_of_a_random_graph(spark):
    r = random.Random(4)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    got = {x.s: x.group for x in similar._groups(spark.createDataFrame(links, "x long, y long")).collect()}
    for a, b in links:
        if a != b:
            assert got[a] == got[b]
    assert len({got[k] for k in range(100, 131)}) == 1
    want = {v: v for e in links for v in e}
    for _ in range(60):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert len(set(got.values())) == len({want[v] for v in got})


def test_quality(spark, empty):
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s") for i, t in awkward()] + [(200 + k, prose(120, 300 + k), "en", "s") for k in range(70)]
    rows += [(300, " ".join("#$%" + w for w in prose(80, 9).split()), "en", "s")]
    got = quality.judge_quality(spark.createDataFrame(rows, "id long, detail string, lang string, source string")).collect()
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        places = defaultdict(list)
        for k in range(len(w) - 2):
            places[tuple(w[k:k + 3])].append(k)
        twice = {k + d for v in places.values() if len(v) > 1 for k in v for d in range(3)}
        want[(i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice),
              len(w) < 50 or 100 * len(twice) > 50 * len(w))] += 1
    assert Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    kept = {r.id: r.kept for r in got}
    assert not kept[300] and all(kept[200 + k] for k in range(70)) and not kept[3]
    assert quality.judge_quality(empty).collect() == []


def test_fences_follow_the_group(spark):
    lined = lambda k, again: "\n".join([prose(10, 5000 + 20 * k + j) for j in range(12 - again)] + [prose(10, 5000 + 20 * k)] * again)
    rows = [(k, lined(k, 0), "en", "plain") for k in range(60)] + [(100, lined(100, 2), "en", "plain")]
    rows += [(200 + k, lined(200 + k, 1 + k % 4), "en", "refrains") for k in range(60)] + [(300, lined(300, 2), "en", "refrains")]
    got = {r.id: r.kept for r in quality.judge_quality(spark.createDataFrame(rows, "id long, detail string, lang string, source string")).collect()}
    assert all(got[k] for k in range(60)) and not got[100]  # a line comes twice where none do
    assert all(got[200 + k] for k in range(60)) and got[300]  # the same where that is common


def test_severity(spark, empty):
    bad = ["vileword", "nastyish", "horrid"]
    r = random.Random(6)
    rows = []
    for k in range(400):
        words = prose(60, 1000 + k).split()
        if k % 5 == 0:
            for _ in range(r.randint(1, 4)):
                words[r.randrange(60)] = r.choice(bad)
        rows.append((k, " ".join(words), int(k % 5 == 0)))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (1, rows[1][1])], "id long, instruction string")
    grades = spark.createDataFrame([(i, g) for i, _, g in rows if i < 200] + [(5000, None)], "id long, grade int")
    model = severity.fit_severity(df, grades)
    assert model.cuts == sorted(model.cuts) and len(model.cuts) == 2
    got = severity.severity(df, model).collect()
    assert len(got) == 403
    by = {x.id: x for x in got}
    right = sum(by[i].harmful == bool(g) for i, _, g in rows if i >= 200)
    assert right >= 195 and not by[900].harmful and not by[901].harmful
    assert severity.fit_severity(df, grades.limit(0)) is None
    assert severity.severity(empty.withColumnRenamed("detail", "instruction"), None).collect() == []


def test_archives(spark):
    page = "<p>" + prose(200, 12)
    rows = [(1, "a", page), (2, "b", page), (3, "c", page), (3, "d", page), (4, None, "small"), (5, "x\r\ny", "small"), (6, "e", None), (None, "f", page)]
    df = spark.createDataFrame(rows, "id long, location string, body string").repartition(3)
    path = scratch_dir(spark, "test-warc")
    index = archive.write_archives(df, path)
    got = archive.read_archives(spark, path, index).collect()
    seen = Counter((r.id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    want = Counter()
    for i, _, body in rows:
        raw = (body or "").encode()
        kind = ("revisit", 3) if body == page and i != 3 else ("response", None)
        want[(i, *kind, len(raw), hashlib.sha1(raw).hexdigest())] += 1
    assert seen == want
    files = index.select("archive").distinct().count()
    assert files > 1 and index.select("archive").where("archive is null").count() == 0
    raw = [gzip.decompress(open(f, "rb").read()).decode() for f in Path(path.removeprefix("file:")).glob("*.warc.gz")]
    names = re.findall(r"WARC-Record-ID: (<urn:uuid:[0-9a-f-]+>)", "".join(raw))
    assert len(set(names)) == len(rows) and set(re.findall(r"WARC-Refers-To: (\S+)", "".join(raw))) <= set(names)
    assert len(re.findall(r"WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r", "".join(raw))) == len(rows)
    one = archive.read_archives(spark, path, index.where("id = 4")).collect()
    assert [(r.payload.decode(), r.location) for r in one] == [("small", "")]
    none = archive.write_archives(df.limit(0), scratch_dir(spark, "test-warc"))
    assert none.collect() == []
