"""The numbered queries: each maps the given tables to an operator's interface and its rows back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm import archive, balltree, boosting, credentials, manifest, packing, passages, pieces, quality, runs, severity, similar, tokens
from darkroom.plans.registry import Registry
from darkroom.plans.tables import table
from darkroom.session import scratch_dir

plans = Registry()


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as job steps: a step's detail is a document's text."""
    return table(spark, sf, "documents").withColumnsRenamed({"doc_id": "id", "text": "detail"})


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))


@plans.add("op1_exact_dedup", """
with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id = max(doc_id) over g as kept, sha256(text) as text_sha256
from t window g as (partition by text)""")
def _(spark, sf):
    out = runs.exact_copies(steps(spark, sf))
    return out.withColumnsRenamed({"id": "doc_id", "detail_sha256": "text_sha256"})


@plans.add("op2_substring_dedup", r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
words as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word, len(ws) as k from w),
spans as (select doc_id, i, word, case when i + 19 <= k then string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 19 following) end as s from words),
starts as (select *, s is not null and row_number() over (partition by s order by doc_id, i) > 1 as again from spans),
marked as (select doc_id, i, word, bool_or(again) over (partition by doc_id order by i rows between 19 preceding and current row) as gone from starts),
kept as (select doc_id, count(*) as n, count(*) filter (gone) as g, string_agg(word, ' ' order by i) filter (not gone) as t from marked group by doc_id)
select doc_id, coalesce(n, 0) as n_words, coalesce(g, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)""")
def _(spark, sf):
    out = passages.repeated_passages(steps(spark, sf))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


@plans.add("op3_secret_scans")
def _(spark, sf):
    found = credentials.secret_spans(steps(spark, sf))
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in credentials.KINDS[:3]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


@plans.add("op4_token_files")
def _(spark, sf):
    path = scratch_dir(spark, "tokens")
    tokens.write_token_files(prompts(spark, sf), path, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return tokens.read_token_files(spark, path).select(
        F.col("id").alias("doc_id"), "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32")
    )


@plans.add("op5_toxicity")
def _(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("instruction"))
    grades = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("grade"))
    model = severity.fit_severity(rows, grades)
    return severity.severity(rows, model).select(
        F.col("id").alias("doc_id"), "severity", F.col("likely").alias("toxic_chance"), F.col("harmful").alias("toxic")
    )


@plans.add("op6_quality_rules", r"""
with t as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
words as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word, len(ws) as k from t),
grams as (select doc_id, i, case when i + 2 <= k then word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o end as g
    from words window o as (partition by doc_id order by i)),
twice as (select doc_id, i, g is not null and count(*) over (partition by doc_id, g) > 1 as hit from grams),
covered as (select doc_id, bool_or(hit) over (partition by doc_id order by i rows between 2 preceding and current row) as c from twice),
repeats as (select doc_id, count(*) filter (c) as n from covered group by doc_id),
counts as (select doc_id, lang, source, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) as n_lines,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from t left join repeats using (doc_id)),
long as (select doc_id, lang, source, unnest(['word_size', 'symbols', 'dup_lines', 'repeats']) as ratio, unnest([
    case when n_words > 0 then 1000 * word_chars // n_words end, case when word_chars > 0 then 1000 * n_symbols // word_chars end,
    case when n_lines > 0 then 1000 * n_dup_lines // n_lines end, case when n_words > 0 then 1000 * n_repeat_words // n_words end]) as v, n_words from counts),
fine as (select lang, source, ratio, (v >> greatest(length(bin(v)) - 10, 0)) << greatest(length(bin(v)) - 10, 0) as bucket, count(*) as n
  from long where n_words > 0 and v is not null group by all),
levels as (select true as own, lang, source, ratio, bucket, n from fine
  union all select false, lang, null, ratio, bucket, sum(n) from fine group by lang, ratio, bucket),
ranked as (select *, sum(n) over (partition by own, lang, source, ratio order by bucket) as upto, sum(n) over (partition by own, lang, source, ratio) as total from levels),
eighths as (select own, lang, source, ratio, max(total) as total, min(bucket) filter (upto * 8 >= total) as e1, min(bucket) filter (upto * 8 >= total * 2) as e2,
  min(bucket) filter (upto * 8 >= total * 6) as e6, min(bucket) filter (upto * 8 >= total * 7) as e7 from ranked group by all),
fences as (select own, lang, source, ratio, case when e6 > e2 then e2 - (e6 - e2) * 4 else e1 - (e2 - e1) * 4 end as low,
  case when e6 > e2 then e6 + (e6 - e2) * 4 else e7 + (e7 - e6) * 4 end as high from eighths where total >= 50),
judged as (select doc_id, bool_or(coalesce(v > coalesce(a.high, b.high) or (l.ratio = 'word_size' and v < coalesce(a.low, b.low)), false)) as outside
  from long l left join fences a on a.own and a.ratio = l.ratio and a.lang is not distinct from l.lang and a.source is not distinct from l.source
  left join fences b on not b.own and b.ratio = l.ratio and b.lang is not distinct from l.lang group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not outside as kept from counts join judged using (doc_id)""")
def _(spark, sf):
    return quality.judge_quality(steps(spark, sf)).withColumnRenamed("id", "doc_id")


@plans.add("op7_sentencepiece")
def _(spark, sf):
    rows = prompts(spark, sf).withColumnRenamed("prompt", "phrase")
    out = pieces.encode_phrases(rows, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@plans.add("op8_best_fit_packing")
def _(spark, sf):
    out = packing.pack_prompts(prompts(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), room=2048, end=0)
    return out.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "sequence_id", "offset"
    )


@plans.add("op9_similar", r"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) as ws from documents),
shingles as (select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s from w),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
reach as (select doc_id as a, doc_id as b from w union select a, y from reach join links on x = b)
select doc_id, coalesce(n, 0) as n_shingles, component_id from w left join sizes using (doc_id)
  join (select a as doc_id, min(b) as component_id from reach group by a) using (doc_id)""")
def _(spark, sf):
    rows = prompts(spark, sf).withColumnRenamed("prompt", "instruction")
    return similar.similar_instructions(rows, words=3, share=(90, 100)).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id"
    )


@plans.add("op10_warc", """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
q as (select *, max(page_id) over (partition by html) as top from p)
select page_id, cast(n as bigint) as payload_bytes, sha1(html) as payload_digest,
  case when n >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> top then top end as refers_to
from q""")
def _(spark, sf):
    rows = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.col("url").alias("location"), F.col("html").alias("body")
    )
    path = scratch_dir(spark, "warc")
    index = archive.write_archives(rows, path)
    return archive.read_archives(spark, path, index).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@plans.add("op11_ranked_search", r"""
with words as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from words group by all),
sizes as (select doc_id, cast(sum(tf) as bigint) as n from tf group by all),
corpus as (select count(*) as docs, cast(sum(n) as bigint) as total from sizes),
df as (select term, count(*) as df from tf group by all),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
scores as (select item_id, doc_id, cast(sum(cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint)
    * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) as bigint) as score
  from asked join df using (term) join tf using (term) join sizes using (doc_id) cross join corpus group by all),
ranked as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50""")
def _(spark, sf):
    out = balltree.search_steps(steps(spark, sf), table(spark, sf, "benchmark"), phrase_id="item_id", phrase="text", best=50)
    return out.select(F.col("phrase_id").alias("item_id"), "rank", F.col("step_id").alias("doc_id"), "score")


def remainder(id: str):
    """The fifth of all rows that is held out of learning is the one with remainder 0."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 5


@plans.add("op12_quality_classifier")
def _(spark, sf):
    rows = prompts(spark, sf)
    labels = table(spark, sf, "labels").where(remainder("doc_id") != 0)
    model = boosting.fit_prompt_quality(rows, labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("good")))
    out = boosting.score_prompts(rows, model)
    return out.select(
        F.col("id").alias("doc_id"), F.coalesce(remainder("id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@plans.add("op13_merkle_manifest", """
with recursive plain as (
  select *, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''),
      lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, e: case when e >= 0 then xor(c, e) else xor(c >> 1, (c & 1) * 3988292384) end) as crc
  from documents),
now as (select *, case when xor(crc, 4294967295) % 3 = 0
    then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as seen from plain),
said as (select doc_id, lang,
    coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') as body, coalesce(octet_length(encode(seen)) || ':' || seen, '-') as seen from now),
leaves as (select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as pos,
    count(*) over (partition by lang) as n, sha256(head || body) as leaf, sha256(head || seen) as found from said),
tree as (select lang, 0 as lv, pos, n, leaf as digest from leaves
  union all
  select lang, lv + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)) from tree where n > 1
  group by lang, lv, pos // 8, n),
subroots as (select lang, digest, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from tree where n = 1),
top as (select 0 as lv, pos, n, digest from subroots
  union all
  select lv + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)) from top where n > 1 group by lv, pos // 8, n),
ways as (
  select l.doc_id, t.lv, string_agg(t.digest, '' order by t.pos) filter (t.pos < (l.pos >> 3 * t.lv)) as a,
    string_agg(t.digest, '' order by t.pos) filter (t.pos > (l.pos >> 3 * t.lv)) as b
  from leaves l join tree t on t.lang is not distinct from l.lang and t.n > 1 and t.pos // 8 = (l.pos >> 3 * t.lv) // 8
  group by l.doc_id, t.lv
  union all
  select l.doc_id, 100 + t.lv, string_agg(t.digest, '' order by t.pos) filter (t.pos < (s.pos >> 3 * t.lv)),
    string_agg(t.digest, '' order by t.pos) filter (t.pos > (s.pos >> 3 * t.lv))
  from leaves l join subroots s on s.lang is not distinct from l.lang join top t on t.n > 1 and t.pos // 8 = (s.pos >> 3 * t.lv) // 8
  group by l.doc_id, t.lv),
path as (select doc_id, coalesce(a, '') as a, coalesce(b, '') as b, row_number() over (partition by doc_id order by lv) as step from ways),
folded as (select doc_id, 0::bigint as step, found as digest from leaves
  union all
  select f.doc_id, p.step, sha256(p.a || f.digest || p.b) from folded f join path p on p.doc_id = f.doc_id and p.step = f.step + 1),
ends as (select doc_id, arg_max(digest, step) as folded_root from folded group by doc_id),
proofs as (select doc_id, sha256(string_agg(a || b, '' order by step)) as proof_sha256 from path group by doc_id)
select l.doc_id, leaf, s.digest as subroot, r.digest as root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root,
  folded_root = r.digest as verified
from leaves l join subroots s on s.lang is not distinct from l.lang cross join (select digest from top where n = 1) r
join ends using (doc_id) left join proofs using (doc_id)""")
def _(spark, sf):
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    seen = F.when(changed, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    fields = ["doc_id", "source", "lang", "n_chars"]
    out = manifest.step_manifest(
        table(spark, sf, "documents"), id="doc_id", group="lang", fields=[*fields, "text"], found=[*map(F.col, fields), seen]
    )
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES, ORACLES = plans.queries, plans.oracles
