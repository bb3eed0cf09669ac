"""Validation and projection queries over parts, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkroom.functions import payloads, specs
from darkroom.plans.registry import Registry
from darkroom.plans.tables import table

plans = Registry()

OP = """case p_type when 'ECONOMY' then 'add' when 'SMALL' then 'replace' when 'LARGE' then 'background'
    when 'MEDIUM' then 'remove' when 'STANDARD' then 'upscale' else 'restyle' end"""


def spec_rows(spark, sf):
    part = table(spark, sf, "part")
    op = F.lit(None).cast("string")
    names = {"ECONOMY": "add", "SMALL": "replace", "LARGE": "background", "MEDIUM": "remove",
             "STANDARD": "upscale"}
    for kind, name in names.items():
        op = F.when(F.col("p_type") == kind, name).otherwise(op)
    return part.select(
        F.col("p_partkey").alias("id"),
        F.coalesce(op, F.lit("restyle")).alias("op"),
        F.when(F.col("p_size") < 10, "brush").when(F.col("p_size") < 20, "text")
        .when(F.col("p_size") < 30, "point").when(F.col("p_size") < 48, "auto").otherwise("sky")
        .alias("mask_source"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("target"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).when(F.col("p_size") % 5 == 0, "").alias("content"),
        F.when(F.col("p_size") > 40, "#A0b1C2").alias("colour"),
        (F.col("p_size") % 4 == 0).alias("has_mask"),
        F.col("p_size"), F.col("p_retailprice"), F.col("p_brand"),
    )


SPECS = f"""sp as (select p_partkey as id, {OP} as op, case when p_size < 10 then 'brush' when p_size < 20 then 'text'
    when p_size < 30 then 'point' when p_size < 48 then 'auto' else 'sky' end as mask_source,
    case when p_size % 3 <> 0 then p_name end as target,
    case when p_size % 2 = 0 then p_brand when p_size % 5 = 0 then '' end as content,
    case when p_size > 40 then '#A0b1C2' end as colour, p_size % 4 = 0 as has_mask, p_size, p_retailprice, p_brand
    from part)"""

RULES = """case when op in ('add', 'replace') and coalesce(content, '') = '' then 'needs content' end,
    case when op = 'background' and coalesce(content, '') = '' and coalesce(colour, '') = '' then 'needs a backdrop' end,
    case when op = 'remove' and coalesce(target, '') = '' and not has_mask then 'needs target or mask' end,
    case when mask_source = 'text' and coalesce(target, '') = '' then 'text needs target' end,
    case when mask_source in ('brush', 'point') and not has_mask then 'drawn source needs mask' end,
    case when mask_source not in ('text', 'brush', 'point', 'auto', 'whole') then 'unknown mask source' end"""


def _listed(df):
    return df.withColumn("violations", F.array_join("violations", "; "))


@plans.add("pv1_validate_specs", f"with {SPECS}, v as (select id, op, concat_ws('; ', {RULES}) as violations from sp) select *, violations = '' as valid from v")
def _(spark, sf):
    return _listed(specs.validate_specs(spec_rows(spark, sf))).select("id", "op", "violations", "valid")


@plans.add("pv1_validate_intents", f"""with {SPECS}, v as (select id, op, concat_ws('; ', {RULES},
    case when op in ('remove', 'replace') and coalesce(target, '') = '' then 'needs target' end) as violations from sp)
  select *, violations = '' as valid from v""")
def _(spark, sf):
    checked = specs.validate_specs(spec_rows(spark, sf), intents=True)
    return _listed(checked).select("id", "op", "violations", "valid")


@plans.add("pv1_quarantine", f"""with {SPECS}, v as (select id, concat_ws('; ', {RULES}) as violations from sp)
  select id, violations from v where violations <> ''""")
def _(spark, sf):
    _, rejected = specs.quarantine(specs.validate_specs(spec_rows(spark, sf)))
    return _listed(rejected).select("id", "violations")


@plans.add("pv2_validate_refs", """with r as (select o_orderkey as id,
    case when o_orderstatus = 'P' then upper(sha256(cast(o_orderkey as varchar))) else sha256(cast(o_orderkey as varchar)) end as sha256,
    o_custkey as width, (o_totalprice / 4)::bigint as height, o_custkey / 2000 as x0, o_totalprice / 500000 as x1,
    0.1 as y0, 0.9 as y1, o_totalprice / 400000 as score,
    case when o_orderpriority = '1-URGENT' then '#12345' when o_orderpriority = '2-HIGH' then '#a1B2c3' end as colour from orders)
  select id, concat_ws('; ', case when not regexp_matches(sha256, '^[0-9a-f]{64}$') then 'digest' end,
    case when width not between 1 and 100000 then 'width' end, case when height not between 1 and 100000 then 'height' end,
    case when not (x0 >= 0 and x0 < x1 and x1 <= 1) then 'box' end, case when score not between 0 and 1 then 'score' end,
    case when not regexp_matches(colour, '^#[0-9a-fA-F]{6}$') then 'colour' end) as violations from r""")
def _(spark, sf):
    digest = F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)
    refs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "P", F.upper(digest)).otherwise(digest).alias("sha256"),
        F.col("o_custkey").alias("width"),
        F.bround(F.col("o_totalprice") / 4, 0).cast("bigint").alias("height"),
        (F.col("o_custkey") / 2000).alias("x0"), (F.col("o_totalprice") / 500000).alias("x1"),
        F.lit(0.1).alias("y0"), F.lit(0.9).alias("y1"), (F.col("o_totalprice") / 400000).alias("score"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "#12345")
        .when(F.col("o_orderpriority") == "2-HIGH", "#a1B2c3").alias("colour"),
    )
    return _listed(specs.validate_refs(refs)).select("id", "violations")


@plans.add("pv4_admit_uploads", """with u as (select o_orderkey as id, ((o_totalprice - 5000) * 60)::bigint as byte_size,
    case o_orderpriority when '1-URGENT' then 'GIF' when '2-HIGH' then 'PNG' when '3-MEDIUM' then 'JPEG'
      when '5-LOW' then 'AVIF' end as format, (o_custkey - 20) * 10 as width, o_custkey * 4 as height from orders),
  r as (select id, case when byte_size > 26214400 then 'too large' when byte_size <= 0 then 'empty'
    when coalesce(format, '') not in ('JPEG', 'PNG', 'WEBP', 'AVIF') then 'format not supported'
    when width <= 0 or height <= 0 then 'bad size' when width::double * height / 1e6 > 40 then 'too many megapixels' end as reason from u)
  select id, reason, reason is null as admitted from r""")
def _(spark, sf):
    priority = F.col("o_orderpriority")
    uploads = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.bround((F.col("o_totalprice") - 5000) * 60, 0).cast("bigint").alias("byte_size"),
        F.when(priority == "1-URGENT", "GIF").when(priority == "2-HIGH", "PNG")
        .when(priority == "3-MEDIUM", "JPEG").when(priority == "5-LOW", "AVIF").alias("format"),
        ((F.col("o_custkey") - 20) * 10).alias("width"), (F.col("o_custkey") * 4).alias("height"),
    )
    return specs.admit_uploads(uploads).select("id", "reason", "admitted")


@plans.add("pf1_filter_cases", f"""with {SPECS} select id, op from sp where not (p_size % 7 = 0)
  and op in ('remove', 'add') and p_size > 15""")
def _(spark, sf):
    cases = spec_rows(spark, sf).withColumns(
        {
            "deferred": F.when(F.col("p_size") % 7 == 0, True),
            "box": F.when(F.col("p_size") > 15, F.array(F.lit(0.1), F.lit(0.2), F.lit(0.8), F.lit(0.9))),
        }
    )
    return specs.filter_cases(cases, ["remove", "add"], need_box=True).select("id", "op")


@plans.add("pf2_render_prompt", f"""with {SPECS} select id, case op when 'remove' then 'remove ' || coalesce(target, 'None')
    when 'add' then 'add ' || coalesce(content, 'None')
    when 'replace' then 'replace ' || coalesce(target, 'None') || ' with ' || coalesce(content, 'None')
    when 'background' then 'change the background to ' || coalesce(content, 'None')
    when 'upscale' then 'upscale the image' else trim(op || ' ' || coalesce(target, content, '')) end as prompt from sp""")
def _(spark, sf):
    prompt = specs.render_prompt(F.col("op"), F.col("target"), F.col("content"))
    return spec_rows(spark, sf).select("id", prompt.alias("prompt"))


@plans.add("pf5_derive_asset_cols", f"""with {SPECS} select id, 'asset://' || p_brand || '/' || sha256(cast(id as varchar)) as uri,
    p_size * 100::double * (p_size * 50) / 1e6 as megapixels, op in ('add', 'replace', 'restyle', 'background') as is_generative,
    case when colour is null then 0 else ('0x' || substr(colour, 2, 2))::int end as red,
    case when colour is null then 177 else ('0x' || substr(colour, 4, 2))::int end as green,
    case when colour is null then 64 else ('0x' || substr(colour, 6, 2))::int end as blue from sp""")
def _(spark, sf):
    rows = spec_rows(spark, sf).select(
        "id", "op", "colour", F.col("p_brand").alias("bucket"),
        F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("sha256"),
        (F.col("p_size") * 100).alias("width"), (F.col("p_size") * 50).alias("height"),
    )
    return specs.derive_asset_cols(rows).select(
        "id", "uri", "megapixels", "is_generative", "red", "green", "blue"
    )


@plans.add("pf6_client_identity", """select event_id, case when event_type = 'click' then '10.0.0.' || user_id
    when event_type = 'view' then 'host' || user_id when event_type = 'purchase' then 'host' || user_id
    when event_type = 'signup' then 'unknown' else 'user' || user_id end as identity from events""")
def _(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    forwarded = (
        F.when(kind == "click", F.concat(F.lit("  10.0.0."), user, F.lit(" , 10.9.9.9")))
        .when(kind == "view", F.lit("")).when(kind == "purchase", F.lit("  ,10.9.9.9"))
        .when(kind == "error", F.concat(F.lit("user"), user))
    )
    host = F.when(kind.isin("view", "purchase"), F.concat(F.lit("host"), user)).when(kind == "signup", F.lit(""))
    return table(spark, sf, "events").select(
        "event_id", specs.client_identity(host, forwarded).alias("identity")
    )


@plans.add("pv6_redact", """select event_id, '{"Api_Key":"[redacted]","k":"[redacted]","kind":"' || event_type || '","user":{"at":['
    || event_id || ',{"ok":true,"password":"[redacted]"}],"cookie_jar":"[redacted]","id":' || user_id || ',"session_token":"[redacted]"}}'
    as fields from events""")
def _(spark, sf):
    """Each event as a nested log record with credentials at every level."""
    parts = [
        F.lit('{"k":'), F.lit('"[redacted]","Api_Key": "abc-'), F.col("event_id").cast("string"),
        F.lit('", "kind":"'), F.col("event_type"), F.lit('", "user": {"id": '), F.col("user_id").cast("string"),
        F.lit(', "session_token": {"v": 1}, "cookie_jar": ["a", 2], "at": ['),
        F.col("event_id").cast("string"), F.lit(', {"password": "p", "ok": true}]}}'),
    ]
    records = table(spark, sf, "events").select("event_id", F.concat(*parts).alias("fields"))
    return payloads.redact_records(records, "fields")


@plans.add("pv6_redact_props", """select event_id, '{"k":' || json_extract_string(props, '$.k') || '}' as fields from events""")
def _(spark, sf):
    return payloads.redact_records(table(spark, sf, "events").select("event_id", F.col("props").alias("fields")), "fields")


@plans.add("pv7_merge_context", """select doc_id, source as job_id, lang as service, 'record' as level,
    substr(text, 1, 500) as error_detail, 5 as fields from documents""")
def _(spark, sf):
    entry = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    outer = entry(job_id=F.col("source"), level=F.lit("outer"), request=F.lit("r"))
    inner = entry(job_id=F.lit("inner"), service=F.col("lang"), level=F.lit("inner"))
    extras = entry(level=F.lit("record"), error_detail=F.col("text"))
    merged = table(spark, sf, "documents").select(
        "doc_id", payloads.merge_context(outer, inner, extras).alias("m")
    )
    return merged.select(
        "doc_id", *[F.col("m")[k].alias(k) for k in ("job_id", "service", "level", "error_detail")],
        F.size("m").alias("fields"),
    )


@plans.add("sc16_event_round_trip", """select event_id, cast(user_id as varchar) as job_id, event_type as state,
    case when event_type = 'view' then 0.0 else value end as progress,
    case when event_type = 'click' then '' else props end as detail, event_type = 'purchase' as terminal from events""")
def _(spark, sf):
    kind = F.col("event_type")
    payload = payloads.event_to_json(
        F.col("user_id"), kind, F.when(kind != "view", F.col("value")),
        F.when(kind != "click", F.col("props")), F.when(kind == "purchase", F.lit(True)),
    )
    sent = table(spark, sf, "events").select("event_id", payload.alias("payload"))
    return sent.select("event_id", payloads.event_from_json(F.col("payload")).alias("e")).select(
        "event_id", "e.*"
    )


@plans.add("sc15_flatten_sentences", """with t as (select conv_id, turn, unnest(case role when 'user' then [trim(text, ' ' || chr(9) || chr(10) || chr(13))]
    when 'assistant' then [trim(text, ' ' || chr(9) || chr(10) || chr(13)), 'said', 'sent ' || turn]
    else ['cap'] end) as phrase from conversations) select conv_id, turn, phrase from t where phrase <> ''""")
def _(spark, sf):
    """Turns as records of the three shapes: a string, a list of both kinds, a caption list."""
    words = F.to_json(F.col("text").cast("variant"))
    user = F.concat(F.lit('{"sentences": '), words, F.lit("}"))
    helper = F.concat(
        F.lit('{"sentences": ['), words, F.lit(', {"raw": " said ", "sent": "x"}], "raw_sentences": [{"raw": "", "sent": "sent '),
        F.col("turn").cast("string"), F.lit('"}, "  "]}'),
    )
    record = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", helper).otherwise(
        F.lit('{"captions": ["cap", "", null]}')
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.explode(payloads.flatten_sentences(record)).alias("phrase")
    )
