"""Instruction and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkroom.functions import fixed, routing, text
from darkroom.operators import documents as ops
from darkroom.plans.registry import Registry
from darkroom.plans.tables import table

plans = Registry()

# One phrasing per part size, around the part's own name and brand.
PHRASES = (
    "Please remove the {n} from the photo.",
    "can you replace a {n} with my {b}, please",
    "put a {b} where the {n} used to be",
    "change the background to Teal please!",
    "Set background to #A1b2C3",
    "make the background a {n} at dusk",
    "add an {n} in the picture",
    "erase whatever that {n} is",
    "  give   them a   {n} ",
    "upscale the {n}",
    "make it sharper",
    "swap out this {n} for an {b}",
    "I'd like you to get rid of my {n}, thanks",
    "what is a {n}?",
    "insert something {n}",
    "take out {n} out of the image, for me",
)


def instructions(spark, sf):
    """A phrasing for every part, and every conversation turn as it stands."""
    n, b = F.col("p_name"), F.col("p_brand")
    which = F.col("p_size") % len(PHRASES)
    said = F.lit("")
    for i, phrase in enumerate(PHRASES):
        said = F.when(which == i, F.replace(F.replace(F.lit(phrase), F.lit("{n}"), n), F.lit("{b}"), b)).otherwise(said)
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), said.alias("instruction")
    )
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), F.col("text").alias("instruction")
    )
    return parts.unionByName(turns)


def _sql(s):
    return s.replace("'", "''")


_CASES = " ".join(
    f"when {i} then replace(replace('{_sql(p)}', '{{n}}', p_name), '{{b}}', p_brand)" for i, p in enumerate(PHRASES)
)
SAID = f"""said as (select 'p' || p_partkey as id, case p_size % {len(PHRASES)} {_CASES} end as instruction from part
  union all select 'c-' || conv_id || '-' || turn, text from conversations)"""


def _clean(c):
    bare = rf"trim(regexp_replace(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '^[.!?]+|[.!?]+$', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))"
    start = f"regexp_replace({bare}, '(?i){_sql(fixed.POLITE_START)}', '')"
    end = f"regexp_replace({start}, '(?i){_sql(fixed.POLITE_END)}', '')"
    return rf"trim(regexp_replace({end}, '\s+', ' ', 'g'))"


CLEANED = f"{SAID}, cleaned as (select *, {_clean('instruction')} as t from said)"


@plans.add("sc2_clean_instruction", f"with {CLEANED} select id, t as cleaned from cleaned")
def _(spark, sf):
    return instructions(spark, sf).select("id", text.clean_instruction(F.col("instruction")).alias("cleaned"))


def _x(c, pattern, group):
    return f"regexp_extract({c}, '(?i){_sql(pattern)}', {group})"


def _m(c, pattern):
    return f"regexp_matches({c}, '(?i){_sql(pattern)}')"


def _subject(c):
    return f"regexp_replace(trim({c}), '(?i){_sql(fixed.FROM_PICTURE)}', '')"


_COLOUR = "case " + " ".join(f"when d = '{k}' then '{v}'" for k, v in fixed.COLOURS.items()) + \
    f" when regexp_matches(d, '{fixed.COLOUR_PATTERN}') then d end"
_BG = _x("t", fixed.BACKGROUND_TO, 1)
_RM, _AD = _x("t", fixed.REMOVE_IT, 1), _x("t", fixed.ADD_IT, 1)

ROUTED = f"""{CLEANED}, b0 as (select *, regexp_replace(regexp_replace(lower({_clean(_BG)}), '^a ', ''), '^the ', '') as d from cleaned),
  b1 as (select *, {_COLOUR} as col from b0),
  routed as (select id, instruction, case
    when {_m('t', fixed.PUT_WHERE)} then ['replace', {_subject(_x('t', fixed.PUT_WHERE, 2))}, trim({_x('t', fixed.PUT_WHERE, 1)}), null]
    when {_m('t', fixed.REPLACE_WITH)} then ['replace', {_subject(_x('t', fixed.REPLACE_WITH, 1))}, trim({_x('t', fixed.REPLACE_WITH, 2)}), null]
    when {_m('t', fixed.BACKGROUND_TO)} then ['background', null, case when col is null then d end, col]
    when {_m('t', fixed.REMOVE_IT)} and not {_m(_RM, fixed.VAGUE)} then ['remove', {_subject(_RM)}, null, null]
    when {_m('t', fixed.ADD_IT)} and not {_m(_AD, fixed.VAGUE)} then ['add', null, {_subject(_AD)}, null]
    when {_m('t', fixed.UPSCALE)} or {_m('t', fixed.MAKE_BIGGER)} then ['upscale', null, null, null] end as r from b1)"""


def _routed(available):
    known = "r[1] in (" + ", ".join(f"'{a}'" for a in available) + ")"
    before, after = fixed.UNSUPPORTED.split("{op}")
    return f"""with {ROUTED} select id, case when {known} then r[1] end as op, case when {known} then r[2] end as target,
      case when {known} then r[3] end as content, case when {known} then r[4] end as colour,
      case when {known} then 'rule' else 'ask' end as route,
      case when r is null then '{_sql(fixed.UNCLEAR)}' when not {known} then '{before}' || r[1] || '{_sql(after)}' end as question,
      case when r is null then 'no rule matched and no model was available'
        when not {known} then r[1] || ' has no implementation here' else 'matched a rule' end as reason from routed"""


@plans.add("sc1_route_instructions", _routed(fixed.IMPLEMENTED_OPS))
def _(spark, sf):
    return routing.route_instructions(instructions(spark, sf)).drop("instruction")


@plans.add("sc1_route_without_add", _routed(("remove", "replace", "background", "upscale")))
def _(spark, sf):
    some = ("remove", "replace", "background", "upscale")
    return routing.route_instructions(instructions(spark, sf), available=some).drop("instruction")


@plans.add("sc3_named_colour", """select doc_id, w.i - 1 as place, case w.w """ + " ".join(
    f"when '{k}' then '{v}'" for k, v in fixed.COLOURS.items()) + """ end as colour
  from (select doc_id, unnest(list_transform(string_split(text, ' '), lambda x, i: {'w': lower(trim(x, ' ' || chr(10))), 'i': i})) as w from documents)
  where w.w in (""" + ", ".join(f"'{k}'" for k in fixed.COLOURS) + """)
  union all select p_partkey, -w.i, case w.w """ + " ".join(f"when '{k}' then '{v}'" for k, v in fixed.COLOURS.items()) + """ end
  from (select p_partkey, unnest(list_transform(string_split(p_name, ' '), lambda x, i: {'w': lower(x), 'i': i})) as w from part)""")
def _(spark, sf):
    words = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", " ")).alias("place", "word")
    )
    found = words.select("doc_id", F.col("place").cast("bigint").alias("place"),
                         text.named_colour(F.col("word")).alias("colour")).where("colour IS NOT NULL")
    names = table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), F.posexplode(F.split("p_name", " ")).alias("place", "word")
    )
    parts = names.select(
        "doc_id", (-1 - F.col("place")).cast("bigint").alias("place"), text.named_colour(F.col("word")).alias("colour")
    )
    return found.unionByName(parts)


_NORM = "trim(regexp_replace(regexp_replace(trim(lower(instruction), ' ' || chr(9) || chr(10) || chr(13)), '^[.!?]+|[.!?]+$', '', 'g'), '\\s+', ' ', 'g'))"
for _article in fixed.SUBJECT_ARTICLES:
    _NORM = f"regexp_replace({_NORM}, '^{_article}', '')"


@plans.add("sc4_normalise_subject", f"with {SAID} select id, {_NORM} as subject from said")
def _(spark, sf):
    return instructions(spark, sf).select(
        "id", text.normalise_subject(F.col("instruction")).alias("subject")
    )


@plans.add("sc5_normalise_phrase", f"""with {SAID}, p as (select id, trim(regexp_replace(lower(trim(instruction, ' ' || chr(9) || chr(10) || chr(13))),
    '\\.+$', ''), ' ' || chr(9) || chr(10) || chr(13)) as s from said) select id, case when s = '' then '' else s || '.' end as phrase from p""")
def _(spark, sf):
    return instructions(spark, sf).select("id", text.normalise_phrase(F.col("instruction")).alias("phrase"))


@plans.add("sc6_word_count", """select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::int as words from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@plans.add("sc7_judge_plan", f"""with {ROUTED}, k as (select p_partkey as pk, case p_type when 'ECONOMY' then null when 'SMALL' then 'replace'
    else 'remove' end as wop, case when p_size % 2 = 0 then 'the ' || upper(p_name) end as wt,
    case when p_size % 8 = 3 then '#008080' end as wc, case when p_size % 3 = 0 then p_brand end as wn from part),
  j as (select id, wop, wt, wc, wn, r[1] as g, r[2] as gt, r[3] as gn, r[4] as gc,
    regexp_replace(regexp_replace(lower(wt), '^the ', ''), '^a ', '') as nw,
    regexp_replace(lower(coalesce(r[2], '')), '^(?:the |a |an |my |this |that )', '') as ng
    from routed join k on id = 'p' || pk),
  w as (select id, case when wop is null and g is not null then 'planned ' || g || ' for something that is not an edit'
    when wop is null then '' when g is null then 'asked a question about a plain instruction'
    when g <> wop then g || ', expected ' || wop
    when wt is not null and ng <> nw then 'target ' || coalesce('''' || gt || '''', 'None') || ', expected ''' || wt || ''''
    when wc is not null and gc is distinct from wc then 'colour ' || coalesce(gc, 'None') || ', expected ' || wc
    when wn is not null and coalesce(gn, '') = '' then 'no content for an operation that needs one' else '' end as why from j)
  select id, why = '' as correct, why from w""")
def _(spark, sf):
    size = F.col("p_size")
    labels = table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("id"),
        F.when(F.col("p_type") == "SMALL", "replace").when(F.col("p_type") != "ECONOMY", "remove").alias("w_op"),
        F.when(size % 2 == 0, F.concat(F.lit("the "), F.upper("p_name"))).alias("w_target"),
        F.when(size % 8 == 3, F.lit("#008080")).alias("w_colour"),
        F.when(size % 3 == 0, F.col("p_brand")).alias("w_content"),
    )
    made = routing.route_instructions(instructions(spark, sf)).join(labels, "id")
    fields = ("op", "target", "colour", "content")
    correct, why = routing.judge_plan(
        {f: F.col(f"w_{f}") for f in fields}, {f: F.col(f) for f in fields}
    )
    return made.select("id", correct.alias("correct"), why.alias("why"))


def linked(spark, sf):
    """Pages as link-marked text: every anchor becomes a bracketed link."""
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("path"), "url",
        F.regexp_replace("html", r'<a href="([^"]*)">([^<\]]*)</a>', r"[$2]($1)").alias("text"),
    )


PATH_OF = r"'^https?://[^/]+(/[^?#]*).*$'"
LINKED = r"""docs as (select page_id as path, url, regexp_replace(html, '<a href="([^"]*)">([^<\]]*)</a>', '[\2](\1)', 'g') as text from pages)"""


@plans.add("jn9_broken_links", rf"""with {LINKED}, here as (select rtrim(regexp_extract(url, {PATH_OF}, 1), '/') as here_path,
    text || ' [twin](..' || rtrim(regexp_extract(url, {PATH_OF}, 1), '/') || ') [next](./' || path || '/) [up](..)' as text from docs),
  l as (select here_path as path, unnest(regexp_extract_all(text, '{fixed.LINK}', 1)) as target from here),
  f as (select *, regexp_replace(path, '/[^/]*$', '') as folder from l),
  g as (select *, rtrim(case when target = '..' then '/' when starts_with(target, '../') then regexp_replace(folder, '/[^/]*$', '') || target[3:]
    when starts_with(target, './') then folder || target[2:] when starts_with(target, '/') then target
    else folder || '/' || target end, '/') as followed from f)
  select target, path, count(*) as mentions from g where not regexp_matches(target, '^(?:http://|https://|mailto:)')
    and followed <> '' and followed not in (select here_path from here) group by target, path""")
def _(spark, sf):
    """Pages with three relative links more each: one to itself, one by number, one to the root."""
    at = F.rtrim(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*).*$", 1), F.lit("/"))
    docs = linked(spark, sf).select(
        at.alias("path"),
        F.concat("text", F.lit(" [twin](.."), at, F.lit(") [next](./"), "path", F.lit("/) [up](..)")).alias("text"),
    )
    return ops.broken_links(docs, docs.select(F.col("path").alias("target")))


@plans.add("jn10_reconcile", """with i as (select o_orderkey as id, o_orderstatus as s, o_orderpriority as p from orders),
  d as (select l_orderkey as id, count(*) as n, arg_min(l_linestatus, (l_linenumber, l_partkey, l_suppkey)) as s,
    arg_min(case when l_quantity > 25 then '1-URGENT' else '5-LOW' end, (l_linenumber, l_partkey, l_suppkey)) as p
    from lineitem group by l_orderkey),
  j as (select coalesce(i.id, d.id) as id, i.s as a, d.s as b, i.p as c, d.p as e, n, i.id is not null as li, d.id is not null as di
    from i full join d on d.id = i.id)
  select id, 'no section' as finding, '' as shown from j where li and not di
  union all select id, 'not in the index', '' from j where di and not li
  union all select id, 'repeated', cast(n as varchar) from j where n > 1
  union all select id, 'status differs', a || ' / ' || b from j where li and di and a <> b
  union all select id, 'priority differs', c || ' / ' || e from j where li and di and c <> e""")
def _(spark, sf):
    index = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    detail = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("status"),
        F.when(F.col("l_quantity") > 25, "1-URGENT").otherwise("5-LOW").alias("priority"),
        "l_linenumber", "l_partkey", "l_suppkey",
    )
    return ops.reconcile(index, detail, ["l_linenumber", "l_partkey", "l_suppkey"])


PAGE = r"'^https?://([^/?#]+)[^?#]*.*$'"


@plans.add("dc1_missing_paths", rf"""with d as (select regexp_extract(url, {PAGE}, 1) || '/' || page_id || '.md' as path, page_id, url,
    'see `' || regexp_extract(url, {PAGE}, 1) || '/' || (page_id + 1) || '.md`, `' || './' || (page_id // 2) || '.md` and `/top/' || page_id || '.md`' as text from pages),
  m as (select path, unnest(['' || regexp_extract(url, {PAGE}, 1) || '/' || (page_id + 1) || '.md', './' || (page_id // 2) || '.md']) as target,
    regexp_replace(path, '[^/]*$', '') as folder from d),
  there as (select path from d where page_id % 3 <> 0)
  select target, path, count(*) as mentions from m where regexp_replace(target, '^\./', '') not in (select path from there)
    and folder || regexp_replace(target, '^\./', '') not in (select path from there) group by target, path""")
def _(spark, sf):
    """Pages as documents that name two others each; a third of the files is not there."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)[^?#]*.*$", 1)
    at = lambda number: F.concat(number.cast("string"), F.lit(".md"))
    docs = table(spark, sf, "pages").select(
        F.concat(host, F.lit("/"), at(F.col("page_id"))).alias("path"), "page_id",
        F.concat(F.lit("see `"), host, F.lit("/"), at(F.col("page_id") + 1), F.lit("`, `./"), at(F.floor(F.col("page_id") / 2)),
                 F.lit("` and `/top/"), at(F.col("page_id")), F.lit("`")).alias("text"),
    )
    return ops.missing_paths(docs, docs.where("page_id % 3 <> 0").select(F.col("path").alias("target")))


@plans.add("dc2_unknown_commands", """select source as command, doc_id as path, count(*) as mentions from documents
  where source not like 'src1%' group by source, doc_id""")
def _(spark, sf):
    """Documents that tell to run a target named like their source."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("path"), "source", F.concat("text", F.lit(" `make "), "source", F.lit("`")).alias("text")
    )
    return ops.unknown_commands(docs, docs.where(F.col("source").like("src1%")).select(F.col("source").alias("command")))


@plans.add("dc3_undocumented_keys", """with docs as (select 'made in ' || replace(n_name, '_', '-') || ' (' || s_name || ')' as text
    from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 9000)
  select n_name as key from nation where not exists (select 1 from docs
    where contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g')))""")
def _(spark, sf):
    """Nations that no note on a rich supplier names."""
    nations = table(spark, sf, "nation")
    notes = table(spark, sf, "supplier").where("s_acctbal > 9000").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    docs = notes.select(F.concat(F.lit("made in "), F.translate("n_name", "_", "-"), F.lit(" ("), "s_name", F.lit(")")).alias("text"))
    return ops.undocumented_keys(nations.select(F.col("n_name").alias("key")), docs)


@plans.add("dc4_open_without_trigger", """select o_custkey as path, o_orderkey || ' - order' as item from orders
  where o_orderstatus = 'O' and not o_orderpriority like '1%'""")
def _(spark, sf):
    """Orders as register items; urgent ones say what sets them off."""
    orders = table(spark, sf, "orders")
    docs = orders.select(
        F.col("o_custkey").alias("path"),
        F.concat(F.lit("# Register\n### TD-"), F.col("o_orderkey").cast("string"), F.lit(" - order\nStatus: "),
                 F.when(F.col("o_orderstatus") == "O", "open").otherwise("done"), F.lit("\n"),
                 F.when(F.col("o_orderpriority").like("1%"), "**Trigger:** now").otherwise("later")).alias("text"),
    )
    return ops.open_without_trigger(docs, "### TD-")


@plans.add("sc18_secret_scan", f"""select doc_id as path from documents where regexp_matches(text, '{fixed.SECRET}')
  union all select o_orderkey from orders where regexp_matches('id s' || 'k-' || substr(sha256(cast(o_orderkey as varchar)), 1, (o_custkey % 40)::int), '{fixed.SECRET}')""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    digest = F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)
    tail = F.substr(digest, F.lit(1), (F.col("o_custkey") % 40).cast("int"))
    notes = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("path"), F.concat(F.lit("id s"), F.lit("k-"), tail).alias("text")
    )
    return ops.secret_scan(docs.unionByName(notes)).select("path")


@plans.add("sc19_required_headers", """with f as (select unnest(['the', 'and', 'License']) as field)
  select doc_id as path, field from documents, f where not contains(substr(text, 1, 600), field)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    return ops.required_headers(docs, ["the", "and", "License"])


@plans.add("sc20_doc_size_limits", r"""with d as (select doc_id as path, case when text = '' then 0 else
    len(regexp_split_to_array(regexp_replace(text, '(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])\z', ''),
      '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'))::int end as lines from documents)
  select path, lines from d where lines > 5""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    return ops.doc_size_limits(docs, 5).select("path", "lines")


@plans.add("su3_coverage_gap", """select distinct upper(p_name) as op from part where upper(p_name) not in
  (select upper(p_name) from part where p_size > 48)""")
def _(spark, sf):
    names = table(spark, sf, "part").select(F.upper("p_name").alias("op"), "p_size")
    return ops.coverage_gap(names, names.where("p_size > 48"))
