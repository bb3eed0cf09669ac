"""JSON payloads: log fields, progress events and shape-tolerant phrase records."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import fixed, text

EVENT_SCHEMA = "job_id STRING, state STRING, progress DOUBLE, detail STRING, terminal BOOLEAN"


def suspicious(name: Column) -> Column:
    """Whether a field name looks like a credential."""
    return F.lower(name).rlike("|".join(fixed.SUSPICIOUS_NAMES))


def _quoted(c: Column) -> Column:
    return F.to_json(c.cast("variant"))


def _redacted(value: Column, depth: int) -> Column:
    """A variant as JSON with suspicious values hidden; it holds containers ``depth`` levels deep at most."""
    hidden = F.lit(f'"{fixed.REDACTED}"')
    plain = F.coalesce(F.to_json(value), F.lit("null"))
    if depth == 0:
        return plain
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    items = F.try_variant_get(value, "$", "array<variant>")

    def shown(m: Column) -> Column:
        label = F.coalesce(F.concat(_quoted(m["key"]), F.lit(":")), F.lit(""))
        held = F.when(suspicious(m["key"]), hidden).otherwise(_redacted(m["value"], depth - 1))
        return F.concat(label, held)

    unnamed = F.transform(
        items, lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value"))
    )
    body = F.array_join(F.transform(F.coalesce(F.map_entries(fields), unnamed), shown), ",")
    wrapped = F.when(fields.isNotNull(), F.concat(F.lit("{"), body, F.lit("}"))).when(
        items.isNotNull(), F.concat(F.lit("["), body, F.lit("]"))
    )
    return F.coalesce(wrapped, plain)


#: In JSON without white space: a name with its colon, a string, a bracket, a comma, or any other value.
TOKEN = re.compile(r'("(?:[^"\\]|\\.)*")(:?)|[\[{]|[\]}]|,|[^\[\]{},":]+', re.DOTALL)


def _hidden(line: str) -> str:
    """Compact JSON with the value after every suspicious name replaced, in one pass without recursion."""
    out: list[str] = []
    depth, since, hide = 0, -1, False  # since: depth at which a hidden container opened
    for m in TOKEN.finditer(line):
        token = m.group()
        if token[0] in "]}":
            depth -= 1
            if depth == since:
                since = -1
                continue
        if since < 0:
            if hide:
                out.append(f'"{fixed.REDACTED}"')
                hide = False
                since = depth if token[0] in "[{" else -1
            else:
                out.append(token)
                hide = bool(m.group(2)) and _SUSPICIOUS.search(json.loads(m.group(1)).lower()) is not None
        if token[0] in "[{":
            depth += 1
    return "".join(out)


_SUSPICIOUS = re.compile("|".join(fixed.SUSPICIOUS_NAMES))


def redact(line: Column) -> Column:
    """JSON text with the values of suspicious names hidden, at every level however deep.

    Items of a list are judged by the list's name, objects by their own names. A text that is no
    JSON, names a field twice, or is nested deeper than Spark's JSON parser reads (1000 levels) is
    hidden whole. An object's names come out in alphabetical order.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(_hidden, na_action="ignore")

    parsed = F.try_parse_json(line)
    plain = F.when(parsed.isNotNull(), F.coalesce(F.to_json(parsed), F.lit("null")))
    shown = F.pandas_udf(run, "string")(plain)
    return F.when(line.isNotNull() & parsed.isNull(), F.lit(f'"{fixed.REDACTED}"')).otherwise(shown)


redact_all = redact


def nesting(line: Column) -> Column:
    """How many brackets are open at once, at most, in a JSON text; 0 for a plain value."""
    brackets = F.regexp_replace(F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    step = lambda a, c: F.struct(
        (a["open"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("open"),
        F.greatest(a["most"], a["open"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"),
    )
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))
    chars = F.filter(F.split(brackets, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda a: a["most"])


def redact_records(records: DataFrame, column: str, levels: int = 24) -> DataFrame:
    """``records`` with ``column`` redacted as ``redact`` does it, in the JVM.

    One pass finds how deep the texts are nested, and the second walks exactly that deep. Only texts of
    more than ``levels`` levels go through Python.
    """
    deep = nesting(F.col(column))
    most = records.agg(F.max(deep).alias("most")).first()["most"] or 0
    parsed = F.try_parse_json(F.col(column))
    walked = F.when(F.col(column).isNotNull() & parsed.isNull(), F.lit(f'"{fixed.REDACTED}"')).otherwise(
        _redacted(parsed, min(most, levels))
    )
    walked = F.when(F.col(column).isNotNull(), walked)
    if most <= levels:
        return records.withColumn(column, walked)
    shallow = F.coalesce(deep <= levels, F.lit(True))
    return records.where(shallow).withColumn(column, walked).unionByName(
        records.where(~shallow).withColumn(column, redact(F.col(column)))
    )


def merge_context(outer: Column, inner: Column, extras: Column) -> Column:
    """One map per log record: the outer context beats the inner one, the record beats both.

    Error details are cut to the published limit.
    """
    none = F.create_map().cast("map<string,string>")
    outer, inner = F.coalesce(outer, none), F.coalesce(inner, none)
    extras = F.coalesce(extras, none)
    inner = F.map_filter(
        inner, lambda k, v: ~F.map_contains_key(outer, k) & ~F.map_contains_key(extras, k)
    )
    outer = F.map_filter(outer, lambda k, v: ~F.map_contains_key(extras, k))
    merged = F.map_concat(inner, outer, extras)
    return F.transform_values(
        merged,
        lambda k, v: F.when(k == "error_detail", F.substring(v, 1, fixed.DETAIL_LIMIT)).otherwise(v),
    )


def event_to_json(job_id: Column, state: Column, progress: Column, detail: Column,
                  terminal: Column) -> Column:
    return F.to_json(
        F.struct(
            job_id.cast("string").alias("job_id"),
            state.alias("state"),
            F.coalesce(progress, F.lit(0.0)).alias("progress"),
            F.coalesce(detail, F.lit("")).alias("detail"),
            F.coalesce(terminal, F.lit(False)).alias("terminal"),
        )
    )


def event_from_json(payload: Column) -> Column:
    """Struct with defaults filled in; null where the payload is broken or lacks its job or state."""
    read = F.from_json(payload, EVENT_SCHEMA + ", __bad STRING",
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    whole = read["__bad"].isNull() & read["job_id"].isNotNull() & read["state"].isNotNull()
    return F.when(
        whole,
        F.struct(
            read["job_id"].alias("job_id"),
            read["state"].alias("state"),
            F.coalesce(read["progress"], F.lit(0.0)).alias("progress"),
            F.coalesce(read["detail"], F.lit("")).alias("detail"),
            F.coalesce(read["terminal"], F.lit(False)).alias("terminal"),
        ),
    )


def flatten_sentences(info: Column) -> Column:
    """Phrases of a record held as JSON: strings, lists of strings, or lists of objects.

    The keys are read in order; objects give ``raw``, else ``sent``; blanks are dropped.
    """
    record = F.from_json(info, "sentences STRING, captions STRING, raw_sentences STRING")

    def phrases(value: Column) -> Column:
        opens = F.substring(F.trim(value), 1, 1)
        items = F.from_json(value, "array<string>")

        def phrase(v: Column) -> Column:
            parts = F.from_json(v, "raw STRING, sent STRING")
            pick = F.coalesce(F.when(parts["raw"] != "", parts["raw"]), parts["sent"])
            return F.when(F.substring(v, 1, 1) == "{", pick).otherwise(v)

        return (
            F.when(opens == "[", F.transform(items, phrase))
            .when(value.isNotNull(), F.array(value))
            .otherwise(F.array().cast("array<string>"))
        )

    every = F.flatten(F.array(*[phrases(record[k]) for k in ("sentences", "captions", "raw_sentences")]))
    return F.filter(F.transform(every, text.strip), lambda p: p.isNotNull() & (p != ""))
