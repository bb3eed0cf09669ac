"""Checks over whole document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import fixed, text
from darkroom.operators.ranks import ordinal_rank
from darkroom.session import cut_lineage


def links(docs: DataFrame, body: str = "text") -> DataFrame:
    """Every link of every document, once per mention."""
    found = F.regexp_extract_all(F.col(body), F.lit(fixed.LINK), F.lit(1))
    return docs.select("path", F.explode(found).alias("target"))


def normal_path(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts; ``..`` at the root stays there."""
    rooted = F.startswith(path, F.lit("/"))

    def step(done: Column, part: Column) -> Column:
        inside = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        up = F.when(inside, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(
            rooted, done
        ).otherwise(F.array_append(done, ".."))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def broken_links(docs: DataFrame, targets: DataFrame, body: str = "text") -> DataFrame:
    """Local links to something that is not there: target, path and mentions per document.

    A link is followed from its document's folder; one in a document without a path, from the top.
    ``targets`` lists the paths that exist, folders included, written as ``path`` is; the root
    exists. A target that very many documents name is counted per document first, so each mention
    group meets the target list once.
    """
    local = links(docs, body).where(~F.col("target").rlike("^(?:http://|https://|mailto:)"))
    mentions = local.groupBy("target", "path").agg(F.count(F.lit(1)).alias("mentions"))
    beside = F.concat(F.col("path").cast("string"), F.lit("/../"), F.col("target"))
    alone = F.startswith("target", F.lit("/")) | (F.coalesce(F.col("path").cast("string"), F.lit("")) == "")
    there = normal_path(F.when(alone, F.col("target")).otherwise(beside))
    known = targets.select(normal_path(F.col("target")).alias("__at")).distinct()
    followed = mentions.withColumn("__at", there).where(~F.col("__at").isin("", "/"))
    return followed.join(known, "__at", "left_anti").select("target", "path", "mentions")


def missing_paths(docs: DataFrame, targets: DataFrame, body: str = "text") -> DataFrame:
    """Files named in backticks that are not there: target, path and mentions per document.

    A name counts from the top and from the document's folder. Names from the root of a site are no
    files. ``targets`` lists the paths that exist, generated ones too, from the top.
    """
    named = F.regexp_extract_all(F.col(body), F.lit(fixed.PATH_MENTION), F.lit(1))
    found = docs.select("path", F.explode(named).alias("target")).where(~F.startswith("target", F.lit("/")))
    mentions = found.groupBy("target", "path").agg(F.count(F.lit(1)).alias("mentions"))
    known = targets.select(F.ltrim(normal_path(F.col("target")), F.lit("/")).alias("__at")).distinct()
    folder = F.regexp_replace(F.coalesce(F.col("path").cast("string"), F.lit("")), r"[^/]*$", "")
    beside = F.ltrim(normal_path(F.concat(folder, "target")), F.lit("/"))
    lost = mentions.withColumn("__at", normal_path(F.col("target"))).join(known, "__at", "left_anti")
    return lost.withColumn("__at", beside).join(known, "__at", "left_anti").select("target", "path", "mentions")


def unknown_commands(docs: DataFrame, commands: DataFrame, body: str = "text") -> DataFrame:
    """Commands that documents tell to run and that are no target: command, path and mentions."""
    named = F.regexp_extract_all(F.col(body), F.lit(fixed.COMMAND_MENTION), F.lit(1))
    mentions = docs.select("path", F.explode(named).alias("command")).groupBy("command", "path").agg(
        F.count(F.lit(1)).alias("mentions")
    )
    return mentions.join(commands.select("command").distinct(), "command", "left_anti")


def undocumented_keys(keys: DataFrame, docs: DataFrame, body: str = "text", together: int = 1000) -> DataFrame:
    """Registry keys that no document names, by letters and digits alone, in any case.

    ``together`` keys are looked for in one scan of the documents.
    """
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    wanted = cut_lineage(keys.select("key", flat(F.col("key")).alias("__flat")).distinct())
    every = wanted.select("__flat").where(F.col("__flat").isNotNull()).distinct().withColumn("__id", F.monotonically_increasing_id())
    placed = ordinal_rank(every, ["__flat", "__id"], "__at")
    found = None
    for low in range(0, placed.count(), together):
        block = placed.where((F.col("__at") >= low) & (F.col("__at") < low + together))
        names = F.lit([r["__flat"] for r in block.select("__flat").collect()])
        text_ = docs.select(flat(F.col(body)).alias("__text"))
        seen = text_.select(F.explode(F.filter(names, lambda n: F.contains(F.col("__text"), n))).alias("__flat")).distinct()
        found = seen if found is None else found.unionByName(seen)
    return wanted.select("key") if found is None else wanted.join(found, "__flat", "left_anti").select("key")


def open_without_trigger(docs: DataFrame, heading: str, body: str = "text") -> DataFrame:
    """Open items that say nothing of what would set them off: path and item.

    An item is a section that begins with ``heading``; its name is the rest of that line.
    """
    sections = F.split(F.col(body), rf"\Q{heading}\E")
    items = docs.select("path", F.explode(F.slice(sections, F.lit(2), F.greatest(F.size(sections) - 1, F.lit(0)))).alias("__item"))
    open_ = F.contains("__item", F.lit(fixed.OPEN_ITEM)) & ~F.contains("__item", F.lit(fixed.TRIGGER))
    return items.where(open_).select("path", F.trim(F.substring_index("__item", "\n", 1)).alias("item"))


def secret_scan(docs: DataFrame, body: str = "text") -> DataFrame:
    """Documents holding something shaped like a credential."""
    return docs.where(F.col(body).rlike(fixed.SECRET))


def required_headers(
    docs: DataFrame, fields: Sequence[str] = fixed.REQUIRED_HEADERS,
    head: int = fixed.HEADER_CHARS, body: str = "text",
) -> DataFrame:
    """One row per field missing from a document's opening characters."""
    opening = F.substring(F.col(body), 1, head)
    wanted = F.array(*[F.lit(f) for f in fields])
    missing = F.filter(wanted, lambda field: ~F.contains(opening, field))
    return docs.select("path", F.explode(missing).alias("field"))


def doc_size_limits(docs: DataFrame, limit: Column | int, body: str = "text") -> DataFrame:
    """Documents over their line limit."""
    return docs.withColumn("lines", text.line_count(F.col(body))).where(F.col("lines") > limit)


def coverage_gap(advertised: DataFrame, covered: DataFrame) -> DataFrame:
    """Advertised values nothing covers."""
    return advertised.select("op").subtract(covered.select("op"))


def reconcile(index: DataFrame, detail: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Where an index and its detail disagree: id, finding, shown.

    Both have id, status, priority; the index has one row per id. A repeated detail id is
    compared by its first row in ``seq`` order, found by aggregation and not by sorting an id.
    """
    first = detail.groupBy("id").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min_by(F.struct("status", "priority"), F.struct(*seq)).alias("__d"),
    )
    both = index.withColumn("__i", F.struct("status", "priority")).select("id", "__i").join(
        first, "id", "full_outer"
    )
    listed, detailed = F.col("__i").isNotNull(), F.col("__d").isNotNull()
    against = lambda f: F.concat(F.col(f"__i.{f}"), F.lit(" / "), F.col(f"__d.{f}"))
    differs = lambda f: listed & detailed & ~F.col(f"__i.{f}").eqNullSafe(F.col(f"__d.{f}"))
    found = [
        ("no section", listed & ~detailed, F.lit("")),
        ("not in the index", ~listed & detailed, F.lit("")),
        ("repeated", F.col("__n") > 1, F.col("__n").cast("string")),
        ("status differs", differs("status"), against("status")),
        ("priority differs", differs("priority"), against("priority")),
    ]
    rows = F.array(*[
        F.when(test, F.struct(F.lit(name).alias("finding"), shown.alias("shown")))
        for name, test, shown in found
    ])
    return both.select("id", F.inline(F.filter(rows, lambda r: r.isNotNull())))
