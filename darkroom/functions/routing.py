"""Instructions to edits by ordered rules. Each rule is a struct column, null when it passes."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import fixed, text

Rule = Callable[[Column], Column]


def _intent(op: str, target: Column | None = None, content: Column | None = None,
            colour: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    given = {"op": F.lit(op), "target": target, "content": content, "colour": colour}
    return F.struct(*[(none if v is None else v).alias(k) for k, v in given.items()])


def _group(c: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(c, text.ANY_CASE + pattern, index)


def _says(c: Column, pattern: str) -> Column:
    return c.rlike(text.ANY_CASE + pattern)


def _subject(c: Column) -> Column:
    """The object of the verb without a trailing mention of the picture itself."""
    return F.regexp_replace(text.strip(c), text.ANY_CASE + fixed.FROM_PICTURE, "")


def replace_rule(c: Column) -> Column:
    where, swap = fixed.PUT_WHERE, fixed.REPLACE_WITH
    return F.when(
        _says(c, where),
        _intent("replace", _subject(_group(c, where, 2)), text.strip(_group(c, where, 1))),
    ).when(
        _says(c, swap),
        _intent("replace", _subject(_group(c, swap, 1)), text.strip(_group(c, swap, 2))),
    )


def background_rule(c: Column) -> Column:
    said = F.lower(text.clean_instruction(_group(c, fixed.BACKGROUND_TO, 1)))
    said = F.regexp_replace(F.regexp_replace(said, "^a ", ""), "^the ", "")
    # One-element transforms give the backdrop and its colour a name, so each is worked out once.
    found = F.transform(F.array(said), lambda s: F.struct(s.alias("s"), text.named_colour(s).alias("c")))
    intent = F.transform(
        found,
        lambda f: _intent("background", None, F.when(f["c"].isNull(), f["s"]), f["c"]),
    )
    return F.when(_says(c, fixed.BACKGROUND_TO), intent[0])


def remove_rule(c: Column) -> Column:
    what = _group(c, fixed.REMOVE_IT, 1)
    plain = _says(c, fixed.REMOVE_IT) & ~_says(what, fixed.VAGUE)
    return F.when(plain, _intent("remove", _subject(what)))


def add_rule(c: Column) -> Column:
    what = _group(c, fixed.ADD_IT, 1)
    plain = _says(c, fixed.ADD_IT) & ~_says(what, fixed.VAGUE)
    return F.when(plain, _intent("add", None, _subject(what)))


def upscale_rule(c: Column) -> Column:
    return F.when(_says(c, fixed.UPSCALE) | _says(c, fixed.MAKE_BIGGER), _intent("upscale"))


RULES: tuple[Rule, ...] = (replace_rule, background_rule, remove_rule, add_rule, upscale_rule)


def actionable(intent: Column) -> Column:
    """Whether the fields an operation needs are there and not empty."""
    has = lambda field: F.coalesce(intent[field], F.lit("")) != ""
    op = intent["op"]
    return (
        (~op.isin("add", "replace") | has("content"))
        & ((op != "background") | has("content") | has("colour"))
        & (~op.isin("remove", "replace") | has("target"))
    )


def route_instructions(
    df: DataFrame,
    instruction: str = "instruction",
    available: Collection[str] = fixed.IMPLEMENTED_OPS,
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """Add op, target, content, colour, route, question and reason.

    The first rule whose shape matches decides; if what it found cannot be acted on, no later
    rule is tried and the user is asked.
    """
    kept = df.columns
    cleaned = df.withColumn("__text", text.clean_instruction(F.col(instruction)))
    found = cleaned.withColumn("__found", F.coalesce(*[rule(F.col("__text")) for rule in rules]))
    usable = F.col("__found").isNotNull() & actionable(F.col("__found"))
    found = found.withColumn("__intent", F.when(usable, F.col("__found")))
    op = F.col("__intent.op")
    known = op.isin(*available)
    before, after = fixed.UNSUPPORTED.split("{op}")
    shown = lambda field: F.when(known, F.col(f"__intent.{field}")).alias(field)
    return found.select(
        *kept,
        shown("op"), shown("target"), shown("content"), shown("colour"),
        F.when(known, F.lit("rule")).otherwise(F.lit("ask")).alias("route"),
        F.when(op.isNull(), F.lit(fixed.UNCLEAR))
        .when(~known, F.concat(F.lit(before), op, F.lit(after)))
        .alias("question"),
        F.when(op.isNull(), F.lit(fixed.NO_RULE))
        .when(~known, F.replace(F.lit(fixed.NOT_HERE), F.lit("{op}"), op))
        .otherwise(F.lit(fixed.RULE_MATCHED))
        .alias("reason"),
    )


def judge_plan(
    expected: dict[str, Column], got: dict[str, Column]
) -> tuple[Column, Column]:
    """(correct, why) for a routed plan against its label; the first failed check explains."""
    want_op, got_op = expected["op"], got["op"]
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    shown = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    same_target = text.normalise_subject(got["target"]) == text.normalise_subject(expected["target"])
    why = (
        F.when(
            want_op.isNull() & got_op.isNotNull(),
            F.concat(F.lit("planned "), got_op, F.lit(" for something that is not an edit")),
        )
        .when(want_op.isNull(), F.lit(""))
        .when(got_op.isNull(), F.lit("asked a question about a plain instruction"))
        .when(got_op != want_op, F.concat(got_op, F.lit(", expected "), want_op))
        .when(
            said(expected["target"]) & ~same_target,
            F.concat(F.lit("target "), shown(got["target"]), F.lit(", expected "),
                     shown(expected["target"])),
        )
        .when(
            said(expected["colour"]) & ~got["colour"].eqNullSafe(expected["colour"]),
            F.concat(F.lit("colour "), F.coalesce(got["colour"], F.lit("None")),
                     F.lit(", expected "), expected["colour"]),
        )
        .when(said(expected["content"]) & ~said(got["content"]),
              F.lit("no content for an operation that needs one"))
        .otherwise(F.lit(""))
    )
    return why == "", why
