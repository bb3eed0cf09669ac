"""Validation and derived columns for edit specs, uploads, requests and jobs."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import fixed, text

Checks = list[tuple[Column, str]]


def violations(checks: Checks) -> Column:
    """Labels of every check that failed, in order. A null test counts as not failed."""
    failed = F.array(*[F.when(test, F.lit(label)) for test, label in checks])
    return F.filter(failed, lambda label: label.isNotNull())


def _with(df: DataFrame, checks: Checks) -> DataFrame:
    return df.withColumn("violations", violations(checks)).withColumn(
        "valid", F.size("violations") == 0
    )


def _missing(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def validate_specs(df: DataFrame, intents: bool = False) -> DataFrame:
    """Is each spec actionable? Needs op, mask_source, target, content, colour, has_mask.

    Every broken rule is listed. ``intents`` adds the stricter rule for unbound intents, which
    must name a target to remove or replace.
    """
    op, source = F.col("op"), F.col("mask_source")
    checks: Checks = [
        (op.isin("add", "replace") & _missing("content"), "needs content"),
        ((op == "background") & _missing("content") & _missing("colour"), "needs a backdrop"),
        ((op == "remove") & _missing("target") & ~F.col("has_mask"), "needs target or mask"),
        ((source == "text") & _missing("target"), "text needs target"),
        (source.isin("brush", "point") & ~F.col("has_mask"), "drawn source needs mask"),
        (~op.isin(*fixed.OPS), "unknown op"),
        (~source.isin(*fixed.MASK_SOURCES), "unknown mask source"),
    ]
    if intents:
        checks.append((op.isin("remove", "replace") & _missing("target"), "needs target"))
    return _with(df, checks)


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their violations)."""
    return checked.where("valid").drop("violations", "valid"), checked.where("NOT valid")


def validate_refs(df: DataFrame) -> DataFrame:
    """Digest shape, sides, box order, score range and colour shape.

    Needs sha256, width, height, x0, y0, x1, y1, score, colour.
    """
    side = lambda c: ~F.col(c).between(1, fixed.MAX_SIDE)
    ordered = (
        (F.col("x0") >= 0.0) & (F.col("x0") < F.col("x1")) & (F.col("x1") <= 1.0)
        & (F.col("y0") >= 0.0) & (F.col("y0") < F.col("y1")) & (F.col("y1") <= 1.0)
    )
    return _with(
        df,
        [
            (~F.col("sha256").rlike(fixed.DIGEST_PATTERN), "digest"),
            (side("width"), "width"),
            (side("height"), "height"),
            (~ordered, "box"),
            (~F.col("score").between(0.0, 1.0), "score"),
            (~F.col("colour").rlike(fixed.COLOUR_PATTERN), "colour"),
        ],
    )


def validate_masks(df: DataFrame) -> DataFrame:
    """Run lengths fill the mask exactly and the mask has the image's shape.

    Needs width, height, counts, image_width, image_height.
    """
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n)
    pixels = F.col("width").cast("bigint") * F.col("height")
    skew = F.abs(
        F.col("width").cast("bigint") * F.col("image_height")
        - F.col("height").cast("bigint") * F.col("image_width")
    )
    return _with(
        df,
        [
            (total != pixels, "counts do not fill the mask"),
            (skew > F.col("image_width") + F.col("image_height"), "not the shape of the image"),
        ],
    )


def admit_uploads(
    df: DataFrame,
    max_bytes: int = fixed.MAX_UPLOAD_BYTES,
    max_megapixels: float = fixed.MAX_MEGAPIXELS,
    formats: Collection[str] = fixed.ALLOWED_FORMATS,
) -> DataFrame:
    """First reason each upload is refused, null when it is admitted.

    Needs byte_size, format, width, height.
    """
    pixels = F.col("width").cast("double") * F.col("height")
    reason = (
        F.when(F.col("byte_size") > max_bytes, "too large")
        .when(F.col("byte_size") <= 0, "empty")
        .when(~F.coalesce(F.col("format"), F.lit("")).isin(*formats), "format not supported")
        .when((F.col("width") <= 0) | (F.col("height") <= 0), "bad size")
        .when(pixels / 1e6 > max_megapixels, "too many megapixels")
    )
    return df.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def check_outcomes(jobs: DataFrame) -> DataFrame:
    """A failed job says why; a finished one names its result."""
    return _with(
        jobs,
        [
            ((F.col("state") == "failed") & _missing("error"), "failed without a reason"),
            ((F.col("state") == "done") & _missing("result_sha256"), "done without a result"),
        ],
    )


def render_prompt(op: Column, target: Column, content: Column) -> Column:
    """What a person would type for this case."""
    target, content = F.coalesce(target, F.lit("None")), F.coalesce(content, F.lit("None"))
    other = F.when(target != "None", target).when(content != "None", content).otherwise(F.lit(""))
    return (
        F.when(op == "remove", F.concat(F.lit("remove "), target))
        .when(op == "add", F.concat(F.lit("add "), content))
        .when(op == "replace", F.concat(F.lit("replace "), target, F.lit(" with "), content))
        .when(op == "background", F.concat(F.lit("change the background to "), content))
        .when(op == "upscale", F.lit("upscale the image"))
        .otherwise(text.strip(F.concat(op, F.lit(" "), other)))
    )


def filter_cases(
    cases: DataFrame,
    ops: Collection[str] | None = None,
    need_box: bool = False,
    include_deferred: bool = False,
) -> DataFrame:
    """Cases to run: chosen operations, with a box if one is needed, deferred ones left out."""
    if not include_deferred:
        cases = cases.where(~F.coalesce(F.col("deferred"), F.lit(False)))
    if ops is not None:
        cases = cases.where(F.col("op").isin(*ops))
    return cases.where(F.col("box").isNotNull()) if need_box else cases


def exclude_remote(df: DataFrame) -> DataFrame:
    """Drop operations whose result is different on every call. A missing op is kept."""
    return df.where(F.col("op").isNull() | ~F.col("op").isin(*fixed.REMOTE_OPS))


def derive_asset_cols(df: DataFrame, fallback: tuple[int, int, int] = (0, 177, 64)) -> DataFrame:
    """uri, megapixels, red/green/blue and whether the operation needs a remote model."""
    channel = lambda at: F.conv(F.substring(F.ltrim(F.col("colour"), F.lit("#")), at, 2), 16, 10)
    rgb = {
        name: F.coalesce(channel(1 + 2 * i).cast("int"), F.lit(fallback[i]))
        for i, name in enumerate(("red", "green", "blue"))
    }
    return df.withColumns(
        {
            "uri": F.concat(F.lit("asset://"), F.col("bucket"), F.lit("/"), F.col("sha256")),
            "megapixels": F.col("width").cast("double") * F.col("height") / 1e6,
            "is_generative": F.col("op").isin(*fixed.GENERATIVE_OPS),
            **rgb,
        }
    )


def client_identity(host: Column, forwarded_for: Column) -> Column:
    """First forwarded entry if it is not blank, else the host, else ``unknown``."""
    first = text.strip(F.split(forwarded_for, ",")[0])
    blank_to_null = lambda c: F.when(c != "", c)
    return F.coalesce(blank_to_null(first), blank_to_null(host), F.lit("unknown"))


def owner_scoped(df: DataFrame, user_id: Column | str) -> DataFrame:
    """Only the rows a user owns; the predicate reaches the scan."""
    return df.where(F.col("user_id") == user_id)
