"""Decisions and scores over stored metrics, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from darkroom.functions import fixed


def fill_cost(chroma: Column, luminance: Column, edge: Column) -> Column:
    """Photometric cost of a fill; lower is better."""
    detail = F.abs(F.log(F.greatest(edge, F.lit(1e-3))))
    return chroma + luminance + F.lit(fixed.EDGE_WEIGHT) * detail


def compare_cost(
    candidate: Column,
    baseline: Column,
    base_area: Column,
    candidate_area: Column,
    penalty: float = fixed.GROWTH_PENALTY,
) -> Column:
    """Candidate cost over baseline, charged for area it touched beyond the baseline's."""
    extra = F.greatest(candidate_area - base_area, F.lit(0)).cast("double")
    return (candidate + F.lit(penalty) * extra / F.greatest(base_area, F.lit(1))) - baseline


def pick_arm(confidence: Column, above: Column, below: Column, gate: Column) -> Column:
    return F.when(confidence >= gate, above).otherwise(below)


def object_verdict(
    referenced: Column, age_hours: Column, grace_hours: float = 24.0, retention_days: int = 0
) -> Column:
    """``orphan``, ``expired`` or null (keep)."""
    verdict = F.when(~referenced & (age_hours >= grace_hours), F.lit("orphan"))
    if retention_days > 0:
        verdict = verdict.when(referenced & (age_hours >= retention_days * 24.0), F.lit("expired"))
    return verdict


def _present(checks: Sequence[tuple[Column, Column]]) -> Column:
    """The labels of the checks that hold, in order. A null check does not hold."""
    return F.filter(F.array(*[F.when(test, label) for test, label in checks]), lambda r: r.isNotNull())


def verdict_reasons(
    changed: Column,
    cost: Column,
    still_there: Column,
    min_changed: float = fixed.MIN_CHANGED,
    escalate_cost: float = fixed.ESCALATE_COST,
    min_score: float = fixed.MIN_BOX_SCORE,
) -> Column:
    """Why an edit is not good: empty array when it is. ``still_there`` null means unchecked."""
    return _present(
        [
            (changed < min_changed, F.lit(fixed.UNCHANGED)),
            (cost > escalate_cost, F.lit(fixed.IMPLAUSIBLE)),
            (still_there >= min_score, F.lit(fixed.STILL_THERE)),
        ]
    )


def decide_action(
    ok: Column,
    attempt: Column,
    seconds: Column,
    can_widen: Column,
    max_retries: Column,
    max_seconds: Column,
) -> Column:
    """accept, stop, widen or ask; the first rule that holds."""
    return (
        F.when(ok, F.lit("accept"))
        .when((attempt > max_retries) | (seconds >= max_seconds), F.lit("stop"))
        .when(can_widen, F.lit("widen"))
        .otherwise(F.lit("ask"))
    )


def blank_fill(mean: Column, spread: Column) -> Column:
    """A region that is dark and flat carries no picture."""
    return (mean < fixed.BLANK_MEAN) & (spread < fixed.BLANK_SPREAD)


def signature_distance(left: Column, right: Column) -> Column:
    """Largest byte difference of two hex strings over 255; 1.0 when their lengths differ."""
    def numbers(text: Column) -> Column:
        """Seven bytes at a time, the most a long holds without its sign."""
        pieces = F.regexp_extract_all(text, F.lit(".{1,14}"), F.lit(0))
        return F.transform(pieces, lambda p: F.conv(p, 16, 10).cast("bigint"))

    byte = lambda n, at: F.shiftright(n, 8 * at).bitwiseAND(F.lit(255))
    gaps = F.zip_with(
        numbers(left), numbers(right),
        lambda a, b: F.greatest(*[F.abs(byte(a, at) - byte(b, at)) for at in range(7)]),
    )
    return F.when(F.length(left) != F.length(right), F.lit(1.0)).otherwise(
        F.array_max(gaps).cast("double") / 255.0
    )
