"""The job store: intake, ownership, steps, states and provider calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import fixed
from darkroom.operators.ordered import BLOCK_ROWS, by_sequence, first_per_key, join_null_safe, scan
from darkroom.operators.selection import exact_quantiles

ORDER = ["id"]


def dedupe_idempotent(jobs: DataFrame) -> DataFrame:
    """First job per (user_id, idempotency_key). Jobs without a key are all different jobs.

    Keyless rows never enter the shuffle: they would all meet under one null key.
    """
    keyless = jobs.where(F.col("idempotency_key").isNull())
    keyed = jobs.where(F.col("idempotency_key").isNotNull())
    first = first_per_key(keyed, ["user_id", "idempotency_key"], ["created_at", "id"])
    return first.unionByName(keyless)


def dedupe_images(images: DataFrame, order: list[str]) -> DataFrame:
    """The first row recorded for each digest."""
    return first_per_key(images, ["sha256"], order)


def jobs_with_steps(jobs: DataFrame, steps: DataFrame, heavy_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each job with its steps in order, one row per step; jobs without steps keep one row.

    Flat rather than nested, so that a job's history is never one value in one task. The two
    halves are an inner join, which Spark may split on a heavy job, and an anti join.
    """
    numbered = scan(
        steps.withColumn("__one", F.lit(1).cast("bigint")),
        ["job_id"], ORDER, by_sequence("id", heavy_rows), heavy_rows=heavy_rows,
        running_sum={"step_no": F.col("__one")},
    ).drop("__one")
    numbered = numbered.select(
        "job_id",
        "step_no",
        *[F.col(c).alias(f"step_{c}") for c in ("id", "state", "detail", "progress", "at")],
    )
    own = jobs.withColumnRenamed("id", "job_id")
    started = own.join(numbered, "job_id")
    idle = own.join(steps.select("job_id").distinct(), "job_id", "left_anti")
    return started.unionByName(idle, allowMissingColumns=True)


def current_state(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Last state and progress of each job; ``queued`` at 0.0 before its first step."""
    last = steps.groupBy("job_id").agg(
        F.max_by(F.struct("state", "progress"), F.col("id")).alias("__last")
    )
    return jobs.select(F.col("id").alias("job_id")).join(last, "job_id", "left").select(
        "job_id",
        F.coalesce(F.col("__last.state"), F.lit("queued")).alias("state"),
        F.coalesce(F.col("__last.progress"), F.lit(0.0)).alias("progress"),
    )


def fill_progress(steps: DataFrame, heavy_rows: int = BLOCK_ROWS) -> DataFrame:
    """A step that reports no progress repeats the last reported one, 0.0 before any."""
    filled = scan(
        steps, ["job_id"], ORDER, by_sequence("id", heavy_rows), heavy_rows=heavy_rows,
        last_value={"__progress": F.col("progress")},
    )
    return filled.withColumn("progress", F.coalesce("__progress", F.lit(0.0))).drop("__progress")


def legal_move(from_state: Column, to_state: Column) -> Column:
    legal = F.create_map(
        *[
            part
            for state, moves in fixed.TRANSITIONS.items()
            for part in (F.lit(state), F.array(*[F.lit(m) for m in moves]).cast("array<string>"))
        ]
    )
    return F.array_contains(F.try_element_at(legal, from_state), to_state)


def illegal_transitions(steps: DataFrame, heavy_rows: int = BLOCK_ROWS) -> DataFrame:
    """Steps whose state may not follow the one before; cancelling a finished job is not one."""
    paired = scan(
        steps, ["job_id"], ORDER, by_sequence("id", heavy_rows), heavy_rows=heavy_rows,
        previous={"from_state": F.col("state")},
    )
    late_cancel = F.col("from_state").isin(*fixed.TERMINAL) & (F.col("state") == "cancelled")
    return paired.where(
        F.col("from_state").isNotNull()
        & ~F.coalesce(legal_move(F.col("from_state"), F.col("state")), F.lit(False))
        & ~late_cancel
    ).select("job_id", "id", "from_state", F.col("state").alias("to_state"))


def artifacts_in_order(artifacts: DataFrame, heavy_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every job's artifacts with their position by (created_at, id)."""
    return scan(
        artifacts.withColumn("__one", F.lit(1).cast("bigint")), ["job_id"], ["created_at", "id"],
        heavy_rows=heavy_rows, running_sum={"position": F.col("__one")},
    ).drop("__one")


def artifacts_for(artifacts: DataFrame, job_id: Column | str) -> DataFrame:
    """One job's artifacts, oldest first."""
    return artifacts.where(F.col("job_id") == job_id).orderBy("created_at", "id")


def owner_lookup(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs as their askers may see them: another owner's job is absent, not an error."""
    return requests.join(jobs.withColumnRenamed("id", "job_id"), ["job_id", "user_id"])


def provision_users(subjects: DataFrame, users: DataFrame) -> DataFrame:
    """Known users plus one new row per unseen external id.

    The new id is derived from the external id, so two runs over the same sign-ins agree.
    """
    digest = F.sha2("external_id", 256)
    piece = lambda at, n: F.substring(digest, at, n)
    made = F.concat_ws("-", piece(1, 8), piece(9, 4), piece(13, 4), piece(17, 4), piece(21, 12))
    unseen = (
        subjects.select("external_id").where("external_id IS NOT NULL").distinct()
        .join(users.select("external_id"), "external_id", "left_anti")
        .select(made.alias("id"), "external_id", F.lit(True).alias("is_new"))
    )
    return users.select("id", "external_id", F.lit(False).alias("is_new")).unionByName(unseen)


def upsert_jobs(current: DataFrame, incoming: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """(jobs after the saves, rejected saves).

    Saves apply in ``seq`` order. A job belongs to whoever holds it, or else to whoever saved
    it first; another owner's save, or an unnamed one, is rejected. The last accepted save replaces the row.
    """
    fields = [c for c in current.columns if c not in ("id", "user_id")]
    # what each saver did to each job; nothing else of the saves is needed to settle it
    summed = incoming.groupBy("id", "user_id").agg(
        F.min(seq).alias("__began"), F.max_by(F.struct("user_id", *fields), F.col(seq)).alias("__last")
    )
    held = current.select("id", F.struct("user_id", *fields).alias("__held"))
    mine = F.when(F.col("user_id").eqNullSafe(F.col("__held.user_id")), F.col("__last"))
    settled = summed.join(held, "id", "full_outer").groupBy("id").agg(
        F.any_value("__held", True).alias("__held"), F.min_by("__last", "__began").alias("__first"),
        F.any_value(mine, True).alias("__mine"), F.count("__began").alias("__savers"),
    )
    # without a holder the first saver owns the job, and its last save stands
    named = F.col("__held.user_id").isNotNull()
    owner = F.coalesce(F.col("__held.user_id"), F.col("__first.user_id"))
    new = F.when(named, F.coalesce("__mine", "__held")).otherwise(F.coalesce("__first", "__held"))
    jobs = settled.select("id", new.alias("__new")).select("id", "__new.*")
    owners = settled.where("__savers > 0").select("id", owner.alias("__owner"))
    rejected = incoming.join(owners, "id").where(~F.col("user_id").eqNullSafe(F.col("__owner"))).drop("__owner")
    return jobs, rejected


def replace_steps(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Step lists are replaced whole: a saved job keeps none of its old steps."""
    kept = current.join(incoming.select("job_id").distinct(), "job_id", "left_anti")
    return kept.unionByName(incoming)


def job_wait(
    jobs: DataFrame, steps: DataFrame, max_wait: float = fixed.MAX_WAIT_SECONDS
) -> DataFrame:
    """Per outcome: jobs, median and 90th percentile seconds to the first final state.

    A job with no final state within ``max_wait`` counts as still waiting, at ``max_wait``.
    """
    ended = (
        steps.where(F.col("state").isin(*fixed.TERMINAL))
        .groupBy("job_id")
        .agg(F.min_by(F.struct("state", "at"), F.struct("at", "id")).alias("__end"))
    )
    seconds = (F.unix_micros("__end.at") - F.unix_micros("created_at")) / F.lit(1_000_000.0)
    waited = (
        jobs.select(F.col("id").alias("job_id"), "created_at")
        .join(ended, "job_id", "left")
        .withColumn("__s", seconds)
        .withColumn("__in", F.coalesce(F.col("__s") <= max_wait, F.lit(False)))
        .select(
            F.when(F.col("__in"), F.col("__end.state")).otherwise(F.lit("still waiting")).alias("outcome"),
            F.when(F.col("__in"), F.col("__s")).otherwise(F.lit(float(max_wait))).alias("seconds"),
        )
    )
    counts = waited.groupBy("outcome").agg(F.count(F.lit(1)).alias("jobs"))
    parts = exact_quantiles(waited, ["outcome"], "seconds", {"p50": 0.5, "p90": 0.9})
    return join_null_safe(counts, parts, ["outcome"], "left")


def provider_health(calls: DataFrame) -> DataFrame:
    """Per provider: calls, failures, failures since the last success, and the last error."""
    at = F.struct("at", "id")
    totals = calls.groupBy("provider").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.coalesce(F.max_by("error", F.when(~F.col("ok"), at)), F.lit("")).alias("last_error"),
        F.max(F.when(F.col("ok"), at)).alias("__last_ok"),
    )
    recent = (
        calls.where(~F.col("ok")).select("provider", at.alias("__at"))
        .join(totals.select("provider", "__last_ok"), "provider")
        .where(F.col("__last_ok").isNull() | (F.col("__at") > F.col("__last_ok")))
        .groupBy("provider")
        .agg(F.count(F.lit(1)).alias("__recent"))
    )
    return totals.join(recent, "provider", "left").select(
        "provider", "calls", "failures",
        F.coalesce("__recent", F.lit(0)).alias("consecutive_failures"), "last_error",
    )
