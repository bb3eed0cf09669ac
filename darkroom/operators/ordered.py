"""Ordered per-key scans that do not put a heavy key in one task.

``Window.partitionBy(key).orderBy(seq)`` sends every row of a key to one task. When one key
holds a third of the table that task is the job. Here a heavy key's history is cut into blocks
of the ordering column, each block is scanned on its own, one summary row per block is carried
along the key, and the carry is joined back. Only block summaries meet in one task. All other
keys are one block each and cost what the plain window costs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"
BLOCK_ROWS = 1 << 20


def by_sequence(column: str, rows: int = BLOCK_ROWS) -> Column:
    """Blocks of a dense integer sequence: a (key, block) group holds at most ``rows`` rows."""
    return F.floor(F.col(column) / F.lit(rows)).cast("bigint")


def mark_heavy(df: DataFrame, keys: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``__heavy``: true on rows of keys with more than ``rows`` rows, null elsewhere.

    Keys are counted by hash, combined on the map side. Every such key is marked, however many
    there are; Spark chooses the join by the size of their list.
    """
    hashed = F.xxhash64(*keys)
    heavy = (
        df.groupBy(hashed.alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > rows)
        .select("__h", F.lit(True).alias("__heavy"))
    )
    return df.withColumn("__h", hashed).join(heavy, "__h", "left").drop("__h")


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with ``right``'s other columns; null keys match null keys."""
    named = right.withColumnsRenamed({c: f"__on_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on]
    return left.join(named, same, how).drop(*[f"__on_{c}" for c in on])


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None = None,
    *,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    running_sum: Mapping[str, Column] | None = None,
    last_value: Mapping[str, Column] | None = None,
    heavy_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add neighbouring and running columns per key, in ``order``.

    ``previous`` / ``following``: the expression on the row before / after, null at the ends.
    ``running_sum``: inclusive prefix sum. ``last_value``: last non-null value up to this row.

    Keys of more than ``heavy_rows`` rows are looked for first. Without any, plain windows answer
    in one shuffle. The rows of heavy keys are cut into blocks: by ``block``, which must not decrease
    in order, or, where it is not given, by their counted position, ``heavy_rows`` rows to a block
    whatever the values of ``order`` are.
    """
    previous, following = dict(previous or {}), dict(following or {})
    running_sum, last_value = dict(running_sum or {}), dict(last_value or {})
    keys, order = list(keys), list(order)
    inputs = {f"__in_{n}": e for n, e in {**previous, **following, **running_sum, **last_value}.items()}
    names = [*previous], [*following], [*running_sum], [*last_value]
    kept = [c for c in df.columns if c not in {n for some in names for n in some}]

    hashed = F.xxhash64(*keys)
    heavy = df.groupBy(hashed.alias("__h")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > heavy_rows)
    if heavy.isEmpty():
        return _windowed(df.withColumns(inputs), keys, order, names, kept)
    marked = df.withColumns({"__h": hashed, **inputs}).join(
        heavy.select("__h", F.lit(True).alias("__heavy")), "__h", "left"
    ).drop("__h")
    light = _windowed(marked.where("__heavy IS NULL"), keys, order, names, kept)
    large = marked.where("__heavy")
    if block is None:
        from darkroom.operators.ranks import ordinal_rank  # which builds on this module

        large = ordinal_rank(large, [*keys, *order], "__at")
        order, block = ["__at"], by_sequence("__at", heavy_rows)
    return light.unionByName(_carried(large.withColumn(BLOCK, block), keys, order, names, kept))


def _given(name: str) -> Column:
    return F.col(f"__in_{name}")


def _boxed(name: str) -> Column:
    """The value inside a struct, so that a null value is not taken for a missing row."""
    return F.struct(_given(name).alias("v"))


def _local(by: list[str], order: list[str], names: tuple[list[str], ...]) -> dict[str, Column]:
    previous, following, running_sum, last_value = names
    inside = Window.partitionBy(*by).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {
        **{n: F.lag(_boxed(n)).over(inside) for n in previous},
        **{n: F.lead(_boxed(n)).over(inside) for n in following},
        **{n: F.sum(_given(n)).over(upto) for n in running_sum},
        **{n: F.last(_given(n), ignorenulls=True).over(upto) for n in last_value},
    }


def _windowed(
    rows: DataFrame, keys: list[str], order: list[str], names: tuple[list[str], ...], kept: list[str]
) -> DataFrame:
    neighbours = {*names[0], *names[1]}
    local = _local(keys, order, names)
    return rows.select(*kept, *[(e["v"] if n in neighbours else e).alias(n) for n, e in local.items()])


def _carried(
    rows: DataFrame, keys: list[str], order: list[str], names: tuple[list[str], ...], kept: list[str]
) -> DataFrame:
    """Every block scanned by itself, with what the blocks before and after it hand over."""
    previous, following, running_sum, last_value = names
    at = F.struct(*[F.col(c) for c in order])
    totals = {
        **{n: F.max_by(_boxed(n), at) for n in previous},
        **{n: F.min_by(_boxed(n), at) for n in following},
        **{n: F.sum(_given(n)) for n in running_sum},
        **{n: F.max_by(_given(n), F.when(_given(n).isNotNull(), at)) for n in last_value},
    }
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda n: F.col(f"__t_{n}")
    carries = {
        **{n: F.lag(total(n)).over(along) for n in previous},
        **{n: F.lead(total(n)).over(along) for n in following},
        **{n: F.sum(total(n)).over(before) for n in running_sum},
        **{n: F.last(total(n), ignorenulls=True).over(before) for n in last_value},
    }
    carry = (
        rows.groupBy(*keys, BLOCK).agg(*[e.alias(f"__t_{n}") for n, e in totals.items()])
        .select(*keys, BLOCK, *[e.alias(f"__c_{n}") for n, e in carries.items()])
    )
    local = _local([*keys, BLOCK], order, names)
    joined = join_null_safe(rows.withColumns({f"__l_{n}": e for n, e in local.items()}), carry, [*keys, BLOCK], "left")
    mine, came = (lambda n: F.col(f"__l_{n}")), (lambda n: F.col(f"__c_{n}"))
    out = {n: F.coalesce(mine(n), came(n))["v"] for n in [*previous, *following]}
    out |= {n: F.coalesce(mine(n) + came(n), mine(n), came(n)) for n in running_sum}
    out |= {n: F.coalesce(mine(n), came(n)) for n in last_value}
    return joined.select(*kept, *[e.alias(n) for n, e in out.items()])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. Spark keeps one row per key on the map side of the shuffle."""
    return top_per_key(df, keys, order, 1, "__rn").drop("__rn")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each key with their 1-based rank; map side keeps ``k`` per key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
