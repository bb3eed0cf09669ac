"""Exact percentiles per key without ordering a key's values in one task.

``percentile`` keeps every distinct value of a key in one buffer, and a window puts all rows of a key
in one task. Here only keys of few rows are ordered. For a larger key one sketch brackets all wanted
order statistics at once; values are counted on the map side, those below a bracket become one
number and those above it go. A bracket that still holds many different values is cut into
ranges at quantiles of its own, the rows of each range are counted, and the range in which the
wanted rank lies is the next bracket, round after round, until a task can order it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkroom.operators.ordered import join_null_safe
from darkroom.session import cut_lineage

#: Rows of a list that is joined as a broadcast; a longer one meets the rows by key and part.
LISTED = 10_000
#: Parts that a key's rows are dealt to where the list of keys is long.
PARTS = 32
#: Ranges that a bracket is cut into in each round.
RANGES = 64


def _bracketed(x: DataFrame, keys: list[str], large: DataFrame, listed: int) -> DataFrame:
    """``x`` with ``large``'s columns, null for keys that are not in it; no key is met in one task."""
    if listed <= LISTED:
        return join_null_safe(x, F.broadcast(large), keys, "left")
    dealt = large.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    parted = x.withColumn("__part", F.pmod(F.xxhash64("__y"), F.lit(PARTS)))
    return join_null_safe(parted, dealt, [*keys, "__part"], "left").drop("__part")


def _ranks(ps: Sequence[float], i: Column, n: Column) -> Column:
    """Position, counted from 0 and perhaps between two rows, of percentile ``i`` among ``n`` rows."""
    return (n - 1) * F.get(F.array(*[F.lit(float(p)) for p in ps]), i)


def _narrowed(counted: DataFrame, keys: list[str], ps: Sequence[float], most: int) -> DataFrame:
    """Brackets of more than ``most`` different values cut down to the range their rank lies in."""
    by = [*keys, "__i"]
    while True:
        counted = cut_lineage(counted)
        steps = [k / RANGES for k in range(1, RANGES)]
        large = counted.where(F.col("__i").isNotNull() & F.col("__y").isNotNull()).groupBy(*by).agg(
            F.percentile_approx("__y", steps, 10_000).alias("__cuts"), F.count(F.lit(1)).alias("__d")
        ).where(F.col("__d") > most).drop("__d")
        large = cut_lineage(large)
        listed = large.count()
        if not listed:
            return counted
        met = _bracketed(counted, by, large, listed)
        rest = met.where(F.col("__cuts").isNull()).drop("__cuts")
        at = F.when(F.col("__y").isNull(), -1).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col("__y"))))
        placed = met.where(F.col("__cuts").isNotNull()).withColumn("__range", at).drop("__cuts")
        along = Window.partitionBy(*by).orderBy("__range")  # at most RANGES + 1 rows of a key
        upto = F.sum("__c").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = placed.groupBy(*by, "__range").agg(F.sum("__c").alias("__c"), F.max("__n").alias("__n"))
        sums = sums.withColumn("__upto", upto).withColumn("__rank", _ranks(ps, F.col("__i"), F.col("__n")))
        wanted = sums.groupBy(*by).agg(
            F.min(F.when(F.col("__upto") > F.floor("__rank"), F.col("__range"))).alias("__low"),
            F.min(F.when(F.col("__upto") > F.ceil("__rank"), F.col("__range"))).alias("__high"),
        )
        inside = _bracketed(placed, by, wanted, listed).where(F.col("__range") <= F.col("__high"))
        kept = F.when(F.col("__range") >= F.col("__low"), F.col("__y"))
        cut = inside.groupBy(*by, kept.alias("__y"), "__n").agg(F.sum("__c").alias("__c"))
        counted = rest.select(*by, "__y", "__n", "__c").unionByName(cut.select(*by, "__y", "__n", "__c"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column | str, wanted: Mapping[str, float],
    accuracy: int = 10_000, most: int = 100_000,
) -> DataFrame:
    """Exact interpolated percentiles per key, one column for each name in ``wanted``; nulls are ignored.

    All percentiles come from the same passes. A key of at most ``accuracy`` rows is ordered at once,
    and so is what is left of a larger one when it has ``most`` different values or fewer. Null keys
    are keys like others; a key without values has no row.
    """
    keys, names, ps = list(keys), list(wanted), list(wanted.values())
    column = F.col(value) if isinstance(value, str) else value
    group = keys or ["__all"]
    base = df if keys else df.withColumn("__all", F.lit(0))
    x = base.select(*group, column.cast("double").alias("__y")).where(F.col("__y").isNotNull())
    margin = 2.0 / accuracy
    ends = [e for p in ps for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    large = x.groupBy(*group).agg(
        F.percentile_approx("__y", ends, accuracy).alias("__ends"), F.count(F.lit(1)).alias("__n")
    ).where(F.col("__n") > accuracy)
    few = large.limit(LISTED + 1).collect()  # keys of many rows, with two values for each percentile
    if not few:
        counted = x.groupBy(*group, "__y").agg(F.count(F.lit(1)).alias("__c")).withColumns(
            {"__i": F.lit(None).cast("int"), "__n": F.lit(None).cast("bigint")}
        )
    else:
        if len(few) <= LISTED:
            large = df.sparkSession.createDataFrame(few, T.StructType([large.schema[c] for c in large.columns]))
        else:
            large = cut_lineage(large)
        met = _bracketed(x, group, large, len(few))
        # a sketch is off by a share of the rows, so an end of a bracket near the first or last row is open
        under = lambda i: F.lit(True) if ps[i] + margin >= 1 else F.col("__y") <= F.col("__ends")[2 * i + 1]
        over = lambda i: F.lit(True) if ps[i] - margin <= 0 else F.col("__y") >= F.col("__ends")[2 * i]
        choice = lambda i: F.when(under(i), F.struct(F.lit(i).alias("i"), F.when(over(i), F.col("__y")).alias("y")))
        plain = F.array(F.struct(F.lit(None).cast("int").alias("i"), F.col("__y").alias("y")))
        chosen = F.when(F.col("__ends").isNull(), plain).otherwise(F.array_compact(F.array(*[choice(i) for i in range(len(ps))])))
        counted = met.select(*group, "__n", F.explode(chosen).alias("__s")).groupBy(
            *group, F.col("__s.i").alias("__i"), F.col("__s.y").alias("__y"), "__n"
        ).agg(F.count(F.lit(1)).alias("__c"))
        if 2 * margin * max(r["__n"] for r in few) > most or len(few) > LISTED:
            counted = _narrowed(counted, group, ps, most)

    each = Window.partitionBy(*group, "__i")
    upto = each.orderBy(F.col("__y").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumns(
        {"__upto": F.sum("__c").over(upto), "__m": F.coalesce(F.col("__n"), F.sum("__c").over(each))}
    )
    out = []
    for i, p in enumerate(ps):
        mine = F.col("__i").isNull() | (F.col("__i") == i)
        at = (F.col("__m") - 1) * F.lit(float(p))
        low = F.min(F.when(mine & (F.col("__upto") > F.floor(at)), F.col("__y")))
        high = F.min(F.when(mine & (F.col("__upto") > F.ceil(at)), F.col("__y")))
        out += [low.alias(f"__low{i}"), high.alias(f"__high{i}"), F.max(F.when(mine, at - F.floor(at))).alias(f"__f{i}")]
    answer = ranked.groupBy(*group).agg(*out)
    between = lambda i: F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * F.col(f"__f{i}")
    return answer.select(*keys, *[between(i).alias(name) for i, name in enumerate(names)])


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: Column | str, name: str, p: float = 0.5, accuracy: int = 10_000,
    few_groups: bool = False,
) -> DataFrame:
    """One exact percentile per key. ``few_groups`` changes nothing: keys are counted, not promised."""
    return exact_quantiles(df, keys, value, {name: p}, accuracy)


def exact_percentiles(df: DataFrame, columns: Mapping[str, Column | str], p: float = 0.5) -> DataFrame:
    """One row with the exact percentile of several columns, in the passes that one column takes."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("__what"), as_column(c).cast("double").alias("__v"))
        for name, c in columns.items()
    ])))
    each = exact_quantiles(long, ["__what"], "__v", {"__p": p})
    return each.agg(*[F.max(F.when(F.col("__what") == n, F.col("__p"))).alias(n) for n in columns])
