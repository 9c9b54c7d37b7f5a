"""Ranks and running totals over long orders, without sorting a group in one task.

A window ordered over a whole language would put that language into one task.
Here rows fall into ranges of their order first; each range's total is summed,
a small table of ranges gives what lies before each, and only the rows of one
range are ordered together.  Bounds of ranges are quantiles of the order, so a
few outlying numbers do not fill a range; how many there are goes with the size
of the input.

Groups and keys may be null: a null group is a group, null keys come first (last
in reverse).  Rows that are equal in all order columns stand in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the input, by the optimizer's estimate, for each range, and the bounds of their number.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 32 << 20, 16, 4096
_RANGE, _TOTAL, _BEFORE = "__ordered_range", "__ordered_total", "__ordered_before"


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; nothing is run for it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of columns of two tables, of nulls too."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def beside(df: DataFrame, facts: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the columns of the one row of ``facts`` that has equal ``names``, nulls included; others go."""
    renamed = facts.select(*[F.col(n).alias(f"__key_{n}") for n in names], *[c for c in facts.columns if c not in names])
    on = reduce(lambda a, b: a & b, [df[n].eqNullSafe(renamed[f"__key_{n}"]) for n in names])
    return df.join(renamed, on).drop(*[f"__key_{n}" for n in names])


def _accumulate(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str, below: int | None = None) -> DataFrame:
    before = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, _RANGE).agg(F.sum(value).alias(_TOTAL))
    offsets = totals.select(*group, _RANGE, F.coalesce(F.sum(_TOTAL).over(before), F.lit(0)).alias(_BEFORE))
    if below is not None:  # ranges that begin later are not even sorted
        offsets = offsets.where(F.col(_BEFORE) < below)
    inner = Window.partitionBy(*group, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return beside(df, offsets, [*group, _RANGE]).withColumn(name, F.col(_BEFORE) + F.sum(value).over(inner)).drop(_RANGE, _BEFORE)


def _range_of(x: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are less than or equal to a number, found in two steps of about the root of their number."""
    step = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    count = lambda a: F.size(F.filter(a, lambda b: b <= x))
    first = F.greatest(count(F.array(*[F.lit(r[0]) for r in rows])) - 1, F.lit(0))
    table = F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows])
    return first * step + count(F.element_at(table, (first + 1).cast("int")))


def by_number(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, reverse: bool = False, below: int | None = None) -> DataFrame:
    """Running total of ``value`` (the row's own included) in the order of columns of which the first is a number.

    With ``below``, rows may be missing whose total before them is that much or more.
    """
    first = F.col(order[0]).cast("double")
    n = min(MOST_RANGES, max(LEAST_RANGES, estimated_bytes(df) // RANGE_BYTES))
    cuts = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(first, F.array(*[F.lit(c) for c in cuts]), F.lit(max(10_000, 20 * n)))).first()[0]
    bounds = sorted(set(found or [0.0]))
    at = F.when(first.isNotNull(), 1 + _range_of(first, bounds)).otherwise(0).cast("int")
    ranged = df.withColumn(_RANGE, -at if reverse else at)
    return _accumulate(ranged, group, [F.col(c).desc() if reverse else F.col(c) for c in order], value, name, below)


def by_hash(df: DataFrame, group: list[str], digest: str, value: Column, name: str, then: str) -> DataFrame:
    """Running total in the order of a hexadecimal digest, ties by ``then``; ranges are the digest's first digits."""
    return _accumulate(df.withColumn(_RANGE, F.coalesce(F.substring(digest, 1, 3), F.lit(""))), group, [F.col(digest), F.col(then)], value, name)


def order_digest(seed: int, key: str) -> Column:
    """A digest that orders rows at random, the same on every engine and for every partitioning; a null key counts as an empty text."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
