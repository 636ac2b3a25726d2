"""Aggregates and orderings with the meaning the analytical queries rely on.

Where engines differ (first non-null value, value at the maximum, division by
zero, place of nulls, days between dates, membership in a list with nulls) the
meaning is fixed here once, as plain Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def share(condition: Column, digits: int = 6) -> Column:
    """Share of rows for which the condition holds, among those where it is known."""
    return F.round(F.avg(condition.cast("int")), digits)


def count_if(condition: Column) -> Column:
    """Rows for which the condition holds, as BIGINT, 0 for none."""
    return F.count(F.when(condition, F.lit(1)))


def any_non_null(x: Column) -> Column:
    """Some non-null value; which one is open where there are several."""
    return F.any_value(x, F.lit(True))


def arg_max(x: Column, *by: Column) -> Column:
    """x of the row with the greatest ``by``, among rows where neither is null; ties
    go to the greatest x."""
    known = x.isNotNull()
    for b in by:
        known = known & b.isNotNull()
    packed = F.max(F.when(known, F.struct(*[b.alias(f"b{i}") for i, b in enumerate(by)], x.alias("x"))))
    return packed["x"]


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def contains(items: Column, x: Column) -> Column:
    """Membership in a list; a list with nulls and no match gives false."""
    return F.coalesce(F.array_contains(items, x), F.lit(False))


def nulls_last(*names: str) -> list[Column]:
    """Orderings with nulls last; a leading minus means descending."""
    return [F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc_nulls_last() for n in names]


def text_filter(column: Column, q: str) -> Column:
    """Case-insensitive containment; % and _ in ``q`` are wildcards; '' means no filter."""
    return column.ilike(f"%{q}%") if q else F.lit(True)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col(rank) <= n)


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """One page of a totally ordered list, with the total of all rows beside each."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    number = max(number, 1)
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def page_count(total: int, size: int = 50) -> int:
    """Pages of a list; an empty list has one."""
    return max(1, -(-total // size))


def evenly_spaced(df: DataFrame, order: list[Column], n: int, m: int) -> DataFrame:
    """At most m rows of an ordered list of n, evenly spaced from the first."""
    stride = max(1, n // m)
    numbered = df.withColumn("__rn", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.where((F.col("__rn") % stride == 0) & (F.col("__rn") / stride < m)).drop("__rn")
