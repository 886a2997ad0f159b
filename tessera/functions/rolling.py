"""Null-strict rolling expressions over (asset, date) panels."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, TIME = "asset", "date"


def trailing(n: int, key: str = KEY, time: str = TIME):
    return Window.partitionBy(key).orderBy(time).rowsBetween(-(n - 1), 0)


def ordered(key: str = KEY, time: str = TIME):
    return Window.partitionBy(key).orderBy(time)


def roll(f: Callable[[Column], Column], x: Column, n: int, least: int | None = None, **w) -> Column:
    """f over the last n rows; null unless ``least`` (default n) of them have a value."""
    win = trailing(n, **w)
    return F.when(F.count(x).over(win) >= (least or n), f(x).over(win))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clip that keeps nulls."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def lag(x: Column, n: int = 1, **w) -> Column:
    return F.lag(x, n).over(ordered(**w))


def log_return(x: Column, n: int = 1, **w) -> Column:
    return F.ln(F.try_divide(x, lag(x, n, **w)))


def zscore(x: Column, n: int, least: int | None = None, **w) -> Column:
    return ratio(x - roll(F.avg, x, n, least, **w), roll(F.stddev_samp, x, n, least, **w))


def ewm(x: Column, span: int, n: Column, key: str = KEY, time: str = TIME) -> Column:
    """Exponentially weighted mean, seeded with the first value, null before ``span`` values.

    ``n`` counts the values so far (1 at the first).  The closed form sums x_i w_i / (1-a)^(i-1)
    and is exact as long as (1-a)^-n is a finite double: about 5,300 rows at span 15, 7,000 at
    span 20; use :func:`ewm_long` beyond.
    """
    a = 2.0 / (span + 1)
    win = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    part = x * F.when(n == 1, F.lit(1.0)).otherwise(F.lit(a)) * F.pow(F.lit(1 - a), (1 - n).cast("double"))
    return F.when(x.isNotNull() & (n >= span), F.sum(part).over(win) * F.pow(F.lit(1 - a), (n - 1).cast("double")))


def ewm_long(rows: DataFrame, x: str, span: int, n: str, out: str, key: str = KEY, time: str = TIME) -> DataFrame:
    """rows and ``out``: :func:`ewm` for series of any length.

    The closed form holds in blocks of values over which (1-a) falls to 1e-150 at most, and the
    blocks' last values are folded; in the first block the result is that of :func:`ewm`.
    """
    a = 2.0 / (span + 1)
    size = max(1, int(150 * math.log(10) / -math.log(1 - a))) if a < 1 else 1
    keep, at = F.lit(1 - a), F.col("_r").cast("double")
    r = rows.withColumn("_b", F.floor((F.col(n) - 1) / size)).withColumn("_r", F.col(n) - 1 - F.col("_b") * size)
    block = Window.partitionBy(key, "_b").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    part = F.col(x) * F.when(F.col(n) == 1, F.lit(1.0)).otherwise(F.lit(a)) * F.pow(keep, -at)
    r = r.withColumn("_l", F.sum(part).over(block) * F.pow(keep, at))
    before = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_c", F.collect_list(F.when(F.col(x).isNotNull() & (F.col("_r") == size - 1), F.col("_l"))).over(before))
    carry = F.aggregate("_c", F.lit(0.0), lambda s, last: s * F.lit((1 - a) ** size) + last)
    value = F.when(F.size("_c") > 0, F.col("_l") + carry * F.pow(keep, at + 1)).otherwise(F.col("_l"))
    return r.withColumn(out, F.when(F.col(x).isNotNull() & (F.col(n) >= span), value)).drop("_b", "_r", "_l", "_c")


def hold(direction: Column, n: int, key: str = KEY, time: str = TIME) -> Column:
    """Carries a non-zero label forward over at most n - 1 rows."""
    if n <= 1:
        return direction
    return F.coalesce(F.last(F.nullif(direction, F.lit(0)), ignorenulls=True).over(trailing(n, key, time)), F.lit(0))


def run_length_gate(direction: Column, n: int, key: str = KEY, time: str = TIME) -> Column:
    """Keeps a direction only where the last n rows all have it."""
    return F.when(F.abs(roll(F.sum, direction, n, key=key, time=time)) >= n, direction).otherwise(0)
