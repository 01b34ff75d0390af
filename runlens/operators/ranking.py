"""Argmax and top-n without single-task windows (numbers and carries are in ``positions``).

* ``best_per_group`` aggregates ``max(struct(...))``: the partial aggregate runs
  before the shuffle (Spark sorts each task's rows for a struct buffer), so a
  group holding a third of all rows sends one struct per task.
* ``last_two_per_group`` keeps two rows per group with a window limit that Spark
  also places before the shuffle.

Null groups are groups like any other; joins on group keys are null-safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has_value(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the keys appear once."""
    if not keys:
        raise ValueError("no keys")
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_right_{k}"])
    return left.join(right, on, how).drop(*[f"_right_{k}" for k in keys])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by ``order``, then by the other columns."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    first = F.min(F.struct(*[F.col(c) for c in lead], *[F.col(c) for c in rest if c not in lead]) if rest else F.lit(1)).alias("_first")
    out = df.groupBy(*keys).agg(first)
    return out.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def best_per_group(df: DataFrame, keys: Sequence[str], metric: str, tiebreak: str,
                   descending: bool = True, carry: Sequence[str] | None = None) -> DataFrame:
    """Row with the highest (or lowest) ``metric`` per group; on ties the row with
    the smallest ``tiebreak`` wins (first row in file order). Null and NaN
    metrics can't win; a group that has nothing else gives no row."""
    df = df.where(has_value(F.col(metric)))
    carry = [c for c in (carry if carry is not None else df.columns) if c not in keys]
    m = F.col(metric) if descending else -F.col(metric)
    rest = [c for c in carry if c not in (metric, tiebreak)]
    best = F.max(F.struct(m.alias("_m"), (-F.col(tiebreak)).alias("_t"),
                          *[F.col(c) for c in rest], F.col(metric).alias("_metric"),
                          F.col(tiebreak).alias("_tb"))).alias("_best")
    out = df.groupBy(*keys).agg(best)
    sel = [F.col(k) for k in keys] + [F.col(f"_best.{c}").alias(c) for c in rest]
    if metric in carry:
        sel.append(F.col("_best._metric").alias(metric))
    if tiebreak in carry:
        sel.append(F.col("_best._tb").alias(tiebreak))
    return out.select(*sel)


def last_two_per_group(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Per group: the last and second-last ``value`` in ``order`` (descending
    rank 1 and 2).

    ``row_number() <= 2`` lets Spark place a partial WindowGroupLimit before
    the shuffle, so each task forwards at most two rows per group (a hot group
    costs two rows per task), and the final limit and the pivot to one row run
    after a single exchange. Output: key, n_top (1 or 2), last_<order...>,
    prev_<order...>, last_value, prev_value (null when the group has one row)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    top = df.select(key, *order, value, F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= 2)
    at = lambda r, c: F.max(F.when(F.col("_rn") == r, F.col(c)))
    return top.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_top"),
        *[at(n, c).alias(f"{which}_{c}") for n, which in ((1, "last"), (2, "prev")) for c in order],
        at(1, value).alias("last_value"), at(2, value).alias("prev_value"))


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows in a total order: a bounded top-k per task, then a merge."""
    return df.orderBy(*order).limit(n)
