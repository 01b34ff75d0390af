"""Exploding computed arrays into rows.

``posexplode`` of an expression makes Catalyst infer a ``size(expr) > 0``
filter below the generator (InferFiltersFromGenerate), and that filter
evaluates the whole array expression again — a second tokenisation or a
second pass of vector maths per row. The outer generator has no inferred
filter; its extra row for an empty or null array has a null position and is
dropped, so null elements inside arrays are kept as they would be by
``posexplode``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def posexplode_rows(df: DataFrame, keep: Sequence[str | Column], arr: Column | str, pos: str = "pos",
                    value: str = "value") -> DataFrame:
    """(keep..., pos, value) for every element of ``arr``; nothing for empty/null arrays."""
    a = F.col(arr) if isinstance(arr, str) else arr
    out = df.select(*keep, F.posexplode_outer(a).alias(pos, value))
    return out.where(F.col(pos).isNotNull())


def explode_rows(df: DataFrame, keep: Sequence[str | Column], arr: Column | str, value: str = "value") -> DataFrame:
    """(keep..., value) for every element of ``arr``; nothing for empty/null arrays."""
    return posexplode_rows(df, keep, arr, "_pos", value).drop("_pos")
