"""User functions over batches and metric callbacks over predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch of rows; ``schema`` is that of its result.
    For what column expressions can't say."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield fn(batch)

    return df.mapInPandas(run, schema)


def metric_callbacks(pred: DataFrame, metrics: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each callback takes (label, pred) rows to one row with a ``value``;
    one row (metric, value) per callback."""
    out = None
    for name, fn in metrics.items():
        row = pred.transform(fn).select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no metrics")
    return out
