"""Analytics over a results table of (run, epoch, metric, hyperparameters).

Argmax family, parameter effects, pivots, convergence, learning curves,
leaderboards and set operations used to resume and prune evaluation work.
Every function is DataFrame -> DataFrame; ties are broken by an explicit
``ord`` column (file order), never by engine-dependent row order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.positions import frequency_quantiles, number_rows, running_max_before, with_previous
from runlens.operators.ranking import best_per_group, has_value, last_two_per_group, null_safe_join, top_n

# Fixed values of the analysis rules (must equal the reference's behaviour).
CONVERGENCE_THRESHOLD = 0.001
STATUS_IMPROVING = "Still improving"
STATUS_CONVERGED = "Converged"
STATUS_OVERFITTING = "Overfitting"
TEACHER_LAYERS = 12


# ---------------------------------------------------------------- filters (F)

def final_epoch_rows(df: DataFrame, epoch: str = "epoch") -> DataFrame:
    """rows whose epoch equals the table-wide maximum (scalar subquery)."""
    return df.where(F.col(epoch) == df.select(F.max(epoch)).scalar())


def multi_row_groups(df: DataFrame, key: str) -> DataFrame:
    """keep the groups that have more than one row (aggregate + semi join,
    no per-group window); the null group is a group."""
    multi = df.groupBy(key).count().where(F.col("count") > 1).select(key)
    return null_safe_join(df, multi, [key], "left_semi")


# ---------------------------------------------------------- aggregations (A)

def run_profile(df: DataFrame, run: str = "run_name") -> DataFrame:
    """Rows, distinct runs and describe() of rows-per-run, in one scan: all of it
    follows from how many runs have how many rows."""
    per_run = df.groupBy(run).agg(F.count(F.lit(1)).cast("double").alias("rows"))
    freq = per_run.groupBy("rows").agg(F.count(F.lit(1)).alias("runs"))
    n, total = F.sum("runs"), F.sum(F.col("rows") * F.col("runs"))
    spread = F.sum(F.col("rows") * F.col("rows") * F.col("runs")) - total * total / n  # whole numbers: no cancellation below 2^53
    stats = [total.cast("bigint").alias("n_rows"), n.alias("n_runs"), (total / n).alias("mean"),
             F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))).alias("std"), F.min("rows").alias("min"), F.max("rows").alias("max")]
    return frequency_quantiles(freq, "rows", "runs", [0.25, 0.5, 0.75], ["q25", "q50", "q75"], stats)


def best_overall(df: DataFrame, metric: str = "metric", tiebreak: str = "ord") -> DataFrame:
    """The single best row; the first row in file order on ties. Null and NaN can't win."""
    return top_n(df.where(has_value(F.col(metric))), [F.col(metric).desc(), F.col(tiebreak).asc()], 1)


def best_per(df: DataFrame, keys: Sequence[str], metric: str = "metric", tiebreak: str = "ord") -> DataFrame:
    """Best row per group (run, epoch, size, beta...)."""
    return best_per_group(df, keys, metric, tiebreak)


def param_effect(df: DataFrame, params: Sequence[str], metric: str = "metric",
                 epoch: str = "epoch") -> DataFrame:
    """Mean metric per value of each hyperparameter on final-epoch rows,
    long form (param, value, mean_metric, n_rows)."""
    final = final_epoch_rows(df, epoch)
    parts = [final.groupBy(F.lit(p).alias("param"), F.col(p).cast("string").alias("value"))
             .agg(F.avg(metric).alias("mean_metric"), F.count(F.lit(1)).alias("n_rows"))
             for p in params]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def occurring(df: DataFrame, column: str) -> list:
    """The values of a hyperparameter column, in order: one small job."""
    return sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)


def pivot_agg(df: DataFrame, index: str, column: str, values: Sequence, metric: str,
              agg: str = "avg", names: Mapping | None = None) -> DataFrame:
    """``groupBy(index).pivot(column, values)`` aggregated by ``agg``;
    ``values`` are those that occur (``occurring``), so none is lost."""
    g = df.groupBy(index).pivot(column, list(values))
    out = getattr(g, {"avg": "avg", "mean": "avg", "max": "max", "min": "min", "sum": "sum"}[agg])(metric)
    if names:
        out = out.withColumnsRenamed({str(k): v for k, v in names.items()})
    return out


def smallest_matching(best_by_size: DataFrame, baseline: Column, size: str = "size",
                      best: str = "best", teacher_layers: int = TEACHER_LAYERS) -> DataFrame:
    """Smallest size whose best metric reaches the baseline, with the
    compression percentage (teacher - k) / teacher * 100; no row if none."""
    hit = best_by_size.where(F.col(best) >= baseline).agg(F.min(size).alias("smallest_size"))
    return hit.where(F.col("smallest_size").isNotNull()).select(
        "smallest_size",
        ((F.lit(teacher_layers) - F.col("smallest_size")) / F.lit(teacher_layers) * 100).alias("compression_pct"))


def running_best(df: DataFrame, partition: str, order: Sequence[str], metric: str) -> DataFrame:
    """Running champion; a row replaces the champion only when strictly
    better than every earlier row of its run (segmented scan, no per-run window)."""
    out = running_max_before(df, partition, order, metric, "prev_best")
    better = F.col("prev_best").isNull() | (F.col(metric) > F.col("prev_best"))
    return out.withColumn("is_new_best", has_value(F.col(metric)) & better)


# ------------------------------------------------------------ windows (W)

def convergence_status(df: DataFrame, run: str = "run_name", epoch: str = "epoch",
                       ord_col: str = "ord", metric: str = "metric",
                       threshold: float = CONVERGENCE_THRESHOLD) -> DataFrame:
    """Last versus second-last epoch of every run with >= 2 rows.

    delta > t -> improving; |delta| < t -> converged; otherwise overfitting
    (so delta == +t exactly is overfitting). Double arithmetic throughout."""
    lt = last_two_per_group(df, run, [epoch, ord_col], metric).where(F.col("n_top") >= 2)
    delta = F.col("last_value") - F.col("prev_value")
    status = (F.when(delta > threshold, STATUS_IMPROVING)
              .when(F.abs(delta) < threshold, STATUS_CONVERGED)
              .otherwise(STATUS_OVERFITTING))
    return lt.select(run, F.col(f"last_{epoch}").alias("last_epoch"), F.col(f"prev_{epoch}").alias("prev_epoch"),
                     F.col("last_value").alias("last_metric"), F.col("prev_value").alias("prev_metric"),
                     delta.alias("delta"), status.alias("status"))


def leaderboard(df: DataFrame, metric: str, tiebreak: str, name: str = "rank") -> DataFrame:
    """1-based rank by metric descending, earlier row first on ties, null and NaN
    behind all others; numbered without a single-task window."""
    rated = df.withColumn("_rated", F.when(has_value(F.col(metric)), F.col(metric)))
    out = number_rows(rated, ["-_rated", tiebreak], name="_r")
    return out.withColumn(name, F.col("_r") + 1).drop("_r", "_rated")


def learning_curves(df: DataFrame, run: str, epoch: str, ord_col: str, params: Sequence[str]) -> DataFrame:
    """Multi-epoch runs with the hyperparameters of each run's first row (the null run is a run)."""
    fields = [F.col(c).alias(f"_{i}") for i, c in enumerate([epoch, ord_col, *params])]
    first = df.groupBy(run).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*fields)).alias("_first"))
    first = first.where(F.col("_n") > 1).select(run, *[F.col(f"_first._{i + 2}").alias(f"{p}_first") for i, p in enumerate(params)])
    return null_safe_join(df, first, [run])


def param_impact(df: DataFrame, group: str, x: str, metric: str, epoch: str = "epoch") -> DataFrame:
    """Mean metric per (group, x) on final-epoch rows plus plot bounds
    min * 0.98 and max * 1.01 of the series."""
    final = final_epoch_rows(df, epoch)
    series = final.groupBy(group, x).agg(F.avg(metric).alias("mean_metric"))
    bounds = series.agg((F.min("mean_metric") * 0.98).alias("y_lo"), (F.max("mean_metric") * 1.01).alias("y_hi"))
    return series.select("*", bounds.select("y_lo").scalar().alias("y_lo"),
                         bounds.select("y_hi").scalar().alias("y_hi"))


def adaptive_top_n(df: DataFrame, metric: str, tiebreak: str, lo: int = 3, hi: int = 4) -> DataFrame:
    """n = min(hi, max(lo, rows // 3)) largest rows. n is at most ``hi``,
    so the candidates are a bounded top-``hi`` before the count is applied."""
    n = F.least(F.lit(hi), F.greatest(F.lit(lo), F.floor(df.select(F.count(F.lit(1))).scalar() / 3)))
    head = top_n(df.where(has_value(F.col(metric))), [F.col(metric).desc(), F.col(tiebreak).asc()], hi)
    w = Window.orderBy(F.col(metric).desc(), F.col(tiebreak).asc())  # at most `hi` rows
    return head.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def chain_degradation(df: DataFrame, chain: str, order: Sequence[str], metric: str) -> DataFrame:
    """Change of the metric from the previous stage and from the root, in one read of the rows."""
    j = with_previous(df, chain, order, metric, "_prev", "_root", "_i")
    return j.select(*df.columns, (F.col("_i") + 1).cast("int").alias("stage"),
                    (F.col(metric) - F.col("_prev")).alias("delta_prev"),
                    (F.col(metric) - F.col("_root")).alias("delta_root"))


# ------------------------------------------------------------- joins (J)

def resume_anti(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items not already evaluated; a null key equals a null key."""
    return null_safe_join(todo, done.select(*keys), keys, "left_anti")


def tier2_semi(rows: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """All rows of the selected runs. ``selected`` is a bounded top-n, so
    broadcasting it is safe."""
    return rows.join(F.broadcast(selected.select(key).distinct()), key, "left_semi")


def strategy_compare(a: DataFrame, b: DataFrame, key: str, value: str,
                     a_name: str = "LAST", b_name: str = "SKIP") -> DataFrame:
    """Per common key: both values, difference a - b, relative % and winner."""
    j = (a.select(key, F.col(value).alias("a_value"))
         .join(b.select(key, F.col(value).alias("b_value")), key))
    diff = F.col("a_value") - F.col("b_value")
    return j.select(key, "a_value", "b_value", diff.alias("diff"),
                    F.try_divide(diff, F.col("b_value")).alias("_r"),
                    F.when(diff > 0, a_name).when(diff < 0, b_name).otherwise("TIE").alias("winner")) \
        .withColumn("rel_pct", F.col("_r") * 100).drop("_r")


def vs_baseline(groups: DataFrame, value: str, baseline: Column) -> DataFrame:
    """Every group's best against one scalar baseline (absolute, relative %)."""
    return groups.select("*", baseline.alias("baseline"),
                         (F.col(value) - baseline).alias("gain"),
                         (F.try_divide(F.col(value) - baseline, baseline) * 100).alias("gain_pct"))


def union_tagged(frames: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Concatenate tables, tagging each with a constant column."""
    out = None
    for name, df in frames.items():
        t = df.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
