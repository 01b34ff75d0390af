"""Experiment statistics: gain tables, paired tests, effect sizes, intervals,
dataset profiles, Pareto frontiers, composite selection, agreement between
methods, regressions and decision rules. Moments come from aggregates; only
the t quantile runs in a scalar pandas UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.stats import t_quantile_udf, two_sided_p
from runlens.operators.positions import cut_blocks
from runlens.operators.ranking import has_value, null_safe_join
from runlens.session import scratch_path, ship

# Fixed weights of the composite model score (accuracy, similarity, size, time).
COMPOSITE_WEIGHTS = (0.4, 0.3, 0.2, 0.1)


def gain_table(df: DataFrame, dataset: str, method: str, metric: str,
               baseline: str = "baseline", treated: str = "distilled") -> DataFrame:
    """Mean metric per dataset and method side by side, gain and gain %."""
    p = df.groupBy(dataset).pivot(method, [baseline, treated]).avg(metric)
    return p.withColumns({"gain": F.col(treated) - F.col(baseline),
                          "gain_pct": F.try_divide(F.col(treated) - F.col(baseline), F.col(baseline)) * 100})


def paired_t(gains: DataFrame, gain: str = "gain") -> DataFrame:
    """Paired t-test on per-dataset differences: n, t, df, two-sided p."""
    m = gains.agg(F.count(gain).alias("n"), F.avg(gain).alias("_m"), F.stddev_samp(gain).alias("_s"))
    t = F.try_divide(F.col("_m"), F.col("_s") / F.sqrt(F.col("n")))
    out = m.select("n", t.alias("t"), (F.col("n") - 1).alias("df"))
    return out.withColumn("p_value", two_sided_p(F.col("t"), F.col("df")))


def effect_size(gains: DataFrame, baseline: str = "baseline", treated: str = "distilled",
                gain: str = "gain") -> DataFrame:
    """(mean treated - mean baseline) / std(gain)."""
    return gains.agg(F.try_divide(F.avg(treated) - F.avg(baseline), F.stddev_samp(gain)).alias("effect_size"))


def mean_ci(gains: DataFrame, gain: str = "gain", level: float = 0.95) -> DataFrame:
    """Mean gain with a t-based confidence interval (t quantile x SEM)."""
    m = gains.agg(F.count(gain).alias("n"), F.avg(gain).alias("mean_gain"), F.stddev_samp(gain).alias("_s"))
    q = t_quantile_udf(F.lit(0.5 + level / 2), (F.col("n") - 1).cast("double"))
    half = q * F.col("_s") / F.sqrt(F.col("n"))
    return m.select("n", "mean_gain", (F.col("mean_gain") - half).alias("ci_lo"),
                    (F.col("mean_gain") + half).alias("ci_hi"))


def dataset_profile(df: DataFrame, dataset: str, length: str, cls: str) -> DataFrame:
    """Size, mean text length and the std of class counts per dataset (the null dataset is one)."""
    sizes = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(length).alias("mean_len"))
    cc = df.groupBy(dataset, cls).agg(F.count(F.lit(1)).alias("_c"))
    std = cc.groupBy(dataset).agg(F.stddev_samp("_c").alias("class_count_std"))
    return null_safe_join(sizes, std, [dataset])


def class_entropy(df: DataFrame, dataset: str, cls: str) -> DataFrame:
    """Number of classes and the natural-log entropy of class shares (the null dataset is one)."""
    cc = df.groupBy(dataset, cls).agg(F.count(F.lit(1)).alias("_c"))
    tot = cc.groupBy(dataset).agg(F.sum("_c").alias("_t"))
    p = null_safe_join(cc, tot, [dataset]).withColumn("_p", F.col("_c") / F.col("_t"))
    return p.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_classes"),
                                  (-F.sum(F.col("_p") * F.log(F.col("_p")))).alias("entropy"))


def pareto_front_grid(df: DataFrame, maximize: str, grid_max: str, grid_min: str) -> DataFrame:
    """Rows not dominated when maximising ``maximize`` and ``grid_max``
    and minimising ``grid_min`` (identical rows do not dominate each other).

    ``grid_max`` and ``grid_min`` must be integers of bounded range: a row is
    dominated iff some row in a strictly better (grid_min, grid_max) cell has
    a value >= its own, or a row of its own cell a strictly larger one. The
    best value of every cell region is a two-pass cumulative maximum over the
    grid, whose size is the product of the two ranges and not the row count;
    rows are only joined with the grid."""
    cells = df.groupBy(grid_min, grid_max).agg(F.max(maximize).alias("_cell"))
    bounds = df.agg(F.min(grid_min).alias("_a0"), F.max(grid_min).alias("_a1"),
                    F.min(grid_max).alias("_b0"), F.max(grid_max).alias("_b1"))
    grid = (bounds.select(F.explode(F.sequence("_a0", "_a1")).alias(grid_min), "_b0", "_b1")
            .select(grid_min, F.explode(F.sequence("_b0", "_b1")).alias(grid_max)))
    g = grid.join(cells, [grid_min, grid_max], "left")
    w_row = Window.partitionBy(grid_min).orderBy(F.col(grid_max).desc()).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("_r", F.max("_cell").over(w_row))  # best with grid_max >= b, same grid_min
    w_col = Window.partitionBy(grid_max).orderBy(F.col(grid_min)).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("_m", F.max("_r").over(w_col))  # best with grid_min <= a and grid_max >= b
    prev_a = F.lag("_m").over(Window.partitionBy(grid_max).orderBy(grid_min))
    prev_b = F.lag("_m").over(Window.partitionBy(grid_min).orderBy(F.col(grid_max).desc()))
    g = g.select(grid_min, grid_max, "_cell", F.greatest(prev_a, prev_b).alias("_better"))
    j = df.join(g, [grid_min, grid_max])
    dominated = (F.coalesce(F.col("_better") >= F.col(maximize), F.lit(False))
                 | (F.col("_cell") > F.col(maximize)))
    return j.where(~dominated).drop("_cell", "_better")


def _once(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _best_rows(x: np.ndarray) -> np.ndarray:
    """The rows (larger is better) that no other row dominates, each once."""
    x = np.unique(x, axis=0) if x.shape[1] else x[:1]
    best: list[int] = []
    for i in np.argsort(-x.sum(axis=1), kind="stable").tolist():  # what dominates a row has a larger sum
        if not (x[best] >= x[i]).all(axis=1).any():
            best.append(i)
    return x[best]


def pareto_front(df: DataFrame, maximize: Sequence[str], minimize: Sequence[str] = (), block: int = 2048) -> DataFrame:
    """N07 for any numeric objectives: rows that no row dominates (identical rows
    don't dominate each other; rows with a null or NaN objective are left out).

    Whether a row is dominated depends on its objectives alone. Each task keeps
    the best of its distinct objective tuples; what is left is cut into blocks along
    the objectives, best first. A tuple can only be dominated by one of its own block or of an earlier
    one, and of the earlier ones, which are no worse in the first objective, only the others count: each
    block needs the front of the other objectives over all blocks before it. These fronts come from a scan
    in log2(blocks) rounds, in each of which a block meets one other. Every front is written once."""
    names = [*maximize, *minimize]
    d = len(names)
    ok = F.lit(True)
    for c in names:
        ok = ok & has_value(F.col(c))
    signed = [F.col(c).cast("double") * F.lit(1.0 if i < len(maximize) else -1.0) + F.lit(0.0) for i, c in enumerate(names)]  # no -0.0
    rows = df.where(ok).withColumns({f"_s{i}": x for i, x in enumerate(signed)})
    axes = [f"_s{i}" for i in range(d)]
    shape = ", ".join(f"{a} double" for a in axes)
    others = axes[1:]
    ship(df.sparkSession)
    best = _best_rows

    def local(batches):
        kept = np.empty((0, d))
        for batch in batches:
            kept = best(np.vstack([kept, batch[axes].to_numpy(float)]))
        yield pd.DataFrame(kept, columns=axes)

    left = _once(rows.select(*axes).distinct().mapInPandas(local, shape), "pareto-local").distinct()
    blocks, sizes = cut_blocks(left, [f"-{a}" for a in axes], rows=block)
    own = _once(blocks.groupBy("_block").applyInPandas(
        lambda key, part: pd.DataFrame(best(part[axes].to_numpy(float)), columns=axes).assign(_block=key[0]), f"{shape}, _block long"), "pareto-blocks")
    if len(sizes) > 1:
        place = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(sorted(sizes))), "_i long, _block long"))  # a row per block
        own = own.join(place, "_block").drop("_block")
        flat = "_i long, _none int" + "".join(f", {a} double" for a in others)

        def others_best(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(best(part[others].to_numpy(float)), columns=others).assign(_i=key[0], _none=0)[["_i", "_none", *others]]

        before = _once(own.withColumns({"_i": F.col("_i") + 1, "_none": F.lit(0)}).groupBy("_i").applyInPandas(others_best, flat), "pareto-scan")
        step = 1
        while step < len(sizes):
            both = before.unionByName(before.withColumn("_i", F.col("_i") + step)).where(F.col("_i") < len(sizes))
            before = _once(both.groupBy("_i").applyInPandas(others_best, flat), "pareto-scan")
            step *= 2

        def undominated(mine: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
            x, y = mine[others].to_numpy(float), earlier[others].to_numpy(float)
            free = [i for i in range(len(x)) if not (y >= x[i]).all(axis=1).any()]
            return mine[axes].iloc[free]

        own = own.groupBy("_i").cogroup(before.groupBy("_i")).applyInPandas(undominated, shape)
    return rows.join(own.select(*axes), axes, "left_semi").drop(*axes)


def composite_select(df: DataFrame, acc: str, sim: str, params: str, time: str, key: str,
                     requirements: Mapping[str, float], n: int = 5,
                     weights: Sequence[float] = COMPOSITE_WEIGHTS) -> DataFrame:
    """Candidates meeting the requirements, ranked by
    w0*acc + w1*sim + w2*(1 - params/max params) + w3*(1 - time/max time)."""
    c = df.where((F.col(params) <= requirements["max_params"]) & (F.col(acc) >= requirements["min_accuracy"])
                 & (F.col(sim) >= requirements["min_similarity"]) & (F.col(time) <= requirements["max_time"]))
    maxp = c.select(F.max(params)).scalar()
    maxt = c.select(F.max(time)).scalar()
    w0, w1, w2, w3 = weights
    score = (w0 * F.col(acc) + w1 * F.col(sim) + w2 * (1 - F.col(params) / maxp) + w3 * (1 - F.col(time) / maxt))
    return c.withColumn("score", score).orderBy(F.col("score").desc(), F.col(key)).limit(n)


def _corr(a: str, b: str) -> Column:
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def correlation_matrix(df: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of method columns, computed as
    one aggregate over the wide rows (no pairs of rows are formed); null when
    a method is constant."""
    pairs = list(combinations(methods, 2))
    agg = df.agg(*[_corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    long = agg.unpivot([], [f"{a}__{b}" for a, b in pairs], "_pair", "corr")
    parts = F.split("_pair", "__")
    return long.select(F.get(parts, 0).alias("method_a"), F.get(parts, 1).alias("method_b"), "corr")


def stability(df: DataFrame, group: str, methods: Sequence[str]) -> DataFrame:
    """Per row the sample std of the methods' scores, averaged per group."""
    arr = F.array(*[F.col(m) for m in methods])
    k = float(len(methods))
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / k
    ss = F.aggregate(F.zip_with(arr, F.array_repeat(mean, len(methods)), lambda x, m: (x - m) * (x - m)),
                     F.lit(0.0), lambda a, x: a + x)
    return df.select(group, F.sqrt(ss / (k - 1)).alias("_sd")).groupBy(group).agg(F.avg("_sd").alias("stability"))


def slope(df: DataFrame, group: str, y: str, x: str) -> DataFrame:
    """Least-squares slope, intercept and R^2 of y on x per group."""
    return df.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                                 F.regr_r2(y, x).alias("r2"))


def drivers_correlation(profile: DataFrame, characteristics: Sequence[str], target: str) -> DataFrame:
    """Correlation of each dataset characteristic with the target."""
    agg = profile.agg(*[_corr(c, target).alias(c) for c in characteristics])
    return agg.unpivot([], list(characteristics), "characteristic", "corr")


def decision_rules(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Nested conditions, the first matching rule wins."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)
