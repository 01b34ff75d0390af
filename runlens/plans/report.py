"""Text reports as long DataFrames of (section_no, section, ord, line), formatted
with built-in expressions. ``write_report`` writes one as text files in report order.

``report_lines`` lists every run, epoch and evaluation of a results table;
``comparison_lines`` sets two strategies against each other and a baseline. Lines of
sections that grow with the table are numbered by ``number_rows``; evaluations are ranked
once, the order of the runs follows from their best evaluation's rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators import runs as R
from runlens.operators.positions import number_rows
from runlens.operators.ranking import best_per_group, has_value


def _fmt4(c) -> Column:
    return F.format_string("%.4f", F.round(c, 4))


def _signed(c, digits: int = 4) -> Column:
    return F.format_string(f"%+.{digits}f", F.round(c, digits))


def _section(df: DataFrame, no: int, name: str, order: Column, line: Column) -> DataFrame:
    return df.select(F.lit(no).alias("section_no"), F.lit(name).alias("section"), order.cast("int").alias("ord"), line.alias("line"))


def _lines(df: DataFrame, *lines: Column) -> DataFrame:
    """A row per line of a one-row table."""
    return df.select(F.posexplode(F.array(*lines)).alias("ord", "line"))


def _all(sections: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sections)


def _effect(final: DataFrame, param: str, no: int) -> DataFrame:
    eff = final.groupBy(param).agg(F.avg("metric").alias("m"))
    place = F.row_number().over(Window.orderBy(F.col("m").desc(), param))  # one row per value of a hyperparameter
    return _section(eff, no, f"{param}_effect", place, F.format_string(f"{param}=%s: %s", F.col(param), _fmt4(F.col("m"))))


def report_lines(runs: DataFrame) -> DataFrame:
    """The report of a results table (run_name, epoch, metric, alpha, temperature, ord and, if it has one, loss).
    Effects of hyperparameters are means over the final epoch."""
    if "loss" not in runs.columns:
        runs = runs.withColumn("loss", F.lit(None).cast("double"))
    loss = F.when(F.col("loss").isNotNull(), F.concat(F.lit(", loss "), _fmt4(F.col("loss")))).otherwise("")
    overview = _lines(runs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_name").alias("k")),
                      F.format_string("Total evaluations: %d", "n"), F.format_string("Runs: %d", "k"))
    best = F.format_string("Best metric: %s (%s, epoch %d%s)", _fmt4(F.col("metric")), F.col("run_name"), F.col("epoch"), loss)
    rated = runs.withColumn("_rated", F.when(has_value(F.col("metric")), F.col("metric")))
    rows = runs.count()
    every = number_rows(rated, ["-_rated", "ord"], name="_i", at_most=rows).withColumn("_i", F.col("_i") + 1)
    first = F.min(F.struct("_i", "epoch", "metric", "loss")).alias("s")
    per_run = every.where("_rated IS NOT NULL").groupBy("run_name").agg(first).select("run_name", "s.*")
    per_run = number_rows(per_run, ["_i"], name="_p", at_most=rows).withColumn("_p", F.col("_p") + 1)
    status = R.convergence_status(runs)
    conv = number_rows(status, ["run_name"], name="_i", at_most=rows).withColumn("_i", F.col("_i") + 1)
    counts = status.groupBy("status").count()
    final = R.final_epoch_rows(runs)
    return _all([
        _section(overview, 1, "overview", F.col("ord"), F.col("line")),
        _section(R.best_overall(runs), 1, "overview", F.lit(2), best),
        _section(per_run, 2, "best_per_run", F.col("_p"), F.format_string(
            "%d. %s epoch %d: %s%s", F.col("_p"), F.col("run_name"), F.col("epoch"), _fmt4(F.col("metric")), loss)),
        _section(R.best_per(runs, ["epoch"]), 3, "best_per_epoch", F.col("epoch"), F.format_string(
            "epoch %d: %s alpha=%s temperature=%s: %s", F.col("epoch"), F.col("run_name"), F.col("alpha"), F.col("temperature"),
            _fmt4(F.col("metric")))),
        _effect(final, "alpha", 4),
        _effect(final, "temperature", 5),
        _section(every, 6, "all_evaluations", F.col("_i"), F.format_string(
            "%d. %s epoch %d alpha=%s temperature=%s: %s", F.col("_i"), F.col("run_name"), F.col("epoch"), F.col("alpha"),
            F.col("temperature"), _fmt4(F.col("metric")))),
        _section(conv, 7, "convergence", F.col("_i"), F.format_string(
            "%s: epoch %d %s -> epoch %d %s, change %s (%s)", F.col("run_name"), F.col("prev_epoch"), _fmt4(F.col("prev_metric")),
            F.col("last_epoch"), _fmt4(F.col("last_metric")), _signed(F.col("delta")), F.col("status"))),
        _section(counts, 8, "convergence_summary", F.row_number().over(Window.orderBy("status")),  # at most three statuses
                 F.format_string("%s: %d", F.col("status"), F.col("count"))),
    ])


def comparison_lines(rows: DataFrame, first: str, second: str, baseline: str, baseline_size: int, beta: str) -> DataFrame:
    """Two strategies (rows of strategy, size, beta, metric, ord) against a baseline and each other: best per size
    at one ``beta``, best per beta, differences, winners, and the smallest size that reaches the baseline."""
    a_name, b_name = first.upper(), second.upper()
    base = rows.where((F.col("strategy") == baseline) & (F.col("size") == baseline_size)).agg(F.max("metric").alias("base"))
    at_beta = rows.where(F.col("beta") == beta)
    best = best_per_group(at_beta.where(F.col("strategy").isin(first, second)), ["strategy", "size"], "metric", "ord").withColumn("base", base.scalar())
    gain = F.col("metric") - F.col("base")
    against = F.when(F.col("base").isNotNull(), F.concat(F.lit(", vs baseline "), _signed(gain), F.lit(" ("), _signed(
        F.try_divide(gain, F.col("base")) * 100, 2), F.lit("%)"))).otherwise("")
    per_size = F.format_string("size %d: %s (ord %d)%s", F.col("size"), _fmt4(F.col("metric")), F.col("ord"), against)
    per_beta = best_per_group(rows.where(F.col("strategy") == second), ["beta"], "metric", "ord")
    both = R.strategy_compare(*[best.where(F.col("strategy") == s).select("size", "metric") for s in (first, second)], "size", "metric", a_name, b_name)
    wins = both.agg(*[F.count_if(F.col("winner") == w).alias(w) for w in (a_name, b_name, "TIE")])
    mine = best.where(F.col("strategy") == first)
    top = mine.agg(F.max_by(F.struct("size", "metric"), F.struct("metric", -F.col("size"))).alias("s"))
    reach = R.smallest_matching(mine.select("size", F.col("metric").alias("best")), base.scalar())
    down = -F.col("size")  # the larger first
    return _all([
        _section(base.where("base IS NOT NULL"), 1, "baseline", F.lit(0), F.format_string(
            "%s size %d: %s", F.lit(baseline), F.lit(baseline_size), _fmt4(F.col("base")))),
        _section(mine, 2, f"best_{first}", down, per_size),
        _section(best.where(F.col("strategy") == second), 3, f"best_{second}", down, per_size),
        _section(per_beta, 4, "best_per_beta", F.row_number().over(Window.orderBy("beta")),  # one row per beta
                 F.format_string("beta=%s: size %d: %s (ord %d)", F.col("beta"), F.col("size"), _fmt4(F.col("metric")), F.col("ord"))),
        _section(both, 5, "comparison", down, F.format_string(
            f"size %d: {a_name} %s, {b_name} %s, difference %s (%s%%), winner %s", F.col("size"), _fmt4(F.col("a_value")), _fmt4(F.col("b_value")),
            _signed(F.col("diff")), _signed(F.col("rel_pct"), 2), F.col("winner"))),
        _section(top.where("s IS NOT NULL"), 6, "findings", F.lit(0), F.format_string(
            f"best {a_name} model: size %d (%s)", F.col("s.size"), _fmt4(F.col("s.metric")))),
        _section(wins, 6, "findings", F.lit(1), F.format_string(
            f"wins: {a_name} %d, {b_name} %d, ties %d", F.col(a_name), F.col(b_name), F.col("TIE"))),
        _section(reach, 6, "findings", F.lit(2), F.format_string(
            f"smallest {a_name} size that reaches the baseline: %d (%s%% smaller)", F.col("smallest_size"),
            F.format_string("%.1f", F.col("compression_pct").cast("double")))),
    ])


def write_report(lines: DataFrame, path: str) -> None:
    """Text files whose names sort in report order."""
    lines.orderBy("section_no", "ord").select("line").write.mode("overwrite").text(path)
