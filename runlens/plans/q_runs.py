"""Queries over the results-table views: argmax family, pivots, convergence,
leaderboards, filters and the joins used to resume and prune work."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions.arrays import explode_rows
from runlens.operators import runs as R
from runlens.operators.ranking import best_per_group
from runlens.plans.registry import query
from runlens.plans.sql_views import PATHS, RUNS, STRATEGIES
from runlens.sources import bindings as B
from runlens.sources.tables import read_table


def r6(c):
    return F.round(c, 6)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIORITY_COLS = {p: "a_" + p.split("-")[0] for p in PRIORITIES}


# ------------------------------------------------------------------ F

@query("f01_final_epoch", f"WITH {RUNS} SELECT run_name, epoch, metric, ord FROM runs "
       "WHERE epoch = (SELECT max(epoch) FROM runs)")
def f01(spark, d):
    return R.final_epoch_rows(B.runs(spark, d)).select("run_name", "epoch", "metric", "ord")


@query("f02_step_epoch", f"""WITH {PATHS}
SELECT l_orderkey, l_linenumber, l_partkey, path, step, CAST(step // 1325 AS INTEGER) AS epoch
FROM (SELECT *, CAST(regexp_extract(path, 'checkpoint-([0-9]+)$', 1) AS INTEGER) AS step FROM paths)
WHERE step = 5300""")
def f02(spark, d):
    p = B.checkpoint_paths(spark, d).withColumn(
        "step", F.regexp_extract("path", r"checkpoint-([0-9]+)$", 1).cast("int"))
    return p.where(F.col("step") == 5300).withColumn("epoch", F.expr("step div 1325").cast("int"))


@query("f03_name_contains", r"""SELECT p_partkey, p_name, regexp_matches(p_name, '^red\b') AS word_match
FROM part WHERE contains(p_name, 'red')""")
def f03(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_name")
    return p.where(F.col("p_name").contains("red")).withColumn(
        "word_match", F.col("p_name").rlike(r"^red\b"))


@query("f04_multi_row_groups", f"""WITH {RUNS}
SELECT run_name, epoch, metric, ord FROM runs
WHERE run_name IN (SELECT run_name FROM runs GROUP BY run_name HAVING count(*) > 1)""")
def f04(spark, d):
    return R.multi_row_groups(B.runs(spark, d), "run_name").select("run_name", "epoch", "metric", "ord")


@query("f05_fixed_param", f"""WITH {STRATEGIES}
SELECT l_orderkey, l_partkey, size, beta, metric FROM strategies
WHERE strategy = 'skip' AND size = 3 AND beta = 'F'""")
def f05(spark, d):
    s = B.strategies(spark, d)
    return s.where((F.col("strategy") == "skip") & (F.col("size") == 3) & (F.col("beta") == "F")).select(
        "l_orderkey", "l_partkey", "size", "beta", "metric")


# ------------------------------------------------------------------ A

@query("a01_run_profile", f"""WITH {RUNS}, per AS (SELECT run_name, CAST(count(*) AS DOUBLE) AS c FROM runs GROUP BY run_name)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_runs, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS std,
       min(c) AS min, max(c) AS max, round(quantile_cont(c, 0.25), 6) AS q25, round(quantile_cont(c, 0.5), 6) AS q50,
       round(quantile_cont(c, 0.75), 6) AS q75 FROM per""")
def a01(spark, d):
    p = R.run_profile(B.runs_by_id(spark, d), "run_id")
    return p.select("n_rows", "n_runs", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"),
                    "min", "max", *[r6(F.col(q)).alias(q) for q in ("q25", "q50", "q75")])


@query("a02_best_overall", f"WITH {RUNS} SELECT run_name, epoch, metric, ord FROM runs ORDER BY metric DESC, ord LIMIT 1")
def a02(spark, d):
    return R.best_overall(B.runs(spark, d)).select("run_name", "epoch", "metric", "ord")


@query("a03_best_per_run", f"""WITH {RUNS}
SELECT run_name, epoch, alpha, temperature, metric, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY metric DESC, ord) AS rn FROM runs) WHERE rn = 1""")
def a03_run(spark, d):
    return R.best_per(B.runs_by_id(spark, d), ["run_id"]).select(
        B.run_name(), "epoch", "alpha", "temperature", "metric", "ord")


@query("a03_best_per_epoch", f"""WITH {RUNS}
SELECT epoch, run_name, metric, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY metric DESC, ord) AS rn FROM runs) WHERE rn = 1""")
def a03_epoch(spark, d):
    return R.best_per(B.runs(spark, d), ["epoch"]).select("epoch", "run_name", "metric", "ord")


@query("a04_param_effect", f"""WITH {RUNS}, fin AS (SELECT * FROM runs WHERE epoch = (SELECT max(epoch) FROM runs))
SELECT 'alpha' AS param, alpha AS value, round(avg(metric), 6) AS mean_metric, count(*) AS n_rows FROM fin GROUP BY alpha
UNION ALL
SELECT 'temperature', temperature, round(avg(metric), 6), count(*) FROM fin GROUP BY temperature""")
def a04(spark, d):
    out = R.param_effect(B.runs(spark, d), ["alpha", "temperature"])
    return out.withColumn("mean_metric", r6(F.col("mean_metric")))


_A05_COLS = ", ".join(f"round(avg(metric) FILTER (WHERE alpha = '{p}'), 6) AS {c}" for p, c in PRIORITY_COLS.items())


@query("a05_pivot_mean", f"""WITH {RUNS}, best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY metric DESC, ord) AS rn FROM runs) WHERE rn = 1)
SELECT temperature, {_A05_COLS} FROM best GROUP BY temperature""")
def a05(spark, d):
    best = R.best_per(B.runs(spark, d), ["run_name"])
    names = {p: "a_" + p.split("-")[0] for p in R.occurring(read_table(spark, d, "orders"), "o_orderpriority")}
    out = R.pivot_agg(best, "temperature", "alpha", list(names), "metric", "avg", names)
    return out.select("temperature", *[r6(F.col(c)).alias(c) for c in names.values()])


@query("a06_pivot_max", f"""WITH {STRATEGIES}
SELECT size, max(metric) FILTER (WHERE beta = 'F') AS beta_F, max(metric) FILTER (WHERE beta = 'O') AS beta_O
FROM strategies GROUP BY size""")
def a06(spark, d):
    s = B.strategies(spark, d)
    betas = R.occurring(s, "beta")
    return R.pivot_agg(s, "size", "beta", betas, "metric", "max", {b: f"beta_{b}" for b in betas})


def _best_by_size(spark, d, strategy, beta=None):
    s = B.strategies(spark, d).where(F.col("strategy") == strategy)
    if beta is not None:
        s = s.where(F.col("beta") == beta)
    return s.groupBy("size").agg(F.max("metric").alias("best"))


_BEST_BY_SIZE_SQL = """best_{name} AS (SELECT size, max(metric) AS best FROM strategies
  WHERE strategy = '{strategy}'{extra} GROUP BY size)"""


def _bbs(name, strategy, beta=None):
    return _BEST_BY_SIZE_SQL.format(name=name, strategy=strategy,
                                    extra=f" AND beta = '{beta}'" if beta else "")


_J04_SQL = f"""WITH {STRATEGIES}, {_bbs('last', 'last', 'F')}, {_bbs('skip', 'skip', 'F')},
cmp AS (SELECT l.size, l.best AS last_best, s.best AS skip_best, l.best - s.best AS diff,
  (l.best - s.best) / s.best * 100 AS rel_pct,
  CASE WHEN l.best - s.best > 0 THEN 'LAST' WHEN l.best - s.best < 0 THEN 'SKIP' ELSE 'TIE' END AS winner
  FROM best_last l JOIN best_skip s ON l.size = s.size)"""


def _j04_frame(spark, d):
    cmp = R.strategy_compare(_best_by_size(spark, d, "last", "F"), _best_by_size(spark, d, "skip", "F"),
                             "size", "best")
    return cmp.withColumnsRenamed({"a_value": "last_best", "b_value": "skip_best"})


@query("j04_strategy_compare", _J04_SQL + """
SELECT size, last_best, skip_best, round(diff, 6) AS diff, round(rel_pct, 6) AS rel_pct, winner FROM cmp""")
def j04(spark, d):
    c = _j04_frame(spark, d)
    return c.select("size", "last_best", "skip_best", r6(F.col("diff")).alias("diff"),
                    r6(F.col("rel_pct")).alias("rel_pct"), "winner")


@query("a07_win_counts", _J04_SQL + """
SELECT count(*) FILTER (WHERE winner = 'LAST') AS last_wins, count(*) FILTER (WHERE winner = 'SKIP') AS skip_wins,
       count(*) FILTER (WHERE winner = 'TIE') AS ties FROM cmp""")
def a07(spark, d):
    c = _j04_frame(spark, d)
    return c.agg(F.count_if(F.col("winner") == "LAST").alias("last_wins"),
                 F.count_if(F.col("winner") == "SKIP").alias("skip_wins"),
                 F.count_if(F.col("winner") == "TIE").alias("ties"))


_A08_BASE = "(SELECT max(metric) FROM strategies WHERE strategy = 'vanilla' AND size = 7)"


@query("a08_smallest_matching", f"""WITH {STRATEGIES}, {_bbs('skip', 'skip')},
hit AS (SELECT min(size) AS smallest_size FROM best_skip WHERE best >= {_A08_BASE})
SELECT smallest_size, round((12 - smallest_size) / 12.0 * 100, 6) AS compression_pct FROM hit WHERE smallest_size IS NOT NULL""")
def a08(spark, d):
    s = B.strategies(spark, d)
    base = s.where((F.col("strategy") == "vanilla") & (F.col("size") == 7)).select(F.max("metric")).scalar()
    out = R.smallest_matching(_best_by_size(spark, d, "skip"), base)
    return out.withColumn("compression_pct", r6(F.col("compression_pct").cast("double")))


@query("a15_running_best", f"""WITH {RUNS}
SELECT ord, run_name, epoch, metric,
  max(metric) OVER (PARTITION BY run_name ORDER BY epoch, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best,
  coalesce(metric > max(metric) OVER (PARTITION BY run_name ORDER BY epoch, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_new_best
FROM runs""")
def a15(spark, d):
    out = R.running_best(B.runs_by_id(spark, d), "run_id", ["epoch", "ord"], "metric")
    return out.select("ord", B.run_name(), "epoch", "metric", "prev_best", "is_new_best")


# ------------------------------------------------------------------ W

@query("w01_convergence", f"""WITH {RUNS},
r AS (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY epoch DESC, ord DESC) AS rn FROM runs)
SELECT a.run_name, a.epoch AS last_epoch, a.metric AS last_metric, b.metric AS prev_metric, a.metric - b.metric AS delta,
  CASE WHEN a.metric - b.metric > CAST(0.001 AS DOUBLE) THEN 'Still improving'
       WHEN abs(a.metric - b.metric) < CAST(0.001 AS DOUBLE) THEN 'Converged' ELSE 'Overfitting' END AS status
FROM r a JOIN r b ON a.run_name = b.run_name AND b.rn = 2 WHERE a.rn = 1""")
def w01(spark, d):
    status = R.convergence_status(B.runs_by_id(spark, d), "run_id")
    return status.select(B.run_name(), "last_epoch", "last_metric", "prev_metric", "delta", "status")


@query("w02_leaderboard", """SELECT s_suppkey, s_name, s_acctbal,
  CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS rank FROM supplier""")
def w02(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return R.leaderboard(s, "s_acctbal", "s_suppkey")


@query("w03_learning_curves", f"""WITH {RUNS},
f AS (SELECT run_name, alpha AS alpha_first, temperature AS temperature_first, n FROM (
  SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY epoch, ord) AS rn, count(*) OVER (PARTITION BY run_name) AS n
  FROM runs) WHERE rn = 1 AND n > 1)
SELECT r.run_name, r.epoch, r.metric, r.ord, r.alpha, r.temperature, f.alpha_first, f.temperature_first
FROM runs r JOIN f ON r.run_name = f.run_name""")
def w03(spark, d):
    out = R.learning_curves(B.runs(spark, d), "run_name", "epoch", "ord", ["alpha", "temperature"])
    return out.select("run_name", "epoch", "metric", "ord", "alpha", "temperature", "alpha_first", "temperature_first")


@query("w04_param_impact", f"""WITH {RUNS}, fin AS (SELECT * FROM runs WHERE epoch = (SELECT max(epoch) FROM runs)),
s AS (SELECT alpha, temperature, avg(metric) AS m FROM fin GROUP BY alpha, temperature)
SELECT alpha, temperature, round(m, 6) AS mean_metric, round((SELECT min(m) FROM s) * 0.98, 6) AS y_lo,
       round((SELECT max(m) FROM s) * 1.01, 6) AS y_hi FROM s""")
def w04(spark, d):
    out = R.param_impact(B.runs(spark, d), "alpha", "temperature", "metric")
    return out.select("alpha", "temperature", *[r6(F.col(c)).alias(c) for c in ("mean_metric", "y_lo", "y_hi")])


@query("w05_adaptive_topn", f"""WITH {RUNS}, fin AS (SELECT * FROM runs WHERE epoch = 4)
SELECT run_name, epoch, metric, ord, rank FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY metric DESC, ord) AS INTEGER) AS rank FROM fin)
WHERE rank <= least(4, greatest(3, (SELECT count(*) FROM fin) // 3))""")
def w05(spark, d):
    fin = B.runs(spark, d).where(F.col("epoch") == 4)
    return R.adaptive_top_n(fin, "metric", "ord").select("run_name", "epoch", "metric", "ord", "rank")


@query("w06_n_largest", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def w06(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    return p.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(10)


@query("w07_chain_degradation", f"""WITH {RUNS}
SELECT ord, run_name, CAST(row_number() OVER w AS INTEGER) AS stage, metric,
  round(metric - lag(metric) OVER w, 6) AS delta_prev, round(metric - first_value(metric) OVER w, 6) AS delta_root
FROM runs WINDOW w AS (PARTITION BY run_name ORDER BY epoch, ord)""")
def w07(spark, d):
    out = R.chain_degradation(B.runs_by_id(spark, d), "run_id", ["epoch", "ord"], "metric")
    return out.select("ord", B.run_name(), "stage", "metric", r6(F.col("delta_prev")).alias("delta_prev"),
                      r6(F.col("delta_root")).alias("delta_root"))


# ------------------------------------------------------------------ J

@query("j01_resume_anti", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def j01(spark, d):
    todo = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    done = (read_table(spark, d, "lineitem").where(F.col("l_returnflag") == "R")
            .select(F.col("l_orderkey").alias("o_orderkey")))
    return R.resume_anti(todo, done, ["o_orderkey"])


@query("j02_tier2_semi", f"""WITH {RUNS}, fin AS (SELECT * FROM runs WHERE epoch = 4),
top AS (SELECT run_name FROM (SELECT *, row_number() OVER (ORDER BY metric DESC, ord) AS rank FROM fin)
        WHERE rank <= least(4, greatest(3, (SELECT count(*) FROM fin) // 3)))
SELECT run_name, epoch, metric, ord FROM runs WHERE run_name IN (SELECT run_name FROM top)""")
def j02(spark, d):
    runs = B.runs(spark, d)
    top = R.adaptive_top_n(runs.where(F.col("epoch") == 4), "metric", "ord")
    return R.tier2_semi(runs, top, "run_name").select("run_name", "epoch", "metric", "ord")


@query("j03_best_only", f"""WITH {RUNS},
catalog AS (
  SELECT run_name || '_epoch' || CAST(epoch AS VARCHAR) AS model_key, '/ckpt/' || run_name || '_epoch' || CAST(epoch AS VARCHAR) AS model_path,
         alpha, temperature, epoch FROM runs
  UNION ALL
  SELECT run_name || '_epoch' || CAST(epoch AS VARCHAR), '/ckpt/' || run_name || '_epoch' || CAST(epoch AS VARCHAR) || '/copy',
         alpha, temperature, epoch FROM runs WHERE ord % 3 = 0),
firsthit AS (SELECT model_key, min(model_path) AS model_path FROM catalog GROUP BY model_key),
best AS (SELECT run_name || '_epoch' || CAST(epoch AS VARCHAR) AS model_key FROM (
  SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY metric DESC, ord) AS rn FROM runs) WHERE rn = 1)
SELECT 'student' AS model_type, f.model_key, f.model_path FROM best b JOIN firsthit f ON b.model_key = f.model_key
UNION ALL
SELECT DISTINCT 'teacher', model_key, model_path FROM catalog
WHERE epoch = 1 AND alpha = '1-URGENT' AND temperature = 'F' AND model_path NOT LIKE '%/copy'""")
def j03(spark, d):
    runs = B.runs(spark, d)
    key = F.concat(F.col("run_name"), F.lit("_epoch"), F.col("epoch").cast("string"))
    base = F.concat(F.lit("/ckpt/"), key)
    catalog = explode_rows(runs, [key.alias("model_key"), "alpha", "temperature", "epoch"], F.array_compact(
        F.array(base, F.when(F.col("ord") % 3 == 0, F.concat(base, F.lit("/copy"))))), "model_path")
    first_hit = catalog.groupBy("model_key").agg(F.min("model_path").alias("model_path"))
    best = R.best_per(runs, ["run_name"]).select(key.alias("model_key"))
    students = best.join(first_hit, "model_key").select(F.lit("student").alias("model_type"), "model_key", "model_path")
    teachers = catalog.where((F.col("epoch") == 1) & (F.col("alpha") == "1-URGENT") & (F.col("temperature") == "F")
                             & ~F.col("model_path").endswith("/copy")).select(
        F.lit("teacher").alias("model_type"), "model_key", "model_path").distinct()
    return students.unionByName(teachers)


@query("j05_vs_baseline", f"""WITH {STRATEGIES}, {_bbs('skip', 'skip')},
base AS (SELECT max(metric) AS b FROM strategies WHERE strategy = 'vanilla')
SELECT size, best, (SELECT b FROM base) AS baseline, round(best - (SELECT b FROM base), 6) AS gain,
       round((best - (SELECT b FROM base)) / (SELECT b FROM base) * 100, 6) AS gain_pct FROM best_skip""")
def j05(spark, d):
    s = B.strategies(spark, d)
    base = s.where(F.col("strategy") == "vanilla").select(F.max("metric")).scalar()
    out = R.vs_baseline(_best_by_size(spark, d, "skip"), "best", base)
    return out.select("size", "best", "baseline", r6(F.col("gain")).alias("gain"), r6(F.col("gain_pct")).alias("gain_pct"))


@query("j06_common_runs", f"""WITH {RUNS},
common AS (SELECT k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events) ORDER BY k LIMIT 4)
SELECT CAST(substr(run_name, 5) AS BIGINT) AS run_id, 'dev' AS series, CAST(epoch AS BIGINT) AS x, metric AS y FROM runs
WHERE CAST(substr(run_name, 5) AS BIGINT) IN (SELECT k FROM common)
UNION ALL
SELECT user_id, 'train', event_id, value FROM events WHERE user_id IN (SELECT k FROM common)""")
def j06(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    e = read_table(spark, d, "events")
    common = o.intersect(e.select(F.col("user_id").alias("k"))).orderBy("k").limit(4)
    common = F.broadcast(common)  # at most 4 keys
    runs = B.runs(spark, d).withColumn("k", F.substring("run_name", 5, 100).cast("bigint"))
    dev = runs.join(common, "k", "left_semi").select(
        F.col("k").alias("run_id"), F.lit("dev").alias("series"), F.col("epoch").cast("bigint").alias("x"),
        F.col("metric").alias("y"))
    train = e.join(common.withColumnRenamed("k", "user_id"), "user_id", "left_semi").select(
        F.col("user_id").alias("run_id"), F.lit("train").alias("series"), F.col("event_id").alias("x"),
        F.col("value").alias("y"))
    return dev.unionByName(train)


@query("j08_union_tagged", f"""WITH {RUNS}, {STRATEGIES}
SELECT 'runs' AS source, alpha, CAST(NULL AS INTEGER) AS size, max(metric) AS best FROM runs GROUP BY alpha
UNION ALL
SELECT 'strategies', NULL, size, max(metric) FROM strategies GROUP BY size""")
def j08(spark, d):
    a = B.runs(spark, d).groupBy("alpha").agg(F.max("metric").alias("best"))
    b = B.strategies(spark, d).groupBy("size").agg(F.max("metric").alias("best"))
    return R.union_tagged({"runs": a, "strategies": b}).select("source", "alpha", "size", "best")


@query("j09_distinct_union", """SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F'
UNION SELECT user_id FROM events WHERE event_type = 'purchase'""")
def j09(spark, d):
    a = read_table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("key"))
    b = read_table(spark, d, "events").where(F.col("event_type") == "purchase").select(F.col("user_id").alias("key"))
    return a.union(b).distinct()


# ------------------------------------------------------------ flagship

@query("flagship_run_summary", f"""WITH {RUNS},
best AS (SELECT run_name, epoch AS best_epoch, metric AS best_metric FROM (
  SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY metric DESC, ord) AS rn FROM runs) WHERE rn = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY epoch DESC, ord DESC) AS rn FROM runs),
conv AS (SELECT a.run_name, a.metric - b.metric AS last_delta,
  CASE WHEN a.metric - b.metric > CAST(0.001 AS DOUBLE) THEN 'Still improving'
       WHEN abs(a.metric - b.metric) < CAST(0.001 AS DOUBLE) THEN 'Converged' ELSE 'Overfitting' END AS status
  FROM r a JOIN r b ON a.run_name = b.run_name AND b.rn = 2 WHERE a.rn = 1)
SELECT best.run_name, best_epoch, best_metric, last_delta, status FROM best LEFT JOIN conv ON best.run_name = conv.run_name""")
def flagship(spark, d):
    runs = B.runs_by_id(spark, d)
    best = R.best_per(runs, ["run_id"]).select(
        "run_id", F.col("epoch").alias("best_epoch"), F.col("metric").alias("best_metric"))
    conv = R.convergence_status(runs, "run_id").select("run_id", F.col("delta").alias("last_delta"), "status")
    return best.join(conv, "run_id", "left").select(B.run_name(), "best_epoch", "best_metric", "last_delta", "status")
