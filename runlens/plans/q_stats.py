"""Queries for the experiment statistics.

Bindings: datasets are line numbers ("ds1".."ds7"), the baseline method is
line status F and the distilled one O, accuracy is the extended price; text
datasets are document languages; models for selection and Pareto analysis
are parts; methods for agreement are the four 16-value slices of a vector.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import stats as S
from runlens.plans.registry import query
from runlens.plans.sql_views import ELEMS_SQL, STRATEGIES, VECTORS, WORDS
from runlens.sources import bindings as B
from runlens.sources.tables import read_table


def r6(c):
    return F.round(c, 6)


def _results(spark, d):
    s = B.strategies(spark, d)
    return s.select(F.concat(F.lit("ds"), F.col("size").cast("string")).alias("dataset"),
                    F.when(F.col("beta") == "F", "baseline").otherwise("distilled").alias("method"),
                    F.col("metric").alias("accuracy"))


_GAIN_SQL = f"""{STRATEGIES},
res AS (SELECT 'ds' || CAST(size AS VARCHAR) AS dataset, CASE WHEN beta = 'F' THEN 'baseline' ELSE 'distilled' END AS method,
  metric AS accuracy FROM strategies),
gains AS (SELECT dataset, avg(accuracy) FILTER (WHERE method = 'baseline') AS baseline,
  avg(accuracy) FILTER (WHERE method = 'distilled') AS distilled FROM res GROUP BY dataset),
g2 AS (SELECT *, distilled - baseline AS gain, (distilled - baseline) / baseline * 100 AS gain_pct FROM gains)"""


def _gains(spark, d):
    return S.gain_table(_results(spark, d), "dataset", "method", "accuracy")


@query("n01_gain_table", f"""WITH {_GAIN_SQL}
SELECT dataset, round(baseline, 6) AS baseline, round(distilled, 6) AS distilled, round(gain, 6) AS gain,
  round(gain_pct, 6) AS gain_pct FROM g2""")
def n01(spark, d):
    g = _gains(spark, d)
    return g.select("dataset", *[r6(F.col(c)).alias(c) for c in ("baseline", "distilled", "gain", "gain_pct")])


@query("n02_paired_t", f"""WITH {_GAIN_SQL}
SELECT count(gain) AS n, round(avg(gain) / (stddev_samp(gain) / sqrt(count(gain))), 6) AS t, count(gain) - 1 AS df FROM g2""")
def n02(spark, d):
    t = S.paired_t(_gains(spark, d))
    return t.select("n", r6(F.col("t")).alias("t"), "df")


# Seven datasets, six degrees of freedom: P(|T| <= t) = sin x (1 + cos^2 x / 2 + 3 cos^4 x / 8), x = atan(t / sqrt 6).
@query("n02_paired_t_pvalue", f"""WITH {_GAIN_SQL},
s AS (SELECT count(gain) AS n, avg(gain) / (stddev_samp(gain) / sqrt(count(gain))) AS t, count(gain) - 1 AS df FROM g2),
a AS (SELECT *, atan(abs(t) / sqrt(6.0)) AS x FROM s)
SELECT n, round(t, 6) AS t, df, round(1 - sin(x) * (1 + cos(x) * cos(x) / 2 + 3 * cos(x) * cos(x) * cos(x) * cos(x) / 8), 6) AS p_value FROM a""")
def n02p(spark, d):
    """Two-sided p-value of the paired test."""
    return S.paired_t(_gains(spark, d)).select("n", r6(F.col("t")).alias("t"), "df", r6(F.col("p_value")).alias("p_value"))


@query("n03_effect_size", f"""WITH {_GAIN_SQL}
SELECT round((avg(distilled) - avg(baseline)) / stddev_samp(gain), 6) AS effect_size FROM g2""")
def n03(spark, d):
    return S.effect_size(_gains(spark, d)).select(r6(F.col("effect_size")).alias("effect_size"))


# Fixed: the 0.975 quantile of Student's t with 6 degrees of freedom (7 datasets).
T975_DF6 = 2.4469118511449692


@query("n04_mean_ci", f"""WITH {_GAIN_SQL}
SELECT count(gain) AS n, round(avg(gain), 6) AS mean_gain,
  round(avg(gain) - {T975_DF6} * stddev_samp(gain) / sqrt(count(gain)), 6) AS ci_lo,
  round(avg(gain) + {T975_DF6} * stddev_samp(gain) / sqrt(count(gain)), 6) AS ci_hi FROM g2""")
def n04(spark, d):
    m = S.mean_ci(_gains(spark, d))
    return m.select("n", *[r6(F.col(c)).alias(c) for c in ("mean_gain", "ci_lo", "ci_hi")])


@query("n05_dataset_profile", """WITH c AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY lang, source)
SELECT d.lang, count(*) AS n_docs, round(avg(n_chars), 6) AS mean_len,
  round((SELECT stddev_samp(c) FROM c WHERE c.lang = d.lang), 6) AS class_count_std FROM documents d GROUP BY d.lang""")
def n05(spark, d):
    docs = read_table(spark, d, "documents")
    p = S.dataset_profile(docs, "lang", "n_chars", "source")
    return p.select("lang", "n_docs", r6(F.col("mean_len")).alias("mean_len"),
                    r6(F.col("class_count_std")).alias("class_count_std"))


@query("n06_entropy_vocab", f"""WITH {WORDS},
c AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY lang, source),
p AS (SELECT lang, c / sum(c) OVER (PARTITION BY lang) AS p FROM c),
e AS (SELECT lang, count(*) AS n_classes, -sum(p * ln(p)) AS entropy FROM p GROUP BY lang),
v AS (SELECT lang, count(DISTINCT word) AS vocab_size FROM words GROUP BY lang)
SELECT e.lang, n_classes, round(entropy, 6) AS entropy, v.vocab_size FROM e JOIN v ON e.lang = v.lang""")
def n06(spark, d):
    docs = read_table(spark, d, "documents")
    e = S.class_entropy(docs, "lang", "source")
    v = B.words(spark, d).select("lang", "word").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("vocab_size"))
    return e.join(v, "lang").select("lang", "n_classes", r6(F.col("entropy")).alias("entropy"), "vocab_size")


_PARTS_SQL = "pm AS (SELECT p_partkey, p_retailprice, (p_partkey * 7919) % 1000 AS score, p_size FROM part)"


@query("n07_pareto", f"""WITH {_PARTS_SQL}
SELECT * FROM pm x WHERE NOT EXISTS (SELECT 1 FROM pm y WHERE y.p_retailprice >= x.p_retailprice AND y.score >= x.score
  AND y.p_size <= x.p_size AND (y.p_retailprice > x.p_retailprice OR y.score > x.score OR y.p_size < x.p_size))""")
def n07(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_retailprice",
                                            ((F.col("p_partkey") * 7919) % 1000).alias("score"), "p_size")
    return S.pareto_front_grid(p, "p_retailprice", grid_max="score", grid_min="p_size").select(
        "p_partkey", "p_retailprice", "score", "p_size")


_REAL_SQL = """pm AS (SELECT p_partkey, p_retailprice / CAST(2000 AS DOUBLE) AS accuracy,
  ((p_partkey * 7919) % 1000) / CAST(1000 AS DOUBLE) AS similarity, CAST(p_size AS DOUBLE) AS cost FROM part)"""


@query("n07_pareto_real", f"""WITH {_REAL_SQL}
SELECT * FROM pm x WHERE NOT EXISTS (SELECT 1 FROM pm y WHERE y.accuracy >= x.accuracy AND y.similarity >= x.similarity
  AND y.cost <= x.cost AND (y.accuracy > x.accuracy OR y.similarity > x.similarity OR y.cost < x.cost))""")
def n07_real(spark, d):
    p = read_table(spark, d, "part").select(
        "p_partkey", (F.col("p_retailprice") / 2000.0).alias("accuracy"),
        ((F.col("p_partkey") * 7919) % 1000 / 1000.0).alias("similarity"), F.col("p_size").cast("double").alias("cost"))
    return S.pareto_front(p, ["accuracy", "similarity"], ["cost"])


_N08_REQ = {"max_params": 40, "min_accuracy": 0.5, "min_similarity": 0.3, "max_time": 30}


@query("n08_select_model", f"""WITH m AS (SELECT p_partkey, ((p_partkey * 7919) % 1000) / CAST(1000 AS DOUBLE) AS acc,
  p_retailprice / CAST(2000 AS DOUBLE) AS sim, p_size AS params, length(p_name) AS t FROM part),
c AS (SELECT * FROM m WHERE params <= 40 AND acc >= 0.5 AND sim >= 0.3 AND t <= 30),
s AS (SELECT *, 0.4 * acc + 0.3 * sim + 0.2 * (1 - params / (SELECT max(params) FROM c)) + 0.1 * (1 - t / (SELECT max(t) FROM c)) AS score FROM c)
SELECT p_partkey, round(acc, 6) AS acc, round(sim, 6) AS sim, round(score, 6) AS score FROM s ORDER BY score DESC, p_partkey LIMIT 5""")
def n08(spark, d):
    p = read_table(spark, d, "part").select(
        "p_partkey", (((F.col("p_partkey") * 7919) % 1000) / F.lit(1000.0)).alias("acc"),
        (F.col("p_retailprice") / F.lit(2000.0)).alias("sim"), F.col("p_size").alias("params"),
        F.length("p_name").alias("t"))
    top = S.composite_select(p, "acc", "sim", "params", "t", "p_partkey", _N08_REQ)
    return top.select("p_partkey", *[r6(F.col(c)).alias(c) for c in ("acc", "sim", "score")])


METHODS = ["m1", "m2", "m3", "m4"]


def _methods(spark, d):
    v = B.vectors(spark, d)
    x = v.select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos"), "vec")
    return x.select("vec_id", "label", "pos",
                    *[F.element_at("vec", F.col("pos") + 1 + 16 * i).alias(m) for i, m in enumerate(METHODS)])


_METHODS_SQL = f"""{VECTORS}, {ELEMS_SQL},
w AS (SELECT vec_id, label, pos % 16 AS pos, max(v) FILTER (WHERE pos // 16 = 0) AS m1, max(v) FILTER (WHERE pos // 16 = 1) AS m2,
  max(v) FILTER (WHERE pos // 16 = 2) AS m3, max(v) FILTER (WHERE pos // 16 = 3) AS m4 FROM elems GROUP BY vec_id, label, pos % 16)"""


@query("n09_method_agreement", f"""WITH {_METHODS_SQL}
SELECT 'm1' AS method_a, 'm2' AS method_b, round(corr(m1, m2), 6) AS corr FROM w
UNION ALL SELECT 'm1', 'm3', round(corr(m1, m3), 6) FROM w UNION ALL SELECT 'm1', 'm4', round(corr(m1, m4), 6) FROM w
UNION ALL SELECT 'm2', 'm3', round(corr(m2, m3), 6) FROM w UNION ALL SELECT 'm2', 'm4', round(corr(m2, m4), 6) FROM w
UNION ALL SELECT 'm3', 'm4', round(corr(m3, m4), 6) FROM w""")
def n09(spark, d):
    return S.correlation_matrix(_methods(spark, d), METHODS).withColumn("corr", r6(F.col("corr")))


@query("n10_stability", f"""WITH {_METHODS_SQL},
l AS (UNPIVOT w ON m1, m2, m3, m4 INTO NAME method VALUE v),
sd AS (SELECT vec_id, label, pos, stddev_samp(v) AS sd FROM l GROUP BY vec_id, label, pos)
SELECT label, round(avg(sd), 6) AS stability FROM sd GROUP BY label""")
def n10(spark, d):
    return S.stability(_methods(spark, d), "label", METHODS).withColumn("stability", r6(F.col("stability")))


@query("n11_slope", f"""WITH {STRATEGIES}
SELECT strategy, round(regr_slope(metric, size), 6) AS slope, round(regr_intercept(metric, size), 6) AS intercept,
  round(regr_r2(metric, size), 6) AS r2 FROM strategies GROUP BY strategy""")
def n11(spark, d):
    s = B.strategies(spark, d).withColumn("size", F.col("size").cast("double"))
    return S.slope(s, "strategy", "metric", "size").select(
        "strategy", *[r6(F.col(c)).alias(c) for c in ("slope", "intercept", "r2")])


TEACHER_LAYERS = 12


@query("n12_efficiency", f"""WITH {STRATEGIES},
g AS (SELECT strategy, size, avg(metric) AS m, avg(l_quantity) AS t FROM strategies GROUP BY strategy, size)
SELECT strategy, size, round(m, 6) AS mean_metric, round({TEACHER_LAYERS} / CAST(size AS DOUBLE), 6) AS compression,
  round(m / size, 6) AS metric_per_layer, round(m / t, 6) AS metric_per_sec FROM g""")
def n12(spark, d):
    g = B.strategies(spark, d).groupBy("strategy", "size").agg(F.avg("metric").alias("m"), F.avg("l_quantity").alias("t"))
    return g.select("strategy", "size", r6(F.col("m")).alias("mean_metric"),
                    r6(F.try_divide(F.lit(float(TEACHER_LAYERS)), F.col("size"))).alias("compression"),
                    r6(F.try_divide(F.col("m"), F.col("size"))).alias("metric_per_layer"),
                    r6(F.try_divide(F.col("m"), F.col("t"))).alias("metric_per_sec"))


@query("n13_group_effects", f"""WITH {STRATEGIES},
b AS (SELECT strategy, size, max(metric) AS best FROM strategies GROUP BY strategy, size),
m AS (SELECT strategy, avg(metric) AS strategy_mean FROM strategies GROUP BY strategy)
SELECT b.strategy, size, best, round(strategy_mean, 6) AS strategy_mean FROM b JOIN m ON b.strategy = m.strategy""")
def n13(spark, d):
    s = B.strategies(spark, d)
    best = s.groupBy("strategy", "size").agg(F.max("metric").alias("best"))
    mean = s.groupBy("strategy").agg(r6(F.avg("metric")).alias("strategy_mean"))
    return best.join(mean, "strategy")


# Fixed outcomes of the decision rules (first match wins).
PRIORITY_OF = {"1-URGENT": "maximum_accuracy", "2-HIGH": "deployment_speed", "3-MEDIUM": "flexibility"}


@query("n14_decision_rules", """WITH r AS (SELECT o_orderkey,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'maximum_accuracy' WHEN '2-HIGH' THEN 'deployment_speed'
       WHEN '3-MEDIUM' THEN 'flexibility' ELSE 'other' END AS priority,
  CAST(floor(o_totalprice) AS BIGINT) % 6 AS acceptable_drop,
  CASE WHEN o_orderstatus = 'P' THEN 'limited' ELSE 'ample' END AS compute_budget,
  o_totalprice / 100 AS data_size FROM orders)
SELECT o_orderkey, CASE WHEN priority = 'maximum_accuracy' THEN 'fine_tune_large_model'
  WHEN priority = 'deployment_speed' THEN CASE WHEN acceptable_drop >= 3 THEN 'fine_tune_small_model' ELSE 'distill_to_small_model' END
  WHEN priority = 'flexibility' THEN 'fine_tune_teacher_then_distill_multiple_sizes'
  WHEN compute_budget = 'limited' THEN 'fine_tune_only'
  WHEN data_size < 1000 THEN 'fine_tune_only'
  ELSE 'distill_to_small_model' END AS approach FROM r""")
def n14(spark, d):
    o = read_table(spark, d, "orders")
    pr = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY_OF.items() for x in kv]),
                                 F.col("o_orderpriority")), F.lit("other"))
    drop = F.floor("o_totalprice").cast("bigint") % 6
    rules = [
        (pr == "maximum_accuracy", "fine_tune_large_model"),
        ((pr == "deployment_speed") & (drop >= 3), "fine_tune_small_model"),
        (pr == "deployment_speed", "distill_to_small_model"),
        (pr == "flexibility", "fine_tune_teacher_then_distill_multiple_sizes"),
        (F.col("o_orderstatus") == "P", "fine_tune_only"),
        (F.col("o_totalprice") / 100 < 1000, "fine_tune_only"),
    ]
    return o.select("o_orderkey", S.decision_rules(rules, "distill_to_small_model").alias("approach"))


@query("n15_drivers_corr", """WITH c AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY lang, source),
prof AS (SELECT d.lang, CAST(count(*) AS DOUBLE) AS size, avg(n_chars) AS avg_length,
  (SELECT stddev_samp(c) FROM c WHERE c.lang = d.lang) AS class_balance, avg(l.quality) AS improvement
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang)
SELECT 'size' AS characteristic, round(corr(size, improvement), 6) AS corr FROM prof
UNION ALL SELECT 'avg_length', round(corr(avg_length, improvement), 6) FROM prof
UNION ALL SELECT 'class_balance', round(corr(class_balance, improvement), 6) FROM prof""")
def n15(spark, d):
    docs = read_table(spark, d, "documents")
    lab = B.labelled(spark, d)
    cc = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_c")).groupBy("lang") \
        .agg(F.stddev_samp("_c").alias("class_balance"))
    prof = lab.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("size"),
                                   F.avg("n_chars").alias("avg_length"),
                                   F.avg("quality").alias("improvement")).join(cc, "lang")
    out = S.drivers_correlation(prof, ["size", "avg_length", "class_balance"], "improvement")
    return out.withColumn("corr", r6(F.col("corr")))
