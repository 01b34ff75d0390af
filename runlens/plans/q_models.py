"""Queries for DataFrame-level modelling (M01-M07). Metrics of trained classifiers have no
SQL equivalent (rows-only check); that the logistic models are optimal is certified by aggregates
whose data side SQL computes, least squares are solved in SQL too, and the summary is run on the
linear scorers that SQL reproduces."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import knn as KNN
from runlens.operators import models as MD
from runlens.operators import prep as P
from runlens.plans.registry import query
from runlens.plans.sql_views import ELEMS_SQL, VECTORS
from runlens.session import scratch_path
from runlens.sources import bindings as B
from runlens.sources.tables import read_table

SEED = 42
N_SCORERS, N_CLASSES, DIM = 4, 10, 64


def _vector_split(spark, d):
    v = B.vectors(spark, d)
    s = P.stratified_split(v, "label", "vec_id", test_frac=0.2, dev_frac=None, seed=SEED)
    s = MD.as_vector(s, "vec")
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


def _report_cols(df):
    return df.select("model", "row_name", *[F.round(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")],
                     "support")


@query("m01_logreg")
def m01(spark, d):
    train, test = _vector_split(spark, d)
    return _report_cols(MD.evaluate(MD.fit_logistic(train, test, "features", "label"), "label", "logreg"))


def _train_sql(rows: str, key: str, label: str, frac: float = 0.2) -> str:
    """The training part of a stratified split of the table ``rows``."""
    return f"""cnt AS (SELECT {label}, count(*) AS n FROM {rows} GROUP BY {label}),
q1 AS (SELECT *, n * ceil({frac} * sum(n) OVER ()) / sum(n) OVER () AS cont, ceil({frac} * sum(n) OVER ()) AS ndraw FROM cnt),
q2 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM q1),
quota AS (SELECT {label}, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, {label}) <= ndraw - sum(fl) OVER () THEN 1 ELSE 0 END AS q_test FROM q2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{SEED}:' || CAST({key} AS VARCHAR)), {key}) - 1 AS r FROM {rows}),
train AS (SELECT ranked.* FROM ranked JOIN quota USING ({label}) WHERE r >= q_test)"""


@query("m01_certificate", f"""WITH {VECTORS}, {_train_sql("vectors", "vec_id", "label")},
elems AS (SELECT label, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos, unnest(vec) AS v FROM train)
SELECT label, pos, round(sum(v), 6) AS moment, true AS optimal FROM elems GROUP BY label, pos
UNION ALL SELECT label, -1, CAST(count(*) AS DOUBLE), true FROM train GROUP BY label""")
def m01_certificate(spark, d):
    train, _ = _vector_split(spark, d)
    return MD.logistic_certificate(train, "features", "label").withColumn("moment", F.round("moment", 6))


@query("m02_random_forest")
def m02(spark, d):
    train, test = _vector_split(spark, d)
    return _report_cols(MD.evaluate(MD.fit_forest(train, test, "features", "label"), "label", "random_forest"))


def _doc_split(spark, d):
    lab = B.labelled(spark, d).select("doc_id", "text", F.col("quality").alias("label"))
    # several passes follow: the split is made once
    path = scratch_path(spark, "document-split")
    P.stratified_split(lab, "label", "doc_id", test_frac=0.2, dev_frac=None, seed=SEED).write.parquet(path)
    s = spark.read.parquet(path)
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


@query("m04_bow_baseline")
def m04(spark, d):
    train, test = _doc_split(spark, d)
    return _report_cols(MD.evaluate(MD.bow_baseline(train, test, "text", "label"), "label", "bow_logreg"))


@query("m04_certificate", rf"""WITH lab AS (SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
{_train_sql("lab", "doc_id", "quality")},
toks AS (SELECT quality, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS word FROM train),
vocab AS (SELECT word FROM toks GROUP BY word ORDER BY count(*) DESC, word LIMIT 5000)
SELECT c.quality AS label, v.word, CAST((SELECT count(*) FROM toks t WHERE t.word = v.word AND t.quality = c.quality) AS DOUBLE) AS moment, true AS optimal
FROM vocab v, (SELECT DISTINCT quality FROM train) c
UNION ALL SELECT quality, NULL, CAST(count(*) AS DOUBLE), true FROM train GROUP BY quality""")
def m04_certificate(spark, d):
    train, _ = _doc_split(spark, d)
    words, counts = MD.bow_stages(train, "text")
    rows = MD.spread(counts.transform(words.transform(train)).select("_bow", "label"))
    certified = MD.logistic_certificate(rows, "_bow", "label")
    names = spark.createDataFrame(list(enumerate(counts.vocabulary)), "pos int, word string")
    return certified.join(F.broadcast(names), "pos", "left").select("label", "word", F.round("moment", 6).alias("moment"), "optimal")  # vocabulary-sized


_M05_SQL = f"""WITH {VECTORS}, {ELEMS_SQL},
w AS (SELECT CAST(m AS INTEGER) AS m, CAST(c AS INTEGER) AS c, CAST(i AS INTEGER) AS i,
  ((((i * (c + 1) + m) % 7) - 3) / 4.0)::DOUBLE AS w FROM range(0, {N_SCORERS}) a(m), range(0, {N_CLASSES}) b(c), range(0, {DIM}) x(i)),
logit AS (SELECT w.m, e.vec_id, e.label, w.c, sum(e.v * w.w) AS z FROM elems e JOIN w ON w.i = e.pos GROUP BY w.m, e.vec_id, e.label, w.c),
ranked AS (SELECT *, max(z) OVER (PARTITION BY m, vec_id) AS zmax,
  row_number() OVER (PARTITION BY m, vec_id ORDER BY z DESC, c) AS r FROM logit),
per_row AS (SELECT m, vec_id, label, max(CASE WHEN r = 1 THEN c END) AS pred,
  ln(sum(exp(z - zmax))) - max(CASE WHEN c = label THEN z - zmax END) AS loss FROM ranked GROUP BY m, vec_id, label)
SELECT 'scorer_' || CAST(m AS VARCHAR) AS model, count(*) AS num_samples,
  round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(loss), 6) AS loss
FROM per_row GROUP BY m"""


@query("m05_batch_score", _M05_SQL)
def m05(spark, d):
    v = B.vectors(spark, d)
    w = MD.linear_scorer_weights(N_SCORERS, N_CLASSES, DIM)
    scored = MD.batch_score(v, "vec", "label", "vec_id", w, [f"scorer_{m}" for m in range(N_SCORERS)])
    s = MD.score_summary(scored)
    return s.select("model", "num_samples", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"))


@query("m06_model_summary")
def m06(spark, d):
    train, test = _vector_split(spark, d)
    reports = {
        "logreg": MD.evaluate(MD.fit_logistic(train, test, "features", "label"), "label", "logreg"),
        "random_forest": MD.evaluate(MD.fit_forest(train, test, "features", "label"), "label", "random_forest"),
    }
    # Majority-class baseline: predicts the most frequent training label.
    major = train.groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(1).select("label")
    base_pred = test.select("label", major.select("label").scalar().cast("double").alias("prediction"))
    reports["majority"] = MD.evaluate(base_pred, "label", "majority")
    acc = MD.summary_rows(reports)
    out = MD.model_summary(acc, "majority")
    return out.select("model", F.round("accuracy", 6).alias("accuracy"), F.round("improvement", 6).alias("improvement"),
                      "rank")


@query("m06_scorer_summary", f"""WITH acc AS ({_M05_SQL})
SELECT model, accuracy, round(accuracy - (SELECT accuracy FROM acc WHERE model = 'scorer_0'), 6) AS improvement,
  CAST(row_number() OVER (ORDER BY accuracy DESC, model) AS INTEGER) AS rank FROM acc""")
def m06_scorers(spark, d):
    scored = MD.batch_score(B.vectors(spark, d), "vec", "label", "vec_id", MD.linear_scorer_weights(N_SCORERS, N_CLASSES, DIM),
                            [f"scorer_{m}" for m in range(N_SCORERS)])
    acc = MD.score_summary(scored).withColumn("accuracy", F.round("accuracy", 6))
    return MD.model_summary(acc, "scorer_0").withColumn("improvement", F.round("improvement", 6))


_DRIVERS = ("size", "avg_length", "toxic_share")
_M07_SUMS = ", ".join([*(f"avg(x{i}) AS m{i}" for i in (1, 2, 3)), "avg(y) AS my",
                       *(f"regr_count(y, x1) * covar_pop(x{i}, x{j}) AS s{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j),
                       *(f"regr_count(y, x1) * covar_pop(x{i}, y) AS t{i}" for i in (1, 2, 3))])


@query("m07_ols_drivers", f"""WITH g AS (SELECT CAST(count(*) AS DOUBLE) AS x1, avg(n_chars) AS x2, avg(toxic) AS x3, avg(quality) AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang, source),
s AS (SELECT {_M07_SUMS} FROM g),
b AS (SELECT *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13) AS det,
  t1 * (s22 * s33 - s23 * s23) - s12 * (t2 * s33 - s23 * t3) + s13 * (t2 * s23 - s22 * t3) AS d1,
  s11 * (t2 * s33 - t3 * s23) - t1 * (s12 * s33 - s23 * s13) + s13 * (s12 * t3 - t2 * s13) AS d2,
  s11 * (s22 * t3 - s23 * t2) - s12 * (s12 * t3 - t2 * s13) + t1 * (s12 * s23 - s22 * s13) AS d3 FROM s),
c AS (SELECT '{_DRIVERS[0]}' AS feature, d1 / det AS coefficient FROM b UNION ALL SELECT '{_DRIVERS[1]}', d2 / det FROM b
  UNION ALL SELECT '{_DRIVERS[2]}', d3 / det FROM b UNION ALL SELECT 'intercept', my - (d1 * m1 + d2 * m2 + d3 * m3) / det FROM b)
SELECT feature, round(coefficient, 6) AS coefficient, CAST(row_number() OVER (ORDER BY abs(coefficient) DESC, feature) AS INTEGER) AS rank FROM c""")
def m07(spark, d):
    lab = B.labelled(spark, d)
    g = lab.groupBy("lang", "source").agg(
        F.count(F.lit(1)).cast("double").alias("size"), F.avg("n_chars").alias("avg_length"),
        F.avg("toxic").alias("toxic_share"), F.avg("quality").alias("gain"))
    return MD.ols_drivers(g, _DRIVERS, "gain").withColumn("coefficient", F.round("coefficient", 6))


@query("m03_knn", f"""WITH {VECTORS},
test AS (SELECT * FROM vectors WHERE vec_id % 4 = 0), train AS (SELECT * FROM vectors WHERE vec_id % 4 <> 0),
d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label AS tlabel, list_distance(q.vec, t.vec) AS dist FROM test q, train t),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS r FROM d) WHERE r <= 5),
votes AS (SELECT qid, tlabel, count(*) AS c FROM nn GROUP BY qid, tlabel),
pick AS (SELECT qid, tlabel FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, tlabel) AS r FROM votes) WHERE r = 1)
SELECT t.vec_id, t.label, CAST(p.tlabel AS INTEGER) AS pred FROM test t JOIN pick p ON p.qid = t.vec_id""")
def m03(spark, d):
    v = B.vectors(spark, d)
    test = v.where(F.col("vec_id") % 4 == 0)
    train = v.where(F.col("vec_id") % 4 != 0)
    pred = KNN.knn_classify(test, train, "vec_id", "vec", "label", k=5)
    return test.select("vec_id", "label").join(pred, "vec_id")
