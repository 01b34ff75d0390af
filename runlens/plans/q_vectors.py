"""Queries over score vectors: argmax/softmax/losses, classification metrics,
attribution comparison, pooling and integrated gradients.

Bindings (``runlens.sources.bindings``): ``vectors`` are the 64-value
embeddings; logits are slices 1-5 (five choices) or 1-10 (ten classes);
hidden states are the 4 x 16 reshape; the student of example i is row i + 1.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import vec as V
from runlens.functions.arrays import explode_rows, posexplode_rows
from runlens.operators import metrics as M
from runlens.operators import attribution as AT
from runlens.operators.user import metric_callbacks
from runlens.plans.registry import query
from runlens.plans.sql_views import PAIRS, STRATEGIES, VECTORS, WORDS
from runlens.sources import bindings as B
from runlens.sources.tables import read_table


def r6(c):
    return F.round(c, 6)


N_CLASSES = 10
KD_TEMPERATURE = 2.0
TOPK = 10
DIM = 64

ELEMS_ONLY = """elems AS (SELECT vec_id, label, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos, unnest(vec) AS v FROM vectors)"""
ELEMS = VECTORS + ",\n" + ELEMS_ONLY


def _long(df, keys, arr, pos="pos", val="value"):
    return posexplode_rows(df, keys, arr, pos, val)


# ------------------------------------------------------------ V01-V08

@query("v01_argmax", f"""WITH {VECTORS}
SELECT vec_id, CAST(list_position(vec[1:5], list_max(vec[1:5])) - 1 AS INTEGER) AS pred FROM vectors""")
def v01(spark, d):
    v = B.vectors(spark, d)
    return v.select("vec_id", V.argmax(F.slice("vec", 1, 5)).alias("pred"))


_SOFTMAX_SQL = """x AS (SELECT vec_id, label, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS k, unnest(l) AS v
                FROM (SELECT vec_id, label, vec[1:{n}] AS l FROM vectors)),
mx AS (SELECT vec_id, max(v) AS m FROM x GROUP BY vec_id),
z AS (SELECT x.vec_id, x.label, k, (v - m) / {t} AS z FROM x JOIN mx ON x.vec_id = mx.vec_id),
se AS (SELECT vec_id, sum(exp(z)) AS s FROM z GROUP BY vec_id),
sm AS (SELECT z.vec_id, z.label, k, exp(z) / s AS prob, z - ln(s) AS log_prob FROM z JOIN se ON z.vec_id = se.vec_id)"""


@query("v02_softmax_T", f"""WITH {VECTORS}, {_SOFTMAX_SQL.format(n=5, t='CAST(2.0 AS DOUBLE)')}
SELECT vec_id, k, round(prob, 6) AS prob, round(log_prob, 6) AS log_prob FROM sm""")
def v02(spark, d):
    v = B.vectors(spark, d).select("vec_id", F.slice("vec", 1, 5).alias("l"))
    z = v.select("vec_id", F.arrays_zip(V.softmax("l", KD_TEMPERATURE).alias("prob"),
                                        V.log_softmax("l", KD_TEMPERATURE).alias("log_prob")).alias("z"))
    out = posexplode_rows(z, ["vec_id"], "z", "k", "pl")
    return out.select("vec_id", "k", r6(F.col("pl.prob")).alias("prob"), r6(F.col("pl.log_prob")).alias("log_prob"))


def _kl_sql(temps_sql: str) -> str:
    """Per temperature T: batch-mean KL(teacher || student) * T^2 over pairs."""
    return f"""temps AS (SELECT CAST(t AS DOUBLE) AS t FROM (VALUES {temps_sql}) AS v(t)),
tl AS (SELECT example_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS k, unnest(l) AS v FROM (SELECT example_id, t_vec[1:5] AS l FROM pairs)),
sl AS (SELECT example_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS k, unnest(l) AS v FROM (SELECT example_id, s_vec[1:5] AS l FROM pairs)),
tz AS (SELECT temps.t, tl.example_id, tl.k, (tl.v - max(tl.v) OVER (PARTITION BY tl.example_id)) / temps.t AS z FROM tl, temps),
sz AS (SELECT temps.t, sl.example_id, sl.k, (sl.v - max(sl.v) OVER (PARTITION BY sl.example_id)) / temps.t AS z FROM sl, temps),
tlp AS (SELECT t, example_id, k, z - ln(sum(exp(z)) OVER (PARTITION BY t, example_id)) AS lp FROM tz),
slp AS (SELECT t, example_id, k, z - ln(sum(exp(z)) OVER (PARTITION BY t, example_id)) AS lp FROM sz),
klrow AS (SELECT a.t, a.example_id, sum(CASE WHEN exp(a.lp) = 0 THEN 0 ELSE exp(a.lp) * (a.lp - b.lp) END) AS kl
          FROM tlp a JOIN slp b ON a.t = b.t AND a.example_id = b.example_id AND a.k = b.k GROUP BY a.t, a.example_id),
kd AS (SELECT t, count(*) AS n_pairs, sum(kl) / count(*) * t * t AS kl FROM klrow GROUP BY t)"""


@query("v03_kl_loss", f"""WITH {PAIRS}, {_kl_sql('(2.0)')}
SELECT n_pairs, round(kl, 6) AS kl FROM kd""")
def v03(spark, d):
    p = B.vector_pairs(spark, d)
    return M.kd_loss(p, F.slice("t_vec", 1, 5), F.slice("s_vec", 1, 5), [KD_TEMPERATURE]).select(
        "n_pairs", r6(F.col("kl")).alias("kl"))


@query("v04_cross_entropy", f"""WITH {VECTORS}, {_SOFTMAX_SQL.format(n=10, t='CAST(1.0 AS DOUBLE)')}
SELECT count(*) AS n, round(avg(-log_prob), 6) AS ce FROM sm WHERE k = label""")
def v04(spark, d):
    v = B.vectors(spark, d)
    return v.agg(F.count(F.lit(1)).alias("n"),
                 r6(F.avg(V.cross_entropy_row(F.slice("vec", 1, N_CLASSES), F.col("label")))).alias("ce"))


@query("v05_l2_normalize", f"""WITH {ELEMS},
n AS (SELECT vec_id, greatest(sqrt(sum(v * v)), CAST(1e-12 AS DOUBLE)) AS n FROM elems GROUP BY vec_id)
SELECT e.vec_id, e.pos, round(e.v / n.n, 6) AS value FROM elems e JOIN n ON e.vec_id = n.vec_id""")
def v05(spark, d):
    v = B.vectors(spark, d)
    out = _long(v, ["vec_id"], V.l2_normalize("vec"))
    return out.withColumn("value", r6(F.col("value")))


_LAYER_MAP_SQL = f"""{STRATEGIES},
sizes AS (SELECT DISTINCT size AS student_layers FROM strategies),
strat AS (SELECT * FROM (VALUES ('skip'), ('last')) AS s(strategy)),
idx AS (SELECT student_layers, strategy, CAST(i AS INTEGER) AS s_idx FROM sizes, strat, range(0, 64) AS r(i) WHERE i < student_layers - 1),
layer_map AS (SELECT strategy, student_layers, s_idx,
   CASE strategy WHEN 'skip' THEN 2 * s_idx + 1 ELSE 12 - (student_layers - 1) - 1 + s_idx END AS t_idx FROM idx)"""


@query("v06_layer_map", f"""WITH {_LAYER_MAP_SQL}
SELECT strategy, student_layers, s_idx, CAST(t_idx AS INTEGER) AS t_idx FROM layer_map WHERE t_idx < 12""")
def v06(spark, d):
    sizes = B.strategies(spark, d).select(F.col("size").alias("student_layers")).distinct()
    return M.layer_map(sizes, "student_layers", teacher_layers=12)


_PKD_SQL = """th AS (SELECT vec_id AS ex, CAST((pos) // 16 AS INTEGER) AS layer, pos % 16 AS dim, v FROM elems),
tn AS (SELECT ex, layer, dim, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY ex, layer)), CAST(1e-12 AS DOUBLE)) AS nv FROM th),
sh AS (SELECT vec_id - 1 AS ex, CAST(pos // 16 AS INTEGER) AS layer, pos % 16 AS dim, v FROM elems WHERE pos < 48),
sn AS (SELECT ex, layer, dim, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY ex, layer)), CAST(1e-12 AS DOUBLE)) AS nv FROM sh),
lm AS (SELECT * FROM (VALUES ('skip', 0, 1), ('skip', 1, 3), ('last', 0, 1), ('last', 1, 2)) AS m(strategy, s_idx, t_idx)),
pair_mse AS (SELECT lm.strategy, lm.s_idx, avg((sn.nv - tn.nv) * (sn.nv - tn.nv)) AS mse
  FROM sn JOIN lm ON sn.layer = lm.s_idx JOIN tn ON tn.ex = sn.ex AND tn.layer = lm.t_idx AND tn.dim = sn.dim
  GROUP BY lm.strategy, lm.s_idx),
pkd AS (SELECT strategy, sum(mse) AS loss FROM pair_mse GROUP BY strategy)"""


@query("v07_patient_loss", f"""WITH {ELEMS}, {_PKD_SQL}
SELECT strategy, round(loss, 6) AS loss FROM pkd""")
def v07(spark, d):
    return M.patient_loss_from_vectors(B.vectors(spark, d), teacher_layers=4, student_layers=3, dim=16).select(
        "strategy", r6(F.col("loss")).alias("loss"))


@query("v08_combined_loss", f"""WITH {PAIRS}, {_kl_sql('(5.0), (10.0), (20.0)')},
{ELEMS_ONLY}, {_PKD_SQL},
sx AS (SELECT example_id, t_label % 5 AS y, s_vec[1:5] AS l FROM pairs),
sxl AS (SELECT example_id, y, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS k, unnest(l) AS v FROM sx),
sxz AS (SELECT example_id, y, k, v - max(v) OVER (PARTITION BY example_id) AS z FROM sxl),
ce AS (SELECT avg(-(z - lse)) AS ce FROM (SELECT *, ln(sum(exp(z)) OVER (PARTITION BY example_id)) AS lse FROM sxz) WHERE k = y),
grid AS (SELECT CAST(a AS DOUBLE) AS alpha, CAST(b AS DOUBLE) AS beta FROM (VALUES (0.2), (0.5), (0.7)) AS x(a), (VALUES (10.0), (100.0), (500.0), (1000.0)) AS y(b))
SELECT alpha, beta, kd.t AS temperature,
  round((1 - alpha) * (SELECT ce FROM ce) + alpha * kd.kl + beta * (SELECT loss FROM pkd WHERE strategy = 'skip'), 6) AS loss
FROM grid, kd""")
def v08(spark, d):
    p = B.vector_pairs(spark, d)
    v = B.vectors(spark, d)
    kd = M.kd_loss(p, F.slice("t_vec", 1, 5), F.slice("s_vec", 1, 5), [5.0, 10.0, 20.0])
    ce = p.select(F.avg(V.cross_entropy_row(F.slice("s_vec", 1, 5), F.col("t_label") % 5))).scalar()
    pt = (M.patient_loss_from_vectors(v, teacher_layers=4, student_layers=3, dim=16)
          .where(F.col("strategy") == "skip").select("loss").scalar())
    out = M.combined_loss(kd, ce, pt, alphas=[0.2, 0.5, 0.7], betas=[10.0, 100.0, 500.0, 1000.0])
    return out.select("alpha", "beta", "temperature", r6(F.col("loss")).alias("loss"))


# ------------------------------------------------------------ A09-A12, A16

_PRED_SQL = f"""{VECTORS}, pred AS (SELECT vec_id, label,
  CAST(list_position(vec[1:10], list_max(vec[1:10])) - 1 AS INTEGER) AS pred FROM vectors)"""


@query("a09_accuracy", f"""WITH {_PRED_SQL}
SELECT count(*) AS n, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred""")
def a09(spark, d):
    p = M.predictions(B.vectors(spark, d), F.slice("vec", 1, N_CLASSES))
    return M.accuracy(p).select("n", r6(F.col("accuracy")).alias("accuracy"))


_PRF_SQL = _PRED_SQL + """,
classes AS (SELECT label AS c FROM pred UNION SELECT pred FROM pred),
prf AS (SELECT c AS class,
  count(*) FILTER (WHERE p.label = c AND p.pred = c) AS tp,
  count(*) FILTER (WHERE p.pred = c) AS n_pred,
  count(*) FILTER (WHERE p.label = c) AS support
  FROM classes, pred p GROUP BY c),
prf2 AS (SELECT class, support,
  CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM prf),
prf3 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM prf2)"""


@query("a10_prf_per_class", f"""WITH {_PRF_SQL}
SELECT CAST(class AS INTEGER) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support FROM prf3""")
def a10(spark, d):
    p = M.predictions(B.vectors(spark, d), F.slice("vec", 1, N_CLASSES))
    out = M.per_class_prf(p)
    return out.select("class", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("a11_confusion_matrix", f"""WITH {_PRED_SQL},
cls AS (SELECT label AS c FROM pred UNION SELECT pred FROM pred)
SELECT a.c AS label, b.c AS pred, count(p.vec_id) AS n
FROM cls a CROSS JOIN cls b LEFT JOIN pred p ON p.label = a.c AND p.pred = b.c GROUP BY a.c, b.c""")
def a11(spark, d):
    p = M.predictions(B.vectors(spark, d), F.slice("vec", 1, N_CLASSES))
    return M.confusion_long(p)


@query("a12_classification_report", f"""WITH {_PRF_SQL},
tot AS (SELECT sum(support) AS n, sum(CASE WHEN support > 0 THEN 1 ELSE 0 END) AS k FROM prf3),
acc AS (SELECT avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS a FROM pred)
SELECT CAST(class AS VARCHAR) AS row_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support FROM prf3
UNION ALL SELECT 'accuracy', NULL, NULL, round((SELECT a FROM acc), 6), CAST((SELECT n FROM tot) AS BIGINT)
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM prf3
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM prf3""")
def a12(spark, d):
    p = M.predictions(B.vectors(spark, d), F.slice("vec", 1, N_CLASSES))
    out = M.classification_report(p)
    return out.select("row_name", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("u02_metric_callback", f"""WITH {_PRED_SQL}
SELECT 'accuracy' AS metric, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS value FROM pred
UNION ALL SELECT 'mean_gap', round(avg(abs(pred - label)::DOUBLE), 6) FROM pred""")
def u02(spark, d):
    p = M.predictions(B.vectors(spark, d), F.slice("vec", 1, N_CLASSES))
    rows = metric_callbacks(p, {
        "accuracy": lambda x: M.accuracy(x).select(F.col("accuracy").alias("value")),
        "mean_gap": lambda x: x.agg(F.avg(F.abs(F.col("pred") - F.col("label"))).alias("value"))})
    return rows.select("metric", r6(F.col("value")).alias("value"))


@query("a16_mean_vector", f"""WITH {ELEMS}
SELECT label, pos, round(avg(v), 6) AS mean FROM elems GROUP BY label, pos""")
def a16(spark, d):
    v = B.vectors(spark, d)
    return M.mean_vector(v, ["label"], "vec").withColumn("mean", r6(F.col("mean")))


# ------------------------------------------------------------ attribution metrics

_TOPK_SQL = """te AS (SELECT example_id, CAST(generate_subscripts(t_vec, 1) - 1 AS INTEGER) AS pos, unnest(t_vec) AS v FROM pairs),
se AS (SELECT example_id, CAST(generate_subscripts(s_vec, 1) - 1 AS INTEGER) AS pos, unnest(s_vec) AS v FROM pairs),
ttop AS (SELECT example_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY abs(v) DESC, pos) AS r FROM te) WHERE r <= 10),
stop_ AS (SELECT example_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY abs(v) DESC, pos) AS r FROM se) WHERE r <= 10),
overlap AS (SELECT p.example_id, (SELECT count(*) FROM ttop a JOIN stop_ b ON a.example_id = b.example_id AND a.pos = b.pos
  WHERE a.example_id = p.example_id) / 10.0 AS top10_overlap FROM pairs p)"""

_METRICS_SQL = f"""{PAIRS}, {_TOPK_SQL},
mom AS (SELECT te.example_id, avg(te.v) AS mt, avg(se.v) AS ms FROM te JOIN se ON te.example_id = se.example_id AND te.pos = se.pos GROUP BY te.example_id),
m AS (SELECT te.example_id, sum(te.v * se.v) AS dot, sum(te.v * te.v) AS tt, sum(se.v * se.v) AS ss,
  sum((te.v - mt) * (se.v - ms)) AS cxy, sum((te.v - mt) * (te.v - mt)) AS cxx, sum((se.v - ms) * (se.v - ms)) AS cyy
  FROM te JOIN se ON te.example_id = se.example_id AND te.pos = se.pos JOIN mom ON mom.example_id = te.example_id GROUP BY te.example_id),
per_ex AS (SELECT m.example_id, p.t_label,
  CASE WHEN sqrt(tt) * sqrt(ss) = 0 THEN 0.0 ELSE dot / (sqrt(tt) * sqrt(ss)) END AS cosine_similarity,
  CASE WHEN sqrt(cxx * cyy) > 0 THEN cxy / sqrt(cxx * cyy) END AS correlation, o.top10_overlap
  FROM m JOIN overlap o ON o.example_id = m.example_id JOIN pairs p ON p.example_id = m.example_id)"""


@query("j07_vector_pairs", f"""WITH {PAIRS}
SELECT example_id, t_label, s_label, t_vec[1] AS t_first, s_vec[1] AS s_first FROM pairs""")
def j07(spark, d):
    p = B.vector_pairs(spark, d)
    return p.select("example_id", "t_label", "s_label", F.element_at("t_vec", 1).alias("t_first"),
                    F.element_at("s_vec", 1).alias("s_first"))


@query("v13_topk_tokens", f"""WITH {ELEMS}
SELECT vec_id, CAST(r AS INTEGER) AS rank, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, pos) AS r FROM elems) WHERE r <= 10""")
def v13(spark, d):
    v = B.vectors(spark, d)
    out = posexplode_rows(v, ["vec_id"], V.topk_positions("vec", TOPK), "rank", "pos")
    return out.withColumn("rank", (F.col("rank") + 1).cast("int"))


@query("v14_topk_overlap", f"""WITH {PAIRS}, {_TOPK_SQL}
SELECT example_id, round(top10_overlap, 6) AS top10_overlap FROM overlap""")
def v14(spark, d):
    p = AT.pair_metrics(B.vector_pairs(spark, d), k=TOPK)
    return p.select("example_id", r6(F.col("top10_overlap")).alias("top10_overlap"))


@query("v15_union_topk", f"""WITH {PAIRS}, {_TOPK_SQL},
u AS (SELECT example_id, pos FROM ttop UNION SELECT example_id, pos FROM stop_)
SELECT u.example_id, u.pos, CASE WHEN abs(te.v) > abs(se.v) THEN te.v ELSE se.v END AS value
FROM u JOIN te ON te.example_id = u.example_id AND te.pos = u.pos JOIN se ON se.example_id = u.example_id AND se.pos = u.pos""")
def v15(spark, d):
    p = B.vector_pairs(spark, d)
    out = explode_rows(p, ["example_id"], V.union_topk_values("t_vec", "s_vec", TOPK), "u")
    return out.select("example_id", F.col("u.pos").alias("pos"), F.col("u.value").alias("value"))


@query("v16_cosine", f"""WITH {_METRICS_SQL}
SELECT example_id, round(cosine_similarity, 6) AS cosine_similarity FROM per_ex""")
def v16(spark, d):
    p = AT.pair_metrics(B.vector_pairs(spark, d), k=TOPK)
    return p.select("example_id", r6(F.col("cosine_similarity")).alias("cosine_similarity"))


@query("v17_pearson", f"""WITH {_METRICS_SQL}
SELECT example_id, round(correlation, 6) AS correlation FROM per_ex""")
def v17(spark, d):
    p = AT.pair_metrics(B.vector_pairs(spark, d), k=TOPK)
    return p.select("example_id", r6(F.col("correlation")).alias("correlation"))


@query("a13_metric_summary", f"""WITH {_METRICS_SQL},
lng AS (UNPIVOT per_ex ON cosine_similarity, correlation, top10_overlap INTO NAME metric VALUE value)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
       round(max(value), 6) AS max FROM lng GROUP BY metric""")
def a13(spark, d):
    p = AT.pair_metrics(B.vector_pairs(spark, d), k=TOPK)
    out = AT.metric_summary(p, ["cosine_similarity", "correlation", "top10_overlap"])
    return out.select("metric", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")])


@query("a14_group_mean_std", f"""WITH {_METRICS_SQL},
g AS (SELECT 'student_' || CAST(t_label % 4 AS VARCHAR) AS student, [6, 4, 3, 2][t_label % 4 + 1] AS layers, * FROM per_ex)
SELECT student, CAST(layers AS INTEGER) AS layers,
  round(avg(cosine_similarity), 4) AS cosine_similarity_mean, round(stddev_samp(cosine_similarity), 4) AS cosine_similarity_std,
  round(avg(correlation), 4) AS correlation_mean, round(stddev_samp(correlation), 4) AS correlation_std,
  round(avg(top10_overlap), 4) AS top10_overlap_mean, round(stddev_samp(top10_overlap), 4) AS top10_overlap_std
FROM g GROUP BY student, layers""")
def a14(spark, d):
    p = AT.pair_metrics(B.vector_pairs(spark, d), k=TOPK).withColumns({
        "student": F.concat(F.lit("student_"), (F.col("t_label") % 4).cast("string")),
        "layers": F.element_at(F.array(*[F.lit(x) for x in (6, 4, 3, 2)]), (F.col("t_label") % 4 + 1).cast("int"))})
    return AT.group_mean_std(p, ["student", "layers"], ["cosine_similarity", "correlation", "top10_overlap"], digits=4)


@query("v09_token_score", f"""WITH {ELEMS}
SELECT vec_id, CAST(pos // 16 AS INTEGER) AS token, round(sum(v), 6) AS score FROM elems GROUP BY vec_id, pos // 16""")
def v09(spark, d):
    v = B.vectors(spark, d)
    out = _long(v, ["vec_id"], V.row_sums(V.reshape("vec", 4, 16)), "token", "score")
    return out.withColumn("score", r6(F.col("score")))


@query("v10_maxabs_norm", f"""WITH {ELEMS},
m AS (SELECT vec_id, max(abs(v)) + CAST(1e-10 AS DOUBLE) AS m FROM elems GROUP BY vec_id)
SELECT e.vec_id, e.pos, round(e.v / m.m, 6) AS value FROM elems e JOIN m ON e.vec_id = m.vec_id""")
def v10(spark, d):
    v = B.vectors(spark, d)
    return _long(v, ["vec_id"], V.maxabs_normalize("vec")).withColumn("value", r6(F.col("value")))


_WORD_SCORE_SQL = f"""{WORDS},
ws AS (SELECT doc_id, pos, word, ((pos * 31 + length(word) * 17) % 21 - 10) / 10.0 AS score FROM words),
wn AS (SELECT ws.*, score / (max(abs(score)) OVER (PARTITION BY doc_id) + CAST(1e-10 AS DOUBLE)) AS norm FROM ws)"""


@query("v11_highlight", f"""WITH {_WORD_SCORE_SQL}
SELECT doc_id, pos, printf('%s(%+.2f)', word, round(norm, 2)) AS highlight FROM wn WHERE norm > 0.1 OR norm < -0.1""")
def v11(spark, d):
    docs = read_table(spark, d, "documents").select(
        "doc_id", F.regexp_extract_all(F.lower("text"), F.lit(B.WORD_PATTERN), 0).alias("tokens"))
    return AT.highlight_words(docs, "doc_id", "tokens", threshold=0.1)


_V12_TOKENS = r"""toks AS (SELECT doc_id, list_concat(['[CLS]'], flatten(list_transform(
    regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\t\n\x0B\f\r \p{Z}\p{L}\p{N}_]'),
    lambda w: CASE WHEN length(w) > 8 THEN [substr(w, 1, 6), '##' || substr(w, 7)] ELSE [w] END)), ['[SEP]']) AS t FROM documents),
tl AS (SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS token FROM toks)"""


@query("v12_token_filter", "WITH " + _V12_TOKENS + r"""
SELECT doc_id, pos, token FROM tl
WHERE token NOT IN ('[CLS]', '[SEP]', '[PAD]', '[UNK]') AND NOT starts_with(token, '##')
  AND NOT (length(token) = 1 AND NOT regexp_matches(token, '^\p{Nd}$'))
  AND NOT regexp_matches(token, '^[.,;:!?()\[\]{}"''\-/]*$')""")
def v12(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    toks = posexplode_rows(docs, ["doc_id"], AT.wordpiece_tokens("text"), "pos", "token")
    return AT.filter_tokens(toks, "token")


@query("v18_truncate", f"""WITH {PAIRS}, te AS (SELECT example_id, CAST(generate_subscripts(t_vec, 1) - 1 AS INTEGER) AS pos,
  unnest(t_vec) AS t_val, unnest(s_vec) AS s_val FROM pairs)
SELECT example_id, pos, t_val, s_val FROM te WHERE pos < 48""")
def v18(spark, d):
    p = B.vector_pairs(spark, d)
    z = p.select("example_id", F.arrays_zip(F.slice("t_vec", 1, 48).alias("t_val"),
                                            F.slice("s_vec", 1, 48).alias("s_val")).alias("z"))
    out = posexplode_rows(z, ["example_id"], "z", "pos", "e")
    return out.select("example_id", "pos", F.col("e.t_val").alias("t_val"), F.col("e.s_val").alias("s_val"))


@query("v19_pooling", f"""WITH {ELEMS},
tok AS (SELECT vec_id, label, CAST(pos // 16 AS INTEGER) AS token, CAST(pos % 16 AS INTEGER) AS dim, v FROM elems)
SELECT vec_id, 'cls' AS pool, dim, round(v, 6) AS value FROM tok WHERE token = 0
UNION ALL
SELECT vec_id, 'mean', dim, round(sum(v) / greatest(1 + label % 4, 1), 6) FROM tok WHERE token < 1 + label % 4
GROUP BY vec_id, label, dim""")
def v19(spark, d):
    v = B.vectors(spark, d).withColumn("m", V.reshape("vec", 4, 16))
    cls = _long(v, ["vec_id"], F.element_at("m", 1), "dim", "value").withColumn("pool", F.lit("cls"))
    mean = _long(v, ["vec_id"], V.masked_mean_rows("m", F.col("label") % 4 + 1), "dim", "value") \
        .withColumn("pool", F.lit("mean"))
    return cls.unionByName(mean).select("vec_id", "pool", "dim", r6(F.col("value")).alias("value"))


@query("v20_ensemble_vote", f"""WITH {VECTORS},
ens AS (SELECT a.vec_id AS example_id, list_transform(list_zip(a.vec[1:5], b.vec[1:5], c.vec[1:5]),
          lambda x: (x[1] + x[2] + x[3]) / 3.0) AS m
        FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1 JOIN vectors c ON c.vec_id = a.vec_id + 2)
SELECT example_id, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS pred FROM ens""")
def v20(spark, d):
    v = B.vectors(spark, d).select("vec_id", F.slice("vec", 1, 5).alias("l"))
    a = v.select(F.col("vec_id").alias("example_id"), F.col("l").alias("l0"))
    b = v.select((F.col("vec_id") - 1).alias("example_id"), F.col("l").alias("l1"))
    c = v.select((F.col("vec_id") - 2).alias("example_id"), F.col("l").alias("l2"))
    ens = a.join(b, "example_id").join(c, "example_id")
    return ens.select("example_id", V.argmax(V.elementwise_mean(["l0", "l1", "l2"])).alias("pred"))


@query("v21_pseudo_labels", f"""WITH {_PRED_SQL}
SELECT label, count(*) AS n, count(*) FILTER (WHERE pred = label) AS n_agree,
       round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM pred GROUP BY label""")
def v21(spark, d):
    p = M.predictions(B.vectors(spark, d), F.slice("vec", 1, N_CLASSES))
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("n_agree"),
                                  r6(F.avg((F.col("pred") == F.col("label")).cast("double"))).alias("agreement"))


@query("v22_confidence", f"""WITH {VECTORS}, {_SOFTMAX_SQL.format(n=10, t='CAST(1.0 AS DOUBLE)')},
e AS (SELECT vec_id, unnest(vec) AS v FROM vectors)
SELECT (SELECT round(avg(mp), 6) FROM (SELECT max(prob) AS mp FROM sm GROUP BY vec_id)) AS mean_max_prob,
       (SELECT round(avg(abs(v)), 6) FROM e) AS mean_abs_attribution""")
def v22(spark, d):
    v = B.vectors(spark, d)
    mp = v.select(F.avg(F.array_max(V.softmax(F.slice("vec", 1, N_CLASSES)))).alias("mean_max_prob"))
    ma = explode_rows(v, [], "vec", "x").select(F.avg(F.abs("x")).alias("mean_abs_attribution"))
    return mp.select(r6(F.col("mean_max_prob")).alias("mean_max_prob"),
                     r6(ma.select("mean_abs_attribution").scalar()).alias("mean_abs_attribution"))


_W_SQL = "((pos % 7) - 3) / 4.0"


@query("v23_integrated_gradients", f"""WITH {ELEMS},
z AS (SELECT vec_id, sum(v * {_W_SQL}) AS z FROM elems GROUP BY vec_id),
g AS (SELECT z.vec_id, z.z, avg(s * (1 - s)) AS mg FROM (
        SELECT z.vec_id, z.z, 1.0 / (1.0 + exp(-(((k - 0.5) / 50.0) * z.z))) AS s FROM z, range(1, 51) AS r(k)) z
      GROUP BY z.vec_id, z.z)
SELECT e.vec_id, e.pos,
  round(e.v * {_W_SQL} * (1.0 / (1.0 + exp(-g.z))) * (1 - 1.0 / (1.0 + exp(-g.z))), 6) + CAST(0 AS DOUBLE) AS input_x_gradient,
  round(e.v * {_W_SQL} * g.mg, 6) + CAST(0 AS DOUBLE) AS integrated_gradient
FROM elems e JOIN g ON e.vec_id = g.vec_id""")
def v23(spark, d):
    v = B.vectors(spark, d)
    out = AT.attributions_linear(v, "vec", V.linear_weights(DIM))
    return out.select("vec_id", "pos", r6(F.col("input_x_gradient")).alias("input_x_gradient"),
                      r6(F.col("integrated_gradient")).alias("integrated_gradient"))
