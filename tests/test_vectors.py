"""Invariants and reference examples for the vector operators."""

import math

import pytest
from pyspark.sql import functions as F

from runlens.functions import vec as V
from runlens.functions.stats import t_cdf, t_ppf
from runlens.operators import attribution as AT
from runlens.operators import metrics as M


def one(df, col):
    return df.select(col.alias("x")).collect()[0].x


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [0.5, -1.0, 2.0, 0.0])], "a array<double>, b array<double>")


def test_cosine_examples(spark, row):
    assert abs(one(row, V.cosine("a", "a")) - 1.0) < 1e-3
    assert abs(one(row, V.cosine("a", F.transform("a", lambda x: -x))) + 1.0) < 1e-3
    assert one(row, V.cosine("a", F.array_repeat(F.lit(0.0), 4))) == 0.0


def test_softmax_sums_to_one_and_kl_self_is_zero(row):
    assert abs(one(row, V.vsum(V.softmax("a", 2.0))) - 1.0) < 1e-12
    assert abs(one(row, V.kl_row("a", "a", 2.0))) < 1e-12


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<double>")
    assert one(df, V.argmax("a")) == 1


def test_pearson_constant_is_null(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0], [1.0, 2.0, 3.0])], "a array<double>, b array<double>")
    assert one(df, V.pearson("a", "b")) is None


def test_topk_overlap_and_order(spark):
    df = spark.createDataFrame([([0.1, -0.9, 0.5, 0.5, 0.0],)], "a array<double>")
    assert one(df, V.topk_positions("a", 3)) == [1, 2, 3]


@pytest.mark.parametrize("layers,skip,last", [
    (6, [1, 3, 5, 7, 9], [6, 7, 8, 9, 10]), (4, [1, 3, 5], [8, 9, 10]), (3, [1, 3], [9, 10]), (2, [1], [10])])
def test_layer_map(spark, layers, skip, last):
    sizes = spark.createDataFrame([(layers,)], "student_layers int")
    m = M.layer_map(sizes, "student_layers", 12)
    got = {s: [r.t_idx for r in m.where(F.col("strategy") == s).orderBy("s_idx").collect()] for s in ("skip", "last")}
    assert got == {"skip": skip, "last": last}


def test_patient_loss_identity_and_positive(spark):
    import random
    rnd = random.Random(0)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(64)]) for i in range(6)]
    v = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    loss = {r.strategy: r.loss for r in M.patient_loss_from_vectors(v, 4, 3, 16).collect()}
    assert loss["skip"] > 0 and loss["last"] > 0
    # Student equal to the teacher's mapped layers -> zero loss.
    t = v.select(F.col("vec_id").alias("ex"), F.posexplode(V.reshape("vec", 4, 16)).alias("t_idx", "t_state"))
    s = t.select("ex", F.col("t_idx").alias("s_idx"), F.col("t_state").alias("s_state"))
    mapping = spark.createDataFrame([("same", 0, 0), ("same", 1, 1), ("same", 2, 2)], "strategy string, s_idx int, t_idx int")
    assert M.patient_loss(s, t, mapping).collect()[0].loss < 1e-6


def test_token_filter_reference_example(spark):
    toks = ["[CLS]", "court", "##s", ",", "held", "that", "1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(toks)], "pos int, token string")
    kept = [r.token for r in AT.filter_tokens(df, "token").orderBy("pos").collect()]
    assert kept == ["court", "held", "that", "1"]


def test_integrated_gradients_completeness(spark, sf_dir):
    from runlens.sources.bindings import vectors
    v = vectors(spark, sf_dir)
    gap = AT.ig_completeness(v, "vec", V.linear_weights(64)).agg(F.max("gap")).collect()[0][0]
    assert gap < 1e-4


def test_t_distribution():
    assert abs(t_ppf(0.975, 6) - 2.4469118511449692) < 1e-9
    assert abs(t_cdf(0.0, 5) - 0.5) < 1e-15
    assert abs(t_ppf(0.995, 30) - 2.749995653567) < 1e-8
    assert math.isclose(t_cdf(t_ppf(0.9, 3), 3), 0.9, rel_tol=1e-12)


def test_knn_blocks_agree_with_brute_force(spark, sf_dir):
    import numpy as np

    from runlens.operators.knn import knn_classify
    from runlens.sources.bindings import vectors
    v = vectors(spark, sf_dir)
    test = v.where(F.col("vec_id") % 4 == 0)
    train = v.where(F.col("vec_id") % 4 != 0)
    many = {r.vec_id: r.pred for r in knn_classify(test, train, "vec_id", "vec", "label", k=5, block_rows=37).collect()}
    one = {r.vec_id: r.pred for r in knn_classify(test, train, "vec_id", "vec", "label", k=5).collect()}
    assert many == one and len(one) == test.count()
    tr = train.orderBy("vec_id").collect()
    t_vec = np.array([r.vec for r in tr])
    t_lab = np.array([r.label for r in tr])
    for r in test.collect():
        d = np.sqrt(((t_vec - np.array(r.vec)) ** 2).sum(axis=1))
        nn = np.lexsort((np.arange(len(d)), d))[:5]
        counts = np.bincount(t_lab[nn])
        assert one[r.vec_id] == int(np.argmax(counts))


def test_token_filter_edge_cases(spark):
    toks = ["", "--", "a", "7", "(x)", "ok", "[PAD]", "##ing", "é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(toks)], "pos int, token string")
    kept = [r.token for r in AT.filter_tokens(df, "token").orderBy("pos").collect()]
    assert kept == ["7", "(x)", "ok"]


def test_padding_counts_unless_left_out(spark):
    from runlens.operators.attribution import pair_metrics
    rows = [(1, 0, [0.9, 0.1, -0.5, 7.0, 7.0], [0.8, 0.3, -0.4, -7.0, 7.0], [1, 1, 1, 0, 0]), (2, 0, [1.0, 2.0], [2.0, 1.0], [1, 1])]
    df = spark.createDataFrame(rows, "example_id int, t_label int, t_vec array<double>, s_vec array<double>, mask array<int>")
    whole = {r.example_id: r for r in pair_metrics(df, 2).collect()}
    real = {r.example_id: r for r in pair_metrics(df, 2, mask="mask", include_padding=False).collect()}
    short = {r.example_id: r for r in pair_metrics(spark.createDataFrame([(1, 0, rows[0][2][:3], rows[0][3][:3])],
                                                                        "example_id int, t_label int, t_vec array<double>, s_vec array<double>"), 2).collect()}
    assert real[1] == short[1] and real[2] == whole[2] and whole[1].top10_overlap != 0 and abs(whole[1].correlation - real[1].correlation) > 0.1
    with pytest.raises(ValueError):
        pair_metrics(df, include_padding=False)
