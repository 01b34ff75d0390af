"""Nulls, NaN, ties, uncommon labels and hot groups: nothing is lost and nothing wins by accident."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runlens.functions import vec as V
from runlens.operators import metrics as M
from runlens.operators import prep as P
from runlens.operators import runs as R
from runlens.operators.positions import number_rows, running_max_before
from runlens.operators.ranking import best_per_group
from runlens.plans import report as REP
from runlens.session import scratch_path
from runlens.sources import io as IO
from runlens.sources.results import append_results, read_results


def test_null_groups_are_numbered(spark):
    rows = [("a", 1), ("a", 2), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "g string, o int")
    assert sorted((r.g or "", r.o, r.i) for r in number_rows(df, ["o"], partition_by=["g"], name="i").collect()) == [
        ("", 3, 0), ("", 4, 1), ("a", 1, 0), ("a", 2, 1)]
    chain = R.chain_degradation(df.withColumn("m", F.col("o") * 1.0), "g", ["o"], "m").collect()
    assert sorted((r.g or "", r.stage, r.delta_prev, r.delta_root) for r in chain if r.stage == 2) == [("", 2, 1.0, 1.0), ("a", 2, 1.0, 1.0)]
    assert len(chain) == 4


@pytest.mark.parametrize("prefix", [1, 3])
def test_stratified_split_against_sorting(spark, monkeypatch, prefix):
    import hashlib
    monkeypatch.setattr(P, "SPLIT_PREFIX", prefix)
    rng = random.Random(1)
    rows = [(i, None if rng.random() < 0.1 else 0 if rng.random() < 0.6 else rng.randint(1, 3)) for i in range(1200)]
    got = {r.k: r.split for r in P.stratified_split(spark.createDataFrame(rows, "k int, label int"), "label", "k").collect()}
    assert len(got) == len(rows)
    size = {s: sum(v == s for v in got.values()) for s in ("test", "dev", "train")}
    assert size["test"] == math.ceil(0.1 * 1200) and size["dev"] == math.ceil(0.1111 * (1200 - size["test"]))
    for label in (None, 0, 1, 2, 3):  # each split is a run of the class's hash order
        order = sorted((hashlib.md5(f"42:{k}".encode()).hexdigest(), k) for k, v in rows if v == label)
        splits = [got[k] for _, k in order]
        assert splits == sorted(splits, key=["test", "dev", "train"].index)


def test_running_best_with_nulls_and_nan(spark):
    rows = [(None, 1, 2.0), (None, 2, 1.0), (None, 3, 3.0), ("a", 1, None), ("a", 2, float("nan")), ("a", 3, 1.0), ("a", 4, 1.0)]
    got = {(r.g, r.o): (r.prev_best, r.is_new_best) for r in R.running_best(
        spark.createDataFrame(rows, "g string, o int, m double"), "g", ["o"], "m").collect()}
    assert got[(None, 1)] == (None, True) and got[(None, 2)] == (2.0, False) and got[(None, 3)] == (2.0, True)
    assert [got[("a", o)] for o in (1, 2, 3, 4)] == [(None, False), (None, False), (None, True), (1.0, False)]
    whole = spark.createDataFrame([("g", 1, 5), ("g", 2, 7)], "g string, o int, v int")
    assert running_max_before(whole, "g", ["o"], "v").schema["prev_best"].dataType.simpleString() == "int"


def test_nan_never_wins(spark):
    df = spark.createDataFrame([("a", float("nan"), 1), ("a", 0.5, 2), ("b", None, 3), ("b", float("nan"), 4)], "g string, m double, ord int")
    assert [(r.g, r.ord) for r in best_per_group(df, ["g"], "m", "ord").collect()] == [("a", 2)]


def test_confusion_has_every_label(spark):
    df = spark.createDataFrame([(1, 12, 12), (2, 3, 77), (3, None, 3)], "vec_id int, label int, pred int")
    got = {(r.label, r.pred): r.n for r in M.confusion_long(df).collect()}
    assert sum(got.values()) == 2 and got[(3, 77)] == 1 and len(got) == 9  # a null label is no class


def test_catalog_keeps_unparsable_paths(spark):
    paths = ["/m/vanilla_L6_A0p5_T4/checkpoint-1325", None, "x", ""]
    good, bad = IO.checkpoint_catalog(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert good.count() == 1 and bad.count() == 3


def test_append_keeps_the_first_row_and_null_keys_once(spark):
    path = scratch_path(spark, "append")
    df = spark.createDataFrame([("r", 1, 0.9, 7), ("r", 1, 0.1, 3), (None, 1, 0.5, 1)], "run string, epoch int, metric double, ord int")
    for _ in range(3):
        append_results(df.repartition(3), path, ["run", "epoch"], ["ord"])
    assert sorted((r.run or "", r.metric) for r in read_results(spark, path, df.schema).collect()) == [("", 0.5), ("r", 0.1)]


def test_pearson_of_constant_and_offset_vectors(spark):
    pairs = [([0.1] * 7, [float(i) for i in range(7)]), ([1e9 + 1, 1e9 + 2, 1e9 + 4], [1.0, 2.0, 4.0]), ([1.0, 2.0], [2.0, 1.0]), ([], [])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    got = [r.p for r in df.orderBy("i").select(V.pearson("a", "b").alias("p")).collect()]
    assert got[0] is None and got[1] == pytest.approx(1) and got[2] == pytest.approx(-1) and got[3] is None


def test_labels_are_numbers_as_python_reads_them(spark):
    texts = ["3.0f", "2d", "1e300", "inf", "-2.9", "1_0", ".5", "5.", "0x1", "nan", "1e2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row int, s string")
    got = {texts[r.row]: (r.label, r.reason) for r in P.parse_labels(df, "s").collect()}
    assert got == {"3.0f": (None, "not_a_number"), "2d": (None, "not_a_number"), "1e300": (None, "out_of_range"), "inf": (None, "not_finite"),
                   "-2.9": (-2, None), "1_0": (10, None), ".5": (0, None), "5.": (5, None), "0x1": (None, "not_a_number"),
                   "nan": (None, "not_finite"), "1e2": (100, None)}
    with pytest.raises(PySparkException, match="bad label 2d: not_a_number, row=1"):
        P.parse_labels(df.where("row = 1"), "s", strict=True, where=["row"]).collect()


def test_report_lists_every_run(spark):
    rows = [(f"run_{i}", e, i + e / 10, "x", "t", 10 * i + e) for i in range(15) for e in (1, 2)]
    lines = REP.report_lines(spark.createDataFrame(rows, "run_name string, epoch int, metric double, alpha string, temperature string, ord long"))
    by = {}
    for r in lines.orderBy("section_no", "ord").collect():
        by.setdefault(r.section, []).append(r.line)
    assert len(by["best_per_run"]) == len(by["convergence"]) == 15 and len(by["all_evaluations"]) == 30 and len(by["best_per_epoch"]) == 2
    assert by["best_per_run"][0] == "1. run_14 epoch 2: 14.2000" and by["convergence"][0] == "run_0: epoch 1 0.1000 -> epoch 2 0.2000, change +0.1000 (Still improving)"


def test_knn_ties(spark):
    from runlens.operators.knn import knn_classify
    train = spark.createDataFrame([(i, [1.0, 2.0], 0 if i < 5 else 1) for i in range(500)], "k int, v array<double>, l int")
    query = spark.createDataFrame([(1000, [1.0, 2.0]), (1001, [0.0, 0.0])], "k int, v array<double>")
    for block in (64, 8192):
        assert {r.k: r.pred for r in knn_classify(query, train, "k", "v", "l", 5, block).collect()} == {1000: 0, 1001: 0}


def test_knn_without_structure_sends_back_little(spark):
    from runlens.operators.knn import nearest
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)], 0) for i in range(460)]
    frame = lambda part: spark.createDataFrame(part, "k long, v array<double>, l int")
    got = nearest(frame(rows[:60]), frame(rows[60:]), "k", "v", "l", 5, 16)
    found: dict[int, list] = {}
    for r in got.collect():
        found.setdefault(r.query_key, []).append((r.dist, r.train_key))
    for k, v, _ in rows[:60]:
        assert [t for _, t in sorted(found[k])[:5]] == [t for _, t in sorted((math.dist(v, w), t) for t, w, _ in rows[60:])[:5]]
        assert len(found[k]) == len(set(found[k]))
    # all blocks are met (25 at least), but only rows within the radius of the first round come back
    assert sum(map(len, found.values())) < 60 * 25 * 5 / 2


@pytest.mark.parametrize("block", [16, 8192])
def test_knn_against_all_distances(spark, block):
    from runlens.operators.knn import knn_classify, nearest
    rng = random.Random(8)
    centres = [[rng.gauss(0, 30) for _ in range(6)] for _ in range(12)]

    def row(i):
        c = centres[0] if i % 3 == 0 else rng.choice(centres)  # a hot cluster
        return i, [x + rng.gauss(0, 1) for x in c], rng.randint(0, 3)

    train = [row(i) for i in range(700)] + [(800, [1.0, 2.0], 3), (801, [1.0, 2.5], 2), (802, [], 1), (803, None, 1), (804, [float("nan")] * 6, 1),
                                            (805, [None] * 6, 1), (None, centres[0], 1), (806, centres[1], None), (807, [float("inf")] * 6, 1)]
    query = [(10_000 + i, row(i)[1]) for i in range(120)] + [(20_000, [1.0, 2.2]), (20_001, [1.0, 2.0, 3.0]), (20_002, []), (20_003, None), (20_004, [0.0] * 6)]
    t = spark.createDataFrame(train, "k long, v array<double>, l int")
    q = spark.createDataFrame(query, "k long, v array<double>")
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    want = {}
    for i, v in query:
        near = sorted((math.dist(v, w), k, lab) for k, w, lab in train if k is not None and lab is not None and fine(w) and len(w) == len(v))[:5] if fine(v) else []
        votes = [lab for _, _, lab in near]
        if votes:
            want[i] = min(set(votes), key=lambda lab: (-votes.count(lab), lab))
    assert {r.k: r.pred for r in knn_classify(q, t, "k", "v", "l", 5, block).collect()} == want
    if block == 16:  # rows met, of all pairs of a query and a training row
        met = nearest(q, t, "k", "v", "l", 5, block).groupBy("query_key").agg(F.sum("met") / 5).collect()
        assert sum(r[1] for r in met) < 0.5 * 120 * 700
    assert knn_classify(q, t.limit(0), "k", "v", "l").count() == 0 and knn_classify(q.limit(0), t, "k", "v", "l").count() == 0


@pytest.mark.parametrize("block", [3, 7, 2048])
def test_pareto_front_of_real_objectives(spark, block):
    from runlens.operators.stats import pareto_front
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), float(rng.randint(1, 9))) for i in range(300)]
    rows += [(900, *rows[5][1:]), (901, None, 1.0, 0.0), (902, float("nan"), 1.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    real = [r for r in rows if r[0] < 901]
    want = sorted(r[0] for r in real if not any(
        y[1] >= r[1] and y[2] >= r[2] and y[3] <= r[3] and y[1:] != r[1:] for y in real))
    assert sorted(r.i for r in pareto_front(df.repartition(4), ["a", "b"], ["c"], block).collect()) == want


def test_pair_truncation_is_longest_first(spark):
    vocab = spark.createDataFrame([(f"w{i}", i + 2) for i in range(400)], "word string, word_id int")
    rng = random.Random(3)
    rows = [(i, [f"w{rng.randrange(450)}" for _ in range(rng.randint(0, 30))], [f"w{rng.randrange(450)}" for _ in range(rng.randint(0, 30))])
            for i in range(120)]
    got = {r.i: r for r in P.encode_pairs(spark.createDataFrame(rows, "i int, a array<string>, b array<string>"), ["i"], "a", "b", vocab, 24).collect()}
    for i, a, b in rows:
        a, b = list(a), list(b)
        while len(a) + len(b) > 21:
            (a if len(a) > len(b) else b).pop()
        ids = lambda ws: [int(w[1:]) + 2 if int(w[1:]) < 400 else P.UNK_ID for w in ws]
        want = [P.CLS_ID, *ids(a), P.SEP_ID, *ids(b), P.SEP_ID]
        assert got[i].input_ids == want + [P.PAD_ID] * (24 - len(want)) and sum(got[i].attention_mask) == got[i].n_tokens == len(want)


def test_a_hot_customer_keeps_its_epochs(spark, tmp_path):
    import datetime

    from runlens.sources.bindings import runs
    rng = random.Random(4)
    rows = [(i, 1 if i % 5 < 3 else rng.randint(2, 9) if i % 7 else None, datetime.date(2024, 1, 1 + rng.randrange(20)), 1.0 * i, "p", "F") for i in range(500)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderpriority string, o_orderstatus string"
                          ).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.ord: r.epoch for r in runs(spark, str(tmp_path)).collect()}
    for cust in {r[1] for r in rows}:
        order = sorted((r[2], r[0]) for r in rows if r[1] == cust)
        assert [got[k] for _, k in order] == list(range(1, len(order) + 1))


def test_p_values_by_numeric_integration(spark):
    from runlens.functions.stats import t_cdf, two_sided_p

    def tail(t, n):  # midpoint rule of the density, t = tan(x) * sqrt(n)
        c = math.gamma((n + 1) / 2) / math.gamma(n / 2) / math.sqrt(math.pi)
        a, m = math.atan(t / math.sqrt(n)), 20_000
        return 2 * c * sum(math.cos(a + (math.pi / 2 - a) * (i + 0.5) / m) ** (n - 1) for i in range(m)) * (math.pi / 2 - a) / m

    rows = [(t, n) for n in (1, 2, 3, 4, 5, 6, 7, 30, 31) for t in (0.0, 0.7, 2.5)]
    df = spark.createDataFrame(rows, "t double, n int").withColumn("p", two_sided_p(-F.col("t"), F.col("n")))
    for r in df.collect():
        assert r.p == pytest.approx(tail(r.t, r.n), abs=1e-6), r
        assert 2 * (1 - t_cdf(r.t, r.n)) == pytest.approx(r.p, abs=1e-12)
    assert spark.createDataFrame([(1.0, 0), (None, 5), (float("nan"), 5)], "t double, n int").select(two_sided_p(F.col("t"), F.col("n")).alias("p")).distinct().collect() == [(None,)]


def test_bow_rows_are_spread_before_the_fit(spark, monkeypatch):
    """Iterations read even files of vectors, not the plan that made the training rows (here one part)."""
    from runlens.operators import models as MD

    texts = [(f"good fine {'word' * (i % 3)} t{i % 7}", 1) if i % 2 else (f"bad poor {'word' * (i % 2)} t{i % 5}", 0) for i in range(60)]
    rows = spark.createDataFrame(texts, "text string, label int").coalesce(1)
    seen, plain = [], MD._logistic

    def logistic(train, *rest):
        seen.append(train)
        return plain(train, *rest)

    monkeypatch.setattr(MD, "_logistic", logistic)
    scored = MD.bow_baseline(rows, rows, "text", "label", vocab_size=20, max_iter=50).collect()
    assert len(scored) == 60 and all(r["prediction"] == r["label"] for r in scored)
    assert seen[0].inputFiles() and seen[0].count() == 60
    sizes = [r["n"] for r in seen[0].groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) <= 60 / len(sizes) + 8
