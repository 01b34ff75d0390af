"""Blocks, numbers and quantiles on awkward keys, and the results table with several writers."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import positions as P
from runlens.operators import prep
from runlens.operators import runs as R
from runlens.session import scratch_path
from runlens.sources import results as RES
from runlens.sources.results import read_results
from runlens.streaming.ingest import first_arrivals, ingest_once

WIDE = "k long, s string, d date, t timestamp, x double, b boolean, g string"


def wide_rows(n=1500):
    rng = random.Random(5)
    words = ["", "a", "common-", "é", "\U0001f600", None]
    day = datetime.date(2024, 1, 1)
    rows = []
    for i in range(n):
        s = rng.choice(words)
        s = s if s is None or rng.random() < 0.3 else s + str(rng.randrange(900))
        rows.append((i, s, None if i % 97 == 0 else day + datetime.timedelta(days=rng.randrange(3) if i % 2 else rng.randrange(2000)),
                     datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=rng.randrange(5000)),
                     rng.choice([0.0, None, float("nan"), float("inf"), -float("inf"), rng.gauss(0, 1), 10.0 ** rng.randrange(-300, 300)]),
                     rng.choice([True, False, None]), rng.choice(["hot", "hot", None, "c"])))
    return rows


@pytest.mark.parametrize("order", [["s", "k"], ["-d", "k"], ["x", "-k"], ["-x", "t", "k"], ["b", "-s", "k"]])
def test_numbers_equal_one_window(spark, monkeypatch, order):
    monkeypatch.setattr(P, "ROWS", 80)
    df = spark.createDataFrame(wide_rows(), WIDE).repartition(5)
    blocks, sizes = P.cut_blocks(df, order)
    assert len(sizes) > 10 and sum(sizes.values()) == 1500
    assert max(sizes.values()) <= 4 * P.ROWS  # ties don't pile up
    monkeypatch.setattr(P, "cut_blocks", lambda *_: (blocks, sizes))
    for part in ([], ["g"]):
        got = P.number_rows(df, order, part, "i")
        want = df.withColumn("i", (F.row_number().over(Window.partitionBy(*part).orderBy(*P.sort_columns(order))) - 1).cast("long"))
        assert {(r.k, r.i) for r in got.collect()} == {(r.k, r.i) for r in want.collect()}


def test_chains_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 60)
    rng = random.Random(8)
    rows = [(g, rng.randrange(40), i, float(rng.randrange(100))) for i, g in enumerate(["hot"] * 400 + [None] * 150 + ["a"] * 60 + ["b"] * 7)]
    df = spark.createDataFrame(rows, "g string, epoch int, ord int, m double").repartition(4)
    w = Window.partitionBy("g").orderBy("epoch", "ord")
    want = df.select("ord", F.row_number().over(w).alias("stage"), (F.col("m") - F.lag("m").over(w)).alias("p"), (F.col("m") - F.first("m").over(w)).alias("r"),
                     F.max("m").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("best"))
    got = R.chain_degradation(df, "g", ["epoch", "ord"], "m").select("ord", "stage", "delta_prev", "delta_root")
    assert {tuple(r) for r in got.collect()} == {tuple(r)[:4] for r in want.collect()}
    best = R.running_best(df, "g", ["epoch", "ord"], "m").select("ord", "prev_best")
    assert {tuple(r) for r in best.collect()} == {(r.ord, r.best) for r in want.collect()}


def test_only_large_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 60)
    df = spark.createDataFrame([(g, i) for i, g in enumerate(["hot"] * 200 + ["a"] * 60 + [None] * 50)], "g string, k int")
    blocks, sizes = P.cut_groups(df, ["g"], ["k"])
    seen = {(r.g, r._block) for r in blocks.select("g", "_block").distinct().collect()}
    assert {b for g, b in seen if g != "hot"} == {-1} and sum(g == "hot" for g, _ in seen) >= 3 and blocks.count() == 310
    small = df.where("g <> 'hot' OR g IS NULL")
    assert len(P.cut_groups(small, ["g"], ["k"])[1]) == 1
    # rows of groups that all fit need one exchange
    numbered = P.number_rows(small, ["k"], ["g"])._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in numbered and "_block" not in numbered


def test_blocks_of_little_and_nothing(spark):
    df = spark.createDataFrame([], WIDE)
    assert P.number_rows(df, ["k"]).count() == 0 and P.with_previous(df, "g", ["k"], "x").count() == 0
    with pytest.raises(ValueError):
        P.with_previous(df, "g", ["-k"], "x")


@pytest.mark.parametrize("bins", [16])
def test_exact_quantiles(spark, monkeypatch, bins):
    monkeypatch.setattr(P, "BINS", bins)
    rng = random.Random(6)
    probs = [0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1]
    for values in ([5.0], [1.0, 2.0], [3.0] * 50 + [4.0], [rng.gauss(0, 1) for _ in range(999)], [2.0 ** rng.randrange(-20, 20) for _ in range(300)],
                   [1e308, -1e308, 1.7e308, -1.7e308, 0.0], [5e-324, 1e-323, 0.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        assert P.exact_quantiles(df, "v", probs) == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)
    assert P.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


def test_run_profile_in_one_row(spark):
    import pandas as pd
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", "c", None, "d", "hot", "hot"]),) for _ in range(500)]
    got = R.run_profile(spark.createDataFrame(rows, "run_name string")).collect()
    want = pd.Series([r[0] for r in rows]).value_counts(dropna=False).describe()
    assert len(got) == 1 and got[0].n_rows == 500 and got[0].n_runs == want["count"]
    assert [got[0][c] for c in ("mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(
        [want[c] for c in ("mean", "std", "min", "25%", "50%", "75%", "max")])


def test_nan_is_never_the_best(spark):
    df = spark.createDataFrame([("a", float("nan"), 1), ("b", 0.5, 2), ("c", None, 3), ("d", 0.5, 4), ("e", 0.1, 5)], "run string, m double, ord int")
    assert [r.run for r in R.best_overall(df, "m").collect()] == ["b"]
    assert sorted((r.rank, r.run) for r in R.leaderboard(df, "m", "ord").collect()) == [(1, "b"), (2, "d"), (3, "e"), (4, "a"), (5, "c")]
    assert [r.run for r in R.adaptive_top_n(df, "m", "ord").orderBy("rank").collect()] == ["b", "d", "e"]


def test_null_runs_are_runs(spark):
    rows = [(None, 1, 0.1, 5, "p"), (None, 2, 0.2, 6, "q"), ("a", 1, 0.3, 7, "r")]
    df = spark.createDataFrame(rows, "run string, epoch int, m double, ord int, param string")
    assert [r.ord for r in R.multi_row_groups(df, "run").orderBy("ord").collect()] == [5, 6]
    curves = R.learning_curves(df, "run", "epoch", "ord", ["param", "epoch", "ord"]).orderBy("ord").collect()
    assert [(r.run, r.ord, r.param_first, r.epoch_first, r.ord_first) for r in curves] == [(None, 5, "p", 1, 5), (None, 6, "p", 1, 5)]
    assert [r.run for r in R.resume_anti(df, df.where("run IS NULL"), ["run"]).collect()] == ["a"]
    from runlens.operators import stats as S
    docs = spark.createDataFrame([(None, 3, "x"), (None, 5, "y"), ("d", 1, "x")], "ds string, n int, cls string")
    assert S.dataset_profile(docs, "ds", "n", "cls").count() == 2 and S.class_entropy(docs, "ds", "cls").count() == 2


def test_documents_of_one_id_stay_apart(spark):
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "word string, word_id int")
    rows = [(1, ["a", "b", "a"]), (1, ["b", "z"]), (1, ["b", "z"]), (1, []), (1, []), (None, ["a"] * 9), (2, None)]
    df = spark.createDataFrame(rows, "doc_id int, tokens array<string>")
    got = sorted((str(r.doc_id), r.input_ids, r.n_tokens) for r in prep.encode_fixed_length(df, "tokens", vocab, 4).collect())
    assert got == sorted([("1", [2, 3, 2, 0], 3), ("1", [3, 1, 0, 0], 2), ("1", [3, 1, 0, 0], 2), ("1", [0] * 4, 0), ("1", [0] * 4, 0),
                          ("None", [2] * 4, 4), ("2", [0] * 4, 0)])
    ids = prep.token_ids(df, ["doc_id"], F.col("tokens"), vocab, "ids")
    batches = prep.pad_batches(ids, "doc_id", "ids", 3).collect()
    assert sorted(r.batch_id for r in batches) == [0, 0, 0, 1, 1, 1, 2]
    assert all(len(r.input_ids) == r.padded_len == max(len(x.ids) for x in batches if x.batch_id == r.batch_id) for r in batches)


# the results table

def result_rows(spark, keys, value):
    return spark.createDataFrame([(k, value) for k in keys], "k string, v int")


def stored(spark, path):
    got = [(r.k, r.v) for r in RES.read_results(spark, path, spark.createDataFrame([], "k string, v int").schema).collect()]
    assert len(got) == len({k for k, _ in got})
    return dict(got)


def test_two_writers_add_a_key_once(spark):
    path = scratch_path(spark, "two-writers")
    RES.append_results(result_rows(spark, ["a", None], 0), path, ["k"])
    one = RES.Append(result_rows(spark, ["a", "b", "c"], 1), path, ["k"])
    two = RES.Append(result_rows(spark, ["b", "c", "d", None], 2), path, ["k"])
    one.prepare()
    two.prepare()  # both have seen the same table
    assert one.commit() and not two.commit()
    assert stored(spark, path) == {"a": 0, None: 0, "b": 1, "c": 1}  # nothing of a writer that has no number
    RES._finish(two)
    assert stored(spark, path) == {"a": 0, None: 0, "b": 1, "c": 1, "d": 2}
    assert len(RES.commits(spark, path)) == 3


def test_an_append_reads_only_files_that_may_hold_its_keys(spark, monkeypatch):
    monkeypatch.setattr(RES, "FILE_ROWS", 500)
    path = scratch_path(spark, "pruned")
    RES.append_results(result_rows(spark, [f"run{i}" for i in range(5000)], 0), path, ["k"])
    for i in range(4):
        RES.append_results(result_rows(spark, [f"late{i}{j}" for j in range(3)], 1), path, ["k"])
    files = len(spark.read.parquet(*[f"{path}/_keys/{c.folder}" for c in RES.commits(spark, path)]).select("file").distinct().collect())
    assert files >= 10
    again = RES.append_results(result_rows(spark, ["late20", "late21"], 9), path, ["k"])
    assert 1 <= len(again.read) <= 4
    assert len(stored(spark, path)) == 5012 and stored(spark, path)["late20"] == 1


def test_a_batch_is_claimed_once(spark):
    path = scratch_path(spark, "claims")
    for _ in range(3):
        RES.append_new(result_rows(spark, ["a", "b"], 1), path, ["k"], "batch-7")
    RES.append_new(result_rows(spark, [], 1), path, ["k"], "batch-8")
    assert stored(spark, path) == {"a": 1, "b": 1} and [c.batch for c in RES.commits(spark, path)] == ["batch-7", "batch-8"]


# ingest

def test_late_repeats_are_known_without_reading_the_table(spark):
    inbox, out, ckpt = (scratch_path(spark, n) for n in ("late-inbox", "late-out", "late-ckpt"))
    schema = spark.createDataFrame([], "k long, v double, ord int").schema

    def deliver(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{inbox}/b={n}")

    deliver(1, [(1, 0.5, 9), (1, 0.1, 3), (2, 0.2, 1), (None, 0.3, 1)])
    ingest_once(spark, inbox, out, ckpt, schema, ["k"], order=["ord"])
    held = RES.commits(spark, out)
    for n in range(2, 5):
        deliver(n, [(1, 9.9, 0), (10 * n, 1.0, 1), (None, 9.9, 0)])
        ingest_once(spark, inbox, out, ckpt, schema, ["k"], order=["ord"])
    got = sorted((str(r.k), r.v) for r in read_results(spark, out, schema).collect())
    assert got == sorted([("1", 0.1), ("2", 0.2), ("None", 0.3), ("20", 1.0), ("30", 1.0), ("40", 1.0)])
    stream = first_arrivals(spark.readStream.schema(schema).parquet(inbox), ["k"])
    assert out not in stream._jdf.queryExecution().analyzed().toString()  # the table is no input
    assert RES.commits(spark, out)[:len(held)] == held


def test_ingest_with_a_watermark(spark):
    inbox, out, ckpt = (scratch_path(spark, n) for n in ("wm-inbox", "wm-out", "wm-ckpt"))
    schema = spark.createDataFrame([], "k long, at timestamp").schema
    day = lambda n: datetime.datetime(2024, 1, n)
    for n, rows in enumerate([[(1, day(1)), (2, day(1))], [(1, day(2)), (3, day(20))], [(3, day(21)), (4, day(21))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{inbox}/b={n}")
        ingest_once(spark, inbox, out, ckpt, schema, ["k"], event_time="at", delay="3 days")
    assert sorted(r.k for r in read_results(spark, out, schema).collect()) == [1, 2, 3, 4]
