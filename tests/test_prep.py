"""Preparation operators: label parsing, text cleaning traps, exact split
sizes, resume idempotence."""

import pytest
from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.operators import prep as P
from runlens.operators.positions import number_rows
from runlens.session import scratch_path
from runlens.sources.results import append_results, read_results
from runlens.sources import io as IO


def test_label_parse_reference_cases(spark):
    vals = ["3.0", " ", None, "abc", "3.7", "inf", "-2.5"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s string")
    out = {r.i: (r.label, r.reason) for r in P.parse_labels(df, "s").collect()}
    assert out == {0: (3, None), 1: (None, "blank"), 2: (None, "missing"), 3: (None, "not_a_number"),
                   4: (3, None), 5: (None, "not_finite"), 6: (-2, None)}


def test_label_range_strict_fails(spark):
    df = spark.createDataFrame([(1,), (7,)], "label long")
    assert P.label_range_report(df).collect()[0].n_out_of_range == 1
    import pytest
    with pytest.raises(Exception):
        P.label_range_report(df, strict=True).collect()


def test_python_strip_and_tag_order(spark):
    df = spark.createDataFrame([(" \t <b>Héllo</b> World \n",)], "t string")
    after = df.select(T.normalize_text("t", tags="after")).collect()[0][0]
    before = df.select(T.normalize_text("t", tags="before")).collect()[0][0]
    assert after == "héllo world"
    assert before == "héllo world"
    df2 = spark.createDataFrame([("<p> x</p>",)], "t string")
    assert df2.select(T.normalize_text("t", tags="after")).collect()[0][0] == " x"  # blanks left by a tag survive
    assert df2.select(T.normalize_text("t", tags="before")).collect()[0][0] == "x"


def test_stratified_split_exact_sizes(spark):
    n = 52978
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 5).alias("label"))
    s = P.stratified_split(df, "label", "k", 0.1, 0.1111, seed=42)
    sizes = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes == {"train": 42382, "dev": 5298, "test": 5298}
    assert s.select("k").distinct().count() == n  # disjoint and complete


def test_stratified_split_labelled_sizes(spark):
    rows = [(i, 0) for i in range(58)] + [(100 + i, 1) for i in range(341)]
    df = spark.createDataFrame(rows, "k long, label int")
    s = P.stratified_split(df, "label", "k", 0.1, None)
    got = {r.label: r["count"] for r in s.where("split = 'test'").groupBy("label").count().collect()}
    assert got == {0: 6, 1: 34}


def test_global_index_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g"))
    out = number_rows(df.repartition(5), ["v"], partition_by=["g"], name="i")
    for r in out.groupBy("g").agg(F.min("i"), F.max("i"), F.count("*"), F.countDistinct("i")).collect():
        assert r[1] == 0 and r[2] == r[3] - 1 and r[3] == r[4]


def test_append_results_idempotent(spark):
    path = scratch_path(spark, "test-append")
    df = spark.createDataFrame([("r1", 1, 0.5), ("r1", 2, 0.6)], "run_name string, epoch int, m double")
    append_results(df, path, ["run_name", "epoch"])
    append_results(df, path, ["run_name", "epoch"])
    assert read_results(spark, path, df.schema).count() == 2


def test_checkpoint_catalog_parses_and_rejects(spark):
    paths = spark.createDataFrame([("/m/vanilla_L6_A0p5_T10/checkpoint-2650",), ("/m/pkd_last_L4_B500/checkpoint-5300",),
                                   ("/m/tmp_L3/checkpoint-1",)], "path string")
    cat, rej = IO.checkpoint_catalog(paths)
    rows = {r.strategy: r for r in cat.collect()}
    assert rows["vanilla"].alpha == 0.5 and rows["vanilla"].temperature == 10.0 and rows["vanilla"].epoch == 2
    assert rows["pkd_last"].beta == 500.0 and rows["pkd_last"].layers == 4 and rows["pkd_last"].epoch == 4
    assert rej.count() == 1


def _hot_frame(spark):
    # One group holds 60 % of the rows and spans many tasks; 997 small groups.
    return spark.range(60000).select(
        F.when(F.col("id") < 36000, F.lit("hot")).otherwise(
            F.concat(F.lit("g"), (F.col("id") % 997).cast("string"))).alias("g"),
        F.col("id").alias("o"), ((F.col("id") * 7919) % 100003).cast("double").alias("v")).repartition(7)


@pytest.mark.parametrize("rows", [1 << 20, 3000])
def test_positional_operators_match_windows_on_hot_group(spark, monkeypatch, rows):
    from pyspark.sql import Window

    from runlens.operators import positions
    monkeypatch.setattr(positions, "ROWS", rows)
    df = _hot_frame(spark)
    w = Window.partitionBy("g").orderBy("o")
    a = positions.running_max_before(df, "g", ["o"], "v")
    b = df.withColumn("prev_best", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    gi = number_rows(df, ["o"], partition_by=["g"], name="i")
    rb = df.withColumn("i", F.row_number().over(w) - 1)
    assert gi.exceptAll(rb).count() == 0 and rb.exceptAll(gi).count() == 0
    g0 = number_rows(df, ["-v", "o"], name="i")
    r0 = df.withColumn("i", F.row_number().over(Window.orderBy(F.col("v").desc(), "o")) - 1)
    assert g0.exceptAll(r0).count() == 0
    p = positions.with_previous(df, "g", ["o"], "v")
    q = df.select("*", F.lag("v").over(w).alias("previous"), F.first("v").over(w).alias("first"), (F.row_number().over(w) - 1).alias("number"))
    assert p.exceptAll(q).count() == 0 and q.exceptAll(p).count() == 0


def test_runs_binding_equals_a_window_per_run(spark, sf_dir):
    from pyspark.sql import Window

    from runlens.sources.bindings import runs
    from runlens.sources.tables import read_table
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    a = runs(spark, sf_dir).select("ord", "epoch")
    b = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.row_number().over(w).alias("epoch"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_batches_of_wide_rows_are_cut_into_small_blocks(spark, monkeypatch):
    from runlens.operators import positions
    monkeypatch.setattr(P, "WIDE_ROWS", 40, raising=False)
    seen = []
    cut = positions.cut_blocks

    def watched(*args):
        found = cut(*args)
        seen.append(max(found[1].values()))
        return found

    monkeypatch.setattr(positions, "cut_blocks", watched)
    rows = [(i // 2, [i % 7] * (i % 11)) for i in range(500)]
    got = P.pad_batches(spark.createDataFrame(rows, "k long, ids array<int>").repartition(5), "k", "ids", 8).collect()
    assert max(seen) <= 80  # twice the wanted size at most, not the whole table
    want = sorted(rows)
    by: dict[int, list] = {}
    for i, (k, ids) in enumerate(want):
        by.setdefault(i // 8, []).append((k, ids))
    assert sorted((r.batch_id, r.k, r.ids, r.padded_len, r.input_ids) for r in got) == sorted(
        (b, k, ids, max(len(x) for _, x in part), ids + [0] * (max(len(x) for _, x in part) - len(ids))) for b, part in by.items() for k, ids in part)
