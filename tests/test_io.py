"""Sources, sinks, streaming ingest and plan shape."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.plans import load_all
from runlens.session import scratch_path
from runlens.sources import io as IO
from runlens.sources.results import read_results
from runlens.streaming.ingest import ingest_once

TRICKY = ['plain', 'comma, inside', 'quote " inside', '""', '', '  leading and trailing  ', 'tab\there',
          'line\nbreak', 'crlf\r\nbreak', 'ünïcödé ✓', None]


@pytest.mark.parametrize("sep", [",", "\t"])
def test_delimited_round_trip_keeps_every_string(spark, sep):
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("s", T.StringType())])
    df = spark.createDataFrame(list(enumerate(TRICKY)), schema)
    path = scratch_path(spark, "test-delimited")
    IO.write_delimited(df, path, sep=sep)
    back = {r.i: r.s for r in IO.read_delimited(spark, path, schema, sep=sep, multi_line=True).collect()}
    # Empty strings come back missing, as with pandas.read_csv; every other value is kept exactly.
    assert back == {i: (None if s == "" else s) for i, s in enumerate(TRICKY)}


def test_optional_source_missing_is_empty(spark):
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert IO.optional_source(spark, scratch_path(spark, "nothing-here"), schema).count() == 0


def test_split_table_prunes_partitions(spark):
    df = spark.range(30).select(F.col("id"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    path = scratch_path(spark, "test-splits")
    IO.write_splits(df, path)
    only = IO.read_splits(spark, path, ["test"])
    assert only.count() == 10
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "test" in plan


def test_ingest_is_restartable_and_idempotent(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])
    inbox, out, ckpt = (scratch_path(spark, n) for n in ("t-inbox", "t-out", "t-ckpt"))
    spark.range(10).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v")).write.parquet(f"{inbox}/b=1")
    ingest_once(spark, inbox, out, ckpt, schema, ["k"])
    ingest_once(spark, inbox, out, ckpt, schema, ["k"])          # nothing new: nothing appended
    spark.range(5, 15).select(F.col("id").alias("k"), F.lit(0.0).alias("v")).write.parquet(f"{inbox}/b=2")
    ingest_once(spark, inbox, out, ckpt, schema, ["k"])          # re-delivered keys 5..9 are skipped
    got = read_results(spark, out, schema)
    assert got.count() == 15 and got.select("k").distinct().count() == 15
    assert got.where("k = 7").collect()[0].v == 7.0              # the first copy is kept


def test_no_query_plans_cartesian_or_nested_loop_joins(spark, sf_dir):
    queries, _ = load_all()
    for name, fn in queries.items():
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_report_written_in_order(spark, sf_dir):
    from runlens.plans import report as REP
    from runlens.sources.bindings import runs
    lines = REP.report_lines(runs(spark, sf_dir))
    path = scratch_path(spark, "test-report")
    REP.write_report(lines, path)
    written = [r.value for r in spark.read.text(path).collect()]
    expected = [r.line for r in lines.orderBy("section_no", "ord").collect()]
    assert written == expected
    assert written[0].startswith("Total evaluations: ") and any(w.startswith("1. run_") for w in written)
