
import pytest
from pyspark.sql import functions as F

from runlens.operators import metrics as M
from runlens.operators import runs as R


def test_t3_delta_exactly_threshold_is_overfitting(spark):
    # 0.5 - 0.499 is not exactly 0.001 in binary; build the delta from exact halves instead.
    df = spark.createDataFrame([("r", 1, 1, 0.0), ("r", 2, 2, 0.0009765625)], "run_name string, epoch int, ord long, metric double")
    out = R.convergence_status(df, threshold=0.0009765625).collect()[0]
    assert out.delta == 0.0009765625 and out.status == "Overfitting"


def test_t8_rounding_uses_engine_round(spark):
    assert spark.range(1).select(F.round(F.lit(2.675), 2)).collect()[0][0] == 2.68


def test_t9_std_of_one_row_is_null(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert df.agg(F.stddev_samp("x")).collect()[0][0] is None


def test_t10_contains_matches_longer_token(spark):
    df = spark.createDataFrame([("pkd_skip_L6_B10",), ("pkd_skip_L60_B10",)], "n string")
    assert df.where(F.col("n").contains("L6")).count() == 2
    assert df.where(F.col("n").rlike(r"_L6(_|$)")).count() == 1


def test_t15_unknown_layer_strategy_fails(spark):
    sizes = spark.createDataFrame([(6,)], "student_layers int")
    with pytest.raises(ValueError):
        M.layer_map(sizes, "student_layers", 12, strategies=["skip", "middle"])


def test_t2_binary_float_difference(spark):
    df = spark.createDataFrame([("r", 1, 1, 0.7242), ("r", 2, 2, 0.7252)], "run_name string, epoch int, ord long, metric double")
    assert R.convergence_status(df).collect()[0].status == "Still improving"
