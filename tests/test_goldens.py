"""Golden results re-typed in FIXTURES.md (committed reports of the
experiment this engine analyses), run through the operators."""

import pytest
from pyspark.sql import functions as F

from runlens.operators import runs as R
from runlens.operators.ranking import best_per_group

VANILLA = [  # ord, run_name, alpha, temperature, step, epoch, acc, loss
    (1, "vanilla_L6_A0p2_T10", 0.2, 10.0, 5300, 4, 0.7486, 0.6573),
    (2, "vanilla_L6_A0p2_T20", 0.2, 20.0, 5300, 4, 0.7516, 0.6599),
    (3, "vanilla_L6_A0p2_T5", 0.2, 5.0, 5300, 4, 0.7499, 0.6552),
    (4, "vanilla_L6_A0p5_T10", 0.5, 10.0, 5300, 4, 0.7541, 0.6465),
    (5, "vanilla_L6_A0p5_T20", 0.5, 20.0, 5300, 4, 0.7535, 0.6468),
    (6, "vanilla_L6_A0p5_T5", 0.5, 5.0, 5300, 4, 0.7539, 0.646),
    (7, "vanilla_L6_A0p7_T10", 0.7, 10.0, 5300, 4, 0.755, 0.6423),
    (8, "vanilla_L6_A0p7_T20", 0.7, 20.0, 5300, 4, 0.7548, 0.6426),
    (9, "vanilla_L6_A0p7_T5", 0.7, 5.0, 5300, 4, 0.7559, 0.6416),
    (10, "vanilla_L6_A0p7_T10", 0.7, 10.0, 1325, 1, 0.7529, 0.6545),
    (11, "vanilla_L6_A0p7_T10", 0.7, 10.0, 2650, 2, 0.7541, 0.6485),
    (12, "vanilla_L6_A0p7_T10", 0.7, 10.0, 3975, 3, 0.7561, 0.6422),
    (13, "vanilla_L6_A0p7_T20", 0.7, 20.0, 1325, 1, 0.7525, 0.655),
    (14, "vanilla_L6_A0p7_T20", 0.7, 20.0, 2650, 2, 0.7533, 0.6483),
    (15, "vanilla_L6_A0p7_T20", 0.7, 20.0, 3975, 3, 0.7563, 0.6423),
    (16, "vanilla_L6_A0p7_T5", 0.7, 5.0, 1325, 1, 0.752, 0.6523),
    (17, "vanilla_L6_A0p7_T5", 0.7, 5.0, 2650, 2, 0.7541, 0.6477),
    (18, "vanilla_L6_A0p7_T5", 0.7, 5.0, 3975, 3, 0.7556, 0.6418),
]
COLS = "ord long, run_name string, alpha double, temperature double, step int, epoch int, dev_accuracy double, dev_loss double"

SKIP = {  # run: (layers, beta, [(acc, loss) for epochs 1..4])
    "pkd_skip_L2_B10": (2, 10.0, [(0.6442, 0.947), (0.6727, 0.8893), (0.6776, 0.8653), (0.6816, 0.864)]),
    "pkd_skip_L2_B100": (2, 100.0, [(0.6467, 0.9456), (0.6733, 0.8895), (0.678, 0.8658), (0.6791, 0.8646)]),
    "pkd_skip_L2_B1000": (2, 1000.0, [(0.648, 0.9431), (0.6712, 0.8877), (0.6784, 0.865), (0.682, 0.8642)]),
    "pkd_skip_L2_B500": (2, 500.0, [(0.6495, 0.9452), (0.6708, 0.889), (0.6799, 0.8658), (0.6827, 0.8649)]),
    "pkd_skip_L3_B10": (3, 10.0, [(0.7089, 0.787), (0.7216, 0.7508), (0.7257, 0.7373), (0.7259, 0.7373)]),
    "pkd_skip_L3_B100": (3, 100.0, [(0.7095, 0.787), (0.721, 0.7519), (0.7237, 0.7374), (0.7252, 0.7372)]),
    "pkd_skip_L3_B1000": (3, 1000.0, [(0.7099, 0.7855), (0.7197, 0.7538), (0.7248, 0.7391), (0.7263, 0.739)]),
    "pkd_skip_L3_B500": (3, 500.0, [(0.7089, 0.7864), (0.722, 0.7533), (0.7242, 0.7385), (0.7252, 0.7385)]),
    "pkd_skip_L4_B10": (4, 10.0, [(0.7346, 0.6821), (0.741, 0.6764), (0.7433, 0.6711), (0.7442, 0.6673)]),
    "pkd_skip_L4_B100": (4, 100.0, [(0.7331, 0.6788), (0.7429, 0.6748), (0.7446, 0.6727), (0.7444, 0.6684)]),
    "pkd_skip_L4_B1000": (4, 1000.0, [(0.7327, 0.6815), (0.7418, 0.6773), (0.7442, 0.6728), (0.7439, 0.6699)]),
    "pkd_skip_L4_B500": (4, 500.0, [(0.7335, 0.6799), (0.7442, 0.6758), (0.7441, 0.6722), (0.7439, 0.6688)]),
    "pkd_skip_L6_B10": (6, 10.0, [(0.7522, 0.6493), (0.7527, 0.6448), (0.7537, 0.6411), (0.7542, 0.6407)]),
    "pkd_skip_L6_B100": (6, 100.0, [(0.7535, 0.6536), (0.7529, 0.6489), (0.7559, 0.6423), (0.7542, 0.6428)]),
    "pkd_skip_L6_B1000": (6, 1000.0, [(0.7541, 0.659), (0.7552, 0.6533), (0.7576, 0.6446), (0.7552, 0.6451)]),
    "pkd_skip_L6_B500": (6, 500.0, [(0.7524, 0.6566), (0.7531, 0.6513), (0.7559, 0.6437), (0.755, 0.6443)]),
}
LAST = {
    "pkd_last_L2_B500": (2, 500.0, [(0.6461, 0.9349), (0.6784, 0.8728), (0.6869, 0.8499), (0.6882, 0.8477)]),
    "pkd_last_L3_B500": (3, 500.0, [(0.7114, 0.7765), (0.7223, 0.7489), (0.7286, 0.7329), (0.7267, 0.7313)]),
    "pkd_last_L4_B500": (4, 500.0, [(0.7384, 0.6685), (0.7458, 0.6709), (0.7484, 0.6711), (0.7482, 0.6659)]),
    "pkd_last_L6_B500": (6, 500.0, [(0.7576, 0.6555), (0.7554, 0.6459), (0.7578, 0.6409), (0.7575, 0.6376)]),
}
PKD_COLS = "ord long, run_name string, student_layers int, beta double, epoch int, dev_accuracy double, dev_loss double"


def pkd_rows(table):
    rows, o = [], 0
    for run, (layers, beta, eps) in table.items():
        for e, (acc, loss) in enumerate(eps, start=1):
            o += 1
            rows.append((o, run, layers, beta, e, acc, loss))
    return rows


@pytest.fixture(scope="module")
def vanilla(spark):
    return spark.createDataFrame(VANILLA, COLS)


@pytest.fixture(scope="module")
def skip(spark):
    return spark.createDataFrame(pkd_rows(SKIP), PKD_COLS)


@pytest.fixture(scope="module")
def last(spark):
    return spark.createDataFrame(pkd_rows(LAST), PKD_COLS)


def test_best_overall_vanilla(vanilla):
    r = R.best_overall(vanilla, "dev_accuracy", "ord").collect()[0]
    assert (r.run_name, r.epoch, r.step, r.dev_accuracy, r.dev_loss) == ("vanilla_L6_A0p7_T20", 3, 3975, 0.7563, 0.6423)


def test_best_per_run_vanilla(vanilla):
    rows = R.best_per(vanilla, ["run_name"], "dev_accuracy", "ord").orderBy(F.desc("dev_accuracy"), "ord").collect()
    assert len(rows) == 9
    assert rows[0].dev_accuracy == 0.7563 and rows[-1].dev_accuracy == 0.7486


def test_best_per_epoch_tie_takes_first_row(vanilla):
    rows = {r.epoch: r for r in R.best_per(vanilla, ["epoch"], "dev_accuracy", "ord").collect()}
    assert rows[1].run_name.endswith("T10") and rows[1].dev_accuracy == 0.7529
    assert rows[2].run_name == "vanilla_L6_A0p7_T10" and rows[2].dev_accuracy == 0.7541  # tie with T5: first row
    assert rows[3].run_name.endswith("T20") and rows[3].dev_accuracy == 0.7563
    assert rows[4].run_name.endswith("A0p7_T5") and rows[4].dev_accuracy == 0.7559


def test_param_effect_vanilla(vanilla):
    rows = {(r.param, r.value): round(r.mean_metric, 4)
            for r in R.param_effect(vanilla, ["alpha", "temperature"], "dev_accuracy").collect()}
    assert rows[("alpha", "0.7")] == 0.7552 and rows[("alpha", "0.5")] == 0.7538 and rows[("alpha", "0.2")] == 0.75
    assert rows[("temperature", "20.0")] == 0.7533 and rows[("temperature", "5.0")] == 0.7532
    assert rows[("temperature", "10.0")] == 0.7526


def test_convergence_vanilla(vanilla):
    rows = {r.run_name: (r.status, round(r.delta, 4))
            for r in R.convergence_status(vanilla, metric="dev_accuracy").collect()}
    assert rows == {"vanilla_L6_A0p7_T10": ("Overfitting", -0.0011), "vanilla_L6_A0p7_T20": ("Overfitting", -0.0015),
                    "vanilla_L6_A0p7_T5": ("Converged", 0.0003)}


def test_convergence_binary_float_threshold(skip):
    rows = {r.run_name: r.status for r in R.convergence_status(skip, metric="dev_accuracy").collect()}
    assert len(rows) == 16
    assert rows["pkd_skip_L3_B500"] == "Still improving"  # 0.7252 - 0.7242 = 0.0010000000000000009


def test_run_profile_vanilla(vanilla):
    r = R.run_profile(vanilla).collect()[0]
    assert (r.n_rows, r.n_runs, r.mean, r.min, r.q25, r.q50, r.q75, r.max) == (18, 9, 2.0, 1.0, 1.0, 1.0, 4.0, 4.0)
    assert round(r.std, 1) == 1.5


def test_adaptive_top_n_vanilla(vanilla):
    fin = vanilla.where(F.col("step") == 5300)
    names = [r.run_name for r in R.adaptive_top_n(fin, "dev_accuracy", "ord").orderBy("rank").collect()]
    assert names == ["vanilla_L6_A0p7_T5", "vanilla_L6_A0p7_T10", "vanilla_L6_A0p7_T20"]


def test_best_per_size_and_beta(skip):
    by_size = {r.student_layers: (r.run_name, r.epoch, r.dev_accuracy)
               for r in R.best_per(skip, ["student_layers"], "dev_accuracy", "ord").collect()}
    assert by_size == {6: ("pkd_skip_L6_B1000", 3, 0.7576), 4: ("pkd_skip_L4_B100", 3, 0.7446),
                       3: ("pkd_skip_L3_B1000", 4, 0.7263), 2: ("pkd_skip_L2_B500", 4, 0.6827)}
    by_beta = {r.beta: (r.run_name, r.epoch, r.dev_accuracy)
               for r in R.best_per(skip, ["beta"], "dev_accuracy", "ord").collect()}
    assert by_beta[10.0] == ("pkd_skip_L6_B10", 4, 0.7542)
    assert by_beta[100.0] == ("pkd_skip_L6_B100", 3, 0.7559)
    assert by_beta[500.0] == ("pkd_skip_L6_B500", 3, 0.7559)
    assert by_beta[1000.0] == ("pkd_skip_L6_B1000", 3, 0.7576)


def _best_by_size(df):
    return df.groupBy("student_layers").agg(F.max("dev_accuracy").alias("best")).withColumnRenamed(
        "student_layers", "size")


def test_vs_vanilla_and_smallest_matching(vanilla, skip, last):
    base = vanilla.select(F.max("dev_accuracy")).scalar()
    g = {r.size: (round(r.gain, 4), round(r.gain_pct, 2)) for r in R.vs_baseline(_best_by_size(skip), "best", base).collect()}
    assert g[6] == (0.0013, 0.17)
    sm = R.smallest_matching(_best_by_size(skip), base).collect()
    assert [(r.smallest_size, r.compression_pct) for r in sm] == [(6, 50.0)]
    g_last = {r.size: round(r.gain, 4) for r in R.vs_baseline(_best_by_size(last), "best", base).collect()}
    assert g_last[6] == 0.0015


def test_strategy_compare_and_wins(skip, last):
    s500 = _best_by_size(skip.where(F.col("beta") == 500.0))
    cmp = {r.size: (r.a_value, r.b_value, round(r.diff, 4), round(r.rel_pct, 2), r.winner)
           for r in R.strategy_compare(_best_by_size(last), s500, "size", "best").collect()}
    assert cmp[6] == (0.7578, 0.7559, 0.0019, 0.25, "LAST")
    assert cmp[4] == (0.7484, 0.7442, 0.0042, 0.56, "LAST")
    assert cmp[3] == (0.7286, 0.7252, 0.0034, 0.47, "LAST")
    assert cmp[2] == (0.6882, 0.6827, 0.0055, 0.81, "LAST")


def test_best_per_group_keeps_first_on_ties(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "a", 0.5)], "ord long, g string, m double")
    assert best_per_group(df, ["g"], "m", "ord").collect()[0].ord == 1
