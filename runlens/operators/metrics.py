"""Classification metrics and distillation losses over score-vector tables.

Confusion counts are one hash aggregate (at most classes^2 groups); every
metric is derived from that small table, so the data are scanned once.
Losses are row expressions (``runlens.functions.vec``) reduced by aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import vec as V
from runlens.functions.arrays import posexplode_rows

LAYER_STRATEGIES = ["skip", "last"]


# ------------------------------------------------------------------ metrics

def predictions(df: DataFrame, logits: Column, label: str = "label", key: str = "vec_id") -> DataFrame:
    """A09/V21 input: argmax prediction per row (first index on ties)."""
    return df.select(key, F.col(label).alias("label"), V.argmax(logits).alias("pred"))


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.count(F.lit(1)).alias("n"),
                    F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def confusion_counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def _class_counts(pred: DataFrame) -> DataFrame:
    """Per class: true positives, predictions and support, from one pass: each
    cell of the confusion table counts for its label and for its prediction."""
    n, hit = F.col("n"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    cells = confusion_counts(pred).select(F.explode(F.array(
        F.struct(F.col("label").cast("int").alias("class"), hit.alias("tp"), F.lit(0).cast("bigint").alias("n_pred"), n.alias("support")),
        F.struct(F.col("pred").cast("int").alias("class"), F.lit(0).cast("bigint").alias("tp"), n.alias("n_pred"),
                 F.lit(0).cast("bigint").alias("support")))).alias("c")).select("c.*")
    return cells.where("class is not null").groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("support").cast("bigint").alias("support"))


def _scores(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = counts.withColumns({"precision": ratio("tp", "n_pred"), "recall": ratio("tp", "support")})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0)))


def per_class_prf(pred: DataFrame) -> DataFrame:
    """A10: precision, recall, F1 and support per class (0 where undefined)."""
    return _scores(_class_counts(pred)).select("class", "precision", "recall", "support", "f1")


def confusion_long(pred: DataFrame, classes: Sequence[int] | None = None) -> DataFrame:
    """Zero-filled confusion matrix in long form over the labels that occur
    (as label or prediction) and ``classes``: classes x classes rows."""
    cc = confusion_counts(pred)
    occur = cc.agg(F.collect_set("label").alias("a"), F.collect_set("pred").alias("b"))  # as many values as classes
    more = F.array(*[F.lit(int(c)) for c in classes or ()]).cast("array<int>")
    every = F.array_distinct(F.concat(F.col("a").cast("array<int>"), F.col("b").cast("array<int>"), more))
    grid = occur.select(every.alias("c")).select("c", F.explode("c").alias("label")).select("label", F.explode("c").alias("pred"))
    return grid.join(cc, ["label", "pred"], "left").select("label", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(pred: DataFrame) -> DataFrame:
    """Per-class rows plus accuracy, macro avg and weighted avg rows, all
    from one pass: each class counts for its own row and for the three others."""
    one, size = F.lit(1.0), F.col("support").cast("double")
    rows = _scores(_class_counts(pred)).select("*", F.explode(F.array(*[
        F.struct(name.alias("row_name"), weight.alias("weight")) for name, weight in (
            (F.col("class").cast("string"), one), (F.lit("accuracy"), one), (F.lit("macro avg"), one), (F.lit("weighted avg"), size))
    ])).alias("r")).select("*", "r.*")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum("weight"))
    whole = F.col("row_name") == "accuracy"
    out = rows.groupBy("row_name").agg(
        mean("precision").alias("precision"), mean("recall").alias("recall"), mean("f1").alias("f1"),
        F.sum("support").cast("bigint").alias("support"), F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("share"))
    return out.select(
        "row_name", F.when(~whole, F.col("precision")).alias("precision"), F.when(~whole, F.col("recall")).alias("recall"),
        F.when(whole, F.col("share")).otherwise(F.col("f1")).alias("f1"), "support")


def mean_vector(df: DataFrame, keys: Sequence[str], arr: str) -> DataFrame:
    """Element-wise mean vector per group in long form (keys, pos, mean), by array-valued
    sums: a row stays a row until the shuffle. Null elements don't count; vectors of several
    lengths are summed apart and meet as sums."""
    present = F.transform(arr, lambda x: F.when(x.isNull(), 0.0).otherwise(1.0))
    values = F.transform(arr, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    rows = df.where(F.size(arr) > 0).select(*keys, F.size(arr).alias("_size"), array_to_vector(F.concat(values, present)).alias("_v"))
    sums = rows.groupBy(*keys, "_size").agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("_s"))
    both = F.arrays_zip(F.slice("_s", F.lit(1), F.col("_size")).alias("x"), F.slice("_s", F.col("_size") + 1, F.col("_size")).alias("n"))
    long = posexplode_rows(sums, keys, both, "pos", "_e")
    return long.groupBy(*keys, "pos").agg(F.try_divide(F.sum("_e.x"), F.sum("_e.n")).alias("mean"))


# ------------------------------------------------------------------ losses

def kd_loss(pairs: DataFrame, t_logits: Column, s_logits: Column, temperatures: Sequence[float]) -> DataFrame:
    """KL(teacher || student) of temperature-softened distributions,
    summed over classes, divided by the number of examples, times T^2; one row
    per temperature (temperature, n_pairs, kl)."""
    temps = F.array(*[F.lit(float(t)) for t in temperatures])
    x = pairs.select(F.explode(temps).alias("temperature"), t_logits.alias("_t"), s_logits.alias("_s"))
    x = x.select("temperature", V.kl_row("_t", "_s", F.col("temperature")).alias("_kl"))
    return x.groupBy("temperature").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        (F.sum("_kl") / F.count(F.lit(1)) * F.col("temperature") * F.col("temperature")).alias("kl"))


def layer_map(sizes: DataFrame, size_col: str, teacher_layers: int,
              strategies: Sequence[str] = LAYER_STRATEGIES) -> DataFrame:
    """Student layer i -> teacher layer for the first S = size - 1 student
    layers: skip t = 2i + 1; last t = Nt - S - 1 + i; pairs with t >= Nt stop."""
    unknown = set(strategies) - set(LAYER_STRATEGIES)
    if unknown:
        raise ValueError(f"unknown layer strategy {sorted(unknown)}; expected {LAYER_STRATEGIES}")
    x = sizes.select(F.col(size_col).alias("student_layers"),
                     F.explode(F.array(*[F.lit(v) for v in strategies])).alias("strategy"))
    x = x.select("strategy", "student_layers",
                 F.explode(F.sequence(F.lit(0), F.greatest(F.col("student_layers") - 2, F.lit(0)))).alias("s_idx"))
    x = x.where(F.col("s_idx") < F.col("student_layers") - 1)
    t = (F.when(F.col("strategy") == "skip", 2 * F.col("s_idx") + 1)
         .otherwise(F.lit(teacher_layers) - (F.col("student_layers") - 1) - 1 + F.col("s_idx")))
    return x.select("strategy", "student_layers", F.col("s_idx").cast("int").alias("s_idx"),
                    t.cast("int").alias("t_idx")).where((F.col("t_idx") < teacher_layers) & (F.col("t_idx") >= 0))


def patient_loss(student: DataFrame, teacher: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per strategy, the sum over mapped (student, teacher) layer pairs of
    the mean squared difference of L2-normalised states.

    ``student``: (ex, s_idx, s_state); ``teacher``: (ex, t_idx, t_state);
    ``mapping``: (strategy, s_idx, t_idx), bounded by the layer counts."""
    j = student.join(F.broadcast(mapping), "s_idx").join(teacher, ["ex", "t_idx"])
    return _mapped_loss(j.select("strategy", "s_idx", V.l2_normalize("s_state").alias("a"), V.l2_normalize("t_state").alias("b")), F.size("a"))


def _mapped_loss(states: DataFrame, size) -> DataFrame:
    sq = F.aggregate(F.zip_with("a", "b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x) / size
    per_pair = states.groupBy("strategy", "s_idx").agg(F.avg(sq).alias("mse"))
    return per_pair.groupBy("strategy").agg(F.sum("mse").alias("loss"))


def patient_loss_from_vectors(v: DataFrame, teacher_layers: int, student_layers: int, dim: int) -> DataFrame:
    """V07 on the vectors binding: teacher states are row i reshaped to
    teacher_layers x dim, student states the first student_layers x dim values
    of row i + 1. The vectors are joined whole; mapped layers are cut out of the pair."""
    teacher = v.select(F.col("vec_id").alias("ex"), F.col("vec").alias("t"))
    student = v.select((F.col("vec_id") - 1).alias("ex"), F.col("vec").alias("s"))
    sizes = v.sparkSession.range(1).select(F.lit(student_layers).alias("student_layers"))
    mapping = layer_map(sizes, "student_layers", teacher_layers).drop("student_layers").collect()  # layers x strategies rows
    pairs = F.array(*[F.struct(*[F.lit(m[c]).alias(c) for c in ("strategy", "s_idx", "t_idx")]) for m in mapping])
    state = lambda c, i: V.l2_normalize(F.slice(c, F.col(i) * dim + 1, F.lit(dim)))
    j = teacher.join(student, "ex").select("t", "s", F.inline(pairs)).select("strategy", "s_idx", state("s", "s_idx").alias("a"), state("t", "t_idx").alias("b"))
    return _mapped_loss(j, dim)


def combined_loss(kd: DataFrame, ce, pt, alphas: Sequence[float], betas: Sequence[float]) -> DataFrame:
    """(1 - alpha) * CE + alpha * KD(T) + beta * PT over the (alpha, beta, T)
    grid; ``kd`` has one row per temperature, ``ce``/``pt`` are scalars."""
    x = kd.select("temperature", "kl",
                  F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    x = x.select("*", F.explode(F.array(*[F.lit(float(b)) for b in betas])).alias("beta"))
    return x.select("alpha", "beta", "temperature",
                    ((1 - F.col("alpha")) * ce + F.col("alpha") * F.col("kl") + F.col("beta") * pt).alias("loss"))
