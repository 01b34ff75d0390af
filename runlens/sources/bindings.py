"""Experiment-shaped views over the driver's test tables.

Each view renames columns of a test table into the roles the operators use
(run, epoch, metric, hyperparameters, score vectors, texts). The same views are
written as SQL common table expressions in ``runlens.plans.oracle`` so the
DuckDB check runs on identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.positions import number_rows
from runlens.sources.tables import read_table

# Word pattern shared by every tokenising operator (letters, digits, underscore,
# at least two characters). Written with Unicode classes so that the JVM and
# RE2 engines tokenise accented text identically.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def runs_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result table: one row per (run, epoch) evaluation, runs by number.

    run_id <- customer of the order, epoch <- position of the order within
    the customer's orders by date, metric <- total price, alpha <- priority,
    temperature <- status, ord <- order key (unique, the file-order tie-break).

    A real results table carries its epochs; this adapter derives them with
    ``number_rows``: one exchange by customer, which aggregates, windows and joins by
    ``run_id`` share, and a customer with many orders is spread over blocks.
    """
    o = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    o = number_rows(o, ["o_orderdate", "o_orderkey"], partition_by=["o_custkey"], name="n")
    return o.select(
        F.col("o_custkey").alias("run_id"),
        (F.col("n") + 1).cast("int").alias("epoch"),
        F.col("o_totalprice").alias("metric"),
        F.col("o_orderpriority").alias("alpha"),
        F.col("o_orderstatus").alias("temperature"),
        F.col("o_orderkey").alias("ord"),
    )


def run_name(run_id: str = "run_id") -> Column:
    return F.concat(F.lit("run_"), F.col(run_id).cast("string")).alias("run_name")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``runs_by_id`` with the runs' names."""
    return runs_by_id(spark, sf_dir).select(run_name(), "epoch", "metric", "alpha", "temperature", "ord")


def strategy_of(flag: Column) -> Column:
    return (F.when(flag == "A", "skip").when(flag == "R", "last").otherwise("vanilla"))


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distillation-strategy results: strategy <- return flag, size <- line number,
    metric <- extended price, beta <- line status."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        strategy_of(F.col("l_returnflag")).alias("strategy"),
        F.col("l_linenumber").alias("size"),
        F.col("l_extendedprice").alias("metric"),
        F.col("l_linestatus").alias("beta"),
        F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"),
        F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"),
    )


def labelled(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """Documents with their quality/toxic labels (left join keeps unlabelled)."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", how)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score vectors as double arrays: vec_id, label, vec (64 doubles)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher x student pairing per example: the teacher is row vec_id, the
    student is row vec_id + 1 (an equi-join on a computed key)."""
    v = vectors(spark, sf_dir)
    t = v.select(F.col("vec_id").alias("example_id"), F.col("label").alias("t_label"), F.col("vec").alias("t_vec"))
    s = v.select((F.col("vec_id") - 1).alias("example_id"), F.col("label").alias("s_label"), F.col("vec").alias("s_vec"))
    return t.join(s, "example_id")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word occurrence: doc_id, lang, source, pos (0-based), word."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    toks = F.regexp_extract_all(F.lower(F.col("text")), F.lit(WORD_PATTERN), 0)
    # posexplode_outer + not-null filter: a plain posexplode lets Catalyst infer
    # a size(tokens) > 0 filter below it that runs the tokeniser twice more.
    out = d.select("doc_id", "lang", "source", F.posexplode_outer(toks).alias("pos", "word"))
    return out.where(F.col("word").isNotNull())


def checkpoint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint directory names built from lineitem columns, some unparsable
    (``tmp_L<n>`` when the discount is 0). Built with ``concat`` of integer
    strings rather than ``format_string``, which is far slower per row."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    s = lambda c: c.cast("string")
    layers = s(F.col("l_linenumber"))
    step = (F.col("l_orderkey") % 4 + 1) * 1325
    run = (
        F.when(F.col("l_discount") == 0, F.concat(F.lit("tmp_L"), layers))
        .when(F.col("l_returnflag") == "A", F.concat(
            F.lit("pkd_skip_L"), layers, F.lit("_B"),
            s(F.element_at(F.array(*[F.lit(v) for v in (1, 10, 100, 1000)]), (F.col("l_suppkey") % 4 + 1).cast("int")))))
        .when(F.col("l_returnflag") == "R", F.concat(
            F.lit("pkd_last_L"), layers, F.lit("_B"), s((F.col("l_suppkey") % 4 + 1) * 250)))
        .otherwise(F.concat(F.lit("vanilla_L"), layers, F.lit("_A0p"), s(F.col("l_suppkey") % 9 + 1),
                            F.lit("_T"), s(F.col("l_partkey") % 20 + 1)))
    )
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat(F.lit("/models/"), run, F.lit("/checkpoint-"), s(step)).alias("path"),
    )
