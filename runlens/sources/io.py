"""Sources and sinks: delimited text, split-partitioned tables, JSON
documents and checkpoint catalogs (the results table is in ``results``).

Readers take explicit schemas (no inference pass over the data); writers are
plain DataFrame writers, so both scale with the number of files and tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# RFC-4180 style quoting: quotes doubled, fields with separators, quotes or
# line breaks quoted, whitespace kept as is.
_CSV_WRITE = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
              "ignoreTrailingWhiteSpace": "false", "lineSep": "\n"}
_CSV_READ = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false", "mode": "FAILFAST"}


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "error",
                    rows_per_file: int = 50_000) -> None:
    """CSV/TSV sink of the chosen columns (no index column). Files are bounded, as a file
    whose fields hold line breaks is read by one task."""
    (df.write.mode(mode).options(**_CSV_WRITE).option("sep", sep).option("header", str(header).lower())
     .option("maxRecordsPerFile", rows_per_file)
     .option("emptyValue", '""').csv(path))


def read_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = ",", header: bool = True,
                   multi_line: bool = False) -> DataFrame:
    """CSV scan with header, doubled quotes and embedded separators, under an
    explicit schema. Empty fields read as null, like ``pandas.read_csv``. Files are split
    at line breaks; ``multi_line`` admits line breaks in fields, at one task per file."""
    return (spark.read.schema(schema).options(**_CSV_READ).option("sep", sep).option("multiLine", str(multi_line).lower())
            .option("header", str(header).lower()).csv(path))


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "error") -> None:
    """One table partitioned by split name (train/dev/test directories)."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def read_splits(spark: SparkSession, path: str, splits: Sequence[str] | None = ("train", "dev", "test"),
                split_col: str = "split") -> DataFrame:
    """Read the split table; a split subset is a partition filter, so
    only those directories are listed and scanned."""
    df = spark.read.parquet(path)
    return df.where(F.col(split_col).isin(*splits)) if splits else df


def training_curves(states: DataFrame, run: str = "run_name", step: str = "checkpoint_step",
                    log: str = "log_history", fields: Sequence[str] = ("epoch", "loss", "learning_rate", "grad_norm"),
                    ) -> DataFrame:
    """From trainer-state documents, the last checkpoint of every run,
    its log entries that carry a training loss, missing fields as 0."""
    last = states.groupBy(run).agg(F.max(step).alias(step))
    docs = states.join(last, [run, step], "left_semi")
    entries = docs.select(run, F.inline(log))
    keep = entries.where(F.col("loss").isNotNull())
    return keep.select(run, "step", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in fields])


# S05 catalog: run directory names of the three families and their checkpoints.
RUN_DIR_PATTERN = r"^(vanilla|pkd_skip|pkd_last)_L([0-9]+)(?:_A([0-9]+p[0-9]+)_T([0-9]+)|_B([0-9]+))$"
CHECKPOINT_DIR_PATTERN = r"^checkpoint-[0-9]+$"
STEPS_PER_EPOCH = 1325


def checkpoint_catalog(paths: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(catalog, rejects). Parses family, layers, alpha, temperature, beta
    and step out of ``.../<run dir>/checkpoint-<step>`` paths; names that do
    not parse go to rejects. One anchored match validates the short directory
    names; the fields are then cut out with plain string functions."""
    parts = F.split(F.col(path), "/")
    run_dir, leaf = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    ok = F.coalesce((F.size(parts) >= 2) & run_dir.rlike(RUN_DIR_PATTERN) & leaf.rlike(CHECKPOINT_DIR_PATTERN), F.lit(False))
    x = paths.where(ok).withColumns({"_run": run_dir, "_leaf": leaf})
    toks = F.split("_run", "_")
    vanilla = F.startswith(F.col("_run"), F.lit("vanilla_"))
    off = F.when(vanilla, 1).otherwise(2)           # tokens after the family name
    field = lambda i: F.substr(F.get(toks, off + i), F.lit(2))  # noqa: E731  drop the L/A/T/B tag
    parsed = x.select(
        *paths.columns,
        F.when(vanilla, "vanilla").otherwise(F.concat_ws("_", F.get(toks, 0), F.get(toks, 1))).alias("strategy"),
        field(0).try_cast("int").alias("layers"),
        F.when(vanilla, F.replace(field(1), F.lit("p"), F.lit("."))).try_cast("double").alias("alpha"),
        F.when(vanilla, field(2)).try_cast("double").alias("temperature"),
        F.when(~vanilla, field(1)).try_cast("double").alias("beta"),
        F.substring_index("_leaf", "-", -1).try_cast("int").alias("step"),
    ).withColumn("epoch", F.expr(f"step div {STEPS_PER_EPOCH}").cast("int"))
    return parsed, paths.where(~ok)


def write_documents(df: DataFrame, path: str, partition_by: str, mode: str = "error") -> None:
    """One JSON document per row, UTF-8, a directory per partition value."""
    df.write.mode(mode).partitionBy(partition_by).json(path)


def optional_source(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The table at ``path`` if it exists, else an empty frame of the
    declared schema (a missing optional input contributes nothing)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath):
        return spark.read.schema(schema).format(fmt).load(path)
    return spark.createDataFrame([], schema)
