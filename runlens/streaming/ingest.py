"""Incremental, restartable ingest of result files.

New files in the input folder are picked up by a file-source stream. Which keys have
been seen is the stream's own state: one entry per key in Spark's state store (RocksDB,
dealt by key, checkpointed as changes), so a micro-batch costs what its own rows cost,
whatever the table holds, and a key that comes back after any time is known.
With ``event_time`` and ``delay`` the state forgets keys that old, and what
comes later than that is dropped, as ``dropDuplicatesWithinWatermark`` does.

A micro-batch enters the table under its number: replayed after a crash, it finds its claim in
the log and appends nothing (``runlens.sources.results``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlens.sources.results import append_new

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_arrivals(stream: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Per key that a micro-batch touches: its first row ever, and whether that row is of this batch.

    All rows of a micro-batch carry the batch's time. A key whose earliest and latest times
    are equal is new; of several rows of one batch the first by ``order``, then by the other columns, counts."""
    rest = [c for c in stream.columns if c not in keys]
    lead = [c for c in order if c in rest]
    first = F.min(F.struct("_arrival", *lead, *[c for c in rest if c not in lead])).alias("_first")
    seen = stream.withColumn("_arrival", F.current_timestamp()).groupBy(*keys).agg(first, F.max("_arrival").alias("_latest"))
    return seen.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in stream.columns],
                       (F.col("_first._arrival") == F.col("_latest")).alias("_new"))


def ingest_once(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str,
                schema: StructType, keys: Sequence[str], fmt: str = "parquet",
                max_files_per_trigger: int | None = None, order: Sequence[str] = (),
                event_time: str | None = None, delay: str = "7 days") -> None:
    """Process every file that arrived since the last run, then stop
    (``trigger(availableNow=True)``). Read the result with ``read_results``."""
    spark.conf.set(STATE_STORE, ROCKS_DB)
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(input_dir)
    if event_time:
        found = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys)).withColumn("_new", F.lit(True))
    else:
        found = first_arrivals(stream, keys, order)

    def append(batch: DataFrame, batch_id: int) -> None:
        append_new(batch.where("_new").drop("_new"), output_dir, keys, f"{checkpoint_dir}#{batch_id}")

    q = (found.writeStream.outputMode("append" if event_time else "update").foreachBatch(append)
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
