"""Sharding: proportional stratified interleaving.

Rows are shuffled by a seed within their source and ranked; a row's fractional
rank is (rank + 1/2) / rows of its source. Sorting all rows by that fraction
spreads every source evenly over the whole order, so cutting the order into
equal runs gives shards that all match the mixture; counts differ by one at
most (the ``rows`` law).

Ranks come without a task per source and without a global sort: a seeded hash's
prefix splits each source into buckets, counts per bucket become offsets by a
prefix sum over that small table, and rows are numbered inside a bucket. The
fractional order is numbered in the same way over equal ranges of the fraction.
Only ids, hashes and sizes are shuffled, never texts.

Defined results: null text counts 8 bytes and has the checksum of no bytes (0);
the null source is a source of its own; rows with equal ids are told apart by
checksum and size, wholly equal rows are interchangeable; an empty table gives
no rows; input columns named as an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import column, group_key, materialise
from runlens.llm.mixing import seeded_order

#: Hex digits of the hash that form a bucket of a source.
PREFIX = 3
#: Ranges into which the fractional order is cut for numbering.
RANGES = 4096


def interleave(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", source_col: str = "source",
               text_col: str = "text", seed: str = "shard", ranges: int = RANGES) -> DataFrame:
    """(doc_id, source, size, text_crc32, position, shard, slot), one row per input row."""
    text = column(docs, text_col)
    size, crc = F.coalesce(F.octet_length(text), F.lit(0)) + 8, F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    rows = docs.select(column(docs, id_col).alias("doc_id"), column(docs, source_col).alias("source"),
                       group_key(column(docs, source_col)).alias("key"), size.cast("long").alias("size"),
                       crc.cast("long").alias("text_crc32"), seeded_order(column(docs, id_col), seed).alias("h"))
    rows = materialise(rows.withColumn("b", F.substring("h", 1, PREFIX)), "shard-rows")

    before = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("key", "b").agg(F.count(F.lit(1)).alias("n")).select(
        "key", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy("key")).alias("total"))
    inside = F.row_number().over(Window.partitionBy("key", "b").orderBy("h", "doc_id", "text_crc32", "size"))
    ranked = rows.join(offsets, ["key", "b"]).withColumn("rank", F.col("offset") + inside - 1).select(
        "doc_id", "source", "key", "size", "text_crc32", "rank",
        ((2 * F.col("rank") + 1) / (2 * F.col("total"))).alias("fraction"))
    ranked = materialise(ranked.withColumn("part", F.floor(F.col("fraction") * ranges).cast("int")), "shard-ranks")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    starts = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy()).alias("all_rows"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("fraction", "key", "rank"))
    placed = ranked.join(starts, "part").withColumn("position", F.col("start") + inside - 1)
    shard = F.expr(f"(position * {n_shards}) div all_rows")
    return placed.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", "position", F.col("shard").cast("int").alias("shard"),
        (F.col("position") - F.expr(f"(shard * all_rows + {n_shards - 1}) div {n_shards}")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, seed: str = "shard", **columns) -> None:
    """Write ``docs`` as one folder per shard, rows in slot order within each file.

    Documents are joined to their place by id, so ids must be unique here.
    """
    ident = columns.get("id_col", "doc_id")
    place = interleave(docs, n_shards, seed=seed, **columns).select(
        F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    (docs.join(place, column(docs, ident).eqNullSafe(F.col("_id"))).drop("_id")
     .repartitionByRange(F.col("_shard"), F.col("_slot")).sortWithinPartitions("_shard", "_slot")
     .write.partitionBy("_shard").parquet(path))
