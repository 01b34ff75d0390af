"""An append-only results table that keeps every key once, with any number of writers.

A batch is a folder of Parquet files; it belongs to the table once the next number of
the log names it. The log file is created exclusively, so of two writers that saw the
same table one is first; the other drops the keys that came in meanwhile and tries
again. Readers only read folders the log names: a writer that dies leaves nothing visible.

A bitmap of the hashed keys of every data file (``SLOTS`` bits in words of 64) lies
beside the data. An append writes its batch, asks the bitmaps which files can hold one of its keys and reads
the keys of these files only; a batch of few keys touches few files, whatever the
table's size. Rows of a batch are dealt to files by ranges of the key's hash, so that a
file's bits lie together.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlens.operators.ranking import first_per_key, null_safe_join

#: Bits of a file's bitmap, and the rows a data file should hold.
SLOTS, FILE_ROWS = 1 << 15, 1 << 20


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _slot(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS))


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))


@dataclass(frozen=True)
class Commit:
    number: int
    folder: str
    batch: str
    mapped: str  # "1" if the folder has bitmaps


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """The table's batches in the order in which they came (one entry per append)."""
    fs, at = _file_system(spark, f"{path}/_log")
    if not fs.exists(at):
        return []
    rows = spark.read.text(f"{path}/_log").select(F.col("_metadata.file_name").alias("n"), "value").collect()
    return sorted((Commit(int(r["n"]), *r["value"].split("\t")) for r in rows), key=lambda c: c.number)


def read_results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table: the folders that the log names."""
    folders = [f"{path}/{c.folder}" for c in commits(spark, path)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


_BITMAP = "file string, word long, bits long"


def touched_files(spark: SparkSession, path: str, since: Sequence[Commit], folder: str) -> list[str]:
    """The data files (or folders without bitmaps) of these batches that may hold a key of the batch in ``folder``."""
    mapped = [f"{path}/_keys/{c.folder}" for c in since if c.mapped]
    unmapped = [f"{path}/{c.folder}" for c in since if not c.mapped]
    if not mapped:
        return unmapped
    asked = spark.read.schema(_BITMAP).parquet(f"{path}/_keys/{folder}").groupBy("word").agg(F.bit_or("bits").alias("asked"))
    known = spark.read.schema(_BITMAP).parquet(*mapped)
    hit = known.join(F.broadcast(asked), "word").where(F.col("bits").bitwiseAND(F.col("asked")) != 0)  # at most SLOTS / 64 words
    return unmapped + sorted(r["file"] for r in hit.select("file").distinct().collect())


class Append:
    """One batch on its way into the table: ``prepare`` writes it beside the table, ``commit`` makes it part of it."""

    def __init__(self, rows: DataFrame, path: str, keys: Sequence[str], batch: str = ""):
        self.spark, self.path, self.keys, self.batch, self.schema = rows.sparkSession, path, list(keys), batch, rows.schema
        self.rows, self.seen, self.folder, self.read, self.mapped = rows, 0, "", [], ""

    def prepare(self, check: bool = True) -> bool:
        """Drop the keys that the batches since the last look hold, write the rest; False if the batch id is in the log already.
        ``check=False`` for rows whose keys are known to be new; they get no bitmaps."""
        log = commits(self.spark, self.path)
        if self.batch and any(c.batch == self.batch for c in log):
            self._forget()
            return False
        since = [c for c in log if c.number > self.seen] if check else []
        if not self.folder:
            self._write(self.rows, check)  # evaluated once; as it is the batch, unless a key of it is known
        self.read = touched_files(self.spark, self.path, since, self.folder) if since else []
        if self.read:
            known = self.spark.read.schema(self.schema).parquet(*self.read).select(*self.keys)
            self._write(null_safe_join(self.rows, known, self.keys, "left_anti"), check)
        self.seen = max((c.number for c in log), default=0)
        return True

    def _write(self, new: DataFrame, mapped: bool) -> None:
        before, self.folder = self.folder, f"batch-{uuid.uuid4().hex}"
        at = f"{self.path}/{self.folder}"
        new.write.parquet(at)
        self.rows = self.spark.read.schema(self.schema).parquet(at)
        if mapped:
            slots = self.rows.select(F.col("_metadata.file_path").alias("file"), _slot(self.keys).alias("s"))
            bits = slots.groupBy("file", F.expr("s div 64").alias("word")).agg(F.bit_or(_bit(F.col("s"))).alias("bits"))
            bits.write.parquet(f"{self.path}/_keys/{self.folder}")
        self.mapped = "1" if mapped else ""
        if before:
            self._delete(before)

    def commit(self) -> bool:
        """Take the next number of the log; False if another writer has it."""
        fs, at = _file_system(self.spark, f"{self.path}/_log/{self.seen + 1:020d}")
        try:
            out = fs.create(at, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()) or fs.exists(at):
                return False
            raise
        out.write(bytearray(f"{self.folder}\t{self.batch}\t{self.mapped}".encode()))
        out.close()
        return True

    def _delete(self, folder: str) -> None:
        for part in (folder, f"_keys/{folder}"):
            fs, at = _file_system(self.spark, f"{self.path}/{part}")
            fs.delete(at, True)

    def _forget(self) -> None:
        if self.folder:
            self._delete(self.folder)
            self.folder = ""


def append_results(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (), batch: str = "") -> Append:
    """S06 + J01: append the rows whose keys the table at ``path`` lacks (it is created on first use);
    of several rows of one key the first by ``order`` is kept. Null keys are keys. Running it again appends
    nothing; a ``batch`` id that the log holds is not looked at again."""
    rows = first_per_key(df, keys, order)
    files = max(1, -(-df.count() // FILE_ROWS))
    dealt = rows.withColumn("_file", F.call_function("div", _slot(keys) * files, F.lit(SLOTS)).cast("int")).repartitionById(files, "_file")
    return _finish(Append(dealt.drop("_file"), path, keys, batch))


def append_new(df: DataFrame, path: str, keys: Sequence[str], batch: str) -> Append:
    """Append rows whose keys are known to be new and unique, once per ``batch`` id."""
    return _finish(Append(df, path, keys, batch), check=False)


def _finish(append: Append, check: bool = True) -> Append:
    while append.prepare(check):
        if append.commit():
            break
    return append
