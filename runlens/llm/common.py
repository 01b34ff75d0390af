"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.session import scratch_path, ship

__all__ = ["WORD", "column", "file_system", "free", "group_key", "materialise", "ship", "slices", "without", "word_count"]

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that a task works on, and hands back, at once.
SLICE = 2 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts lineage in the shared folder, so a lost executor re-reads files, and
    gives Catalyst the true size of the side when it picks a join strategy.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(path: str):
    """File system and path in it; any scheme that Arrow knows."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def without(df: DataFrame, names) -> list[str]:
    """Columns of ``df`` that do not clash (case-insensitively) with ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in parts of about ``size`` bytes: a batch may hold a whole task's texts."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def column(df: DataFrame, name: str) -> Column:
    """A column by its literal name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def free(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if a column of ``df`` has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def group_key(c: Column) -> Column:
    """A non-null string key that keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))
