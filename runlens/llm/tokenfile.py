"""Token ids in Arrow files: equal-length sequences and masks, zero-copy.

Documents, in ascending id order, form one stream of ids (an end id after each).
The stream is range-partitioned by id; each task writes its part as one Arrow
IPC file whose record batches hold ``ids`` (fixed-size list of unsigned
integers) and ``mask`` (fixed-size list of booleans, false on the padding of the
file's last sequence). All batches but the last have ``BATCH`` sequences, so the
place of any position follows by division, and a memory-mapped file gives numpy
views of it without a copy. An index row per document names file, place and
length.

A task writes under a name of its own attempt and moves the file into place
when complete; the index keeps the names that the successful attempts return,
so a lost executor leaves nothing half-written behind that is ever read.

Defined results: null text is empty and gives the end id alone; null ids come
first; rows with equal ids are ordered by a hash of the text, equal rows are
interchangeable; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import column, file_system, materialise, ship
from runlens.llm.tokens import crc32_u4, encode_column, encoder

#: Sequences per record batch.
BATCH = 128


def schema(length: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a stream of ids into equal sequences and writes them in batches."""

    def __init__(self, path: str, length: int, dtype: np.dtype):
        self._schema, self._length, self._dtype = schema(length, dtype), length, dtype
        self._fs, self._path = file_system(path)
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        self._sink = self._fs.open_output_stream(self._path + ".part")
        self._writer = pa.ipc.new_file(self._sink, self._schema)
        self._held: list[bytes] = []
        self._size, self.written = 0, 0

    def add(self, ids: bytes) -> None:
        self._held.append(ids)
        self._size += len(ids)
        self.written += len(ids) // self._dtype.itemsize
        if self._size >= self._length * BATCH * self._dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self._held), self._dtype)
        full = self._length * BATCH
        cut = len(ids) if last else len(ids) // full * full
        for at in range(0, cut, full):
            part = ids[at:min(at + full, cut)]
            n = -(-len(part) // self._length)
            padded, mask = np.zeros(n * self._length, self._dtype), np.zeros(n * self._length, bool)
            padded[:len(part)], mask[:len(part)] = part, True
            self._writer.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(padded), self._length),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask), self._length)], schema=self._schema))
        self._held = [ids[cut:].tobytes()]
        self._size = len(self._held[0])

    def close(self) -> None:
        self._flush(True)
        self._writer.close()
        self._sink.close()
        self._fs.move(self._path + ".part", self._path)


class SequenceReader:
    """Random access to the stream of one file."""

    def __init__(self, path: str):
        fs, inner = file_system(path)
        self._file = pa.ipc.open_file(pa.memory_map(inner) if fs.type_name == "local" else fs.open_input_file(inner))
        self._length = self._file.schema.field("ids").type.list_size
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0))

    def _batch(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            self._last = (k, self._file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True))
        return self._last[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of the k-th sequence."""
        batch = self._file.get_batch(k // BATCH).slice(k % BATCH, 1)
        return batch.column("ids").flatten().to_numpy(zero_copy_only=True), batch.column("mask").flatten().to_numpy(zero_copy_only=False)

    def read(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the file's stream."""
        full, parts = self._length * BATCH, []
        while n > 0:
            batch = self._batch(start // full)
            part = batch[start % full:start % full + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, length: int = 2048, end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files below ``path``; the index: doc_id, file, at, start, n_tokens.

    ``at`` is the place in the file's stream, ``start`` in the whole stream.
    """
    ship(docs.sparkSession)
    rows = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    arrow_id = pa.string() if id_type == "string" else None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encode = encoder(tokenizer)
        end, out = np.array([end_id], encode.dtype).tobytes(), None
        name = f"{path}/tokens-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        for batch in batches:
            if out is None:
                out = SequenceWriter(name, length, encode.dtype)
            at, n = [], []
            for ids in encode_column(encode, batch.column("text")):
                ids += end
                at.append(out.written)
                n.append(len(ids) // encode.dtype.itemsize)
                out.add(ids)
            ids_col = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [ids_col if arrow_id is None else ids_col.cast(arrow_id), pa.array([task.partitionId()] * len(at), pa.int32()),
                 pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())],
                names=["doc_id", "part", "file", "at", "n_tokens"])
        if out is not None:
            out.close()

    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    index = materialise(ordered.mapInArrow(write, f"doc_id {id_type}, part int, file string, at long, n_tokens long"), "token-index")
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(files, "part").select("doc_id", "file", "at", (F.col("base") + F.col("at")).alias("start"), "n_tokens")


def read_checksums(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the ids read back from the files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            sums = []
            for path, at, n in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                if path != name:
                    name, file = path, SequenceReader(path)
                sums.append(crc32_u4(file.read(at, n)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    id_type = index.schema["doc_id"].dataType.simpleString()
    return index.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
