"""Packing into fixed sequences: cutting stock by column generation.

Documents longer than a sequence are cut into full sequences and a rest. Lengths
are counted by Spark into classes, a table bounded by the sequence length: exact
up to ``EXACT`` tokens, above rounded up by less than a 64th. On that histogram the cutting-stock
linear program is solved by column generation: the basis starts with the patterns of a
greedy filling, the duals price classes, a knapsack dynamic program finds the
pattern worth most at these prices, and it enters the basis until the solution is
proven to be within ``GAP`` of the optimum.
Pattern counts are rounded down; what is left, less than
one sequence per pattern, is filled largest class first. Both steps only see
counts, never documents.

Pieces are ranked within their class (offsets per hash bucket, then numbers in
the bucket, so that a class with a third of all rows is spread out) and the k-th
piece takes the class's k-th slot of the patterns. The slot table has at most
classes x patterns rows, bounded by the sequence length as well.

Defined results: null and empty texts are the end id alone; rows with equal ids
are documents of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import column, materialise, ship
from runlens.llm.tokens import CACHE, crc32_u4, encode_column, encoder, forget

#: Classes above this length are a 64th of it apart at most; up to it every length is one.
EXACT = 128
#: Share by which the linear program may miss its optimum, and the columns it may take for that.
GAP, MOST = 0.005, 2000
#: Rows that a bucket, in which the pieces of a class are numbered, should hold; buckets at least.
BUCKET_ROWS, BUCKETS = 1 << 16, 1024

Pattern = tuple[np.ndarray, int]


def knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and counts of an unbounded knapsack.

    Item by item: the best filling with up to k copies of a size s is, along each residue of s,
    a running maximum of what was reached before, less what the copies are worth."""
    counts = np.zeros(len(sizes), np.int64)
    by_size = np.argsort(sizes, kind="stable")
    reached = np.maximum.accumulate(np.r_[0.0, value[by_size]])[:-1]
    useful = by_size[value[by_size] > reached]  # the others are worth no more than a smaller one
    best, steps = np.zeros(capacity + 1), []
    for i in useful:
        s, v = int(sizes[i]), float(value[i])
        rows = -(-(capacity + 1) // s)
        grid = np.full(rows * s, -np.inf)
        grid[:capacity + 1] = best
        grid = grid.reshape(rows, s)
        paid = v * np.arange(rows)[:, None]
        best = (np.maximum.accumulate(grid - paid, axis=0) + paid).ravel()[:capacity + 1]
        steps.append(best)
    c = capacity
    for k in range(len(useful) - 1, -1, -1):
        before, s = steps[k - 1] if k else np.zeros(capacity + 1), int(sizes[useful[k]])
        while c >= s and steps[k][c] > before[c] + 1e-12:
            counts[useful[k]] += 1
            c -= s
    return float(value @ counts), counts


def greedy_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns (columns) that the largest classes left over make, one class used up by each: a first
    solution of the linear program."""
    m, left, columns = len(sizes), demand.astype(float), []
    alive = np.ones(m, bool)
    while alive.any():
        room, counts = capacity, np.zeros(m)
        for i in np.flatnonzero(alive)[::-1]:
            counts[i] = room // sizes[i]
            room -= int(counts[i]) * int(sizes[i])
        held = counts > 0
        left[held] -= counts[held] * (left[held] / counts[held]).min()
        spent = np.flatnonzero(held & (left <= 1e-9 * demand))
        columns.append(counts)
        for i in spent[1:]:  # used up at the same time: a pattern of its own, not used yet
            alone = np.zeros(m)
            alone[i] = capacity // sizes[i]
            columns.append(alone)
        alive[spent] = False
    return np.array(columns).T


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = MOST, gap: float = 1e-7) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in a fractional solution at most ``gap`` above the optimum.

    The optimum is at least the volume of all pieces, and at least the solution's size over the value
    of the best pattern at its prices; ``most`` bounds the columns that enter."""
    m = len(sizes)
    columns = greedy_basis(sizes, demand, capacity)
    inverse = np.linalg.inv(columns)
    used = np.maximum(inverse @ demand, 0)
    least = float(sizes @ demand) / capacity
    for _ in range(most):
        if used.sum() <= least * (1 + gap):
            break
        value, counts = knapsack(np.maximum(inverse.sum(axis=0), 0), sizes, capacity)
        least = max(least, used.sum() / max(value, 1))
        if value <= 1 + gap:
            break
        step = inverse @ counts
        grows = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[grows] = used[grows] / step[grows]
        out = int(ratio.argmin())
        amount = ratio[out]
        used = np.maximum(used - amount * step, 0)
        used[out] = amount
        columns[:, out] = counts
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return [(np.rint(columns[:, j]).astype(np.int64), float(used[j])) for j in range(m)]


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-7) -> list[Pattern]:
    """Patterns and whole numbers of uses that hold the demand exactly."""
    out: list[Pattern] = []
    left = demand.copy()
    for counts, used in column_generation(sizes, demand, capacity, gap=gap):
        whole = int(used + 1e-9)
        held = counts > 0
        whole = min([whole, *(left[held] // counts[held])])  # rounding of floats must not use a piece twice
        if whole > 0:
            out.append((counts, int(whole)))
            left -= counts * whole
    while left.any():  # largest class that still fits, again and again
        room, counts = capacity, np.zeros_like(left)
        for i in np.flatnonzero(left)[::-1]:
            counts[i] = min(left[i], room // sizes[i])
            room -= counts[i] * sizes[i]
        held = counts > 0
        times = int((left[held] // counts[held]).min())
        out.append((counts, times))
        left -= counts * times
    return out


def slots(sizes: np.ndarray, plan: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, pieces per sequence)."""
    rows, next_rank, sequence = [], np.zeros(len(sizes), np.int64), 0
    for counts, times in plan:
        for i in np.flatnonzero(counts):
            end = next_rank[i] + counts[i] * times
            rows.append((int(sizes[i]), int(next_rank[i]), int(end), sequence, int(counts[i])))
            next_rank[i] = end
        sequence += times
    return rows


def cut_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, id_col: str, text_col: str, keep_ids: bool, cache: int = CACHE,
               keep_encoder: bool = True) -> DataFrame:
    """Encode whole texts and cut them: one row per piece."""
    rows = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cache)
        end = np.array([end_id], encode.dtype).tobytes()
        for batch in batches:
            of, start, size, crc, total, raw = [], [], [], [], [], []
            for k, coded in enumerate(encode_column(encode, batch.column("text"))):
                ids = np.frombuffer(coded + end, encode.dtype)
                for at in range(0, len(ids), length):
                    piece = ids[at:at + length]
                    of.append(k)
                    start.append(at)
                    size.append(len(piece))
                    crc.append(crc32_u4(piece))
                    total.append(len(ids))
                    raw.append(piece.astype("<u4").tobytes() if keep_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total)),
                 pa.array(raw, pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        if not keep_encoder:
            forget(tokenizer)

    return rows.mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def length_class(length: Column, capacity: int) -> Column:
    """The length itself up to ``EXACT``; above, the next multiple of its power of two's 64th, at most a sequence."""
    step = F.pow(F.lit(2), F.length(F.bin(length - 1)) - 7).cast("long")
    return F.when(length <= EXACT, length).otherwise(F.least(F.ceil(length / step) * step, F.lit(capacity))).cast("int")


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = False, cache: int = CACHE, keep_encoder: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids
    as little-endian unsigned 32-bit integers, if kept): one row per piece. ``cache``: bytes of
    known words that a worker may keep, twice; without ``keep_encoder`` it keeps nothing beyond a task."""
    spark = docs.sparkSession
    ship(spark)
    pieces = cut_pieces(docs, tokenizer, length, end_id, id_col, text_col, keep_ids, cache, keep_encoder)
    pieces = pieces.withColumn("class", length_class(F.col("length"), length))
    pieces = materialise(pieces if keep_ids else pieces.drop("ids"), "pack-pieces")
    buckets = max(BUCKETS, -(-pieces.count() // BUCKET_ROWS))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))

    counts = materialise(pieces.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = sorted((r["class"], r["n"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect())  # one row per class
    sizes = np.array([c for c, _ in histogram], np.int64)
    demand = np.array([n for _, n in histogram], np.int64)
    plan = slots(sizes, patterns(sizes, demand, length, GAP)) if histogram else []
    # from Arrow: rows of Python would take workers of another kind, which stay beside those that encode
    names = ("class", "first", "end", "sequence", "per")
    table = spark.createDataFrame(pa.table(
        {x: pa.array([row[i] for row in plan], pa.int64() if i else pa.int32()) for i, x in enumerate(names)}))

    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.join(offsets, ["class", "bucket"]).withColumn("rank", F.col("base") + inside - 1)
    # classes x patterns rows at most
    slot = F.broadcast(table)
    placed = ranked.join(slot, (ranked["class"] == slot["class"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.expr("(rank - first) div per"))
    # a sequence holds few pieces by its length
    inner = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inner), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
