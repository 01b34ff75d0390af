"""Exact top-k search with vector-approximation files.

Vectors of integer components are cut into blocks. A block is a file in the shared
folder: the ids, the approximation (for every component the number of its cell,
one byte, in a grid of ``CELLS`` equal cells between the component's smallest and
largest value over all vectors) and the exact vectors. For a query, the cells of a
block give a lower and an upper bound of every score (inner product) from two matrix
products. A block's first candidates are vectors whose upper bound reaches the k-th best
lower bound; their exact vectors are read in the order of their bounds, best first, until
the k-th exact score is certain: no bound that is left reaches it. In later blocks
only vectors whose upper bound reaches the k-th exact score so far are read.

Every query block meets every vector block (a stated query set against all rows,
in blocks). A task takes one query block and a share of the vector blocks' files, one after
another; nothing but the names of the files is dealt out. Query blocks are as many as give the
cluster ``WAVES`` tasks a core, within ``LEAST`` and ``MOST`` queries each; where they are too few, the vector blocks
are cut into up to ``SHARES`` shares. So the tasks grow with the queries, not with the
pairs of blocks, and at most k rows per query and share are shuffled, which a ranked window merges.
Blocks are dealt by a hash of the id and the vector, so copies of one vector spread.

Score ties go to the smaller id; equal ids keep separate places as candidates.
Defined results: vectors that are null, empty or hold null or non-finite
components take no part, as query or candidate; rows without an id neither;
components are whole numbers up to +-``WIDEST`` (beyond, they count as that), scores are exact
and end at the limits of a long, where they tie; vectors with a component beyond +-``LIMIT`` have no cells, they
are compared exactly, as queries and as candidates; only vectors of the same length are compared; a query row repeated as a whole
gives its result once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import column, file_system, materialise, ship
from runlens.session import scratch_path

#: Cells per component.
CELLS = 32
#: Vectors per block, on average.
BLOCK = 8192
#: Queries per query block, on average: at least, and at most.
LEAST, MOST = 512, 32768
#: Tasks that each core should get, and shares of the vector blocks that a query block may be given for that.
WAVES, SHARES = 4, 8
#: Largest absolute value of a component up to which sums of products are exact in doubles, and of any component.
LIMIT, WIDEST = 1 << 20, 9_200_000_000_000_000_000
LONGEST = (1 << 63) - 1
#: Queries whose bounds are held at a time, and candidates whose exact vectors are.
CHUNK, READ = 128, 1 << 15
#: Half-integers below this are exact in single precision.
SINGLE = 1 << 23


def integer_components(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component; null unless all are finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-float(WIDEST))), F.lit(float(WIDEST)))).cast("long"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), whole)


def approximate(exact: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Cell numbers of the components."""
    return ((exact - low) // width).astype(np.uint8)


def write_block(path: str, ids: np.ndarray, exact: np.ndarray, cells: np.ndarray | None) -> None:
    """One file of a block: its ids, exact vectors and cells, a row per vector."""
    columns = {"ids": ids, "exact": exact} | ({} if cells is None else {"cells": cells})
    arrays = [pa.array(x) if x.ndim == 1 else pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]) for x in columns.values()]
    batch = pa.record_batch(arrays, names=list(columns))
    fs, inner = file_system(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inner) as sink, pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)


def read_block(path: str) -> dict[str, np.ndarray]:
    """The arrays of a block's file: views of it, where it is local, so that only vectors that are asked for are read."""
    fs, inner = file_system(path)
    batch = pa.ipc.open_file(pa.memory_map(inner) if fs.type_name == "local" else fs.open_input_file(inner)).get_batch(0)
    return {name: x.to_numpy() if pa.types.is_integer(x.type) else x.flatten().to_numpy().reshape(len(x), -1)
            for name, x in zip(batch.schema.names, batch.columns, strict=True)}


class Best:
    """The k best of every query so far: by score, then id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids, self.scores = [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n
        self.kth = np.full(n, -np.inf)

    def add(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[j], ids]), np.concatenate([self.scores[j], scores])
        first = np.lexsort((ids, ~scores))[:self.k]
        self.ids[j], self.scores[j] = ids[first], scores[first]
        if len(first) == self.k:
            self.kth[j] = scores[first[-1]]


def search_block(queries: np.ndarray, query_ids: np.ndarray, numbers: np.ndarray, exact: np.ndarray, cells: np.ndarray, ids: np.ndarray,
                 low: np.ndarray, width: np.ndarray, best: Best) -> None:
    """Add the vectors of a block, which ascend by id, to the best of the queries; ``numbers``: their places in ``best``."""
    k = best.k
    # integer components fill a cell from its first to its last value
    radius = (width - 1) / 2.0
    largest = np.maximum(np.abs(low), np.abs(low + CELLS * width)) + 2 * radius
    kind = np.float32 if np.abs(queries).max(axis=0) @ largest < SINGLE else np.float64  # sums are exact in either
    centre = (low + cells * width.astype(float) + radius).astype(kind).T
    own = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    for first in range(0, len(queries), CHUNK):
        asked, at = queries[first:first + CHUNK], numbers[first:first + CHUNK]
        part, spread = asked.astype(kind), np.abs(asked) @ radius
        middle = part @ centre
        for j in np.flatnonzero(own[0][first:first + CHUNK] < own[1][first:first + CHUNK]):
            middle[j, own[0][first + j]:own[1][first + j]] = -np.inf
        kth = best.kth[at]
        fresh = kth == -np.inf
        # an upper bound is the middle and the spread
        j, i = np.divmod(np.flatnonzero(middle >= np.where(fresh, np.inf, kth - spread).astype(kind)[:, None]), len(ids))
        scores = None
        if len(j) > middle.size // 16:  # reading most of them, one product is cheaper
            scores = (part @ exact.astype(kind).T)[j, i].astype(np.int64)
        for start in range(0, len(j), READ):
            of, rows = j[start:start + READ], i[start:start + READ]
            s = scores[start:start + READ] if scores is not None else np.einsum("ij,ij->i", exact[rows].astype(np.int64), asked[of])
            good = s >= kth[of]
            of, rows, s = of[good], rows[good], s[good]
            cut = [*np.flatnonzero(np.diff(of, prepend=-1)), len(of)]
            for a, b in itertools.pairwise(cut):
                best.add(at[of[a]], ids[rows[a:b]], s[a:b])
        for j in np.flatnonzero(fresh):
            m = middle[j].astype(float)
            # all bounds of a query have one spread: the k-th best lower bound is the k-th best middle less it
            least = np.partition(m, len(m) - k)[len(m) - k] if len(m) > k else -np.inf
            near = np.flatnonzero((m >= least - 2 * spread[j]) & (m > -np.inf))
            near = near[np.argsort(-m[near], kind="stable")]
            upper = m[near] + spread[j]
            start, step = 0, 4 * k
            while start < len(near) and upper[start] >= best.kth[at[j]]:
                more = near[start:start + step]
                best.add(at[j], ids[more], exact[more].astype(np.int64) @ asked[j])
                start, step = start + len(more), 2 * step


def search_exactly(queries: np.ndarray, query_ids: np.ndarray, exact: np.ndarray, ids: np.ndarray,
                   k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same for components of any size: every score, in Python's integers where a long is too short."""
    dim, largest = exact.shape[1], int(np.abs(exact).max())
    wide = None
    for j in range(len(queries)):
        if largest * int(np.abs(queries[j]).max()) * dim <= LONGEST:
            scores = exact @ queries[j]
        else:
            wide = exact.astype(object) if wide is None else wide
            scores = np.array([max(-LONGEST - 1, min(LONGEST, s)) for s in wide @ queries[j].astype(object)], np.int64)
        rows = np.flatnonzero(ids != query_ids[j])
        rows = np.array(sorted(rows.tolist(), key=lambda i: (-int(scores[i]), ids[i]))[:k], np.int64)
        yield j, rows, scores[rows]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), is_query.alias("q"),
                          integer_components(column(vectors, vector_col), scale).alias("v"))
    far = F.exists("v", lambda x: F.abs(x) > LIMIT)
    rows = materialise(rows.where("v is not null and id is not null").withColumns({"dim": F.size("v"), "wide": far}), "va-vectors")
    sizes = {(r["dim"], r["wide"]): r["n"] for r in rows.groupBy("dim", "wide").agg(F.count(F.lit(1)).alias("n")).collect()}
    queries = {r["dim"]: r["n"] for r in rows.where("q").groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "query_id long, rank int, vec_id long, score long"
    if not queries:
        return spark.createDataFrame([], schema)

    parts: dict[int, DataFrame] = {}
    asked_of: dict[int, DataFrame] = {}
    for (dim, wide), n in sorted(sizes.items()):  # vector lengths: one, as a rule
        if dim not in queries:
            continue
        nq = queries[dim]
        own = rows.where((F.col("dim") == dim) & (F.col("wide") == wide))
        # the grid: one row per component
        low = width = np.zeros(0, np.int64)
        if not wide:
            grid = own.agg(*[F.struct(F.min(F.col("v")[i]), F.max(F.col("v")[i])).alias(f"c{i}") for i in range(dim)]).first()
            low = np.array([g[0] for g in grid], np.int64)
            width = np.maximum(-(-(np.array([g[1] for g in grid], np.int64) - low + 1) // CELLS), 1)
        kind = np.int64 if wide else next(t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= low.min() and (low + CELLS * width).max() <= np.iinfo(t).max)

        def blocks(part: DataFrame, count: int, name: str, dtype: type, low=None, width=None, dim=dim) -> tuple[str, DataFrame]:
            """Folder of the files, and a row for each: its number and the attempt that wrote it."""
            folder = scratch_path(spark, f"va-{name}")

            def store(key: tuple, rows: pa.Table) -> pa.Table:
                from pyspark import TaskContext

                ids = rows.column("id").to_numpy()
                order, attempt = np.argsort(ids, kind="stable"), TaskContext.get().taskAttemptId()
                whole = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)[order]
                write_block(f"{folder}/{key[0].as_py()}-{attempt}", ids[order], whole.astype(dtype),
                            None if low is None else approximate(whole, low, width))
                return pa.table({name: pa.array([key[0].as_py()], pa.int64()), "attempt": pa.array([attempt], pa.int64())})

            dealt = part.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("long"))
            return folder, materialise(dealt.groupBy(name).applyInArrow(store, f"{name} long, attempt long"), f"va-{name}s")

        n_blocks, wanted = -(-n // block), WAVES * spark.sparkContext.defaultParallelism
        n_asked = -(-nq // max(LEAST, min(MOST, -(-nq // wanted))))
        shares = max(1, min(SHARES, n_blocks, -(-wanted // n_asked)))
        vectors_at, va = blocks(own.select("id", "v"), n_blocks, "block", kind, *(() if wide else (low, width)))
        if dim not in asked_of:  # written once: queries keep their numbers
            asked_of[dim] = blocks(rows.where((F.col("dim") == dim) & F.col("q")).select("id", "v").distinct(), n_asked, "asked", np.int64)
        queries_at, asked = asked_of[dim]
        # a row per query block and share: names of files
        va = va.groupBy((F.col("block") % shares).alias("share")).agg(F.sort_array(F.collect_list(F.struct("block", "attempt"))).alias("files"))
        asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
        meetings = asked.join(va, "share").repartitionByRange(n_asked * shares, "asked", "share")

        def search(batches: Iterator[pa.RecordBatch], low=low, width=width, wide=wide, vectors_at=vectors_at,
                   queries_at=queries_at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for m in b.to_pylist():
                    asked = read_block(f"{queries_at}/{m['asked']}-{m['attempt']}")
                    qids, queries = asked["ids"], asked["exact"]
                    far = (np.abs(queries) > LIMIT).any(axis=1) | wide
                    of_near, of_far = np.flatnonzero(~far), np.flatnonzero(far)
                    near, found = queries[of_near], Best(len(queries), k)
                    for f in m["files"]:
                        x = read_block(f"{vectors_at}/{f['block']}-{f['attempt']}")
                        if len(of_near):
                            search_block(near, qids[of_near], of_near, x["exact"], x["cells"], x["ids"], low, width, found)
                        if len(of_far):
                            for j, at, s in search_exactly(queries[of_far], qids[of_far], x["exact"].astype(np.int64), x["ids"], k):
                                found.add(of_far[j], x["ids"][at], s)
                    for first in range(0, len(queries), BLOCK):
                        ids, scores = found.ids[first:first + BLOCK], found.scores[first:first + BLOCK]
                        q = first + np.repeat(np.arange(len(ids)), [len(i) for i in ids])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(qids[q]), pa.array((m["asked"] << 32) + q), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))],
                            names=["query_id", "query", "vec_id", "score"])

        part = meetings.mapInArrow(search, "query_id long, query long, vec_id long, score long").withColumn("dim", F.lit(dim))
        parts[dim] = parts[dim].unionByName(part) if dim in parts else part
    best = Window.partitionBy("dim", "query").orderBy(F.col("score").desc(), "vec_id")
    found = reduce(DataFrame.unionByName, parts.values())
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])
