"""Exact k-nearest-neighbour classification (Euclidean, uniform vote).

Training rows lie in cells around pivots (a bounded sample of them), each cell in rings
by the distance to its pivot, each ring in blocks of bounded size, so that a hot cell is
many blocks. For a query at distance d from a pivot, rows of a ring [lo, hi] are at
least max(d - hi, lo - d) away. A query first meets its nearest rings until they hold k rows;
the k-th of these bounds its radius, and then it meets the other rings that may hold a row
within. Queries of a block are packed too, so a meeting is one matrix product in a task of
its own, and no pair is ever a row. Ranks and votes are merged by a window limit and aggregates;
the driver sees the pivots and one row per ring.

Neighbour ties go to the smaller training key, vote ties to the smaller label. Rows with a null key, label or vector,
or a null or non-finite component, take no part; vectors of another length are no neighbours. Query keys are unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import scratch_path, ship

QUERY_BATCH = 128   # queries scored together against a block (bounds numpy memory)
QUERY_BLOCK = 8192  # queries packed together
ROUTE_BATCH = 1024  # queries routed together (bounds the queries x rings tables)
PIVOTS, RINGS = 256, 16
AT = ["dim", "cell", "ring", "salt"]
AT_TYPES = "dim int, cell int, ring int, salt int"
#: Share of the vectors' lengths by which a distance to a pivot may be off.
SLACK = 1e-6


def _points(df: DataFrame, key: str, vec: str, label: str | None) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    rows = df.select(F.col(key).cast("bigint").alias("k"), v.alias("v"), (F.col(label) if label else F.lit(0)).cast("bigint").alias("l")).dropna()
    return rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < math.inf))).withColumn("dim", F.size("v"))


def _once(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pivots(train: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Per vector length, some of the training vectors: at most ``PIVOTS`` in all, and one of each length."""
    few = min(PIVOTS, max(1, math.isqrt(rows) // 2))
    sample = train.orderBy(F.xxhash64("k"), "k").limit(few).select("v").collect()
    rest = train.groupBy("dim").agg(F.min_by("v", "k").alias("v")).collect()  # a row per length
    out: dict[int, list] = {}
    for r in sample:
        out.setdefault(len(r["v"]), []).append(r["v"])
    for r in rest:
        out.setdefault(len(r["v"]), [r["v"]])
    return {dim: np.array(vs, float).reshape(len(vs), dim) for dim, vs in out.items()}


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2.0 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _of_batch(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per vector length: some rows of a batch and their vectors."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        of_dim = np.flatnonzero(dims == dim)
        for first in range(0, len(of_dim), ROUTE_BATCH):
            at = of_dim[first:first + ROUTE_BATCH]
            flat = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            yield int(dim), at, flat.reshape(len(at), dim)


def _to_cells(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, at, x in _of_batch(batch):
            d = _distances(x, pivots[dim])
            cell = d.argmin(axis=1)
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(at)), cell])],
                                             names=[*rows.schema.names, "cell", "d"])


def _vectors(part: pd.DataFrame) -> np.ndarray:
    return np.array(part["v"].tolist(), float)


def _pack(key: tuple, part: pd.DataFrame, extra: list[str]) -> pd.DataFrame:
    return pd.DataFrame({**{c: [v] for c, v in zip([*AT, *extra], key, strict=True)}, "ks": [part["k"].to_numpy(np.int64).tobytes()],
                         "ls": [part["l"].to_numpy(np.int64).tobytes()], "vs": [_vectors(part).tobytes()]})


def _blocks(train: DataFrame, pivots: dict[int, np.ndarray], block_rows: int) -> tuple[DataFrame, list]:
    """Packed blocks of training rows, and one row per ring: its rows, blocks and distances to the pivot."""
    cells = _once(train.mapInArrow(partial(_to_cells, pivots=pivots), "k long, v array<double>, l long, dim int, cell int, d double"), "knn-cells")
    sizes = cells.groupBy("dim", "cell").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.count(F.lit(1)).alias("n"))
    rings = F.least(F.lit(RINGS), F.ceil(F.col("n") / block_rows))
    ring = F.when(F.col("d1") > F.col("d0"), F.least(rings - 1, F.floor((F.col("d") - F.col("d0")) / (F.col("d1") - F.col("d0")) * rings))).otherwise(0)
    ringed = cells.join(sizes, ["dim", "cell"]).withColumn("ring", ring.cast("int"))
    directory = ringed.groupBy("dim", "cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    directory = _once(directory.withColumn("salts", F.ceil(F.col("n") / block_rows).cast("int")), "knn-rings")
    salted = ringed.select("k", "v", "l", "dim", "cell", "ring").join(directory.select("dim", "cell", "ring", "salts"), ["dim", "cell", "ring"]).withColumn(
        "salt", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int"))
    blocks = salted.groupBy(*AT).applyInPandas(lambda key, part: _pack(key, part, []), f"{AT_TYPES}, ks binary, ls binary, vs binary")
    return _once(blocks, "knn-blocks"), directory.collect()


def _least_and_near(x: np.ndarray, pivots: np.ndarray, directory: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries x rings: the least distance of a ring's rows, and whether it is one of the nearest rings that hold k rows."""
    cell, _, n, _, lo, hi = directory
    d = _distances(x, pivots)[:, cell]
    size = np.sqrt((x * x).sum(axis=1))[:, None] + np.sqrt((pivots ** 2).sum(axis=1))[cell]
    least = np.maximum(np.maximum(d - hi, lo - d), 0) - SLACK * size
    order = np.argsort(np.maximum(least, 0) + 1e-12 * d, axis=1, kind="stable")
    held = np.cumsum(n[order], axis=1) - n[order]
    near = np.zeros(least.shape, bool)
    np.put_along_axis(near, order, held < k, axis=1)
    return least, near


def _route(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], directory: dict[int, tuple], k: int) -> Iterator[pa.RecordBatch]:
    """A row per query and block of its nearest rings that hold k rows."""
    for batch in batches:
        for dim, at, x in _of_batch(batch):
            if dim not in directory:
                continue
            cell, ring, _, salts, _, _ = directory[dim]
            q, r = np.nonzero(_least_and_near(x, pivots[dim], directory[dim], k)[1])
            again = salts[r]
            q, r = np.repeat(q, again), np.repeat(r, again)
            salt = np.arange(len(q)) - np.repeat(np.cumsum(again) - again, again)
            rows = batch.take(pa.array(at[q]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), dim, np.int32)), *(pa.array(c.astype(np.int32)) for c in (cell[r], ring[r], salt)),
                 rows.column("k"), rows.column("l"), rows.column("v")], names=[*AT, "k", "l", "v"])


def _pack_far(key: tuple, part: pd.DataFrame, pivots: dict[int, np.ndarray], directory: dict[int, tuple], first: dict[int, int], k: int) -> pd.DataFrame:
    """Queries of one length with their radii, and per ring a bit for each that has to meet it in the second round."""
    dim = int(key[0])
    x, radius = _vectors(part).reshape(len(part), dim), part["radius"].to_numpy(float)
    bits = np.zeros((len(directory[dim][0]), -(-len(part) // 8) * 8), bool)
    for at in range(0, len(part), ROUTE_BATCH):
        rows = slice(at, min(at + ROUTE_BATCH, len(part)))
        least, near = _least_and_near(x[rows], pivots[dim], directory[dim], k)
        bits[:, rows] = (~near & ~(least > radius[rows, None])).T  # no radius: fewer than k rows so far
    rings = np.flatnonzero(bits.any(axis=1))
    return pd.DataFrame({"dim": [dim], "chunk": [int(key[1])], "rings": [(rings + first[dim]).tolist()], "qs": [part["k"].to_numpy(np.int64).tobytes()], "xs": [x.tobytes()],
                         "radii": [radius.tobytes()], "bits": [np.packbits(bits[rings], axis=1).tobytes()]})


def _score(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            m = {c: batch.column(c)[i] for c in batch.schema.names}
            q_keys, t_keys, t_labels = (np.frombuffer(m[c].as_buffer(), np.int64) for c in ("qs", "ks", "ls"))
            q_vecs = np.frombuffer(m["xs"].as_buffer()).reshape(len(q_keys), -1)
            t_vecs = np.frombuffer(m["vs"].as_buffer()).reshape(len(t_keys), -1)
            radii = np.full(len(q_keys), np.nan)
            if "bits" in m:
                radii = np.frombuffer(m["radii"].as_buffer())
                bits = np.frombuffer(m["bits"].as_buffer(), np.uint8).reshape(len(m["rings"]), -1)[m["place"].as_py()]
                meets = np.flatnonzero(np.unpackbits(bits, count=len(q_keys)))
                q_keys, q_vecs, radii = q_keys[meets], q_vecs[meets], radii[meets]
            t_sq, kk = (t_vecs * t_vecs).sum(axis=1), min(k, len(t_keys))
            out: list[tuple[np.ndarray, ...]] = []
            for at in range(0, len(q_keys), QUERY_BATCH):
                q = q_vecs[at:at + QUERY_BATCH]
                q_sq = (q * q).sum(axis=1)[:, None]
                near = q_sq + t_sq - 2.0 * q @ t_vecs.T
                # all rows that rounding may hide behind the k-th are measured exactly, ties included
                slack = 1e-9 * (q_sq[:, 0] + t_sq.max())
                limit = np.partition(near, kk - 1, axis=1)[:, kk - 1] + slack
                r = radii[at:at + QUERY_BATCH]
                within = np.where(np.isnan(r), np.inf, r * r + slack)
                limit = np.minimum(limit, within)
                for i in np.flatnonzero(near.min(axis=1) <= limit):
                    rows = np.flatnonzero(near[i] <= limit[i])
                    dist = np.sqrt(((t_vecs[rows] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((t_keys[rows], dist))[:kk]
                    best = best[~(dist[best] > r[i])]
                    of = len(best)
                    out.append((np.full(of, q_keys[at + i]), dist[best], t_keys[rows[best]], t_labels[rows[best]], np.full(of, len(t_keys))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                 names=["query_key", "dist", "train_key", "train_label", "met"])


CANDIDATES = "query_key long, dist double, train_key long, train_label long, met long"


def _meet_near(routed: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """k candidates per query and block met. The queries of a block are packed in chunks, more if it is met by more."""
    per = routed.groupBy(*AT).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("chunks"))  # a row per block
    chunked = routed.join(F.broadcast(per), AT).withColumn("chunk", F.pmod(F.xxhash64("k"), F.col("chunks")).cast("int"))
    asked = chunked.groupBy(*AT, "chunk").applyInPandas(
        lambda key, part: _pack(key, part, ["chunk"]), f"{AT_TYPES}, chunk int, ks binary, ls binary, vs binary")
    asked = asked.select(*AT, "chunk", F.col("ks").alias("qs"), F.col("vs").alias("xs"))
    met = blocks.join(asked, AT).repartition(*AT, "chunk").select("qs", "xs", "ks", "ls", "vs")
    return met.mapInArrow(partial(_score, k=k), CANDIDATES)


def _meet_far(asked: DataFrame, blocks: DataFrame, pivots: dict[int, np.ndarray], directory: dict[int, tuple], queries: int, k: int) -> DataFrame:
    """The candidates within their query's radius, from all blocks that the first round left out."""
    spark = blocks.sparkSession
    chunks = max(1, -(-queries // QUERY_BLOCK))
    first, numbers = {}, []
    for dim, (cell, ring, *_) in directory.items():
        first[dim] = len(numbers)
        numbers += [(dim, int(c), int(r), first[dim] + i) for i, (c, r) in enumerate(zip(cell, ring, strict=True))]
    numbered = blocks.join(F.broadcast(spark.createDataFrame(numbers, "dim int, cell int, ring int, no int")), ["dim", "cell", "ring"])  # the directory
    known = asked.where(F.col("dim").isin(*directory)).withColumn("chunk", F.pmod(F.xxhash64("k"), F.lit(chunks)).cast("int"))
    pack = partial(_pack_far, pivots=pivots, directory=directory, first=first, k=k)
    packed = known.repartition(chunks, "dim", "chunk").groupBy("dim", "chunk").applyInPandas(
        lambda key, part: pack(key, part), "dim int, chunk int, rings array<int>, qs binary, xs binary, radii binary, bits binary")
    packed = _once(packed, "knn-queries")
    met = packed.select("dim", "chunk", F.posexplode("rings").alias("place", "no"))
    sent = met.join(numbered.select("no", "ks", "ls", "vs"), "no")
    pairs = sent.join(packed.hint("shuffle_hash"), ["dim", "chunk"])
    return pairs.select("rings", "place", "qs", "xs", "radii", "bits", "ks", "ls", "vs").mapInArrow(partial(_score, k=k), CANDIDATES)


def nearest(queries: DataFrame, train: DataFrame, key: str, vec: str, label: str, k: int = 5, block_rows: int = 8192) -> DataFrame:
    """(query_key, dist, train_key, train_label, met): candidates among which each query's k nearest are;
    ``met`` is the size of the block a candidate comes from."""
    ship(queries.sparkSession)
    asked, known = _points(queries, key, vec, None), _points(train, key, vec, label)
    rows = known.count()
    if not rows:
        return queries.sparkSession.createDataFrame([], CANDIDATES)
    pivots = _pivots(known, rows)
    blocks, rings = _blocks(known, pivots, block_rows)
    directory = {}
    for dim in pivots:
        own = [r for r in rings if r["dim"] == dim]
        directory[dim] = tuple(np.array([r[c] for r in own]) for c in ("cell", "ring", "n", "salts", "lo", "hi"))
    routed = asked.mapInArrow(partial(_route, pivots=pivots, directory=directory, k=k), f"{AT_TYPES}, k long, l long, v array<double>")
    close = _once(_meet_near(routed, blocks, k), "knn-close")
    ranked = close.withColumn("r", F.row_number().over(Window.partitionBy("query_key").orderBy("dist", "train_key"))).where(F.col("r") == k)
    bounded = asked.join(ranked.select(F.col("query_key").alias("k"), F.col("dist").alias("radius")), "k", "left")
    return close.unionByName(_meet_far(bounded, blocks, pivots, directory, asked.count(), k))


def knn_classify(queries: DataFrame, train: DataFrame, key: str, vec: str, label: str, k: int = 5,
                 block_rows: int = 8192) -> DataFrame:
    """Predicted label per query row: (key, pred)."""
    cands = nearest(queries, train, key, vec, label, k, block_rows)
    w = Window.partitionBy("query_key").orderBy("dist", "train_key")  # k candidates per block per query
    nn = cands.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    votes = nn.groupBy("query_key", "train_label").agg(F.count(F.lit(1)).alias("_c"))
    best = votes.groupBy("query_key").agg(F.max(F.struct(F.col("_c"), (-F.col("train_label")).alias("_nl"))).alias("_v"))
    return best.select(F.col("query_key").alias(key), (-F.col("_v._nl")).cast("int").alias("pred"))
