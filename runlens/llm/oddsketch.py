"""Near-duplicate documents by MinHash bands and odd sketches.

A document's set is its distinct word shingles (as 64-bit hashes). MinHash
samples of the set are banded: documents that agree in all samples of a band
share a bucket. The samples are also folded into an odd sketch, a bitmap in
which each (sample number, value) flips one bit; two sketches' XOR has a
population count that tells how many samples differ, precisely so for high
similarities. In a bucket, documents whose sketches allow the similarity are
joined to coarse groups; a coarse group's full sets are then compared, and only
pairs that reach the similarity on their full sets are links. Components of
these links are the result.

Bands are as many as the similarity needs for a chance of ``MISS`` that a pair just
at the threshold shares none; the sketch threshold leaves several standard
deviations. Equal sets (copies) are one node before anything is compared, so a
group of thousands of copies costs one comparison.

No step forms all pairs. Within a bucket or a coarse group only what joins two
different parts is kept: one document is compared with all; those it doesn't
reach are compared with all in turn; those in its part need not be, since a link
from it to another part is found from the other end. Buckets and groups above
``BLOCK`` members are cut into blocks and each pair of blocks is a group of its
own, so a bucket or group of any size is spread over tasks, with no cap.

Defined results: null texts and texts without words have the empty set, stay
alone and are kept; fewer words than a shingle make one shingle of the whole
sequence; ids that are null don't count as the smallest id of a component unless
it has no other; rows with equal ids are documents of their own and kept or not
together; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import column, free, group_key, materialise, ship
from runlens.llm.components import connected_components

#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
#: Bits of an odd sketch.
BITS = 512
#: Members of a bucket or coarse group that are compared in one task.
BLOCK = 2048
#: Bits of the filter that tells which texts are read again.
FILTER_BITS = 1 << 24

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit shingle hashes."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at the ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in parts], np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i])
    return np.unique(out)


class Signature:
    """Bands and odd sketch of a set, for one similarity."""

    def __init__(self, similarity: float):
        self.rows = 5 if similarity >= 0.85 else 4
        self.bands = math.ceil(math.log(MISS) / math.log(1 - similarity**self.rows))
        self.samples = k = self.bands * self.rows
        rng = np.random.default_rng(20240229)
        self._a = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._b = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        self._number = np.arange(k, dtype=np.uint64) << np.uint64(40)
        # samples that differ at the threshold, with five deviations; each flips two bits
        differ = k * (1 - similarity) + 5 * math.sqrt(k * similarity * (1 - similarity))
        odd = BITS / 2 * (1 - math.exp(-4 * differ / BITS))
        self.most_odd = math.ceil(odd + 3 * math.sqrt(odd / 2))

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bucket keys of the bands and the odd sketch."""
        low = np.full(self.samples, np.iinfo(np.uint64).max)
        for at in range(0, len(values), 2048):
            part = values[at:at + 2048]
            low = np.minimum(low, ((part[:, None] * self._a + self._b) >> np.uint64(24)).min(axis=0))
        keys = np.full(self.bands, 0x51, np.uint64) + np.arange(self.bands, dtype=np.uint64)
        for column_ in low.reshape(self.bands, self.rows).T:
            keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + column_)
        bits = (_mix(low ^ self._number) % np.uint64(BITS)).astype(np.int64)
        odd = np.bincount(bits, minlength=BITS).astype(np.uint8) & 1
        return keys.view(np.int64), np.packbits(odd).tobytes()


class Parts:
    """Which members of a group belong together."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        for part in np.unique(self.of[others]):
            if part != self.of[i]:
                self.links.append((i, int(others[np.argmax(self.of[others] == part)])))
                self.of[self.of == part] = self.of[i]


def join_group(n: int, reached) -> Parts:
    """Join the members that are linked; ``reached(i)`` gives all members linked to i.

    After a few trials the member with the most links is the root; members of its
    part are passed over, all others are compared with every member.
    """
    parts = Parts(n)
    if n < 2:
        return parts
    tried: dict[int, np.ndarray] = {}
    for i in range(0, n, max(1, n // 8)):
        tried[i] = reached(i)
        parts.join(i, tried[i])
    root = max(tried, key=lambda i: len(tried[i]))
    for i in range(n):
        if i not in tried and parts.of[i] != parts.of[root]:
            parts.join(i, reached(i))
    return parts


def join_by_sketch(sketches: np.ndarray, most_odd: int) -> Parts:
    """``sketches``: one row of 64-bit words per member."""
    def reached(i: int) -> np.ndarray:
        odd = np.bitwise_count(sketches ^ sketches[i]).sum(axis=1)
        odd[i] = most_odd + 1
        return np.flatnonzero(odd <= most_odd)

    return join_group(len(sketches), reached)


def join_by_sets(sets: list[np.ndarray], percent: int) -> Parts:
    """Members whose sets have 100 * intersection >= percent * union."""
    size = np.array([len(s) for s in sets], np.int64)
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    marked = np.zeros(len(values), bool)

    def reached(i: int) -> np.ndarray:
        own = number[start[i]:start[i] + size[i]]
        marked[own] = True
        common = np.add.reduceat(marked[number], start, dtype=np.int64)
        marked[own] = False
        linked = 100 * common >= percent * (size + size[i] - common)
        linked[i] = False
        return np.flatnonzero(linked)

    return join_group(len(sets), reached)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of a partition sorted by ``key``, group by group; a group may span batches."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not len(table):
            continue
        k = table.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None and len(held) > 1:
        yield held


def _cells(members: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """A long ``cell`` per group, or per pair of blocks of a group above BLOCK members."""
    rows = members.join(counts.where("n > 1"), key)
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    pair = F.transform(F.sequence(F.lit(0), (blocks - 1).cast("long")),
                       lambda j: F.xxhash64(F.col(key), F.least(own, j), F.greatest(own, j)))
    return rows.withColumn("cell", F.explode(F.when(blocks > 1, pair).otherwise(F.array(F.xxhash64(key)))))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    row_key: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    ``row_key``, a string that tells rows apart, is carried along as row_key.
    """
    ship(docs.sparkSession)
    texts = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).cast("string").alias("text"),
                        (F.lit(None) if row_key is None else row_key).cast("string").alias("row_key"))
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature = Signature(percent / 100)
        for batch in batches:
            n, node, keys, sketch = [], [], [], []
            for text in batch.column("text"):
                values = shingles(text.as_py(), words)
                bands, odd = signature(values) if len(values) else (np.empty(0, np.int64), b"")
                n.append(len(values))
                node.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                keys.append(bands)
                sketch.append(odd)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "row_key", "n_shingles", "node", "keys", "sketch"])

    signed = materialise(texts.mapInArrow(
        sign, f"doc_id {id_type}, row_key string, n_shingles long, node binary, keys array<long>, sketch binary"), "dup-signatures")
    # copies are one node
    nodes = materialise(signed.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "dup-nodes")

    # coarse groups: buckets, joined by sketches
    buckets = nodes.select("node", F.explode("keys").alias("bucket"))
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    members = _cells(buckets, "bucket", counts).select("cell", "node").join(nodes.select("node", "sketch"), "node")

    def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most_odd = Signature(percent / 100).most_odd
        a, b = [], []
        for group in sorted_groups(batches, "cell"):
            node = group.column("node").to_pylist()
            sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
            for i, j in join_by_sketch(sketches, most_odd).links:
                a.append(node[i])
                b.append(node[j])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    coarse = connected_components(members.select("cell", "node", "sketch").repartition("cell").sortWithinPartitions("cell")
                                  .mapInArrow(by_sketch, "a binary, b binary"))
    coarse = materialise(coarse.join(nodes.select("node", "doc_id"), "node"), "dup-coarse")

    # read the texts of coarse groups again: a filter of fixed size spares the others the shuffle
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("long")
    bitmap = {r["k"]: bytes(r["bits"]) for r in coarse.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()}  # FILTER_BITS / 8 bytes at most

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("p").to_numpy()
            # the bitmap functions count buckets and positions from 1
            keep = [i for i, p in enumerate(at.tolist()) if (bits := bitmap.get(p // 32768 + 1)) and bits[p % 32768 // 8] >> (p % 8) & 1]
            full = [shingles(batch.column("text")[i].as_py(), words).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep, pa.int32())), pa.array([xxhash.xxh3_128_digest(s) for s in full], pa.binary()),
                 pa.array(full, pa.binary())], names=["doc_id", "node", "values"])

    full = texts.select("doc_id", "text", place.alias("p")).mapInArrow(sets, f"doc_id {id_type}, node binary, values binary")
    groups = coarse.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    cells = _cells(coarse.select("root", "node", "doc_id"), "root", groups).select("cell", "node", F.col("doc_id").alias("first_id"))
    compared = cells.join(full, (cells["node"] == full["node"]) & cells["first_id"].eqNullSafe(full["doc_id"])).select(
        "cell", cells["node"].alias("node"), "values")

    def by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "cell"):
            own = dict(zip(group.column("node").to_pylist(), group.column("values").to_pylist(), strict=True))  # repeated rows are one
            node = list(own)
            links = join_by_sets([np.frombuffer(v, np.uint64) for v in own.values()], percent).links
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in links], pa.binary()),
                                              pa.array([node[j] for _, j in links], pa.binary())], names=["a", "b"])

    linked = connected_components(compared.repartition("cell").sortWithinPartitions("cell").mapInArrow(by_sets, "a binary, b binary"))

    # the smallest id of every component, then back to all rows
    roots = nodes.select("node", "doc_id").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = roots.join(smallest, "root").select("node", "component_id")
    out = signed.select("doc_id", "row_key", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
                      *([] if row_key is None else ["row_key"]))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, once."""
    key = F.concat_ws(":", group_key(column(docs, id_col)), F.xxhash64(column(docs, text_col)).cast("string"))
    name = free(docs, "_row_key")
    kept = near_duplicates(docs, words, percent, id_col, text_col, key).where("kept").select(F.col("row_key").alias(name)).distinct()
    rows = docs.withColumn(name, key)
    return rows.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
