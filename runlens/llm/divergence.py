r"""Divergence of sources: term shares of every (language, source) group against each other.

Terms are counted per group over whole texts; a language keeps those that enough of its
documents hold. A group gives a kept term, seen ``count`` times, the smoothed share
``p = 1 + floor(SCALE * (count + 1) / (N + V))``, and p and q differ by
``floor((p - q)^2 / q)``. All of it is exact integer arithmetic.

The matrix groups x terms of a language is cut into blocks: terms by hash, groups in
tiles. Per pair of tiles and block of terms, one task lays a k2-tree (k = 2) over the
cells: a pyramid of bits, each saying whether a quadrant holds anything. The trees of
the two tiles are descended together for all pairs of groups: where both quadrants are
all zero, every cell has the same two shares, so its price is one value times the cells; other
quadrants are opened, and leaves (16 x 64 cells) computed cell by cell. Terms that a
block's tiles don't hold at all are priced in the same way when the blocks are summed.
A block holds at most ``TILE`` groups a side and about ``COLUMNS`` terms, whatever the corpus.

Defined results: null text, language or source count as ''; documents are rows, so
repeated rows and ids count again; a language that keeps no term differs by 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import column, materialise, ship

#: Runs of ASCII letters and of everything beyond ASCII.
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Share of a whole group, in three steps of a thousand (exact for groups of up to 9e15 terms).
SCALE, STEPS = 1_000_000_000, 3
#: Groups of a tile, terms of a block, and the cells of a leaf.
TILE, COLUMNS, LEAF_ROWS, LEAF_COLUMNS = 256, 1 << 14, 16, 64
#: Distinct terms of all groups that a task counts before it passes them on.
HELD = 300_000


# counting

def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it): partial counts of whole texts."""
    ship(docs.sparkSession)
    rows = docs.select(*[F.coalesce(column(docs, c).cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def batch_of(total: dict[tuple[str, str], tuple[Counter[str], Counter[str]]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.string()),
                 pa.array(list(n.values()), pa.int64()), pa.array([documents[t] for t in n], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], tuple[Counter[str], Counter[str]]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column("text"), strict=True):
                n, documents = total.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                # bytes are lower-cased in ASCII only
                found = Counter(TERM.findall(text.as_py().encode().lower().decode()))
                n.update(found)
                documents.update(found.keys())
                held += len(n)
                if held > HELD:
                    yield from batch_of(total)
                    total, held = {}, 0
        yield from batch_of(total)

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


# shares, in Spark and in numpy

def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)) without overflow."""
    whole, rest, out = total + kept, count + F.lit(1).cast("long"), F.lit(0).cast("long")
    for _ in range(STEPS):
        out = out * 1000 + F.call_function("div", rest * 1000, whole)
        rest = (rest * 1000) % whole
    return out + 1


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same for arrays; ``whole`` is total + kept."""
    rest, out = count + 1, np.zeros(np.broadcast_shapes(count.shape, whole.shape), np.int64)
    for _ in range(STEPS):
        out = out * 1000 + rest * 1000 // whole
        rest = rest * 1000 % whole
    return out + 1


def differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


# the quadtree over one block

class QuadTree:
    """Groups x terms: a pyramid of occupied quadrants and the shares of the occupied leaves."""

    def __init__(self, row: np.ndarray, col: np.ndarray, count: np.ndarray, whole: np.ndarray, leaf_rows: int, leaf_columns: int):
        #: leaves down and across are powers of two
        self.whole = np.ones(leaf_rows * LEAF_ROWS, np.int64)
        self.whole[:len(whole)] = whole
        self.none = shares(np.zeros_like(self.whole), self.whole)
        at = row // LEAF_ROWS * leaf_columns + col // LEAF_COLUMNS
        by = np.argsort(at, kind="stable")
        self.leaves: dict[int, np.ndarray] = {}
        for part in np.split(by, np.flatnonzero(np.diff(at[by])) + 1) if len(at) else []:
            where = int(at[part[0]])
            top = where // leaf_columns * LEAF_ROWS
            cells = np.zeros((LEAF_ROWS, LEAF_COLUMNS), np.int64)
            cells[row[part] - top, col[part] % LEAF_COLUMNS] = count[part]
            self.leaves[where] = shares(cells, self.whole[top:top + LEAF_ROWS, None])
        bits = np.zeros(leaf_rows * leaf_columns, bool)
        bits[list(self.leaves)] = True
        self.levels = [bits.reshape(leaf_rows, leaf_columns)]
        while (last := self.levels[-1]).size > 1:
            down, across = min(2, last.shape[0]), min(2, last.shape[1])
            self.levels.append(last.reshape(last.shape[0] // down, down, last.shape[1] // across, across).any(axis=(1, 3)))
        self.leaf_columns = leaf_columns

    def shares_at(self, a: int, c: int) -> np.ndarray:
        found = self.leaves.get(a * self.leaf_columns + c)
        top = a * LEAF_ROWS
        return self.none[top:top + LEAF_ROWS, None] if found is None else found


def joint_sums(left: QuadTree, right: QuadTree, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the block's terms of the differences left to right and right to left, for all pairs of rows."""
    n, m = len(left.whole), len(right.whole)
    forth, back, zero = (np.zeros((n, m), np.int64) for _ in range(3))
    same = left is right
    todo = [(len(left.levels) - 1, 0, 0, 0)]
    while todo:
        level, a, b, c = todo.pop()
        rows, across = left.whole.size // left.levels[level].shape[0], left.leaf_columns // left.levels[level].shape[1] * LEAF_COLUMNS
        width = min(columns, (c + 1) * across) - c * across  # the last quadrants reach beyond the terms
        if width <= 0:
            continue
        ra, rb = slice(a * rows, (a + 1) * rows), slice(b * rows, (b + 1) * rows)
        if not left.levels[level][a, c] and not right.levels[level][b, c]:
            zero[ra, rb] += width
        elif level == 0:
            p, q = left.shares_at(a, c)[:, None, :width], right.shares_at(b, c)[None, :, :width]
            square = (p - q) ** 2
            forth[ra, rb] += (square // q).sum(axis=2)
            back[ra, rb] += (square // p).sum(axis=2)
        else:
            down, over = (left.levels[level - 1].shape[i] // left.levels[level].shape[i] for i in (0, 1))
            todo += [(level - 1, a * down + i, b * down + j, c * over + k) for i in range(down) for j in range(down) for k in range(over)
                     if not same or a * down + i <= b * down + j]
    square = (left.none[:, None] - right.none[None, :]) ** 2
    forth += zero * (square // right.none[None, :])
    back += zero * (square // left.none[:, None])
    return forth, back


def _power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def _compare_tiles(key: tuple, table: pa.Table) -> pa.Table:
    """lang, source, item, value, seen (terms of the block), kept, unseen (price of a term that neither has)."""
    lang, _, first, second = (k.as_py() for k in key)
    is_group = np.array(table.column("term").is_null().to_pylist())
    tile, slot, n = (table.column(c).to_numpy() for c in ("tile", "slot", "n"))
    terms = table.column("term").combine_chunks().dictionary_encode()
    col = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[~is_group]
    columns = len(terms.dictionary)
    # terms of most groups first, so that empty cells lie together
    rank = np.empty(columns, np.int64)
    rank[np.argsort(-np.bincount(col, minlength=columns), kind="stable")] = np.arange(columns)
    names, cell_tile, cell_row, cell_n = table.column("source").to_pylist(), tile[~is_group], slot[~is_group] % TILE, n[~is_group]
    whole = (table.column("total").to_numpy() + table.column("kept").to_numpy())
    kept = int(table.column("kept")[0].as_py())
    groups = {t: sorted((int(slot[i]) % TILE, names[i], int(whole[i])) for i in np.flatnonzero(is_group & (tile == t))) for t in {first, second}}
    leaf_rows = _power(-(-max(map(len, groups.values())) // LEAF_ROWS))
    leaf_columns = _power(-(-max(1, columns) // LEAF_COLUMNS))
    trees = {}
    for t, members in groups.items():
        at = cell_tile == t
        trees[t] = QuadTree(cell_row[at], rank[col[at]], cell_n[at], np.array([max(1, w) for _, _, w in members], np.int64), leaf_rows, leaf_columns)
    left, right = trees[first], trees[second]
    forth, back = joint_sums(left, right, columns)
    out = []
    for i, a, _ in groups[first]:
        for j, b, _ in groups[second]:
            if first != second or i < j:
                square = (int(left.none[i]) - int(right.none[j])) ** 2
                out.append((a, b, int(forth[i, j]), square // int(right.none[j])))
                out.append((b, a, int(back[i, j]), square // int(left.none[i])))
    return pa.table([pa.array([lang] * len(out), pa.string()), *(pa.array([r[k] for r in out], t) for k, t in enumerate(
        (pa.string(), pa.string(), pa.int64()))), pa.array([columns] * len(out), pa.int64()), pa.array([kept] * len(out), pa.int64()),
        pa.array([r[3] for r in out], pa.int64())], names=["lang", "source", "item", "value", "seen", "kept", "unseen"])


# the operator

def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: how far each other source of the language is, over all kept terms.
    Part ``term``: the ``top`` kept terms that the group has more of than its language.
    """
    spark = docs.sparkSession
    of_term = Window.partitionBy("lang", "term")
    counted = count_terms(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = materialise(counted.select(
        "lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("lang_docs"),
        (F.col("source") == F.min("source").over(of_term)).alias("lead")).where(F.col("lang_docs") >= least_docs).drop("lang_docs"),
        "divergence-cells")

    names = docs.select(F.coalesce(column(docs, lang_col).cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(column(docs, source_col).cast("string"), F.lit("")).alias("source")).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("lead").alias("lead"))
    of_lang = Window.partitionBy("lang")  # a row per source
    groups = names.join(totals, ["lang", "source"], "left").fillna(0, ["total", "lead"]).select(
        "lang", "source", "total", F.sum("total").over(of_lang).alias("lang_total"), F.sum("lead").over(of_lang).alias("kept"),
        (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long").alias("slot"), F.count(F.lit(1)).over(of_lang).alias("sources"))
    # written, so that Spark knows its size when it chooses a join
    groups = materialise(groups, "divergence-groups").withColumns({
        "tile": F.expr(f"slot div {TILE}"), "tiles": F.expr(f"(sources + {TILE - 1}) div {TILE}"),
        "blocks": F.expr(f"greatest(1, (kept + {COLUMNS - 1}) div {COLUMNS})")})
    cells = cells.join(groups, ["lang", "source"])

    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where(F.col("p") > F.col("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", differ(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    row = ["source", "tile", "slot", "total", "kept"]
    cell_rows = cells.select("lang", block.alias("block"), "tiles", "term", "n", *row)
    group_rows = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "tiles",
                               F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), *row)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    met = cell_rows.unionByName(group_rows).withColumn("other", other)
    met = met.withColumns({"first": F.least("tile", "other"), "second": F.greatest("tile", "other")}).drop("tiles", "other")
    # a stated number of tasks, as a few bytes are much work here
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = met.repartition(tasks, "lang", "block", "first", "second")
    sums = met.groupBy("lang", "block", "first", "second").applyInArrow(
        _compare_tiles, "lang string, source string, item string, value long, seen long, kept long, unseen long")
    pairs = sums.groupBy("lang", "source", "item").agg(
        (F.sum("value") + F.when(F.max("kept") > 0, (F.max("kept") - F.sum("seen")) * F.max("unseen")).otherwise(0)).alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)
