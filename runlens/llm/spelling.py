"""Spelling variants: k-d trees over letter-count vectors.

One inserted, deleted or replaced code point moves a word's vector of letter counts
by at most 2 in L1 distance: by 1 to the next length, by 2 within a length. So near
words are range searches, per pair of lengths, in k-d trees over these vectors,
pruned by the boxes of the subtrees; the candidates' letter order is verified.

A vector is kept in unary code: 32 counts (a to z, the rest dealt by code point),
4 bits each, counts above 4 as 4, which never lengthens a distance. L1 distance is the
number of differing bits, the distance to a box the bits that all of the box and the
point not, or the point and none of the box, have. A split is one bit: "at least c of
this letter".

Spark deals the words by the upper part of the trees, built per length from a bounded
sample of the vocabulary (``SAMPLE`` words, by hash; the sample moves only the cuts, every
word is dealt): a word is a member of its own leaf and a query of every leaf whose box
lies within the radius. A leaf is one task's work; there a tree over its members goes on
down. Each leaf gives one row per word, its near words counted and the best kept, and
Spark merges these. Forms are followed to their roots by pointer doubling; along a chain
counts grow by the stated factor, which bounds its length.

Defined results: null texts have no words, null ids count as empty; null or empty words
are dropped, repeated ones summed; the best of equal counts is the smaller word; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import column, materialise, ship

#: Words from which the upper trees are cut, members a leaf should hold, members a tree's last node holds.
SAMPLE, LEAF, NODE = 1 << 20, 1 << 14, 48
#: Sampled words that a leaf needs so that its size is known well enough.
SEEN = 32
#: Distinct words a task counts before it passes them on.
HELD = 300_000
#: Pairs of words compared at once.
PAIRS = 1 << 18

RUN = re.compile("[a-zÀ-ÿ]+")
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
Codes = np.ndarray  # (words, 2) unary letter counts


# counting

def count_words(docs: DataFrame, least_chars: int = 6, delete_every: int | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """word, n: partial counts of the runs of Latin letters of whole texts, A to Z lower-cased.

    ``delete_every`` plants misspellings: where it divides h, the crc32 of
    ``<id>:<run>``, the run loses its code point h % length.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(column(docs, id_col).cast("string"), F.lit("")).alias("id"), column(docs, text_col).cast("string").alias("text"))

    def batch_of(total: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                before = zlib.crc32(f"{key.as_py()}:".encode())
                # bytes are lower-cased in ASCII only
                for word, n in Counter(RUN.findall(text.as_py().encode().lower().decode())).items():
                    if len(word) < least_chars:
                        continue
                    if delete_every:
                        h = zlib.crc32(word.encode(), before)
                        if h % delete_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least_chars:
                                continue
                    total[word] += n
                if len(total) > HELD:
                    yield batch_of(total)
                    total = Counter()
        yield batch_of(total)

    return rows.mapInArrow(count, "word string, n long")


# vectors and trees

def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def unary(points: np.ndarray) -> Codes:
    """Letter counts as bits."""
    place = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % 6).astype(np.intp)
    counts, row = np.zeros((len(points), 32), np.uint8), np.arange(len(points))
    for j in range(points.shape[1]):
        held = counts[row, place[:, j]]
        counts[row, place[:, j]] = np.minimum(held, 3) + 1
    bits = counts[:, :, None] > np.arange(4, dtype=np.uint8)
    return np.packbits(bits.reshape(len(points), 128), axis=1, bitorder="little").view(np.uint64)


@dataclass
class Node:
    """A box (bits that all have, bits that some may have) and its halves or, at a leaf, its number and members."""

    low: np.ndarray
    high: np.ndarray
    halves: tuple[Node, Node] | None = None
    leaf: int = -1
    members: np.ndarray | None = None


def _cut(codes: Codes, low: np.ndarray, high: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The bit that halves the words best and who has it; None if all are alike."""
    if not len(codes):
        return None
    has = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
    uneven = np.abs(2 * has.sum(axis=0, dtype=np.int64) - len(codes))
    bit = int(uneven.argmin())
    return None if uneven[bit] == len(codes) else (bit, has[:, bit].astype(bool))


def _bit(bit: int) -> np.ndarray:
    out = np.zeros(2, np.uint64)
    out[bit // 64] = np.uint64(1) << np.uint64(bit % 64)
    return out


def grow(codes: Codes, most: int, leaves: list[Node], tight: bool) -> Node:
    """A tree whose leaves hold at most ``most`` of the words, unless these are alike. Boxes are
    those of the words themselves (``tight``) or those of the cuts, which hold for other words too."""

    def node(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> Node:
        if tight:
            low, high = np.bitwise_and.reduce(codes[at], axis=0), np.bitwise_or.reduce(codes[at], axis=0)
        cut = _cut(codes[at], low, high) if len(at) > most else None
        if cut is None:
            leaves.append(Node(low, high, leaf=len(leaves), members=at))
            return leaves[-1]
        bit, has = cut
        mask = _bit(bit)
        return Node(low, high, (node(at[~has], low, high & ~mask), node(at[has], low | mask, high)))

    return node(np.arange(len(codes)), np.zeros(2, np.uint64), np.full(2, ALL))


def within(tree: Node, codes: Codes, radius: int) -> Iterator[tuple[Node, np.ndarray]]:
    """The leaves and, per leaf, the queries whose distance to its box is at most the radius."""
    stack = [(tree, np.arange(len(codes)))]
    while stack:
        node, at = stack.pop()
        q = codes[at]
        away = np.bitwise_count((node.low & ~q) | (q & ~node.high)).sum(axis=1)
        at = at[away <= radius]
        if not len(at):
            continue
        if node.halves:
            stack += [(half, at) for half in node.halves]
        else:
            yield node, at


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, whether b is a with one code point replaced or, if it is longer, inserted."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    start = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    end = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return start + end >= n


def near_pairs(query: np.ndarray, query_codes: Codes, member: np.ndarray, member_codes: Codes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of queries and members one edit apart, found through a tree over the members."""
    radius = 2 if query.shape[1] == member.shape[1] else 1
    tree = grow(member_codes, NODE, [], tight=True)
    held, size = [], 0
    for leaf, at in within(tree, query_codes, radius):
        m = leaf.members
        for k in range(0, len(at), step := max(1, PAIRS // len(m))):
            part = at[k:k + step]
            away = sum(np.bitwise_count(query_codes[part, i][:, None] ^ member_codes[m, i]).astype(np.int16) for i in (0, 1))
            qi, mi = np.nonzero(away <= radius)
            held.append((part[qi], m[mi]))
            size += len(qi)
        if size >= PAIRS:
            yield from _verified(query, member, held)
            held, size = [], 0
    yield from _verified(query, member, held)


def _verified(query: np.ndarray, member: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if held:
        qi, mi = (np.concatenate(x) for x in zip(*held, strict=True))
        step = max(1, 16 * PAIRS // member.shape[1])  # very long words: fewer at once
        for k in range(0, len(qi), step):
            q, m = qi[k:k + step], mi[k:k + step]
            ok = one_edit(query[q], member[m])
            yield q[ok], m[ok]


# a leaf's work

def _best(of: np.ndarray, other: np.ndarray, other_n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word in ``of``: how many near words, and the one of most occurrences, smallest first."""
    by = np.lexsort((order[other], -other_n[other], of))
    of, other = of[by], other[by]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.intp)
    return of[first], np.diff(np.r_[first, len(of)]), other[first]


def _search_leaf(table: pa.Table) -> pa.Table:
    """word, n_near, best_n, best: what one leaf knows of its members and queries."""
    role = table.column("role").to_numpy()
    words = table.column("word").to_pylist()
    n = table.column("n").to_numpy()
    member = np.flatnonzero(role == 0)
    out: list[list] = [[], [], [], []]

    def emit(of: np.ndarray, of_index: np.ndarray, other: np.ndarray, other_index: np.ndarray) -> None:
        order = np.empty(len(other_index), np.int64)
        order[sorted(range(len(other_index)), key=lambda i: words[other_index[i]])] = np.arange(len(other_index))
        who, count, best = _best(of, other, n[other_index], order)
        out[0] += [words[i] for i in of_index[who]]
        out[1] += count.tolist()
        out[2] += n[other_index[best]].tolist()
        out[3] += [words[i] for i in other_index[best]]

    if len(member):
        points = letters([words[i] for i in member])
        codes = unary(points)
        for which in ((0, 1), (2,)):  # of the same length, shorter by one
            query = np.flatnonzero(np.isin(role, which))
            if not len(query):
                continue
            q_points = letters([words[i] for i in query])
            pairs = list(near_pairs(q_points, unary(q_points), points, codes))
            if not pairs:
                continue
            qi, mi = (np.concatenate(x) for x in zip(*pairs, strict=True))
            emit(qi, query, mi, member)
            if which == (2,):
                emit(mi, member, qi, query)
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())],
                    names=["word", "n_near", "best_n", "best"])


# the operator

def _upper_trees(words: DataFrame, total: int) -> tuple[dict[int, Node], int]:
    """Per length, the upper part of its tree; the number of leaves of all."""
    one_in = max(1, math.ceil(total / SAMPLE))
    sample = words.where(F.pmod(F.xxhash64("word"), F.lit(one_in)) == 0).select("word").toArrow().column("word").to_pylist()  # bounded
    by_length: dict[int, list[str]] = {}
    for w in sorted(sample):
        by_length.setdefault(len(w), []).append(w)
    trees, leaves = {}, 0
    for length, group in sorted(by_length.items()):
        own: list[Node] = []
        trees[length] = grow(unary(letters(group)), max(SEEN, LEAF // one_in), own, tight=False)
        for leaf in own:
            leaf.leaf, leaf.members = leaf.leaf + leaves, None
        leaves += len(own)
    return trees, leaves


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best of a table of distinct ``word`` and ``n``: the words one edit away, counted, and the most frequent."""
    ship(words.sparkSession)
    trees, leaves = _upper_trees(words, words.count())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("word").to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, w in enumerate(names):
                by_length.setdefault(len(w), []).append(i)
            for length, index in by_length.items():
                codes, at = unary(letters([names[i] for i in index])), np.array(index)
                # a length that the sample missed is one leaf, numbered below 0
                own, longer = (trees.get(x) or Node(np.zeros(2, np.uint64), np.full(2, ALL), leaf=-x) for x in (length, length + 1))
                dealt = [(leaf, q, 0) for leaf, q in within(own, codes, 0)]
                home = np.empty(len(index), np.int64)
                for leaf, q, _ in dealt:
                    home[q] = leaf.leaf
                dealt += [(leaf, q[home[q] != leaf.leaf], 1) for leaf, q in within(own, codes, 2)]
                dealt += [(leaf, q, 2) for leaf, q in within(longer, codes, 1)]
                for leaf, q, role in dealt:
                    rows = batch.take(pa.array(at[q]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(q), leaf.leaf, np.int64)), pa.array(np.full(len(q), role, np.int8)), rows.column("word"), rows.column("n")],
                        names=["leaf", "role", "word", "n"])

    dealt = words.select("word", "n").mapInArrow(deal, "leaf long, role byte, word string, n long")
    # a stated number of tasks: few bytes are much work here
    tasks = max(1, min(leaves, 4096))
    found = dealt.repartition(tasks, "leaf").groupBy("leaf").applyInArrow(_search_leaf, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def variants(counts: DataFrame, least_n: int = 5, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n from counts of words (``word``, ``n``; repeated words are summed).

    A word's form is its near word of largest n, if that is at least ``factor`` times
    its own; the root is where the forms lead.
    """
    if factor < 2:
        raise ValueError("counts must grow along a chain of forms")
    words = counts.where(F.col("word") != "").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)
    words = materialise(words, "spelling-words")
    near = near_words(words)
    has_form = F.col("best_n") >= F.col("n") * factor
    table = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")), "spelling-forms")

    largest = table.agg(F.max("form_n")).first()[0]
    roots = table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    hops = int(math.log(max(1, largest or 1) / least_n, factor) + 1e-9) if largest else 0
    for _ in range(math.ceil(math.log2(hops)) if hops > 1 else 0):
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialise(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return table.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
