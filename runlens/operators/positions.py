"""Numbers, quantiles and carries along a total order, for tables of any size.

A table is cut into blocks: ranges of the order, ``ROWS`` rows each as a rule. The
cuts are quantiles of the order's first column as a number; a value so frequent that
its block stays hot is cut again by what follows (the next bytes of a string, the next
column). They are collected once (at most ``BLOCKS`` per step) and enter the plan as
values, so a recomputed task cuts as the first one did, and nothing is
sorted or stored beforehand. Rows are then worked on inside (group, block),
one exchange and one read, and what crosses a block's border comes from a table with
one row per (group, block): its rows, its first, last or largest value, summed up along
the group. A table of up to ``ROWS`` rows is one block and needs no such table. Groups of
up to ``ROWS`` rows are not cut: only larger ones, which a count per group finds, lie in blocks.

An order is a list of column names, ``-name`` for descending; nulls come first when
ascending and last when descending, as in Spark. It must be total for numbers to be
unique. Null groups are groups.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators.ranking import has_value, null_safe_join

#: Rows of a block, blocks that one step of cutting makes at most.
ROWS, BLOCKS = 1 << 20, 4096
#: Bytes of a string that make a number, and how many such numbers are tried.
CHUNK, CHUNKS = 6, 10
LARGEST = sys.float_info.max
#: Distinct values that ``exact_quantiles`` looks through at once.
BINS = 1024


def sort_columns(order: Sequence[str]) -> list[Column]:
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def _plain(name: str) -> str:
    return name.removeprefix("-")


def _numbers(df: DataFrame, name: str) -> list[Column]:
    """Numbers that ascend with a column's order, the later ones for ties of the earlier."""
    c, kind = F.col(_plain(name)), df.schema[_plain(name)].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = c.cast("binary")
        part = [F.rpad(F.hex(F.substring(raw, 1 + i * CHUNK, CHUNK)), 2 * CHUNK, "0") for i in range(CHUNKS)]
        out = [F.conv(p, 16, 10).cast("double") for p in part]
    elif isinstance(kind, T.DateType):
        out = [F.unix_date(c).cast("double")]
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = [F.unix_micros(c.cast("timestamp")).cast("double")]
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        x = c.cast("double") if isinstance(kind, T.NumericType) else c.cast("int").cast("double")
        # NaN is above infinity; infinities are as good as the largest numbers
        out = [F.when(F.isnan(x), F.lit(math.inf)).when(x.isNotNull(), F.least(F.greatest(x, F.lit(-LARGEST)), F.lit(LARGEST)))]
    else:
        out = []  # no number: ties of the columns before stay together
    least = F.lit(-math.inf)  # null is the least of all
    out = [F.coalesce(x, least) for x in out]
    return [-x for x in out] if name.startswith("-") else out


def _nested(cuts: list[float]) -> tuple[list[float], list[list[float]]]:
    """Sorted cuts in two levels, so that a look-up compares with the square root of their number twice."""
    step = max(1, math.isqrt(len(cuts)))
    fine = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    return [f[0] for f in fine], fine


def cut_blocks(df: DataFrame, order: Sequence[str], at_most: int | None = None, rows: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """``df`` with ``_block``, ascending along ``order``, and the rows of each block (``rows`` or ``ROWS`` as a rule).
    A table known to have ``at_most`` so many rows is not counted if that is one block."""
    rows = rows or ROWS
    total = at_most if at_most is not None and at_most <= rows else df.count()
    out, sizes = df.withColumn("_block", F.lit(0).cast("long")), {0: total}
    live = {0}  # blocks whose rows agree in all columns before
    for name in order if total > rows else ():
        if name != order[0] and not any(sizes[b] > 2 * rows for b in live):
            break
        c = F.col(_plain(name))
        tied = (F.count(c) == 0) | ((F.count(c) == F.count(F.lit(1))) & F.min(c).eqNullSafe(F.max(c)))
        open_ = live
        for key in _numbers(df, name):
            hot = {b for b in open_ if sizes[b] > (2 * rows if len(sizes) > 1 else rows)}
            if not hot:
                break
            want = min(BLOCKS, max(-(-sizes[b] // rows) for b in hot))
            fractions = [i / want for i in range(1, want)]
            found = out.where(F.col("_block").isin(*hot)).groupBy("_block").agg(
                F.percentile_approx(key, fractions, max(10_000, 8 * want)).alias("cuts")).collect()
            cuts: dict[int, list[float]] = {}
            for r in found:
                # a value that fills more than a block gets a block of its own
                often = {x for x, y in zip(r["cuts"], r["cuts"][1:], strict=False) if x == y}
                cuts[r["_block"]] = sorted({*r["cuts"], *(math.nextafter(x, math.inf) for x in often if x < math.inf)})
            table, alone, at = [], set(), 0
            for b in sorted(sizes):
                coarse, fine = _nested(cuts.get(b, []))
                table.append((b, at, coarse, fine, [len(f) for f in fine]))
                mine = cuts.get(b, [])
                alone |= {at + 1 + i for i, x in enumerate(mine) if x == math.inf or (i + 1 < len(mine) and math.nextafter(x, math.inf) == mine[i + 1])}
                at += len(mine) + 1
            cut = F.broadcast(df.sparkSession.createDataFrame(
                table, "_block long, _base long, _coarse array<double>, _fine array<array<double>>, _width array<int>"))
            i = F.size(F.filter("_coarse", lambda x: x <= F.col("_key")))
            j = F.size(F.filter(F.get("_fine", F.col("_i") - 1), lambda x: x <= F.col("_key")))
            before = F.col("_base") + F.when(F.col("_i") > 0, F.aggregate(
                F.slice("_width", F.lit(1), F.greatest(F.col("_i") - 1, F.lit(0))), F.lit(0), lambda x, y: x + y) + j).otherwise(0)
            keyed = out.withColumn("_key", key).join(cut, "_block").withColumn("_i", i)
            out = keyed.select(*df.columns, before.cast("long").alias("_block"))
            sizes, live = _sizes(out, tied)
            open_ = alone & sizes.keys()
        if not _numbers(df, name):
            break
    return out, sizes


def _sizes(blocks: DataFrame, tied: Column) -> tuple[dict[int, int], set[int]]:
    rows = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("n"), tied.alias("tied")).collect()
    return {r["_block"]: r["n"] for r in rows}, {r["_block"] for r in rows if r["tied"]}


def cut_groups(df: DataFrame, group: Sequence[str], order: Sequence[str], at_most: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """``cut_blocks`` for work inside groups: a group of up to ``ROWS`` rows lies whole in one block (-1 beside
    larger ones), and if there are no others the table counts as one block and nothing is looked up.
    The driver sees one row per larger group, of which there are at most rows / ``ROWS``."""
    total = at_most if at_most is not None and at_most <= ROWS else df.count()
    large = []
    if total > ROWS:
        large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > ROWS).select(*group).collect()
    if not large:
        return df.withColumn("_block", F.lit(0).cast("long")), {0: total}
    blocks, sizes = cut_blocks(df, order, at_most)
    marked = df.sparkSession.createDataFrame([(*r, True) for r in large], T.StructType([*df.select(*group).schema.fields, T.StructField("_large", T.BooleanType())]))
    out = null_safe_join(blocks, F.broadcast(marked), group, "left")
    return out.select(*df.columns, F.when(F.col("_large"), F.col("_block")).otherwise(-1).alias("_block")), sizes


def _along(group: Sequence[str], order: Sequence[str], sizes: dict[int, int]):
    """Window over a group's rows inside a block."""
    return Window.partitionBy(*group, *(["_block"] if len(sizes) > 1 or not group else [])).orderBy(*sort_columns(order))


def number_rows(df: DataFrame, order: Sequence[str], partition_by: Sequence[str] = (), name: str = "idx",
                at_most: int | None = None, rows: int | None = None) -> DataFrame:
    """0-based number of each row in ``order``, from 0 again for every ``partition_by`` value.
    ``rows``: of a block, where rows are wide; without ``partition_by`` only."""
    if partition_by and rows:
        raise ValueError("groups are cut into blocks of the usual size")
    blocks, sizes = cut_groups(df, partition_by, order, at_most) if partition_by else cut_blocks(df, order, at_most, *([rows] if rows else []))
    out = blocks.withColumn(name, (F.row_number().over(_along(partition_by, order, sizes)) - 1).cast("long"))
    if len(sizes) > 1:
        if partition_by:
            before = Window.partitionBy(*partition_by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            starts = blocks.groupBy(*partition_by, "_block").agg(F.count(F.lit(1)).alias("_n")).select(
                *partition_by, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_block_start"))
        else:
            running = [(b, sum(sizes[a] for a in sizes if a < b)) for b in sizes]
            starts = F.broadcast(df.sparkSession.createDataFrame(running, "_block long, _block_start long"))
        out = null_safe_join(out, starts, [*partition_by, "_block"]).withColumn(name, F.col(name) + F.col("_block_start"))
    return out.select(*df.columns, name)


def running_max_before(df: DataFrame, group: str, order: Sequence[str], value: str, name: str = "prev_best") -> DataFrame:
    """Maximum of ``value`` over all earlier rows of the group (null for its first row);
    null and NaN values raise no maximum."""
    blocks, sizes = cut_groups(df, [group], order)
    held = F.when(has_value(F.col(value)), F.col(value))
    earlier = _along([group], order, sizes).rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.withColumn(name, F.max(held).over(earlier))
    if len(sizes) > 1:
        before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carry = blocks.groupBy(group, "_block").agg(F.max(held).alias("_max")).select(
            group, "_block", F.max("_max").over(before).alias("_block_max"))
        out = null_safe_join(out, carry, [group, "_block"]).withColumn(name, F.greatest("_block_max", name))
    return out.select(*df.columns, F.col(name).cast(df.schema[value].dataType).alias(name))


def with_previous(df: DataFrame, group: str, order: Sequence[str], value: str, previous: str = "previous", first: str = "first",
                  number: str = "number") -> DataFrame:
    """Per row of a group: the ``value`` of the row before, of the group's first row, and its 0-based number."""
    if any(o.startswith("-") for o in order):
        raise ValueError("with_previous takes an ascending order")
    blocks, sizes = cut_groups(df, [group], order)
    w = _along([group], order, sizes)
    out = blocks.withColumns({previous: F.lag(value).over(w), first: F.first(value).over(w), number: (F.row_number().over(w) - 1).cast("long")})
    if len(sizes) > 1:
        of_group = Window.partitionBy(group).orderBy("_block")
        before = of_group.rowsBetween(Window.unboundedPreceding, -1)
        key = F.struct(*[F.col(o) for o in order], F.col(value).alias("_value"))
        carry = blocks.groupBy(group, "_block").agg(
            F.count(F.lit(1)).alias("_n"), F.min(key).alias("_head"), F.max(key).alias("_tail")).select(
            group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_block_start"),
            F.lag("_tail._value").over(of_group).alias("_block_before"), F.first("_head._value").over(of_group).alias("_block_root"))
        out = null_safe_join(out, carry, [group, "_block"]).withColumns({
            previous: F.when(F.col(number) == 0, F.col("_block_before")).otherwise(F.col(previous)),
            first: F.col("_block_root"), number: F.col(number) + F.col("_block_start")})
    return out.select(*df.columns, previous, first, number)


# quantiles

def _at_ranks(freq: DataFrame, value: str, count: str, probs: Sequence[float], names: Sequence[str]) -> list[Column]:
    """Aggregates over (value, count, ``_upto``, ``_all``) rows: linearly interpolated quantiles."""
    out = []
    for q, name in zip(probs, names, strict=True):
        at = (F.col("_all") - 1) * F.lit(float(q))
        pick = lambda rank: F.max(F.when((F.col("_upto") - F.col(count) <= rank) & (rank < F.col("_upto")), F.col(value)))
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return out


def frequency_quantiles(freq: DataFrame, value: str, count: str, probs: Sequence[float], names: Sequence[str],
                        others: Sequence[Column] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles from distinct values and how often each occurs,
    with ``others``, aggregates over the same rows, in one row.

    One task runs over the table of frequencies: for values whose number is bounded (counts of
    rows per group sum up to the table's rows, so at most the square root of twice that number
    of different ones occur)."""
    run = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    summed = freq.withColumns({"_upto": F.sum(count).over(run), "_all": F.sum(count).over(whole)})
    return summed.agg(*others, *_at_ranks(summed, value, count, probs, names))


def exact_quantiles(values: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    """Exact, linearly interpolated quantiles of a numeric column (as pandas and ``quantile_cont``
    give them; null and NaN don't count) by selection: per pass, the ranges that hold a wanted rank
    are cut into ``BINS`` bins, and only counts, minima and maxima per bin come to the driver.
    A pass ends when every wanted rank lies in a bin of one value."""
    x = values.select(F.col(column).cast("double").alias("x")).where(has_value(F.col("x")))
    n, lo, hi = x.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(probs)
    places = [(n - 1) * float(q) for q in probs]
    ranks = {r for p in places for r in (math.floor(p), math.ceil(p))}
    known: dict[int, float] = {}
    todo = [(lo, hi, 0, n)]  # range, rows below it, rows up to its end
    while todo:
        parts = []
        for k, (a, b, below, end) in enumerate(todo):
            if a == b or math.isinf(a) or math.isinf(b):
                a, b = max(a, -1.7e308), min(b, 1.7e308)
            half = b / 2 - a / 2  # b - a may overflow
            place = F.floor((F.col("x") / 2 - a / 2) / half * BINS) if half > 0 else F.when(F.col("x") > a, 1).otherwise(0)
            parts.append(F.when((F.col("x") >= todo[k][0]) & (F.col("x") <= todo[k][1]), F.lit(k * (BINS + 3)) + 1 + F.least(F.greatest(place, F.lit(-1)), F.lit(BINS + 1))))
        bins = x.select("x", F.coalesce(*parts).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(
            F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("bin").collect()
        after, at = [], {k: t[2] for k, t in enumerate(todo)}
        for r in bins:
            k = int(r["bin"]) // (BINS + 3)
            held = {i for i in ranks if at[k] <= i < at[k] + r["n"]}
            if held and r["lo"] == r["hi"]:
                known |= dict.fromkeys(held, r["lo"])
            elif held:
                after.append((r["lo"], r["hi"], at[k], at[k] + r["n"]))
            at[k] += r["n"]
        todo = after
    return [known[math.floor(p)] + (known[math.ceil(p)] - known[math.floor(p)]) * (p - math.floor(p)) if p % 1 else known[int(p)] for p in places]
