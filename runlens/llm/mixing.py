"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Every source has a weight and may be used for at most ``max_epochs`` passes.
The budget is ``share`` of all words. A source's target is its weight's part of
the budget, clamped at ``max_epochs`` times its size; what a clamped source
cannot take is shared again among the others by weight until no target is above
its clamp. That fixed point is a water level: with sources sorted by clamp per
weight, the level behind the first k clamped sources is (budget - their clamps)
/ (weights of the rest), and the first k whose level does not exceed the next
clamp per weight is the answer. Prefix sums over one row per source find it, so
there is no loop and no driver round trip.

A source's target divided by its size gives whole passes and a rest. Whole
passes repeat every document; the rest takes the documents that come first in a
seeded hash order until their words reach it (within half a document). The cut
is found from word sums per (source, hash prefix); only the rows of the one
prefix in which the cut falls are ordered, so a source that holds a third of
all rows never meets in one task, and texts are never shuffled.

Defined results: null texts have size 0; the null source is a source of its own
and comes last; a source without words has target 0 and each of its rows is taken
as the whole passes say (0); rows equal in id and size share one decision; an
empty table gives an empty result. Input columns named as an output column are
replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import column, free, group_key, materialise, without, word_count

OUTPUT = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
#: Hex digits of the hash that form a bucket: 4096 buckets per source.
PREFIX = 3


def seeded_order(ident: Column, seed: str) -> Column:
    """Hex digest that orders rows; the same on every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))


def water_fill(sources: DataFrame, weights: Sequence[float], max_epochs: float, share: float) -> DataFrame:
    """One row (source, total) per source to (key, source_size, target)."""
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.select(
        "key", "source", "total", (F.row_number().over(by_name) - 1).alias("place"),
        F.sum("total").over(whole).alias("all_words"),
    ).select(
        "*", F.element_at(cycle, F.col("place") % F.lit(len(weights)) + 1).alias("weight"),
        (F.col("total") * F.lit(float(max_epochs))).alias("clamp"),
    ).withColumn("ratio", F.col("clamp") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "place")
    clamped_before = F.coalesce(F.sum("clamp").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("all_words") * F.lit(float(share)) - clamped_before) / weights_left)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(whole)["level"]
    target = F.least("clamp", F.coalesce(level * F.col("weight"), F.col("clamp")))
    return rows.select("key", F.col("total").alias("source_size"), target.alias("target"))


def _plan(slim: DataFrame, weights, max_epochs: float, share: float) -> DataFrame:
    """Per source: size, target, whole passes and the cut of the partial pass."""
    buckets = slim.groupBy("key", "source", F.substring("h", 1, PREFIX).alias("b")).agg(F.sum("size").alias("words"))
    sources = buckets.groupBy("key", "source").agg(F.sum("words").alias("total"))
    per_source = water_fill(sources, weights, max_epochs, share).withColumns({
        "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
    }).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    before = F.coalesce(F.sum("words").over(
        Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the last bucket that begins before the rest is used up holds the cut
    edge = (buckets.withColumn("before", before).join(per_source, "key")
            .where(F.col("before") < F.col("rest"))
            .groupBy("key").agg(F.max(F.struct("b", "before")).alias("e"), F.first("rest").alias("rest"))
            .select("key", "rest", "e.b", "e.before"))
    edge_rows = (slim.select("key", "h", "size", F.substring("h", 1, PREFIX).alias("b")).join(edge, ["key", "b"])
                 .groupBy("key", "b", "rest", "before", "h", "size").agg(F.sum("size").alias("words")))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("h", "size"))
    taken = edge_rows.withColumn("middle", F.col("before") + upto - F.col("words") / 2)
    cut = (taken.groupBy("key", "b")
           .agg(F.max(F.when(F.col("middle") <= F.col("rest"), F.struct("h", "size"))).alias("c"))
           # nothing of the edge bucket taken: the cut lies just before it
           .select("key", F.coalesce(F.col("c.h"), F.col("b")).alias("cut_h"),
                   F.coalesce(F.col("c.size"), F.lit(-1)).alias("cut_size")))
    return per_source.join(cut, "key", "left").select("key", "source_size", "target", "whole", "cut_h", "cut_size")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3.0, share: float = 1.0,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                size_col: str | None = None, seed: str = "mix") -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target (words) and mix_copies.

    ``weights`` are dealt to the sources in code point order, repeating.
    ``size_col`` names a column that holds the sizes already.
    """
    size = column(docs, size_col).cast("long") if size_col else word_count(column(docs, text_col))
    size, source = F.coalesce(size, F.lit(0)), column(docs, source_col)
    key, h = group_key(source), seeded_order(column(docs, id_col), seed)
    slim = materialise(docs.select(key.alias("key"), source.cast("string").alias("source"), size.alias("size"), h.alias("h")), "mix-sizes")
    plan = materialise(_plan(slim, weights, max_epochs, share), "mix-plan")  # one row per source: Catalyst sees its size

    keep = without(docs, OUTPUT)
    key_name, h_name, plan_name = (free(docs, n) for n in ("_key", "_h", "_plan"))
    sized = docs.select(*[column(docs, c) for c in keep], size.alias("mix_size"), key.alias(key_name), h.alias(h_name))
    plan = plan.select(F.col("key").alias(key_name), F.struct(*[c for c in plan.columns if c != "key"]).alias(plan_name))
    out = sized.join(plan, key_name, "left")
    chosen = F.col(plan_name)
    first = F.struct(F.col(h_name).alias("h"), F.col("mix_size").alias("s")) <= F.struct(
        chosen["cut_h"].alias("h"), chosen["cut_size"].cast("long").alias("s"))
    extra = F.when(chosen["cut_h"].isNotNull() & first, 1).otherwise(0)
    return out.select(
        *[column(out, c) for c in keep], "mix_size", chosen["source_size"].alias("mix_source_size"),
        chosen["target"].alias("mix_target"), (chosen["whole"] + extra).cast("long").alias("mix_copies"))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as mix_copies says (never for 0)."""
    copies, name = mixed.where(F.col("mix_copies") > 0), free(mixed, "_copy")
    return copies.withColumn(name, F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(
        *[column(copies, c) for c in without(mixed, OUTPUT)])
