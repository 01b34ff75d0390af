"""Dataset preparation: null handling, label validation, exact stratified
splits, multiple-choice explode, vocabulary encoding, padding and chunking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.arrays import posexplode_rows
from runlens.functions.text import parse_label
from runlens.operators.positions import number_rows
from runlens.operators.ranking import null_safe_join
from runlens.session import scratch_path

PAD_ID = 0
UNK_ID = 1
FIRST_WORD_ID = 2
#: Marks of a pair, outside the range of word ids.
CLS_ID, SEP_ID = -1, -2
LABEL_MIN, LABEL_MAX = 0, 4
#: Rows with ids that one task numbers together: they are sorted whole, so the usual block would hold gigabytes.
WIDE_ROWS = 1 << 14
#: Hex digits of the hash that form a bucket of a class.
SPLIT_PREFIX = 3


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row report) for ``na.drop``; the report counts
    total, kept, dropped and the dropped percentage in one aggregate."""
    cols = list(subset) if subset else df.columns
    if how == "any":
        ok = F.lit(True)
        for c in cols:
            ok = ok & F.col(c).isNotNull()
    else:
        ok = F.lit(False)
        for c in cols:
            ok = ok | F.col(c).isNotNull()
    report = df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_kept"),
                    F.count_if(~ok).alias("n_dropped"))
    report = report.withColumn("pct_dropped", F.try_divide(F.col("n_dropped") * 100.0, F.col("n_total")))
    return df.where(ok), report


def parse_labels(df: DataFrame, text_col: str, strict: bool = False, where: Sequence[str] = ()) -> DataFrame:
    """Adds ``label`` (bigint) and ``reason`` (null when parsed).

    ``strict`` fails the job at a bad label and names it with the values of the
    columns ``where`` (its split and row, say)."""
    label, reason = parse_label(text_col)
    if strict:
        at = [F.concat(F.lit(f", {c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in where]
        said = F.concat(F.lit("bad label "), F.coalesce(F.col(text_col), F.lit("null")), F.lit(": "), reason, *at)
        label = F.when(reason.isNull(), label).otherwise(F.raise_error(said).cast("bigint"))
    return df.withColumns({"label": label, "reason": reason})


def label_range_report(df: DataFrame, label: str = "label", lo: int = LABEL_MIN, hi: int = LABEL_MAX,
                       strict: bool = False) -> DataFrame:
    """Counts of parsed labels outside [lo, hi]; ``strict`` fails the job."""
    out_of_range = F.count_if(F.col(label).isNotNull() & ~F.col(label).between(lo, hi))
    rep = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(label).alias("n_parsed"),
                 out_of_range.alias("n_out_of_range"))
    rep = rep.withColumn("ok", F.col("n_out_of_range") == 0)
    if strict:
        rep = rep.withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(
            F.raise_error(F.lit(f"labels outside [{lo}, {hi}]")).cast("boolean")))
    return rep


def seeded_key(key: str, seed: int) -> Column:
    """Deterministic pseudo-random order: md5 of 'seed:key'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _quotas(counts: DataFrame, label: str, n_col: str, frac: float, out: str) -> DataFrame:
    """Largest-remainder allocation of ceil(frac * n) draws over classes
    (ties to the smaller label); ``counts`` has one row per class."""
    w_all = Window.partitionBy()
    n = F.sum(n_col).over(w_all)
    n_draw = F.ceil(F.lit(frac) * n)
    cont = F.col(n_col) * n_draw / n
    x = counts.withColumns({"_cont": cont, "_floor": F.floor(cont)})
    x = x.withColumns({"_rem": F.col("_cont") - F.col("_floor"),
                       "_need": n_draw - F.sum("_floor").over(w_all)})
    r = F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(label)))
    return x.withColumn(out, (F.col("_floor") + F.when(r <= F.col("_need"), 1).otherwise(0)).cast("bigint")) \
        .drop("_cont", "_floor", "_rem", "_need")


def stratified_split(df: DataFrame, label: str, key: str, test_frac: float = 0.1, dev_frac: float | None = 0.1111,
                     seed: int = 42, split_col: str = "split") -> DataFrame:
    """Exact stratified split: test = ceil(test_frac * n) rows allocated to
    classes by largest remainder, then dev = ceil(dev_frac * rest) the same way
    over the remaining rows, train the rest. Members are the first rows of each
    class in md5(seed:key) order. Counts per (class, first hash digits) tell for
    all rows of a bucket where they fall, unless a quota ends inside the bucket;
    only the rows of those buckets, two per class, are numbered. Rows are
    neither sorted nor checkpointed.

    The class-count table has one row per class (the label domain), so the
    quota windows run over a bounded frame. The null class is a class."""
    hashed = df.withColumn("_h", seeded_key(key, seed))
    hashed = hashed.withColumn("_b", F.coalesce(F.substring("_h", 1, SPLIT_PREFIX), F.lit("")))
    buckets = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_in"))
    counts = buckets.groupBy(label).agg(F.sum("_in").alias("_n"))
    q = _quotas(counts, label, "_n", test_frac, "_q_test")
    if dev_frac is not None:
        q = q.withColumn("_n_rest", F.col("_n") - F.col("_q_test"))
        q = _quotas(q, label, "_n_rest", dev_frac, "_q_dev")
    else:
        q = q.withColumn("_q_dev", F.lit(0).cast("bigint"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("_from", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    test_end, dev_end = F.col("_q_test"), F.col("_q_test") + F.col("_q_dev")
    inside = lambda end: (F.col("_from") < end) & (end < F.col("_from") + F.col("_in"))
    starts = null_safe_join(starts, q.select(label, "_q_test", "_q_dev"), [label]).withColumn(
        "_edge", inside(test_end) | inside(dev_end))
    placed = null_safe_join(hashed, starts, [label, "_b"])
    number = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) - 1
    edge = placed.where("_edge").withColumn("_r", F.col("_from") + number)
    rest = placed.where("not _edge").withColumn("_r", F.col("_from").cast("long"))
    split = (F.when(F.col("_r") < test_end, "test").when(F.col("_r") < dev_end, "dev").otherwise("train"))
    return rest.unionByName(edge).withColumn(split_col, split).select(*df.columns, split_col)


def split_summary(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows and normalised class share per split."""
    c = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy(split).agg(F.sum("n").alias("_tot"))
    return null_safe_join(c, tot, [split]).withColumn("share", F.col("n") / F.col("_tot")).drop("_tot")


def row_index(df: DataFrame, partition_by: Sequence[str], order: Sequence[str], name: str = "index") -> DataFrame:
    """Dense 0-based index restarting per partition value."""
    return number_rows(df, list(order), partition_by=list(partition_by), name=name)


def grid_minus_done(grid: Mapping[str, Sequence], done: DataFrame) -> DataFrame:
    """P10: the Cartesian grid of hyperparameter values (a generated frame of
    the parameter lists, not a join of data) minus finished combinations, with
    a run number in grid order."""
    spark = done.sparkSession
    names = list(grid)
    g = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in grid[names[0]]])).alias(names[0]))
    for n in names[1:]:
        g = g.select("*", F.explode(F.array(*[F.lit(v) for v in grid[n]])).alias(n))
    todo = g.join(done.select(*names).distinct(), names, "left_anti")
    w = Window.orderBy(*names)  # the grid is bounded by the parameter lists
    return todo.withColumn("run_no", F.row_number().over(w))


def explode_choices(df: DataFrame, key: str, context: str, candidates: Sequence[str]) -> DataFrame:
    """One row per (example, choice) with the context repeated."""
    arr = F.array(*[F.col(c) for c in candidates])
    out = df.select(key, F.col(context).alias("context"), F.posexplode(arr).alias("choice", "candidate"))
    return out.where(F.col("candidate").isNotNull())


def join_choices(examples: DataFrame, candidates: DataFrame, key: str, context: str, choice: str, candidate: str) -> DataFrame:
    """P11 where the candidates are rows already (``key``, ``choice``, ``candidate``): each with its example's context."""
    found = candidates.where(F.col(candidate).isNotNull()).select(key, F.col(choice).alias("choice"), F.col(candidate).alias("candidate"))
    return examples.select(key, F.col(context).alias("context")).join(found, key)


def regroup_choices(df: DataFrame, key: str, choice: str, value: str, name: str = "choices") -> DataFrame:
    """P11 inverse: back to one row per example with the values in choice order
    (groups are bounded by the number of choices)."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(choice), F.col(value)))).alias("_s"))
    return g.select(key, F.transform("_s", lambda s: s[value]).alias(name))


def doc_word_counts(words: DataFrame, doc: str = "doc_id", word: str = "word") -> DataFrame:
    """Occurrences of each word in each document (partial aggregate per task)."""
    # The explicit not-null filter matches the one Catalyst infers for the
    # vocabulary join, so both consumers share one shuffle (ReusedExchange).
    return words.where(F.col(word).isNotNull()).groupBy(doc, word).agg(F.count(F.lit(1)).alias("n"))


def word_frequencies(words: DataFrame, word: str = "word") -> DataFrame:
    """Corpus frequency of every word (partial aggregate before the shuffle)."""
    return words.groupBy(word).agg(F.count(F.lit(1)).alias("freq"))


def vocabulary(freq: DataFrame, word: str = "word", size: int = 5000) -> DataFrame:
    """The ``size`` most frequent words (count desc, word asc) with ids
    from FIRST_WORD_ID, from a (word, freq) frame; a bounded top-k, so the
    result may be broadcast."""
    top = freq.orderBy(F.col("freq").desc(), F.col(word)).limit(size)
    w = Window.orderBy(F.col("freq").desc(), F.col(word))  # at most `size` rows
    return top.withColumn("word_id", (F.row_number().over(w) + FIRST_WORD_ID - 1).cast("int"))


def frequencies_from_counts(counts: DataFrame, word: str = "word") -> DataFrame:
    return counts.groupBy(word).agg(F.sum("n").alias("freq"))


def bag_of_words(counts: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """Per-document counts of vocabulary words; the per-document counts
    feed both the vocabulary and this join, so the text is tokenised once."""
    return counts.join(F.broadcast(vocab.select(word)), word)


def token_ids(df: DataFrame, keys: Sequence[str], tokens: Column, vocab: DataFrame, name: str) -> DataFrame:
    """Word ids of a token array (UNK_ID outside the vocabulary), one row per
    row of ``df``; empty arrays come through the outer explode. (A map lookup
    per token is not used: Spark map lookups scan the keys linearly.)

    Rows are told apart by the keys and a hash of their tokens; rows alike in both have the
    same ids, are encoded once, counted by their first positions and repeated."""
    rows = df.select(*keys, tokens.alias("_tokens")).withColumn("_row", F.xxhash64("_tokens"))
    rows = rows.select(*keys, "_row", F.posexplode_outer("_tokens").alias("_pos", "word"))
    rows = rows.join(F.broadcast(vocab.select("word", "word_id")), "word", "left")
    ids = F.collect_set(F.when(F.col("_pos").isNotNull(), F.struct(F.col("_pos"), F.coalesce(F.col("word_id"), F.lit(UNK_ID)).alias("id"))))
    got = rows.groupBy(*keys, "_row").agg(F.array_sort(ids).alias("_s"), F.count_if(F.coalesce(F.col("_pos"), F.lit(0)) == 0).alias("_n"))
    got = got.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    return got.select(*keys, F.transform("_s", lambda s: s["id"]).alias(name))


def _padded(ids: Column, length: Column) -> tuple[Column, Column]:
    pad = F.array_repeat(F.lit(PAD_ID), (length - F.size(ids)).cast("int"))
    return F.concat(ids, pad), F.concat(F.array_repeat(F.lit(1), F.size(ids)), pad)


def encode_fixed_length(docs: DataFrame, tokens: str, vocab: DataFrame, max_length: int,
                        doc: str = "doc_id") -> DataFrame:
    """The first ``max_length`` word ids of every document, padded with
    PAD_ID, plus the attention mask. Token arrays are cut to ``max_length``
    before they are exploded, so the broadcast vocabulary join and the regroup
    see at most max_length rows per document."""
    ids = token_ids(docs, [doc], F.slice(F.col(tokens), 1, max_length), vocab, "_ids")
    input_ids, mask = _padded(F.col("_ids"), F.lit(max_length))
    return ids.select(doc, input_ids.alias("input_ids"), mask.alias("attention_mask"), F.size("_ids").alias("n_tokens"))


def encode_pairs(rows: DataFrame, keys: Sequence[str], first: str, second: str, vocab: DataFrame,
                 max_length: int = 512) -> DataFrame:
    """P12 with two texts: [CLS] first [SEP] second [SEP], padded to ``max_length``.

    ``first`` and ``second`` are token arrays. If both don't fit, tokens go from
    the end of the longer one until they do (longest first; on equal lengths from
    the second)."""
    room = F.lit(max_length - 3)
    a, b = F.size(first), F.size(second)
    half = F.floor(room / 2)
    # the shorter keeps its length up to half of the room, the longer gets the rest; of an odd room the first gets one more
    keep_a = F.when(a + b <= room, a).when(b <= half, room - b).when(a <= room - half, a).otherwise(room - half).cast("int")
    keep_b = F.when(a + b <= room, b).when(b <= half, b).otherwise(room - keep_a).cast("int")
    cut = rows.select(*keys, F.slice(F.col(first), F.lit(1), keep_a).alias("_a"), F.slice(F.col(second), F.lit(1), keep_b).alias("_b"))
    cut = cut.withColumns({"_n": F.size("_a"), "_t": F.concat("_a", "_b")})
    ids = token_ids(cut.withColumnRenamed("_n", "_first"), [*keys, "_first"], F.col("_t"), vocab, "_ids")
    mark = lambda i: F.array(F.lit(i))
    whole = F.concat(mark(CLS_ID), F.slice("_ids", F.lit(1), F.col("_first")), mark(SEP_ID),
                     F.slice("_ids", F.col("_first") + 1, F.size("_ids")), mark(SEP_ID))
    input_ids, mask = _padded(F.col("_whole"), F.lit(max_length))
    return ids.withColumn("_whole", whole).select(
        *keys, input_ids.alias("input_ids"), mask.alias("attention_mask"), F.size("_whole").alias("n_tokens"))


def _batches(df: DataFrame, key: str, size: Column, batch_size: int, rows: int | None = None) -> DataFrame:
    """Rows numbered in key order (rows of one key by their other columns), cut into batches, with the longest size of each."""
    order = [key, *[c for c in df.columns if c != key and c != "_size"]]
    numbered = number_rows(df.withColumn("_size", size), order, name="_rn", rows=rows)
    batch = F.floor(F.col("_rn") / batch_size).cast("bigint")
    # a batch has batch_size rows
    return numbered.withColumn("batch_id", batch).withColumn("padded_len", F.max("_size").over(Window.partitionBy("batch_id"))).drop("_rn")


def pad_batches(encoded: DataFrame, key: str, ids: str, batch_size: int) -> DataFrame:
    """Consecutive batches of ``batch_size`` rows in key order; ids and masks
    padded to the longest row of the batch, other columns untouched. The rows are written once, as
    cutting them into blocks of ``WIDE_ROWS`` reads them several times."""
    path = scratch_path(encoded.sparkSession, "pad-batches")
    encoded.write.parquet(path)
    stored = encoded.sparkSession.read.schema(encoded.schema).parquet(path)
    b = _batches(stored, key, F.size(ids), batch_size, WIDE_ROWS).drop("_size")
    input_ids, mask = _padded(F.col(ids), F.col("padded_len"))
    return b.withColumns({"input_ids": input_ids, "attention_mask": mask})


def batch_pad_lengths(df: DataFrame, key: str, length: Column, batch_size: int) -> DataFrame:
    """The lengths to which ``pad_batches`` pads, without ids."""
    return _batches(df, key, length, batch_size).withColumnRenamed("_size", "n_tokens")


def sliding_chunks(df: DataFrame, key: str, tokens: str, size: int, stride: int, first_only: bool = False) -> DataFrame:
    """Windows of ``size`` tokens every ``stride`` tokens until the end is
    covered (or only the first window)."""
    n = F.size(tokens)
    n_chunks = F.lit(1) if first_only else 1 + F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(stride)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n_chunks - 1))  # no chunk for an empty text
    x = posexplode_rows(df, [key, tokens], starts, "_p", "chunk_no").drop("_p")
    start = F.col("chunk_no") * stride
    part = F.slice(tokens, start + 1, F.lit(size))
    return x.select(key, "chunk_no", start.alias("start"), F.size(part).alias("n_words"),
                    F.array_join(part, " ").alias("text"))
